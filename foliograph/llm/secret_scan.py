"""Secret scans by character Markov models.

Two first-order character models, one of random strings and one of ordinary identifiers,
score every run of key characters; a run whose log-likelihood ratio exceeds `min_llr` in
all and `min_llr_char` per character is a `random` span.  The models are trained from
labelled samples: runs of about `sample_rows` documents, labelled random where they are the
value of a base match, ordinary elsewhere, with seeded random strings.  Of the distinct runs of
those documents at most `sample_runs`, chosen by a hash, train the models, each by at most its first
`RUN_CHARS` characters, so what the driver holds is bounded.

Base kinds assign, access and hex are found by their patterns, in documents that a byte
scan of the block marks; base spans always stay.  Spans are in code points, end exclusive.

Defined results: null or empty text has no spans; a null doc_id is passed on; repeated rows
are each scanned; an empty table gives an empty one; without samples the ordinary model is
trained from the seeded strings' smoothing alone, and it is an error if there are rows but the
sample has none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
ORDER = {kind: n for n, kind in enumerate(KINDS)}
#: The cue words of assignments, in lower case.
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|"
    + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN, MIN_LLR, MIN_LLR_CHAR, SAMPLE_ROWS, SAMPLE_RUNS, RUN_CHARS = 16, 12.0, 0.6, 3000, 60_000, 4096
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

CODE = np.full(256, -1, np.int64)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
IS_KEY = CODE >= 0
IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def base_values(text: str) -> list[tuple[int, int]]:
    """Where the random part of each base match stands."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    return out + [m.span() for m in ACCESS.finditer(text)] + [m.span() for m in HEX.finditer(text)]


def _runs(member: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least `least` member bytes; none crosses a document's start."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    heads = start[:-1][start[:-1] < len(member)]
    opens[heads] = member[heads]
    tails = start[1:][start[1:] > 0] - 1
    closes[tails] = member[tails]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - begin >= least
    return begin[long], end[long]


def train(random: list[str], ordinary: list[str], seed: int = 7, drawn: int = 2000) -> np.ndarray:
    """The log-likelihood ratio of each pair of characters (previous, next), random over ordinary."""
    rng, size = np.random.default_rng(seed), len(ALPHABET)
    letters = np.frombuffer(ALPHABET.encode(), np.uint8)
    made = [bytes(letters[rng.integers(0, top, 32)]).decode() for top in (62, 64) for _ in range(drawn)]
    forms = [f for s in ordinary for f in (s, s.lower(), s.upper())]

    def model(strings: list[str], smooth: float) -> np.ndarray:
        counts = np.full((size, size), smooth)
        for s in strings:
            codes = CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)]
            codes = codes[codes >= 0]
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        return np.log(counts / counts.sum(1, keepdims=True))

    return model([*random, *made], 1.0) - model(forms, 0.5)


def random_runs(block: tb.Block, table: np.ndarray, min_llr: float, min_llr_char: float) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the runs that the models call random."""
    begin, end = _runs(IS_KEY[block.data], block.start, MIN_RUN)
    if not len(begin):
        return begin, end
    codes = CODE[block.data]
    pair = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * len(ALPHABET) + codes[1:], 0)
    total = np.concatenate(([0.0], np.cumsum(table.ravel()[pair])))
    llr = total[end - 1] - total[begin]
    good = (llr >= min_llr) & (llr >= min_llr_char * (end - begin - 1))
    return begin[good], end[good]


def _marked(block: tb.Block) -> np.ndarray:
    """Documents that may hold a base match."""
    marks = np.zeros(block.n, bool)
    raw, lower = block.data.tobytes(), LOWER[block.data].tobytes()
    places = []
    for where, words in ((lower, CUES), (raw, (b"AKIA",))):
        for word in words:
            at = where.find(word)
            while at >= 0:
                places.append(at)
                at = where.find(word, at + 1)
    begin, _ = _runs(IS_HEX[block.data], block.start, 24)
    marks[np.searchsorted(block.start, [*places, *begin], "right") - 1] = True
    return marks


def scan(block: tb.Block, texts, table: np.ndarray, min_llr: float, min_llr_char: float) -> list[list[tuple[str, int, int]]]:
    """All spans of each document of a block, by start, then kind."""
    out: list[list] = [[] for _ in range(block.n)]
    for n in np.flatnonzero(_marked(block)):
        out[n] = base_spans(texts[int(n)].as_py())
    begin, end = random_runs(block, table, min_llr, min_llr_char)
    docs = np.searchsorted(block.start, begin, "right") - 1
    points = np.concatenate(([0], np.cumsum(~tb.IS_TAIL[block.data]))) if len(begin) else None
    for n, a, b in zip(docs.tolist(), begin.tolist(), end.tolist(), strict=True):
        zero = points[block.start[n]]
        a, b = int(points[a] - zero), int(points[b] - zero)
        if not any(s < b and a < e for _, s, e in out[n]):
            out[n].append(("random", a, b))
    return [sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])) for spans in out]


def sample_bound(rows: int, total: int) -> int:
    """The signed 64-bit hash below which about `rows` of `total` rows lie."""
    return min((1 << 63) - 1, -(1 << 63) + (rows << 64) // max(1, total))


def bounded_sample(df: DataFrame, rows: int, *key: str, seed: str = "sample") -> DataFrame:
    """About `rows` rows of `df` chosen by a hash of `key` (all if there are no more)."""
    total = df.count()
    return df if total <= rows else df.where(F.xxhash64(F.lit(seed), *key) < F.lit(sample_bound(rows, total)))


def labelled_runs(df: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_runs: int = SAMPLE_RUNS) -> tuple[list[str], list[str]]:
    """Random and ordinary runs of a bounded sample of documents."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                values = base_values(text or "")
                rows += [(text[a : min(b, a + RUN_CHARS)], True) for a, b in values]
                for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", text or ""):
                    if not any(a < m.end() and m.start() < b for a, b in values):
                        rows.append((m.group()[:RUN_CHARS], False))
            rows = list(dict.fromkeys(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["run", "random"])

    chosen = bounded_sample(df, sample_rows, "doc_id", "text")
    found = chosen.mapInArrow(run, "run string, random boolean").distinct()
    rows = found.orderBy(F.xxhash64("run"), "run").limit(sample_runs).collect()
    if not rows and not chosen.limit(1).count() and df.limit(1).count():
        raise ValueError("the sample of documents is empty; raise sample_rows")
    return [r.run for r in rows if r.random], [r.run for r in rows if not r.random]


def secret_scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: np.ndarray | None = None,
    min_llr: float = MIN_LLR, min_llr_char: float = MIN_LLR_CHAR, sample_rows: int = SAMPLE_ROWS, sample_runs: int = SAMPLE_RUNS,
) -> DataFrame:
    """Per row: the number of base spans by kind, a digest of them, and all spans (no shuffle).

    `table` is a trained model (see `train`); without one it is trained from a sample of `df`.
    """
    docs = tb.id_and_text(df, id_col, text_col)
    if table is None:
        table = train(*labelled_runs(docs, sample_rows, sample_runs))

    def run(batches):
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                found = scan(block, batch.column(1).slice(block.row, block.n), table, min_llr, min_llr_char)
                base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
                counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
                digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
                columns = [*counts, pa.array(digests, pa.string()), pa.array([joined(s) for s in found], pa.string())]
                names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row, block.n), *columns], names=names)

    return docs.mapInArrow(run, SCHEMA)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
