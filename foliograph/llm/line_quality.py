"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad.  Its features are those of the line and of its two neighbours;
the chain's transition weights tie neighbouring labels.  Forward-backward gives every
line's marginal, and the document's score is their mean weighted by line length.

The field is fitted to documents whose lines all have the document's label, by L-BFGS on

    sum over d of w(d) log p(labels of d | lines of d) - penalty / 2 |theta|^2

with one weight a document for emissions and transitions alike, w(d) = 1 / (2 n(label) lines(d)),
so that documents count alike however long, and so do the two labels.  The sample is bounded:
about `sample_rows` labelled documents, and of those, in the order of a hash, as many as
have `sample_lines` lines in all; chains are cut into pieces of `SEGMENT` lines for fitting (scores
use whole documents).  Features come from text alone.

Defined results: a text without words scores 0; without labels every other text scores
0.5; several labels of one document count as their least; repeated rows score alike; a null
doc_id is scored and passed on; an empty table gives an empty one.  It is an error if there are
labelled documents but the sample has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .secret_scan import bounded_sample
from .shared import scratch

SAMPLE_ROWS, SAMPLE_LINES, SEGMENT, ROUNDS, PENALTY, THRESHOLD = 6000, 200_000, 64, 60, 3e-4, 0.3
FOLDS, HELD_OUT = 5, 0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_good_lines long"
#: Byte classes of the features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b"!", b"0123456789", b"|", b".,;:?")
WINDOW = 5
_IN_CLASS = np.zeros((len(CLASSES), 256), bool)
for _n, _class in enumerate(CLASSES):
    _IN_CLASS[_n, list(_class)] = True
#: Features of one line, and which of them its neighbours lend.
OWN = len(CLASSES) + 6
NEIGHBOUR = list(range(OWN))
WIDTH = OWN + 2 * len(NEIGHBOUR) + 3


@dataclass
class Lines:
    """Lines with a word: features, length in words, document, and each document's first line (n + 1)."""

    x: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = np.append(same, False) | np.insert(same, 0, False)
    return out


def line_features(block: tb.Block) -> Lines:
    data, words = block.data, tb.find_words(block)
    if not len(words.doc):
        return Lines(np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64))
    n = len(words.doc)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line_no = breaks[words.begin]
    opens = np.ones(n, bool)
    opens[1:] = (line_no[1:] != line_no[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.flatnonzero(opens)
    to = np.append(at[1:], n)
    begin, end, doc = words.begin[at], words.end[to - 1], words.doc[at]
    length = (to - at).astype(np.float64)
    n_bytes = (end - begin).astype(np.float64)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[to] - total[at]) / length

    columns = []
    for member in _IN_CLASS:
        total = np.concatenate(([0], np.cumsum(member[data])))
        columns.append((total[end] - total[begin]) / n_bytes)
    hashes = tb.span_hashes(data, words.begin, words.end)
    again = np.zeros(n, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    windows = tb.window_hashes(hashes, WINDOW)
    in_repeat = np.zeros(n, bool)
    if len(windows):
        salted = tb.mix64(windows ^ tb.mix64(words.doc[: len(windows)].astype(np.uint64)))
        salted[~tb.window_starts(words, WINDOW)] = np.arange((~tb.window_starts(words, WINDOW)).sum(), dtype=np.uint64)
        twice = np.flatnonzero(_repeated(salted))
        in_repeat = tb.covered(twice, WINDOW, n)
    line_hash = tb.mix64(tb.span_hashes(data, begin, end) ^ tb.mix64(doc.astype(np.uint64) + np.uint64(7)))
    own = np.stack(
        [*columns, np.log1p(length) / 5, n_bytes / length / 12, share(again), share(in_repeat), _repeated(line_hash).astype(float),
         share(_IN_CLASS[1][data[words.end - 1]])], axis=1,
    )
    first = np.searchsorted(doc, np.arange(block.n + 1))
    head, tail = np.ones(len(at), bool), np.ones(len(at), bool)
    head[1:], tail[:-1] = doc[1:] != doc[:-1], doc[1:] != doc[:-1]
    before = np.where(head[:, None], 0, np.roll(own, 1, 0))
    after = np.where(tail[:, None], 0, np.roll(own, -1, 0))
    x = np.concatenate([own, before[:, NEIGHBOUR], after[:, NEIGHBOUR], head[:, None], tail[:, None], np.ones((len(at), 1))], 1)
    return Lines(x.astype(np.float32), length, doc, first)


def forward_backward(emit: np.ndarray, first: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 of each line, weighted pair marginals summed over all lines, and log partition by document.

    `emit` is the score of state 1 over state 0 of each line, `move` the 2 x 2 transition scores, `weight`
    that of each document's pairs (default 1).  Documents advance together, one line at a time; those
    that ended drop out.  Both passes are scaled to probabilities, so no logarithm is taken on the way.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    steps = int(sizes.max()) if len(sizes) else 0
    alive = np.searchsorted(-sizes[order], -np.arange(steps), "left")
    begin = np.concatenate(([0], np.cumsum(alive)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = begin[np.arange(len(emit)) - first[doc]] + rank[doc]  # lines by their number in the document, then by document
    one, zero = np.empty(len(emit)), np.empty(len(emit))
    clipped = np.clip(emit, -500, 500)
    one[place], zero[place] = 1 / (1 + np.exp(-clipped)), 1 / (1 + np.exp(clipped))
    top = move.max()
    (m00, m01), (m10, m11) = np.exp(move - top)
    f0, f1, b0, b1 = np.empty(len(emit)), np.empty(len(emit)), np.ones(len(emit)), np.ones(len(emit))
    log_z = np.zeros(len(sizes))
    for t in range(steps):
        n, now = alive[t], slice(begin[t], begin[t + 1])
        x0, x1 = zero[now], one[now]
        if t:
            p0, p1 = f0[begin[t - 1] : begin[t - 1] + n], f1[begin[t - 1] : begin[t - 1] + n]
            x0, x1 = (p0 * m00 + p1 * m10) * x0, (p0 * m01 + p1 * m11) * x1
        scale = x0 + x1
        f0[now], f1[now] = x0 / scale, x1 / scale
        log_z[:n] += np.log(scale)
    pairs = np.zeros((2, 2))
    each = np.ones(len(sizes)) if weight is None else weight[order]
    for t in range(steps - 2, -1, -1):
        n, following = alive[t + 1], slice(begin[t + 1], begin[t + 2])
        now = slice(begin[t], begin[t] + n)
        g0, g1 = zero[following] * b0[following], one[following] * b1[following]
        u0, u1 = m00 * g0 + m01 * g1, m10 * g0 + m11 * g1
        share = each[:n] / (f0[now] * u0 + f1[now] * u1)
        a0, a1 = f0[now] * share, f1[now] * share
        pairs += [[m00 * (a0 @ g0), m01 * (a0 @ g1)], [m10 * (a1 @ g0), m11 * (a1 @ g1)]]
        scale = u0 + u1
        b0[now], b1[now] = u0 / scale, u1 / scale
    marginal = f1 * b1 / (f0 * b0 + f1 * b1)
    out = np.zeros(len(sizes))
    out[order] = log_z
    out += np.bincount(doc, np.logaddexp(0, clipped), len(sizes)) + top * np.maximum(sizes - 1, 0)
    return marginal[place], pairs, out


def objective(theta: np.ndarray, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The penalised, weighted log likelihood of chains whose lines all have the chain's label, and its gradient."""
    emit, move = x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    sizes = np.diff(first)
    marginal, pairs, log_z = forward_backward(emit, first, move, weight)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    steps = np.maximum(sizes - 1, 0)
    path = np.bincount(doc, emit, len(sizes)) * label + steps * move[label, label]
    same = np.diag([(weight * steps)[label == v].sum() for v in (0, 1)])
    gradient = np.concatenate([x.T @ (weight[doc] * (label[doc] - marginal)), (same - pairs).ravel()]) - penalty * theta
    return float(weight @ (path - log_z) - penalty / 2 * theta @ theta), gradient


def climb(function, theta: np.ndarray, rounds: int, memory: int = 10, enough: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS: the maximum of a concave `function` that gives its value and gradient."""
    value, grad = function(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, factors = grad.copy(), []
        for s, y in reversed(steps):
            factors.append((s @ way) / (s @ y))
            way -= factors[-1] * y
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.abs(way).max())
        for (s, y), factor in zip(steps, reversed(factors), strict=True):
            way += s * (factor - (y @ way) / (s @ y))
        length = 1.0
        while True:
            new, new_grad = function(theta + length * way)
            if new >= value + 1e-4 * length * (grad @ way) or length < 1e-8:
                break
            length /= 2
        if new <= value:
            break
        s, y = length * way, grad - new_grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        gained, theta, value, grad = new - value, theta + s, new, new_grad
        if gained < enough * max(1e-3, abs(value)):
            break
    return theta


def train(lines: list[tuple[np.ndarray, int]], rounds: int = ROUNDS, penalty: float = PENALTY, segment: int = SEGMENT) -> np.ndarray:
    """Weights (features, then the four transitions) from documents' line features and labels."""
    theta = np.zeros(WIDTH + 4)
    if not lines:
        return theta
    x = np.concatenate([a for a, _ in lines]).astype(np.float64)
    sizes = np.array([len(a) for a, _ in lines])
    label = np.array([y for _, y in lines])
    each = 0.5 / np.bincount(label, minlength=2)[label] / sizes
    pieces = -(-sizes // segment)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = np.minimum(segment, np.repeat(sizes, pieces) - place * segment)
    first = np.concatenate(([0], np.cumsum(cut)))
    label, each = np.repeat(label, pieces), np.repeat(each, pieces)
    return climb(lambda at: objective(at, x, first, label, each, penalty), theta, rounds)


def document_scores(lines: Lines, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean marginal of each document (0 without lines), and its number of good lines."""
    marginal, _, _ = forward_backward(lines.x.astype(np.float64) @ theta[:WIDTH], lines.first, theta[WIDTH:].reshape(2, 2))
    n = len(lines.first) - 1
    weight = np.bincount(lines.doc, lines.length, n)
    score = np.bincount(lines.doc, lines.length * marginal, n) / np.maximum(weight, 1)
    return np.clip(score, 0, 1), np.bincount(lines.doc, marginal >= 0.5, n).astype(np.int64)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES,
) -> np.ndarray:
    """Weights from a bounded sample of the labelled documents outside the held-out fold."""
    given = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    given = given.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    given = given.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = bounded_sample(given, sample_rows, "doc_id")
    texts = tb.id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("text").alias("key"))  # about sample_rows rows

    def run(batches):
        for batch in batches:
            rows = []
            for block in tb.blocks(batch.column(1)):
                lines = line_features(block)
                labels, keys = (batch.column(c).slice(block.row, block.n).to_pylist() for c in (0, 2))
                rows += [(labels[k], keys[k], int(b - a), lines.x[a:b].tobytes()) for k, (a, b) in enumerate(zip(lines.first[:-1], lines.first[1:], strict=True)) if b > a]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["label", "key", "n", "x"])

    with scratch(docs.sparkSession) as made:
        found = made.written(texts.mapInArrow(run, "label int, key long, n long, x binary"), "line-features")
        if not chosen.limit(1).count() and given.limit(1).count():
            raise ValueError("the sample of labelled documents is empty; raise sample_rows")
        room, last = sample_lines, None
        for r in sorted(found.select("key", "n").collect(), key=lambda r: (r["key"], r["n"])):  # about sample_rows rows
            if r["n"] <= room:
                room, last = room - r["n"], r["key"]
            else:
                break
        sample = found.where(F.col("key") <= F.lit(last)).collect() if last is not None else []
    sample.sort(key=lambda r: (r["key"], r["label"], bytes(r["x"])))
    return train([(np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH), r["label"]) for r in sample])


def fold(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(FOLDS))


def line_quality(
    docs: DataFrame, theta: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the numbers of lines and of good lines (no shuffle)."""

    def run(batches):
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                lines = line_features(block)
                score, good = document_scores(lines, theta)
                columns = [
                    batch.column(0).slice(block.row, block.n), batch.column(2).slice(block.row, block.n), pa.array(score),
                    pa.array((score >= threshold).astype(np.int32)), pa.array(np.diff(lines.first).astype(np.int64)), pa.array(good),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_lines", "n_good_lines"])

    rows = tb.id_and_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)))
    return rows.mapInArrow(run, SCHEMA)
