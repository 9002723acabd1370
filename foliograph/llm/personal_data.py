"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, URL schemes, identifier cues and the
shortest digit pairs that any address, card or phone number must hold.  From each anchor a
deterministic local parser expands to the left and right, validates the result and emits a
span.  Texts without an anchor cost one automaton pass.

Kinds email, ip, card and phone are the base kinds, leftmost and non-overlapping in each
kind; `url` (an address with user information), `iban` (checksum 97) and `account` (a
number after a cue) are added.  A span is (kind, start, end) in code points, end exclusive.

Defined results: null or empty text has no spans; a null doc_id is passed on; repeated rows
are each scanned; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
ORDER = {kind: n for n, kind in enumerate(KINDS)}
#: URL schemes and the cue words of account numbers.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte")
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_TAIL = re.compile(r"[\x20().0-9-]+")
URL_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:/[^\s<>\"]*)?")
AFTER_CUE = re.compile(r"(?:\x20?(?:no|nr|number|num)\b\.?)?\x20{0,2}[:#=]?\x20{0,2}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){7,16}(?![0-9])")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Pattern -> (anchor kind, pattern length)."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for a in DIGITS:
        found.add_word(f"+{a}", ("plus", 2))
        for b in DIGITS:
            found.add_word(f"{a}.{b}", ("dot", 3))
            for gap in ("", " ", "-"):
                pair = f"{a}{gap}{b}"
                found.add_word(pair, ("pair", len(pair)))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def valid_iban(value: str) -> bool:
    compact = value.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    domain = DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _ips(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The valid groups of four parts in the dotted chain at `start`, and the chain's end."""
    chain = DOTTED.match(text, start)
    parts, place, out = chain.group().split("."), start, []
    for n in range(0, len(parts) - 3, 4):
        four = parts[n : n + 4]
        length = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
            out.append((place, place + length))
        place += length + 1
    return out, chain.end()


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    run = PHONE_TAIL.match(text, plus + 2)
    if not run:
        return None
    last = run.end() - 1
    while last > run.start() and text[last] not in DIGITS:
        last -= 1
    if last <= run.start():
        return None
    count = sum(c in DIGITS for c in text[plus + 1 : last + 1])
    return (plus, last + 1) if 9 <= count <= 15 else None


def _account(text: str, after: int) -> tuple[str, int, int] | None:
    place = AFTER_CUE.match(text, after).end()
    iban = IBAN.match(text, place)
    if iban:
        value = iban.group()
        while len(value) >= 15 and not valid_iban(value):  # the last groups may be other words
            value = value[:-1].rstrip()
        if len(value) >= 15:
            return "iban", place, place + len(value)
    number = ACCOUNT.match(text, place)
    return ("account", place, number.end()) if number else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    email_end = dotted_end = chain_end = 0
    seen = set()
    for last, (anchor, length) in automaton().iter(text):
        begin = last - length + 1
        if anchor == "pair":
            if begin >= chain_end:
                chain = DIGIT_CHAIN.match(text, begin)
                chain_end = chain.end()
                digits = chain.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", begin, chain_end))
        elif anchor == "at":
            if begin >= email_end and (span := _email(text, begin, email_end)):
                out.append(("email", *span))
                email_end = span[1]
        elif anchor == "dot":
            if begin >= dotted_end:
                start = begin
                while start > dotted_end and text[start - 1] in DIGITS:
                    start -= 1
                spans, dotted_end = _ips(text, start)
                out += [("ip", *s) for s in spans]
        elif anchor == "plus":
            if span := _phone(text, begin):
                out.append(("phone", *span))
        elif anchor == "scheme":
            if user := URL_USER.match(text, last + 1):
                out.append(("url", begin, user.end()))
        elif (found := _account(text, last + 1)) and found not in seen:
            seen.add(found)
            out.append(found)
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with each span (the longest where spans overlap) replaced by its kind."""
    if text is None:
        return None
    out, place = [], 0
    for kind, start, end in sorted(find_spans(text) if spans is None else spans, key=lambda s: (s[1], -s[2])):
        if start >= place:
            out += [text[place:start], f"<{kind}>"]
            place = end
    return "".join([*out, text[place:]])


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number of base spans by kind, a digest of them, and all spans (no shuffle)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find_spans(text)
                base = [s for s in spans if s[0] in BASE_KINDS]
                kinds = [s[0] for s in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*map(kinds.count, BASE_KINDS), digest, joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)]
            names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return tb.id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `df` with personal data in the text replaced by kind marks."""
    tb.bound_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
