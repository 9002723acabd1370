"""Text functions as column expressions (inside the JVM but for excerpts)."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CORPORATE_SUFFIXES, TYPE_NAMES, UNIT_PATTERN

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words(text: Column) -> Column:
    """White-space words of a text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clean_word(word: Column) -> Column:
    """A word without the non-alphanumerics at its ends."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def excerpt_of(text: str | None, query: str | None, window: int = 30) -> str | None:
    """The first window of words that holds most words of the query, in one pass with a running count."""
    if text is None:
        return None
    all_words = text.split()
    wanted = {w for q in (query or "").lower().split() if (w := _EDGES.sub("", q))}
    if len(all_words) <= window or not wanted:
        return " ".join(all_words[:window])
    hits = [_EDGES.sub("", w.lower()) in wanted for w in all_words]
    score = best = sum(hits[:window])
    at = 0
    for start in range(1, len(all_words) - window + 1):
        score += hits[start + window - 1] - hits[start - 1]
        if score > best:
            best, at = score, start
    return " ".join(all_words[at : at + window])


def best_excerpt(text: Column, query: Column, window: int = 30) -> Column:
    """`excerpt_of` in Arrow batches.

    As an expression its arrays would be evaluated again for every window: lambdas share nothing.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([excerpt_of(t, q, window) for t, q in zip(texts, queries, strict=True)])

    return run(text, query)


def chunks_of(text: str | None, size: int, overlap: int) -> list[dict]:
    stride, out = max(size - overlap, 1), []
    while text and (not out or out[-1]["end"] < len(text)):
        start = len(out) * stride
        out.append({"chunk_no": len(out), "start": start, "end": min(start + size, len(text)), "chunk": text[start : start + size]})
    return out


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows (chunk_no, start, end, chunk) of `size` characters, each `size - overlap` on; the last reaches the end.

    In Arrow batches: an expression would count the characters from the start again for every chunk.
    """

    @F.pandas_udf("array<struct<chunk_no:int,start:int,end:int,chunk:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(t, size, overlap) for t in texts])

    return run(text)


def normalize_tag(tag: Column) -> Column:
    """Lower case, blanks and dashes as one underscore, nothing but a-z, 0-9 and underscores inside."""
    out = F.regexp_replace(F.lower(F.trim(tag)), r"[ \t\n\r\f-]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9_]", ""), "_+", "_")
    return F.regexp_replace(out, "^_|_$", "")


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def short_name(value: Column, entity_class: Column) -> Column:
    """A shorter name of an organisation or unit, or collapsed blanks; null when nothing changes."""
    ordered = sorted(CORPORATE_SUFFIXES, key=len, reverse=True)
    suffix = "(?i)(?:" + "|".join(s.replace(".", r"\.") for s in ordered) + ")$"
    stem = F.regexp_replace(F.regexp_replace(value, suffix, ""), "[,. ]+$", "")
    organisation = F.when(value.rlike(suffix) & (stem != ""), stem)
    parts = F.filter(F.transform(F.split(value, "-"), lambda s: F.trim(s)), lambda s: s != "")
    last, two = F.element_at(parts, -1), F.array_join(F.slice(parts, -2, 2), " ")
    unit = F.when(F.size(parts) >= 2, F.when(last.rlike(UNIT_PATTERN), collapse(last)).when(two.rlike(UNIT_PATTERN), collapse(two)))
    ruled = F.when(entity_class == "Organization", organisation).when(entity_class == "Location", unit)
    found = F.trim(F.coalesce(ruled, collapse(value)))
    return F.when((found != "") & (found != value), found)


def looks_like_email(value: Column) -> Column:
    return F.trim(value).rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$")


def entity_type_of(entity_class: Column) -> Column:
    return F.lower(entity_class)


def capitalise(value: Column) -> Column:
    """The first letter upper-cased, the rest as it is."""
    return F.concat(F.upper(F.left(value, F.lit(1))), F.substring(value, 2, 1 << 30))


def title_from_query(query: Column, most: int = 40) -> Column:
    """A query of at most `most` characters, or its beginning up to the last blank in them."""
    head = F.left(query, F.lit(most))
    cut = F.regexp_extract(head, r"^(.*)\s", 1)
    return F.when(F.char_length(query) <= most, query).when(cut != "", cut).otherwise(head)


def clip_head_tail(text: Column, most: int = 12_000, each: int = 6_000) -> Column:
    """Texts of more bytes than `most` keep their first and last `each` bytes (whole characters) between marks."""
    raw = F.encode(text, "utf-8")
    head = F.regexp_replace(F.decode(F.substring(raw, 1, each), "utf-8"), "�+$", "")
    tail = F.regexp_replace(F.decode(F.substring(raw, -each, each), "utf-8"), "^�+", "")
    return F.when(F.octet_length(text) > most, F.concat(F.lit("[HEAD]\n"), head, F.lit("\n[TAIL]\n"), tail)).otherwise(text)


def strip_model_noise(reply: Column) -> Column:
    """A model's reply without thinking blocks and code fences."""
    out = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(out, r"(?m)^\s*```[A-Za-z]*\s*$", ""))


def parse_json_reply(reply: Column, schema: str) -> Column:
    """The reply as JSON, directly or without noise; null if neither parses."""
    def parsed(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))

    stripped = strip_model_noise(reply)
    inner = F.regexp_extract(stripped, r"(?s)(\{.*\})", 1)
    return F.coalesce(parsed(reply), parsed(stripped), parsed(inner))


def sanitize_field(value: Column, most: int = 100) -> Column:
    return F.left(F.regexp_replace(value, r"\p{Cc}", ""), F.lit(most))


def membership_fingerprint(ids: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the sorted ids, one a line."""
    return F.left(F.sha2(F.concat(F.array_join(F.array_sort(ids), "\n"), F.lit("\n")), 256), F.lit(16))


def suffix_label(label: Column, value: Column) -> Column:
    """`label — value`, in place of an older suffix."""
    return F.concat(F.substring_index(label, " — ", 1), F.lit(" — "), value)


def is_snake_case(name: Column, most: int = 64) -> Column:
    return name.rlike("^[a-z][a-z0-9_]*$") & (F.octet_length(name) <= most)


BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(size: Column, units: tuple[str, ...] = BYTE_UNITS) -> Column:
    """One decimal and the largest of the units of which there is one; nothing is `0 B`."""
    value, unit = size.cast("double"), F.lit(units[0])
    for n in range(1, len(units)):
        value = F.when(size >= 1024**n, size / F.lit(float(1024**n))).otherwise(value)
        unit = F.when(size >= 1024**n, F.lit(units[n])).otherwise(unit)
    return F.when(size == 0, "0 B").otherwise(F.concat(F.format_string("%.1f", value), F.lit(" "), unit))


def relative_time(then: Column, now: Column) -> Column:
    """Whole minutes, hours or days ago."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    ago = lambda n, mark: F.concat(n.cast("string"), F.lit(f"{mark} ago"))
    hours = F.floor(minutes / 60)
    return F.when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).otherwise(ago(F.floor(hours / 24), "d"))


def score_badge(score: Column) -> Column:
    percent = F.round(score * 100)
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").otherwise("low")


def is_token_subset(a: Column, b: Column) -> Column:
    """Whether one value's lower-cased words are all among the other's."""
    x, y = words(F.lower(a)), words(F.lower(b))
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return some & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def normal_type(doc_type: Column) -> Column:
    lower = F.lower(doc_type)
    return reduce(lambda c, kv: c.when(lower == kv[0], kv[1]), TYPE_NAMES.items(), F.when(doc_type.isNull(), "other")).otherwise(lower)


def unix_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
