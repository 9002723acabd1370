"""Filters of document search as predicates and semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TARGET_VERSION

AMOUNT = r"\$?([0-9,]+(?:\.[0-9]{2})?)"
OVER = r"(?:over|above|more\s+than|greater\s+than|exceeding)\s+" + AMOUNT
UNDER = r"(?:under|below|less\s+than|cheaper\s+than)\s+" + AMOUNT


def metadata_filter(doc_type: str | None = None, space_id: str | None = None, date_from: str | None = None, date_to: str | None = None, tags: list[str] | None = None) -> Column | None:
    """All given conditions together; None when none is given (then nothing is narrowed)."""
    created = F.coalesce(F.col("created_at"), F.lit(""))
    conditions = [
        None if doc_type is None else F.col("doc_type") == doc_type,
        None if space_id is None else F.array_contains("space_ids", space_id),
        None if date_from is None else created >= date_from,
        None if date_to is None else created <= date_to,
        None if not tags else F.arrays_overlap("tags", F.array(*map(F.lit, tags))),
    ]
    out = None
    for c in conditions:
        if c is not None:
            out = c if out is None else out & c
    return out


def parse_entity_filter(query: Column) -> Column:
    """struct(min_amount, max_amount, before_date, after_date) read from a query; null when it has none."""
    lower = F.lower(query)

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_replace(F.regexp_extract(lower, pattern, 1), ",", ""), F.lit("")).try_cast("double")

    def date(word: str) -> Column:
        return F.nullif(F.regexp_extract(lower, word + r"\s+([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))

    parts = (number(OVER), number(UNDER), date("before"), date("after"))
    names = ("min_amount", "max_amount", "before_date", "after_date")
    return F.when(F.coalesce(*(p.cast("string") for p in parts)).isNotNull(), F.struct(*(p.alias(n) for p, n in zip(parts, names, strict=True))))


def entity_filter(entities: Column, minimum: Column, maximum: Column, before: Column, after: Column) -> Column:
    """Any amount at least the minimum and any at most the maximum, any date before, any after.

    A condition without a bound, or on a document without entities of that kind, holds.
    """
    entities = F.coalesce(entities, F.expr("cast(array() as array<struct<value:string,entity_type:string>>)"))

    def of(kind: str) -> Column:
        return F.filter(entities, lambda e: F.lower(e["entity_type"]) == kind)

    amounts = F.filter(F.transform(of("amount"), lambda e: F.regexp_replace(e["value"], "[^0-9.]", "").try_cast("double")), lambda v: v.isNotNull())
    dates = F.transform(of("date"), lambda e: e["value"])

    def holds(bound: Column, values: Column, test) -> Column:
        return bound.isNull() | (F.size(values) == 0) | F.exists(values, lambda v: test(v, bound))

    return (
        holds(minimum, amounts, lambda v, b: v >= b) & holds(maximum, amounts, lambda v, b: v <= b)
        & holds(before, dates, lambda v, b: v < b) & holds(after, dates, lambda v, b: v > b)
    )


def entity_class_filter(filters: DataFrame, aliases: DataFrame, entity_docs: DataFrame) -> DataFrame:
    """(doc_id): documents with all the filtered entities.

    `filters` (filter_no, class, value), `aliases` (surface_lc, entity_type, canonical_id),
    `entity_docs` (canonical_id, doc_id).  An unknown entity leaves no document.
    """
    wanted = filters.select("filter_no", F.lower("value").alias("surface_lc"), F.lower("class").alias("_t"))
    found = wanted.join(aliases, (aliases["surface_lc"] == wanted["surface_lc"]) & (F.lower(aliases["entity_type"]) == wanted["_t"]))
    docs = found.join(entity_docs, "canonical_id").select("doc_id", "filter_no").distinct()
    n = filters.agg(F.countDistinct("filter_no").alias("n"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("hits")).join(F.broadcast(n), F.col("hits") == F.col("n")).select("doc_id")


def combine(*candidates: DataFrame | None) -> DataFrame | None:
    """The documents in all candidate sets; None stands for no narrowing."""
    out = None
    for c in candidates:
        if c is not None:
            out = c if out is None else out.join(c, "doc_id", "left_semi")
    return out


def space_scope(members: DataFrame, spaces: DataFrame, space_id: str) -> DataFrame:
    """(doc_id) of a space and of the spaces below it (two levels)."""
    own = spaces.where((F.col("id") == space_id) | (F.col("parent_id") == space_id)).select(F.col("id").alias("space_id"))
    return members.join(own, "space_id", "left_semi").select("doc_id").distinct()


def long_enough(query: Column) -> Column:
    return F.octet_length(F.trim(query)) >= 3


def class_and_value(key: Column) -> Column:
    """struct(class, value) of `Class:value`, split at the first colon; null when malformed."""
    at = F.instr(key, ":")
    name, value = F.trim(F.left(key, at - 1)), F.trim(F.substring(key, at + 1, F.lit(1 << 30)))
    return F.when((at > 1) & (name != "") & (value != ""), F.struct(name.alias("class"), value.alias("value")))


def is_low_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(1.0)) < 0.7


def needs_backfill(version: Column) -> Column:
    return F.coalesce(version, F.lit(0.0)) < TARGET_VERSION


def is_placeholder_label(label: Column) -> Column:
    return F.trim(F.coalesce(label, F.lit(""))).rlike("^(Space [0-9]+)?$")


def highlight_range(value: Column) -> Column:
    """struct(start, end) of `start-end` with end beyond start; null otherwise."""
    start, end = (F.nullif(F.regexp_extract(value, "^([0-9]+)-([0-9]+)$", g), F.lit("")).try_cast("long") for g in (1, 2))
    return F.when(end > start, F.struct(start.alias("start"), end.alias("end")))


def favourites(docs: DataFrame) -> DataFrame:
    return docs.where("is_favorite")


def toggle_favourite(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.withColumn("is_favorite", F.when(F.col("doc_id") == doc_id, ~F.col("is_favorite")).otherwise(F.col("is_favorite")))


def narrow_topic(rows: DataFrame, topic: str | None) -> DataFrame:
    return rows if topic is None else rows.where(F.col("topic") == topic)


def tag_kind(rows: DataFrame, kind: str | None) -> DataFrame:
    """Tags of one kind (`auto` or `user`); all without one."""
    return rows if kind is None else rows.where(F.col("tag_type") == kind)
