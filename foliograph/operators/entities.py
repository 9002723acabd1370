"""Entity mentions, canonical entities and their resolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.constants import CLASSES, MERGE_COSINE
from . import blocks
from .components import connected

WORDY = ("person", "organization", "location")


def mentions(docs: DataFrame, entities: str = "extracted_entities") -> DataFrame:
    """One row per mention (doc_id and the entity's fields)."""
    return docs.select("doc_id", F.explode(entities).alias("e")).select("doc_id", "e.*")


def alias_key(surface: Column, entity_type: Column) -> Column:
    return F.struct(F.lower(surface).alias("surface_lc"), F.lower(entity_type).alias("type_lc"))


def lookup(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions with the canonical id of their alias; null where unknown."""
    keyed = found.withColumns({"surface_lc": F.lower("value"), "type_lc": F.lower("entity_type")})
    return keyed.join(aliases, ["surface_lc", "type_lc"], "left")


def documents_of(entity_docs: DataFrame, docs: DataFrame, canonical_id: str) -> DataFrame:
    return docs.join(entity_docs.where(F.col("canonical_id") == canonical_id), "doc_id", "left_semi")


def type_summary(found: DataFrame) -> DataFrame:
    """Entities by type with their distinct documents, most first."""
    out = found.groupBy("entity_type", "value").agg(F.countDistinct("doc_id").alias("document_count"))
    return out.orderBy("entity_type", F.desc("document_count"), "value")


def related_entities(found: DataFrame, key: str, target: str, least: int = 2, n: int = 10) -> DataFrame:
    """Entities in the target's documents: mentions there, at least `least`, the best n."""
    inside = found.where(F.col(key) == target).select("doc_id").distinct()
    shared = found.join(inside, "doc_id", "left_semi").where(F.col(key) != target)
    out = shared.groupBy(key).agg(F.count("*").alias("shared_count")).where(F.col("shared_count") >= least)
    return out.orderBy(F.desc("shared_count"), key).limit(n)


def co_occurrence(found: DataFrame, key: str, targets: DataFrame, n: int = 10) -> DataFrame:
    """For each stated target, the n entities most mentioned in its documents.

    Targets are few; entities of one document meet only the targets in it, so no pairs of all entities arise.
    """
    t = targets.select(F.col(key).alias("target"))
    inside = found.join(F.broadcast(t) if t.limit(1001).count() <= 1000 else t, found[key] == t["target"]).select("target", "doc_id").distinct()
    shared = found.join(inside, "doc_id").where(F.col(key) != F.col("target"))
    counts = shared.groupBy("target", key).agg(F.count("*").alias("shared_count"))
    w = Window.partitionBy("target").orderBy(F.desc("shared_count"), key)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def canonical_name(aliases: DataFrame) -> DataFrame:
    """(canonical_id, canonical_name): the alias of most bytes, the last of equals."""
    best = F.max_by("alias", F.struct(F.octet_length("alias"), "position"))
    return aliases.groupBy("canonical_id").agg(best.alias("canonical_name"))


def short_name_mode(found: DataFrame) -> DataFrame:
    """(canonical_id, short_name): the most frequent short name, the smallest of equals."""
    counts = found.where("canonical_short_name is not null").groupBy("canonical_id", "canonical_short_name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("canonical_id").orderBy(F.desc("n"), "canonical_short_name")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("canonical_id", F.col("canonical_short_name").alias("short_name"))


def vector_pairs(canon: DataFrame, floor: float = MERGE_COSINE, planes: int | None = None, tables: int = 0, seed: int = 5) -> DataFrame:
    """(a, b) of one type with cosine at least `floor`, a < b.

    All pairs of a type are compared, block by block.  With `tables` over 0 only candidates that
    share the pattern of one of `tables` groups of `planes` seeded projections are: there are no
    false pairs, but some are missed (with 16 tables of 6 planes about 3 of 100 at cosine 0.75).
    The planes grow with the logarithm of the rows, so that a pattern holds about a hundred rows
    of no structure; tables should grow with the recall that is wanted.
    """
    if not tables:
        return blocks.close_pairs(canon, "id", "embedding", "entity_type", floor)
    planes = max(6, int(np.log2(max(1, canon.count() / 100)))) if planes is None else planes
    left = canon.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    right = canon.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))

    def run(batches):
        for part in batches:
            x = np.array(part["embedding"].tolist(), float)
            normals = np.random.default_rng(seed).normal(size=(x.shape[1], tables * planes))
            bits = (x @ normals >= 0).reshape(len(x), tables, planes)
            codes = (bits << np.arange(planes)).sum(2) + (np.arange(tables) << planes)
            yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), tables), "entity_type": np.repeat(part["entity_type"].to_numpy(), tables), "pattern": codes.ravel()})

    posts = canon.select("id", "entity_type", "embedding").mapInPandas(run, "id long, entity_type string, pattern long")
    other = posts.select(F.col("id").alias("b"), "entity_type", "pattern")
    pairs = posts.withColumnRenamed("id", "a").join(other, ["entity_type", "pattern"]).where("a < b").select("a", "b").distinct()
    return pairs.join(left, "a").join(right, "b").where(V.cosine(F.col("va"), F.col("vb")) >= floor).select("a", "b")


def token_subset_pairs(canon: DataFrame) -> DataFrame:
    """(a, b) of one wordy type where one name's words are all in the other's, by their rarest word.

    A subset's rarest word is in the superset too, so joining each name's rarest word with all
    words of the others finds every pair.
    """
    wordy = canon.where(F.lower("entity_type").isin(*WORDY)).select("id", "entity_type", "name", F.array_distinct(T.words(F.lower("name"))).alias("words"))
    posts = wordy.select("id", "entity_type", "name", F.explode("words").alias("word"))
    often = posts.groupBy("entity_type", "word").agg(F.count("*").alias("often"))
    rare = posts.join(often, ["entity_type", "word"]).groupBy("id", "entity_type", "name").agg(F.min_by("word", F.struct("often", "word")).alias("word"))
    pairs = rare.select(F.col("id").alias("a"), "entity_type", "word", F.col("name").alias("na")).join(
        posts.select(F.col("id").alias("b"), "entity_type", "word", F.col("name").alias("nb")), ["entity_type", "word"]
    )
    same = pairs.where("a <> b").where(F.size(F.array_except(T.words(F.lower("na")), T.words(F.lower("nb")))) == 0)
    return same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def resolve(canon: DataFrame, with_vectors: bool = False, **settings) -> DataFrame:
    """(id, canonical_id): equal keys, word subsets and (if wanted) near vectors of one type, closed over components.

    `canon` has long id, name, entity_type (and embedding).  The canonical id is the least of its component.
    """
    keyed = canon.select("id", F.lower("name").alias("k"), F.lower("entity_type").alias("t"))
    same = keyed.join(keyed.groupBy("k", "t").agg(F.min("id").alias("b")), ["k", "t"]).where("id <> b").select(F.col("id").alias("a"), "b")
    edges = same.union(token_subset_pairs(canon))
    if with_vectors:
        edges = edges.union(vector_pairs(canon, **settings))
    groups = connected(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    return canon.join(groups, canon["id"] == groups["node"], "left").select(canon["id"], F.coalesce("root", canon["id"]).alias("canonical_id"))


def split_alias(found: DataFrame, value: str, new_id: str) -> DataFrame:
    """Mentions with one alias (whatever its case) moved to a new canonical entity."""
    return found.withColumn("canonical_id", F.when(F.lower("value") == value.lower(), F.lit(new_id)).otherwise(F.col("canonical_id")))


def rename(canon: DataFrame, canonical_id: str, name: str) -> DataFrame:
    return canon.withColumn("canonical_name", F.when(F.col("canonical_id") == canonical_id, F.lit(name)).otherwise(F.col("canonical_name")))


def store_of(found: DataFrame) -> DataFrame:
    """(canonical_id, entity_type, canonical_name, short_name, documents): the store that mentions with ids make.

    The name is the alias of most bytes (the last of equals, by value), the short name the most frequent one,
    `documents` the number of documents; mentions without an id belong to none.  Rebuilding the store from
    stored mentions, and recomputing it after a merge or split, is this.
    """
    known = found.where("canonical_id is not null")
    sizes = known.groupBy("canonical_id").agg(F.min("entity_type").alias("entity_type"), F.countDistinct("doc_id").alias("documents"))
    names = canonical_name(known.select("canonical_id", F.col("value").alias("alias"), F.col("value").alias("position")).distinct())
    return sizes.join(names, "canonical_id").join(short_name_mode(known), "canonical_id", "left").select("canonical_id", "entity_type", "canonical_name", "short_name", "documents")


def register(found: DataFrame, aliases: DataFrame, embedded: bool = True) -> DataFrame:
    """Mentions of new documents with the canonical id of their alias, or a new id for an unknown one.

    New ids follow from type and lower-cased value, so that equal aliases share one.  Without an embedder
    (`embedded = False`) unknown mentions keep a null id.
    """
    named = lookup(found, aliases)
    fresh = F.sha2(F.concat_ws("\n", "type_lc", "surface_lc"), 256) if embedded else F.lit(None).cast("string")
    return named.withColumn("canonical_id", F.coalesce(F.col("canonical_id").cast("string"), fresh)).drop("surface_lc", "type_lc")


def merged_ids(canon: DataFrame, pairs: DataFrame, entity_docs: DataFrame) -> DataFrame:
    """(id, canonical_id): the components of `pairs`; each takes the id with most documents, the least of equals."""
    groups = connected(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    sizes = entity_docs.groupBy(F.col("canonical_id").alias("id")).agg(F.countDistinct("doc_id").alias("docs"))
    placed = canon.select("id").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")).join(sizes, "id", "left")
    best = F.min_by("id", F.struct((-F.coalesce("docs", F.lit(0))).alias("d"), "id"))
    kept = placed.groupBy("root").agg(best.alias("canonical_id"))
    return placed.join(kept, "root").select("id", "canonical_id")


def merge_aliases(canon: DataFrame, found: DataFrame, **settings) -> DataFrame:
    """Mentions with the ids that are left after near entities of one type are merged (cosine 0.75 by default).

    The side with more documents keeps its id.  `store_of` gives the names and document counts after it.
    """
    ids = merged_ids(canon, vector_pairs(canon, **settings), found.select("canonical_id", "doc_id"))
    moved = found.join(ids.select(F.col("id").alias("_id"), F.col("canonical_id").alias("_to")), F.col("canonical_id") == F.col("_id"), "left")
    return moved.withColumn("canonical_id", F.coalesce("_to", "canonical_id")).drop("_id", "_to")


def validate_refined(entities: Column, topic: Column, tags: Column) -> Column:
    """A model's entities without unknown classes, its topic and tags normalised."""
    known = F.filter(entities, lambda e: e["class"].isin(*CLASSES))
    return F.struct(known.alias("entities"), T.normalize_tag(topic).alias("topic"), F.filter(F.transform(tags, T.normalize_tag), lambda t: t != "").alias("tags"))
