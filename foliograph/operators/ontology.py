"""The adaptive ontology: layered vocabulary, promotion by support, rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import BOOTSTRAP_DOCS, CLASSES, PREDICATES, PROMOTION_SUPPORT, VOCABULARY_CAP

LAYERS = ("seed", "corpus", "manual", "adaptive")
SCHEMA = "name string, source string, count long"


def seed(spark) -> DataFrame:
    return spark.createDataFrame([(p, "seed", 0) for p in PREDICATES], SCHEMA)


def effective(predicates: DataFrame) -> DataFrame:
    """One row per name: that of the first layer in seed, corpus, manual, adaptive order."""
    layer = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("source"))
    known = predicates.withColumn("_l", layer).where("_l > 0")
    best = known.groupBy("name").agg(F.min_by(F.struct("source", "count"), F.struct("_l", "source", "count")).alias("b"))
    return best.select("name", "b.source", "b.count")


def observe(observations: DataFrame, vocabulary: DataFrame, distinct_docs: bool = True, cap: int = VOCABULARY_CAP, support: int = PROMOTION_SUPPORT) -> DataFrame:
    """(name, support, status): unknown predicates are pending, promoted from `support` on while the vocabulary has room.

    `distinct_docs = False` counts every observation, as a plain counter does.
    """
    good = observations.where(T.is_snake_case(F.col("name"))).join(vocabulary.select("name"), "name", "left_anti")
    counted = good.groupBy("name").agg((F.countDistinct("doc_id") if distinct_docs else F.count("*")).alias("support"), F.min("seq").alias("first_seen"))
    room = vocabulary.agg(F.greatest(F.lit(cap) - F.count("*"), F.lit(0)).alias("room"))
    ready = counted.where(F.col("support") >= support).orderBy("first_seen", "name").limit(cap)  # no more can ever be promoted
    ranked = ready.withColumn("_r", F.row_number().over(Window.orderBy("first_seen", "name"))).join(F.broadcast(room)).where("_r <= room").select("name", F.lit(True).alias("in"))
    out = counted.join(F.broadcast(ranked), "name", "left")
    return out.select("name", "support", F.when(F.col("in"), "promoted").when(F.col("support") >= support, "cap_exceeded").otherwise("pending").alias("status"))


def bootstrap(proposed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Proposed corpus predicates that are not in the vocabulary yet."""
    return proposed.join(vocabulary.select("name"), "name", "left_anti").select("name", F.lit("corpus").alias("source"), F.lit(0).cast("long").alias("count"))


def validate_bootstrap(proposed: DataFrame, vocabulary: DataFrame, cap: int = VOCABULARY_CAP) -> DataFrame:
    """Well-formed proposals that are not known yet, each once, in order, while the vocabulary has room."""
    good = proposed.where(T.is_snake_case(F.col("name"), 40)).join(vocabulary.select("name"), "name", "left_anti").groupBy("name").agg(F.min("position").alias("position"))
    room = max(0, cap - vocabulary.limit(cap).count())
    return good.orderBy("position", "name").limit(room)


def validate_subclasses(proposed: DataFrame, most: int = 24) -> DataFrame:
    """Subclasses of the known classes with short normalised names."""
    return proposed.withColumn("subclass", T.normalize_tag(F.col("subclass"))).where(F.col("class").isin(*CLASSES) & (F.col("subclass") != "") & (F.char_length("subclass") <= most)).distinct()


def add_manual(vocabulary: DataFrame, name: str) -> DataFrame:
    spark = vocabulary.sparkSession
    if not (name and name[0].isalpha() and name.replace("_", "a").isalnum() and name == name.lower()):
        raise ValueError("a predicate is snake case")
    fresh = spark.createDataFrame([(name, "manual", 0)], SCHEMA).join(vocabulary.select("name"), "name", "left_anti")
    return vocabulary.unionByName(fresh)


def rename(vocabulary: DataFrame, old: str, new: str) -> DataFrame:
    if old in PREDICATES:
        raise ValueError("seed predicates keep their names")
    return vocabulary.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name")))


def merge(vocabulary: DataFrame, sources: list[str], target: str) -> DataFrame:
    """The sources' counts folded into the target; seed and corpus rows stay apart."""
    movable = F.col("source").isin("adaptive", "manual", "pending")
    moved = vocabulary.where(movable).withColumn("name", F.when(F.col("name").isin(*sources), F.lit(target)).otherwise(F.col("name")))
    folded = moved.groupBy("name").agg(F.min("source").alias("source"), F.sum("count").alias("count"))
    return vocabulary.where(~movable).unionByName(folded)


def split(vocabulary: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """A predicate taken apart: its row goes, the parts come with no count, adaptive, where they are not known.

    Which triples go to which part is for a reviewer; `consolidate` takes it as a list.
    """
    if name in PREDICATES:
        raise ValueError("seed predicates keep their names")
    fresh = vocabulary.sparkSession.createDataFrame([(p, "adaptive", 0) for p in dict.fromkeys(parts)], SCHEMA)
    rest = vocabulary.where(F.col("name") != name)
    return rest.unionByName(fresh.join(rest.select("name"), "name", "left_anti"))


def consolidate(
    vocabulary: DataFrame, triples: DataFrame, renames: dict[str, str], merges: dict[str, list[str]], splits: dict[str, list[str]] | None = None, moved: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The vocabulary and the triples after renames, merges and splits, in one pass over the triples.

    `moved` (subject_id, predicate, object_id, part) says which part of a split predicate a triple takes; those
    that it does not name keep the old predicate, which then stays in the vocabulary as well.
    """
    moves = dict(renames)
    for target, sources in merges.items():
        moves |= dict.fromkeys(sources, target)
        vocabulary = merge(vocabulary, sources, target)
    for old, new in renames.items():
        vocabulary = rename(vocabulary, old, new)
    if splits:
        key = ["subject_id", "predicate", "object_id"]
        if moved is not None:
            triples = triples.join(moved.select(*key, "part"), key, "left").withColumn("predicate", F.coalesce("part", "predicate")).drop("part")
        left = {r["predicate"] for r in triples.where(F.col("predicate").isin(list(splits))).select("predicate").distinct().collect()}  # at most the split names
        for name, parts in splits.items():
            before = vocabulary.where(F.col("name") == name)
            vocabulary = split(vocabulary, name, parts)
            vocabulary = vocabulary.unionByName(before) if name in left else vocabulary
    table = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair]) if moves else None
    if table is not None:
        triples = triples.withColumn("predicate", F.coalesce(F.try_element_at(table, F.col("predicate")), F.col("predicate")))
    return vocabulary, triples


def reset(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.where("source = 'seed'")


def without_corpus(vocabulary: DataFrame) -> DataFrame:
    """Before the corpus layer is made anew."""
    return vocabulary.where("source <> 'corpus'")


def bootstrap_due(successes: int, already: bool) -> bool:
    return successes == BOOTSTRAP_DOCS and not already
