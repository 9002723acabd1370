"""The triple store: closure, upsert, provenance, roll-ups and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FINANCIAL, PREDICATES, PROPERTY_HINTS, VEHICLE_HINTS, inverse_table

COLUMNS = ("subject_id", "predicate", "object_id", "doc_ids", "user_added")


def valid(triples: DataFrame, predicates: tuple[str, ...] | None = PREDICATES) -> DataFrame:
    """Triples with a known predicate between two different entities."""
    out = triples.where("subject_id <> object_id")
    return out if predicates is None else out.where(F.col("predicate").isin(*predicates))


def closure(triples: DataFrame) -> DataFrame:
    """Triples and their inverse or symmetric partners, with the same provenance; not yet merged."""
    pairs = F.broadcast(inverse_table(triples.sparkSession))
    partners = triples.join(pairs, "predicate").select(F.col("object_id").alias("subject_id"), F.col("partner").alias("predicate"), F.col("subject_id").alias("object_id"), "doc_ids", "user_added")
    return triples.select(*COLUMNS).union(partners)


def merge(triples: DataFrame) -> DataFrame:
    """One row per (subject, predicate, object): all documents, user-added if any is.

    A document is counted once per triple before a triple's documents meet, so what meets is as long as the result.
    """
    key = ["subject_id", "predicate", "object_id"]
    one = triples.select(*key, F.explode_outer("doc_ids").alias("_doc"), "user_added").groupBy(*key, "_doc").agg(F.max("user_added").alias("user_added"))
    return one.groupBy(*key).agg(F.array_sort(F.collect_list("_doc")).alias("doc_ids"), F.max("user_added").alias("user_added"))


def upsert(store: DataFrame, new: DataFrame, strict_reference: bool = False) -> DataFrame:
    """The store with new triples and their partners.

    Documents are merged; with `strict_reference` a triple that no user added takes the new row's documents alone.
    """
    fresh = merge(closure(valid(new)))
    if not strict_reference:
        return merge(store.select(*COLUMNS).union(fresh.select(*COLUMNS)))
    key = ["subject_id", "predicate", "object_id"]
    own = store.where("user_added").select(*COLUMNS)
    untouched = store.where("not user_added").join(fresh, key, "left_anti").select(*COLUMNS)
    both = own.union(fresh.join(own.select(*key), key, "left_semi").select(*COLUMNS))
    return untouched.union(merge(both).select(*COLUMNS)).union(fresh.join(own.select(*key), key, "left_anti").select(*COLUMNS))


def add_manual(store: DataFrame, new: DataFrame, canon: DataFrame) -> DataFrame:
    """Manual triples between known entities."""
    ids = canon.select("canonical_id")
    known = new.join(ids, new["subject_id"] == ids["canonical_id"], "left_semi").join(ids, F.col("object_id") == ids["canonical_id"], "left_semi")
    return upsert(store, known.withColumn("user_added", F.lit(True)))


def delete(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the given triples and their partners."""
    key = ["subject_id", "predicate", "object_id"]
    both = closure(gone.select(*key, F.array().cast("array<string>").alias("doc_ids"), F.lit(False).alias("user_added")))
    return store.join(both.select(*key).distinct(), key, "left_anti")


def cleanup_document(store: DataFrame, doc_id: Column) -> DataFrame:
    """Without one document's provenance; triples without any left go unless a user added them."""
    out = store.withColumn("doc_ids", F.array_remove("doc_ids", doc_id))
    return out.where((F.size("doc_ids") > 0) | F.col("user_added"))


def of_entity(store: DataFrame, entity_id: Column) -> DataFrame:
    return store.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id)).orderBy("predicate", "object_id")


def with_entities(store: DataFrame, canon: DataFrame) -> DataFrame:
    """Triples with both ends' names; rows with a missing end go."""
    s = canon.select(F.col("canonical_id").alias("subject_id"), F.col("canonical_name").alias("subject_name"), F.col("entity_type").alias("subject_type"))
    o = canon.select(F.col("canonical_id").alias("object_id"), F.col("canonical_name").alias("object_name"), F.col("entity_type").alias("object_type"))
    return store.join(s, "subject_id").join(o, "object_id")


def relations_page(store: DataFrame, canon: DataFrame, entity_id: Column) -> DataFrame:
    """The entity's triples with the other end and a direction."""
    named = with_entities(store, canon)
    outgoing = F.col("subject_id") == entity_id
    return named.where(outgoing | (F.col("object_id") == entity_id)).withColumn("direction", F.when(outgoing, "outgoing").otherwise("incoming"))


def all_related(store: DataFrame, entity_id: Column) -> DataFrame:
    """(predicate, other_id) around an entity, each once."""
    out = store.where(F.col("subject_id") == entity_id).select("predicate", F.col("object_id").alias("other_id"))
    return out.union(store.where(F.col("object_id") == entity_id).select("predicate", F.col("subject_id").alias("other_id"))).distinct()


def subjects_of(store: DataFrame, predicate: str, object_id: Column) -> DataFrame:
    return store.where((F.col("predicate") == predicate) & (F.col("object_id") == object_id)).select("subject_id")


def objects_of(store: DataFrame, subject_id: Column, predicate: str) -> DataFrame:
    return store.where((F.col("predicate") == predicate) & (F.col("subject_id") == subject_id)).select("object_id")


def asset_type(entity_type: Column, subclass: Column, topic: Column, name: Column) -> Column:
    """The kind of asset: by topic first, then by entity type, then by hints in the name."""
    kind, t, n = F.lower(entity_type), F.lower(F.coalesce(topic, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))

    def hint(words: tuple[str, ...]) -> Column:
        return n.rlike("|".join(words))

    place = F.when(t == "vehicle", "Vehicle").when(t.isin("property", "real_estate"), "Property").when(hint(PROPERTY_HINTS), "Property").when(hint(VEHICLE_HINTS), "Vehicle").otherwise("Other")
    return (
        F.when(t.isin("investment", "insurance"), "Investment").when(kind == "identifier", F.when(F.lower(F.coalesce(subclass, F.lit(""))).isin(*FINANCIAL), "Financial").otherwise("Other"))
        .when(kind == "location", place).when(kind == "organization", F.when(t == "business", "Business").otherwise("Other")).otherwise("Other")
    )


def ownership(store: DataFrame, canon: DataFrame, topics: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(subject_id, asset_type, assets, total): what each entity owns by kind of asset.

    `topics` (doc_id, topic) gives the topic of a triple's first document, `subclasses`
    (surface_lc, subclass) the kind of an identifier.
    """
    owned = store.where("predicate = 'owns'").select("subject_id", "object_id", F.get("doc_ids", F.lit(0)).alias("doc_id"))
    o = canon.select(F.col("canonical_id").alias("object_id"), F.col("canonical_name").alias("name"), "entity_type")
    sub = subclasses.groupBy("surface_lc").agg(F.min("subclass").alias("subclass"))
    rows = owned.join(o, "object_id").join(topics, "doc_id", "left").join(sub, F.lower("name") == sub["surface_lc"], "left")
    typed = rows.select("subject_id", "object_id", asset_type(F.col("entity_type"), F.col("subclass"), F.col("topic"), F.col("name")).alias("asset_type")).distinct()
    out = typed.groupBy("subject_id", "asset_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("object_id")).alias("assets"))
    totals = typed.groupBy("subject_id").agg(F.count("*").alias("total"))
    return out.join(totals, "subject_id")


def rename_predicate(store: DataFrame, old: str, new: str) -> DataFrame:
    """All triples of one predicate under another name (equal rows are not merged)."""
    return store.withColumn("predicate", F.when(F.col("predicate") == old, F.lit(new)).otherwise(F.col("predicate")))


def validate_model_triples(triples: DataFrame, vocabulary: DataFrame, n_entities: Column) -> DataFrame:
    """A model's positional triples with a known predicate, two different ends, both in range."""
    inside = F.col("s").between(0, n_entities - 1) & F.col("o").between(0, n_entities - 1)
    return triples.where((F.col("s") != F.col("o")) & inside).join(F.broadcast(vocabulary), "predicate", "left_semi")


def resolve_positions(triples: DataFrame, entities: Column) -> DataFrame:
    """Positional ends as canonical ids; triples with an end that has none go."""
    out = triples.withColumns({"subject_id": F.get(entities, F.col("s"))["canonical_id"], "object_id": F.get(entities, F.col("o"))["canonical_id"]})
    return out.where("subject_id is not null and object_id is not null")


def new_predicates(proposed: DataFrame, vocabulary: DataFrame, most: int = 3) -> DataFrame:
    """Well-formed predicates that are not known yet, each document's first `most`."""
    from pyspark.sql import Window

    good = proposed.where(F.col("predicate").rlike("^[a-z][a-z0-9_]*$") & (F.octet_length("predicate") <= 40)).join(vocabulary, "predicate", "left_anti")
    first = good.groupBy("doc_id", "predicate").agg(F.min("position").alias("position"))
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))).where(F.col("_r") <= most).drop("_r")
