"""The document graph: edges to neighbours, space graph, related documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

NEAR, SAME_SPACE, SAME_TAG, SAME_ENTITY, K = 0.7, 0.5, 0.3, 0.4, 10


def document_edges(neighbours: DataFrame) -> DataFrame:
    """(source, target, weight, edge_types) from neighbour pairs with both sides' spaces, tags and names.

    The pairs come from a top-k search (`search.top_k` in blocks of queries), so there are at most k per document.
    """
    def shared(a: str, b: str) -> Column:
        return F.size(F.array_intersect(a, b))

    tags = F.when(shared("tags_a", "tags_b") > 0, SAME_TAG * shared("tags_a", "tags_b") / F.greatest(F.size("tags_a"), F.size("tags_b"))).otherwise(0.0)
    parts = {
        "similar": F.when(F.col("similarity") > NEAR, F.col("similarity")).otherwise(0.0), "space": F.when(shared("spaces_a", "spaces_b") > 0, SAME_SPACE).otherwise(0.0),
        "tag": tags, "entity": F.when(shared("names_a", "names_b") > 0, SAME_ENTITY).otherwise(0.0),
    }
    kinds = F.filter(F.array(*[F.when(v > 0, k) for k, v in parts.items()]), lambda x: x.isNotNull())
    return neighbours.select("source", "target", F.greatest(*parts.values()).alias("weight"), kinds.alias("edge_types")).where("size(edge_types) > 0")


def neighbours_of(edges: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "target")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def space_graph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(space_a, space_b, weight): edge weights between different spaces, both directions in one pair."""
    a, b = (members.select(F.col("id").alias(end), F.col("space_id").alias(f"s_{end}")) for end in ("source", "target"))
    joined = edges.join(a, "source").join(b, "target").where("s_source <> s_target")
    return joined.groupBy(F.least("s_source", "s_target").alias("space_a"), F.greatest("s_source", "s_target").alias("space_b")).agg(F.sum("weight").alias("weight"))


def related_documents(edges: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """Each source's neighbours that exist, by weight."""
    return neighbours_of(edges.join(docs.select(F.col("doc_id").alias("target")), "target", "left_semi"), n)


def names_of(entities: Column) -> Column:
    """Lower-cased person and organisation values."""
    named = F.filter(entities, lambda e: F.lower(e["entity_type"]).isin("person", "organization"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda e: F.lower(e["value"]))))


def blocked_neighbours(rows: DataFrame, k: int = K) -> DataFrame:
    """(source, target, similarity, rank): the k nearest of every row, itself left out.

    Every row is a stated query; blocks of queries pass by the blocks of rows (`blocks.nearest`), which is exact
    and quadratic in the rows, but for what moves: k + 1 rows a query and task.
    """
    near = blocks.nearest(rows, rows, k + 1, "embedding", "id", "id", "embedding").where("query_id <> id").drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias("source"), F.col("id").alias("target"), "similarity", "rank")
