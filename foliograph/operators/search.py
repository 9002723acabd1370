"""Vector search, scoring, related documents and chunk retrieval.

Query sets are stated vectors against all rows, in blocks (`blocks.nearest`): the ids of each
query's best rows are found first, and only those rows' columns are joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.constants import ANSWER_FLOOR, CHAT_K, CHUNK_OVERLAP, CHUNK_SIZE, CHUNKS_IN_ALL, CHUNKS_PER_DOC, RELATED_FLOOR, SEARCH_K
from . import blocks
from .filters import combine, entity_class_filter, entity_filter, long_enough, parse_entity_filter


def top_k(rows: DataFrame, queries: DataFrame, k: int = SEARCH_K, vector: str = "embedding", row_id: str = "id", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, row columns but the vector, similarity, rank): the k rows nearest to each query by cosine, ties by id.

    `queries` is the stated query set, of any size; row ids are unique.
    """
    found = blocks.nearest(rows, queries, k, vector, row_id, query_id, query_vector).withColumnRenamed("id", "_found")
    return rows.drop(vector).join(found, F.col(row_id) == F.col("_found")).drop("_found")


def search(rows: DataFrame, queries: DataFrame, as_of: Column, k: int = SEARCH_K, keep: Column | None = None, row_id: str = "id", created: str = "created_at") -> DataFrame:
    """Scored hits: the k nearest rows, then those that `keep` admits (so fewer than k may stay)."""
    hits = top_k(rows, queries, k, row_id=row_id)
    if keep is not None:
        hits = hits.where(keep)
    score = V.search_score(V.clamp(F.col("similarity")), V.recency(F.col(created), as_of))
    return hits.withColumn("score", score)


def rerank(hits: DataFrame, logit: str = "logit") -> DataFrame:
    """Scores mixed with attention over each query's hits: 0.7 score + 0.3 softmax; single hits keep theirs."""
    out = V.softmax_over(hits, logit, ["query_id"], "attention")
    n = F.count("*").over(Window.partitionBy("query_id"))
    return out.withColumn("reranked", F.when(n > 1, 0.7 * F.col("score") + 0.3 * F.col("attention")).otherwise(F.col("score")))


def attention_logit(query: Column, key: Column) -> Column:
    return V.dot(query, key) / F.sqrt(F.size(key).cast("double"))


def entity_keys(entities: Column) -> Column:
    """Distinct `Class:value` keys; the class falls back to the capitalised type, blanks are left out."""
    key = F.transform(
        F.filter(entities, lambda e: (F.trim(e["value"]) != "") & (F.coalesce(e["class"], e["entity_type"], F.lit("")) != "")),
        lambda e: F.concat(T.capitalise(F.coalesce(e["class"], e["entity_type"])), F.lit(":"), e["value"]),
    )
    return F.array_sort(F.array_distinct(key))


def related_scored(rows: DataFrame, queries: DataFrame, as_of: Column, n: int = 5, k: int = SEARCH_K, row_id: str = "id") -> DataFrame:
    """Related documents: neighbours but the document itself, scored by cosine, shared entities and recency.

    `queries` carries query_id, query_vector and the entity keys `query_keys`; rows carry `keys` and `created_at`.
    """
    hits = top_k(rows, queries, k, row_id=row_id).where(F.col("query_id") != F.col(row_id))
    keyed = hits.join(queries.select("query_id", "query_keys"), "query_id")
    score = V.related_score(F.col("similarity"), V.jaccard(F.col("keys"), F.col("query_keys")), V.recency(F.col("created_at"), as_of))
    scored = keyed.withColumn("score", score).where(F.col("score") >= RELATED_FLOOR)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(row_id))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def snippet(excerpt: Column, keys: Column, before: int = 30, after: int = 90) -> Column:
    """The part of an excerpt around the first of the keys' values that occurs in it (values in order)."""
    values = F.transform(F.array_sort(keys), lambda k: F.substring(k, F.instr(k, ":") + 1, F.lit(1 << 30)))
    hit = F.get(F.filter(values, lambda v: (v != "") & F.contains(F.lower(excerpt), F.lower(v))), F.lit(0))
    at = F.instr(F.lower(excerpt), F.lower(hit))
    start = F.greatest(at - before, F.lit(1))
    return F.when(hit.isNotNull(), F.substring(excerpt, start, at - start + F.char_length(hit) + after))


def retrieve_chunks(docs: DataFrame, queries: DataFrame, embed, k: int = CHAT_K, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, per_doc: int = CHUNKS_PER_DOC, in_all: int = CHUNKS_IN_ALL) -> DataFrame:
    """Chunks for an answer: the k nearest documents, their chunks scored, the best per document, the best in all.

    Documents have id, text and embedding; `embed` maps a text column to vectors.
    """
    near = top_k(docs, queries, k)
    chunked = near.withColumn("c", F.explode(T.chunks(F.col("text"), size, overlap))).select("query_id", "id", "c.*")
    scored = chunked.join(queries.select("query_id", "query_vector"), "query_id")
    scored = scored.withColumn("score", V.cosine(embed(F.col("chunk")), F.col("query_vector"))).drop("query_vector")
    of_doc = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "chunk_no")
    of_all = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "chunk_no")
    best = scored.withColumn("_r", F.row_number().over(of_doc)).where(F.col("_r") <= per_doc)
    return best.withColumn("rank", F.row_number().over(of_all)).where(F.col("rank") <= in_all).drop("_r")


def answerable(retrieved: DataFrame, floor: float = ANSWER_FLOOR) -> DataFrame:
    """Per query: the best score and whether it reaches the floor."""
    best = retrieved.groupBy("query_id").agg(F.max("score").alias("best"))
    return best.withColumn("answerable", F.coalesce(F.col("best"), F.lit(0.0)) >= floor)


def numbered_context(retrieved: DataFrame) -> DataFrame:
    """Per query: the prompt lines `[i] title: chunk` and citations numbered from 1."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("title"), F.lit(": "), F.col("chunk"))
    cite = F.struct("rank", "id", "title", "start", "end")
    parts = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), line.alias("line"), cite.alias("cite"))))
    out = retrieved.groupBy("query_id").agg(parts.alias("parts"))
    return out.select("query_id", F.array_join(F.col("parts.line"), "\n").alias("context"), F.col("parts.cite").alias("citations"))


def hyperbolic_nearest(spaces: DataFrame, point: Column, k: int = 3) -> DataFrame:
    """(id, distance): the k top-level spaces whose centroid is nearest in the Poincare ball; none without spaces."""
    near = hyperbolic_index(spaces).withColumn("distance", V.poincare_distance(F.col("point"), point))
    return near.select("id", "distance").orderBy("distance", "id").limit(k)


def click_reward(position: Column) -> Column:
    return 1 / (1 + position)


def trajectory_quality(hits: DataFrame) -> DataFrame:
    """(query_id, quality): the mean score of a search's hits."""
    return hits.groupBy("query_id").agg(F.avg("score").alias("quality"))


def related_to(rows: DataFrame, ids: list, as_of: Column, n: int = 5, row_id: str = "id", vector: str = "embedding") -> DataFrame:
    """`related_scored` for stated documents, with a snippet of each hit around a shared entity; an unknown id is an error.

    Rows carry `keys`, `created_at` and `excerpt`.
    """
    asked = rows.where(F.col(row_id).isin(ids)).select(F.col(row_id).alias("query_id"), F.col(vector).alias("query_vector"), F.col("keys").alias("query_keys"))
    missing = sorted(set(ids) - {r["query_id"] for r in asked.select("query_id").collect()})  # the stated ids
    if missing:
        raise LookupError(f"no such document: {missing[0]}")
    hits = related_scored(rows, asked, as_of, n, row_id=row_id)
    return hits.withColumn("snippet", snippet(F.col("excerpt"), F.array_intersect("keys", "query_keys")))


def hyperbolic_index(spaces: DataFrame) -> DataFrame:
    """(id, point): the top-level spaces that have a centroid, at half its direction in the Poincare ball."""
    points = F.transform(V.normalise(F.col("centroid")), lambda x: x * 0.5)
    return spaces.where((F.col("depth") == 0) & (F.size("centroid") > 0)).select("id", points.alias("point"))


def search_documents(
    docs: DataFrame, queries: DataFrame, as_of: Column, candidates: DataFrame | None = None, k: int = SEARCH_K, aliases: DataFrame | None = None,
    entity_docs: DataFrame | None = None, filters: DataFrame | None = None,
) -> DataFrame:
    """Search from end to end: (query_id, id, similarity, excerpt, score, reranked, place), the best first.

    `docs` has id, embedding, text, created_at and extracted_entities; `queries` has query_id, query and
    query_vector.  Candidates (doc_id, as the metadata filters, spaces and topics leave them) and documents with
    the stated entities (`filters` with `aliases` and `entity_docs`) narrow the documents before the search; bounds
    on amounts and dates in the query narrow the k hits after it.  Hits get the excerpt around the query's
    words, the score of similarity and recency, and the re-ranking by attention over the query's hits.
    Queries of fewer than three bytes find nothing.
    """
    asked = queries.where(long_enough(F.col("query")))
    narrowed = combine(candidates, None if filters is None else entity_class_filter(filters, aliases, entity_docs))
    rows = docs if narrowed is None else docs.join(narrowed.select(F.col("doc_id").alias("id")), "id", "left_semi")
    hits = top_k(rows, asked, k).join(asked.select("query_id", "query", "query_vector"), "query_id")
    bounds = hits.withColumn("_b", parse_entity_filter(F.col("query")))
    kept = bounds.where(entity_filter(F.col("extracted_entities"), *[F.col(f"_b.{c}") for c in ("min_amount", "max_amount", "before_date", "after_date")]))
    scored = kept.withColumn("score", V.search_score(V.clamp(F.col("similarity")), V.recency(F.col("created_at"), as_of)))
    keyed = scored.join(docs.select("id", F.col("embedding").alias("_key")), "id")
    ranked = rerank(keyed.withColumn("logit", attention_logit(F.col("query_vector"), F.col("_key"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("reranked"), "id")
    return ranked.select(
        "query_id", "id", "similarity", T.best_excerpt(F.col("text"), F.col("query")).alias("excerpt"), "score", "reranked", F.row_number().over(best).alias("place"),
    )


def search_log(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, query, result_count): what a search leaves in the query log."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.join(counts, "query_id", "left").select("query_id", "query", F.coalesce("n", F.lit(0)).alias("result_count"))
