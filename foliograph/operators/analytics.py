"""Aggregations, rankings and pages over the corpus and its logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_counts(docs: DataFrame, tags: str = "tags") -> DataFrame:
    """Documents per tag with a slug, most first."""
    one = docs.select("doc_id", F.explode(F.array_distinct(F.col(tags))).alias("tag"))
    out = one.groupBy("tag").agg(F.count("*").alias("document_count"))
    return out.withColumn("id", F.concat(F.lit("tag-"), F.regexp_replace(F.lower("tag"), " ", "-"))).orderBy(F.desc("document_count"), "tag")


def topic_counts(docs: DataFrame, topic: str = "topic") -> DataFrame:
    """Documents per topic but blank and `other`, most first, then by name."""
    named = docs.select(F.trim(F.col(topic)).alias("topic")).where("topic <> '' and topic <> 'other'")
    return named.groupBy("topic").agg(F.count("*").alias("document_count")).orderBy(F.desc("document_count"), "topic")


def type_counts(docs: DataFrame, doc_type: str = "doc_type") -> DataFrame:
    return docs.groupBy(F.coalesce(F.col(doc_type), F.lit("other")).alias("doc_type")).agg(F.count("*").alias("document_count"))


def corpus_stats(docs: DataFrame, spaces: DataFrame, folders: DataFrame, dimensions: int = 384) -> DataFrame:
    """One row: documents, spaces, last scan (or `never`), bytes of vectors."""
    n = docs.agg(F.count("*").alias("documents"))
    s = spaces.agg(F.count("*").alias("spaces"))
    f = folders.agg(F.coalesce(F.max("last_scan").cast("string"), F.lit("never")).alias("last_scan"))
    return n.join(s).join(f).withColumn("index_bytes", F.col("documents") * dimensions * 4)  # one row each


def last_n(log: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """A ring buffer: the n rows with the highest sequence numbers."""
    return log.orderBy(F.desc(seq)).limit(n)


def search_analytics(log: DataFrame, buffer: int = 1000, top: int = 10) -> DataFrame:
    """(query, searches, total, average_results): the top queries of the buffer, with the lifetime total."""
    recent = last_n(log, buffer)
    total = log.agg(F.count("*").alias("total"))
    average = recent.agg(F.avg("result_count").alias("average_results"))
    best = recent.groupBy("query").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "query").limit(top)
    return best.join(F.broadcast(total)).join(F.broadcast(average))  # one row each


def click_as_of(searches: DataFrame, clicks: DataFrame, by: str = "user_id", seq: str = "seq") -> DataFrame:
    """Each click with the user's last search before it: one union and a window, no range join."""
    tagged = searches.select(by, seq, F.col("query"), F.lit(0).alias("_k")).unionByName(clicks.select(by, seq, F.lit(None).cast("string").alias("query"), F.lit(1).alias("_k")))
    w = Window.partitionBy(by).orderBy(seq, "_k")
    last = F.last(F.when(F.col("_k") == 0, F.struct(F.col(seq).alias("seq"), F.col("query").alias("query"))), ignorenulls=True).over(w)
    return tagged.withColumn("search", last).where("_k = 1").select(by, F.col(seq).alias("click_seq"), F.col("search.seq").alias("search_seq"), F.col("search.query").alias("query"))


def click_by_index(searches: DataFrame, clicks: DataFrame, buffer: int = 1000, seq: str = "seq") -> DataFrame:
    """Searches of the buffer with `clicked`: the last click that names their place in it (`query_index`, counted from 0, the oldest first)."""
    recent = last_n(searches, buffer, seq)
    placed = recent.withColumn("query_index", F.row_number().over(Window.orderBy(seq)) - 1)  # at most `buffer` rows
    last = clicks.groupBy("query_index").agg(F.max_by("clicked", seq).alias("clicked"))
    return placed.join(last, "query_index", "left")


def ordered_documents(docs: DataFrame, by: str = "name") -> DataFrame:
    """Favourites by `name`, by `modified` (the latest first) or by `size` (the largest first), ties by id."""
    orders = {"name": F.lower("title"), "modified": F.desc("modified_at"), "size": F.desc("size")}
    return docs.orderBy(orders[by], "doc_id")


def rolling_eta(steps: DataFrame, remaining: Column, by: list[str], order: str, latency: str = "latency_ms", window: int = 20) -> DataFrame:
    """Mean latency of the last `window` steps (whole ms) and the time left at that pace."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - window, 0)
    mean = F.floor(F.sum(latency).over(w) / F.count("*").over(w))
    return steps.withColumn("mean_ms", mean).withColumn("eta_ms", F.col("mean_ms") * remaining)


def daily_activity(log: DataFrame, as_of: Column, days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows per day of the last `days` days up to `as_of`, days without rows included."""
    day = F.to_date(as_of)
    spark = log.sparkSession
    calendar = spark.range(days).select(F.date_sub(day, F.col("id").cast("int")).alias("day"))
    counts = log.where(F.to_date(ts).between(F.date_sub(day, days - 1), day)).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def recency_bucket(day: Column, as_of: Column) -> Column:
    age = F.datediff(F.to_date(as_of), F.to_date(day))
    return F.when(age <= 0, "Today").when(age == 1, "Yesterday").when(age < 7, "This week").otherwise("Older")


def recent_documents(docs: DataFrame, n: int = 10, modified: str = "modified_at") -> DataFrame:
    return docs.orderBy(F.desc(modified), "doc_id").limit(n)


def page(ids: DataFrame, number: int, size: int = 20, order: str = "doc_id") -> DataFrame:
    """A page of sorted ids, counted from 0; beyond the end empty, below 0 an error."""
    if number < 0:
        raise ValueError("pages count from 0")
    return ids.orderBy(order).offset(number * size).limit(size)


def activity_feed(log: DataFrame, buffer: int = 200, n: int = 50) -> DataFrame:
    return last_n(log, min(buffer, n)).withColumn("id", F.concat(F.lit("act-"), "seq"))


def tag_range(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("document_count").alias("min_count"), F.max("document_count").alias("max_count"))


def grouped_ranks(rows: DataFrame, by: str, order: list[Column], out: str = "place") -> DataFrame:
    """Each row's place in its group."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top_per_group(rows: DataFrame, by: str, order: list[Column], n: int, out: str = "place") -> DataFrame:
    """The best n rows of each group; each task keeps its best n before the shuffle."""
    return grouped_ranks(rows, by, order, out).where(F.col(out) <= n)


def fallback_count(docs: DataFrame, version: float = 2.5) -> DataFrame:
    return docs.agg(F.count_if(F.abs(F.col("entities_version") - version) < 1e-6).alias("fallbacks"))


def saved_search_counts(saved: DataFrame, docs: DataFrame, entity_filters: DataFrame | None = None, aliases: DataFrame | None = None, entity_docs: DataFrame | None = None) -> DataFrame:
    """(id, document_count) by the stored filters alone; no filter counts every document.

    `saved` (id, doc_type, topic, date_from, date_to) is a stated set of filters.  `entity_filters` (id, filter_no,
    class, value) with `aliases` (surface_lc, entity_type, canonical_id) and `entity_docs` (canonical_id,
    doc_id) leave the documents that have all entities of a search; an unknown one leaves none.
    """
    s = saved.alias("s")
    created = F.coalesce(F.col("d.created_at"), F.lit(""))
    match = (
        (F.col("s.doc_type").isNull() | (F.col("s.doc_type") == F.col("d.doc_type"))) & (F.col("s.topic").isNull() | (F.col("s.topic") == F.col("d.topic")))
        & (F.col("s.date_from").isNull() | (created >= F.col("s.date_from"))) & (F.col("s.date_to").isNull() | (created <= F.col("s.date_to")))
    )
    # counts by distinct filter values first, so the stated set meets groups, not documents
    groups = docs.groupBy("doc_type", "topic", "created_at").agg(F.count("*").alias("n"))
    counted = F.broadcast(s).join(groups.alias("d"), match).groupBy(F.col("s.id").alias("id")).agg(F.sum("d.n").alias("n"))
    if entity_filters is not None:
        named = entity_filters.select("id", "filter_no", F.lower("value").alias("_v"), F.lower("class").alias("_t"))
        found = named.join(aliases, (F.col("_v") == F.col("surface_lc")) & (F.lower("entity_type") == F.col("_t"))).join(entity_docs, "canonical_id").select("id", "filter_no", "doc_id").distinct()
        wanted = entity_filters.groupBy("id").agg(F.countDistinct("filter_no").alias("_n"))
        whole = found.groupBy("id", "doc_id").agg(F.count("*").alias("_hits")).join(wanted, "id").where("_hits = _n").select(F.col("id").alias("_id"), "doc_id")
        inside = whole.join(docs, "doc_id").alias("d").join(F.broadcast(s), match & (F.col("d._id") == F.col("s.id"))).groupBy(F.col("s.id").alias("id")).agg(F.count("*").alias("n"))
        counted = counted.join(wanted, "id", "left_anti").union(inside)
    return saved.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("document_count"))
