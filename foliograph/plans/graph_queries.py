"""Aggregations, logs, entities, triples, ontology, stores and streams over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.constants import PREDICATES
from ..operators import analytics as A
from ..operators import entities as E
from ..operators import ontology as O
from ..operators import passes as M
from ..operators import stores as S
from ..operators import triples as R
from ..operators.components import shared_folder
from ..sources import ingest as I
from ..streaming import streams as ST
from .registry import query, table

# --- aggregations and logs ---------------------------------------------------


@query("SELECT source AS tag, 'tag-' || lower(source) AS id, count(*) AS document_count FROM documents GROUP BY source")
def agg_tags(spark, sf_dir):
    return A.tag_counts(table(spark, sf_dir, "documents").select("doc_id", F.array("source", "source").alias("tags"))).select("tag", "id", "document_count")


@query("SELECT trim(lang) AS topic, count(*) AS document_count FROM documents WHERE lang <> 'de' GROUP BY 1")
def agg_topics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return A.topic_counts(docs.select(F.when(F.col("lang") == "de", "other").otherwise(F.concat(F.lit(" "), "lang", F.lit(" "))).alias("topic")))


@query("SELECT coalesce(lang, 'other') AS doc_type, count(*) AS document_count FROM documents GROUP BY 1")
def agg_types(spark, sf_dir):
    return A.type_counts(table(spark, sf_dir, "documents"), "lang")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM region) AS spaces, (SELECT CAST(max(o_custkey) AS VARCHAR) FROM orders) AS last_scan, (SELECT count(*) FROM documents) * 1536 AS index_bytes")
def agg_stats(spark, sf_dir):
    return A.corpus_stats(table(spark, sf_dir, "documents"), table(spark, sf_dir, "region"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("last_scan")))


@query("SELECT min(n) AS min_count, max(n) AS max_count FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def agg_tag_range(spark, sf_dir):
    return A.tag_range(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("document_count")))


@query("""
WITH b AS (SELECT * FROM events WHERE event_type IN ('click', 'view') ORDER BY event_id DESC LIMIT 1000)
SELECT query, searches, (SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) AS total, round((SELECT avg(value) FROM b), 6) AS average_results
FROM (SELECT event_type || user_id % 30 AS query, count(*) AS searches FROM b GROUP BY 1 ORDER BY searches DESC, query LIMIT 10)
""")
def log_search_analytics(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    log = e.select(F.col("event_id").alias("seq"), F.concat("event_type", F.col("user_id") % 30).alias("query"), F.col("value").alias("result_count"))
    return A.search_analytics(log).withColumn("average_results", F.round("average_results", 6))


@query("SELECT 'act-' || event_id AS id, event_type AS action FROM events ORDER BY event_id DESC LIMIT 50")
def log_activity_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    return A.activity_feed(e).select("id", "action")


@query("""
SELECT c.user_id, c.event_id AS click_seq, s.event_id AS search_seq, s.event_type || s.user_id AS query
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') s ON c.user_id = s.user_id AND c.event_id >= s.event_id
""")
def log_click_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat("event_type", "user_id").alias("query"), "event_type")
    return A.click_as_of(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


@query("""
WITH m AS (SELECT CAST(max(ts) AS DATE) AS d FROM events), c AS (SELECT CAST((SELECT d FROM m) - CAST(k AS INTEGER) AS DATE) AS day FROM range(7) t(k))
SELECT c.day, count(e.event_id) AS n FROM c LEFT JOIN events e ON CAST(e.ts AS DATE) = c.day GROUP BY c.day
""")
def log_daily_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.daily_activity(e, F.lit(str(e.agg(F.max("ts")).first()[0])).cast("timestamp"))


@query("""
SELECT CASE WHEN a <= 0 THEN 'Today' WHEN a = 1 THEN 'Yesterday' WHEN a < 7 THEN 'This week' ELSE 'Older' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') AS a FROM events) GROUP BY 1
""")
def log_recency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(A.recency_bucket(F.col("ts"), F.lit("2024-01-20").cast("date")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, CAST(floor(sum(v) OVER w / count(*) OVER w) AS BIGINT) AS mean_ms, CAST(floor(sum(v) OVER w / count(*) OVER w) AS BIGINT) * 100 AS eta_ms
FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
def log_rolling_eta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("value") * 100).cast("long").alias("latency_ms"))
    return A.rolling_eta(e, F.lit(100), ["user_id"], "event_id").select("event_id", "mean_ms", "eta_ms")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def sort_recent(spark, sf_dir):
    return A.recent_documents(table(spark, sf_dir, "documents"), 10, "n_chars").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20 OFFSET 20")
def sort_page(spark, sf_dir):
    return A.page(table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id"), 1)


@query("SELECT source, doc_id, place FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents) WHERE place <= 5")
def sort_top_per_group(spark, sf_dir):
    out = A.top_per_group(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 5)
    return out.select("source", "doc_id", "place")


@query("SELECT lang AS id, count(*) FILTER (WHERE d.lang = s.l AND (s.t IS NULL OR d.source = s.t)) AS document_count FROM documents d, (VALUES ('en', NULL), ('fr', 'src1')) s(l, t) WHERE FALSE GROUP BY 1 UNION ALL SELECT 'a', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', count(*) FROM documents WHERE lang = 'fr' AND source = 'src1' UNION ALL SELECT 'c', count(*) FROM documents UNION ALL SELECT 'd', 0")
def saved_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_type"), F.col("source").alias("topic"), F.lit("2024-01-01").alias("created_at"))
    saved = spark.createDataFrame([("a", "en", None, None, None), ("b", "fr", "src1", None, None), ("c", None, None, None, None), ("d", "xx", None, None, None)], "id string, doc_type string, topic string, date_from string, date_to string")
    return A.saved_search_counts(saved, docs)


# --- entities ------------------------------------------------------------------

MENTION_SQL = "SELECT o_orderkey AS doc_id, 'customer' AS entity_type, 'c' || o_custkey AS value FROM orders UNION ALL SELECT l_orderkey, 'part', 'p' || l_partkey % 500 FROM lineitem"


def _mentions(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("customer").alias("entity_type"), F.concat(F.lit("c"), "o_custkey").alias("value"))
    return a.union(items.select("l_orderkey", F.lit("part"), F.concat(F.lit("p"), F.col("l_partkey") % 500)))


@query(f"SELECT entity_type, value, count(DISTINCT doc_id) AS document_count FROM ({MENTION_SQL}) GROUP BY 1, 2")
def ent_summary(spark, sf_dir):
    return E.type_summary(_mentions(spark, sf_dir))


@query(f"""
WITH m AS ({MENTION_SQL}) SELECT value, count(*) AS shared_count FROM m WHERE doc_id IN (SELECT doc_id FROM m WHERE value = 'p7') AND value <> 'p7' GROUP BY value HAVING count(*) >= 2 ORDER BY shared_count DESC, value LIMIT 10
""")
def ent_related(spark, sf_dir):
    return E.related_entities(_mentions(spark, sf_dir), "value", "p7")


@query(f"""
WITH m AS ({MENTION_SQL}), t AS (SELECT DISTINCT value AS target, doc_id FROM m WHERE value LIKE 'p%' AND CAST(substr(value, 2) AS INTEGER) % 50 = 0)
SELECT target, value, count(*) AS shared_count, CAST(row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, value) AS INTEGER) AS place FROM t JOIN m USING (doc_id) WHERE value <> target GROUP BY 1, 2 QUALIFY place <= 10
""")
def ent_co_occurrence(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    targets = m.where("value like 'p%' and cast(substr(value, 2) as int) % 50 = 0").select("value").distinct()
    return E.co_occurrence(m, "value", targets)


@query("""
SELECT p_brand AS canonical_id, p_name AS canonical_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY octet_length(encode(p_name)) DESC, p_partkey DESC) = 1
""")
def ent_canonical_name(spark, sf_dir):
    return E.canonical_name(table(spark, sf_dir, "part").select(F.col("p_brand").alias("canonical_id"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("position")))


@query("SELECT p_brand AS canonical_id, p_type AS short_name FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) = 1")
def ent_short_name(spark, sf_dir):
    return E.short_name_mode(table(spark, sf_dir, "part").select(F.col("p_brand").alias("canonical_id"), F.col("p_type").alias("canonical_short_name")))


@query("""
WITH RECURSIVE c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Acme n' || s_suppkey // 9 ELSE 'acme n' || s_suppkey // 9 || ' x' || s_suppkey // 3 END AS name FROM supplier),
w AS (SELECT id, lower(name) AS k, string_split(lower(name), ' ') AS ws FROM c),
e AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id <> b.id AND (len(list_filter(a.ws, lambda x: NOT list_contains(b.ws, x))) = 0 OR len(list_filter(b.ws, lambda x: NOT list_contains(a.ws, x))) = 0)),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a)
SELECT id, min(root) AS canonical_id FROM r GROUP BY id
""")
def ent_resolve(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Acme n"), F.floor(k / 9))).otherwise(F.concat(F.lit("acme n"), F.floor(k / 9), F.lit(" x"), F.floor(k / 3)))
    return E.resolve(s.select(k.alias("id"), name.alias("name"), F.lit("Organization").alias("entity_type")))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("entity_type"))
    moved = F.concat(F.array(F.get("embedding", F.lit(0)) + 0.1), F.slice("embedding", 2, 1 << 20))
    return e.union(e.where("id % 3 = 0").select(F.col("id") + 10_000_000, moved, "entity_type"))


@query("""
WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT vec_id + 10000000, label, list_concat([CAST(embedding[1] AS DOUBLE) + 0.1], CAST(embedding[2:] AS DOUBLE[])) FROM embeddings WHERE vec_id % 3 = 0)
SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.label = b.label AND a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.75
""")
def ent_vector_merge(spark, sf_dir):
    return E.vector_pairs(_vectors(spark, sf_dir))


@query(f"SELECT doc_id, value, CASE WHEN value = 'p7' THEN 'new' ELSE entity_type END AS canonical_id FROM ({MENTION_SQL})")
def ent_split_alias(spark, sf_dir):
    return E.split_alias(_mentions(spark, sf_dir).withColumn("canonical_id", F.col("entity_type")), "P7", "new").select("doc_id", "value", "canonical_id")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS canonical_id FROM orders")
def ent_lookup(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    found = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("C"), "o_custkey").alias("value"), F.lit("Person").alias("entity_type"))
    aliases = customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("surface_lc"), F.lit("person").alias("type_lc"), F.col("c_custkey").alias("canonical_id"))
    return E.lookup(found, aliases).select("doc_id", "canonical_id")


# --- triples ---------------------------------------------------------------------

BASE_TRIPLES = """
WITH t AS (SELECT 'c' || c_custkey AS s, 'located_in' AS p, 'n' || c_nationkey AS o, 'd' || c_custkey % 10 AS d FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, 'd0' FROM nation
UNION ALL SELECT DISTINCT 'c' || o_custkey, 'purchased_from', 's' || l_suppkey, 'd' || o_custkey % 10 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'c' || o_custkey, 'owns', 'p' || l_partkey, 'd' || o_custkey % 10 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT 'c' || c_custkey, 'partner_of', 'c' || c_custkey + 1, 'd5' FROM customer)
"""
INVERSE = "CASE p WHEN 'owns' THEN 'owned_by' WHEN 'purchased_from' THEN 'sold_to' WHEN 'partner_of' THEN 'partner_of' END"
CLOSURE = f", c AS (SELECT * FROM t UNION ALL SELECT o, {INVERSE}, s, d FROM t WHERE {INVERSE} IS NOT NULL), m AS (SELECT s, p, o, list_sort(list(DISTINCT d)) AS ds FROM c GROUP BY 1, 2, 3)"
CLOSED = BASE_TRIPLES + CLOSURE


def _triples(spark, sf_dir):
    """Triples of all orders, lines and customers."""
    customer, nation, orders, items = (table(spark, sf_dir, n) for n in ("customer", "nation", "orders", "lineitem"))
    key = lambda p, c: F.concat(F.lit(p), c)
    bought = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    row = lambda df, s, p, o, d: df.select(s.alias("subject_id"), F.lit(p).alias("predicate"), o.alias("object_id"), F.array(d).alias("doc_ids"), F.lit(False).alias("user_added"))
    of = lambda c: key("d", F.col(c) % 10)
    parts = [
        row(customer, key("c", F.col("c_custkey")), "located_in", key("n", F.col("c_nationkey")), of("c_custkey")),
        row(nation, key("n", F.col("n_nationkey")), "part_of", key("r", F.col("n_regionkey")), F.lit("d0")),
        row(bought, key("c", F.col("o_custkey")), "purchased_from", key("s", F.col("l_suppkey")), of("o_custkey")),
        row(bought, key("c", F.col("o_custkey")), "owns", key("p", F.col("l_partkey")), of("o_custkey")),
        row(customer, key("c", F.col("c_custkey")), "partner_of", key("c", F.col("c_custkey") + 1), F.lit("d5")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _store(spark, sf_dir):
    t = _triples(spark, sf_dir)
    return R.upsert(t.limit(0), t)


@query(CLOSED + "SELECT s AS subject_id, p AS predicate, o AS object_id, array_to_string(ds, ',') AS doc_ids FROM m")
def trp_closure(spark, sf_dir):
    return _store(spark, sf_dir).select("subject_id", "predicate", "object_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(CLOSED + "SELECT s AS subject_id, p AS predicate, o AS object_id FROM m WHERE len(list_filter(ds, lambda x: x <> 'd5')) > 0")
def trp_cleanup(spark, sf_dir):
    return R.cleanup_document(_store(spark, sf_dir), F.lit("d5")).select("subject_id", "predicate", "object_id")


@query(CLOSED + "SELECT s AS subject_id, p AS predicate, o AS object_id FROM m WHERE NOT (p = 'purchased_from' AND s LIKE 'c%1') AND NOT (p = 'sold_to' AND o LIKE 'c%1')")
def trp_delete(spark, sf_dir):
    gone = _triples(spark, sf_dir).where("predicate = 'purchased_from' and subject_id like 'c%1'")
    return R.delete(_store(spark, sf_dir), gone).select("subject_id", "predicate", "object_id")


@query(CLOSED + "SELECT p AS predicate, o AS other_id FROM m WHERE s = 'c12' UNION SELECT p, s FROM m WHERE o = 'c12'")
def trp_related(spark, sf_dir):
    return R.all_related(_store(spark, sf_dir), F.lit("c12"))


@query(BASE_TRIPLES + "SELECT DISTINCT s AS subject_id FROM t WHERE p = 'located_in' AND o = 'n4'")
def trp_subjects(spark, sf_dir):
    return R.subjects_of(_store(spark, sf_dir), "located_in", F.lit("n4"))


@query(CLOSED + "SELECT o AS object_id FROM m WHERE p = 'owns' AND s = 'c12'")
def trp_objects(spark, sf_dir):
    return R.objects_of(_store(spark, sf_dir), F.lit("c12"), "owns")


@query(CLOSED + "SELECT s AS subject_id, p AS predicate, o AS object_id, CASE WHEN s = 'n4' THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN s = 'n4' THEN NULL ELSE c_name END AS subject_name FROM m LEFT JOIN customer ON s = 'c' || c_custkey WHERE s = 'n4' OR o = 'n4'")
def trp_page(spark, sf_dir):
    canon = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("canonical_id"), F.col("c_name").alias("canonical_name"), F.lit("person").alias("entity_type"))
    places = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit(None).cast("string"), F.lit("location")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit(None).cast("string"), F.lit("location")))
    return R.relations_page(_store(spark, sf_dir), canon.union(places), F.lit("n4")).select("subject_id", "predicate", "object_id", "direction", "subject_name")


@query(BASE_TRIPLES + """
, k AS (SELECT DISTINCT s, o, CASE CAST(substr(o, 2) AS INTEGER) % 3 WHEN 0 THEN CASE WHEN lower(p_name) LIKE '%plot%' OR lower(p_name) LIKE '%land%' OR lower(p_name) LIKE '%property%' THEN 'Property' WHEN lower(p_name) LIKE '%car%' OR lower(p_name) LIKE '%vehicle%' OR lower(p_name) LIKE '%bike%' OR lower(p_name) LIKE '%scooter%' THEN 'Vehicle' ELSE 'Other' END WHEN 1 THEN 'Business' ELSE 'Financial' END AS a
  FROM t JOIN part ON o = 'p' || p_partkey WHERE p = 'owns')
SELECT s AS subject_id, a AS asset_type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY s) AS BIGINT) AS total FROM k GROUP BY s, a
""")
def trp_ownership(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.get(F.array(F.lit("location"), F.lit("organization"), F.lit("identifier")), (F.col("p_partkey") % 3).cast("int"))
    canon = part.select(F.concat(F.lit("p"), "p_partkey").alias("canonical_id"), F.when(kind == "identifier", F.concat(F.lit("ID"), "p_partkey")).otherwise(F.col("p_name")).alias("canonical_name"), kind.alias("entity_type"))
    topics = spark.createDataFrame([(f"d{n}", "business") for n in range(10)], "doc_id string, topic string")
    subclasses = part.select(F.concat(F.lit("id"), "p_partkey").alias("surface_lc"), F.lit("iban").alias("subclass"))
    out = R.ownership(_triples(spark, sf_dir), canon, topics, subclasses)
    return out.select("subject_id", "asset_type", "n", "total")


@query(CLOSED + "SELECT CASE WHEN p = 'owns' THEN 'holds' ELSE p END AS predicate, count(*) AS n FROM m GROUP BY 1")
def trp_rename(spark, sf_dir):
    return R.rename_predicate(_store(spark, sf_dir), "owns", "holds").groupBy("predicate").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc_id, l_linenumber % 4 AS s, 'owns' AS predicate, l_linenumber // 2 AS o FROM lineitem WHERE l_partkey % 2 = 0 AND l_linenumber % 4 <> l_linenumber // 2 AND l_linenumber // 2 < 3 AND l_linenumber % 4 < 3")
def trp_validate_model(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    rows = i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4).alias("s"), F.when(F.col("l_partkey") % 2 == 0, "owns").otherwise("invented").alias("predicate"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("o"))
    return R.validate_model_triples(rows, spark.createDataFrame([(p,) for p in PREDICATES], "predicate string"), F.lit(3)).select("doc_id", "s", "predicate", "o")


# --- ontology ---------------------------------------------------------------------


@query("""
SELECT lower(replace(p_brand, '#', '_')) || '_' || p_size AS name, count(DISTINCT p_partkey % 3) AS support, CASE WHEN count(DISTINCT p_partkey % 3) >= 2 THEN
  CASE WHEN row_number() OVER (PARTITION BY count(DISTINCT p_partkey % 3) >= 2 ORDER BY min(p_partkey), lower(replace(p_brand, '#', '_')) || '_' || p_size) <= 179 THEN 'promoted' ELSE 'cap_exceeded' END ELSE 'pending' END AS status FROM part GROUP BY 1
""")
def ont_observe(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    seen = part.select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_"), "p_size").alias("name"), (F.col("p_partkey") % 3).alias("doc_id"), F.col("p_partkey").alias("seq"))
    return O.observe(seen, O.seed(spark))


@query("SELECT name, source FROM (SELECT lower(event_type) AS name, CASE min(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 3 END) WHEN 2 THEN 'corpus' ELSE 'manual' END AS source FROM events GROUP BY 1)")
def ont_effective(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.lower("event_type").alias("name"), F.when(F.col("user_id") % 2 == 0, "corpus").otherwise("manual").alias("source"), F.lit(1).cast("long").alias("count"))
    return O.effective(rows).select("name", "source")


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE event_type END AS name, count(*) AS count FROM events GROUP BY 1")
def ont_merge(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("count")).select("name", F.lit("adaptive").alias("source"), "count")
    return O.merge(counts, ["click", "view"], "seen").select("name", "count")


@query("SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS name FROM part")
def ont_bootstrap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("name"), F.col("p_partkey").alias("position"))
    return O.validate_bootstrap(rows.union(spark.createDataFrame([("owns of", 0), ("Bad", 1)], "name string, position long")), O.seed(spark)).select("name")


# --- stores, model replies, ingest, streams ------------------------------------------


@query("SELECT conv_id AS session_id, count(*) AS messages, min(turn) AS created_at, max(turn) AS updated_at FROM conversations GROUP BY 1")
def chat_sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at")))


@query("SELECT conv_id, turn FROM conversations WHERE octet_length(encode(trim(text))) BETWEEN 1 AND 4000")
def chat_valid(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(S.valid_message(F.col("text"))).select("conv_id", "turn")


@query("SELECT conv_id AS message_id, string_agg(replace(text, chr(10), ' '), '' ORDER BY turn, role) AS content, 'done' AS state, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY 1")
def chat_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    numbered = rows.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    lines = numbered.select(F.col("conv_id").alias("message_id"), "seq", line.alias("line"))
    end = F.explode(F.array(F.struct(F.lit(1 << 29).alias("seq"), F.lit('data: {"choices": [], "usage": {"prompt_tokens": 1}}').alias("line")), F.struct(F.lit(1 << 30).alias("seq"), F.lit("data: [DONE]").alias("line"))))
    ends = rows.select(F.col("conv_id").alias("message_id")).distinct().select("message_id", end.alias("e")).select("message_id", "e.*")
    answer = S.accumulate_tokens(M.stream_frames(lines.union(ends)))
    return answer.withColumn("n", F.char_length("content").cast("long"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE c_name END AS name FROM customer")
def store_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return S.upsert(c, c.where("id % 3 = 0").select("id", F.concat(F.lit("new"), "id").alias("name")), "id")


@query("""
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 3.0 ELSE 2.5 END AS DOUBLE) AS entities_version, 'person' AS entity_type, CASE WHEN doc_id % 3 = 0 THEN 'Organization' ELSE 'Person' END AS class, CASE WHEN doc_id % 3 = 0 THEN 'tax_papers' END AS topic FROM documents
""")
def llm_two_pass(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit('<think>x {y}</think>\n```json\n{"refined_entities": [{"pass1_id": "e_0", "class": "Organization"}], "topic": "Tax papers!"}\n```')).when(F.col("doc_id") % 3 == 1, "no json")
    entity = F.array(F.struct(F.lit("Acme").alias("value"), F.lit("person").alias("entity_type"), F.lit("Person").alias("class"), F.lit(None).cast("string").alias("subclass")))
    out = M.two_pass(docs.select("doc_id", entity.alias("extracted_entities"), reply.alias("reply")))
    return out.select("doc_id", F.col("entities_version").cast("double").alias("entities_version"), F.get("extracted_entities", F.lit(0))["entity_type"].alias("entity_type"), F.get("extracted_entities", F.lit(0))["class"].alias("class"), "topic")


@query("SELECT doc_id, 0 AS s, 'owns' AS predicate, CAST(doc_id % 5 AS INTEGER) AS o FROM documents")
def llm_relations(spark, sf_dir):
    reply = F.concat(F.lit('{"triples": [{"subject": "e_0", "predicate": "owns", "object": "e_'), F.col("doc_id") % 5, F.lit('"}, {"subject": "x", "predicate": "owns", "object": "e_1"}]}'))
    return M.relations(table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 4 = 1 THEN 'replaced' ELSE 'unchanged' END AS change FROM documents")
def src_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash"), "doc_id")
    known = docs.where("doc_id % 4 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 4 == 1, "old").otherwise(F.col("content_hash")))
    return I.changes(docs.drop("doc_id"), known).select("path", "change")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE 'Unknown' END AS title, 'other' AS doc_type, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS size, CASE WHEN doc_id % 2 = 0 THEN lang END AS topic FROM documents")
def src_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    meta = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("T"), "doc_id").alias("name"), F.col("n_chars").alias("size"), F.col("lang").alias("topic")))).otherwise(F.lit('{"topic": ""}'))
    return I.decode_rows(docs.select(F.col("doc_id").alias("id"), meta.alias("metadata"))).select("id", "title", "doc_type", "size", "topic")


@query("""
SELECT p FROM (SELECT '/home/' || CASE page_id % 5 WHEN 0 THEN 'docs' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'x/.git' WHEN 3 THEN 'a/b' ELSE 'target' END || '/' || CASE WHEN page_id % 7 = 0 THEN '.' ELSE '' END || page_id || '.' || CASE page_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'md' WHEN 2 THEN 'exe' ELSE 'xlsx' END AS p, page_id FROM pages)
WHERE page_id % 5 IN (0, 3) AND page_id % 7 <> 0 AND page_id % 4 <> 2
""")
def src_accepted(spark, sf_dir):
    k = F.col("page_id")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    path = F.concat(F.lit("/home/"), pick(5, "docs", "node_modules", "x/.git", "a/b", "target"), F.lit("/"), F.when(k % 7 == 0, ".").otherwise(""), k.cast("string"), F.lit("."), pick(4, "PDF", "md", "exe", "xlsx"))
    return table(spark, sf_dir, "pages").select(path.alias("p")).where(I.accepted(F.col("p")))


def _replayed(spark, sf_dir):
    """The events as a file stream, a batch read over what is there."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, stream, mode="append"):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return ST.drain(stream, f"{base}/out", f"{base}/checkpoint", mode)


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_windows(spark, sf_dir):
    out = _drained(spark, ST.query_windows(_replayed(spark, sf_dir)))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, run HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_sessions(spark, sf_dir):
    out = _drained(spark, ST.user_sessions(_replayed(spark, sf_dir)))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
