"""Vector search, scoring, related documents, retrieval and clustering over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph as G
from ..operators import search as S
from ..operators import spaces as P
from ..sources.ingest import hashing_embedder
from .registry import query, table

AS_OF = "2026-01-01 00:00:00"
CREATED_SQL = "CAST(DATE '2022-01-01' + CAST(vec_id * 7 % 2000 AS INTEGER) AS TIMESTAMP)"


def _rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    created = F.expr("cast(date_add(date'2022-01-01', cast(vec_id * 7 % 2000 as int)) as timestamp)")
    keys = F.array(F.concat(F.lit("Person:p"), F.col("label")), F.concat(F.lit("Organization:o"), F.col("vec_id") % 7))
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", created.alias("created_at"), keys.alias("keys"))


def _queries(spark, sf_dir):
    """Every row whose id is divisible by 50 asks."""
    rows = _rows(spark, sf_dir).where("id % 50 = 0")
    return rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("keys").alias("query_keys"))


PAIRS = f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, {CREATED_SQL} AS created_at FROM embeddings),
p AS (SELECT q.id AS query_id, r.id, r.label, q.label AS query_label, r.created_at, list_cosine_similarity(r.v, q.v) AS s, list_inner_product(r.v, q.v) / sqrt(len(r.v)) AS logit FROM e r, e q WHERE q.id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p QUALIFY rank <= 20),
r AS (SELECT *, CASE WHEN created_at > TIMESTAMP '{AS_OF}' THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400) / 1095)) END AS recent FROM k),
f AS (SELECT *, least(1.0, greatest(0.0, 0.9 * least(1.0, greatest(0.0, s)) + 0.1 * recent)) AS score FROM r)
"""


@query(PAIRS + "SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS similarity FROM k")
def vec_top_k(spark, sf_dir):
    out = S.top_k(_rows(spark, sf_dir), _queries(spark, sf_dir))
    return out.select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query(PAIRS + "SELECT query_id, id, round(s, 6) AS similarity, round(score, 6) AS score FROM f WHERE label <> 3")
def vec_search(spark, sf_dir):
    hits = S.search(_rows(spark, sf_dir), _queries(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), keep=F.col("label") != 3)
    return hits.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query(PAIRS + ", a AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY query_id)) AS x FROM f) SELECT query_id, id, round(0.7 * score + 0.3 * x / sum(x) OVER (PARTITION BY query_id), 6) AS reranked FROM a")
def vec_rerank(spark, sf_dir):
    rows, asked = _rows(spark, sf_dir), _queries(spark, sf_dir)
    hits = S.search(rows, asked, F.lit(AS_OF).cast("timestamp"))
    keyed = hits.join(rows.select("id", F.col("embedding").alias("k")), "id").join(asked.select("query_id", F.col("query_vector").alias("q")), "query_id")
    return S.rerank(keyed.withColumn("logit", S.attention_logit(F.col("q"), F.col("k")))).select("query_id", "id", F.round("reranked", 6).alias("reranked"))


@query(PAIRS + """, j AS (SELECT *, ((label = query_label)::INT + (id % 7 = query_id % 7)::INT) AS n_shared FROM f WHERE id <> query_id),
c AS (SELECT query_id, id, 0.55 * s + 0.35 * (n_shared / (4.0 - n_shared)) + 0.10 * recent AS score FROM j)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM c WHERE score >= 0.3) WHERE place <= 5""")
def vec_related_scored(spark, sf_dir):
    out = S.related_scored(_rows(spark, sf_dir), _queries(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return out.select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS first FROM embeddings")
def vec_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(V.normalise(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("""
WITH s AS (SELECT source, list(DISTINCT lang) AS langs, list(DISTINCT CAST(doc_id % 40 AS VARCHAR)) AS marks FROM documents GROUP BY source)
SELECT a.source AS a, b.source AS b, round(len(list_intersect(a.marks, b.marks)) / len(list_distinct(list_concat(a.marks, b.marks))), 6) AS jaccard,
  round((len(a.marks) + len(b.marks) - 2 * len(list_intersect(a.marks, b.marks))) / len(list_distinct(list_concat(a.marks, b.marks))), 6) AS distance
FROM s a JOIN s b ON CAST(substr(b.source, 4) AS INTEGER) = CAST(substr(a.source, 4) AS INTEGER) + 5
""")
def set_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    s = docs.groupBy("source").agg(F.collect_set((F.col("doc_id") % 40).cast("string")).alias("m"))
    a, b = (s.select(F.col("source").alias(n), F.col("m").alias(f"m{n}"), F.substring("source", 4, 9).cast("int").alias(f"k{n}")) for n in "ab")
    pairs = a.join(b, F.col("kb") == F.col("ka") + 5)
    return pairs.select("a", "b", F.round(V.jaccard(F.col("ma"), F.col("mb")), 6).alias("jaccard"), F.round(V.jaccard_distance(F.col("ma"), F.col("mb")), 6).alias("distance"))


NEIGHBOURS = """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
n AS (SELECT a.id AS source, b.id AS target, a.label AS la, b.label AS lb, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.id <> b.id),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, target) <= 10),
g AS (SELECT source, target, la, lb, greatest(CASE WHEN s > 0.7 THEN s ELSE 0 END, CASE WHEN la = lb THEN 0.5 ELSE 0 END, CASE WHEN source % 5 = target % 5 THEN 0.3 ELSE 0 END, CASE WHEN source % 11 = target % 11 THEN 0.4 ELSE 0 END) AS weight FROM k)
"""


def _edges(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    near = G.blocked_neighbours(rows)
    facts = rows.select("id", F.array(F.col("label").cast("string")).alias("spaces"), F.array((F.col("id") % 5).cast("string")).alias("tags"), F.array((F.col("id") % 11).cast("string")).alias("names"))
    a, b = (facts.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{n}") for c in ("spaces", "tags", "names")]) for end, n in (("source", "a"), ("target", "b")))
    return G.document_edges(near.join(a, "source").join(b, "target"))


@query(NEIGHBOURS + "SELECT source, target, round(weight, 6) AS weight FROM g WHERE weight > 0")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target", F.round("weight", 6).alias("weight"))


@query(NEIGHBOURS + "SELECT 's' || least(la, lb) AS space_a, 's' || greatest(la, lb) AS space_b, round(sum(weight), 5) AS weight FROM g WHERE weight > 0 AND la <> lb GROUP BY ALL")
def graph_spaces(spark, sf_dir):
    members = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), "label").alias("space_id"))
    return G.space_graph(_edges(spark, sf_dir), members).withColumn("weight", F.round("weight", 5))


@query(NEIGHBOURS + "SELECT source, target FROM g WHERE weight > 0 AND target % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) <= 5")
def graph_related(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"))
    return G.related_documents(_edges(spark, sf_dir), docs).select("source", "target")


@query()
def rag_retrieve(spark, sf_dir):
    embed = hashing_embedder(32)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", embed(F.col("text")).alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("query_vector"))
    out = S.retrieve_chunks(docs, asked, embed)
    return out.select("query_id", "id", "chunk_no", "start", "end", "rank", F.round("score", 6).alias("score"))


@query("""
SELECT conv_id, string_agg('[' || n || '] ' || role || ': ' || text, chr(10) ORDER BY n) AS context, count(*) AS citations FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) GROUP BY conv_id
""")
def rag_context(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    shaped = rows.select(F.col("conv_id").alias("query_id"), "rank", F.col("turn").alias("id"), F.col("role").alias("title"), F.col("text").alias("chunk"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return S.numbered_context(shaped).select(F.col("query_id").alias("conv_id"), "context", F.size("citations").cast("long").alias("citations"))


@query("""
SELECT label AS space, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS c0, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS c63 FROM embeddings GROUP BY label
""")
def space_centroids(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    members = rows.select("id", F.col("label").cast("string").alias("space_id"))
    out = P.centroids_of(rows, members, 64)
    return out.select(F.col("space_id").cast("int").alias("space"), "n", F.round(F.get("centroid", F.lit(0)), 6).alias("c0"), F.round(F.get("centroid", F.lit(63)), 6).alias("c63"))


@query()
def space_kmeans(spark, sf_dir):
    return P.kmeans(_rows(spark, sf_dir).select("id", "embedding"), init="farthest_first")


@query()
def space_sub_spaces(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return P.sub_spaces(rows, rows.select("id", F.concat(F.lit("space-"), "label").alias("space_id")), least_docs=40)


@query("""
WITH e AS (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
cm AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS v FROM cm GROUP BY label),
pm AS (SELECT label, i, avg(x) AS x FROM e WHERE vec_id % 2 = 0 GROUP BY ALL), p AS (SELECT label, list(x ORDER BY i) AS v FROM pm GROUP BY label)
SELECT 's' || c.label AS space_id, 's' || p.label AS previous_id, round(list_cosine_similarity(c.v, p.v), 6) AS similarity FROM c, p QUALIFY row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(c.v, p.v) DESC, 's' || p.label DESC) = 1
""")
def space_nearest_previous(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("s"), "label").alias("space_id"))
    members = rows.select("id", "space_id")
    now, before = P.centroids_of(rows, members, 64), P.centroids_of(rows, members.where("id % 2 = 0"), 64)
    return P.nearest_previous(now, before).withColumn("similarity", F.round("similarity", 6))


MEMBERS = """
WITH cur AS (SELECT 's' || doc_id % 9 AS space_id, doc_id AS id FROM documents), prev AS (SELECT 's' || doc_id % 9 AS space_id, doc_id AS id FROM documents WHERE doc_id % 9 NOT IN (0, 1) AND (doc_id % 9 <> 2 OR doc_id % 4 <> 0)
  UNION ALL SELECT 's1', doc_id FROM documents WHERE doc_id % 9 = 0)
"""


def _members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cur = docs.select(F.concat(F.lit("s"), F.col("doc_id") % 9).alias("space_id"), F.col("doc_id").alias("id"))
    prev = cur.where("id % 9 not in (0, 1) and (id % 9 <> 2 or id % 4 <> 0)").union(docs.where("doc_id % 9 = 0").select(F.lit("s1"), "doc_id"))
    cache = spark.createDataFrame([(f"s{n}", "Space 4" if n == 3 else f"Label {n}", n == 4) for n in range(1, 9)], "space_id string, label string, user_locked boolean")
    return cur, prev, cache


@query(MEMBERS + """
, ch AS (SELECT coalesce(c.space_id, p.space_id) AS space_id, sum(CASE WHEN c.id IS NULL OR p.id IS NULL THEN 1 ELSE 0 END) AS changed, count(*) AS united FROM cur c FULL JOIN prev p ON c.space_id = p.space_id AND c.id = p.id GROUP BY 1)
SELECT space_id, CASE WHEN space_id = 's4' THEN 'skip' WHEN space_id = 's0' THEN 'llm' WHEN space_id = 's3' THEN 'llm' WHEN 5 * changed <= united THEN 'skip' ELSE 'llm' END AS decision FROM ch
""")
def space_label_plan(spark, sf_dir):
    cur, prev, cache = _members(spark, sf_dir)
    return P.label_plan(cur, prev, cache)


@query("WITH s AS (SELECT DISTINCT 's' || doc_id % 9 AS space_id FROM documents) SELECT 's' || n AS space_id FROM range(1, 14) t(n) WHERE 's' || n NOT IN (SELECT space_id FROM s)")
def space_stale_labels(spark, sf_dir):
    cur, _, _ = _members(spark, sf_dir)
    cache = spark.range(1, 14).select(F.concat(F.lit("s"), "id").alias("space_id"))
    return P.stale_labels(cache, cur)


def _collisions(part):
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_brand"), F.lit(" "), "p_size")).otherwise(F.concat(F.lower("p_brand"), F.lit("  "), "p_size"))
    rows = part.select(F.concat(F.lit("space-"), "p_partkey").alias("space_id"), label.alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("hint"))
    return P.resolve_collisions(rows).select("space_id", "collides", "label")


@query("""
WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) || ' ' || p_size ELSE lower(p_brand) || '  ' || p_size END AS label, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS hint FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(regexp_replace(label, '\\s+', ' ', 'g')))) > 1 AS collides FROM l)
SELECT 'space-' || p_partkey AS space_id, collides, CASE WHEN collides THEN label || ' — ' || coalesce(hint, CAST(p_partkey + 1 AS VARCHAR)) ELSE label END AS label FROM c
""")
def space_collisions(spark, sf_dir):
    return _collisions(table(spark, sf_dir, "part"))


NAMED = """
WITH d AS (SELECT doc_id, 's' || doc_id % 8 AS space_id, doc_id % 8 AS k FROM documents)
SELECT space_id, CASE k WHEN 0 THEN 'Invoices & Receipts' WHEN 1 THEN 'Property' WHEN 2 THEN 'Spreadsheets & Data' WHEN 3 THEN 'Work' WHEN 4 THEN 'Medical' WHEN 5 THEN 'Kids & Education' WHEN 6 THEN 'Photos & Images' ELSE 'Space 8' END AS name, count(*) AS n FROM d GROUP BY ALL
"""


@query(NAMED)
def space_rule_names(spark, sf_dir):
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 8
    by = lambda *values: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    rows = docs.select(
        F.concat(F.lit("s"), k).alias("space_id"), "doc_id", by("PDF", "txt", "csv", "txt", "txt", "md", "png", "txt").alias("doc_type"),
        by("/a/bills", "/home/property-tax", "/x/data", "/me/work", "/me/health", "/me/school", "/me/photos", "/me/misc").alias("path"),
        F.array(by("amount", "date", "url", "person", "email", "person", "person", "organization"), F.lit("person")).alias("entity_types"),
    )
    out = P.name_signals(rows)
    index = F.regexp_extract("space_id", "([0-9]+)", 1).cast("int")
    return out.select("space_id", P.rule_style(index)["name"].alias("name"), "n")


@query("""
SELECT 's' || k AS space_id, value AS hint FROM (SELECT doc_id % 9 AS k, lang AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id % 9) AS docs FROM documents GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, value) = 1 AND n >= (docs + 4) // 5
""")
def space_hint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id") % 9).alias("space_id"), F.col("lang").alias("value"))
    return P.canonical_hint(docs.groupBy("space_id", "value").agg(F.count("*").alias("n")), docs.groupBy("space_id").agg(F.count("*").alias("docs")))


@query("""
SELECT 's' || doc_id % 9 AS space_id, count(*) AS document_count, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY CAST(doc_id AS VARCHAR))[1:3], ',') AS sample_files FROM documents GROUP BY 1
""")
def space_assemble(spark, sf_dir):
    cur, _, _ = _members(spark, sf_dir)
    return P.assemble(cur, cur.select("id", F.col("id").cast("string").alias("title"))).withColumn("sample_files", F.array_join("sample_files", ","))


@query("SELECT doc_id AS id, CASE WHEN doc_id = 10 THEN 's5' ELSE 's' || doc_id % 9 END AS space_id FROM documents")
def space_move(spark, sf_dir):
    return P.move_document(_members(spark, sf_dir)[0], 10, "s5").select("id", "space_id")


@query("SELECT DISTINCT 's' || doc_id % 9 AS space_id, 't' || doc_id % 4 AS other_id FROM documents UNION SELECT DISTINCT 't' || doc_id % 4, 's' || doc_id % 9 FROM documents")
def space_related(spark, sf_dir):
    cur, _, _ = _members(spark, sf_dir)
    return P.related_spaces(cur.select("id", "space_id").union(cur.select("id", F.concat(F.lit("t"), F.col("id") % 4))))


@query("""
WITH d AS (SELECT doc_id, lower(text) AS t, substr(text, 1, 200) AS excerpt FROM documents)
SELECT doc_id, substr(excerpt, greatest(p - 30, 1), p - greatest(p - 30, 1) + 3 + 90) AS snippet FROM (SELECT doc_id, excerpt, instr(lower(excerpt), 'the') AS p FROM d) WHERE p > 0
""")
def vec_snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(200)).alias("excerpt"))
    return docs.select("doc_id", S.snippet(F.col("excerpt"), F.array(F.lit("Topic:the"), F.lit("Zone:xyzzy"))).alias("snippet")).where("snippet is not null")




LABELS = """
WITH d AS (SELECT 's' || doc_id % 9 AS space_id, source AS title, lang AS class, CASE WHEN lang <> 'de' THEN lang END AS topic, 'tag' || n_chars % 13 AS tag FROM documents),
c AS (SELECT space_id, class || ': ' || count(*) AS x, row_number() OVER (PARTITION BY space_id ORDER BY count(*) DESC, class) AS r FROM d GROUP BY space_id, class QUALIFY r <= 5),
p AS (SELECT space_id, topic AS x, row_number() OVER (PARTITION BY space_id ORDER BY count(*) DESC, topic) AS r FROM d WHERE topic IS NOT NULL GROUP BY space_id, topic QUALIFY r <= 3),
g AS (SELECT space_id, tag AS x, row_number() OVER (PARTITION BY space_id ORDER BY count(*) DESC, tag) AS r FROM d GROUP BY space_id, tag QUALIFY r <= 10)
SELECT t.space_id, t.titles, (SELECT string_agg(x, ';' ORDER BY r) FROM c WHERE c.space_id = t.space_id) AS classes, (SELECT string_agg(x, ';' ORDER BY r) FROM p WHERE p.space_id = t.space_id) AS topics,
  (SELECT string_agg(x, ';' ORDER BY r) FROM g WHERE g.space_id = t.space_id) AS tags
FROM (SELECT space_id, array_to_string(list(DISTINCT title ORDER BY title)[1:20], ';') AS titles FROM d GROUP BY space_id) t
"""


@query(LABELS)
def space_label_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.concat(F.lit("s"), F.col("doc_id") % 9).alias("space_id"), F.col("source").alias("title"), F.col("lang").alias("class"), F.when(F.col("lang") != "de", F.col("lang")).alias("topic"),
        F.array(F.concat(F.lit("tag"), F.col("n_chars") % 13)).alias("tags"),
    )
    out = P.label_inputs(rows, rows)
    return out.select("space_id", *[F.array_join(c, ";").alias(c) for c in ("titles", "classes", "topics", "tags")])


@query("""
SELECT 's' || k || '-' || n AS sub_id, CASE WHEN n = 'misc' OR k % 2 = 0 THEN 'skip' ELSE 'llm' END AS decision FROM (SELECT DISTINCT doc_id % 4 AS k, CASE WHEN doc_id % 3 = 0 THEN 'misc' ELSE 'sub-' || doc_id % 3 END AS n FROM documents)
""")
def space_sub_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, "misc").otherwise(F.concat(F.lit("sub-"), F.col("doc_id") % 3))
    subs = docs.select(F.concat(F.lit("s"), F.col("doc_id") % 4, F.lit("-"), tail).alias("sub_id"), F.col("doc_id").alias("id"))
    prints = P.fingerprints(subs.select(F.col("sub_id").alias("space_id"), "id"))
    even = F.regexp_extract("space_id", "s([0-9])", 1).cast("int") % 2 == 0
    return P.sub_label_plan(subs, prints.select(F.col("space_id").alias("sub_id"), F.when(even, F.col("fingerprint")).otherwise("old").alias("fingerprint")))


@query(MEMBERS + """
, ch AS (SELECT coalesce(c.space_id, p.space_id) AS space_id, sum(CASE WHEN c.id IS NULL OR p.id IS NULL THEN 1 ELSE 0 END) AS changed, count(*) AS united FROM cur c FULL JOIN prev p ON c.space_id = p.space_id AND c.id = p.id GROUP BY 1)
SELECT space_id AS parent_id, space_id || '-sub-0' AS sub_id FROM ch WHERE 5 * changed <= united
""")
def space_keep_sub_labels(spark, sf_dir):
    cur, prev, _ = _members(spark, sf_dir)
    cache = spark.range(9).select(F.concat(F.lit("s"), "id").alias("parent_id"), F.concat(F.lit("s"), "id", F.lit("-sub-0")).alias("sub_id"))
    return P.keep_sub_labels(cache, prev, cur)


@query(PAIRS + "SELECT query_id, round(avg(score), 6) AS quality FROM f GROUP BY query_id")
def vec_trajectory(spark, sf_dir):
    return S.trajectory_quality(S.search(_rows(spark, sf_dir), _queries(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))).withColumn("quality", F.round("quality", 6))
