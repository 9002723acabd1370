"""Files, stores, streams, entities, triples, ontology, spaces and searches that the other modules leave out."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions import settings as ST
from ..functions import text as T
from ..functions import vectors as V
from ..functions.constants import PREDICATES
from ..operators import analytics as A
from ..operators import entities as E
from ..operators import filters as L
from ..operators import graph as G
from ..operators import ontology as O
from ..operators import search as S
from ..operators import spaces as P
from ..operators import stores as B
from ..operators import triples as R
from ..operators.components import shared_folder
from ..sources import ingest as I
from ..streaming import streams as W
from .registry import query, table
from .search_queries import AS_OF, CREATED_SQL, PAIRS, _queries, _rows

DOCUMENT = "doc_id string, title string, path string, doc_type string, size long, modified_at string, excerpt string, text string, content_hash string, entities_version double"


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


# --- files ---------------------------------------------------------------------


def _files(df, path, content):
    return df.select(path.alias("path"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query("""
SELECT sha256('/in/' || doc_id || '.txt' || chr(10) || sha256(text)) AS doc_id, doc_id || '.txt' AS title, 'txt' AS doc_type, CAST(octet_length(encode(text)) AS BIGINT) AS size, '2024-01-02T03:04:05Z' AS modified_at,
  left(text, 200) AS excerpt, sha256(text) AS content_hash, 2.5::DOUBLE AS entities_version FROM documents WHERE trim(text) <> '' AND doc_id % 4 <> 1
""")
def src_index(spark, sf_dir):
    """New and changed text files become documents, unchanged ones do not."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/in/"), "doc_id", F.lit(".txt"))
    parsed = I.parse(_files(docs, path, F.encode("text", "utf-8")))
    known = docs.where("doc_id % 4 in (1, 2)").select(path.alias("path"), F.when(F.col("doc_id") % 4 == 1, F.sha2(F.encode("text", "utf-8"), 256)).otherwise("old").alias("content_hash"), F.col("doc_id").cast("string").alias("doc_id"))
    return I.index(parsed, known).select("doc_id", "title", "doc_type", "size", "modified_at", "excerpt", "content_hash", F.col("entities_version").cast("double").alias("entities_version"))


def _zipped(kind: str):
    """A function that makes files of a kind from names and types."""

    def docx(name: str, kind: str) -> bytes:
        return f'<w:document xmlns:w="w"><w:p><w:r><w:t>{escape(name)}</w:t></w:r></w:p><w:p><w:r><w:t>{escape(kind)}</w:t></w:r><w:r><w:t>!</w:t></w:r></w:p></w:document>'.encode()

    def xlsx(name: str, kind: str) -> bytes:
        return f'<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>{escape(kind)}</t></is></c></row><row><c/></row><row><c><v>7</v></c></row></sheetData></worksheet>'.encode()

    def ods(name: str, kind: str) -> bytes:
        cell = "<c:table-cell><t:p>{}</t:p></c:table-cell>"
        row = f"<c:table-row>{cell.format(escape(name))}<c:table-cell/>{cell.format(escape(kind))}</c:table-row><c:table-row><c:table-cell/></c:table-row>"
        return f'<o:document-content xmlns:o="o" xmlns:c="c" xmlns:t="t"><c:table>{row}</c:table></o:document-content>'.encode()

    def pdf(name: str, kind: str) -> bytes:
        shown = name.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
        content = f"BT /F1 12 Tf 72 720 Td ({shown}) Tj 0 -14 Td [({kind[:3]}) -20 ({kind[3:]}) -300 (end)] TJ ET".encode()
        packed = zlib.compress(content)
        return b"%%PDF-1.4\n1 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n%%%%EOF" % (len(packed), packed)

    @F.pandas_udf("binary")
    def run(names: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for name, what in zip(names, kinds, strict=True):
            if kind == "pdf":
                out.append(pdf(name, what))
                continue
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                if kind == "docx":
                    z.writestr("word/document.xml", docx(name, what))
                elif kind == "ods":
                    z.writestr("content.xml", ods(name, what))
                else:
                    z.writestr("xl/worksheets/sheet1.xml", xlsx(name, what))
                    z.writestr("xl/sharedStrings.xml", f"<sst><si><t>{escape(name)}</t></si></sst>")
            out.append(raw.getvalue())
        return pd.Series(out)

    return run


@query("SELECT '/in/' || p_partkey || '.docx' AS path, p_partkey || '.docx' AS title, p_name || chr(10) || p_type || '!' AS text, 'docx' AS doc_type FROM part")
def src_docx(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return I.parse(_files(part, F.concat(F.lit("/in/"), "p_partkey", F.lit(".docx")), _zipped("docx")("p_name", "p_type"))).select("path", "title", "text", "doc_type")


@query("SELECT '/in/' || p_partkey || '.xlsx' AS path, p_name || ' ' || p_type || chr(10) || '7' AS text FROM part")
def src_xlsx(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return I.parse(_files(part, F.concat(F.lit("/in/"), "p_partkey", F.lit(".xlsx")), _zipped("xlsx")("p_name", "p_type"))).select("path", "text")


@query("SELECT '/in/' || p_partkey || '.ods' AS path, p_name || ' ' || p_type AS text FROM part")
def src_ods(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return I.parse(_files(part, F.concat(F.lit("/in/"), "p_partkey", F.lit(".ods")), _zipped("ods")("p_name", "p_type"))).select("path", "text")


@query("SELECT '/in/' || p_partkey || '.pdf' AS path, p_name || chr(10) || p_type || ' end' AS text FROM part")
def src_pdf(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return I.parse(_files(part, F.concat(F.lit("/in/"), "p_partkey", F.lit(".pdf")), _zipped("pdf")("p_name", "p_type"))).select("path", "text")


@query("""
SELECT '/in/' || p_partkey || '.' || x AS path, x AS doc_type, CASE WHEN x IN ('csv', 'md') THEN p_name END AS text,
  CASE WHEN x IN ('png', 'heic') THEN 'OCR not available' WHEN x IN ('csv', 'md') THEN NULL ELSE 'Unsupported file type: ' || x END AS error
FROM (SELECT p_partkey, p_name, CASE p_partkey % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'md' WHEN 2 THEN 'png' WHEN 3 THEN 'heic' WHEN 4 THEN 'zip' ELSE 'xls' END AS x FROM part)
""")
def src_formats(spark, sf_dir):
    """Plain formats, and an error row for formats that no parser reads."""
    kind = F.get(F.array(*map(F.lit, ("csv", "md", "png", "heic", "zip", "xls"))), (F.col("p_partkey") % 6).cast("int"))
    files = _files(table(spark, sf_dir, "part"), F.concat(F.lit("/in/"), "p_partkey", F.lit("."), kind), F.encode("p_name", "utf-8"))
    return I.parse(files).select("path", "doc_type", "text", "error")


@query("SELECT '/a/b' || (p_partkey % 3) || '/c/' || p_partkey AS path, CASE p_partkey % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'top' END AS folder_id FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT '/z' || p_partkey, NULL FROM part WHERE p_partkey % 3 = 2")
def src_folder_of(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 3 < 2, F.concat(F.lit("/a/b"), k % 3, F.lit("/c/"), k)).otherwise(F.concat(F.lit("/z"), k))
    folders = spark.createDataFrame([("top", "/a/"), ("deep", "/a/b0"), ("other", "/a/b")], "id string, path string")
    return I.folder_of(table(spark, sf_dir, "part").select(path.alias("path")), folders).select("path", "folder_id")


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS text, p_partkey % 3 = 1 AS truncated, CASE WHEN p_partkey % 3 = 2 THEN 'not UTF-8' END AS error FROM part")
def src_preview(spark, sf_dir):
    k = F.col("p_partkey")
    content = F.when(k % 3 == 2, F.unhex(F.lit("FFFE"))).otherwise(F.encode("p_name", "utf-8"))
    files = table(spark, sf_dir, "part").select(k.alias("path"), F.when(k % 3 == 1, 6 << 20).otherwise(10).cast("long").alias("length"), content.alias("content"))
    return I.preview(files)


@query("SELECT event_id, strftime(to_timestamp(1700000000 + event_id * 977) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE event_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'jpg' WHEN 2 THEN 'other' WHEN 3 THEN 'md' ELSE 'other' END AS kind FROM events")
def src_normal(spark, sf_dir):
    kinds = F.array(*[F.lit(k).cast("string") for k in ("DOC", "jpeg", None, "MD", "unknown")])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.unix_to_iso(1_700_000_000 + F.col("event_id") * 977).alias("iso"), T.normal_type(F.get(kinds, (F.col("event_id") % 5).cast("int"))).alias("kind"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN least(length(text), 2000) ELSE length(text) END AS n FROM documents")
def src_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(I.truncated(F.col("text"))).cast("long").alias("n"))


@query("SELECT '/d/' || p_partkey AS path, CAST(p_partkey AS VARCHAR) AS doc_id FROM part")
def src_path_index(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    return I.path_index(table(spark, sf_dir, "part").select(F.concat(F.lit("/d/"), k).alias("path"), k.alias("doc_id"), "p_name"))


@query("SELECT 'documents_1536' AS name, TRUE AS first, FALSE AS again, 0 AS rows UNION ALL SELECT 'documents_384', TRUE, FALSE, 0")
def src_tables(spark, sf_dir):
    """The catalogue is made once, and again nothing."""
    root = _new_folder(spark)
    first, again = I.create_tables(spark, root), I.create_tables(spark, root)
    return spark.createDataFrame([(n, n in first, n in again, I.load_table(spark, f"{root}/{n}", I.TABLES[n]).count()) for n in sorted(I.TABLES)], "name string, first boolean, again boolean, rows int")


@query("SELECT doc_id, source FROM documents")
def src_snapshot(spark, sf_dir):
    """A saved table is read back; a missing one is empty."""
    path, schema = _new_folder(spark), "doc_id long, source string"
    missing = I.load_table(spark, f"{path}/missing", schema)
    I.save_table(table(spark, sf_dir, "documents").select("doc_id", "source"), f"{path}/saved")
    return I.load_table(spark, f"{path}/saved", schema).union(missing)


@query("SELECT doc_id, CASE WHEN doc_id = 10 THEN toxic <> 1 ELSE toxic = 1 END AS is_favorite FROM labels")
def src_toggle(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("toxic") == 1).alias("is_favorite"))
    return L.toggle_favourite(labels, "10").select(F.col("doc_id").cast("long").alias("doc_id"), "is_favorite")


@query("SELECT FALSE AS llm_enabled, '' AS llm_model, 20 AS entity_cap, 'missing' AS at UNION ALL SELECT TRUE, '', 30, 'saved'")
def src_settings(spark, sf_dir):
    path = _new_folder(spark)
    before = ST.read(spark, path)
    ST.write(spark, path, ST.patch(before, llm_enabled=True, llm_model=None, entity_cap=30))
    return spark.createDataFrame([(s.llm_enabled, s.llm_model, s.entity_cap, at) for s, at in ((before, "missing"), (ST.read(spark, path), "saved"))], "llm_enabled boolean, llm_model string, entity_cap int, at string")


# --- stores and streams ----------------------------------------------------------


@query("SELECT conv_id AS session_id, 'T' || conv_id AS title, max(turn) + 1 AS updated_at FROM conversations GROUP BY conv_id UNION ALL SELECT -1, 'new', 0")
def chat_append(spark, sf_dir):
    """Sessions with a new one, after messages that are appended; those of unknown sessions are left out."""
    rows = table(spark, sf_dir, "conversations")
    known = rows.groupBy(F.col("conv_id").cast("long").alias("session_id")).agg(F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))
    sessions = known.select("session_id", F.concat(F.lit("T"), "session_id").alias("title"), "created_at", "updated_at")
    sessions = sessions.union(spark.createDataFrame([(-1, "new", 0, 0)], "session_id long, title string, created_at long, updated_at long"))
    fresh = rows.select(F.col("conv_id").cast("long").alias("session_id"), (F.col("turn") + 1).cast("long").alias("created_at")).union(rows.select(F.col("conv_id") + 10_000_000, F.col("turn").cast("long")))
    later, _ = B.append_messages(sessions, fresh.limit(0), fresh)
    return later.select("session_id", "title", "updated_at")


@query("SELECT conv_id AS session_id, count(*) * 2 AS n FROM conversations GROUP BY 1")
def chat_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "text")
    answers = rows.union(rows.select(F.col("session_id") + 10_000_000, "text"))
    return B.append_answer(rows, answers, rows.select("session_id").distinct()).groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT 'a' AS session_id, 'one' AS title UNION ALL SELECT 'b', 'two'")
def chat_create(spark, sf_dir):
    none = spark.createDataFrame([], "session_id string, title string, created_at int, updated_at int")
    at = F.lit(1)
    out = B.create_session(B.create_session(B.create_session(none, "a", " first ", at), "b", "two", at), "a", "again", at)
    return B.rename_session(out, "a", " one ").select("session_id", "title")


@query("""
WITH s(id, v, w) AS (VALUES ('one', 'src1', NULL), ('both', 'src1', 'en'), ('none', 'srcx', NULL))
SELECT id, (SELECT count(*) FROM documents WHERE source = v AND (w IS NULL OR lang = w)) AS document_count FROM s UNION ALL SELECT 'all', (SELECT count(*) FROM documents)
""")
def saved_entities(spark, sf_dir):
    """Saved searches by the entities of their documents."""
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").alias("doc_id"), F.explode(F.array("source", "lang")).alias("canonical_id"))
    aliases = pairs.select("canonical_id").distinct().select("canonical_id", F.lower("canonical_id").alias("surface_lc"), F.lit("Organization").alias("entity_type"))
    saved = spark.createDataFrame([("one", ["organization:SRC1"]), ("both", ["Organization:src1", "Organization: EN"]), ("none", ["Organization:srcx"]), ("all", [])], "id string, entities array<string>")
    plain = saved.select("id", *[F.lit(None).cast("string").alias(c) for c in ("doc_type", "topic", "date_from", "date_to")])
    facts = docs.select("doc_id", F.col("lang").alias("doc_type"), F.col("lang").alias("topic"), F.lit("2024-01-01").alias("created_at"))
    return A.saved_search_counts(plain, facts, B.saved_filters(saved), aliases, pairs)


@query("SELECT event_id AS seq, event_type AS action FROM events UNION ALL SELECT max(event_id) + 1, 'opened' FROM events")
def log_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.lit("s").alias("subject"), F.lit(0).alias("ts"))
    return B.log_activity(e, "opened", "x", F.lit(1)).select("seq", "action")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'paused' ELSE 'watching' END AS status FROM nation")
def folder_status(spark, sf_dir):
    return B.folder_status(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 2 == 0).alias("is_paused"))).select("id", "status")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 3.5 ELSE 2.5 END AS DOUBLE) AS entities_version, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n FROM documents")
def backfill_versions(spark, sf_dir):
    """Documents below the target version are extracted again, in parts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("mail u"), "doc_id", F.lit("@x.org")).alias("text"), F.when(F.col("doc_id") % 3 == 0, 3.5).when(F.col("doc_id") % 3 == 1, 2.0).cast("double").alias("entities_version"),
        F.array().cast(W.X.ENTITIES).alias("extracted_entities"),
    )
    return W.backfill(docs, parts=2).select("doc_id", "entities_version", F.size("extracted_entities").alias("n"))


def _drained(spark, stream, mode="append"):
    base = _new_folder(spark)
    return W.drain(stream, f"{base}/out", f"{base}/checkpoint", mode)


@query("""
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e), g AS (SELECT user_id, run, max(ts) AS last FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n FROM g WHERE last + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 20 MINUTE GROUP BY 1
""")
def stream_debounced(spark, sf_dir):
    """Runs of a user's events within the interval, by their last event."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return _drained(spark, W.debounced(events, "user_id", "ts", "20 minutes")).groupBy("user_id").agg(F.count("*").alias("n"))


# --- searches --------------------------------------------------------------------


@query(PAIRS.replace("WHERE q.id % 50 = 0)", "WHERE q.id % 50 = 0 AND r.label <> 3 AND r.id % 7 <> 0)") + """
, b AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY query_id)) AS x FROM f WHERE query_id % 100 = 0 OR 100 + id * 37 % 900 >= 300),
m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN 0.7 * score + 0.3 * x / sum(x) OVER (PARTITION BY query_id) ELSE score END AS reranked FROM b)
SELECT query_id, id, round(score, 6) AS score, round(reranked, 6) AS reranked, 'word w' || id || ' paid' AS excerpt, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, id) AS INTEGER) AS place FROM m
""")
def search_end_to_end(spark, sf_dir):
    """Candidates, the 20 nearest, bounds on amounts, excerpt, score and re-ranking in one."""
    rows = _rows(spark, sf_dir)
    amount = F.concat(F.lit("$"), F.format_string("%.2f", (100 + F.col("id") * 37 % 900).cast("double")))
    entities = F.array(F.struct(amount.alias("value"), F.lit("amount").alias("entity_type")))
    docs = rows.select("id", "embedding", F.concat(F.lit("word w"), "id", F.lit(" paid")).alias("text"), "created_at", entities.alias("extracted_entities"), "label")
    asked = _queries(spark, sf_dir).select("query_id", "query_vector", F.when(F.col("query_id") % 100 == 0, "plain words").otherwise("bills over $300").alias("query"))
    asked = asked.union(asked.limit(1).select(F.lit(-1).cast("long"), "query_vector", F.lit("ab")))
    candidates = L.combine(rows.where("label <> 3").select(F.col("id").alias("doc_id")), rows.where("id % 7 <> 0").select(F.col("id").alias("doc_id")))
    out = S.search_documents(docs, asked, F.lit(AS_OF).cast("timestamp"), candidates)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.round("reranked", 6).alias("reranked"), "excerpt", "place")


@query(PAIRS + "SELECT query_id, id, round(least(1.0, greatest(0.0, 0.9 * least(1.0, greatest(0.0, s)) + 0.1 * CASE WHEN id % 3 = 0 THEN 0.5 ELSE recent END)), 6) AS score FROM r")
def vec_undated(spark, sf_dir):
    """Rows without a date are half as recent as can be."""
    rows = _rows(spark, sf_dir).withColumn("created_at", F.when(F.col("id") % 3 != 0, F.col("created_at")))
    return S.search(rows, _queries(spark, sf_dir), F.lit(AS_OF).cast("timestamp")).select("query_id", "id", F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT id, v FROM e WHERE id % 50 = 0), m AS (SELECT id, v FROM e WHERE label IN (1, 2)),
k AS (SELECT q.id AS query_id, m.id, list_cosine_similarity(m.v, q.v) AS s FROM m, q QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(m.v, q.v) DESC, m.id) <= 20)
SELECT query_id, id, round(s, 6) AS similarity FROM k
""")
def vec_scoped(spark, sf_dir):
    """Search in a space and the spaces below it."""
    rows = _rows(spark, sf_dir)
    spaces = spark.createDataFrame([("s1", None), ("s2", "s1"), ("s3", None)], "id string, parent_id string")
    members = rows.select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "label").alias("space_id"))
    inside = rows.join(L.space_scope(members, spaces, "s1").withColumnRenamed("doc_id", "id"), "id", "left_semi")
    return S.top_k(inside, _queries(spark, sf_dir)).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(PAIRS + """, j AS (SELECT *, ((label = query_label)::INT + (id % 7 = query_id % 7)::INT) AS n_shared FROM f WHERE id <> query_id AND query_id < 200),
c AS (SELECT query_id, id, label, query_label, 0.55 * s + 0.35 * (n_shared / (4.0 - n_shared)) + 0.10 * recent AS score FROM j)
SELECT query_id, id, CASE WHEN id % 7 = query_id % 7 THEN 'seen o' || id % 7 || ' by p' || label || ' today' WHEN label = query_label THEN 'seen o' || id % 7 || ' by p' || label || ' today' END AS snippet
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM c WHERE score >= 0.3) WHERE place <= 5""")
def vec_related_to(spark, sf_dir):
    """Related documents of stated ones with a snippet around a shared entity."""
    rows = _rows(spark, sf_dir).withColumn("excerpt", F.concat(F.lit("seen o"), F.col("id") % 7, F.lit(" by p"), "label", F.lit(" today")))
    return S.related_to(rows, [0, 50, 100, 150], F.lit(AS_OF).cast("timestamp")).select("query_id", "id", "snippet")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Person:' || c_name WHEN 1 THEN 'Org:x;Person:' || c_name ELSE '' END AS keys FROM customer")
def vec_entity_keys(spark, sf_dir):
    entity = lambda value, kind, cls: F.struct(value.alias("value"), F.lit(kind).cast("string").alias("entity_type"), F.lit(cls).cast("string").alias("class"))
    named, k = F.col("c_name"), F.col("c_custkey") % 3
    found = (
        F.when(k == 0, F.array(entity(named, "x", "Person"), entity(named, "y", "Person"))).when(k == 1, F.array(entity(named, "person", None), entity(F.lit("x"), "org", None)))
        .otherwise(F.array(entity(F.lit(" "), "person", "Person"), entity(F.lit("z"), None, None)))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(S.entity_keys(found), ";").alias("keys"))


@query("""
WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label), h AS (SELECT m.label, i, 0.5 * x / n AS x FROM m JOIN n USING (label)), g AS (SELECT label, x, i FROM h WHERE label <> 2),
d AS (SELECT g.label, acosh(1 + 2 * sum((g.x - 0.05) * (g.x - 0.05)) / ((1 - sum(g.x * g.x)) * (1 - 64 * 0.05 * 0.05))) AS d FROM g GROUP BY g.label)
SELECT 's' || label AS id, round(d, 5) AS distance FROM d ORDER BY d, id LIMIT 3
""")
def vec_hyperbolic(spark, sf_dir):
    """The three top-level spaces nearest to a point in the Poincare ball."""
    rows = _rows(spark, sf_dir)
    spaces = P.centroids_of(rows, rows.select("id", F.concat(F.lit("s"), "label").alias("space_id")), 64)
    spaces = spaces.select(F.col("space_id").alias("id"), "centroid", F.when(F.col("space_id") == "s2", 1).otherwise(0).alias("depth"))
    return S.hyperbolic_nearest(spaces, F.array_repeat(F.lit(0.05), 64)).withColumn("distance", F.round("distance", 5))


VOWELS = "aeinrst"


def _letters(text):
    """An embedder that SQL can say: how often some letters occur."""
    return F.array(*[(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in VOWELS])


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)" for c in VOWELS) + "]"


RAG = f"""
WITH d AS (SELECT doc_id AS id, text, {_letters_sql('text')} AS v FROM documents WHERE length(text) > 0), q AS (SELECT item_id AS query_id, {_letters_sql('text')} AS v FROM benchmark),
k AS (SELECT query_id, id, text, q.v AS qv FROM d, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN list_sum(d.v) = 0 OR list_sum(q.v) = 0 THEN 0 ELSE round(list_cosine_similarity(d.v, q.v), 12) END DESC, id) <= 12),
c AS (SELECT *, unnest(range(0, greatest(CAST(ceil((length(text) - 1500) / 1300.0) AS BIGINT) + 1, 1))) AS n FROM k),
s AS (SELECT query_id, id, n, substr(text, n * 1300 + 1, 1500) AS chunk, qv FROM c),
t AS (SELECT query_id, id, n, CASE WHEN list_sum({_letters_sql('chunk')}) = 0 OR list_sum(qv) = 0 THEN 0 ELSE round(list_cosine_similarity({_letters_sql('chunk')}, qv), 12) END AS score FROM s),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, n) <= 5),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, n) AS INTEGER) AS rank FROM b QUALIFY rank <= 15)
"""


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("char_length(text) > 0").select(F.col("doc_id").alias("id"), "text", _letters(F.col("text")).alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _letters(F.col("text")).alias("query_vector"))
    return S.retrieve_chunks(docs, asked, _letters)


@query(RAG + "SELECT query_id, id, CAST(n AS INTEGER) AS chunk_no, rank, round(score, 6) AS score FROM r")
def rag_chunks(spark, sf_dir):
    """Chunks for an answer: the nearest documents, the best chunks of each, the best in all."""
    return _chunks(spark, sf_dir).select("query_id", "id", "chunk_no", "rank", F.round("score", 6).alias("score"))


@query(RAG + "SELECT query_id, round(max(score), 6) AS best, max(score) >= 0.2 AS answerable FROM r GROUP BY 1 UNION ALL SELECT -1, 0.1, FALSE")
def rag_answerable(spark, sf_dir):
    low = spark.createDataFrame([(-1, 0.1)], "query_id long, score double")
    return S.answerable(_chunks(spark, sf_dir).select(F.col("query_id").cast("long").alias("query_id"), "score").union(low)).withColumn("best", F.round("best", 6))


@query("SELECT event_id, round(1.0 / (1 + event_id % 10), 6) AS reward FROM events")
def vec_click_reward(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(S.click_reward(F.col("event_id") % 10), 6).alias("reward"))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 1000)) SELECT event_id AS seq, CAST(i AS INTEGER) AS query_index, CASE WHEN i % 3 = 0 AND i < 300 THEN CAST(i % 20 AS INTEGER) END AS clicked FROM r")
def log_click_by_index(spark, sf_dir):
    searches = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("seq"))
    clicks = spark.range(300).where("id % 3 = 0").select(F.col("id").alias("seq"), F.col("id").cast("int").alias("query_index"), (F.col("id") % 20).cast("int").alias("clicked"))
    clicks = clicks.union(clicks.select(F.lit(-1).cast("long"), "query_index", F.lit(99)))
    return A.click_by_index(searches, clicks).select("seq", "query_index", "clicked")


@query("SELECT count(*) AS fallbacks FROM documents WHERE doc_id % 4 = 1")
def agg_fallbacks(spark, sf_dir):
    return A.fallback_count(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 1, 2.5).otherwise(3.5).alias("entities_version")))


@query("SELECT 'name' AS by, list(doc_id ORDER BY lower(source), doc_id)[1:5]::VARCHAR AS first FROM documents UNION ALL SELECT 'modified', list(doc_id ORDER BY lang DESC, doc_id)[1:5]::VARCHAR FROM documents UNION ALL SELECT 'size', list(doc_id ORDER BY n_chars DESC, doc_id)[1:5]::VARCHAR FROM documents")
def sort_favourites(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("modified_at"), F.col("n_chars").alias("size"))
    rows = [(by, "[" + ", ".join(str(r["doc_id"]) for r in A.ordered_documents(docs, by).limit(5).collect()) + "]") for by in ("name", "modified", "size")]
    return spark.createDataFrame(rows, "by string, first string")


# --- entities ----------------------------------------------------------------------


MENTIONED = "SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 1 THEN upper(p_brand) ELSE lower(p_brand) END AS value, p_type AS canonical_short_name, lower(p_brand) AS canonical_id FROM lineitem JOIN part ON p_partkey = l_partkey"


def _brands(spark, sf_dir):
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    value = F.when(F.col("l_linenumber") == 1, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("doc_id"), value.alias("value"), F.lit("organization").alias("entity_type"), F.col("p_type").alias("canonical_short_name"), F.lower("p_brand").alias("canonical_id"))


@query(f"""
WITH m AS ({MENTIONED}), s AS (SELECT canonical_id, canonical_short_name, count(*) AS n FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY n DESC, canonical_short_name) = 1)
SELECT m.canonical_id, 'organization' AS entity_type, max(value) AS canonical_name, any_value(s.canonical_short_name) AS short_name, count(DISTINCT doc_id) AS documents FROM m JOIN s USING (canonical_id) GROUP BY 1
""")
def ent_store(spark, sf_dir):
    """The store that stored mentions make."""
    return E.store_of(_brands(spark, sf_dir))


@query(f"""
WITH m AS (SELECT doc_id, value, CASE WHEN lower(value) = 'brand#11' THEN 'new' ELSE canonical_id END AS canonical_id FROM ({MENTIONED}))
SELECT canonical_id, count(DISTINCT doc_id) AS documents, max(value) AS canonical_name FROM m GROUP BY 1
""")
def ent_split_store(spark, sf_dir):
    """Names and documents after an alias is split off."""
    return E.store_of(E.split_alias(_brands(spark, sf_dir), "Brand#11", "new")).select("canonical_id", "documents", "canonical_name")


@query(f"SELECT DISTINCT lower(value) AS value, CASE WHEN lower(value) < 'brand#3' THEN 'known-' || lower(value) ELSE sha256('organization' || chr(10) || lower(value)) END AS canonical_id FROM ({MENTIONED})")
def ent_register(spark, sf_dir):
    found = _brands(spark, sf_dir).drop("canonical_id")
    known = found.select(F.lower("value").alias("surface_lc")).distinct().where("surface_lc < 'brand#3'").select("surface_lc", F.lit("organization").alias("type_lc"), F.concat(F.lit("known-"), "surface_lc").alias("canonical_id"))
    return E.register(found, known).select(F.lower("value").alias("value"), "canonical_id").distinct()


@query("""
WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT vec_id + 10000000, label, list_concat([CAST(embedding[1] AS DOUBLE) + 0.1], CAST(embedding[2:] AS DOUBLE[])) FROM embeddings WHERE vec_id % 3 = 0)
SELECT id, CASE WHEN id >= 10000000 AND (id - 10000000) % 2 = 1 THEN id WHEN id < 10000000 AND id % 6 = 3 THEN id + 10000000 WHEN id >= 10000000 THEN id - 10000000 ELSE id END AS canonical_id FROM e
""")
def ent_merge_aliases(spark, sf_dir):
    """Near entities merge into the one with more documents."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("entity_type"))
    moved = F.concat(F.array(F.get("embedding", F.lit(0)) + 0.1), F.slice("embedding", 2, 1 << 20))
    canon = e.union(e.where("id % 3 = 0").select(F.col("id") + 10_000_000, moved, "entity_type"))
    twice = (F.col("id") >= 10_000_000) & (F.col("id") % 2 == 1)
    found = canon.select(F.col("id").alias("canonical_id"), F.explode(F.sequence(F.lit(1), F.when(twice, 3).when(F.col("id") % 2 == 0, 2).otherwise(1))).alias("doc_id"))
    out = E.merge_aliases(canon, found.withColumn("first", F.col("canonical_id")), floor=0.99)
    return out.select(F.col("first").alias("id"), "canonical_id").distinct()


@query("SELECT p_partkey AS canonical_id, CASE WHEN p_partkey = 7 THEN 'Seven' ELSE p_name END AS canonical_name FROM part")
def ent_rename(spark, sf_dir):
    canon = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("canonical_id"), F.col("p_name").alias("canonical_name"))
    return E.rename(canon, "7", "Seven").select(F.col("canonical_id").cast("long").alias("canonical_id"), "canonical_name")


@query(f"SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 500 = 7")
def ent_documents(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pairs = items.select(F.concat(F.lit("p"), F.col("l_partkey") % 500).alias("canonical_id"), F.col("l_orderkey").alias("doc_id"))
    return E.documents_of(pairs, orders.select(F.col("o_orderkey").alias("doc_id")), "p7").select(F.col("doc_id").alias("o_orderkey"))


@query("SELECT o_orderkey AS doc_id, 'c' || o_custkey AS value, 'Person' AS class FROM orders UNION ALL SELECT o_orderkey, o_orderkey || '@x.org', 'Email' FROM orders")
def ent_mentions(spark, sf_dir):
    entity = lambda v, c: F.struct(v.alias("value"), F.lit(c).alias("class"))
    orders = table(spark, sf_dir, "orders")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.array(entity(F.concat(F.lit("c"), "o_custkey"), "Person"), entity(F.concat("o_orderkey", F.lit("@x.org")), "Email")).alias("extracted_entities"))
    return E.mentions(docs)


@query("SELECT o_orderkey AS id, 'c' || o_custkey || ',clerk' AS names FROM orders")
def graph_names(spark, sf_dir):
    entity = lambda v, t: F.struct(v.alias("value"), F.lit(t).alias("entity_type"))
    found = F.array(entity(F.concat(F.lit("C"), "o_custkey"), "Person"), entity(F.lit("Clerk"), "organization"), entity(F.lit("clerk"), "person"), entity(F.lit("x"), "date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(G.names_of(found), ",").alias("names"))


# --- triples and ontology ------------------------------------------------------------


STORE = "subject_id string, predicate string, object_id string, doc_ids array<string>, user_added boolean"


@query("SELECT 'c' || c_custkey AS subject_id, 'owns' AS predicate, 'n' || c_nationkey AS object_id, TRUE AS user_added FROM customer WHERE c_nationkey < 10 UNION ALL SELECT 'n' || c_nationkey, 'owned_by', 'c' || c_custkey, TRUE FROM customer WHERE c_nationkey < 10")
def trp_manual(spark, sf_dir):
    """Manual triples between known entities, with their partners."""
    customer = table(spark, sf_dir, "customer")
    new = customer.select(F.concat(F.lit("c"), "c_custkey").alias("subject_id"), F.lit("owns").alias("predicate"), F.concat(F.lit("n"), "c_nationkey").alias("object_id"), F.array().cast("array<string>").alias("doc_ids"))
    canon = customer.select(F.concat(F.lit("c"), "c_custkey").alias("canonical_id")).union(table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.lit("n"), "n_nationkey")))
    return R.add_manual(spark.createDataFrame([], STORE), new, canon).select("subject_id", "predicate", "object_id", "user_added")


@query("SELECT 'c' || c_custkey AS subject_id, 'located_in' AS predicate, 'n3' AS object_id, CAST(row_number() OVER (ORDER BY 'c' || c_custkey) AS INTEGER) AS place FROM customer WHERE c_nationkey = 3")
def trp_of_entity(spark, sf_dir):
    """The triples of an entity in order."""
    customer = table(spark, sf_dir, "customer")
    store = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("subject_id"), F.lit("located_in").alias("predicate"), F.concat(F.lit("c"), "c_custkey").alias("object_id"))
    rows = R.of_entity(store, F.lit("n3")).collect()  # one entity's page
    return spark.createDataFrame([(r["object_id"], r["predicate"], r["subject_id"], n + 1) for n, r in enumerate(rows)], "subject_id string, predicate string, object_id string, place int")


@query("SELECT l_orderkey AS doc_id, 'e' || l_linenumber % 3 AS subject_id, 'e2' AS object_id FROM lineitem WHERE l_linenumber % 3 <> 1")
def trp_positions(spark, sf_dir):
    """Positional ends as canonical ids; the second entity has none."""
    ids = F.array(*[F.struct(F.lit(v).cast("string").alias("canonical_id")) for v in ("e0", None, "e2")])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).cast("int").alias("s"), F.lit(2).alias("o"))
    return R.resolve_positions(rows, ids).select("doc_id", "subject_id", "object_id")


@query("SELECT l_orderkey AS doc_id, 'likes_' || l_linenumber AS predicate FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3")
def trp_new_predicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("likes_"), "l_linenumber").alias("predicate"), F.col("l_linenumber").alias("position"))
    noise = rows.select("doc_id", F.explode(F.array(F.lit("owns"), F.lit("Bad Name"))).alias("predicate"), F.lit(0).alias("position"))
    vocabulary = spark.createDataFrame([(p,) for p in PREDICATES], "predicate string")
    return R.new_predicates(rows.union(noise.select("doc_id", "predicate", F.col("position").cast(rows.schema["position"].dataType))), vocabulary).select("doc_id", "predicate")


@query("SELECT 'b' || p_size AS name, 'corpus' AS source FROM part GROUP BY p_size")
def ont_bootstrap_rows(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), "p_size").alias("name")).distinct().union(spark.createDataFrame([("owns",)], "name string"))
    return O.bootstrap(names, O.seed(spark)).select("name", "source")


@query("SELECT DISTINCT lower(replace(p_brand, '#', '')) AS name FROM part")
def ont_bootstrap_known(spark, sf_dir):
    """Proposals that are in the vocabulary already take no room."""
    names = table(spark, sf_dir, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("name"), F.col("p_partkey").alias("position"))
    seeds = spark.createDataFrame([(p, -1) for p in PREDICATES], "name string, position long")
    return O.validate_bootstrap(names.union(seeds), O.seed(spark)).select("name")


@query("SELECT DISTINCT 'Person' AS class, lower(replace(p_brand, '#', '')) AS subclass FROM part")
def ont_subclasses(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "Person").otherwise("Alien").alias("class"), F.concat("p_brand", F.lit("!")).alias("subclass"))
    every = rows.where("class = 'Person'").union(rows.where("class = 'Alien'")).union(rows.select(F.lit("Person"), "subclass")).union(rows.select(F.lit("Person"), F.repeat("subclass", F.lit(5))))
    return O.validate_subclasses(every)


@query(f"SELECT event_type AS name, 'adaptive' AS source FROM events WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT 'clicked', 'adaptive' UNION ALL SELECT 'by_hand', 'manual'")
def ont_rename(spark, sf_dir):
    """A renamed predicate and one that is added by hand, once."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("count")).select("name", F.lit("adaptive").alias("source"), "count")
    return O.rename(O.add_manual(O.add_manual(rows, "by_hand"), "by_hand"), "click", "clicked").select("name", "source")


@query("SELECT CASE WHEN event_type = 'click' THEN 'clicked' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'view_even' WHEN event_type = 'view' THEN 'view' ELSE event_type END AS predicate, count(*) AS n FROM events GROUP BY 1")
def ont_consolidate(spark, sf_dir):
    """Triples after a rename and a split of which a reviewer moved half."""
    e = table(spark, sf_dir, "events")
    triples = e.select(F.col("event_id").cast("string").alias("subject_id"), F.col("event_type").alias("predicate"), F.lit("o").alias("object_id"))
    vocabulary = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("count")).select("name", F.lit("adaptive").alias("source"), "count")
    moved = triples.where("predicate = 'view' and cast(subject_id as long) % 2 = 0").withColumn("part", F.lit("view_even"))
    _, out = O.consolidate(vocabulary, triples, {"click": "clicked"}, {}, {"view": ["view_even", "view_odd"]}, moved)
    return out.groupBy("predicate").agg(F.count("*").alias("n"))


@query("SELECT name FROM (SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN ('view', 'click')) UNION ALL SELECT 'clicked' UNION ALL SELECT 'view' UNION ALL SELECT 'view_even' UNION ALL SELECT 'view_odd'")
def ont_consolidated_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    triples = e.select(F.col("event_id").cast("string").alias("subject_id"), F.col("event_type").alias("predicate"), F.lit("o").alias("object_id"))
    vocabulary = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("count")).select("name", F.lit("adaptive").alias("source"), "count")
    names, _ = O.consolidate(vocabulary, triples, {"click": "clicked"}, {}, {"view": ["view_even", "view_odd"]})
    return names.select("name")


@query("SELECT 'reset' AS what, CAST(21 AS BIGINT) AS n UNION ALL SELECT 'without_corpus', 21 + (SELECT count(DISTINCT event_type) FROM events) UNION ALL SELECT 'due', 1")
def ont_reset(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    rows = O.seed(spark).union(e.select("name", F.lit("manual"), F.lit(0).cast("long"))).union(e.select(F.concat("name", F.lit("_c")), F.lit("corpus"), F.lit(0).cast("long")))
    due = [n for n in range(100) if O.bootstrap_due(n, False) and not O.bootstrap_due(n, True)]
    return spark.createDataFrame([("reset", O.reset(rows).count()), ("without_corpus", O.without_corpus(rows).count()), ("due", len(due))], "what string, n long")


# --- spaces ----------------------------------------------------------------------------


def _spaces(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    spaces = nation.select(F.concat(F.lit("s"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2).alias("depth"), F.col("n_regionkey").alias("updated_at"), (F.col("n_nationkey") * 7 % 11).cast("long").alias("document_count"))
    cache = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("s"), "n_nationkey").alias("space_id"), F.concat(F.lit("L"), "n_nationkey").alias("label"), (F.col("n_nationkey") % 2 == 0).alias("user_locked"))
    return spaces, cache


@query("SELECT 's' || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'L' || n_nationkey ELSE n_name END AS name, n_nationkey % 6 = 0 AS user_locked FROM nation WHERE n_nationkey % 2 = 0")
def space_lookup(spark, sf_dir):
    """Top-level spaces with their labels."""
    spaces, cache = _spaces(spark, sf_dir)
    return P.labelled(P.top_level(spaces), cache).select("id", "name", "user_locked")


@query("""
WITH c AS (SELECT 's' || n_nationkey AS space_id, 'L' || n_nationkey AS label, n_nationkey % 2 = 0 AS locked FROM nation WHERE n_nationkey % 3 = 0)
SELECT 'set' AS step, space_id, CASE WHEN space_id = 's3' THEN 'Mine' ELSE label END AS label, CASE WHEN space_id = 's3' THEN TRUE ELSE locked END AS locked FROM c
UNION ALL SELECT 'drop', space_id, label, locked FROM c WHERE space_id <> 's6' UNION ALL SELECT 'unlock', space_id, label, locked AND space_id <> 's6' FROM c UNION ALL SELECT 'relabel', space_id, label, locked FROM c WHERE locked
""")
def space_label_cache(spark, sf_dir):
    """The label cache after a rename, a removal, a lock that is cleared, and before all labels are made anew."""
    _, cache = _spaces(spark, sf_dir)
    steps = {"set": P.set_label(cache, "s3", "Mine", True), "drop": P.set_label(cache, "s6", None, False), "unlock": P.clear_lock(cache, "s6"), "relabel": P.relabel(cache)}
    out = None
    for step, rows in steps.items():
        part = rows.select(F.lit(step).alias("step"), "space_id", "label", F.col("user_locked").alias("locked"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 4 OR doc_id % 13 = 2")
def space_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    members = docs.where("doc_id % 9 = 4").union(docs.where("doc_id % 13 = 2")).select(F.col("doc_id").alias("id"), F.lit("a").alias("space_id")).union(docs.select("doc_id", F.lit("b")))
    return P.space_documents(members, docs, "a").select("doc_id")


@query("""
SELECT 's' || doc_id % 9 AS space_id, count(*) AS documents, array_to_string(list(DISTINCT lang ORDER BY lang), ',') AS doc_types, min(n_chars) AS first_at, max(n_chars) AS last_at FROM documents GROUP BY 1
""")
def space_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    members = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("s"), F.col("doc_id") % 9).alias("space_id"))
    out = P.cluster_metadata(members, docs.select("doc_id", F.col("lang").alias("doc_type"), F.col("n_chars").alias("modified_at")))
    return out.withColumn("doc_types", F.array_join("doc_types", ","))


@query("SELECT 's' || doc_id % 9 AS space_id, source AS value, count(*) AS n FROM documents GROUP BY ALL")
def space_value_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    members = docs.select(F.concat(F.lit("s"), F.col("doc_id") % 9).alias("space_id"), F.col("doc_id").alias("id"))
    found = docs.select("doc_id", F.col("source").alias("value"))
    return P.entity_value_counts(members, found.union(found))


@query("SELECT 'spaces_of' AS what, CAST(10 % 9 AS VARCHAR) AS value UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT doc_id % 9 FROM documents) UNION ALL SELECT 'largest', CAST(max(n) AS VARCHAR) FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id % 9)")
def space_accessors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    members = docs.select((F.col("doc_id") % 9).cast("string").alias("space_id"), F.col("doc_id").alias("id"))
    counts = P.space_counts(members)
    parts = (
        P.spaces_of(members, 10).select(F.lit("spaces_of").alias("what"), F.col("space_id").alias("value")), counts.agg(F.count("*").cast("string").alias("value")).select(F.lit("count"), "value"),
        counts.agg(F.max("document_count").cast("string").alias("value")).select(F.lit("largest"), "value"),
    )
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT 's' || n_nationkey AS id, CAST(CASE WHEN n_nationkey = 5 THEN n_nationkey * 7 % 11 + 1 WHEN n_nationkey IN (0, 1) THEN greatest(n_nationkey * 7 % 11 - 1, 0) ELSE n_nationkey * 7 % 11 END AS BIGINT) AS document_count FROM nation")
def space_counts_after_move(spark, sf_dir):
    spaces, _ = _spaces(spark, sf_dir)
    members = spark.createDataFrame([(7, "s0"), (7, "s1"), (8, "s2")], "id long, space_id string")
    return P.counts_after_move(spaces, members, 7, "s5").select("id", "document_count")


@query("""
WITH s AS (SELECT 's' || n_nationkey AS id, n_name AS name, n_regionkey AS u, n_nationkey * 7 % 11 AS c FROM nation)
SELECT 'name' AS by, array_to_string(list(id ORDER BY lower(name), id)[1:10], ',') AS ids FROM s UNION ALL SELECT 'updated', array_to_string(list(id ORDER BY u DESC, id)[1:10], ',') FROM s UNION ALL SELECT 'count', array_to_string(list(id ORDER BY c DESC, id)[1:10], ',') FROM s
""")
def space_orders(spark, sf_dir):
    """The first ten spaces by name, time and count."""
    spaces, _ = _spaces(spark, sf_dir)
    tops = {by: [r["id"] for r in P.ordered_spaces(spaces, by).limit(10).collect()] for by in ("name", "updated")} | {"count": [r["id"] for r in P.largest_spaces(spaces).collect()]}
    return spark.createDataFrame([(by, ",".join(ids)) for by, ids in tops.items()], "by string, ids string")


@query("SELECT array_to_string(list(n ORDER BY misc, c DESC, n), ',') AS subs FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'p-misc' ELSE 'p-sub-' || doc_id % 5 END AS n, doc_id % 5 = 0 AS misc, count(*) AS c FROM documents GROUP BY 1, 2)")
def space_sub_order(spark, sf_dir):
    k = F.col("doc_id") % 5
    subs = table(spark, sf_dir, "documents").groupBy(F.when(k == 0, "p-misc").otherwise(F.concat(F.lit("p-sub-"), k)).alias("sub_id")).agg(F.count("*").alias("document_count"))
    return spark.createDataFrame([(",".join(r["sub_id"] for r in P.ordered_subs(subs).collect()),)], "subs string")


@query("SELECT source, CASE WHEN n <= 1 THEN 1 ELSE CAST(least(20, greatest(2, floor(sqrt(n / 2.0) + 0.5))) AS INTEGER) END AS k, CAST(greatest(2, floor(sqrt(n / 2.0))) AS INTEGER) AS sub_k FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def space_auto_k(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").count().collect()  # one row a source
    return spark.createDataFrame([(r["source"], P.auto_k(r["count"]), P.auto_k(r["count"], True)) for r in counts], "source string, k int, sub_k int")


def _seeded(score: str) -> str:
    """SQL of three seeds by a score of the next one, and one round of means, over unit vectors."""
    return f"""
WITH u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s0 AS (SELECT v FROM u ORDER BY id LIMIT 1),
s1 AS (SELECT u.v FROM u, s0 ORDER BY round(1 - list_cosine_similarity(u.v, s0.v), 12) DESC, id LIMIT 1),
s2 AS (SELECT u.v FROM u, s0, s1 ORDER BY round(1 - {score}(list_cosine_similarity(u.v, s0.v), list_cosine_similarity(u.v, s1.v)), 12) DESC, id LIMIT 1),
c AS (SELECT 0 AS k, v FROM s0 UNION ALL SELECT 1, v FROM s1 UNION ALL SELECT 2, v FROM s2),
a AS (SELECT id, u.v, k FROM u, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(u.v, c.v), 12) DESC, k) = 1),
x AS (SELECT k, unnest(list_transform(v, lambda y: y / sqrt(list_inner_product(v, v)))) AS y, unnest(range(len(v))) AS i FROM a), m AS (SELECT k, i, avg(y) AS y FROM x GROUP BY ALL), n AS (SELECT k, list(y ORDER BY i) AS v FROM m GROUP BY k UNION ALL SELECT k, v FROM c WHERE k NOT IN (SELECT k FROM m))
SELECT id, 'space-' || k AS space_id FROM u, n QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(u.v, n.v), 12) DESC, k) = 1
"""


@query(_seeded("greatest"))
def space_kmeans_round(spark, sf_dir):
    """Farthest-first seeds and one round, row by row."""
    return P.kmeans(_rows(spark, sf_dir).select("id", "embedding"), 3, "farthest_first", rounds=1)


@query(_seeded("least"))
def space_kmeans_literal(spark, sf_dir):
    """The literal seeding and one round, row by row."""
    return P.kmeans(_rows(spark, sf_dir).select("id", "embedding"), 3, "reference", rounds=1)


@query("SELECT 'space-' || label AS space_id, count(*) AS n, TRUE AS numbered, TRUE AS large_enough FROM embeddings GROUP BY label HAVING count(*) > 10")
def space_sub_invariants(spark, sf_dir):
    """Every document of a large parent is in one sub-space; these are numbered from 0 and hold three documents at least."""
    rows = _rows(spark, sf_dir)
    subs = P.sub_spaces(rows, rows.select("id", F.concat(F.lit("space-"), "label").alias("space_id")), least_docs=10)
    sizes = subs.groupBy("space_id", "sub_id").agg(F.count("*").alias("n"))
    number = F.when(~F.col("sub_id").endswith("-misc"), F.substring_index("sub_id", "-", -1).cast("int"))
    return sizes.groupBy("space_id").agg(
        F.sum("n").alias("n"), (F.coalesce(F.max(number), F.lit(-1)) + 1 == F.count(number)).alias("numbered"),
        F.coalesce(F.min(F.when(number.isNotNull(), F.col("n"))) >= 3, F.lit(True)).alias("large_enough"),
    )


@query("SELECT conv_id AS a, 1.0::DOUBLE AS inside, 1.0::DOUBLE AS nothing FROM conversations GROUP BY 1")
def vec_softmax_total(spark, sf_dir):
    """Attention over a group sums up to one, with large logits as well."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("a"), (F.col("turn") * 1000.0).alias("logit"))
    out = V.softmax_over(rows, "logit", ["a"], "w")
    return out.groupBy("a").agg(F.round(F.sum("w"), 9).alias("inside"), F.lit(1.0).alias("nothing"))
