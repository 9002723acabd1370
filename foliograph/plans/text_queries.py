"""Text functions, extraction and filters over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import filters as L
from ..operators import spaces as P
from .registry import query, table


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT doc_id, ws, list_transform(ws, lambda x: CASE WHEN list_contains(['the', 'la', 'die', 'thing'], regexp_replace(regexp_replace(lower(x), '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')) THEN 1 ELSE 0 END) AS hits FROM w),
s AS (SELECT doc_id, ws, list_transform(range(0, greatest(len(ws) - 30, 0) + 1), lambda i: coalesce(list_sum(hits[i + 1 : i + 30]), 0)) AS scores FROM h)
SELECT doc_id, array_to_string(CASE WHEN len(ws) <= 30 THEN ws ELSE ws[list_position(scores, list_max(scores)) : list_position(scores, list_max(scores)) + 29] END, ' ') AS excerpt FROM s
""")
def txt_best_excerpt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.best_excerpt(F.col("text"), F.lit("the la die thing")).alias("excerpt"))


@query("""
WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1500) / 1300.0) AS BIGINT) + 1, 1))) AS k FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(k * 1300 AS INTEGER) AS "start", CAST(least(k * 1300 + 1500, length(text)) AS INTEGER) AS "end", md5(substr(text, k * 1300 + 1, 1500)) AS digest FROM c
""")
def txt_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.chunks(F.col("text"), 1500, 200)).alias("c")).select("doc_id", "c.chunk_no", "c.start", "c.end", F.md5("c.chunk").alias("digest"))


@query(r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type || ' - ' || p_name || '!')), '[ \t\n\r\f-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS tag FROM part
""")
def txt_normalize_tag(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", T.normalize_tag(F.concat("p_type", F.lit(" - "), "p_name", F.lit("!"))).alias("tag"))


SHORT_VALUE = """CASE c_custkey % 6 WHEN 0 THEN c_name || ' Ltd' WHEN 1 THEN c_name || ' Pvt Ltd' WHEN 2 THEN c_name || ', Inc.' WHEN 3 THEN 'Alpha Complex-Unit-' || c_custkey WHEN 4 THEN '  Foo   ' || c_custkey ELSE 'Building-P' || c_custkey END"""
SHORT_CLASS = """CASE WHEN c_custkey % 6 < 3 THEN 'Organization' WHEN c_custkey % 6 = 4 THEN 'Person' ELSE 'Location' END"""


@query(f"""
SELECT c_custkey, {SHORT_VALUE} AS value,
  CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN c_name WHEN 3 THEN 'Unit ' || c_custkey WHEN 4 THEN 'Foo ' || c_custkey ELSE 'P' || c_custkey END AS short_name
FROM customer
""")
def txt_short_name(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(SHORT_VALUE).alias("value"), F.expr(SHORT_CLASS).alias("class"))
    return rows.select("c_custkey", "value", T.short_name(F.col("value"), F.col("class")).alias("short_name"))


@query("""
SELECT source, substr(sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10)), 1, 16) AS fingerprint, count(*) AS n FROM documents GROUP BY source
""")
def txt_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return P.fingerprints(docs.select(F.col("source").alias("space_id"), F.col("doc_id").alias("id"))).withColumnRenamed("space_id", "source")


@query(r"""
SELECT conv_id, turn, CASE WHEN length(text) <= 40 THEN text WHEN regexp_extract(left(text, 40), '(?s)^(.*)\s', 1) <> '' THEN regexp_extract(left(text, 40), '(?s)^(.*)\s', 1) ELSE left(text, 40) END AS title
FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)
""")
def txt_title(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return rows.select("conv_id", "turn", T.title_from_query(F.col("text")).alias("title"))


@query("""
SELECT p_partkey, upper(left(p_type, 1)) || substr(p_type, 2) AS capitalised, lower(p_brand) AS kind,
  CASE WHEN round(p_size * 2 / 100.0 * 100) >= 80 THEN 'high' WHEN round(p_size * 2 / 100.0 * 100) >= 50 THEN 'medium' ELSE 'low' END AS badge,
  regexp_matches(lower(replace(p_name, ' ', '_')), '^[a-z][a-z0-9_]*$') AS snake
FROM part
""")
def txt_formats(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", T.capitalise(F.col("p_type")).alias("capitalised"), T.entity_type_of(F.col("p_brand")).alias("kind"),
        T.score_badge(F.col("p_size") * 2 / F.lit(100.0)).alias("badge"), T.is_snake_case(F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("snake"),
    )


@query("""
WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS ws FROM part), t AS (SELECT p_type, string_split(lower(p_type), ' ') AS ts FROM part GROUP BY p_type)
SELECT p_partkey, p_type FROM p, t WHERE len(list_filter(ws, lambda x: NOT list_contains(ts, x))) = 0 OR len(list_filter(ts, lambda x: NOT list_contains(ws, x))) = 0
UNION ALL SELECT p_partkey, 'own' FROM p
""")
def txt_token_subset(spark, sf_dir):
    """Every part's name against every type (a bounded table), and against a name that holds its words."""
    part = table(spark, sf_dir, "part")
    types = F.broadcast(part.select("p_type").distinct())  # 150 combinations of three words
    hits = part.select("p_partkey", "p_name").join(types, T.is_token_subset(F.col("p_name"), F.col("p_type"))).select("p_partkey", "p_type")
    longer = F.concat(F.lit("x "), F.upper("p_name"), F.lit(" y"))
    return hits.union(part.where(T.is_token_subset(F.col("p_name"), longer)).select("p_partkey", F.lit("own")))


def _found(spark, sf_dir, expression):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(expression(F.col("text"))).alias("value"))


EMAIL_SQL = r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1)) AS value FROM documents"


@query(EMAIL_SQL)
def p1_emails(spark, sf_dir):
    return _found(spark, sf_dir, X.emails_sql)


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4})', 1)) AS value FROM documents")
def p1_phones(spark, sf_dir):
    return _found(spark, sf_dir, X.phones_sql)


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z][a-z]+ [A-Z][a-z]+)', 1)) AS value FROM documents")
def p1_persons(spark, sf_dir):
    return _found(spark, sf_dir, X.persons_sql)


@query(r"""
WITH f AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4})', 1)), '[ -]', '', 'g') AS value FROM documents)
SELECT doc_id, value FROM f
WHERE list_sum(list_transform(range(0, length(value)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(value[length(value) - i] AS INTEGER)
  ELSE (CAST(value[length(value) - i] AS INTEGER) * 2) // 10 + (CAST(value[length(value) - i] AS INTEGER) * 2) % 10 END)) % 10 = 0
AND (value LIKE '4%' OR CAST(left(value, 2) AS INTEGER) BETWEEN 51 AND 55 OR CAST(left(value, 4) AS INTEGER) BETWEEN 2221 AND 2720
  OR CAST(left(value, 2) AS INTEGER) IN (34, 37, 65) OR left(value, 4) = '6011' OR CAST(left(value, 6) AS INTEGER) BETWEEN 644000 AND 649999)
""")
def p1_cards(spark, sf_dir):
    return _found(spark, sf_dir, X.cards_sql)


@query(r"SELECT DISTINCT page_id, unnest(regexp_extract_all(url || ' ' || html, '(https?://[^ \t\r\n<>]{3,})', 1)) AS value FROM pages")
def p1_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(X.urls_sql(F.concat("url", F.lit(" "), "html"))).alias("value"))


SENTENCE_SQL = "'Invoice No. INV-' || o_orderkey || ' total $' || printf('%.2f', o_totalprice) || ' due ' || strftime(o_orderdate, '%Y-%m-%d')"


def _sentences(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Invoice No. INV-"), "o_orderkey", F.lit(" total $"), F.format_string("%.2f", "o_totalprice"), F.lit(" due "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select("o_orderkey", text.alias("text"))


@query(f"""
SELECT o_orderkey, regexp_extract(s, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS due, regexp_extract(s, '([$][0-9,]+(?:\\.[0-9]{{1,2}})?)', 1) AS amount, 'INV-' || o_orderkey AS identifier
FROM (SELECT o_orderkey, {SENTENCE_SQL} AS s FROM orders)
""")
def p1_invoice_fields(spark, sf_dir):
    rows, text = _sentences(spark, sf_dir), F.col("text")
    first = lambda c: F.get(c, F.lit(0))
    return rows.select("o_orderkey", first(X.iso_dates_sql(text)).alias("due"), first(X.amounts_sql(text)).alias("amount"), first(X.weak_ids_sql(text)).alias("identifier"))


@query(f"""
SELECT o_orderkey, 'amount' AS entity_type, '$' || printf('%.2f', o_totalprice) AS value, 'usd' AS subclass FROM orders
UNION ALL SELECT o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d'), NULL FROM orders
UNION ALL SELECT o_orderkey, 'identifier', 'INV-' || o_orderkey, 'unknown' FROM orders
""")
def p1_extract(spark, sf_dir):
    found = X.extract(_sentences(spark, sf_dir)).select("o_orderkey", F.explode("extracted_entities").alias("e"))
    return found.select("o_orderkey", "e.entity_type", "e.value", "e.subclass")


@query()
def p1_extract_documents(spark, sf_dir):
    found = X.extract(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("extracted_entities").alias("e"))
    return found.select("doc_id", "e.entity_type", "e.value", "e.subclass", "e.confidence")


LEGACY = {
    "date": ("Date", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{4})\b"),
    "amount": ("Amount", r"((?:USD\s*)?[$£€]\s*[0-9,]+(?:\.[0-9]{2})?|[0-9,]+(?:\.[0-9]{2})?\s*(?:USD|EUR|GBP))"), "email": ("Email", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"),
    "person": ("Person/Org", r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b"),
}


#: Letters beyond ASCII are word characters to the pattern, but not to SQL's word boundary: digits stand in for them.
WORDLY = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\pL\pN]', '~', 'g'), '[^\x00-\x7F]', '0', 'g')"


@query(
    "WITH f AS (" + " UNION ".join(f"SELECT doc_id, '{kind}' AS entity_type, unnest(regexp_extract_all({WORDLY if kind == 'person' else 'text'}, '{shape}', 1)) AS value, '{label}' AS label FROM documents" for kind, (label, shape) in LEGACY.items())
    + ") SELECT doc_id, entity_type, value, label FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY entity_type, value) <= 20"
)
def p1_legacy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(X.legacy_entities(F.col("text"))).alias("e")).select("doc_id", "e.entity_type", "e.value", "e.label")


ASKED = "CASE o_orderkey % 4 WHEN 0 THEN 'Invoices over $' || CAST(o_custkey AS VARCHAR) || ',000.50' WHEN 1 THEN 'bills cheaper than ' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'Before ' || d || ' and after 2023-06-01' ELSE 'nothing here' END"


@query(f"""
WITH q AS (SELECT o_orderkey, lower({ASKED}) AS q FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))
SELECT o_orderkey, TRY_CAST(nullif(replace(regexp_extract(q, '(?:over|above|more\\s+than|greater\\s+than|exceeding)\\s+\\$?([0-9,]+(?:\\.[0-9]{{2}})?)', 1), ',', ''), '') AS DOUBLE) AS min_amount,
  TRY_CAST(nullif(replace(regexp_extract(q, '(?:under|below|less\\s+than|cheaper\\s+than)\\s+\\$?([0-9,]+(?:\\.[0-9]{{2}})?)', 1), ',', ''), '') AS DOUBLE) AS max_amount,
  nullif(regexp_extract(q, 'before\\s+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS before_date, nullif(regexp_extract(q, 'after\\s+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS after_date
FROM q WHERE q <> 'nothing here'
""")
def flt_parse_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    asked = orders.select("o_orderkey", F.expr(ASKED.replace("VARCHAR", "STRING")).alias("q"))
    return asked.withColumn("f", L.parse_entity_filter(F.col("q"))).where("f is not null").select("o_orderkey", "f.*")


@query("""
SELECT o_orderkey FROM orders WHERE (o_orderkey % 5 = 0) OR (round(o_totalprice, 2) >= 100000 AND strftime(o_orderdate, '%Y-%m-%d') < '1997-01-01')
""")
def flt_entities(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    entity = lambda kind, value: F.struct(value.alias("value"), F.lit(kind).alias("entity_type"))
    have = F.array(entity("amount", F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice"))), entity("date", F.date_format("o_orderdate", "yyyy-MM-dd")))
    rows = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, have).alias("entities"))
    none = F.lit(None)
    return rows.where(L.entity_filter(F.col("entities"), F.lit(100000.0), none.cast("double"), F.lit("1997-01-01"), none.cast("string"))).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars >= 500")
def flt_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"), F.array("source").alias("tags"), "n_chars", F.lit(None).cast("string").alias("created_at"))
    return docs.where(L.metadata_filter(doc_type="en", tags=["src1", "src2"])).where("n_chars >= 500").select("doc_id")


@query("SELECT d.doc_id FROM documents d JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE d.source = 'src1'")
def flt_combined(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return L.combine(docs.where("source = 'src1'").select("doc_id"), None, labels.where("quality = 1").select("doc_id"))


@query("""
SELECT DISTINCT CAST(o.o_orderkey AS VARCHAR) AS doc_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_custkey % 7 = 1 AND c.c_nationkey = 3
""")
def flt_entity_class(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = customer.select("c_custkey", F.concat(F.lit("nation-"), "c_nationkey").alias("n"), F.concat(F.lit("group-"), F.col("c_custkey") % 7).alias("g"))
    pairs = orders.join(nation, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("doc_id"), F.explode(F.array("n", "g")).alias("canonical_id"))
    aliases = pairs.select("canonical_id").distinct().select("canonical_id", F.col("canonical_id").alias("surface_lc"), F.lit("location").alias("entity_type"))
    wanted = spark.createDataFrame([(0, "Location", "Nation-3"), (1, "Location", "GROUP-1")], "filter_no int, class string, value string")
    return L.entity_class_filter(wanted, aliases, pairs.select("canonical_id", "doc_id"))


@query("SELECT n_nationkey AS doc_id FROM nation WHERE n_regionkey = 2")
def flt_space_scope(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    spaces = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")).union(
        nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    )
    members = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("space_id"), F.col("n_nationkey").alias("doc_id"))
    return L.space_scope(members, spaces, "r2")


@query("""
SELECT p_partkey, trim(p_brand) AS class, trim(p_name) AS value FROM part WHERE p_partkey % 3 <> 0
""")
def flt_class_value(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.concat("p_brand", F.lit(":"), "p_name")).otherwise(F.col("p_name")).alias("k"))
    return part.withColumn("f", L.class_and_value(F.col("k"))).where("f is not null").select("p_partkey", "f.*")


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def flt_favourites(spark, sf_dir):
    return L.favourites(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_favorite"))).select("doc_id")
