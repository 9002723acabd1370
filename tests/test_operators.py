"""Invariants that SQL does not hold: clustering, stores, ingest, streams, edge cases."""

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliograph.operators import analytics as A
from foliograph.operators import entities as E
from foliograph.operators import ontology as O
from foliograph.operators import passes as M
from foliograph.operators import search as S
from foliograph.operators import spaces as P
from foliograph.operators import stores as ST
from foliograph.operators import triples as R
from foliograph.operators.components import connected
from foliograph.sources import ingest as I
from foliograph.streaming import streams


def test_kmeans_separates(spark):
    rows = [(0, [0.9, 0.1, 0.0]), (1, [0.85, 0.15, 0.0]), (2, [0.95, 0.05, 0.0]), (3, [0.1, 0.9, 0.0]), (4, [0.15, 0.85, 0.0]), (5, [0.05, 0.95, 0.0])]
    for init in ("reference", "farthest_first"):
        got = {r["id"]: r["space_id"] for r in P.kmeans(spark.createDataFrame(rows, "id long, embedding array<double>"), 2, init).collect()}
        assert got[0] == got[1] == got[2] != got[3] == got[4] == got[5]


@pytest.mark.parametrize("n, k", [(1, 1), (2, 2), (4, 2), (50, 5), (100, 7), (1000, 20)])
def test_auto_k(n, k):
    assert P.auto_k(n) == k


def test_post_filter_keeps_fewer(spark):
    rows = spark.range(60).select("id", F.array(F.lit(1.0), F.col("id") / 100).alias("embedding"), F.current_timestamp().alias("created_at"))
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert 0 < S.search(rows, asked, F.current_timestamp(), keep=F.col("id") % 2 == 0).count() < 20


def test_components(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected(chain).collect()}
    assert all(roots[n] == 0 for n in range(41)) and roots[101] == 100


def test_triples(spark):
    row = "subject_id string, predicate string, object_id string, doc_ids array<string>, user_added boolean"
    new = spark.createDataFrame([("a", "owns", "b", ["d1"], False), ("a", "married_to", "c", ["d1"], False), ("a", "owns", "a", ["d1"], False), ("a", "eats", "b", ["d1"], False)], row)
    store = R.upsert(new.limit(0), new)
    assert {(r[0], r[1], r[2]) for r in store.collect()} == {("a", "owns", "b"), ("b", "owned_by", "a"), ("a", "married_to", "c"), ("c", "married_to", "a")}
    again = spark.createDataFrame([("a", "owns", "b", ["d2"], False)], row)
    docs = lambda s: next(r["doc_ids"] for r in s.collect() if r["predicate"] == "owns")
    assert docs(R.upsert(store, again)) == ["d1", "d2"] and docs(R.upsert(store, again, strict_reference=True)) == ["d2"]
    kept = R.add_manual(store, again, spark.createDataFrame([("a",), ("b",)], "canonical_id string"))
    assert {r["predicate"] for r in R.cleanup_document(R.cleanup_document(kept, F.lit("d1")), F.lit("d2")).collect()} == {"owns", "owned_by"}
    assert R.delete(store, new.where("predicate = 'owns' and object_id = 'b'")).count() == 2


@pytest.mark.parametrize("args, kind", [
    (("Location", None, "property", "x"), "Property"), (("location", None, "vehicle", "x"), "Vehicle"), (("Organization", None, "business", "x"), "Business"),
    (("Person", None, "insurance", "x"), "Investment"), (("Identifier", "iban", None, "x"), "Financial"), (("Location", None, None, "Credit card"), "Vehicle"), (("Person", None, None, "x"), "Other"),
])
def test_asset_type(spark, args, kind):
    assert spark.range(1).select(R.asset_type(*[F.lit(a).cast("string") for a in args])).first()[0] == kind


def test_ontology(spark):
    seed = O.seed(spark)
    seen = spark.createDataFrame([("likes", "d1", 0), ("likes", "d2", 1), ("hates", "d1", 2), ("hates", "d1", 3), ("owns", "d1", 4), ("Bad Name", "d1", 5)], "name string, doc_id string, seq long")
    assert {(r["name"], r["status"]) for r in O.observe(seen, seed).collect()} == {("likes", "promoted"), ("hates", "pending")}
    assert {r["status"] for r in O.observe(seen, seed, distinct_docs=False).collect()} == {"promoted"}
    with pytest.raises(ValueError):
        O.rename(seed, "owns", "has")
    more = O.add_manual(seed, "likes")
    vocabulary, triples = O.consolidate(more, spark.createDataFrame([("likes",), ("owns",)], "predicate string"), {"likes": "adores"}, {})
    assert "adores" in {r["name"] for r in vocabulary.collect()} and {r[0] for r in triples.collect()} == {"adores", "owns"}
    assert O.reset(more).count() == 21


def test_stores(spark):
    with pytest.raises(ValueError):
        A.page(spark.range(3).select(F.col("id").alias("doc_id")), -1)
    ids = spark.range(25).select(F.col("id").alias("doc_id"))
    assert [A.page(ids, n).count() for n in range(3)] == [20, 5, 0]
    saved = spark.createDataFrame([("a", ["Person:x"]), ("b", ["bad"]), ("", None)], "name string, entities array<string>")
    assert [r["name"] for r in ST.valid_saved_search(saved).collect()] == ["a"]


def test_no_model_keeps_patterns(spark):
    M.register_llm(None)
    assert M.ask(spark.createDataFrame([("p",)], "prompt string")).first()["reply"] is None
    M.register_llm(lambda prompts: [p.upper() for p in prompts])
    assert M.ask(spark.createDataFrame([("p",)], "prompt string")).first()["reply"] == "P"
    M.register_llm(None)


def test_resolve_empty(spark):
    canon = spark.createDataFrame([], "id long, name string, entity_type string")
    assert E.resolve(canon).count() == 0


def test_ingest_is_incremental(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Paid $5.00 on 2024-01-15")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:document>')
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe\xff")
    schema = "doc_id string, title string, path string, doc_type string, size long, modified_at string, excerpt string, text string, content_hash string, entities_version double"
    files = I.discover(spark, str(tmp_path)).where(I.accepted(F.col("path")))
    parsed = I.parse(files)
    assert {r["title"]: r["error"] is None for r in parsed.collect()} == {"a.txt": True, "c.docx": True, "d.pdf": False, "e.txt": False}
    first = I.index(parsed, spark.createDataFrame([], schema))
    rows = {r["title"]: r for r in first.collect()}
    assert set(rows) == {"a.txt", "c.docx"} and rows["c.docx"]["text"] == "Hello"
    assert {e["value"] for e in rows["a.txt"]["extracted_entities"]} == {"$5.00", "2024-01-15"}
    known = spark.createDataFrame(first.drop("old_id").collect(), first.drop("old_id").schema)
    assert I.index(I.parse(files), known).count() == 0
    (tmp_path / "a.txt").write_text("changed")
    fresh = I.index(I.parse(I.discover(spark, str(tmp_path)).where(I.accepted(F.col("path")))), known)
    assert [r["old_id"] for r in fresh.collect()] == [rows["a.txt"]["doc_id"]]
    assert I.apply_index(known, fresh).count() == 2


def test_index_stream(spark, tmp_path):
    inbox, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello world")
    schema = I.index(I.parse(I.discover(spark, inbox)), spark.createDataFrame([], "path string, content_hash string, doc_id string")).drop("old_id").schema.simpleString()
    from pyspark.sql.types import _parse_datatype_string

    ddl = _parse_datatype_string(schema)
    streams.index_stream(streams.watch(spark, inbox), table, ddl, check).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("second")
    streams.index_stream(streams.watch(spark, inbox), table, ddl, check).awaitTermination()
    (tmp_path / "in" / "c.txt").write_text("hello world")
    (tmp_path / "in" / "a2.txt").write_text("other")
    streams.index_stream(streams.watch(spark, inbox), table, ddl, check).awaitTermination()
    assert {r["title"] for r in streams.read_index(spark, table, ddl).collect()} == {"a.txt", "b.txt", "c.txt", "a2.txt"}
    assert spark.read.parquet(f"{table}/rows/batch=1").count() == 1  # a batch writes what it brings
    streams.compact_index(spark, table, ddl, str(tmp_path / "compact"))
    assert streams.read_index(spark, str(tmp_path / "compact"), ddl).count() == 4


def test_replaced_files_and_repeated_batches(spark, tmp_path):
    """A changed file replaces its row; a batch that runs again writes the same; a file that changes back is there once."""
    known = "path string, content_hash string, doc_id string"
    files = lambda *rows: spark.createDataFrame([(p, None, len(c), c.encode()) for p, c in rows], I.FILE_SCHEMA)
    ddl = I.index(I.parse(files(("/a.txt", "x"))), spark.createDataFrame([], known)).drop("old_id").schema
    table = str(tmp_path / "index")

    def batch(number, *rows):
        fresh = I.index(I.parse(files(*rows)), streams.read_index(spark, table, ddl, number))
        fresh = streams.materialise(fresh, "fresh")
        I.save_table(fresh.drop("old_id"), f"{table}/rows/batch={number}")
        I.save_table(fresh.where("old_id is not null").select(F.col("old_id").alias("doc_id")), f"{table}/gone/batch={number}")

    batch(0, ("/a.txt", "one"), ("/b.txt", "two"))
    batch(1, ("/a.txt", "changed"))
    batch(1, ("/a.txt", "changed"))
    assert sorted((r.path, r.text) for r in streams.read_index(spark, table, ddl).collect()) == [("/a.txt", "changed"), ("/b.txt", "two")]
    batch(2, ("/a.txt", "one"))
    batch(3, ("/b.txt", "two"))
    assert sorted((r.path, r.text) for r in streams.read_index(spark, table, ddl).collect()) == [("/a.txt", "one"), ("/b.txt", "two")]


def test_a_table_that_cannot_be_read_is_an_error(spark, tmp_path):
    schema = "doc_id string"
    assert I.load_table(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"PAR1 no parquet file at all PAR1")
    with pytest.raises(Exception, match="(?i)parquet|footer|corrupt|read"):
        I.load_table(spark, str(tmp_path / "broken"), schema).collect()
    from foliograph.functions import settings

    (tmp_path / "settings").mkdir()
    (tmp_path / "settings" / "part-0.txt").write_text("no json")
    with pytest.raises(ValueError):
        settings.read(spark, str(tmp_path / "settings"))


def test_debounce_keeps_the_last_event(spark, tmp_path):
    schema = "path string, ts timestamp, n int"
    at = lambda ms: datetime.fromtimestamp(1_700_000_000 + ms / 1000)
    rows = [("a", at(0), 1), ("a", at(100), 2), ("a", at(250), 3), ("a", at(2000), 4), ("b", at(50), 5), ("z", at(60_000), 6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    out = streams.drain(streams.debounced(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r["path"], r["n"]) for r in out.collect()) == [("a", 3), ("a", 4), ("b", 5)]


BACKFILLED = "doc_id long, text string, extracted_entities array<struct<label:string,value:string,entity_type:string,canonical_id:string,class:string,subclass:string,canonical_short_name:string,confidence:float>>, entities_version double"


def test_backfill_survives_a_failing_document(spark, monkeypatch):
    from foliograph.operators import extract

    docs = spark.createDataFrame([(1, "a@b.org", None, None), (2, "c@d.org", [], 2.0), (3, "e@f.org", [], 3.5)], BACKFILLED)
    real = extract.extract

    def failing(rows, **settings):
        """Extraction that fails on the second document."""
        out = real(rows, **settings)
        bad = F.col("doc_id") == 2
        return out.withColumn("extracted_entities", F.when(~bad, F.col("extracted_entities"))).withColumn("_failed", bad)

    monkeypatch.setattr(extract, "extract", failing)
    told = []
    out = {r["doc_id"]: r for r in streams.backfill(docs, parts=3, progress=told.append).collect()}
    assert {d: r["entities_version"] for d, r in out.items()} == {1: 2.5, 2: 2.0, 3: 3.5}
    assert [e["value"] for e in out[1]["extracted_entities"]] == ["a@b.org"] and out[2]["extracted_entities"] == [] == out[3]["extracted_entities"]
    assert len(told) == 3 and (told[-1].total, told[-1].done, told[-1].failed) == (2, 2, 1)
    assert extract._or_none(5) is None  # what is no text fails alone


def test_one_backfill_at_a_time(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.org", None, None)], BACKFILLED)
    lock, seen = str(tmp_path / "lock"), []

    def refine(rows):
        with pytest.raises(RuntimeError, match="running"):
            streams.backfill(docs)
        seen.append(1)
        return rows.withColumn("entities_version", F.lit(3.0))

    assert streams.backfill(docs, refine, lock=lock).first()["entities_version"] == 3.0 and seen == [1]
    assert streams._take(spark, lock)  # as another driver would
    with pytest.raises(RuntimeError, match="running"):
        streams.backfill(docs, lock=lock)
    streams._release(spark, lock)
    assert streams.backfill(docs, lock=lock).count() == 1 and streams.next_version(2.0, True, False) == 3.0 and streams.next_version(3.5, False, False) == 3.5


def test_watcher():
    class Stream:
        def __init__(self, path):
            self.path, self.on = path, True

        def stop(self):
            self.on = False

    made = []
    watcher = streams.Watcher(lambda path: made.append(Stream(path)) or made[-1])
    watcher.add("a", "/a")
    watcher.pause("a")
    watcher.resume("a")
    watcher.resume("a")
    assert [(s.path, s.on) for s in made] == [("/a", False), ("/a", True)]
    watcher.remove("a")
    watcher.shutdown()
    assert not watcher.running and not any(s.on for s in made)


def test_changed_only(spark, tmp_path):
    schema = "path string, content_hash string"
    for n, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")], [("a", "2"), ("b", "2")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
        streams.drain(streams.changed_only(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]


def test_asking_again(spark, tmp_path):
    marks = tmp_path / "tries"

    def failing(prompts):
        with open(marks, "a") as f:
            f.write("x")
        if len(open(marks).read()) < 2:
            raise RuntimeError("busy")
        return [p.upper() for p in prompts]

    M.register_llm(failing, "busy")
    assert M.ask(spark.createDataFrame([("p",)], "prompt string").coalesce(1), name="busy", attempts=2).first()["reply"] == "P"
    M.register_llm(lambda prompts: 1 / 0, "broken")
    assert M.ask(spark.createDataFrame([("p",)], "prompt string"), name="broken", attempts=1).first()["reply"] is None
    M.register_llm(None, "busy")
    M.register_llm(None, "broken")


def test_parser_hook(spark):
    I.register_parser("tex", lambda raw: raw.decode().replace("\\", ""))
    try:
        assert I.parse_bytes("/x/a.TEX", b"\\em")["text"] == "em" and I.parse_bytes("/x/a.xls", b"x")["error"] == "Unsupported file type: xls"
    finally:
        I.PARSERS.pop("tex")


def test_pdf_text():
    import zlib

    def file(*contents, head=b""):
        return b"%PDF-1.7\n" + b"".join(b"%d 0 obj << /Length %d %s >>\nstream\n%s\nendstream endobj\n" % (n, len(c), head, c) for n, c in enumerate(contents))

    plain = rb"BT /F1 9 Tf 1 0 0 1 72 720 Tm (a \(b\) \143\) (x)) Tj T* <48656c6c6f> Tj ( there) ' 5 0 Td (same) Tj ET"
    assert I.parse_bytes("a.pdf", file(plain))["text"] == "a (b) c) (x)\nHello\nthere same".replace("there same", "theresame")
    assert I.parse_bytes("a.pdf", file(zlib.compress(plain), head=b"/Filter /FlateDecode"))["text"] == I.parse_bytes("a.pdf", file(plain))["text"]
    assert I.parse_bytes("a.pdf", file(b"BT <FEFF00e900e0> Tj ET", b"BT [(W) 30 (o) -250 (r)] TJ ET"))["text"] == "éà\nWo r"
    for raw in (b"", b"%PDF-1.4 nothing", b"no pdf", file(plain) + b"trailer << /Encrypt 5 0 R >>", file(b"broken", head=b"/Filter /FlateDecode")):
        assert I.parse_bytes("a.pdf", raw)["text"] is None and I.parse_bytes("a.pdf", raw)["error"]


def test_unknown_documents_are_errors(spark):
    rows = spark.createDataFrame([(1, [1.0], ["A:b"], None, "b")], "id long, embedding array<double>, keys array<string>, created_at timestamp, excerpt string")
    with pytest.raises(LookupError):
        S.related_to(rows, [1, 2], F.current_timestamp())


def test_components_in_rounds(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 160)], "a long, b long")
    for few in (0, 5, 10**6):
        roots = {r["node"]: r["root"] for r in connected(chain, one_task_edges=few).collect()}
        assert all(roots.get(n, n) == 0 for n in range(61)) and all(roots.get(n, n) == 100 for n in range(100, 160))


def test_shared_folder_off_local_masters():
    from foliograph.operators import components

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        components.shared_folder(Session())


def test_vector_pairs_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + 0.45 * rng.normal(size=(4, 32)) for c in centres])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(160) for j in range(i + 1, 160) if unit[i] @ unit[j] >= 0.75}
    canon = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(x)], "id long, entity_type string, embedding array<double>")
    got = {(r["a"], r["b"]) for r in E.vector_pairs(canon, tables=16).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0
    assert {(r["a"], r["b"]) for r in E.vector_pairs(canon, tables=0).collect()} == want


def test_settings(spark, tmp_path):
    from foliograph.functions import settings

    path = str(tmp_path / "settings")
    assert settings.read(spark, path) == settings.Settings()
    settings.write(spark, path, settings.patch(settings.Settings(), llm_enabled=True, llm_model=None))
    assert settings.read(spark, path).llm_enabled
