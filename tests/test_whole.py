"""The whole-table queries against brute force on small tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import blocks
from foliograph.operators import entities as E
from foliograph.operators import extract as X
from foliograph.operators import graph as G
from foliograph.operators import search as S
from foliograph.operators import spaces as P
from foliograph.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables given as name=(rows, schema); the folder's path."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_triples_of_all_customers(spark, tables):
    customers, orders = range(1, 31), [(o, o * 7 % 30 + 1) for o in range(60)]
    items = [(o, (o * 5 + n) % 11, (o * 3 + n) % 7) for o in range(60) for n in range(2)]
    sf = tables(
        customer=([(c, c % 5, f"name {c}") for c in customers], "c_custkey long, c_nationkey int, c_name string"), nation=([(n, n % 2) for n in range(5)], "n_nationkey int, n_regionkey int"),
        orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long"),
    )
    of, want = dict(orders), {}

    def add(s, p, o, d, back=None):
        for t in [(s, p, o)] + [(o, back, s)] * (back is not None):
            want.setdefault(t, set()).add(d)

    for c in customers:
        add(f"c{c}", "located_in", f"n{c % 5}", f"d{c % 10}")
        add(f"c{c}", "partner_of", f"c{c + 1}", "d5", "partner_of")
    for n in range(5):
        add(f"n{n}", "part_of", f"r{n % 2}", "d0")
    for o, part, supplier in items:
        add(f"c{of[o]}", "purchased_from", f"s{supplier}", f"d{of[o] % 10}", "sold_to")
        add(f"c{of[o]}", "owns", f"p{part}", f"d{of[o] % 10}", "owned_by")
    got = {(r["subject_id"], r["predicate"], r["object_id"]): r["doc_ids"] for r in QUERIES["trp_closure"](spark, sf).collect()}
    assert got == {t: ",".join(sorted(d)) for t, d in want.items()}
    owned = {r["object_id"] for r in QUERIES["trp_objects"](spark, sf).collect()}
    assert owned == {o for s, p, o in want if s == "c12" and p == "owns"}
    left = {(r["subject_id"], r["predicate"], r["object_id"]) for r in QUERIES["trp_cleanup"](spark, sf).collect()}
    assert left == {t for t, d in want.items() if d != {"d5"}}


def test_collisions_of_all_parts(spark, tables):
    parts = [(4, "B#1", 7, "four"), (10, "B#1", 7, "ten"), (9, "B#2", 3, "nine"), (5, "b#2", 3, "five"), (8, "B#3", 1, "eight")]
    sf = tables(part=(parts, "p_partkey long, p_brand string, p_size int, p_name string"))
    got = {r["space_id"]: (r["collides"], r["label"]) for r in QUERIES["space_collisions"](spark, sf).collect()}
    assert got == {
        "space-4": (True, "B#1 7 — 5"), "space-10": (True, "B#1 7 — 11"), "space-9": (True, "b#2  3 — nine"), "space-5": (True, "b#2  3 — 6"), "space-8": (False, "B#3 1"),
    }


def test_hint_is_due_at_a_fifth_of_all_documents(spark, tables):
    # space 0: x in 2 of 10; space 1: 1 of 6; space 2: 3 of 7, all of odd ids or rare ones
    values = {0: ["x", "x", *"abcdefgh"], 1: list("abcdef"), 2: ["y", "a", "y", "b", "y", "c", "d"]}
    rows = [(9 * n + k, v) for k, vs in values.items() for n, v in enumerate(vs)]
    sf = tables(documents=(rows, "doc_id long, lang string"))
    assert {tuple(r) for r in QUERIES["space_hint"](spark, sf).collect()} == {("s0", "x"), ("s2", "y")}


def test_nearest_previous_by_all_dimensions(spark, tables):
    # the labels differ in the last dimension only, and the first three point to the wrong one
    def vector(x, y):
        return [1.0, x, 0.0] + [0.0] * 60 + [y]

    rows = [(0, vector(0.0, 9.0), 1), (1, vector(0.4, 9.0), 1), (2, vector(0.2, -9.0), 2), (3, vector(-0.2, -9.0), 2)]
    sf = tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert {(r["space_id"], r["previous_id"]) for r in QUERIES["space_nearest_previous"](spark, sf).collect()} == {("s1", "s1"), ("s2", "s2")}


def test_vector_pairs_are_all_found(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + 0.45 * rng.normal(size=(4, 32)) for c in centres] + [np.zeros((1, 32))])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rows = [(i, f"t{i % 8 // 4}", v.tolist()) for i, v in enumerate(x)]
    want = {(i, j) for i in range(161) for j in range(i + 1, 161) if rows[i][1] == rows[j][1] and unit[i] @ unit[j] >= 0.75}
    canon = spark.createDataFrame(rows, "id long, entity_type string, embedding array<double>")
    whole = E.vector_pairs(canon)
    monkeypatch.setattr(blocks, "packed", lambda *args, real=blocks.packed: real(*args, block=30))
    for got in (whole, E.vector_pairs(canon.repartition(3))):
        pairs = [(r["a"], r["b"]) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_vector_merge_at_three_quarters(spark, tables):
    rows = [(1, [1.0, 0.0], 1), (2, [0.8, 0.6], 1), (4, [0.0, 1.0], 1), (5, [1.0, 0.1], 2)]
    sf = tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert {(r["a"], r["b"]) for r in QUERIES["ent_vector_merge"](spark, sf).collect()} == {(1, 2)}


def test_alias_merge_joins_all_near_entities(spark, tables):
    # 1 and 2 are near rows of their own; 3 has a moved copy with more documents; 4 is near 1 but of another type
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.05], 1), (5, [0.0, 1.0], 1), (3, [0.0, 1.0], 2), (4, [1.0, 0.0], 2)]
    sf = tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert {tuple(r) for r in QUERIES["ent_merge_aliases"](spark, sf).collect()} == {(1, 2), (2, 2), (5, 5), (3, 10_000_003), (10_000_003, 10_000_003), (4, 4)}


def test_customer_lines_whose_account_is_a_sin(spark, tables):
    # 100090000 passes the check of a SIN, 100080000 does not
    assert [e["value"] for e in X.extract_text("account no. acc-100090000") if e["subclass"] == "sin"] == ["100090000"]
    sf = tables(customer=([(7,), (10008,), (10009,), (12345678,), (100000009,)], "c_custkey long"))
    got = sorted(map(tuple, QUERIES["p1_customer_line"](spark, sf).collect()))
    assert got == sorted(duckdb.sql(ORACLE_SQL["p1_customer_line"].replace("FROM customer", f"FROM '{sf}/customer.parquet/*.parquet'")).fetchall())


def test_sizes_of_a_terabyte(spark, tables):
    sf = tables(part=([(k,) for k in (1, 2, 3, 4, 1098434, 1098439, 1199999)], "p_partkey long"))
    got = sorted(map(tuple, QUERIES["txt_sizes"](spark, sf).collect()))
    assert got == sorted(duckdb.sql(ORACLE_SQL["txt_sizes"].replace("FROM part)", f"FROM '{sf}/part.parquet/*.parquet')")).fetchall())
    sizes = spark.createDataFrame([(1 << 40,), (1 << 30,)], "n long").select(T.format_bytes(F.col("n")), T.format_bytes(F.col("n"), T.BYTE_UNITS[:4]))
    assert list(map(tuple, sizes.collect())) == [("1.0 TB", "1024.0 GB"), ("1.0 GB", "1.0 GB")]


def test_any_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2100, 4)).astype(np.float32)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, query_vector array<float>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:30])], "id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit[:30].T), axis=1, kind="stable")[:, :3]
    got = {(r["query_id"], r["rank"]): r["id"] for r in S.top_k(rows, asked, 3).collect()}
    assert got == {(q, n + 1): int(i) for q, ids in enumerate(best) for n, i in enumerate(ids)}
    # the queries on top of it give the same in blocks as in one
    names = ("vec_search", "vec_rerank", "vec_related_scored", "vec_trajectory", "rag_retrieve")
    one = {name: sorted(map(repr, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) for name in names}
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 3)
    assert one == {name: sorted(map(repr, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) for name in names}


def test_nearest_of_odd_vectors(spark):
    """Ties go to the lesser id, in blocks of any size; zero, short and missing vectors are at cosine 0; ids may be strings."""
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "query_id long, query_vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in S.top_k(frame, asked, 5).collect()}
    assert [got[1, n] for n in range(1, 6)] == [("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", 0.0), ("e", 0.0)]
    assert [got[2, n][0] for n in range(1, 6)] == ["a", "b", "c", "d", "e"]
    assert S.top_k(frame.limit(0), asked, 5).count() == 0 == S.top_k(frame, asked.limit(0), 5).count()


def test_top_k_plan_moves_ids_only(spark):
    """The texts of rows are joined to the hits; what is ranked is narrow."""
    rows = spark.range(100).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("embedding"), F.lit("long text").alias("text"))
    asked = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plan = S.top_k(rows, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "text" not in window and "BroadcastNestedLoopJoin" not in window[: window.index("MapInArrow")]


def test_neighbours_are_not_themselves(spark):
    rows = spark.createDataFrame([(n, [1.0, 0.0]) for n in range(30)] + [(99, [0.9, 0.1])], "id long, embedding array<double>")
    near = G.blocked_neighbours(rows, 4).collect()
    assert len(near) == 31 * 4 and all(r["source"] != r["target"] for r in near)
    assert sorted(r["target"] for r in near if r["source"] == 1) == [0, 2, 3, 4]


def test_sub_spaces_are_alike_at_all_sizes(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.2 * rng.normal(size=(20, 6)) for c in rng.normal(size=(5, 6))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    members = rows.select("id", F.concat(F.lit("p"), F.col("id") % 2).alias("space_id"))
    one = sorted(P.sub_spaces(rows, members, least_docs=10).collect())
    assert one == sorted(P.sub_spaces(rows, members, least_docs=10, block=10).collect()) and len(one) == 100


def test_rounds_over_all_rows_are_those_of_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))], "id long, embedding array<double>")
    one = sorted(P.kmeans(rows, 6).collect())
    real = P.pick_seeds
    monkeypatch.setattr(P, "seed_rows", lambda dimensions: 199)
    monkeypatch.setattr(P, "_sample", lambda vectors, n, most: np.array([r["vector"] for r in vectors.orderBy("id").collect()]))
    assert real is P.pick_seeds and sorted(P.kmeans(rows, 6).collect()) == one


def test_seeds_come_from_a_bounded_sample(spark):
    vectors = spark.range(20_000).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    got = P._sample(vectors, 20_000, 500)
    assert 350 < len(got) < 650
