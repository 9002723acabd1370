"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliograph.llm import components, decontamination, exchange, line_quality, mixing, ngram_join, personal_data, quality_rules, queries, secret_scan, sharding, substring_dedup, textblocks, token_files
from foliograph.llm.shared import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


CLASHING = (
    "size", "score", "kept", "chunk", "class", "start", "_size", "_at", "shard", "slot", "block", "family", "root", "node", "_source", "_crc", "_hash", "_bucket", "_new", "_o", "_b", "_old", "_block",
    "_part", "_key", "_found", "run", "target", "_n", "_s", "_value", "_g", "offset", "first", "_offset", "old", "new", "part", "bucket", "n", "at", "_of", "cuts", "step", "print", "check", "tie", "_kept", "item_id",
)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é€😀"]) + str(rng.randint(0, 99)) for _ in range(40_000))
    base = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", None), (4, "one two three", "en", "b", 3), (5, "one two three", "en", "b", 3), (5, "one two three", "en", "b", 3),
        (None, "no id here at all, really none", "en", "a", 1), (7, long, "en", "a", 1), (8, "x y z w v u t s r q " * 3 + "tail", "en", "c", 1), (9, "é ü ñ <|endoftext|> 'tis 　 mail: a.b@c.de", "en", "a", 1),
    ]
    frame = spark.createDataFrame(base, SCHEMA)
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


OPERATORS = {
    "line_quality": lambda d: line_quality.line_quality(d, np.zeros(line_quality.WIDTH + 4)), "quality_rules": quality_rules.repetition_rules, "keep_unrepetitive": quality_rules.keep_unrepetitive,
    "ngram_join": ngram_join.near_duplicates, "one_per_group": ngram_join.one_per_group, "contaminated": lambda d: decontamination.contaminated(d, d.selectExpr("doc_id as item_id", "text").where("doc_id in (1, 2, 4)")),
    "reshard": lambda d: sharding.reshard(d, sharding.by_source(d)), "personal_data": personal_data.personal_data, "redacted": personal_data.redacted, "substring": substring_dedup.remove_repeats,
    "decontaminate": lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "x y z w v u")], "item_id long, text string")),
    "mix": mixing.mix, "mixed_rows": mixing.mixed_rows, "secrets": secret_scan.secret_scan,
}
ALL_COLUMNS = {"keep_unrepetitive", "one_per_group", "reshard", "redacted", "mix", "mixed_rows", "decontaminate"}
SAME_ROWS = {"line_quality", "quality_rules", "ngram_join", "reshard", "personal_data", "redacted", "substring", "mix", "secrets"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    out = OPERATORS[name](odd).collect()
    if name in SAME_ROWS:
        assert len(out) == odd.count()
    if name in ALL_COLUMNS:  # the caller's columns keep their values
        plain = [c for c in odd.columns if c != "text" or name != "redacted"]
        assert set(plain) <= set(out[0].__fields__) and all(r[c] == f"own {c}" for r in out for c in CLASHING)
        rows = {tuple(r[c] for c in plain) for r in odd.collect()}
        assert {tuple(r[c] for c in plain) for r in out} <= rows and (name not in SAME_ROWS or {tuple(r[c] for c in plain) for r in out} == rows)


@pytest.mark.parametrize("name, own", [("reshard", "_shard"), ("mix", "_mix")])
def test_a_column_of_the_result_is_taken(odd, name, own):
    out = OPERATORS[name](odd.withColumn(own, F.lit(1)))
    assert out.columns[-2:] == [own, f"{own}_"] and {r[own] for r in out.collect()} == {1}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


# --- 1 -----------------------------------------------------------------------

def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 11])
    emit, move = rng.normal(size=11), rng.normal(size=(2, 2))
    marginal, pairs, log_z = line_quality.forward_backward(emit, first, move)
    total = np.zeros((2, 2))
    for n in range(4):
        a, b = first[n], first[n + 1]
        if a == b:
            continue
        paths = [[(k >> t) & 1 for t in range(b - a)] for k in range(1 << (b - a))]
        weight = np.array([np.exp(sum(emit[a + t] * s for t, s in enumerate(p)) + sum(move[p[t], p[t + 1]] for t in range(len(p) - 1))) for p in paths])
        assert np.isclose(np.log(weight.sum()), log_z[n])
        for t in range(b - a):
            assert np.isclose(marginal[a + t], sum(w for w, p in zip(weight, paths, strict=True) if p[t]) / weight.sum())
        for w, p in zip(weight / weight.sum(), paths, strict=True):
            for t in range(len(p) - 1):
                total[p[t], p[t + 1]] += w
    assert np.allclose(pairs, total)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in queries.op1_crf_quality(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in scored.items())
    held = [(scored[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if scored[r.doc_id].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9


# --- 2 -----------------------------------------------------------------------

def brute_repeats(seq):
    """Longest repeat from each place, by comparing all pairs."""
    out = [0] * len(seq)
    for i in range(len(seq)):
        for j in range(len(seq)):
            if i != j:
                k = 0
                while max(i, j) + k < len(seq) and seq[i + k] == seq[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


def brute_maximal(seq, least):
    """Substrings found twice or more, whose occurrences differ in the symbol before and in the symbol behind."""
    at = collections.defaultdict(list)
    for i in range(len(seq)):
        for j in range(i + least, len(seq) + 1):
            at[tuple(seq[i:j])].append(i)
    differ = lambda places, step: len({seq[p] if 0 <= p < len(seq) else ("edge", p) for p in (k + step for k in places)}) > 1
    return sorted(s for s, places in at.items() if len(places) > 1 and differ(places, -1) and differ(places, len(s)))


@pytest.mark.parametrize("seed", range(60))
def test_longest_repeats(seed):
    rng = random.Random(seed)
    seq, least = [rng.randint(0, rng.choice([0, 1, 2, 5, 30])) for _ in range(rng.randint(0, 50))], rng.choice([1, 2, 3, 5])
    found, longest = quality_rules.find_repeats(np.array(seq, np.uint64), least), brute_repeats(seq)
    assert found.longest.tolist() == longest
    assert sorted(tuple(seq[a : a + n]) for a, n in zip(*map(np.ndarray.tolist, found.maximal), strict=True)) == brute_maximal(seq, least)
    covered = {k + n for k, m in enumerate(longest) if m >= least for n in range(m)}
    assert covered == {k for a, b in quality_rules.repeated_spans(np.array(seq, np.uint64), least) for k in range(a, b)}


def test_repeats_of_one_word():
    found = quality_rules.find_repeats(np.zeros(200_000, np.uint64))
    assert found.longest[0] == 199_999 and len(found.maximal[0]) == 199_999 - 7


def test_quality_rules(spark, rows):
    got = {r.doc_id: r for r in queries.op2_suffix_repetition(spark, SF).collect()}
    for doc, text, _ in rows:
        w, r = words_of(text), got[doc]
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        inside = {k + n for v in at.values() if len(v) > 1 for k in v for n in range(5)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if words_of(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside))
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
        if not failed and len(w) < 250:
            longest = brute_repeats(w)
            cover = {k + n for k, m in enumerate(longest) if m >= quality_rules.MIN_REPEAT for n in range(m)}
            assert r.covered_words == len(cover)
            assert r.kept == (len(cover) <= quality_rules.MAX_COVERED * len(w) and max(longest) <= quality_rules.MAX_LONGEST)


def test_quality_rules_match_sql(spark, docs):
    got, con = queries.op2_suffix_repetition(spark, SF), duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op2_suffix_repetition"])
    assert got.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
    assert "n_maximal" in quality_rules.repetition_rules(docs).columns


def test_repeated_spans():
    seq = [*range(10), 50, *range(10), 60, 61]
    assert quality_rules.repeated_spans(np.array(seq, np.uint64), 8) == [(0, 10), (11, 21)]


# --- 3 -----------------------------------------------------------------------

def shingles(text):
    w = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_ngram_join(spark, rows):
    sets = {d: shingles(t) for d, t, _ in rows}
    want = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_prefix_tree_join(spark, SF).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def near_texts(seed, n=60):
    """Chains and clusters around the threshold."""
    rng = random.Random(seed)
    out = []
    for g in range(4):
        w = [f"g{g}w{k}" for k in range(rng.choice([6, 30, 80]))]
        for _ in range(n // 4):
            if rng.random() < 0.6:
                w = list(w)
                w[rng.randrange(len(w))] = f"r{rng.randint(0, 10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("family, block", [(2_000_000, 1500), (200, 3)])
def test_ngram_join_blocks(spark, monkeypatch, family, block):
    """Small limits deal every family into blocks: the components stay the same."""
    texts = near_texts(7)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = ngram_join.link_classes
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "link_classes", lambda sets, percent: real(sets, percent, family, block))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()}
    assert got == brute_components({n: shingles(t) for n, t in enumerate(texts)})


@pytest.mark.parametrize("seed", range(10))
def test_prefix_tree(seed):
    rng = random.Random(seed)
    sets = [rng.sample(range(14), rng.randint(1, 12)) for _ in range(40)]
    links = ngram_join.join_sets([np.array(s, np.uint64) for s in sets], [len(s) for s in sets], percent=60)
    parent = brute_components({n: frozenset(s) for n, s in enumerate(sets)}, 60)
    got = {n: n for n in range(40)}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        got[max(x, y)] = min(x, y)
    assert {n: find(n) for n in got} == parent


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(n, n + 1) for n in range(1000, 1060)] + [(2000, n) for n in range(2001, 2100)]
    want = brute_components({})
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert want == {} and got == {x: find(x) for x in got} and len(got) >= len(parent) - sum(a == b for a, b in edges)


# --- 4 -----------------------------------------------------------------------

def semi_global(x, y):
    last = [0] * (len(y) + 1)
    for i, a in enumerate(x, 1):
        now = [i]
        for j, b in enumerate(y, 1):
            now.append(min(last[j - 1] + (a != b), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


def test_decontamination(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rng, texts, want = random.Random(9), [], {}
    for n in range(60):
        item = rng.choice(bench)
        x = list(item.text)
        for _ in range(rng.randint(0, int(len(x) * 0.14))):
            p, how = rng.randrange(len(x)), rng.random()
            x[p : p + (how < 0.66)] = [] if how < 0.33 else [rng.choice("abcxyz")]
        texts.append("intro words " * rng.randint(0, 4) + "".join(x) + " and the end")
        low = lambda s: re.sub(rb"[\x20\x09-\x0d]+", b" ", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m.group().lower(), s).encode()).strip()
        edits, budget = semi_global(low(item.text), low(texts[-1])), int(decontamination.ERROR * len(low(item.text)))
        want[n, item.item_id] = edits if edits <= budget else None
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    for key, edits in want.items():
        assert (got[key].edits if key in got else None) == edits
    clean = {n for n in range(60) if not any(k[0] == n for k in got)}
    assert {r.doc_id for r in decontamination.decontaminate(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()} == clean


def test_decontamination_short_items(spark):
    frame = spark.createDataFrame([(1, "so Ab Cd it is"), (2, "nothing"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "ab  cd"), (6, None), (7, " ")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in decontamination.contaminated(frame, items).collect()] == [(1, 5, 3, 8)]


# --- 5 and 9 -------------------------------------------------------------------

def test_min_cost_flow():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(1, 5)
        supply = [rng.randint(0, 50) for _ in range(n)]
        demand = sharding.capacities(sum(supply), n)
        flow = sharding.min_cost_flow(supply, demand, [[int(i != j) for j in range(n)] for i in range(n)])
        assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(n)] == demand
        moved = sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j)
        assert moved == sum(max(0, s - d) for s, d in zip(supply, demand, strict=True))
    costs = [[4, 1], [2, 5]]
    assert sharding.min_cost_flow([3, 3], [3, 3], costs) == [[0, 3], [3, 0]]


def brute_blocks(rows, shards, old_of):
    """Blocks of (old shard, hash) with sizes, and the least number of bytes that any layout of equal shards must move."""
    size = collections.Counter()
    for doc, text, source in rows:
        size[old_of(source)] += len((text or "").encode()) + 1
    cap = sharding.capacities(sum(size.values()), shards)
    return size, sum(max(0, size[s] - cap[s]) if s < shards else size[s] for s in size)


def test_resharding(spark, rows):
    got = queries.op5_flow_resharding(spark, SF).collect()
    text = {d: t for d, t, _ in rows}
    assert {r.doc_id for r in got} == set(text)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) for t in text.values()) + 1
    assert max(sizes.values()) - min(sizes.values()) <= largest
    # the old layout is the stated one, and no layout of equal shards moves many fewer bytes
    source = {d: s for d, _, s in rows}
    old_of = lambda s: zlib.crc32((s or "").encode()) % 8
    assert all(r.old_shard == old_of(source[r.doc_id]) for r in got)
    _, least = brute_blocks(rows, 8, old_of)
    assert least <= sum(r.size for r in got if r.old_shard != r.shard) + 8 * largest and sum(r.size for r in got if r.old_shard != r.shard) <= least + 8 * largest


@pytest.mark.parametrize("old, new", [(4, 4), (8, 4), (4, 8), (8, 8), (1, 3)])
def test_rewrite_affected(spark, docs, tmp_path, old, new):
    path, staging = f"{tmp_path}/shards", f"{tmp_path}/staging"
    columns = docs.columns
    docs.withColumn("shard", F.when(F.col("doc_id") % 10 < 4, 0).otherwise(F.pmod("doc_id", F.lit(old)))).write.partitionBy("shard").parquet(path)
    before = {r.shard: r.files for r in spark.read.parquet(path).withColumn("f", F.input_file_name()).groupBy("shard").agg(F.collect_set("f").alias("files")).collect()}
    affected = sharding.rewrite_affected(spark, path, new, staging)
    after = spark.read.parquet(path)
    key = lambda frame: sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect())))
    assert key(after) == key(docs)
    size = {r.shard: r.s for r in after.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("s")).collect()}
    assert set(size) == set(range(new)) and max(size.values()) < 1.3 * min(size.values())
    now = {r.shard: r.files for r in after.withColumn("f", F.input_file_name()).groupBy("shard").agg(F.collect_set("f").alias("files")).collect()}
    assert all(sorted(now[s]) == sorted(before[s]) for s in before if s not in affected) and set(before) - set(range(new)) <= set(affected)
    assert not (tmp_path / "staging").exists()
    sharding.rewrite_affected(spark, path, new, staging)
    assert key(spark.read.parquet(path)) == key(docs)


@pytest.mark.parametrize("fails_at", range(1, 9))
def test_interrupted_rewrite_is_finished(spark, tmp_path, monkeypatch, fails_at):
    path, staging = f"{tmp_path}/shards", f"{tmp_path}/staging"
    frame = spark.range(400).withColumns({"doc_id": F.col("id"), "text": F.lit("some text of a row"), "shard": F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 3)})
    frame.write.partitionBy("shard").parquet(path)
    import os

    calls, real = [0], sharding._finish

    def broken(spark, path, staging):
        """Makes some of the changes by hand, as a run that was stopped left them."""
        if not os.path.exists(f"{staging}/changes"):
            return []
        for what in ("stays", "moves"):
            for folder in sorted(os.listdir(f"{staging}/files/what={what}") if os.path.exists(f"{staging}/files/what={what}") else []):
                for name in sorted(os.listdir(f"{staging}/files/what={what}/{folder}")):
                    if what == "stays" and not os.path.exists(f"{staging}/gone/{folder}"):
                        os.makedirs(f"{staging}/gone", exist_ok=True)
                        os.rename(f"{path}/{folder}", f"{staging}/gone/{folder}")
                        calls[0] += 1
                        if calls[0] >= fails_at:
                            raise RuntimeError("stopped")
                    if what == "moves":
                        os.makedirs(f"{path}/{folder}", exist_ok=True)
                        os.rename(f"{staging}/files/what={what}/{folder}/{name}", f"{path}/{folder}/{name}")
                        calls[0] += 1
                        if calls[0] >= fails_at:
                            raise RuntimeError("stopped")
                if what == "stays":
                    os.rename(f"{staging}/files/what={what}/{folder}", f"{path}/{folder}")
        raise RuntimeError("stopped")

    monkeypatch.setattr(sharding, "_finish", broken)
    with pytest.raises(RuntimeError, match="stopped"):
        sharding.rewrite_affected(spark, path, 3, staging)
    monkeypatch.setattr(sharding, "_finish", real)
    assert sharding.rewrite_affected(spark, path, 3, staging)
    after = spark.read.parquet(path)
    assert sorted(r.id for r in after.collect()) == list(range(400)) and {r["count"] for r in after.groupBy("shard").count().collect()} <= set(range(120, 148))


def test_sainte_lague():
    rng = random.Random(6)
    for _ in range(30):
        weights, seats = [rng.random() * 10 for _ in range(rng.randint(1, 8))], rng.randint(0, 200)
        out = [0] * len(weights)
        for _ in range(seats):
            out[max(range(len(weights)), key=lambda i: weights[i] / (2 * out[i] + 1))] += 1
        assert mixing.sainte_lague(weights, seats) == out


def greedy(weights, seats):
    """Sources in the order in which the highest quotients take the seats."""
    out, order = [0] * len(weights), []
    for _ in range(seats):
        order.append(max(range(len(weights)), key=lambda i: weights[i] / (2 * out[i] + 1)))
        out[order[-1]] += 1
    return order


def test_shard_quotas():
    rng = random.Random(16)
    for _ in range(20):
        weights, seats, shards = [rng.random() * 10 for _ in range(rng.randint(1, 6))], rng.randint(0, 150), rng.randint(1, 9)
        order = greedy(weights, seats)
        cuts = mixing.shard_quotas(weights, seats, shards, [10**9] * len(weights))
        for j in range(shards):
            own = collections.Counter(order[seats * j // shards : seats * (j + 1) // shards])
            assert [c[j + 1] - c[j] for c in cuts] == [own[i] for i in range(len(weights))]


def test_taken_words():
    rng = random.Random(11)
    for kind in (np.int64, object):
        for _ in range(150):
            block, total = rng.randint(1, 9), rng.randint(1, 200)
            n = -(-total // block)
            step, shift, seats = next(s for s in iter(lambda: rng.randint(1, n), 0) if np.gcd(s, n) == 1), rng.randrange(n), rng.randint(0, 2 * n)
            order = sorted(range(n), key=lambda x: (step * x + shift) % n) * 3
            times = collections.Counter(order[:seats])
            assert max(times.values(), default=0) <= 2
            per_word, at = [times[w // block] for w in range(total)], 0
            while at < total:
                size = min(rng.randint(1, 60), total - at)
                taken, often, _ = mixing.taken_words(*(np.array([v], kind) for v in (at, size, block, n, step, shift, seats)))
                assert taken[0] == sum(per_word[at : at + size]) and often[0] == per_word[at + size // 2]
                at += size


def test_targets():
    out = mixing.targets([100, 10, 50, 0], [5, 2, 1, 5])
    assert all(t <= 2 * s + 1e-9 for t, s in zip(out, [100, 10, 50, 0], strict=True)) and abs(sum(out) - 240) < 1e-6


def test_mix(spark, docs, rows):
    """Every row against an apportionment and a choice of blocks made one by one."""
    got = {r.doc_id: r for r in queries.op9_sainte_lague_mix(spark, SF).collect()}
    assert got == {r.doc_id: r for r in queries.op9_sainte_lague_mix(spark, SF).collect()}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len(words_of(t)) for _, t, own in rows if own == s) for s in sources}
    goal = mixing.targets([size[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))])
    assert abs(sum(goal) - 1.5 * sum(size.values())) < 1e-3 and all(g <= 2 * size[s] + 1e-6 for g, s in zip(goal, sources, strict=True))
    block = max(1, int(min(goal) // mixing.LEAST_BLOCKS))
    seats = collections.Counter(greedy(goal, round(sum(goal) / block)))
    for i, s in enumerate(sources):
        own = sorted(((got[d].start, len(words_of(t)), d) for d, t, source in rows if source == s), key=lambda x: x[:2])
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]  # the documents lie one behind another
        p = mixing.plan([size[x] for x in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))], sources)[i]
        order = sorted(range(p["blocks"]), key=lambda x: (p["step"] * x + p["shift"]) % p["blocks"])
        assert sorted(order) == list(range(-(-size[s] // block)))
        line = (order * 3)[: min(seats[i], 2 * p["blocks"])]
        times = collections.Counter(line)
        shard_of = {}
        for at, x in enumerate(line):
            shard_of.setdefault(x, max(j for j in range(8) if p["cuts"][j] <= at))
        for at, n, d in own:
            middle = (at + n // 2) // block
            want = (n, size[s], sum(times[w // block] for w in range(at, at + n)), shard_of.get(middle) if n else None)
            assert (got[d].size, got[d].source_size, got[d].taken, got[d].shard) == want and abs(got[d].target - goal[i]) < 1e-6
        assert abs(sum(got[d].taken for _, _, d in own) - goal[i]) <= 2 * block + 1


# --- 6 -----------------------------------------------------------------------

def test_token_files(spark, rows):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r.doc_id: r for r in queries.op6_bit_packed_ids(spark, SF).collect()}, 0
    for doc, text, _ in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    from foliograph.llm.shared import shared_dir

    files = token_files.write_tokens(odd, path, shared_dir(spark, "ids"), file_bytes=20_000)
    got = token_files.read_tokens(spark, files, with_ids=True).collect()
    want = collections.Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in odd.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert got and sorted(r.start for r in got)[0] == 0
    assert token_files.token_ids(spark.createDataFrame([], SCHEMA), path).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_units_encode_as_whole_texts(special):
    """Special tokens, words, lines and marks in any order, against the library over whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_files.UnitEncoder(token_files.library_tokenizer(path, special))
    library.encode_special_tokens = not special
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endo", "ftext|>", "hello", " world", " ", "  ", "\n", ".", ",", "|", "'s", "12", "é", "　", "\u00a0", "x" * 40, "Don't", "\t", "<|", "😀", " the", "\u2009"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "ends <|endo", "ftext|> begins", ""] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    for limit in (300, 1 << 16):
        for block in textblocks.blocks(pa.array(texts), limit):
            ids, counts = encoder(block)
            ends = np.cumsum(counts)
            for n in range(block.n):
                assert ids[ends[n] - counts[n] : ends[n]].tolist() == library.encode(texts[block.row + n], add_special_tokens=False).ids
    if special:
        assert library.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]


def test_units_are_forgotten(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "KNOWN_UNITS", 300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_files.UnitEncoder(token_files.library_tokenizer(path))
    rng = random.Random(6)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(100)) for _ in range(3)]
        ids, counts = encoder(next(textblocks.blocks(pa.array(texts))))
        assert ids.tolist() == [i for x in texts for i in library.encode(x, add_special_tokens=False).ids] and len(encoder.key) < 900


def test_rows_of_one_id_are_in_order(spark):
    import public_tokenizers

    frame = spark.createDataFrame([(3, f"text {n}") for n in range(50)] + [(None, f"none {n}") for n in range(50)] + [(1, "x"), (9, None)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    runs = [sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_ids(frame.repartition(n), path, file_bytes=100).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and [r[1] for r in runs[0]] == [None] * 50 + [1] + [3] * 50 + [9]
    starts = [r[0] for r in runs[0]]
    assert starts == [sum(r[2] for r in runs[0][:k]) for k in range(len(starts))]


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing(width, tmp_path):
    ids = np.random.default_rng(width).integers(0, 1 << width, 200_001)
    assert (token_files.unpack(token_files.pack(ids, width), width, len(ids)) == ids).all()
    with open(tmp_path / "f.ids", "wb") as sink:
        writer = token_files.Writer(sink, width)
        for a in range(0, len(ids), 7777):
            part = ids[a : a + 7777]
            writer.add(part, [(a, len(part))])
        writer.close()
    reader = token_files.Reader(f"file://{tmp_path}/f.ids")
    assert reader.n == len(ids) and (reader.ids(65_530, 140_000) == ids[65_530:140_000]).all() and (reader.document(3) == ids[3 * 7777 : 4 * 7777]).all()


# --- 7 and 10 ------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn(s):
    return sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(s))) % 10 == 0


def brute_pii(x):
    out = [("email", *m.span()) for m in EMAIL.finditer(x)]
    out += [("ip", *m.span()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(x) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(x) if 9 <= len(digits(m.group())) <= 15]


def in_order(spans, kinds):
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def test_pii_fuzz():
    rng = random.Random(3)
    parts = ["@", ".", "1", "23", "+", "4", " ", "-", "a", "b.c", "(", ")", "256", "é", "\n", "%", "4111111111111111", "http://", "iban "]
    for _ in range(6000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert in_order(brute_pii(x), personal_data.KINDS) == [s for s in personal_data.find_spans(x) if s[0] in personal_data.BASE_KINDS]


def test_pii_method():
    x = "see https://joe:pw@ex.org/a, IBAN: GB29 NWBK 6016 1331 9268 19 and account no. 12345678."
    found = {k: x[a:b] for k, a, b in personal_data.find_spans(x)}
    assert found["url"] == "https://joe:pw@ex.org/a," and found["iban"] == "GB29 NWBK 6016 1331 9268 19" and found["account"] == "12345678"
    assert personal_data.find_spans("my account of it, konto") == [] and personal_data.redact("mail a@b.cd now") == "mail <email> now" and personal_data.redact(None) is None


def test_pii_query(spark, rows):
    got = {r.doc_id: r for r in queries.op7_anchor_pii(spark, SF).collect()}
    for doc, text, _ in rows:
        base = in_order(brute_pii(text or ""), personal_data.KINDS)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[doc]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in personal_data.BASE_KINDS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(x):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(x) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m.group()) >= 20]
    return in_order(out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m.group()) >= 24], secret_scan.KINDS)


def test_secrets(spark, rows):
    got = {r.doc_id: r for r in queries.op10_markov_secrets(spark, SF).collect()}
    for doc, text, _ in rows:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_secrets(text or ""))
        assert got[doc].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    table = secret_scan.train(["9f8e7d6c5b4a39281706"], ["ordinaryidentifier", "some_long_function_name", "AnotherClassName"] * 50)
    texts = ["see xK9vQ2mZ7pL4tR8wY1nB3cD6 there", "see some_long_function_name_with_ordinary_words there", "é token = abcdef123456"]
    block = next(textblocks.blocks(pa.array(texts)))
    found = secret_scan.scan(block, pa.array(texts), table, secret_scan.MIN_LLR, secret_scan.MIN_LLR_CHAR)
    assert [[s[0] for s in spans] for spans in found] == [["random"], [], ["assign"]] and found[0][0][1:] == (4, 28) and found[2][0][1:] == (2, 22)


def test_secrets_fuzz():
    rng, table = random.Random(8), secret_scan.train([], [])
    parts = ["token", "Secret", "ſecret", "=", ":", " ", "'", '"', "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "api_key", "APIKEY", "é", "\n", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for block in textblocks.blocks(pa.array(texts)):
        part = texts[block.row : block.row + block.n]
        for x, spans in zip(part, secret_scan.scan(block, pa.array(part), table, 12, 0.6), strict=True):
            assert brute_secrets(x) == [s for s in spans if s[0] != "random"]


# --- 8 -----------------------------------------------------------------------

def brute_removal(rows, size=20):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        kept = [a for a, b in zip(w, gone, strict=True) if not b]
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_count_min_substrings(spark, SF).collect()}
    assert got == brute_removal([(d, t) for d, t, _ in rows])


def test_substring_dedup_small_windows(spark):
    rng = random.Random(5)
    texts = [(n, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for n in range(120)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), size=4, with_text=True).collect()
    want = brute_removal(texts, 4)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out)


@pytest.mark.parametrize("bits", [4, 10, 33])
def test_sorted_codes(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 7, 16):
        values = np.sort(rng.choice(1 << min(bits, 20), min(n, 1 << bits), replace=False)).astype(np.uint64)
        assert (exchange.decode_sorted(exchange.encode_sorted(values, bits)) == values).all()


# --- shared parts ---------------------------------------------------------------

def test_window_hashes_are_positional():
    h = np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64)
    for size in (1, 2, 5, 20):
        w = textblocks.window_hashes(np.concatenate([h, h]), size)
        assert (w[: 101 - size] == w[100 : 201 - size]).all() and len(set(w[:100].tolist())) == 100


def test_spans_are_equal_across_blocks():
    texts = ["alpha beta", "x" * 3_000_000 + " alpha", "", "beta alpha"]
    seen = collections.defaultdict(set)
    for block in textblocks.blocks(pa.array(texts), 16):
        w = textblocks.find_words(block)
        for a, b, h in zip(w.begin, w.end, textblocks.span_hashes(block.data, w.begin, w.end).tolist(), strict=True):
            seen[block.data[a:b].tobytes()].add(h)
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == 3


def test_written_survives(spark):
    assert written(spark.range(5), "t").count() == 5
