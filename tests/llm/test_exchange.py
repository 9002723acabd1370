"""Hashes that no relation of the letters can fool, and the exchange on several levels of ranges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from foliograph.llm import exchange, ngram_join, quality_rules, substring_dedup, textblocks

from .test_llm_operators import SF, brute_components, brute_removal, near_texts, shingles


def thue_morse(n):
    """A word of n letters a and b, and the one with a and b exchanged."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("letters", [16, 128, 256, 1024, 4096])
def test_complementary_words_differ(letters):
    one, two = thue_morse(letters)
    block = next(textblocks.blocks(pa.array([f"{one} {two}"])))
    words = textblocks.find_words(block)
    for seed in (0, 1):
        a, b = textblocks.span_hashes(block.data, words.begin, words.end, seed=seed)
        assert a != b


def test_span_hashes_tell_all_short_words_apart():
    words = sorted({bytes(random.Random(n).choices(b"ab\x00\xc3", k=n % 20 + 1)) for n in range(20_000)})
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    for seed in (0, 1):
        assert len(set(textblocks.span_hashes(data, end - [len(w) for w in words], end, seed=seed).tolist())) == len(words)


def test_operators_tell_complementary_words_apart(spark):
    one, two = thue_morse(1024)
    rest = " ".join(f"w{n}" for n in range(19))
    frame = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest} {two} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame).collect()} == {1: 0, 2: 0, 3: 40}
    short = spark.createDataFrame([(1, f"{one} x"), (2, f"{two} x"), (3, f"{one} x")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r["class"]) for r in ngram_join.near_duplicates(short).collect()}
    assert [got[n][0] for n in (1, 2, 3)] == [1, 2, 1] and got[1][1] == got[3][1] != got[2][1]
    words = " ".join(f"v{n}" for n in range(20))
    row = quality_rules.repetition_rules(spark.createDataFrame([(1, f"{one} {words} {two}"), (2, f"{one} {words} {one} {words}")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.longest_repeat for r in row} == {1: 0, 2: 21}


def test_classes_of_equal_prints_are_told_by_their_checks(spark):
    sets = spark.createDataFrame([(5, 1, 10), (3, 1, 10), (4, 1, 11), (9, 2, 11)], "doc_id long, print long, check long")
    got = {(r["print"], r["check"]): (r["doc_id"], r["class"]) for r in ngram_join.name_classes(sets).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 10): 3, (1, 11): 4, (2, 11): 9} and len({v[1] for v in got.values()}) == 3
    # a chunk finds a class by both
    texts = ["one two three", "one two four"]
    block = next(textblocks.blocks(pa.array(texts)))
    value, first, check = ngram_join.shingle_sets(block, checks=True)
    one, two = ngram_join.set_prints(value, first, check)
    asked = exchange.table({"print": (one[:1], pa.int64()), "check": (two[1:], pa.int64()), "class": ([7], pa.int64())})
    rows = exchange.table({"text": (texts, pa.string())})
    assert ngram_join._Chunk(rows, asked, 5).classes == []
    assert ngram_join._Chunk(rows, asked.set_column(1, "check", pa.array(two[:1])), 5).classes == [7]


@pytest.fixture
def levels(monkeypatch):
    """Three levels of ranges, four senders a relay."""
    monkeypatch.setattr(exchange, "FAN", 4)
    monkeypatch.setattr(exchange, "LEAST_CHUNKS", 20)
    monkeypatch.setattr(exchange.Counted, "DENSE_BITS", 8)


def test_several_levels(spark, levels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert exchange.layout(docs).steps == [2, 2, 2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_removal(rows)
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert found == brute_components({d: shingles(t) for d, t in rows})


def test_ranges_follow_the_input():
    for words in (10**6, 10**9, 10**12, 2 * 10**13):
        ranges = 1 << (max(exchange.LEAST_RANGES, words // exchange.RANGE_VALUES) - 1).bit_length()
        plan = exchange.Layout(0, 64, ranges, words)
        assert words / ranges <= exchange.RANGE_VALUES * 1.01 and 2 ** sum(plan.steps) == ranges and max(plan.steps) <= 11


def test_rows_of_one_id_and_of_none(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(30)) for _ in range(40)]
    frame = spark.createDataFrame([(None if n % 2 else 7, t) for n, t in enumerate(texts)] + [(7, texts[0])], "doc_id long, text string")
    out = substring_dedup.remove_repeats(frame, size=4).collect()
    assert len(out) == 41 and sorted(r.n_removed for r in out) == sorted(r.n_removed for r in substring_dedup.remove_repeats(frame.orderBy("text"), size=4).collect())
    assert sum(r.doc_id == 7 and r.n_removed == 30 for r in out) >= 1
