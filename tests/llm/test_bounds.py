"""Samples that never become empty, gradients, and searches in parts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograph.llm import decontamination, line_quality, secret_scan, textblocks

from .test_llm_operators import SF, semi_global


@pytest.mark.parametrize("total", [10**4, 10**6, 10**9, 10**10, 10**11, 10**14])
def test_sample_bound(total):
    """The expected size stays 3,000 however many rows there are, and the hash is uniform over its 64 bits."""
    bound = secret_scan.sample_bound(3000, total)
    assert abs((bound + (1 << 63)) / (1 << 64) * total - 3000) < 1e-3
    assert secret_scan.sample_bound(5, 5) == (1 << 63) - 1


def test_bounded_sample(spark):
    frame = spark.range(1_000_000)
    got = secret_scan.bounded_sample(frame, 3000, "id")
    assert 2700 < got.count() < 3300 and sorted(got.collect()) == sorted(secret_scan.bounded_sample(frame.repartition(3), 3000, "id").collect())
    assert secret_scan.bounded_sample(frame.limit(10), 3000, "id").count() == 10
    few = secret_scan.bounded_sample(frame, 3000, "id").select(F.xxhash64(F.lit("sample"), "id").alias("h")).agg(F.max("h")).first()[0]
    assert few < secret_scan.sample_bound(3000, 1_000_000)


def test_empty_samples_are_errors(spark, monkeypatch):
    docs = spark.createDataFrame([(n, "a line of words") for n in range(50)], "doc_id long, text string")
    monkeypatch.setattr(secret_scan, "sample_bound", lambda rows, total: -(1 << 63))
    with pytest.raises(ValueError, match="empty"):
        secret_scan.labelled_runs(docs, 10)
    with pytest.raises(ValueError, match="empty"):
        line_quality.fit(docs, docs.selectExpr("doc_id", "1 as quality"), sample_rows=10)


def test_crf_gradient():
    rng = np.random.default_rng(3)
    sizes = np.array([4, 1, 7, 2, 3])
    x, first = rng.normal(size=(sizes.sum(), line_quality.WIDTH)), np.concatenate(([0], np.cumsum(sizes)))
    label, weight, theta = np.array([0, 1, 1, 0, 1]), rng.random(5), rng.normal(size=line_quality.WIDTH + 4) * 0.3

    def at(point):
        return line_quality.objective(point, x, first, label, weight, 3e-4)

    gradient = at(theta)[1]
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert np.isclose((at(theta + step)[0] - at(theta - step)[0]) / 2e-5, gradient[k], atol=1e-6)
    best = line_quality.climb(at, theta, 300, enough=1e-12)
    assert at(best)[0] > at(theta)[0] and np.abs(at(best)[1]).max() < 1e-3


def test_crf_sample_is_bounded_in_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_quality, "train", lambda lines: seen.extend(len(x) for x, _ in lines))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    line_quality.fit(docs, labels, sample_lines=60)
    assert 0 < sum(seen) <= 60


def test_scores_by_brute_force():
    """A document's score is the mean, weighted by words, of its lines' marginals over all labellings."""
    rng = np.random.default_rng(8)
    theta = rng.normal(size=line_quality.WIDTH + 4)
    texts = ["One line of words.\n\n# two ### || signs\nthree", "", "a single line here", "x\ny z\nx\nw 1 2 3\n!!"]
    block = next(textblocks.blocks(pa.array(texts)))
    lines = line_quality.line_features(block)
    scores, _ = line_quality.document_scores(lines, theta)
    emit, move = lines.x.astype(float) @ theta[: line_quality.WIDTH], theta[line_quality.WIDTH :].reshape(2, 2)
    for n, text in enumerate(texts):
        a, b = lines.first[n], lines.first[n + 1]
        assert [len(x.split()) for x in text.split("\n") if x.split()] == lines.length[a:b].tolist()
        if a == b:
            assert scores[n] == 0
            continue
        paths = [[(k >> t) & 1 for t in range(b - a)] for k in range(1 << (b - a))]
        odds = np.exp([sum(emit[a + t] * s for t, s in enumerate(p)) + sum(move[p[t], p[t + 1]] for t in range(len(p) - 1)) for p in paths])
        marginal = [(odds * [p[t] for p in paths]).sum() / odds.sum() for t in range(b - a)]
        assert np.isclose(scores[n], np.average(marginal, weights=lines.length[a:b]))


@pytest.mark.parametrize("pairs", [1, 7, 50, 10**9])
def test_shared_grams_are_counted_in_parts(monkeypatch, pairs):
    rng = random.Random(2)
    items = ["the common words " * 3 + "".join(rng.choice("abcd") for _ in range(20)) for _ in range(6)] + ["the common words the common words"]
    texts = [rng.choice(items)[rng.randint(0, 2) :] + " the common words " * rng.randint(0, 4) for _ in range(25)] + ["", "nothing"]
    index = decontamination.build(list(enumerate(items)))
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    block = next(textblocks.blocks(pa.array(texts)))
    got = {(d, n): e for d, n, e, _, _ in decontamination.find(block, index)}
    want = {}
    for d, text in enumerate(texts):
        for n, item in enumerate(items):
            edits = semi_global(item.strip().encode(), " ".join(text.split()).encode())
            if edits <= int(decontamination.ERROR * len(item.strip())):
                want[d, n] = edits
    assert got == want and want


def test_benchmark_in_passes(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(decontamination.contaminated(docs, bench).collect())
    real = decontamination.query_passes
    monkeypatch.setattr(decontamination, "query_passes", lambda b, i, t: real(b, i, t, 500, 4000))
    assert len(list(real(bench, "item_id", "text", 500, 4000))) > 2
    assert sorted(decontamination.contaminated(docs, bench).collect()) == one and one
    clean = {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {r.doc_id for r in one}
