"""The pipeline against its stages by brute force."""

import collections

import corpus_pipeline
from foliograph.llm import mixing, quality_rules

from .test_llm_operators import SF, brute_components, shingles, words_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    verdict = {r.doc_id: r.kept for r in quality_rules.repetition_rules(docs).collect()}
    kept = steps["quality_rules"](spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, k in verdict.items() if k}
    one = steps["ngram_jaccard_join"](spark, kept, SF)
    roots = brute_components({d: shingles(rows[d]) for d, k in verdict.items() if k})
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted({*roots.values()})
    clean = steps["benchmark_decontamination"](spark, one, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and not any(i in rows[d] for d in left for i in items) and len(left) > 0.8 * len({*roots.values()})
    mixed = steps["source_mixing"](spark, clean, SF)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(times) <= left and max(times.values()) <= 2
    assert times == {r.doc_id: r._mix.times for r in mixing.mix(clean).collect() if r._mix.times}
    words = sum(n * len(words_of(rows[d])) for d, n in times.items())
    whole = sum(len(words_of(rows[d])) for d in left)
    assert abs(words - 1.5 * whole) < 0.2 * whole
    final = steps["sharding"](spark, mixed, SF)
    slots = collections.defaultdict(list)
    for r in final.collect():
        slots[r.shard].append(r.slot)
    sizes = collections.Counter()
    for r in final.collect():
        sizes[r.shard] += len((r.text or "").encode()) + 1
    assert max(sizes.values()) - min(sizes.values()) <= max(len((r.text or "").encode()) for r in mixed.collect()) + 1
    assert collections.Counter(tuple(r[c] for c in columns) for r in final.collect()) == collections.Counter(tuple(r) for r in mixed.collect())
    assert final.count() == mixed.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run(spark):
    from pathlib import Path

    out = corpus_pipeline.run(spark, SF)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert len(list(shared.glob("pipeline-*"))) == 1  # the stages before the last but one are removed
    assert out.count() > 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
