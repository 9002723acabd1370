"""Decontamination keeps its edit budget at every length of an item."""

import random

import pytest

from foliograph.llm import decontamination

from .test_llm_operators import semi_global


@pytest.mark.parametrize("length", [8, 9, 10, 12, 15, 16, 19, 20, 21, 23, 24, 29, 30, 31, 32, 40])
def test_edits_of_short_items(spark, length):
    rng = random.Random(length)
    item = "".join(rng.choice("abcdefghij") for _ in range(length))
    texts = [item]
    for n in range(60):
        x = list(item)
        for _ in range(n % 6):
            p, how = rng.randrange(len(x)), rng.random()
            x[p : p + (how < 0.66)] = [] if how < 0.33 else [rng.choice("klmn")]
        texts.append("xyz " * (n % 3) + "".join(x) + " uvw" * (n % 2))
    rows = [(n, semi_global(item.encode(), t.encode())) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.edits for r in decontamination.contaminated(frame, bench).collect()}
    assert got == {n: e for n, e in rows if e <= int(decontamination.ERROR * length)}
