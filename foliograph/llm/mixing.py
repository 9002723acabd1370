"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's words, in a seeded order of its documents, are cut into blocks of equal
length.  The blocks of the mix are the seats: each goes to the source with the highest
quotient target / (2 * seats + 1).  The seats are dealt to the shards of the mix in that
order, so every shard has an integer quota of each source's blocks, near the targets' shares,
and the quotas of all shards sum up to the source's seats.

Every source's blocks stand in a seeded order: block x of n stands at (step * x + shift) mod n.
The shards take their quotas from that order one after another, from its beginning again
where it ends.  So which blocks a document's words are in, and how often those are taken, is
a count over a range of numbers (a sum of floors), and no list of blocks is needed.

Targets share `share` times all words by weight; no target exceeds `most` times its
source's words, and the excess is shared again by weight.

Defined results: a null text has no words, a null source is a source of its own (the
last), documents without words take nothing, repeated rows each take their part, an empty
table gives an empty one; columns of the caller keep their values, whatever their names.  The table
of sources (one row per source, not per document) is held by the driver.
"""

from __future__ import annotations

import heapq
import zlib
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .running import bucket_count, bucket_offsets, sum_before
from .shared import written

WEIGHTS, SHARE, MOST, SHARDS, SEED = (5, 2, 1), 1.5, 2, 8, 13
#: Blocks that the smallest target is cut into, at least.
LEAST_BLOCKS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's target: shares by weight of `share` times all words, at most `most` times its own."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in set(free))
        scale = left / sum(weights[i] for i in free)
        above = [i for i in free if scale * weights[i] > most * sizes[i]]
        for i in above or free:
            out[i] = float(most * sizes[i]) if above else scale * weights[i]
        if not above:
            break
        gone = set(above)
        free = [i for i in free if i not in gone]
    return out


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2 * seats + 1), ties to the earlier."""
    total, n = sum(weights), len(weights)
    if total <= 0 or seats <= 0:
        return [0] * n
    out = [0] * n
    if seats > 2 * n:  # the seats that a larger divisor gives are the first of the highest quotients
        divisor = total / (seats - n)
        out = [int(w / divisor + 0.5) for w in weights]
    queue = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, out, strict=True)) if w > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(queue)
        out[i] += 1
        heapq.heappush(queue, (-weights[i] / (2 * out[i] + 1), i))
    return out


def shard_quotas(weights: list[float], seats: int, shards: int, most: list[int]) -> list[list[int]]:
    """How many seats each source has when the first 0, 1, ... `shards` shards are full (one list per source, at most `most`).

    Sainte-Lague seats only grow with their number, so the differences are the shards' quotas.
    """
    filled = [sainte_lague(weights, seats * j // shards) for j in range(shards + 1)]
    return [[min(f[i], most[i]) for f in filled] for i in range(len(weights))]


def plan(sizes: list[int], weights: list[float], names: list[str | None], share: float = SHARE, most: float = MOST, seed: int = SEED, shards: int = SHARDS) -> list[dict]:
    """For each source: target, seats after each shard (`cuts`), block length, number of blocks, and their seeded order."""
    goal = targets(sizes, weights, share, most)
    block = max(1, int(min((g for g in goal if g > 0), default=0) // LEAST_BLOCKS))
    blocks = [-(-size // block) for size in sizes]
    cuts = shard_quotas(goal, round(sum(goal) / block), shards, [int(most * b) for b in blocks])
    rows = []
    for name, size, target, n, cut in zip(names, sizes, goal, blocks, cuts, strict=True):
        step = 1 + zlib.crc32(f"step:{seed}:{name}".encode()) * max(1, n) // (1 << 32)
        while n and gcd(step, n) > 1:
            step += 1
        shift = zlib.crc32(f"shift:{seed}:{name}".encode()) * n // (1 << 32)
        rows.append({"source": name, "source_size": size, "target": target, "block": block, "blocks": n, "step": step, "shift": shift, "cuts": cut})
    return rows


def floor_sum(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of (a * x + b) // m over x from 0 to n - 1, for arrays of non-negative numbers."""
    total = n * 0
    while (n > 0).any():
        m = np.where(m == 0, 1, m)
        total = total + n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        n, b, m, a = np.where(a == 0, 0, top // m), top % m, a, m
    return total


def taken_words(at, size, block, blocks, step, shift, seats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words taken of a document at `at`, how often its middle word's block is taken, and that block's place in the order."""
    n = np.maximum(blocks, 1)
    passes, run = seats // n, seats % n

    def place(x):
        return (step * x + shift) % n

    def chosen(x):  # blocks before x whose place is in the run
        return floor_sum(x, n, step, shift + n) - floor_sum(x, n, step, shift - run + n)

    first, last = at // block, (at + np.maximum(size, 1) - 1) // block
    head = np.where(first == last, size, (first + 1) * block - at)
    tail = np.where(first == last, 0, at + size - last * block)
    between = np.where(last > first + 1, chosen(np.where(last > first, last, 0)) - chosen(np.where(last > first, first + 1, 0)), 0)
    words = passes * size + head * (place(first) < run) + tail * (place(last) < run) + between * block
    middle = place((at + size // 2) // block)
    return np.where(size > 0, words, 0), np.where(size > 0, passes + (middle < run), 0), middle


def _taken(at: pd.Series, size: pd.Series, block: pd.Series, blocks: pd.Series, step: pd.Series, shift: pd.Series, seats: pd.Series) -> pd.DataFrame:
    kind = np.int64 if not len(blocks) or int(blocks.max()) < 1 << 30 else object  # whole numbers of any size
    taken, times, place = taken_words(*(c.to_numpy().astype(kind) for c in (at, size, block, blocks, step, shift, seats)))
    return pd.DataFrame({"taken": taken.astype(np.int64), "times": times.astype(np.int64), "place": place.astype(np.int64)})


def mix(
    df: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shards: int = SHARDS,
) -> DataFrame:
    """`df` with the struct `_mix` (size, source_size, target, taken, start, times, shard) for each row.

    Sources in code-point order, null last, weigh `weights`, repeating.  `start` counts the words of the
    row's source before it; `times` is how often the block of its middle word is taken, `shard` the first
    shard that takes it (null: none).  The struct's name has underscores added while `df` has such a column.
    """
    spark = df.sparkSession
    out, size, source, key, bucket, at, found = tb.unused(df, "_mix", "_size", "_source", "_key", "_bucket", "_at", "_found")
    buckets, text, ident = bucket_count(df.count()), F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    count = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = df.withColumns({size: count, source: F.col(f"`{source_col}`").cast("string"), key: F.xxhash64(F.lit(seed), ident, text)})
    sized = sized.withColumn(bucket, F.pmod(F.col(key), F.lit(buckets)))
    sums = written(sized.groupBy(F.col(source).alias("source"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("size")), "source-sums")
    totals = sums.groupBy("source").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    plans = plan([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], [r["source"] for r in totals], share, most, seed, shards)
    schema = "source string, source_size long, target double, block long, blocks long, step long, shift long, cuts array<long>"
    columns = schema.replace("array<long>", "").split()[::2]
    table = spark.createDataFrame([tuple(p[k] for k in columns) for p in plans], schema).withColumnRenamed("source", "_of")
    offsets = bucket_offsets(sums, ["source"], "bucket", "size", buckets, "offset")
    offsets = offsets.join(F.broadcast(table) if len(plans) <= 10_000 else table, F.col("source").eqNullSafe(F.col("_of")))
    offsets = offsets.select(F.struct(*[c for c in offsets.columns if c not in ("size", "_of")]).alias(found))
    placed = sized.withColumn(at, sum_before(size, [source, bucket], key, ident, size))
    joined = placed.join(offsets, F.col(source).eqNullSafe(F.col(f"{found}.source")) & (F.col(bucket) == F.col(f"{found}.bucket")))
    joined = joined.withColumn(at, F.col(at) + F.col(f"{found}.offset"))
    seats = F.element_at(f"{found}.cuts", -1)
    counted = joined.withColumn(key, F.pandas_udf(_taken, "taken long, times long, place long")(at, size, *[f"{found}.{c}" for c in ("block", "blocks", "step", "shift")], seats))
    shard = F.when((F.col(size) > 0) & (F.col(f"{key}.place") < seats), F.size(F.filter(f"{found}.cuts", lambda c: c <= F.col(f"{key}.place"))) - 1)
    digest = F.struct(
        F.col(size).alias("size"), F.col(f"{found}.source_size").alias("source_size"), F.col(f"{found}.target").alias("target"), F.col(f"{key}.taken").alias("taken"),
        F.col(at).alias("start"), F.col(f"{key}.times").alias("times"), shard.alias("shard"),
    )
    return counted.select(*[F.col(f"`{c}`") for c in df.columns], digest.alias(out))


def mixed_rows(df: DataFrame, **settings) -> DataFrame:
    """The rows of `df`, each as often as the mix takes the block of its middle word."""
    out, n = tb.unused(df, "_mix", "_n")
    mixed = mix(df, **settings).where(F.col(f"{out}.times") > 0)
    return mixed.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(f"{out}.times").cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])
