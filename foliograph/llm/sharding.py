"""Minimum-cost-flow resharding.

Old shards supply their bytes, new shards demand their capacities, and moving a byte costs
one unless it stays: a minimum-cost flow gives the transfers that move the fewest bytes.
Documents are dealt into hashed blocks of their old shard (`BLOCKS` in all for as many old
shards as new ones, whatever the input), and blocks are assigned to the flow's arcs, largest
first, so shards differ from their capacities by about one small block.

`reshard` gives every row its new shard and slot.  `rewrite_affected` changes the files: shards
that lose blocks are rewritten without them, shards that gain blocks get files beside their
own, and the rest is not touched.

Defined results: a null text has no bytes (size 1), a null source or old shard is one of its
own, repeated rows are separate rows in the same block, rows of one id but other texts part,
equal texts may part (sizes decide), an empty table gives an empty one; columns of the caller keep their values, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .running import bucket_count, bucket_offsets, sum_before
from .shared import remove_folder, written

SHARDS, BLOCKS, FILE_BYTES = 8, 8192, 256 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supply to each demand of least cost, by successive shortest paths.

    All supply is sent; the demands must sum up to it.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    ends: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, capacity: int, each: int) -> None:
        for x, y, c, e in ((a, b, capacity, each), (b, a, 0, -each)):
            out[x].append(len(ends))
            ends.append(y)
            room.append(c)
            price.append(e)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost[i][j])
    for j, d in enumerate(demand):
        arc(n + j, sink, d, 0)
    while True:
        far: list[float] = [float("inf")] * (n + m + 2)
        via = [-1] * (n + m + 2)
        far[source] = 0
        changed = [source]
        while changed:
            following = []
            for a in changed:
                for e in out[a]:
                    if room[e] and far[a] + price[e] < far[ends[e]]:
                        far[ends[e]], via[ends[e]] = far[a] + price[e], e
                        following.append(ends[e])
            changed = following
        if via[sink] < 0:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = ends[via[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in out[i]:
            if e % 2 == 0 and n <= ends[e] < n + m:
                flow[i][ends[e] - n] += room[e ^ 1]
    return flow


def capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def transfers(sizes: dict[tuple[int, int], int], new: list[int]) -> dict[tuple[int, int], int]:
    """The new shard of each block (old shard, block), from the blocks' sizes and the new capacities.

    The capacities sum up to all sizes; an old shard with a number below the new count stays where it can.
    """
    olds = sorted({old for old, _ in sizes})
    supply = [sum(size for (o, _), size in sizes.items() if o == old) for old in olds]
    flow = min_cost_flow(supply, new, [[int(old != j) for j in range(len(new))] for old in olds])
    by_old: dict[int, list] = defaultdict(list)
    for (old, block), size in sizes.items():
        by_old[old].append((-size, block))
    out = {}
    for n, old in enumerate(olds):
        left = list(flow[n])
        least = min(-size for size, _ in by_old[old])
        for j, f in enumerate(left):
            if j != old < len(new) and 2 * f < least:  # no block comes nearer to it than none
                left[old], left[j] = left[old] + f, 0
        open_to = [j for j, f in enumerate(left) if f > 0] or [min(old, len(new) - 1)]
        for size, block in sorted(by_old[old]):
            j = max(open_to, key=lambda j: (left[j], j == old))
            left[j] += size
            out[old, block] = j
    return out


def by_source(df: DataFrame, source_col: str = "source", shards: int = SHARDS) -> Column:
    """An old layout that keeps every source in one shard."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")), "utf-8")), F.lit(shards)).cast("int")


@dataclass
class Placement:
    """Rows with their old shard, block and part of a block, and the new shard of each block."""

    rows: DataFrame
    names: list[str]
    sums: DataFrame
    sizes: dict[tuple[int, int], int]
    counts: dict[tuple[int, int], int]
    chosen: dict[tuple[int, int], int]
    parts: int


def place_blocks(df: DataFrame, old_shard: Column, shards: int, id_col: str, text_col: str, new: list[int] | None) -> Placement:
    """Deals rows into blocks and finds the blocks' new shards.  Reads the texts once."""
    names = size, crc, old, block, part, _ = tb.unused(df, "_size", "_crc", "_old", "_block", "_part", "_key")
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "utf-8")
    each, ident = max(1, BLOCKS // shards), F.col(f"`{id_col}`")
    parts = max(1, bucket_count(df.count()) // BLOCKS)
    rows = df.withColumns({size: (F.octet_length(text) + 1).cast("long"), crc: F.crc32(text), old: F.coalesce(old_shard.cast("int"), F.lit(-1))})
    rows = rows.withColumns({block: F.pmod(F.xxhash64(ident, crc), F.lit(each)).cast("int"), part: F.pmod(F.xxhash64(F.lit(29), ident, crc), F.lit(parts)).cast("int")})
    sums = written(rows.groupBy(F.col(old).alias("old"), F.col(block).alias("block"), F.col(part).alias("part")).agg(F.sum(size).alias("size"), F.count("*").alias("n")), "block-sums")
    found = sums.groupBy("old", "block").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()  # BLOCKS / shards rows an old shard
    sizes = {(r["old"], r["block"]): r["size"] for r in found}
    chosen = transfers(sizes, capacities(sum(sizes.values()), shards) if new is None else new)
    return Placement(rows, names, sums, sizes, {(r["old"], r["block"]): r["n"] for r in found}, chosen, parts)


def reshard(df: DataFrame, old_shard: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", new: list[int] | None = None) -> DataFrame:
    """`df` with the struct `_shard` (size, text_crc32, law, old_shard, shard, slot, grown_shard).

    `new` holds the new capacities in bytes (default: equal); `slot` numbers the rows of a shard from 0.
    The struct's name has underscores added while `df` has a column of that name.
    """
    spark, out = df.sparkSession, tb.unused(df, "_shard")[0]
    placed = place_blocks(df, old_shard, shards, id_col, text_col, new)
    size, crc, old, block, part, key = placed.names
    base, table = defaultdict(int), []
    for (o, b), shard in sorted(placed.chosen.items()):
        table.append((o, b, shard, base[shard]))
        base[shard] += placed.counts[o, b]
    blocks = F.broadcast(spark.createDataFrame(table, "old int, block int, shard int, first long"))  # BLOCKS / shards rows an old shard
    offsets = bucket_offsets(placed.sums, ["old", "block"], "part", "n", placed.parts, "offset").join(blocks, ["old", "block"])
    offsets = offsets.select(F.struct("old", "block", "part", "shard", (F.col("first") + F.col("offset")).alias("first")).alias(key))
    one = placed.rows.withColumn(out, F.lit(1))
    ranked = one.withColumn(out, sum_before(out, [old, block, part], F.xxhash64(F.lit(31), f"`{id_col}`", crc), f"`{id_col}`", crc))
    same = (F.col(old) == F.col(f"{key}.old")) & (F.col(block) == F.col(f"{key}.block")) & (F.col(part) == F.col(f"{key}.part"))
    digest = F.struct(
        F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.lit("bytes").alias("law"), F.nullif(F.col(old), F.lit(-1)).alias("old_shard"),
        F.col(f"{key}.shard").alias("shard"), (F.col(f"{key}.first") + F.col(out)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
    return ranked.join(offsets, same).select(*[F.col(f"`{c}`") for c in df.columns], digest.alias(out))


def rewrite_affected(spark: SparkSession, path: str, shards: int, staging: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Reshard the Parquet folders `shard=K` under `path`; returns the shards whose files changed.

    Only shards that lose blocks are read again: what moves and what stays of them is written to
    `staging`, then a list of the changes, and only then folders change by renames.  A run that was
    interrupted is finished by the next one from that list; before the list is whole, `path` is
    as it was.  Folders of shards that are no more go.  `staging` must be in the file system of `path`.
    """
    affected = set(_finish(spark, path, staging))
    remove_folder(spark, staging)
    layout = spark.read.parquet(path)
    columns = [c for c in layout.columns if c != "shard"]
    placed = place_blocks(layout, F.col("shard"), shards, id_col, text_col, None)
    _, _, old, block, _, key = placed.names
    new, what = tb.unused(placed.rows, "shard_", "_what")
    moves = {(o, j) for (o, b), j in placed.chosen.items() if o != j}
    losers, gains = sorted({o for o, _ in moves}), sorted({j for _, j in moves})
    if not losers:
        return sorted(affected)
    table = spark.createDataFrame([(o, b, j) for (o, b), j in placed.chosen.items()], "old int, block int, new int").select(F.struct("*").alias(key))
    rows = placed.rows.where(F.col("shard").isin(losers)).join(F.broadcast(table), (F.col(old) == F.col(f"{key}.old")) & (F.col(block) == F.col(f"{key}.block")))
    rows = rows.withColumns({new: F.col(f"{key}.new"), what: F.when(F.col(old) == F.col(f"{key}.new"), "stays").otherwise("moves")})
    files = 1 + sum(size for (o, _), size in placed.sizes.items() if o in losers) // FILE_BYTES
    dealt = rows.repartition(max(len(losers) + len(gains), int(files)), what, new, F.pmod(F.col(block), F.lit(int(files))))
    dealt.select(*columns, F.col(what).alias("what"), F.col(new).alias("shard")).write.partitionBy("what", "shard").parquet(f"{staging}/files")
    expected = sum(n for (o, _), n in placed.counts.items() if o in losers)
    if spark.read.parquet(f"{staging}/files").count() != expected:
        raise RuntimeError(f"{staging} does not hold the {expected} rows that were read; {path} is as it was")
    changes = [("stays", o) for o in losers] + [("moves", j) for j in gains]
    spark.createDataFrame(changes, "what string, shard int").coalesce(1).write.json(f"{staging}/changes")
    return sorted(affected | set(_finish(spark, path, staging)))


def _finish(spark: SparkSession, path: str, staging: str) -> list[int]:
    """Makes the changes that `staging` lists, as far as they are not made; the shards concerned."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at(f"{staging}/changes/_SUCCESS")):
        return []
    changes = sorted((r["what"], r["shard"]) for r in spark.read.schema("what string, shard int").json(f"{staging}/changes").collect())
    for shard in (s for what, s in changes if what == "stays"):
        own, gone, ready = (at(f"{x}/shard={shard}") for x in (path, f"{staging}/gone", f"{staging}/files/what=stays"))
        if not system.exists(gone):
            system.mkdirs(at(f"{staging}/gone"))
            system.rename(own, gone)
        if system.exists(ready):
            system.rename(ready, own)
    for shard in (s for what, s in changes if what == "moves"):
        ready = at(f"{staging}/files/what=moves/shard={shard}")
        system.mkdirs(at(f"{path}/shard={shard}"))
        for file in system.listStatus(ready) if system.exists(ready) else []:
            system.rename(file.getPath(), at(f"{path}/shard={shard}/{file.getPath().getName()}"))
    remove_folder(spark, staging)
    return sorted({s for _, s in changes})
