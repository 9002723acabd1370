"""Vectors in blocks: rows and stated queries meet as matrices in Arrow batches.

Rows are packed into blocks of `BLOCK` unit vectors of one length, queries into blocks of
`QUERY_BLOCK`; a task multiplies blocks and keeps each query's best rows, so the rows stay where
they are and only `k` of them a query and task are shuffled.  Similarities are compared to 12
decimals, so that equal vectors are equally near wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import materialise

BLOCK, QUERY_BLOCK, HELD = 1024, 2000, 4_000_000
DECIMALS = 12


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The length of each vector, and for every length the places and unit vectors of that length (null: length 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    first, out = np.cumsum(sizes) - sizes, []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = values[first[at][:, None] + np.arange(size)] if size else np.zeros((len(at), 0))
        out.append((size, at, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)))
    return sizes, out


def packed(rows: DataFrame, row_id: str, vector: str, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """(first, ids, matrix, size, kind): blocks of rows of one vector length (and one `by`), in the order of their ids."""
    kind = F.col(by).cast("string") if by else F.lit("")
    narrow = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("v"), kind.alias("kind")).where("id is not null")
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, kinds = batch.column(0), np.array(batch.column(2).to_pylist(), object)
            for size, at, x in unit_rows(batch.column(1))[1]:
                for name in dict.fromkeys(kinds[at].tolist()):
                    own = np.flatnonzero(kinds[at] == name)
                    order = own[np.argsort(np.array(ids.take(pa.array(at[own])).to_pylist()), kind="stable")]
                    for a in range(0, len(order), block):
                        part = order[a : a + block]
                        names = ids.take(pa.array(at[part]))
                        yield pa.RecordBatch.from_arrays(
                            [names.slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), names), pa.array([x[part].tobytes()], pa.binary()), pa.array([size], pa.int32()), pa.array([name], pa.string())],
                            names=["first", "ids", "matrix", "size", "kind"],
                        )

    return narrow.mapInArrow(run, f"first {id_type}, ids array<{id_type}>, matrix binary, size int, kind string")


def read_block(batch: pa.RecordBatch, n: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(batch.column(f"{side}ids")[n].as_py())
    return ids, np.frombuffer(batch.column(f"{side}matrix")[n].as_py(), np.float64).reshape(len(ids), batch.column(f"{side}size")[n].as_py())


def similarities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round(x @ y.T, DECIMALS) if x.shape[1] == y.shape[1] else np.zeros((len(x), len(y)))


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query number, id, similarity) the k best of each query, ties by id."""
    query, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    place = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
    return query[place < k], ids[place < k], score[place < k]


def nearest(rows: DataFrame, queries: DataFrame, k: int, vector: str, row_id: str, query_id: str, query_vector: str) -> DataFrame:
    """(query_id, id, similarity, rank): the ids of the k rows nearest to each stated query by cosine, ties by id."""
    standing = packed(rows, row_id, vector)
    asked = packed(queries, query_id, query_vector, block=QUERY_BLOCK)
    row_type, query_type = (df.schema["first"].dataType.simpleString() for df in (standing, asked))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("first", "ids", "matrix", "size")])
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        pairs = materialise(standing, "row-blocks").hint("shuffle_replicate_nl").join(materialise(asked, "query-blocks"))
    else:
        pairs = standing.join(F.broadcast(asked))  # at most QUERY_BLOCK queries
    schema = f"query_id {query_type}, id {row_type}, similarity double"

    def run(batches):
        held: dict[tuple, tuple] = {}

        def told():
            for ids, found in held.values():
                query, rows_of, score = _best(found, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(rows_of), pa.array(score)], names=["query_id", "id", "similarity"])

        for batch in batches:
            for n in range(batch.num_rows):
                (ids, x), (asked_ids, y) = read_block(batch, n, ""), read_block(batch, n, "q_")
                score = similarities(y, x)
                if len(ids) > k:  # all rows as near as the k-th, so that ties are cut by id
                    query, at = np.nonzero(score >= np.partition(score, len(ids) - k, axis=1)[:, [len(ids) - k]])
                else:
                    query, at = np.nonzero(np.ones(score.shape, bool))
                found = held.setdefault((asked_ids[0], y.shape[1]), (asked_ids, []))[1]
                found.append((query, ids[at], score[query, at]))
                if sum(len(f[0]) for f in found) > 4 * k * len(asked_ids):
                    found[:] = [_best(found, k)]
            if sum(len(f[0]) for _, found in held.values() for f in found) > HELD:
                yield from told()
                held.clear()
        yield from told()

    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def close_pairs(rows: DataFrame, row_id: str, vector: str, by: str, floor: float) -> DataFrame:
    """(a, b): all pairs of rows of one `by` with cosine at least `floor`, a before b."""
    one = materialise(packed(rows.where(F.col(by).isNotNull() & F.col(vector).isNotNull()), row_id, vector, by), "vector-blocks")
    other = one.select(*[F.col(c).alias(f"q_{c}") for c in one.columns])
    pairs = one.hint("shuffle_replicate_nl").join(other, (F.col("kind") == F.col("q_kind")) & (F.col("size") == F.col("q_size")) & (F.col("first") <= F.col("q_first")))
    id_type = one.schema["first"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                (a, x), (b, y) = read_block(batch, n, ""), read_block(batch, n, "q_")
                i, j = np.nonzero(similarities(x, y) >= floor)
                if a[0] == b[0]:
                    i, j = i[i < j], j[i < j]
                left, right = a[i], b[j]
                swap = left > right
                yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, right, left)), pa.array(np.where(swap, left, right))], names=["a", "b"])

    return pairs.mapInArrow(run, f"a {id_type}, b {id_type}")
