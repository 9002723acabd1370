"""Connected components, and the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes that a task joins before it passes on what it has, and edges that one task may finish alone.
TASK_NODES, ONE_TASK_EDGES = 1_000_000, 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; with a local master, where it is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='foliograph-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage is cut, and lost executors lose nothing."""
    return _written(df, _new_path(df.sparkSession, name))


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables that are written on the way to a result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(_new_path(self.spark, name))
        return _written(df, self.paths[-1])

    def clear(self) -> None:
        while self.paths:
            remove_folder(self.spark, self.paths.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables written here are removed at the end; nothing that is read later may depend on them."""
    made = Scratch(spark)
    try:
        yield made
    finally:
        made.clear()


class _Forest:
    """Union-find over any long ids; the root of a tree is its least node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b, strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def trees(self) -> pa.RecordBatch:
        nodes = list(self.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(n) for n in nodes], pa.int64())], names=["a", "b"])


def _contracted(edges: DataFrame, nodes: int | None = TASK_NODES) -> DataFrame:
    """(a, b): every task's edges as trees of depth one, b the least node; a = b for the roots."""

    def run(batches):
        forest = _Forest()
        for batch in batches:
            forest.join(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if nodes and len(forest.parent) > nodes:
                yield forest.trees()
                forest = _Forest()
        yield forest.trees()

    return edges.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, most_rounds: int = 60, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected `edges` (a long, b long) of different ends.

    Every task first joins its own edges, which leaves at most one edge a node and task.  Up to
    `one_task_edges` of those are then finished by one task.  More are settled in rounds: every
    node takes the least label of its neighbours, labels hang themselves under the least label
    around their nodes, and every node jumps to its label's label, so paths shorten by half or
    more.  Labels only fall; the rounds end when none did.
    """
    with scratch(edges.sparkSession) as made:
        trees = made.written(_contracted(edges.where("a <> b").select("a", "b")).where("a <> b"), "trees")
        if trees.limit(one_task_edges + 1).count() <= one_task_edges:
            return materialise(_contracted(trees.coalesce(1), None).select(F.col("a").alias("node"), F.col("b").alias("root")), "labels")
        trees = trees.distinct()
        both = made.written(trees.union(trees.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
        rounds = Scratch(edges.sparkSession)
        labels, known = rounds.written(first, "labels"), None
        for _ in range(most_rounds):
            near = both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "root")
            own = labels.select("node", "root")
            around = near.union(own).groupBy("node").agg(F.min("root").alias("root"))
            hooks = around.join(own.withColumnRenamed("root", "old"), "node").where("root < old").select(F.col("old").alias("node"), "root")
            lower = around.union(hooks).groupBy("node").agg(F.min("root").alias("root"))
            jump = lower.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
            once = lower.join(jump, lower["root"] == jump["_at"], "left").select("node", F.coalesce("_to", "root").alias("root"))
            following = Scratch(edges.sparkSession)
            known = following.written(once.join(own.withColumnRenamed("root", "old"), "node"), "labels")
            moved = known.where("root < old").limit(1).count()
            rounds.clear()
            rounds, labels = following, known.select("node", "root")
            if not moved:
                return labels
        rounds.clear()
    raise RuntimeError("components did not settle")
