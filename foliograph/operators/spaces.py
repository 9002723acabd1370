"""Smart spaces: clustering, sub-spaces, labels and membership."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.constants import MERGE_COSINE, SPACE_STYLES
from .components import materialise
from .filters import is_placeholder_label

ROUNDS, SUB_LEAST_DOCS, SUB_LEAST_SIZE = 20, 50, 3
#: Numbers in the vectors that seeds are chosen from (32 MB).
SEED_VALUES = 4_000_000


def auto_k(n: int, sub: bool = False) -> int:
    """The number of clusters: half away from zero of sqrt(n / 2) in 2..20; truncated and unbounded for sub-spaces."""
    if sub:
        return max(2, int((n / 2) ** 0.5))
    return 1 if n <= 1 else int(min(20, max(2, np.floor((n / 2) ** 0.5 + 0.5))))


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The most similar centroid of each vector, to 12 decimals, the lowest of equals."""
    return np.round(x @ centroids.T, 12).argmax(1)


def _assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster): the most similar centroid, the lowest of equals.  Vectors meet the k centroids in Arrow batches."""

    def run(batches):
        for part in batches:
            x = np.array(part["vector"].tolist()).reshape(-1, centroids.shape[1])
            yield pd.DataFrame({"id": part["id"], "cluster": nearest_centroid(x, centroids)})

    return vectors.mapInPandas(run, "id long, cluster int")


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """Per cluster: size, a print of its members, and the sum of its vectors, summed per batch before the shuffle."""

    def run(batches):
        for part in batches:
            x = np.array(part["vector"].tolist()).reshape(-1, centroids.shape[1])
            best = nearest_centroid(x, centroids)
            ids = (part["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
            rows = [(j, int((best == j).sum()), int(ids[best == j].sum() & np.uint64((1 << 62) - 1)), x[best == j].sum(0)) for j in np.unique(best)]
            yield pd.DataFrame(rows, columns=["cluster", "n", "print", "sum"])

    parts = vectors.mapInPandas(run, "cluster int, n long, print long, sum array<double>")
    dims = [F.sum(F.get("sum", F.lit(d))) for d in range(centroids.shape[1])]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.bit_xor("print").alias("print"), F.array(*dims).alias("sum")).collect()


def seed_rows(dimensions: int) -> int:
    """How many vectors seeds are chosen from: as many as have `SEED_VALUES` numbers."""
    return max(1, SEED_VALUES // max(1, dimensions))


def pick_seeds(x: np.ndarray, k: int, init: str) -> np.ndarray:
    """k starting centroids of unit vectors in the order of their ids, from the first one on.

    `reference` takes next the vector least like its least like seed (which may repeat);
    `farthest_first` the one least like its most like seed; the first of equals.
    """
    chosen, likes = [0], x @ x[0]
    while len(chosen) < k:
        chosen.append(int(np.round(1 - likes, 12).argmax()))
        like = x @ x[chosen[-1]]
        likes = np.minimum(likes, like) if init == "reference" else np.maximum(likes, like)
    return x[chosen].copy()


def _moved(centroids: np.ndarray, sums: dict[int, tuple[int, np.ndarray]]) -> None:
    for j, (n, total) in sums.items():
        mean = total / n
        length = np.linalg.norm(mean)
        centroids[j] = mean / length if length else mean


def cluster(x: np.ndarray, k: int, init: str, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after at most `rounds` rounds, or when no vector changed its cluster, and each vector's cluster."""
    centroids, before = pick_seeds(x, k, init), None
    for _ in range(rounds):
        label = nearest_centroid(x, centroids)
        if before is not None and (label == before).all():
            break
        before = label
        _moved(centroids, {int(j): (int((label == j).sum()), x[label == j].sum(0)) for j in np.unique(label)})
    return centroids, nearest_centroid(x, centroids)


def _sample(vectors: DataFrame, n: int, most: int) -> np.ndarray:
    """The vector of least id and about `most` others, all if there are no more, in the order of their ids."""
    bound = min((1 << 63) - 1, -(1 << 63) + (most << 64) // n)
    some = vectors if n <= most else vectors.where(F.xxhash64(F.lit("seed"), "id") < F.lit(bound)).union(vectors.orderBy("id").limit(1)).distinct()
    rows = some.collect()  # at most about SEED_VALUES numbers
    return np.array([r["vector"] for r in sorted(rows, key=lambda r: r["id"])])


def kmeans(rows: DataFrame, k: int | None = None, init: str = "reference", rounds: int = ROUNDS) -> DataFrame:
    """(id, space_id): cosine k-means over unit vectors; empty clusters keep their centroid and drop out.

    `rows` has long id and vector `embedding`.  Seeds are chosen from a bounded sample (`seed_rows`); where that
    is all vectors, the rounds run on it as well, otherwise each is one aggregation of k sums, and
    only they reach the driver.
    """
    vectors = materialise(rows.select("id", V.normalise(F.col("embedding")).alias("vector")), "vectors")
    n = vectors.count()
    k = auto_k(n) if k is None else k
    if n <= k:
        place = F.row_number().over(Window.orderBy("id")) - 1  # no more rows than clusters
        return vectors.select("id", F.concat(F.lit("space-"), place).alias("space_id"))
    most = seed_rows(len(vectors.first()["vector"]))
    sample = _sample(vectors, n, most)
    if n <= most:
        centroids = cluster(sample, k, init, rounds)[0]
    else:
        centroids, before = pick_seeds(sample, k, init), None
        for _ in range(rounds):
            sums = _sums(vectors, centroids)
            now = {r["cluster"]: (r["n"], r["print"]) for r in sums}
            if now == before:
                break
            before = now
            _moved(centroids, {r["cluster"]: (r["n"], np.array(r["sum"])) for r in sums})
    return _assign(vectors, centroids).select("id", F.concat(F.lit("space-"), F.col("cluster")).alias("space_id"))


def centroids_of(rows: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(space_id, centroid, n): mean vectors, summed before the shuffle."""
    joined = members.join(rows.select("id", "embedding"), "id")
    mean = F.array(*[F.avg(F.get(V.as_doubles(F.col("embedding")), F.lit(d))) for d in range(size)])
    return joined.groupBy("space_id").agg(mean.alias("centroid"), F.count("*").alias("n"))


def sub_spaces(rows: DataFrame, members: DataFrame, least_docs: int = SUB_LEAST_DOCS, least_size: int = SUB_LEAST_SIZE, block: int | None = None) -> DataFrame:
    """(id, space_id, sub_id): parents of more than `least_docs` documents cluster again; small clusters go to `misc`.

    Sub-spaces are numbered from 0 in the order of their clusters.  A parent whose vectors are all in the sample that
    seeds are chosen from (`seed_rows`) clusters in one task, a larger one by the distributed loop, with the same result.
    """
    sizes = members.groupBy("space_id").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    joined = members.join(sizes, "space_id").join(rows.select("id", "embedding"), "id")
    first = rows.select("embedding").where("embedding is not null").first()
    block = seed_rows(len(first["embedding"]) if first else 1) if block is None else block

    def named(parent: str, label: np.ndarray, counts: dict[int, int]) -> list[str]:
        number = {j: i for i, j in enumerate(j for j in sorted(counts) if counts[j] >= least_size)}
        return [f"{parent}-sub-{number[j]}" if j in number else f"{parent}-misc" for j in label.tolist()]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.array(part["embedding"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        label = cluster(x, min(auto_k(len(x), True), len(x)), "farthest_first")[1]
        parent = part["space_id"].iloc[0]
        return pd.DataFrame({"id": part["id"], "space_id": parent, "sub_id": named(parent, label, dict(zip(*np.unique(label, return_counts=True), strict=True)))})

    schema = "id long, space_id string, sub_id string"
    out = joined.where(F.col("n") <= block).select("id", "space_id", "embedding").groupBy("space_id").applyInPandas(run, schema)
    for r in sizes.where(F.col("n") > block).orderBy("space_id").collect():  # at most rows / block parents
        own = kmeans(joined.where(F.col("space_id") == r["space_id"]), auto_k(r["n"], True), "farthest_first")
        own = own.withColumn("_c", F.substring_index("space_id", "-", -1).cast("int"))
        counts = {c["_c"]: c["n"] for c in own.groupBy("_c").agg(F.count("*").alias("n")).collect()}  # one row a cluster
        names = named(r["space_id"], np.array(sorted(counts)), counts)
        table = rows.sparkSession.createDataFrame(list(zip(sorted(counts), names, strict=True)), "_c int, sub_id string")
        out = out.union(own.join(table, "_c").select("id", F.lit(r["space_id"]).alias("space_id"), "sub_id"))
    return out


def fingerprints(members: DataFrame) -> DataFrame:
    """(space_id, fingerprint, n): the first 16 hex digits of SHA-256 over a space's sorted ids, one a line.

    A space's ids are sorted by Spark and hashed as they pass by, so a task holds none of them.
    """
    ids = members.select("space_id", F.col("id").cast("string").alias("id"))
    ordered = ids.repartition("space_id").sortWithinPartitions("space_id", F.encode("id", "utf-8"))

    def run(batches):
        space, digest, n = None, hashlib.sha256(), 0
        for batch in batches:
            out = []
            for name, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != space and n:
                    out.append((space, digest.hexdigest()[:16], n))
                    digest, n = hashlib.sha256(), 0
                space, n = name, n + 1
                digest.update(f"{doc}\n".encode())
            yield _print_rows(out)
        yield _print_rows([(space, digest.hexdigest()[:16], n)] if n else [])

    return ordered.mapInArrow(run, "space_id string, fingerprint string, n long")


def _print_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["space_id", "fingerprint", "n"])


def membership_change(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(space_id, changed, united): members added or removed, and in either, by counting rows, never lists."""
    both = previous.select("space_id", "id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(current.select("space_id", "id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    one = both.groupBy("space_id", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return one.groupBy("space_id").agg(F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count("*").alias("united"), F.sum("a").alias("was"))


def label_plan(current: DataFrame, previous: DataFrame, cache: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """(space_id, decision): what to do with each cluster's label.

    Locked labels stay; placeholders are made anew; labels stay while at most a fifth of the
    members changed; clusters without a label take that of a space at cosine 0.75 or more
    (`nearest`: space_id, similarity), or a new one.
    """
    spaces = current.select("space_id").distinct()
    change = membership_change(previous, current)
    out = spaces.join(cache.select("space_id", "label", "user_locked"), "space_id", "left").join(change, "space_id", "left")
    if nearest is not None:
        out = out.join(nearest.select("space_id", "similarity"), "space_id", "left")
    else:
        out = out.withColumn("similarity", F.lit(None).cast("double"))
    decision = (
        F.when(F.col("user_locked"), "skip").when(F.col("label").isNull(), F.when(F.col("similarity") >= MERGE_COSINE, "bootstrap").otherwise("llm"))
        .when(is_placeholder_label(F.col("label")), "llm").when((5 * F.col("changed")) <= F.col("united"), "skip").otherwise("llm")
    )
    return out.select("space_id", decision.alias("decision"))


def stale_labels(cache: DataFrame, current: DataFrame) -> DataFrame:
    return cache.join(current.select("space_id").distinct(), "space_id", "left_anti")


def nearest_previous(now: DataFrame, before: DataFrame) -> DataFrame:
    """(space_id, previous_id, similarity): each centroid's nearest earlier one.  Both are tables of spaces, at most k rows."""
    b = before.select(F.col("space_id").alias("previous_id"), F.col("centroid").alias("_c"))
    pairs = now.select("space_id", "centroid").join(F.broadcast(b)).withColumn("similarity", V.cosine(F.col("centroid"), F.col("_c")))
    best = F.max_by(F.struct("previous_id", "similarity"), F.struct("similarity", F.col("previous_id")))
    return pairs.groupBy("space_id").agg(best.alias("b")).select("space_id", "b.*")


def canonical_hint(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(space_id, hint): the most counted entity value, the smallest of equals, where it reaches a fifth of the documents."""
    w = Window.partitionBy("space_id").orderBy(F.desc("n"), "value")
    top = values.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return top.join(sizes, "space_id").where(F.col("n") >= F.floor((F.col("docs") + 4) / 5)).select("space_id", F.col("value").alias("hint"))


def label_collisions(labels: DataFrame) -> DataFrame:
    """Labels with `collides`: equal to another but for case and blanks."""
    key = F.lower(T.collapse(F.col("label")))
    return labels.withColumn("collides", F.count("*").over(Window.partitionBy(key)) > 1)


def resolve_collisions(labels: DataFrame) -> DataFrame:
    """Colliding labels with a suffix: the hint, or the space's number."""
    number = F.regexp_extract("space_id", "([0-9]+)$", 1).try_cast("int") + 1
    suffix = F.coalesce(F.col("hint"), number.cast("string"))
    return label_collisions(labels).withColumn("label", F.when(F.col("collides"), T.suffix_label(F.col("label"), suffix)).otherwise(F.col("label")))


def name_signals(docs: DataFrame) -> DataFrame:
    """(space_id, n, top_entity, top_type, segments): what naming rules look at.

    `docs`: space_id, doc_id, doc_type, path, entity_types (array).
    """
    def top(rows: DataFrame, key: str, out: str) -> DataFrame:
        counts = rows.groupBy("space_id", key).agg(F.count("*").alias("n"))
        w = Window.partitionBy("space_id").orderBy(F.desc("n"), key)
        return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("space_id", F.col(key).alias(out))

    kinds = docs.select("space_id", F.explode("entity_types").alias("kind")).withColumn("kind", F.lower("kind")).where(~F.col("kind").isin("person", "organization", "location"))
    types = docs.select("space_id", F.lower("doc_type").alias("type")).where("type is not null")
    parts = docs.select("space_id", "doc_id", F.explode(F.array_distinct(F.transform(F.split(F.lower("path"), "/"), lambda s: F.trim(s)))).alias("segment")).where("octet_length(segment) > 2")
    segments = parts.groupBy("space_id", "segment").agg(F.countDistinct("doc_id").alias("docs"))
    sizes = docs.groupBy("space_id").agg(F.countDistinct("doc_id").alias("n"))
    major = segments.join(sizes, "space_id").where("docs * 2 >= n").groupBy("space_id").agg(F.array_join(F.array_sort(F.collect_set("segment")), "/").alias("segments"))
    return sizes.join(top(kinds, "kind", "top_entity"), "space_id", "left").join(top(types, "type", "top_type"), "space_id", "left").join(major, "space_id", "left")


def rule_style(index: Column) -> Column:
    """struct(name, icon, color) by the first rule that holds, from the columns of `name_signals`."""
    segments, entity, kind = F.coalesce(F.col("segments"), F.lit("")), F.col("top_entity"), F.col("top_type")

    def style(key: str) -> Column:
        name, icon, color = SPACE_STYLES[key]
        return F.struct(F.lit(name).alias("name"), F.lit(icon).alias("icon"), F.lit(color).alias("color"))

    other = SPACE_STYLES["other"]
    fallback = F.struct(F.concat(F.lit(f"{other[0]} "), index + 1).alias("name"), F.lit(other[1]).alias("icon"), F.lit(other[2]).alias("color"))
    return (
        F.when((entity == "amount") & (kind == "pdf"), style("invoices"))
        .when(segments.rlike("tax|property") & entity.isin("date", "amount"), style("property"))
        .when(kind.isin("xlsx", "csv"), style("sheets")).when(segments.rlike("work|project"), style("work")).when(segments.rlike("medical|health"), style("medical"))
        .when(segments.rlike("kid|school|education"), style("education")).when(segments.rlike("photo|image|picture") & kind.isin("png", "jpg"), style("photos")).otherwise(fallback)
    )


def assemble(members: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """(space_id, document_count, sample_files): counts and the first titles."""
    w = Window.partitionBy("space_id").orderBy("title", "id")
    ranked = members.join(docs.select("id", "title"), "id").withColumn("_r", F.row_number().over(w))
    first = F.filter(F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", "title")))), lambda s: s.isNotNull())
    return ranked.groupBy("space_id").agg(F.count("*").alias("document_count"), first.alias("f")).select("space_id", "document_count", F.col("f.title").alias("sample_files"))


def move_document(members: DataFrame, doc_id: int, target: str) -> DataFrame:
    """The document leaves its spaces and joins the target."""
    moved = members.where(F.col("id") == doc_id).select("id").distinct().withColumn("space_id", F.lit(target))
    return members.where(F.col("id") != doc_id).select("id", "space_id").union(moved)


def counts_after_move(spaces: DataFrame, members: DataFrame, doc_id: int, target: str) -> DataFrame:
    """Spaces (id, document_count) with the counts that a move leaves: one less where the document was (never below 0), one more in the target."""
    was = members.where(F.col("id") == doc_id).select(F.col("space_id").alias("_was")).distinct()
    known = members.where(F.col("id") == doc_id).limit(1).select(F.lit(1).alias("_known"))
    joined = spaces.join(was, F.col("id") == F.col("_was"), "left").join(F.broadcast(known), how="left")  # one row
    left = F.greatest(F.col("document_count") - F.when(F.col("_was").isNotNull(), 1).otherwise(0), F.lit(0))
    return joined.withColumn("document_count", left + F.when((F.col("id") == target) & F.col("_known").isNotNull(), 1).otherwise(0)).drop("_was", "_known")


def set_label(cache: DataFrame, space_id: str, label: str | None, locked: bool) -> DataFrame:
    """An upsert of one label; a null label drops the row."""
    rest = cache.where(F.col("space_id") != space_id)
    if label is None:
        return rest
    return rest.unionByName(cache.sparkSession.createDataFrame([(space_id, label, locked)], "space_id string, label string, user_locked boolean"))


def related_spaces(members: DataFrame) -> DataFrame:
    """(space_id, other_id): spaces that share a document."""
    sets = members.groupBy("id").agg(F.collect_set("space_id").alias("s")).where("size(s) > 1")
    one = sets.select("s", F.explode("s").alias("space_id"))
    return one.select("space_id", F.explode("s").alias("other_id")).where("space_id <> other_id").distinct()


def entity_value_counts(members: DataFrame, found: DataFrame) -> DataFrame:
    """(space_id, value, n): in how many of a cluster's documents an entity value occurs."""
    docs = found.select(F.col("doc_id").alias("id"), "value").distinct()
    return members.select("space_id", "id").distinct().join(docs, "id").groupBy("space_id", "value").agg(F.count("*").alias("n"))


def label_inputs(docs: DataFrame, found: DataFrame, titles: int = 20, classes: int = 5, topics: int = 3, tags: int = 10) -> DataFrame:
    """(space_id, titles, classes, topics, tags): what a label request tells about a cluster.

    `docs` (space_id, title, topic, tags), `found` (space_id, class): the first titles in order,
    and the most frequent classes (`Class: n`), topics and tags, ties by name.  `entity_value_counts`
    with `canonical_hint` gives the entity that goes with them.
    """
    def most(rows: DataFrame, key: str, n: int, shown: Column, out: str) -> DataFrame:
        counts = rows.where(F.col(key).isNotNull()).groupBy("space_id", key).agg(F.count("*").alias("n"))
        w = Window.partitionBy("space_id").orderBy(F.desc("n"), key)
        best = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
        listed = F.array_sort(F.collect_list(F.struct("_r", shown.alias("x"))))
        return best.groupBy("space_id").agg(listed.alias("l")).select("space_id", F.col("l.x").alias(out))

    w = Window.partitionBy("space_id").orderBy("title")
    first = docs.select("space_id", "title").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= titles)
    out = first.groupBy("space_id").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    parts = (
        most(found, "class", classes, F.concat("class", F.lit(": "), "n"), "classes"), most(docs, "topic", topics, F.col("topic"), "topics"),
        most(docs.select("space_id", F.explode("tags").alias("tag")), "tag", tags, F.col("tag"), "tags"),
    )
    for part in parts:
        out = out.join(part, "space_id", "left")
    return out


def sub_label_plan(subs: DataFrame, cache: DataFrame) -> DataFrame:
    """(sub_id, decision) of `subs` (sub_id, id): misc and unchanged memberships stay, others get a new label."""
    prints = fingerprints(subs.select(F.col("sub_id").alias("space_id"), "id"))
    known = cache.select(F.col("sub_id").alias("space_id"), F.col("fingerprint").alias("_known"))
    decision = F.when(F.col("space_id").endswith("-misc") | (F.col("fingerprint") == F.col("_known")), "skip").otherwise("llm")
    return prints.join(known, "space_id", "left").select(F.col("space_id").alias("sub_id"), decision.alias("decision"))


def keep_sub_labels(sub_cache: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """Sub-space labels (parent_id, ...) of parents of which at most a fifth of the members changed."""
    steady = membership_change(previous, current).where(5 * F.col("changed") <= F.col("united")).select(F.col("space_id").alias("parent_id"))
    return sub_cache.join(steady, "parent_id", "left_semi")


def ordered_subs(subs: DataFrame) -> DataFrame:
    """Sub-spaces by documents, misc last."""
    return subs.orderBy(F.col("sub_id").endswith("-misc"), F.desc("document_count"), "sub_id")


def ordered_spaces(spaces: DataFrame, by: str = "name") -> DataFrame:
    """Spaces by `name`, by `updated` (the latest first) or by `count` (the most first), ties by id."""
    orders = {"name": F.lower("name"), "updated": F.desc("updated_at"), "count": F.desc("document_count")}
    return spaces.orderBy(orders[by], "id")


def largest_spaces(spaces: DataFrame, n: int = 10) -> DataFrame:
    return ordered_spaces(spaces, "count").limit(n)


def top_level(spaces: DataFrame) -> DataFrame:
    return spaces.where("depth = 0")


def labelled(spaces: DataFrame, cache: DataFrame) -> DataFrame:
    """Spaces with the label of the cache in place of their name, where it has one."""
    known = cache.select(F.col("space_id").alias("id"), "label", "user_locked")
    return spaces.join(known, "id", "left").withColumn("name", F.coalesce("label", "name")).withColumn("user_locked", F.coalesce("user_locked", F.lit(False))).drop("label")


def clear_lock(cache: DataFrame, space_id: str) -> DataFrame:
    """One label may be replaced again."""
    return cache.withColumn("user_locked", F.col("user_locked") & (F.col("space_id") != space_id))


def relabel(cache: DataFrame) -> DataFrame:
    """The cache before all labels are made anew: only locked ones stay."""
    return cache.where("user_locked")


def space_documents(members: DataFrame, docs: DataFrame, space_id: str) -> DataFrame:
    """The documents of a space."""
    return docs.join(members.where(F.col("space_id") == space_id).select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")


def space_counts(members: DataFrame) -> DataFrame:
    """(space_id, document_count)."""
    return members.groupBy("space_id").agg(F.countDistinct("id").alias("document_count"))


def spaces_of(members: DataFrame, doc_id: int) -> DataFrame:
    return members.where(F.col("id") == doc_id).select("space_id")


def cluster_metadata(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(space_id, documents, doc_types, first_at, last_at): sizes, kinds of file and times of each cluster.

    `docs` has doc_id, doc_type and modified_at.
    """
    joined = members.join(docs.withColumnRenamed("doc_id", "id"), "id")
    return joined.groupBy("space_id").agg(
        F.countDistinct("id").alias("documents"), F.array_sort(F.collect_set("doc_type")).alias("doc_types"), F.min("modified_at").alias("first_at"), F.max("modified_at").alias("last_at")
    )
