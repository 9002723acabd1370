"""N-gram Jaccard join with a prefix tree.

A document's set holds its distinct 5-word shingles (with fewer words, the whole sequence).
Two documents link when the Jaccard similarity of their sets is at least 80 percent.

1. Equal sets form one class, represented by its least document; only classes are joined.
2. Shingles are globally ordered by document frequency (in powers of two, counted over all
   classes by ranges of hashes), then by hash.  Linked sets share one of their first
   |x| - ceil(0.8 |x|) + 1 shingles; those that no other class has need not be looked at.
   Classes that share such a prefix shingle, directly or over others, form a family.
3. A family's sets are stored in a trie, most frequent shingles first.  Each set walks the
   trie, so sets with a common beginning share the partial overlap; a subtree is left when
   the remaining shingles of walker and subtree cannot reach the required overlap, when its
   sizes do not fit, or when all its sets are in the walker's component already.
4. A family beyond `FAMILY_SHINGLES` is dealt into blocks, by the prefix shingle that most of
   its sets have and by size.  Every block is joined with itself and with pivots of its
   shingle; then only sets outside the family's largest component are compared with other
   blocks, those that have one of their prefix shingles and sizes that fit, a block pair a
   task.  No link is lost, memory is bounded by two blocks, and the sets of a group of near
   copies are not compared all with all.

Links that matter are those that join components: the result is the components.

Sets are compared by 64-bit shingle hashes; equal sets are told by 128 bits of two independent
hashes of their words.

Defined results: a null or empty text has an empty set and links with nothing (its component
is its own id); repeated rows have equal sets; rows with a null id get n_shingles and a null
component_id; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as ex
from . import textblocks as tb
from .components import connected
from .shared import scratch, written

SIZE, PERCENT = 5, 80
FAMILY_SHINGLES, BLOCK_ROWS, PIVOTS = 500_000, 400, 4
CLASS_SEEDS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABD07E4F2C1B9E55))
CELLS_PER_SHINGLE = 8
#: Ids that are sent to all tasks (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(block: tb.Block, size: int = SIZE, checks: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct shingle hashes of each document of a block, sorted, and where each document's begin (n + 1).

    With `checks` also a second, independent hash of each shingle.
    """
    words = tb.find_words(block)
    whole = np.flatnonzero(tb.window_starts(words, size))
    counts = np.diff(words.first)
    short = [(n, np.flatnonzero(counts == n)) for n in range(1, size)]

    def of(seed: int) -> np.ndarray:
        hashes = tb.span_hashes(block.data, words.begin, words.end, lower=True, seed=seed)
        parts = [tb.window_hashes(hashes, size, 1 + 50 * seed)[whole]]
        return np.concatenate(parts + [tb.window_hashes(hashes, n, 100 + n + 50 * seed)[words.first[docs]] for n, docs in short if len(docs)])

    value, doc = of(0), np.concatenate([words.doc[whole]] + [docs for _, docs in short if len(docs)])
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.uint16 if block.n < 1 << 16 else np.int64), kind="stable")]
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.searchsorted(doc[fresh], np.arange(block.n + 1))
    return (value[fresh], first, of(1)[order[fresh]]) if checks else (value[fresh], first)


def set_prints(value: np.ndarray, first: np.ndarray, check: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit prints of each set, of independent shingle hashes, the same for equal sets."""
    out = []
    for hashes, seed in zip((value, check), CLASS_SEEDS, strict=True):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix64(hashes ^ seed))))
        out.append(tb.mix64(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of sets of these sizes that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class _Node:
    __slots__ = ("tokens", "children", "members", "small", "large", "deepest", "roots")

    def __init__(self, tokens, small, large, deepest, roots):
        self.tokens, self.children, self.members = tokens, {}, []
        self.small, self.large, self.deepest, self.roots = small, large, deepest, roots


class PrefixTree:
    """Sets of ascending local ranks; `link` finds the sets that link with one and joins their components."""

    def __init__(self, n: int, ranks: int, percent: int = PERCENT):
        self.percent, self.parent = percent, list(range(n))
        self.has = np.zeros(ranks, bool)
        self.top = _Node(np.zeros(0, np.int64), 1 << 60, 0, 0, set())
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def link(self, who: int, tokens: np.ndarray, size: int) -> None:
        least, most = -(-self.percent * size // 100), 100 * size // self.percent
        has = self.has
        has[tokens] = True
        count, own = len(tokens), self.find(who)
        stack = [(self.top, 0)]
        while stack:
            node, shared = stack.pop()
            if node.small > most or node.large < least:
                continue
            roots = node.roots
            if len(roots) > 1 or own not in roots:
                roots = node.roots = {self.find(r) for r in roots}
            if len(roots) == 1 and own in roots:
                continue
            edge = node.tokens
            if len(edge):
                shared += int(np.count_nonzero(has[edge]))
                left = count - int(tokens.searchsorted(edge[-1], "right"))
            else:
                left = count
            need = needed(size, max(node.small, least), self.percent)
            if shared + min(left, node.deepest) < need:
                continue
            for other, other_size in node.members:
                if shared >= needed(size, other_size, self.percent) and self.find(other) != own:
                    self.links.append((other, who))
                    self.union(other, who)
                    own = self.find(who)
            # the children that share the walker's next shingles are looked at first
            stack += sorted(((c, shared) for c in node.children.values()), key=lambda c: bool(has[c[0].tokens[0]]))
        has[tokens] = False

    def add(self, who: int, tokens: np.ndarray, size: int) -> None:
        node, at = self.top, 0
        while True:
            node.small, node.large = min(node.small, size), max(node.large, size)
            node.deepest = max(node.deepest, len(tokens) - at)
            node.roots.add(who)
            if at == len(tokens):
                node.members.append((who, size))
                return
            key = int(tokens[at])
            child = node.children.get(key)
            if child is None:
                child = _Node(tokens[at:], size, size, 0, {who})
                child.members.append((who, size))
                node.children[key] = child
                return
            edge = child.tokens
            n = min(len(edge), len(tokens) - at)
            differ = np.flatnonzero(edge[:n] != tokens[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(edge):  # split the edge
                upper = _Node(edge[:same], child.small, child.large, child.deepest + len(edge) - same, set(child.roots))
                child.tokens = edge[same:]
                upper.children[int(edge[same])] = child
                node.children[key] = upper
                child = upper
            node, at = child, at + same


def join_sets(sets: list[np.ndarray], sizes: list[int], same: list[int] | None = None, only: int | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the components of `sets` (hashes in global order, rarest first).

    `same` holds a known component for each set; with `only`, the sets from that number on
    walk the tree of those before it and are not stored themselves.
    """
    if not sets:
        return []
    pool = np.concatenate(sets)
    values, inverse = np.unique(pool, return_inverse=True)
    often = np.bincount(inverse, minlength=len(values))
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -often))] = np.arange(len(values))
    ranked, ends = rank[inverse], np.cumsum([len(s) for s in sets])
    tree = PrefixTree(len(sets), len(values), percent)
    if same is not None:
        heads: dict[int, int] = {}
        for n, label in enumerate(same):
            tree.union(heads.setdefault(label, n), n)
    local = [np.sort(ranked[e - len(s) : e]) for s, e in zip(sets, ends, strict=True)]
    stored = len(sets) if only is None else only
    for n in range(stored):
        if only is None:
            tree.link(n, local[n], sizes[n])
        tree.add(n, local[n], sizes[n])
    for n in range(stored, len(sets)):
        tree.link(n, local[n], sizes[n])
    return tree.links


class _Chunk:
    """The sets of the classes that a chunk's documents represent."""

    def __init__(self, rows: pa.Table, classes: pa.Table, size: int):
        tb.trim()  # what the chunk before needed
        wanted = dict(zip(zip(classes.column("print").to_pylist(), classes.column("check").to_pylist(), strict=True), classes.column("class").to_pylist(), strict=True))
        values, self.classes = [], []
        for block in tb.blocks(rows.column("text")):
            value, first, check = shingle_sets(block, size, checks=True)
            one, two = set_prints(value, first, check)
            for n, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if key in wanted and first[n + 1] > first[n]:
                    self.classes.append(wanted.pop(key))
                    values.append(value[first[n] : first[n + 1]].copy())
        order = sorted(range(len(values)), key=self.classes.__getitem__)
        self.classes = [self.classes[k] for k in order]
        self.sizes = np.array([len(values[k]) for k in order], np.int64)
        self.value = np.concatenate([values[k] for k in order] or [np.zeros(0, np.uint64)])

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct cells, their counts, and the cell number of each shingle."""
        cell, number, count = np.unique(tb.mix64(self.value) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return cell, count, number


class Frequencies(ex.Counted):
    """Cells with the number of classes that have them; the answer to each is that number's power of two, at most 15."""

    MOST, DENSE = 1 << 16, np.uint32

    def read(self, body: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
        cells = ex.decode_sorted(body)
        count = np.ones(len(cells), np.uint32)
        several = np.frombuffer(more, "<u4").reshape(2, -1)
        count[several[0]] = several[1]
        return cells, count

    def write(self, values: np.ndarray, notes: np.ndarray) -> tuple[bytes, bytes]:
        several = np.flatnonzero(notes > 1)
        return ex.encode_sorted(values & np.uint64((1 << self.bits) - 1), self.bits), np.stack([several, notes[several]]).astype("<u4").tobytes()

    def settled(self, notes: np.ndarray) -> np.ndarray:
        return np.minimum(np.frexp(notes.astype(np.float32))[1] - 1, 15).astype(np.uint8)

    def tell(self, answer: np.ndarray, sent: np.ndarray) -> bytes:
        common = answer > 0
        return ex.encode_flags(common) + ex.pack(answer[common], 4)

    def blank(self, n: int) -> np.ndarray:
        return np.zeros(n, np.uint8)

    def told(self, body: bytes, out: np.ndarray, a: int, b: int) -> None:
        common = ex.decode_flags(body, b - a)
        out[a:b][common] = ex.unpack(body[-(-(b - a) // 8) :], 4, int(common.sum()))


def class_sets(docs: DataFrame, members: DataFrame, plan: ex.Layout, size: int, percent: int) -> DataFrame:
    """(class, size, prefix, shingles): classes with a prefix shingle that others have, their shingles in global order.

    `members` are the classes (class, print, check) with the document that represents each; `shingles`
    leaves out those that no other class has.
    """
    bits = max((CELLS_PER_SHINGLE * plan.words - 1).bit_length(), plan.ranges.bit_length())
    kind, step = Frequencies(bits), plan.steps[0]

    def by_chunk(df: DataFrame):
        return df.repartition(plan.chunk_tasks, "chunk").groupBy("chunk")

    chunk = ex.chunk_of(plan.chunks, "doc_id").cast("long")
    chunks = by_chunk(docs.where("doc_id is not null").withColumn("chunk", chunk))
    named = members.select(chunk.alias("chunk"), F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("body"), "class", "print", "check")

    def count(rows: pa.Table, classes: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if rows.num_rows and classes.num_rows:
            cell, times, _ = _Chunk(rows, classes, size).cells(bits)
            kind.send(cell, times, step, 0, rows.column("chunk")[0].as_py(), out)
        return ex.message_table(*out)

    def choose(rows: pa.Table, more: pa.Table) -> pa.Table:
        names, sizes, prefixes, sets = [], [], [], []
        of = more.column("part").to_numpy()
        classes, answers = more.filter(pa.array(of < 0)), more.filter(pa.array(of >= 0))
        if rows.num_rows and classes.num_rows:
            chunk = _Chunk(rows, classes, size)
            cell, _, number = chunk.cells(bits)
            levels, ends = kind.receive(answers, cell, step)[number], np.cumsum(chunk.sizes)
            for name, n, end in zip(chunk.classes, chunk.sizes.tolist(), ends.tolist(), strict=True):
                own, value = levels[end - n : end], chunk.value[end - n : end]
                common = np.flatnonzero(own)
                look = n - -(-percent * n // 100) + 1 - (n - len(common))
                if look > 0:
                    order = common[np.lexsort((value[common], own[common]))]
                    names.append(name)
                    sizes.append(n)
                    prefixes.append(value[order[:look]].view(np.int64))
                    sets.append(value[order].tobytes())
        return ex.table({"class": (names, pa.int64()), "size": (sizes, pa.int64()), "prefix": (prefixes, pa.list_(pa.int64())), "shingles": (sets, pa.binary())})

    messages = chunks.cogroup(by_chunk(named)).applyInArrow(count, ex.MESSAGE)
    answers = ex.answered(messages, kind.deeper(step), plan.steps, plan.chunks)
    none = [F.lit(None).cast("long").alias(c) for c in ("class", "print", "check")]
    told = answers.select("chunk", "part", "body", *none).union(named)
    return chunks.cogroup(by_chunk(told)).applyInArrow(choose, "class long, size long, prefix array<long>, shingles binary")


def _read_sets(rows: pa.Table, order: list[int]) -> tuple[list[np.ndarray], list[int], list[int]]:
    bodies, sizes, names = (rows.column(c).to_pylist() for c in ("shingles", "size", "class"))
    return [np.frombuffer(bodies[k], np.uint64) for k in order], [sizes[k] for k in order], [names[k] for k in order]


def _link_table(links, names) -> pa.Table:
    return ex.table({"a": ([names[a] for a, _ in links], pa.int64()), "b": ([names[b] for _, b in links], pa.int64())})


def link_classes(sets: DataFrame, percent: int = PERCENT, family_shingles: int = FAMILY_SHINGLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root): the component of each class that links with another, from `class_sets` written out."""
    posts = sets.select("class", F.explode("prefix").alias("shingle"))
    with scratch(sets.sparkSession) as made:
        stars = posts.groupBy("shingle").agg(F.min("class").alias("least"), F.max("class").alias("other")).where("least < other")
        spokes = posts.join(stars, "shingle").select(F.col("class").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        family = connected(spokes)
        sized = sets.select("class", "size", "shingles", F.octet_length("shingles").alias("_bytes"))
        grown = sized.join(family, sized["class"] == family["node"]).select("class", "size", "shingles", "_bytes", F.col("root").alias("family"))
        grown = made.written(grown, "families")
        share = F.greatest(F.col("_bytes") / 8 / family_shingles, F.lit(1 / block_rows))  # of a block
        totals = grown.groupBy("family").agg(F.sum(share).alias("blocks"))
        amount = grown.agg(F.sum("_bytes").alias("all")).first()["all"] or 0
        buckets = max(64, int(amount // 8 // family_shingles) + 1)
        placed = grown.withColumn("share", share).join(totals, "family")
        whole = placed.where("blocks <= 1").withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(buckets)))

        def join_families(rows: pa.Table) -> pa.Table:
            families, names = rows.column("family").to_numpy(), rows.column("class").to_numpy()
            links = []
            order = np.lexsort((names, families))
            for part in np.split(order, np.flatnonzero(np.diff(families[order])) + 1):
                sets, sizes, names_of = _read_sets(rows, part.tolist())
                links += [(names_of[a], names_of[b]) for a, b in join_sets(sets, sizes, percent=percent)]
            return ex.table({"a": ([x[0] for x in links], pa.int64()), "b": ([x[1] for x in links], pa.int64())})

        links = whole.groupBy("bucket").applyInArrow(join_families, "a long, b long")
        large = placed.where("blocks > 1")
        if large.limit(1).count():
            large = made.written(large.select("family", "class", "size", "shingles", "share"), "large-families")
            links = made.written(links.union(_link_large(large, posts, percent, made)), "links")
        return connected(links)


def _block_of(large: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """`large` with `key`, `band` and `block`.

    A set's key is the prefix shingle that most sets of its family have; its band is its size on a
    scale on which sizes that may link are at most one apart.  A block holds sets of one band, of
    one key where these fill half a block, and of several keys otherwise.
    """
    common = posts.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    keys = posts.join(large.select("class"), "class").join(common, "shingle").groupBy("class").agg(F.max_by("shingle", F.struct("n", "shingle")).alias("key"))
    dealt = large.join(keys, "class", "left").withColumn("band", F.floor(F.log("size") / max(1e-9, float(np.log(100 / percent)) * (1 + 1e-9))))
    cells = dealt.groupBy("family", "band", "key").agg(F.sum("share").alias("all"))
    few = cells.where("all < 0.5").groupBy("family", "band").agg(F.ceil(F.sum("all")).alias("several"))
    sized = dealt.join(cells.withColumnRenamed("key", "_key").withColumnsRenamed({"family": "_f", "band": "_b"}), (F.col("family") == F.col("_f")) & (F.col("band") == F.col("_b")) & F.col("key").eqNullSafe(F.col("_key")))
    sized = sized.drop("_f", "_b", "_key").join(few, ["family", "band"], "left")
    own = F.xxhash64("family", "band", "key", F.pmod(F.xxhash64("class"), F.ceil("all")))
    shared = F.xxhash64("family", "band", F.pmod(F.xxhash64(F.lit("few"), "key"), F.col("several")))
    return sized.withColumn("block", F.when(F.col("all") >= 0.5, own).otherwise(shared)).drop("all", "several", "share")


def _link_large(large: DataFrame, posts: DataFrame, percent: int, made) -> DataFrame:
    """Links of the families that are dealt into blocks."""
    schema = "a long, b long"
    dealt = made.written(_block_of(large, posts, percent), "dealt")
    picks = [F.min_by("class", F.xxhash64(F.lit(n), "class")).alias(f"p{n}") for n in range(PIVOTS)]
    several = dealt.groupBy("family", "key").agg(F.min("block").alias("one"), F.max("block").alias("other"), *picks).where("one <> other")
    pivots = several.select("family", "key", F.explode(F.array_distinct(F.array(*[f"p{n}" for n in range(PIVOTS)]))).alias("class"))
    places = dealt.select("family", "key", "block").distinct()
    sent = pivots.join(places, ["family", "key"]).select("class", "block")
    own = dealt.select("block", "class", "size", "shingles", F.lit(0).alias("pivot"))
    guests = sent.join(dealt.select("class", "size", "shingles"), "class").select("block", "class", "size", "shingles", F.lit(1).alias("pivot"))

    def join_block(rows: pa.Table) -> pa.Table:
        names = rows.column("class").to_pylist()
        order = sorted({name: k for k, name in enumerate(names)}.values(), key=lambda k: (-rows.column("pivot")[k].as_py(), names[k]))
        sets, sizes, names = _read_sets(rows, order)
        return _link_table(join_sets(sets, sizes, percent=percent), names)

    links = made.written(own.union(guests).groupBy("block").applyInArrow(join_block, schema), "block-links")
    found = connected(links)
    labelled = dealt.join(found, dealt["class"] == found["node"], "left").withColumn("label", F.coalesce("root", "class")).drop("node", "root", "key")
    sizes = labelled.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    labelled = made.written(labelled.join(main, "family"), "labelled")
    rest = labelled.where("label <> main")
    if not rest.limit(1).count():
        return links
    # the sets outside the main component walk the blocks that have a prefix shingle of theirs and fit in size
    holds = posts.join(labelled.select("class", "block", "band"), "class").select("shingle", "block", "band").distinct()
    asks = posts.join(rest.select("class", F.col("block").alias("walk"), F.col("band").alias("_band")), "class").select("shingle", "walk", "_band").distinct()
    pairs = asks.join(holds, "shingle").where("walk <> block and abs(band - _band) <= 1").select("walk", "block").distinct()
    pairs = made.written(pairs, "block-pairs")
    columns = ["class", "size", "shingles", "label"]
    standing = labelled.join(pairs, "block").select("block", "walk", *columns, F.lit(0).alias("walks"))
    walkers = rest.withColumnRenamed("block", "walk").join(pairs, "walk").select("block", "walk", *columns, F.lit(1).alias("walks"))

    def join_pair(rows: pa.Table) -> pa.Table:
        walks, names = rows.column("walks").to_pylist(), rows.column("class").to_pylist()
        order = sorted(range(len(names)), key=lambda k: (walks[k], names[k]))
        sets, sizes, names = _read_sets(rows, order)
        labels = rows.column("label").to_pylist()
        return _link_table(join_sets(sets, sizes, [labels[k] for k in order], walks.count(0), percent), names)

    return links.union(standing.union(walkers).groupBy("block", "walk").applyInArrow(join_pair, schema))


def name_classes(sets: DataFrame) -> DataFrame:
    """(print, check, doc_id, class): the least document of each class, and a name of the class.

    Sets of equal prints but other checks are other classes; all but one of them take another name.
    """
    classes = sets.groupBy("print", "check").agg(F.min("doc_id").alias("doc_id"))
    nth = F.row_number().over(Window.partitionBy("print").orderBy("check"))
    named = classes.withColumn("_nth", nth).withColumn("class", F.when(F.col("_nth") == 1, F.col("print")).otherwise(F.xxhash64("print", "check")))
    return named.drop("_nth")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least document reachable by links), class (equal sets)."""
    docs = tb.id_and_text(df, id_col, text_col)
    plan = ex.layout(docs)

    def prints(batches):
        tb.trim()
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                value, first, check = shingle_sets(block, size, checks=True)
                one, two = set_prints(value, first, check)
                columns = [batch.column(0).slice(block.row, block.n), pa.array(np.diff(first).astype(np.int64)), pa.array(one), pa.array(two)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print", "check"])

    with scratch(df.sparkSession) as made:
        sets = written(docs.mapInArrow(prints, "doc_id long, n_shingles long, print long, check long"), "set-prints")
        classes = made.written(name_classes(sets.where("n_shingles > 0 and doc_id is not null")), "classes")
        found = link_classes(made.written(class_sets(docs, classes, plan, size, percent), "class-sets"), percent)
        rooted = classes.join(found, classes["class"] == found["node"], "left").select("print", "check", classes["class"], "doc_id", F.coalesce("root", "class").alias("root"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
        named = written(rooted.join(least, "root").select(F.col("print").alias("_print"), F.col("check").alias("_check"), "class", "least"), "components")
    same = (sets["print"] == named["_print"]) & (sets["check"] == named["_check"]) & (sets["n_shingles"] > 0)
    out = sets.join(named, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "class")


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of `df` that stand for their component (its least id, once), and those without a set; all columns."""
    id_name, n = tb.unused(df, "_kept", "_n")
    groups = near_duplicates(df, id_col, text_col, size, percent)
    kept = written(groups.where("component_id = doc_id").groupBy(F.col("doc_id").alias(id_name)).agg(F.count("*").alias(n)), "kept")
    columns, own = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{id_col}`").cast("long")

    few = kept.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def rows(which: str) -> DataFrame:
        ids = kept.where(which)
        return df.join(F.broadcast(ids) if few else ids, own == F.col(id_name), "left_semi").select(*columns)

    out = rows(f"{n} = 1").union(df.where(own.isNull()))
    if kept.where(f"{n} > 1").limit(1).count():  # only then can rows be repeated
        out = out.union(rows(f"{n} > 1").dropDuplicates([id_col, text_col]))
    return out
