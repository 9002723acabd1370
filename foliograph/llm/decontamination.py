"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items and texts are normalised (A-Z and Latin-1 capitals lower-cased, white space
runs one space).  An
item of m characters that occurs in a text with at most k = floor(`error` * m) edits shares
at least m - q + 1 - q * k of its q-grams with it, all within k + 1 neighbouring diagonals.
Shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, so one band
holds any such match whole; bands that reach the bound are verified by banded alignment.

The benchmark is the stated query set.  It is compared with all texts in passes of
`PASS_BYTES`, each in blocks of `QUERY_BYTES`, of which every Python worker builds an index
(about 30 times their size) once, so memory is bounded whatever the benchmark's size.  Shared q-grams are
counted `PAIRS` at a time, by documents or, in a long document, by items, so common q-grams
take no more memory than rare ones.  An item that repeats a q-gram r times costs r steps at each
of its places in a text.

Defined results: a null or empty text matches nothing; a null or empty item is never found;
items with too many edits for the lemma at q take a smaller q, for which it holds; items shorter
than q without edits are searched exactly; of several occurrences of an item the one with the fewest
edits counts, of equal ones the first; repeated items and rows each give their own pairs; empty tables
give an empty one.  Characters are UTF-8 bytes, also in the edit budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

Q, ERROR, QUERY_BYTES, PASS_BYTES, PAIRS = 8, 0.10, 1 << 20, 4 << 20, 4_000_000
SCHEMA = "doc_id long, item_id long, edits int, start long, end long"
FILTER_BITS = 22

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[list(tb.SEPARATORS)] = 32


@dataclass
class Index:
    """Normalised items and the q-grams of those that the filter can find; `shorter`: the same items, for smaller q."""

    ids: np.ndarray
    items: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    exact: list[int]
    q: int
    shorter: list[Index]


def normalised(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, document offsets in them, and where each byte came from."""
    low = LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[capital] += 32  # accented Latin capitals
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    heads = start[:-1][start[:-1] < len(low)]
    keep[heads] = True
    at = np.flatnonzero(keep)
    return low[at], np.searchsorted(at, start), at


def grams(low: np.ndarray, q: int = Q) -> np.ndarray:
    """The q (at most 8) bytes at each place as one integer: two q-grams are equal iff these are."""
    g = np.append(low, np.zeros(Q - q, np.uint8)).astype(np.uint64)
    for shift in (1, 2, 4):
        if len(g) <= shift:
            return np.zeros(0, np.uint64)
        g = g[:-shift] | (g[shift:] << np.uint64(8 * shift))
    return g & np.uint64((1 << 8 * q) - 1)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def build(rows: list[tuple[int, str]], error: float = ERROR) -> Index:
    items, ids, edits, sizes, exact = [], [], [], [], []
    for item_id, text in sorted(rows):
        raw = np.frombuffer(text.encode(), np.uint8)
        low = normalised(raw, np.array([0, len(raw)]))[0]
        low = np.frombuffer(low.tobytes().strip(b" "), np.uint8)
        if not len(low):
            continue
        k = int(error * len(low))
        # the largest q up to Q for which the lemma leaves a q-gram: m - q + 1 - q * k >= 1
        q = min(Q, len(low) // (k + 1))
        if k == 0 and len(low) < Q or q < 1:
            exact.append(len(items))
            q = 0
        ids.append(item_id)
        items.append(low)
        edits.append(k)
        sizes.append(q)

    def of(q: int, shorter: list[Index]) -> Index:
        bound = np.array([len(low) - q + 1 - q * k if own == q else 0 for low, k, own in zip(items, edits, sizes, strict=True)])
        parts = [(grams(low, q), n) for n, low in enumerate(items) if sizes[n] == q]
        g = np.concatenate([p for p, _ in parts] or [np.zeros(0, np.uint64)])
        item = np.concatenate([np.full(len(p), n) for p, n in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
        place = np.concatenate([np.arange(len(p)) for p, _ in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(g, kind="stable")
        keys, first = np.unique(g[order], return_index=True)
        sieve = np.zeros(1 << FILTER_BITS, bool)
        sieve[_slot(keys)] = True
        return Index(np.array(ids, np.int64), items, np.array(edits), bound, keys, np.append(first, len(g)), item[order], place[order], sieve, exact, q, shorter)

    return of(Q, [of(q, []) for q in sorted({q for q in sizes if 0 < q < Q})])


def candidates(low: np.ndarray, start: np.ndarray, index: Index) -> np.ndarray:
    """Rows (document, item, band) whose count of shared q-grams reaches the item's bound."""
    none = np.zeros((0, 3), np.int64)
    g = grams(low, index.q)
    at = np.flatnonzero(index.sieve[_slot(g)]) if len(g) else np.zeros(0, np.int64)
    if not len(at) or not len(index.keys):
        return none
    doc = np.searchsorted(start, at, "right") - 1
    inside = at + index.q <= start[doc + 1]
    at, doc = at[inside], doc[inside]
    key = np.minimum(np.searchsorted(index.keys, g[at]), len(index.keys) - 1)
    found = index.keys[key] == g[at]
    at, doc, key = at[found], doc[found], key[found]
    enough = np.bincount(doc, minlength=len(start) - 1) >= index.bound[index.bound > 0].min()
    at, doc, key = at[enough[doc]], doc[enough[doc]], key[enough[doc]]
    n_items, parts = len(index.ids), []
    numbered = None
    todo = [(0, len(at), 0, n_items)]
    while todo:  # hits from a to b with items from low_item to high_item
        a, b, low_item, high_item = todo.pop()
        if a == b:
            continue
        first, last = index.first[key[a:b]], index.first[key[a:b] + 1]
        if (low_item, high_item) != (0, n_items):
            if numbered is None:  # postings by q-gram, then item
                numbered = np.repeat(np.arange(len(index.keys)), np.diff(index.first)) * n_items + index.item
            first, last = (np.searchsorted(numbered, key[a:b] * n_items + x) for x in (low_item, high_item))
        many = last - first
        if many.sum() > PAIRS and doc[a] != doc[b - 1]:
            cut = int(np.searchsorted(doc, doc[(a + b) // 2]))
            cut = cut if cut > a else int(np.searchsorted(doc, doc[a], "right"))
            todo += [(a, cut, low_item, high_item), (cut, b, low_item, high_item)]
        elif many.sum() > PAIRS and high_item - low_item > 1:
            cut = (low_item + high_item) // 2
            todo += [(a, b, low_item, cut), (a, b, cut, high_item)]
        else:
            parts.append(_bands(at[a:b], doc[a:b], first, many, start, index))
    return np.concatenate([none, *parts])


def _bands(at: np.ndarray, doc: np.ndarray, first: np.ndarray, many: np.ndarray, start: np.ndarray, index: Index) -> np.ndarray:
    """Rows (document, item, band) of places and the postings that each one has from `first` on."""
    if not many.any():
        return np.zeros((0, 3), np.int64)
    source = np.repeat(np.arange(len(at)), many)
    posting = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    item = index.item[posting]
    step = index.edits[item] + 1
    shift = at[source] - start[doc[source]] - index.place[posting] + (1 << 40)
    band = shift // step
    n_items = len(index.ids)
    pair = (doc[source] * n_items + item).astype(np.uint64)
    hashed = np.concatenate([tb.mix64(pair * np.uint64(0x2545F4914F6CDD1D) + b.astype(np.uint64)) for b in (band, band - 1)])
    order = np.argsort(hashed)
    heads = np.flatnonzero(np.append(True, hashed[order[1:]] != hashed[order[:-1]]))
    counts = np.diff(np.append(heads, len(order)))
    pick = order[heads] % len(source)
    passed = counts >= index.bound[item[pick]]
    # the bound holds for the item's own q-grams: count each of its places once
    member = np.repeat(passed, counts)
    group = np.repeat(np.arange(len(heads)), counts)[member]
    places = np.unique(group << 32 | index.place[posting[order[member] % len(source)]])
    counts = np.bincount(places >> 32, minlength=len(heads))
    passed &= counts >= index.bound[item[pick]]
    both, late = pick[passed], order[heads][passed] >= len(source)
    return np.stack([doc[source[both]], item[both], band[both] - late], 1)


def verify(low: np.ndarray, start: np.ndarray, rows: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, item, edits, start, end) of the candidate bands with an alignment in the budget.

    All bands of a group are aligned together: a row of the alignment is one array of
    (candidate, diagonal in the band).
    """
    out = []
    lengths = np.array([len(index.items[n]) for n in rows[:, 1]], np.int64)
    for group in np.array_split(np.argsort(lengths, kind="stable"), -(-len(rows) // 64)):
        part, size = rows[group], lengths[group]
        step = index.edits[part[:, 1]] + 1
        base = part[:, 2] * step - (1 << 40)
        width, most = int(2 * step.max()), int(size.max())
        pattern = np.zeros((len(group), most), np.uint8)
        for r, n in enumerate(part[:, 1]):
            pattern[r, : size[r]] = index.items[n]
        left, right = start[part[:, 0]], start[part[:, 0] + 1]
        lane = np.arange(width)
        own = lane < (2 * step)[:, None]
        far = 1 << 20
        cost = np.where(own, 0, far).astype(np.int64)
        begin = base[:, None] + lane
        cost[(begin < 0) | (begin > (right - left)[:, None])] = far
        best, best_from, best_to = np.full(len(group), far), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for i in range(most):
            j = base[:, None] + lane + i  # the text place of lane's next character
            legal = (j >= 0) & (j < (right - left)[:, None]) & own
            at = np.clip(left[:, None] + j, 0, len(low) - 1)
            diagonal = np.where(legal, cost + (low[at] != pattern[:, i : i + 1]), far)
            skip, skip_from = np.full_like(cost, far), begin.copy()
            skip[:, :-1], skip_from[:, :-1] = cost[:, 1:] + 1, begin[:, 1:]
            now = np.minimum(diagonal, skip)
            now_from = np.where(diagonal <= skip, begin, skip_from)
            packed = ((now - lane + width) << 21) | (lane << 1)
            run = np.minimum.accumulate(packed, axis=1)
            origin = (run >> 1) & ((1 << 20) - 1)
            cost = np.minimum((run >> 21) - width + lane, far)
            cost[~own] = far
            begin = np.take_along_axis(now_from, origin, 1)
            done = np.flatnonzero(size == i + 1)
            if len(done):
                lane_of = cost[done].argmin(1)
                best[done] = cost[done, lane_of]
                best_from[done] = begin[done, lane_of]
                best_to[done] = base[done] + lane_of + i + 1
        good = best <= index.edits[part[:, 1]]
        for r in np.flatnonzero(good):
            out.append((int(part[r, 0]), int(part[r, 1]), int(best[r]), int(best_from[r]), int(best_to[r])))
    return out


def find(block: tb.Block, index: Index) -> list[tuple[int, int, int, int, int]]:
    """The best occurrence (document, item, edits, start, end in code points) of each item in each document."""
    low, start, origin = normalised(block.data, block.start)
    found = []
    for part in (index, *index.shorter):
        rows = candidates(low, start, part)
        found += verify(low, start, rows, part) if len(rows) else []
    if index.exact:
        raw = low.tobytes()
        for n in index.exact:
            word = index.items[n].tobytes()
            at = raw.find(word)
            while at >= 0:
                doc = int(np.searchsorted(start, at, "right")) - 1
                if at + len(word) <= start[doc + 1]:
                    found.append((doc, n, 0, at - int(start[doc]), at - int(start[doc]) + len(word)))
                at = raw.find(word, at + 1)
    best: dict[tuple[int, int], tuple] = {}
    for doc, item, edits, a, b in found:
        if (doc, item) not in best or (edits, a, b) < best[doc, item]:
            best[doc, item] = (edits, a, b)
    out = []
    for (doc, item), (edits, a, b) in sorted(best.items()):
        zero = block.start[doc]
        ends = [int((~tb.IS_TAIL[block.data[zero : origin[start[doc] + p - 1] + 1]]).sum()) if p else 0 for p in (a + 1, b)]
        out.append((doc, item, edits, ends[0] - 1, ends[1]))
    return out


def query_passes(benchmark: DataFrame, item_col: str, text_col: str, limit: int = QUERY_BYTES, pass_bytes: int = PASS_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's items in passes of about `pass_bytes`, each a list of blocks of about `limit` bytes."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // pass_bytes)
    for b in range(n):
        blocks, room = [[]], limit
        for r in sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()):
            if room <= 0:
                blocks.append([])
                room = limit
            blocks[-1].append((r.item_id, r.text))
            room -= len(r.text.encode())
        yield [tuple(block) for block in blocks if block]


@lru_cache(maxsize=1)
def _indexes(blocks: tuple[tuple, ...], error: float) -> list[Index]:
    """The indexes of a pass; a Python worker keeps those that it built last."""
    return [build(list(block), error) for block in blocks]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: float = ERROR, item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the best occurrence of each benchmark item in each row."""
    rows = tb.id_and_text(docs, id_col, text_col)

    def one(blocks: list[tuple]) -> DataFrame:
        def run(batches):
            indexes = _indexes(tuple(blocks), error)
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for block in tb.blocks(batch.column(1)):
                    for index in indexes:
                        out += [(ids[block.row + d], int(index.ids[n]), e, a, b) for d, n, e, a, b in find(block, index)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

        return rows.mapInArrow(run, SCHEMA)

    parts = [one(blocks) for blocks in query_passes(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error: float = ERROR, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no benchmark item occurs, with all their columns (no shuffle)."""
    tb.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for blocks in query_passes(benchmark, item_col, item_text_col):

        def run(batches, blocks=blocks):
            tb.trim()
            indexes = _indexes(tuple(blocks), error)
            for batch in batches:
                for block in tb.blocks(batch.column(at)):
                    keep = np.ones(block.n, bool)
                    for index in indexes:
                        keep[[hit[0] for hit in find(block, index)]] = False
                    yield batch.slice(block.row, block.n).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
