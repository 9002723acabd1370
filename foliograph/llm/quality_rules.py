"""Quality rules by suffix-array repetition.

Each document's words form a sequence; its suffix array and longest-common-prefix (LCP)
values give the LCP intervals: groups of neighbouring suffixes that share a prefix which no
longer one extends for all of them.  An interval whose suffixes follow different words is a
maximal repeated substring.  The union of the spans of the maximal repeats of at least
`min_repeat` words is the covered part of the document.  A document is rejected when that
part exceeds `max_covered` of its words or its longest repeat exceeds `max_longest` words.

The suffix arrays of a block of documents are sorted together: a word's symbol is mixed
with its document, so that suffixes of different documents never share a prefix.  Prefix
doubling re-sorts only suffixes that are still tied, so text without repeats costs a few
sorts.  LCP values are compared only where a suffix and the one before it follow different
words; elsewhere each is the one of the suffix a word earlier, less one.  So memory is linear:
about 300 bytes a word of the block (a block is 1 MB of text, or one longer document), however
repetitive it is: 5 GB for a document of 100 MB of ordinary words.

Defined results: null or empty text has no words and fails the base rule; a null doc_id
is passed on; repeated rows are judged each on its own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.20, 60
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_WINDOW = 10, 20, 5
#: Symbols compared at once.
COMPARED = 1 << 18
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_spans long, n_maximal long"
)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling."""
    n = len(symbols)
    order = np.argsort(symbols)
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    active, k = order[np.repeat(sizes > 1, sizes)], 1
    while len(active):
        ahead = active + k
        key = rank[active] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, active = key[by], active[by]
        first = key // (n + 1)
        place = np.arange(len(by))
        new_block = np.ones(len(by), bool)
        new_block[1:] = first[1:] != first[:-1]
        block_at = place[new_block][np.cumsum(new_block) - 1]
        new_key = np.ones(len(by), bool)
        new_key[1:] = key[1:] != key[:-1]
        starts = place[new_key]
        sizes = np.diff(np.append(starts, len(by)))
        rank[active] = np.repeat(first[starts] + starts - block_at[starts], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


def common_lengths(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes from each a and b share."""
    n, out = len(symbols), np.zeros(len(a), np.int64)
    active, width = np.arange(len(a)), 1
    while len(active):
        on, step = [], max(1, COMPARED // width)
        for at in range(0, len(active), step):
            part = active[at : at + step]
            x = (a[part] + out[part])[:, None] + np.arange(width)
            y = (b[part] + out[part])[:, None] + np.arange(width)
            same = (x < n) & (y < n) & (symbols[np.minimum(x, n - 1)] == symbols[np.minimum(y, n - 1)])
            whole = same.all(1)
            out[part] += np.where(whole, width, same.argmin(1))
            on.append(part[whole])
        active, width = np.concatenate(on), min(2 * width, COMPARED)
    return out


def lcp_array(symbols: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in suffix order (0 for the first)."""
    n = len(suffixes)
    before = np.empty(n, np.int64)  # the suffix before each place's
    before[suffixes[1:]], before[suffixes[0]] = suffixes[:-1], -1
    place = np.arange(n)
    own = np.ones(n, bool)  # places whose LCP does not follow from the place before
    own[1:] = (before[1:] < 1) | (symbols[before[1:] - 1] != symbols[:-1])
    reach = np.zeros(n, np.int64)
    reach[own] = place[own]
    ask = np.flatnonzero(own & (before >= 0) & (symbols == symbols[before]))
    reach[ask] += common_lengths(symbols, ask, before[ask])
    return (np.maximum.accumulate(reach) - place)[suffixes]


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LCP intervals of at least `least` symbols: depth, first and last member, and the interval of each place (or -1).

    An interval's members are places of the suffix array; a place's interval is the one that its
    suffix and the suffix before it make.
    """
    at = np.flatnonzero(lcp >= least)
    depths, firsts, lasts, owner = [], [], [], []
    open_: list[int] = []
    last = -1
    for i, depth in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if i != last + 1:
            for k in open_:
                lasts[k] = last
            open_.clear()
        first = i - 1
        while open_ and depths[open_[-1]] > depth:
            k = open_.pop()
            lasts[k], first = last, firsts[k]
        if not open_ or depths[open_[-1]] < depth:
            open_.append(len(depths))
            depths.append(depth)
            firsts.append(first)
            lasts.append(i)
        owner.append(open_[-1])
        last = i
    for k in open_:
        lasts[k] = last
    interval = np.full(len(lcp), -1, np.int64)
    interval[at] = owner
    return np.array(depths, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64), interval


@dataclass
class Repeats:
    """`longest`: at each place, the longest run from there that also starts elsewhere; `depth`: the length of the
    maximal repeat that begins there (0: none, or the repeat extends to the left); `maximal`: a place and the length of
    each maximal repeat."""

    longest: np.ndarray
    depth: np.ndarray
    maximal: tuple[np.ndarray, np.ndarray]


def find_repeats(symbols: np.ndarray, min_repeat: int = MIN_REPEAT) -> Repeats:
    """Maximal repeats of at least `min_repeat` symbols.

    A suffix belongs to nested intervals and its deepest one reaches furthest.  Where that one is
    not left-maximal, the same symbol stands before all its suffixes, so the repeat that begins a
    symbol earlier covers its spans.
    """
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return Repeats(none, none, (none, none))
    suffixes = suffix_array(symbols)
    lcp = lcp_array(symbols, suffixes)
    following = np.append(lcp[1:], 0)
    longest, depth = np.empty(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    longest[suffixes] = np.maximum(lcp, following)
    depths, first, last, interval = lcp_intervals(lcp, min_repeat)
    if not len(depths):
        return Repeats(longest, depth, (none, none))
    left = symbols[suffixes - 1]
    differs = np.ones(len(suffixes), bool)
    differs[1:] = (left[1:] != left[:-1]) | (suffixes[1:] == 0) | (suffixes[:-1] == 0)
    changes = np.cumsum(differs)
    is_maximal = changes[last] > changes[first]
    deepest = np.where(lcp >= following, interval, np.append(interval[1:], -1))
    inside = np.flatnonzero(deepest >= 0)
    inside = inside[is_maximal[deepest[inside]]]
    depth[suffixes[inside]] = depths[deepest[inside]]
    return Repeats(longest, depth, (suffixes[first[is_maximal]], depths[is_maximal]))


def repeated_spans(symbols: np.ndarray, min_repeat: int = MIN_REPEAT) -> list[tuple[int, int]]:
    """The union of maximal repeated substrings of at least `min_repeat` symbols, as spans."""
    depth = find_repeats(symbols, min_repeat).depth
    at = np.flatnonzero(depth)
    inside = np.concatenate(([False], tb.covered(at, depth[at], len(symbols)), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def duplicate_lines(text: str) -> int:
    """Lines (split at \\n) with a word that equal an earlier line of the text."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen, count = set(), 0
    for line in lines:
        if line in seen:
            count += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return count


def judge(block: tb.Block, texts: list[str | None], min_repeat: int, max_covered: float, max_longest: int) -> dict:
    words = tb.find_words(block)
    n_words = np.diff(words.first)
    hashes = tb.span_hashes(block.data, words.begin, words.end)
    symbols = tb.mix64(hashes ^ tb.mix64(words.doc.astype(np.uint64) + np.uint64(1)))
    repeats = find_repeats(symbols, min_repeat)
    base_at, at = np.flatnonzero(repeats.longest >= BASE_WINDOW), np.flatnonzero(repeats.depth)
    n_repeat = tb.per_doc(words, tb.covered(base_at, BASE_WINDOW, len(symbols)))
    inside = tb.covered(at, repeats.depth[at], len(symbols))
    n_covered = tb.per_doc(words, inside)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (words.doc[1:] != words.doc[:-1])
    most = np.zeros(block.n, np.int64)
    place, length = repeats.maximal
    np.maximum.at(most, words.doc[place], length)
    points = tb.per_doc_bytes(block, ~(tb.IS_TAIL[block.data] | tb.IS_SEP[block.data]))
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    rejected = (n_covered > max_covered * n_words) | (most > max_longest)
    return {
        "n_words": n_words,
        "word_chars": points,
        "n_symbols": tb.per_doc_bytes(block, _IS_SYMBOL[block.data]),
        "n_dup_lines": np.array([duplicate_lines(t or "") for t in texts], np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & ~rejected,
        "covered_words": n_covered,
        "longest_repeat": most,
        "n_spans": tb.per_doc(words, opens),
        "n_maximal": np.bincount(words.doc[place], minlength=block.n).astype(np.int64),
    }


def _judged(batch: pa.RecordBatch, text_at: int, *limits) -> Iterator[tuple[tb.Block, dict]]:
    column = batch.column(text_at)
    for block in tb.blocks(column):
        yield block, judge(block, column.slice(block.row, block.n).to_pylist(), *limits)


def repetition_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """One row of measures and the verdict `kept` for each row of `df` (no shuffle)."""

    def run(batches):
        tb.trim()
        for batch in batches:
            for block, out in _judged(batch, 1, min_repeat, max_covered, max_longest):
                ids = batch.column(0).slice(block.row, block.n)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out.values())], names=["doc_id", *out])

    return tb.id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_unrepetitive(
    df: DataFrame, text_col: str = "text",
    min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """The rows of `df` that the rules keep, with all their columns."""
    tb.bound_batches(df.sparkSession)
    text_at = df.columns.index(text_col)

    def run(batches):
        tb.trim()
        for batch in batches:
            for block, out in _judged(batch, text_at, min_repeat, max_covered, max_longest):
                yield batch.slice(block.row, block.n).filter(pa.array(out["kept"]))

    return df.mapInArrow(run, df.schema)
