"""Vectorised word, line and hash primitives over Arrow text batches.

A batch of texts is handled as one UTF-8 byte array plus document offsets.  All
separators are ASCII, so byte positions and word boundaries never cut a code
point.  Blocks bound the working memory: about ``BLOCK_BYTES`` of text at a
time, or one document where a single text is larger.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch, in sessions that leave Spark's own setting (64 MB) as it is.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: The word pattern `[^\x20\x09-\x0D]+`, as separators.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True
#: Bytes that continue a code point.
IS_TAIL = np.zeros(256, dtype=bool)
IS_TAIL[0x80:0xC0] = True

#: Multipliers of the independent span hashes, by seed.
SPAN_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Spans from this length on are hashed one by one.
LONG_SPAN = 512
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
_TAIL_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Block:
    """A run of documents: `data` bytes, `start` document offsets (n + 1), first row number `row`."""

    data: np.ndarray
    start: np.ndarray
    row: int

    @property
    def n(self) -> int:
        return len(self.start) - 1


@dataclass
class Words:
    """Word byte spans, the document of each word, and each document's first word (n + 1)."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offs = text_buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield Block(data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row], row)
        row = stop


def find_words(block: Block) -> Words:
    data, start = block.data, block.start
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(block.n + 1, np.int64))
    inside = ~IS_SEP[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = start[:-1][start[:-1] < len(data)]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = start[1:][start[1:] > 0] - 1
    closes[tails] = inside[tails]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(begin, start)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    return Words(begin, end, doc, first)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand.

    Eight bytes at a time are mixed in by a multiplication and a bijective finaliser, so no
    linear relation of the bytes survives; long spans take a cryptographic digest.  The two
    seeds give independent hashes: together they tell spans apart by 128 bits.
    """
    if lower:
        data = LOWER_ASCII[data]
    length = end - begin
    factor = SPAN_FACTORS[seed]
    out = mix64(length.astype(np.uint64) + factor)
    if not len(begin):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    out = mix64((out ^ (eight[begin] & _TAIL_MASK[np.minimum(length, 8)])) * factor)
    long = np.flatnonzero(length >= LONG_SPAN)
    active, done = np.flatnonzero((length > 8) & (length < LONG_SPAN)), 8
    while len(active):
        left = length[active] - done
        chunk = eight[begin[active] + done] & _TAIL_MASK[np.minimum(left, 8)]
        out[active] = mix64((out[active] ^ chunk) * factor)
        done += 8
        active = active[left > 8]
    for n in long.tolist():
        digest = hashlib.blake2b(data[begin[n] : end[n]], digest_size=16).digest()
        out[n] = np.frombuffer(digest, "<u8")[seed]
    return out


def window_hashes(h: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of `size` consecutive word hashes at each place (len(h) - size + 1 values, none if shorter).

    Built by doubling: hashes of 2, 4, 8 ... words join neighbours, and the binary digits of
    `size` say which of them make up the window.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    left, right = np.uint64(0x9FB21C651E98DF25 + 2 * seed), np.uint64(0xD6E8FEB86659FD93 + 4 * seed)
    power, run, done, out = 1, h, 0, None
    while True:
        if size & power:
            part = run[done : done + n]
            out = part if out is None else mix64(out * left + part * right + np.uint64(power))
            done += power
        if done == size:
            return mix64(out + np.uint64(seed))
        run = mix64(run[:-power] * left + run[power:] * right)
        power *= 2


def window_starts(words: Words, size: int) -> np.ndarray:
    """True at each place where `size` words of one document begin (len(doc) - size + 1 values)."""
    if len(words.doc) < size:
        return np.zeros(0, bool)
    return words.doc[: len(words.doc) - size + 1] == words.doc[size - 1 :]


def covered(places: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in a span of `lengths` words from one of `places`."""
    change = np.bincount(places, minlength=n + 1).astype(np.int64)
    change -= np.bincount(places + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def per_doc(words: Words, flags: np.ndarray) -> np.ndarray:
    """Sum of a per-word array by document."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[words.first[1:]] - total[words.first[:-1]]


def per_doc_bytes(block: Block, flags: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array by document."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[block.start[1:]] - total[block.start[:-1]]


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, under its own names, whatever other columns there are.

    Ids are integers: a `doc_id` that is no number raises Spark's cast error.
    """
    bound_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by `BATCH_BYTES`, unless the session has a bound of its own.

    Every task holds a batch four times (written and read by the JVM and by Python), and a lazy plan takes the setting
    of the session when it runs, so it stays set.
    """
    if spark.conf.get(BATCH_SETTING, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _allocator():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library keeps what it keeps
        return None


def trim() -> None:
    """Gives memory that a task needed for a while back to the system; Python workers live on."""
    pa.default_memory_pool().release_unused()
    if _allocator():
        _allocator()(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores added until `df` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
