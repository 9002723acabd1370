"""Keyed exchange between chunks of documents and hash ranges.

Documents are dealt by a hash into chunks of about `CHUNK_BYTES` of text.  A chunk turns its
texts into sorted arrays of hashes and sends each hash range one compact message instead of
one row per hash; a range merges the messages and answers each with something about the
values it was sent.  A chunk's arrays are a function of its documents alone, so they can be
computed again wherever the answers are needed.

The number of ranges grows with the input, about `RANGE_VALUES` values a range, so a range's
task does not.  A sender addresses at most `FAN` ranges: where there are more, its messages go
to wide ranges first, in which relays join those of up to `FAN` senders and pass them on to
`FAN` ranges in the wide one, on as many levels as it takes; the answers come back the same
way.  So with n bytes of text there are at most n / CHUNK_BYTES * FAN messages on each of
log(ranges) / log(FAN) levels: one level to about 1.6 GB of text, two to 3 TB, three to 6 PB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .token_files import pack, unpack

CHUNK_BYTES, LEAST_CHUNKS = 8 << 20, 16
#: Values per hash range aimed at, the least number of ranges, and how many a sender addresses (a power of two).
RANGE_VALUES, LEAST_RANGES, FAN = 1 << 17, 64, 2048
BYTES_PER_WORD = 6
MESSAGE = "part long, chunk long, body binary, more binary"


@dataclass(frozen=True)
class Layout:
    """Numbers that follow from the size of the input alone; `ranges` is a power of two."""

    rows: int
    chunks: int
    ranges: int
    words: int

    @property
    def steps(self) -> list[int]:
        """Bits of the range number that each level adds."""
        left, fan, out = self.ranges.bit_length() - 1, FAN.bit_length() - 1, []
        while left > 0:
            out.append(min(left, fan))
            left -= out[-1]
        return out or [0]

    @property
    def chunk_tasks(self) -> int:
        """A task a chunk up to 32 GB of text, then eight chunks a task."""
        return max(min(self.chunks, 4096), self.chunks // 8)


def layout(docs: DataFrame) -> Layout:
    got = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    size = got["size"] or 0
    words = max(1, size // BYTES_PER_WORD)
    ranges = 1 << (max(LEAST_RANGES, words // RANGE_VALUES) - 1).bit_length()
    return Layout(got["n"], max(LEAST_CHUNKS, -(-size // CHUNK_BYTES)), ranges, words)


def chunk_of(n: int, *columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit("chunk"), *columns), F.lit(n))


def encode_sorted(values: np.ndarray, universe_bits: int) -> bytes:
    """Elias-Fano code of sorted distinct values below 2 ** universe_bits: about 2 + log2(universe / n) bits each."""
    n = len(values)
    low_bits = max(0, min(universe_bits, universe_bits - max(0, n.bit_length() - 1)))
    values = values.astype(np.uint64)
    low = values & np.uint64((1 << low_bits) - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    unary = np.zeros((int(high[-1]) if n else 0) + n, np.uint8)
    unary[high + np.arange(n)] = 1
    head = np.array([n, low_bits], "<u4").tobytes()
    return head + (pack(low, low_bits) if low_bits else b"") + np.packbits(unary, bitorder="little").tobytes()


def decode_sorted(data: bytes) -> np.ndarray:
    n, low_bits = (int(x) for x in np.frombuffer(data, "<u4", 2))
    cut = 8 + -(-n * low_bits // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=cut), bitorder="little")
    high = (np.flatnonzero(bits)[:n] - np.arange(n)).astype(np.uint64)
    low = unpack(data[8:cut], low_bits, n).astype(np.uint64) if low_bits else np.uint64(0)
    return (high << np.uint64(low_bits)) | low


def encode_flags(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def decode_flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


def split_sorted(values: np.ndarray, bits: int, step: int) -> np.ndarray:
    """Where each of 2 ** step equal hash ranges begins in sorted values below 2 ** bits, and their end."""
    heads = np.arange(1 << step, dtype=np.uint64) << np.uint64(bits - step)
    return np.append(np.searchsorted(values, heads), len(values))


def table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()})


def message_table(part: list[int], chunk: list[int], body: list[bytes], more: list[bytes | None]) -> pa.Table:
    return table({"part": (part, pa.int64()), "chunk": (chunk, pa.int64()), "body": (body, pa.binary()), "more": (more, pa.binary())})


@dataclass
class Merged:
    """Distinct values of several senders with their notes, and where each sender's values are among them."""

    values: np.ndarray
    notes: np.ndarray
    places: list[np.ndarray]


class Kind:
    """What messages hold: values in ascending order, and a note about each.

    `read` and `write` (de)code a message; `joined` merges the messages of several senders;
    `settled` makes answers from merged notes; `own` makes a sender's answers from those;
    `tell` and `told` (de)code answers; `split` says where 2 ** step parts of the range begin.
    """

    def deeper(self, step: int) -> Kind:
        """The kind of the messages in a 2 ** step-th of the range."""
        raise NotImplementedError

    def own(self, sender: int, answer: np.ndarray, merged: Merged) -> np.ndarray:
        return answer[merged.places[sender]]

    def answers(self, values: list[np.ndarray], notes: list[np.ndarray]) -> list[np.ndarray]:
        """The answers to each sender's values where all that is known of them has come together."""
        merged = self.joined(values, notes)
        answer = self.settled(merged.notes)
        return [self.own(n, answer, merged) for n in range(len(values))]

    def send(self, values: np.ndarray, notes, step: int, part: int, sender: int, out: tuple[list, ...]) -> None:
        """Appends the messages of one sender, one for each of 2 ** step parts of the range that has values."""
        edges, deeper = self.split(values, step), self.deeper(step)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[k], edges[k + 1])
            body, more = deeper.write(values[own], notes[own])
            for column, value in zip(out, (part << step | k, sender, body, more), strict=True):
                column.append(value)

    def receive(self, answers: pa.Table, values: np.ndarray, step: int) -> np.ndarray:
        """The answers to a sender's values, from those of the 2 ** step parts of one range."""
        edges = self.split(values, step)
        out = self.blank(len(values))
        for part, body in zip(answers.column("part").to_pylist(), answers.column("body").to_pylist(), strict=True):
            k = part & ((1 << step) - 1)
            self.told(body, out, int(edges[k]), int(edges[k + 1]))
        return out


class Counted(Kind):
    """Cells below 2 ** bits with counts; a cell's count is the sum of its senders', at most `MOST`."""

    MOST, DENSE_BITS, DENSE = 2, 22, np.uint8

    def __init__(self, bits: int):
        self.bits = bits

    def deeper(self, step: int) -> Counted:
        return type(self)(self.bits - step)

    def split(self, values: np.ndarray, step: int) -> np.ndarray:
        return split_sorted(values, self.bits, step)

    def joined(self, values: list[np.ndarray], notes: list[np.ndarray]) -> Merged:
        merged, places = np.unique(np.concatenate(values), return_inverse=True)
        count = np.bincount(places, np.concatenate(notes), len(merged)).astype(np.int64)
        cuts = np.cumsum([len(v) for v in values])[:-1]
        return Merged(merged, np.minimum(count, self.MOST), np.split(places, cuts))

    def answers(self, values: list[np.ndarray], notes: list[np.ndarray]) -> list[np.ndarray]:
        if self.bits > self.DENSE_BITS:
            return super().answers(values, notes)
        total = np.zeros(1 << self.bits, self.DENSE)
        for cells, count in zip(values, notes, strict=True):
            total[cells] = np.minimum(total[cells] + count, self.MOST)
        return [self.settled(total[cells]) for cells in values]


def _read(messages: pa.Table, kind: Kind) -> tuple[list, list]:
    both = [kind.read(b, m) for b, m in zip(messages.column("body").to_pylist(), messages.column("more").to_pylist(), strict=True)]
    return [v for v, _ in both], [n for _, n in both]


def _told(messages: pa.Table, kind: Kind, answers: list[np.ndarray], notes: list[np.ndarray]) -> pa.Table:
    bodies = [kind.tell(answer, sent) for answer, sent in zip(answers, notes, strict=True)]
    return message_table(messages.column("part").to_pylist(), messages.column("chunk").to_pylist(), bodies, [None] * len(bodies))


def answered(messages: DataFrame, kind: Kind, steps: list[int], senders: int) -> DataFrame:
    """The answer to each message (part, chunk, body), by `steps` levels of ranges.

    `senders` bounds the number of senders; `kind` is that of the messages, whose parts are those
    of the first step.
    """

    def settle(part: pa.Table) -> pa.Table:
        values, notes = _read(part, kind)
        return _told(part, kind, kind.answers(values, notes), notes)

    if len(steps) == 1:
        return messages.groupBy("part").applyInArrow(settle, MESSAGE)
    groups, step = -(-senders // FAN), steps[1]
    messages = written(messages.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups))), "messages")

    def relay(part: pa.Table) -> pa.Table:
        merged, out = kind.joined(*_read(part, kind)), ([], [], [], [])
        kind.send(merged.values, merged.notes, step, part.column("part")[0].as_py(), part.column("group")[0].as_py(), out)
        return message_table(*out)

    def hand_back(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return message_table([], [], [], [])
        values, notes = _read(part, kind)
        merged = kind.joined(values, notes)
        answer = kind.receive(answers, merged.values, step)
        return _told(part, kind, [kind.own(n, answer, merged) for n in range(len(values))], notes)

    passed = messages.groupBy("part", "group").applyInArrow(relay, MESSAGE)
    told = answered(passed, kind.deeper(step), steps[1:], groups)
    told = told.withColumnRenamed("chunk", "group").withColumn("wide", F.shiftright("part", step))
    return messages.groupBy("part", "group").cogroup(told.groupBy("wide", "group")).applyInArrow(hand_back, MESSAGE)
