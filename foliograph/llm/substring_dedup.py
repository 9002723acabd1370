"""Substring deduplication with a count-min prefilter.

A window is `size` consecutive words of one document.  Every word covered by a window that
also starts earlier (in a smaller document id, or earlier in the same document) goes.

First pass: each chunk of documents builds its part of a count-min sketch of `DEPTH` rows
and about `CELLS_PER_WINDOW` cells per window, and sends it, by ranges of cells; the parts
are merged by adding.  A cell's count is at least the number of its windows, so a window is
repeated only if all its cells count two or more; no repeated window is lost.  Second pass:
only windows so estimated are grouped exactly, by 96 bits of two independent hashes of their
words (the chance that any two of n such windows collide is below n * n / 2 ** 97), and every
chunk learns which of its windows first occur in another chunk.  Third pass: words are removed.

Counts in a chunk saturate at two and a chunk names a window once, so a window that a third
of all documents hold costs one entry per chunk.

Defined results: a null or empty text has no words; documents shorter than a window keep
all; rows with the same id count as documents in the order of a hash of their texts, then of
the texts (so a repeated row loses the windows of the first); rows with a null id come before all
others; an empty table gives an empty one.  Rows are dealt by id and text, so that only rows
equal in both meet in one task whatever their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textblocks as tb

SIZE, DEPTH, CELLS_PER_WINDOW = 20, 2, 8
SEEDS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0xE220A8397B1DCDAF))
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
NO_ID = -(1 << 63)


class Chunk:
    """The windows of a chunk's documents, in order of (doc_id, tie, text)."""

    def __init__(self, rows: pa.Table, size: int):
        tb.trim()  # what the chunk before needed
        self.size = size
        ids, ties, texts = rows.column("doc_id").to_pylist(), rows.column("tie").to_pylist(), rows.column("text")
        column = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        keys = [(NO_ID if d is None else d, tie) for d, tie in zip(ids, ties, strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        if len(set(keys)) < len(keys):
            order = sorted(order, key=lambda k: (*keys[k], column[k].as_py() or ""))
        self.ids = [ids[k] for k in order]
        self.keys = np.array([keys[k] for k in order], np.int64).reshape(-1, 2)
        self.texts = column.take(pa.array(order, pa.int64()))
        prints, checks, doc, place, self.n_words, first = [], [], [], [], [], 0
        for block in tb.blocks(self.texts):
            words = tb.find_words(block)
            self.n_words.append(np.diff(words.first))
            whole = np.flatnonzero(tb.window_starts(words, size))
            one, two = (tb.span_hashes(block.data, words.begin, words.end, seed=seed) for seed in (0, 1))
            prints.append(tb.window_hashes(one, size, 1)[whole])
            checks.append((tb.window_hashes(two, size, 2)[whole] >> np.uint64(32)).astype(np.uint32))
            doc.append(words.doc[whole] + block.row)
            place.append(whole + first)
            first += len(words.doc)
        nothing = [np.zeros(0, np.int64)]
        self.n_words = np.concatenate(self.n_words or nothing)
        self.doc = np.concatenate(doc or nothing)
        self.place = np.concatenate(place or nothing)
        prints = np.concatenate(prints or [np.zeros(0, np.uint64)])
        checks = np.concatenate(checks or [np.zeros(0, np.uint32)])
        order = np.argsort(prints, kind="stable")
        ranked, checked = prints[order], checks[order]
        fresh, other = ranked[1:] != ranked[:-1], checked[1:] != checked[:-1]
        if (other & ~fresh).any():  # different windows of equal prints
            order = np.lexsort((checks, prints))
            ranked, checked = prints[order], checks[order]
            fresh = (ranked[1:] != ranked[:-1]) | (checked[1:] != checked[:-1])
        heads = np.flatnonzero(np.append(True, fresh)) if len(ranked) else np.zeros(0, np.int64)
        self.prints, self.check = ranked[heads], checked[heads]
        self.count = np.diff(np.append(heads, len(ranked)))
        self.first = order[heads]  # stable order: the earliest window of each print
        self.inverse = np.empty(len(prints), np.int64)
        self.inverse[order] = np.repeat(np.arange(len(heads)), self.count)

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct cells of a sketch row, their counts up to two, and the cell number of each print."""
        cell = tb.mix64(self.prints ^ SEEDS[row]) >> np.uint64(64 - bits)
        order = np.argsort(cell)
        ranked = cell[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
        number = np.empty(len(cell), np.int64)
        number[order] = np.cumsum(fresh) - 1
        total = np.bincount(number, np.minimum(self.count, 2), minlength=int(fresh.sum()))
        return ranked[fresh], np.minimum(total, 2).astype(np.int64), number

    def repeated(self, answers: pa.Table, kind: Sketch, step: int) -> np.ndarray:
        """Numbers of the prints whose cells all count two or more."""
        good = np.ones(len(self.prints), bool)
        rows = answers.column("part").to_numpy() >> step
        for row in range(DEPTH):
            cells, _, number = self.cells(row, kind.bits)
            good &= kind.receive(answers.filter(pa.array(rows == row)), cells, step)[number]
        return np.flatnonzero(good)


class Sketch(ex.Counted):
    """Cells of a sketch row; the answer to each is whether it counts two or more."""

    def read(self, body: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
        cells = ex.decode_sorted(body)
        return cells, 1 + ex.decode_flags(more, len(cells)).astype(np.uint8)

    def write(self, values: np.ndarray, notes: np.ndarray) -> tuple[bytes, bytes]:
        return ex.encode_sorted(values & np.uint64((1 << self.bits) - 1), self.bits), ex.encode_flags(notes > 1)

    def settled(self, notes: np.ndarray) -> np.ndarray:
        return notes > 1

    def tell(self, answer: np.ndarray, sent: np.ndarray) -> bytes:
        return ex.encode_flags(answer)

    def blank(self, n: int) -> np.ndarray:
        return np.zeros(n, bool)

    def told(self, body: bytes, out: np.ndarray, a: int, b: int) -> None:
        out[a:b] = ex.decode_flags(body, b - a)


VALUE = np.dtype([("print", "<u8"), ("check", "<u4")])
NOTE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("number", "<u4")])


class Windows(ex.Kind):
    """Windows with their first document and the sender's number; the answer is the numbers of those that start earlier elsewhere.

    `used` is how many leading bits of a print its range fixes.
    """

    def __init__(self, used: int):
        self.used = used

    def deeper(self, step: int) -> Windows:
        return Windows(self.used + step)

    def split(self, values: np.ndarray, step: int) -> np.ndarray:
        return ex.split_sorted(values["print"] & np.uint64((1 << 64 - self.used) - 1), 64 - self.used, step)

    def read(self, body: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, n_docs = (int(x) for x in np.frombuffer(body, "<u4", 2))
        values, notes = np.frombuffer(body, VALUE, n, 8), np.empty(n, NOTE)
        at = 8 + n * VALUE.itemsize
        local = np.frombuffer(body, "<u4", n, at)
        docs = np.frombuffer(body, "<i8", 2 * n_docs, at + 4 * n).reshape(-1, 2)
        notes["doc"], notes["tie"], notes["number"] = docs[local, 0], docs[local, 1], ex.decode_sorted(more)
        return values, notes

    def write(self, values: np.ndarray, notes: np.ndarray) -> tuple[bytes, bytes]:
        keys = np.stack([notes["doc"], notes["tie"]], 1)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        fresh = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(1))
        local = np.empty(len(order), np.uint32)
        local[order] = np.cumsum(fresh) - 1
        docs = keys[order[fresh]].astype("<i8")
        body = np.array([len(values), len(docs)], "<u4").tobytes() + values.tobytes() + local.astype("<u4").tobytes() + docs.tobytes()
        return body, ex.encode_sorted(notes["number"], 32)

    def joined(self, values: list[np.ndarray], notes: list[np.ndarray]) -> ex.Merged:
        value, note = np.concatenate(values), np.concatenate(notes)
        # of rows equal in id and text all are in one chunk, so equal keys are of one sender
        order = np.lexsort((note["tie"], note["doc"], value["check"], value["print"]))
        ranked = value[order]
        fresh = np.append(True, (ranked["print"][1:] != ranked["print"][:-1]) | (ranked["check"][1:] != ranked["check"][:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        merged = note[order[fresh]].copy()
        merged["number"] = np.arange(len(merged))
        late = np.ones(len(order), bool)
        late[order[fresh]] = False
        cuts = np.cumsum([len(v) for v in values])[:-1]
        self.late = np.split(late, cuts)
        return ex.Merged(ranked[fresh], merged, np.split(place, cuts))

    def settled(self, notes: np.ndarray) -> np.ndarray:
        return np.zeros(len(notes), bool)

    def own(self, sender: int, answer: np.ndarray, merged: ex.Merged) -> np.ndarray:
        return self.late[sender] | answer[merged.places[sender]]

    def tell(self, answer: np.ndarray, sent: np.ndarray) -> bytes:
        return ex.encode_sorted(np.sort(sent["number"][answer]), 32)

    def blank(self, n: int) -> np.ndarray:
        return np.zeros(n, bool)

    def told(self, body: bytes, out: np.ndarray, a: int, b: int) -> None:
        out[ex.decode_sorted(body).astype(np.int64)] = True


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and the kept words, joined by spaces, as `kept`)."""
    docs = tb.id_and_text(df, id_col, text_col)
    plan = ex.layout(docs)
    bits = max((CELLS_PER_WINDOW * plan.words - 1).bit_length(), plan.ranges.bit_length())
    sketches, windows, step = Sketch(bits), Windows(0), plan.steps[0]
    told = docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    told = told.withColumn("chunk", ex.chunk_of(plan.chunks, "doc_id", "tie").cast("long"))
    chunks = told.repartition(plan.chunk_tasks, "chunk").groupBy("chunk")
    schema = SCHEMA + (", kept string" if with_text else "")

    def by_chunk(answers: DataFrame):
        return answers.repartition(plan.chunk_tasks, "chunk").groupBy("chunk")

    def sketch(rows: pa.Table) -> pa.Table:
        chunk, number, out = Chunk(rows, size), rows.column("chunk")[0].as_py(), ([], [], [], [])
        for row in range(DEPTH):
            cells, count, _ = chunk.cells(row, bits)
            sketches.send(cells, count, step, row, number, out)
        return ex.message_table(*out)

    def name_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if rows.num_rows and answers.num_rows:
            chunk = Chunk(rows, size)
            chosen = chunk.repeated(answers, sketches, step)
            value, note = np.empty(len(chosen), VALUE), np.empty(len(chosen), NOTE)
            value["print"], value["check"], note["number"] = chunk.prints[chosen], chunk.check[chosen], chosen
            note["doc"], note["tie"] = chunk.keys[chunk.doc[chunk.first[chosen]]].T
            windows.send(value, note, step, 0, rows.column("chunk")[0].as_py(), out)
        return ex.message_table(*out)

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema([("doc_id", pa.int64())]).empty_table()
        chunk = Chunk(rows, size)
        elsewhere = windows.blank(len(chunk.prints))
        for late in answers.column("body").to_pylist():
            windows.told(late, elsewhere, 0, 0)
        later = np.ones(len(chunk.doc), bool)
        later[chunk.first] = False
        gone = tb.covered(chunk.place[later | elsewhere[chunk.inverse]], size, int(chunk.n_words.sum()))
        ends = np.cumsum(chunk.n_words)
        removed = np.concatenate(([0], np.cumsum(gone)))
        removed = removed[ends] - removed[ends - chunk.n_words]
        kept, digests = [], []
        for n, text in enumerate(chunk.texts.to_pylist()):
            words = split_words(text)
            if removed[n]:
                drop = gone[ends[n] - chunk.n_words[n] : ends[n]]
                words = [w for w, out in zip(words, drop.tolist(), strict=True) if not out]
            joined = b" ".join(words)
            digests.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode() if with_text else None)
        columns = {"doc_id": (chunk.ids, pa.int64()), "n_words": (chunk.n_words, pa.int64()), "n_removed": (removed, pa.int64()), "kept_sha256": (digests, pa.string())}
        return ex.table(columns | ({"kept": (kept, pa.string())} if with_text else {}))

    counted = ex.answered(chunks.applyInArrow(sketch, ex.MESSAGE), sketches.deeper(step), plan.steps, plan.chunks)
    named = chunks.cogroup(by_chunk(counted)).applyInArrow(name_windows, ex.MESSAGE)
    late = ex.answered(named, windows.deeper(step), plan.steps, plan.chunks)
    return chunks.cogroup(by_chunk(late)).applyInArrow(remove, schema)


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: bytes.split() cuts at the same six separators."""
    return (text or "").encode().split()
