"""Token ids in fixed-width bit-packed files.

Every id takes the fewest bits that hold the vocabulary.  A file is

    payload   blocks of `BLOCK_IDS` ids, each packed from its own byte on, least bit first
    table     one int64 pair (document id, number of ids) per document
    offsets   one uint64 per block and one for the end of the payload
    footer    magic, width, ids per block, ids, documents

so any run of ids is found from the block offsets and unpacked by numpy.

Texts are encoded by the tokenizers library in units: byte-level BPE never joins across a
space between two words, so a text is cut there, equal units of a block of texts are
encoded once, and the units that were used last are kept.  Units are told apart by 128 bits of
two independent hashes.  The strings of special tokens in a text are special tokens, as the
library has it by default; with `special_tokens=False` they are ordinary text.

Documents are range-partitioned by id, a partition writes one file of about `FILE_BYTES` of
text into the shared folder (less, down to `LEAST_FILE_BYTES`, while there are fewer files
than cores), and the list of files is held by the driver: one row for 256 MB of text.
A failed attempt leaves a file that no list names.

Defined results: a null text is empty and gives the end id alone; a null document id sorts
first and is read back as null; rows of one id stand in the order of a hash of their texts, then
of the texts, and may be in several files; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import shared_dir

BLOCK_IDS, END_ID, KNOWN_UNITS = 1 << 16, 2, 1_500_000
FILE_BYTES, LEAST_FILE_BYTES = 256 << 20, 8 << 20
MAGIC = b"FBP1"
FOOTER = struct.Struct("<4sIIxxxxQQ")
NO_ID = -(1 << 63)
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: First bytes of code points among which there is white space.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_PUNCTUATION[list(b".,;:!?#*$%&|")] = True


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1).astype(np.uint32)


class Writer:
    """Appends documents to one file; holds at most about one block of ids."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.open_ids, self.open_n = sink, width, [], 0
        self.table, self.offsets, self.n = [], [0], 0

    def add(self, ids: np.ndarray, docs: list[tuple[int | None, int]]) -> None:
        """`ids` of whole documents, `docs` their (id, number of ids)."""
        self.table += [(NO_ID if d is None else d, n) for d, n in docs]
        self.n += len(ids)
        self.open_ids.append(ids)
        self.open_n += len(ids)
        if self.open_n >= BLOCK_IDS:
            ids = np.concatenate(self.open_ids)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for a in range(0, whole, BLOCK_IDS):
                self._block(ids[a : a + BLOCK_IDS])
            self.open_ids, self.open_n = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.open_n:
            self._block(np.concatenate(self.open_ids))
        self.sink.write(np.array(self.table, "<i8").reshape(-1, 2).tobytes())
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(FOOTER.pack(MAGIC, self.width, BLOCK_IDS, self.n, len(self.table)))
        self.sink.close()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        magic, self.width, self.block_ids, self.n, docs = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a packed token file")
        blocks = -(-self.n // self.block_ids)
        at = size - FOOTER.size - 8 * (blocks + 1)
        self.offsets = np.frombuffer(self._at(at, 8 * (blocks + 1)), "<u8").astype(np.int64)
        table = np.frombuffer(self._at(at - 16 * docs, 16 * docs), "<i8").reshape(-1, 2)
        self.doc_ids, self.counts = table[:, 0], table[:, 1]
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from `start` to `stop`, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, -(-stop // self.block_ids)
        data = self._at(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        zero, parts = self.offsets[a], []
        for k in range(a, b):
            n = min(self.block_ids, self.n - k * self.block_ids)
            parts.append(unpack(data[int(self.offsets[k] - zero) : int(self.offsets[k + 1] - zero)], self.width, n))
        return np.concatenate(parts)[start - a * self.block_ids : stop - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def units(block: tb.Block, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that can be encoded on their own.

    Texts are cut before a single space between words, around a single line end between
    words, and before punctuation that follows a letter: pieces always end there.  A special
    token is a unit of its own.
    """
    data, n = block.data, len(block.data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        plain = ~tb.IS_SEP[data]
        alone = np.flatnonzero(plain[:-2] & plain[2:] & ~plain[1:-1]) + 1
        alone = alone[~(_MAY_BE_SPACE[data[np.maximum(alone - 2, 0)]] | _MAY_BE_SPACE[data[np.maximum(alone - 3, 0)]])]
        space, line = alone[data[alone] == 32], alone[data[alone] == 10]
        line = line[~_MAY_BE_SPACE[data[line + 1]]]
        cut[space] = cut[line] = cut[line + 1] = True
        cut[1:n] |= _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
    found = _special_spans(block, specials)
    for a, b in found:
        cut[a : b + 1] = False
    for a, b in found:
        cut[a] = cut[b] = True
    cut[block.start] = True
    cut[n] = False
    begin = np.flatnonzero(cut)
    return begin, np.append(begin[1:], n)


def _special_spans(block: tb.Block, specials: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping places of special tokens, each within a document."""
    raw, found = block.data.tobytes() if specials else b"", []
    for word in specials:
        at = raw.find(word)
        while at >= 0:
            if np.searchsorted(block.start, at, "right") == np.searchsorted(block.start, at + len(word) - 1, "right"):
                found.append((at, -(at + len(word))))
            at = raw.find(word, at + 1)
    out, last = [], 0
    for a, b in sorted(found):
        if a >= last:
            out.append((a, -b))
            last = -b
    return out


@dataclass
class Tokenizer:
    """`encode` turns texts into ids, `spans` holds the bytes of each id's token, `specials` the special tokens that it looks for."""

    encode: Callable[[list[str]], list[list[int]]]
    spans: np.ndarray
    specials: tuple[bytes, ...] = ()


class UnitEncoder:
    """Encodes blocks of texts; keeps the ids of at most `KNOWN_UNITS` units in arrays, in the order of their hashes."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.block = tokenizer, 0
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some units, and the number of ids of each.

        Words with their space are encoded a thousand in a text, and told apart by their tokens' bytes.
        """
        joined, single = [], []
        for n, name in enumerate(names):
            word = len(name) > 1 and name[0] == 32 and name[1] > 32 and not _MAY_BE_SPACE[name[1]] and 32 < name[-1] < 127
            (joined if word else single).append(n)
        groups = [joined[a : a + 1000] for a in range(0, len(joined), 1000)]
        coded = self.tokenizer.encode([b"".join([names[n] for n in g]).decode() for g in groups] + [names[n].decode() for n in single])
        length, parts = np.zeros(len(names), np.int64), []
        for group, ids in zip(groups, coded, strict=False):
            codes = np.array(ids, np.uint32)
            ends = np.cumsum(self.tokenizer.spans[codes])
            length[group] = np.diff(np.searchsorted(ends, np.cumsum([len(names[n]) for n in group])) + 1, prepend=0)
            parts.append(codes)
        length[single] = [len(ids) for ids in coded[len(groups) :]]
        parts.append(np.fromiter(chain.from_iterable(coded[len(groups) :]), np.uint32))
        pool, order = np.concatenate(parts), np.array(joined + single, np.int64)
        start = np.empty(len(names), np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return pool[_ranges(start, length)], length

    def _add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        at = np.searchsorted(self.key, key)
        start = len(self.pool) + np.cumsum(length) - length
        new = {"key": key, "check": check, "start": start, "length": length, "used": np.full(len(key), self.block)}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.pool = np.concatenate([self.pool, ids])

    def _forget(self) -> None:
        """Keeps the half of the units that were used last."""
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        self.pool = self.pool[_ranges(self.start[keep], self.length[keep])]
        for name in ("key", "check", "length", "used"):
            setattr(self, name, getattr(self, name)[keep])
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the number of ids of each document."""
        if not len(block.data):
            return np.zeros(0, np.uint32), np.zeros(block.n, np.int64)
        begin, end = units(block, self.tokenizer.specials)
        hashes, checks = (tb.span_hashes(block.data, begin, end, seed=seed) for seed in (0, 1))
        key, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        check = checks[one]
        if (check[inverse] != checks).any():  # different units of equal hashes
            both = np.stack([hashes, checks], 1)
            both, one, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True)
            (key, check), inverse = both.T.copy(), inverse.ravel()
        self.block += 1
        if len(self.key) > KNOWN_UNITS:
            self._forget()
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = block.data.tobytes()
            ids, length = self.learn([raw[a:b] for a, b in zip(begin[one[fresh]].tolist(), end[one[fresh]].tolist(), strict=True)])
            zero = len(self.pool)
            starts, lengths = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            starts[fresh], lengths[fresh] = zero + np.cumsum(length) - length, length
            self.used[at[known]] = self.block
            starts[known], lengths[known] = self.start[at[known]], self.length[at[known]]
            self._add(key[fresh], check[fresh], ids, length)
        else:
            self.used[at] = self.block
            starts, lengths = self.start[at], self.length[at]
        many = lengths[inverse]
        ids = self.pool[_ranges(starts[inverse], many)]
        total = np.concatenate(([0], np.cumsum(many)))
        places = np.searchsorted(begin, block.start)
        return ids, total[places[1:]] - total[places[:-1]]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range behind another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


@lru_cache(maxsize=2)
def library_tokenizer(path: str, special_tokens: bool = True) -> Tokenizer:
    """A tokenizer from a file of the tokenizers library.

    In a byte-level vocabulary a token's name has one character per byte.
    """
    import os

    from tokenizers import Tokenizer as Library

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    library = Library.from_file(path)
    library.encode_special_tokens = not special_tokens
    added = library.get_added_tokens_decoder()
    spans = np.zeros(max([library.get_vocab_size(), *(n + 1 for n in added)]), np.int64)
    for name, n in library.get_vocab().items():
        spans[n] = len(name)
    specials = []
    for n, token in added.items():
        spans[n] = len(token.content.encode())
        if special_tokens or not token.special:
            if token.lstrip or token.rstrip or token.single_word or token.normalized:
                raise ValueError(f"the token {token.content} depends on the text around it")
            specials.append(token.content.encode())
    return Tokenizer(lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)], spans, tuple(specials))


@lru_cache(maxsize=2)
def unit_encoder(path: str, special_tokens: bool = True) -> UnitEncoder:
    """The encoder of a Python worker: what it has learned serves the tasks that follow."""
    return UnitEncoder(library_tokenizer(path, special_tokens))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """Ids of documents, each followed by the end id."""
    return np.insert(ids, np.cumsum(counts), end_id)


def write_tokens(
    df: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, special_tokens: bool = True, file_bytes: int = FILE_BYTES,
) -> list[dict]:
    """Writes all documents in ascending id order; returns the files in that order with their first global id."""
    rows = tb.id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    size, cores = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, df.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-size // min(file_bytes, max(LEAST_FILE_BYTES, size // (4 * cores)))))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text", "tie")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, writer, name, low, high = unit_encoder(tokenizer_path, special_tokens), None, "", None, None
        width = width_of(max(len(encoder.tokenizer.spans), end_id + 1))
        for batch in batches:
            ids, ties = batch.column(0).to_pylist(), batch.column(2)
            for block in tb.blocks(batch.column(1)):
                if writer is None:
                    name, low = f"{folder}/{uuid.uuid4().hex}.ids", (ids[block.row], ties[block.row].as_py())
                    system, path = fs.FileSystem.from_uri(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = Writer(system.open_output_stream(path), width)
                coded, counts = encoder(block)
                high = (ids[block.row + block.n - 1], ties[block.row + block.n - 1].as_py())
                writer.add(with_end(coded, counts, end_id), list(zip(ids[block.row : block.row + block.n], (counts + 1).tolist(), strict=True)))
        if writer is not None:
            writer.close()
            row = {"file": [name], "low": [low[0]], "low_tie": [low[1]], "high": [high[0]], "high_tie": [high[1]], "n": [writer.n]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("low", "low_tie", "high", "high_tie", "n"))]))

    files = [r.asDict() for r in ordered.mapInArrow(run, "file string, low long, low_tie long, high long, high_tie long, n long").collect()]
    files.sort(key=lambda r: (r["low"] is not None, r["low"] or 0, r["low_tie"], r["high"] or 0, r["high_tie"]))
    start = 0
    for r in files:
        r["start"], start = start, start + r["n"]
    return files


def read_tokens(spark, files: list[dict], with_ids: bool = False, step: int = 1 << 20) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and the ids), read from the files."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(uri)
                a = 0
                while a < len(reader.counts):
                    b = max(a + 1, int(np.searchsorted(reader.first, reader.first[a] + step, "right")) - 1)
                    ids, zero = reader.ids(int(reader.first[a]), int(reader.first[b])), reader.first[a]
                    parts = [ids[reader.first[k] - zero : reader.first[k + 1] - zero] for k in range(a, b)]
                    columns = [
                        pa.array([None if d == NO_ID else d for d in reader.doc_ids[a:b].tolist()], pa.int64()), pa.array(reader.first[a:b] + start),
                        pa.array(reader.counts[a:b]), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    a = b

    listed = spark.createDataFrame([(r["file"], r["start"]) for r in files], "file string, start long").repartition(len(files))
    return listed.mapInArrow(run, schema)


def token_ids(df: DataFrame, tokenizer_path: str, **settings) -> DataFrame:
    """Encodes, writes and reads back: doc_id, start, n_tokens, ids_crc32 of each document."""
    files = write_tokens(df, tokenizer_path, shared_dir(df.sparkSession, "token-ids"), **settings)
    return read_tokens(df.sparkSession, files)
