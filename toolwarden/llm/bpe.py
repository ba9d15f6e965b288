"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are cut into pre-tokens ("words"), and every distinct word of the corpus is
encoded once: a block of documents numbers its words, and keeps each document as
the numbers of its words by position; the distinct words of all blocks are dealt
by a hash of the word, encoded, and their ids go back to the blocks that have
them, where documents are put together by position.  Decoding maps ids through
the table of token bytes, word by word, and joins by position in the same way.

A block has each of its words once, so no word is hot however frequent it is; the
words of a block travel as one compressed list per target.  The positions, as
compressed number arrays, are written once and stay where they lie: the table is
bucketed by block, so only the ids are shuffled to meet them.  Blocks hold about
``BLOCK`` code points, or one longer document.  Row and block numbers come from
tasks and live in that table.

Defined results: a NULL or empty text has no ids and the digests of nothing;
repeated rows are encoded as often as they occur; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import bucketed

#: Code points of a block of documents.
BLOCK = 8_000_000
_LOOSE = regex.compile(r" (?:\s|\Z)|[\x1c-\x1f]")

ROWS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("target", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("numbers", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])
_ARROW = pa.schema([
    ("block", pa.int64()), ("target", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("numbers", pa.binary()), ("payload", pa.binary()),
])
#: The target of the row that holds the documents of a block.
DOCUMENTS = -1


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed planes of bytes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed_words(words: list[bytes]) -> bytes:
    sizes = packed(np.array([len(w) for w in words], np.int64))
    body = zstandard.compress(b"".join(words), 1)
    return len(sizes).to_bytes(4, "little") + sizes + body


def unpacked_words(raw: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(raw[:4], "little")
    ends = np.cumsum(unpacked(raw[4:cut]))
    body = zstandard.decompress(raw[cut:])
    return [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Block:
    """Numbers the words of a block of documents.

    White space aside, a text is cut at single spaces first: where every space
    stands alone between other signs, pre-tokens never cross one, and each
    stretch between spaces needs the pattern only once per block."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.stretches: dict[str, int] = {}
        self.flat: list[int] = []
        self.ends: list[int] = []
        self.ids: list = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def _cut(self, text: str) -> int:
        words = self.words
        for w in self.find(text):
            self.flat.append(words.setdefault(w, len(words)))
        self.ends.append(len(self.flat))
        return len(self.ends) - 1

    def add(self, doc_id, text: str) -> None:
        self.ids.append(doc_id)
        self.size += len(text)
        if _LOOSE.search(text):
            found = [self._cut(text)]
        else:
            head, *rest = text.split(" ")
            if head not in self.heads:
                self.heads[head] = self._cut(head)
            known, found = self.stretches, [self.heads[head]]
            for part in rest:
                at = known.get(part)
                if at is None:
                    at = known[part] = self._cut(" " + part)
                found.append(at)
        self.docs.append(np.array(found, np.int64))

    def rows(self, block: int, targets: int) -> Iterator[dict]:
        flat, ends = np.array(self.flat, np.int64), np.array(self.ends, np.int64)
        parts = [tokens.ragged(flat, ends, d) for d in self.docs]
        everything = np.concatenate(parts)
        # Frequent words get small numbers, which compress well; those of a target are contiguous.
        names = np.array(list(self.words), object)
        raw = [w.encode() for w in names]
        target = np.array([xxhash.xxh3_64_intdigest(w) % targets for w in raw], np.int64)
        often = np.bincount(everything, minlength=len(raw))
        order = np.argsort(-often, kind="stable")
        renumbered = np.empty(len(raw), np.int64)
        renumbered[order] = np.arange(len(raw))
        yield {
            "block": block, "target": DOCUMENTS, "doc_ids": self.ids, "counts": [len(p) for p in parts],
            "numbers": None, "payload": packed(renumbered[everything]),
        }
        by_target = order[np.argsort(target[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(target[by_target])) + 1
        for group in np.split(by_target, cuts):
            if len(group):
                yield {
                    "block": block, "target": int(target[group[0]]), "doc_ids": None, "counts": None,
                    "numbers": packed(renumbered[group]), "payload": packed_words([raw[i] for i in group]),
                }


def numbered(docs: DataFrame, targets: int) -> DataFrame:
    """Blocks of documents as word numbers, and the words of each block by target."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 31, Block(pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, text or "")
                if block.size >= BLOCK:
                    for row in block.rows(number, targets):
                        yield pa.RecordBatch.from_pylist([row], schema=_ARROW)
                    number, block = number + 1, Block(pattern)
        if block.ids:
            for row in block.rows(number, targets):
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return bucketed(docs.select("doc_id", "text").mapInArrow(run, ROWS), "words", "block", targets)


def encoded_words(rows: DataFrame, path: str, targets: int) -> DataFrame:
    """The word lists of all blocks, with ids in place of the words; a word is encoded once per target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = tokens.byte_bpe(path), {}
        for batch in batches:
            for block, target, numbers, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
                found = []
                for w in unpacked_words(payload):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(encoder.encode_ordinary(w.decode()), np.uint32).tobytes()
                    found.append(ids)
                row = {"block": block, "target": target, "numbers": numbers, "payload": packed_words(found)}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    words = rows.where(F.col("target") != DOCUMENTS)
    return words.repartition(targets, "target").mapInArrow(run, ROWS)


def _assembled(documents: pa.Table, words: pa.Table, what) -> pa.Table:
    """Put the documents of one block together; ``what`` makes a row of a document's words."""
    ids: dict[int, bytes] = {}
    for row in words.select(["numbers", "payload"]).to_pylist():
        ids.update(zip(unpacked(row["numbers"]).tolist(), unpacked_words(row["payload"]), strict=True))
    (block,) = documents.to_pylist()
    numbers = unpacked(block["payload"])
    return what([ids[i] for i in range(len(ids))], block["doc_ids"], block["counts"], numbers)


def _by_block(docs: DataFrame, path: str, what, schema: T.StructType) -> DataFrame:
    """The results of ``what`` for the documents of all blocks."""
    targets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(docs, targets)
    documents = rows.where(F.col("target") == DOCUMENTS).groupBy("block")
    words = encoded_words(rows, path, targets).groupBy("block")
    return documents.cogroup(words).applyInArrow(lambda d, w: _assembled(d, w, what), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text."""
    schema = T.StructType().add("doc_id", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))

    def what(words: list[bytes], doc_ids: list, counts: list[int], numbers: np.ndarray) -> pa.Table:
        arrays = [np.frombuffer(w, np.uint32).astype(np.int64) for w in words]
        ends = np.cumsum([len(a) for a in arrays]) if arrays else np.zeros(0, np.int64)
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        cuts = np.cumsum(counts)[:-1]
        ids = [tokens.ragged(flat, ends, n).astype(np.int32) if len(n) else n.astype(np.int32) for n in np.split(numbers, cuts)]
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _by_block(docs, path, what, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``doc_id, bytes``: the bytes of each row's ids."""
    schema = T.StructType().add("doc_id", T.LongType()).add("bytes", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in tokens.ranks(path).items()}
        for batch in batches:
            rows = [b"".join([table[i] for i in x or ()]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", ids).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, and its ids decoded."""
    schema = (
        T.StructType().add("doc_id", T.LongType()).add("n_tokens", T.LongType())
        .add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    )

    def what(words: list[bytes], doc_ids: list, counts: list[int], numbers: np.ndarray) -> pa.Table:
        table = {i: b for b, i in tokens.ranks(path).items()}
        ids = [np.frombuffer(w, np.uint32).tolist() for w in words]
        sizes = np.array([len(i) for i in ids], np.int64)
        plain = [" ".join(map(str, i)) for i in ids]
        back = [b"".join([table[i] for i in found]) for found in ids]
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc_id, own in zip(doc_ids, np.split(numbers, np.cumsum(counts)[:-1]), strict=True):
            listed = own.tolist()
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(int(sizes[own].sum()))
            out["ids_sha256"].append(hashlib.sha256(" ".join([plain[i] for i in listed]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([back[i] for i in listed])).hexdigest())
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(out[n], t) for n, t in zip(schema.names, types, strict=True)], names=schema.names)

    return _by_block(docs, path, what, schema)
