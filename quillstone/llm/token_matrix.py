"""Token ids as wavelet matrices, one compressed file entry per shard.

``write_token_shards`` encodes whole texts in ascending doc_id order and writes one wavelet
matrix per shard as a row of a Parquet folder in the shared storage; Spark's committer makes
lost executors harmless.  ``read_documents`` reads that folder back.  ``WaveletMatrix`` opens
one entry and gives token access, counting and occurrence lookup by rank and select.

Defined results: a null or empty text has the end id only; repeated rows are kept, ties of
doc_id stand in the order of a hash of their texts, null doc_ids come first; an empty table
gives no shard and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encoding
from .common import shared_dir, table, text_slices

#: The entry's first bytes, and the layout of its header: bits, tokens, documents, null ids.
MAGIC, HEADER = b"QWM2", struct.Struct("<4sIQQ")
#: Positions between two stored ranks.
BLOCK = 512
#: A shard is closed once it holds so many tokens; a longer document still stays whole.
SHARD_TOKENS = 1 << 20


def _levels(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bit-plane of each level from the top, as booleans in that level's order."""
    for bit in range(bits - 1, -1, -1):
        plane = (ids >> ids.dtype.type(bit)) & ids.dtype.type(1) > 0
        yield plane
        ids = np.concatenate([ids[~plane], ids[plane]])


def _ranks(plane: np.ndarray) -> np.ndarray:
    """The ones before each ``BLOCK`` of a packed plane, and in all of it; a shard has fewer than 2**32 ids."""
    step = BLOCK // 8
    blocks = np.pad(plane, (0, -len(plane) % step)).reshape(-1, step // 8, 8).view(np.uint64)[..., 0]
    return np.concatenate([[0], np.cumsum(np.bitwise_count(blocks).sum(1, dtype=np.int64))])


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """One shard as bytes: header, document table, the ranks of all bit-planes, then each plane compressed by itself."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    squeeze = zstandard.ZstdCompressor(level=1).compress
    names = np.array([0 if d is None else d for d in doc_ids], np.int64)
    absent = np.array([d is None for d in doc_ids], bool)
    planes = [np.packbits(plane, bitorder="little") for plane in _levels(ids, bits)]
    ranks = np.array([_ranks(plane) for plane in planes], np.uint32)
    parts = [squeeze(x.tobytes()) for x in (names, absent, lengths.astype(np.int64), ranks, *planes)]
    sizes = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return b"".join([HEADER.pack(MAGIC, bits, len(ids), len(names)), sizes, *parts])


class WaveletMatrix:
    """An opened shard.  The file holds the rank of every ``BLOCK``-th position; the rest is counted in the plane.

    ``select`` finds its block by binary search in the stored ranks.
    """

    def __init__(self, data: bytes):
        magic, self.bits, self.n, docs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        sizes = struct.unpack_from(f"<{self.bits + 4}Q", data, HEADER.size)
        at, parts = HEADER.size + 8 * len(sizes), []
        for size in sizes:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]))
            at += size
        self.doc_ids = np.frombuffer(parts[0], np.int64)
        self.absent = np.frombuffer(parts[1], bool)
        self.lengths = np.frombuffer(parts[2], np.int64)
        self.ranks = np.frombuffer(parts[3], np.uint32).reshape(self.bits, -1)
        self.planes = [np.frombuffer(p, np.uint8) for p in parts[4:]]

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the levels from the last to the first."""
        ids = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level, packed in zip(range(self.bits), reversed(self.planes), strict=True):
            plane = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            zeros = self.n - np.count_nonzero(plane)
            above = np.empty_like(ids)
            above[~plane] = ids[:zeros]
            above[plane] = ids[zeros:] | ids.dtype.type(1 << level)
            ids = above
        return ids

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block, plane = i // BLOCK, self.planes[level]
        whole = plane[block * BLOCK // 8 : i // 8]
        tail = int(plane[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0
        return int(self.ranks[level, block]) + int(np.bitwise_count(whole).sum()) + tail

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level, -1])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self.planes[level][i // 8] >> (i % 8) & 1
            ones = self._ones(level, i)
            value = value << 1 | int(bit)
            i = self._zeros(level) + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self._zeros(level) + a, self._zeros(level) + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs among the first i ids."""
        start, end = self._range(token, i)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0)."""
        start, end = self._range(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            goal = i - self._zeros(level) if one else i
            # the block that holds the goal-th bit of its kind, then its place within
            ranks = self.ranks[level].astype(np.int64)
            kind = ranks if one else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
            block = int(np.searchsorted(kind, goal, "right")) - 1
            bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
            i = block * BLOCK + int(np.flatnonzero(bits == one)[goal - int(kind[block])])
        return i


def write_token_shards(docs: DataFrame, vocabulary: str, end_id: int, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write the shards to ``path``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(vocabulary)
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            blob = pack(np.concatenate(ids), names, np.concatenate(lengths))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_tokens": pa.array([held], pa.int64()), "matrix": pa.array([blob], pa.binary())})

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, data, at in text_slices(batch.column(1)):
                found, starts = encoder.encode(data, at)
                ids.append(np.insert(found, starts[1:], end_id))
                lengths.append(np.diff(starts) + 1)
                names += doc_ids[first:end]
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield close()
                    number, held = number + 1, 0
                    ids, names, lengths = [], [], []
        if names:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    # ranges of doc_id and of the texts under one, so that a doc_id on many rows isn't one task
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(shards, "part int, number int, n_tokens long, matrix binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32, and its shard.

    A shard's start is a running sum over one row per shard, never over documents.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*(batch.column(c) for c in range(3)), strict=True):
                matrix = WaveletMatrix(blob.as_py())
                little = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                crc = [zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part.as_py()] * n, pa.int32()),
                        "number": pa.array([number.as_py()] * n, pa.int32()),
                        "doc_id": pa.array(matrix.doc_ids, pa.int64(), mask=matrix.absent),
                        "local_start": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(matrix.lengths, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    shards = spark.read.parquet(path)
    own = shards.select("part", "number", "matrix").mapInArrow(digests, "part int, number int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "number", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    return own.join(starts, ["part", "number"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "number")


def op7_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/quillstone/token-matrix-{uuid.uuid4().hex}"
    write_token_shards(table(spark, sf_dir, "documents"), encoding.vocabulary_path(), 1, path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
