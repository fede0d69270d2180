"""Shared pieces: the shared folder, staged tables and vectorised text handling."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, looked_up, shared_dir  # noqa: F401

#: Bytes of text handled at once by the vectorised readers; bounds their memory.
SLICE_BYTES = 2 << 20

#: The separators of the word pattern [^\x20\x09-\x0D]+.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same pattern for Spark's and DuckDB's regular expressions.
WORD_RE = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged frames that nothing will read again; others are left alone."""
    for df in frames:
        path = vars(df).pop("staged_path", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the decimal doc_id, mod ``modulus`` (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, and where each begins (one more for the end).  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) for runs of whole texts of about ``most`` bytes; one longer text is a run."""
    data, at = raw_text(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text where its words begin (one more for the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _IS_WORD[data]
    edge = at[:-1][at[:-1] < len(data)]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts_here = inside & ~before
    starts_here[edge] = inside[edge]
    ends_here = before & ~inside
    ends_here[edge] = before[edge]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, at)


def pieces(data: np.ndarray, breaks: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Spans of about ``most`` bytes that cover ``data``, each cut where ``breaks`` (a table by byte) allows it."""
    first, n = 0, len(data)
    while n - first > most:
        end, step = first + most, 1 << 12
        while end < n:
            at = np.flatnonzero(breaks[data[end : end + step]])
            if len(at):
                end += int(at[0])
                break
            end, step = min(n, end + step), 2 * step
        yield first, end
        first = end
    yield first, n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words, eight bytes at a time; with ``fold`` A-Z count as a-z.

    Each step scrambles what the last one left together with the next eight bytes, which isn't
    linear in them, so that no two words collide but by chance.  Words of more than ``LONG`` bytes
    go one by one through a keyed digest.
    """

    LONG = 512

    def __init__(self, seed: int = 7, fold: bool = True):
        self.key = np.random.default_rng(seed).bytes(16)
        self.seed = np.frombuffer(self.key, np.uint64)[0]
        self.low = np.arange(256, dtype=np.uint8)
        if fold:
            self.low[65:91] += 32
        self.fold = fold

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = self.low[data] if self.fold else data
        eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
        size = ends - starts
        h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ self.seed
        here = np.arange(len(size))
        if len(size) and size.max() > self.LONG:
            for i in np.flatnonzero(size > self.LONG).tolist():
                h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].data, digest_size=8, key=self.key).digest(), "little")
            here = np.flatnonzero(size <= self.LONG)
        at, left = starts[here], size[here]
        k = 0
        while len(here):
            chunk = eight[at + k]
            short = left - k < 8
            if short.any():
                chunk[short] &= (np.uint64(1) << ((left[short] - k).astype(np.uint64) << np.uint64(3))) - np.uint64(1)
            h[here] = mix64(h[here] ^ chunk)
            k += 8
            more = left > k
            here, at, left = here[more], at[more], left[more]
        return h
