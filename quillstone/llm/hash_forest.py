"""Approximate nearest neighbours by a hash-prefix forest.

A tree hashes a vector to a string of 32 bits, the sides of 32 orthonormal hyperplanes, and is
the sorted array of the strings of a block of rows.  ``index`` builds the trees of every row once
and writes them beside the rows, as Parquet in the shared folder.  A query descends in every tree
of a block by binary search to its longest matching prefix, whose length varies, and then ascends
in all trees at once, from the longest match of any: with each level the range of rows that share
the shorter prefix widens, and every row in a tree's range is met once more.  Ascending ends as
soon as ``share`` of the block's rows have been met ``MET`` times; those met most often are
ranked by the exact cosine.  The planes depend on ``seed`` alone, nothing is learned, and every
row is indexed.

The share is what recall asks for: without clusters in the data the fifth neighbour of a query
is little nearer than a hundred others, and fewer candidates lose it (figures in the README).

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors of another length than the query's aren't candidates; repeated rows are
candidates each for itself, but rows with the query's own vec_id are not; repeated queries are
answered each for itself, with k ranks each; ties go to the smaller vec_id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import blocks, ranked, read_block, usable, with_queries

TREES, BITS, STEM, SHARE, MET, SEED = 128, 32, 12, 0.2, 16, 20
#: Queries that descend together.
TOGETHER = 256
FOUND = "q long, i int, query_id long, vec_id long, score double, scored long"


class Forest:
    """The trees over one block of rows: for each the sorted strings, and the row of each."""

    def __init__(self, strings: np.ndarray, order: np.ndarray):
        self.strings = strings
        self.n = strings.shape[1]
        self.flat = order.astype(np.intp).ravel()
        self.order = list(self.flat.reshape(order.shape))
        self.first = np.arange(len(order)) * self.n
        # where each prefix of STEM bits begins in each tree; shorter prefixes are runs of these
        stems = np.arange((1 << STEM) + 1, dtype=np.uint64) << np.uint64(BITS - STEM)
        self.begins = np.array([np.searchsorted(x, stems) for x in strings.astype(np.uint64)])

    @classmethod
    def grown(cls, rows: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
        strings = hash_strings(rows, planes_of(rows.shape[1], trees, seed))
        order = np.argsort(strings, axis=1, kind="stable")
        return cls(np.take_along_axis(strings, order, axis=1), order)

    def descend(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (column of ``own``) and tree the length of its longest match; and for each
        level, tree and query the range of rows that share a prefix of so many bits (levels x 2 x trees x queries)."""
        longest = np.zeros(own.shape, np.int64)
        ranges = np.zeros((BITS + 1, 2, *own.shape), np.int64)
        for t, (strings, codes) in enumerate(zip(self.strings, own, strict=True)):
            at = np.searchsorted(strings, codes)
            for near in (strings[np.maximum(0, at - 1)], strings[np.minimum(self.n - 1, at)]):
                longest[t] = np.maximum(longest[t], BITS - np.frexp((near ^ codes).astype(np.float64))[1])
            for level in range(1, min(BITS, int(longest[t].max())) + 1):
                rest = BITS - level
                low = codes.astype(np.uint64) >> np.uint64(rest)
                if level <= STEM:
                    step = np.uint64(STEM - level)
                    ranges[level, 0, t], ranges[level, 1, t] = self.begins[t, low << step], self.begins[t, (low + np.uint64(1)) << step]
                else:
                    some = np.flatnonzero(longest[t] >= level)
                    wide = strings.astype(np.uint64)
                    for side in (0, 1):
                        ranges[level, side, t, some] = np.searchsorted(wide, (low[some] + np.uint64(side)) << np.uint64(rest))
        return longest, ranges

    def ascend(self, longest: int, ranges: np.ndarray, wanted: int) -> np.ndarray:
        """How often a query meets each row on its way up, until ``wanted`` rows have been met ``MET`` times.

        ``ranges`` holds the query's range in each tree by level (levels x 2 x trees).
        """
        met = np.zeros(self.n, np.int64)
        entries = 0
        for level in range(longest, 0, -1):
            start, end = ranges[level]
            size = end - start
            if size.sum() > 16 * len(size):
                found = np.concatenate([order[a:b] for order, a, b in zip(self.order, start.tolist(), end.tolist(), strict=True)])
            else:  # many short ranges are one gather
                stop = np.cumsum(size)
                found = self.flat[np.arange(stop[-1]) + np.repeat(self.first + start - stop + size, size)]
            met += np.bincount(found, minlength=self.n)
            entries += len(found)
            if entries >= MET * wanted and np.count_nonzero(met >= MET) >= wanted:
                break
        return met


def planes_of(dim: int, trees: int, seed: int) -> np.ndarray:
    """``BITS`` hyperplanes for each tree, orthonormal within each run of ``dim``, side by side."""
    rng = np.random.default_rng(seed)
    runs = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-BITS * trees // dim))]
    return np.concatenate(runs, axis=1)[:, : BITS * trees]


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each tree (a row) and vector the string, as a number whose first bit is the string's."""
    out = np.empty((planes.shape[1] // BITS, len(vectors)), np.uint32)
    for t in range(len(out)):
        bits = np.packbits(vectors @ planes[:, t * BITS : (t + 1) * BITS] > 0, axis=1)
        out[t] = np.ascontiguousarray(bits).view(">u4")[:, 0]
    return out


def index(vectors: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Staged blocks of ``vectors`` (vec_id, embedding) with their trees: dim, n, ids, data, strings, order."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, rows = read_block(row.column("ids")[0].as_py(), row.column("data")[0].as_py(), row.column("dim")[0].as_py())
                forest = Forest.grown(rows, trees, seed)
                order = np.array(forest.order).astype(np.uint16 if len(rows) <= 1 << 16 else np.uint32)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([forest.strings.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())], names=[*row.schema.names, "strings", "order"])

    return staged(blocks(vectors).mapInArrow(grow, "dim int, n int, ids binary, data binary, strings binary, order binary"), "forest")


def nearest(indexed: DataFrame, queries: DataFrame, k: int, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score for the k nearest found by cosine in what ``index`` made with ``seed``."""
    paired = with_queries(indexed, queries, "forest-queries")
    if paired is None:
        return indexed.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ranked(paired.mapInArrow(lambda batches: _search(batches, k, share, seed), FOUND), k)


def _search(batches: Iterator[pa.RecordBatch], k: int, share: float, seed: int) -> Iterator[pa.RecordBatch]:
    hashed: dict[int, np.ndarray] = {}
    for batch in batches:
        for q, dim, n, ids, data, strings, order, q_ids, q_data in zip(*(batch.column(c).to_pylist() for c in ("q", "dim", "n", "ids", "data", "strings", "order", "q_ids", "q_data")), strict=True):
            row_ids, rows = read_block(ids, data, dim)
            query_ids, query = read_block(q_ids, q_data, dim)
            norm, q_norm = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((query * query).sum(axis=1))
            sorted_ = np.frombuffer(strings, np.uint32).reshape(-1, n)
            forest = Forest(sorted_, np.frombuffer(order, np.uint16 if n <= 1 << 16 else np.uint32).reshape(-1, n))
            if q not in hashed:
                hashed = {q: hash_strings(query, planes_of(dim, len(sorted_), seed))}
            wanted = min(n, max(8 * k, int(np.ceil(share * n))))
            out = []
            for i in range(len(query_ids)):
                if i % TOGETHER == 0:
                    longest, ranges = forest.descend(hashed[q][:, i : i + TOGETHER])
                met = forest.ascend(int(longest[:, i % TOGETHER].max()), ranges[..., i % TOGETHER], wanted)
                met[row_ids == query_ids[i]] = -1
                maybe = np.argpartition(-met, wanted - 1)[:wanted]
                maybe = maybe[met[maybe] > 0]
                # the same order of additions for every row, so that equal vectors score alike
                scores = (rows[maybe] * query[i]).sum(axis=1) / (norm[maybe] * q_norm[i])
                best = np.lexsort((row_ids[maybe], -scores))[:k]
                out.append((np.full(len(best), q), np.full(len(best), i, np.int32), np.full(len(best), query_ids[i]), row_ids[maybe][best], scores[best], np.full(len(best), len(maybe))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["q", "i", "query_id", "vec_id", "score", "scored"])


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.exists("embedding", lambda x: x != 0)
    vectors = table(spark, sf_dir, "embeddings").where(usable()).where(some).select("vec_id", "embedding")
    return nearest(index(vectors), vectors.where("vec_id % 50 = 0"), 5)
