"""Blocks of vectors: rows gathered to binary blocks, and blocks paired with blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows of one block; 4096 x 64 doubles are 2 MB.
BLOCK_ROWS = 4096
#: Queries of one block, and blocks of queries (2 MB each at 64 doubles) that are broadcast; beyond, both sides are shuffled.
QUERY_ROWS, BROADCAST_BYTES = 4096, 32 << 20


def usable(embedding: str = "embedding") -> Column:
    """Not null, not empty, and without null or non-finite components."""
    c = F.col(embedding)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad


def matrix_of(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as a matrix of floats or doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blocks(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors`` (vec_id, embedding, dim) as binary blocks (dim, n, ids, data) of at most ``rows``.

    Vectors of different lengths can't be compared; each block holds one length.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                dims = part.column(2).to_numpy()
                for dim in np.unique(dims).tolist():
                    of = pa.array(dims == dim)
                    ids = part.column(0).filter(of).to_numpy()
                    held.setdefault(dim, []).append((ids, matrix_of(part.column(1).filter(of))))
                    if sum(len(p[0]) for p in held[dim]) >= rows:
                        yield emit(dim)
        for dim in list(held):
            yield emit(dim)

    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    return columns.mapInArrow(gather, "dim int, n int, ids binary, data binary")


def read_block(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    width = np.float32 if len(data) == 4 * dim * len(names) else np.float64
    return names, np.frombuffer(data, width).reshape(-1, dim).astype(np.float64)


def with_queries(held: DataFrame, queries: DataFrame, name: str) -> DataFrame | None:
    """``held`` (blocks of rows, with dim) beside each block of ``queries``: q, q_ids, q_data; None without queries.

    Blocks of queries meet blocks of rows by an equality join on the number of the query block, so
    tasks grow in number and not in size.  Few queries are broadcast and no row is shuffled; of
    many, each ``QUERY_ROWS`` cost a copy of the rows.
    """
    asked = staged(blocks(queries, QUERY_ROWS).withColumn("q", F.monotonically_increasing_id()), name)
    sides = asked.select("q", F.length("data").alias("size")).collect()  # one number per query block
    if not sides:
        return None
    side = asked.select("q", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    if sum(r["size"] for r in sides) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return held.withColumn("q", F.explode(F.lit([r["q"] for r in sides]))).join(side, "q").where("dim = q_dim")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each row i of query block q in ``found``."""
    order = Window.partitionBy("q", "i").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
