"""Exact top-k by inner product without random access.

Within a block of vectors every dimension is a list sorted by its component.  A query reads the
lists with a positive weight from the top and those with a negative weight from the bottom, all
to the same depth.  What it has read of a vector is summed up, for all queries and the places of
one round at once; a component not read yet lies
between the list's far end and the place where reading stands, which bounds the vector's score
from below and above.  Reading goes on, the unread rest of the lists halving with every round,
until no more than ``LEAST_LEFT`` times k vectors can still reach the k-th best lower bound;
vectors that can't are read no further.  The few that are left are resolved exactly.  Queries go
``TOGETHER`` at a time; all numbers are integers below 2**53, so doubles hold them exactly.

The k-th best score that a query has met in earlier blocks of the task also stops its reading.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part; vectors of another length than the query's aren't candidates; repeated rows are candidates
each for itself, but rows with the query's own vec_id are not; repeated queries are answered each
for itself, with k ranks each; ties go to the smaller vec_id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import blocks, ranked, read_block, usable, with_queries

#: Vectors in question, as a multiple of k, at which reading ends.
LEAST_LEFT = 2
#: Rows of one set of sorted lists, and queries that read them together.
LIST_ROWS, TOGETHER = 16_384, 64
FOUND = "q long, i int, query_id long, vec_id long, score long"


class Lists:
    """A block of vectors as one sorted list for each dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.n, self.dim = rows.shape
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(rows, self.order, axis=0)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)

    def in_question(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[np.ndarray]:
        """For each query the row numbers that may be among its k best, ties included.

        ``own`` marks (query, row) pairs that aren't candidates; ``floor`` holds for each query a
        score that k candidates elsewhere reach.
        """
        who, queries = np.arange(len(queries)), queries.astype(np.float64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(who)
        least, most = self.sorted[0], self.sorted[-1]
        known, alive, kth = np.zeros((self.n, len(who))), ~own.T, floor.astype(np.float64)
        here, read = np.arange(self.n), 0
        while len(who):
            up, down = np.maximum(queries, 0), np.minimum(queries, 0)
            depth = read + (self.n - read + 1) // 2
            # the places that this round reads; all others count 0
            place, rows = self.place[here], self.rows[here]
            top, bottom = (place >= self.n - depth) & (place < self.n - read), (place >= read) & (place < depth)
            known[here] += np.where(top, rows, 0.0) @ up.T + np.where(bottom, rows, 0.0) @ down.T
            read = depth
            upper = lower = known[here]
            if read < self.n:
                # a component not read yet lies beyond the place where reading stands
                high, low = (place < self.n - read).astype(np.float64), (place >= read).astype(np.float64)
                upper = known[here] + high @ (up * self.sorted[self.n - read]).T + low @ (down * self.sorted[read - 1]).T
                lower = known[here] + high @ (up * least).T + low @ (down * most).T
            live = alive[here]
            if len(here) >= k:
                kth = np.maximum(kth, np.partition(np.where(live, lower, -np.inf), len(here) - k, axis=0)[len(here) - k])
            live &= upper >= kth
            open_ = (live.sum(axis=0) > LEAST_LEFT * k) & (read < self.n)
            for i in np.flatnonzero(~open_).tolist():
                out[who[i]] = here[live[:, i]]
            alive = np.zeros((self.n, int(open_.sum())), bool)
            alive[here] = live[:, open_]
            who, queries, known, kth = who[open_], queries[open_], known[:, open_], kth[open_]
            here = here[live[:, open_].any(axis=1)]
        return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for the k best of ``vectors`` by integer inner product.

    Both frames have vec_id and an integer ``embedding``.
    """
    doubles = lambda df: df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    paired = with_queries(blocks(doubles(vectors), LIST_ROWS), doubles(queries), "query-blocks")
    if paired is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for q, dim, ids, data, q_ids, q_data in zip(*(batch.column(c).to_pylist() for c in ("q", "dim", "ids", "data", "q_ids", "q_data")), strict=True):
                row_ids, rows = read_block(ids, data, dim)
                query_ids, query = read_block(q_ids, q_data, dim)
                floor = met.setdefault(q, np.full(len(query_ids), -np.inf))
                lists = Lists(rows)
                out: list[tuple[np.ndarray, ...]] = []
                for first in range(0, len(query_ids), TOGETHER):
                    part = slice(first, first + TOGETHER)
                    own = query_ids[part, None] == row_ids[None, :]
                    for i, maybe in enumerate(lists.in_question(query[part], own, k, floor[part]), first):
                        scores = rows[maybe] @ query[i]
                        best = best_of(row_ids[maybe], scores, k)
                        if len(best) == k:
                            floor[i] = max(floor[i], scores[best[-1]])
                        out.append((np.full(len(best), q), np.full(len(best), i, np.int32), np.full(len(best), query_ids[i]), row_ids[maybe][best], scores[best].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["q", "i", "query_id", "vec_id", "score"])

    return ranked(paired.mapInArrow(search, FOUND), k)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = table(spark, sf_dir, "embeddings").where(usable()).select("vec_id", F.transform("embedding", lambda x: F.floor(1024 * x.cast("double"))).alias("embedding"))
    return exact_topk(scaled, scaled.where("vec_id % 100 = 0"), 10)


ORACLE = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.n, q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from (select * from v where vec_id % 100 = 0) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
