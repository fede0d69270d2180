"""Best-fit packing of token sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most ``capacity`` entries, whatever the corpus
holds.  A configuration (pattern) is a multiset of lengths that fit one sequence.  The linear
program "use as few patterns as cover the histogram" is solved by multiplicative weights on the
prices of its lengths, an unbounded-knapsack dynamic program finding the best patterns of each
round; every round also bounds from below how few sequences any packing needs.  The prices then
guide the rounding: patterns of most worth are used in whole numbers while stock lasts, and what
is left goes best-fit decreasing.  The plan is a few thousand pattern slots, each a run of ranks
within a length, so that every piece finds its place by arithmetic on its own rank.

Defined results: a null or empty text is one piece of the end id; repeated rows are packed each
for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encoding
from .common import staged, table, text_slices

CAPACITY = 2048
#: Rounds of weights; leans of the rounding; how far above the program's bound a plan is taken at once.
ROUNDS, LEANS, GOOD_ENOUGH = 60, (0.3, 0.1, 1.0), 0.003
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its rank among the task's pieces of that length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = encoding.encoder(vocabulary), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, end, data, at in text_slices(batch.column(1)):
                found, starts = encoder.encode(data, at)
                little = np.insert(found, starts[1:], end_id).astype("<u4").tobytes()
                sizes = np.diff(starts) + 1
                begin = np.cumsum(sizes) - sizes
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), count)
                number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at_byte = ((begin[row] + start) * 4).tolist()
                crc = [zlib.crc32(little[a : a + 4 * n]) for a, n in zip(at_byte, length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                same = length[order]
                head = np.searchsorted(same, same)
                rank = np.empty(len(row), np.int64)
                rank[order] = met[same] + np.arange(len(row)) - head
                met += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(first, end - first).take(pa.array(row)),
                        "piece": pa.array(number, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "task": pa.array(np.full(len(row), task), pa.int32()),
                        "local_rank": pa.array(rank, pa.int64()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


class Pricing:
    """An unbounded knapsack over ``lengths`` (ascending) by dynamic programming: the most worth in every room."""

    def __init__(self, lengths: np.ndarray, worth: np.ndarray, capacity: int):
        best = np.zeros(capacity + 1)
        last = np.full(capacity + 1, -1)
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
        for c in range(int(lengths[0]), capacity + 1):
            total = best[c - lengths[: fits[c]]] + worth[: fits[c]]
            k = int(total.argmax())
            if total[k] > best[c - 1]:
                best[c], last[c] = total[k], k
            else:
                best[c] = best[c - 1]
        self.last, self.sizes, self.capacity = last.tolist(), lengths.tolist(), capacity
        #: For each length the worth of the best pattern that holds it.
        self.with_ = best[capacity - lengths] + worth

    def pattern(self, i: int) -> Counter:
        """The best pattern that holds length number ``i``, as numbers of lengths."""
        chosen = Counter([i])
        c = self.capacity - self.sizes[i]
        while c > 0:
            k = self.last[c]
            if k < 0:
                c -= 1
            else:
                chosen[k] += 1
                c -= self.sizes[k]
        return chosen


def solve_program(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The linear program's dual by multiplicative weights: a lower bound of the sequences, and its prices.

    Each round prices every length's best pattern with one knapsack; all patterns nearly as good
    as the best ask for their lengths, and the prices of what is asked for most fall.  Any prices
    under which no pattern is worth more than 1 bound the number of sequences by what the
    histogram is worth; the best round's are returned.
    """
    log_price = np.log(lengths / capacity)
    bound, prices = 0.0, lengths / capacity
    for r in range(rounds * min(5, 1 + 200 // len(lengths))):  # the fewer lengths, the cheaper a round and the sooner it pays
        price = np.exp(log_price - log_price.max())
        found = Pricing(lengths, price, capacity)
        most = found.with_.max()
        if float((need * price).sum() / most) > bound:
            bound, prices = float((need * price).sum() / most), price / most
        asked = np.zeros(len(lengths))
        for i in np.flatnonzero(found.with_ >= (1 - 0.3 / (r + 3)) * most).tolist():
            pattern = found.pattern(i)
            times = min(need[k] / c for k, c in pattern.items())
            for k, c in pattern.items():
                asked[k] += c * times / need[k]
        log_price -= 0.5 / (r + 5) * np.clip(asked / max(asked.mean(), 1e-9) - 1, -1, 2)
    return bound, prices


def rounded(lengths: np.ndarray, need: np.ndarray, prices: np.ndarray, capacity: int, lean: float) -> list[tuple[Counter, int]]:
    """Whole uses of patterns that hold exactly ``need``: by the program's prices, leaning to lengths of which most is left.

    Patterns worth nearly as much as the best are used for an eighth of what stock allows, then
    the rest is priced again; where none fits the stock, worse ones may.  The end goes best-fit.
    """
    stock = need.astype(np.int64)
    plan: list[tuple[Counter, int]] = []
    slack = 0.001
    while stock.any() and slack < 0.3:
        alive = np.flatnonzero(stock)
        found = Pricing(lengths[alive], prices[alive] * (1 + lean * stock[alive] / need[alive]), capacity)
        used = False
        for i in np.flatnonzero(found.with_ >= (1 - slack) * found.with_.max())[::-1].tolist():
            pattern = found.pattern(i)
            times = min(int(stock[alive[k]]) // c for k, c in pattern.items())
            if times:
                times = max(1, times // 8)
                for k, c in pattern.items():
                    stock[alive[k]] -= c * times
                plan.append((Counter({int(lengths[alive[k]]): c for k, c in pattern.items()}), times))
                used = True
        if not used:
            slack *= 2
    return plan + best_fit_decreasing(Counter({int(n): int(k) for n, k in zip(lengths, stock, strict=True) if k}), capacity)


def solve_patterns(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[Counter, int]]:
    """Patterns and how often each is used; together they hold exactly the histogram.

    Of best fit alone and the program rounded with each of ``LEANS``, the plan of fewest sequences;
    no more are tried once one is within ``GOOD_ENOUGH`` of the program's bound.
    """
    left = Counter({n: k for n, k in histogram.items() if n < capacity and k})
    whole = [(Counter({capacity: 1}), histogram[capacity])] if histogram.get(capacity) else []
    if not left:
        return whole
    lengths = np.array(sorted(left), np.int64)
    need = np.array([left[n] for n in lengths.tolist()], np.int64)
    sequences = lambda plan: sum(times for _, times in plan)
    bound, prices = solve_program(lengths, need, capacity, rounds)
    best = rounded(lengths, need, prices, capacity, LEANS[0])
    for other in (*(lambda lean=lean: rounded(lengths, need, prices, capacity, lean) for lean in LEANS[1:]), lambda: best_fit_decreasing(left, capacity)):
        if sequences(best) <= np.ceil(bound - 1e-6) * (1 + GOOD_ENOUGH):
            break
        best = min(best, other(), key=sequences)
    return best + whole


def best_fit_decreasing(left: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """Best fit on the histogram itself: a pattern is filled greedily and used as often as stock allows."""
    plan: list[tuple[Counter, int]] = []
    stock = dict(left)
    sizes = sorted(stock, reverse=True)
    while sizes:
        pattern: Counter = Counter()
        room, from_ = capacity, np.array(sizes)
        while True:
            fits = from_[from_ <= room]
            fits = [int(n) for n in fits[:1] if stock[int(n)] > pattern[int(n)]] or next(([int(n)] for n in fits if stock[int(n)] > pattern[int(n)]), [])
            if not fits:
                break
            pattern[fits[0]] += 1
            room -= fits[0]
        times = min(stock[n] // k for n, k in pattern.items())
        plan.append((pattern, times))
        for n, k in pattern.items():
            stock[n] -= k * times
        sizes = [n for n in sizes if stock[n]]
    return plan


def slots(plan: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: (length, first rank, uses, first sequence, offset), by length and rank."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            for _ in range(pattern[n]):
                rows.append((n, taken[n], times, sequence, offset))
                taken[n] += times
                offset += n
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "uses", "sequence", "offset"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Place staged ``pieces`` (as ``cut_pieces`` gives them): adds sequence_id and offset."""
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("k"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = slots(solve_patterns(histogram, capacity, rounds))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"))
    span = int(plan["first"].max(initial=0)) + int(plan["uses"].max(initial=0)) + 1
    runs = plan["length"] * span + plan["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("local_rank").to_numpy() + batch.column("base").to_numpy()
            run = np.searchsorted(runs, length * span + rank, "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            sequence = plan["sequence"][run] + rank - plan["first"][run]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(plan["offset"][run], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.join(base, ["task", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Cut ``docs`` into pieces and pack them; the pieces are staged, the texts are read once."""
    return pack(staged(cut_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), encoding.vocabulary_path())
