"""Toxic passages as maximum-scoring segments.

Every word scores the log-odds of its strongest unit (the word itself or its first 4, 5 or 6
bytes) between toxic and clean labelled texts, estimated under a Dirichlet prior and kept only
where its z-score is at least ``LEAST_Z``; any other word scores ``-DRIFT``.  A linear-time scan finds all
maximal-scoring segments of a text.  By extreme-value theory a segment of score S in a text of m
words has E = K m exp(-lambda S) equals by chance, lambda solving the equation that makes the
scores' exponential mean 1 over clean text and K counted over clean texts; passages with 1 - exp(-E) <= ``SIGNIFICANT`` are
reported, and best passage, number of passages and their share of the text are turned into a
probability by a logistic fit.

Counts come from about ``PER_CLASS`` labelled documents of each class (a hash of doc_id holds a
quarter back for K and the logistic fit); each unit counts once a document.  Units below
``LEAST_Z`` keep no log-odds, as those are shrunk to 0.  Every text is scanned whole, a long one
piece by piece.

Defined results: null and empty texts have no passages and the score of a text without any;
without labels of both classes the score is the share of toxic labels, or 0 without any;
a label that is repeated counts once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WordHasher, discard, is_held_out, pieces, staged, table, text_slices
from .learning import fit_logistic, labelled_texts, logistic

PER_CLASS, PRIOR, LEAST_Z, LEAST_TEXTS, DRIFT = 8000, 0.5, 3.0, 3, 0.5
#: The scaled score from which clean texts' segments are counted to learn how many chance makes.
TAIL, SIGNIFICANT = 3.0, 0.05
PREFIXES = (4, 5, 6)
_KIND = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_hasher = WordHasher(31)


def letter_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letter bytes, and where each text's runs begin."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    if len(starts) and len(at) > 2:  # a run that reaches into the next text is two
        cuts = at[1:-1]
        k = np.searchsorted(starts, cuts, "right") - 1
        over = (k >= 0) & (starts[k] < cuts) & (ends[k] > cuts)
        cuts = np.unique(cuts[over])
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, at)


def unit_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each kind of unit the words' hashes; a word too short for a prefix repeats its own."""
    if not len(starts):
        return [np.zeros(0, np.int64)] * (len(PREFIXES) + 1)
    word = _hasher(data, starts, ends)
    out = [word]
    for kind, size in zip(_KIND[1:], PREFIXES, strict=True):
        long = ends - starts > size
        own = word.copy()
        if long.any():
            own[long] = _hasher(data, starts[long], starts[long] + size) ^ kind
        out.append(own)
    return [x.view(np.int64) for x in out]


def count_units(docs: DataFrame) -> DataFrame:
    """key, clean, toxic: in how many texts of ``docs`` (text, toxic) a unit occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for first, end, data, at in text_slices(batch.column(0)):
                starts, ends, words_at = letter_words(data, at)
                units = unit_hashes(data, starts, ends)
                own = [np.unique(np.concatenate([u[a:b] for u in units])) for a, b in zip(words_at[:-1], words_at[1:], strict=True)]
                keys = np.concatenate(own) if own else np.zeros(0, np.int64)
                mark = np.repeat(toxic[first:end], [len(x) for x in own])
                key, which = np.unique(keys, return_inverse=True)
                yes = np.bincount(which, weights=mark, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "clean": pa.array(np.bincount(which, minlength=len(key)) - yes), "toxic": pa.array(yes)})

    return docs.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def maximal_segments(at: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last position, score), in linear time.

    Only words of positive score are given, by position; all between them cost ``drift`` each.
    A stack holds candidates with the running total before and after each; a new one joins the
    latest that began lower, if that one ended no higher.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, before, after, the latest that began lower
    total, last = 0.0, -1
    for position, score in zip(at.tolist(), scores.tolist(), strict=True):
        total -= drift * (position - last - 1)
        first, before = position, total
        total += score
        last = position
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, position, before, total, j))
                break
            first, before = stack[j][0], stack[j][2]
            j = stack[j][4]
            del stack[next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == first) :]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


class Model:
    """The units' scores and the law of chance segments; ``fit`` is set by ``learn``."""

    def __init__(self, key: np.ndarray, clean: np.ndarray, toxic: np.ndarray, total_clean: int, total_toxic: int):
        a = PRIOR
        odds = np.log((toxic + a) / (total_toxic + a)) - np.log((clean + a) / (total_clean + a))
        order = np.argsort(key)
        self.key, self.score = key[order], (odds - DRIFT)[order]
        share = ((clean + a) / (total_clean + a))[order]
        low, high = 1e-3, 5.0
        for _ in range(60):
            mid = (low + high) / 2
            mean = (1 - min(0.9, share.sum())) * np.exp(-mid * DRIFT) + (share * np.exp(np.minimum(mid * self.score, 600))).sum()
            low, high = (mid, high) if mean < 1 else (low, mid)
        self.rate = low
        self.k = 1.0
        self.fit: np.ndarray | None = None
        self.prior = 0.0

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        best = np.full(len(starts), -DRIFT)
        if len(self.key):
            for unit in unit_hashes(data, starts, ends):
                where = np.minimum(np.searchsorted(self.key, unit), len(self.key) - 1)
                best = np.where(self.key[where] == unit, np.maximum(best, self.score[where]), best)
        return best

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number, score, start and end of the words of positive score, and where each text's words begin."""
        if len(at) != 2 or len(data) <= 2 * SLICE_BYTES:
            starts, ends, words_at = letter_words(data, at)
            scores = self.word_scores(data, starts, ends)
            own = np.flatnonzero(scores > 0)
            return own, scores[own], starts[own], ends[own], words_at
        parts, words = [], 0
        for a, b in pieces(data, ~_LETTER):  # one long text
            own, scores, starts, ends, words_at = self.hits(data[a:b], np.array([0, b - a]))
            parts.append((own + words, scores, starts + a, ends + a))
            words += int(words_at[1])
        return *(np.concatenate(x) for x in zip(*parts, strict=True)), np.array([0, words])

    def scan(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """For each text its features and its significant passages (byte offsets, score, p)."""
        hits, scores, starts, ends, words_at = self.hits(data, at)
        hits_at = np.searchsorted(hits, words_at)
        x = np.zeros((len(at) - 1, 3))
        passages: list[list[dict]] = [[] for _ in range(len(at) - 1)]
        for i in np.flatnonzero(np.diff(hits_at)).tolist():
            own = slice(hits_at[i], hits_at[i + 1])
            base, m = words_at[i], words_at[i + 1] - words_at[i]
            found = maximal_segments(hits[own] - base, scores[own])
            begin, end = dict(zip((hits[own] - base).tolist(), starts[own].tolist(), strict=True)), dict(zip((hits[own] - base).tolist(), ends[own].tolist(), strict=True))
            for a, b, score in found:
                chance = self.k * m * np.exp(-min(600.0, self.rate * score))
                p = -np.expm1(-chance)
                if p <= SIGNIFICANT:
                    passages[i].append({"start": int(begin[a] - at[i]), "end": int(end[b] - at[i]), "score": float(score), "p": float(p)})
            best = max(s for _, _, s in found)
            x[i] = self.rate * best - np.log(self.k * m), np.log1p(len(passages[i])), 1.0
        return x, passages

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(x, self.fit) if self.fit is not None else np.full(len(x), self.prior)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text)."""
    back = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) == 0
    texts = labelled_texts(docs, labels, "toxic", per_class, "toxic-sample")
    sample = texts.withColumn("back", back)
    sizes = {(r["toxic"], r["back"]): r["n"] for r in sample.groupBy("toxic", "back").agg(F.count("*").alias("n")).collect()}
    counted = staged(count_units(sample.where(~F.col("back")).dropDuplicates(["text"])), "toxic-units")
    totals = counted.agg(F.sum("clean"), F.sum("toxic")).first()
    clean, toxic = (int(x or 0) for x in totals)
    odds = F.log((F.col("toxic") + PRIOR) / (toxic + PRIOR)) - F.log((F.col("clean") + PRIOR) / (clean + PRIOR))
    z = odds / F.sqrt(1 / (F.col("toxic") + PRIOR) + 1 / (F.col("clean") + PRIOR))
    # the sample is bounded, and so are the units in it; of those few are so much likelier in toxic texts
    rows = counted.where((F.col("toxic") >= LEAST_TEXTS) & (z >= LEAST_Z) & (odds > 2 * DRIFT)).collect()
    discard(counted)
    model = Model(*(np.array([r[c] for r in rows], np.int64) for c in ("key", "clean", "toxic")), clean, toxic)
    n = sum(sizes.values())
    model.prior = sum(v for (t, _), v in sizes.items() if t == 1) / n if n else 0.0
    if all(sum(v for (t, _), v in sizes.items() if t == c) for c in (0, 1)):
        chance = chance_segments(sample.where("toxic = 0").where("back" if sizes.get((0, True)) else "true"), model).agg(F.sum("words"), F.sum("segments")).first()
        # as many segments of TAIL as clean texts have, and half a one more
        model.k = min(1.0, (int(chance[1] or 0) + 0.5) * float(np.exp(TAIL)) / max(1, int(chance[0] or 0)))
        fitted = "back" if all(sizes.get((c, True)) for c in (0, 1)) else "true"
        seen = features_of(sample.where(fitted).select("toxic", "text"), model).collect()  # at most about per_class / 2 rows of numbers
        seen.sort()
        # one passage-free clean and one certain toxic example more keep the fit finite
        x = np.array([r["x"] for r in seen] + [[0.0, 0.0, 0.0], [20.0, np.log(2.0), 1.0]])
        model.fit = fit_logistic(x, np.array([float(r["toxic"]) for r in seen] + [0.0, 1.0]))
    discard(texts)
    return model


def chance_segments(docs: DataFrame, model: Model) -> DataFrame:
    """words, segments: of each text how many words it has and how many segments of at least ``TAIL``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in text_slices(batch.column(0)):
                hits, scores, _, _, words_at = model.hits(data, at)
                hits_at = np.searchsorted(hits, words_at)
                found = [maximal_segments(hits[a:b], scores[a:b]) for a, b in zip(hits_at[:-1], hits_at[1:], strict=True)]
                count = [sum(model.rate * s >= TAIL for _, _, s in x) for x in found]
                yield pa.RecordBatch.from_pydict({"words": pa.array(np.diff(words_at), pa.int64()), "segments": pa.array(count, pa.int64())})

    return docs.select("text").mapInArrow(scan, "words long, segments long")


def features_of(docs: DataFrame, model: Model) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column(1)):
                x, _ = model.scan(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    return docs.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(scan, "toxic int, x array<double>")


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (1: toxic) and the significant passages (UTF-8 byte spans) of every row of ``docs``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column(1)):
                x, passages = model.scan(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(model.scores(x)), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(score, "doc_id long, score double, passages array<struct<start:long,end:long,score:double,p:double>>")


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    scored = score_toxicity(docs, learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
