"""Quality by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.  A text is
compressed window by window with either; the difference of the sizes over their sum, and the
size itself over the text's length (text that repeats itself shrinks far below what prose does),
are turned into a probability by a logistic fit on labelled texts that the dictionaries haven't
seen.

At most about ``per_class`` labelled documents of either class, of at most ``max_chars``
characters each, are learned from; every text is scored whole, in windows of ``WINDOW`` bytes.

Defined results: null and empty texts score as the features' zero point, which the fit learns as
one bad example more; without labels of both classes the score is the share of good labels, or
0.5 without any; a label that is repeated counts once; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, is_held_out, table, text_slices
from .learning import fit_logistic, labelled_texts, logistic

WINDOW, LEVEL, DICT_BYTES = 4096, 3, 64 << 10
PER_CLASS, MAX_CHARS = 1200, 20_000


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:]


class Sizer:
    """Compressed sizes under one dictionary."""

    def __init__(self, content: bytes):
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def __call__(self, text: bytes) -> int:
        return sum(len(self.compress(text[i : i + WINDOW])) for i in range(0, len(text), WINDOW))


def features(text: bytes, good: Sizer, bad: Sizer) -> tuple[float, ...]:
    if not text:
        return (0.0,) * 5
    a, b = good(text), bad(text)
    difference, rate = (b - a) / (a + b), np.log(len(text) / a)
    return difference, difference * abs(difference), rate, rate * rate, 1.0


class Model:
    def __init__(self, good: list[bytes], bad: list[bytes]):
        n = len(good) + len(bad)
        self.prior = len(good) / n if n else 0.5
        self.parts = None
        if good and bad:
            half = lambda x: (x[::2] or x, x[1::2] or x)  # noqa: E731  one half for the dictionary, one for the fit
            (good_dict, good_fit), (bad_dict, bad_fit) = half(good), half(bad)
            self.parts = dictionary(good_dict), dictionary(bad_dict)
            sizers = self.sizers()
            x = np.array([features(t, *sizers) for t in [*good_fit, *bad_fit, b""]])
            y = np.array([1.0] * len(good_fit) + [0.0] * (len(bad_fit) + 1))
            self.fit = fit_logistic(x, y)

    def sizers(self) -> tuple[Sizer, Sizer]:
        return Sizer(self.parts[0]), Sizer(self.parts[1])

    def score(self, texts: list[bytes], sizers: tuple[Sizer, Sizer]) -> np.ndarray:
        return logistic(np.array([features(t, *sizers) for t in texts]).reshape(len(texts), -1), self.fit)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, quality) joined to ``docs`` (doc_id, text)."""
    short = docs.where(F.length("text").between(1, max_chars))
    sample = labelled_texts(short, labels, "quality", per_class, "quality-sample")
    rows = sorted(sample.collect())  # at most about 2 * per_class rows of max_chars
    discard(sample)
    texts = [(r["quality"], r["text"].encode()) for r in rows]
    return Model([t for q, t in texts if q == 1], [t for q, t in texts if q == 0])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (1: good) for every row of ``docs``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizers = model.sizers() if model.parts else None
        for batch in batches:
            for first, end, data, at in text_slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                scores = model.score(texts, sizers) if sizers else np.full(len(texts), model.prior)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality")
    scored = score_quality(docs, learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
