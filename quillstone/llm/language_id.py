"""Language identification by hierarchical discrimination.

First the language family is predicted, then the language within it, both by one-versus-one
linear support vector machines over hashed byte n-grams (lengths 1 to 4) of the whole text.
Families come from a fixed list of language codes; a code that it lacks is a family by itself.

The machines are fitted on about ``per_language`` documents of each language, of at most
``max_chars`` characters each; prediction reads every document whole.  A text's feature vector
is the mean over its n-grams, so a machine's margin is a mean of table look-ups.

Defined results: ``und`` with score 0 for a null text, one without a letter, and for all texts
if there is nothing to learn from; a single learned language is always predicted.  Null langs
aren't learned from; other columns pass through ``identify`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, is_held_out, table, text_slices
from .learning import fit_svm, ragged_sums, sample_by_class

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy yi lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn pa gu mr ne ur si",
    "turkic": "tr az kk ky uz tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
BITS, ORDERS = 11, 4
PER_LANGUAGE, MAX_CHARS = 250, 20_000


def family_of(lang: str) -> str:
    code = lang.split("-")[0].split("_")[0].lower()
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"only {lang}")


def gram_buckets(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte; ASCII letters count in lower case.

    The last ones of a text are cut short by its end, whatever text comes next.
    """
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    h = low.copy()
    for k in range(1, order):
        h *= np.uint32(0x01000193)
        after = np.zeros_like(low)
        after[:-k] = low[k:]
        for j in range(1, k + 1):
            past = at[1:] - j
            after[past[past >= at[:-1]]] = 0
        h ^= after
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)) + np.uint32((order - 1) << BITS)


def mean_margins(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the mean over its n-grams of each machine's weight (rows: buckets)."""
    sums = np.zeros((len(at) - 1, weights.shape[1]))
    # one long text goes in steps, each with the few bytes that its last n-grams reach into
    step = len(data) if len(at) != 2 else SLICE_BYTES
    for first in range(0, len(data), max(1, step)):
        part = data[first : first + step + ORDERS - 1]
        n = min(step, len(data) - first)
        for order in range(1, ORDERS + 1):
            which = gram_buckets(part, at if n == len(data) else np.array([0, len(part)]), order)[:n]
            for j in range(weights.shape[1]):
                sums[:, j] += ragged_sums(weights[:, j][which], at if n == len(data) else np.array([0, n]))
    return sums / np.maximum(1, ORDERS * np.diff(at))[:, None]


def features(texts: list[str]) -> np.ndarray:
    """The machines' features: scaled means, by bucket."""
    out = np.zeros((len(texts), ORDERS << BITS), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        for order in range(1, ORDERS + 1):
            out[i] += np.bincount(gram_buckets(data, np.array([0, len(data)]), order), minlength=ORDERS << BITS)
        out[i] *= SCALE / max(1, ORDERS * len(data))
    return out


#: Features are means over buckets; this brings them to the size that the machines expect.
SCALE = 100.0


def tree_of(langs: Iterable[str]) -> dict[str, list[str]]:
    """Families and their languages, in order."""
    tree: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        tree.setdefault(family_of(lang), []).append(lang)
    return dict(sorted(tree.items()))


def fit_machines(texts: list[str], langs: list[str]) -> Iterator[tuple[str | None, str, str, np.ndarray]]:
    """(group, a, b, machine) of each pair of families (group None) and of languages within each family."""
    tree = tree_of(langs)
    x = features(texts)
    own = np.array(langs)
    kin = np.array([family_of(x) for x in langs])
    for group, names, of in [(None, list(tree), kin), *((f, names, own) for f, names in tree.items())]:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                rows = np.flatnonzero((of == a) | (of == b))
                yield group, a, b, fit_svm(x, rows, np.where(of[rows] == a, 1.0, -1.0)).astype(np.float32)


class Model:
    """Pairs of classes and their machines, for families (None) and within each family."""

    def __init__(self, langs: Iterable[str], machines: list[tuple[str | None, str, str, np.ndarray]]):
        self.tree = tree_of(langs)
        self.pairs = [m[:3] for m in machines]
        both = np.array([m[3] for m in machines], np.float32).reshape(len(machines), (ORDERS << BITS) + 1)
        self.weights = np.ascontiguousarray(both[:, :-1].T) * np.float32(SCALE)
        self.intercepts = both[:, -1].astype(np.float64)

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = mean_margins(data, at, self.weights) + self.intercepts
        chance = 1 / (1 + np.exp(-np.clip(4 * margins, -30, 30)))

        def choose(group: str | None, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes, sure = np.zeros((len(at) - 1, len(names))), np.ones((len(at) - 1, len(names)))
            for j, (g, a, b) in enumerate(self.pairs):
                if g == group and a in names:
                    i, k = names.index(a), names.index(b)
                    votes[:, i] += chance[:, j]
                    votes[:, k] += 1 - chance[:, j]
                    sure[:, i] = np.minimum(sure[:, i], chance[:, j])
                    sure[:, k] = np.minimum(sure[:, k], 1 - chance[:, j])
            best = votes.argmax(axis=1)
            return best, sure[np.arange(len(best)), best]

        families = list(self.tree)
        family, score = choose(None, families)
        lang = np.empty(len(at) - 1, object)
        for f, name in enumerate(families):
            best, sure = choose(name, self.tree[name])
            here = family == f
            lang[here] = np.array(self.tree[name], object)[best[here]]
            score = np.where(here, score * sure, score)
        return lang.tolist(), score


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    found = ragged_sums(ascii_letter, at) > 0
    for i in np.flatnonzero(~found):
        if at[i + 1] > at[i]:
            found[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model:
    """Fit the machines on a bounded sample of ``docs`` (doc_id, text, lang).

    One task reads the sample and fits, so that the driver holds no text and no feature, only
    ``ORDERS << BITS`` numbers a machine.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    sample = sample_by_class(usable.select("doc_id", "text", "lang"), "lang", ["doc_id", "text"], per_language).select("text", "lang")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        langs = [r[1] for r in rows]
        names = ["family", "a", "b", "machine"]
        for lang in sorted(set(langs)):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([lang]), pa.array([None], pa.string()), pa.array([None], pa.binary())], names=names)
        for group, a, b, machine in fit_machines([r[0] for r in rows], langs):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([a]), pa.array([b]), pa.array([machine.tobytes()], pa.binary())], names=names)

    found = sample.repartition(1).mapInArrow(fit, "family string, a string, b string, machine binary").collect()  # a row for each language and machine
    machines = [(r["family"], r["a"], r["b"], np.frombuffer(r["machine"], np.float32)) for r in found if r["machine"] is not None]
    return Model([r["a"] for r in found if r["machine"] is None], machines)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with __lang and __score; all its columns stay as they are."""
    names = docs.columns
    at_text = names.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column(at_text)):
                if model.tree:
                    langs, score = model.predict(data, at)
                    lettered = has_letter(data, at)
                else:
                    langs, score, lettered = ["und"] * (end - first), np.zeros(end - first), np.zeros(end - first, bool)
                said = [x if ok else "und" for x, ok in zip(langs, lettered, strict=True)]
                kept = [c.slice(first, end - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=[*names, "__lang", "__score"])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = is_held_out(F.col("doc_id"), 5, 0)
    model = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
