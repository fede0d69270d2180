"""Operators whose result hangs on an order: greedy dedupe, split, rate limit, latest wins."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import written


def digest(content: Column) -> Column:
    """SHA-256 in hex of decoded content."""
    return F.sha2(content.cast("binary"), 256)


def image_digest(image: Column, with_size: bool = False) -> Column:
    """SHA-256 of an image's pixels, red first; without the size, images of one pixel sequence are equal.

    ``image`` is a struct of Spark's image source, whose pixels are blue first.
    """

    @F.pandas_udf("binary")
    def red_first(data: pd.Series, channels: pd.Series) -> pd.Series:
        def turned(content: bytes, n: int) -> bytes:
            pixels = np.frombuffer(content, np.uint8).reshape(-1, max(1, n))
            return (np.repeat(pixels, 3, axis=1) if n == 1 else pixels[:, 2::-1]).tobytes()

        return pd.Series([None if x is None or n < 1 else turned(x, int(n)) for x, n in zip(data, channels, strict=True)], dtype=object)

    pixels = red_first(image["data"], image["nChannels"])
    return F.sha2(F.concat(F.concat_ws("x", image["width"], image["height"]).cast("binary"), pixels) if with_size else pixels, 256)


def ordered_paths(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ord, their place in the order of ``keys``: range-sorted, one count a partition to the driver."""
    placed = written(rows.orderBy(*keys).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(placed.sparkSession.createDataFrame(starts or [(0, 0)], "__p long, __start long"))
    return placed.join(offsets, part == F.col("__p")).withColumn("ord", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__p", "__start")


def dedupe_greedy(pairs: DataFrame) -> DataFrame:
    """``pairs`` (ord, label, before, after, before_ok, after_ok) with accepted and duplicate_of.

    Pairs come in the order of ord.  A stem that passes its own checks (``*_ok``) and whose digest
    is new registers the digest, even if the pair fails later; ``after`` is looked at only if
    ``before`` was accepted.  Acceptance hangs on strictly earlier stems alone, so there is one
    fixed point: start with every ``after`` looked at, find each digest's first stem, look again
    only where ``before`` was accepted, and repeat until nothing changes.  A chain of pairs each of
    which fails by the one before costs a round a link.
    """
    state = written(pairs.withColumn("__look", F.col("before_ok") & F.col("after_ok")), "dedupe-0")
    while True:
        place = lambda stem: F.struct(F.col("ord"), F.lit(stem).alias("stem"), F.col("label"))
        stems = state.where("before_ok").select(F.col("before").alias("digest"), place(0).alias("at")).union(state.where("__look").select(F.col("after").alias("digest"), place(1).alias("at")))
        first = stems.groupBy("digest").agg(F.min("at").alias("first"))
        seen = state.join(first.select(F.col("digest").alias("before"), F.col("first").alias("__b")), "before", "left").join(first.select(F.col("digest").alias("after"), F.col("first").alias("__a")), "after", "left")
        own = lambda c, stem: F.coalesce((F.col(f"{c}.ord") == F.col("ord")) & (F.col(f"{c}.stem") == stem), F.lit(False))
        good = F.col("before_ok") & own("__b", 0)
        look = good & F.col("after_ok")
        next_ = written(seen.withColumn("__good", good).withColumn("__next", look).withColumn("__pair", look & own("__a", 1)), "dedupe")
        if next_.where("__next <> __look").isEmpty():
            break
        state = written(next_.withColumn("__look", F.col("__next")).select(*state.columns), "dedupe-state")
    owner = lambda c: F.concat_ws("/", F.col(f"{c}.label"), F.when(F.col(f"{c}.stem") == 0, "before").otherwise("after"))
    duplicate = F.when(F.col("before_ok") & ~F.col("__good"), F.concat(F.lit("before is a duplicate of "), owner("__b"))).when(F.col("__next") & ~F.col("__pair"), F.concat(F.lit("after is a duplicate of "), owner("__a")))
    return next_.select(*pairs.columns, F.col("__pair").alias("accepted"), duplicate.alias("duplicate_of"))


#: Keys among which the split's edge is looked up at once.
EDGE_KEYS = 4096


def split_edge(keys: DataFrame, wanted: int) -> tuple[str, str] | None:
    """The (__h, __k) of number ``wanted`` in the order of both; None for 0.

    A histogram over the leading digits of __h finds the stretch that holds it, then one over the
    next digits within that, until few keys are left: three digits a pass, 4096 numbers on the driver.
    """
    prefix, left = "", wanted
    while left:
        here = keys.where(F.col("__h").startswith(prefix))
        sizes = sorted((r["b"], r["n"]) for r in here.groupBy(F.substring("__h", 1, len(prefix) + 3).alias("b")).agg(F.count("*").alias("n")).collect())
        for stretch, n in sizes:
            if left <= n:
                break
            left -= n
        if n <= EDGE_KEYS or len(stretch) > 29:
            rows = keys.where(F.col("__h").startswith(stretch)).select("__h", "__k").orderBy("__h", "__k").limit(left).collect()
            return rows[-1]["__h"], rows[-1]["__k"]
        prefix = stretch
    return None


def split_assign(rows: DataFrame, key: str = "pair_id", seed: int = 42, fraction: float = 0.1) -> DataFrame:
    """``rows`` with split: the first share (at least one of two or more keys) in the order of md5(seed:key) is val.

    ``rows`` are computed twice: once for their keys, which are staged, and once for the result, in
    which the split is a comparison with the edge's key.  Rows of one key go together.
    """
    hashed = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), c))
    keys = written(rows.select(F.col(key).cast("string").alias("__k")).distinct().withColumn("__h", hashed(F.col("__k"))), "split-keys")
    n = keys.count()
    edge = split_edge(keys, max(1, int(n * fraction)) if n > 1 else 0)
    own = F.col(key).cast("string")
    within = (hashed(own) < edge[0]) | ((hashed(own) == edge[0]) & (own <= edge[1])) if edge else F.lit(False)
    return rows.withColumn("split", F.when(within, "val").otherwise("train"))


def split_assign_listed(rows: DataFrame, key: str = "pair_id", seed: int = 42, fraction: float = 0.1, most: int = 1_000_000) -> DataFrame:
    """The split of a seeded shuffle of the sorted keys, on the driver; refuses more than ``most`` keys."""
    import random

    keys = [r[0] for r in rows.select(key).distinct().orderBy(key).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError("too many keys for a shuffle on the driver; use split_assign")
    random.Random(seed).shuffle(keys)
    count = max(1, int(len(keys) * fraction)) if len(keys) > 1 else 0
    named = rows.sparkSession.createDataFrame([(k, "val" if i < count else "train") for i, k in enumerate(keys)], f"{key} string, split string")
    return rows.join(named, key)


def split_counts(rows: DataFrame) -> DataFrame:
    """n_train, n_val and whether the training set is too small for more than a smoke test."""
    out = rows.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return out.withColumn("too_small", F.col("n_train") < fixed.SMALL_TRAINING_SET)


class HitLog:
    """A client's accepted hits within the window, in order: the limiter's whole state."""

    def __init__(self, limit: int, window: int, kept: list[int] | None = None):
        self.limit, self.window, self.kept = limit, window, kept or []

    def blocked(self, now: int) -> bool:
        """Whether a hit is one too many; only hits that pass are recorded."""
        self.kept = [t for t in self.kept if now - t < self.window]
        if len(self.kept) >= self.limit:
            return True
        self.kept.append(now)
        return False


def judged(times: np.ndarray, limit: int, window: int, kept: deque[int]) -> np.ndarray:
    """Which of a client's ascending ``times`` are blocked; ``kept`` holds its last ``limit`` accepted hits and goes on.

    A hit passes if the hit accepted ``limit`` before it has left the window, so after each full log
    the search goes straight to the first time that passes again: a step for each accepted hit only.
    """
    blocked = np.ones(len(times), bool)
    i = 0
    while i < len(times):
        if len(kept) == limit:
            i = max(i, int(np.searchsorted(times, kept[0] + window)))
            if i == len(times):
                break
            kept.popleft()
        blocked[i] = False
        kept.append(int(times[i]))
        i += 1
    return blocked


def rate_limit(hits: DataFrame, limit: int = fixed.RATE_LIMIT, window: int = fixed.RATE_WINDOW_MS) -> DataFrame:
    """``hits`` (key, t, id) with blocked, by a sliding log of accepted hits for each key.

    A pause as long as the window starts a key anew.  Pauses lie between stretches of time as long
    as the window, so they are found among one row for each key and stretch with hits, and hits are
    dealt out by key and run of stretches.  What has no pause stays sequential, as each verdict
    hangs on the ones before: it streams through a log of ``limit`` times, whatever its length.
    """
    slot = F.floor(F.col("t") / window).cast("long")
    slots = hits.groupBy("key", slot.alias("__slot")).agg(F.min("t").alias("__first"), F.max("t").alias("__last"))
    by_key = Window.partitionBy("key").orderBy("__slot")
    pause = F.coalesce((F.col("__first") - F.lag("__last").over(by_key) >= window).cast("int"), F.lit(0))
    runs = slots.withColumn("__new", pause).withColumn("run", F.sum("__new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(runs.select(F.col("key").alias("__key"), "__slot", "run"), "limiter-runs")
    placed = hits.select("key", "t", "id").withColumn("__own", slot).join(runs, F.col("key").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__slot"))).select("key", "t", "id", "run")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, deque()
        for batch in batches:
            code = batch.groupby(["key", "run"], dropna=False, sort=False).ngroup().to_numpy()
            times, said = batch["t"].to_numpy(), []
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(code)) + 1):
                if len(part):
                    key = batch["key"].iat[part[0]]
                    of = (None if pd.isna(key) else key, batch["run"].iat[part[0]])
                    if of != current:
                        current, kept = of, deque()
                    said.append(judged(times[part], limit, window, kept))
            yield batch[["key", "t", "id"]].assign(blocked=np.concatenate(said) if said else np.zeros(0, bool))

    dealt = placed.repartition("key", "run").sortWithinPartitions("key", "run", "t", "id")
    kinds = dict(hits.dtypes)
    return dealt.mapInPandas(judge, f"key {kinds['key']}, t {kinds['t']}, id {kinds['id']}, blocked boolean")


def limiter_state(hits: DataFrame, limit: int = fixed.RATE_LIMIT) -> DataFrame:
    """key, times: each key's latest ``limit`` different times, latest first, which is all that a limiter may hold."""
    latest = Window.partitionBy("key").orderBy(F.desc("t"))
    kept = hits.select("key", "t").distinct().withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= limit)
    return kept.groupBy("key").agg(F.sort_array(F.collect_list("t"), False).alias("times"))


def expired_keys(state: DataFrame, now: int, window: int = fixed.RATE_WINDOW_MS) -> DataFrame:
    """Keys of a state table (key, times) all of whose hits have left the window: safe to forget."""
    return state.where(F.forall("times", lambda t: now - t >= window)).select("key")


def latest_wins(events: DataFrame, session: str, order: str) -> DataFrame:
    """``events`` with kept: whether no later request of the session has replaced the event's."""
    newest = events.groupBy(session).agg(F.max(order).alias("__newest"))
    return events.join(newest, session).withColumn("kept", F.col(order) == F.col("__newest")).drop("__newest")


def can_generate(photo: Column, consent: Column, busy: Column) -> Column:
    return photo & consent & ~busy


def empty_input(rows: DataFrame, where: str) -> DataFrame:
    """``rows``, or an error that names the place if there are none."""
    if rows.isEmpty():
        raise ValueError(f"no pairs found under {where}")
    return rows
