"""Mixing sources to target weights by weighted sampling without replacement.

Sources share ``share`` times all words by weight; no target exceeds ``most_epochs`` times its
source, the excess going to the others by weight.  Complete epochs come first: each of a source's
documents is taken once for each whole time that the source fits its target.  What is left of the
target is filled in the order of Efraimidis and Spirakis: a document's key is an exponential
deviate over its quality weight, keys are sorted within the source, sizes are summed along, and
documents are taken while the sum stays within the budget.  Documents are taken whole; the one
document of the rest whose size comes nearest to the remaining gap closes it.

The targets' level is found by a few sums over the sources, and no source is sorted in one task:
keys fall into buckets of at most about ``BUCKET_ROWS`` documents (more where a source would have
over ``MOST_BUCKETS``), the buckets' sums tell in which one the budget ends, and only that one is
sorted.  What the mix takes is then told from a row's own key and its source's place of that end,
so texts aren't shuffled.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source;
repeated rows are documents each for itself; ties of keys go to the smaller doc_id and size (null
first); an empty table gives no rows; columns of ``docs`` may have any names but those that begin
with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, discard, staged, table

SHARE, MOST_EPOCHS, SEED, BUCKET_ROWS, VARIED = 1.5, 2.0, 17, 256, 0.9
#: Stretches of a source's keys, but for those of the least weight; their sums are added up in one task a source.
MOST_BUCKETS = 100_000
#: Sources up to which the table of targets is broadcast; beyond, Spark joins it by shuffling.
BROADCAST_SOURCES = 50_000


_SPACE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def prose_quality(text: Column, size: Column, distinct: Column) -> Column:
    """A quality in (0, 1] for texts that have no score of their own: 1 for plain, varied prose.

    It falls with the share of symbols that tables and junk are full of, and with Herdan's measure
    of variety, log distinct words over log words, below ``VARIED``, which hardly hangs on length.
    """
    junk = F.length(text) - F.length(F.regexp_replace(text, "[!#$%&*|]", ""))
    clean = F.when(F.length(text) > 0, 1.0 / (1.0 + 50.0 * junk / F.length(text))).otherwise(1.0)
    varied = F.when(size > 1, F.least(F.lit(1.0), (F.log(distinct.cast("double")) + 0.1) / F.log(size.cast("double")) / VARIED)).otherwise(1.0)
    return clean * F.pow(varied, F.lit(8.0))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of seed and key, alike in every engine and run."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)


def water_level(sizes: DataFrame, share: float, most_epochs: float) -> float:
    """The level at which the sources' targets, least(cap, level * weight), sum up to ``share`` of all sizes.

    Starting without caps, every source that the level lifts above its cap is capped and what it
    leaves is shared anew; the level only rises, and stands after a few sums over one row a source.
    """
    cap = most_epochs * F.col("source_size")
    level = 0.0
    while True:
        below = cap > level * F.col("weight")
        sums = sizes.agg(F.sum("source_size"), F.sum(F.when(~below, cap)), F.sum(F.when(below, F.col("weight")))).first()
        if sums[0] is None or sums[2] is None:
            return float("inf")
        after = (share * sums[0] - (sums[1] or 0.0)) / sums[2]
        if after <= level:
            return level
        level = after


def numbered(sums: DataFrame) -> DataFrame:
    """``sums`` with __number, the place of source by code point, null last: range-sorted, one count a partition to the driver."""
    placed = staged(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = sums.sparkSession.createDataFrame(starts or [(0, 0)], "__p long, __start long")
    return placed.join(F.broadcast(offsets), part == F.col("__p")).withColumn("__number", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__p", "__start")


def _bucket() -> Column:
    """A stretch of keys in which exponential deviates of any weight lie thinly: even below 1, in even ratios above."""
    near = F.when(F.col("__key") < 1, F.col("__key")).otherwise(1 + F.log(F.least("__key", F.lit(1e300))))
    return F.floor(near * F.col("__buckets"))


def _place() -> Column:
    return F.struct("__key", "doc_id", "__size", "__row")


def _within() -> Column:
    """Whether a row (beside its source's plan) stands among those that fill the rest of the target."""
    before = (_bucket() < F.col("__edge")) | ((_bucket() == F.col("__edge")) & F.coalesce(_place() <= F.col("__last"), F.lit(False)))
    return (F.col("__size") > 0) & (F.col("__edge").isNull() | before)


def beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's row of the staged ``plan``, which is broadcast unless sources are many."""
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return rows.join(side, F.col("source").eqNullSafe(F.col("__source")))


def choose(light: DataFrame, weights: DataFrame | None = None, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """The mix as a staged plan, one row a source: what ``with_copies`` needs to tell how often a row is taken.

    ``light`` (staged) has __row, doc_id, source, __size and __key.  ``weights`` has source and
    weight; without it sources by code point, null last, weigh ``cycle`` in turn.  Of all rows only
    those of each source's bucket in which the budget ends are sorted.
    """
    sums = light.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("__n"))
    if weights is None:
        sums = numbered(sums).withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("__number") % len(cycle) + 1).cast("int"))).drop("__number")
    else:
        sums = sums.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select("s.*", F.col("w.weight").cast("double").alias("weight"))
    sums = staged(sums, "mix-sources")
    water = water_level(sums, share, most_epochs)
    goal = sums.withColumn("target", F.least(most_epochs * F.col("source_size"), F.lit(water) * F.col("weight")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("__epochs", full).withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size")).withColumn("__buckets", F.least((F.col("__n") / BUCKET_ROWS).cast("long"), F.lit(MOST_BUCKETS)) + 1)
    goal = staged(goal.withColumnRenamed("source", "__source").drop("__n", "weight"), "mix-targets")
    discard(sums)
    totals = beside(light, goal).groupBy("__source", "__rest", _bucket().alias("__bucket")).agg(F.sum("__size").alias("__total"))
    upto = F.sum("__total").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = totals.withColumn("__upto", upto).where(F.col("__upto") > F.col("__rest"))
    edges = over.groupBy("__source").agg(F.min(F.struct("__bucket", (F.col("__upto") - F.col("__total")).alias("base"))).alias("e"))
    edges = edges.select(F.col("__source").alias("__s"), F.col("e.__bucket").alias("__edge"), F.col("e.base").alias("__base"))
    edged = staged(goal.join(edges, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s"), "mix-edges")
    order = Window.partitionBy("__source").orderBy("__key", "doc_id", "__size", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = beside(light, edged).where(_bucket() == F.col("__edge")).withColumn("__upto", F.col("__base") + F.sum("__size").over(order)).where(F.col("__upto") <= F.col("__rest"))
    last = last.groupBy("__source").agg(F.max(_place()).alias("__last"), F.max("__upto").alias("__used")).withColumnRenamed("__source", "__s")
    gap = F.when(F.col("__edge").isNotNull(), F.col("__rest") - F.coalesce("__used", "__base")).otherwise(F.lit(0.0))
    begun = edged.join(last, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("__gap", gap)
    begun = staged(begun.drop("__used", "__base", "__rest"), "mix-begun")
    discard(goal, edged)
    miss = F.abs(F.col("__size") - F.col("__gap"))
    spare = beside(light, begun).where((F.col("__size") > 0) & (miss < F.col("__gap"))).where(~_within())
    closing = spare.groupBy("__source").agg(F.min(F.struct(miss.alias("m"), F.col("__key").alias("k"), F.col("doc_id").alias("d"), F.col("__row").alias("r"))).alias("x"))
    closing = closing.select(F.col("__source").alias("__s"), F.col("x.r").alias("__closing"))
    plan = staged(begun.join(closing, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s", "__gap"), "mix-plan")
    discard(begun)
    return plan


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (__row, doc_id, source, __size, __key and any others) with source_size, target and __copies.

    Nothing but the plan is looked up, so rows stay where they are.
    """
    closes = F.coalesce(F.col("__row") == F.col("__closing"), F.lit(False))
    copies = F.col("__epochs") * (F.col("__size") > 0).cast("long") + (_within() | closes).cast("long")
    return beside(rows, plan).withColumn("__copies", copies).drop("__source", "__epochs", "__buckets", "__edge", "__last", "__closing")


def weighed(docs: DataFrame, seed: int = SEED, quality: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with __row, __size and __key.

    ``quality`` is a document's weight, a positive number such as a classifier's score; null and
    what isn't positive count as the least double above 0.  Without it ``prose_quality`` weighs.
    """
    sized = docs.withColumn("__words", words_of(F.col("text"))).withColumn("__size", F.size("__words").cast("long"))
    weight = prose_quality(F.col("text"), F.col("__size"), F.size(F.array_distinct("__words"))) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(5e-324))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce(weight, F.lit(1.0))
    return sized.withColumns({"__row": F.monotonically_increasing_id(), "__key": key}).drop("__words").select(*docs.columns, "__row", "__size", "__key")


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, quality: Column | None = None, **options) -> DataFrame:
    """``docs`` as the mix takes them: each as many times as it is taken."""
    base = staged(weighed(docs, quality=quality), "mix-docs")
    plan = choose(base.select("__row", "doc_id", "source", "__size", "__key"), weights, **options)
    taken = with_copies(base, plan.drop("source_size", "target")).where("__copies > 0")
    return taken.select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    light = staged(weighed(docs).drop("text"), "mix-light")
    chosen = with_copies(light, choose(light))
    return chosen.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"))


ORACLE = rf"""
with b as (select *, coalesce(regexp_extract_all(text, '{WORD_RE}'), []) as ws from documents),
d as (
  select doc_id, source, len(ws) as size,
    -ln((cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double)
      / (case when length(text) > 0 then 1.0::double / (1.0::double + 50.0::double * (length(text) - length(regexp_replace(text, '[!#$%&*|]', '', 'g'))) / length(text)) else 1.0::double end
        * pow(case when len(ws) > 1 then least(1.0::double, (ln(list_unique(ws)::double) + 0.1::double) / ln(len(ws)::double) / {VARIED}::double) else 1.0::double end, 8.0::double)) as key
  from b),
s as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight from s),
c as (select *, 2.0::double * source_size as cap from w),
v as (select *, ({SHARE}::double * sum(source_size) over () - coalesce(sum(cap) over e, 0)) / (sum(weight) over () - coalesce(sum(weight) over e, 0)) as level,
        row_number() over (order by cap / weight, source nulls last) as place
      from c window e as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select *, least(cap, coalesce((select arg_min(level, place) from v where cap / weight >= level), 'inf'::double) * weight) as target from v),
g as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
p as (select d.doc_id, d.size, d.key, g.source, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size as rest,
        sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) as upto
      from d join g on d.source is not distinct from g.source),
i as (select *, size > 0 and upto <= rest as inside, rest - sum(case when size > 0 and upto <= rest then size else 0 end) over (partition by source) as gap from p),
n as (select *, row_number() over (partition by source, not inside and size > 0 and abs(size - gap) < gap order by abs(size - gap), key, doc_id) as near from i)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (epochs + case when inside or (size > 0 and abs(size - gap) < gap and near = 1) then 1 else 0 end) as bigint) as taken
from n
"""
