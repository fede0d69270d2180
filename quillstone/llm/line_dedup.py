"""Line dedup by a suffix array over line-id sequences; DataFrame functions only.

A document is the sequence of its lines that hold a word, trimmed of white space; two lines are
one id if they are equal (128 bits of hash).  A run of lines qualifies if it holds at least
``min_words`` words.  Every qualifying run that also stands earlier, in the order of doc_id and
line, is a later copy, and its lines are deleted.  The first copy of any line stays.

The suffix array is built by prefix doubling: ranks of runs of one line, of two, of four and so
on, each the order of the pairs of ranks of its halves, found by a range sort of the distinct
pairs.  Runs that occur once leave the doubling at once, as no longer run there can repeat.  It
is built to the depth at which every suffix qualifies (at most ``min_words`` lines, so a handful
of rounds whatever the corpus).  A common-prefix interval of that depth is a rank of the shortest
qualifying run at a place, read forwards or backwards; all places in it but the first are later
copies, and the union of such runs is exactly the union of all maximal qualifying later copies.

No group is gathered: ranks and first places come from aggregations with partial sums and from
joins of staged tables, which are broadcast if they are small and split by Spark where a line is hot.  Lists are held per document only.

Defined results: null texts stay null, with no lines; empty texts and lines without a word are
never deleted; of repeated rows the later are copies of the first, where a null doc_id comes
first and ties keep the order in which rows were read; an empty table gives no rows.  Columns of
``docs`` may have any names; those of the operator begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, looked_up, staged, table

#: Words that a run of lines must hold to be a copy: as many as a shingle of the n-gram join.
MIN_WORDS = 5
_SPACE = " \t\n\x0b\x0c\r"


def count_words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has; null for null."""
    marks = F.regexp_replace(F.btrim(text, F.lit(_SPACE)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(marks).cast("long")


def line_runs(base: DataFrame, min_words: int) -> DataFrame:
    """Runs of neighbouring repeated lines with enough words: __row, __doc, __line, __w, __sum, __r (arrays)."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)))
    described = F.transform(trimmed, lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), count_words(x).alias("w")))
    kept = F.filter(described, lambda x: x["w"] > 0)
    lines = base.select("__row", F.col("doc_id").alias("__doc"), F.posexplode(kept).alias("__seq", "x")).select("__row", "__doc", "__seq", "x.*")
    lines = staged(lines, "lines")
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    ranked = staged(repeated.orderBy("h1", "h2").withColumn("r", F.monotonically_increasing_id()), "line-ranks")
    # lines and ranks are both staged, so that Spark splits the join where a line is hot
    active = lines.join(ranked, ["h1", "h2"]).select("__row", "__doc", "__seq", "line", "w", "r")
    place = Window.partitionBy("__row").orderBy("__seq")
    runs = active.withColumn("__run", F.col("__seq") - F.row_number().over(place)).withColumn("sum", F.sum("w").over(place)).groupBy("__row", "__run")
    gathered = runs.agg(F.first("__doc").alias("__doc"), F.array_sort(F.collect_list(F.struct("__seq", "line", "w", "sum", "r"))).alias("x"), F.sum("w").alias("words"))
    gathered = gathered.where(F.col("words") >= min_words).select("__row", "__doc", *[F.col(f"x.{c}").alias(f"__{c}") for c in ("line", "w", "sum", "r")])
    out = staged(gathered, "line-runs")  # what follows reads the lists by place, so they must stand as columns
    discard(lines, ranked)
    return out


def shortest_windows(min_words: int) -> Column:
    """All (s, m) of a run: the shortest run of m lines with enough words from place s on, or up to a place.

    Every line has a word, so no more than ``min_words`` places are looked at from any.
    """
    n = F.size("__w")
    words = lambda s, e: F.get("__sum", e) - F.get("__sum", s) + F.get("__w", s)

    def forwards(s: Column) -> Column:
        ends = F.filter(F.sequence(s, F.least(n - 1, s + min_words - 1)), lambda e: words(s, e) >= min_words)
        return F.struct(s.alias("s"), (F.get(ends, F.lit(0)) - s + 1).alias("m"))

    def backwards(e: Column) -> Column:
        starts = F.filter(F.sequence(F.greatest(F.lit(0), e - min_words + 1), e), lambda s: words(s, e) >= min_words)
        start = F.try_element_at(starts, F.lit(-1))
        return F.struct(start.alias("s"), (e - start + 1).alias("m"))

    places = F.sequence(F.lit(0), n - 1)
    both = F.concat(F.transform(places, forwards), F.transform(places, backwards))
    return F.array_distinct(F.filter(both, lambda x: x["s"].isNotNull() & x["m"].isNotNull()))


def later_copies(runs: DataFrame, min_words: int) -> DataFrame:
    """__row and __line of every line that a later copy of a qualifying run covers, once each."""
    state = staged(runs.withColumn("__win", shortest_windows(min_words)).withColumn("__head", F.get("__line", F.lit(0))).drop("__w", "__sum"), "line-runs-0")
    deepest = state.agg(F.max(F.array_max(F.transform("__win", lambda x: x["m"])))).first()[0] or 0
    found, states, size, level = None, [state], 1, 0
    while size <= deepest:
        # places whose shortest qualifying run has `size` to 2 * size - 1 lines: two overlapping halves name it
        here = F.filter("__win", lambda x: (x["m"] >= size) & (x["m"] < 2 * size))
        named = F.transform(here, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), F.get("__r", x["s"]).alias("a"), F.get("__r", x["s"] + x["m"] - size).alias("b")))
        named = F.filter(named, lambda x: x["a"].isNotNull() & x["b"].isNotNull())
        windows = state.select("__row", "__doc", "__line", F.explode(named).alias("x"))
        windows = windows.select("__row", "__doc", F.slice("__line", F.col("x.s") + 1, F.col("x.m")).alias("lines"), "x.m", "x.a", "x.b")
        found = windows if found is None else found.unionByName(windows)
        if 2 * size <= deepest:
            state = doubled(state, size, level)
            states.append(state)
        size, level = 2 * size, level + 1
    if found is None:
        return state.select("__row", F.explode("__line").alias("__line"))
    found = staged(found, "line-windows")
    discard(*states)
    place = F.struct("__doc", "__row", F.get("lines", F.lit(0)).alias("at"))
    first = staged(found.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("m", "a", "b", "first"), "line-firsts")
    later = looked_up(found, first, ["m", "a", "b"]).where((F.col("__row") != F.col("first.__row")) | (F.get("lines", F.lit(0)) != F.col("first.at")))
    out = staged(later.select("__row", F.explode("lines").alias("__line")).distinct(), "line-copies")
    discard(found, first)
    return out


def doubled(state: DataFrame, size: int, level: int) -> DataFrame:
    """The next round: ranks of runs of 2 * size lines; null where such a run occurs once or ends too late."""
    spots = F.sequence(F.lit(0), F.size("__r") - 1)
    pairs = F.transform(spots, lambda i: F.struct(i.alias("i"), F.get("__r", i).alias("a"), F.get("__r", i + size).alias("b")))
    exploded = staged(state.select("__row", "__head", F.explode(pairs).alias("x")).select("__row", "__head", "x.*"), f"line-pairs-{level}")
    whole = exploded.where("a is not null and b is not null")
    repeated = whole.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    ranked = staged(repeated.orderBy("a", "b").withColumn("r", F.monotonically_increasing_id()), f"line-ranks-{level + 1}")
    none = exploded.where("a is null or b is null").select("__row", "__head", "i", F.lit(None).cast("long").alias("r"))
    named = whole.join(ranked, ["a", "b"], "left").select("__row", "__head", "i", "r").unionByName(none)
    lists = named.groupBy("__row", "__head").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("__x")).select("__row", "__head", F.col("__x.r").alias("__next"))
    merged = state.join(lists, ["__row", "__head"]).withColumn("__r", F.col("__next"))
    out = staged(merged.select(*state.columns), f"line-runs-{level + 1}")
    discard(exploded, ranked)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) without later copies; adds __n_lines and __n_removed."""
    base = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "line-docs")
    runs = line_runs(base, min_words)
    copies = later_copies(runs, min_words)
    discard(runs)
    removed = copies.groupBy("__row").agg(F.collect_set("__line").alias("__gone"))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains("__gone", i))
    gone = F.col("__gone").isNotNull()
    joined = base.join(removed, "__row", "left")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(_SPACE)) != "")), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines)
    return joined.select(
        *[F.when(gone, F.array_join(left, "\n")).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias("__n_lines"),
        F.when(gone, F.size("__gone")).otherwise(0).cast("long").alias("__n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


ORACLE = rf"""
with raw as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
a as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line from raw where text is not null),
b as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from a),
l as (select *, sum(w) over (partition by doc_id order by i) as c, row_number() over (partition by doc_id order by i) as q from b where w > 0),
f as (select s.doc_id, s.q as s, min(e.q) as e from l s join l e on s.doc_id = e.doc_id and e.q >= s.q and e.c - s.c + s.w >= {MIN_WORDS} group by 1, 2),
k as (select e.doc_id, max(s.q) as s, e.q as e from l s join l e on s.doc_id = e.doc_id and e.q >= s.q and e.c - s.c + s.w >= {MIN_WORDS} group by e.doc_id, e.q),
n as (select doc_id, s, e from f union select doc_id, s, e from k),
z as (select n.doc_id, n.s, n.e, string_agg(l.t, chr(10) order by l.q) as body
      from n join l on l.doc_id = n.doc_id and l.q between n.s and n.e group by 1, 2, 3),
y as (select *, row_number() over (partition by body order by doc_id, s) as copy from z),
g as (select distinct l.doc_id, l.i from y join l on l.doc_id = y.doc_id and l.q between y.s and y.e where y.copy > 1),
o as (select b.doc_id, count(*) filter (b.w > 0) as n_lines, count(g.i) as n_removed,
        coalesce(string_agg(b.line, chr(10) order by b.i) filter (g.i is null), '') as kept
      from b left join g on g.doc_id = b.doc_id and g.i = b.i group by 1)
select r.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(length(kept) as bigint) as kept_chars, md5(kept) as kept_md5
from raw r left join o on o.doc_id = r.doc_id
"""
