"""N-gram Jaccard self-join: every pair of documents whose word-shingle sets are alike enough.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds a text's distinct shingles of
five words (with fewer words the whole sequence is one), as 64-bit hashes.  Texts of one set are
one class (named by 64 bits of its content), so copies meet once.

1. Every class posts the first shingles of its set in a global order: two sets that overlap in
   four fifths must share one of the first n - ceil(0.8 n) + 1 in whatever order.  Rare shingles
   come first and the most frequent ones, up to ``HOT_SHINGLES`` of them, last, so that a passage
   or line that many documents share brings few of them together.
2. The classes that post a shingle form a tile; tiles with the same least class are one.  Every
   class is first compared with the least class that it meets: one pair a class, and in a large
   group of near copies that links nearly all.
3. What such links leave apart in a tile is compared in size bands: sets whose sizes differ by
   more than a fifth never meet, and all others do in one band or the next.  Signatures are hashed
   bitmaps of parities, at least three fifths as wide as the set; sets differ in no fewer shingles
   than their bitmaps do in bits, and that bounds the overlap from above.  First each class's
   likeliest partner is tried; tiles in which a class had others are read again, for every pair
   that is still apart and possible.  Larger tiles are cut into pairs of blocks.
4. Surviving pairs are decided exactly on the sorted sets: 100 * intersection >= 80 * union.

Pairs within a component that links already join aren't compared again, so a group of n copies
costs about n comparisons and not n squared; no link between components is lost.

Defined results: null, empty and wordless texts have an empty set and are a component each;
repeated rows are one class; a component is named by its smallest doc_id that isn't null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _IS_WORD, BROADCAST_ROWS, SLICE_BYTES, WordHasher, discard, looked_up, mix64, pieces, staged, table, text_slices, word_spans

WORDS = 5
#: Frequent shingles that are ordered last; the list is bounded and sent to the workers.
HOT_SHINGLES = 30_000
#: A worker reports a shingle as frequent once so many of the texts it has just read hold it.
LOCAL_COUNT, FLUSH = 12, 3_000_000
#: Classes that a worker remembers, lest it repeats itself for copies.
SEEN_CLASSES = 500_000
#: Members of a tile's block, blocks up to which blocks stay that small, and members of a block beyond:
#: every member is compared with each block, so a large tile is cut into fewer, larger ones.
TILE_ROWS, TILE_BLOCKS, MOST_ROWS = 256, 64, 8192

_hasher = WordHasher(7)
RUN_STEP = 1 << 18
_PLACE = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, and where each text's words begin; one long text is hashed piece by piece."""
    if len(at) != 2 or len(data) <= 2 * SLICE_BYTES:
        starts, ends, words_at = word_spans(data, at)
        return _hasher(data, starts, ends), words_at
    found = [word_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in pieces(data, ~_IS_WORD)]
    h = np.concatenate(found)
    return h, np.array([0, len(h)])


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's set of shingles as a sorted array of 64-bit hashes."""
    h, words_at = word_hashes(data, at)
    run = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for first in range(0, len(run), RUN_STEP):  # in steps, lest a long text needs its hashes many times over
        part = run[first : first + RUN_STEP]
        for j in range(words):
            part += h[first + j : first + j + len(part)] * _PLACE[j % len(_PLACE)]
        part[:] = mix64(part)
    out = []
    for a, b in zip(words_at[:-1].tolist(), words_at[1:].tolist(), strict=True):
        n = b - a
        if n >= words:
            own = run[a : b - words + 1].copy()
            own.sort()
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif n:
            places = np.array(_PLACE[:n])
            total = (h[a:b] * places).sum(keepdims=True) + np.array([n], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out.append(mix64(total))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(own: np.ndarray) -> int:
    """64 bits of a set's content."""
    total = mix64(own).sum(keepdims=True, dtype=np.uint64) + np.array([len(own)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix64(total).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def bitmap(own: np.ndarray) -> bytes:
    """A hashed bitmap of at least three fifths as many bits as shingles (256 to 524288).

    A bit tells whether an odd number of shingles falls on it.  Two unrelated sets of one size then
    differ in half of the bits, three tenths of their size or more, and a link allows two ninths;
    bitmaps are most of what tiles shuffle, so they are no wider than that needs.
    """
    bits = min(1 << 19, max(256, 1 << (3 * len(own) // 5 - 1).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(one: bytes, words: int) -> np.ndarray:
    """A bitmap as a row of so many 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(one, np.uint64).reshape(-1, words), axis=0)


def may_link(n_a: np.ndarray, n_b: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Whether an overlap of four fifths of the union is possible, by the bits in which bitmaps differ.

    The overlap is (n_a + n_b - difference) / 2, and the difference is ``odd`` at least.
    """
    return n_a + n_b >= 9 * odd


class Tile:
    """The bitmaps of a tile's rows, folded to each width among them."""

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(m) // 8 for m in maps], np.int64)
        self.rows = {}
        for words in np.unique(self.words).tolist():
            rows = self.rows[words] = np.zeros((len(maps), words), np.uint64)
            for k in np.flatnonzero(self.words >= words).tolist():
                rows[k] = folded(maps[k], words)

    def odd(self, x: int, y: np.ndarray) -> np.ndarray:
        """The bits in which row x differs from each of rows y, at the narrower one's width."""
        out = np.zeros(len(y), np.int64)
        width = np.minimum(self.words[x], self.words[y])
        for words, rows in self.rows.items():
            at = np.flatnonzero(width == words)
            if len(at):
                out[at] = np.bitwise_count(rows[x] ^ rows[y[at]]).sum(axis=1, dtype=np.int64)
        return out


def _classes(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: documents (doc_id, cls, n, sig) and locally frequent shingles (shingle, k).

    A class's bitmap stands in the first of its rows that a task meets.
    """
    names = ["doc_id", "cls", "n", "sig", "shingle", "k"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[int] = set()

        def frequent() -> pa.RecordBatch:
            key, k = np.unique(np.concatenate(held), return_counts=True)
            key, k = key[k >= LOCAL_COUNT].view(np.int64), k[k >= LOCAL_COUNT]
            none = pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(k, pa.int64())], names=names)

        for batch in batches:
            for first, end, data, at in text_slices(batch.column(1)):
                sets = shingle_sets(data, at)
                n = np.array([len(s) for s in sets], np.int64)
                cls = [class_of(s) if len(s) else None for s in sets]
                sig = [None if c is None or c in seen or seen.add(c) else bitmap(s) for c, s in zip(cls, sets, strict=True)]
                none = pa.nulls(end - first, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(cls, pa.int64()), pa.array(n), pa.array(sig, pa.binary()), none, none], names=names)
                if len(seen) > SEEN_CLASSES:
                    seen.clear()
                held += sets
                size += int(n.sum())
                if size >= FLUSH:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(read, "doc_id long, cls long, n long, sig binary, shingle long, k long")


def _postings(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """key, cls: the first shingles of every class, once a task; those that ``hot`` lists come last in the order."""
    order, rank = np.sort(hot[:, 0].view(np.uint64)) if len(hot) else np.zeros(0, np.uint64), None
    if len(hot):
        rank = hot[np.argsort(hot[:, 0].view(np.uint64)), 1]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, at in text_slices(batch.column(1)):
                keys, names = [], []
                for own in shingle_sets(data, at):
                    if not len(own) or (name := class_of(own)) in seen:
                        continue
                    seen.add(name)
                    length = prefix_length(len(own))
                    if len(order):
                        where = np.minimum(np.searchsorted(order, own), len(order) - 1)
                        common = order[where] == own
                        rare = own[~common]
                        if len(rare) < length:
                            late = own[common][np.argsort(rank[where[common]], kind="stable")]
                            rare = np.concatenate([rare, late])
                        own = rare
                    keys.append(own[:length])
                    names.append(np.full(len(keys[-1]), name, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names))], names=["key", "cls"])
                if len(seen) > SEEN_CLASSES:
                    seen.clear()

    return docs.mapInArrow(post, "key long, cls long")


def shared_postings(postings: DataFrame) -> DataFrame:
    """cls, lo: the postings of keys that two classes share, with the least of the key's classes.

    Keys are summed up before they are shuffled, so no key's rows meet in one task; those that are
    shared are staged and joined back, and both sides of that join are shuffled rows, which Spark
    splits where a key is hot.
    """
    least = staged(postings.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key", "lo"), "shared-keys")
    return looked_up(postings, least, "key").select("cls", "lo")


def sets_of(docs: DataFrame, speakers: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """cls, shingles of the ``wanted`` classes, read from the document that speaks for each."""
    mine = staged(speakers.join(wanted, "cls"), f"{name}-speakers")
    if mine.count() <= BROADCAST_ROWS:
        mine = F.broadcast(mine)  # two numbers a class
    said = docs.alias("d").join(mine.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))).select(F.col("d.text"), F.col("s.cls"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, end, data, at in text_slices(batch.column(0)):
                # a doc_id that stands on several texts brings texts of other classes too
                rows = [(w, s) for w, s in zip(names[first:end], shingle_sets(data, at), strict=True) if len(s) and class_of(s) == w]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], names=["cls", "shingles"])

    return staged(said.mapInArrow(read, "cls long, shingles binary").dropDuplicates(["cls"]), f"{name}-sets")


def verified(pairs: DataFrame, bitmaps: DataFrame, speakers: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of classes that link: bound by bits first, then exact intersection."""
    side = lambda df, c: df.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in df.columns if x != "cls"])
    near = pairs.join(side(bitmaps, "a"), "a").join(side(bitmaps, "b"), "b").where("5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            keep = []
            for n_a, n_b, x, y in zip(rows["n_a"], rows["n_b"], rows["sig_a"], rows["sig_b"], strict=True):
                words = min(len(x), len(y)) // 8
                keep.append(bool(may_link(n_a, n_b, int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                where = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int(np.count_nonzero(v[where] == u))
                keep.append(100 * both >= 80 * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = staged(near.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(bound, "a long, b long"), f"{name}-bounded")
    wanted = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = sets_of(docs, speakers, wanted, name)
    links = staged(near.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(exact, "a long, b long"), f"{name}-links")
    discard(near, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable.  Labels fall to a neighbour's, then to their own label's."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    earlier = [labels]
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels.node == heard.a).select("node", "label", F.least("label", "heard").alias("low"))
        lower = staged(lower, "cc-lower")
        up = lower.select(F.col("node").alias("p"), F.col("low").alias("up"))
        after = staged(lower.join(up, lower.low == up.p).select("node", F.col("up").alias("new"), "label"), "cc-labels")
        still = after.where("new <> label").isEmpty()
        discard(lower, *earlier)
        earlier, labels = [after], after.select("node", F.col("new").alias("label"))
        if still:
            discard(both)
            return labels


def pieces_of(members: Column) -> Column:
    """Into how many blocks a tile of so many members is cut."""
    return F.least(F.ceil(members / TILE_ROWS), F.greatest(F.lit(TILE_BLOCKS), F.ceil(members / MOST_ROWS)))


def _tile_pairs(members: DataFrame, bitmaps: DataFrame, best: bool) -> DataFrame:
    """a, b, rest: pairs of different components in a tile that the bitmaps leave possible.

    ``members`` has lo (the tile), cls, label and n.  Bitmaps are joined to members only where a
    size band has another component.  ``best`` gives each class its likeliest partner only; where
    it had others, rest is the tile.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    banded = members.withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    kin = F.col("own") == F.col("band")
    counted = banded.groupBy("lo", "band").agg(F.count("*").alias("t"), F.sum(kin.cast("int")).alias("k"), F.min("label").alias("x"), F.max("label").alias("y"))
    counted = staged(counted.where("t > 1 and k > 0 and x <> y").select("lo", "band", "t"), "bands")
    cut = looked_up(banded, counted, ["lo", "band"]).withColumn("s", pieces_of(F.col("t")).cast("int")).join(bitmaps.select("cls", "sig"), "cls")
    block = F.pmod(F.xxhash64("cls"), F.col("s").cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    tiles = cut.withColumn("block", block).withColumn("x", F.explode(others)).select("lo", "band", "x.i", "x.j", "block", "own", "cls", "label", "n", "sig")
    place = ["lo", "band", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            lo, band, i, j = rows[0][:4]
            block, own, cls, label, n = (np.array([r[k] for r in rows], np.int64) for k in range(4, 9))
            maps = Tile([r[9] for r in rows])
            right = np.flatnonzero(block == j)
            for x in np.flatnonzero(block == i).tolist():
                y = right if i != j else right[right > x]
                ok = (label[y] != label[x]) & ((own[y] == band) | (own[x] == band))
                ok &= (5 * n[y] >= 4 * n[x]) & (5 * n[x] >= 4 * n[y])
                y = y[ok]
                odd = maps.odd(x, y)
                ok = may_link(n[x], n[y], odd)
                y, odd = y[ok], odd[ok]
                if len(y):
                    others = best and len(y) > 1
                    if others:
                        y = y[[(odd / (n[x] + n[y])).argmin()]]
                    yield np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y]), pa.array([lo if others else None] * len(y), pa.int64())

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)), pa.concat_arrays([o[2] for o in out])], names=["a", "b", "rest"])

        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:4] != row[:4]:
                    out += tile(held)
                    held = []
                held.append(row)
            if out:
                yield batch_of(out)
        out = list(tile(held)) if held else []
        if out:
            yield batch_of(out)

    return tiles.repartition(*place).sortWithinPartitions(*place).mapInArrow(compare, "a long, b long, rest long").distinct()


def similar_classes(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """node, label of the classes that have links; None if none has."""
    hot = rows.where("shingle is not null").groupBy("shingle").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "shingle").limit(HOT_SHINGLES).collect()
    frequent = np.array([(r["shingle"], r["k"]) for r in hot], np.int64).reshape(-1, 2)
    postings = staged(_postings(docs, frequent), "postings")
    tiles = staged(shared_postings(postings).select("lo", "cls").distinct(), "tiles")
    discard(postings)
    stars = staged(tiles.where("cls <> lo").groupBy("cls").agg(F.min("lo").alias("a")).withColumnRenamed("cls", "b"), "stars")
    if stars.isEmpty():
        return None
    wanted = tiles.select("cls").distinct()
    speakers = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    bitmaps = staged(rows.where("sig is not null").select("cls", "n", "sig").join(wanted, "cls").dropDuplicates(["cls"]), "bitmaps")
    links = verified(stars, bitmaps, speakers, docs, "stars")
    label = None if links.isEmpty() else components(links)
    sized = staged(tiles.join(bitmaps.select("cls", "n"), "cls"), "sized-tiles")
    discard(tiles, stars)
    todo = sized
    for best in (True, False):
        if label is None:
            named = todo.withColumn("label", F.col("cls"))
        else:
            named = todo.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        # one component needs no more links
        apart = staged(named.groupBy("lo").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("lo"), "tiles-apart")
        members = staged(looked_up(named, apart, "lo").select("lo", "cls", "label", "n"), "members")
        more = staged(_tile_pairs(members, bitmaps, best), "tile-pairs")
        discard(apart, members)
        if more.isEmpty():
            break
        found = verified(more.select("a", "b").distinct(), bitmaps, speakers, docs, "tiles")
        if not found.isEmpty():
            links = links.unionByName(found)
            label = components(links)
        # elsewhere every possible pair has been decided
        rest = staged(more.where("rest is not null").select(F.col("rest").alias("lo")).distinct(), "tiles-left")
        discard(more)
        if rest.isEmpty():
            break
        todo = looked_up(sized, rest, "lo")
    discard(bitmaps, sized)
    return label


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(_classes(plain), "classes")
    label = similar_classes(plain, rows)
    members = rows.where("n is not null").select("doc_id", "n", "cls")
    first = members.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    if label is not None:
        joined = first.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        joined = staged(joined, "class-labels")
        lowest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
        first = joined.join(lowest, "label").select("cls", "component_id")
    else:
        first = first.withColumnRenamed("least", "component_id")
    first = staged(first, "class-components")
    return looked_up(members, first, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as c from documents union select r.a, e.b from r join e on r.c = e.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from documents d left join n on n.doc_id = d.doc_id join (select a, min(c) as component_id from r group by 1) c on c.a = d.doc_id
"""
