"""Queries without SQL against plain row-by-row versions of the same, on whole small tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import compression_quality, encoding, exact_topk, hash_forest, language_id, line_dedup, mixing, ngram_join, packing, queries, token_matrix, toxic_segments
from quillstone.llm.common import is_held_out, staged, table

SF = "/root/testdata/sf0.001"


def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.vocabulary_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op7_equals_the_library(spark, library):
    found = queries.QUERIES["op7_token_matrix"](spark, SF).collect()
    start, wanted = 0, []
    for d, t in sorted(texts().items()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        wanted.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in found) == wanted


def test_op8_equals_the_library_and_comes_near_the_bound(spark, library):
    found = queries.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    wanted, lengths = [], Counter()
    for d, t in texts().items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            wanted.append((d, piece, at, len(part), crc(part)))
            lengths[len(part)] += 1
    assert sorted(tuple(r)[:5] for r in found) == sorted(wanted)
    fill = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    short = sorted(n for n in lengths if n < 2048)
    bound, _ = packing.solve_program(np.array(short), np.array([lengths[n] for n in short]), 2048)
    assert len(fill) <= 1.01 * (np.ceil(bound - 1e-6) + lengths[2048]) + 1


def test_packing_of_triples_that_fill_their_sequences():
    rng = np.random.default_rng(1)
    histogram, n = Counter(), 2000
    for _ in range(n):
        a, b = rng.integers(500, 800, 2).tolist()
        histogram.update([a, b, 2048 - a - b])
    plan = packing.solve_patterns(dict(histogram), 2048)
    held = Counter()
    for pattern, times in plan:
        assert sum(k * c for k, c in pattern.items()) <= 2048
        held.update({k: c * times for k, c in pattern.items()})
    bound, _ = packing.solve_program(np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)]), 2048)
    used = sum(times for _, times in plan)
    print(f"{used} sequences, bound {bound}, best fit alone {sum(t for _, t in packing.best_fit_decreasing(histogram, 2048))}")
    assert held == histogram and n - 1e-6 >= bound - 1 and used <= 1.01 * np.ceil(bound - 1e-6)


def test_op4_scores_by_compressed_sizes(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    model = compression_quality.learn(docs, labels.where(~is_held_out(F.col("doc_id"), 4, 2)).select("doc_id", "quality"))
    found = {r["doc_id"]: r for r in queries.QUERIES["op4_compression_quality"](spark, SF).collect()}

    def size(text, part):
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(part), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(squeeze.compress(text[i : i + 4096])) for i in range(0, len(text), 4096))

    for d, t in texts().items():
        raw = (t or "").encode()
        x = [0.0] * 4
        if raw:
            a, b = size(raw, model.parts[0]), size(raw, model.parts[1])
            gap, rate = (b - a) / (a + b), np.log(len(raw) / a)
            x = [gap, gap * abs(gap), rate, rate**2]
        score = 1 / (1 + np.exp(-np.clip(np.dot([*x, 1.0 if raw else 0.0], model.fit[:-1]) + model.fit[-1], -30, 30)))
        assert abs(found[d]["score"] - score) < 1e-6 and found[d]["predicted"] == (found[d]["score"] >= 0.7)


def plain_language(model, text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = np.zeros(len(model.pairs))
    for order in range(1, language_id.ORDERS + 1):
        for i in range(len(raw)):
            h = raw[i]
            for k in range(1, order):
                h = h * 0x01000193 & 0xFFFFFFFF
                if i + k < len(raw):
                    h ^= raw[i + k]
            bucket = (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language_id.BITS
            total += model.weights[bucket + ((order - 1) << language_id.BITS)]
    margin = total / (language_id.ORDERS * len(raw)) + model.intercepts
    chance = dict(zip(model.pairs, 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30))), strict=True))

    def choose(group, names):
        over = lambda a, b: chance[group, a, b] if (group, a, b) in chance else 1 - chance[group, b, a]
        votes = [sum(over(a, b) for b in names if b != a) for a in names]
        best = names[int(np.argmax(votes))]
        return best, min([1.0, *[over(best, b) for b in names if b != best]])

    family, sure = choose(None, list(model.tree))
    lang, more = choose(family, model.tree[family])
    return lang, sure * more


def test_op6_scores_by_votes(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~is_held_out(F.col("doc_id"), 5, 0)))
    found = {r["doc_id"]: r for r in queries.QUERIES["op6_language_id"](spark, SF).collect()}
    short = {d: t for d, t in texts().items() if len(t or "") < 1500}
    assert len(short) > 50
    for d, t in short.items():
        lang, score = plain_language(model, t)
        assert found[d]["lang_pred"] == lang and abs(found[d]["score"] - score) < 1e-4


def test_languages_of_one_family_are_told_apart(spark):
    words = {"en": "the cat sat with those other things", "de": "die katze sitzt nicht auf der matte", "nl": "de kat zit niet op het kleine matje", "fr": "le chat est assis sur une chaise", "es": "el gato no quiere la comida hoy"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i, lang in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.where("doc_id < 100"))
    assert model.tree == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"]}
    said = language_id.identify(docs.where("doc_id >= 100"), model).collect()
    assert all(r["__lang"] == r["lang"] for r in said)


def all_maximal(scores):
    """Maximal-scoring segments by definition: the best of all, then those left and right of it."""
    if not len(scores):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    value = {(a, b): sums[b + 1] - sums[a] for a in range(len(scores)) for b in range(a, len(scores))}
    (a, b), best = max(value.items(), key=lambda x: (x[1], -(x[0][1] - x[0][0])))
    if best <= 1e-9:
        return []
    return [*all_maximal(scores[:a]), (a, b, best), *[(x + b + 1, y + b + 1, s) for x, y, s in all_maximal(scores[b + 1 :])]]


def test_segments_equal_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(150):
        scores = np.where(rng.random(rng.integers(1, 25)) < 0.4, rng.random() * 3 * rng.random(1)[0] + rng.random(1)[0], -toxic_segments.DRIFT)
        scores = np.where(scores > 0, scores + rng.random(len(scores)), scores)
        hits = np.flatnonzero(scores > 0)
        found = toxic_segments.maximal_segments(hits, scores[hits])
        wanted = all_maximal(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in wanted]
        assert np.allclose([s for *_, s in found], [s for *_, s in wanted])


def test_op9_finds_planted_passages(spark):
    rng = np.random.default_rng(6)
    clean, toxic = [f"{a}{b}lain{c}" for a in "bcdfg" for b in "aeiou" for c in "bcdfghklmnpr"], [f"vile{c}" for c in "abcdefghijkl"]
    rows, labels, spans = [], [], {}
    for d in range(240):
        before, after = " ".join(rng.choice(clean, 60)), " ".join(rng.choice(clean, 60))
        passage = " ".join(rng.choice(toxic, 8)) if d % 3 == 0 else ""
        rows.append((d, f"{before} {passage} {after}"))
        spans[d] = (len(before) + 1, len(before) + 1 + len(passage)) if passage else None
        labels.append((d, int(d % 3 == 0)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxic_segments.learn(docs, marked.where("doc_id < 180"))
    assert 0 < model.k <= 1
    for r in toxic_segments.score_toxicity(docs, model).collect():
        if spans[r["doc_id"]]:
            assert r["score"] > 0.5 and [(p["start"], p["end"]) for p in r["passages"]] == [spans[r["doc_id"]]]
        else:
            assert r["score"] < 0.3 and not r["passages"]


def test_forest_recall_and_share(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op5_hash_prefix_forest"](spark, sf).collect()
    rows = [(i, np.array(v, float)) for i, v in duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' where embedding is not null").fetchall()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    mine = {}
    for r in found:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    met = 0
    for q in mine:
        cosine = unit @ unit[ids == q][0]
        cosine[ids == q] = -2
        met += len(mine[q] & set(ids[np.lexsort((ids, -cosine))[:5]].tolist()))
    print(f"recall {met} of {5 * len(mine)}")
    assert len(mine) == (ids % 50 == 0).sum() and met >= 0.9 * 5 * len(mine)
    forest = hash_forest.Forest.grown(x)
    codes = hash_forest.hash_strings(x[:20], hash_forest.planes_of(x.shape[1], hash_forest.TREES, hash_forest.SEED))
    longest, ranges = forest.descend(codes)
    plain = lambda a, b: 32 - (int(a) ^ int(b)).bit_length()
    grown = hash_forest.hash_strings(x, hash_forest.planes_of(x.shape[1], hash_forest.TREES, hash_forest.SEED))
    for t in (0, 7, 127):
        for q in range(20):
            common = [plain(codes[t, q], s) for s in grown[t]]
            assert longest[t, q] == max(common)
            for level in (1, 4, 9, 13, int(longest[t, q])):
                a, b = ranges[level, :, t, q]
                if level <= longest[t, q]:
                    assert set(forest.order[t][a:b].tolist()) == {i for i, n in enumerate(common) if n >= level}


def test_topk_scores_few_rows():
    rows = np.floor(1024 * np.array([v for (v,) in duckdb.sql("select embedding from '/root/testdata/sf0.01/embeddings.parquet' where embedding is not null").fetchall()], float))
    queries_ = rows[::25]
    own = np.zeros((len(queries_), len(rows)), bool)
    left = exact_topk.Lists(rows).in_question(queries_, own, 10, np.full(len(queries_), -np.inf))
    share = np.mean([len(x) for x in left]) / len(rows)
    print(f"{share:.4f} of the rows resolved")
    assert share < 0.1
    for q, maybe in zip(queries_, left, strict=True):
        scores = rows @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-10])) <= set(maybe.tolist())


@pytest.mark.parametrize("rows, blocks", [(256, 64), (8, 64), (4, 3)])
def test_links_of_a_hot_group_equal_brute_force(spark, monkeypatch, rows, blocks):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", rows)
    monkeypatch.setattr(ngram_join, "TILE_BLOCKS", blocks)
    monkeypatch.setattr(ngram_join, "MOST_ROWS", 40)
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary, 120).tolist() for _ in range(3)]
    docs = []
    for d in range(260):  # a chain of near copies about three texts, a passage that all share, and others
        words = list(base[d % 3]) if d < 200 else rng.choice(vocabulary, 80).tolist()
        for at in rng.choice(len(words), rng.integers(0, 5), replace=False):
            words[at] = f"x{rng.integers(50)}"
        docs.append((d, " ".join(words + [f"p{i}" for i in range(12)])))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[max(root(a), root(b))] = min(root(a), root(b))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d: (len(sets[d]), root(d)) for d, _ in docs}
    assert len({c for _, c in found.values()}) > 40


def test_mix_keeps_its_budget(spark):
    rng = np.random.default_rng(9)
    rows = [(i if i % 7 else 3, " ".join(["word"] * int(rng.integers(1, 9))), "abc"[min(2, int(rng.integers(0, 12)) // 5)]) for i in range(3000)]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), "mix")
    light = staged(mixing.weighed(docs).drop("text"), "light")
    chosen = mixing.with_copies(light, mixing.choose(light)).collect()
    again = mixing.with_copies(light, mixing.choose(light)).collect()
    assert sorted((r["__row"], r["__copies"]) for r in chosen) == sorted((r["__row"], r["__copies"]) for r in again)
    size, taken, target = Counter(), Counter(), {}
    for r in chosen:
        size[r["source"]] += r["__size"]
        taken[r["source"]] += r["__size"] * r["__copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["__copies"] <= 2 and r["source_size"] == sum(len(t.split()) for _, t, s in rows if s == r["source"])
    weight, open_, left = dict(zip(sorted(size), (3, 1, 2), strict=True)), set(size), 1.5 * sum(size.values())
    wanted = {}
    while True:  # the excess is shared anew until nobody is above
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not above:
            break
        wanted |= {s: 2.0 * size[s] for s in above}
        left -= sum(2.0 * size[s] for s in above)
        open_ -= above
    wanted |= {s: level * weight[s] for s in open_}
    assert target == pytest.approx(wanted) and all(abs(taken[s] - wanted[s]) <= 4 for s in size)


def test_mix_prefers_given_quality(spark):
    rows = [(i, "same words here", "a", 1.0 if i % 2 else 0.01) for i in range(2000)] + [(9999, "word " * 9000, "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    out = mixing.mix_documents(docs, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double"), quality=F.col("score"), share=0.4)
    kinds = Counter(r["doc_id"] % 2 for r in out.where("source = 'a'").collect())
    assert kinds[1] > 20 * kinds[0]


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_differ_by_a_hard_pattern(spark, library):
    words = [(2 * n + flip, thue_morse(n, flip)) for n in (512, 1024, 2048, 4096) for flip in (0, 1)]
    docs = spark.createDataFrame([(d, f"{w} {w}x") for d, w in words], "doc_id long, text string")
    assert all(r["doc_id"] == r["component_id"] for r in ngram_join.join_documents(docs).collect())
    encoder = encoding.WordEncoder(encoding.vocabulary_path())
    for text in [" ".join(w for _, w in words), *[w for _, w in words]]:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_units_of_one_hash_are_told_apart(library):
    encoder = encoding.WordEncoder(encoding.vocabulary_path())
    encoder.hashers = (lambda data, a, b: np.zeros(len(a), np.uint64)), encoder.hashers[1]
    for text in ("one", "two three one", "extraordinary misunderstandings, one two", "four extraordinary"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_very_long_text_goes_in_pieces(library):
    words = [f"word{i % 7001}" + ("é" if i % 5 else "") for i in range(1_300_000)]
    text = " ".join(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(raw)])
    assert len(raw) > 10 << 20
    half = text[: len(text) // 2]
    encoder = encoding.encoder(encoding.vocabulary_path())
    ids, where = encoder.encode(raw, at)
    plain, _ = encoder._encode(raw, at)
    assert (ids == plain).all() and where.tolist() == [0, len(ids)]
    assert library.encode(half[:200_000], add_special_tokens=False).ids[:-2] == ids[: len(library.encode(half[:200_000], add_special_tokens=False).ids) - 2].tolist()
    whole = ngram_join.shingle_sets(raw, at)[0]
    wanted = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(whole) == len(wanted)
    weights = np.random.default_rng(0).normal(size=(language_id.ORDERS << language_id.BITS, 2)).astype(np.float32)
    both = np.concatenate([raw, raw[:10]])  # the same text beside a short one is read at once
    long, short = language_id.mean_margins(raw, at, weights)[0], language_id.mean_margins(both, np.array([0, len(raw), len(both)]), weights)[0]
    assert np.abs(long - short).max() < 1e-5


def test_samples_are_bounded_by_rows(spark):
    labels = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("quality")).union(spark.createDataFrame([(8, 0)], "doc_id long, quality int"))
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(8, "bad")], "doc_id long, text string"))
    from quillstone.llm.learning import labelled_texts

    rows = labelled_texts(docs.union(docs), labels, "quality", 200, "sample")
    kinds = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    assert kinds[0] == 1 and 100 < kinds[1] < 300


def test_one_doc_id_on_many_rows_is_dealt_out(spark, tmp_path):
    docs = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # which would join so few rows
    try:
        token_matrix.write_token_shards(docs, encoding.vocabulary_path(), 1, f"file://{tmp_path}/shards")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_matrix.read_documents(spark, f"file://{tmp_path}/shards").collect()
    assert len(rows) == 4000 and max(Counter(r["part"] for r in rows).values()) < 2500
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_pipeline_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    said = staged(corpus_pipeline.identify_language(spark, docs, SF), "p1")
    kept = {r["doc_id"]: r for r in said.collect()}
    assert set(kept) == {d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    assert all(kept[d]["text"] == rows[d]["text"] and kept[d]["source"] == rows[d]["source"] for d in kept)

    lines = staged(corpus_pipeline.dedup_lines(spark, said, SF), "p2")
    earlier, wanted = set(), {}
    for d in sorted(kept):
        own = kept[d]["text"].split("\n")
        at = [i for i, x in enumerate(own) if x.strip(" \t\n\x0b\x0c\r")]
        bare = [own[i].strip(" \t\n\x0b\x0c\r") for i in at]
        size = [len(ngram_words(x)) for x in bare]
        gone, runs = set(), []
        for s in range(len(at)):
            for e in range(s, len(at)):
                if sum(size[s : e + 1]) >= line_dedup.MIN_WORDS:
                    runs.append((tuple(bare[s : e + 1]), s, e))
                    break
        for e in range(len(at)):
            for s in range(e, -1, -1):
                if sum(size[s : e + 1]) >= line_dedup.MIN_WORDS:
                    runs.append((tuple(bare[s : e + 1]), s, e))
                    break
        for run, s, e in sorted(set(runs), key=lambda x: x[1]):
            if run in earlier:
                gone |= set(range(s, e + 1))
            earlier.add(run)
        if not gone or len(gone) < len(at):
            wanted[d] = "\n".join(x for i, x in enumerate(own) if i not in {at[g] for g in gone})
    found = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert found == wanted

    near = staged(corpus_pipeline.drop_near_copies(spark, lines, SF), "p3")
    sets = {d: shingles(t) for d, t in found.items()}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    assert {r["doc_id"] for r in near.collect()} == {d for d in sets if root(d) == d}

    mixed = staged(corpus_pipeline.mix_sources(spark, near, SF), "p4")
    copies = Counter(r["doc_id"] for r in mixed.collect())
    total = sum(len(ngram_words(found[d])) * n for d, n in copies.items())
    whole = sum(len(ngram_words(r["text"])) for r in near.collect())
    assert max(copies.values()) <= 2 and abs(total - min(1.5, 2.0) * whole) < 0.05 * whole + 500

    pieces = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    ends = Counter((r["doc_id"], r["piece"]) for r in pieces)
    assert {d: n for (d, p), n in ends.items() if p == 0} == dict(copies)


def ngram_words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in ngram_words(text)]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
