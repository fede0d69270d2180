"""Odd rows through every operator: nulls, empty and long texts, copies, ties, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import compression_quality, encoding, exact_topk, hash_forest, language_id, line_dedup, mixing, ngram_join, packing, token_matrix, toxic_segments
from quillstone.llm.common import staged

LONG = " ".join(f"word{i % 701}x{i % 13}" for i in range(30_000))
RUN = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "Hello there, this is the first text.", "en", "b", 9),
    (4, "Hello there, this is the first text.", "en", "b", 9), (None, "No name but some words here and there.", "en", None, 1), (5, LONG, "en", "a", None),
    (6, LONG + " tail", "en", "a", 1), (7, "own line seven\n" + RUN + "\nend seven", "fr", "c", 2), (8, "own line eight\n" + RUN + "\nend eight", "fr", "c", 2),
    (9, "!!! 123 ###", "de", "c", 1), (10, "Σίσυφος ÉTÉ naïve 中文 😀 <|endoftext|>", "fr", "d", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, cls string, size int, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return staged(spark.createDataFrame([(*r, 0.5, 1, "x", 2, "y") for r in ROWS], SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def nothing(docs):
    return staged(docs.where("false"), "none")


def test_line_dedup(docs, nothing):
    out = line_dedup.dedup_lines(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(ROWS)
    assert rows[7]["text"].count("shared") == 60 and rows[8]["text"] == "own line eight\nend eight"
    assert rows[1]["text"] is None and rows[1]["__n_lines"] == 0 and rows[2]["text"] == "" and rows[3]["text"] == " \n\t "
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = ["a b c", "d e", "f", "g h i j", "k l m n o p"]
    texts = ["\n".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))) for _ in range(30)]
    lines = [t.split("\n") for t in texts]
    gone, earlier = [set() for _ in texts], set()
    for d, own in enumerate(lines):  # every run of at least 7 words, by its first place
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                run = tuple(own[s:e])
                if sum(len(x.split()) for x in run) >= 7:
                    if run in earlier:
                        gone[d] |= set(range(s, e))
                    earlier.add(run)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, 7).collect()}
    assert found == {d: "\n".join(x for i, x in enumerate(own) if i not in gone[d]) for d, own in enumerate(lines)}


def test_mixing(docs, nothing):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.where("text is null or text = ''").isEmpty()
    light = staged(mixing.weighed(docs.select("doc_id", "text", "source")).drop("text"), "light")
    rows = mixing.with_copies(light, mixing.choose(light)).collect()
    assert len(rows) == len(ROWS) and all(r["__copies"] <= 2 for r in rows)
    assert mixing.mix_documents(nothing).count() == 0


def test_ngram_join(docs, nothing):
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs).collect())
    found = {d: (n, c) for d, n, c in rows}
    assert len(rows) == len(ROWS) and found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[6][1] == 5 and found[8][1] == 7 and found[9] == (1, 9)
    assert ngram_join.join_documents(nothing).count() == 0


def test_classifiers(spark, docs, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (5, 1, 0), (7, None, None), (9, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (docs, nothing):
        model = compression_quality.learn(given, labels)
        scores = compression_quality.score_quality(docs, model).collect()
        assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
        model = toxic_segments.learn(given, labels)
        scores = toxic_segments.score_toxicity(docs, model).collect()
        assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
        model = language_id.learn(given)
        said = language_id.identify(docs, model)
        assert said.columns[:-2] == docs.columns
        rows = {r["doc_id"]: r["__lang"] for r in said.collect()}
        assert rows[1] == rows[2] == rows[3] == "und" and rows[4] == ("en" if given is docs else "und")
    assert language_id.identify(nothing, language_id.learn(docs)).count() == 0


def test_token_files(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = encoding.vocabulary_path()
    library = Tokenizer.from_file(path)
    token_matrix.write_token_shards(docs, path, 1, f"file://{tmp_path}/shards", shard_tokens=500)
    rows = token_matrix.read_documents(spark, f"file://{tmp_path}/shards").orderBy("start").collect()
    wanted = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in sorted(ROWS, key=lambda r: r[0] or 0)]
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(d, len(ids)) for d, ids in wanted]
    blobs = spark.read.parquet(f"file://{tmp_path}/shards").orderBy("part", "number").collect()
    ids = [i for _, x in wanted for i in x]
    opened = [token_matrix.WaveletMatrix(b["matrix"]) for b in blobs]
    assert [i for m in opened for i in m.decode().tolist()] == ids
    m = max(opened, key=lambda x: x.n)
    own = m.decode().tolist()
    token = own[len(own) // 3]
    assert [m.access(i) for i in range(0, m.n, 997)] == own[::997]
    assert m.count(token) == own.count(token) and m.rank(token, 700) == own[:700].count(token)
    assert m.select(token, 0) == own.index(token)
    token_matrix.write_token_shards(nothing, path, 1, f"file://{tmp_path}/none")
    assert token_matrix.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_packing(docs, nothing):
    rows = packing.pack_documents(docs, encoding.vocabulary_path()).orderBy("sequence_id", "offset").collect()
    fill = {}
    for r in rows:
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert packing.pack_documents(nothing, encoding.vocabulary_path()).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 2.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (100, [5.0, 5.0]), (11, [-1.0, 3.0])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, score string")
    from quillstone.llm.vectors import usable

    good = df.where(usable()).select("vec_id", F.transform("embedding", lambda x: F.floor(x)).alias("embedding"))
    top = exact_topk.exact_topk(good, good.where("vec_id % 100 = 0"), 3).where("query_id = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in top] == [(100, 5), (1, 1), (2, 1)]
    some = df.where(usable()).where(F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")
    near = hash_forest.nearest(hash_forest.index(some), some.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in near][:2] == [1, 2] and near[0]["score"] == 1.0
    none = some.where("false")
    assert exact_topk.exact_topk(none, none, 3).count() == 0 and hash_forest.nearest(hash_forest.index(none), none, 3).count() == 0


def test_pipeline_stages(spark, docs, nothing):
    for given in (docs, nothing):
        out = given
        for name, stage in corpus_pipeline.STAGES:
            last = staged(stage(spark, out, ""), name)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert last.columns == docs.columns
            out = last
        assert (out.count() > 0) == (given is docs)
