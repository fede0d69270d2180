"""The pipeline's stages remove copies that are short, ragged, or stand under repeated and missing doc_ids."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts], SCHEMA)


def test_short_runs_of_lines_are_copies(spark):
    passage = [f"p{i}a p{i}b p{i}c p{i}d p{i}e p{i}f" for i in range(9)]  # 54 words, 42 of them in whole inner lines
    single = "This nine word line stands in many a document"
    texts = [
        (1, "\n".join(["own one " + passage[0], *passage[1:-1], passage[-1] + " own one end"])),
        (2, "\n".join(["own two " + passage[0], *passage[1:-1], passage[-1] + " own two end"])),
        (3, "third begins\n" + single + "\nthird ends"),
        (4, "fourth begins\n" + single + "\nfourth ends"),
        (5, "fifth begins\nAll rights reserved.\nfifth ends"),
        (6, "sixth begins\nAll rights reserved.\nsixth ends"),
    ]
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, frame(spark, texts), "").collect()}
    wanted = dict(texts) | {2: "own two " + passage[0] + "\n" + passage[-1] + " own two end", 4: "fourth begins\nfourth ends"}
    assert found == wanted


def test_one_row_of_each_group_stays_under_any_doc_ids(spark):
    def text(name, tail=""):
        return " ".join(f"{name}{i}" for i in range(60)) + tail

    texts = [
        (1, text("a")), (5, text("e")), (5, text("a", " near")),  # 5 keeps e, its copy of 1's text goes
        (None, text("a", " too")), (None, text("n")), (None, text("n", " near")), (None, text("n")),  # one of n's rows stays
        (7, text("s")), (7, text("s", " near")), (8, text("s")), (9, text("o")), (9, text("o")),
    ]
    found = [(r["doc_id"], r["text"].split()[0]) for r in corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "").collect()]
    assert sorted(found, key=str) == sorted([(1, "a0"), (5, "e0"), (None, "n0"), (7, "s0"), (9, "o0")], key=str)
