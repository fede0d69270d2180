"""Operators on small inline rows, and against sequential models."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstone.functions import geometry, text
from quillstone.operators import media, ordered, requests, validation
from quillstone.sources import pairs
from quillstone.streaming.limiter import limit_stream

GOOD = {"pair_id": "p1", "shape": "round", "volume_cc": 350, "view": "front", "consent_ref": "a-1"}


def errors_of(spark, metas, folder="p1", strict=False):
    rows = [(i, m if isinstance(m, str) else json.dumps(m), folder, "b.jpg", "a.jpg") for i, m in enumerate(metas)]
    df = spark.createDataFrame(rows, "i int, meta_json string, folder string, before string, after string")
    return [r["errors"] for r in validation.validated(df, strict).orderBy("i").collect()]


def test_volume_types(spark):
    low = "volume_cc must be an integer between 100 and 1000, got "
    values = [99, 100, 1000, 1001, 350.0, "350", True, 0]
    found = errors_of(spark, [GOOD | {"volume_cc": v} for v in values])
    assert [len(e) for e in found] == [1, 0, 0, 1, 1, 1, 1, 2]
    assert found[0] == [low + "99"] and found[5] == [low + "'350'"] and found[6] == [low + "True"]
    assert found[7] == ["missing required field 'volume_cc'", low + "0"]


def test_truthiness_and_order(spark):
    without = {k: v for k, v in GOOD.items() if k != "consent_ref"}
    found = errors_of(spark, [without, *[GOOD | {"consent_ref": v} for v in (None, "", "x", "  ", [], {}, False)]])
    assert [len(e) for e in found] == [1, 1, 1, 0, 0, 1, 1, 1]
    everything = errors_of(spark, [{"shape": "oval", "view": "top", "pair_id": "q"}])[0]
    assert [e.split(" ")[0] for e in everything] == ["missing", "missing", "invalid", "invalid", "pair_id"]


def test_unreadable_metadata(spark):
    assert errors_of(spark, ["{cut", "[1]", "3"]) == [["meta.json is not valid JSON"], ["meta.json is not an object"], ["meta.json is not an object"]]
    assert errors_of(spark, [GOOD | {"clothing": "coat", "months_post_op": -1}], strict=True) == [["clothing is not in its domain", "months_post_op must be a number of at least 0"]]


def test_consent_gate_is_strict_by_default(spark):
    rows = spark.createDataFrame([("a", True), (" ", True), ("b", True), ("c", False), (None, True), ("d", None)], "ref string, adult boolean")
    consents = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False)], "consent_ref string, revoked boolean")
    kept = validation.consent_gate(rows, F.col("ref"), consents=consents, adult=F.col("adult")).collect()
    assert [r["ref"] for r in kept] == ["a"]
    assert validation.consent_gate(rows, F.col("ref")).isEmpty()
    assert validation.consent_gate(rows, F.col("ref"), parity=True).count() == 5


def test_caption_and_bands(spark):
    df = spark.createDataFrame([(350, "round", "moderate-plus", None)], "v long, s string, p string, b string")
    said = df.select(text.caption(*map(F.col, "vspb"))).first()[0]
    assert said == (
        "Edit this photo to simulate the outcome of breast augmentation surgery with 350 cc round implants giving even fullness and visible roundness in the upper breast, "
        "using a balanced moderate-plus profile. The change should read as a natural-looking increase of roughly one to one and a half cup sizes. "
        "Keep the person's identity, pose, skin tone, clothing, lighting and background exactly the same."
    )
    bands = spark.createDataFrame([(v,) for v in (249, 250, 399, 400, 549, 550, 699, 700)], "v int").select(text.size_phrase(F.col("v"))).collect()
    assert [bands[i] != bands[i + 1] for i in range(7)] == [True, False, True, False, True, False, True]


def test_aspects(spark):
    sizes = [(832, 1216, "2:3"), (1536, 1024, "3:2"), (1000, 1000, "1:1"), (4000, 100, "21:9"), (1080, 1920, "9:16"), (0, 5, None), (None, 5, None)]
    rows = spark.createDataFrame(sizes, "w int, h int, a string").select(geometry.closest_aspect(F.col("w"), F.col("h")), "a").collect()
    assert all(r[0] == r[1] for r in rows)


def dedupe_model(rows):
    seen, out = set(), []
    for _, before, after, b_ok, a_ok in rows:
        good = b_ok and before not in seen
        if good:
            seen.add(before)
            good = a_ok and after not in seen
            if good:
                seen.add(after)
        out.append(bool(good))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dedupe_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"d{rng.randrange(40)}", f"d{rng.randrange(40)}", rng.random() > 0.1, rng.random() > 0.1) for i in range(60)]
    df = spark.createDataFrame([(i, f"c/{i}", *r) for i, *r in rows], "ord long, label string, before string, after string, before_ok boolean, after_ok boolean")
    assert [r["accepted"] for r in ordered.dedupe_greedy(df).orderBy("ord").collect()] == dedupe_model(rows)


def hits(seed, n=300):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 500, 3000, 9000, 60_000])
        out.append((rng.choice("ab"), t, i))
    return out


def limit_model(rows):
    logs, out = {}, {}
    for key, t, i in rows:
        kept = [x for x in logs.get(key, []) if t - x < 60_000]
        out[i] = len(kept) >= 8
        logs[key] = kept if out[i] else [*kept, t]
    return out


def test_rate_limit(spark):
    rows = hits(1) + [("edge", t, 1000 + t) for t in (0, 1, 2, 3, 4, 5, 6, 7, 8, 60_000)]
    found = {r["id"]: r["blocked"] for r in ordered.rate_limit(spark.createDataFrame(rows, "key string, t long, id long")).collect()}
    assert found == limit_model(rows)
    assert found[1008] and not found[61_000]


def test_streaming_limiter(spark, tmp_path):
    rows = hits(2, 120)
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], "key string, t long, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, t long, id long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = limit_stream(stream).writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["id"]: r["blocked"] for r in spark.table("judged").collect()} == limit_model(rows)


def test_streaming_limiter_that_forgets(spark, tmp_path):
    import time

    rows = hits(3, 60)
    spark.createDataFrame(rows, "key string, t long, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, t long, id long").parquet(str(tmp_path / "in"))
    q = limit_stream(stream, forget_idle=True).writeStream.format("memory").queryName("forgetful").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        end = time.time() + 60
        while spark.table("forgetful").count() < len(rows) and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert {r["id"]: r["blocked"] for r in spark.table("forgetful").collect()} == limit_model(rows)


def test_split(spark):
    for n, wanted in ((0, 0), (1, 0), (2, 1), (10, 1), (25, 2), (400, 40)):
        df = spark.createDataFrame([(f"p{i}",) for i in range(n)], "pair_id string")
        for split in (ordered.split_assign, ordered.split_assign_listed):
            found = split(df).collect()
            assert len(found) == n and sum(r["split"] == "val" for r in found) == wanted


def test_guards_fail_in_order(spark):
    body = json.dumps({"image": "aGk", "mimeType": "image/png", "config": {"brandId": "mentor", "shape": "round", "profileId": "high", "volumeCc": 350}})
    rows = [(1, True, None, "{"), (2, False, None, "{"), (3, False, "10", "{"), (4, False, "10", "{}"), (5, False, "10", body.replace("png", "gif")), (6, False, "10", body.replace("350", '"350"')), (7, False, "10", body), (8, False, "Infinity", body)]
    df = spark.createDataFrame(rows, "k int, limited boolean, content_length string, body string")
    found = [r[0] for r in requests.guarded(df, F.col("limited")).orderBy("k").select("response.status").collect()]
    assert found == [429, 413, 400, 400, 400, 400, 200, 413]
    strict = requests.guarded(df.where("k = 7"), F.col("limited"), strict=True).select("response.status").first()[0]
    assert strict == 400


def test_media_fails_closed(spark):
    images = spark.createDataFrame([("p", "before", b"x"), ("q", "after", None)], "label string, stem string, content binary")
    assert [r["reason"] for r in media.deidentify(images, codec=lambda: None).collect()] == ["no image codec is installed"] * 2

    def codec():
        import numpy as np

        return (lambda b: np.full((40, 40, 3), 7, "uint8")), (lambda a: a.tobytes())

    assert media.deidentify(images, codec, lambda: None).orderBy("label").first()["reason"] == "no face detector is installed"
    none = media.deidentify(images, codec, lambda: lambda image: [], crop_top=0.2).orderBy("label").collect()
    assert [r["reason"] for r in none] == ["no face detected in before", "cannot read after"]
    found = media.deidentify(images, codec, lambda: lambda image: [(5, 5, 10, 10)]).orderBy("label").first()
    assert found["reason"] is None and found["faces"] == [Row(x=5, y=5, w=10, h=10)]


def test_pixelated_hides_detail():
    np = pytest.importorskip("numpy")
    image = np.random.default_rng(0).integers(0, 255, (100, 120, 3)).astype("uint8")
    out = media.pixelated(image, [(40, 30, 20, 20)])
    assert (out[:20] == image[:20]).all() and out[30:50, 40:60].std() < image[30:50, 40:60].std() / 3


def test_folders(spark, tmp_path):
    for clinic, pair, names in (("c1", "p1", ("before.png", "before.jpg", "after.webp")), ("c2", "p1", ("before.JPG", "after.jpeg"))):
        folder = tmp_path / "raw" / clinic / pair
        folder.mkdir(parents=True)
        (folder / "meta.json").write_text(json.dumps(GOOD))
        for name in names:
            (folder / name).write_bytes(b"x")
    (tmp_path / "raw/c1/p2").mkdir()
    metas = pairs.scan_raw(spark, str(tmp_path / "raw"))
    assert metas.count() == 2
    both = pairs.assemble(metas, pairs.scan_images(pairs.image_files(spark, str(tmp_path / "raw"))), ["clinic", "folder"])
    checked = validation.validated(both).withColumn("pair_id", F.lit("p1"))
    rows = {r["clinic"]: r for r in checked.collect()}
    assert rows["c1"]["before"].endswith("before.jpg") and rows["c1"]["accepted"]
    assert rows["c2"]["errors"] == ["no before.(jpg|png|webp) image"]
    assert pairs.id_collisions(checked).first()["clinics"] == ["c1", "c2"]
    out = checked.where("accepted").withColumns({"split": F.lit("val"), "caption": F.lit("c"), "audited": F.lit(False), "consent_ref": F.lit("a-1"), "adult_attested": F.lit(True)})
    pairs.write_manifest(out, str(tmp_path / "manifest"), parity=True)
    line = json.loads(next(p for p in (tmp_path / "manifest").iterdir() if p.suffix == ".json").read_text().splitlines()[0])
    assert list(line) == ["pair_id", "split", "control", "target", "instruction", "meta"] and line["meta"] == GOOD
    pairs.write_dataset(out, str(tmp_path / "dataset"))
    assert spark.read.schema("split string, pair_id string").parquet(str(tmp_path / "dataset")).count() == 0
