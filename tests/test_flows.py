"""Raw folders to a dataset: governance, image checks, de-identification, files, and the command line."""

import hashlib
import json
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import __main__ as shell
from quillstone.functions import json as js
from quillstone.operators import media, ordered, requests, validation
from quillstone.plans import fixtures, flows, registry
from quillstone.sources import pairs

GOOD = {"shape": "round", "volume_cc": 350, "view": "front", "profile": "high", "adult_attested": True}


def raw(root, clinic, pair, before, after, **meta):
    folder = root / clinic / pair
    folder.mkdir(parents=True)
    (folder / "meta.json").write_text(json.dumps(GOOD | {"pair_id": pair, "consent_ref": f"ref-{pair}"} | meta))
    for name, content in (("before.jpg", before), ("after.png", after)):
        if content is not None:
            (folder / name).write_bytes(content)


def picture(shade, size=10, face=True):
    return fixtures.raw_image(size, size, shade, face)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flows")
    raw(root / "raw", "c1", "p1", picture(1), picture(2))
    raw(root / "raw", "c1", "p2", picture(3), picture(1))  # after is p1's before
    raw(root / "raw", "c1", "p3", picture(4), picture(4))  # its own duplicate
    raw(root / "raw", "c1", "p4", picture(5, 8), picture(6))  # too small
    raw(root / "raw", "c1", "p5", b"junk", picture(7))
    raw(root / "raw", "c1", "p6", picture(8), picture(9), consent_ref="revoked")
    raw(root / "raw", "c1", "p7", picture(10), picture(11), adult_attested=False)
    raw(root / "raw", "c1", "p8", picture(12), None)
    raw(root / "raw", "c1", "p9", picture(3), picture(13))  # p2 registered its before, though it failed
    raw(root / "raw", "c2", "p1", picture(14), picture(15))  # one pair_id in two clinics
    raw(root / "raw", "c2", "q1", picture(16), picture(17, face=False))
    raw(root / "raw", "c2", "q2", picture(18), picture(19), consent_ref=" ")
    raw(root / "raw", "c2", "q3", picture(20), picture(21))
    raw(root / "raw", "c2", "q4", picture(22), picture(23))
    return root


@pytest.fixture(scope="module")
def consents(spark):
    named = [(f"ref-{p}", False) for p in ("p1", "p2", "p3", "p4", "p5", "p7", "p8", "p9", "q1", "q3", "q4")]
    return spark.createDataFrame([*named, ("revoked", True)], "consent_ref string, revoked boolean")


@pytest.fixture(scope="module")
def ingested(spark, folders, consents):
    return flows.ingest(spark, str(folders / "raw"), str(folders / "staging"), fixtures.pixmap_codec, consents=consents, min_side=9)


@pytest.fixture(scope="module")
def cleaned(spark, folders, ingested):
    return flows.clean(spark, str(folders / "staging"), str(folders / "clean"), fixtures.pixmap_codec, fixtures.red_detector)


def test_ingest(ingested):
    assert {r["label"]: (r["stage"], r["reason"]) for r in ingested.rejects.collect()} == {
        "c1/p2": ("images", "after is a duplicate of c1/p1/before"),
        "c1/p3": ("images", "after is a duplicate of c1/p3/before"),
        "c1/p4": ("images", "before image too small (8x8)"),
        "c1/p5": ("images", "cannot read before"),
        "c1/p6": ("consent", "no active consent of an attested adult"),
        "c1/p7": ("consent", "no active consent of an attested adult"),
        "c1/p8": ("validate", "no after.(jpg|png|webp) image"),
        "c1/p9": ("images", "before is a duplicate of c1/p2/before"),
        "c2/q2": ("consent", "no active consent of an attested adult"),
    }
    rows = {r["label"]: r for r in ingested.accepted.collect()}
    assert sorted(rows) == ["c1/p1", "c2/p1", "c2/q1", "c2/q3", "c2/q4"] and ingested.ok
    assert rows["c1/p1"]["before"] == picture(1) and json.loads(rows["c1/p1"]["meta_json"])["pair_id"] == "p1"


def test_parity_takes_any_consent_reference(spark, folders):
    result = flows.ingest(spark, str(folders / "raw"), str(folders / "plain"), fixtures.pixmap_codec, parity=True, min_side=9)
    assert {"c1/p6", "c1/p7", "c2/q2"} <= {r["label"] for r in result.accepted.collect()}


def test_without_codec_nothing_passes(spark, folders):
    result = flows.ingest(spark, str(folders / "raw"), str(folders / "none"), lambda: None, parity=True)
    assert not result.ok and "no image codec is installed" in {r["reason"] for r in result.rejects.collect()}


def test_clean_rejects_the_pair(cleaned):
    assert [(r["label"], r["reason"]) for r in cleaned.rejects.collect()] == [("c2/q1", "no face detected in after")]
    row = cleaned.accepted.where("label = 'c1/p1'").first()
    assert row["before"] != picture(1) and b"\xff\0\0" not in bytes(row["before"]) and len(row["before_faces"]) == 1


def test_export(spark, folders, cleaned, consents):
    audits = spark.createDataFrame([("c1/p1", True), ("c2/p1", True), ("c2/q3", True), ("c2/q4", False)], "label string, audited boolean")
    result = flows.export(spark, str(folders / "clean"), str(folders / "dataset"), audits=audits, consents=consents)
    assert [r["label"] for r in result.accepted.collect()] == ["c2/q3"]
    why = {r["label"]: r["reason"] for r in result.rejects.collect()}
    assert why == {"c1/p1": "pair_id stands in several clinics", "c2/p1": "pair_id stands in several clinics", "c2/q4": "not cleared for export"}
    files = {str(p.relative_to(folders / "dataset")) for p in (folders / "dataset/train").rglob("*") if p.is_file()}
    assert files == {"train/control/q3.jpg", "train/target/q3.jpg", "train/target/q3.txt"}
    caption = (folders / "dataset/train/target/q3.txt").read_text()
    lines = [json.loads(x) for p in (folders / "dataset/manifest.jsonl").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["control"] == "train/control/q3.jpg" and lines[0]["instruction"] + "\n" == caption
    assert lines[0]["meta"]["consent_ref"] == "ref-q3" and caption.startswith("Edit this photo")
    withdrawn = consents.withColumn("revoked", F.lit(True))
    assert not flows.dataset(spark, str(folders / "clean"), audits, consents=withdrawn).ok
    assert not flows.dataset(spark, str(folders / "clean"), None, consents=consents).ok


def test_every_writer_asks_the_gate(spark, tmp_path):
    row = {"pair_id": "p", "split": "val", "caption": "c", "meta": 1, "before": bytearray(b"b"), "after": bytearray(b"a"), "consent_ref": "r", "adult_attested": True, "audited": True}
    for missing, left in ((None, 1), ("consent_ref", 0), ("adult_attested", 0), ("audited", 0)):
        rows = spark.createDataFrame([row])
        rows = rows.drop(missing) if missing else rows
        assert pairs.write_files(rows, str(tmp_path / "files")) == left
        pairs.write_manifest(rows, str(tmp_path / "lines"), single=True)
        pairs.write_dataset(rows, str(tmp_path / "table"))
        assert spark.read.text(str(tmp_path / "lines")).count() == left
        assert spark.read.schema("split string, pair_id string").parquet(str(tmp_path / "table")).count() == left


def test_shell(spark, folders, capsys):
    args = shell.parser().parse_args(["export", "a", "b"])
    assert (args.val_fraction, args.seed, args.parity) == (0.1, 42, False)
    assert shell.main(["ingest", str(folders / "raw"), str(folders / "by-shell"), "--parity"]) == 1  # no codec here, or no image large enough
    said = capsys.readouterr().out
    assert "0 accepted" in said and "REJECT c1/p8: no after.(jpg|png|webp) image" in said
    (folders / "nothing").mkdir()
    assert shell.main(["clean", str(folders / "by-shell"), str(folders / "out")]) == 1


def test_pictures_are_digested_red_first(spark, tmp_path):
    line = b"\0" + bytes([10, 20, 30, 40, 50, 60])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(line)) + chunk(b"IEND", b""))
    (tmp_path / "b.png").write_bytes(b"junk")
    images = pairs.decode_images(spark, str(tmp_path)).withColumn("digest", ordered.image_digest(F.col("image")))
    found = {r["path"][-5]: (r["ok"], r["digest"]) for r in images.select("path", "digest", pairs.decodable(F.col("image")).alias("ok")).collect()}
    assert found["a"] == (True, hashlib.sha256(bytes([10, 20, 30, 40, 50, 60])).hexdigest()) and not found["b"][0]


def test_reduced_interpolates_between_pixels():
    ramp = np.repeat(np.arange(16.0)[None, :, None], 16, axis=0)
    assert (media._reduced(ramp, 8)[0, :, 0] == np.rint(np.arange(8) * 2 + 0.5)).all()
    assert media._reduced(np.full((1, 1, 3), 9.0), 8).shape == (8, 8, 3)


def test_manifest_parses_each_text_once(spark):
    seen = []
    real = validation.validated

    def watched(*args, **options):
        out = real(*args, **options)
        seen.append(out)
        return out

    validation.validated = watched
    try:
        plan = registry.manifest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        validation.validated = real
    parses = lambda text: len(re.findall("(?i)parse_?json", text))
    assert parses(plan) == 0  # staged before
    assert parses(seen[0].select("errors", "accepted")._jdf.queryExecution().optimizedPlan().toString()) == 1


def test_numbers_of_headers(spark):
    texts = {"2048": 2048, "0x10": 16, "0b101": 5, "0o17": 15, "2048d": None, "2048f": None, "\u00a012\ufeff": 12, "": 0, "1e3": 1000, ".5": 0.5, "5.": 5, "-3": -3, "Infinity": None, "0x": None, "0x" + "F" * 30: 1e300, "1 2": None, "+7": 7}
    df = spark.createDataFrame([(t, None if n is None else float(n)) for t, n in texts.items()], "t string, n double")
    wrong = df.where(~requests.number_of(F.col("t")).eqNullSafe(F.col("n"))).collect()
    assert not wrong


def test_text_is_shown_between_quotes(spark):
    values = ["plain", "it's", 'say "it\'s"', "a\\b", "two\nlines", True, False, None, 350.5, 7]
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(values)], "i int, j string")
    shown = [r[0] for r in df.orderBy("i").select(js.literal(F.try_parse_json("j"), "v")).collect()]
    assert shown == [repr(v) for v in values]


def test_split_of_many_keys_takes_the_first_in_order(spark):
    n = 30_000
    df = spark.range(n).select(F.format_string("p%d", "id").alias("pair_id"))
    ranked = sorted((hashlib.md5(f"42:p{i}".encode()).hexdigest(), f"p{i}") for i in range(n))
    val = {r["pair_id"] for r in ordered.split_assign(df.union(df.limit(50))).where("split = 'val'").collect()}
    assert val == {k for _, k in ranked[: n // 10]}


def test_long_stretches_are_judged_in_batches(spark):
    from tests.test_operators import limit_model

    rows = [("busy", 700 * i, i) for i in range(25_000)] + [("slow", 61_000 * i, 50_000 + i) for i in range(50)]
    found = {r["id"]: r["blocked"] for r in ordered.rate_limit(spark.createDataFrame(rows, "key string, t long, id long")).collect()}
    assert found == limit_model(rows)
