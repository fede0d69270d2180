"""Many small files: few tasks, and nothing lost on odd names and empty files."""

import json

import pytest

from quillstone.plans import fixtures, flows
from quillstone.sources import pairs

GOOD = {"shape": "round", "volume_cc": 350, "view": "front", "consent_ref": "r", "adult_attested": True}


def tasks(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    return sum(told.getStageInfo(s).numTasks for s in stages)


def folder(root, clinic, pair, shade):
    at = root / clinic / pair
    at.mkdir(parents=True)
    (at / "meta.json").write_text(json.dumps(GOOD | {"pair_id": pair}))
    (at / "before.jpg").write_bytes(fixtures.raw_image(10, 10, shade, True))
    (at / "after.png").write_bytes(fixtures.raw_image(10, 10, shade + 1, True))


def test_tasks_do_not_grow_with_folders(spark, tmp_path):
    for i in range(200):
        folder(tmp_path, f"c{i % 2}", f"p{i}", 2)
    scan = lambda: (pairs.scan_raw(spark, str(tmp_path)).collect(), pairs.image_files(spark, str(tmp_path)).select("path").collect())
    assert tasks(spark, "folders", scan) < 100


def test_odd_names_and_empty_files(spark, tmp_path):
    folder(tmp_path / "raw", "clinic 1", "pär 100%", 2)
    folder(tmp_path / "raw", "c", "cut", 4)
    (tmp_path / "raw/c/cut/meta.json").write_bytes(b"")
    folder(tmp_path / "raw", "c", "blank", 6)
    (tmp_path / "raw/c/blank/before.jpg").write_bytes(b"")
    (tmp_path / "raw/c/no-meta").mkdir()
    (tmp_path / "raw/stray").write_bytes(b"x")
    result = flows.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "staging"), fixtures.pixmap_codec, parity=True, min_side=9)
    assert [r["label"] for r in result.accepted.collect()] == ["clinic 1/pär 100%"]
    assert {r["label"]: r["reason"] for r in result.rejects.collect()} == {"c/cut": "meta.json is not valid JSON", "c/blank": "cannot read before"}


def test_nothing_there(spark, tmp_path):
    for root in (tmp_path, tmp_path / "missing"):
        with pytest.raises(ValueError, match="no pairs found"):
            flows.ingest(spark, str(root), str(tmp_path / "out"), fixtures.pixmap_codec)


def test_both_ways_of_reading_agree(spark, tmp_path, monkeypatch):
    for i in range(5):
        folder(tmp_path, "c", f"p{i}", 2 * i)

    def read():
        files = pairs.image_files(spark, str(tmp_path))
        images = pairs.scan_images(files)
        metas = pairs.scan_raw(spark, str(tmp_path)).collect()
        found = [(r["clinic"], r["folder"], r["stem"], r["extension"], bytes(r["content"])) for r in pairs.image_contents(files, images).collect()]
        return sorted(map(tuple, metas)), sorted(found)

    direct = read()
    monkeypatch.setattr(pairs, "local_folder", lambda *_: None)
    assert read() == direct and len(direct[1]) == 10
