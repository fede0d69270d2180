"""The three stages from raw folders to a dataset, each a plan over the operators.

Every stage reads what the one before wrote, replaces what its own earlier run left, and returns a
``StageResult``.  ``parity`` reproduces the plain rules; without it consent must be active and
adulthood attested before an image is read and again before anything leaves, and a person must
have audited a pair before it leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import json as js
from ..operators import media, ordered, validation
from ..session import looked_up, written
from ..sources import pairs

STEMS = ("before", "after")


def _governed(meta: Column) -> dict[str, Column]:
    """What the gates ask for, from the metadata."""
    return {"consent_ref": js.as_text(meta, "consent_ref"), "adult_attested": F.when(js.kind(meta, "adult_attested") == "BOOLEAN", F.try_variant_get(meta, "$.adult_attested", "boolean"))}


def _with_contents(kept: DataFrame, images: DataFrame) -> DataFrame:
    """``kept`` with each stem's content out of ``images`` (label, stem, content)."""
    for s in STEMS:
        kept = kept.join(images.where(F.col("stem") == s).select("label", F.col("content").alias(s)), "label")
    return kept


def ingest(spark: SparkSession, raw: str, staging: str, codec: Callable = media.installed_codec, parity: bool = False, consents: DataFrame | None = None, min_side: int = fixed.MIN_DIMENSION) -> pairs.StageResult:
    """Raw folders to staged pairs: validated, consented, decoded, large enough, new, encoded anew.

    Metadata is parsed once, in a stage of its own, so that no image is read for a pair that fails
    there.  ``rejects`` has label, stage and reason; a pair stops at its first failing image check.
    """
    metas = ordered.empty_input(written(pairs.scan_raw(spark, raw), "ingest-metas"), raw)
    files = pairs.image_files(spark, raw)
    both = pairs.assemble(metas, pairs.scan_images(files), ["clinic", "folder"])
    read = validation.validated(both).withColumns(_governed(F.col("meta"))).withColumn("label", text.label(F.col("clinic"), F.col("folder")))
    read = written(read.select("label", "clinic", "folder", "meta_json", "errors", "accepted", "consent_ref", "adult_attested", *STEMS), "ingest-read")
    sound = read.where("accepted")
    usable = written(ordered.ordered_paths(validation.consent_gate(sound, F.col("consent_ref"), parity, consents, F.col("adult_attested")), "clinic", "folder"), "ingest-usable")
    listed = usable.select("label", F.explode(F.array(*[F.struct(F.lit(s).alias("stem"), F.col(s).alias("path")) for s in STEMS])).alias("x")).select("label", "x.*")
    images = written(media.reencoded(pairs.image_contents(files, written(listed, "ingest-listed")), codec), "ingest-images")
    side = lambda s, *names: images.where(F.col("stem") == s).select("label", *[F.col(n).alias(f"{s}_{n}") for n in names])
    told = usable.select("label", "ord")
    for s in STEMS:
        told = told.join(side(s, "width", "height", "digest", "reason"), "label", "left")
    bad = {}
    for s in STEMS:
        small, said = validation.too_small(s, F.col(f"{s}_width"), F.col(f"{s}_height"), min_side)
        unread = F.when(F.col(f"{s}_digest").isNull(), F.coalesce(f"{s}_reason", F.lit(f"cannot read {s}")))
        bad[s] = F.coalesce(unread, F.when(small, said))
    told = written(told.select("ord", "label", *[bad[s].alias(f"{s}_bad") for s in STEMS], *[F.col(f"{s}_digest").alias(s) for s in STEMS]), "ingest-told")
    judged = ordered.dedupe_greedy(told.withColumns({f"{s}_ok": F.col(f"{s}_bad").isNull() for s in STEMS}))
    duplicate = F.col("duplicate_of")
    reason = F.coalesce("before_bad", F.when(duplicate.startswith("before"), duplicate), "after_bad", duplicate)
    judged = written(judged.select("label", "accepted", reason.alias("reason")), "ingest-judged")
    kept = _with_contents(usable.drop(*STEMS).join(judged.where("accepted").select("label"), "label"), images)
    staged = kept.select("label", "clinic", F.col("folder").alias("pair_id"), "meta_json", *STEMS)
    accepted = pairs.write_stage(staged, staging)
    withheld = sound.join(usable.select("label"), "label", "left_anti").withColumn("reason", F.lit("no active consent of an attested adult"))
    rejects = validation.rejects(read, F.col("label"), "validate", F.when(~F.col("accepted"), validation.joined_errors(F.col("errors"))))
    for stage, rows in (("consent", withheld), ("images", judged)):
        rejects = rejects.unionByName(validation.rejects(rows, F.col("label"), stage, F.col("reason")))
    return pairs.StageResult(accepted, rejects)


def clean(spark: SparkSession, staging: str, out: str, codec: Callable = media.installed_codec, detector: Callable = media.installed_detector, allow_no_face: bool = False, crop_top: float = 0.0) -> pairs.StageResult:
    """Staged pairs with the faces in both images made unrecognisable; a pair goes if either image does."""
    rows = pairs.read_stage(spark, staging)
    images = rows.select("label", F.explode(F.array(*[F.struct(F.lit(s).alias("stem"), F.col(s).alias("content")) for s in STEMS])).alias("x")).select("label", "x.*")
    done = written(media.deidentify(images, codec, detector, allow_no_face, crop_top), "clean-images")
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct((F.col("stem") != STEMS[0]).alias("second"), "reason")))["reason"]
    told = written(done.groupBy("label").agg(first.alias("reason"), *[F.first(F.when(F.col("stem") == s, F.col("faces")), ignorenulls=True).alias(f"{s}_faces") for s in STEMS]), "clean-told")
    kept = rows.drop(*STEMS).join(told.where("reason is null").drop("reason"), "label")
    return pairs.StageResult(pairs.write_stage(_with_contents(kept, done), out), validation.rejects(told, F.col("label"), "deidentify", F.col("reason")))


def dataset(spark: SparkSession, cleaned: str, audits: DataFrame | None = None, parity: bool = False, consents: DataFrame | None = None, seed: int = 42, fraction: float = 0.1) -> pairs.StageResult:
    """Clean pairs that may leave, with consent, audit, split and caption: what the writers of ``sources.pairs`` take.

    ``audits`` has label and audited.  A pair_id that several clinics use would give two pairs one
    file, so none of them leaves.
    """
    rows = pairs.read_stage(spark, cleaned)
    meta = js.parsed(F.col("meta_json"))
    fields = {c: js.as_text(meta, c) for c in ("shape", "profile", "brand")} | {"volume_cc": F.try_variant_get(meta, "$.volume_cc", "long")}
    told = rows.drop(*STEMS).withColumns(_governed(meta) | fields)
    audited = audits.groupBy("label").agg(F.bool_and("audited").alias("audited")) if audits is not None else spark.createDataFrame([], "label string, audited boolean")
    told = written(told.join(audited, "label", "left"), "dataset-rows")  # images stay where they are until a pair is cleared
    shared = pairs.id_collisions(told).select("pair_id")
    ready = written(validation.exportable(told.join(shared, "pair_id", "left_anti"), parity, consents), "dataset-ready")
    captioned = ordered.split_assign(ready, seed=seed, fraction=fraction).withColumn("caption", text.caption(F.col("volume_cc"), F.col("shape"), F.col("profile"), F.col("brand")))
    captioned = written(captioned, "dataset-split")
    accepted = looked_up(rows.select("label", *STEMS), captioned, "label").withColumn("meta", meta)
    why = told.select("label", "pair_id").join(shared.withColumn("twice", F.lit(True)), "pair_id", "left").join(ready.select("label", F.lit(True).alias("ready")), "label", "left")
    reason = F.when(F.col("twice"), "pair_id stands in several clinics").when(F.col("ready").isNull(), "not cleared for export")
    return pairs.StageResult(accepted, validation.rejects(why, F.col("label"), "export", reason))


def export(spark: SparkSession, cleaned: str, out: str, **options) -> pairs.StageResult:
    """``dataset`` written as files under ``out``, with one manifest folder beside them; every writer asks the gate again."""
    result = dataset(spark, cleaned, **options)
    gate = {k: options[k] for k in ("parity", "consents") if k in options}
    pairs.write_files(result.accepted, out, **gate)
    pairs.write_manifest(result.accepted, f"{out}/manifest.jsonl", **gate)
    return result
