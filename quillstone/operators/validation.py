"""Rules over pair metadata: all errors of a record in order, and the gates.

``parity`` reproduces the plain rules.  Without it the consent gate asks for a reference that is
not blank and, if a table of consents is given, active in it; whether adulthood is attested is
asked as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, geometry
from ..functions import json as js


def metadata_errors(meta: Column, folder: Column) -> list[Column]:
    """One message or null for each rule, in the order in which they are reported."""
    text = lambda name: js.as_text(meta, name)
    given = lambda name: ~js.falsy(meta, name)
    shown = lambda name: F.coalesce(text(name), js.literal(meta, name))
    outside = lambda name, domain: given(name) & ~F.coalesce(text(name).isin(*domain), F.lit(False))
    missing = [F.when(js.falsy(meta, name), F.lit(f"missing required field '{name}'")) for name in fixed.REQUIRED_FIELDS]
    volume = F.try_variant_get(meta, "$.volume_cc", "long")
    whole = (js.kind(meta, "volume_cc") == "BIGINT") & volume.between(*fixed.INGEST_VOLUME)
    there = js.kind(meta, "volume_cc").isNotNull() & (js.kind(meta, "volume_cc") != "VOID")
    low, high = fixed.INGEST_VOLUME
    return [
        *missing,
        F.when(outside("shape", fixed.SHAPES), F.concat(F.lit("invalid shape '"), shown("shape"), F.lit("'"))),
        F.when(outside("view", fixed.VIEWS), F.concat(F.lit("invalid view '"), shown("view"), F.lit("'"))),
        F.when(there & ~F.coalesce(whole, F.lit(False)), F.concat(F.lit(f"volume_cc must be an integer between {low} and {high}, got "), js.literal(meta, "volume_cc"))),
        F.when(given("pair_id") & ~F.coalesce(text("pair_id") == folder, F.lit(False)), F.concat(F.lit("pair_id '"), shown("pair_id"), F.lit("' does not match folder name '"), folder, F.lit("'"))),
    ]


def schema_errors(meta: Column) -> list[Column]:
    """Further rules of the metadata contract that ingest itself doesn't ask for."""
    text = lambda name: js.as_text(meta, name)
    there = lambda name: js.kind(meta, name).isNotNull()
    domains = {"brand": fixed.BRAND_CODES, "profile": fixed.PROFILE_CODES, "clothing": fixed.CLOTHING}
    out = [F.when(there(n) & ~F.coalesce(text(n).isin(*d), F.lit(False)), F.lit(f"{n} is not in its domain")) for n, d in domains.items()]
    months = F.try_variant_get(meta, "$.months_post_op", "double")
    kind = js.kind(meta, "months_post_op")
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    out.append(F.when(there("months_post_op") & ~F.coalesce(number & (months >= 0), F.lit(False)), F.lit("months_post_op must be a number of at least 0")))
    out.append(F.when(there("notes") & (js.kind(meta, "notes") != "STRING"), F.lit("notes must be text")))
    return out


def missing_images(before: Column, after: Column) -> list[Column]:
    return [F.when(path.isNull(), F.lit(f"no {stem}.(jpg|png|webp) image")) for stem, path in (("before", before), ("after", after))]


def validated(pairs: DataFrame, strict_schema: bool = False) -> DataFrame:
    """``pairs`` (meta_json, folder, before, after) with meta (VARIANT), errors (in order) and accepted."""
    rows = pairs.withColumn("meta", js.parsed(F.col("meta_json")))
    meta = F.col("meta")
    readable = js.is_object(meta)
    rules = metadata_errors(meta, F.col("folder")) + (schema_errors(meta) if strict_schema else []) + missing_images(F.col("before"), F.col("after"))
    errors = F.when(meta.isNull(), F.array(F.lit("meta.json is not valid JSON"))).when(~readable, F.array(F.lit("meta.json is not an object"))).otherwise(F.array_compact(F.array(*rules)))
    return rows.withColumn("errors", errors).withColumn("accepted", F.size("errors") == 0)


def joined_errors(errors: Column) -> Column:
    return F.concat_ws("; ", errors)


def consent_gate(rows: DataFrame, consent: Column, parity: bool = False, consents: DataFrame | None = None, adult: Column | None = None) -> DataFrame:
    """Rows that may be used at all; run first and, by ``exportable``, once more in every writer of a dataset.

    ``consents`` has consent_ref and revoked.  Strict mode fails closed: without an ``adult``
    attestation column nothing passes.
    """
    if parity:
        return rows.where(consent.isNotNull() & (consent != ""))
    kept = rows.where(F.trim(consent) != "").where(F.coalesce(adult, F.lit(False)) if adult is not None else F.lit(False))
    if consents is not None:
        active = consents.where(~F.coalesce("revoked", F.lit(True))).select(F.trim("consent_ref").alias("__ref")).distinct()
        kept = kept.withColumn("__own", F.trim(consent)).join(active, F.col("__own") == F.col("__ref"), "left_semi").drop("__own")
    return kept


def exportable(rows: DataFrame, parity: bool = False, consents: DataFrame | None = None, consent: str = "consent_ref", adult: str = "adult_attested", audited: str = "audited") -> DataFrame:
    """The rows that may leave: behind the consent gate again and, unless ``parity``, audited by a person.

    Strict mode fails closed: rows without one of the columns don't leave.
    """
    given = lambda name: F.col(name) if name in rows.columns else F.lit(None)
    kept = consent_gate(rows, given(consent).cast("string"), parity, consents, given(adult).cast("boolean"))
    return kept if parity else kept.where(F.coalesce(given(audited).cast("boolean"), F.lit(False)))


def first_reason(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first failing check, as ingest stops there; null if none fails."""
    return F.coalesce(*[F.when(failed, said if isinstance(said, Column) else F.lit(said)) for failed, said in checks])


def too_small(stem: str, width: Column, height: Column, least: int = fixed.MIN_DIMENSION) -> tuple[Column, Column]:
    return ~geometry.large_enough(width, height, least), F.concat(F.lit(f"{stem} image too small ("), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(")"))


def no_face_rejected(faces: Column, allow_no_face: Column | bool, crop_top: Column | float, parity: bool = False) -> Column:
    """No face found and no leave to go without; under parity a crop is such leave as well."""
    allowed = allow_no_face if isinstance(allow_no_face, Column) else F.lit(allow_no_face)
    if parity:
        allowed = allowed | ((crop_top if isinstance(crop_top, Column) else F.lit(crop_top)) != 0)
    return (faces == 0) & ~allowed


def outcome_counts(rows: DataFrame, accepted: Column) -> DataFrame:
    return rows.agg(F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))


def rejects(rows: DataFrame, label: Column, stage: str, reason: Column) -> DataFrame:
    """The log of a stage: label, stage, reason of every rejected row."""
    return rows.where(reason.isNotNull()).select(label.alias("label"), F.lit(stage).alias("stage"), reason.alias("reason"))
