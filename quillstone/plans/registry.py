"""One query for each operator or group of operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import lookup, ordered, requests, validation
from ..session import written
from ..sources import pairs
from . import fixtures, flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validated(fixtures.metadata_json(fixtures.meta(spark, sf_dir)).select("k", "clinic", "folder", "before", "after", "meta_json"))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata behind the consent gate that passes every rule, as typed columns.

    Staged with its outcome: a filter on ``accepted`` itself would carry every rule, and with it a
    parse of the text for every field, into the filter and into each use of the rows.
    """
    meta = validation.consent_gate(fixtures.meta(spark, sf_dir), F.col("consent_ref"), parity=True)
    checked = validation.validated(fixtures.metadata_json(meta))
    return written(checked.select("pair_id", "shape", "profile", "brand", "volume_cc", "consent_ref", "accepted"), "accepted").where("accepted")


@query
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("k", validation.joined_errors(F.col("errors")).alias("errors"), F.size("errors").cast("long").alias("n_errors"), "accepted")


@query
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    meta = fixtures.meta(spark, sf_dir).withColumn("clothing", fixtures.pick(k, "nude", "bra", "top", "coat")).withColumn("months_post_op", k % 9 - 1)
    rows = validation.validated(fixtures.metadata_json(meta), strict_schema=True)
    return rows.select("k", validation.joined_errors(F.col("errors")).alias("errors"))


@query
def accept_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.outcome_counts(_validated(spark, sf_dir), F.col("accepted"))


@query
def consent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.consent_gate(fixtures.meta(spark, sf_dir), F.col("consent_ref"), parity=True).select("k", "consent_ref")


@query
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.boxes(spark, sf_dir)
    reason = validation.first_reason(validation.too_small("before", F.col("width"), F.col("height")), validation.too_small("after", F.col("height"), F.col("w") * 10), (F.col("faces") == 3, F.lit("after is a duplicate")))
    label = text.label(F.col("k").cast("string"), F.col("n").cast("string"))
    return validation.rejects(rows, label, "ingest", reason)


@query
def reject_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_reasons(spark, sf_dir).groupBy("stage", F.substring_index("reason", " ", 1).alias("stem")).agg(F.count("*").alias("n"))


@query
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.meta(spark, sf_dir).select("k", text.caption(F.col("volume_cc"), F.col("shape"), F.col("profile"), F.col("brand")).alias("caption"))


@query
def edit_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.meta(spark, sf_dir).select("k", text.edit_prompt(F.col("volume_cc"), F.col("shape"), F.col("profile"), F.col("brand")).alias("prompt"))


@query
def volume_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc = F.col("volume_cc")
    return fixtures.meta(spark, sf_dir).select("k", text.size_phrase(cc).alias("phrase"), text.size_label(cc).alias("label"), text.clamp(cc).cast("long").alias("clamped"))


@query
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.meta(spark, sf_dir).select("k", "brand", "profile", "shape")
    for dimension, code in ((lookup.brands, "brand"), (lookup.profiles, "profile"), (lookup.shapes, "shape")):
        rows = lookup.look_up(rows, dimension(spark), F.col(code), f"found_{code}")
    return rows.select("k", "found_brand_name", "found_brand_manufacturer", "found_brand_fill", "found_brand_blurb", "found_profile_name", "found_profile_blurb", "found_shape_name", "found_shape_blurb")


@query
def catalog_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.known(fixtures.meta(spark, sf_dir), lookup.brands(spark), F.col("brand"), keep=False).select("k", "brand")


@query
def catalog_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.highlights(lookup.brands(spark)).select("brand_id", F.col("position").cast("long").alias("position"), "highlight")


@query
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.split_assign(fixtures.meta(spark, sf_dir).select("pair_id")).select("pair_id", "split")


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.split_counts(split_assign(spark, sf_dir))


@query
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.exportable(ordered.split_assign(_accepted(spark, sf_dir)), parity=True)
    captioned = rows.withColumn("caption", text.caption(F.col("volume_cc"), F.col("shape"), F.col("profile"), F.col("brand")))
    return pairs.manifest(captioned.withColumn("meta", F.lit(None))).drop("meta")


@query
def pixel_hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", ordered.digest(F.col("text")).alias("digest"))


@query
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.dedupe_greedy(fixtures.digest_pairs(spark, sf_dir)).select("ord", "accepted")


@query
def pair_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    files = fixtures.table(spark, sf_dir, "documents").select(F.floor(d / 2).alias("folder"), F.when(d % 2 == 0, "before").otherwise("after").alias("stem"), F.when(d % 13 != 0, d.cast("string")).alias("path"))
    metas = fixtures.table(spark, sf_dir, "documents").select(F.floor(d / 2).alias("folder")).distinct()
    errors = validation.joined_errors(F.array_compact(F.array(*validation.missing_images(F.col("before"), F.col("after")))))
    return pairs.assemble(metas, files, ["folder"]).select("folder", "before", "after", errors.alias("errors"))


@query
def best_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    files = fixtures.table(spark, sf_dir, "pages").select(F.floor(p / 3).alias("folder"), fixtures.pick(p * 7 + F.floor(p / 5), "webp", "png", "JPG", "jpeg", "jpg").alias("extension"))
    return pairs.best_extension(files.withColumn("path", F.concat(F.lit("before."), F.col("extension"))), ["folder"]).select("folder", "path")


@query
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.meta(spark, sf_dir).select("clinic", "folder", "k")
    return ordered.ordered_paths(rows, "clinic", "folder").select("k", F.col("ord").cast("long").alias("ord"))


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.rate_limit(fixtures.hits(spark, sf_dir), limit=8, window=7200)


@query
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    user = F.col("user_id").cast("string")
    header = F.when(e % 6 == 0, F.lit(None)).when(e % 6 == 1, F.lit(" , 10.0.0.1")).when(e % 6 == 2, F.concat(F.lit("  "), user, F.lit(" ,x"))).when(e % 6 == 3, F.concat(F.lit("\u00a0\t"), user, F.lit("\ufeff"))).otherwise(user)
    return fixtures.table(spark, sf_dir, "events").select("event_id", text.client_key(header).alias("client"))


@query
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.latest_wins(fixtures.table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query
def can_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", ordered.can_generate(F.col("turn") % 2 == 0, F.col("conv_id") % 3 != 0, F.col("turn") % 5 == 0).alias("enabled"))


@query
def closest_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.boxes(spark, sf_dir).select("k", "n", geometry.closest_aspect(F.col("width"), F.col("height")).alias("aspect"))


@query
def scale_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = geometry.scaled(F.col("width"), F.col("height"))
    return fixtures.boxes(spark, sf_dir).select("k", "n", width.alias("width"), height.alias("height"), geometry.large_enough(F.col("width"), F.col("height")).alias("large"))


@query
def bbox_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.expanded_box(*map(F.col, ("x", "y", "w", "h", "width", "height")))
    return fixtures.boxes(spark, sf_dir).select("k", "n", box.alias("b")).select("k", "n", "b.x0", "b.y0", "b.x1", "b.y1")


@query
def crop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, kept = geometry.cropped_rows(F.col("height"), 0.2)
    return fixtures.boxes(spark, sf_dir).select("k", "n", first.alias("first"), kept.alias("kept"))


@query
def noface_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces, allow, crop = map(F.col, ("faces", "allow", "crop"))
    return fixtures.boxes(spark, sf_dir).select("k", "n", validation.no_face_rejected(faces, allow, crop, parity=True).alias("parity"), validation.no_face_rejected(faces, allow, crop).alias("strict"))


@query
def guard_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.guarded(fixtures.requests(spark, sf_dir), F.col("limited"))
    return rows.select("k", F.col("response.status").cast("long").alias("status"), F.col("response.demo").alias("demo"), F.col("response.image").alias("image"), F.coalesce("response.error", "response.message").alias("said"))


@query
def response_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = requests.mapped_response(F.col("response"), F.col("http_status"), F.col("network_error"))
    rows = fixtures.responses(spark, sf_dir).withColumn("answer", answer)
    return rows.select("conv_id", F.col("answer.status").cast("long").alias("status"), "answer.error", "answer.image", F.col("answer.mimeType").alias("mime"))


@query
def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = requests.provider_request(F.lit("prompt"), F.lit("image/png"), F.col("k").cast("string"), F.when(F.col("k") % 3 != 0, F.col("width")), F.col("height"))
    return fixtures.boxes(spark, sf_dir).select("k", "n", body.alias("body"))


@query
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    mime = fixtures.pick(k, "image/jpeg", "image/png", "image/webp", "image/gif")
    return fixtures.boxes(spark, sf_dir).select("k", "n", requests.file_error(mime, F.col("width") * F.col("height") * 4).alias("error"))


@query
def download_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = fixtures.pick(F.col("k"), "image/jpeg", "image/png", "image/webp", "image/gif")
    return fixtures.meta(spark, sf_dir).select("k", text.download_name(F.col("brand"), F.col("shape"), F.col("volume_cc"), mime).alias("name"), text.data_url(mime, F.col("k").cast("string")).alias("url"))


@query
def provider_error_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", text.error_detail(F.col("text")).alias("detail"), text.data_url_payload(F.col("text")).alias("payload"))


@query
def expired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fixtures.hits(spark, sf_dir).select((F.col("id") % 997).alias("key"), "t")
    now = hits.agg(F.max("t")).first()[0]
    return ordered.expired_keys(ordered.limiter_state(hits), now, 86_400)


@query
def consent_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.consent_gate(fixtures.governed(spark, sf_dir), F.col("consent_ref"), consents=fixtures.consents(spark, sf_dir), adult=F.col("adult_attested")).select("k", "consent_ref")


@query
def content_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    header = fixtures.pick(e, "2048", "0x10", "2048d", " 12 ", "", "1e3", "0b101", "12500001", "0xFFFFFFFFFFFFFFFFFF", ".5", "-3", "Infinity", "0x")
    return fixtures.table(spark, sf_dir, "events").select("event_id", requests.content_length_ok(F.when(e % 14 != 13, header)).alias("ok"))


@query
def provider_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.guarded(fixtures.requests(spark, sf_dir), F.col("limited"), demo=False)
    answer = requests.answered(rows, fixtures.provided(spark, sf_dir), "k")
    return answer.select("k", F.col("response.status").cast("long").alias("status"), "response.demo", "response.error", "response.image", F.col("response.mimeType").alias("mime"))


@query
def provider_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.guarded(fixtures.requests(spark, sf_dir), F.col("limited"), demo=False)
    return requests.provider_requests(rows, F.lit("prompt"), "k").select("k", F.col("provider_body").alias("body"))


@query
def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.guarded(fixtures.requests(spark, sf_dir), F.col("limited"))
    return rows.select("k", requests.response_json(F.col("response")).alias("body"))


@query
def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = pairs.decode_images(spark, fixtures.png_folder(spark, sf_dir))
    good = pairs.decodable(F.col("image"))
    key = F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long")
    return images.select(key.alias("k"), good.alias("decodable"), F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"), F.when(good, ordered.image_digest(F.col("image"))).alias("digest"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[pairs.StageResult, str]:
    raw = fixtures.raw_folders(spark, sf_dir)
    staging = raw.replace("/raw-", "/staging-")
    return flows.ingest(spark, raw, staging, fixtures.pixmap_codec, consents=fixtures.consents(spark, sf_dir), min_side=9), staging


@query
def ingest_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = _ingested(spark, sf_dir)
    none = F.lit(None).cast("string")
    return result.accepted.select("label", none.alias("stage"), none.alias("reason")).unionByName(result.rejects)


def _cleaned(spark: SparkSession, sf_dir: str) -> tuple[pairs.StageResult, str]:
    _, staging = _ingested(spark, sf_dir)
    out = staging.replace("/staging-", "/clean-")
    return flows.clean(spark, staging, out, fixtures.pixmap_codec, fixtures.red_detector), out


@query
def clean_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = _cleaned(spark, sf_dir)
    faces = (F.size("before_faces") + F.size("after_faces")).cast("long")
    return result.accepted.select("label", faces.alias("faces"), F.lit(None).cast("string").alias("reason")).unionByName(result.rejects.select("label", F.lit(0).cast("long").alias("faces"), "reason"))


@query
def export_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cleaned = _cleaned(spark, sf_dir)
    out = cleaned.replace("/clean-", "/dataset-")
    meta = fixtures.meta(spark, sf_dir)
    audits = meta.select(F.concat_ws("/", "clinic", "folder").alias("label"), (F.col("k") % 3 != 0).alias("audited"))
    flows.export(spark, cleaned, out, audits=audits, consents=fixtures.consents(spark, sf_dir))
    return spark.read.schema("pair_id string, split string, control string, target string, instruction string").json(f"{out}/manifest.jsonl")
