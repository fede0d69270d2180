"""Request guards, provider requests and the mapping of provider responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, geometry, text
from ..functions import json as js
from ..session import written

#: The provider's response as far as it is read.
RESPONSE = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,inlineData:struct<mimeType:string,data:string>>>>,finishReason:string>>,promptFeedback:struct<blockReason:string>>"


def _answer(status: int, said: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(fixed.SAYS[said]).alias("error"))


def number_of(header: Column) -> Column:
    """What a header's text is as a number: decimal, or whole in base 16, 8 or 2; 0 if blank, null if it is none."""
    bare = text.trimmed(header)
    decimal = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    based = F.lit(None).cast("double")
    for prefix, digits, base in (("x", "0-9a-fA-F", 16), ("o", "0-7", 8), ("b", "01", 2)):
        own = F.regexp_replace(F.substring(bare, 3, F.length(bare)), "^0+", "")
        # what 52 bits don't hold is beyond any limit
        value = F.when(F.length(own) > 52 // (base.bit_length() - 1), 1e300).otherwise(F.coalesce(F.conv(own, base, 10).cast("double"), F.lit(0.0)))
        based = F.when(bare.rlike(f"^0[{prefix}{prefix.upper()}][{digits}]+$"), value).otherwise(based)
    return F.when(bare == "", 0.0).when(decimal, bare.try_cast("double")).otherwise(based)


def content_length_ok(header: Column) -> Column:
    """A finite number above 0 and within the limit; a missing header counts as 0."""
    number = number_of(F.coalesce(header, F.lit("")))
    return F.coalesce((number > 0) & (number <= fixed.MAX_BODY_BYTES), F.lit(False))


def config_ok(brand: Column, shape: Column, profile: Column, volume: Column) -> Column:
    """All three codes are in the catalogue and the volume is a number within the preview's range."""
    codes = brand.isin(*fixed.BRAND_WORDS) & shape.isin(*fixed.SHAPE_WORDS) & profile.isin(*fixed.PROFILE_WORDS)
    return F.coalesce(codes & volume.between(*fixed.PREVIEW_VOLUME), F.lit(False))


def guard(limited: Column, length_ok: Column, json_ok: Column, image: Column, image_length: Column, mime: Column, config: Column, consent: Column | None = None) -> Column:
    """(status, error) of the first guard that a request fails; null if it passes.

    ``image`` tells whether there is a photo, ``image_length`` how long its base64 is.  With
    ``consent`` the strict model also asks for a consent in the request itself.
    """
    checks = F.when(limited, _answer(429, "rate")).when(~length_ok, _answer(413, "large")).when(~json_ok, _answer(400, "json"))
    checks = checks.when(~F.coalesce(image, F.lit(False)) | F.coalesce(image_length == 0, F.lit(True)), _answer(400, "photo")).when(image_length > fixed.MAX_BASE64, _answer(413, "large"))
    checks = checks.when(~F.coalesce(mime.isin(*fixed.MIME_TYPES), F.lit(False)), _answer(400, "mime")).when(~F.coalesce(config, F.lit(False)), _answer(400, "config"))
    if consent is not None:
        checks = checks.when(~F.coalesce(consent, F.lit(False)), F.struct(F.lit(400).alias("status"), F.lit("Consent is missing.").alias("error")))
    return checks


def guarded(requests: DataFrame, limited: Column, demo: bool = True, strict: bool = False) -> DataFrame:
    """``requests`` (body: JSON text, content_length) with response: the failed guard's, or the demo's."""
    # the parse, the length and the verdict are columns of their own, as each is looked at many times
    rows = requests.withColumn("__v", js.parsed(F.col("body"))).withColumn("__length_ok", content_length_ok(F.col("content_length")))
    v = F.col("__v")
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    texted = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "STRING", get(path, "string"))
    of_volume = F.schema_of_variant(get("config.volumeCc", "variant"))
    volume = F.when(of_volume.startswith("BIGINT") | of_volume.startswith("DECIMAL") | of_volume.startswith("DOUBLE"), get("config.volumeCc", "double"))
    image = texted("image")
    config = config_ok(texted("config.brandId"), texted("config.shape"), texted("config.profileId"), volume)
    verdict = guard(limited, F.col("__length_ok"), v.isNotNull(), image.isNotNull(), F.length(image), texted("mimeType"), config, get("consent", "boolean") if strict else None)
    rows = rows.withColumn("__image", image).withColumn("__mime", texted("mimeType")).withColumn("__failed", verdict)
    image, mime, failed = F.col("__image"), F.col("__mime"), F.col("__failed")
    none = F.lit(None).cast("string")
    passed = F.struct(F.lit(200).alias("status"), F.lit(demo).alias("demo"), image.alias("image"), mime.alias("mimeType"), (F.lit(fixed.SAYS["demo"]) if demo else none).alias("message"), none.alias("error"))
    refused = F.struct(failed["status"].alias("status"), F.lit(None).cast("boolean").alias("demo"), none.alias("image"), none.alias("mimeType"), none.alias("message"), failed["error"].alias("error"))
    return rows.withColumn("response", F.when(failed.isNotNull(), refused).otherwise(passed)).drop("__v", "__length_ok", "__image", "__mime", "__failed")


def response_json(response: Column) -> Column:
    """The body of a response; what it lacks is left out."""
    return F.to_json(response.dropFields("status"))


def provider_request(prompt: Column, mime: Column, image: Column, width: Column, height: Column) -> Column:
    """The provider's request as JSON; the aspect is left out where the size isn't known."""
    inline = F.struct(mime.alias("mimeType"), image.alias("data"))
    part = lambda data, text: F.to_json(F.struct(*([data.alias("inlineData")] if data is not None else [text.alias("text")])))
    parts = F.concat(F.lit('[{"parts":['), part(inline, None), F.lit(","), part(None, prompt), F.lit("]}]"))
    aspect = F.to_json(F.struct(F.array(F.lit("IMAGE")).alias("responseModalities"), F.when(geometry.has_size(width, height), F.struct(geometry.closest_aspect(width, height).alias("aspectRatio"))).alias("imageConfig")))
    return F.concat(F.lit('{"contents":'), parts, F.lit(',"generationConfig":'), aspect, F.lit("}"))


def first_image(response: Column) -> Column:
    """The first part with image data of the first candidate; null if there is none."""
    parts = F.get(response["candidates"], F.lit(0))["content"]["parts"]
    return F.get(F.filter(parts, lambda p: F.coalesce(p["inlineData"]["data"] != "", F.lit(False))), F.lit(0))["inlineData"]


def is_blocked(response: Column) -> Column:
    reason = F.coalesce(response["promptFeedback"]["blockReason"] != "", F.lit(False))
    end = F.coalesce(F.get(response["candidates"], F.lit(0))["finishReason"].isin("SAFETY", "IMAGE_SAFETY"), F.lit(False))
    return reason | end


def provider_requests(rows: DataFrame, prompt: Column, key: str) -> DataFrame:
    """``key`` and body of the provider's request for every row of ``guarded`` (demo false) that passed its guards.

    The guarded rows are staged, lest every guard is judged anew in the filter on their outcome.
    """
    v = js.parsed(F.col("body"))
    side = lambda name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, f"$.{name}", "double"))
    passed = written(rows.select(key, "body", "response"), "guarded").where("response.status = 200")
    return passed.select(key, provider_request(prompt, F.col("response.mimeType"), F.col("response.image"), side("imageWidth"), side("imageHeight")).alias("provider_body"))


def answered(rows: DataFrame, provided: DataFrame, key: str) -> DataFrame:
    """``rows`` of ``guarded`` (demo false) with the response that their clients get.

    ``provided`` has ``key``, provider (the provider's response), http_status and network_error.
    A refused request keeps its refusal; one that the provider never answered counts as unreachable.
    """
    joined = rows.alias("g").join(provided.alias("p"), key, "left")
    missing = F.col("p.http_status").isNull() & F.col("p.network_error").isNull()
    answer = mapped_response(F.col("p.provider"), F.col("p.http_status"), F.when(missing, "missing").otherwise(F.col("p.network_error")))
    none = F.lit(None).cast("string")
    said = F.struct(answer["status"].alias("status"), F.when(answer["error"].isNull(), F.lit(False)).alias("demo"), answer["image"].alias("image"), answer["mimeType"].alias("mimeType"), none.alias("message"), answer["error"].alias("error"))
    return joined.select(key, F.when(F.col("g.response.status") == 200, said).otherwise(F.col("g.response")).alias("response"))


def mapped_response(response: Column, http_status: Column | None = None, network_error: Column | None = None) -> Column:
    """(status, error, image, mimeType): network failures, provider errors, then the image or its absence.

    ``network_error`` is ``timeout``, any other text, or null; an image counts even if blocked.
    """
    none = F.lit(None).cast("string")
    image = first_image(response)

    def failed(status: int, said: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(fixed.SAYS[said]).alias("error"), none.alias("image"), none.alias("mimeType"))

    found = F.struct(F.lit(200).alias("status"), none.alias("error"), image["data"].alias("image"), F.coalesce(image["mimeType"], F.lit("image/png")).alias("mimeType"))
    out = F.when(F.lit(False), failed(502, "failed"))
    if network_error is not None:
        out = out.when(network_error == "timeout", failed(502, "timeout")).when(network_error.isNotNull(), failed(502, "unreachable"))
    if http_status is not None:
        out = out.when(http_status == 429, failed(502, "busy")).when(~http_status.between(200, 299), failed(502, "failed"))
    return out.when(image.isNotNull(), found).when(is_blocked(response), failed(422, "declined")).otherwise(failed(502, "no_image"))


def file_error(mime: Column, size: Column) -> Column:
    """What a client says about a file that it won't take; null if it takes it."""
    return F.when(~F.coalesce(mime.isin(*fixed.MIME_TYPES), F.lit(False)), fixed.SAYS["file_type"]).when(size > fixed.MAX_FILE_BYTES, fixed.SAYS["file_size"])
