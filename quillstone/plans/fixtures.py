"""Inputs of the operators, derived from the supplied tables by expressions that SQL can repeat."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, shared_dir

_MIMES = ("image/jpeg", "image/png", "image/webp", "image/gif")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column, *names: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair metadata over part; every rule is broken by some rows."""
    k = F.col("p_partkey")
    key = F.concat(F.lit("clinic0"), (k % 5).cast("string"), F.lit("-"), k.cast("string"))
    return table(spark, sf_dir, "part").select(
        k.alias("k"),
        F.concat(F.lit("clinic0"), (k % 5).cast("string")).alias("clinic"),
        key.alias("pair_id"),
        F.when(k % 17 == 0, F.concat(F.lit("other-"), k.cast("string"))).otherwise(key).alias("folder"),
        F.when(k % 9 < 5, "round").when(k % 9 < 8, "teardrop").otherwise("oval").alias("shape"),
        F.when(k % 23 == 0, "top").otherwise(pick(k, "front", "oblique-left", "oblique-right", "side-left", "side-right")).alias("view"),
        pick(k, "mentor", "natrelle", "motiva", "sientra", "other", "unknown").alias("brand"),
        pick(k, "moderate", "moderate-plus", "high", "extra-high", "unknown").alias("profile"),
        (50 + 20 * F.col("p_size")).cast("long").alias("volume_cc"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "").otherwise(F.concat(F.lit("agreement-"), k.cast("string"))).alias("consent_ref"),
        F.when(k % 19 != 0, F.concat(key, F.lit("/before.jpg"))).alias("before"),
        F.when(k % 29 != 0, F.concat(key, F.lit("/after.png"))).alias("after"),
    )


META_SQL = """meta as (
  select p_partkey as k, 'clinic0' || (p_partkey % 5) as clinic, 'clinic0' || (p_partkey % 5) || '-' || p_partkey as pair_id,
    case when p_partkey % 17 = 0 then 'other-' || p_partkey else 'clinic0' || (p_partkey % 5) || '-' || p_partkey end as folder,
    case when p_partkey % 9 < 5 then 'round' when p_partkey % 9 < 8 then 'teardrop' else 'oval' end as shape,
    case when p_partkey % 23 = 0 then 'top' else ['front','oblique-left','oblique-right','side-left','side-right'][p_partkey % 5 + 1] end as view,
    ['mentor','natrelle','motiva','sientra','other','unknown'][p_partkey % 6 + 1] as brand,
    ['moderate','moderate-plus','high','extra-high','unknown'][p_partkey % 5 + 1] as profile,
    cast(50 + 20 * p_size as bigint) as volume_cc,
    case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then '' else 'agreement-' || p_partkey end as consent_ref,
    case when p_partkey % 19 <> 0 then 1 end as before, case when p_partkey % 29 <> 0 then 1 end as after
  from part)"""


def metadata_json(rows: DataFrame) -> DataFrame:
    """``rows`` of meta with the JSON text that a clinic would send; a few texts are cut short."""
    names = [n for n in ("pair_id", "shape", "view", "brand", "profile", "volume_cc", "consent_ref", "adult_attested", "clothing", "months_post_op") if n in rows.columns]
    whole = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return rows.withColumn("meta_json", F.when(F.col("k") % 31 == 0, F.expr("substring(pair_id, 1, 5)")).otherwise(whole))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over meta; every guard is the first to fail for some."""
    k = F.col("k")
    image = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("aGk"), k.cast("string")))
    config = F.struct(F.col("brand").alias("brandId"), F.col("shape"), F.col("profile").alias("profileId"), F.col("volume_cc").alias("volumeCc"))
    body = F.to_json(F.struct(image.alias("image"), pick(k, *_MIMES).alias("mimeType"), config.alias("config")))
    return meta(spark, sf_dir).select(
        "k",
        (k % 10 == 0).alias("limited"),
        F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, "12500001").when(k % 8 == 2, "none").otherwise("2048").alias("content_length"),
        F.when(k % 12 == 0, F.lit("{cut")).otherwise(body).alias("body"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider responses over conversations: a part for each turn, images in those of assistants."""
    c, t = F.col("conv_id"), F.col("turn")
    inline = F.struct(F.when(t % 2 == 0, "image/jpeg").alias("mimeType"), F.when(c % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("img"), t.cast("string"))).alias("data"))
    part = F.struct(F.col("text"), F.when((F.col("role") == "assistant") & (c % 4 != 0), inline).alias("inlineData"))
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    candidate = F.struct(F.struct(F.col("p.part").alias("parts")).alias("content"), F.when(c % 5 == 0, "SAFETY").when(c % 5 == 1, "IMAGE_SAFETY").otherwise("STOP").alias("finishReason"))
    response = F.struct(F.when(c % 16 != 0, F.array(candidate)).alias("candidates"), F.struct(F.when(c % 7 == 0, "OTHER").alias("blockReason")).alias("promptFeedback"))
    return parts.select("conv_id", response.alias("response"), F.when(c % 10 == 9, 429).when(c % 10 == 8, 500).otherwise(200).alias("http_status"), F.when(c % 21 == 20, "timeout").when(c % 21 == 19, "reset").alias("network_error"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter's hit log over events: key, t in seconds, id."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("t"), F.col("event_id").alias("id"))


def digest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents 2k and 2k + 1 with the digests of their texts; a few are too small."""
    from ..operators import ordered

    d = F.col("doc_id")
    stems = table(spark, sf_dir, "documents").select((d - d % 2).alias("ord"), (d % 2).alias("stem"), ordered.digest(F.col("text")).alias("digest"))
    both = stems.groupBy("ord").agg(F.max(F.when(F.col("stem") == 0, F.col("digest"))).alias("before"), F.max(F.when(F.col("stem") == 1, F.col("digest"))).alias("after"))
    o = F.col("ord")
    return both.where("before is not null and after is not null").select("ord", F.concat(F.lit("clinic/"), o.cast("string")).alias("label"), "before", "after", (o % 26 != 0).alias("before_ok"), (o % 34 != 0).alias("after_ok"))


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements over part: some are revoked, some aren't on file."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(k % 23 != 1).select(F.concat(F.lit("agreement-"), k.cast("string")).alias("consent_ref"), (k % 7 == 0).alias("revoked"))


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meta with adult_attested; false or missing for some."""
    k = F.col("k")
    return meta(spark, sf_dir).withColumn("adult_attested", F.when(k % 10 != 8, k % 10 != 9))


GOVERNED_SQL = "(consent_ref <> '' and k % 10 not in (8, 9) and k % 23 <> 1 and k % 7 <> 0)"


def write_images(rows: DataFrame, root: str) -> str:
    """Write the files of ``rows`` (path, content) under ``root``, a folder that executors share, and return it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root)
        local, made = isinstance(system, fs.LocalFileSystem), None
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                end = f"{top}/{path}"
                folder = end.rsplit("/", 1)[0]
                if folder != made:
                    os.makedirs(folder, exist_ok=True) if local else system.create_dir(folder, recursive=True)
                    made = folder
                with open(end, "wb") if local else system.open_output_stream(end) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


def raw_image(width: int, height: int, shade: int, face: bool) -> bytes:
    """A binary pixmap of one shade; a face is its first two pixels in red."""
    pixels = bytearray([shade]) * (3 * width * height)
    if face:
        pixels[:6] = b"\xff\0\0\xff\0\0"
    return b"P6\n%d %d\n255\n" % (width, height) + bytes(pixels)


def pixmap_codec() -> tuple[Callable[[bytes], np.ndarray | None], Callable[[np.ndarray], bytes]]:
    """A codec of binary pixmaps, for images without an imaging library."""

    def decode(content: bytes) -> np.ndarray | None:
        head = content.split(b"\n", 3)
        if head[0] != b"P6" or len(head) != 4:
            return None
        width, height = map(int, head[1].split())
        return np.frombuffer(head[3], np.uint8).reshape(height, width, 3)

    return decode, lambda image: b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def red_detector() -> Callable[[np.ndarray], list[tuple[int, int, int, int]]]:
    """Finds the first two pixels if they are red, and takes what is around them for a face."""
    return lambda image: [(0, 0, 4, 4)] if (image[0, :2] == (255, 0, 0)).all() else []


def raw_folders(spark: SparkSession, sf_dir: str) -> str:
    """Raw folders over part: every check of the three stages is failed by some pairs."""
    rows = metadata_json(governed(spark, sf_dir)).select("k", "clinic", "folder", "meta_json", "before", "after")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, clinic, folder, meta_json, before, after in batch.itertuples(index=False):
                at = f"{clinic}/{folder}"
                out.append((f"{at}/meta.json", meta_json.encode()))
                if before:
                    out.append((f"{at}/before.jpg", b"junk" if k % 37 == 0 else raw_image(8 + k % 10, 9 + k % 3, k % 31, k % 4 != 0)))
                if after:
                    out.append((f"{at}/after.png", raw_image(9 + k % 4, 8 + k % 8, (k * 7 + 3) % 31, k % 6 != 0)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return write_images(dealt(rows).mapInPandas(files, "path string, content binary"), f"{shared_dir(spark)}/quillstone/raw-{uuid.uuid4().hex}")


def png_folder(spark: SparkSession, sf_dir: str) -> str:
    """A picture of one shade for every part, named by its key; a few can't be decoded."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["p_partkey"].tolist():
                width, height = 2 + k % 7, 1 + k % 5
                lines = (b"\0" + bytes([33 + k % 31]) * (3 * width)) * height
                chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
                whole = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
                out.append((f"{k}.png", b"junk" if k % 13 == 0 else whole))
            yield pd.DataFrame(out, columns=["path", "content"])

    rows = dealt(table(spark, sf_dir, "part").select("p_partkey")).mapInPandas(files, "path string, content binary")
    return write_images(rows, f"{shared_dir(spark)}/quillstone/png-{uuid.uuid4().hex}")


def provided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the provider answered to the requests over meta: images, refusals, errors, and nothing."""
    k = F.col("k")
    inline = F.struct(F.when(k % 2 == 0, "image/jpeg").alias("mimeType"), F.concat(F.lit("img"), k.cast("string")).alias("data"))
    parts = F.array(F.struct(F.lit("text").alias("text"), F.lit(None).cast("struct<mimeType:string,data:string>").alias("inlineData")), F.struct(F.lit(None).cast("string").alias("text"), F.when(k % 3 != 0, inline).alias("inlineData")))
    candidate = F.struct(F.struct(parts.alias("parts")).alias("content"), F.when(k % 5 == 0, "SAFETY").otherwise("STOP").alias("finishReason"))
    provider = F.struct(F.array(candidate).alias("candidates"), F.struct(F.lit(None).cast("string").alias("blockReason")).alias("promptFeedback"))
    network = F.when(k % 21 == 20, "timeout")
    return meta(spark, sf_dir).where(k % 17 != 0).select("k", provider.alias("provider"), F.when(network.isNull(), F.when(k % 10 == 9, 429).when(k % 10 == 7, 500).otherwise(200)).alias("http_status"), network.alias("network_error"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes, boxes and face counts over lineitem, all whole numbers."""
    q, n, k = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        k.alias("k"), n.alias("n"), (q * 61 + n * 37).alias("width"), (q * 43 + n * 211).alias("height"), (q * 3 + k % 7).alias("x"), (n * 17 + k % 5).alias("y"),
        (20 + q * 2).alias("w"), (20 + n * 9).alias("h"), (k % 4).alias("faces"), (k % 9 == 0).alias("allow"), F.when(k % 11 == 0, 0.2).otherwise(0.0).alias("crop"),
    )


BOXES_SQL = """boxes as (
  select l_orderkey as k, cast(l_linenumber as bigint) as n, cast(l_quantity as bigint) * 61 + l_linenumber * 37 as width, cast(l_quantity as bigint) * 43 + l_linenumber * 211 as height,
    cast(l_quantity as bigint) * 3 + l_orderkey % 7 as x, l_linenumber * 17 + l_orderkey % 5 as y, 20 + cast(l_quantity as bigint) * 2 as w, 20 + l_linenumber * 9 as h,
    l_orderkey % 4 as faces, l_orderkey % 9 = 0 as allow, case when l_orderkey % 11 = 0 then 0.2 else 0.0 end as crop
  from lineitem)"""
