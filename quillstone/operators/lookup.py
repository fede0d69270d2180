"""The catalogue's small dimensions and look-ups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def brands(spark: SparkSession) -> DataFrame:
    rows = [(*b[:5], list(b[5]), fixed.BRAND_WORDS[b[0]]) for b in fixed.BRANDS]
    return spark.createDataFrame(rows, "id string, name string, manufacturer string, fill string, blurb string, highlights array<string>, prompt_descriptor string")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p, fixed.PROFILE_WORDS[p[0]]) for p in fixed.PROFILES], "id string, name string, blurb string, prompt_descriptor string")


def shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, fixed.SHAPE_WORDS[s[0]]) for s in fixed.SHAPE_ROWS], "id string, name string, blurb string, prompt_descriptor string")


def look_up(rows: DataFrame, dimension: DataFrame, code: Column, prefix: str) -> DataFrame:
    """``rows`` with the dimension's columns, null where it lacks the code; the dimension has a few rows, fixed in code."""
    renamed = dimension.select(*[F.col(c).alias(f"{prefix}_{c}") for c in dimension.columns])
    return rows.join(F.broadcast(renamed), code == F.col(f"{prefix}_id"), "left")


def known(rows: DataFrame, dimension: DataFrame, code: Column, keep: bool = True) -> DataFrame:
    """Rows whose code the dimension has, or (``keep`` false) lacks."""
    ids = F.broadcast(dimension.select(F.col("id").alias("__id")))
    return rows.join(ids, code == F.col("__id"), "left_semi" if keep else "left_anti")


def highlights(dimension: DataFrame) -> DataFrame:
    return dimension.select(F.col("id").alias("brand_id"), F.posexplode("highlights").alias("position", "highlight"))
