"""A catalogue of models: what they accept, what they cost, which to offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.pricing import per_million
from timeloom.schema import MODEL


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Raw model rows of payload files ({"data": [...]}), with `position`, their place in the list; rows that
    are no objects are dropped. A payload that isn't JSON or has no list of data raises when it is read."""
    v = F.try_parse_json("value")
    rows = F.try_variant_get(v, "$.data", "array<variant>")
    listed = F.when(v.isNull(), F.raise_error(F.lit("the catalogue is not JSON")).cast("array<variant>")).when(
        rows.isNull(), F.raise_error(F.lit("the catalogue has no list of data")).cast("array<variant>")).otherwise(rows)
    d = spark.read.text(path, wholetext=True).select(F.posexplode(listed).alias("position", "v"))
    d = d.where(F.schema_of_variant("v").startswith("OBJECT"))
    return d.select("position", F.from_json(F.to_json("v"), MODEL).alias("m")).select("position", "m.*")


def has_modality(needle: str) -> Column:
    """Case-blind: in the older modality text, or in any listed input."""
    n = needle.lower()
    legacy = F.lower("architecture.modality").contains(n)
    listed = F.exists("architecture.input_modalities", lambda m: F.lower(m).contains(n))
    return F.coalesce(legacy, F.lit(False)) | F.coalesce(listed, F.lit(False))


def model_info(raw: DataFrame) -> DataFrame:
    """Typed rows; those without an id are dropped."""
    return raw.where(F.col("id").isNotNull() & (F.col("id") != "")).select(
        "id", "name", F.col("context_length").try_cast("int").alias("context_length"),
        per_million(F.col("pricing.prompt")).alias("usd_in"), per_million(F.col("pricing.completion")).alias("usd_out"),
        has_modality("audio").alias("audio"), has_modality("video").alias("video"))


def usable(raw: DataFrame) -> DataFrame:
    """Models that take audio and video, cheapest first, unpriced last."""
    return model_info(raw).where("audio and video").orderBy(F.col("usd_in").asc_nulls_last(), "id")


def check_models(asked: DataFrame, raw: DataFrame) -> DataFrame:
    """asked (id) with `problem`: null, or why the model won't do. Of rows with one id the first counts, by
    the column `position` if there is one, else as they come."""
    place = F.col("position") if "position" in raw.columns else F.monotonically_increasing_id()
    first = raw.withColumn("_place", place).where("id is not null").groupBy("id").agg(F.min_by("architecture", "_place").alias("architecture"))
    info = first.select("id", has_modality("audio").alias("audio"), has_modality("video").alias("video"))
    missing = F.array_join(F.array_compact(F.array(F.when(~F.col("audio"), "audio"), F.when(~F.col("video"), "video"))), ", ")
    problem = F.when(F.col("audio").isNull(), "unknown model").when(missing != "", F.concat(F.lit("lacks input: "), missing))
    return asked.join(info, "id", "left").select("id", problem.alias("problem"))


def supports(asked: DataFrame, raw: DataFrame, modality: str) -> DataFrame:
    """asked (id) with `supported`; false for unknown ids."""
    info = raw.where("id is not null").select("id", has_modality(modality).alias("has")).groupBy("id").agg(F.max("has").alias("has"))
    return asked.join(info, "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("supported"))


def page(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The first rows and how many more there are."""
    return rows.limit(limit), max(0, rows.count() - limit)
