"""The driver's tables seen as timelines, clips, envelopes, poll logs and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: an order is a video, a line a clip; pos: the order in which its clips came."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    start = F.col("l_linenumber").cast("long") * 10_000_000
    category = F.when(F.col("l_returnflag") == "R", "highlight").when(F.col("l_returnflag") == "A", "reaction").otherwise("filler")
    # Named after the window, so that Spark knows rows to be dealt by video_id from here on.
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(by)).select(
        F.col("l_orderkey").alias("video_id"), "pos", start.alias("start_us"),
        (start + (F.col("l_quantity") * 1_500_000).cast("long")).alias("end_us"), F.round(F.col("l_discount") * 100).cast("int").alias("score"),
        category.alias("category"))


def described(rows: DataFrame) -> DataFrame:
    """Clips with ids and texts."""
    return rows.withColumns({
        "clip_id": F.concat(F.lit("clip-"), F.col("pos").cast("string")), "description": F.concat(F.lit("Moment #"), F.col("pos").cast("string"), F.lit(" / "), "category"),
        "rationale": F.lit("from the table"), "tags": F.array("category")})


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_totalprice") / 100).alias("duration_sec"))


def described_media(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "path": F.concat(F.lit("/videos/"), F.col("video_id").cast("string"), F.lit(".mp4")), "width": F.lit(1280), "height": F.lit(720), "fps": F.lit(25.0),
        "video_codec": F.lit("h264"), "audio_codec": F.lit("aac"), "container": F.lit("mp4"), "size_bytes": F.col("video_id") * 1000})


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips laid end to end: scene lengths are the clips' lengths."""
    by = Window.partitionBy("video_id").orderBy("pos")
    length = (F.col("end_us") - F.col("start_us")) / 1e6
    d = clips(spark, sf_dir).withColumn("end_sec", F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select("video_id", (F.col("pos") - 1).alias("scene_index"), (F.col("end_sec") - length).alias("start_sec"), "end_sec")


def scene_media(scene_rows: DataFrame) -> DataFrame:
    return scene_rows.groupBy("video_id").agg(F.max("end_sec").alias("duration_sec"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a timeline, an event a frame."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), (F.row_number().over(by) - 1).cast("long").alias("frame"), F.col("value").alias("e"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as moments in seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.lit(None).cast("int").alias("scene_index"), "event_id")


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min(F.struct("event_id", "value", "event_type")).alias("e"))
    size = F.when(F.col("e.event_type") != "error", F.floor(F.col("e.value") / 100).cast("long"))
    return d.select(F.col("user_id").cast("string").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), size.alias("size_bytes"), size.alias("mtime_ns"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 5
    legacy = F.when(kind == 0, "Text+Audio+Video->text")
    listed = F.when(kind == 1, F.array(F.lit("audio"), F.lit("VIDEO"))).when(kind == 2, F.array(F.lit("video"))).when(kind == 3, F.array(F.lit("text"), F.lit("audio")))
    price = F.when(F.col("p_size") % 7 != 0, (F.col("p_retailprice") / 1e9).cast("string"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("m/"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), (F.col("p_size") * 1000).cast("string").alias("context_length"),
        F.struct(legacy.alias("modality"), listed.alias("input_modalities")).alias("architecture"), F.struct(price.alias("prompt"), price.alias("completion")).alias("pricing"))


# The same views for the reference SQL.
CLIPS = """clips AS (
  SELECT l_orderkey AS video_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS pos,
         l_linenumber::BIGINT * 10000000 AS start_us, l_linenumber::BIGINT * 10000000 + trunc(l_quantity * 1500000)::BIGINT AS end_us,
         round(l_discount * 100)::INT AS score, CASE l_returnflag WHEN 'R' THEN 'highlight' WHEN 'A' THEN 'reaction' ELSE 'filler' END AS category
  FROM lineitem)"""
SCORED = CLIPS + """,
lengths AS (SELECT *, (end_us - start_us) / 1000000 AS secs FROM clips),
scored AS (SELECT *, CASE WHEN secs < 3 OR secs > 60 THEN 2 ELSE 5 END AS heuristic_score,
           greatest(0, least(10, score + CASE WHEN secs < 3 OR secs > 60 THEN 2 ELSE 5 END - 5))::INT AS final_score FROM lengths)"""
MEDIA = "media AS (SELECT o_orderkey AS video_id, o_totalprice / 100 AS duration_sec FROM orders)"
SCENES = CLIPS + """,
ends AS (SELECT video_id, pos, (end_us - start_us) / 1e6::DOUBLE AS len, sum((end_us - start_us) / 1e6::DOUBLE) OVER (PARTITION BY video_id ORDER BY pos) AS end_sec FROM clips),
scenes AS (SELECT video_id, (pos - 1)::INT AS scene_index, end_sec - len AS start_sec, end_sec FROM ends)"""
FRAMES = "frames AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS e FROM events)"
MOMENTS = "moments AS (SELECT user_id AS video_id, epoch_us(ts) / 1e6::DOUBLE AS t, event_id FROM events)"
MODELS = """models AS (
  SELECT 'm/' || p_partkey AS id, p_name AS name, (p_size * 1000)::INT AS context_length, p_partkey % 5 IN (0, 1, 3) AS audio, p_partkey % 5 IN (0, 1, 2) AS video,
         CASE WHEN p_size % 7 <> 0 THEN round_even(p_retailprice / 1e9::DOUBLE * 1e6::DOUBLE, 4) END AS usd FROM part)"""
POLLS = """polls AS (
  SELECT user_id::VARCHAR AS path, epoch_us(ts) / 1e6::DOUBLE AS t, CASE WHEN arg_min(event_type, event_id) <> 'error' THEN floor(arg_min(value, event_id) / 100)::BIGINT END AS size
  FROM events GROUP BY user_id, ts)"""


def fold(items: str, clash: str) -> str:
    """SQL: keeps the items that clash (x: the item, y: one kept) with none kept before."""
    return (f"list_reduce(list_transform({items}, lambda i: [i]), lambda acc, xs: CASE WHEN len(list_filter(acc, lambda y: "
            f"{clash.replace('x.', 'xs[1].')})) > 0 THEN acc ELSE list_concat(acc, xs) END)")
