"""Mixing sources to target weights by a time-varying curriculum.

A source's target is its share of all words by weight, stopped at `MAX_EPOCHS` times its own size; the
excess is shared anew by weight until none is above. The source's weight runs linearly over training
time, so its cumulative demand is quadratic and is inverted in closed form: the word at offset c of a
source's stream is wanted at the time t at which the integral of its weight reaches c. Documents stand
in that stream in the order of md5(doc_id), epoch after epoch; one is taken as often as its middle word
lies below the target, so that a source misses its target by half a document at most. The result is
range-sorted by position.

A source of any share is dealt out: offsets are prefix sums over 4096 hash buckets a source and,
inside each bucket, over its documents. DataFrame functions alone, no Python on executors.

Cases: null text has size 0 and is never taken; without any word all targets are 0; a null source is a source of its own, the last; rows
repeated count each for itself; null ids hash alike and come first in their source, ordered by size and text hash; a very long text is
one row, counted whole; equal hashes are ordered by id, size and text hash; an empty table
gives an empty result; further columns are kept by `mix` and ignored by `positions`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, load, word_count

WEIGHTS = (1, 2, 3)
#: Change of a source's weight over training, relative to its mean: -1 fades out, 1 fades in.
SLOPES = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
_BUCKET_DIGITS = 3  # hex digits of the hash: 4096 buckets a source


def targets(sources: DataFrame, weights=WEIGHTS, slopes=SLOPES, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source, source_size) to the same plus target, slope, all_words and mean_slope. One row a
    source: the windows here see the table of sources, not of documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = lambda values: F.element_at(
        F.array(*(F.lit(float(v)) for v in values)), ((F.col("n") - 1) % len(values) + 1).cast("int"))
    s = sources.withColumn("n", F.row_number().over(by_name))
    s = s.withColumn("weight", cycle(weights)).withColumn("slope", cycle(slopes))
    s = s.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("all_words", F.sum("source_size").over(every).cast("double"))
    level = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    s = s.withColumn("full", F.col("cap") / F.col("weight") <= level)
    s = s.withColumn("rest", F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every))
    s = s.withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every))
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("rest") / F.col("open") * F.col("weight")))
    s = s.withColumn("mean_slope", F.coalesce(F.try_divide(F.sum(F.col("target") * F.col("slope")).over(every), F.col("all_words")), F.lit(0.0)))
    return s.select("skey", "source_size", "target", "slope", "all_words", "mean_slope")


def _row_key(doc_id, source, text) -> tuple:
    """What a row is ordered and dealt by: the id's hash, the source and the text's hash."""
    return (F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))).alias("key"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("skey"), F.xxhash64(text).alias("tie"))


def _keyed(docs: DataFrame) -> DataFrame:
    key, skey, tie = _row_key(F.col("doc_id"), F.col("source"), F.col("text"))
    return docs.select(
        "doc_id", word_count(F.col("text")).alias("size"), skey, "source", key,
        F.substring(key, 1, _BUCKET_DIGITS).alias("bucket"), tie,
    )


def _assigned(rows: DataFrame, sizes: DataFrame, weights, slopes, epochs: int) -> DataFrame:
    """rows (keyed) plus source_size, target, copies and the positions of the copies; sizes: the same
    table, which is read twice."""
    cells = sizes.groupBy("skey", "bucket").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("cell"))
    sources = cells.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("cell").alias("source_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("skey", "bucket", F.coalesce(F.sum("cell").over(earlier), F.lit(0)).alias("base"))
    cells = cells.join(targets(sources, weights, slopes, epochs), "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = rows.join(cells, ["skey", "bucket"])
    d = d.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = F.filter(
        F.sequence(F.lit(0), F.lit(epochs - 1)),
        lambda e: (F.col("size") > 0) & (F.col("start") + F.col("size") / 2 + e * F.col("source_size") < F.col("target")),
    )
    d = d.withColumn("taken_in", taken)
    a, m = F.col("slope"), F.col("mean_slope")

    def position(epoch):
        u = (F.col("start") + epoch * F.col("source_size")) / F.col("target")
        t = 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))  # F(t) = (1-a) t + a t^2 = u
        t = F.when(u == 0, F.lit(0.0)).otherwise(t)
        return F.floor(F.col("all_words") * ((1 - m) * t + m * t * t))

    return d.withColumn("positions", F.transform("taken_in", position))


def positions(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) and position (words of training
    before its first copy; null if it isn't taken), sorted by position."""
    z = cut(_keyed(docs.select("doc_id", "source", "text")), "mix")
    d = _assigned(z, z, weights, slopes, epochs)
    return d.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("positions")).alias("taken"),
        F.get("positions", F.lit(0)).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with their columns.

    Words are counted once, and only keys and sizes pass through the windows; texts join the positions
    of their copies and are sorted by them. Rows with the same id, source and text are told apart by their
    number among these, whichever gets which."""
    z = cut(_keyed(docs.select("doc_id", "source", "text")), "mix")
    placed = _assigned(z, z, weights, slopes, epochs).where(F.size("positions") > 0)
    placed = placed.select("key", "skey", "tie", "positions")
    same = ["key", "skey", "tie"]
    number = lambda order: F.row_number().over(Window.partitionBy(*same).orderBy(order))
    placed = placed.withColumn("copy", number(F.col("positions")[0]))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    packed = packed.select("row", *_row_key(F.col("row.doc_id"), F.col("row.source"), F.col("row.text")))
    d = packed.withColumn("copy", number(F.lit(0))).join(placed.hint("merge"), [*same, "copy"])
    return d.select("row", "key", F.explode("positions").alias("at")).orderBy("at", "key").select("row.*")


def op4_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    return positions(load(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS weight, [-0.5, 0.0, 0.5][((n - 1) % 3 + 1)::INT]::DOUBLE AS a,
             (source_size * 3)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS words FROM s),
f AS (SELECT *, cap / weight <= (words - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM w),
t AS (SELECT *, CASE WHEN is_full THEN cap ELSE (words - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
             / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target FROM f),
m AS (SELECT *, coalesce(sum(target * a) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / words, 0) AS ma FROM t),
c AS (SELECT doc_id, size, source_size, target, words, a, ma,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
e AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE (st + size / 2 < target)::INT + (st + size / 2 + source_size < target)::INT
             + (st + size / 2 + 2 * source_size < target)::INT END AS copies,
             CASE WHEN st = 0 THEN 0.0 ELSE 2 * (st / target) / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * (st / target))) END AS x FROM c)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN floor(words * ((1 - ma) * x + ma * x * x))::BIGINT END AS position
FROM e
"""
