"""Media facts from the JSON that a prober prints, and files' signatures and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.schema import PROBE


def _rate(text: Column) -> Column:
    over = F.coalesce(F.get(F.split(text, "/"), F.lit(1)), F.lit("1")).try_cast("double")
    rate = F.get(F.split(text, "/"), F.lit(0)).try_cast("double") / F.nullif(over, F.lit(0.0))
    return F.when(rate > 0, rate)


def _positive(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(x > 0, x)


def parse_probe(payloads: DataFrame, text: str = "payload", path: str = "path", keep: str | None = None) -> DataFrame:
    """(path, payload) to the media facts and problem (null, or what is missing); keep: a column that stays."""
    also = [keep] if keep else []
    d = payloads.select(*also, F.col(path).alias("path"), F.from_json(text, PROBE).alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    d = d.select(*also, "path", "p", first("video").alias("v"), first("audio").alias("a"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    container = F.coalesce(F.nullif(F.split_part("p.format.format_name", F.lit(","), F.lit(1)), F.lit("")), F.nullif(suffix, F.lit("")), F.lit("unknown"))
    d = d.select(
        *also, "path", F.coalesce(_positive(F.col("p.format.duration")), _positive(F.col("v.duration"))).alias("duration_sec"),
        F.col("v.width").alias("width"), F.col("v.height").alias("height"),
        F.coalesce(_rate(F.col("v.avg_frame_rate")), _rate(F.col("v.r_frame_rate"))).alias("fps"), F.col("v.codec_name").alias("video_codec"),
        F.col("a.codec_name").alias("audio_codec"), container.alias("container"),
        F.coalesce(F.col("p.format.size").try_cast("long"), F.lit(0)).alias("size_bytes"),
        F.col("p.streams").isNull().alias("_broken"), F.col("v").isNull().alias("_none"))
    problem = (F.when(F.col("_broken"), "not a probe").when(F.col("_none"), "no video stream").when(F.col("width").isNull() | F.col("height").isNull() | F.col("video_codec").isNull(), "video stream lacks a field")
               .when(F.col("fps").isNull(), "no frame rate").when(F.col("duration_sec").isNull(), "no duration"))
    return d.withColumn("problem", problem).drop("_broken", "_none")


#: What a prober that was stopped after its time-out gets to end by itself.
GRACE_SEC = 1.0


def _probed(prober, path: str, timeout: float) -> tuple[str | None, str | None]:
    """Payload and problem of one file. The prober runs in a process of its own, which is killed when the time is over."""
    import multiprocessing

    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)

    def ask():
        try:
            there.send(prober(path, timeout))
        except FileNotFoundError:
            there.send((None, "no such file"))
        except TimeoutError:
            there.send((None, f"no answer in {timeout:g} s"))
        except BaseException as failure:  # noqa: BLE001  told as this file's problem
            there.send((None, f"{type(failure).__name__}: {failure}"))

    process = context.Process(target=ask, daemon=True)
    process.start()
    there.close()
    try:
        if not here.poll(timeout + GRACE_SEC):
            return None, f"no answer in {timeout:g} s"
        code, said = here.recv()
    except EOFError:
        process.join(GRACE_SEC)
        return None, f"exit code {process.exitcode}"
    finally:
        if process.is_alive():
            process.kill()
        process.join()
        here.close()
    return (None, said) if code is None else (said, f"exit code {code}" if code else None)


def probe_files(paths: DataFrame, prober, timeout: float = 30.0) -> DataFrame:
    """paths (path) to media facts and problem. prober(path, timeout) gives the exit code and the printed
    text, inside the tasks; a missing file, a time-out, another code than 0 and bad JSON are problems. A prober
    that hangs is killed soon after its time-out."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            payloads, problems = zip(*(_probed(prober, path, timeout) for path in paths)) if paths else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(payloads, pa.string()), pa.array(problems, pa.string())], names=["path", "payload", "failure"])

    d = paths.select("path").mapInArrow(run, "path string, payload string, failure string")
    facts = parse_probe(d.select("path", F.struct("payload", "failure").alias("both"), "payload"), keep="both")
    return facts.withColumn("problem", F.coalesce("both.failure", "problem")).drop("both")


def aspect_ratio(width: Column, height: Column) -> Column:
    return width / height


def file_signatures(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, modified of the files that match path; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def content_seed(content: Column) -> Column:
    """An unsigned 64-bit number (decimal) from the hash of the first MiB."""
    return F.conv(F.substring(F.sha2(F.substring(content, 1, 1 << 20), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def pcm_samples(files: DataFrame, key: str, content: str) -> DataFrame:
    """Raw little-endian 32-bit floats to rows (key, i, x)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(data.as_py() or b"", "<f4", len(data.as_py() or b"") // 4)
                for at in range(0, len(x), 1 << 20):
                    part = x[at : at + (1 << 20)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(part), batch.schema.field(0).type), pa.array(np.arange(at, at + len(part))), pa.array(part.astype(np.float64))],
                        names=[key, "i", "x"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, i long, x double")
