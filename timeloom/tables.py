"""Tables between the steps of a job: written to the folder that driver and executors share, and owned by a block.

A step that several later ones read, or that a loop carries on, is written and read back. Lineage ends there
and a lost executor loses nothing. Tables belong to the `scratch` block around the call.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary folder of
    this machine is set, once a session, if the session runs on this machine alone; else it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark then drops a query's shuffle files when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders that the innermost block of this thread (or task of asyncio) owns; None outside of blocks.
_owned: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here, a lost
    executor loses nothing, the shuffle files behind it go, and later readers prune columns. This is a
    job of its own, run while the query is being put together. The table belongs to the innermost
    `scratch` block around the call and goes with it; outside of any it stays until `discard` is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/timeloom/{label}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    if spark.conf.get(_CLEANUP, "false") != "true":
        spark.conf.set(_CLEANUP, "true")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Owns the tables that `cut` writes inside the block (in this thread) and deletes them at its end, but
    for those added to the list that it gives; these pass to the block around it.

    An operator that returns rows lazily leaves tables that its result reads. Who calls it can put the call
    and the use of its result into such a block; all of its tables are gone afterwards."""
    mine: list[str] = []
    kept: list[DataFrame] = []
    token = _owned.set(mine)
    try:
        yield kept
    finally:
        _owned.reset(token)
        stay, outer = {p for df in kept for p in df.inputFiles()}, _owned.get()
        for path in mine:
            if not any(path in p for p in stay):
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that `cut` gave and that nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in table.inputFiles()}:
        if "/timeloom/" in path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
