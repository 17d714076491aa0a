"""Rows as JSON lines with a manifest that comes last.

Tasks write parts of their own names; nothing lists a folder to find them. When all have succeeded, the driver writes
a manifest that names the parts, whole or not at all. A job that fails leaves the manifest before it. Readers go by
the manifest alone; parts of tasks that were lost or outlived their job do no harm, and `vacuum` deletes them.
"""

from __future__ import annotations

import dataclasses
import datetime
import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from timeloom.errors import TimelineError

MANIFEST = "manifest.json"


@dataclasses.dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int


def _open(path: str):
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _manifest(path: str) -> dict | None:
    store, top = _open(path)
    if store.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{top}/{MANIFEST}") as f:
        return json.loads(f.read())


def _plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    raise TypeError(f"no JSON for {type(value).__name__}")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows) -> _Part:
        store, top = _open(self.path)
        store.create_dir(top)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        try:
            with store.open_output_stream(f"{top}/{name}") as out:
                for row in rows:
                    out.write(json.dumps(row.asDict(recursive=True), default=_plain).encode() + b"\n")
                    n += 1
        except BaseException:
            store.delete_file(f"{top}/{name}")  # the attempt that takes its place has a name of its own
            raise
        return _Part(name, n)

    def commit(self, messages) -> None:
        store, top = _open(self.path)
        before = _manifest(self.path)
        old = before["parts"] if before else []
        new = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        parts = new if self.overwrite else old + new
        store.create_dir(top)
        with store.open_output_stream(f"{top}/{MANIFEST}.tmp") as out:
            out.write(json.dumps({"parts": parts, "rows": sum(p["rows"] for p in parts)}, indent=1).encode())
        store.move(f"{top}/{MANIFEST}.tmp", f"{top}/{MANIFEST}")
        stay = {p["file"] for p in parts}
        self._delete([*(p["file"] for p in old if p["file"] not in stay), *(m.file for m in messages if m is not None and m.file not in stay)])

    def abort(self, messages) -> None:
        self._delete([m.file for m in messages if m is not None])

    def _delete(self, names) -> None:
        store, top = _open(self.path)
        for name in names:
            if store.get_file_info(f"{top}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{top}/{name}")


class CommittedLines(DataSource):
    """option path: a folder that the driver's and the executors' Python can write to, or an address that pyarrow knows."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """mode: append, or overwrite: the manifest then names the new parts alone, and the old ones go after it."""
    if mode not in ("append", "overwrite"):
        raise TimelineError(f"mode {mode!r}: append or overwrite")
    rows.sparkSession.dataSource.register(CommittedLines)
    rows.write.format("committed_lines").mode(mode).save(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the parts that the manifest names; none without a manifest."""
    found = _manifest(path)
    if not found or not found["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{p['file']}" for p in found["parts"]])


def vacuum(path: str) -> int:
    """Deletes the parts that the manifest doesn't name, when no job writes there; returns how many."""
    store, top = _open(path)
    stay = {p["file"] for p in (_manifest(path) or {"parts": []})["parts"]}
    gone = [f.path for f in store.get_file_info(fs.FileSelector(top)) if f.base_name.startswith("part-") and f.base_name not in stay]
    for name in gone:
        store.delete_file(name)
    return len(gone)


def to_folder(path: str):
    """A sink for `documents.dispatch`: ranked clips as lines, from scratch."""
    def put(ranked: DataFrame) -> None:
        write(ranked, path, "overwrite")

    return put
