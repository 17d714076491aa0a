"""A folder as a stream of polls: who is there, how large, changed when.

Each trigger is a poll. Its listing is written to a log before its offset is told, so that a restarted query
reads the same rows for the same offset, whatever has become of the folder since. Folders and logs are paths
that the driver's and the executors' Python can open, or addresses that pyarrow knows.
"""

from __future__ import annotations

import dataclasses
import json
import re
import time

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

POLL = "path string, t double, size_bytes long, mtime_ns long"
_NAME = re.compile(r"(\d{12})\.json$")


@dataclasses.dataclass
class _Poll(InputPartition):
    n: int


class _Polls(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.log = options["path"], options["log"]
        self.every, self.polled = float(options.get("every", "0")), None

    def _file(self, n: int):
        store, top = fs.FileSystem.from_uri(_address(self.log))
        return store, f"{top}/{n:012d}.json"

    def _last(self) -> int:
        store, top = fs.FileSystem.from_uri(_address(self.log))
        found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return max((int(m[1]) for f in found if (m := _NAME.search(f.base_name))), default=0)

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        n = self._last()
        if n and self.polled is not None and time.monotonic() - self.polled < self.every:
            return {"poll": n}
        self.polled = time.monotonic()
        store, top = fs.FileSystem.from_uri(_address(self.folder))
        now = time.time()
        seen = [(f.path, now, f.size, f.mtime_ns) for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.type == fs.FileType.File]
        log, name = self._file(n + 1)
        log.create_dir(name.rsplit("/", 1)[0])
        with log.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(seen).encode())
        log.move(f"{name}.tmp", name)  # whole or not at all
        return {"poll": n + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Poll(n) for n in range(start["poll"] + 1, end["poll"] + 1)]

    def read(self, partition: _Poll):
        store, name = self._file(partition.n)
        with store.open_input_stream(name) as f:
            yield from map(tuple, json.loads(f.read()))

    def commit(self, end: dict) -> None:
        """Listings before the last one committed aren't asked for again."""
        store, top = fs.FileSystem.from_uri(_address(self.log))
        for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if (m := _NAME.search(f.base_name)) and int(m[1]) < end["poll"]:
                store.delete_file(f.path)


def _address(path: str) -> str:
    return path if "://" in path else f"file://{path}"


class FolderPolls(DataSource):
    """options: path (the folder), log (where listings go), every (least seconds between two polls)."""

    @classmethod
    def name(cls) -> str:
        return "folder_polls"

    def schema(self) -> str:
        return POLL

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Polls(self.options)


def polls(spark: SparkSession, folder: str, log: str, every: float = 1.0) -> DataFrame:
    """The stream (path, t, size_bytes, mtime_ns) of a folder's files, for `streaming.readiness.watch`."""
    spark.dataSource.register(FolderPolls)
    return spark.readStream.format("folder_polls").option("log", log).option("every", str(every)).load(folder)
