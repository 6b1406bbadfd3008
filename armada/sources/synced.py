"""Files of a synced folder as a stream that also delivers files that change.

Spark's own file source remembers paths, so a file rewritten under its old name is never seen again. Here
an offset stands for a listing of the folder: path, modification time and length of every file. A file
that is new in a listing, or differs from the one before, is delivered; so each state of a file that a
listing met is delivered once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "synced_folder"
SCHEMA = "path string, modified timestamp, length bigint, content binary"
PARTITION_BYTES = 64 << 20

_ARROW = pa.schema(
    [("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())]
)


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    found, path = fs.FileSystem.from_uri(place if ":" in place else f"file://{place}")
    return found, path


@dataclass
class Files(InputPartition):
    """Files (path, modified in microseconds, length) that one task reads."""

    listed: tuple[tuple[str, int, int], ...]


class Reader(DataSourceStreamReader):
    """Offsets are numbers of listings; listing n is the file ``n.json`` in the state folder.

    Listings are written before their number is handed out and never change, so a query that starts
    again finds the files its last offset stood for. Two listings are kept.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.state = options["path"], options["state"]
        self.ending = options.get("ending", "")

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _listed(self, number: int) -> dict[str, list[int]]:
        if not number:
            return {}
        system, state = opened(self.state)
        with system.open_input_stream(f"{state}/{number}.json") as stream:
            return json.loads(stream.readall())

    def _last(self) -> int:
        system, state = opened(self.state)
        system.create_dir(state, recursive=True)
        names = (i.base_name for i in system.get_file_info(fs.FileSelector(state)))
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def latestOffset(self) -> dict:
        system, folder = opened(self.folder)
        selector = fs.FileSelector(folder, allow_not_found=True, recursive=True)
        now = {
            i.path: [i.mtime_ns // 1000, i.size]
            for i in system.get_file_info(selector)
            if i.is_file and i.base_name.endswith(self.ending) and not i.base_name.startswith((".", "_"))
        }
        number = self._last()
        if now == self._listed(number):
            return {"listing": number}
        system, state = opened(self.state)
        with system.open_output_stream(f"{state}/.{number + 1}.part") as stream:
            stream.write(json.dumps(now).encode())
        system.move(f"{state}/.{number + 1}.part", f"{state}/{number + 1}.json")
        return {"listing": number + 1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before, now = self._listed(start["listing"]), self._listed(end["listing"])
        changed = sorted((path, *state) for path, state in now.items() if before.get(path) != state)
        found, held, size = [], [], 0
        for file in changed:
            if held and size + file[2] > PARTITION_BYTES:
                found.append(Files(tuple(held)))
                held, size = [], 0
            held.append(file)
            size += file[2]
        if held:
            found.append(Files(tuple(held)))
        return found

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        for path, modified, length in partition.listed:
            try:
                with system.open_input_stream(path) as stream:
                    content = stream.readall()
            except FileNotFoundError:  # taken away since; the next listing does not have it
                continue
            columns = ([path], [modified], [length], [content])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def commit(self, end: dict) -> None:
        system, state = opened(self.state)
        old = f"{state}/{end['listing'] - 2}.json"
        if system.get_file_info(old).is_file:
            system.delete_file(old)


class SyncedFolder(DataSource):
    """Options: ``path`` (the folder), ``state`` (a folder of the stream's own that outlives restarts),
    ``ending`` (of the names that count)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def stream_synced(spark: SparkSession, folder: str, state: str, ending: str = "") -> DataFrame:
    """Each state of each file of a folder as a stream (path, modified, length, content).

    ``state`` belongs to one stream and must be as durable as its checkpoint. Files are delivered whole; a
    file that changes while it is read is delivered again with its next listing. Names that begin with a
    dot or underscore are left out, and so are files that are gone again.
    """
    spark.dataSource.register(SyncedFolder)
    reader = spark.readStream.format(NAME).option("path", folder).option("state", state).option("ending", ending)
    return reader.load()


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows (name, content) as one file each, replacing files of the same name.

    Files take their place by a rename, so a reader never meets half of one; written again by a task that
    runs twice they are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                part = f"{path}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as stream:
                    stream.write((content or "").encode())
                system.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    rows.select("name", F.col("content").cast("string")).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line of each file: path, modified, pos (from 0), value. A last line end opens no line."""
    text = F.regexp_replace(F.col(content).cast("string"), r"\r?\n\z", "")
    return files.select("path", "modified", F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "value"))


def latest(files: DataFrame) -> DataFrame:
    """Of a table of delivered states, the last of each path."""
    best = F.max_by(F.struct("modified", "length", "content"), F.struct("modified", "length")).alias("_f")
    return files.groupBy("path").agg(best).select("path", "_f.*")
