"""Landed payloads as a Spark data source, for batches and streams: spark.read.format("landed_payloads").option("path", ...).load().

Whatever fetches payloads lands them in run folders of one landing folder, named in ascending order; a run is read once it has a _SUCCESS
file, as Spark's own writers leave one. A run's files are either

* form=files (default): each file is a payload as it came (JSON, HTML or XML); its name without the ending is the board's token, or
* form=rows: each line of a file is an object with token, label and payload, as df.write.json leaves them.

Rows: run, token, label, payload, ord. ord ascends over runs, files and lines, which is the order in which the first of equal postings wins.
Tasks get whole files, together up to FILE_BYTES; a file of rows is read line by line. The stream's offset is the name of the last complete
run, so a batch that runs again reads the same files.

Defined cases: hidden files (. or _) are left out; an empty landing folder has no rows; a line that isn't an object fails the read; a missing
token or label is null, and an empty file of form=files is an empty payload. Options: path, form, labels (a JSON object from token to label;
tokens are their own labels otherwise), from and to (names of the first and last run).
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "landed_payloads"
#: Bytes of files that a task reads, unless a single one is larger.
FILE_BYTES = 32 << 20
#: Lines of a file, which ord has room for.
LINES = 1 << 23
BATCH_ROWS = 256
SCHEMA = "run string, token string, label string, payload string, ord bigint"


@dataclass
class Files(InputPartition):
    """(place among all files, run, path) of a task's files."""

    files: list[tuple[int, str, str]]


class Landing:
    """The landing folder, as the driver lists it and tasks read it; any file system that Arrow knows."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.rows = options.get("form", "files") == "rows"
        self.labels = json.loads(options.get("labels", "{}"))
        self.first, self.last = options.get("from", ""), options.get("to", "")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def runs(self, after: str = "", upto: str | None = None) -> list[str]:
        """Complete runs in their order, without those up to `after`."""
        from pyarrow import fs

        system, root = self._open()
        found = [x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory]
        found = sorted(x for x in found if x > after and (upto is None or x <= upto) and x >= self.first and (not self.last or x <= self.last))
        done = system.get_file_info([f"{root}/{x}/_SUCCESS" for x in found])
        return [x for x, mark in zip(found, done, strict=True) if mark.type == fs.FileType.File]

    def partitions(self, runs: list[str]) -> list[Files]:
        from pyarrow import fs

        system, root = self._open()
        out, held, size, place = [], [], 0, 0
        for run in runs:
            for x in sorted(system.get_file_info(fs.FileSelector(f"{root}/{run}")), key=lambda x: x.base_name):
                if x.type != fs.FileType.File or x.base_name[0] in "._":
                    continue
                if held and size + x.size > FILE_BYTES:
                    out, held, size = [*out, Files(held)], [], 0
                held.append((place, run, x.path))
                place, size = place + 1, size + x.size
        return [*out, Files(held)] if held else out

    def read(self, part: Files):
        import pyarrow as pa

        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        held = []
        for row in self._rows(part):
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "ord" else pa.string()) for n, c in zip(names, zip(*held, strict=True), strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "ord" else pa.string()) for n, c in zip(names, zip(*held, strict=True), strict=True)], names)

    def _rows(self, part: Files):
        import io

        system, _ = self._open()
        for place, run, path in part.files:
            with system.open_input_stream(path) as stream:
                if not self.rows:
                    token = path.rpartition("/")[2].rpartition(".")[0]
                    yield run, token, self.labels.get(token, token), stream.read().decode("utf-8", "replace"), place * LINES
                    continue
                for line, text in enumerate(io.TextIOWrapper(io.BufferedReader(stream), "utf-8", newline="\n")):
                    if line >= LINES:
                        raise ValueError(f"{path} has more than {LINES} lines")
                    x = json.loads(text)
                    yield run, x.get("token"), self.labels.get(x.get("token"), x.get("label")), x.get("payload"), place * LINES + line


class Reader(DataSourceReader):
    def __init__(self, landing: Landing):
        self.landing = landing

    def partitions(self):
        return self.landing.partitions(self.landing.runs()) or [Files([])]

    def read(self, partition):
        return self.landing.read(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, landing: Landing):
        self.landing = landing

    def initialOffset(self):
        return {"run": ""}

    def latestOffset(self):
        runs = self.landing.runs()
        return {"run": runs[-1] if runs else ""}

    def partitions(self, start, end):
        return self.landing.partitions(self.landing.runs(start["run"], end["run"])) or [Files([])]

    def read(self, partition):
        return self.landing.read(partition)

    def commit(self, end):
        """Nothing to do: landed files stay."""


class LandedPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(Landing(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(Landing(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. The classes travel by value, so executors needn't have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LandedPayloads)
