"""A data source of ordered lines: text files cut by byte ranges, each line with its place, in batch and as a stream.

    spark.dataSource.register(OrderedLines)
    spark.read.format("ordered_lines").option("path", folder).load()        # path, place, line

`place` is the byte at which a line begins, so (path, place) is the order of the lines however many tasks read a file: what a stable sort
by time needs for its ties. A range's reader begins behind the first line end after its start and reads on through the line that
crosses its end, so every line is read once. Files are reached through pyarrow.fs, as the executors see them. Options: path (a
file or folder), range_bytes, and for streams files_per_batch. A stream takes files in the order of their names; a name is taken once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, place long, line string"
RANGE_BYTES, BLOCK = 64 << 20, 1 << 20


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files at any depth, hidden ones left out, in the order of their paths."""
    from pyarrow import fs

    store, name = store_of(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(name) :].strip("/").split("/")))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def lines_of(store, part: Range) -> Iterator[tuple[str, int, str]]:
    """The lines that begin in the range; a line holds no line end, \\n or \\r\\n."""
    with store.open_input_file(part.path) as source:
        at = part.start
        if at:
            source.seek(at - 1)
            # The line that crosses the start, or ends just there, is another range's.
            while (block := source.read(BLOCK)) and (cut := block.find(b"\n")) < 0:
                at += len(block)
            if not block:
                return
            at += cut
        source.seek(at)
        held = b""
        while at < part.end:
            block = source.read(BLOCK)
            if not block:
                if held:
                    yield part.path, at, held.removesuffix(b"\r").decode(errors="replace")
                return
            *whole, held = (held + block).split(b"\n")
            for line in whole:
                if at >= part.end:
                    return
                yield part.path, at, line.removesuffix(b"\r").decode(errors="replace")
                at += len(line) + 1


def ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    return [Range(path, start, min(start + size, n)) for path, n in files for start in range(0, n, size)]


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(files_under(self.root), self.size) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(store_of(self.root)[0], partition) if partition.path else iter(())


class LineStreamReader(DataSourceStreamReader):
    """An offset is the last name taken."""

    def __init__(self, options: dict):
        self.root, self.size, self.most = options["path"], int(options.get("range_bytes", RANGE_BYTES)), int(options.get("files_per_batch", 1000))
        self.at = ""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        new = [p for p, _ in files_under(self.root) if p > self.at][: self.most]
        self.at = new[-1] if new else self.at
        return {"after": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # After a restart the reader goes on behind what is already planned.
        self.at = max(self.at, end["after"])
        return ranges([(p, n) for p, n in files_under(self.root) if start["after"] < p <= end["after"]], self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(store_of(self.root)[0], partition)


class OrderedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(self.options)


def read_lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(OrderedLines)
    return spark.read.format("ordered_lines").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def parsed(lines: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """path, place and the fields of each line's JSON. strict: a line that is no JSON of this schema fails the query; else it is left out.
    Blank lines are left out."""
    full = lines.where(F.trim("line") != "").withColumn("_j", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_j._bad").isNotNull() | F.col("_j").isNull()
    if strict:
        told = F.concat(F.lit("not a measurement: "), F.col("path"), F.lit(" at byte "), F.col("place").cast("string"))
        full = full.withColumn("_j", F.when(bad, F.raise_error(told).cast(full.schema["_j"].dataType)).otherwise(F.col("_j")))
    else:
        full = full.where(~bad)
    return full.select("path", "place", "_j.*").drop("_bad")


def in_time_order(rows: DataFrame, time: str = "t") -> DataFrame:
    """Stable: rows of one time stand as their lines do."""
    return rows.orderBy(time, "path", "place")
