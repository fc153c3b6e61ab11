"""Members of zip and tar archives as tables, through a data source of Spark's own kind.

``spark.read.format("archive").load(path)`` after ``register(spark)``. Options:

* ``members``: names separated by commas; for a zip they are matched by their last part, whatever its case;
* ``table``: true reads text members with a header as rows of strings; else a row is (archive, member, content, status);
* ``required``: columns that a table must have.

Names and headers are looked up while the query is analysed, so that a missing member or a drifted header fails before
anything is read or written. A zip is read by a task a member, from where the member begins; a tar, which can only be read from its start,
by a task an archive, that holds one member at a time. Of a tar, a member that is not there is a row with status 404, and an
archive that ends or breaks half-way one with status 500, after the members before it.

Archives may lie wherever pyarrow's file systems reach; ``path`` may name several, separated by commas.
"""

from __future__ import annotations

import csv
import io
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 10_000
RAW = "archive string, member string, content binary, status int"


@contextmanager
def opened(path: str) -> Iterator[object]:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_file(name) as file:
        yield file


def is_zip(path: str) -> bool:
    return path.lower().endswith(".zip")


def found_in(path: str, wanted: list[str]) -> list[str]:
    """The full names of wanted members of a zip; all, if none is named. Fails if one is missing."""
    with opened(path) as file, zipfile.ZipFile(file) as archive:
        names = {n.rsplit("/", 1)[-1].lower(): n for n in sorted(archive.namelist(), reverse=True) if not n.endswith("/")}
    if missing := [w for w in wanted if w.lower() not in names]:
        raise FileNotFoundError(f"{path} has no {missing}")
    return [names[w.lower()] for w in wanted] if wanted else sorted(names.values())


def lines(file: object) -> Iterator[list[str]]:
    """Fields of a Latin-1 text table, trimmed; the byte-order mark goes, short rows are filled up by the caller."""
    text = io.TextIOWrapper(file, "latin-1", newline="")
    for row in csv.reader(text):
        yield [x.removeprefix("ï»¿").strip() for x in row]


@dataclass
class Member(InputPartition):
    path: str
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], wanted: list[str], columns: list[str] | None):
        self.paths, self.wanted, self.columns = paths, wanted, columns

    def partitions(self) -> list[Member]:
        out = []
        for path in self.paths:
            out += [Member(path, [n]) for n in found_in(path, self.wanted)] if is_zip(path) else [Member(path, self.wanted)]
        return out

    def read(self, partition: Member) -> Iterator:
        if self.columns is not None:
            yield from self.rows(partition)
        elif is_zip(partition.path):
            with opened(partition.path) as file, zipfile.ZipFile(file) as archive:
                for name in partition.names:
                    yield partition.path, name, archive.read(name), 200
        else:
            yield from self.members(partition)

    def rows(self, partition: Member) -> Iterator[pa.RecordBatch]:
        width = len(self.columns) - 1
        with opened(partition.path) as file, zipfile.ZipFile(file) as archive:
            for name in partition.names:
                with archive.open(name) as member:
                    found = lines(member)
                    next(found, None)
                    held = []

                    def batch(rows: list[list[str]], name: str = name) -> pa.RecordBatch:
                        full = [[*r[:width], *[""] * (width - len(r))] for r in rows]
                        values = [pa.array([x or None for x in c], pa.string()) for c in zip(*full, strict=True)]
                        return pa.RecordBatch.from_arrays([*values, pa.array([name] * len(rows), pa.string())], self.columns)

                    for row in found:
                        if row:
                            held.append(row)
                        if len(held) >= ROWS:
                            yield batch(held)
                            held = []
                    if held:
                        yield batch(held)

    def members(self, partition: Member) -> Iterator[tuple]:
        missing = set(partition.names)
        try:
            with opened(partition.path) as file, tarfile.open(fileobj=file, mode="r|*") as archive:
                for member in archive:
                    if member.isfile() and (not partition.names or member.name in missing):
                        content = archive.extractfile(member).read()
                        missing.discard(member.name)
                        yield partition.path, member.name, content, 200
                        if partition.names and not missing:
                            return
        except (tarfile.TarError, EOFError, OSError, ValueError):
            yield partition.path, None, None, 500
            return
        for name in sorted(missing):
            yield partition.path, name, None, 404


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def _asked(self) -> tuple[list[str], list[str]]:
        split = lambda x: [y.strip() for y in self.options.get(x, "").split(",") if y.strip()]
        if not split("path"):
            raise ValueError("no archive is named")
        return split("path"), split("members")

    def schema(self) -> str:
        paths, wanted = self._asked()
        if self.options.get("table", "false") != "true":
            for path in filter(is_zip, paths):
                found_in(path, wanted)
            return RAW
        if not all(map(is_zip, paths)):
            raise ValueError("only members of zip archives are read as tables")
        headers = []
        for path in paths:
            for member in found_in(path, wanted):
                with opened(path) as file, zipfile.ZipFile(file) as archive, archive.open(member) as text:
                    header = [c for c in next(lines(text), []) if c]
                required = [c.strip() for c in self.options.get("required", "").split(",") if c.strip()]
                if lacking := set(required) - set(header):
                    raise ValueError(f"{member} of {path} has no {sorted(lacking)}")
                headers.append(header)
        if any(h != headers[0] for h in headers):
            raise ValueError(f"the members of {paths} have different columns")
        return ", ".join(f"`{c}` string" for c in [*headers[0], "_member"])

    def reader(self, schema) -> ArchiveReader:
        table = self.options.get("table", "false") == "true"
        return ArchiveReader(*self._asked(), schema.names if table else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def text_table(spark: SparkSession, path: str, member: str, required: list[str]) -> DataFrame:
    """One text member of a zip archive as rows of strings."""
    register(spark)
    return spark.read.format("archive").option("members", member).option("table", "true").option("required", ",".join(required)).load(path).drop("_member")


def trace_members(spark: SparkSession, paths: list[str], aircraft: list[str]) -> DataFrame:
    """Trace files of some aircraft in daily archives: archive, icao, content (as ``traces.bodies`` reads it) and status."""
    from pyspark.sql import functions as F

    register(spark)
    wanted = ",".join(f"traces/{x[-2:]}/trace_full_{x}.json" for x in aircraft)
    rows = spark.read.format("archive").option("members", wanted).load(",".join(paths))
    return rows.select("archive", F.regexp_extract("member", "trace_full_(.*)\\.json$", 1).alias("icao"), "content", "status")
