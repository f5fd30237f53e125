"""A writer of files with a commit protocol: rows (frame, name, content) become
files, and a job's files are seen all at once or not at all.

A task writes its files and a list of them under a folder of its own; the commit
message names the list.  Committing replaces ``_committed.json``, a small file
that names the lists, by one rename, so that a reader sees the whole of one
write; files of a task that failed are in no list, and an aborted job's folder
goes.  Paths are those of any file system that Arrow knows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lumenspan.session import parts_of

SCHEMA = "frame long, name string, content binary"
LISTED = "frame long, name string, file string, size long, sha256 string"
COMMITTED = "_committed.json"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(where: fs.FileSystem, path: str, content: bytes) -> None:
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as f:
        f.write(content)


@dataclass
class Written(WriterCommitMessage):
    """Where a task's list of files stands, and how many it names."""

    listing: str
    files: int


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        where, root = file_system(self.path)
        mine, listed, seen = f"{root}/job-{self.job}/{uuid.uuid4().hex}", [], set()
        for row in iterator:
            frame, name, content = row["frame"], row["name"], bytes(row["content"] or b"")
            if frame is None or not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"no file can be named by frame {frame} and {name!r}")
            if (frame, name) in seen:
                raise ValueError(f"frame {frame} has two files {name!r}")
            seen.add((frame, name))
            file = f"{mine}/{frame}/{name}"
            _write(where, file, content)
            listed.append({"frame": frame, "name": name, "file": file, "size": len(content), "sha256": hashlib.sha256(content).hexdigest()})
        listing = f"{mine}/files.jsonl"
        _write(where, listing, "".join(json.dumps(x) + "\n" for x in listed).encode())
        return Written(listing, len(listed))

    def commit(self, messages: list[Written | None]) -> None:
        where, root = file_system(self.path)
        told = {"job": self.job, "files": sum(m.files for m in messages if m), "listings": sorted(m.listing for m in messages if m)}
        new = f"{root}/job-{self.job}/{COMMITTED}"
        _write(where, new, json.dumps(told).encode())
        where.move(new, f"{root}/{COMMITTED}")

    def abort(self, messages: list[Written | None]) -> None:
        where, root = file_system(self.path)
        if where.get_file_info(f"{root}/job-{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/job-{self.job}")


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"])


def write(rows: DataFrame, path: str) -> None:
    """Write ``rows`` (frame, name, content; other columns are not written) in
    place of what was committed at ``path`` before.  A frame's files are written
    by one task, so that a name that stands twice is an error; so is a NULL
    frame or a name that is no plain file name.  NULL content is an empty file;
    an empty table commits no file.  Files are small but dear to write, so frames
    are dealt to as many tasks as the session shuffles into, whatever their bytes."""
    rows.sparkSession.dataSource.register(Artifacts)
    dealt = rows.select(F.col("frame").cast("long").alias("frame"), F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).repartition(parts_of(rows.sparkSession), "frame")
    dealt.write.format("artifacts").mode("overwrite").option("path", path).save()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(frame, name, file, size, sha256) of the files last committed."""
    where, root = file_system(path.rstrip("/"))
    if where.get_file_info(f"{root}/{COMMITTED}").type != fs.FileType.File:
        return spark.createDataFrame([], LISTED)
    with where.open_input_stream(f"{root}/{COMMITTED}") as f:
        told = json.loads(f.read())
    scheme = path.split(root, 1)[0] if root in path else ""
    return spark.read.schema(LISTED).json([scheme + x for x in told["listings"]]) if told["listings"] else spark.createDataFrame([], LISTED)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(frame, name, content) of the files last committed; one whose bytes are
    not those that were written is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = file_system(path)
        for pdf in batches:
            content = []
            for file, digest in zip(pdf["file"], pdf["sha256"], strict=True):
                with where.open_input_stream(file) as f:
                    content.append(f.read())
                if hashlib.sha256(content[-1]).hexdigest() != digest:
                    raise ValueError(f"{file} was changed")
            yield pd.DataFrame({"frame": pdf["frame"], "name": pdf["name"], "content": content})

    return listed(spark, path).repartition(parts_of(spark), "file").mapInPandas(run, SCHEMA)
