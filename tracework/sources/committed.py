"""A sink for files with provenance that commits: bytes and a side-car beside each, visible only once the job is over.

Every attempt of a task writes into a folder of its own and lists its files in a part. The job's commit names the parts of
the attempts that succeeded in one manifest, which is put in place by a rename, so readers see all of a job or nothing of
it; what other attempts left behind is deleted. The driver gets the name of a part for each task, never the files.

The folder must be one that tasks can open by themselves (ranges.SCHEMES).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tracework.sources.ranges import _full_uri

FORMAT = "committed_files"
ROWS = "name string, file string, byte_length long, content_sha256 string"


def _store(path: str):
    from pyarrow import fs

    path = _full_uri(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """An attempt that succeeded."""

    attempt: str


class FileWriter(DataSourceWriter):
    """Rows (name, data) of one job."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Part:
        store, root = _store(self.path)
        attempt = uuid.uuid4().hex
        folder = f"{root}/data/{self.job}/{attempt}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/part.jsonl") as listed:
            for n, row in enumerate(iterator):
                data = b"" if row["data"] is None else bytes(row["data"])
                told = {"name": row["name"], "file": f"data/{self.job}/{attempt}/{n:08d}", "byte_length": len(data), "content_sha256": hashlib.sha256(data).hexdigest()}
                with store.open_output_stream(f"{root}/{told['file']}") as out:
                    out.write(data)
                with store.open_output_stream(f"{root}/{told['file']}.provenance.json") as out:
                    out.write(json.dumps(told).encode())
                listed.write(json.dumps(told).encode() + b"\n")
        return Part(attempt)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        kept = sorted(m.attempt for m in messages if m is not None)
        for found in store.get_file_info(fs.FileSelector(f"{root}/data/{self.job}", allow_not_found=True)):
            if found.base_name not in kept:
                store.delete_dir(found.path)
        store.create_dir(f"{root}/manifests", recursive=True)
        hidden = f"{root}/manifests/.{self.job}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps({"job": self.job, "attempts": kept}).encode() + b"\n")
        store.move(hidden, f"{root}/manifests/{self.job}.json")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/data/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/data/{self.job}")


class CommittedFiles(DataSource):
    """spark.write.format("committed_files").option("path", folder): rows (name string, data binary)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write files(name, data) below a folder, each with its side-car; a null is no bytes. A retried or speculated task
    leaves no second copy, and a job that fails leaves nothing that is read."""
    files.sparkSession.dataSource.register(CommittedFiles)
    files.select("name", "data").write.format(FORMAT).option("path", path).mode("append").save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, byte_length, content_sha256) of what jobs have committed below a folder; file is relative to it. Equal
    files of one name are one row, of the first job by its name."""
    store, root = _store(path.rstrip("/"))
    from pyarrow import fs

    parts = []
    for found in store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
        if found.base_name.endswith(".json") and not found.base_name.startswith("."):
            with store.open_input_stream(found.path) as data:
                told = json.loads(data.read())
            parts += [f"{path.rstrip('/')}/data/{told['job']}/{a}/part.jsonl" for a in told["attempts"]]
    if not parts:
        return spark.createDataFrame([], ROWS)
    lines = spark.read.text(parts).select(F.from_json("value", ROWS).alias("r")).select("r.*")
    return lines.groupBy("name", "byte_length", "content_sha256").agg(F.min("file").alias("file")).select("name", "file", "byte_length", "content_sha256")
