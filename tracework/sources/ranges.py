"""Random access to lines of text files by byte offsets: an index of lines, and reads of single lines by range.

The index is dealt by ranges of (file, offset), so a task opens few files and goes through each in one direction. It reads
blocks that begin small and double until the line ends; what the next line has in common with a block is not read
again. So the bytes read follow the lines asked for, not the files' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The first block of a read.
BLOCK = 4_096
#: Schemes whose files a task can open by itself.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs")


def indexed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, offset, line) of every line of text files under one or more paths. Lines end with \\n. Of each block that Spark reads a
    file in, the bytes of its lines are summed; the blocks before it give its start."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"),
        "value", (F.octet_length("value") + 1).cast("long").alias("size"),
    )
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("size").alias("bytes")).select("file", "block", F.coalesce(F.sum("bytes").over(before("file", "block")), F.lit(0)).alias("start"))
    within = lines.withColumn("at", F.coalesce(F.sum("size").over(before("file", "block", "n")), F.lit(0)))
    return within.join(blocks, ["file", "block"]).select("file", (F.col("start") + F.col("at")).alias("offset"), F.col("value").alias("line"))


class LineReader:
    """Lines of one open file by their offsets, in rising order; read tells the bytes read so far."""

    def __init__(self, handle) -> None:
        self.handle = handle
        self.start, self.data, self.read = 0, b"", 0

    def _more(self, size: int) -> bool:
        found = self.handle.read(size)
        self.read += len(found)
        self.data += found
        return bool(found)

    def line(self, offset: int) -> bytes | None:
        """The line that begins there, without its end; None at the end of the file, or before its start."""
        if offset < 0:
            return None
        if self.start <= offset < self.start + len(self.data):
            self.data, self.start = self.data[offset - self.start :], offset
        else:
            self.handle.seek(offset)
            self.data, self.start = b"", offset
        size, looked = BLOCK, 0
        while (end := self.data.find(b"\n", looked)) < 0:
            looked = len(self.data)
            if not self._more(size):
                return self.data or None
            size *= 2
        return self.data[:end]


def _opened(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def _full_uri(uri: str) -> str:
    """Spark writes file:/x for local files, others want file:///x."""
    return "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def readable(places: DataFrame) -> bool:
    """Whether tasks can open all files that places(file) names by themselves."""
    kinds = places.select(F.regexp_extract("file", "^([A-Za-z][A-Za-z0-9+.-]*):", 1).alias("scheme")).distinct()
    return all(r["scheme"] in ("", *SCHEMES) for r in kinds.limit(len(SCHEMES) + 2).collect())


def lines_at(places: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of places(file, offset, ...) with the line that begins at each, and the bytes that reading it took. Equal
    places share a read; a place behind a file's end, and a null one, have a null line; bytes that are no UTF-8 are
    replaced; a missing file is an error."""
    n = partitions or places.sparkSession.sparkContext.defaultParallelism
    dealt = places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    schema = T.StructType([*places.schema.fields, T.StructField("line", T.StringType()), T.StructField("bytes_read", T.LongType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        name = reader = last = None
        try:
            for batch in batches:
                lines, sizes = [], []
                files, offsets = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset"))
                for file, offset in zip(files, offsets, strict=True):
                    if file is None or offset is None:
                        lines.append(None)
                        sizes.append(0)
                        continue
                    if file != name:
                        if reader is not None:
                            reader.handle.close()
                        name, reader, last = file, LineReader(_opened(_full_uri(file))), (None, None)
                    before = reader.read
                    if last[0] != offset:
                        found = reader.line(offset)
                        last = (offset, None if found is None else found.decode("utf-8", "replace"))
                    lines.append(last[1])
                    sizes.append(reader.read - before)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.string()), pa.array(sizes, pa.int64())], [*batch.schema.names, "line", "bytes_read"])
        finally:
            if reader is not None:
                reader.handle.close()

    return dealt.mapInArrow(run, schema)
