"""Session helpers shared by the library: table reads and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tracework", cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of fewer bytes are dealt to all cores: such a file is often one row group, which one task would read.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, *order: str) -> DataFrame:
    """A small table in as many partitions as there are cores, with the rows of each in order where columns are given; a
    larger one as it is, since its files make tasks enough and its rows had better stay where they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SPREAD_BYTES:
        return df
    dealt = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return dealt.sortWithinPartitions(*order) if order else dealt


#: Bytes of a table of short rows that one task reads, where each row is made a text that Python reads.
DEALT_BYTES = 1 << 20


def dealt(df: DataFrame, each: int = DEALT_BYTES) -> DataFrame:
    """A table of short rows whose work is in Python, in tasks that stay as short however large it is: its files are few."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each)))


def dealt_by(df: DataFrame, *keys: str, each: int = DEALT_BYTES) -> DataFrame:
    """A table dealt by keys into tasks that stay as large however large it is, and at least as many as there are cores. What
    groups, windows and sorts by these keys and more needs no other shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each)), *keys)


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that cut() wrote in this process.
_written: list[str] = []
#: Where a table that cut() wrote has its path.
WRITTEN = "_tracework_path"


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as Parquet into the shared work folder and read it back: later plans start from the
    written table, so a lost executor costs no recomputation of what stands before it."""
    path = f"{work_dir(df.sparkSession)}/tracework/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(found, WRITTEN, path)
    return found


#: Rows of an Arrow batch when each may hold a whole text.
TEXT_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """df, with the session's Arrow batches held to so many rows, unless they are smaller: for operators that hand whole
    texts to Python, where ten thousand rows, the default, could be gigabytes on both sides."""
    now = int(df.sparkSession.conf.get(_BATCH))
    if not 0 < now <= rows:
        df.sparkSession.conf.set(_BATCH, str(rows))
    return df


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers stay for other tasks, and what their allocators keep
    would count beside the next operator's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: Rows of a dimension that is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def drop_work(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote, once nothing reads them any more."""
    _delete(spark, f"{work_dir(spark)}/tracework")


@contextmanager
def drop_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that cut() writes inside the block, but for those given to keep()."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, WRITTEN, None))
        return df

    yield keep
    for path in [p for p in _written if p not in before and p not in kept]:
        _delete(spark, path)
        _written.remove(path)
