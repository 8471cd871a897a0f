"""Results kept by what was asked and by the version of the data, each a Parquet table in a shared folder."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TTL = 3600


def result_path(root: str, endpoint: str, params: dict, version: str) -> str:
    """One path for equal questions: the order of the parameters doesn't matter."""
    asked = json.dumps([params, version], sort_keys=True, default=str)
    return f"{root.rstrip('/')}/{endpoint}/{hashlib.sha256(asked.encode()).hexdigest()[:24]}"


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cached(spark: SparkSession, root: str, endpoint: str, params: dict, version: str, compute: Callable[[], DataFrame], ttl: float = TTL, now: float | None = None) -> DataFrame:
    """The kept table, if it was finished less than ttl seconds ago; else it is computed and written first."""
    path = result_path(root, endpoint, params, version)
    done, files = _file_system(spark, f"{path}/_SUCCESS")
    fresh = files.exists(done) and (now or time.time()) - files.getFileStatus(done).getModificationTime() / 1000 < ttl
    if not fresh:
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def invalidate(spark: SparkSession, root: str, endpoint: str = "*") -> int:
    """Drop the results of endpoints that match a pattern; how many tables there were."""
    pattern, files = _file_system(spark, f"{root.rstrip('/')}/{endpoint}/*")
    found = files.globStatus(pattern) or []
    for status in found:
        files.delete(status.getPath(), True)
    return len(found)
