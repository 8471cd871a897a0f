"""Files that are visible only when their job is over."""

import glob
import hashlib
import os
import subprocess
import sys

import pytest

from tracework.sources import committed

FILES = [(f"n{i}", bytes([i]) * (i * 7)) for i in range(20)] + [("empty", b""), ("none", None)]


def told(rows):
    return sorted((n, len(d or b""), hashlib.sha256(d or b"").hexdigest()) for n, d in rows)


def seen(spark, path):
    return sorted((r["name"], r["byte_length"], r["content_sha256"]) for r in committed.read_files(spark, path).collect())


def test_files_and_side_cars(spark, tmp_path):
    path = str(tmp_path / "files")
    assert committed.read_files(spark, path).count() == 0
    committed.write_files(spark.createDataFrame(FILES, "name string, data binary").repartition(3), path)
    assert seen(spark, path) == told(FILES)
    for r in committed.read_files(spark, path).collect():
        data = open(f"{path}/{r['file']}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == r["content_sha256"] and os.path.exists(f"{path}/{r['file']}.provenance.json")
    committed.write_files(spark.createDataFrame([("n3", FILES[3][1]), ("n3", b"changed"), ("late", b"x")], "name string, data binary"), path)
    assert seen(spark, path) == sorted(told(FILES) + told([("n3", b"changed"), ("late", b"x")]))


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "files")

    def broken(batches):
        yield from batches
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        committed.write_files(spark.createDataFrame(FILES, "name string, data binary").mapInArrow(broken, "name string, data binary"), path)
    assert seen(spark, path) == [] and not glob.glob(f"{path}/manifests/*")


def test_an_attempt_that_is_lost_after_its_write(tmp_path, spark):
    """What the first attempt wrote is there until the commit, is never seen, and is gone after it."""
    path = str(tmp_path / "files")
    writer, rows = committed.FileWriter(path), [{"name": n, "data": d} for n, d in FILES]
    writer.write(iter(rows))  # its message never arrives
    part = writer.write(iter(rows))
    assert len(glob.glob(f"{path}/data/*/*")) == 2 and seen(spark, path) == []
    writer.commit([part, None])
    assert len(glob.glob(f"{path}/data/*/*")) == 1 and seen(spark, path) == told(FILES)


KILLED = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tracework.sources import committed

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

def once(batches):
    yield from batches
    if TaskContext.get().attemptNumber() == 0:
        os._exit(9)  # the executor is lost when all rows have gone to the writer

rows = spark.range(40).selectExpr("CAST(id AS STRING) AS name", "CAST(repeat('x', CAST(id AS INT)) AS BINARY) AS data").repartition(2)
committed.write_files(rows.mapInArrow(once, "name string, data binary"), sys.argv[1])
print("rows", committed.read_files(spark, sys.argv[1]).count())
"""


def test_a_task_that_is_killed_before_the_commit(tmp_path):
    path = str(tmp_path / "files")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run([sys.executable, "-c", KILLED, path], env=env, capture_output=True, text=True, timeout=180)
    assert "rows 40" in run.stdout, run.stderr[-2000:]
    assert len([f for f in glob.glob(f"{path}/data/*/*/*") if not f.endswith((".json", ".jsonl"))]) == 40
