"""Joins of windows with marks of the same key, whose work follows the rows and the result, not the square of a key's rows.

* inside: each window falls to the level of its length's power of two and there to at most two bins, a mark to one bin of
  each level that occurs (64 at most). Windows and marks meet by key, level and bin, so a hot key is dealt over its bins.
* nearest: one order of all windows and marks, dealt in ranges of (key, place), so that a hot key is spread over tasks.
  Within a range the last and the next mark of each place are running values; what a range lacks comes from the ranges
  before and behind it, of which only the first and the last mark of each key travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracework.session import cut


def inside(windows: DataFrame, marks: DataFrame, key: str = "record_id", begin: str = "begin", end: str = "end", pos: str = "pos", level: int | None = None) -> DataFrame:
    """windows joined with the marks of equal key whose pos lies in [begin, end); whole numbers. Empty windows and nulls
    match nothing; repeated rows of either side each match. Where windows are known to be about 2 ** level long, bins have
    that length, and no job asks for the levels."""
    # the bits of the length less one, so that 2 ** level reaches over it
    own = F.when(F.col(end) - F.col(begin) > 1, F.length(F.bin((F.col(end) - F.col(begin) - 1).cast("long")))).otherwise(0)
    levelled = windows.where(F.col(end) > F.col(begin)).withColumn("_level", own if level is None else F.lit(level))
    levels = [level] if level is not None else sorted(r[0] for r in levelled.select("_level").distinct().collect())  # 64 at most
    at = lambda x: f"shiftright(CAST({x} AS BIGINT), _level)"
    binned = levelled.withColumn("_bin", F.explode(F.expr(f"sequence({at(begin)}, {at(f'({end} - 1)')})")))
    each = marks.where(F.col(pos).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", F.expr(at(pos)))
    met = binned.join(each, [key, "_level", "_bin"]).where((F.col(pos) >= F.col(begin)) & (F.col(pos) < F.col(end)))
    return met.drop("_level", "_bin")


def nearest(acts: DataFrame, marks: DataFrame, key: str = "record_id", ranges: int | None = None) -> DataFrame:
    """(key, act, value) of every row of acts(key, act, at, begin, end): the mark of marks(key, pos, value) in [begin, end)
    nearest to at; of two as near the first, of marks at one place the least value, null first; null if there is none."""
    n = ranges or int(acts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = marks.where(F.col("pos").isNotNull()).groupBy(key, F.col("pos").alias("place")).agg(F.min(F.struct(F.col("value").alias("value"))).alias("v"))
    held = one.select(key, "place", F.lit(0).alias("kind"), F.lit(None).cast(acts.schema["act"].dataType).alias("act"), F.struct(F.col("place").alias("pos"), F.col("v.value").alias("value")).alias("mark"))
    window = acts.where("end > begin AND at IS NOT NULL")
    none = F.lit(None).cast(held.schema["mark"].dataType).alias("mark")
    # behind the marks at the last place that may count before, and ahead of those at the first that may after
    before = window.select(key, F.least(F.col("at"), F.col("end") - 1).alias("place"), F.lit(1).alias("kind"), "act", none, "at", "begin", "end")
    after = window.select(key, F.greatest(F.col("at") + 1, F.col("begin")).alias("place"), F.lit(-1).alias("kind"), "act", none, "at", "begin", "end")
    rows = before.unionByName(after).unionByName(held, allowMissingColumns=True)
    dealt = cut(rows.repartitionByRange(n, key, "place", "kind", "act").withColumn("_range", F.spark_partition_id()), "places")

    run = Window.partitionBy("_range", key)
    last = F.last("mark", True).over(run.orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # from behind: a frame that ends with the group would be gone through anew for every row
    following = F.last("mark", True).over(run.orderBy(F.col("place").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = dealt.withColumn("_last", last).withColumn("_next", following).where("kind <> 0")
    ends = dealt.groupBy(key, "_range").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    over = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(key).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.last("hi", True).over(over).alias("_over"), F.last("lo", True).over(behind).alias("_behind"))
    met = own.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")), "left")
    mark = F.when(F.col("kind") == 1, F.coalesce("_last", "_over")).otherwise(F.coalesce("_next", "_behind"))
    found = met.withColumn("mark", mark).where("mark.pos >= begin AND mark.pos < end")
    best = found.groupBy(key, "act").agg(F.min(F.struct(F.abs(F.col("mark.pos") - F.col("at")).alias("far"), F.col("mark.pos").alias("pos"), F.col("mark.value").alias("value"))).alias("m"))
    return acts.select(key, "act").join(best, [key, "act"], "left").select(key, "act", F.col("m.value").alias("value"))
