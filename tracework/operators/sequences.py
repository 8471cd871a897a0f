"""Ordered-sequence operators over an event log (trace, ts, event_id, activity).

Order inside a trace is (ts, event_id), so ties are settled and results don't depend on the input's order. Everything
is partitioned by trace: one shuffle, which all operators of one plan share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]


def in_trace() -> Window:
    return Window.partitionBy("trace").orderBy(*ORDER)


def event_log(events: DataFrame) -> DataFrame:
    """A trace is what one user did on one day."""
    return events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace"),
        "user_id", "ts", "event_id", F.col("event_type").alias("activity"),
    )


def collapsed(log: DataFrame) -> DataFrame:
    """Without consecutive repeats of an activity."""
    before = F.lag("activity").over(in_trace())
    return log.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("activity"))).drop("_b")


def paths(log: DataFrame, *keys: str) -> DataFrame:
    """(trace, keys, path): the activities of each trace in order."""
    steps = F.array_sort(F.collect_list(F.struct(*ORDER, "activity")))
    return log.groupBy("trace", *keys).agg(F.transform(steps, lambda s: s["activity"]).alias("path"))


def variants(log: DataFrame, k: int | None = None) -> DataFrame:
    """(variant, n), most frequent first; ties by variant. k: the first k only."""
    counted = paths(log).groupBy(F.array_join("path", ">").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "variant").limit(k) if k else counted


def pairs(log: DataFrame) -> DataFrame:
    """(trace, src, dst): consecutive activities."""
    return log.select("trace", F.col("activity").alias("src"), F.lead("activity").over(in_trace()).alias("dst")).where("dst IS NOT NULL")


def dfg(log: DataFrame) -> DataFrame:
    """Directly-follows graph (src, dst, n)."""
    return pairs(log).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def trace_count(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("trace").alias("traces"))


def edge_frequency(log: DataFrame) -> DataFrame:
    """(src, dst, weight): occurrences of a pair, repeats included, over the number of traces; may exceed 1."""
    return _over_traces(dfg(log), log)


def edge_containment(log: DataFrame) -> DataFrame:
    """(src, dst, weight): the share of traces that contain the pair."""
    return _over_traces(pairs(log).distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), log)


def _over_traces(counted: DataFrame, log: DataFrame) -> DataFrame:
    # one row joined to the few rows of a graph
    return counted.join(F.broadcast(trace_count(log)), F.lit(True)).select("src", "dst", (F.col("n") / F.col("traces")).alias("weight"))


def normalised(edges: DataFrame, weight: str = "n") -> DataFrame:
    """(src, dst, p): weights over the sum of their source's; sources that sum to zero are left out."""
    total = F.sum(weight).over(Window.partitionBy("src"))
    return edges.withColumn("_t", total).where("_t > 0").select("src", "dst", (F.col(weight) / F.col("_t")).alias("p"))


def entropy(probabilities: DataFrame) -> DataFrame:
    """(src, bits) of each source's next-step distribution."""
    return probabilities.where("p > 0").groupBy("src").agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"))


def divergence(counts: DataFrame) -> DataFrame:
    """(left, right, bits): Jensen-Shannon divergence between the groups of counts(grp, item, n), for each pair."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).select("grp", "item", "p")
    a, b = p.toDF("left", "item", "p"), p.toDF("right", "item", "q")
    both = a.join(b, "item").where("left < right").groupBy("left", "right").agg(
        # items of one side only add p / 2 bits each: 1 in all, less what the shared ones take away
        (1 + F.sum(0.5 * (F.col("p") * F.log2(F.col("p") / (F.col("p") + F.col("q"))) + F.col("q") * F.log2(F.col("q") / (F.col("p") + F.col("q")))))).alias("bits")
    )
    groups = p.select("grp").distinct()
    every = groups.toDF("left").join(groups.toDF("right"), F.col("left") < F.col("right"))
    return every.join(both, ["left", "right"], "left").select("left", "right", F.coalesce("bits", F.lit(1.0)).alias("bits"))


def positions(log: DataFrame) -> DataFrame:
    """Position of each event in its trace, from 0."""
    return log.withColumn("position", F.row_number().over(in_trace()) - 1)


def log_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.countDistinct("trace").alias("traces"), F.count(F.lit(1)).alias("events"),
        F.count("ts").alias("dated"), F.countDistinct("activity").alias("activities"),
    )


def relabelled(log: DataFrame, levels: DataFrame) -> DataFrame:
    """Activities at a coarser level: levels(activity, coarse), a vocabulary; unknown ones keep their name."""
    return log.join(levels, "activity", "left").withColumn("activity", F.coalesce("coarse", "activity")).drop("coarse")


def cross_case_classes(log: DataFrame) -> DataFrame:
    """(activity, traces, fundamental, is_variant, is_unique): in all traces, some, or one."""
    by = log.select("trace", "activity").distinct().groupBy("activity").agg(F.count(F.lit(1)).alias("traces"))
    n = trace_count(log).withColumnRenamed("traces", "all_traces")
    return by.join(F.broadcast(n), F.lit(True)).select(
        "activity", "traces", (F.col("traces") == F.col("all_traces")).alias("fundamental"),
        ((F.col("traces") > 1) & (F.col("traces") < F.col("all_traces"))).alias("is_variant"), (F.col("traces") == 1).alias("is_unique"),
    )


def goal_so_far(log: DataFrame, goal: str) -> DataFrame:
    """Whether the goal was reached before each event."""
    before = in_trace().rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("reached", F.coalesce(F.max(F.col("activity") == goal).over(before), F.lit(False)))


def date_bounds(text: Column) -> tuple[Column, Column]:
    """First and last day of a "YYYY-MM" or "YYYY-MM-DD" text."""
    month = F.length(text) == 7
    first = F.to_date(F.when(month, F.concat(text, F.lit("-01"))).otherwise(text))
    return first, F.when(month, F.last_day(first)).otherwise(first)


def precision(text: Column) -> Column:
    return F.when(F.length(text) == 7, "month").when(F.length(text) == 10, "day").otherwise("none")


def in_date_order(dated: DataFrame, key: str, order: list[str], date: str) -> DataFrame:
    """(key, dated, in_order): null for fewer than two dates; months count as their first day; ties are in order."""
    first = date_bounds(F.col(date))[0]
    w = Window.partitionBy(key).orderBy(*order)
    steps = dated.where(F.col(date).isNotNull()).withColumn("_d", first)
    steps = steps.withColumn("_ok", F.coalesce(F.col("_d") >= F.lag("_d").over(w), F.lit(True)))
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("dated"), F.when(F.count(F.lit(1)) >= 2, F.min("_ok")).alias("in_order"))


def procedure_departures(events: DataFrame, precedence: DataFrame) -> DataFrame:
    """(case, departure, first, second) of events(case, kind, date) with precedence(earlier, later): "order" when a later
    step is dated wholly before an earlier one (months cover their days), "repeat" for one step on two dates that don't
    overlap. Missing
    steps are no departures."""
    lo, hi = date_bounds(F.col("date"))
    spans = events.where("date IS NOT NULL").select("case", "kind", lo.alias("lo"), hi.alias("hi")).distinct()
    a = spans.select("case", F.col("kind").alias("first"), F.col("lo").alias("first_lo"))
    b = spans.select("case", F.col("kind").alias("second"), F.col("hi").alias("second_hi"))
    order = (
        a.join(F.broadcast(precedence), F.col("first") == F.col("earlier")).join(b, "case")
        .where("second = later AND second_hi < first_lo").select("case", F.lit("order").alias("departure"), "first", "second").distinct()
    )
    # a repeat: two dates of one step that can't be one day; dates that overlap are one. The least last day lies before the
    # greatest first day exactly if two of the spans don't overlap
    apart = spans.groupBy("case", "kind").agg(F.min("hi").alias("least"), F.max("lo").alias("greatest")).where("least < greatest")
    repeat = apart.select("case", F.lit("repeat").alias("departure"), F.col("kind").alias("first"), F.col("kind").alias("second"))
    return order.unionByName(repeat)


def both_outcomes(events: DataFrame, one: str, other: str, departure: str) -> DataFrame:
    """Cases that have two steps which exclude each other."""
    return (
        events.groupBy("case").agg(F.max(F.col("kind") == one).alias("a"), F.max(F.col("kind") == other).alias("b")).where("a AND b")
        .select("case", F.lit(departure).alias("departure"), F.lit(one).alias("first"), F.lit(other).alias("second"))
    )
