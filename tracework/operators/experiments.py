"""Null experiments on an event log: what is measured beside the same measure on shuffled data.

All shuffles are permutations drawn from MD5 sums of names, draw and seed, so that they are the same for any order or
partitioning of the input, and exact: a label is dealt as often as it stands in the data. Ranks are numbered within
hash buckets and offset by the buckets before, so that no task holds a whole draw.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.operators import sequences as S
from tracework.session import small


def drawn(name: Column, draw: Column, seed: int) -> Column:
    """32 hex digits that order the names of a draw."""
    return F.md5(F.concat_ws("|", name.cast("string"), draw.cast("string"), F.lit(str(seed))))


def shuffled_labels(traces: DataFrame, group: str, draws: int, seed: int = 7) -> DataFrame:
    """(draw, trace, grp): the labels of traces(trace, group) dealt anew among the traces, in each of the draws."""
    each = traces.select("trace", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    each = each.withColumn("_h", drawn(F.col("trace"), F.col("draw"), seed)).withColumn("_b", F.substring("_h", 1, 2))
    # 256 buckets of each draw: a size fixed by parameters
    before = Window.partitionBy("draw").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.groupBy("draw", "_b").agg(F.count(F.lit(1)).alias("n")).select("draw", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("draw", "_b").orderBy("_h", "trace"))
    ranked = each.join(F.broadcast(offsets), ["draw", "_b"]).select("draw", "trace", (F.col("_o") + inside).alias("_i"))
    # the i-th trace takes the i-th label in their order; labels are groups of a comparison, so they are few
    upto = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    labels = traces.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n")).select("grp", F.sum("n").over(upto).alias("_last"), "n")
    met = ranked.join(small(labels), (F.col("_i") <= F.col("_last")) & (F.col("_i") > F.col("_last") - F.col("n")))
    return met.select("draw", "trace", "grp")


def items_of(log: DataFrame, what: str = "steps") -> DataFrame:
    """(trace, item, n): the steps of each trace, or its transitions."""
    if what == "steps":
        rows = log.select("trace", F.col("activity").alias("item"))
    else:
        rows = S.pairs(log).select("trace", F.concat_ws(">", "src", "dst").alias("item"))
    return rows.groupBy("trace", "item").agg(F.count(F.lit(1)).alias("n"))


def compared(log: DataFrame, group: str, what: str = "steps", draws: int = 20, seed: int = 7) -> DataFrame:
    """(mean_bits, shuffled_bits, above_shuffled): the mean divergence between the groups of a log's traces, and the mean
    of the same over draws with shuffled labels."""
    traces = log.groupBy("trace").agg(F.min(group).alias("grp"))
    items = items_of(log, what)
    own = traces.select(F.lit(-1).alias("draw"), "trace", "grp").unionByName(shuffled_labels(traces, "grp", draws, seed))
    counts = own.join(items, "trace").groupBy("draw", "grp", "item").agg(F.sum("n").alias("n"))
    p = counts.select("draw", "grp", "item", (F.col("n") / F.sum("n").over(Window.partitionBy("draw", "grp"))).alias("p"))
    a, b = p.withColumnsRenamed({"grp": "left"}), p.withColumnsRenamed({"grp": "right", "p": "q"})
    p_, q_ = F.col("p"), F.col("q")
    # what two groups share takes away from one bit; groups that share nothing have no row, and a bit
    less = F.sum(0.5 * (p_ * F.log2(p_ / (p_ + q_)) + q_ * F.log2(q_ / (p_ + q_))))
    pairs = a.join(b, ["draw", "item"]).where("left < right").groupBy("draw", "left", "right").agg((1 + less).alias("bits"))
    k = p.groupBy("draw").agg(F.countDistinct("grp").alias("k"))
    by = pairs.groupBy("draw").agg(F.sum(1 - F.col("bits")).alias("gain")).join(k, "draw", "right")
    mean = by.where("k > 1").select("draw", (1 - F.coalesce("gain", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1) / 2)).alias("bits"))
    both = mean.agg(F.max(F.when(F.col("draw") < 0, F.col("bits"))).alias("mean_bits"), F.avg(F.when(F.col("draw") >= 0, F.col("bits"))).alias("shuffled_bits"))
    return both.withColumn("above_shuffled", F.col("mean_bits") - F.col("shuffled_bits"))


def compared_levels(logs: dict[str, DataFrame], group: str, draws: int = 20, seed: int = 7) -> DataFrame:
    """compared() for each level's log, steps and transitions: (level, what, mean_bits, shuffled_bits, above_shuffled)."""
    found = None
    for level, log in logs.items():
        for what in ("steps", "transitions"):
            part = compared(log, group, what, draws, seed).select(F.lit(level).alias("level"), F.lit(what).alias("what"), "*")
            found = part if found is None else found.unionByName(part)
    return found


def conditional_entropy(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, bits): the entropy of the next step given the step, of edges(keys, src, dst, n)."""
    over = Window.partitionBy(*keys, "src")
    every = edges.withColumn("t", F.sum("n").over(over))
    bits = F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))) / F.sum("n")
    return every.groupBy(*keys).agg(bits.alias("bits")) if keys else every.agg(bits.alias("bits"))


def order_null(log: DataFrame, draws: int = 20, seed: int = 7) -> DataFrame:
    """(bits, shuffled_bits, below_shuffled): how uncertain the next step is, in the order told and with the steps of each
    trace in a shuffled order."""
    each = log.select("trace", "event_id", "activity", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    order = Window.partitionBy("draw", "trace").orderBy(drawn(F.col("event_id"), F.col("draw"), seed), "event_id")
    mixed = each.select("draw", F.col("activity").alias("src"), F.lead("activity").over(order).alias("dst")).where("dst IS NOT NULL")
    null = conditional_entropy(mixed.groupBy("draw", "src", "dst").agg(F.count(F.lit(1)).alias("n")), "draw").agg(F.avg("bits").alias("shuffled_bits"))
    own = conditional_entropy(S.dfg(log))
    return own.crossJoin(F.broadcast(null)).withColumn("below_shuffled", F.col("shuffled_bits") - F.col("bits"))  # one row each


def grouping_information(edges: DataFrame, grouping: DataFrame, *keys: str) -> DataFrame:
    """(keys, bits): what the group of a step tells of the group of the next one, of edges(src, dst, n) with
    grouping(keys, activity, grp), a vocabulary."""
    g = small(grouping)
    at = edges.join(g.select(*keys, F.col("activity").alias("src"), F.col("grp").alias("a")), "src")
    on = g.select(*keys, F.col("activity").alias("dst"), F.col("grp").alias("b"))
    by = at.join(on, [*keys, "dst"]).groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"))
    total, of_a, of_b = (F.sum("n").over(Window.partitionBy(*(list(keys) or [F.lit(0)]), *c)) for c in ([], ["a"], ["b"]))
    every = by.select(*keys, "n", total.alias("t"), of_a.alias("x"), of_b.alias("y"))
    bits = F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("x") * F.col("y"))))
    return every.groupBy(*keys).agg(bits.alias("bits")) if keys else every.agg(bits.alias("bits"))


def groupings_beside_random(edges: DataFrame, groupings: DataFrame, draws: int = 20, seed: int = 7) -> DataFrame:
    """(name, bits, random_bits, above_random) of groupings(name, activity, grp): each beside random ones with groups of
    the same sizes. Groupings are vocabularies."""
    each = groupings.select("name", "activity", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    places = Window.partitionBy("name", "draw").orderBy(drawn(F.concat_ws("/", "name", "activity"), F.col("draw"), seed), "activity")
    dealt = each.withColumn("_i", F.row_number().over(places))
    slots = groupings.select("name", "grp", F.row_number().over(Window.partitionBy("name").orderBy("grp", "activity")).alias("_i"))
    null = dealt.join(small(slots), ["name", "_i"]).select("name", "draw", "activity", "grp")
    own = groupings.select("name", F.lit(-1).alias("draw"), "activity", "grp")
    bits = grouping_information(edges, own.unionByName(null), "name", "draw")
    both = bits.groupBy("name").agg(F.max(F.when(F.col("draw") < 0, F.col("bits"))).alias("bits"), F.avg(F.when(F.col("draw") >= 0, F.col("bits"))).alias("random_bits"))
    return both.withColumn("above_random", F.col("bits") - F.col("random_bits"))


def learned_grouping(edges: dict[tuple[str, str], float], groups: int) -> dict[str, int]:
    """Activities with alike next steps in one group: the two groups with the least divergence are joined until `groups`
    are left; ties by name. For a collected graph of a vocabulary."""
    names = sorted({s for e in edges for s in e})
    at = {s: i for i, s in enumerate(names)}
    n = np.zeros((len(names), len(names)))
    for (a, b), w in edges.items():
        n[at[a], at[b]] = w
    held = [[i] for i in range(len(names))]

    def apart(x: list[int], y: list[int]) -> float:
        p, q = (n[z].sum(0) / max(n[z].sum(), 1e-300) for z in (x, y))
        m = (p + q) / 2
        return sum(0.5 * float((v[v > 0] * np.log2(v[v > 0] / m[v > 0])).sum()) for v in (p, q))

    while len(held) > groups:
        _, i, j = min((round(apart(x, y), 12), i, j) for i, x in enumerate(held) for j, y in enumerate(held) if i < j)
        held[i] = sorted(held[i] + held.pop(j))
        held.sort()
    return {names[i]: g for g, own in enumerate(held) for i in own}


def invariance(log: DataFrame, group: str, draws: int = 20, seed: int = 7) -> DataFrame:
    """(draw, bits, paired): how much the group of a trace tells of its next step, given the step, in the log (draw -1) and
    in draws with shuffled labels; paired is the log's bits less the draw's, null for the log itself. Steps that obey one
    law in all groups have bits as small as the draws'."""
    traces = log.groupBy("trace").agg(F.min(group).alias("grp"))
    own = traces.select(F.lit(-1).alias("draw"), "trace", "grp").unionByName(shuffled_labels(traces, "grp", draws, seed))
    steps = S.pairs(log).groupBy("trace", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    counts = own.join(steps, "trace").groupBy("draw", "grp", "src", "dst").agg(F.sum("n").alias("n"))
    apart = conditional_entropy(counts.groupBy("draw", "src", "dst").agg(F.sum("n").alias("n")), "draw").withColumnRenamed("bits", "_all")
    within = conditional_entropy(counts.select("draw", F.struct("grp", "src").alias("src"), "n"), "draw")
    bits = apart.join(within, "draw").select("draw", (F.col("_all") - F.col("bits")).alias("bits"))
    told = bits.where("draw < 0").select(F.col("bits").alias("_own"))
    return bits.crossJoin(F.broadcast(told)).select("draw", "bits", F.when(F.col("draw") >= 0, F.col("_own") - F.col("bits")).alias("paired"))  # one row


#: Halvings of the range in which a beta is looked for.
HALVINGS = 48


def rationalities(choices: DataFrame, most: float = 50.0, *keys: str) -> DataFrame:
    """(keys, beta) of choices(keys, src, dst, v, n): the beta, from 0 to `most`, under which the counted choices are
    likeliest, a choice's probability being in proportion to exp(beta times its worth v) among those of its state src. n
    may be zero for what could have been chosen. The likelihood is concave, so halving the sign change of its slope
    finds it; 0 where nothing is chosen for its worth. The choices of a machine are a vocabulary: those of one key are
    one array, and all keys are fitted at once, natively."""
    by_state = choices.groupBy(*keys, "src").agg(F.array_sort(F.collect_list(F.struct("dst", F.col("v").cast("double").alias("v"), F.col("n").cast("double").alias("n")))).alias("o"))
    states = by_state.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("src", "o"))).alias("s"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))

    def slope(beta: Column) -> Column:
        def of(state: Column) -> Column:
            o, top = state["o"], F.array_max(F.transform(state["o"], lambda c: c["v"]))
            weight = lambda c: F.exp(beta * (c["v"] - top))
            expected = total(o, lambda c: weight(c) * c["v"]) / total(o, weight)
            return total(o, lambda c: c["n"] * c["v"]) - total(o, lambda c: c["n"]) * expected

        return total(F.col("s"), of)

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        up = slope(middle) > 0
        return F.struct(F.when(up, middle).otherwise(acc["low"]).alias("low"), F.when(up, acc["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(float(most)).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)
    beta = F.when(slope(F.lit(0.0)) <= 0, 0.0).when(slope(F.lit(float(most))) >= 0, float(most)).otherwise((found["low"] + found["high"]) / 2)
    return states.select(*keys, beta.alias("beta"))


def rationality_null(log: DataFrame, worth: DataFrame, draws: int = 20, seed: int = 7, most: float = 50.0) -> DataFrame:
    """(draw, beta, paired): how much steps are chosen for the worth of where they lead, worth(dst, v) being a vocabulary, in
    the order told (draw -1) and in draws with the steps of each trace in a shuffled order; paired is the told order's beta
    less the draw's. Every step of the vocabulary may follow every one."""
    each = log.select("trace", "event_id", "activity", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    order = Window.partitionBy("draw", "trace").orderBy(drawn(F.col("event_id"), F.col("draw"), seed), "event_id")
    mixed = each.select("draw", F.col("activity").alias("src"), F.lead("activity").over(order).alias("dst")).where("dst IS NOT NULL")
    counts = mixed.groupBy("draw", "src", "dst").agg(F.count(F.lit(1)).alias("n")).unionByName(S.dfg(log).select(F.lit(-1).alias("draw"), "src", "dst", "n"))
    # what could be chosen: each state of a draw with the whole vocabulary, as one array beside it
    vocabulary = worth.agg(F.collect_list(F.struct("dst", "v")).alias("w"))
    options = counts.select("draw", "src").distinct().crossJoin(F.broadcast(vocabulary)).select("draw", "src", F.explode("w").alias("w")).select("draw", "src", "w.dst", "w.v")  # one row
    choices = options.join(counts, ["draw", "src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    betas = rationalities(choices, most, "draw")
    told = betas.where("draw < 0").select(F.col("beta").alias("_own"))
    return betas.crossJoin(F.broadcast(told)).select("draw", "beta", F.when(F.col("draw") >= 0, F.col("_own") - F.col("beta")).alias("paired"))  # one row


def rationality(counts: dict[tuple[str, str], float], worth: dict[tuple[str, str], float], most: float = 50.0) -> float:
    """The beta, from 0 to `most`, under which the counted choices are likeliest, a choice's probability being in
    proportion to exp(beta times its worth) among those of its state. The likelihood is concave, so halving the sign
    change of its slope finds it; 0 where nothing is chosen for its worth."""
    states: dict[str, list[tuple[float, float]]] = {}
    for (src, dst), v in worth.items():
        states.setdefault(src, []).append((v, counts.get((src, dst), 0.0)))

    def slope(beta: float) -> float:
        total = 0.0
        for options in states.values():
            v, n = (np.array(x) for x in zip(*options, strict=True))
            p = np.exp(beta * (v - v.max()))
            total += float(n @ v - n.sum() * (p @ v) / p.sum())
        return total

    low, high = 0.0, most
    if slope(low) <= 0:
        return low
    if slope(high) >= 0:
        return high
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return math.fsum((low, high)) / 2
