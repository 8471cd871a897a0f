"""Window joins against all pairs, and their work on a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from tracework.operators import intervals


def some(rng, n, keys, span):
    acts, marks = [], []
    for i in range(n):
        at = rng.randrange(-span, span)
        begin, end = (at - rng.randrange(span), at + rng.randrange(span)) if rng.random() < 0.8 else (b := rng.randrange(-span, span), b + rng.choice([-1, 0, 1, 2, 4, 5, 1 << 40]))
        acts.append((rng.choice(keys), i // 2 if i % 50 == 0 else i, at, begin, end))
        marks.append((rng.choice(keys), rng.choice([None, rng.randrange(-span, span), rng.randrange(-span, span)]), rng.choice([None, "b", "a"])))
    return acts, marks + marks[:20]


def tables(spark, acts, marks):
    return spark.createDataFrame(acts, "record_id int, act long, at long, begin long, end long"), spark.createDataFrame(marks, "record_id int, pos long, value string")


@pytest.mark.parametrize(("keys", "span", "ranges"), [([1, 2, 3, None], 60, 7), ([1], 1_000_000, 3), (list(range(80)), 8, 1), ([1, 1, 1, 1, 2], 5, 16)])
def test_joins_equal_all_pairs(spark, keys, span, ranges):
    acts, marks = some(random.Random(span), 300, keys, span)
    a, m = tables(spark, acts, marks)
    text = lambda rows: sorted(map(str, rows))
    pairs = [(k, act, at, b, e, p, v) for k, act, at, b, e in acts for q, p, v in marks if k is not None and k == q and p is not None and b <= p < e]
    assert text(tuple(r) for r in intervals.inside(a, m).select("record_id", "act", "at", "begin", "end", "pos", "value").collect()) == text(pairs)
    assert text(tuple(r) for r in intervals.inside(a.where("end - begin < 5000000"), m, level=9).select("record_id", "act", "at", "begin", "end", "pos", "value").collect()) == text(x for x in pairs if x[4] - x[3] < 5_000_000)
    best = {}
    for k, act, at, _, _, p, v in pairs:
        one = (abs(p - at), p, v is not None, v or "", v)
        best[k, act] = min(best.get((k, act), one), one)
    want = [(k, act, best[k, act][4] if (k, act) in best else None) for k, act, *_ in acts]
    assert text(tuple(r) for r in intervals.nearest(a, m, ranges=ranges).collect()) == text(want)
    empty = m.where("false")
    assert intervals.inside(a, empty).count() == 0 and intervals.nearest(a, empty).where("value IS NOT NULL").count() == 0


def test_a_hot_key_makes_no_square(spark):
    """40,000 windows and marks of one key: bins stay small, so the pairs that are tested follow the result."""
    n = 40_000
    acts = spark.range(n).select(F.lit(1).alias("record_id"), F.col("id").alias("act"), (F.col("id") * 10).alias("at"), (F.col("id") * 10 - 15).alias("begin"), (F.col("id") * 10 + 15).alias("end"))
    marks = spark.range(n).select(F.lit(1).alias("record_id"), (F.col("id") * 10 + 3).alias("pos"), F.col("id").cast("string").alias("value"))
    found = intervals.inside(acts, marks)
    assert found.count() == 3 * n - 2
    near = intervals.nearest(acts, marks, ranges=16)
    assert near.where("value = act").count() == n
    sizes = [r["n"] for r in acts.selectExpr("explode(array_distinct(array(shiftright(begin, 5), shiftright(end - 1, 5)))) b").groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 8  # so no bin is large, whatever the key holds
