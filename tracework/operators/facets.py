"""Faceted filters and selections over case rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def overlap(column: str, wanted) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(x) for x in _listed(wanted)]))


def filter_cases(cases: DataFrame, filters: dict) -> DataFrame:
    """Rows that satisfy every facet given.

    source: equality. start, end: bounds (inclusive) on the row's start, which must be a timestamp. platforms, topics,
    severity (or platform, topic; the plural wins): overlap with a list or one value. region: the victims' or the
    perpetrators'. victim_count, perpetrator_count: {"min", "max"}, inclusive, null rows excluded."""
    out = cases
    if filters.get("source"):
        out = out.where(F.col("source") == filters["source"])
    if "start" in filters or "end" in filters:
        start = F.try_to_timestamp("start")
        out = out.where(start.isNotNull())
        if filters.get("start"):
            out = out.where(start >= F.lit(filters["start"]).cast("timestamp"))
        if filters.get("end"):
            out = out.where(start <= F.lit(filters["end"]).cast("timestamp"))
    for many, one, column in (("platforms", "platform", "platforms_used"), ("topics", "topic", "case_topics"), ("severity", "severity", "severity_indicators")):
        wanted = filters.get(many) or filters.get(one)
        if wanted:
            out = out.where(overlap(column, wanted))
    if filters.get("region"):
        r = filters["region"]
        out = out.where((F.col("victim_region") == r) | (F.col("perpetrator_region") == r))
    for column in ("victim_count", "perpetrator_count"):
        bounds = filters.get(column) or {}
        if bounds:
            out = out.where(F.col(column).isNotNull())
        if bounds.get("min") is not None:
            out = out.where(F.col(column) >= bounds["min"])
        if bounds.get("max") is not None:
            out = out.where(F.col(column) <= bounds["max"])
    return out


def select_records(records: DataFrame, ids: list | None = None, kind: str | None = None, domain: str | None = None, seed: int | None = None, limit: int = 0) -> DataFrame:
    """Ids short-circuit all else; else kind, domain membership, and `limit` rows in a seeded order (0: all)."""
    if ids:
        return records.where(F.col("record_id").isin(list(ids)))
    out = records
    if kind:
        out = out.where(F.col("kind") == kind)
    if domain:
        out = out.where(F.array_contains("domains", domain))
    if seed is not None:
        out = out.orderBy(F.md5(F.concat_ws("|", F.col("record_id").cast("string"), F.lit(str(seed)))), "record_id")
    return out.limit(limit) if limit else out


def in_scope(records: DataFrame, kind: str = "", domain: str = "", dated_only: bool = False, with_offense: bool = False) -> DataFrame:
    """Records of a kind and a domain, with a date, and with an offense, as asked for."""
    out = select_records(records, kind=kind or None, domain=domain or None)
    if dated_only:
        out = out.where("date IS NOT NULL")
    return out.where(F.size("offenses") > 0) if with_offense else out


def case_view(rows: DataFrame, wanted: str, case: str = "case_id", record: str = "record_id", order: tuple[str, ...] = ("date",)) -> DataFrame:
    """The rows of one case, named by its id or by one of its records' ids, in order; undated ones last."""
    cases = rows.where((F.col(case) == wanted) | (F.col(record) == wanted)).select(F.col(case).alias("_c")).distinct()
    found = rows.join(F.broadcast(cases), F.col(case) == F.col("_c"), "left_semi")  # one case
    return found.orderBy(*[F.col(c).asc_nulls_last() for c in order], record)


def timeline(rows: DataFrame) -> DataFrame:
    """Rows with a start, its year, and the end (the start where there is none)."""
    start = F.try_to_timestamp("start")
    return rows.withColumn("start_at", start).where("start_at IS NOT NULL").withColumn("end_at", F.coalesce(F.try_to_timestamp("end"), "start_at")).withColumn("year", F.year("start_at"))


def ranked_or_fallback(rows: DataFrame, key: str, rank: Column, preferred: Column, order: list[str], k: int) -> DataFrame:
    """The k best ranked preferred rows of each key; of keys without any, the k best of all."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("_rank", rank).withColumn("_any", F.max(preferred).over(w)).where(~F.col("_any") | preferred)
    return ranked.withColumn("_k", F.row_number().over(w.orderBy("_rank", *order))).where(F.col("_k") <= k).drop("_any", "_k")


def newest(rows: DataFrame, key: str, ts: str, k: int, yearly: bool = False) -> DataFrame:
    """The k newest rows of a key, or its first of every year; of rows at one time, the first by all other columns."""
    ties = [c for c in rows.columns if c not in (key, ts)]
    if yearly:
        w = Window.partitionBy(key, F.year(ts)).orderBy(ts, *ties)
        return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    w = Window.partitionBy(key).orderBy(F.desc(ts), *ties)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def with_totals(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sums by group and a row named TOTAL."""
    return rows.rollup(group).agg(F.sum(value).alias(value), F.grouping(group).alias("_g")).select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(group)).alias(group), value)
