"""Golden records against a plain reading of the rules, and against SQL."""

import datetime as dt
import math
import random

import duckdb
import pandas as pd
import pytest

from tracework.llm import golden
from tracework.llm import queries as Q

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, recent string, _segment string, cluster_id int, stale boolean"


def blank(t):
    return None if t is None or not t.strip(" \t\n\v\f\r") else t


def by_rule(rows):
    """One record for each cluster, straight from the rules."""
    clusters = {}
    for client, master, source, at, name, email, city, nation, segment, balance in rows:
        trust = golden.TRUST.index(source) if source in golden.TRUST else 9
        balance = None if balance is None or balance != balance or abs(balance) == float("inf") else balance
        row = dict(id=client, trust=trust, at=at, name=blank(name), email=blank(email), city=blank(city), nation=nation, segment=blank(segment), balance=balance)
        clusters.setdefault(client if master is None else master, []).append(row)
    out = []
    for cluster, own in clusters.items():
        latest = max((r["at"] for r in own if r["at"]), default=None)
        for r in own:
            r["stale"] = r["at"] is None or latest - r["at"] > dt.timedelta(days=30)
        recent = lambda r: (r["at"] is None, -(r["at"] - dt.datetime(1970, 1, 1)).total_seconds() if r["at"] else 0, r["trust"], r["id"] is None, r["id"] or 0)
        trusted = lambda r: (r["stale"], r["trust"], *recent(r))
        pick = lambda field, key: min((r for r in own if r[field] is not None), key=lambda r: (*key(r), r[field]), default=None)
        seg = pick("segment", recent)
        name, email = pick("name", lambda r: (-len(r["name"]), *trusted(r))), pick("email", trusted)
        bal = pick("balance", lambda r: (seg is None or r["segment"] != seg["segment"], *recent(r)))
        adr = min(own, key=lambda r: ((r["city"] is None) + (r["nation"] is None), *trusted(r), r["city"] is None, r["city"] or "", r["nation"] or 0))
        value = lambda r, f: None if r is None else r[f]
        cents = None if bal is None else math.floor(bal["balance"] * 100 + 0.5)
        out.append((cluster, len(own), sum(r["stale"] for r in own), value(name, "name"), value(email, "email"), value(seg, "segment"), adr["city"], adr["nation"], cents, value(name, "id"), value(email, "id"), value(seg, "id"), value(bal, "id"), adr["id"] if adr["city"] is not None or adr["nation"] is not None else None))
    return sorted(out, key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7, True) for r in rows], SCHEMA)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def some_rows(n, clusters, seed):
    draw = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = None if draw.random() < 0.1 else start + dt.timedelta(days=draw.randrange(90), microseconds=draw.choice([0, 0, 1, 999_999]))
        texts = [draw.choice([None, "", " \t", "a", "bb", " bb", "é" * 3, "日本"]) for _ in range(4)]
        balance = draw.choice([None, float("nan"), float("inf"), -0.005, 0.125, 1.005, -994.77, draw.uniform(-1e4, 1e4)])
        rows.append((draw.choice([None, i, i, i, -i, i // 2]), draw.choice([None, *[draw.randrange(clusters) for _ in range(9)]]), draw.choice(["partner", "store", "web", "crm", None, "other"]), at, texts[0], texts[1], texts[2], draw.choice([None, 0, 5]), texts[3], balance))
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("n", "clusters", "share"), [(400, 60, 1_000), (400, 3, 1_000), (400, 25, 8), (300, 300, 1)])
def test_records_follow_the_rules(spark, n, clusters, share):
    """Nulls, blanks, odd balances, ties, repeated rows, ids that are null, negative or stand twice; hot clusters and none."""
    rows = some_rows(n, clusters, n + clusters)
    assert got(golden.golden_records(table_of(spark, rows), share)) == by_rule(rows)


def test_borders(spark):
    """Stale is over thirty days, to the microsecond; before 1970 too; a null cluster; a name of a million characters."""
    last = dt.datetime(2024, 5, 1, 0, 0, 0, 5)
    month = dt.timedelta(days=30)
    rows = [
        (1, 9, "crm", last, "a", None, None, None, None, None),
        (2, 9, "web", last - month, "x" * 1_000_000, "e", "c", 1, "s", 1.0),
        (3, 9, "partner", last - month - dt.timedelta(microseconds=1), "b", "f", "d", 2, "s", 2.0),
        (None, None, None, dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), "n", "m", None, 3, "s", -1.0),
        (None, None, None, dt.datetime(1950, 1, 1), "nn", "m", None, 3, "s", -1.0),
        (-(1 << 63), None, "web", None, None, None, None, None, None, None),
        ((1 << 63) - 1, None, "web", None, "z", None, None, None, None, None),
    ]
    found = got(golden.golden_records(table_of(spark, rows)))
    assert found == by_rule(rows)
    assert {r[0]: r[2] for r in found}[9] == 1 and {r[0]: r[9] for r in found}[9] == 2
    assert golden.golden_records(table_of(spark, rows).where("false")).count() == 0


def test_keys_sort_as_the_rule(spark):
    rows = spark.createDataFrame([(m, t, c) for m in (None, -5, 0, 7) for t in (0, 4) for c in (None, -3, 0, 9)], "m long, t int, c long")
    keyed = rows.select("*", golden.recent_key(rows.m, rows.t, rows.c).alias("k")).collect()
    order = lambda r: (r.m is None, -(r.m or 0), r.t, r.c is None, r.c or 0)
    assert sorted(keyed, key=lambda r: bytes(r.k)) == sorted(keyed, key=order)
    back = rows.select("c", golden.client_of(golden.recent_key(rows.m, rows.t, rows.c)).alias("d")).collect()
    assert all(r.c == r.d for r in back)


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_gives_the_rows_of_its_sql(spark, at):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clients AS SELECT * FROM '{at}/clients.parquet'")
    want = con.execute(Q.ORACLES["op11_golden_records"]).df()
    have = Q.QUERIES["op11_golden_records"](spark, at).toPandas()
    assert sorted(have.columns) == sorted(want.columns)
    plain = lambda f: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert plain(have) == plain(want)
