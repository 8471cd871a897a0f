"""Every library query that has an oracle gives the oracle's rows on whole tables."""

import glob
import os

import pandas as pd
import pytest

from tracework.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


def rows(frame):
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:  # tested against other definitions in test_process and test_graph
        assert len(got.columns) == len(set(got.columns)) and len(got) > 0


def test_only_learnt_models_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"alignment_fitness", "inductive_tree", "triage_predictions"}
