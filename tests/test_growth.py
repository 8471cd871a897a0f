"""What keeps a task's size when tables grow: shuffles that are dealt by size and serve all that comes after them."""

import pytest
from pyspark.sql import functions as F

from tracework.operators import resolve
from tracework.plans import catalog
from tracework.session import dealt_by


def shuffles(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")


def test_tables_are_dealt_by_their_size(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 1000).alias("k"))
    parts = dealt_by(rows, "k", each=1 << 19)
    assert parts.rdd.getNumPartitions() == 16 and dealt_by(rows, "k", each=1 << 30).rdd.getNumPartitions() == 4
    assert parts.select("k", F.spark_partition_id()).distinct().count() == 1000


@pytest.mark.parametrize("name", ["person_carry_over", "resolved_votes"])
def test_one_shuffle_serves_the_query(spark, sf, name):
    assert shuffles(catalog.QUERIES[name](spark, sf)) == 1


def test_rivals_have_as_many_families(spark):
    rows = [(1, "x", "a", 0.9), (1, "y", "a", 0.8), (2, "x", "a", 0.9), (2, "x", "b", 0.9), (2, "y", "a", 0.9), (3, "x", "human", 0.1), (3, "y", "a", 0.9), (3, "y", "b", 0.9), (4, "x", None, 0.9), (5, "x", None, 0.9), (5, "y", "a", 0.9)]
    votes = spark.createDataFrame([(r, "f", "", 0, 1, v, fam, c) for r, v, fam, c in rows], "record_id int, field string, role string, start int, end int, value string, family string, confidence double")
    got = {r["record_id"]: (r["value"], r["families"], r["status"]) for r in resolve.resolve(votes).collect()}
    assert got == {1: ("x", 1, "review"), 2: ("x", 2, "resolved"), 3: ("x", 1, "resolved"), 4: ("x", 0, "resolved"), 5: ("y", 1, "resolved")}


def test_subjects_by_sentence_and_heading(spark):
    from tracework.operators import attribution

    m = [("r", 0, 0, 5, "a", False), ("r", 0, 6, 9, "b", True), ("r", 0, 20, 25, "c", False), ("r", 3, 70, 75, "d", False)]
    mentions = spark.createDataFrame(m, "record_id string, sentence int, begin int, finish int, person string, joined boolean")
    values = spark.createDataFrame([("r", 0, 9), ("r", 0, 19), ("r", 0, 30), ("r", 2, 60), ("r", 3, 70), ("r", 4, 90), ("s", 0, 1)], "record_id string, sentence int, start int")
    sentences = spark.createDataFrame([("r", n, n == 2) for n in range(5)], "record_id string, sentence int, carried boolean")
    headings = spark.createDataFrame([("r", 65, "h"), ("r", 80, None)], "record_id string, finish int, person string")
    found = {(r.record_id, r.start): (r.people, r.rule) for r in attribution.subjects(values, mentions, sentences, headings).collect()}
    same, back = "same_sentence", "carried_from_previous_sentence"
    assert found == {
        ("r", 9): (["a", "b"], same), ("r", 19): (["a", "b"], same), ("r", 30): (["c"], same), ("r", 60): (["a", "b"], back),
        ("r", 70): (["h"], "defendant_line"), ("r", 90): ([], "none"), ("s", 1): ([], "none"),
    }


@pytest.mark.parametrize("name", ["attributed_values", "statute_votes"])
def test_what_belongs_to_a_text_stays_in_its_row(spark, sf, name):
    """Texts are read in one pass, and nothing is shuffled by record."""
    plan = str(catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning" not in plan and "Window" not in plan and plan.count("Scan parquet") == 1


def test_statutes_in_a_row_vote_as_in_tables(spark):
    from tracework.operators import evidence, tokens

    law = spark.createDataFrame([("18", "1343", "wire", None, 240), ("18", "1001", "false", 60, 90), ("21", "841A", "drug", 60, 240)], "title string, section string, label string, low int, high int")
    texts = ["", None, "18 U.S.C. § 1001 and 21 U.S.C. § 841a: 60 months, 240 months, 5 years, life in prison. He was sentenced to 60 months.", "60 months under 18 U.S.C. § 1343, 20 years", "21 U.S.C. § 841a, 18 U.S.C. § 1001, 18 U.S.C. § 1001, 18 U.S.C. § 5: 240 months"]
    docs = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string")
    found = tokens.read_tokens(docs, ["statute", "duration"])
    read = tokens.tokens_in_rows(docs, ["statute", "duration"])
    rows = read.select("record_id", tokens.citations_in(F.col("hits")).alias("citations"), tokens.terms_in(F.col("text"), F.col("hits")).alias("terms"))
    got = evidence.statute_votes_in_rows(rows, law)
    want = evidence.statute_votes(evidence.cited_statutes(tokens.citations(found), law), tokens.terms(docs, found))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sum(r.field == "sentence" for r in got.collect()) == 5


def test_values_beside_their_text(spark):
    """Two values of a text, one outside of all sentences, and a name that a sentence's end cuts."""
    from tracework.operators import attribution

    text = "Ann Lee and Bo Kay met Cy Low. It rained. They paid $5. Di B. Moe paid $6.  "
    docs = spark.createDataFrame([("r", None, text), ("s", "press", None)], "record_id string, kind string, text string")
    values = spark.createDataFrame([("r", text.index("$5"), "5"), ("r", text.index("$6"), "6"), ("r", len(text), "7"), ("s", 0, "8")], "record_id string, start int, amount string")
    found = {r.amount: (r.sentence, r.people, r.rule) for r in attribution.attributed(docs, values).collect()}
    assert found == {"5": (2, ["Lee", "Kay"], "carried_from_previous_sentence"), "6": (4, [], "none")}
