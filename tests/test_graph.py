"""Triples, evidence readers and triage on inline rows."""

import pytest
from pyspark.sql import functions as F

from tracework.operators import attribution, evidence, experiments, graph, triage
from tracework.operators import machine as M

TRIPLES = [
    ("x", "a", "Case", "iri"), ("x", "has", "p1", "iri"), ("x", "has", "p2", "iri"), ("x", "at", "2024", "string"),
    ("p1", "a", "Kind", "iri"), ("p2", "a", "Other", "iri"), ("y", "a", "Case", "iri"), ("p1", "knows", "p2", "iri"),
]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(TRIPLES, "s string, p string, o string, o_kind string")


def test_patterns(triples):
    got = graph.match(triples, [("?c", "a", "Case"), ("?c", "has", "?p"), ("?p", "a", "?t")])
    assert {(r.c, r.p, r.t) for r in got.collect()} == {("x", "p1", "Kind"), ("x", "p2", "Other")}
    with pytest.raises(ValueError, match="shares no variable"):
        graph.match(triples, [("?a", "a", "Case"), ("?b", "has", "?c")])


def test_shapes(triples):
    found = graph.violations(triples, "Case", [{"path": "has", "min": 1, "max": 1, "cls": "Kind"}, {"path": "at", "kind": "timestamp"}])
    assert {tuple(r) for r in found.collect()} == {("x", "has", "max"), ("y", "has", "min"), ("x", "has", "class"), ("x", "at", "kind")}


def test_subclass_bridge(spark, triples):
    edges = spark.createDataFrame([("Kind", "Mid"), ("Mid", "Top")], "sub string, super string")
    closure = graph.subclasses(edges)
    assert {tuple(r) for r in closure.where("sub = 'Kind'").collect()} == {("Kind", "Kind"), ("Kind", "Mid"), ("Kind", "Top")}
    assert graph.with_supertypes(triples, closure).where("s = 'p1' AND p = 'a'").count() == 3


def test_neighbours_and_cohorts(spark, triples):
    got = graph.neighbours(triples, spark.createDataFrame([("p1",)], "node string"))
    assert {(r.p, r.other, r.outward) for r in got.collect()} == {("a", "Kind", True), ("knows", "p2", True), ("has", "x", False)}
    sides = graph.cohort_difference(triples, triples.where("s <> 'p2'")).collect()
    assert {(r.cls, r.side) for r in sides} == {("Other", "left"), ("Case", "both"), ("Kind", "both")}
    assert spark.sql("SELECT 'http://a/b#C' AS u").select(graph.local_name(F.col("u")).alias("n")).first().n == "C"


def test_readers_read_their_kinds(spark):
    def words(docs):
        return docs.select("record_id", F.lit("word").alias("field"), F.lit("").alias("role"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("value"), F.lit(0.9).alias("confidence"))

    docs = spark.createDataFrame([("a", "press", "hello"), ("b", "court", "no"), ("c", "reference", "x")], "record_id string, kind string, text string")
    plan = evidence.reading_plan(spark, [("words", ["press"], "regex", "0", 1), ("words", ["press", "court"], "llm", "1", 20), ("others", ["press"], "human", "2", 10)])
    assert sorted((r.record_id, r.method, r.version, r.family, r.end) for r in evidence.read_votes(docs, plan, {"words": words}).collect()) == [("a", "llm", "1", "llm", 5), ("b", "llm", "1", "llm", 2)]
    assert {(r.record_id, r.turn, r.reader) for r in evidence.dispatched(docs, plan).collect()} == {("a", 1, "others"), ("a", 2, "words"), ("b", 1, "words")}


def whose(spark, text, kind="press", *places):
    docs = spark.createDataFrame([("r", kind, text)], "record_id string, kind string, text string")
    values = spark.createDataFrame([("r", text.index(p)) for p in places], "record_id string, start int")
    found = {r.start: (r.people, r.confidence, r.rule) for r in attribution.attributed(docs, values).collect()}
    return [found[text.index(p)] for p in places]


def test_values_of_a_sentence(spark):
    text = "Ann Lee received 3 months. Bo Kay, Cy Low and Di Moe were each given 4 months, and Eve Nye 5 months."
    assert whose(spark, text, "press", "3 months", "4 months", "5 months") == [(["Lee"], 0.75, "same_sentence"), (["Kay", "Low", "Moe"], 0.75, "same_sentence"), (["Nye"], 0.75, "same_sentence")]


def test_values_carried_over(spark):
    first = "Ann Lee and Bo Kay met Cy Low. "
    back = (["Lee", "Kay"], 0.6, "carried_from_previous_sentence")  # the first-named person and the group, not the last one
    none = ([], 0.0, "none")
    assert whose(spark, first + "They paid $5.", "press", "$5") == [back]
    assert whose(spark, first + "In addition, the plan cost $5.", "press", "$5") == [none]  # no pronoun opens it
    assert whose(spark, first + "The judge ordered them to pay $5.", "press", "$5") == [back]
    assert whose(spark, first + "It rained. They paid $5.", "press", "$5") == [back]
    assert whose(spark, first + "It rained. It snowed. They paid $5.", "press", "$5") == [none]  # two sentences back at most


def test_officials_and_victims_are_nobodys_owner(spark):
    text = "Judge Eve Nye gave Ann Lee 3 months. Eve Nye spoke of 4 months. The victim, Bo Kay, lost $5."
    assert whose(spark, text, "press", "3 months", "4 months", "$5") == [(["Lee"], 0.75, "same_sentence"), ([], 0.0, "none"), ([], 0.0, "none")]


def test_headings_of_court_records(spark):
    text = "DEFENDANT: Ann Lee\nCOUNTY OF X.\nThe loss was $5. DEFENDANT: \n\n\n\nBo Kay.\nThe fine was $6."
    assert whose(spark, text, "court", "$5") == [(["Lee"], 0.7, "defendant_line")]
    assert whose(spark, text, "press", "$5") == [([], 0.0, "none")]


def test_ties_are_settled(spark):
    mentions = spark.createDataFrame([("r", 0, 0, 5, "b", False), ("r", 0, 0, 5, "a", False)], "record_id string, sentence int, begin int, finish int, person string, joined boolean")
    values = spark.createDataFrame([("r", 0, 5)], "record_id string, sentence int, start int")
    sentences = spark.createDataFrame([("r", 0, False)], "record_id string, sentence int, carried boolean")
    assert attribution.subjects(values, mentions, sentences).first().people == attribution.subjects(values, mentions.orderBy("person"), sentences).first().people


def test_gates(spark):
    rows = spark.createDataFrame([("Down for MAINTENANCE", False), ("x", True), ("%PDF-1", True), ("fine", False)], "body string, pdf boolean")
    assert [r.f for r in rows.select(evidence.payload_failure(F.col("body"), F.col("pdf"), ["maintenance"]).alias("f")).collect()] == ["maintenance page", "not a PDF", None, None]
    mentions = spark.createDataFrame([("r", "money", i, i + 1) for i in range(10)] + [("r", "date", 0, 1)], "record_id string, field string, start int, end int")
    assert evidence.open_mentions(mentions, ["money", "sentence"]).count() == 8


def test_walks_from_the_start(spark):
    steps = spark.createDataFrame([("a", 0, "Contact"), ("a", 1, "Goal"), ("b", 0, "Goal")], "walk string, k int, next string")
    assert {r.walk for r in M.from_start(steps, ["Contact", "Preparation"]).collect()} == {"a"}


def alike(spark, item):
    rows = [(f"{d}{i}", d, k, 3 * i + k, a) for d in "ab" for i in range(30) for k, a in enumerate(item(d))]
    return spark.createDataFrame(rows, "trace string, grp string, ts int, event_id int, activity string")


def test_domains_that_differ_only_in_means(spark):
    act, means = alike(spark, lambda d: ["contact", "demand", "transfer"]), alike(spark, lambda d: [f"contact[{d}]", "demand", "transfer"])
    found = {(r.level, r.what): r for r in experiments.compared_levels({"act": act, "means": means}, "grp", draws=5).collect()}
    assert found["act", "steps"].mean_bits == pytest.approx(0) and found["act", "transitions"].mean_bits == pytest.approx(0)
    assert found["means", "steps"].above_shuffled > 0.3
    dealt = experiments.shuffled_labels(means.groupBy("trace").agg(F.min("grp").alias("grp")), "grp", 3)
    assert {tuple(r) for r in dealt.groupBy("draw", "grp").agg(F.count("*").cast("int")).collect()} == {(d, g, 30) for d in range(3) for g in "ab"}


def test_a_learned_grouping_joins_what_goes_on_alike():
    edges = {("a", "x"): 3.0, ("b", "x"): 5.0, ("x", "a"): 1.0, ("y", "a"): 2.0, ("x", "b"): 1.0, ("y", "b"): 2.0}
    found = experiments.learned_grouping(edges, 2)
    assert found["a"] == found["b"] != found["x"] == found["y"]


def test_rationality_of_choices():
    worth = {("s", "a"): 1.0, ("s", "b"): 0.0}
    assert experiments.rationality({("s", "a"): 1, ("s", "b"): 1}, worth) == 0
    beta = experiments.rationality({("s", "a"): 3, ("s", "b"): 1}, worth)
    assert beta == pytest.approx(1.0986122886681098, abs=1e-6)  # odds of three to one for one unit of worth
    assert experiments.rationality({("s", "a"): 3}, worth) == 50


def test_triage(spark):
    rows = spark.range(400).select("id", (F.col("id") % 3).cast("double").alias("f"), (F.col("id") % 3 * 10 + F.col("id") % 2).cast("double").alias("score"))
    _, accuracy = triage.triage(rows, "id", ["f"], "score", kind="tree")
    assert accuracy > 0.9
    assert triage.triage(rows.limit(5), "id", ["f"], "score") is None
    labelled = triage.binned(rows, "score")
    train, test = triage.split(labelled, "id")
    count = lambda df: {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    whole, part = count(labelled), count(train)
    assert all(part[k] == round(0.8 * n) for k, n in whole.items()) and train.join(test, "id").count() == 0


def test_closures_on_the_cluster(spark):
    """Rounds on the cluster equal a walk from every node: circles, loops, lines, nodes without parents, nulls, repeats."""
    import random

    from tracework.operators import closure
    from tracework.operators import machine as M

    rng = random.Random(6)
    for n, m in ((12, 14), (30, 20), (9, 40)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1, 1), (None, 2), (3, None), (4, 5), (4, 5)]
        graph_of = {}
        for a, b in edges:
            if a is not None and b is not None and a != b:
                graph_of.setdefault(a, set()).add(b)
                graph_of.setdefault(b, set())
        want = set()
        for a in graph_of:
            far, at = {a: 0}, [a]
            for x in at:
                for y in sorted(graph_of[x]):
                    if y not in far:
                        far[y] = far[x] + 1
                        at.append(y)
            want |= {(a, b, d) for b, d in far.items()}
        rows = closure.reach(spark.createDataFrame(edges, "a int, b int")).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    parents = [(f"s{i}", f"s{i - 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("self", "self"), ("top", None), ("two", "s9"), ("two", "s3"), (None, "s1")]
    states = spark.createDataFrame(parents, "state string, parent string")
    on_driver = {tuple(r) for r in M.ancestry(states.where("state IS NOT NULL")).collect()}
    on_cluster = M.ancestry(states, on_driver=0).collect()
    assert len(on_cluster) == len(on_driver) and {tuple(r) for r in on_cluster} == on_driver
    assert ("w", "z", 3) in on_driver and ("two", "s0", 4) in on_driver and ("s39", "s0", 39) in on_driver
    assert closure.ancestors(states.where("false")).count() == 0 and closure.reach(spark.createDataFrame([], "a int, b int")).count() == 0


def test_rationalities_of_all_draws_at_once(spark):
    """The native fit equals the fit of each draw by itself: chosen for worth, against it, always the best, ties."""
    import random

    from tracework.operators import experiments as E

    rng = random.Random(3)
    rows, want = [], {}
    for draw in range(12):
        counts, worth = {}, {}
        for src in "ab" if draw else "a":
            for dst in "xyz":
                worth[src, dst] = rng.choice([0.0, 1.0, rng.random()])
                counts[src, dst] = {1: 5 * (worth[src, dst] == 1.0), 2: 3}.get(draw, rng.randrange(9) * (1 + 3 * worth[src, dst]))
                rows.append((draw, src, dst, worth[src, dst], float(counts[src, dst])))
        want[draw] = E.rationality(counts, worth)
    got = E.rationalities(spark.createDataFrame(rows, "draw int, src string, dst string, v double, n double"), 50.0, "draw").collect()
    assert {r["draw"]: pytest.approx(r["beta"], abs=1e-6) for r in got} == want
    assert 0.0 in want.values() and len({round(b, 3) for b in want.values()}) > 4


def test_patterns_thin_out_before_they_join(spark):
    """A statement that binds nothing new is no join of the bindings, and nothing is compared after the joins."""
    rows = [(f"c{i}", "in", f"n{i % 2}", "iri") for i in range(6)] + [(f"c{i}", "a", "T", "iri") for i in range(0, 6, 2)] + [("n0", "part", "r", "iri")] * 2
    every = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    got = graph.match(every, [("?x", "in", "?n"), ("?n", "part", "?r"), ("?y", "in", "?n"), ("?y", "a", "T")])
    assert sorted(map(tuple, got.select("x", "n", "r", "y").collect())) == sorted((f"c{i}", "n0", "r", f"c{j}") for i in (0, 2, 4) for j in (0, 2, 4))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith(("Aggregate", "Distinct")) and plan.count("LeftSemi") == 1
