"""Operators on inline rows."""

import re

import pytest
from pyspark.sql import functions as F

from tracework.functions import columns as C
from tracework.operators import evidence, facets, linkage, pages, resolve
from tracework.operators import machine as M
from tracework.operators import sequences as S


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "key"),
    [(" http://A.com/x/#f ", "http://A.com/x"), ("http://a.com/x?utm_s=1&b=2&&UTM_c=3", "http://a.com/x?b=2"), ("http://a.com/?utm_x=1", "http://a.com"), ("", "")],
)
def test_url_key(spark, url, key):
    assert one(spark, C.url_key(F.col("u")), u=url) == key


def test_scalars(spark):
    assert one(spark, C.host(F.col("u")), u="https://WWW.Ab.org/x") == "ab.org"
    assert one(spark, C.stamp_date(F.col("u")), u="20240131093000") == "2024-01-31"
    assert one(spark, C.stamp_date(F.col("u")), u="2024-02-03T00:00:00Z") == "2024-02-03"
    assert one(spark, C.stamp_date(F.col("u")), u="soon") == ""
    assert one(spark, C.slug_terms(C.slug(F.col("u")), ["the"]), u="https://x.org/a/the-big-plan-of-two/") == "big plan two"
    assert str(one(spark, C.epoch_date(F.col("u")), u="86400")) == "1970-01-02" and one(spark, C.epoch_date(F.col("u")), u="no") is None
    assert one(spark, C.joined_urls(F.col("u")), u=["see https://a.b/c-", "d/e end", "x"]) == ["see https://a.b/c-d/e end", "x"]
    assert one(spark, C.action_types(F.col("a"), F.col("b")), a=[" X ", ""], b="old") == ["x"]
    assert one(spark, C.action_types(F.col("a"), F.col("b")), a=[], b=" Old") == ["old"]
    assert one(spark, C.repaired_label(F.col("u"), [], {"doe": "North"}, "South"), u="the Doe's  Office") == "North Office"
    assert one(spark, M.action_label(F.col("a"), F.col("m")), a="contact", m=["b", "a", "b"]) == "contact[a+b]"


def test_costs(spark):
    frame = spark.createDataFrame([(4,), (50,), (None,)], "n int").select(C.page_cost(F.col("n")).alias("p"), C.transcript_cost(F.col("n")).alias("t"))
    assert [(r.p, r.t) for r in frame.collect()] == [(pytest.approx(0.4), pytest.approx(0.4)), (3.0, 5.0), (3.0, None)]


def test_page_spec_and_cut(spark):
    assert spark.sql("SELECT '3, 7-9,1' AS s").select(pages.page_spec(F.col("s"), F.lit(8)).alias("p")).first()["p"] == [1, 3, 7, 8]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(["hit", "x", "hit", "y", "z"], 1)], "doc string, page int, text string")
    cut = lambda **o: sorted(r["page"] for r in pages.pages_to_cut(rows, "hit", **o).collect())
    assert cut() == [1, 3] and cut(keep_first=True) == [3] and cut(keep_first=True, follow=2) == [3, 4, 5]


def test_exact_copies_need_length(spark):
    text = "A  long Page " * 10
    rows = spark.createDataFrame([(1, text), (2, text.lower()), (3, "s"), (4, "s")], "id int, text string")
    assert [r["id"] for r in pages.exact_copies(rows, "id", ["id"]).collect()] == [2]


def test_html_blocks():
    html = "<p>One<br>two <b>x</b>y</p><table><tr><td>a</td><td> </td><td><p>b</p><table><tr><td>in</td></tr></table></td></tr></table><script>no</script>"
    assert pages.blocks_of(html) == "One two x y\n\na | b in | in"  # empty cells go, white space is folded
    assert pages.blocks_of("<div>only <i>text</i></div>") == "only\ntext" and pages.blocks_of(None) == ""
    assert pages.blocks_of("<p><b>A<br><p>B &amp; b</p><p>C</p></div></b>") == "A B & b C\n\nB & b\n\nC"  # what isn't closed goes on


def test_html_blocks_at_any_depth():
    """A hundred thousand elements inside each other, closed or not, cost neither the stack nor the square of the time."""
    for tag in ("div", "li", "td", "b"):
        assert pages.blocks_of(f"<{tag}>" * 100_000 + "deep") == "deep" and pages.blocks_of(f"<{tag}>" * 50_000 + "<p>deep</p>" + f"</{tag}>" * 50_000) == "deep"
    assert pages.blocks_of("<div></b>" * 100_000 + "x</nothing>y") == "xy"
    assert pages.blocks_of("<p>" * 1_500 + "one") == "\n\n".join(["one"] * 1_500)
    assert pages.blocks_of("<table>" + "<tr><td>a<td>b" * 3 + "</table>") == "a b a b a b | b a b a b | a b a b | b a b | a b | b"
    assert pages.blocks_of("<table><tr><td>a</td></tr></table>" * 20_000).count("\n\n") == 19_999


def test_profiles(spark):
    profiles = spark.createDataFrame([("common", [], 0), ("x", ["d"], 1), ("y", ["e"], 2)], "profile string, domains array<string>, ord int")
    records = spark.createDataFrame([("a", "d"), ("b", "none"), ("c", None)], "record_id string, domain string")
    got = {}
    for r in evidence.profiles_of(records, profiles).orderBy("record_id", "ord").collect():
        got.setdefault(r["record_id"], []).append(r["profile"])
    assert got == {"a": ["common", "x"], "b": ["common", "x", "y"], "c": ["common", "x", "y"]}


def test_names_give_way_to_numbers(spark):
    docs = spark.createDataFrame([(1, "Ms. Ann Lee wrote ann@x.org to Bo Kay. Lee and Ann Lee agreed."), (2, None)], "id int, text string")
    names = spark.createDataFrame([(1, "Ann Lee"), (1, "Bo Kay")], "id int, name string")
    got = {r["id"]: (r["text"], r["leaks"]) for r in pages.people_numbered(docs, names, "id").collect()}
    assert got == {1: ("Person 1 wrote [name]@x.org to Person 2. [name] and Person 1 agreed.", 0), 2: ("", 0)}


def test_steps_and_fit(spark):
    scheme = spark.createDataFrame([("c", "Contact", False, None), ("g", "Goal", True, True), ("t", "Completed", False, None)], "state string, milestone string, is_goal boolean, source boolean")
    walks = [("w1", ["c", "c", "g"], M.DETECTED), ("w2", ["c", "?", "c"], M.STOP), ("w3", ["?"], M.STOP), ("w4", ["c", "t", "g"], M.DETECTED)]
    rows = [(w, "d", i, s, "act", e) for w, states, e in walks for i, s in enumerate(states)]
    stepped = M.steps(spark.createDataFrame(rows, "walk string, domain string, i int, state string, action string, ended_by string"), scheme)
    got = {}
    for r in stepped.orderBy("walk", "k").collect():
        got.setdefault(r["walk"], []).append((r["state"], r["action"], r["next"]))
    assert got["w1"] == [("(start)", "act", "Contact"), ("Contact", "act", "Contact"), ("Contact", "act", "Goal"), ("Goal", "(detected)", "Completed")]
    assert got["w2"] == [("(start)", "act", "Contact"), ("Contact", "act", "Contact"), ("Contact", "(stop)", "Unresolved")]
    assert "w3" not in got and got["w4"][-1] == ("Contact", "(detected)", "Disrupted")
    counts = {(r["state"], r["action"], r["next"], r["by_detection"]): r["n"] for r in M.counts(stepped).collect()}
    assert counts[("Contact", "act", "Completed", True)] == 1 and ("Contact", "act", "Goal", False) not in counts
    space = {(r["state"], r["action"]) for r in M.action_space(stepped, min_count=2).collect()}
    assert ("(start)", "act") in space and ("Goal", "(stop)") in space and ("Goal", "act") not in space


def test_shuffled_input_gives_the_same(spark):
    rows = [("t", i, i, "ab"[i % 2]) for i in range(20)]
    a, b = (spark.createDataFrame(x, "trace string, ts int, event_id int, activity string").repartition(n) for x, n in ((rows, 1), (rows[::-1], 3)))
    assert S.variants(a).collect() == S.variants(b).collect()


def test_date_order(spark):
    rows = [("a", 1, "2024-01"), ("a", 2, "2024-01-01"), ("b", 1, "2024-02-02"), ("b", 2, "2024-01"), ("c", 1, "2024-01-01")]
    found = S.in_date_order(spark.createDataFrame(rows, "k string, i int, d string"), "k", ["i"], "d")
    assert {r["k"]: r["in_order"] for r in found.collect()} == {"a": True, "b": False, "c": None}


def departures(spark, *events):
    rows = spark.createDataFrame([("x", kind, date) for kind, date in events], "case string, kind string, date string")
    prec = spark.createDataFrame([("arrest", "plea"), ("plea", "sentencing")], "earlier string, later string")
    found = S.procedure_departures(rows, prec).unionByName(S.both_outcomes(rows, "plea", "verdict", "plea_and_verdict"))
    return sorted(r["departure"] for r in found.collect())


def test_departures(spark):
    assert departures(spark, ("sentencing", "2023-02-25"), ("plea", "2023-04-05")) == ["order"]
    assert departures(spark, ("plea", "2023-04"), ("sentencing", "2023-04-20")) == []  # the month may hold the day before
    assert departures(spark, ("plea", "2021-05-02"), ("sentencing", "2021-10-01"), ("sentencing", "2023-02-09")) == ["repeat"]
    assert departures(spark, ("sentencing", "2021-10"), ("sentencing", "2021-10-01")) == []  # a month and a day in it are one
    assert departures(spark, ("sentencing", "2021-10"), ("sentencing", "2021-10-01"), ("sentencing", "2021-10-02")) == ["repeat"]
    assert departures(spark, ("plea", "2021-05-02"), ("verdict", "2021-10-01"), ("sentencing", None)) == ["plea_and_verdict"]
    assert departures(spark, ("sentencing", "2023-06-12")) == []
    assert departures(spark, ("sentencing", "2023-06-01"), ("arrest", "2023-05-20")) == []  # no rule between these two


def test_divergence_bounds(spark):
    rows = [("a", "x", 1), ("b", "x", 3), ("c", "y", 2)]
    found = {(r["left"], r["right"]): r["bits"] for r in S.divergence(spark.createDataFrame(rows, "grp string, item string, n int")).collect()}
    assert found == {("a", "b"): pytest.approx(0), ("a", "c"): pytest.approx(1), ("b", "c"): pytest.approx(1)}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components(spark, few):
    """A long chain, random graphs and names, on the cluster and in one task."""
    import random

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(45)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for a, b in edges * 2:
        if a != b:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in linkage.connected(frame, few=few).collect()} == root
    names = frame.select(F.concat(F.lit("n"), F.lpad(F.col("a").cast("string"), 5, "0")).alias("a"), F.concat(F.lit("n"), F.lpad(F.col("b").cast("string"), 5, "0")).alias("b"))
    assert {r["node"]: r["root"] for r in linkage.connected(names, few=few).collect()} == {f"n{k:05}": f"n{v:05}" for k, v in root.items()}
    assert linkage.connected(frame.where("false"), few=few).count() == 0


def test_candidates_leave_common_numbers_out(spark):
    numbers = spark.createDataFrame([(i, 7) for i in range(13)] + [(1, 8), (2, 8)], "record_id long, number long")
    case_of = spark.createDataFrame([(i, f"c{i}") for i in range(13)], "record_id long, case_id string")
    assert [tuple(r) for r in linkage.case_candidates(numbers, case_of).collect()] == [(1, 2, 8)]


def test_people(spark):
    rows = [("k", 1, 0, "A. Roe"), ("k", 2, 0, "Ann Roe"), ("k", 3, 0, "Bo Roe"), ("k", 4, 0, "Roe, Ann"), ("m", 9, 0, "A Poe"), ("m", 9, 1, "Ann Poe")]
    frame = spark.createDataFrame(rows, "case_id string, record_id int, ord int, name string")
    key = linkage.name_key(F.col("name"))
    linked = linkage.link_people(frame.select("*", key["surname"].alias("surname"), key["given"].alias("given")))
    assert {(r["name"], r["person"], r["basis"]) for r in linked.collect()} == {
        ("A. Roe", "p1", "name_match"), ("Ann Roe", "p1", "name_match"), ("Bo Roe", "p2", "name_match"), ("Roe, Ann", "p1", "name_match"),
        ("A Poe", "p1", "single_record"), ("Ann Poe", "p2", "single_record"),
    }


def test_attribution(spark):
    values = spark.createDataFrame([(1, "money", 0, 2), (1, "money", 5, 7), (2, "money", 0, 2)], "record_id int, field string, start int, end int")
    votes = spark.createDataFrame([(1, "money", 0, 2, ["p2"])], "record_id int, field string, start int, end int, people array<string>")
    people = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p1")], "record_id int, person string")
    got = {(r["record_id"], r["start"]): (r["people"], r["basis"]) for r in linkage.attribute_values(values, votes, people).collect()}
    assert got == {(1, 0): (["p2"], "vote"), (1, 5): (None, None), (2, 0): (["p1"], "sole_defendant")}


def test_votes_count_by_family(spark):
    rows = [(1, "a", "x", 0.8), (1, "a", "x", 0.9), (1, "b", "y", 0.6), (1, "c", "y", 0.7), (2, "a", "x", 0.6), (3, "a", "x", 0.9), (3, "b", "y", 0.9), (4, "a", "x", 0.9), (4, "human", "z", 1.0)]
    votes = spark.createDataFrame([(r, "f", "", 0, 1, v, fam, c) for r, fam, v, c in rows], "record_id int, field string, role string, start int, end int, value string, family string, confidence double")
    got = {r["record_id"]: (r["value"], r["status"]) for r in resolve.resolve(votes).collect()}
    assert got == {1: ("y", "resolved"), 2: ("x", "review"), 3: ("x", "review"), 4: ("z", "resolved")}


def test_facets(spark):
    frame = spark.createDataFrame(
        [(1, "2020-01-01", ["a"], 3), (2, None, ["a"], 3), (3, "not a date", ["a"], 3), (4, "2020-06-01", ["b"], None)],
        "id int, start string, platforms_used array<string>, victim_count int",
    )
    ids = lambda f: [r["id"] for r in facets.filter_cases(frame, f).orderBy("id").collect()]
    assert ids({}) == [1, 2, 3, 4] and ids({"start": "2020-01-01"}) == [1, 4]
    assert ids({"platform": "b"}) == [4] and ids({"platform": "b", "platforms": ["a"]}) == [1, 2, 3]
    assert ids({"victim_count": {"min": 1}}) == [1, 2, 3]
    ids_first = facets.select_records(frame.withColumnRenamed("id", "record_id"), ids=[2], kind="ignored")
    assert [r["record_id"] for r in ids_first.collect()] == [2]


def test_terms_equal_patterns(spark):
    """One automaton gives the tags of a pattern for each label, in one part and in many."""
    import random

    rng = random.Random(2)
    bits = ["a", "B", "ab", "Ab.", " ", "-", "_", "1", "ü", "token =", "x", "\n", "I"]
    rows = [(rng.choice(["f", "g"]), f"l{rng.randrange(12)}", "".join(rng.choices(bits, k=rng.randint(1, 3)))) for _ in range(60)]
    rows = [r for r in rows if r[2].strip() and "\n" not in r[2]] + [("f", "none", ""), ("f", "none", None)]
    docs = spark.createDataFrame([(i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(400)] + [(None, "ab"), (9, None)], "id int, text string")
    escaped = [(f, n, [re.sub(r"([^\w\s])", r"\\\1", t) for g, m, t in rows if (g, m) == (f, n)]) for f, n in sorted({r[:2] for r in rows if r[2]})]
    want = sorted(map(str, pages.tagged(docs, escaped, "id").collect()))
    terms = spark.createDataFrame(rows, "field string, label string, term string")
    assert len(want) > 200
    for most in (pages.TERMS_CHARS, 30):
        assert sorted(map(str, pages.tagged_by_terms(docs, terms, "id", most).collect())) == want
    assert pages.tagged_by_terms(docs, terms.where("false"), "id").count() == 0


def test_time_of_terms_is_flat():
    """Ten thousand terms take about the time of ten; a pattern for each would take a thousand times as long."""
    import random
    import time

    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    text, took = " ".join(word(6) for _ in range(60_000)), {}
    for n in (10, 10_000):
        known = pages.Terms([("f", str(i % 7), word(9)) for i in range(n)])
        took[n] = min(timed(known, text, time) for _ in range(3))
    assert took[10_000] < 8 * took[10]


def timed(known, text, time):
    began = time.process_time()
    known.tags(text)
    return time.process_time() - began


def test_dates_after_9999(spark):
    """DuckDB writes no sign before a year of five digits."""
    assert one(spark, C.date_text(C.epoch_date(F.col("u"))), u=str(2932975 * 86400)) == "10000-03-19"
    assert one(spark, C.date_text(C.epoch_date(F.col("u"))), u="-1") == "1969-12-31" and one(spark, C.date_text(C.epoch_date(F.col("u"))), u="no") is None


STORY = "II. ELEMENTS\nOne who recruited.\nIV. FACTS\nBo Roe telephoned on 1998-02-06 or 1998-02-07. Bo Roe sent $5. He wired $7 and WIRED $8 on WhatsApp in May 1999.\n2. He deleted it. Agents arrested soldiers."


def test_conduct_is_the_same_in_one_row_and_in_rows(spark):
    """Acts that are read with their windows' marks agree with acts, dates and cues that are joined."""
    from tracework.operators import conduct, tokens

    texts = [(1, STORY), (2, None), (3, ""), (4, "unsold ſold sold sold."), (5, STORY * 3)]
    docs = spark.createDataFrame(texts, "record_id long, text string")
    rows = conduct.conduct(conduct.acts(docs), tokens.read_tokens(docs, ["date"]).select("record_id", "start", "value"), conduct.means_cues(docs))
    read = conduct.read_conduct(docs)
    flat = read.select("record_id", F.inline("acts")).withColumn("precision", conduct.precision_of(F.col("date"))).select(*rows.columns)
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, rows.collect()))
    assert {r["record_id"]: r["path"] for r in conduct.conduct_paths(read).collect()}[1] == "contact>transfer>concealment>detection>supply"


def test_acts_of_a_long_text_take_linear_time():
    import time

    from tracework.operators import conduct

    def seconds(n):
        began = time.perf_counter()
        assert sum(1 for _ in conduct.acts_of("He sold it. Then " * n)) == n
        return time.perf_counter() - began

    assert min(seconds(8000) for _ in range(2)) < 16 * min(seconds(1000) for _ in range(2))


def test_dealt_in_tasks_by_size(spark, sf):
    from tracework.session import dealt, table

    rows = table(spark, sf, "orders")
    assert dealt(rows, 1000).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism == dealt(rows).rdd.getNumPartitions()


def test_similar_pairs_leave_in_pieces(spark, monkeypatch):
    """Equal vectors: every pair, in tiles, within and across blocks."""
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(99, [-1.0, 0.0]), (98, [0.0, 0.0]), (97, None)], "id int, v array<float>")
    monkeypatch.setattr(linkage, "TILE_VECTORS", 3)
    for block in (8192, 7):
        assert sorted((r.a, r.b) for r in linkage.similar_pairs(vectors, 0.9, block).collect()) == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def test_html_blocks_reads_few_pages_at_a_time(spark, sf):
    from tracework.plans.catalog import QUERIES
    from tracework.session import TEXT_ROWS

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        QUERIES["html_blocks"](spark, sf)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == TEXT_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cases_without_their_basis(spark):
    """Statistics ask for no basis, so the links are read once; repeated links change nothing."""
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (1, "c"), (2, "c"), (9, None), (8, None)], "record_id long, key string")
    once, often = linkage.star_edges(members, "record_id", "key"), linkage.star_edges(members, "record_id", "key", distinct=False)
    assert sorted(map(tuple, once.collect())) == [(1, 2), (2, 3)] and sorted(map(tuple, often.collect())) == [(1, 2), (1, 2), (2, 3)]
    records = members.select("record_id").distinct()
    whole = linkage.cases(records, often.withColumn("basis", F.lit("k")))
    assert sorted(map(tuple, linkage.case_of(records, once).collect())) == sorted(map(tuple, whole.select("case_id", "record_id").collect()))
    assert {r.record_id: r.basis for r in whole.collect()} == {1: "k", 2: "k", 3: "k", 8: "single", 9: "single"}
