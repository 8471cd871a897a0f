"""Queries on linked records: orders that share parts stand for records that share docket numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracework.functions import columns as C
from tracework.operators import attribution, conduct, graph, linkage, resolve, triage
from tracework.plans.registry import query
from tracework.session import dealt_by, small, table
from tracework.sources import sinks

#: Records are orders. Strong keys: one customer's orders of a month, and of a priority. Weak numbers: a part from a supplier.
COMPONENTS = """strong AS (SELECT o_orderkey AS record_id, o_custkey || '|' || strftime(o_orderdate, '%Y-%m') AS key FROM orders UNION ALL SELECT o_orderkey, o_custkey || '|' || o_orderpriority FROM orders),
star AS (SELECT DISTINCT m.least AS a, record_id AS b FROM strong JOIN (SELECT key, min(record_id) AS least FROM strong GROUP BY 1) m USING (key) WHERE record_id <> least),
sides AS (SELECT a AS u, b AS v FROM star UNION SELECT b, a FROM star),
reach AS (SELECT u AS node, u AS seen FROM sides UNION SELECT reach.node, v FROM reach JOIN sides ON u = seen),
comp AS (SELECT node, min(seen) AS root FROM reach GROUP BY 1)"""

NUMBERS = """numbers AS (SELECT DISTINCT l_orderkey AS record_id, l_partkey || '-' || l_suppkey AS number FROM lineitem)"""


def numbers(spark, sf):
    number = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), number.alias("number")).distinct()


def links(spark, sf):
    orders = table(spark, sf, "orders")
    key = lambda part: orders.select(F.col("o_orderkey").alias("record_id"), F.concat_ws("|", F.col("o_custkey").cast("string"), part).alias("key"))
    return linkage.star_edges(key(F.date_format("o_orderdate", "yyyy-MM")).unionByName(key(F.col("o_orderpriority"))), "record_id", "key", distinct=False)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT node, root FROM comp")
def case_components(spark, sf):
    return linkage.connected(links(spark, sf))


CASES = COMPONENTS + """,
cases AS (SELECT 'case-' || substr(sha256(CAST(coalesce(root, o_orderkey) AS VARCHAR)), 1, 16) AS case_id, o_orderkey AS record_id, CASE WHEN root IS NULL THEN 'single' ELSE 'customer_key' END AS basis
FROM orders LEFT JOIN comp ON node = o_orderkey)"""


def case_table(spark, sf):
    records = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"))
    return linkage.cases(records, links(spark, sf).withColumn("basis", F.lit("customer_key")))


def case_of(spark, sf):
    """The cases where nobody asks for their basis."""
    return linkage.case_of(table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id")), links(spark, sf))


@query(f"WITH RECURSIVE {CASES} SELECT * FROM cases")
def case_ids(spark, sf):
    return case_table(spark, sf)


@query(f"WITH RECURSIVE {CASES}, s AS (SELECT case_id, count(*) AS n FROM cases GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (n > 1) AS with_more_than_one_record, coalesce(max(n), 0) AS largest FROM s")
def case_statistics(spark, sf):
    return linkage.case_statistics(case_of(spark, sf))


CANDIDATES = """few AS (SELECT number FROM numbers GROUP BY 1 HAVING count(*) <= 12), k AS (SELECT number, record_id, case_id FROM numbers JOIN few USING (number) JOIN cases USING (record_id))"""


@query(f"""WITH RECURSIVE {CASES}, {NUMBERS}, {CANDIDATES}, s AS (SELECT case_id, count(*) AS n FROM cases GROUP BY 1)
SELECT count(*) AS cases, count(*) FILTER (n > 1) AS with_more_than_one_record, coalesce(max(n), 0) AS largest,
(SELECT count(*) FROM k a JOIN k b ON a.number = b.number AND a.record_id < b.record_id AND a.case_id <> b.case_id) AS candidate_links FROM s""")
def linkage_summary(spark, sf):
    found = case_of(spark, sf)
    return linkage.case_statistics(found, linkage.case_candidates(numbers(spark, sf), found))


@query(f"""WITH RECURSIVE {CASES}, {NUMBERS}, few AS (SELECT number FROM numbers GROUP BY 1 HAVING count(*) <= 12), k AS (SELECT number, record_id, case_id FROM numbers JOIN few USING (number) JOIN cases USING (record_id))
SELECT a.record_id AS record_a, b.record_id AS record_b, a.number FROM k a JOIN k b ON a.number = b.number AND a.record_id < b.record_id AND a.case_id <> b.case_id""")
def case_candidates(spark, sf):
    return linkage.case_candidates(numbers(spark, sf), case_of(spark, sf))


@query("""SELECT user_id, act, count(*) AS inside FROM (SELECT user_id, event_id AS act, ts FROM events WHERE event_type = 'purchase') a JOIN (SELECT user_id, ts AS t FROM events WHERE event_type = 'click') m USING (user_id)
WHERE t >= a.ts - INTERVAL 6 HOUR AND t < a.ts + INTERVAL 4 HOUR GROUP BY 1, 2""")
def interval_join(spark, sf):
    return linkage.inside_window(*_acts_and_marks(spark, sf)).groupBy(F.col("record_id").alias("user_id"), "act").agg(F.count(F.lit(1)).alias("inside"))


def _acts_and_marks(spark, sf):
    """Purchases with a window of time around them, and clicks, in microseconds."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("record_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hour = 3_600_000_000
    acts = events.where("event_type = 'purchase'").select("record_id", F.col("event_id").alias("act"), "at", (F.col("at") - 6 * hour).alias("begin"), (F.col("at") + 4 * hour).alias("end"))
    return acts, events.where("event_type = 'click'").select("record_id", F.col("at").alias("pos"), F.col("event_id").alias("value"))


@query("""WITH a AS (SELECT user_id, event_id AS act, ts FROM events WHERE event_type = 'purchase'), m AS (SELECT user_id, ts AS t, event_id AS value FROM events WHERE event_type = 'click'),
n AS (SELECT a.user_id, act, value, row_number() OVER (PARTITION BY act ORDER BY abs(epoch_us(t) - epoch_us(a.ts)), t, value) AS k FROM a JOIN m ON a.user_id = m.user_id AND t >= a.ts - INTERVAL 6 HOUR AND t < a.ts + INTERVAL 4 HOUR)
SELECT a.user_id AS record_id, a.act, n.value FROM a LEFT JOIN n ON a.act = n.act AND k = 1""")
def nearest_date(spark, sf):
    return linkage.nearest_mark(*_acts_and_marks(spark, sf))


#: Customers named by their number stand for the people of a nation's records.
PEOPLE = """m AS (SELECT c_nationkey AS case_id, c_custkey AS record_id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A.' WHEN 2 THEN 'Ada' ELSE 'Bo' END || ' Name' || (c_custkey % 5) AS name,
'name' || (c_custkey % 5) AS surname, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'ada' ELSE 'bo' END AS given, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"""
_FITS = "s[j] = surname AND (g[j] = '' OR given = '' OR g[j] = given OR (least(length(g[j]), length(given)) = 1 AND g[j][1] = given[1]))"


def people(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("record_id"), F.lit(0).alias("ord"),
        F.concat(F.element_at(F.array(F.lit(""), F.lit("A."), F.lit("Ada"), F.lit("Bo")), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit(" Name"), (F.col("c_custkey") % 5).cast("string")).alias("name"),
    )
    key = linkage.name_key(F.col("name"))
    return linkage.link_people(rows.select("case_id", "record_id", "ord", "name", key["surname"].alias("surname"), key["given"].alias("given")))


@query(f"""WITH RECURSIVE {PEOPLE}, r(case_id, i, s, g, person) AS (SELECT case_id, 0, []::VARCHAR[], []::VARCHAR[], 0 FROM m WHERE i = 1 UNION ALL
SELECT case_id, i, CASE WHEN j0 IS NULL THEN list_append(s, surname) ELSE s END, CASE WHEN j0 IS NULL THEN list_append(g, given) WHEN length(given) > length(g[j0]) THEN list_concat(list_append(g[1:j0 - 1], given), g[j0 + 1:]) ELSE g END, coalesce(j0, len(s) + 1)
FROM (SELECT m.case_id, m.i, s, g, surname, given, list_min(list_filter(range(1, len(s) + 1), lambda j: {_FITS})) AS j0 FROM r JOIN m ON m.case_id = r.case_id AND m.i = r.i + 1))
SELECT m.case_id, 'p' || person AS person, m.record_id, m.name, CASE WHEN n = 1 THEN 'single_record' ELSE 'name_match' END AS basis FROM m JOIN r ON r.case_id = m.case_id AND r.i = m.i""")
def people_links(spark, sf):
    return people(spark, sf)


@query("""WITH p AS (SELECT c_nationkey AS case_id, c_custkey % 7 AS person, c_custkey AS record_id FROM customer), b AS (SELECT case_id, person, count(DISTINCT record_id) AS n FROM p GROUP BY 1, 2) SELECT count(*) AS people, count(*) FILTER (n > 1) AS in_more_than_one_record FROM b""")
def people_summary(spark, sf):
    return linkage.people_summary(table(spark, sf, "customer").select(F.col("c_nationkey").alias("case_id"), (F.col("c_custkey") % 7).alias("person"), F.col("c_custkey").alias("record_id")))


@query("""WITH o AS (SELECT o_orderkey, 'http://p/' || o_custkey AS url FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT 'pr-' || substr(sha256('http://p/' || c_custkey), 1, 16) AS id FROM customer WHERE c_nationkey < 20)
SELECT DISTINCT least(CAST(o_orderkey AS VARCHAR), id) AS a, greatest(CAST(o_orderkey AS VARCHAR), id) AS b, 'press_link' AS basis FROM o JOIN p ON id = 'pr-' || substr(sha256(url), 1, 16)""")
def press_links(spark, sf):
    """Orders that name a customer's page stand for filings that name a release; customers of some nations have none."""
    url = lambda c: F.concat(F.lit("http://p/"), F.col(c).cast("string"))
    filings = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.when(F.col("o_orderpriority") == "1-URGENT", url("o_custkey")).alias("press_url"))
    press = table(spark, sf, "customer").where("c_nationkey < 20").select(C.content_id(url("c_custkey"), "pr-").alias("record_id"))
    return linkage.press_links(filings, press)


ATTRIBUTED = """v AS (SELECT l_orderkey AS record_id, 'money' AS field, CAST(l_linenumber AS INT) AS "start", CAST(l_linenumber + 1 AS INT) AS "end" FROM lineitem),
votes AS (SELECT record_id, field, "start", "end", ['p' || ("start" % 3)] AS people FROM v WHERE record_id % 2 = 0 AND "start" < 4),
pp AS (SELECT DISTINCT l_orderkey AS record_id, 'p' || (l_suppkey % 3) AS person FROM lineitem)"""


def values_and_people(spark, sf):
    rows = table(spark, sf, "lineitem")
    at = F.col("l_linenumber").cast("int")
    values = rows.select(F.col("l_orderkey").alias("record_id"), F.lit("money").alias("field"), at.alias("start"), (at + 1).alias("end"))
    votes_ = values.where("record_id % 2 = 0 AND start < 4").withColumn("people", F.array(F.concat(F.lit("p"), (F.col("start") % 3).cast("string"))))
    return values, votes_, rows.select(F.col("l_orderkey").alias("record_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("person")).distinct()


@query(f"""WITH {ATTRIBUTED}, per AS (SELECT record_id, list_sort(list(person)) AS all_people FROM pp GROUP BY 1)
SELECT v.record_id, v."start", array_to_string(coalesce(votes.people, CASE WHEN len(all_people) = 1 THEN all_people END), '+') AS people, CASE WHEN votes.people IS NOT NULL THEN 'vote' WHEN len(all_people) = 1 THEN 'sole_defendant' END AS basis
FROM v LEFT JOIN votes ON v.record_id = votes.record_id AND v."start" = votes."start" JOIN per ON per.record_id = v.record_id""")
def attribute_values(spark, sf):
    found = linkage.attribute_values(*values_and_people(spark, sf))
    return found.select("record_id", "start", F.array_join("people", "+").alias("people"), "basis")


@query(f"""WITH {ATTRIBUTED}, per AS (SELECT record_id, list(person) AS a FROM pp GROUP BY 1) SELECT votes.record_id, votes."start", list_has_all(a, people) AS known FROM votes JOIN per USING (record_id)""")
def known_owners(spark, sf):
    _, votes_, persons = values_and_people(spark, sf)
    return linkage.with_known_owners(votes_.withColumnRenamed("people", "owners"), persons).select("record_id", "start", "known")


@query(f"""WITH {ATTRIBUTED}, x AS (SELECT votes.record_id, "start", unnest(list_concat(people, ['p0'])) AS record_person FROM votes),
c AS (SELECT x.record_id, "start", CASE WHEN pp.person IS NOT NULL THEN 'c' || substr(pp.person, 2) || '-' || (x.record_id % 5) END AS person FROM x LEFT JOIN pp ON pp.record_id = x.record_id AND pp.person = x.record_person)
SELECT record_id, "start", coalesce(string_agg(DISTINCT person, '+' ORDER BY person), '') AS people FROM c GROUP BY 1, 2""")
def case_people(spark, sf):
    """A record's people under their names in its case."""
    _, votes_, persons = values_and_people(spark, sf)
    named = persons.select("record_id", F.col("person").alias("record_person"), F.concat(F.lit("c"), F.substring("person", 2, 9), F.lit("-"), (F.col("record_id") % 5).cast("string")).alias("person"))
    both = votes_.withColumn("people", F.concat("people", F.array(F.lit("p0")))).select("record_id", "start", "people")
    return conduct.case_people(both, named).select("record_id", "start", F.array_join("people", "+").alias("people"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS record_id, l_linenumber || '-' || l_partkey || '-' || l_quantity AS term, CAST(floor(l_quantity) AS INT) % 12 AS months FROM lineitem), d AS (SELECT l_orderkey AS record_id, l_partkey AS label, CAST(l_suppkey % 12 AS INT) AS low, CAST(l_partkey % 12 AS INT) AS high, l_linenumber AS ord FROM lineitem),
b AS (SELECT t.record_id, term, label, CASE WHEN months = high THEN 'maximum' WHEN months = low THEN 'minimum' END AS bound, row_number() OVER (PARTITION BY t.record_id, term ORDER BY ord, label, low) AS k FROM t JOIN d ON t.record_id = d.record_id AND (months = high OR months = low)) SELECT record_id, term, label, bound FROM b WHERE k = 1""")
def first_match(spark, sf):
    """Each line's quantity with the first of its order's lines that has it as a bound."""
    rows, key = table(spark, sf, "lineitem"), F.col("l_orderkey").alias("record_id")
    term = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_quantity")])
    terms = rows.select(key, term.alias("term"), (F.col("l_quantity").cast("int") % 12).alias("months")).distinct()
    bounds = rows.select(key, F.col("l_partkey").alias("label"), (F.col("l_suppkey") % 12).cast("int").alias("low"), (F.col("l_partkey") % 12).cast("int").alias("high"), F.col("l_linenumber").alias("ord"))
    return linkage.first_match_join(terms, bounds, ["ord", "label", "low"]).select("record_id", "term", "label", "bound")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders), e AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), f AS (SELECT o_orderpriority, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT l.o_orderkey, coalesce(e.v, f.v) AS file FROM l LEFT JOIN e USING (o_custkey, o_orderpriority) LEFT JOIN f ON f.o_orderpriority = l.o_orderpriority""")
def cached_match(spark, sf):
    """The kept artefact of both keys, else the first one of the second key."""
    orders = table(spark, sf, "orders")
    kept = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("file"))
    return linkage.exact_then_fallback(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), kept, ["o_custkey", "o_orderpriority"], ["o_orderpriority"], "file").select("o_orderkey", "file")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(s.status, 'skip') AS status FROM part LEFT JOIN (SELECT l_partkey, min(l_linestatus) AS status FROM lineitem WHERE l_quantity > 45 GROUP BY 1) s ON l_partkey = p_partkey""")
def claim_statuses(spark, sf):
    results = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.min("l_linestatus").alias("status"))
    return linkage.claim_statuses(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id")), results)


@query("""WITH s AS (SELECT p_partkey, coalesce(s.status, 'skip') AS status FROM part LEFT JOIN (SELECT l_partkey, min(l_linestatus) AS status FROM lineitem WHERE l_quantity > 45 GROUP BY 1) s ON l_partkey = p_partkey) SELECT CASE WHEN status = 'skip' THEN 'error' ELSE 'written' END AS outcome, count(*) AS n FROM s GROUP BY 1""")
def status_counts(spark, sf):
    return sinks.outcomes(claim_statuses(spark, sf), F.when(F.col("status") == "skip", F.lit("no result")))


@query("""WITH own AS (SELECT o_orderkey AS record_id, o_orderkey % 3 AS ord, 'n' || (o_orderkey % 11) AS number FROM orders), f AS (SELECT l_orderkey AS record_id, 'n' || (l_partkey % 11) AS number, -count(DISTINCT l_linenumber) AS place FROM lineitem GROUP BY 1, 2),
e AS (SELECT record_id, number, min((tier, place)) AS place FROM (SELECT record_id, number, 0 AS tier, ord AS place FROM own UNION ALL SELECT record_id, number, 1, place FROM f) GROUP BY 1, 2)
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY place, number) - 1 AS position, number FROM e""")
def docket_numbers(spark, sf):
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 11).cast("string"))
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 3).alias("ord"), name("o_orderkey").alias("number"))
    spans = F.collect_set(F.struct(F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end")))
    found = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record_id"), name("l_partkey").alias("value")).agg(spans.alias("spans"))
    return resolve.docket_numbers(own, found)


VOTES = """votes AS (SELECT l_orderkey AS record_id, 'mode' AS field, l_linestatus AS role, l_linenumber AS "start", l_linenumber + 1 AS "end", l_returnflag AS value,
'f' || CAST(l_suppkey % 3 AS VARCHAR) AS family, round(0.5 + l_discount * 5, 2) AS confidence FROM (SELECT l_orderkey, l_linestatus, l_returnflag, l_suppkey, l_discount, CAST(l_linenumber % 3 AS INT) AS l_linenumber FROM lineitem))"""


def votes(spark, sf):
    told = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_suppkey", "l_discount")
    rows = dealt_by(told, "l_orderkey").withColumn("s", (F.col("l_linenumber") % 3).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("record_id"), F.lit("mode").alias("field"), F.col("l_linestatus").alias("role"), F.col("s").alias("start"), (F.col("s") + 1).alias("end"), F.col("l_returnflag").alias("value"),
        F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("family"), F.round(0.5 + F.col("l_discount") * 5, 2).alias("confidence"),
    )


@query(f"""WITH {VOTES}, b AS (SELECT record_id, field, role, "start", "end", value, count(DISTINCT family) AS families, max(confidence) AS confidence FROM votes GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id, field, role, "start", "end" ORDER BY families DESC, confidence DESC, value) AS k,
count(*) OVER (PARTITION BY record_id, field, role, "start", "end", families) AS rivals FROM b)
SELECT record_id, field, role, "start", "end", value, families, confidence, CASE WHEN confidence >= 0.7 AND rivals = 1 THEN 'resolved' ELSE 'review' END AS status FROM r WHERE k = 1""")
def resolved_votes(spark, sf):
    return resolve.resolve(votes(spark, sf))


@query(f"""WITH {VOTES}, o AS (SELECT DISTINCT record_id, field, role, "start", "end", family, value FROM votes)
SELECT a.family AS family_a, b.family AS family_b, count(*) AS spans, count(*) FILTER (a.value = b.value) AS agreed FROM o a JOIN o b ON a.record_id = b.record_id AND a.role = b.role AND a."start" = b."start" AND a.family < b.family GROUP BY 1, 2""")
def reader_agreement(spark, sf):
    return resolve.agreement(votes(spark, sf))


SETTLED = f"""{VOTES}, b AS (SELECT record_id, field, role, "start", "end", value, count(DISTINCT family) AS families, max(confidence) AS confidence FROM votes GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id, field, role, "start", "end" ORDER BY families DESC, confidence DESC, value) AS k, count(*) OVER (PARTITION BY record_id, field, role, "start", "end", families) AS rivals FROM b),
settled AS (SELECT DISTINCT record_id, field, role, value FROM r WHERE k = 1 AND confidence >= 0.7 AND rivals = 1)"""


def settled(spark, sf):
    return resolve.finals(resolve.resolve(votes(spark, sf)))


@query(f"""WITH {SETTLED} SELECT field, count(*) AS "values", count(DISTINCT record_id) AS records FROM settled GROUP BY 1""")
def extraction_counts(spark, sf):
    return resolve.extraction_counts(settled(spark, sf))


@query(f"""WITH {SETTLED} SELECT record_id, role, value FROM settled WHERE contains(lower(value), 'a')""")
def extraction_search(spark, sf):
    return resolve.search(settled(spark, sf), "A", "mode").select("record_id", "role", "value")


@query("""WITH v AS (SELECT l_orderkey AS record_id, CASE l_linenumber % 3 WHEN 0 THEN 'money' WHEN 1 THEN 'sentence' ELSE 'date' END AS field, CAST(l_extendedprice AS VARCHAR) AS value, l_extendedprice FROM lineitem)
SELECT record_id, field, CASE WHEN field = 'date' THEN value ELSE printf('%.2f', l_extendedprice) END AS value FROM v""")
def normal_values(spark, sf):
    field = F.element_at(F.array(F.lit("money"), F.lit("sentence"), F.lit("date")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), field.alias("field"), resolve.normal_number(field, F.col("l_extendedprice").cast("string")).alias("value"))


@query("""WITH g AS (SELECT CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END AS label, CASE WHEN o_custkey % 3 = 0 THEN 'dear' WHEN o_custkey % 3 = 1 THEN 'cheap' ELSE 'odd' END AS guess FROM orders), c AS (SELECT unnest(['dear', 'cheap', 'odd']) AS class),
k AS (SELECT class, count(*) FILTER (label = class) AS s, count(*) FILTER (guess = class) AS g, count(*) FILTER (label = class AND guess = class) AS h FROM g, c GROUP BY 1)
SELECT class, CAST(s AS BIGINT) AS support, round(CASE WHEN g > 0 THEN h / g ELSE 0 END, 6) AS "precision", round(CASE WHEN s > 0 THEN h / s ELSE 0 END, 6) AS recall, round(CASE WHEN s + g > 0 THEN 2 * h / (s + g) ELSE 0 END, 6) AS f1 FROM k""")
def class_report(spark, sf):
    found = resolve.class_report(_priced(spark, sf), "label", "guess")
    return found.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _priced(spark, sf):
    """Orders with a class and a guess at it."""
    guess = F.element_at(F.array(F.lit("dear"), F.lit("cheap"), F.lit("odd")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, "dear").otherwise("cheap").alias("label"), guess.alias("guess"))


@query("""SELECT count(*) AS n, round(avg((CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END = CASE WHEN o_custkey % 3 = 0 THEN 'dear' WHEN o_custkey % 3 = 1 THEN 'cheap' ELSE 'odd' END)::INT), 6) AS accuracy FROM orders""")
def accuracy(spark, sf):
    return resolve.accuracy(_priced(spark, sf), "label", "guess").withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH g AS (SELECT o_custkey % 2 AS placed, CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END = CASE WHEN o_custkey % 3 = 0 THEN 'dear' WHEN o_custkey % 3 = 1 THEN 'cheap' ELSE 'odd' END AS hit FROM orders) SELECT count(*) AS placed, count(*) FILTER (hit) AS "right", round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM g WHERE placed = 1""")
def placed_accuracy(spark, sf):
    """Of the orders that have a guess at all, those guessed right."""
    rows = _priced(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    truth, found = rows.select("o_orderkey", F.col("label").alias("value")), rows.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 1, F.col("guess")).alias("value"))
    return resolve.placed_accuracy(truth, found, ["o_orderkey"], "value").withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH g AS (SELECT doc_id, lang, quality, CASE WHEN regexp_matches(text, '[|]') THEN 0 ELSE 1 END AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang AS field, count(*) FILTER (quality = 0 AND p = 0) AS tp, count(*) FILTER (quality = 1 AND p = 0) AS fp, count(*) FILTER (quality = 0 AND p = 1) AS fn FROM g GROUP BY 1),
f AS (SELECT * FROM (VALUES ('en', 0.97), ('de', 0.0), ('fr', 0.95), ('xx', 0.1)) AS t(field, floor)), s AS (SELECT field, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c WHERE tp + fp + fn > 0)
SELECT f.field, round(coalesce(f1, 0), 6) AS f1, CAST(floor AS DOUBLE) AS floor FROM f LEFT JOIN s ON s.field = f.field WHERE coalesce(f1, 0) < floor""")
def below_floors(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("lang").alias("field"), "quality", F.col("text").contains("|").alias("bad"))
    scores = resolve.score(rows.where("quality = 0"), rows.where("bad"), ["field", "doc_id"], "field")
    floors = spark.createDataFrame([("en", 0.97), ("de", 0.0), ("fr", 0.95), ("xx", 0.1)], "field string, floor double")
    return resolve.below_floors(scores, floors).withColumn("f1", F.round("f1", 6))


@query("""SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def dimension_lookup(spark, sf):
    """A fact joined to a dimension of fixed size."""
    found = table(spark, sf, "supplier").join(small(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return found.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("""SELECT c_nationkey AS node, count(DISTINCT c_mktsegment) AS cases, count(DISTINCT c_mktsegment) > 1 AS shared FROM customer GROUP BY 1""")
def shared_nodes(spark, sf):
    return linkage.shared_nodes(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("case"), F.col("c_nationkey").alias("s")))


@query("""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM u)
SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.5""")
def cosine_pairs(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return linkage.similar_pairs(vectors, 0.5).select("a", "b")


@query("""WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM u),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.5), sides AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
reach AS (SELECT x AS node, x AS seen FROM sides UNION SELECT reach.node, y FROM reach JOIN sides ON x = seen) SELECT node, min(seen) AS root FROM reach GROUP BY 1""")
def similarity_clusters(spark, sf):
    """Components of the similar pairs."""
    return linkage.connected(cosine_pairs(spark, sf))


def star_triples(spark, sf):
    """The star schema as triples: customers and suppliers in nations, nations in regions."""
    rows = lambda name, key, p, to, kind: table(spark, sf, name).select(
        F.concat(F.lit(kind[0] + ":"), F.col(key).cast("string")).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(kind[1] + ":"), F.col(to).cast("string")).alias("o"), F.lit("iri").alias("o_kind")
    )
    typed = lambda name, key, kind, cls: table(spark, sf, name).select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("s"), F.lit(graph.TYPE).alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind"))
    return (
        rows("customer", "c_custkey", "in", "c_nationkey", ("c", "n")).unionByName(rows("supplier", "s_suppkey", "in", "s_nationkey", ("s", "n")))
        .unionByName(rows("nation", "n_nationkey", "part", "n_regionkey", ("n", "r"))).unionByName(typed("customer", "c_custkey", "c", "Customer")).unionByName(typed("nation", "n_nationkey", "n", "Nation"))
    )


@query("""SELECT 's:' || s_suppkey AS supplier, 'n:' || n_nationkey AS nation, 'r:' || n_regionkey AS region, 'c:' || c_custkey AS customer FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 10 = s_suppkey % 10""")
def graph_pattern(spark, sf):
    """Suppliers and customers of one nation, all regions; the last condition is a filter on the bindings."""
    found = graph.match(star_triples(spark, sf), [("?supplier", "in", "?nation"), ("?nation", "part", "?region"), ("?customer", "in", "?nation"), ("?customer", "a", "Customer")])
    number = lambda c: F.substring(c, 3, 20).cast("long") % 10
    return found.where(F.col("supplier").startswith("s:") & (number("customer") == number("supplier"))).select("supplier", "nation", "region", "customer")


@query("""SELECT 'n:' || n_nationkey AS node, 'part' AS p, 'r:' || n_regionkey AS other, true AS outward FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'in', 'c:' || c_custkey, false FROM customer
UNION ALL SELECT 'n:' || s_nationkey, 'in', 's:' || s_suppkey, false FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'a', 'Nation', true FROM nation""")
def graph_neighbours(spark, sf):
    """The neighbours of every nation."""
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.neighbours(star_triples(spark, sf), nodes)


@query("""SELECT 'Customer' AS cls, count(*) AS nodes, count(*) AS statements FROM customer UNION ALL SELECT 'Nation', count(*), count(*) FROM nation""")
def graph_summary(spark, sf):
    """Nodes of each class, and the statements they make beside their class."""
    return graph.summary(star_triples(spark, sf))


@query("""SELECT 'c:' || c_custkey AS node, 'Customer' AS cls FROM customer WHERE c_custkey % 100 = 77 UNION ALL SELECT 'n:' || n_nationkey, 'Nation' FROM nation WHERE n_nationkey % 100 = 77""")
def concept_search(spark, sf):
    return graph.search(star_triples(spark, sf), ":([0-9]*[0-9])?77$").where("node RLIKE '77$'")


@query("""WITH l AS (SELECT c_mktsegment AS cls FROM customer WHERE c_nationkey < 12), r AS (SELECT c_mktsegment AS cls FROM customer WHERE c_acctbal > 9990 UNION ALL SELECT 'Extra') SELECT cls, CASE WHEN cls IN (SELECT cls FROM l) AND cls IN (SELECT cls FROM r) THEN 'both' WHEN cls IN (SELECT cls FROM l) THEN 'left' ELSE 'right' END AS side FROM (SELECT cls FROM l UNION SELECT cls FROM r)""")
def cohort_classes(spark, sf):
    typed = lambda rows: rows.select(F.col("c_custkey").cast("string").alias("s"), F.lit(graph.TYPE).alias("p"), F.col("c_mktsegment").alias("o"))
    customers = table(spark, sf, "customer")
    extra = spark.createDataFrame([("x", graph.TYPE, "Extra")], "s string, p string, o string")
    return graph.cohort_difference(typed(customers.where("c_nationkey < 12")), typed(customers.where("c_acctbal > 9990")).unionByName(extra))


@query("""SELECT 'n:' || n_nationkey AS s, cls AS o FROM nation, (VALUES ('Nation'), ('Place'), ('Thing')) AS v(cls) UNION ALL SELECT 'c:' || c_custkey, cls FROM customer, (VALUES ('Customer'), ('Party'), ('Thing')) AS v(cls)""")
def subclass_bridge(spark, sf):
    edges = spark.createDataFrame([("Nation", "Place"), ("Place", "Thing"), ("Customer", "Party"), ("Party", "Thing")], "sub string, super string")
    return graph.with_supertypes(star_triples(spark, sf), graph.subclasses(edges)).where(F.col("p") == graph.TYPE).select("s", "o")


#: Rules for subsets of cases, a fixed vocabulary: (subset, test that Spark and SQL read alike).
SUBSETS = [("urgent", "o_orderpriority = '1-URGENT'"), ("dear", "o_totalprice > 200000"), ("open", "o_orderstatus = 'O'")]


@query("WITH t AS (" + " UNION ALL ".join(f"SELECT '{name}' AS subset, o_orderkey FROM orders WHERE {test}" for name, test in SUBSETS) + ") SELECT subset, count(*) AS cases, min(o_orderkey) AS first, max(o_orderkey) AS last FROM t GROUP BY 1")
def case_subsets(spark, sf):
    """Cases under every subset whose rule they meet, and each subset's candidates."""
    found = graph.subset_candidates(table(spark, sf, "orders"), "o_orderkey", SUBSETS)
    return found.groupBy("subset").agg(F.count(F.lit(1)).alias("cases"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("""WITH c AS (SELECT n_nationkey, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), k AS (SELECT 'n:' || n_nationkey AS s, coalesce(n, 0) AS n FROM nation LEFT JOIN c USING (n_nationkey))
SELECT 'n:' || n_nationkey AS s, 'part' AS path, 'class' AS rule FROM nation UNION ALL SELECT s, 'has', 'min' FROM k WHERE n < 2 UNION ALL SELECT s, 'has', 'max' FROM k WHERE n > 4 UNION ALL SELECT s, 'has', 'kind' FROM k WHERE n > 0""")
def shape_violations(spark, sf):
    """Nations are part of a region (which has no class here) and have two to four suppliers, as literals."""
    has = table(spark, sf, "supplier").select(F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("s"), F.lit("has").alias("p"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("o"), F.lit("iri").alias("o_kind"))
    shapes = [{"path": "part", "min": 1, "max": 1, "cls": "Region", "kind": "iri"}, {"path": "has", "min": 2, "max": 4, "kind": "string"}]
    return graph.violations(star_triples(spark, sf).unionByName(has), "Nation", shapes)


#: Three lines of an order are a sentence; lines of most suppliers are mentions of people, the others values. A list joins a
#: mention of an even quantity to the one right before it; sentences with a deep discount carry the ones before them on.
TOLD = """u AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey AS record_id, (CAST(l_linenumber AS INT) - 1) // 3 AS sentence, CAST(l_linenumber AS INT) * 10 AS at_, 's' || l_suppkey AS person, l_suppkey % 3 <> 0 AS mention, CAST(floor(l_quantity) AS INT) % 2 = 0 AS even, l_discount > 0.05 AS deep FROM u),
s AS (SELECT record_id, sentence, bool_or(deep) AS carried FROM l GROUP BY 1, 2),
m AS (SELECT record_id, sentence, at_, person, even AND coalesce(at_ - lag(at_) OVER w = 10, false) AS joined FROM l WHERE mention WINDOW w AS (PARTITION BY record_id, sentence ORDER BY at_)),
g AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY record_id, sentence ORDER BY at_) AS grp FROM m),
p AS (SELECT record_id, sentence, at_, grp, list_distinct(list(person) OVER (PARTITION BY record_id, sentence, grp ORDER BY at_)) AS found FROM g),
f AS (SELECT record_id, sentence, arg_max(found, at_) AS found FROM p WHERE grp = 1 GROUP BY 1, 2),
v AS (SELECT l.record_id, l.sentence, l.at_, (SELECT arg_max(found, p.at_) FROM p WHERE p.record_id = l.record_id AND p.sentence = l.sentence AND p.at_ < l.at_) AS own, CASE WHEN carried THEN coalesce(a.found, b.found) END AS back
  FROM l JOIN s ON s.record_id = l.record_id AND s.sentence = l.sentence LEFT JOIN f a ON a.record_id = l.record_id AND a.sentence = l.sentence - 1 LEFT JOIN f b ON b.record_id = l.record_id AND b.sentence = l.sentence - 2 WHERE NOT mention)"""


@query(f"""WITH {TOLD} SELECT record_id, at_ AS "start", coalesce(array_to_string(list_sort(coalesce(own, back)), '+'), '') AS people, CAST(CASE WHEN own IS NOT NULL THEN 0.75 WHEN back IS NOT NULL THEN 0.6 ELSE 0 END AS DOUBLE) AS confidence,
CASE WHEN own IS NOT NULL THEN 'same_sentence' WHEN back IS NOT NULL THEN 'carried_from_previous_sentence' ELSE 'none' END AS rule FROM v""")
def person_carry_over(spark, sf):
    at = F.col("l_linenumber").cast("int")
    kept = ["l_suppkey", "l_quantity", "l_discount"]
    told = dealt_by(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *kept), "l_orderkey")
    lines = told.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in kept])
    rows = lines.select(
        F.col("l_orderkey").alias("record_id"), F.floor((at - 1) / 3).cast("int").alias("sentence"), (at * 10).alias("at"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("person"),
        (F.col("l_suppkey") % 3 != 0).alias("mention"), (F.col("l_quantity").cast("int") % 2 == 0).alias("even"), (F.col("l_discount") > 0.05).alias("carried"),
    )
    from pyspark.sql import Window

    before = Window.partitionBy("record_id", "sentence").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("mention"), F.col("at")), True).over(before)
    marks = rows.withColumn("joined", F.col("even") & F.coalesce(F.col("at") - last == 10, F.lit(False)))
    value = F.when(~F.col("mention"), F.struct(F.col("at").alias("start")))
    what = F.when(F.col("mention"), "mention").when(~F.col("mention"), "value").otherwise("sentence")
    marks = marks.select("record_id", "sentence", what.alias("what"), F.when(F.col("mention"), F.col("at") - 9).otherwise(F.col("at")).alias("begin"), F.col("at").alias("finish"), "person", "joined", "carried", value.alias("value"))
    found = attribution.subjects_of(marks)
    return found.select("record_id", "value.start", F.array_join(F.array_sort("people"), "+").alias("people"), "confidence", "rule")


@query()
def triage_predictions(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    found, _ = triage.triage(rows, "o_orderkey", ["c_acctbal", "nation"], "o_totalprice", kind="tree")
    return found
