"""Queries on filings: short invented reports made of orders, whose tokens, people and acts are known by construction.

A report is a list of parts, SQL texts that Spark and DuckDB read alike. Oracles know a token by the part that it is:
its start is the length of the parts before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from tracework.functions import vocabulary as V
from tracework.operators import attribution, conduct, evidence, extractors, pages, resolve, tokens
from tracework.operators import machine as M
from tracework.plans.registry import query
from tracework.session import dealt, table


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


GIVEN, SURNAMES = ["Ada", "Bo", "Cy", "Di"], ["Roe", "Poe", "Doe", "Moe", "Noe", "Coe", "Foe"]
SUR1, SUR2 = _case("o_custkey % 7", SURNAMES), _case("(o_custkey + 3) % 7", SURNAMES)
WHO1, WHO2 = f"concat({_case('o_custkey % 4', GIVEN)}, ' ', {SUR1})", f"concat({_case('(o_custkey + 1) % 4', GIVEN)}, ' ', {SUR2})"
DAY = "substr(concat('', o_orderdate), 1, 10)"
WHOLE = "CAST(floor(o_totalprice) AS BIGINT)"
AMOUNT = f"concat('$', concat('', CAST(floor({WHOLE} / 1000) AS BIGINT)), ',', lpad(concat('', {WHOLE} % 1000), 3, '0'), '.50')"
AMOUNT_VALUE = f"concat(concat('', {WHOLE}), '.50')"
MONTHS, BOUND = "concat('', o_orderkey % 30 + 6)", _case("o_orderkey % 3", ["240", "60", "99"])
SECTION = _case("o_orderkey % 2", ["1343", "1001"])
NUMBER = f"concat('1:', substr({DAY}, 3, 2), '-cr-', lpad(concat('', o_orderkey % 100000), 5, '0'))"
KIND = "CASE o_orderkey % 5 WHEN 3 THEN 'court' WHEN 2 THEN 'reference' ELSE 'press' END"
ONE, BOTH = SUR1, f"concat({SUR1}, '+', {SUR2})"


@dataclass(frozen=True)
class Part:
    """A part of a report; with kind a token with its value; people and rule are what the value belongs to, and by what."""

    text: str
    kind: str = ""
    value: str = ""
    people: str = "''"
    rule: str = "none"


def _who(*names: str) -> list[Part]:
    return [Part(n, "party", n) for n in names]


def _money(**of) -> Part:
    return Part(AMOUNT, "money", AMOUNT_VALUE, **of)


def _term(**of) -> Part:
    return Part(f"concat({MONTHS}, ' months')", "duration", MONTHS, **of)


SAME, BACK, LINE = "same_sentence", "carried_from_previous_sentence", "defendant_line"
CONFIDENCE = {SAME: 0.75, BACK: 0.6, LINE: 0.7, "none": 0.0}
_SAID = Part("'sentenced'", "event", "'sentencing'")
#: Reports by o_orderkey % 5.
REPORTS = [
    [*_who(WHO1), Part("' was '"), _SAID, Part("' to '"), _term(people=ONE, rule=SAME), Part("'. He was ordered to pay '"), _money(people=ONE, rule=BACK), Part("'.'")],
    [Part("'Judge '"), *_who("'Eve Hale'"), Part("' '"), _SAID, Part("' '"), *_who(WHO1), Part("' and '"), *_who(WHO2), Part("' to '"), _term(people=BOTH, rule=SAME), Part("'. In addition, They must pay '"), _money(people=BOTH, rule=BACK), Part("'.'")],
    [*_who(WHO1), Part("' met '"), *_who(WHO2), Part("'. The plan cost '"), _money(), Part("'.'")],
    [Part("'DEFENDANT: '"), *_who(WHO1), Part("'\\nCOUNTY OF X.\\nThe court found a loss of '"), _money(people=ONE, rule=LINE), Part("'.'")],
    [*_who(WHO1), Part("', '"), *_who(WHO2), Part("' ran it. Nothing else was said. The court ordered them to pay '"), _money(people=BOTH, rule=BACK), Part("'.'")],
]


def _closing(k: int) -> list[Part]:
    heading = {"people": ONE, "rule": LINE} if k == 3 else {}
    return [
        Part("' It was in violation of '"), Part(f"concat('18 U.S.C. § ', {SECTION})", "statute", f"concat('18 U.S.C. § ', {SECTION})"), Part("', and the maximum is '"),
        Part(f"concat({BOUND}, ' months')", "duration", BOUND, **heading), Part("', in case '"), Part(NUMBER, "case_number", NUMBER), Part("', on '"), Part(DAY, "date", DAY), Part("'.'"),
    ]


REPORTS = [[*r, *_closing(k)] for k, r in enumerate(REPORTS)]


def _text_sql(reports: list[list[Part]], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN concat({', '.join(p.text for p in parts)})" for k, parts in enumerate(reports)) + " END"


def _sql(text: str) -> str:
    """For DuckDB, which has no escapes in texts and adds nothing to numbers that it concatenates."""
    return text.replace("\\n", "' || chr(10) || '")


TEXT = _text_sql(REPORTS, "o_orderkey % 5")


def _tokens_sql() -> str:
    out = []
    for k, parts in enumerate(REPORTS):
        for i, p in enumerate(parts):
            if p.kind:
                start = " + ".join(["0", *[f"length({q.text})" for q in parts[:i]]])
                out.append(f"""SELECT o_orderkey AS record_id, '{p.kind}' AS kind, CAST({start} AS INT) AS "start", CAST({start} + length({p.text}) AS INT) AS "end", {p.value} AS value, {p.people} AS people, '{p.rule}' AS rule, CAST({CONFIDENCE[p.rule]} AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 5 = {k}""")
    return _sql("told AS (" + " UNION ALL ".join(out) + ")")


TOKENS = _tokens_sql()
KINDS = ["money", "date", "statute", "case_number", "duration", "party", "event"]


def filings(spark, sf):
    return dealt(table(spark, sf, "orders")).selectExpr("o_orderkey AS record_id", f"{KIND} AS kind", f"{TEXT} AS text")


def found_tokens(spark, sf, *kinds: str):
    return tokens.read_tokens(filings(spark, sf), list(kinds) or KINDS)


@query(f"""WITH {TOKENS} SELECT record_id, kind, "start", "end", value FROM told""")
def filing_tokens(spark, sf):
    """Typed tokens of every kind with their spans."""
    return found_tokens(spark, sf)


@query(f"""WITH {TOKENS} SELECT record_id, "start", value FROM told WHERE kind = 'money'""")
def lateral_tokens(spark, sf):
    """The same through the table function of SQL."""
    tokens.register(spark)
    filings(spark, sf).createOrReplaceTempView("tracework_filings")
    return spark.sql("SELECT record_id, t.start, t.value FROM tracework_filings, LATERAL typed_tokens(text, 'money') AS t")


@query(f"""WITH {TOKENS} SELECT record_id, kind, "start", value, people, rule, confidence FROM told WHERE kind IN ('money', 'duration')""")
def attributed_values(spark, sf):
    """Whose each amount and term is."""
    read = tokens.tokens_in_rows(filings(spark, sf), ["money", "duration"])
    found = attribution.attributed_rows(read.withColumnRenamed("hits", "values"))
    return found.select("record_id", "value.kind", "value.start", F.col("value.value").alias("value"), F.array_join("people", "+").alias("people"), "rule", "confidence")


STATUTES = "st(title, section, label, low, high) AS (VALUES " + ", ".join(f"('{t}', '{s}', '{label}', {low or 'NULL'}, {high or 'NULL'})" for t, s, label, low, high, _ in V.STATUTES) + ")"


@query(f"""WITH {TOKENS}, {STATUTES}, c AS (SELECT record_id, "start", "end", string_split(value, ' ') AS v FROM told WHERE kind = 'statute') SELECT record_id, "start", label, CAST(high AS INT) AS high FROM c JOIN st ON title = v[1] AND section = v[4]""")
def cited_statutes(spark, sf):
    cited = evidence.cited_statutes(tokens.citations(found_tokens(spark, sf, "statute")), V.statutes(spark))
    return cited.select("record_id", "start", "label", "high")


@query(f"""WITH {TOKENS}, d AS (SELECT record_id, "start", CAST(value AS INT) AS months, row_number() OVER (PARTITION BY record_id ORDER BY "start" DESC) = 1 AND record_id % 5 IN (0, 1) OR record_id % 5 > 1 AS open FROM told WHERE kind = 'duration'),
b AS (SELECT *, CASE WHEN months = CASE WHEN record_id % 2 = 0 THEN 240 ELSE 60 END THEN 'maximum' END AS bound FROM d WHERE open)
SELECT record_id, 'offense' AS field, 'present' AS role, "start", CASE WHEN record_id % 2 = 0 THEN 'wire_fraud' ELSE 'false_statements' END AS value, NULL AS bound FROM told WHERE kind = 'statute'
UNION ALL SELECT record_id, 'sentence', 'exposure', "start", CAST(months AS VARCHAR), bound FROM b WHERE bound IS NOT NULL""")
def statute_votes(spark, sf):
    """Offenses by citation, and terms without a cue of their own that equal a cited bound."""
    read = tokens.tokens_in_rows(filings(spark, sf).select("record_id", "text"), ["statute", "duration"])
    rows = read.select("record_id", tokens.citations_in(F.col("hits")).alias("citations"), tokens.terms_in(F.col("text"), F.col("hits")).alias("terms"))
    return evidence.statute_votes_in_rows(rows, V.statutes(spark)).select("record_id", "field", "role", "start", "value", "bound")


#: (reader, kinds, method, version, rank)
READERS = [("tokens", ["press", "court", "reference"], "regex", "t1", 10), ("statutes", ["press", "court"], "statute_table", "s1", 30), ("people", ["court"], "clause_subject", "p1", 30)]
PLAN = "plan(reader, kind, method, rank) AS (VALUES " + ", ".join(f"('{r}', '{k}', '{m}', {rank})" for r, kinds, m, _, rank in READERS for k in kinds) + ")"


@query(f"WITH {PLAN}, f AS (SELECT o_orderkey AS record_id, {KIND} AS kind FROM orders) SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY rank, reader) AS turn, reader FROM f JOIN plan USING (kind)")
def reader_dispatch(spark, sf):
    return evidence.dispatched(filings(spark, sf), evidence.reading_plan(spark, READERS))


@query(f"""WITH {TOKENS}, f AS (SELECT told.*, {KIND} AS of FROM told JOIN orders ON o_orderkey = record_id)
SELECT method, family, count(*) AS votes FROM (SELECT 'regex' AS method, 'surface_pattern' AS family FROM f WHERE kind = 'money' UNION ALL SELECT 'statute_table', 'lookup' FROM f WHERE kind = 'statute' AND of IN ('press', 'court')) GROUP BY 1, 2""")
def reader_votes(spark, sf):
    """The votes of readers, each over the records of its kinds, with method and family from the plan."""

    def amounts(docs):
        return tokens.read_tokens(docs, ["money"]).select("record_id", F.col("kind").alias("field"), F.lit("unknown").alias("role"), "start", "end", "value", F.lit(0.9).alias("confidence"))

    def offenses(docs):
        return evidence.statute_votes(evidence.cited_statutes(tokens.citations(tokens.read_tokens(docs, ["statute"])), V.statutes(spark)), spark.createDataFrame([], "record_id long, start int, end int, months int, kind string")).drop("bound")

    votes = evidence.read_votes(filings(spark, sf), evidence.reading_plan(spark, READERS), {"tokens": amounts, "statutes": offenses})
    return votes.groupBy("method", "family").agg(F.count(F.lit(1)).alias("votes"))


@query(f"""WITH {TOKENS} SELECT kind, count(*) FILTER (record_id % 3 <> 0) AS passed FROM told WHERE kind IN ('party', 'date') GROUP BY 1 HAVING count(*) FILTER (record_id % 3 <> 0) > 0""")
def span_gate(spark, sf):
    """Votes whose quote stands at their span; those of every third record are off by one."""
    off = F.when(F.col("record_id") % 3 == 0, 1).otherwise(0)
    votes = found_tokens(spark, sf, "party", "date").select("record_id", "kind", (F.col("start") + off).alias("start"), (F.col("end") + off).alias("end"), F.col("value").alias("quote"))
    return resolve.gated(votes, filings(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("passed"))


@query(f"""WITH p AS (SELECT o_orderkey, {WHO1} AS a, {WHO2} AS b, {SUR1} AS s1, {SUR2} AS s2, o_orderkey % 5 AS k FROM orders WHERE o_orderkey % 5 IN (2, 4)), t AS (SELECT o_orderkey, {TEXT} AS text FROM orders)
SELECT o_orderkey AS record_id, sha256(replace(replace(text, a, 'Person 1'), b, 'Person 2')) AS digest, 0 AS leaks FROM p JOIN t USING (o_orderkey)""".replace("\\n", "' || chr(10) || '"))
def people_numbered(spark, sf):
    """Names give way to numbers; what is left over is counted."""
    docs = filings(spark, sf).where("record_id % 5 IN (2, 4)")
    names = tokens.read_tokens(docs, ["party"]).select("record_id", F.col("value").alias("name"))
    return pages.people_numbered(docs, names, "record_id").select("record_id", F.sha2("text", 256).alias("digest"), "leaks")


#: A second kind of report: what someone did, with a recital of the law before every third.
RECITED = "CASE o_orderkey % 3 WHEN 0 THEN 'II. ELEMENTS OF THE OFFENSE\\nThe law speaks of one who recruited or threatened a person.\\nIV. FACTS\\n' ELSE '' END"
STEPS = [
    (RECITED, None), (WHO1, None), ("' '", None), ("'created a profile'", "setup"), ("' on a forum. '", None), (WHO1, None), ("' '", None), ("'sent several messages'", "contact"),
    (f"concat(' on Telegram on ', {DAY}, '. ')", None), (WHO2, None), ("' '", None), ("'sent $'", "transfer"), (f"concat({WHOLE}, ' by wire. ')", None), (WHO1, None), ("' '", None),
    ("CASE o_orderkey % 2 WHEN 0 THEN 'withdrew' ELSE 'kept' END", "movement"), ("' it in cash. Agents '", None), ("'executed a search warrant'", "detection"), ("' there.'", None),
]
STORY = "concat(" + ", ".join(text for text, _ in STEPS) + ")"


def _acts_sql() -> str:
    out = []
    for i, (text, kind) in enumerate(STEPS):
        if kind:
            start = " + ".join(["0", *[f"length({t})" for t, _ in STEPS[:i]]])
            test = " WHERE o_orderkey % 2 = 0" if kind == "movement" else ""
            date, means = (DAY, "'telegram'") if kind == "contact" else ("NULL", "''")
            out.append(f"""SELECT o_orderkey AS record_id, '{kind}' AS kind, '{conduct.PHASES[kind]}' AS phase, CAST({start} AS INT) AS "start", CAST({start} + length({text}) AS INT) AS "end", {date} AS date, {means} AS means FROM orders{test}""")
    return _sql("acts AS (" + " UNION ALL ".join(out) + ")")


ACTS = _acts_sql()


def stories(spark, sf):
    return dealt(table(spark, sf, "orders")).selectExpr("o_orderkey AS record_id", f"{STORY} AS text", "CASE o_orderkey % 2 WHEN 0 THEN 'court' ELSE 'press' END AS kind", "concat('d', o_custkey % 3) AS domain")


def told(spark, sf):
    return conduct.read_conduct(stories(spark, sf))


@query(f"""WITH {ACTS} SELECT record_id, kind, "start", "end" FROM acts UNION ALL SELECT o_orderkey, 'not_conduct', 28 + length('The law speaks of one who '), 28 + length('The law speaks of one who recruited') FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
SELECT o_orderkey, 'not_conduct', 28 + length('The law speaks of one who recruited or '), 28 + length('The law speaks of one who recruited or threatened') FROM orders WHERE o_orderkey % 3 = 0""")
def act_spans(spark, sf):
    """Acts by their cues; what a verb means is decided by what follows it; a recital of the law is no conduct."""
    return conduct.acts(stories(spark, sf)).select("record_id", "kind", "start", "end")


@query(_sql(f"""WITH {ACTS}, t AS (SELECT o_orderkey AS record_id, {STORY} AS text FROM orders), w AS (SELECT record_id, kind, regexp_split_to_array(text[1:"start"], '[.] ')[-1] || regexp_split_to_array(text["start" + 1:], '[.]( |$)')[1] AS said FROM acts JOIN t USING (record_id))
SELECT record_id, kind, sha256(regexp_replace(said, '^.*FACTS.', '', 's')) AS digest FROM w"""))
def act_windows(spark, sf):
    """The text around an act that its date and means may stand in."""
    read = tokens.in_arrays(stories(spark, sf).select("record_id", "text"), conduct.acts_of, "kind string, start int, end int, begin int, finish int")
    found = read.select("record_id", "text", F.inline("hits")).where("kind <> 'not_conduct'")
    said = F.regexp_replace(F.rtrim(F.substr(F.col("text"), F.col("begin") + 1, F.col("finish") - F.col("begin"))), "[.]$", "")
    return found.select("record_id", "kind", F.sha2(F.regexp_replace(said, "(?s)^.*FACTS.", ""), 256).alias("digest"))


@query(f"""WITH {ACTS} SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY "start") - 1 AS position, kind, phase, date, CASE WHEN date IS NULL THEN 'none' ELSE 'day' END AS "precision", means FROM acts""")
def conduct_steps(spark, sf):
    acts = told(spark, sf).select("record_id", F.inline("acts"))
    return acts.select("record_id", F.col("position").cast("long").alias("position"), "kind", "phase", "date", conduct.precision_of(F.col("date")).alias("precision"), F.array_join("means", "+").alias("means"))


def _paths_sql(step: str, test: str = "true") -> str:
    return f"""SELECT record_id, string_agg(s, '>' ORDER BY "start") AS path FROM (SELECT *, lag(s) OVER (PARTITION BY record_id ORDER BY "start") AS b FROM (SELECT *, {step} AS s FROM acts WHERE {test})) WHERE b IS NULL OR b <> s GROUP BY 1"""


@query(f"""WITH {ACTS}, p AS (SELECT 'act' AS level, * FROM ({_paths_sql('kind')}) UNION ALL SELECT 'phase', * FROM ({_paths_sql('phase')}) UNION ALL SELECT 'means', * FROM ({_paths_sql("kind || CASE WHEN means <> '' THEN '[' || means || ']' ELSE '' END")})
UNION ALL SELECT 'undetected', * FROM ({_paths_sql('kind', "kind <> 'detection'")})) SELECT level, path, count(*) AS n FROM p GROUP BY 1, 2""")
def conduct_paths(spark, sf):
    """Paths at three levels, and without what investigators did."""
    acts = F.col("acts")
    paths = {**{level: conduct.path_of(acts, level) for level in ("act", "phase", "means")}, "undetected": conduct.path_of(acts, with_detection=False)}
    every = told(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(level).alias("level"), path.alias("path")) for level, path in paths.items()])))
    return every.where("path <> ''").groupBy("level", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ACTS}, p AS ({_paths_sql('kind')}), n AS (SELECT record_id, count(*) AS acts FROM acts GROUP BY 1)
SELECT record_id, CASE record_id % 2 WHEN 0 THEN 'court' ELSE 'press' END AS record_kind, 'd' || (o_custkey % 3) AS domain, acts, path FROM p JOIN n USING (record_id) JOIN orders ON o_orderkey = record_id""")
def exported_trajectories(spark, sf):
    found = conduct.exported(told(spark, sf))
    return found.select("record_id", "record_kind", "domain", F.size("acts").cast("long").alias("acts"), "path")


@query("SELECT count(*) AS traces, count(*) FILTER (o_orderkey % 2 = 0) AS exact, round(count(*) FILTER (o_orderkey % 2 = 0) / count(*), 6) AS rate FROM orders")
def exact_traces(spark, sf):
    """Of the stories, those whose path is the whole one."""
    truth = stories(spark, sf).select("record_id", F.lit("setup>contact>transfer>movement>detection").alias("path"))
    return conduct.exact_traces(truth, conduct.conduct_paths(told(spark, sf))).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {ACTS}, c AS (SELECT o_orderkey AS record_id, 'case-' || (o_custkey % 9) AS case_id FROM orders WHERE o_custkey % 9 < 5) SELECT case_id, kind, count(*) AS n FROM acts LEFT JOIN c USING (record_id) GROUP BY 1, 2""")
def acts_by_case(spark, sf):
    """Acts with their record's case, null without one."""
    cases = table(spark, sf, "orders").where("o_custkey % 9 < 5").selectExpr("o_orderkey AS record_id", "concat('case-', o_custkey % 9) AS case_id")
    acts = told(spark, sf).select("record_id", F.transform("acts", lambda a: a["kind"]).alias("kinds")).join(cases, "record_id", "left")
    return acts.select("case_id", F.explode("kinds").alias("kind")).groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("n"))


#: Records with what a collector knows of them.
RECORDS = f"""r AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, {KIND} AS kind, {_case("o_custkey % 4", ["fraud", "cyber", "trafficking", "bulk"])} AS domain,
CASE WHEN o_custkey % 6 = 0 THEN [{_case("o_custkey % 4", ["fraud", "cyber", "trafficking", "bulk"])}, 'transcripts'] END AS domains, CASE WHEN o_custkey % 5 <> 0 THEN {DAY} ELSE substr({DAY}, 1, 7) END AS pub_date,
concat('No. ', {NUMBER}, CASE WHEN o_custkey % 7 = 0 THEN ' and 2:01-cv-00001' ELSE '' END) AS docket_number, {_case("o_custkey % 3", ["sentenced", "plea_or_convicted", "early"])} AS stage,
{_case("o_orderkey % 4", ["romance_scams", "ponzi", "ransom", "none"])} AS bucket, {_case("o_custkey % 3", ["complaint_affidavit", "factual_basis", "motion"])} AS collected_as FROM orders)"""
PROFILES = "pf(profile, domains, ord) AS (VALUES " + ", ".join(f"('{p}', {d or '[]::VARCHAR[]'}, {o})" for p, d, o in V.PROFILES) + ")"
BUCKETS = "bk(profile, bucket, label) AS (VALUES " + ", ".join(map(str, V.BUCKETS)) + ")"
READ = f"""{PROFILES}, x AS (SELECT record_id, profile, CASE WHEN profile = 'common' THEN -1 ELSE ord END AS ord, profile <> 'common' AND list_contains(domains_, domain) AS own FROM r, (SELECT profile, domains AS domains_, ord FROM pf)),
of AS (SELECT record_id, ord, profile FROM (SELECT *, bool_or(own) OVER (PARTITION BY record_id) AS a FROM x) WHERE profile = 'common' OR own OR NOT a),
sc AS (SELECT r.record_id, arg_min(label, ord) AS scheme FROM r JOIN of ON of.record_id = r.record_id JOIN bk ON bk.profile = of.profile AND bk.bucket = r.bucket GROUP BY 1)"""


def records(spark, sf):
    domain = _case("o_custkey % 4", ["fraud", "cyber", "trafficking", "bulk"])
    return table(spark, sf, "orders").selectExpr(
        "concat('', o_orderkey) AS record_id", f"{KIND} AS kind", f"{domain} AS domain", f"CASE WHEN o_custkey % 6 = 0 THEN array({domain}, 'transcripts') END AS domains",
        f"CASE WHEN o_custkey % 5 <> 0 THEN {DAY} ELSE substr({DAY}, 1, 7) END AS pub_date", f"concat('No. ', {NUMBER}, CASE WHEN o_custkey % 7 = 0 THEN ' and 2:01-cv-00001' ELSE '' END) AS docket_number",
        f"{_case('o_custkey % 3', ['sentenced', 'plea_or_convicted', 'early'])} AS stage", f"{_case('o_orderkey % 4', ['romance_scams', 'ponzi', 'ransom', 'none'])} AS bucket",
        f"{_case('o_custkey % 3', ['complaint_affidavit', 'factual_basis', 'motion'])} AS collected_as",
    )


@query(f"WITH {RECORDS}, {BUCKETS}, {READ} SELECT record_id, CAST(ord AS INT) AS ord, profile FROM of")
def record_profiles(spark, sf):
    return evidence.profiles_of(records(spark, sf), V.profiles(spark))


@query(f"WITH {RECORDS}, {BUCKETS}, {READ} SELECT record_id, scheme FROM sc")
def bucket_schemes(spark, sf):
    return evidence.bucket_labels(records(spark, sf), V.profiles(spark), V.buckets(spark))


@query(f"""WITH {RECORDS}, {BUCKETS}, {READ}, s AS (SELECT r.*, scheme FROM r LEFT JOIN sc USING (record_id)), v AS (
SELECT record_id, 'date' AS field, 'filed' AS role, pub_date AS value, 0.9 AS confidence FROM s WHERE kind = 'court' AND length(pub_date) = 10
UNION ALL SELECT record_id, 'case_number', 'cited', unnest(regexp_extract_all(docket_number, '{evidence.CASE_NUMBER}')), 0.9 FROM s
UNION ALL SELECT record_id, 'stage', 'present', unnest(CASE stage WHEN 'sentenced' THEN ['sentenced'] WHEN 'plea_or_convicted' THEN ['plea', 'convicted'] ELSE ['charged', 'arrested'] END), 0.8 FROM s
UNION ALL SELECT record_id, 'scheme', 'present', scheme, 0.7 FROM s WHERE scheme IS NOT NULL
UNION ALL SELECT record_id, 'document_type', 'present', CASE collected_as WHEN 'complaint_affidavit' THEN 'complaint' ELSE 'factual_basis' END, 0.8 FROM s WHERE kind = 'court' AND collected_as <> 'motion'
UNION ALL SELECT record_id, 'document_type', 'present', 'transcript', 0.8 FROM s WHERE kind = 'court' AND list_contains(domains, 'transcripts')) SELECT record_id, field, role, value, CAST(confidence AS DOUBLE) AS confidence FROM v""")
def metadata_votes(spark, sf):
    rows = records(spark, sf)
    known = rows.join(evidence.bucket_labels(rows, V.profiles(spark), V.buckets(spark)), "record_id", "left")
    return evidence.metadata_votes(known).select("record_id", "field", "role", "value", "confidence")


ANCHORS = """a AS (SELECT l_orderkey AS record_id, CAST(l_linenumber AS INT) AS "start", CASE l_partkey % 9 WHEN 0 THEN 'Statute 18' WHEN 1 THEN 'Amount 5' WHEN 2 THEN 'Federal case 1' WHEN 3 THEN 'Date 2' WHEN 4 THEN 'Bitcoin address x' WHEN 5 THEN NULL ELSE 'Other' END AS label,
CASE l_suppkey % 3 WHEN 0 THEN 'uco-identity:Person' WHEN 1 THEN 'cryptoinv:VirtualAssetServiceProvider' ELSE 'x' END AS class, CASE l_linenumber % 3 WHEN 0 THEN ['criminal charge'] WHEN 1 THEN ['indictment count reference', 'criminal charge'] END AS events FROM lineitem)"""


@query(f"""WITH {ANCHORS}, f AS (SELECT record_id, "start", CASE WHEN label LIKE 'Statute %' THEN 'statute' WHEN label LIKE 'Amount %' THEN 'money' WHEN label LIKE 'Federal case %' THEN 'case_number' WHEN label LIKE 'Date %' THEN 'date' WHEN class = 'uco-identity:Person' THEN 'party'
WHEN label LIKE 'Bitcoin address%' OR class LIKE 'crypto%' THEN 'channel' WHEN list_contains(events, 'indictment count reference') THEN 'document_type' WHEN list_contains(events, 'criminal charge') THEN 'stage' END AS field FROM a) SELECT * FROM f WHERE field IS NOT NULL""")
def anchor_votes(spark, sf):
    pick = lambda key, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))
    events = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("criminal charge"))).when(F.col("l_linenumber") % 3 == 1, F.array(F.lit("indictment count reference"), F.lit("criminal charge")))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + 1).cast("int").alias("end"),
        pick(F.col("l_partkey") % 9, "Statute 18", "Amount 5", "Federal case 1", "Date 2", "Bitcoin address x", None, "Other", "Other", "Other").alias("label"),
        pick(F.col("l_suppkey") % 3, evidence.PERSON_CLASS, evidence.EXCHANGE_CLASS, "x").alias("class"), events.alias("events"),
    )
    return evidence.anchor_votes(rows).select("record_id", "start", "field")


@query("""WITH m AS (SELECT l_suppkey AS record_id, CASE l_linenumber % 3 WHEN 0 THEN 'money' WHEN 1 THEN 'sentence' ELSE 'date' END AS field, l_orderkey AS "start", l_linenumber AS "end" FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY "start", "end", field) AS k FROM m WHERE field <> 'date') SELECT record_id, field, "start", "end" FROM k WHERE k <= 8""")
def open_mentions(spark, sf):
    field = F.element_at(F.array(F.lit("money"), F.lit("sentence"), F.lit("date")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("record_id"), field.alias("field"), F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("end"))
    return evidence.open_mentions(rows, ["money", "sentence"])


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'not a PDF' WHEN contains(lower(html[1:8000]), 'track(1') THEN 'maintenance page' END AS failure FROM pages""")
def payload_failures(spark, sf):
    """Pages that claim to be PDFs, and pages with a mark of maintenance near their beginning."""
    rows = table(spark, sf, "pages")
    return rows.select("page_id", evidence.payload_failure(F.col("html"), F.col("page_id") % 3 == 0, ["TRACK(1"]).alias("failure"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'raw ' || o_orderstatus END AS case_text FROM orders""")
def hydrated_texts(spark, sf):
    """The text, else the one in the raw JSON; heavy columns are dropped."""
    raw = F.to_json(F.struct(F.concat(F.lit("raw "), "o_orderstatus").alias("case_text")))
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("case_text"), raw.alias("raw"))
    return evidence.slim(evidence.coalesced_text(rows, "case_text", "raw", "$.case_text"), ["raw"])


TAG_TEXT = "concat(text, CASE doc_id % 4 WHEN 0 THEN ' A wire transfer.' WHEN 1 THEN ' By E-mail, with attachments.' WHEN 2 THEN ' Phishing letters.' ELSE ' A debtor.' END)"
TAG_DOMAIN = "CASE lang WHEN 'en' THEN 'fraud' WHEN 'de' THEN 'cyber' ELSE 'bulk' END"


@query(f"""WITH d AS (SELECT doc_id AS record_id, {TAG_DOMAIN} AS domain, {TAG_TEXT} AS text FROM documents), v(profile, field, label, cue) AS (VALUES {", ".join(map(str, V.TAGS))}),
p AS (SELECT record_id, text, profile FROM d, (SELECT DISTINCT profile FROM v) WHERE profile = 'common' OR domain = 'bulk' OR profile = domain)
SELECT DISTINCT record_id, field, label FROM p JOIN v USING (profile) WHERE regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])(?:' || cue || ')([^0-9A-Za-z_]|$)')""")
def profile_tags(spark, sf):
    """Tags by the vocabularies of a record's profiles; a label that two profiles have keeps the cues of both."""
    docs = table(spark, sf, "documents").selectExpr("doc_id AS record_id", f"{TAG_DOMAIN} AS domain", f"{TAG_TEXT} AS text")
    return pages.tagged_by_profile(docs, evidence.profiles_of(docs, V.profiles(spark)), V.TAGS)


@query("WITH l AS (SELECT DISTINCT label FROM (VALUES " + ", ".join(map(str, V.TAGS)) + ") AS t(profile, field, label, cue) WHERE field = 'channel') SELECT label, count(doc_id) AS n FROM l LEFT JOIN documents ON contains(text, label) GROUP BY 1")
def channel_labels(spark, sf):
    """A vocabulary's labels, with the documents that name them."""
    labels = evidence.vocabulary_labels(V.tags(spark), "channel")
    named = table(spark, sf, "documents").join(F.broadcast(labels), F.col("text").contains(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(named, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("WITH f AS (SELECT method, family, row_number() OVER () - 1 AS k FROM (VALUES " + ", ".join(map(str, evidence.FAMILIES.items())) + f", ('unheard of', NULL)) AS t(method, family)) SELECT family, count(*) AS methods FROM documents JOIN f ON k = doc_id % {len(evidence.FAMILIES) + 1} GROUP BY 1")
def method_families(spark, sf):
    """The families of the methods that documents are read by."""
    names = F.array(*map(F.lit, [*evidence.FAMILIES, "unheard of"]))
    rows = table(spark, sf, "documents").select(F.element_at(names, (F.col("doc_id") % (len(evidence.FAMILIES) + 1) + 1).cast("int")).alias("method"))
    return rows.groupBy(evidence.family_of(F.col("method")).alias("family")).agg(F.count(F.lit(1)).alias("methods"))


@query("SELECT l_orderkey, l_linenumber, 'act[' || CASE WHEN l_linestatus < l_returnflag THEN l_linestatus || '+' || l_returnflag WHEN l_linestatus = l_returnflag THEN l_linestatus ELSE l_returnflag || '+' || l_linestatus END || ']' AS action FROM lineitem")
def action_labels(spark, sf):
    """An act with its means, sorted and once each."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.action_label(F.lit("act"), F.array("l_returnflag", "l_linestatus", "l_returnflag")).alias("action"))


#: A third kind of report, with the fields of a case.
CASE = f"""concat('On ', {DAY}, ' a ', {_case("o_custkey % 4", ["Coach", "teacher", "stranger", "person"])}, ' aged ', concat('', o_custkey % 60 + 18), ' was ', {_case("o_orderkey % 3", ["arrested", "charged and pleaded guilty", "sentenced"])},
'. There were ', concat('', o_orderkey % 9 + 1), ' victims and 1,', lpad(concat('', o_orderkey % 1000), 3, '0'), ' images on ', {_case("o_custkey % 3", ["Signal and Telegram", "paper", "Discord"])}, {_case("o_orderkey % 2", [". He admitted it, and a knife.", "; previously convicted on 1990-01-01."])})""".replace("\n", " ")


@query(f"""SELECT o_orderkey AS record_id, CAST(o_orderkey % 9 + 1 AS BIGINT) AS victim_count, CAST(o_custkey % 60 + 18 AS BIGINT) AS perpetrator_age, CASE o_custkey % 4 WHEN 0 THEN 'coach' WHEN 1 THEN 'teacher' WHEN 2 THEN 'stranger' END AS relation, o_orderkey % 2 = 1 AS previous_conviction,
{_case("o_custkey % 3", ["signal+telegram", "", "discord"])} AS platforms, CAST(1000 + o_orderkey % 1000 AS BIGINT) AS evidence_volume, CASE WHEN o_orderkey % 3 = 2 THEN 'sentenced' WHEN o_orderkey % 3 = 1 OR o_orderkey % 2 = 1 THEN 'convicted' ELSE 'arrested' END AS outcome,
{_case("o_orderkey % 2", ["weapon", "repeat"])} AS severity, o_orderkey % 2 = 0 AS admission, CASE WHEN o_orderkey % 2 = 1 THEN least('1990-01-01', {DAY}) ELSE {DAY} END AS first_day, CASE WHEN o_orderkey % 2 = 1 THEN greatest('1990-01-01', {DAY}) ELSE {DAY} END AS last_day,
substr(CASE WHEN o_orderkey % 2 = 1 THEN least('1990-01-01', {DAY}) ELSE {DAY} END, 1, 7) AS month FROM orders""")
def case_fields(spark, sf):
    """The fields of every case, read from its text."""
    found = extractors.case_fields(table(spark, sf, "orders").selectExpr("o_orderkey AS record_id", f"{CASE} AS text")).drop("text")
    return found.withColumn("platforms", F.array_join("platforms", "+")).withColumn("severity", F.array_join("severity", "+"))
