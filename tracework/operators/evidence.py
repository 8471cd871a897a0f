"""Evidence: which reader reads which records, what metadata, anchors and statutes say, and the gates around them.

Readers are plain functions from documents to votes (record_id, field, role, start, end, value, confidence). Which of
them reads which kind of record stands in a table, plan(reader, kind, method, version, rank), so that dispatch is a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOTE = "record_id string, field string, role string, start int, end int, value string, method string, version string, family string, confidence double"

# fixed values: the family of each method; votes are counted by family
FAMILIES = {
    "regex": "surface_pattern",
    "clause_cue": "clause",
    "statute_table": "lookup",
    "sdk_processor": "sdk_rule",
    "clause_subject": "clause",
    "dependency_parse": "dependency",
    "ner_model": "ner",
    "collector_metadata": "metadata",
    "llm": "llm",
    "human": "human",
}


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def family_of(method: Column) -> Column:
    """Null for a method without a family."""
    return _mapped(method, FAMILIES)


def reading_plan(spark: SparkSession, rows: list[tuple[str, list[str], str, str, int]]) -> DataFrame:
    """plan(reader, kind, method, version, rank) of rows (reader, kinds, method, version, rank); the last row of a reader
    counts."""
    last = {r[0]: r for r in rows}
    table = spark.createDataFrame(list(last.values()), "reader string, kinds array<string>, method string, version string, rank int")
    return table.select("reader", F.explode("kinds").alias("kind"), "method", "version", "rank")


def dispatched(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(record_id, turn, reader): who reads a record, in order of rank, then name. The plan is a table of readers, so it
    is broadcast."""
    both = docs.select("record_id", "kind").join(F.broadcast(plan), "kind")
    turn = F.row_number().over(Window.partitionBy("record_id").orderBy("rank", "reader"))
    return both.select("record_id", turn.alias("turn"), "reader")


def read_votes(docs: DataFrame, plan: DataFrame, functions: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The votes of all readers that have a function, each over the records of its kinds. Their method, version and
    family come from the plan."""
    parts = []
    for name in sorted(functions):
        own = plan.where(F.col("reader") == name)
        votes = functions[name](docs.join(F.broadcast(own.select("kind").distinct()), "kind", "left_semi"))
        parts.append(votes.select("record_id", "field", "role", "start", "end", "value", "confidence").withColumn("reader", F.lit(name)))
    every = reduce(DataFrame.unionByName, parts)
    named = every.join(F.broadcast(plan.select("reader", "method", "version").distinct()), "reader")
    return named.select("record_id", "field", "role", "start", "end", "value", "method", "version", family_of(F.col("method")).alias("family"), "confidence")


# fixed values: what the collector's stage and the name it filed a document under stand for
STAGES = {"sentenced": ["sentenced"], "plea_or_convicted": ["plea", "convicted"], "early": ["charged", "arrested"]}
FILED_AS = {"statement_of_offense": "factual_basis", "factual_basis": "factual_basis", "complaint_affidavit": "complaint"}

#: Docket numbers: office:year-type-serial.
CASE_NUMBER = "[0-9]:[0-9]{2}-[a-z]{2}-[0-9]{5}"


def _exploded(rows: DataFrame, votes: list[Column]) -> DataFrame:
    """One row for each vote that isn't null."""
    found = rows.select("record_id", F.explode(F.filter(F.flatten(F.array(*votes)), lambda v: v["value"].isNotNull())).alias("v"))
    none = F.lit(None).cast("int")
    return found.select("record_id", "v.field", "v.role", none.alias("start"), none.alias("end"), "v.value", "v.confidence")


def _vote(field: str, value: Column, role: str, confidence: float) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(role).alias("role"), value.alias("value"), F.lit(confidence).alias("confidence"))


def metadata_votes(records: DataFrame) -> DataFrame:
    """What the collector knows of records(record_id, kind, domain, domains, pub_date, docket_number, stage, scheme,
    collected_as): votes without a span. scheme is the label of the record's bucket (bucket_labels), or null."""
    court = F.col("kind") == "court"
    day = F.substring("pub_date", 1, 10)
    stages = F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("stage")]
    folders = F.coalesce("domains", F.array("domain"))
    none = F.array().cast("array<string>")
    each = lambda values, *vote: F.transform(F.coalesce(values, none), lambda v: _vote(vote[0], v, *vote[1:]))
    return _exploded(
        records,
        [
            F.array(_vote("date", F.when(court & (F.length(day) == 10), day), "filed", 0.9)),
            each(F.regexp_extract_all("docket_number", F.lit(CASE_NUMBER), F.lit(0)), "case_number", "cited", 0.9),
            each(stages, "stage", "present", 0.8),
            F.array(_vote("scheme", F.col("scheme"), "present", 0.7)),
            F.array(_vote("document_type", F.when(court, _mapped(F.col("collected_as"), FILED_AS)), "present", 0.8)),
            F.array(_vote("document_type", F.when(court & F.array_contains(folders, "transcripts"), "transcript"), "present", 0.8)),
        ],
    )


# fixed values: prefixes of an anchor's label, with field and role; names of coins and of services for them
ANCHORED = [("Statute ", "statute", "cited"), ("Amount ", "money", "unknown"), ("Federal case ", "case_number", "cited"), ("Date ", "date", "unknown")]
COINS = ["Bitcoin address", "Ethereum address", "Tron address", "Hosted wallet", "Cryptocurrency"]
PERSON_CLASS, EXCHANGE_CLASS = "uco-identity:Person", "cryptoinv:VirtualAssetServiceProvider"


def anchor_votes(anchors: DataFrame) -> DataFrame:
    """Votes of anchors(record_id, start, end, label, class, events): by the label's prefix, else the class, else the
    events; others say nothing."""
    label = F.coalesce("label", F.lit(""))
    vote = lambda field, role, value, confidence: F.struct(F.lit(field).alias("field"), F.lit(role).alias("role"), F.lit(value).cast("string").alias("value"), F.lit(confidence).alias("confidence"))
    events = F.coalesce("events", F.array().cast("array<string>"))
    coin = reduce(lambda a, b: a | b, [label.startswith(c) for c in COINS])
    rules = [(label.startswith(p), vote(f, r, None, 0.8)) for p, f, r in ANCHORED] + [
        (F.col("class") == PERSON_CLASS, vote("party", "unknown", None, 0.8)),
        (coin | (F.col("class") == EXCHANGE_CLASS), vote("channel", "present", "cryptocurrency", 0.8)),
        (F.array_contains(events, "indictment count reference"), vote("document_type", "present", "indictment", 0.7)),
        (F.array_contains(events, "criminal charge"), vote("stage", "present", "charged", 0.6)),
    ]
    said = F.coalesce(*[F.when(test, v) for test, v in rules])
    return anchors.select("record_id", "start", "end", said.alias("v")).where("v IS NOT NULL").select("record_id", "v.field", "v.role", "start", "end", "v.value", "v.confidence")


def profiles_of(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """(record_id, ord, profile) of records(record_id, domain): the common profile, then those of profiles(profile,
    domains, ord) that have the domain, or all where none has it. Profiles are a vocabulary, so they are broadcast."""
    common = F.col("profile") == "common"
    every = records.select("record_id", "domain").join(F.broadcast(profiles), F.lit(True))
    own = every.withColumn("_own", ~common & F.coalesce(F.array_contains("domains", F.col("domain")), F.lit(False)))
    any_own = F.max("_own").over(Window.partitionBy("record_id"))
    return own.withColumn("_any", any_own).where(common | F.col("_own") | ~F.col("_any")).select("record_id", F.when(common, -1).otherwise(F.col("ord")).alias("ord"), "profile")


def bucket_labels(records: DataFrame, profiles: DataFrame, buckets: DataFrame) -> DataFrame:
    """(record_id, scheme): the label that the first of a record's profiles has for its bucket in buckets(profile, bucket,
    label); records without one are left out."""
    known = profiles_of(records, profiles).join(F.broadcast(buckets), "profile").join(records.select("record_id", "bucket"), ["record_id", "bucket"])
    return known.groupBy("record_id").agg(F.min_by("label", "ord").alias("scheme"))


def vocabulary_labels(vocabulary: DataFrame, field: str) -> DataFrame:
    """(label): every label that any profile defines for a field, in order."""
    return vocabulary.where(F.col("field") == field).select("label").distinct().orderBy("label")


def cited_statutes(citations: DataFrame, statutes: DataFrame) -> DataFrame:
    """citations(record_id, title, section, start, end) that statutes(title, section, label, low, high) knows: titles by
    number, sections in upper case. The dimension is a table of law, so it is broadcast."""
    known = F.broadcast(statutes.select(F.col("title").alias("_t"), F.col("section").alias("_s"), "label", "low", "high"))
    return citations.join(known, (F.col("title").cast("int").cast("string") == F.col("_t")) & (F.upper("section") == F.col("_s"))).drop("_t", "_s")


def statute_votes(cited: DataFrame, terms: DataFrame) -> DataFrame:
    """The offenses that cited statutes name, and terms(record_id, start, end, months, kind) that are exposure: of kind
    unknown, and equal to the maximum, else the minimum, of a cited statute, the first one cited."""
    label = F.col("label")
    offenses = cited.select("record_id", F.lit("offense").alias("field"), F.lit("present").alias("role"), "start", "end", label.alias("value"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("bound"))
    order = Window.partitionBy("record_id", "title", "section").orderBy("start", "end")
    first = cited.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("record_id", "low", "high", F.col("start").alias("ord"))
    bound = F.when(F.col("months") == F.col("high"), "maximum").when(F.col("months") == F.col("low"), "minimum")
    met = terms.where("kind = 'unknown' AND months IS NOT NULL").join(first, "record_id").withColumn("bound", bound).where("bound IS NOT NULL")
    one = met.groupBy("record_id", "start", "end", "months").agg(F.min_by("bound", "ord").alias("bound"))
    exposure = one.select("record_id", F.lit("sentence").alias("field"), F.lit("exposure").alias("role"), "start", "end", F.col("months").cast("string").alias("value"), F.lit(0.8).alias("confidence"), "bound")
    return offenses.unionByName(exposure)


def statute_votes_in_rows(rows: DataFrame, statutes: DataFrame) -> DataFrame:
    """statute_votes() of rows(record_id, citations, terms), arrays of one text, over statutes(title, section, label, low,
    high): the table of law meets each row as one broadcast array, so nothing is shuffled."""
    law = statutes.agg(F.collect_list(F.struct("title", "section", "label", "low", "high")).alias("law"))
    same = lambda c, s: (c["title"].cast("int").cast("string") == s["title"]) & (F.upper(c["section"]) == s["section"])
    known = lambda c: F.transform(F.filter("law", lambda s: same(c, s)), lambda s: F.struct(c["start"].alias("start"), c["end"].alias("end"), s["label"].alias("label"), s["low"].alias("low"), s["high"].alias("high")))
    cited = rows.join(F.broadcast(law), F.lit(True)).select("record_id", "terms", F.flatten(F.transform("citations", known)).alias("cited"))
    none = F.lit(None).cast("string")
    vote = lambda field, role, at, value, bound: F.struct(F.lit(field).alias("field"), F.lit(role).alias("role"), at["start"].alias("start"), at["end"].alias("end"), value.alias("value"), F.lit(0.8).alias("confidence"), bound.alias("bound"))
    offenses = F.transform("cited", lambda c: vote("offense", "present", c, c["label"], none))
    bound = lambda t, c: F.when(t["months"] == c["high"], "maximum").when(t["months"] == c["low"], "minimum")
    # the first citation, by its start, that has such a bound
    first = lambda t: F.array_min(F.filter(F.transform("cited", lambda c: F.struct(c["start"].alias("ord"), bound(t, c).alias("bound"))), lambda b: b["bound"].isNotNull()))["bound"]
    open_ = F.filter("terms", lambda t: (t["kind"] == "unknown") & t["months"].isNotNull())
    exposure = F.filter(F.transform(open_, lambda t: vote("sentence", "exposure", t, t["months"].cast("string"), first(t))), lambda v: v["bound"].isNotNull())
    return cited.select("record_id", F.inline(F.concat(offenses, exposure)))


def not_boilerplate(sentence: Column, pattern: str) -> Column:
    """A cue inside a tip-line sentence is no evidence."""
    return ~sentence.rlike(pattern)


def open_mentions(mentions: DataFrame, fields: list[str], most: int = 8) -> DataFrame:
    """The first `most` open mentions of some fields in each record, by position."""
    w = Window.partitionBy("record_id").orderBy("start", "end", "field")
    return mentions.where(F.col("field").isin(fields)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def payload_failure(body: Column, is_pdf: Column, marks: list[str], head: int = 8000) -> Column:
    """Why a payload can't be used, or null: a maintenance page, or a PDF without its magic bytes."""
    start = F.lower(F.substring(body, 1, head))
    down = reduce(lambda a, b: a | b, [start.contains(m.lower()) for m in marks], F.lit(False))
    return F.when(is_pdf & ~body.startswith("%PDF"), "not a PDF").when(~is_pdf & down, "maintenance page")


def coalesced_text(rows: DataFrame, text: str, raw: str, path: str) -> DataFrame:
    """The text column, else the one inside the raw JSON."""
    return rows.withColumn(text, F.coalesce(F.col(text), F.get_json_object(raw, path)))


def slim(rows: DataFrame, heavy: list[str]) -> DataFrame:
    return rows.drop(*heavy)
