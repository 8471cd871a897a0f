"""Fields of a case read from its text by fixed phrasings, all inside the JVM: counts, ages, relations, convictions,
evidence, outcomes, severity and dates. Vocabularies are small ones of our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.functions.columns import first_match

RELATIONS = ["stepfather", "teacher", "coach", "neighbour", "employer", "stranger"]
PLATFORMS = ["WhatsApp", "Telegram", "Discord", "Signal"]
#: (outcome, cue), the furthest step of the procedure first.
OUTCOMES = [("sentenced", r"sentenced"), ("convicted", r"convicted|pleaded guilty|found guilty"), ("charged", r"charged|indicted"), ("arrested", r"arrested")]
SEVERITY = [("weapon", r"\b(gun|knife|weapon)\b"), ("threat", r"\bthreat(s|ened)?\b"), ("repeat", r"\b(previously|again|repeatedly)\b")]
ADMISSIONS = r"(?i)\b(admitted|confessed)\b"
DAY = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"


def _present(text: Column, cues: list[tuple[str, str]]) -> Column:
    """The labels whose cue is in the text, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(text.rlike(f"(?i){cue}"), F.lit(label)) for label, cue in cues]), lambda x: x.isNotNull()))


def case_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with victim_count, perpetrator_age, relation, previous_conviction, platforms, evidence_volume, outcome, severity,
    admission, first_day, last_day and month (the batch a case belongs to). Missing fields are null, or empty lists; a null
    text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = lambda pattern: F.replace(first_match(t, pattern), F.lit(","), F.lit("")).try_cast("long")
    days = F.regexp_extract_all(t, F.lit(DAY), F.lit(0))
    relation = F.coalesce(*[F.when(t.rlike(rf"(?i)\b{r}\b"), F.lit(r)) for r in RELATIONS])
    outcome = F.coalesce(*[F.when(t.rlike(rf"(?i)\b(?:{cue})\b"), F.lit(name)) for name, cue in OUTCOMES])
    return docs.select(
        "*",
        whole(r"(?i)\b([0-9]+) victims?\b").alias("victim_count"), whole(r"(?i)\bage(?:d)? ([0-9]{1,3})\b").alias("perpetrator_age"), relation.alias("relation"),
        t.rlike(r"(?i)previously convicted|prior conviction|registered offender").alias("previous_conviction"), _present(t, [(p.lower(), rf"\b{p}\b") for p in PLATFORMS]).alias("platforms"),
        whole(r"(?i)\b([0-9][0-9,]*) (?:images|videos|files)\b").alias("evidence_volume"), outcome.alias("outcome"), _present(t, SEVERITY).alias("severity"), t.rlike(ADMISSIONS).alias("admission"),
        F.array_min(days).alias("first_day"), F.array_max(days).alias("last_day"), F.substring(F.array_min(days), 1, 7).alias("month"),
    )
