"""Typed tokens: money, dates, statutes, case numbers, durations, parties, events, e-mail and IP addresses, with spans.

Spark's regular expressions give no offsets, so spans are found in Arrow batches; where values alone are wanted, use
regexp_extract_all. Offsets count code points, the end is exclusive. A span's value is normalised: amounts as numbers
of two decimals, dates as YYYY-MM-DD or YYYY-MM, durations in months ("life" without), statutes as title and section.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from tracework.operators.attribution import NAME
from tracework.operators.evidence import CASE_NUMBER

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_SCALE = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
_NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]

#: Words that report a step of the procedure.
EVENTS = {
    "arrest": r"arrested", "complaint": r"criminal complaint", "indictment": r"indicted", "information": r"charged by information", "charge": r"was charged",
    "plea": r"pleaded guilty|pled guilty", "verdict": r"jury found", "conviction": r"convicted", "sentencing": r"sentenced",
}

PATTERNS = {
    "money": r"\$\s?(?P<whole>\d{1,3}(?:,\d{3})+|\d+)(?P<part>\.\d{1,2})?(?:\s+(?P<scale>thousand|million|billion)\b)?",
    "date": rf"\b(?:(?P<month>{'|'.join(MONTHS)})\s+(?:(?P<day>\d{{1,2}}),\s+)?(?P<year>\d{{4}})|(?P<iso>\d{{4}}-\d{{2}}-\d{{2}}))\b",
    "statute": r"\b(?P<title>\d{1,2})\s+U\.?S\.?C\.?\s+(?:§+\s*)?(?P<section>\d+[A-Za-z]*(?:-\d+[a-z]?)?)",
    "case_number": rf"\b{CASE_NUMBER}\b",
    "duration": rf"\b(?:(?P<n>\d+|{'|'.join(_NUMBERS)})[\s-]+(?P<unit>month|year)s?|(?P<life>life)\s+(?:in\s+prison|imprisonment))\b",
    "party": NAME,
    "event": rf"\b(?:{'|'.join(f'(?P<{k}>{v})' for k, v in EVENTS.items())})\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9])",
}


def normal_amount(value: float) -> str:
    """Two decimals, so that equal amounts are equal texts."""
    return f"{round(float(value), 2):.2f}"


def _value(kind: str, m: re.Match) -> str | None:
    """The normalised value of a match; None for what only looks like one."""
    if kind == "money":
        return normal_amount(float(m["whole"].replace(",", "") + (m["part"] or "")) * _SCALE.get(m["scale"], 1))
    if kind == "date":
        if m["iso"]:
            return m["iso"]
        month = f"{m['year']}-{MONTHS.index(m['month']) + 1:02d}"
        return f"{month}-{int(m['day']):02d}" if m["day"] else month
    if kind == "statute":
        return f"{int(m['title'])} U.S.C. § {m['section'].upper()}"
    if kind == "duration":
        if m["life"]:
            return "life"
        n = int(m["n"]) if m["n"].isdigit() else _NUMBERS.index(m["n"])
        return str(n * (12 if m["unit"] == "year" else 1))
    if kind == "event":
        return m.lastgroup
    if kind == "ip":
        return m.group() if all(int(x) <= 255 for x in m.group().split(".")) else None
    return m.group()


def tokens_of(text: str | None, kinds: list[str] | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value) by kind, then position; matches of a kind don't overlap."""
    for kind in kinds or PATTERNS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            value = _value(kind, m)
            if value is not None:
                yield kind, *m.span(), value


def in_batches(docs: DataFrame, key: str, found: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """A row (key, what found gives) for each hit in docs(key, text); null texts have none."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            places, hits = [], []
            for n, text in enumerate(batch.column(1)):
                for hit in found(said) if (said := text.as_py()) else ():
                    places.append(n)
                    hits.append(hit)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*hits, strict=True) if hits else [[]] * len(fields), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *columns], [key, *fields.names])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def in_arrays(docs: DataFrame, found: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """docs(text, ...) with hits, an array of what found gives for the text, in its order; null texts have none. So what
    belongs to one text stays one row, and needs no shuffle to come together again."""
    fields, at = to_arrow_schema(StructType.fromDDL(schema)), docs.columns.index("text")
    whole = StructType([*docs.schema.fields, StructField("hits", ArrayType(StructType.fromDDL(schema)))])

    def run(batches):
        for batch in batches:
            ends, hits = [0], []
            for text in batch.column(at):
                hits.extend(found(said) if (said := text.as_py()) else ())
                ends.append(len(hits))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*hits, strict=True) if hits else [[]] * len(fields), fields, strict=True)]
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(fields)))
            yield pa.RecordBatch.from_arrays([*batch.columns, arrays], [*batch.schema.names, "hits"])

    return docs.mapInArrow(run, whole)


def read_tokens(docs: DataFrame, kinds: list[str], key: str = "record_id") -> DataFrame:
    """(key, kind, start, end, value) of docs(key, text)."""
    return in_batches(docs, key, lambda text: tokens_of(text, kinds), "kind string, start int, end int, value string")


def tokens_in_rows(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """docs(text, ...) with hits, the array of its tokens (kind, start, end, value)."""
    return in_arrays(docs, lambda text: tokens_of(text, kinds), "kind string, start int, end int, value string")


def citations_in(hits: Column) -> Column:
    """citations() of an array of tokens, as an array."""
    parts = lambda t: F.split(t["value"], " U\\.S\\.C\\. § ")
    return F.transform(F.filter(hits, lambda t: t["kind"] == "statute"), lambda t: F.struct(parts(t)[0].alias("title"), parts(t)[1].alias("section"), t["start"].alias("start"), t["end"].alias("end")))


#: What makes a term imposed, in the TERM_REACH characters before it.
TERM_CUE, TERM_REACH = r"(?i)sentenced[^.]*$", 120


def _term(text: Column, t: Column, cue: str) -> Column:
    before = F.substr(text, F.greatest(F.lit(1), t["start"] - (TERM_REACH - 1)), F.least(F.lit(TERM_REACH), t["start"]))
    return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].try_cast("int").alias("months"), F.when(before.rlike(cue), "imposed").otherwise("unknown").alias("kind"))


def terms_in(text: Column, hits: Column, cue: str = TERM_CUE) -> Column:
    """terms() of a text and the array of its tokens, as an array."""
    return F.transform(F.filter(hits, lambda t: t["kind"] == "duration"), lambda t: _term(text, t, cue))


def citations(tokens: DataFrame) -> DataFrame:
    """(record_id, title, section, start, end) of the statute tokens."""
    parts = F.split("value", " U\\.S\\.C\\. § ")
    return tokens.where("kind = 'statute'").select("record_id", parts[0].alias("title"), parts[1].alias("section"), "start", "end")


def terms(docs: DataFrame, tokens: DataFrame, cue: str = TERM_CUE) -> DataFrame:
    """(record_id, start, end, months, kind) of the duration tokens: "imposed" after a cue in the 120 characters before
    it, else "unknown"."""
    spans = tokens.where("kind = 'duration'").join(docs.select("record_id", "text"), "record_id")
    return spans.select("record_id", _term(F.col("text"), F.struct("start", "end", "value"), cue).alias("t")).select("record_id", "t.*")


def register(spark: SparkSession, name: str = "typed_tokens") -> None:
    """A table function of SQL: typed_tokens(text, kinds), kinds joined by commas or null for all of them."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="kind string, start int, end int, value string")
    class TypedTokens:
        def eval(self, text: str, kinds: str):
            yield from tokens_of(text, kinds.split(",") if kinds else None)

    spark.udtf.register(name, TypedTokens)
