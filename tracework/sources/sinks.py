"""Sinks: appends without repeats, rebuilt tables, exports and small reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.functions.columns import markdown_escaped, url_key


def unseen(rows: DataFrame, stored: DataFrame, url: str = "source_url") -> DataFrame:
    """Rows with a url whose key the stored rows don't have, the first of each key (by the row's own order of columns)."""
    keyed = rows.withColumn("_key", url_key(F.col(url))).where(F.col("_key").isNotNull() & (F.col("_key") != ""))
    seen = stored.select(url_key(F.col(url)).alias("_key")).distinct()
    w = Window.partitionBy("_key").orderBy(*rows.columns)
    return keyed.join(seen, "_key", "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_key")


def append_lookup(rows: DataFrame, path: str, url: str = "source_url") -> None:
    """Append the unseen rows to a Parquet table; running it twice changes nothing."""
    spark = rows.sparkSession
    from tracework.sources.readers import exists

    stored = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], rows.schema)
    unseen(rows, stored, url).write.mode("append").parquet(path)


def rebuild(rows: DataFrame, path: str) -> None:
    """Derived tables are written anew."""
    rows.write.mode("overwrite").parquet(path)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Insert or replace (keep last), or insert or ignore (keep first)."""
    every = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    order = F.desc("_new") if keep == "last" else F.asc("_new")
    return every.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *[c for c in rows.columns if c not in keys]))).where("_k = 1").drop("_k", "_new")


def ocel_events(log: DataFrame) -> DataFrame:
    """Dated events as object-centric event log JSON rows, one a line."""
    objects = F.array(F.struct(F.col("trace").alias("objectId"), F.lit("case").alias("qualifier")))
    event = F.struct(F.col("event_id").cast("string").alias("id"), F.col("activity").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), objects.alias("relationships"))
    return log.where("ts IS NOT NULL").select(F.to_json(event).alias("value"))


def trajectories(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON with the named columns only: no texts, people or statuses."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """(s, value): each subject's statements as one Turtle block, predicates in order."""
    literal = F.concat(F.lit('"'), F.regexp_replace("o", '(["\\\\])', "\\\\$1"), F.lit('"'))
    term = F.when(F.col("o_kind") == "string", literal).when(F.col("o_kind") == "timestamp", F.concat(literal, F.lit("^^xsd:dateTimeStamp"))).otherwise(F.col("o"))
    lines = F.array_sort(F.collect_set(F.concat_ws(" ", F.lit("   "), "p", term)))
    return triples.groupBy("s").agg(lines.alias("l")).select("s", F.concat(F.col("s"), F.lit("\n"), F.array_join("l", " ;\n"), F.lit(" .")).alias("value"))


def markdown_table(rows: DataFrame, most: int = 500) -> str:
    """A small table as Markdown, by the columns' order. Of a larger one the first `most` rows and a line that says so."""
    shown = rows.select(*[markdown_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns])
    body = ["| " + " | ".join(r) + " |" for r in shown.orderBy(*shown.columns).limit(most + 1).collect()]
    more = [f"\nMore than {most} rows; the first {most} are shown."] if len(body) > most else []
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *body[:most], *more])


def outcomes(rows: DataFrame, error: Column) -> DataFrame:
    """(outcome, n): rows with an error beside those without."""
    return rows.groupBy(F.when(error.isNotNull(), "error").otherwise("written").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def ocel_document(log: DataFrame) -> DataFrame:
    """(ord, value): the lines of one OCEL 2.0 JSON document of a log's dated events, which its rows make in order of ord:
    event types, one object type, the traces as objects, the events."""
    dated = log.where("ts IS NOT NULL")
    rows = lambda part, df: df.select(F.lit(part).alias("part"), F.col("value"))
    types = dated.select("activity").distinct().select(F.to_json(F.struct(F.col("activity").alias("name"), F.expr("array()").cast("array<string>").alias("attributes"))).alias("value"))
    objects = dated.select("trace").distinct().select(F.to_json(F.struct(F.col("trace").alias("id"), F.lit("case").alias("type"))).alias("value"))
    kind = log.sparkSession.createDataFrame([('{"name":"case","attributes":[]}',)], "value string")
    parts = [("eventTypes", types), ("objectTypes", kind), ("objects", objects), ("events", ocel_events(log))]
    every = reduce(DataFrame.unionByName, [rows(i, df) for i, (_, df) in enumerate(parts)])
    # equal rows stand together; a comma after every row but the last of its part
    every = every.groupBy("part", "value").agg(F.count(F.lit(1)).cast("int").alias("n"))
    last = every.groupBy("part").agg(F.max("value").alias("_last"))
    copies = F.array_join(F.array_repeat("value", F.col("n")), ",\n")
    lines = every.join(F.broadcast(last), "part").select("part", F.lit(1).alias("sub"), "value", F.concat(copies, F.when(F.col("value") == F.col("_last"), "").otherwise(",")).alias("line"))
    names = [name for name, _ in parts]
    frame = [(i, 0, "", ("{" if i == 0 else "],") + f'"{n}":[') for i, n in enumerate(names)] + [(len(names), 0, "", "]}")]
    marks = log.sparkSession.createDataFrame(frame, "part int, sub int, value string, line string")
    return lines.select("part", "sub", "value", "line").unionByName(marks).select(F.struct("part", "sub", "value").alias("ord"), F.col("line").alias("value"))


def json_ld(triples: DataFrame) -> DataFrame:
    """(s, value): each subject as one JSON-LD node: @id, @type, and its statements by predicate, sorted; objects that are
    names are {"@id"}, literals stay texts."""
    typed = F.array_sort(F.collect_set(F.when(F.col("p") == "a", _json_text(F.col("o")))))
    quoted = F.when(F.col("o_kind") == "iri", F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(_json_text(F.col("o")))
    by = triples.where("p <> 'a'").groupBy("s", "p").agg(F.array_sort(F.collect_set(quoted)).alias("v")).select("s", F.concat(_json_text(F.col("p")), F.lit(":["), F.array_join("v", ","), F.lit("]")).alias("m"))
    members = by.groupBy("s").agg(F.array_sort(F.collect_list("m")).alias("m"))
    types = triples.groupBy("s").agg(typed.alias("t"))
    none = F.array().cast("array<string>")
    whole = types.join(members, "s", "left").select("s", "t", F.coalesce("m", none).alias("m"))
    head = F.array(F.concat(F.lit('"@id":'), _json_text(F.col("s"))), F.concat(F.lit('"@type":['), F.array_join("t", ","), F.lit("]")))
    return whole.select("s", F.concat(F.lit("{"), F.array_join(F.concat(head, "m"), ","), F.lit("}")).alias("value"))


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def with_cost_rows(log: DataFrame, added: DataFrame, section: str) -> DataFrame:
    """log(section, ord, case_id, docket_number, action, cost) with the rows of added(case_id, docket_number, action, cost)
    put before a section's TOTAL row, and that total made anew; other sections stay. Rows keep their order, added ones
    come by their columns."""
    own = log.where(F.col("section") == section)
    lines = own.where("action <> 'TOTAL'").select("ord", F.lit(0).alias("new"), "case_id", "docket_number", "action", "cost")
    more = added.select(F.lit(None).cast("long").alias("ord"), F.lit(1).alias("new"), "case_id", "docket_number", "action", "cost")
    every = lines.unionByName(more)
    order = Window.orderBy("new", "ord", "case_id", "docket_number", "action", "cost")  # a log kept by hand
    numbered = every.select(F.lit(section).alias("section"), F.row_number().over(order).cast("long").alias("ord"), "case_id", "docket_number", "action", "cost")
    total = every.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), (F.count(F.lit(1)) + 1).alias("ord")).select(F.lit(section).alias("section"), "ord", F.lit("").alias("case_id"), F.lit("").alias("docket_number"), F.lit("TOTAL").alias("action"), "cost")
    return log.where(F.col("section") != section).unionByName(numbered).unionByName(total)


def with_provenance(files: DataFrame, data: str = "data") -> DataFrame:
    """files with byte_length and content_sha256 of their bytes, to be kept beside them."""
    return files.withColumn("byte_length", F.octet_length(data).cast("long")).withColumn("content_sha256", F.sha2(F.col(data).cast("binary"), 256))
