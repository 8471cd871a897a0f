"""Sources: line and JSON scans with their rules for bad input, url lists, capture tables, triples and walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracework.sources import ranges

LOOKUP = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "domain", "agency", "title", "pub_date", "source_url", "nhsr")])

WALK = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("source", T.StringType()), T.StructField("ended_by", T.StringType()),
        T.StructField("events", T.ArrayType(T.StructType([T.StructField("action", T.StringType()), T.StructField("state", T.StringType()), T.StructField("means", T.ArrayType(T.StringType()))]))),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Strict scan: blank lines skipped, rows that are no objects dropped, a malformed line raises; a missing path is
    empty. The file of each row is in source_file."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("source_file", T.StringType())]))
    # a table of lines may be a folder of parts under the file's name
    named = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"([^/]+\.jsonl)/[^/]*$", 1), F.lit("")), F.col("_metadata.file_name"))
    lines = spark.read.text(paths).select(F.trim("value").alias("value"), named.alias("source_file")).where("value <> ''")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    checked = parsed.withColumn("v", F.when(F.col("v").isNotNull(), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), F.col("source_file")))))
    objects = checked.where(F.schema_of_variant("v").startswith("OBJECT"))
    return objects.select(F.from_json("value", schema).alias("r"), "source_file").select("r.*", "source_file")


# fixed values: the lookups and the files they are kept in
LOOKUP_FILES = {
    "press": "press_lookup.jsonl",
    "recap": "recap_lookup.jsonl",
    "wayback": "wayback_lookup.jsonl",
    "statute": "statute_lookup.jsonl",
    "calibration": "calibration_lookup.jsonl",
    "litigation": "litigation_lookup.jsonl",
}


def read_lookups(spark: SparkSession, folder: str, schema: T.StructType = LOOKUP) -> DataFrame:
    """The rows of all lookups that are there, with lookup, the kind of the file they stand in."""
    every = read_jsonl(spark, [f"{folder}/{name}" for name in LOOKUP_FILES.values()], schema)
    kind = F.create_map(*[F.lit(x) for kind, name in LOOKUP_FILES.items() for x in (name, kind)])
    return every.withColumn("lookup", kind[F.col("source_file")])


def read_jsonl_tolerant(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Recursive scan of JSON and JSON-lines files; what can't be parsed is skipped. Files named .jsonl are read by lines,
    so that large ones are split; others as a whole, as an object or a list of objects, else line by line."""
    read = lambda names, whole: spark.read.options(recursiveFileLookup="true", pathGlobFilter=names).text(root, wholetext=whole)
    ok = lambda x: F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT")
    lines = read("*.jsonl", False).where(ok("value")).select(F.from_json("value", schema).alias("r"))
    files = read("*.json", True)
    whole = F.from_json("value", T.ArrayType(schema), {"mode": "PERMISSIVE"})
    each = F.transform(F.filter(F.split("value", "\n"), lambda x: F.try_parse_json(x).isNotNull()), lambda x: F.from_json(x, schema))
    rows = F.when(F.try_parse_json("value").isNotNull(), whole).otherwise(each)
    return lines.unionByName(files.select(F.explode(rows).alias("r"))).select("r.*")


def corpus(index: DataFrame, texts: DataFrame) -> DataFrame:
    """The index's entries with their text, null where there is none; texts(record_id, text) may be a table or rows held
    in memory."""
    return index.join(texts.select("record_id", "text"), "record_id", "left")


def texts_at(index: DataFrame, field: str = "body") -> DataFrame:
    """(record_id, text) of index(record_id, file, offset): a field of the JSON line that begins at a byte of a file. Lines
    are read by range; where files stand in a store that only Spark opens, they are read through once, and joined by
    their offsets."""
    places = index.where("file IS NOT NULL").select("record_id", "file", "offset")
    text = F.get_json_object("line", f"$.{field}").alias("text")
    if ranges.readable(places):
        return ranges.lines_at(places).select("record_id", text)
    files = [r["file"] for r in places.select("file").distinct().collect()]  # the collector's files, not records
    return places.join(ranges.indexed_lines(index.sparkSession, files), ["file", "offset"]).select("record_id", text)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, text) of text files whose pages end with form feeds, from 1; doc is the file's name."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.regexp_replace("value", "\f$", "").alias("value"))
    return whole.select("doc", F.posexplode(F.split("value", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def read_gold(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], split: str | None = None) -> dict[str, DataFrame]:
    """The gold tables by name, each a JSON-lines file; of one split, if asked for."""
    tables = {name: read_jsonl(spark, f"{folder}/{name}.jsonl", schema).drop("source_file") for name, schema in schemas.items()}
    return {name: df.where(F.col("split") == split) if split else df for name, df in tables.items()}


SEED = T.StructType([T.StructField("collection", T.StringType()), T.StructField("documents", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("slug", "url", "title", "filename")])))])


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """(collection, slug, url, title, filename) of a seed's documents; a seed without a collection, or a document without
    slug or url, is an error."""
    seed = spark.read.text(path, wholetext=True).select(F.from_json("value", SEED).alias("s")).select("s.*")
    rows = validated(seed, F.col("collection").isNotNull() & F.col("documents").isNotNull(), "a seed needs a collection and documents")
    docs = rows.select("collection", F.explode("documents").alias("d")).select("collection", "d.*")
    return validated(docs, F.col("slug").isNotNull() & F.col("url").isNotNull(), "a seed's document needs a slug and a url")


_VERDICTS = T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType()), T.StructField("role", T.StringType()), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType())])))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Human verdicts as votes (record_id, field, role, start, end, value, family, confidence), which win; a missing file has
    none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "record_id string, field string, role string, start int, end int, value string, family string, confidence double")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _VERDICTS)).alias("record_id", "rows")).select("record_id", F.explode("rows").alias("r"))
    return rows.select("record_id", "r.field", "r.role", F.col("r.span_start").alias("start"), F.col("r.span_end").alias("end"), "r.value", F.lit("human").alias("family"), F.lit(1.0).alias("confidence"))


def read_age_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, age, decision) of a JSON array, the last of equal (case_id, age); anything but objects with a case, an age
    and keep or drop is an error, and a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "case_id string, age int, decision string")
    item = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("decision", T.StringType())])
    whole = spark.read.text(path, wholetext=True)
    listed = validated(whole, F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False)), "expected a JSON array of verdicts")
    rows = listed.select(F.posexplode(F.from_json("value", T.ArrayType(item))).alias("n", "r")).select("n", "r.case_id", "r.age", F.lower(F.trim("r.decision")).alias("decision"))
    good = F.coalesce((F.col("case_id") != "") & F.col("age").isNotNull() & F.col("decision").isin("keep", "drop"), F.lit(False))
    checked = validated(rows, good, "a verdict needs a case_id, an age and keep or drop")
    return checked.groupBy("case_id", "age").agg(F.max_by("decision", "n").alias("decision"))


def kept_ages(slots: DataFrame, verdicts: DataFrame) -> DataFrame:
    """slots(case_id, age, gate) that stay: gate KEEP unless dropped, and any that a verdict keeps."""
    both = slots.join(verdicts, ["case_id", "age"], "left")
    return both.where(F.when(F.col("decision").isNotNull(), F.col("decision") == "keep").otherwise(F.col("gate") == "KEEP")).drop("decision")


def routed_urls(urls: DataFrame, records: DataFrame, known: Column, least: int = 80, on: list[str] | None = None) -> DataFrame:
    """urls(url, ...) with mode and body: those of known hosts are resolved by records(url, body), or unresolved without a
    record or with a body of under `least` characters; others are to be scraped. A record is found by its url, or by the
    columns `on`, of which it must be the only one."""
    on = on or ["url"]
    met = urls.withColumn("_known", known).join(records.select(*on, "body"), on, "left")
    thick = F.coalesce(F.length(F.trim("body")) >= least, F.lit(False))
    mode = F.when(~F.coalesce(F.col("_known"), F.lit(False)), "scrape").when(thick, "resolved").otherwise("unresolved")
    return met.withColumn("mode", mode).withColumn("body", F.when(F.col("mode") == "resolved", F.col("body"))).drop("_known")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of one text file in file order: bounded by the size of a hand-kept list, so one task numbers it."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def url_list(lines: DataFrame) -> DataFrame:
    """(n, url): stripped, cut at "#", those that start with http, the first of each key without trailing slashes."""
    url = F.trim(F.substring_index("line", "#", 1))
    kept = lines.select("n", url.alias("url")).where(F.col("url").startswith("http")).withColumn("_key", F.rtrim(F.col("url"), F.lit("/")))
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("n"))).where("_k = 1").drop("_k", "_key")


def url_list_all(lines: DataFrame) -> DataFrame:
    """(n, url): without blank and "#" lines and fragments; repeats stay."""
    kept = lines.select("n", F.trim("line").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))
    return kept.withColumn("url", F.substring_index("url", "#", 1))


def capture_rows(table: Column) -> Column:
    """A capture index, array<array<string>> with a header row, as array<map<string,string>>; empty under two rows."""
    head = F.get(table, F.lit(0))
    maps = F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), lambda row: F.map_from_arrays(head, row))
    return F.when(F.size(table) >= 2, maps).otherwise(F.array().cast("array<map<string,string>>"))


def walks_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Walks from their JSON form; a missing action is "(step)", a missing end "(stop)"."""
    w = rows.select(F.from_json(column, WALK).alias("w")).select("w.*")
    events = F.transform(F.coalesce("events", F.expr("cast(array() as array<struct<action:string,state:string,means:array<string>>>)")), lambda e: F.struct(F.coalesce(e["action"], F.lit("(step)")).alias("action"), e["state"].alias("state"), F.coalesce(e["means"], F.array().cast("array<string>")).alias("means")))
    return w.select("id", "domain", "source", F.coalesce("ended_by", F.lit("(stop)")).alias("ended_by"), events.alias("events"), "meta")


def walks_to_json(walks: DataFrame) -> DataFrame:
    """The JSON form; empty means and meta are left out."""
    events = F.transform("events", lambda e: F.struct(e["action"].alias("action"), e["state"].alias("state"), F.when(F.size(e["means"]) > 0, e["means"]).alias("means")))
    meta = F.when(F.size(F.coalesce("meta", F.expr("cast(map() as map<string,string>)"))) > 0, F.col("meta"))
    return walks.select(F.to_json(F.struct("id", "domain", "source", "ended_by", events.alias("events"), meta.alias("meta"))).alias("json"))


def walk_events(walks: DataFrame) -> DataFrame:
    """(walk, domain, i, state, action, ended_by) of walks."""
    flat = walks.select(F.col("id").alias("walk"), "domain", "ended_by", F.posexplode("events").alias("i", "e"))
    return flat.select("walk", "domain", "i", "e.state", "e.action", "ended_by")


def turtle_triples(files: DataFrame) -> DataFrame:
    """(s, p, o, o_kind) of Turtle texts in files(value) whose statements end lines: "s p o ;" and "s p o ."; prefixes
    stay as written. Predicate lists repeat the subject."""

    def run(batches):
        import re

        import pandas as pd

        token = re.compile(r'"(?:[^"\\]|\\.)*"(?:\^\^\S+|@[A-Za-z-]+)?|<[^>]*>|[^\s;,"<>]+(?<![.])|[;,.]')
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                body = "\n".join(x for x in (text or "").split("\n") if not x.lstrip().startswith(("@prefix", "#", "PREFIX")))
                place: list[str] = []
                for t in token.findall(body):
                    if t == ".":
                        place = []
                    elif t == ";":
                        place = place[:1]
                    elif t == ",":
                        place = place[:2]
                    elif len(place) < 2:
                        place.append(t)
                    else:
                        kind = "timestamp" if "dateTimeStamp" in t else "string" if t[0] == '"' else "int" if re.fullmatch(r"[+-]?\d+", t) else "bool" if t in ("true", "false") else "iri"
                        rows.append((*place[:2], t.split("^^")[0].strip('"') if t[0] == '"' else t, kind))
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_kind"])

    return files.select("value").mapInPandas(run, "s string, p string, o string, o_kind string")


#: What a statement of Turtle ends with at the end of a line; and a comment at the end of a text.
STATEMENT_END, LAST_COMMENT = " .\n", r"(?:^|\n)[ \t]*#[^\n]*$"


def turtle_statements(spark: SparkSession, path: str) -> DataFrame:
    """Turtle files as rows (value) of whole statements, so that no task holds a file: they are cut where " ." ends a line.
    Files in which a comment ends so, perhaps inside a statement, stay whole."""
    cut = spark.read.text(path, lineSep=STATEMENT_END)
    return cut if cut.where(F.col("value").rlike(LAST_COMMENT)).isEmpty() else spark.read.text(path, wholetext=True)


def walks_from_triples(triples: DataFrame, of: str = "traj:of", order: str = "traj:order", state: str = "traj:state", action: str = "traj:action") -> DataFrame:
    """(walk, i, state, action) of a trajectory graph: step nodes that name their walk, place, state and action; a missing
    action is "(step)"."""
    by = triples.where(F.col("p").isin(of, order, state, action)).groupBy("s").pivot("p", [of, order, state, action]).agg(F.min("o"))
    kept = by.where(F.col(f"`{of}`").isNotNull() & F.col(f"`{state}`").isNotNull())
    return kept.select(F.col(f"`{of}`").alias("walk"), F.col(f"`{order}`").cast("int").alias("i"), F.col(f"`{state}`").alias("state"), F.coalesce(F.col(f"`{action}`"), F.lit("(step)")).alias("action"))


def external_walks(spark: SparkSession, path: str, domain: str = "") -> DataFrame:
    """(walk, domain, i, state, action, ended_by) of a Turtle file of trajectories or of a file of walks in JSON lines, for
    the same analyses; walks without a domain get the one given."""
    if path.endswith(".ttl"):
        steps = walks_from_triples(turtle_triples(turtle_statements(spark, path)))
        return steps.select("walk", F.lit(domain).alias("domain"), "i", "state", "action", F.lit("(stop)").alias("ended_by"))
    events = walk_events(walks_from_json(spark.read.text(path).where("trim(value) <> ''").withColumnRenamed("value", "json")))
    return events.withColumn("domain", F.when(F.coalesce("domain", F.lit("")) == "", F.lit(domain)).otherwise(F.col("domain"))).select("walk", "domain", "i", "state", "action", "ended_by")


def two_tiers(wanted: DataFrame, local: DataFrame, remote: DataFrame | None, key: str, value: str) -> DataFrame:
    """value from the local table, else the remote one where there is one, with tier local, remote or missing."""
    out = wanted.join(local.select(key, F.col(value).alias("_l")), key, "left")
    out = out.join(remote.select(key, F.col(value).alias("_r")), key, "left") if remote is not None else out.withColumn("_r", F.lit(None).cast("string"))
    tier = F.when(F.col("_l").isNotNull(), "local").when(F.col("_r").isNotNull(), "remote").otherwise("missing")
    return out.withColumn(value, F.coalesce("_l", "_r")).withColumn("tier", tier).drop("_l", "_r")


def validated(rows: DataFrame, rule: Column, message: str) -> DataFrame:
    """Rows, or an error where one breaks the rule."""
    return rows.where(F.when(rule, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
