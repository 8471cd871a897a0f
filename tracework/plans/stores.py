"""Queries that write a table to the work folder through a sink, or as a file of some form, and read it back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracework.functions import columns as C
from tracework.functions import vocabulary as V
from tracework.operators import machine as M
from tracework.operators import resolve
from tracework.operators import sequences as S
from tracework.plans.registry import query
from tracework.plans.sequences import LOG, log
from tracework.session import table, work_dir
from tracework.sources import cache, committed, ranges, readers, sinks
from tracework.streaming import streams


def place(spark: SparkSession, name: str) -> str:
    """A new path in the work folder."""
    return f"{work_dir(spark)}/tracework/{name}-{uuid.uuid4().hex}"


def written(lines: DataFrame, name: str) -> str:
    """Lines (one column) as a text file's folder."""
    path = place(lines.sparkSession, name)
    lines.write.text(path)
    return path


def one_file(spark: SparkSession, text: str, name: str, folder: str = "") -> str:
    """A small file of a given name, written through Spark's file systems, so that any store will do."""
    whole = f"{folder or place(spark, 'file')}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode()))
    out.close()
    return whole


def lookup_rows(spark, sf):
    rows = table(spark, sf, "pages").select(F.lit("press").alias("kind"), F.concat(F.lit("d"), (F.col("page_id") % 3).cast("string")).alias("domain"), F.lit("").alias("agency"), F.concat(F.lit("page "), "page_id").alias("title"), F.lit("2024-01-01").alias("pub_date"), F.col("url").alias("source_url"), F.lit("n").alias("nhsr"))
    return rows


@query("SELECT 'page ' || page_id AS title, 'd' || (page_id % 3) AS domain, url AS source_url FROM pages")
def jsonl_scan(spark, sf):
    """Blank lines and lists between the rows are skipped."""
    lines = lookup_rows(spark, sf).select(F.explode(F.array(F.to_json(F.struct("*")), F.lit("   "), F.lit("[1]"))).alias("value"))
    return readers.read_jsonl(spark, written(lines, "lookup"), readers.LOOKUP).select("title", "domain", "source_url")


@query("SELECT 'press' AS lookup, count(*) AS n FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'wayback', count(*) FROM pages WHERE page_id % 2 = 1")
def lookup_union(spark, sf):
    """Two of the six lookups are there, each a folder of parts by the file's name."""
    folder = place(spark, "lookups")
    rows = lookup_rows(spark, sf)
    number = F.substring("title", 6, 20).cast("long")
    for kind, rest in (("press", 0), ("wayback", 1)):
        rows.where(number % 2 == rest).select(F.to_json(F.struct("*"))).write.text(f"{folder}/{readers.LOOKUP_FILES[kind]}")
    return readers.read_lookups(spark, folder).groupBy("lookup").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS title FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'single'")
def tolerant_json(spark, sf):
    """A list of objects, lines with broken ones between, and a single object."""
    names = lambda name, c: [r[0] for r in table(spark, sf, name).select(c).collect()]  # noqa: E731  dimensions of fixed size
    listed = json.dumps([{"title": n} for n in names("nation", "n_name")])
    lines = "\n".join(x for n in names("region", "r_name") for x in (json.dumps({"title": n}), "broken", "[2]"))
    folder = one_file(spark, listed, "a.json").rsplit("/", 1)[0]
    for name, text in (("deep/b.jsonl", lines), ("deep/er/c.json", '{"title": "single"}'), ("d.json", "broken")):
        one_file(spark, text, name, folder)
    return readers.read_jsonl_tolerant(spark, folder, readers.LOOKUP).select("title")


@query("SELECT doc_id AS record_id, url || ' é ' || length(html) AS text FROM documents LEFT JOIN pages ON page_id = doc_id")
def corpus_texts(spark, sf):
    """Texts by an index of files and offsets, each read by its range; documents without a page have none."""
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat("url", F.lit(" é "), F.length("html").cast("string")).alias("body"), F.substring("html", 1, 2_000).alias("rest"))
    path = written(rows.repartition(4, "id").select(F.to_json(F.struct("*"))), "rows")
    lines = ranges.indexed_lines(spark, path)
    places = lines.select(F.get_json_object("line", "$.id").cast("long").alias("record_id"), "file", "offset")
    index = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id")).join(places, "record_id", "left")
    return readers.corpus(index, readers.texts_at(index)).select("record_id", "text")


def _url_lines(spark, sf) -> list[str]:
    """One list for all checks: pages' urls with remarks, fragments and repeats."""
    urls = [r[0] for r in table(spark, sf, "pages").where("page_id < 40").select("url").orderBy("page_id").collect()]  # a list kept by hand
    return ["# head", *[x for u in urls for x in (u, f"{u}/ # again", "", "ftp://other")], "  "]


URL_LINES = """u AS (SELECT page_id, url FROM pages WHERE page_id < 40), l AS (SELECT 1 + 4 * (row_number() OVER (ORDER BY page_id) - 1) AS n, url FROM u)"""


@query(f"""WITH {URL_LINES}, e AS (SELECT n, trim(string_split(url, '#')[1]) AS url FROM l UNION ALL SELECT n + 1, trim(string_split(url || '/', '#')[1]) FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY n) AS k FROM e WHERE starts_with(url, 'http')) SELECT url FROM k WHERE k = 1""")
def url_list(spark, sf):
    path = one_file(spark, "\n".join(_url_lines(spark, sf)), "urls.txt")
    return readers.url_list(readers.numbered_lines(spark, path)).select("url")


@query(f"""WITH {URL_LINES} SELECT url, count(*) AS n FROM (SELECT string_split(trim(url), '#')[1] AS url FROM l UNION ALL SELECT string_split(url || '/ # again', '#')[1] FROM l UNION ALL SELECT 'ftp://other' FROM l) GROUP BY 1""")
def url_list_all(spark, sf):
    path = one_file(spark, "\n".join(_url_lines(spark, sf)), "urls.txt")
    return readers.url_list_all(readers.numbered_lines(spark, path)).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS page, n_name AS text, n_regionkey AS region FROM nation""")
def page_texts(spark, sf):
    """Nations are the pages of their region's document."""
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n")).collect()  # a dimension
    files = [(r[0], one_file(spark, "".join(n["n_name"] + "\f" for n in r["n"]), f"r{r[0]}.txt")) for r in rows]
    parts = [readers.read_pages(spark, path).withColumn("region", F.lit(key).cast("long")) for key, path in files]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select("page", "text", "region")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS timestamp, o_orderpriority AS original FROM orders WHERE o_orderkey % 3 <> 0")
def capture_rows(spark, sf):
    """Tables with a header; those with less than two rows are empty."""
    row = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    head = F.array(F.lit("timestamp"), F.lit("original"))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.array(head)).otherwise(F.array(head, row)).alias("t"))
    return rows.select(F.explode(readers.capture_rows(F.col("t"))).alias("c")).select(F.col("c")["timestamp"].alias("timestamp"), F.col("c")["original"].alias("original"))


def nation_triples(spark, sf):
    name = F.concat(F.lit("ex:n"), F.col("n_nationkey").cast("string"))
    rows = table(spark, sf, "nation")
    triple = lambda p, o, kind: rows.select(name.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    region = F.concat(F.lit("ex:r"), F.col("n_regionkey").cast("string"))
    return triple("a", F.lit("ex:Nation"), "iri").unionByName(triple("ex:part", region, "iri")).unionByName(triple("ex:label", F.concat("n_name", F.lit(' "x"; y')), "string"))


@query("""SELECT 'ex:n' || n_nationkey AS s, 'a' AS p, 'ex:Nation' AS o, 'iri' AS o_kind FROM nation UNION ALL SELECT 'ex:n' || n_nationkey, 'ex:part', 'ex:r' || n_regionkey, 'iri' FROM nation UNION ALL SELECT 'ex:n' || n_nationkey, 'ex:label', n_name || ' \\"x\\"; y', 'string' FROM nation""")
def turtle_triples(spark, sf):
    """Triples written as Turtle and read again; quotes keep their escapes."""
    path = written(sinks.turtle(nation_triples(spark, sf)).select("value"), "turtle")
    return readers.turtle_triples(readers.turtle_statements(spark, path))


@query("""SELECT 'ex:n' || n_nationkey AS id, 'ex:Nation' AS type, 'ex:r' || n_regionkey AS part, n_name || ' "x"; y' AS label FROM nation""")
def json_ld_nodes(spark, sf):
    at = lambda path: F.get_json_object("value", path)
    return sinks.json_ld(nation_triples(spark, sf)).select(at("$['@id']").alias("id"), at("$['@type'][0]").alias("type"), at("$['ex:part'][0]['@id']").alias("part"), at("$['ex:label'][0]").alias("label"))


@query(f"""WITH {LOG} SELECT trace AS walk, CAST(user_id % 4 AS VARCHAR) AS domain, CAST(position AS INT) AS i, activity AS state, CASE WHEN event_id % 2 = 0 THEN activity ELSE '(step)' END AS action, '(stop)' AS ended_by FROM lagged""")
def external_walks(spark, sf):
    """Walks written in their JSON form, without some actions and without ends, and read as another's."""
    events = S.positions(log(spark, sf))
    event = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("activity")).alias("action"), F.col("activity").alias("state"), F.array().cast("array<string>").alias("means"))
    walks = events.groupBy(F.col("trace").alias("id"), (F.col("user_id") % 4).cast("string").alias("domain")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", event.alias("e")))), lambda x: x["e"]).alias("events"))
    whole = walks.select("id", "domain", F.lit("s").alias("source"), F.lit(None).cast("string").alias("ended_by"), "events", F.lit(None).cast("map<string,string>").alias("meta"))
    return readers.external_walks(spark, written(readers.walks_to_json(whole).select("json"), "walks"), "other")


@query(f"WITH {LOG} SELECT activity AS state, count(*) AS n FROM lagged GROUP BY 1")
def external_graph(spark, sf):
    """Walks as a graph in Turtle, read and counted."""
    events = S.positions(log(spark, sf))
    step = F.concat(F.lit("ex:e"), F.col("event_id").cast("string"))
    triple = lambda p, o, kind: events.select(step.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
    triples = triple("traj:of", F.concat(F.lit("ex:"), F.replace("trace", F.lit("/"), F.lit("-"))), "iri").unionByName(triple("traj:order", F.col("position"), "int")).unionByName(triple("traj:state", F.col("activity"), "string"))
    folder = place(spark, "graph") + ".ttl"
    sinks.turtle(triples).select("value").write.text(folder)
    return readers.external_walks(spark, folder, "x").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


GOLD = {"records": T.StructType([T.StructField(c, T.StringType()) for c in ("record_id", "case_id", "split", "shape")]), "cases": T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", "split", "planted")])}


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CASE o_custkey % 2 WHEN 0 THEN 'dev' ELSE 'test' END AS split, o_orderpriority AS shape FROM orders), p AS (SELECT DISTINCT o_custkey, CASE o_custkey % 5 WHEN 0 THEN 'resentencing' END AS planted FROM orders WHERE o_custkey % 2 = 0)
SELECT 'records' AS part, shape AS name, count(*) AS n FROM r WHERE split = 'dev' GROUP BY 2 UNION ALL SELECT 'planted', 'resentencing', count(planted) FROM p""")
def gold_counts(spark, sf):
    """The development split's records by shape, and its cases by what was planted."""
    folder = place(spark, "gold")
    split = F.when(F.col("o_custkey") % 2 == 0, "dev").otherwise("test").alias("split")
    case = F.col("o_custkey").cast("string").alias("case_id")
    rows = table(spark, sf, "orders")
    parts = {"records": rows.select(F.col("o_orderkey").cast("string").alias("record_id"), case, split, F.col("o_orderpriority").alias("shape")), "cases": rows.select(case, split, F.when(F.col("o_custkey") % 5 == 0, "resentencing").alias("planted")).distinct()}
    for name, df in parts.items():
        df.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/{name}.jsonl")
    gold = readers.read_gold(spark, folder, GOLD, "dev")
    shapes = gold["records"].groupBy(F.col("shape").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("records").alias("part"), "name", "n")
    return shapes.unionByName(gold["cases"].agg(F.count("planted").alias("n")).select(F.lit("planted").alias("part"), F.lit("resentencing").alias("name"), "n"))


@query("SELECT 'nations' AS collection, lower(n_name) AS slug, 'http://x/' || n_nationkey AS url FROM nation")
def seed_documents(spark, sf):
    rows = table(spark, sf, "nation").select("n_name", "n_nationkey").collect()  # a dimension
    seed = {"collection": "nations", "documents": [{"slug": r[0].lower(), "url": f"http://x/{r[1]}", "more": 1} for r in rows]}
    return readers.read_seed(spark, one_file(spark, json.dumps(seed), "seed.json")).select("collection", "slug", "url")


@query("""WITH v AS (SELECT 'o' || o_orderkey AS record_id, o_orderstatus AS value, CASE WHEN o_orderkey % 3 = 0 THEN 0.9 ELSE 0.5 END AS c FROM orders) SELECT record_id, CASE WHEN record_id IN ('o1', 'o2', 'o3') THEN 'fixed' ELSE value END AS value, CASE WHEN record_id IN ('o1', 'o2', 'o3') OR c >= 0.7 THEN 'resolved' ELSE 'review' END AS status FROM v""")
def verdicts_win(spark, sf):
    """A person's verdict settles its mention, whatever the readers say."""
    verdict = {f"o{k}": [{"field": "status", "value": "fixed", "role": "", "span_start": 0, "span_end": 1}] for k in (1, 2, 3)}
    human = readers.read_verdicts(spark, one_file(spark, json.dumps(verdict), "verdicts.json"))
    votes = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("record_id"), F.lit("status").alias("field"), F.lit("").alias("role"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("o_orderstatus").alias("value"), F.lit("regex").alias("family"), F.when(F.col("o_orderkey") % 3 == 0, 0.9).otherwise(0.5).alias("confidence"))
    present = human.join(votes.select("record_id").distinct(), "record_id", "left_semi")
    return resolve.resolve(votes.unionByName(present)).select("record_id", "value", "status")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS case_id, CAST(c_custkey % 50 AS INT) AS age, count(*) AS n FROM customer WHERE CASE WHEN c_nationkey = 3 AND c_custkey % 50 = 10 THEN true WHEN c_nationkey = 4 AND c_custkey % 50 = 11 THEN false ELSE c_acctbal > 0 END GROUP BY 1, 2""")
def age_verdicts(spark, sf):
    """A verdict keeps a slot under review or drops a kept one; of two on one slot the last counts."""
    rows = [{"case_id": "3", "age": 10, "decision": "drop"}, {"case_id": "3", "age": 10, "decision": " Keep"}, {"case_id": "4", "age": 11, "decision": "drop"}]
    verdicts = readers.read_age_verdicts(spark, one_file(spark, json.dumps(rows), "ages.json"))
    slots = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("case_id"), (F.col("c_custkey") % 50).cast("int").alias("age"), F.when(F.col("c_acctbal") > 0, "KEEP").otherwise("REVIEW").alias("gate"))
    return readers.kept_ages(slots, verdicts).groupBy("case_id", "age").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'local' WHEN p_partkey % 3 = 0 THEN 'remote' ELSE 'missing' END AS tier FROM part""")
def lookup_tiers(spark, sf):
    parts = table(spark, sf, "part")
    return readers.two_tiers(parts.select("p_partkey"), parts.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("name")), parts.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("name")), "p_partkey", "name")


@query("""SELECT 'point' AS what, n_name AS value FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'among', n_name FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT 'listed', CAST(n_regionkey AS VARCHAR) FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM nation""")
def store_reads(spark, sf):
    """The reads a store is asked for: one row, rows among values, the values of a column, how many rows."""
    rows = table(spark, sf, "nation")
    told = lambda what, df: df.toDF("value").select(F.lit(what).alias("what"), F.col("value").cast("string").alias("value"))
    every = told("point", rows.where("n_nationkey = 7").select("n_name")).unionByName(told("among", rows.where(F.col("n_nationkey").isin(1, 2)).select("n_name")))
    return every.unionByName(told("listed", rows.select("n_regionkey").distinct().orderBy("n_regionkey"))).unionByName(told("count", rows.agg(F.count(F.lit(1)))))


@query("""WITH k AS (SELECT rtrim(split_part(split_part(trim(url), '#', 1), '?', 1), '/') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM (SELECT url, CASE WHEN strpos(split_part(trim(url), '#', 1), '?') > 0 THEN list_filter(string_split(substr(split_part(trim(url), '#', 1), strpos(split_part(trim(url), '#', 1), '?') + 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')) ELSE [] END AS q FROM pages)) SELECT count(DISTINCT key) AS n FROM k""")
def append_twice(spark, sf):
    """Appending the same rows again changes nothing."""
    path = place(spark, "appended")
    for _ in range(2):
        sinks.append_lookup(lookup_rows(spark, sf), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def rebuilt_table(spark, sf):
    path = place(spark, "rebuilt")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.rebuild(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    sinks.rebuild(rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), path)
    return spark.read.parquet(path)


@query("""SELECT 'last' AS keep, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders UNION ALL SELECT 'first', o_orderkey, o_orderstatus FROM orders UNION ALL SELECT keep, -1, 'new' FROM (VALUES ('last'), ('first')) AS t(keep)""")
def upserts(spark, sf):
    """Insert or replace, and insert or ignore."""
    rows = table(spark, sf, "orders")
    stored = rows.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    fresh = rows.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v")).unionByName(spark.createDataFrame([(-1, "new")], stored.schema))
    one, other = (sinks.upsert(stored, fresh, ["k"], keep=keep).select(F.lit(keep).alias("keep"), "k", "v") for keep in ("last", "first"))
    return one.unionByName(other)


@query(f"WITH {LOG} SELECT activity, count(*) AS n FROM log GROUP BY 1")
def trajectory_lines(spark, sf):
    """Exported lines hold the named columns only."""
    path = written(sinks.trajectories(log(spark, sf), ["trace", "activity"]), "trajectories")
    rows = spark.read.text(path).select(F.from_json("value", "trace string, activity string, user_id long").alias("r")).select("r.*")
    return rows.where("user_id IS NULL").groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG} SELECT 'events' AS part, count(*) AS n, min(activity) AS first FROM log UNION ALL SELECT 'objects', count(DISTINCT trace), min(trace) FROM log UNION ALL SELECT 'eventTypes', count(DISTINCT activity), min(activity) FROM log UNION ALL SELECT 'objectTypes', 1, 'case'""")
def ocel_parts(spark, sf):
    """The event log as one OCEL 2.0 document, read as JSON."""
    lines = sinks.ocel_document(log(spark, sf))
    path = place(spark, "ocel")
    lines.orderBy("ord").select("value").write.text(path)
    # the parts of a whole file, in order: a line that opens a part begins it
    read = ranges.indexed_lines(spark, path).withColumn("opens", F.regexp_extract("line", '^(?:\\{|\\],)"([A-Za-z]+)":\\[$', 1))
    begun = read.where("opens <> ''").select(F.col("opens").alias("part"), F.struct("file", "offset").alias("begin"))
    bounds = begun.withColumn("end", F.lead("begin").over(Window.orderBy("begin")))  # four rows
    inside = (F.struct("file", "offset") > F.col("begin")) & (F.col("end").isNull() | (F.struct("file", "offset") < F.col("end")))
    rows = read.where("opens = '' AND line <> ']}'").join(F.broadcast(bounds), inside).select("part", F.from_json(F.regexp_replace("line", ",$", ""), "type string, id string, name string").alias("r"))
    value = F.when(F.col("part") == "events", F.col("r.type")).when(F.col("part") == "objects", F.col("r.id")).otherwise(F.col("r.name"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("first"))


@query("""WITH r AS (SELECT '| ' || r_name || ' | ' || r_regionkey || ' |' AS line, r_name FROM region) SELECT line FROM r UNION ALL SELECT '| name | key |' UNION ALL SELECT '| --- | --- |'""")
def markdown_lines(spark, sf):
    text = sinks.markdown_table(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")))
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


@query("""WITH c AS (SELECT n_regionkey AS section, n_nationkey AS ord, n_name AS case_id, 'view' AS action, CAST(n_nationkey AS DOUBLE) / 10 AS cost FROM nation), s AS (SELECT section, round(sum(cost), 6) AS cost FROM c GROUP BY 1)
SELECT 's' || section AS section, case_id, action, round(cost, 6) AS cost FROM c UNION ALL SELECT 's' || section, '', 'TOTAL', round(cost + CASE WHEN section = 1 THEN 2.5 ELSE 0 END, 6) FROM s UNION ALL SELECT 's1', 'new', 'buy', 2.5""")
def cost_log(spark, sf):
    """A bought document goes before the section's total, which is made anew."""
    name = F.concat(F.lit("s"), F.col("n_regionkey").cast("string"))
    rows = table(spark, sf, "nation").select(name.alias("section"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("case_id"), F.lit("").alias("docket_number"), F.lit("view").alias("action"), (F.col("n_nationkey").cast("double") / 10).alias("cost"))
    totals = rows.groupBy("section").agg(F.lit(1000).cast("long").alias("ord"), F.lit("").alias("case_id"), F.lit("").alias("docket_number"), F.lit("TOTAL").alias("action"), F.sum("cost").alias("cost"))
    added = spark.createDataFrame([("new", "", "buy", 2.5)], "case_id string, docket_number string, action string, cost double")
    return sinks.with_cost_rows(rows.unionByName(totals.select(*rows.columns)), added, "s1").select("section", "case_id", "action", F.round("cost", 6).alias("cost"))


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS byte_length, sha256(html) AS content_sha256 FROM pages")
def provenance(spark, sf):
    return sinks.with_provenance(table(spark, sf, "pages").select("page_id", F.col("html").alias("data"))).drop("data")


@query("SELECT 'first' AS ask, count(*) AS n FROM nation UNION ALL SELECT 'again', count(*) FROM nation UNION ALL SELECT 'later', 0 UNION ALL SELECT 'dropped', 1")
def cached_results(spark, sf):
    """A kept result answers until it is too old, in whatever order the parameters come; an endpoint's results can be
    dropped."""
    root, rows = place(spark, "cache"), table(spark, sf, "nation").select("n_name")
    ask = lambda compute, **o: cache.cached(spark, root, "nations", o.pop("params", {"a": 1, "b": 2}), "v1", compute, **o).count()
    empty = lambda: rows.where("false")
    found = [("first", ask(lambda: rows)), ("again", ask(empty, params={"b": 2, "a": 1})), ("later", ask(empty, now=4e9)), ("dropped", cache.invalidate(spark, root, "nat*"))]
    return spark.createDataFrame(found, "ask string, n long")


@query("SELECT title, section, label, count(p_partkey) AS parts FROM (VALUES " + ", ".join(str((t, s, label)) for t, s, label, *_ in V.STATUTES) + ") AS t(title, section, label) LEFT JOIN part ON CAST(p_size AS VARCHAR) = title GROUP BY ALL")
def statute_table(spark, sf):
    """The statute dimension, with the parts whose size is a title's number."""
    sizes = table(spark, sf, "part").groupBy(F.col("p_size").cast("string").alias("title")).agg(F.count(F.lit(1)).alias("parts"))
    return V.statutes(spark).select("title", "section", "label").join(sizes, "title", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))


URLS = "concat(CASE page_id % 3 WHEN 0 THEN 'https://www.courtlistener.com/recap/gov.uscourts.cand.' WHEN 1 THEN 'https://WWW.Justice.gov/a/' ELSE 'http://x.org/' END, concat('', page_id), '/doc.PDF?x=1#p')"


@query(f"""WITH u AS (SELECT page_id, {URLS} AS url FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END AS docket, page_id % 3 = 1 AS known, CASE WHEN page_id % 3 = 1 THEN CAST(page_id AS VARCHAR) END AS article, CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.json' WHEN 2 THEN '.txt' ELSE '.pdf' END AS extension, 'a\\|b ' || page_id AS escaped FROM u""")
def url_parts(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{URLS} AS url", "CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/plain' ELSE '' END AS mime")
    url = F.col("url")
    return rows.select("page_id", C.docket_id(url).alias("docket"), C.host_in(url, ["www.justice.gov", "justice.gov"]).alias("known"), C.first_match(url, "/a/([0-9]+)/").alias("article"), C.extension(F.col("mime"), url).alias("extension"), C.markdown_escaped(F.concat(F.lit("a|b\n"), F.col("page_id").cast("string"))).alias("escaped"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') || '093000' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' WHEN 2 THEN 'soon' WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d') END AS stamp, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey * 86400 AS VARCHAR) END AS epoch, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS stamped, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(DATE '1970-01-01' + CAST(o_orderkey AS INT) AS VARCHAR) END AS day FROM d""")
def stamp_dates(spark, sf):
    iso, bare = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyyMMdd")
    key = F.col("o_orderkey") % 5
    stamp = F.when(key == 0, F.concat(bare, F.lit("093000"))).when(key == 1, F.concat(iso, F.lit("T00:00:00Z"))).when(key == 2, "soon").when(key == 3, bare).otherwise(F.concat(F.lit(" "), iso))
    epoch = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise((F.col("o_orderkey") * 86400).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", C.stamp_date(stamp).alias("stamped"), C.date_text(C.epoch_date(epoch)).alias("day"))


#: Agency labels with the possessives that names left in them; invented names.
UNITS = [("high tech crimes?('s)? bureau", "North High Tech Bureau", None), ("bureau of criminal investigation", "South BCI", "texas")]
AGENCIES = [
    ("Doe's High Tech Crimes Bureau", "North High Tech Bureau"), ("  the Doe ’s   Fraud Unit", "North Fraud Unit"), ("General Roe's Task Force", "South Task Force"), ("General's Cold Case Unit", "North Cold Case Unit"),
    ("Texas Bureau of Criminal Investigation", "Texas Bureau of Criminal Investigation"), ("Bureau of Criminal Investigation", "South BCI"), ("King's County Sheriff", "King's County Sheriff"), ("Roe's", "South"), ("", ""),
]


@query("SELECT c_custkey, label FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{out.replace(chr(39), chr(39) * 2)}')" for i, (_, out) in enumerate(AGENCIES)) + f") AS v(k, label) ON k = c_custkey % {len(AGENCIES)}")
def agency_labels(spark, sf):
    label = F.element_at(F.array(*[F.lit(a) for a, _ in AGENCIES]), (F.col("c_custkey") % len(AGENCIES) + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", label.alias("label"))
    return rows.select("c_custkey", C.repaired_label(F.col("label"), UNITS, {"doe": "North", "roe": "South"}, "North").alias("label"))


#: (address, the rest of its line, the next lines, what they make)
WRAPPED = [
    ("https://x.gov/f/202109-16", "", ["macoupin county case.", "more words here", "third line no", "x"], "https://x.gov/f/202109-16 macoupin county case more words here"),
    ("https://x.gov/f/20", "", ["2109-16.pdf", "CONTACT: a"], "https://x.gov/f/202109-16.pdf"),
    ("https://x.gov/f/202109-16", "county of y", ["FOR IMMEDIATE RELEASE", "z"], "https://x.gov/f/202109-16 county of y"),
    ("https://x.gov/plain", "", ["some words", "z"], "https://x.gov/plain"),
    ("https://x.gov/a.pdf", "", ["some words"], "https://x.gov/a.pdf"),
]


@query("SELECT c_custkey, url FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{w[3]}')" for i, w in enumerate(WRAPPED)) + f") AS v(k, url) ON k = c_custkey % {len(WRAPPED)}")
def wrapped_urls(spark, sf):
    pick = lambda values: F.element_at(F.array(*values), (F.col("c_custkey") % len(WRAPPED) + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", pick([F.lit(w[0]) for w in WRAPPED]).alias("url"), pick([F.lit(w[1]) for w in WRAPPED]).alias("rest"), pick([F.array(*map(F.lit, w[2])) for w in WRAPPED]).alias("lines"))
    return rows.select("c_custkey", C.joined_source_url(F.col("url"), F.col("rest"), F.col("lines")).alias("url"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN lower(substr(o_orderpriority, 3)) || ',b' WHEN o_custkey % 3 = 1 THEN lower(trim(o_orderstatus)) ELSE '' END AS types FROM orders""")
def action_types(spark, sf):
    listed = F.when(F.col("o_custkey") % 3 == 0, F.array(F.concat(F.lit(" "), F.substring("o_orderpriority", 3, 20)), F.lit(" B "), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    legacy = F.when(F.col("o_custkey") % 3 == 1, F.concat(F.lit(" "), "o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(C.action_types(listed, legacy), ",").alias("types"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_custkey % 7 + 1 AS INT) AS a, CAST(o_custkey % 7 + 1 + o_custkey % 4 AS INT) AS b FROM orders) SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_concat([3], range(a, b + 1)), lambda p: p <= 8))), ',') AS pages FROM s""")
def page_specs(spark, sf):
    from tracework.operators import pages

    a = F.col("o_custkey") % 7 + 1
    spec = F.concat(F.lit("3, "), a.cast("string"), F.lit("-"), (a + F.col("o_custkey") % 4).cast("string"), F.lit(","))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(pages.page_spec(spec, F.lit(8)), ",").alias("pages"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE round((o_custkey % 50) * 0.1, 6) END AS DOUBLE) AS transcript, CAST(round(CASE WHEN o_custkey % 4 = 0 THEN 3.0 ELSE least((o_custkey % 50) * 0.1, 3.0) END, 6) AS DOUBLE) AS document FROM orders")
def document_costs(spark, sf):
    n = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 50)
    return table(spark, sf, "orders").select("o_orderkey", F.round(C.transcript_cost(n), 6).alias("transcript"), F.round(C.page_cost(n), 6).alias("document"))


@query("SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^.*/', ''), '-'), lambda w: length(w) > 2 AND lower(w) NOT IN ('the', 'and'))[1:2], ' ') AS terms FROM pages")
def slug_terms(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.slug_terms(C.slug(F.col("url")), ["the", "and"], 2).alias("terms"))


@query(f"""WITH {LOG} SELECT trace AS walk, count(*) AS steps FROM log WHERE activity <> 'error' GROUP BY 1""")
def unplaced_steps(spark, sf):
    """Events that a scheme of one layer can place; the others are left out."""
    known = spark.createDataFrame([(s, s, False, None, i) for i, s in enumerate(["view", "click", "signup", "purchase"])], "state string, milestone string, is_goal boolean, source boolean, ord int")
    rows = S.positions(log(spark, sf)).select(F.col("trace").alias("walk"), F.lit(0).alias("domain"), F.col("position").alias("i"), F.col("activity").alias("state"), F.col("activity").alias("action"), F.lit(M.STOP).alias("ended_by"))
    return M.placed(rows, known).groupBy("walk").agg(F.count(F.lit(1)).alias("steps"))


def _streamed(spark, sf, make, name: str) -> DataFrame:
    """What a stream over the events, in four files, wrote once it had read them all."""
    source, path = place(spark, "events"), place(spark, name)
    events = table(spark, sf, "events")
    events.repartitionByRange(4, "ts").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    run = make(stream).writeStream.option("checkpointLocation", place(spark, "progress")).trigger(availableNow=True).format("parquet").outputMode("append").start(path)
    run.awaitTermination()
    return spark.read.parquet(path)


@query("SELECT 'http://x/' || user_id || '/' || event_type AS url_key FROM events GROUP BY user_id, event_type")
def stream_unseen_urls(spark, sf):
    """Append with dedup as a stream: one row of each url key."""
    url = F.concat(F.lit("http://x/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("?utm_source="), F.col("event_id").cast("string"), F.lit("#f"))
    return _streamed(spark, sf, lambda events: streams.unseen_urls(events.withColumn("url", url), delay="4000 days"), "unseen").select("url_key")


@query("SELECT url_key, count(*) AS n FROM (SELECT DISTINCT 'http://x/' || user_id AS url_key FROM events) GROUP BY 1")
def stream_merged_urls(spark, sf):
    """Micro-batches appended to a table without repeats; a batch that is run again would change nothing."""
    source, path = place(spark, "events"), place(spark, "merged")
    rows = table(spark, sf, "events").select(F.concat(F.lit("http://x/"), F.col("user_id").cast("string")).alias("url"), "event_id")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = streams.merge_batches(stream, path).option("checkpointLocation", place(spark, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(path).groupBy(C.url_key(F.col("url")).alias("url_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'page-' || page_id AS name, strlen(html) AS byte_length, sha256(html) AS content_sha256 FROM pages")
def committed_pages(spark, sf):
    """Pages as files with side-cars, through the sink that commits, read back from its manifest."""
    path = place(spark, "committed")
    files = table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.col("html").cast("binary").alias("data"))
    committed.write_files(files, path)
    return committed.read_files(spark, path).select("name", "byte_length", "content_sha256")
