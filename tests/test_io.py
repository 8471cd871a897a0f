"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tracework.operators import sequences as S
from tracework.sources import ranges, readers, sinks
from tracework.streaming import streams


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"kind": "press", "title": "x"}\n\n[1]\n')
    assert [r["title"] for r in readers.read_jsonl(spark, str(path), readers.LOOKUP).collect()] == ["x"]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.LOOKUP).count() == 0
    path.write_text('{"kind": \n')
    with pytest.raises(Exception, match="malformed"):
        readers.read_jsonl(spark, str(path), readers.LOOKUP).collect()


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "a"}, {"title": "b"}]))
    (tmp_path / "b.json").write_text(json.dumps({"title": "c"}))
    (tmp_path / "c.jsonl").write_text('{"title": "d"}\nbroken\n{"title": "e"}\n')
    assert sorted(r["title"] for r in readers.read_jsonl_tolerant(spark, str(tmp_path), readers.LOOKUP).collect()) == list("abcde")


def test_url_lists(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("# head\nhttp://a/x/\nhttp://a/x # again\n\nftp://b\nhttp://c#f\n")
    lines = readers.numbered_lines(spark, str(path))
    assert [r["url"] for r in readers.url_list(lines).orderBy("n").collect()] == ["http://a/x/", "http://c"]
    assert [r["url"] for r in readers.url_list_all(lines).orderBy("n").collect()] == ["http://a/x/", "http://a/x ", "ftp://b", "http://c"]


def test_captures(spark):
    rows = spark.createDataFrame([([["ts", "url"], ["1", "u"]],), ([["ts", "url"]],)], "t array<array<string>>")
    assert [r["c"] for r in rows.select(readers.capture_rows(F.col("t")).alias("c")).collect()] == [[{"ts": "1", "url": "u"}], []]


def test_walk_codec(spark):
    text = json.dumps({"id": "w", "domain": "d", "events": [{"state": "s"}, {"action": "a", "state": "t", "means": ["m"]}]})
    walks = readers.walks_from_json(spark.createDataFrame([(text,)], "json string"))
    w = walks.first()
    assert w["ended_by"] == "(stop)" and w["events"][0]["action"] == "(step)" and w["events"][1]["means"] == ["m"]
    back = json.loads(readers.walks_to_json(walks).first()["json"])
    assert back["events"][0] == {"action": "(step)", "state": "s"} and "meta" not in back
    assert readers.walk_events(walks).count() == 2


def test_turtle(spark):
    text = '@prefix ex: <http://e/> .\nex:a a ex:T ;\n  ex:n "x; y", 3 .\nex:b ex:p ex:a .\n'
    got = {tuple(r) for r in readers.turtle_triples(spark.createDataFrame([(text,)], "value string")).collect()}
    assert got == {("ex:a", "a", "ex:T", "iri"), ("ex:a", "ex:n", "x; y", "string"), ("ex:a", "ex:n", "3", "int"), ("ex:b", "ex:p", "ex:a", "iri")}
    written = sinks.turtle(spark.createDataFrame(sorted(got), "s string, p string, o string, o_kind string"))
    assert {tuple(r) for r in readers.turtle_triples(written.select("value")).collect()} == got


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/?utm_x=1", "1"), ("http://a", "2"), ("", "3"), ("http://b", "4")], "source_url string, title string")
    for _ in range(2):
        sinks.append_lookup(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_upsert(spark):
    old, new = (spark.createDataFrame([x], "k int, v string") for x in ((1, "a"), (1, "b")))
    assert sinks.upsert(old, new, ["k"]).first()["v"] == "b" and sinks.upsert(old, new, ["k"], keep="first").first()["v"] == "a"


def test_tiers(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    local, remote = spark.createDataFrame([(1, "l")], "k int, v string"), spark.createDataFrame([(1, "r"), (2, "r")], "k int, v string")
    assert {r["k"]: (r["v"], r["tier"]) for r in readers.two_tiers(wanted, local, remote, "k", "v").collect()} == {1: ("l", "local"), 2: ("r", "remote"), 3: (None, "missing")}


def test_exports(spark, sf):
    log = S.event_log(spark.read.parquet(f"{sf}/events.parquet").limit(3))
    first = json.loads(sinks.ocel_events(log).first()["value"])
    assert set(first) == {"id", "type", "time", "relationships"}
    assert sinks.markdown_table(spark.createDataFrame([("a|b", 1)], "x string, n int")).splitlines()[-1] == "| a\\|b | 1 |"


def test_an_event_document_is_json_with_equal_rows(spark):
    rows = [(1, "u", "view", "2024-01-01 00:00:00")] * 3 + [(0, "t", "buy", "2024-01-01 00:00:00"), (2, "u", "buy", None)]
    log = spark.createDataFrame(rows, "event_id long, trace string, activity string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    document = json.loads("\n".join(r["value"] for r in sinks.ocel_document(log).orderBy("ord").collect()))
    assert [e["id"] for e in document["events"]] == ["0", "1", "1", "1"] and [o["id"] for o in document["objects"]] == ["t", "u"]
    table = sinks.markdown_table(spark.range(7), most=5).splitlines()
    assert len(table) == 9 and table[-1] == "More than 5 rows; the first 5 are shown."


def odd_lines(n):
    return ["", "é" * 3, '{"body": "x"}', " " * 5, "y" * 20_000, "\r", *[json.dumps({"id": i, "body": "ü" * (i % 90)}, ensure_ascii=False) for i in range(n)], "no end"]


def test_lines_by_offset(spark, tmp_path):
    """Every line of several files, at its offset, blocks of any size; and bytes in proportion to the lines asked for."""
    lines, places = odd_lines(3_000), []
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_bytes("\n".join(lines).encode())
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        found = ranges.indexed_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf)
    at = 0
    for line in lines:
        places.append((at, line))
        at += len(line.encode()) + 1
    for name in ("a.txt", "b.txt"):
        assert sorted((r["offset"], r["line"]) for r in found if r["file"].endswith(name)) == places
    index = spark.createDataFrame([(r["file"], r["offset"], r["line"]) for r in found] + [(found[0]["file"], 10**9, None), (None, 3, None), (found[0]["file"], None, None), (found[0]["file"], -1, None)], "file string, offset long, want string")
    got = ranges.lines_at(index.unionByName(index.limit(500)), partitions=3).collect()
    assert len(got) == len(found) + 504 and all(r["line"] == r["want"] for r in got)
    whole = sum(len(line.encode()) + 1 for line in lines)
    assert sum(r["bytes_read"] for r in got) < 2 * 1.3 * whole + 8 * ranges.BLOCK
    few = ranges.lines_at(index.where("offset % 31 = 0 AND offset < 90000 AND offset > 25000 AND want IS NOT NULL"), partitions=2).collect()
    assert few and sum(r["bytes_read"] for r in few) <= 2 * ranges.BLOCK * len(few)
    plan = ranges.lines_at(index)._jdf.queryExecution().toString()
    assert "Join" not in plan and "binaryFile" not in plan


def test_texts_by_index(spark, tmp_path, monkeypatch):
    (tmp_path / "r.jsonl").write_text('{"body": "é"}\n{"body": 3}\nbroken\n{"title": "none"}\n', encoding="utf-8")
    lines = ranges.indexed_lines(spark, str(tmp_path / "r.jsonl"))
    index = lines.select(F.col("offset").alias("record_id"), "file", "offset").unionByName(spark.createDataFrame([(99, None, None)], "record_id long, file string, offset long"))
    want = {0: "é", 15: "3", 27: None, 34: None}
    assert {r["record_id"]: r["text"] for r in readers.texts_at(index).collect()} == want
    monkeypatch.setattr(ranges, "SCHEMES", ("hdfs",))  # as for a store that only Spark opens
    assert {r["record_id"]: r["text"] for r in readers.texts_at(index).collect()} == want


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.activity_counts(stream, delay="40 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "event_type", "n")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_of_urls(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('http://a#1', TIMESTAMP '2024-01-01 00:00:00'), ('http://a', TIMESTAMP '2024-01-01 01:00:00'), ('http://b', TIMESTAMP '2024-01-01 02:00:00') AS t(url, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.unseen_urls(stream).writeStream.format("memory").queryName("urls").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("urls").count() == 2


def test_routes_of_repeated_urls(spark, tmp_path):
    """Pages that share a url have records of their own, or none."""
    import duckdb

    from tracework.plans.catalog import ORACLES, QUERIES

    long, short = "https://www.example.net/" + "a" * 80, "https://example.net/" + "b" * 20
    urls = [(i, long) for i in range(1, 5)] + [(i, short) for i in range(5, 9)] + [(9, None), (10, None), (11, "http://x.org/"), (12, "")]
    spark.createDataFrame(urls, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("url_router", "url_modes"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall())


def test_turtle_by_statements(spark, tmp_path):
    """A file is many rows; a comment inside a statement that ends like one keeps it whole."""
    lines = "".join(f'ex:s{i} traj:of ex:w ;\n    traj:order {i} ;\n    traj:state "a .b" .\n' for i in range(50))
    (tmp_path / "a.ttl").write_text("@prefix ex: <http://e/> .\n# The walks .\n" + lines)
    assert readers.turtle_statements(spark, str(tmp_path / "a.ttl")).count() == 1  # the comment
    (tmp_path / "b.ttl").write_text("@prefix ex: <http://e/> .\n" + lines)
    assert readers.turtle_statements(spark, str(tmp_path / "b.ttl")).count() == 51
    (tmp_path / "c.ttl").write_text("@prefix ex: <http://e/> .\n" + lines.replace("ex:w ;", "ex:w ;\n  # odd .\n", 1))
    got = [sorted(map(tuple, readers.external_walks(spark, str(tmp_path / f"{x}.ttl"), "d").collect())) for x in "abc"]
    assert len(got[0]) == 50 and got[0] == got[1] == got[2]
