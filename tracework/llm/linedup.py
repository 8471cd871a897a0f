"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its lines that have a word; blank lines are no symbols and always stay. Only lines that
stand twice or more in the corpus can belong to a repeated run, so suffixes that start at other lines are left out of
the array from the start. Round k ranks the suffixes by their first 2^k lines: from the pair (rank of the first half,
rank of the second half), sorted and numbered across the cluster. A run of `min_words` words has at most that many
lines, so the rounds end at depth 2^k <= min_words, however long documents are.

Two suffixes stand in one longest-common-prefix interval of depth m exactly if they agree in the rank of round k and in
the rank of round k at distance m - 2^k, k = floor(log2 m). For every suffix two runs are looked at: the shortest one
from its line on that has min_words words, and the shortest one that ends with its line. All lines of a run that also
starts at an earlier position (by doc_id, then line) are deleted. The union of these runs is the union of all maximal
repeated runs with min_words words or more, later copies only: a line of such a run is in the shortest run from it on,
or in the shortest one that ends with the maximal run.

Defined results: null text stays null and has no lines, as empty texts; of copies the first by doc_id stays whole and the
others lose all repeated lines (ties in doc_id: by a hash of the text); rows equal in doc_id and text are one document
and each is treated alike; a text left without a word is empty; columns beside doc_id and text are carried over, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.session import cut

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _count_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _d and _row, which name a document: its id and a hash of id and text."""
    return docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("_row", F.xxhash64("doc_id", "text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(_d, _row, p, q, h, g, w): each line that has a word: its number among these and among all lines from 0, its
    hash pair and its words."""
    lines = F.filter(
        F.transform(
            _lines(F.col("text")),
            lambda x, i: F.struct(i.alias("q"), F.xxhash64(x, F.lit(0)).alias("h"), F.xxhash64(x, F.lit(1)).alias("g"), _count_words(x).alias("w")),
        ),
        lambda x: x["w"] > 0,
    )
    exploded = _keyed(docs).select("_d", "_row", F.posexplode_outer(lines).alias("p", "x"))
    return exploded.select("_d", "_row", "p", "x.q", "x.h", "x.g", F.col("x.w").cast("long").alias("w"))


def _numbered(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys in order, with rank from 1: sorted by ranges, numbered in each range and offset by the counts."""
    sorted_ = cut(keys.distinct().repartitionByRange(*columns).sortWithinPartitions(*columns).select(*columns, F.spark_partition_id().alias("part")), "ranks")
    inside = Window.partitionBy("part").orderBy(*columns)
    counts = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["n"]
    offsets = keys.sparkSession.createDataFrame(before, "part int, before long")
    return sorted_.join(F.broadcast(offsets), "part").select(*columns, (F.row_number().over(inside) + F.col("before")).alias("rank"))


DOC = ["_d", "_row"]
RUN = [*DOC, "run"]


def suffix_ranks(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The suffixes at repeated lines with their ranks r0, r1, ... by the first 1, 2, 4, ... lines (0: the run of
    repeated lines ends before), their run, and the words in it before (since) and through (upto) their line."""
    lines = lines.where("h IS NOT NULL")
    counts = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    ranked = _numbered(counts, ["h", "g"])
    level = cut(lines.join(ranked, ["h", "g"]).select(*DOC, "p", "q", "w", F.col("rank").alias("r0")).distinct(), "suffixes")
    level = level.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy(*DOC).orderBy("p")))
    in_run = Window.partitionBy(*RUN).orderBy("p")
    level = level.withColumn("upto", F.sum("w").over(in_run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("since", F.col("upto") - F.col("w"))
    level = level.withColumn("all", F.sum("w").over(Window.partitionBy(*RUN))).where(F.col("all") >= min_words).drop("all")
    level = cut(level, "suffixes")
    for k in range(int(math.log2(max(1, min_words)))):
        paired = level.withColumn("_y", F.coalesce(F.lead(f"r{k}", 1 << k).over(in_run), F.lit(0))).withColumn("_x", F.col(f"r{k}"))
        keys = _numbered(paired.where("_x > 0 AND _y > 0").select("_x", "_y"), ["_x", "_y"])
        named = paired.join(keys, ["_x", "_y"], "left")
        level = cut(named.withColumn(f"r{k + 1}", F.coalesce("rank", F.lit(0))).drop("_x", "_y", "rank"), "suffixes")
    return level


def _shortest_runs(level: DataFrame, min_words: int) -> DataFrame:
    """(_d, _row, p, m): for each line the shortest run of m lines with min_words words from it on, and to it."""
    # sums rise strictly with p, so one sort of line ends and of wanted sums finds the next end for each of them
    at = ["at", "kind", "p"]
    ends = level.select(*RUN, "p", F.col("upto").alias("at"), F.lit(1).alias("kind"))
    starts = level.select(*RUN, "p", (F.col("since") + min_words).alias("at"), F.lit(0).alias("kind"))
    # from the last to the first, so that the frame only grows
    on = Window.partitionBy(*RUN).orderBy(*[F.desc(c) for c in at]).rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(ends).withColumn("o", F.min(F.when(F.col("kind") == 1, F.col("p"))).over(on))
    forward = found.where("kind = 0 AND o IS NOT NULL").select(*DOC, "p", (F.col("o") - F.col("p") + 1).alias("m"))
    begins = level.select(*RUN, "p", F.col("since").alias("at"), F.lit(0).alias("kind"))
    wanted = level.select(*RUN, "p", (F.col("upto") - min_words).alias("at"), F.lit(1).alias("kind"))
    back = Window.partitionBy(*RUN).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    found = begins.unionByName(wanted).withColumn("o", F.max(F.when(F.col("kind") == 0, F.col("p"))).over(back))
    backward = found.where("kind = 1 AND o IS NOT NULL").select(*DOC, F.col("o").alias("p"), (F.col("p") - F.col("o") + 1).alias("m"))
    return forward.unionByName(backward).distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _row, lines, first_docs): the lines to delete of each document that has any, by number from 0 and in order,
    and the documents that hold the first copies."""
    level = suffix_ranks(line_table(docs), min_words)
    ranks = F.array(*sorted((c for c in level.columns if c[0] == "r" and c[1:].isdigit()), key=lambda c: int(c[1:])))
    at = level.select(*DOC, "p", ranks.alias("ranks"))
    k = F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")
    runs = _shortest_runs(level, min_words).select(*DOC, "p", "m", k.alias("k"))
    head = runs.join(at, [*DOC, "p"]).select(*DOC, "p", "m", "k", F.get("ranks", F.col("k")).alias("a"), (F.col("p") + F.col("m") - F.expr("shiftleft(1, k)")).alias("t"))
    tail = at.select(*DOC, F.col("p").alias("t"), "ranks")
    # (m, a, b) names the longest-common-prefix interval of depth m that the suffix stands in
    named = cut(head.join(tail, [*DOC, "t"]).select(*DOC, "p", "m", "a", F.get("ranks", F.col("k")).alias("b")), "intervals")
    first = named.groupBy("m", "a", "b").agg(F.min(F.struct(*DOC, "p")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = named.join(cut(first, "intervals"), ["m", "a", "b"]).where(F.struct(*DOC, "p") != F.col("first"))
    covered = later.select(*DOC, F.col("first._d").alias("from"), F.explode(F.sequence(F.col("p"), F.col("p") + F.col("m") - 1)).alias("p")).distinct()
    numbered = covered.join(level.select(*DOC, "p", "q"), [*DOC, "p"])
    return numbered.groupBy(*DOC).agg(F.array_sort(F.collect_set("q")).alias("lines"), F.array_sort(F.collect_set("from")).alias("first_docs"))


#: Deletions that are broadcast: their rows, and the line numbers in all of them, which bound the bytes.
BROADCAST_ROWS, BROADCAST_LINES = 500_000, 8_000_000


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs cut out of the texts; all rows and columns stay. The deletions are
    counted: few are broadcast, so that texts stay where they are, many meet the texts by a shuffle."""
    cuts = cut(later_copies(docs, min_words).select(F.col("_d").alias("_cd"), F.col("_row").alias("_cr"), F.col("lines").alias("_lines")), "deleted-lines")
    rows, lines = cuts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_lines")), F.lit(0))).first()
    # the row travels as one struct, so that none of its columns can clash with those used here
    keyed = _keyed(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text"))
    joined = keyed.join(
        F.broadcast(cuts) if rows <= BROADCAST_ROWS and lines <= BROADCAST_LINES else cuts,
        (keyed["_d"] == cuts["_cd"]) & (keyed["_row"] == cuts["_cr"]), "left",
    )
    every = joined.withColumn("_all", F.when(F.col("_lines").isNotNull(), _lines(F.col("text"))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_lines")), lambda i: F.get(F.col("_all"), i))
    every = every.withColumn("_kept", F.when(F.col("_lines").isNotNull(), F.array_join(kept, "\n")))
    blank = ~F.col("_kept").rlike("[^\\x20\\x09-\\x0D]")
    text = F.when(F.col("_kept").isNull(), F.col("text")).when(blank, F.lit("")).otherwise(F.col("_kept"))
    return every.select(*[text.alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
