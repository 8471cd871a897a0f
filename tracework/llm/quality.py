"""Quality rules: hashed n-gram log-likelihood ratio, native.

Every document's words are hashed, and its unigrams and bigrams are dealt by these hashes into buckets, whose number
follows the corpus's size (BUCKET_BYTES, up to MOST_BUCKETS, which bounds the table of weights in the plan). Two smoothed
multinomials over the buckets are counted: the trusted target from labelled documents, the raw corpus from all documents.
A document's score is the mean over its n-grams of log p_target - log p_raw, in integer millionths, and it is kept when
it passes the base rules and its score reaches the threshold.

The target is fitted on at most TRUSTED_ROWS trusted documents (those with the smallest CRC of the id), which bounds
the broadcast id set; raw counts and scores cover every n-gram of every document.

Repeated windows of three words are found by sorting hashes that carry their starts; neighbours are compared word by
word. Should windows with other words stand between them (their hashes agree by chance in the bits kept), the text's
windows are sorted by their words instead: the counts are exact in all cases.

Defined results: null text counts as empty: no words, base_failed; a document without n-grams scores 0; without any
trusted document all scores are 0; repeated rows are scored alike and each counts in the corpus; a score equal to the
threshold is kept; an empty table gives no rows; clashing input columns are not carried over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
#: Buckets are a power of two, one for about so many bytes of text, within these bounds.
BUCKET_BYTES = 2_048
LEAST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 17
TRUSTED_ROWS = 20_000
SMOOTHING = 0.5
SCALE = 1_000_000
#: In millionths of a nat for each n-gram.
THRESHOLD = -50_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _starts(count: Column, size: int) -> Column:
    """0, 1, ... for the windows of `size` among so many words; empty without any."""
    return F.when(count >= size, F.sequence(F.lit(0), count - size)).otherwise(F.array().cast("array<int>"))


def with_base_features(df: DataFrame, carry: list[str], hash_bits: int = 64) -> DataFrame:
    """carry columns, _h (the hashes of the words) and the base features of df's _t (a text, not null) and _w (its words).
    hash_bits: fewer make chance agreements likely, for tests.

    The steps are separate projections, so that arrays are computed once and compiled. Don't filter on the features
    directly: the optimizer would move the filter below the steps and compute the arrays anew for each element; let
    the rows pass an explode_outer first, as the pipeline does."""
    words, n = F.col("_w"), F.size("_w")
    bare = F.col("_t")
    for symbol in "#*$%&|<>":
        bare = F.replace(bare, F.lit(symbol))
    step = df.select(
        *carry, "_w",
        F.transform(words, lambda w: F.xxhash64(w)).alias("_h"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(bare)).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"),
        # the low bits that hold a start
        (F.expr(f"shiftleft(1L, least(62, {64 - hash_bits} + CAST(ceil(log2(size(_w) + 1)) AS INT)))") - 1).alias("_m"),
    )
    h, low = F.col("_h"), F.col("_m")
    window = lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
    step = step.select(
        *carry, "_w", "_h", "_m", "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(_starts(n, 3), lambda i: window(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))).alias("_s"),
    )
    s, kept = F.col("_s"), ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    start = lambda j: F.get(s, j).bitwiseAND(low).cast("int")
    twins = F.filter(_starts(F.size(s), 2), lambda j: F.get(s, j).bitwiseXOR(F.get(s, j + 1)).bitwiseAND(F.bitwise_not(low)) == 0)
    step = step.select(*carry, "_w", "_h", *kept, F.transform(twins, lambda j: F.struct(start(j).alias("a"), start(j + 1).alias("b"))).alias("_p"))
    same = lambda a, b: (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))
    step = step.select(*carry, "_w", "_h", *kept, "_p", F.filter("_p", lambda p: same(p["a"], p["b"])).alias("_q"))
    spelt = F.array_sort(F.transform(_starts(n, 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
    both = lambda pairs: F.concat(F.transform(pairs, lambda p: p["a"]), F.transform(pairs, lambda p: p["b"]))
    step = step.select(*carry, "_w", "_h", *kept, F.when(F.size("_p") == F.size("_q"), both(F.col("_q"))).alias("_p"), F.when(F.size("_p") > F.size("_q"), spelt).alias("_z"))
    z = F.col("_z")
    alike = F.filter(_starts(F.size(z), 2), lambda j: F.get(z, j)["w"] == F.get(z, j + 1)["w"])
    exact = F.concat(F.transform(alike, lambda j: F.get(z, j)["i"]), F.transform(alike, lambda j: F.get(z, j + 1)["i"]))
    step = step.select(*carry, "_w", "_h", *kept, F.sort_array(F.array_distinct(F.coalesce("_p", exact))).alias("_p"))
    p = F.col("_p")
    # each start covers three words, less those that the next start covers too
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda n, x: n + x
    )
    return step.select(*carry, "_h", *kept, covered.alias("n_repeat_words"))


def bucket_count(docs: DataFrame) -> int:
    """A power of two that follows the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """At most `most` distinct ids of rows labelled of good quality: those with the smallest CRC of the id."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(most)


def fit_weights(docs: DataFrame, labels: DataFrame, buckets: int | None = None, smoothing: float = SMOOTHING, most: int = TRUSTED_ROWS) -> list[int]:
    """log p_target - log p_raw of each bucket, in millionths. One row a bucket reaches the driver."""
    buckets = buckets or bucket_count(docs)
    trusted = F.broadcast(trusted_ids(labels, most).withColumn("_trusted", F.lit(1)))
    marked = docs.select("doc_id", "text").join(trusted, "doc_id", "left").select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), words_of(F.coalesce("text", F.lit(""))).alias("_w"))
    # explode_outer: for explode the optimizer would infer a filter that computes all n-grams once more
    paired = marked.select("_trusted", "_w", F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("_v")).select("_trusted", F.explode_outer(F.arrays_zip("_w", "_v")).alias("g"))
    a, b = F.xxhash64("g._w"), F.xxhash64("g._v")
    dealt = lambda h: h.bitwiseAND(F.lit(buckets - 1)).cast("int")
    grams = F.array(F.when(F.col("g._w").isNotNull(), dealt(a)), F.when(F.col("g._v").isNotNull(), dealt(F.xxhash64(a, b))))
    counted = (
        paired.select("_trusted", F.explode_outer(grams).alias("bucket"))
        .groupBy("bucket").agg(F.count("bucket").alias("raw"), F.sum("_trusted").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for row in counted.where("bucket IS NOT NULL").collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0] * buckets
    of_target, of_raw = math.log(sum(target) + smoothing * buckets), math.log(sum(raw) + smoothing * buckets)
    return [round(SCALE * (math.log(t + smoothing) - of_target - math.log(r + smoothing) + of_raw)) for t, r in zip(target, raw, strict=True)]


def judge_quality(docs: DataFrame, weights: list[int], threshold: int = THRESHOLD, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The base features, base_failed, score and kept of every row; docs never leave their partitions."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded into one constant
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*carry, text.alias("_t")).withColumn("_w", words_of(F.col("_t")))
    step = with_base_features(step, list(carry))
    h, last = F.col("_h"), F.size("_h")
    dealt = lambda x: F.get(table, x.bitwiseAND(F.lit(len(weights) - 1)).cast("int"))
    total = F.aggregate(
        _starts(last, 2), F.coalesce(F.when(last > 0, dealt(F.element_at(h, -1))), F.lit(0)).cast("long"),
        lambda acc, i: acc + dealt(F.get(h, i)) + dealt(F.xxhash64(F.get(h, i), F.get(h, i + 1))),
    )
    step = step.withColumn("_sum", total).withColumn("_len", F.greatest(F.lit(0), 2 * last - 1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return step.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("_sum") >= F.lit(threshold).cast("long") * F.col("_len"))).alias("kept"),
        F.when(F.col("_len") > 0, F.col("_sum") / F.lit(float(SCALE)) / F.col("_len")).otherwise(F.lit(0.0)).alias("score"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fit on docs and labels, then judge every document."""
    return judge_quality(docs, fit_weights(docs, labels), threshold, carry)
