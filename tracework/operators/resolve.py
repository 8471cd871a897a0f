"""Settling readers' votes, and scoring what was settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE = 0.7
#: Families of human verdicts.
VERDICTS = ["human", "override"]


def resolve(votes: DataFrame, line: float = LINE) -> DataFrame:
    """votes(record_id, field, role, start, end, value, family, confidence) -> one row a span and value, with status.

    Votes count by family, not by reader. At a span the value with most families leads, then the highest confidence,
    then the value's order; it is "resolved" if its confidence reaches the line and no other value has as many
    families, else "review". Verdicts (families in VERDICTS) win outright."""
    span = ["record_id", "field", "role", "start", "end"]
    one = votes.groupBy(*span, "value", "family").agg(F.max("confidence").alias("confidence"))
    by = one.groupBy(*span, "value").agg(F.count("family").alias("families"), F.max("confidence").alias("confidence"), F.max(F.col("family").isin(VERDICTS)).alias("over"))
    order = Window.partitionBy(*span).orderBy(F.desc("over"), F.desc("families"), F.desc("confidence"), "value")
    # below a leader that is no verdict stand the values of as many families, if any
    ranked = by.withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("families").over(order))
    alone = F.col("_next").isNull() | (F.col("_next") < F.col("families"))
    settled = F.col("over") | ((F.col("confidence") >= line) & alone)
    return ranked.where("_k = 1").select(*span, "value", "families", "confidence", F.when(settled, "resolved").otherwise("review").alias("status"))


def finals(resolved: DataFrame) -> DataFrame:
    """(record_id, field, role, value, spans): resolved values with all their spans, the most cited ones first."""
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    return resolved.where("status = 'resolved'").groupBy("record_id", "field", "role", "value").agg(spans.alias("spans"))


def gated(votes: DataFrame, texts: DataFrame) -> DataFrame:
    """Votes whose quote stands at their span in the record's text; spanless ones pass."""
    joined = votes.join(texts.select("record_id", "text"), "record_id", "left")
    quote = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.where(F.col("start").isNull() | (quote == F.col("quote"))).drop("text")


def score(truth: DataFrame, found: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of two sets of rows."""
    both = truth.select(*keys).distinct().withColumn("_t", F.lit(1)).join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "full_outer")
    tp, fp, fn = F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()), F.count_if(F.col("_t").isNull()), F.count_if(F.col("_f").isNull())
    out = both.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    t, p, n = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return out.select(by, "tp", "fp", "fn", ratio(t, p).alias("precision"), ratio(t, n).alias("recall"), ratio(2 * t, p + n).alias("f1"))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def distractors(tokens: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Typed tokens that nothing claims."""
    return tokens.join(claimed.select(*keys).distinct(), keys, "left_anti")


def misses(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str], k: int) -> DataFrame:
    """The first k rows of truth that weren't found, for each group."""
    w = Window.partitionBy(*by).orderBy(*keys)
    return truth.join(found.select(*keys).distinct(), keys, "left_anti").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def agreement(votes: DataFrame) -> DataFrame:
    """(family_a, family_b, spans, agreed): how often two families that vote at a span give one value."""
    one = votes.select("record_id", "field", "role", "start", "end", "family", "value").distinct()
    a, b = one.withColumnsRenamed({"family": "family_a", "value": "va"}), one.withColumnsRenamed({"family": "family_b", "value": "vb"})
    both = a.join(b, ["record_id", "field", "role", "start", "end"]).where("family_a < family_b")
    return both.groupBy("family_a", "family_b").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("va") == F.col("vb")).alias("agreed"))


def docket_numbers(own: DataFrame, found: DataFrame) -> DataFrame:
    """(record_id, position, number): the collector's own(record_id, ord, number), then the settled found(record_id, value,
    spans) that aren't among them, the most cited first (by the length of their spans, then by value)."""
    first = own.select("record_id", "number", F.lit(0).alias("tier"), F.col("ord").cast("long").alias("place"))
    then = found.select("record_id", F.col("value").alias("number"), F.lit(1).alias("tier"), (-F.size("spans")).cast("long").alias("place"))
    every = first.unionByName(then).groupBy("record_id", "number").agg(F.min(F.struct("tier", "place")).alias("at"))
    order = Window.partitionBy("record_id").orderBy("at", "number")
    return every.select("record_id", (F.row_number().over(order) - 1).alias("position"), "number")


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(n, accuracy): null labels or predictions are wrong."""
    right = F.coalesce(F.col(label) == F.col(predicted), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def class_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1) of every class that is a label or a prediction; empty ratios are 0."""
    by = confusion(rows, label, predicted)
    told = F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    sides = by.select("n", F.explode(told).alias("c"), (F.col(label) == F.col(predicted)).alias("hit"))
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    counts = sides.groupBy(F.col("c.class").alias("class")).agg(n(F.col("c.t") == 1).alias("support"), n(F.col("c.p") == 1).alias("guessed"), n((F.col("c.t") == 1) & F.col("hit")).alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    h, s, g = F.col("hits"), F.col("support"), F.col("guessed")
    return counts.select("class", "support", ratio(h, g).alias("precision"), ratio(h, s).alias("recall"), ratio(2 * h, s + g).alias("f1"))


def placed_accuracy(truth: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(placed, right, accuracy): of the truth's rows that were given a value at all, those given the right one."""
    both = truth.select(*keys, F.col(value).alias("_t")).join(found.select(*keys, F.col(value).alias("_f")), keys).where("_f IS NOT NULL")
    out = both.agg(F.count(F.lit(1)).alias("placed"), F.count_if(F.col("_t") == F.col("_f")).alias("right"))
    return out.withColumn("accuracy", F.when(F.col("placed") > 0, F.col("right") / F.col("placed")).otherwise(0.0))


def below_floors(scores: DataFrame, floors: DataFrame, by: str = "field") -> DataFrame:
    """(by, f1, floor) of floors(by, floor) that the scores don't reach; a field without a score has 0."""
    return floors.join(scores.select(by, "f1"), by, "left").withColumn("f1", F.coalesce("f1", F.lit(0.0))).where("f1 < floor").select(by, "f1", "floor")


def normal_number(field, value) -> F.Column:
    """Amounts and terms at two decimals, other values as they are, so that equal ones compare equal."""
    number = value.try_cast("double")
    return F.when(field.isin("money", "sentence") & number.isNotNull(), F.format_string("%.2f", F.round(number, 2))).otherwise(value)


def extraction_counts(settled: DataFrame) -> DataFrame:
    """(field, values, records)."""
    return settled.groupBy("field").agg(F.count(F.lit(1)).alias("values"), F.countDistinct("record_id").alias("records"))


def search(settled: DataFrame, text: str, field: str | None = None) -> DataFrame:
    """Settled values that hold a text, in any case."""
    kept = settled if field is None else settled.where(F.col("field") == field)
    return kept.where(F.contains(F.lower("value"), F.lit(text.lower())))
