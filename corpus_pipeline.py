"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's docs.

ORACLE_SQL is None: fingerprints, hashed n-grams and the tokenizer's ids can't be expressed in SQL; the tests hold each
stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.llm import bpe, decontam, linedup, quality, similar
from tracework.llm.queries import vocabulary
from tracework.session import cut, drop_tables, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the likelihood-ratio threshold. Null and empty texts have no words and go;
    repeated rows are judged alike and all stay or go; a score equal to the threshold stays; without trusted documents
    only the base rules count; columns may have any names; an empty table stays empty."""
    # the row travels as one struct, so that none of its columns can clash with the judgement's
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    judged = quality.quality_rules(packed, table(spark, sf_dir, "labels"), carry=("_doc",))
    # not where("kept"): the optimizer would push it below the arrays of the judgement and compute them for each element
    kept = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("_doc"))).alias("_doc")).where("_doc IS NOT NULL")
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated runs of lines; n_chars follows the text. Null texts stay null,
    with n_chars null; of copies the first by id stays whole (ties: by a hash of the text); rows equal in id and text are
    treated alike; rows that share an id only are cut each by its own text; an empty table stays empty."""
    return linedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a similarity of 0.8 or more in shingles of five words: the first by id (null
    ids last), then by a hash of the text. Rows are judged by id and text together; of rows equal in both the first by
    the other columns stays; null and empty texts are copies of each other; an empty table stays empty."""
    return similar.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Null and empty texts hold none and stay; repeated rows stay or go together;
    null and blank items match nothing; an empty table, or benchmark, changes nothing."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, of every row: null texts are empty, repeated rows
    are encoded alike; an empty table gives no rows."""
    return bpe.encode_digests(docs, vocabulary())


#: The stage of near-duplicates tests what SimHash fingerprints in BK-trees and MinHash bands propose for exact similarity: no
#: SimHash of 64 bits alone finds a similarity of 0.8 (see similar.py and the README).
STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is a written table; the work files that led to it are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with drop_tables(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
