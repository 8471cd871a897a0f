"""Vocabularies and the statute dimension: small tables of our own, config data for the taggers and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (profile, domains, order): common holds for every record.
PROFILES = [("common", [], 0), ("fraud", ["fraud", "scams"], 1), ("trafficking", ["trafficking"], 2), ("cyber", ["cyber"], 3)]

#: (profile, field, label, cue); cues mean the same in all regular expression dialects used.
TAGS = [
    ("common", "channel", "email", "e-?mail"), ("common", "channel", "phone_call", "phone calls?"), ("common", "channel", "text_message", "text messages?"), ("common", "channel", "mail", "letters?"),
    ("common", "platform", "forum", "forums?"), ("common", "platform", "marketplace", "market ?places?"),
    ("fraud", "scheme", "advance_fee", "advance fees?"), ("fraud", "scheme", "romance", "romance"), ("fraud", "scheme", "investment", "invest(or|ment)s?"), ("fraud", "channel", "wire_transfer", "wire transfers?"),
    ("trafficking", "scheme", "false_job", "job offers?"), ("trafficking", "scheme", "debt_bondage", "debts?"),
    ("cyber", "scheme", "ransomware", "ransom(ware)?"), ("cyber", "scheme", "phishing", "phishing"), ("cyber", "channel", "email", "attachments?"),
]

#: (profile, bucket, label): what a collector's bucket says about the scheme.
BUCKETS = [("fraud", "romance_scams", "romance"), ("fraud", "ponzi", "investment"), ("cyber", "ransom", "ransomware"), ("trafficking", "jobs", "false_job"), ("common", "ponzi", "other")]

# fixed values of the law: title, section, offense, mandatory minimum and statutory maximum in months (none: it depends, or life)
STATUTES = [
    ("18", "371", "conspiracy", None, 60, False),
    ("18", "1001", "false_statements", None, 60, False),
    ("18", "1028A", "aggravated_identity_theft", 24, 24, False),
    ("18", "1030", "computer_fraud", None, None, False),
    ("18", "1341", "mail_fraud", None, 240, False),
    ("18", "1343", "wire_fraud", None, 240, False),
    ("18", "1344", "bank_fraud", None, 360, False),
    ("18", "1591", "sex_trafficking", 120, None, True),
    ("18", "1956", "money_laundering", None, 240, False),
    ("26", "7201", "tax_evasion", None, 60, False),
]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, domains array<string>, ord int")


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAGS, "profile string, field string, label string, cue string")


def buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUCKETS, "profile string, bucket string, label string")


def statutes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUTES, "title string, section string, label string, low int, high int, life boolean")
