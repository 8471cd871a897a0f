"""URL filter by a Bloom filter cascade.

The key universe is every key that any url of the corpus can be looked up by: host suffixes, and host suffixes with
a path prefix. Level 0 encodes the listed keys; level 1 the unlisted keys of the universe that level 0 takes for
listed; level 2 the listed ones that level 1 takes for those, and so on until a level has no false positives. A
key is listed if the first level that rejects it has an odd number, which is exact for every key of the universe, so
urls are judged without a join.

Defined results: a null url, or one without "://", has empty host and path and no rule; repeated rows are judged
alike; the longest rule (host and path together, then host) wins; an empty table gives no rows; columns of the
input other than the id and url are not carried over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.session import cut

#: Most bytes of all levels that one pass broadcasts; larger cascades are split by key hash and applied in passes.
MAX_FILTER_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """action for urls of host (and its subdomains) whose path starts with path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray


@dataclass
class Cascade:
    """segments[s] holds the levels for keys whose first hash is s modulo their number."""

    segments: list[list[Level]] = field(default_factory=list)

    def nbytes(self) -> int:
        return sum(level.words.nbytes for levels in self.segments for level in levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The host and its parent domains of no more labels than any listed key has."""
    labels = F.least(F.size(F.split(host, "\\.")), F.lit(most_labels))
    return F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def lookup_keys(host: Column, path: Column, most_labels: int, path_lengths: list[int]) -> Column:
    """The keys by which a url may be listed: "suffix" for hosts, "suffix/path..." for rules."""
    suffixes = host_suffixes(host, most_labels)
    none = F.array().cast("array<string>")

    def with_prefix(n: int) -> Column:
        prefix = F.left(path, F.lit(n))
        return F.when(F.length(path) >= n, F.transform(suffixes, lambda s: F.concat(s, prefix))).otherwise(none)

    rules = [with_prefix(n) for n in path_lengths]
    return F.concat(suffixes, *rules)


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """splitmix64's finaliser over x moved by the level."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    first, step = _mix(a.view(np.uint64), level) % np.uint64(bits), _mix(b.view(np.uint64), level) % np.uint64(bits)
    return (first[:, None] + step[:, None] * np.arange(hashes, dtype=np.uint64)[None, :]) % np.uint64(bits)


def _hits(a: np.ndarray, b: np.ndarray, number: int, level: Level) -> np.ndarray:
    at = _positions(a, b, number, level.bits, level.hashes)
    return ((level.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def contains(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe, exactly."""
    listed = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    for number, level in enumerate(levels):
        if not len(open_):
            break
        hit = _hits(a[open_], b[open_], number, level)
        listed[open_[~hit]] = number % 2 == 1
        open_ = open_[hit]
    listed[open_] = len(levels) % 2 == 1
    return listed


def _hash_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)


def _encode(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """One level over n keys(a, b): bits set in the tasks, merged by word in the JVM, no more words than the level has."""
    bits = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))

    def set_bits(batches):
        for batch in batches:
            at = np.unique(_positions(*_hash_arrays(batch), number, bits, hashes).ravel())
            word = (at >> np.uint64(6)).astype(np.int64)
            value = np.uint64(1) << (at & np.uint64(63))
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.array([], int)
            merged = np.bitwise_or.reduceat(value, starts) if len(word) else value
            yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(merged.view(np.int64))], ["w", "v"])

    rows = keys.mapInArrow(set_bits, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, hashes, words)


def _taken_for_listed(keys: DataFrame, number: int, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_hits(*_hash_arrays(batch), number, shared.value)))

    return keys.mapInArrow(keep, "a long, b long")


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade:
    """The cascade of listed(key) over universe(key). Listed keys outside the universe are left out: none is asked for."""
    keys = (
        universe.select("key", F.lit(0).alias("l"), F.lit(1).alias("u"))
        .unionByName(listed.select("key", F.lit(1).alias("l"), F.lit(0).alias("u")))
        .where("key IS NOT NULL").groupBy("key").agg(F.max("l").alias("l"), F.max("u").alias("u")).where("u = 1")
        .select("l", hashed(F.col("key")).alias("h")).select("l", "h.a", "h.b")
    )
    keys = cut(keys, "cascade-keys")
    counts = {r["l"]: r["n"] for r in keys.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_in, n_out = counts.get(1, 0), counts.get(0, 0)
    # about log2(n_out / n_in) + 3 hashes of 1.44 bits for each listed key in all levels together
    guess = n_in * 1.44 * (3 + max(0.0, math.log2(max(1, n_out) / max(1, n_in)))) / 8
    parts = max(1, math.ceil(2 * guess / max_bytes))
    cascade = Cascade()
    for part in range(parts):
        own = keys if parts == 1 else keys.where(F.pmod("a", F.lit(parts)) == part)
        inside, outside = own.where("l = 1").select("a", "b"), own.where("l = 0").select("a", "b")
        levels: list[Level] = []
        n = n_in if parts == 1 else inside.count()
        rate = min(0.5, max(1e-9, n / (math.sqrt(2) * max(1, n_out / parts))))
        while n:
            level = _encode(inside, len(levels), n, rate)
            wrong = cut(_taken_for_listed(outside, len(levels), level), "cascade-level")
            levels.append(level)
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
        cascade.segments.append(levels)
    return cascade


def flag_listed(df: DataFrame, cascade: Cascade) -> DataFrame:
    """df with column keys(array<string>), and listed(array<boolean>) beside it, one segment a pass."""
    out = df.withColumn("hashes", F.transform("keys", hashed)).withColumn("listed", F.transform("keys", lambda _: F.lit(False)))
    n = len(cascade.segments)
    for part, levels in enumerate(cascade.segments):
        shared = df.sparkSession.sparkContext.broadcast(levels)

        def test(batches, shared=shared, part=part):
            for batch in batches:
                hashes, listed = batch.column("hashes"), batch.column("listed")
                flat = hashes.flatten()
                a = flat.field("a").to_numpy(zero_copy_only=False)
                b = flat.field("b").to_numpy(zero_copy_only=False)
                found = listed.flatten().to_numpy(zero_copy_only=False).astype(bool)
                mine = np.flatnonzero(a % n == part)
                found[mine] = contains(shared.value, a[mine], b[mine])
                lengths = np.diff(hashes.offsets.to_numpy())
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                at = batch.schema.get_field_index("listed")
                yield batch.set_column(at, batch.schema.field(at), pa.ListArray.from_arrays(offsets, pa.array(found), type=batch.schema.field(at).type))

        out = out.mapInArrow(test, out.schema)
        if n > 1:
            out = cut(out, "cascade-pass")
    return out.drop("hashes")


def judge_urls(pages: DataFrame, rules: list[Rule], listed_hosts: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(page_id, host, path, rule, listed_host, verdict) of every row of pages(page_id, url).

    listed_hosts(key): hosts that are blocked with all their subdomains where no rule fits."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    lengths = sorted({len(r.path) for r in rules})
    labels = listed_hosts.agg(F.max(F.size(F.split("key", "\\.")))).first()[0] or 1
    most = max([labels, *(r.host.count(".") + 1 for r in rules)])
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", lookup_keys(F.col("host"), F.col("path"), most, lengths))
    universe = urls.select(F.explode("keys").alias("key")).distinct()
    rule_keys = spark.createDataFrame([(r.name,) for r in rules], "key string")
    cascade = build_cascade(universe, listed_hosts.select("key").unionByName(rule_keys), max_bytes)
    hits = F.transform(
        F.filter(F.arrays_zip("keys", "listed"), lambda x: x["listed"]), lambda x: x["keys"]
    )
    flagged = flag_listed(urls, cascade).select("page_id", "host", "path", hits.alias("hits"))
    # the rules are a parameter of fixed size: their names are compared with the few keys that the cascade lists
    actions = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.action)])
    order = F.array_max(
        F.transform(
            F.filter("hits", lambda k: F.map_contains_key(actions, k) & F.contains(k, F.lit("/"))),
            lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("k")),
        )
    )
    blocked = F.filter("hits", lambda k: ~F.contains(k, F.lit("/")))
    return (
        flagged.select("page_id", "host", "path", order["k"].alias("rule"), F.get(blocked, F.lit(0)).alias("listed_host"))
        .withColumn("verdict", F.coalesce(F.element_at(actions, F.col("rule")), F.when(F.col("listed_host").isNotNull(), "block").otherwise("allow")))
    )
