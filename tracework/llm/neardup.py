"""SimHash near-duplicates through BK-trees.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Distinct fingerprints are dealt
to shards so that any two within the radius share one: 64 bits are cut into four bands of 16, two fingerprints
that differ in two bits or fewer agree in two bands at least, and there is a shard for each pair of bands and their 32
bits. Each shard gets a BK-tree (children keyed by the integer Hamming distance to their parent); a fingerprint follows
only the edges within the radius of its own distance. Shards of more than LARGE_SHARD fingerprints are dealt once more
by the bands of their other 32 bits, eight each, after which a tree has 2^16 fingerprints at most. A shard hands on only
a spanning forest of its links, and the components are joined by alternating large and small stars.

Trees are built where the shard's rows are, not broadcast: all trees together grow with the corpus, so no bound on a
broadcast could be proven, and every query would visit every tree.

Defined results: null or empty texts have fingerprint zero and link like any other; a text of fewer words than a
shingle is one shingle; exact copies share a fingerprint and are represented by their smallest doc_id; repeated rows
are kept; null ids never are the smallest unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.operators.linkage import connected
from tracework.session import cut, whole_texts

SHINGLE = 3
RADIUS = 2
LARGE_SHARD = 20_000
#: Links that one task joins; more are joined on the cluster.
FEW_LINKS = 200_000

#: Byte value -> eight byte lanes, lane i being bit i.
_LANES = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text's words, A-Z lower-cased."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(view[a:b], 42) for a, b in pairs), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 255):  # a lane of eight bits counts to 255
        sums = _LANES[octets[at : at + 255]].sum(axis=0, dtype=np.uint64)
        counts += sums.view(np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and fp (long) of every row of docs.text."""
    kept = whole_texts(docs).select(*carry, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text").schema) + ", fp long"

    def hash_batch(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            fps = np.array([majority(shingle_hashes(t.as_py(), shingle)) for t in texts], np.uint64).view(np.int64)
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], [*carry, "fp"])

    return kept.mapInArrow(hash_batch, schema)


class BKTree:
    """Nodes in arrays; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].setdefault(d, new)
            if child == new:
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most radius away."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) > 2 * radius + 1:
                open_ += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
            else:
                open_ += [child for e, child in edges.items() if d - radius <= e <= d + radius]
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) links that span the components of the values linked within radius."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def _trees(shards: DataFrame, radius: int) -> DataFrame:
    """shards(k1, k2, fp) -> links (a, b): each shard stands together in one task, in runs."""
    dealt = shards.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")

    def run(batches):
        key, values, links = None, [], []
        for batch in batches:
            k1, k2, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
                now = (int(k1[a]), int(k2[a]))
                if now != key:
                    if len(values) > 1:
                        links += spanning_links(values, radius)
                    key, values = now, []
                values += fp[a:b].view(np.uint64).tolist()
            if len(links) > 10_000:
                yield _link_batch(links)
                links = []
        if len(values) > 1:
            links += spanning_links(values, radius)
        yield _link_batch(links)

    return dealt.mapInArrow(run, "a long, b long")


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _band_pairs(value, width: int):
    """[(pair number, the two bands' bits)] of the four bands of a value of 4 x width bits."""
    mask = (1 << width) - 1
    bands = [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit(mask).cast("long")) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.shiftleft(bands[i], width).bitwiseOR(bands[j]).alias("v")) for n, (i, j) in enumerate(pairs)]), pairs


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE_SHARD) -> DataFrame:
    """Links (a, b) that span the components of distinct(fp) linked within the radius (2 or fewer bits)."""
    if radius > 2:
        raise ValueError("two of four bands agree only up to a radius of 2")
    keys, pairs = _band_pairs(F.col("fp"), 16)
    shards = distinct.select("fp", F.explode(keys).alias("k")).select(
        F.shiftleft(F.col("k.v"), 3).bitwiseOR(F.col("k.n")).alias("k1"), F.col("k.n").alias("n"), "fp"
    )
    sizes = shards.groupBy("k1").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    sized = shards.join(sizes, "k1")
    # the other 32 bits of a large shard's fingerprints: the two bands that its pair leaves out
    other = [[b for b in range(4) if b not in pair] for pair in pairs]
    rest = F.coalesce(
        *[
            F.when(
                F.col("n") == n,
                F.shiftleft(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(65535).cast("long")), 16).bitwiseOR(
                    F.shiftrightunsigned("fp", 16 * j).bitwiseAND(F.lit(65535).cast("long"))
                ),
            )
            for n, (i, j) in enumerate(other)
        ]
    )
    small_keys, _ = _band_pairs(rest, 8)
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("v")))
    dealt = sized.select("k1", "fp", F.explode(F.when(F.col("size") > large, small_keys).otherwise(whole)).alias("k")).select(
        "k1", F.shiftleft(F.col("k.v"), 3).bitwiseOR(F.col("k.n") + 1).alias("k2"), "fp"
    )
    return _trees(dealt, radius).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, fp (long) and component_id of every row of docs(doc_id, text)."""
    prints = cut(fingerprints(docs, shingle, carry), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = cut(fingerprint_links(least.select("fp"), radius), "fingerprint-links")
    grouped = connected(links, few=FEW_LINKS)  # (node, root) of linked fingerprints only
    named = least.join(grouped, least["fp"] == grouped["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    # components of one fingerprint need no shuffle by root but take part for the sake of one plan
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = cut(named.join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(by_print, "fp").select(*carry, "fp", "component_id")
