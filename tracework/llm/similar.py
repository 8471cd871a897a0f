"""Near-duplicates by the exact Jaccard similarity of word shingles, with candidates from SimHash fingerprints in BK-trees
and from MinHash bands.

Each distinct set of shingles has a SimHash fingerprint, and the BK-trees of neardup.py link those within RADIUS bits: close
copies. These alone can't serve a similarity of 0.8: sets of that Jaccard stand at a cosine of about 0.89, so their
fingerprints differ in about ten bits, and shards for so wide a radius would hold most of the corpus. So each set also has
BANDS bands of ROWS minima of multiply-shift permutations; two sets of similarity s share no band with a probability of
(1 - s^ROWS)^BANDS, 3 in 100,000 at 0.8. Sets that the trees link or that share a band are candidates; the components of the
candidates are clusters, found from links of each bucket's sets to its least one and from those of the trees. Within a cluster
every pair of candidates is tested on the sets themselves, by counting what a set shares with all its candidates in one
pass over their shingles, unless the pair is joined already; so no link is false, none is lost, and no pair is a row. A
cluster too large for one task is cut into blocks, and each pair of blocks is a task.

Defined results: rows are told apart by id and text, so rows that share an id are judged each by its own text; null and
empty texts are the empty set and equal to each other; a text of fewer words than a shingle is one shingle; null ids
come after all others; of rows equal in id and text the first by their other columns stays; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracework.llm.neardup import FEW_LINKS, RADIUS, fingerprint_links, majority, shingle_hashes
from tracework.operators.linkage import connected
from tracework.session import cut, give_back, small, whole_texts

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
CHUNK = 512

_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of a set of hashes."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (_FACTORS[:, None] * hashes[at : at + CHUNK]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - 2**63 for b in range(BANDS)]


#: What one block of a cluster has at most, about: sets, and shingles of theirs.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000


class Cluster:
    """Sets that may be similar: their names, band keys, fingerprints and hashes; side tells the two blocks of a task apart."""

    def __init__(self, names: list[int], keys: np.ndarray, hashes: list[np.ndarray], side: np.ndarray) -> None:
        self.names, self.keys, self.side = names, keys, side
        self.prints = np.array([majority(h) for h in hashes], np.uint64)
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.ends = np.cumsum(self.sizes)
        _, self.codes = np.unique(np.concatenate(hashes), return_inverse=True) if len(hashes) else (None, np.zeros(0, int))
        self.mark = np.zeros(int(self.codes.max(initial=-1)) + 1, np.int64)

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles of x each of the others has."""
        own = self.codes[self.ends[x] - self.sizes[x] : self.ends[x]]
        self.mark[own] = 1
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.ends[others] - sizes - (ends - sizes), sizes)
        told = np.add.reduceat(np.r_[self.mark[self.codes[at]], 0], ends - sizes) * (sizes > 0)
        self.mark[own] = 0
        return told

    def links(self, similarity: float) -> list[tuple[int, int]]:
        """Links that span the components of the similar candidates; of two blocks, candidates stand in different ones."""
        root, out, place = np.arange(len(self.names)), [], np.arange(len(self.names))
        for x in range(len(self.names)):
            few, many = np.minimum(self.sizes, self.sizes[x]), np.maximum(self.sizes, self.sizes[x])
            fits = (place > x) & (root != root[x]) & (few >= similarity * many)
            if self.side.any():
                fits &= self.side != self.side[x]
            others = np.flatnonzero(fits)
            near = np.bitwise_count(self.prints[others] ^ self.prints[x]) <= RADIUS
            others = others[near | (self.keys[others] == self.keys[x]).any(axis=1)] if len(others) else others
            if not len(others):
                continue
            both = self.shared(x, others)
            every = self.sizes[others] + self.sizes[x] - both
            alike = np.where(every > 0, both / np.maximum(every, 1), 1.0) >= similarity
            for y in others[alike].tolist():
                if root[y] != root[x]:
                    out.append((self.names[x], self.names[y]))
                    root[root == root[y]] = root[x]
        return out


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, set (a digest of the row's set of shingles), n (its size), fp (its fingerprint) and bands (their
    keys)."""

    def sketch(batches):
        for batch in batches:
            sets, sizes, prints, bands = [], [], [], []
            for text in batch.column(2):
                hashes = np.unique(shingle_hashes(text.as_py(), shingle))
                sets.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42) - 2**63)
                sizes.append(len(hashes))
                prints.append(majority(hashes))
                bands.append(band_keys(hashes))
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            columns = [pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), fps, pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "text_key", "set", "n", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(sketch, f"doc_id {kind}, text_key long, set long, n long, fp long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _hashes(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """set and hashes (sorted, as bytes) of wanted(set, id, text_key): texts are read back by id and key."""

    def pack(batches):
        for batch in batches:
            packed = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["set", "hashes"])

    wanted = small(wanted.withColumnRenamed("text_key", "wanted_key"), BROADCAST_ROWS)
    found = _keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("wanted_key")))
    return found.select("set", "text").mapInArrow(pack, "set long, hashes binary").dropDuplicates(["set"])


def cluster_links(members: DataFrame, similarity: float, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that span the similar sets of members(cluster, set, n, bands, hashes)."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(F.col("shingles") / block_shingles), F.lit(1)).cast("int")
    dealt = members.join(sizes.select("cluster", parts.alias("parts")), "cluster").withColumn("block", F.pmod(F.xxhash64("set", F.lit(9)), F.col("parts")).cast("int"))
    # a block meets itself and every other one: the task of two blocks is named by the lesser and the greater
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rows = dealt.select("cluster", F.explode(tasks).alias("t"), "block", "set", "bands", "hashes").select("cluster", "t.i", "t.j", "block", "set", "bands", "hashes")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "set")

    def test(batches):
        key, held = None, []

        def done():
            if len(held) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            names, keys, hashes, blocks = zip(*held, strict=True)
            side = np.array(blocks) != blocks[0] if key[1] != key[2] else np.zeros(len(names), bool)
            found = [] if key[1] != key[2] and not side.any() else Cluster(list(names), np.array(keys), list(hashes), side).links(similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for n in range(batch.num_rows):
                now = tuple(batch.column(k)[n].as_py() for k in range(3))
                if now != key:
                    yield done()
                    key, held = now, []
                held.append((batch.column(4)[n].as_py(), batch.column(5)[n].as_py(), np.frombuffer(batch.column(6)[n].as_buffer(), np.uint64), batch.column(3)[n].as_py()))
        yield done()
        held.clear()
        give_back()

    return rows.mapInArrow(test, "a long, b long").distinct()


def candidate_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that span the candidates among sets(set, fp, bands): sets whose fingerprints the BK-trees link, sets with
    one fingerprint, and sets that share a band."""
    banded = sets.select("set", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    by_band = banded.join(shared, ["band", "key"]).select("a", F.col("set").alias("b"))
    first = cut(sets.groupBy("fp").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("sets")), "prints")
    by_print = sets.select("fp", "set").join(first.where("sets > 1"), "fp").select("a", F.col("set").alias("b"))
    trees = fingerprint_links(first.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    one, other = first.select(F.col("fp").alias("fp_a"), "a"), first.select(F.col("fp").alias("fp_b"), F.col("a").alias("b"))
    by_tree = trees.join(one, "fp_a").join(other, "fp_b").select("a", "b")
    return by_band.unionByName(by_print).unionByName(by_tree).where("a <> b").distinct()


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key (a hash of the text), component_id (the smallest id of its component) and first (whether the row is
    the component's first, by id, then text_key), of every row of docs(doc_id, text)."""
    rows = cut(shingle_sets(docs, shingle), "shingle-sets")
    # one row of each set: its first row; size, fingerprint and bands are equal in all of them
    every = [F.first(c).alias(c) for c in ("n", "fp", "bands")]
    least = cut(rows.groupBy("set").agg(F.min(_place()).alias("row"), *every), "distinct-sets")
    near = candidate_links(least)
    clusters = cut(connected(near, few=FEW_LINKS).select(F.col("node").alias("set"), F.col("root").alias("cluster")), "candidate-clusters")
    members = cut(least.join(clusters, "set").select("cluster", "set", "n", "bands", F.when(~F.col("row.none"), F.col("row.doc_id")).alias("id"), "row.text_key"), "cluster-members")
    sets = cut(_hashes(docs, members.select("set", "id", "text_key"), shingle), "candidate-sets")
    grouped = connected(cluster_links(members.drop("id", "text_key").join(sets, "set"), similarity), few=FEW_LINKS)
    named = least.join(grouped, least["set"] == grouped["node"], "left").select("set", "row", F.coalesce("root", "set").alias("root"))
    smallest = named.groupBy("root").agg(F.min("row").alias("head"))
    by_set = cut(named.join(smallest, "root").select("set", "head"), "components")
    placed = rows.select("doc_id", "text_key", "set").join(by_set, "set")
    return placed.select("doc_id", "text_key", F.when(~F.col("head.none"), F.col("head.doc_id")).alias("component_id"), (_place() == F.col("head")).alias("first"))


def _place():
    """Order of rows: null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text_key")


#: Rows that are broadcast, keys of two numbers; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without all but the first of each component."""
    judged = cut(similar_documents(docs, shingle, similarity), "near-copies")
    gone = judged.where("NOT first").select(F.col("doc_id").alias("_gd"), F.col("text_key").alias("_gk")).distinct()
    # the row travels as one struct, so that none of its columns can clash with those used here
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    same = lambda other, d, k: F.col("_id").eqNullSafe(other[d]) & (F.col("_key") == other[k])
    gone = small(gone, BROADCAST_ROWS)
    left = keyed.join(gone, same(gone, "_gd", "_gk"), "left_anti")
    again = judged.where("first").groupBy(F.col("doc_id").alias("_rd"), F.col("text_key").alias("_rk")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not again.isEmpty():  # rows equal in id and text
        again = small(again, BROADCAST_ROWS)
        order = Window.partitionBy("_id", "_key").orderBy("_doc")
        repeated = left.join(again, same(again, "_rd", "_rk"), "left_semi").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
        left = left.join(again, same(again, "_rd", "_rk"), "left_anti").unionByName(repeated)
    return left.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
