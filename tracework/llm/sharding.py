"""Sharding by a hierarchical weighted hash tree.

A tree is a list of regions, each a list of racks, each a list of (shard id, weight) pairs. A row descends from
the root: at every level each child draws -ln(u)/w, with u a hash of (row key, child's path) in (0, 1) and w the
child's weight, and the smallest draw wins. A child's weight is the sum of the weights below it, so a change of a
leaf's weight moves rows only between the subtrees whose weights change. A shard added as a region of its own
(grow) changes no other weight: rows then move only into it.

Defined results: a null key hashes as the text "null"; null text has size 8 and CRC 0; repeated rows get the same
shard and each its own slot; ties in a draw go to the first child; an empty table gives no rows; columns of the
input that clash with result names are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tree = list[list[list[tuple[int, float]]]]

#: Slots are numbered within this many hash buckets per shard and then offset, so no task holds a whole shard.
SLOT_BUCKETS = 256


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """Shards 0, 1, ... of weight 1, dealt region by region."""
    ids = iter(range(regions * racks * shards))
    return [[[(next(ids), 1.0) for _ in range(shards)] for _ in range(racks)] for _ in range(regions)]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own."""
    return [*tree, [[(1 + max(s for region in tree for rack in region for s, _ in rack), weight)]]]


def _weight(node) -> float:
    return float(node[1]) if isinstance(node, tuple) else sum(_weight(child) for child in node)


def draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u)/weight; u from the first 52 bits of md5(key|path)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + path))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(weight)


def descend(key: Column, node, path: str = "r") -> Column:
    """The shard id that the key reaches below node."""
    if isinstance(node, tuple):
        return F.lit(int(node[0]))
    open_to = [(i, child) for i, child in enumerate(node) if _weight(child) > 0]
    if len(open_to) == 1:
        return descend(key, open_to[0][1], f"{path}.{open_to[0][0]}")
    draws = [F.struct(draw(key, f"{path}.{i}", _weight(child)).alias("d"), F.lit(i).alias("i")) for i, child in open_to]
    winner = F.least(*draws)["i"]
    if all(isinstance(child, tuple) for _, child in open_to):
        return F.element_at(F.create_map(*[F.lit(x) for i, child in open_to for x in (i, int(child[0]))]), winner)
    picked = F.transform(
        F.array(winner),
        lambda w: F.coalesce(*[F.when(w == i, descend(key, child, f"{path}.{i}")) for i, child in open_to]),
    )
    return picked[0]


def shard_documents(docs: DataFrame, tree: Tree, slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    in_bucket = F.concat(key, F.lit("|"), F.crc32(text).cast("string"))  # rows that share an id, too, are dealt
    bucket = F.pmod(F.conv(F.substring(F.md5(in_bucket), 1, 8), 16, 10).cast("long"), F.lit(slot_buckets)).cast("int")
    placed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(key, tree).alias("shard"),
        descend(key, grow(tree)).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    # at most (shards x buckets) rows, whatever the input: a size fixed by parameters, so it may be broadcast
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
            F.col("grown_shard").cast("int").alias("grown_shard"),
        )
    )
