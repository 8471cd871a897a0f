"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are lower-cased and white space runs become single blanks. An item of m characters has an error
budget of k = m // ERROR_SHARE edits and is split into k + 1 pieces; a passage within k edits of it holds at least one
piece unchanged. An automaton over all pieces finds their exact hits in one pass over a document; around each hit the
stretch that the item could take up is verified with Myers' bit-parallel distance, whatever the item's length: its bits
are one long integer.

Equal items are one, with their ids grouped. Benchmarks are taken in blocks of BLOCK_BYTES, each broadcast for one pass
over all documents.

Defined results: null and blank items match nothing, as null texts hold nothing; an item of under ERROR_SHARE characters
must stand as it is; repeated documents or items are reported alike; a document that holds an item more than once is
reported once, with the least distance; items whose id is null are no items; empty tables give no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.session import whole_texts

ERROR_SHARE = 16
BLOCK_BYTES = 8 << 20


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces_of(unit: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) for budget + 1 pieces of about equal length."""
    cuts = [len(unit) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, unit[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def budget_of(unit: str, error_share: int = ERROR_SHARE) -> int:
    return len(unit) // error_share


class Myers:
    """Least edit distance of a pattern to any stretch of a text (Myers 1999), in one integer of len(pattern) bits."""

    def __init__(self, pattern: str) -> None:
        self.m = len(pattern)
        self.all = (1 << self.m) - 1
        self.top = 1 << (self.m - 1)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def least(self, text: str) -> int:
        every, top, masks = self.all, self.top, self.masks.get
        up, down, score, best = every, 0, self.m, self.m
        for c in text:
            eq = masks(c, 0)
            across = eq | down
            diagonal = (((eq & up) + up) ^ up) | eq
            right = down | (every & ~(diagonal | up))
            left = up & diagonal
            if right & top:
                score += 1
            elif left & top:
                score -= 1
                best = min(best, score)
            right = (right << 1) & every  # a match may begin anywhere: no one is carried in
            left = (left << 1) & every
            up = left | (every & ~(across | right))
            down = right & across
        return best


class Matcher:
    """Finds test items, [(ids, text)], in documents."""

    def __init__(self, items: list[tuple[list[int], str]], error_share: int = ERROR_SHARE) -> None:
        import ahocorasick

        by_text: dict[str, set[int]] = {}
        for ids, text in items:
            if told := normalised(text or ""):
                by_text.setdefault(told, set()).update(ids)
        self.units = [(told, budget_of(told, error_share), sorted(ids)) for told, ids in sorted(by_text.items())]
        places: dict[str, list[tuple[int, int]]] = {}
        for u, (unit, budget, _) in enumerate(self.units):
            for offset, piece in pieces_of(unit, budget):
                places.setdefault(piece, []).append((u, offset))
        self.found_by = ahocorasick.Automaton()
        for piece, where in places.items():
            self.found_by.add_word(piece, (len(piece), where))
        if places:
            self.found_by.make_automaton()
        self.empty = not places
        self.myers: dict[int, Myers] = {}

    def hits(self, text: str | None) -> dict[int, int]:
        """Item -> least distance, for the items within their budgets."""
        if self.empty or not text:
            return {}
        text = normalised(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.found_by.iter(text):
            for u, offset in where:
                unit, budget, _ = self.units[u]
                begin = end - size + 1 - offset
                spans.setdefault(u, []).append((max(0, begin - budget), min(len(text), begin + len(unit) + budget)))
        found: dict[int, int] = {}
        for u, stretches in spans.items():
            unit, budget, items = self.units[u]
            best = budget + 1
            if unit in text:
                best = 0
            else:
                if u not in self.myers:
                    self.myers[u] = Myers(unit)
                # stretches that overlap in more than a half are verified together
                stretches.sort()
                merged = [list(stretches[0])]
                for a, b in stretches[1:]:
                    if a <= merged[-1][1] - len(unit) // 2:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    best = min(best, self.myers[u].least(text[a:b]))
            if best <= budget:
                for item in items:
                    found[item] = min(best, found.get(item, best))
        return found


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Lists of (ids, text) of about block_bytes each, equal texts once; only one is on the driver at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    total = items.agg(F.sum(F.octet_length("text") + 8 * F.size("ids"))).first()[0] or 0
    parts = max(1, math.ceil(total / block_bytes))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield [(list(r["ids"]), r["text"]) for r in own.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, error_share: int = ERROR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): every pair of a document and a test item that it holds within the budget."""
    sc = docs.sparkSession.sparkContext
    found = None
    for items in benchmark_blocks(benchmark, block_bytes):
        shared = sc.broadcast(items)

        def scan(batches, shared=shared):
            matcher = Matcher(shared.value, error_share)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                rows = [(i, item, d) for i, t in zip(ids, texts, strict=True) for item, d in matcher.hits(t.as_py()).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "distance"])

        part = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, item_id long, distance int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_share: int = ERROR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no test item; one pass for each block of the benchmark, no shuffle."""
    sc = docs.sparkSession.sparkContext
    for items in benchmark_blocks(benchmark, block_bytes):
        shared = sc.broadcast(items)

        def keep(batches, shared=shared):
            matcher = Matcher(shared.value, error_share)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not matcher.hits(t.as_py()) for t in texts], pa.bool_()))

        docs = whole_texts(docs).mapInArrow(keep, docs.schema)
    return docs
