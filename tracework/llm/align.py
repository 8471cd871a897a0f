"""Alignment of two tokenizers' tokens by the byte offsets where both have a token end.

A encodes the text with a space before it, B the text, before which it puts a space of its own. So both have the bytes of
space + text, or the text has no tokens here.

1. Spark splits space + text before each space that follows a character other than white space. Neither tokenizer has a
   token across such a place (A's pattern never has white space after another character, and no piece of B has a space
   after another character: both are checked for the given files), so a text's tokens are those of its parts.
2. A task keeps a table of distinct parts. New parts of a batch are encoded and aligned together: a packed bitset for
   each tokenizer marks the bytes where a token ends, AND leaves the shared cuts, and ranks by popcount give the numbers of
   A's and B's tokens before each cut, hence the token ranges of each group.
3. Documents are put together from their parts. Two tokens are linked if they end at one cut.
4. The links are written, then counted by id pair over the whole corpus. Of two tokens that end together in one text one
   has the other's bytes at its end, so the pairs that can occur are bounded by the vocabularies (pair_bound), whatever the
   corpus. Only this table of counts goes to the driver and is broadcast, and the written links get their counts.

Defined results: null and empty texts, and texts whose tokens' joined bytes differ from space + text (U+2581 in a text,
which B takes for a space), have no tokens: zeros and '' for the digest; special tokens' strings in texts are plain
text; repeated rows are aligned alike, and each counts; an empty table gives no rows; columns of the input other than those
carried are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.session import cut, give_back, whole_texts

#: Distinct parts, and their bytes, that a task keeps. Beyond either, those go that the last KEPT_TURNS batches did without,
#: or else all; this changes no result.
KEPT_PARTS = 150_000
KEPT_BYTES = 16 << 20
KEPT_TURNS = 2
#: Parts that a tokenizer gets at once.
ENCODE_PARTS = 4_096
#: Places where space + text is cut: before a space, unless white space or a control character stands before it.
PART_BREAK = r"(?<=[^\s\p{Z}\p{C}])(?= )"

# fixed value: how byte-level vocabularies split a text
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


class ByteTokens:
    """A: a byte-level vocabulary of the tokenizers library. If its merges stand in the order of the ids that they make, the
    ids are ranks, and tiktoken merges by rank to the same ids in a quarter of the time; else the library itself encodes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data["normalizer"] is not None or data["pre_tokenizer"]["type"] != "ByteLevel" or not data["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        vocab, letters = data["model"]["vocab"], byte_letters()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            if all(c in letters for c in piece):
                self.bytes[i] = bytes(letters[c] for c in piece)
        special = {t["content"] for t in data["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        ranked = [vocab[a + b] for a, b in pairs] == list(range(256, 256 + len(pairs))) and sorted(map(len, self.bytes[:256])) == [1] * 256
        plain = {k: data["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")}
        if ranked and not any(plain.values()) and not data["model"].get("ignore_merges"):
            import tiktoken

            ranks = {self.bytes[i]: i for piece, i in vocab.items() if piece not in special}
            encoding = tiktoken.Encoding("A", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda parts: list(map(encoding.encode_ordinary, parts))
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        self.encode = lambda parts: [e.ids for e in tokenizer.encode_batch(parts, add_special_tokens=False)]


class PieceTokens:
    """B: a sentencepiece model, which puts a space before what it encodes; a part's own first space is left out for it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id("▁")
        self.bytes = []
        for i in range(len(self.model)):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            plain = piece.replace("▁", " ")
            if " " in plain.lstrip(" "):
                raise ValueError(f"{path} has a piece with a space inside: {piece}")
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else plain.encode())

    def encode(self, parts: list[str]) -> list[list[int]]:
        found = self.model.encode([p[1:] for p in parts], num_threads=1)
        # it puts no space before nothing
        return [ids if p != " " else [self.space] for p, ids in zip(parts, found, strict=True)]


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: visible Latin-1 characters stand for themselves, the other bytes, in
    order, for U+0100 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tokens_of(kind: type, path: str):
    """The tokenizer of a file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = kind(path)
    return _loaded[path]


def pair_bound(path_a: str, path_b: str) -> int:
    """The number of id pairs of which one token's bytes end with the other's."""
    a, b = tokens_of(ByteTokens, path_a).bytes, tokens_of(PieceTokens, path_b).bytes
    ends = lambda x, y: sum(y.get(t[i:], 0) for t in x if t for i in range(len(t)))
    counted = lambda x: {t: n for t, n in zip(*np.unique(np.array(x, object), return_counts=True), strict=True)}
    return int(ends(a, counted(b)) + ends(b, counted(a)))


def parts_of(text: Column) -> Column:
    """The parts of space + text; null for null and empty texts. Each begins with a space."""
    return F.when(F.length(text) > 0, F.split(F.concat(F.lit(" "), text), PART_BREAK))


class Bitset:
    """Marked positions, packed, with ranks by popcount."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bitset:
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[positions] = 1
        return cls(np.packbits(bits, bitorder="little").view("<u8"))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def positions(self) -> np.ndarray:
        """Select of every rank."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many positions up to at, inclusive, are marked."""
        upto = np.uint64(0xFFFF_FFFF_FFFF_FFFF) >> (63 - (at & 63)).astype(np.uint64)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & upto)


def shared_cuts(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens that cover the same bytes: the last bytes of both (select), and the numbers of A's and B's tokens that
    have ended by then (rank)."""
    ends_a, ends_b = np.cumsum(lengths_a) - 1, np.cumsum(lengths_b) - 1
    size = int(ends_a[-1]) + 1 if len(ends_a) else 0
    a, b = Bitset.of(ends_a, size), Bitset.of(ends_b, size)
    cuts = (a & b).positions()
    return cuts, a.rank(cuts), b.rank(cuts)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat that belong to which, one after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(starts[which] - (ends - n), n)]


class Parts:
    """A task's distinct parts with their tokens, cuts and text of groups."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = tokens_of(ByteTokens, path_a), tokens_of(PieceTokens, path_b)
        self.length_a, self.length_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        self.decimals = pa.array([str(i) for i in range(max(len(self.length_a), len(self.length_b)))], pa.large_string())
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.size = self.turn = 0
        none = np.zeros(0, np.int64)
        #: By part: whether its bytes are kept, and the numbers of bytes, tokens of A and B, and groups.
        self.kept, self.n_bytes, self.n_a, self.n_b, self.n_groups = (none.copy() for _ in range(5))
        #: By part: the last batch that had it.
        self.used = none.copy()
        #: One after the other: ids, and of each cut the bytes and tokens up to it, from the part's start.
        self.ids_a, self.ids_b, self.cut_byte, self.cut_a, self.cut_b = (none.copy() for _ in range(5))
        self.text = pa.array([], pa.large_string())

    def codes(self, column: pa.ListArray) -> np.ndarray:
        """The numbers of the parts in a column of lists, which are learnt where they are new."""
        encoded = column.flatten().dictionary_encode()
        parts = encoded.dictionary.to_pylist()
        if len(self.index) > KEPT_PARTS or self.size > KEPT_BYTES:
            self._forget()
        self.turn += 1
        fresh = [p for p in parts if p not in self.index]
        if fresh:
            self._learn(fresh)
        numbers = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        self.used[numbers] = self.turn
        return numbers[encoded.indices.to_numpy(zero_copy_only=False)] if parts else np.zeros(0, np.int64)

    def _forget(self) -> None:
        own = np.flatnonzero(self.used > self.turn - KEPT_TURNS)
        names = list(self.index)
        held = [names[i] for i in own]
        size = sum(len(p.encode()) for p in held)
        if 2 * len(own) > KEPT_PARTS or 2 * size > KEPT_BYTES:
            self.clear()
            return
        for ids, n in (("ids_a", self.n_a), ("ids_b", self.n_b), ("cut_byte", self.n_groups), ("cut_a", self.n_groups), ("cut_b", self.n_groups)):
            setattr(self, ids, _gather(getattr(self, ids), np.cumsum(n) - n, n, own))
        for name in ("kept", "n_bytes", "n_a", "n_b", "n_groups", "used"):
            setattr(self, name, getattr(self, name)[own])
        self.text = self.text.take(pa.array(own))
        self.index, self.size = {p: i for i, p in enumerate(held)}, size

    def _learn(self, fresh: list[str]) -> None:
        for at in range(0, len(fresh), ENCODE_PARTS):
            parts = fresh[at : at + ENCODE_PARTS]
            ids_a, ids_b = self.a.encode(parts), self.b.encode(parts)
            raw = [p.encode() for p in parts]
            known_a, known_b = self.a.bytes, self.b.bytes
            kept = [b"".join([known_a[i] for i in x]) == p and b"".join([known_b[i] for i in y]) == p for p, x, y in zip(raw, ids_a, ids_b, strict=True)]
            if not all(kept):
                ids_a, ids_b = ([x if k else [] for x, k in zip(ids, kept, strict=True)] for ids in (ids_a, ids_b))
            self._add(np.array([len(p) if k else 0 for p, k in zip(raw, kept, strict=True)], np.int64), ids_a, ids_b, np.array(kept, np.int64))
            self.index |= {p: len(self.index) + i for i, p in enumerate(parts)}
            self.size += sum(map(len, raw))

    def _add(self, n_bytes: np.ndarray, ids_a: list[list[int]], ids_b: list[list[int]], kept: np.ndarray) -> None:
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(y), np.int64, n.sum()) for y, n in ((ids_a, n_a), (ids_b, n_b)))
        cuts, upto_a, upto_b = shared_cuts(self.length_a[flat_a], self.length_b[flat_b])
        ends = np.cumsum(n_bytes)
        owner = np.searchsorted(ends, cuts, "right")
        groups = np.bincount(owner, minlength=len(n_bytes))
        told = lambda flat, upto: pc.binary_join(pa.LargeListArray.from_arrays(np.r_[0, upto], self.decimals.take(pa.array(flat))), pa.scalar(",", pa.large_string()))
        each = pc.binary_join_element_wise(told(flat_a, upto_a), told(flat_b, upto_b), pa.scalar("|", pa.large_string()))
        text = pc.binary_join(pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(groups)], each), pa.scalar(";", pa.large_string()))
        self.text = pa.concat_arrays([self.text, text])
        base_a, base_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        self.used = np.concatenate([self.used, np.full(len(n_bytes), self.turn, np.int64)])
        new = (kept, n_bytes, n_a, n_b, groups, flat_a, flat_b, cuts + 1 - (ends - n_bytes)[owner], upto_a - base_a[owner], upto_b - base_b[owner])
        for name, values in zip(("kept", "n_bytes", "n_a", "n_b", "n_groups", "ids_a", "ids_b", "cut_byte", "cut_a", "cut_b"), new, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), values]))


class Aligned:
    """Some documents by the parts that they consist of."""

    def __init__(self, parts: Parts, codes: np.ndarray, numbers: np.ndarray) -> None:
        sums = lambda x: np.add.reduceat(np.r_[x, 0], np.r_[0, np.cumsum(numbers)[:-1]]) * (numbers > 0) if len(numbers) else np.zeros(0, np.int64)
        whole = sums(1 - parts.kept[codes]) == 0
        self.parts, self.codes = parts, codes[np.repeat(whole, numbers)]
        self.numbers = numbers = np.where(whole, numbers, 0)
        self.sums = lambda x: sums(x[self.codes])
        self.n_a, self.n_b, self.n_groups = map(self.sums, (parts.n_a, parts.n_b, parts.n_groups))

    def ids(self, name: str) -> np.ndarray:
        """ids_a or ids_b of all documents."""
        sizes = getattr(self.parts, f"n_{name[-1]}")
        return _gather(getattr(self.parts, name), np.cumsum(sizes) - sizes, sizes, self.codes)

    def cuts(self, name: str) -> np.ndarray:
        """cut_a, cut_b or cut_byte of all groups, from each document's start."""
        sizes = self.parts.n_groups
        own = _gather(getattr(self.parts, name), np.cumsum(sizes) - sizes, sizes, self.codes)
        step = getattr(self.parts, {"cut_a": "n_a", "cut_b": "n_b", "cut_byte": "n_bytes"}[name])[self.codes]
        before = np.cumsum(step) - step
        first = np.r_[0, np.cumsum(self.numbers)[:-1]]
        start = np.repeat(np.r_[before, 0][np.minimum(first, len(before))], self.numbers)
        return own + np.repeat(before - start, sizes[self.codes])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the two tokens that end at each cut."""
        found = []
        for ids, upto, n in (("ids_a", "cut_a", self.n_a), ("ids_b", "cut_b", self.n_b)):
            last = self.cuts(upto) + np.repeat(np.cumsum(n) - n, self.n_groups) - 1
            found.append(self.ids(ids)[last])
        return found[0], found[1]

    def digests(self) -> list[str]:
        """SHA-256 of the groups as text; '' without tokens."""
        texts = self.parts.text.take(pa.array(self.codes))
        offsets = np.r_[0, np.cumsum(self.numbers)]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, texts), pa.scalar(";", pa.large_string()))
        return [hashlib.sha256(t.as_buffer()).hexdigest() if n else "" for t, n in zip(joined, self.numbers.tolist(), strict=True)]


def lists(values: np.ndarray, numbers: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(numbers)], pa.int32()), pa.array(values, pa.int32()))


def align(docs: DataFrame, path_a: str, path_b: str, render: Callable[[Aligned], list], schema: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and those of schema, which render makes of some documents at a time, for every row of docs(text)."""
    fields = [docs.schema[c] for c in docs.columns if c in carry]
    names = [f.name for f in fields]
    added = [f.split()[0] for f in schema.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = Parts(path_a, path_b)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_parts"))
            numbers = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            done = Aligned(parts, parts.codes(column), numbers)
            carried = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*carried, *map(pa.array, render(done))], [*names, *added])
        parts.clear()
        give_back()

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [schema])
    whole_texts(docs)
    return docs.select(*names, parts_of(F.col("text")).alias("_parts")).mapInArrow(run, out).select(*carry, *added)


def token_groups(docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns; ids_a and ids_b; and of each group, in order, the numbers of A's and B's tokens and of bytes up to its
    end: cut_a, cut_b, cut_byte."""
    return align(
        docs, path_a, path_b,
        lambda d: [lists(d.ids("ids_a"), d.n_a), lists(d.ids("ids_b"), d.n_b), *[lists(d.cuts(c), d.n_groups) for c in ("cut_a", "cut_b", "cut_byte")]],
        "ids_a array<int>, ids_b array<int>, cut_a array<int>, cut_b array<int>, cut_byte array<int>", carry,
    )


def linked(docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, n_a, n_b, n_groups, groups_sha256, and the links' ids: link_a, link_b."""

    def render(d: Aligned) -> list:
        a, b = d.links()
        return [d.n_a, d.n_b, d.n_groups, pa.array(d.digests(), pa.string()), lists(a, d.n_groups), lists(b, d.n_groups)]

    return align(docs, path_a, path_b, render, "n_a long, n_b long, n_groups long, groups_sha256 string, link_a array<int>, link_b array<int>", carry)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold each pair."""
    pairs = links.select(F.explode(F.arrays_zip("link_a", "link_b")).alias("p"))
    return pairs.select(F.col("p.link_a").alias("a"), F.col("p.link_b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def with_counts(links: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """links, with n_links, n_best and count_sum in place of link_a and link_b. counts has no more than `most` rows."""
    table = counts.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise RuntimeError(f"{table.num_rows} id pairs; the vocabularies allow {most}")
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    keys = (a << 32) | b
    order = np.argsort(keys)
    highest = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
    np.maximum.at(highest, b, n)
    shared = links.sparkSession.sparkContext.broadcast((keys[order], n[order], (n == highest[b])[order]))
    names = [c for c in links.columns if c not in ("link_a", "link_b")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("link_a", "link_b"))
            numbers = pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
            own = (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy()
            at = np.searchsorted(keys, own)
            sums = lambda x: np.diff(np.r_[0, np.cumsum(x[at], dtype=np.int64)][np.r_[0, np.cumsum(numbers)]]) if len(at) else np.zeros(len(numbers), np.int64)
            columns = [pa.array(numbers), pa.array(sums(best)), pa.array(sums(n))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], *columns], [*names, "n_links", "n_best", "count_sum"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema if f.name in names)
    return links.mapInArrow(run, f"{kept}, n_links long, n_best long, count_sum long")


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum of every row."""
    links = cut(linked(docs, path_a, path_b, carry), "token-links")
    return with_counts(links, pair_counts(links), pair_bound(path_a, path_b))
