"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

1. Spark splits texts into words at ASCII white space. No rule of the vocabulary reaches across white space (its
   normaliser composes nothing with it, its pattern never matches it, no special token has it), so the ids of a text
   are those of its words one after the other. A word's own ids come from the tokenizer with all its rules.
2. Blocks of documents (up to BLOCK_WORDS words each) keep a list of their distinct words and, for each document, the
   positions of its words in that list. A block is named by a hash of its content. Lists and positions travel packed.
3. A list is cut by a hash of the words into buckets, whose number follows the input's size. A bucket's task gets its
   part of every list, encodes each distinct word once, and sends the ids back to the blocks in the order of their parts.
   A word stands once in a block's list, however frequent it is.
4. Each block's ids and then its documents stream past one task, sorted by block; it holds one block's ids at a time and
   puts documents together by position.

Documents and lists come from two passes over the input, which must give the same rows in the same order, as a table
in files does; if a block's list is missing or has another size the job fails and says so.

Decoding joins the ids of each document with the id-to-piece table (the vocabulary, of a size fixed by its file, so it
is broadcast) and puts the pieces together in the order of the ids.

Defined results: null text is empty: no ids, decoded ""; repeated rows are encoded alike; ids outside the vocabulary
decode to nothing; an empty table gives no rows; columns other than those carried are dropped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.session import give_back, whole_texts

BLOCK_WORDS = 1_500_000
#: Documents of a block travel in slices of about so many words.
SLICE_WORDS = 1 << 16
#: Words that the tokenizer gets at once: its results take far more memory than their ids.
ENCODE_WORDS = 4_096
#: A bucket's packed words, about: lists take about a fifth of the input.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
#: Ids that are rendered at once.
RENDER_IDS = 1 << 20

WORD_BREAK = "[\\x20\\x09-\\x0D]+"

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    """The tokenizer of a vocabulary file, loaded once in each worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def piece_table(path: str) -> list[str]:
    """Pieces by id, special tokens included, with "" for unused ids."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    ids = {i: piece for piece, i in data["model"]["vocab"].items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
    return [ids.get(i, "") for i in range(max(ids) + 1)]


def words_of(text: Column) -> Column:
    """The words; an empty one stands where a text begins or ends with white space, and has no ids."""
    return F.split(F.coalesce(text, F.lit("")), WORD_BREAK)


def bucket_count(docs: DataFrame) -> int:
    """By the optimizer's estimate of the input's size; any number gives the same results."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(LEAST_BUCKETS, size // (5 * BUCKET_BYTES)), 1 << 20))


def _planes(numbers: np.ndarray) -> bytes:
    """Four planes of bytes, which compress better than whole numbers."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def _packed(head: list[int], *parts: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<i8").tobytes() + b"".join(parts))


def _unpacked(data: bytes, heads: int) -> tuple[list[int], memoryview]:
    import zstandard

    body = memoryview(zstandard.ZstdDecompressor().decompress(data))
    return np.frombuffer(body, "<i8", heads).tolist(), body[8 * heads :]


class _Block:
    """The distinct words of some batches of (carry, _words), in an order in which frequent words come first and equally
    frequent ones stand by bucket and name, and the documents' positions in it."""

    def __init__(self, held: list[pa.RecordBatch], carry: tuple[str, ...], buckets: int) -> None:
        columns = [b.column(b.schema.get_field_index("_words")) for b in held]
        self.lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in columns])
        flat = pa.concat_arrays([x.flatten() for x in columns]).dictionary_encode()
        codes, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        counts = np.bincount(codes, minlength=len(words))
        self.bucket_of = np.fromiter((xxhash.xxh64_intdigest(w or "") % buckets for w in words.to_pylist()), np.int64, len(words))
        table = pa.table({"c": pa.array(-counts), "b": pa.array(self.bucket_of), "w": words})
        order = pc.sort_indices(table, [("c", "ascending"), ("b", "ascending"), ("w", "ascending")])
        self.words = words.take(order)
        order = order.to_numpy()
        self.bucket_of = self.bucket_of[order]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        self.codes = rank[codes]
        content = xxhash.xxh64(self.codes.tobytes())
        for buffer in (self.lengths.tobytes(), *self.words.buffers()[1:]):
            content.update(b"" if buffer is None else buffer)
        self.name = int(np.uint64(content.intdigest()).view(np.int64))
        names = held[0].schema.names
        self.carried = pa.Table.from_batches(held).select([c for c in names if c in carry]).combine_chunks()

    def lists(self) -> tuple[list[int], list[bytes]]:
        """Buckets, and their words with the steps from position to position."""
        by_bucket = np.argsort(self.bucket_of, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(self.bucket_of[by_bucket]) != 0, True])
        buckets, data = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = by_bucket[a:b]
            words = "\n".join(self.words.take(pa.array(own)).to_pylist())
            buckets.append(int(self.bucket_of[own[0]]))
            data.append(_packed([len(own)], _planes(np.diff(own, prepend=0)), words.encode()))
        return buckets, data

    def slices(self) -> list[bytes]:
        """The documents: the size of the list, the carried columns, the numbers of words, and the positions."""
        ends = np.cumsum(self.lengths)
        out, a = [], 0
        while a < len(ends):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + SLICE_WORDS, "right")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.carried.schema) as writer:
                writer.write_table(self.carried.slice(a, b - a))
            carried, codes = sink.getvalue().to_pybytes(), self.codes[done : ends[b - 1]]
            head = [len(self.words), b - a, len(codes), len(carried)]
            out.append(_packed(head, carried, _planes(self.lengths[a:b]), _planes(codes)))
            a = b
        return out


def blocks_of(words: DataFrame, carry: tuple[str, ...], lists: bool, block_words: int, buckets: int) -> DataFrame:
    """(block, part, data): the word lists of blocks of words(carry, _words), a row for each bucket; or their documents, a
    row for each slice, with part -1."""

    def rows(block: _Block) -> pa.RecordBatch:
        parts, data = block.lists() if lists else (None, block.slices())
        parts = [-1] * len(data) if parts is None else parts
        return pa.RecordBatch.from_arrays([pa.array([block.name] * len(data), pa.int64()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["block", "part", "data"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            # one block never spans more than block_words words, unless a single document does
            lengths = np.diff(batch.column(batch.schema.get_field_index("_words")).offsets.to_numpy())
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > block_words:
                    held.append(batch.slice(start, i - start))
                    yield from build(held)
                    held, size, start = [], 0, i
                size += n
            held.append(batch.slice(start))
        yield from build(held)

    def build(held):
        held = [b for b in held if b.num_rows]
        if held:
            yield rows(_Block(held, carry, buckets))
            held.clear()
            give_back()

    return words.mapInArrow(pack, "block long, part long, data binary")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Buffer]]:
    block, part, data = batch.columns
    for i in range(batch.num_rows):
        yield block[i].as_py(), part[i].as_py(), data[i].as_buffer()


def encode_lists(lists: DataFrame, path: str) -> DataFrame:
    """lists(block, part, data) -> the same rows with ids in place of words. A bucket's rows stand together, and each of
    its distinct words is encoded once."""
    dealt = lists.repartition("part").sortWithinPartitions("part")

    def run(batches):
        tokenizer, current, known = _tokenizer(path), None, {}
        for batch in batches:
            blocks, data = [], []
            for block, part, body in _rows(batch):
                if part != current:
                    current, known = part, {}
                (n,), rest = _unpacked(body, 1)
                steps, words = bytes(rest[: 4 * n]), bytes(rest[4 * n :]).decode().split("\n")
                fresh = [w for w in words if w not in known]
                for at in range(0, len(fresh), ENCODE_WORDS):
                    some = fresh[at : at + ENCODE_WORDS]
                    for w, e in zip(some, tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.int64, n) // 4
                ids = np.frombuffer(b"".join(found), "<u4")
                blocks.append(block)
                data.append(_packed([n, len(ids)], steps, _planes(sizes), _planes(ids)))
                if len(data) >= 256:
                    yield _list_batch(blocks, data)
                    blocks, data = [], []
            if data:
                yield _list_batch(blocks, data)
        known.clear()
        give_back()

    return dealt.mapInArrow(run, "block long, part long, data binary")


def _list_batch(blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([-2] * len(data), pa.int64()), pa.array(data, pa.binary())], ["block", "part", "data"])


class _Ids:
    """The ids of a block's words: all of them, and each word's start and number."""

    def __init__(self, data: list[bytes], listed: int) -> None:
        at, sizes, ids = [], [], []
        for x in data:
            (n, total), body = _unpacked(x, 2)
            at.append(np.cumsum(_from_planes(body, n)))
            sizes.append(_from_planes(body[4 * n :], n))
            ids.append(_from_planes(body[8 * n :], total).astype(np.int32))
        at, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, sizes))
        starts = np.cumsum(sizes) - sizes
        where, first = np.unique(at, return_index=True)  # equal blocks have equal lists
        if len(where) != listed:
            raise RuntimeError("a block's word list differs between two passes over the input: write the input as a table first")
        self.flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.starts, self.sizes = starts[first], sizes[first]

    def of(self, codes: np.ndarray) -> np.ndarray:
        n = self.sizes[codes]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.starts[codes] - (ends - n), n)]


def encode(docs: DataFrame, path: str, finish: Callable[[], Callable], schema: str, carry: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """carry columns and those of schema for every row of docs(text, carry). finish() is called in each task; what it
    returns gets the ids of some documents, one after the other, and their numbers, and returns the columns."""
    fields = [docs.schema[c] for c in docs.columns if c in carry]
    names = [f.name for f in fields]
    words = whole_texts(docs).select(*names, words_of(F.col("text")).alias("_words"))
    buckets = bucket_count(docs)
    documents = blocks_of(words, carry, False, block_words, buckets)
    lists = encode_lists(blocks_of(words, carry, True, block_words, buckets), path)
    # a block's lists (part -2) come before its documents (part -1)
    met = documents.unionByName(lists).repartition("block").sortWithinPartitions("block", "part")
    added = [f.split()[0] for f in schema.split(", ")]

    def put_together(batches) -> Iterator[pa.RecordBatch]:
        render, current, parts, ids = finish(), None, [], None
        for batch in batches:
            for block, part, data in _rows(batch):
                if block != current:
                    current, parts, ids = block, [], None
                if part == -2:
                    parts.append(data)
                    continue
                (listed, rows, total, size), body = _unpacked(data, 4)
                if ids is None:
                    ids, parts = _Ids(parts, listed), []
                carried = pa.ipc.open_stream(pa.py_buffer(body[:size])).read_all().combine_chunks()
                lengths = _from_planes(body[size:], rows)
                codes = _from_planes(body[size + 4 * rows :], total)
                numbers = np.add.reduceat(np.r_[ids.sizes[codes], 0], np.r_[0, np.cumsum(lengths)[:-1]]) * (lengths > 0)
                columns = render(ids.of(codes), numbers)
                for out in pa.table([*carried.columns, *columns], names=[*names, *added]).to_batches():
                    yield out
        ids, parts, render = None, [], None
        give_back()

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + schema
    found = met.mapInArrow(put_together, out)
    return found.select(*carry, *added)


class Decoder:
    """Ids -> texts as the tokenizers library decodes without a decoder of its own: the pieces joined by single blanks."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pa.array(pieces, pa.large_string())

    def __call__(self, flat: np.ndarray, numbers: np.ndarray) -> pa.Array:
        """flat has the ids of some documents one after the other, numbers of them each."""
        known = (flat >= 0) & (flat < len(self.pieces))
        if not known.all():
            owner = np.repeat(np.arange(len(numbers)), numbers)
            flat, numbers = flat[known], np.bincount(owner[known], minlength=len(numbers))
        offsets = pa.array(np.r_[0, np.cumsum(numbers)], pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.pieces.take(pa.array(flat))), pa.scalar(" ", pa.large_string()))


def _portions(numbers: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of documents of about `most` ids, and of their ids."""
    ends = np.cumsum(numbers)
    a = 0
    while a < len(ends):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield a, b, done, int(ends[b - 1])
        a = b


def _sha256(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]


def encode_digests(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """carry columns, n_tokens, ids_sha256, decoded_sha256 of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(piece_table(path))

    def finish():
        pieces = Decoder(shared.value)
        decimals = Decoder([str(i) for i in range(len(shared.value))])

        def digests(flat, numbers):
            told, decoded = [], []
            for a, b, first, end in _portions(numbers, RENDER_IDS):
                told += _sha256(decimals(flat[first:end], numbers[a:b]))
                decoded += _sha256(pieces(flat[first:end], numbers[a:b]))
            return pa.array(numbers, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())

        return digests

    return encode(docs, path, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", carry, block_words)


def encode_ids(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """carry columns and ids (array<int>) of every row."""

    def finish():
        return lambda flat, numbers: (pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(numbers)], pa.int32()), pa.array(flat, pa.int32())),)

    return encode(docs, path, finish, "ids array<int>", carry, block_words)


def decode_ids(encoded: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and text from encoded(ids): each document's ids joined with the broadcast id-to-piece table."""
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(path))
    fields = [encoded.schema[c] for c in carry]

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            numbers = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
            texts = [decoder(flat[first:end], numbers[a:b]) for a, b, first, end in _portions(numbers, RENDER_IDS)]
            text = pa.concat_arrays(texts).cast(pa.string()) if texts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carry], text], [*carry, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"
    return whole_texts(encoded).select(*carry, "ids").mapInArrow(run, schema)
