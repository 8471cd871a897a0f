"""Token alignment against both tokenizers' own whole-text encodings and a set of offsets."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tests.llm.test_edges import LONG, no_docs, odd_docs
from tracework.llm import align
from tracework.llm import queries as Q

A, B = Q.vocabulary("byte_bpe_50k.json"), Q.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """(text) -> ids of A, ids of B, groups as (A's ids, B's ids), the cuts' bytes; with the libraries over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a.no_truncation()
    bytes_a, bytes_b = align.ByteTokens(A).bytes, align.PieceTokens(B).bytes

    def of(text):
        raw = (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or any(b"".join(t[i] for i in ids) != raw for t, ids in ((bytes_a, x), (bytes_b, y))):
            return [], [], [], []
        ends = [dict(zip(np.cumsum([len(t[i]) for i in ids]).tolist(), range(1, len(ids) + 1))) for t, ids in ((bytes_a, x), (bytes_b, y))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        at = [(0, 0)] + [(ends[0][c], ends[1][c]) for c in cuts]
        return x, y, [(x[i:k], y[j:m]) for (i, j), (k, m) in zip(at, at[1:])], cuts

    return of


def by_definition(rows, whole):
    """The digests' columns of (doc_id, text) rows."""
    found = [(d, *whole(t)) for d, t in rows]
    counts = collections.Counter((g[0][-1], g[1][-1]) for _, _, _, groups, _ in found for g in groups)
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for d, x, y, groups, _ in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((d, len(x), len(y), len(groups), hashlib.sha256(told.encode()).hexdigest() if groups else "", len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links)))
    return sorted(out, key=str)


def digests(docs):
    return sorted(map(tuple, align.alignment_digests(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum").collect()), key=str)


def test_the_tables(spark, sf, whole):
    from tracework.session import table

    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = Q.QUERIES["op13_tokenizer_alignment"](spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")
    assert sorted(map(tuple, got.collect()), key=str) == by_definition(rows, whole)


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_odd_tables(spark, whole, make):
    docs = make(spark)
    assert digests(docs) == by_definition([(r.doc_id, r.text) for r in docs.collect()], whole)


def test_random_texts(spark, whole):
    """White space of every kind, marks, digits, special tokens, U+2581, other scripts, runs without a space."""
    draw = random.Random(3)
    bits = [" ", "  ", "\t", "\n", "\r\n", " ", " ", "　", "\x1c", "\x85", "\x00", "​", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", "'ll", "a", "the", "Über", "é", "ﬁ", "日本語", "한국어", "😀", "👩‍👩‍👧", "12345", "3.14", "...", "#*$%", "İ", "ǅ", "\U0010fffd"]
    rows = [(i, "".join(draw.choice(bits) + draw.choice(["", "", " "]) for _ in range(draw.randrange(1, 40)))) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(docs) == by_definition(rows, whole)


def test_long_texts_and_small_tables(spark, whole, monkeypatch):
    """Texts of megabytes, with and without spaces; a table of parts that starts anew all the time gives the same rows."""
    rows = [(1, LONG * 20), (2, "x" * 200_000), (3, "日本" * 50_000 + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(docs) == by_definition(rows, whole)
    parts = align.Parts(A, B)
    import pyarrow as pa

    monkeypatch.setattr(align, "KEPT_PARTS", 3)
    for text in ("one two three four", "three five"):
        column = pa.array([[" one", " two", " three"], [" " + w for w in text.split()], None])
        done = align.Aligned(parts, parts.codes(column), np.array([3, len(text.split()), 0]))
        assert [n > 0 for n in done.n_a] == [True, True, False]


def test_groups_and_links(spark, whole):
    """The operator's own output: ids, and where each group ends in tokens and bytes."""
    texts = ["an über-token, isn't it?", None, "a▁b", "日本語 and 12345 tokens", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in align.token_groups(docs, A, B).collect():
        x, y, groups, cuts = whole(texts[r.doc_id])
        assert (r.ids_a, r.ids_b, r.cut_byte) == (x, y, cuts)
        at = [(0, 0), *zip(r.cut_a, r.cut_b)]
        assert [(x[i:k], y[j:m]) for (i, j), (k, m) in zip(at, at[1:])] == groups


def test_bitsets():
    draw = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1_000):
        marks = [np.flatnonzero(draw.random(size) < 0.4) for _ in range(2)]
        a, b = (align.Bitset.of(m, size) for m in marks)
        assert (a & b).positions().tolist() == sorted(set(marks[0]) & set(marks[1]))
        at = np.arange(size)
        assert a.rank(at).tolist() == [int((marks[0] <= i).sum()) for i in at]


def test_pairs_are_bounded_by_the_vocabularies(spark, sf):
    from tracework.session import table

    links = align.linked(table(spark, sf, "documents"), A, B).cache()
    tokens_a, tokens_b = align.ByteTokens(A).bytes, align.PieceTokens(B).bytes
    pairs = align.pair_counts(links).collect()
    assert all(tokens_a[p.a].endswith(tokens_b[p.b]) or tokens_b[p.b].endswith(tokens_a[p.a]) for p in pairs)
    assert len(pairs) <= align.pair_bound(A, B) < 400_000
    with pytest.raises(RuntimeError):
        align.with_counts(links, align.pair_counts(links), 10)
