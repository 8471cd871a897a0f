"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; and the methods by themselves."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracework.llm import bpe, chat, decontam, linedup, neardup, pii, quality, sharding, toxicity, urlfilter
from tracework.llm.queries import ADDED_TURNS, URL_RULES, vocabulary
from tracework.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size int, fp string, list string, _d int"
LONG = "lorem ipsum dolor " * 4_000


def odd_docs(spark):
    texts = [None, "", " \n\t", "a", "word " * 60, LONG, "é" * 10, "line one two\n\nline one two", "same text here now", "same text here now", "<|endoftext|> it's ½ İ ǅ é 日本\x1c x", "~0 <| \\"]
    rows = [(i, t, None, None, None, 0.5, True, 1, "x", "y", 2) for i, t in enumerate(texts)]
    rows += [(None, "same text here now", "en", "s", 1, None, None, None, None, None, None), rows[4], rows[4], (7, "another text for the same id", "", "", 0, 0.0, False, 0, "", "", 0)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((0, None, None), (4, 1, 0), (5, 0, 1), (None, 1, 1), (4, 1, 0))):
    return spark.createDataFrame(list(rows), LABELS)


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_operators_take_odd_tables(spark, make):
    docs = make(spark)
    n = docs.count()
    bench = spark.createDataFrame([(1, "same text here now"), (2, None), (3, ""), (None, "a"), (1, "same text here now")], "item_id long, text string")
    assert sharding.shard_documents(docs, sharding.even_tree(3, 2, 4)).count() == n
    assert bpe.encode_digests(docs, vocabulary()).count() == n
    assert neardup.near_duplicates(docs).count() == n
    assert quality.quality_rules(docs, labels(spark)).count() == n
    assert toxicity.toxicity(docs, labels(spark)).count() == n
    assert linedup.dedup_lines(docs).columns == docs.columns and linedup.dedup_lines(docs).count() == n
    assert pii.find_personal_data(docs).count() == n
    leaks = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert leaks == ({(8, 1), (9, 1), (None, 1)} if n else set())
    assert decontam.leaks(docs, bench.where("false")).count() == 0


def test_values_of_odd_rows(spark):
    """Nulls, empties, ties and repeated rows have the results that the docstrings state."""
    import hashlib
    import zlib

    from tokenizers import Tokenizer

    docs, tok = odd_docs(spark), Tokenizer.from_file(vocabulary())
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    same = lambda got, want: sorted(map(tuple, got), key=key) == sorted(want, key=key)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    placed = sharding.shard_documents(docs, sharding.even_tree(3, 2, 4))
    assert same(placed.select("doc_id", "size", "text_crc32").collect(), [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows])
    slots = {}
    for r in placed.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    told = [(d, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for (d, _), x in zip(rows, ids, strict=True)]
    assert same(bpe.encode_digests(docs, vocabulary()).collect(), told)
    prints = neardup.near_duplicates(docs).collect()
    assert {r["fp"] for r in prints if r["doc_id"] in (0, 1, 2)} == {0} and {r["component_id"] for r in prints if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component_id"] for r in prints if r["doc_id"] in (8, 9, None)} == {8}
    judged = quality.quality_rules(docs, labels(spark)).collect()
    assert same([(r["doc_id"], r["n_words"], r["base_failed"]) for r in judged], [(d, len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", t or "") if w]), len((t or "").split()) < 50 or len(set((t or "").split())) < 5) for d, t in rows])
    assert len({(r["kept"], r["score"]) for r in judged if r["doc_id"] == 4}) == 1
    toxic = toxicity.toxicity(docs, labels(spark)).collect()
    assert len({r["score"] for r in toxic if r["doc_id"] in (0, 1)}) == 1 and all(0 <= r["score"] <= 1 for r in toxic)
    assert len({r["score"] for r in toxic if r["doc_id"] == 4}) == 1 and all(not r["held_out"] for r in toxic if r["doc_id"] is None)
    private = pii.find_personal_data(docs).collect()
    assert all((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) == (0, 0, 0, 0, sha(""), "") for r in private if r["doc_id"] in (0, 1, 2, 3))
    kept = linedup.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in kept}[0] is None and sorted(r["text"] for r in kept if r["doc_id"] == 7) == sorted(t for d, t in rows if d == 7)


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_stages_take_odd_tables(spark, sf, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.collect()


def test_other_tables_may_be_odd(spark):
    pages = spark.createDataFrame([(1, None, ""), (2, "no scheme", ""), (3, "://", ""), (4, "http://X.COM/en/?q", ""), (4, "http://X.COM/en/?q", ""), (None, "http://" + "a." * 3000 + "net/es/x", "")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("x.com",), (None,)], "key string")
    got = urlfilter.judge_urls(pages, URL_RULES, listed).collect()
    assert len(got) == 6 and {r["page_id"]: r["verdict"] for r in got} == {1: "allow", 2: "allow", 3: "allow", 4: "allow", None: "block"}
    assert urlfilter.judge_urls(pages.where("false"), URL_RULES, listed.where("false")).count() == 0
    rows = [(None, 0, None, None), (1, None, "user", "x"), (1, 1, "assistant", "~1 <|end|>"), (1, 1, "assistant", "~1 <|end|>"), (2, 5, "system", "s"), (2, 6, "assistant", LONG)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(talk)).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {None: 1, 1: 3, 2: 2} and got[1]["loss_chars"] == 20 and got[2]["loss_chars"] == len(LONG)
    assert chat.digests(chat.windows(talk.where("false"))).count() == 0


def test_encoding_of_odd_texts_and_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    docs = odd_docs(spark).where("doc_id IS NOT NULL AND doc_id NOT IN (4, 7)")
    encoded = bpe.encode_ids(docs, vocabulary(), block_words=50)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, vocabulary()).collect()}
    for r in docs.collect():
        want = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert ids[r["doc_id"]] == want
        assert decoded[r["doc_id"]] == tok.decode(want, skip_special_tokens=False)


def test_encoding_of_random_texts(spark):
    """Letters of many scripts, marks that compose, all kinds of white space and special tokens, in any order."""
    from tokenizers import Tokenizer

    rng, tok = random.Random(17), Tokenizer.from_file(vocabulary())
    parts = ["a", "B", "'s", "'LL", "é", "e\u0301", "\u0301", "İ", "ǅ", "ß", "日", "本", "한", "\u1112\u1161", "ﬁ", "½", "٣", "7", "42", "<", "\u0338", "=", ".", ",,", "!?", "_", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|", "😀",
             " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff", "Σ", "ς", "Ω", "\u212b", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_ids(frame, vocabulary(), block_words=200).collect()}
    assert [got[i] for i in range(len(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_tree_moves_rows_only_into_changed_subtrees(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = sharding.even_tree(3, 2, 4)
    heavier = [[list(rack) for rack in region] for region in tree]
    heavier[1][0][2] = (10, 3.0)
    a = ids.select("doc_id", sharding.descend(F.col("doc_id").cast("string"), tree).alias("a"), sharding.descend(F.col("doc_id").cast("string"), heavier).alias("b"), sharding.descend(F.col("doc_id").cast("string"), sharding.grow(sharding.grow(tree))).alias("c"))
    moved = a.where("a <> b").collect()
    assert moved and all(r["b"] // 8 == 1 for r in moved)  # only within or into the region whose weight changed
    assert all(r["c"] in (r["a"], 24, 25) for r in a.collect())
    sizes = {r["a"]: r["count"] for r in a.groupBy("a").count().collect()}
    assert len(sizes) == 24 and min(sizes.values()) > 100 and max(sizes.values()) < 240


@pytest.mark.parametrize("max_bytes", [64 << 20, 64])
def test_cascade_is_exact(spark, max_bytes):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    cascade = urlfilter.build_cascade(universe, listed, max_bytes)
    assert len(cascade.segments) == 1 or max_bytes == 64
    flagged = urlfilter.flag_listed(universe.withColumn("keys", F.array("key")), cascade)
    assert {r["key"] for r in flagged.where("listed[0]").collect()} == {f"k{7 * i}" for i in range(300)}


def test_bk_trees_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)]
    values = sorted({*base, *near, 0, 1, 3, 7, (1 << 64) - 1})
    tree = neardup.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(values[i] for i in tree.within(v, 2)) == [x for x in values if (x ^ v).bit_count() <= 2]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")

    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = _components(signed, pairs)
    for large in (neardup.LARGE_SHARD, 1):
        links = [(r["a"], r["b"]) for r in neardup.fingerprint_links(frame, large=large).collect()]
        assert _components(signed, links) == want
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in links)


def _components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def test_myers_against_dynamic_programming():
    rng = random.Random(5)

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(200):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abc", k=rng.randint(0, 30)))
        assert decontam.Myers(p).least(t) == least(p, t)


def test_edited_items_are_found_and_others_are_not():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(20)]
    matcher = decontam.Matcher([([i], text) for i, text in items])
    for i, text in items:
        k = decontam.budget_of(decontam.normalised(text))
        edited = list(text)
        for _ in range(k):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], ["z"], [edited[at], "z"]])
        doc = " ".join(rng.choices(words, k=100)) + " " + "".join(edited) + "\n" + " ".join(rng.choices(words, k=100))
        assert i in matcher.hits(doc.upper())
    assert not matcher.hits(" ".join(rng.choices(words, k=3000)))
    long = " ".join(rng.choices(words, k=1000))  # an item of any length is one, found within its budget only
    matcher = decontam.Matcher([([7, 8], long), ([9], "x")])
    assert matcher.hits("ab " + long.replace("a", "A") + " y") == {7: 0, 8: 0}
    edited = list(long)
    for at in rng.sample(range(len(long)), decontam.budget_of(long) - 5):
        edited[at] = "#"
    assert matcher.hits("ab " + "".join(edited)) == {7: matcher.hits("".join(edited))[7], 8: matcher.hits("".join(edited))[7]}
    assert not matcher.hits("ab " + long[: len(long) * 9 // 10] + " y")


def test_line_dedup_by_definition(spark):
    from test_contracts import deleted_lines

    rng = random.Random(4)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.9 else rng.choice(["", f"own {i}"]) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    passage = "\n".join(f"passage {i} of many words here" for i in range(10))
    docs += [(100, "a\n" + passage + "\nb"), (101, passage), (102, "c\n" + passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (8, 50):
        got = {r["_d"]: list(r["lines"]) for r in linedup.later_copies(frame, least).collect()}
        assert got == deleted_lines(docs, least)
    kept = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(frame).collect()}
    assert kept[100] == "a\n" + passage + "\nb" and kept[101] == "" and kept[102] == "c"


def test_field_on_held_out_sentences():
    field = pii.train()
    assert field.plain_margin() > 0
    good = total = 0
    for sentence in pii.labelled_table(150, seed=99):
        tokens = [t for t, _ in sentence]
        path = pii.viterbi(field, [field.scores(tokens)])[0]
        total += len(tokens)
        good += sum(pii.LABELS[p] == label for p, (_, label) in zip(path, sentence, strict=True))
        cut = ["O"] * len(tokens)
        for a, b in pii.stretches(tokens):
            lo = max(0, a - 1)
            for i, p in enumerate(pii.viterbi(field, [field.scores(tokens[lo : b + 1])[a - lo :][: b - a]])[0]):
                cut[a + i] = pii.LABELS[p]
        assert cut == [pii.LABELS[p] for p in path]
    assert good / total > 0.97


def test_emails_as_the_pattern_has_them():
    import re

    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choices("ab1.@-_% ", k=40))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert pii.emails(text) == want


def test_pairs_of_terms_matter():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 6)) < 0.5).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(float)  # toxic only together
    machine = toxicity.fit(np.nonzero(x)[1], x.sum(1).astype(np.int64), y, np.ones(600), factors=4, rounds=400)
    x, bias, w, v = x[:, machine.numbers], machine.bias, machine.weights, machine.factors
    sums = x @ v
    score = bias + x @ w + 0.5 * ((sums**2).sum(1) - (x @ (v**2).sum(1)))
    assert ((score > 0) == (y == 1)).mean() > 0.97


def test_gradients_over_slices_and_over_inputs_that_live(monkeypatch):
    """Sums by row and by column equal those of a dense matrix, whatever the slices and the columns that count."""
    rng = np.random.default_rng(4)
    x = (rng.random((90, 40)) < 0.2).astype(np.float32)
    x[7] = x[60] = 0
    flat, sizes, params = np.nonzero(x)[1], x.sum(1).astype(np.int64), rng.normal(size=(40, 5)).astype(np.float32)
    told = rng.normal(size=(90, 5)).astype(np.float32)
    for most, kept in ((1_024, None), (7, None), (16, rng.random(40) < 0.3), (16, np.zeros(40, bool))):
        monkeypatch.setattr(toxicity, "SLICE_ROWS", most)
        dense = x if kept is None else x * kept
        back = np.zeros((40, 5), np.float32)
        for part in toxicity._slices(flat, sizes, kept):
            sums = part.sums(params)
            assert np.allclose(sums[:, :-1], dense[part.rows] @ params, atol=1e-4) and np.allclose(sums[:, -1], dense[part.rows] @ (params[:, 1:] ** 2).sum(1), atol=1e-4)
            part.back(told[part.rows], back)
        assert np.allclose(back, dense.T @ told, atol=1e-4)


def test_scores_are_the_double_sum(spark, sf):
    """Every document's score, recomputed from the machine by the plain sum over all pairs of its terms."""
    docs, told = table(spark, sf, "documents").limit(120), table(spark, sf, "labels")
    machine = toxicity.train(table(spark, sf, "documents"), told)
    at = {int(n): i for i, n in enumerate(machine.numbers)}
    assert len(at) > 20
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, machine).collect()}
    for r in docs.collect():
        own = [at[t] for t in sorted(toxicity.terms(r["text"])) if t in at]
        total = machine.bias + sum(machine.weights[i] for i in own) + sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(own) for j in own[:k])
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9


def recall_and_precision(got, truth):
    hits = sum(got[i] and truth[i] for i in truth)
    return hits / max(1, sum(truth.values())), hits / max(1, sum(got[i] for i in truth))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: bool(r["toxic"]) for r in table(spark, sf, "labels").where("toxic IS NOT NULL").collect()}
    got = {r["doc_id"]: bool(r["predicted"]) for r in toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").collect()}
    recall, precision = recall_and_precision(got, {i: t for i, t in truth.items() if i in got})
    assert recall >= 0.9 and precision >= 0.9


def test_terms_that_are_toxic_only_together(spark):
    """Neither of two words tells the classes apart, and neither would be an input by itself among so many better ones."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnprst"]
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 4 == 0
        pair = ["group", "insult"] if toxic else [[], ["group"], ["insult"]][i % 3]
        said = rng.sample(words, 25) + pair
        rng.shuffle(said)
        rows.append((i, " ".join(said)))
        labels.append((i, None, int(toxic)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: bool(r["predicted"]) for r in toxicity.toxicity(docs, told).where("held_out").collect()}
    recall, precision = recall_and_precision(got, {i: i % 4 == 0 for i in got})
    assert recall >= 0.9 and precision >= 0.9
    few = toxicity.train(docs, told)  # among all terms the pair stays
    assert {toxicity._number("w group"), toxicity._number("w insult")} <= set(few.numbers.tolist())


def test_repeated_labels_and_ids_count_once(spark):
    docs = spark.createDataFrame([(i % 40, f"word{i % 40} {'scum' if i % 40 < 8 else 'fine'}") for i in range(4000)], "doc_id long, text string")
    told = spark.createDataFrame([(i % 40, None, int(i % 40 < 8)) for i in range(2000)], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, told).collect()}
    assert got == {i: int(i < 8) for i in range(40)}


def _windows(rows):
    """(conversation, block, window) -> [(role, bytes of the turn as written, own)], in order."""
    out = {}
    for r in rows:
        parts = [x for x in r["formatted"].split(chat.OPEN) if x]
        out[r["conv_id"], r["block"], r["window"]] = [(x.split(chat.MIDDLE)[0], len((chat.OPEN + x).encode()), o) for x, o in zip(parts, r["own"], strict=True)]
    return out


def test_windows_keep_the_budget(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(ADDED_TURNS, turns.schema))
    options = {"stride": 600, "history": 2, "history_tokens": 400, "system_tokens": 300}
    said = [(r["role"], chat.OPEN + r["role"] + chat.MIDDLE + (r["text"] or "").replace("~", "~0").replace("<|", "~1") + chat.CLOSE) for r in turns.collect()]
    largest = max(len(x.encode()) for _, x in said)
    systems = max((len(x.encode()) for role, x in said if role == "system"), default=0)
    for block in (2, 256):
        got = _windows(chat.windows(turns, **options, block=block).collect())
        assert sum(o for w in got.values() for *_, o in w) == turns.count()
        for parts in got.values():
            own = [n for _, n, o in parts if o]
            assert sum(own) <= 600 or len(own) == 1 and own[0] <= largest
            assert sum(n for role, n, o in parts if not o and role != "system") <= 400
            assert sum(n for role, n, o in parts if not o and role == "system") <= systems
        assert any(not o and role != "system" for w in got.values() for role, _, o in w), "history is repeated somewhere"


@pytest.mark.parametrize("block", [1, 4, 256])
def test_windows_by_definition(spark, block):
    """Against the rules told one by one, for turns in several blocks, null turns, ties and long system turns."""
    rng = random.Random(block)
    rows = []
    for c in range(40):
        turn = 0
        if rng.random() < 0.6:
            rows.append((c, 0, "system", "s" * rng.choice([3, 60, 200, 900])))
        for _ in range(rng.randint(0, 12)):
            turn += rng.choice([0, 1, 1, 1, 7])
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system"]), "t" * rng.randint(0, 150)))
    options = {"stride": 300, "history": 2, "history_tokens": 200, "system_tokens": 100}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = _windows(chat.windows(frame, **options, block=block).collect())
    import hashlib

    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        size = [len(chat.OPEN + r[2] + chat.MIDDLE + r[3] + chat.CLOSE) for r in own]
        system = size[0] if own[0][2] == "system" else 0
        beyond = max(system - 100, 0)
        stride, budget = max(300 - max(beyond - 200, 0), 1), 200 - beyond
        start, last = 0, None
        for i, r in enumerate(own):
            b = chat.NO_TURN if r[1] is None else r[1] // block
            start = 0 if b != last else start
            first, end = start // stride, (start + size[i] - 1) // stride
            key = (c, b, 2 * first + (first != end))
            if key not in want:
                near = [(own[j][2], size[j], False) for j in range(max(0, i - 2), i) if own[j][2] != "system"]
                near = [x for k, x in enumerate(near) if sum(n for _, n, _ in near[k:]) <= budget]
                want[key] = ([("system", system, False)] if system and i else []) + near
            want[key].append((r[2], size[i], True))
            start, last = start + size[i], b
    assert got == want


def test_long_system_turns_lead_every_window(spark):
    sizes = {1: 120, 2: 121, 3: 125, 4: 300, 5: 700, 6: 9000}
    talk = [(c, 0, "system", f"s{c} " * n) for c, n in sizes.items()]
    talk += [(c, t, "assistant" if t % 2 == 0 else "user", f"c{c}t{t} " * 90) for c in sizes for t in range(1, 30)]
    rows = chat.windows(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), block=4).collect()
    for c, n in sizes.items():
        mine = [r for r in rows if r["conv_id"] == c]
        assert len(mine) > 4 and sum(sum(r["own"]) for r in mine) == 30
        assert all(r["formatted"].startswith(chat.OPEN + "system" + chat.MIDDLE + f"s{c} ") and r["formatted"].count(f"s{c} ") == n for r in mine)
        most = chat.STRIDE + chat.SYSTEM_TOKENS + chat.HISTORY_TOKENS
        assert all(len(r["formatted"].encode()) <= most or sum(r["own"]) == 1 for r in mine)


def test_windows_take_clashing_names(spark):
    rows = [(1, 0, "user", "a", "x", 5, "y", True, "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string, window int, marked string, own boolean, _c string")
    got = chat.digests(chat.windows(frame)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(1, 1, 0)]
