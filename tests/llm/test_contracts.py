"""Every corpus query over whole tables, against brute force."""

import collections
import hashlib
import math
import re
import struct
import zlib

import pytest

from tracework.llm import queries as Q
from tracework.llm import sharding
from tracework.session import table

SPACE = r"[\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def rows(spark, sf, name):
    return Q.QUERIES[name](spark, sf).toPandas()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2(spark, sf, docs):
    got = rows(spark, sf, "op2_hash_tree_sharding")
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == sorted((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs)
    assert set(got.shard) <= set(range(24)) and set(got.law) == {"key"}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(got.grown_shard[got.grown_shard != got.shard]) <= {24}
    grown = sharding.grow(Q.SHARD_TREE)
    assert [(a, b) for a, b in zip(got.shard, got.grown_shard)] == [(shard_of(d, Q.SHARD_TREE), shard_of(d, grown)) for d in got.doc_id]


def shard_of(key, node, path="r"):
    """Down the tree: the child with the smallest -ln(u) / weight, u from an MD5 of the key and the child's path."""
    if isinstance(node, tuple):
        return node[0]
    weight = lambda n: n[1] if isinstance(n, tuple) else sum(map(weight, n))
    u = lambda i: (int(hashlib.md5(f"{key}|{path}.{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    best = min(range(len(node)), key=lambda i: (-math.log(u(i)) / weight(node[i]), i)) if len(node) > 1 else 0
    return shard_of(key, node[best], f"{path}.{best}")


def test_op4(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary())
    got = rows(spark, sf, "op4_distinct_word_bpe")
    want = []
    for d, t in docs:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]].values.tolist())) == sorted(want)


def simhash(text):
    import xxhash

    words = [w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_op5(spark, sf, docs):
    got = rows(spark, sf, "op5_simhash_bk_trees")
    prints = {d: simhash(t) for d, t in docs}
    ids = sorted(prints)
    found = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    want = sorted((d, f"{prints[d]:016x}", found[d]) for d in ids)
    assert sorted(map(tuple, got.values.tolist())) == want


def quality_by_hand(docs, trusted, buckets=None):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each of docs [(id, text)]."""
    import math

    import xxhash

    from tracework.llm import quality

    size = sum(len(t.encode()) for _, t in docs)
    b = buckets or min(quality.MOST_BUCKETS, max(quality.LEAST_BUCKETS, 1 << (size // quality.BUCKET_BYTES).bit_length()))
    raw, target, grams, s = collections.Counter(), collections.Counter(), [], quality.SMOOTHING
    as_long = lambda h: struct.pack("<Q", h)
    for d, t in docs:
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.split(SPACE, t) if x]
        grams.append([x % b for x in h] + [xxhash.xxh64_intdigest(as_long(y), xxhash.xxh64_intdigest(as_long(x), 42)) % b for x, y in zip(h, h[1:])])
        raw.update(grams[-1])
        if d in trusted:
            target.update(grams[-1])
    weigh = lambda x: round(1e6 * (math.log(target[x] + s) - math.log(sum(target.values()) + s * b) - math.log(raw[x] + s) + math.log(sum(raw.values()) + s * b)))
    weight = {x: weigh(x) if target else 0 for x in raw}
    out = []
    for (_, t), own in zip(docs, grams, strict=True):
        w = [x for x in re.split(SPACE, t) if x]
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = collections.Counter(g)
        covered = {j for k, x in enumerate(g) if c[x] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and sum(weight[x] for x in own) >= quality.THRESHOLD * len(own)
        out.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, kept))
    return out


def test_op6(spark, sf, docs):
    got = rows(spark, sf, "op6_quality_rules").set_index("doc_id")
    trusted = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()}
    for (d, _), want in zip(docs, quality_by_hand(docs, trusted), strict=True):
        assert tuple(got.loc[d][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]]) == want


@pytest.mark.parametrize("bits", [64, 12, 3])
def test_repeated_windows_are_exact_whatever_the_hash(spark, bits):
    """With few bits of the hashes kept, windows of other words stand between equal ones all the time."""
    import random

    from pyspark.sql import functions as F

    from tracework.llm import quality

    rng = random.Random(bits)
    texts = [(i, " ".join(rng.choices("abcdef"[: rng.randint(1, 6)], k=rng.randint(0, 120)))) for i in range(80)] + [(100, "x"), (101, ""), (102, "a b c a b c"), (103, " ".join(map(str, range(3000))) + " 7 8 9")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.col("text").alias("_t"), quality.words_of(F.col("text")).alias("_w"))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.with_base_features(frame, ["doc_id"], bits).collect()}
    assert [got[i] for i, _ in texts] == [x[4] for x in quality_by_hand(texts, set())]


def test_op9_base(spark, sf, docs):
    got = rows(spark, sf, "op9_crf_personal_data").set_index("doc_id")
    for d, t in docs:
        want = []
        want += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            n = re.sub("[^0-9]", "", m.group())
            if 13 <= len(n) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(n[::-1])) % 10 == 0:
                want.append(("card", m.start(), m.end()))
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        row = got.loc[d]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone"))
        assert row.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(row.spans.split(","))


def planted_texts(docs, kinds, seed=4):
    """Texts of the documents' plain words with items of some kinds between them: [(text, {(kind, start, end)}, kinds)]."""
    import random

    from tracework.llm import pii

    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def number(k, valid):
        while pii.luhn(found := digits(k)) != valid:
            pass
        return found

    make = {
        "secret": lambda: ("secret", "".join(rng.choices("0123456789abcdef", k=40)), 'token = "{}"'), "SECRET": lambda: ("secret", "".join(rng.choices("0123456789ABCDEF", k=64)), "{}"),
        "dotted card": lambda: ("card", ".".join(number(16, True)[i : i + 4] for i in (0, 0, 0, 0)), "{}"), "email": lambda: ("email", f"josé.ñú{digits(2)}@größe.example", "{}"),
        "local phone": lambda: ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}", "{}"),
        "failed": lambda: (None, number(16, False), "{}"), "year": lambda: (None, str(rng.randint(1900, 2100)), "{}"), "price": lambda: (None, f"{rng.randint(1, 99)}.{digits(2)}", "{}"),
        "date": lambda: (None, f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", "{}"), "version": lambda: (None, f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", "{}"),
    }

    def card():
        whole = number(16, True)
        return "card", ".".join(whole[i : i + 4] for i in range(0, 16, 4)), "{}"

    make["dotted card"] = card
    out = []
    for _, t in docs:
        words = [w for w in t.split() if not re.search(r"[0-9@\"]|\(at\)", w)][:80]
        text, spans, said = "", set(), []
        for w in words:
            text += w + " "
            if rng.random() < 0.06:
                name = rng.choice(kinds)
                kind, item, around = make[name]()
                begin = len(text) + around.index("{}")
                text += around.format(item) + rng.choice([" ", "%%% ", ", "])
                said.append(name)
                if kind:
                    spans.add((kind, begin, begin + len(item)))
        out.append((text, spans, said))
    return out


def test_op9_added_spans_on_documents(docs):
    """Recall and precision of the spans that the field adds, on texts of the documents with planted items."""
    from tracework.llm import pii

    field = pii.train()
    planted = planted_texts(docs, ["secret", "SECRET", "dotted card", "email", "local phone", "failed", "year", "price", "date", "version"])
    texts = [t for t, _, _ in planted]
    found = pii.added_spans(field, texts, [pii.base_spans(t) for t in texts])
    want = {(n, *s) for n, (_, spans, _) in enumerate(planted) for s in spans}
    got = {(n, *s) for n, spans in enumerate(found) for s in spans}
    assert len(want) > 200 and len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)
    neighbours = "x 4465758382889437 4465758382889437 y" if pii.luhn("4465758382889437") else "x 4539148803436467 4539148803436467 y"
    assert [s for s in pii.added_spans(field, [neighbours], [[]])[0]] == [("card", 2, 18), ("card", 19, 35)]


def test_op10(spark, sf):
    got = rows(spark, sf, "op10_budgeted_chat_windows").set_index("conv_id")
    talks = collections.defaultdict(list)
    for r in [*table(spark, sf, "conversations").collect()]:
        talks[r.conv_id].append((r.turn, r.role, r.text or ""))
    talks[-7] = [(t, r, x) for _, t, r, x in Q.ADDED_TURNS]
    assert set(got.index) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        row = got.loc[c]
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(turns), len(loss), sha(loss))
        assert row.turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))


def deleted_lines(docs, min_words=50):
    """By definition: lines in a run of whole lines with min_words words or more that also starts earlier."""
    seqs = {d: [(i, x, len([w for w in re.split(SPACE, x) if w])) for i, x in enumerate(t.split("\n"))] for d, t in docs}
    seqs = {d: [x for x in s if x[2]] for d, s in seqs.items()}
    first, out = {}, collections.defaultdict(set)
    for d in sorted(seqs):
        s = seqs[d]
        for p in range(len(s)):
            n = 0
            for e in range(p, len(s)):
                n += s[e][2]
                if n >= min_words:
                    key = tuple(x[1] for x in s[p : e + 1])
                    if first.setdefault(key, (d, p)) != (d, p):
                        out[d] |= {x[0] for x in s[p : e + 1]}
                    elif e - p > 60:
                        break
    return {d: sorted(x) for d, x in out.items()}


def test_op8(spark, sf, docs):
    got = rows(spark, sf, "op8_suffix_array_line_dedup")
    assert {r.doc_id: list(r.deleted_lines) for r in got.itertuples()} == deleted_lines(docs)


def least_distance(item, text):
    """Of an item to any stretch of a text, by dynamic programming over whole rows."""
    import numpy as np

    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(t) + 1, np.int32)
    steps = np.arange(len(t) + 1)
    for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), np.uint32), 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (t != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_op1(spark, sf, docs):
    """Every pair of a document and an item whose distance may be within the budget, edits included."""
    got = rows(spark, sf, "op1_pigeonhole_decontamination")
    items = [(r.item_id, " ".join(r.text.lower().split())) for r in table(spark, sf, "benchmark").collect()]
    clean = [(d, " ".join(t.lower().split())) for d, t in docs]
    want = set()
    for d, t in clean:
        grams = {t[i : i + 7] for i in range(len(t) - 6)}
        for i, x in items:
            k = len(x) // 16
            # one of k + 1 pieces of 8 characters or more must stand in the text
            cuts = [len(x) * a // (k + 1) for a in range(k + 2)]
            if any(x[a : a + 7] in grams and x[a:b] in t for a, b in zip(cuts, cuts[1:])):
                distance = least_distance(x, t)
                if distance <= k:
                    want.add((d, i, distance))
    assert want == set(zip(got.doc_id, got.item_id, got.distance)) and len(want) > 2


def test_op7(spark, sf, docs):
    got = rows(spark, sf, "op7_factorization_machine_toxicity")
    assert sorted(got.doc_id) == sorted(d for d, _ in docs)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()


def test_op3(spark, sf):
    got = rows(spark, sf, "op3_cascade_url_filter").set_index("page_id")
    for r in table(spark, sf, "pages").collect():
        rest = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        host, path = re.match(r"[^/?#]*", rest).group(), re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fits = [x for x in Q.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        listed = any(host == h or host.endswith("." + h) for h in Q.LISTED_HOSTS)
        row = got.loc[r.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule.name if rule else None)
        assert row.verdict == (rule.action if rule else "block" if listed else "allow")
