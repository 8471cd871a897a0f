"""Every stage of the pipeline, and run(), against brute force on a small fixture that holds junk, repeated passages, edited
near copies, benchmark items with edits, nulls, repeated rows and rows that share an id."""

import hashlib
import random
import re

import pytest
from test_contracts import SPACE, deleted_lines, quality_by_hand
from test_similar import kept_by_brute_force

import corpus_pipeline
from tracework.llm.queries import vocabulary
from tracework.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def fixture_rows():
    rng = random.Random(21)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    prose = lambda: "\n".join(line(rng.randint(8, 30)) for _ in range(rng.randint(5, 12)))
    items = [line(rng.randint(15, 40)) for _ in range(6)]
    passage = [line(12) for _ in range(6)]
    rows, labels = [], []
    for i in range(60):
        text = prose()
        rows.append((i, text))
        labels.append((i, 1, 0))
        if i % 6 == 0:  # a near copy: one word in fifty changed
            words = text.split(" ")
            rows.append((100 + i, " ".join("xyz" if rng.random() < 0.02 else w for w in words)))
        if i % 10 == 3:  # a passage of over 50 words that stands in several
            rows.append((200 + i, "\n".join([prose(), *passage, prose()])))
        if i % 10 == 7:  # a benchmark item with a few edits
            item = list(rng.choice(items))
            for _ in range(len(item) // 30):
                item[rng.randrange(len(item))] = "Z"
            rows.append((300 + i, "\n".join([prose(), "".join(item), prose()])))
    labels += [(d, 1, 0) for d, _ in rows if d >= 100]
    for i in range(20):  # junk: other words, and repeats
        rows.append((400 + i, " ".join(f"#{rng.randrange(10**6)}$" for _ in range(80)) if i % 2 else "spam and eggs " * 40))
        labels.append((400 + i, 0, 0))
    rows += [(500, None), (501, ""), (502, "few words"), (0, prose()), (1, prose()), (None, prose()), rows[2], rows[3]]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows], labels, list(enumerate(items))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = fixture_rows()
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def told(rows):
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def by_quality(rows, folder, spark):
    trusted = {r.doc_id for r in table(spark, folder, "labels").where("quality = 1").collect()}
    judged = quality_by_hand([(d, t or "") for d, t in rows], trusted)
    return [r for r, x in zip(rows, judged, strict=True) if x[-1]]


def by_lines(rows):
    """The definition over rows that are told apart by place: ids are made unique in the order of id, and equal rows are
    one document."""
    distinct = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    # rows of one id are ordered by a hash in the stage; the fixture's have no lines in common
    number = {x: i for i, x in enumerate(distinct)}
    gone = deleted_lines([(i, x[2]) for x, i in number.items()])
    out = []
    for d, t in rows:
        cut = set(gone.get(number[d is not None, d or 0, t or ""], ()))
        if cut:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut)
            t = t if re.search("[^\x20\x09-\x0d]", t) else ""
        out.append((d, t))
    return out


def by_similarity(rows):
    """One of each component: the first by id (null ids last); the fixture has no ties between texts of one id."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    kept, _ = kept_by_brute_force([t for _, t in order])
    return [order[i] for i in kept]


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def by_benchmark(rows, items):
    clean = lambda t: " ".join((t or "").lower().split())
    holds = lambda text: any(edit_distance_inside(clean(x), clean(text)) <= len(clean(x)) // 16 for _, x in items)
    return [r for r in rows if not holds(r[1])]


def by_tokenizer(rows):
    from tokenizers import Tokenizer

    tok, sha = Tokenizer.from_file(vocabulary()), lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return out


def test_every_stage_and_the_run(spark, folder):
    rows, _, items = fixture_rows()
    want, docs = [(r[0], r[1]) for r in rows], table(spark, folder, "documents")
    wanted = {
        "quality rules": lambda r: by_quality(r, folder, spark), "line dedup": by_lines, "near-dedup": by_similarity,
        "benchmark decontamination": lambda r: by_benchmark(r, items),
    }
    changed = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        before, want = want, wanted[name](want)
        assert told(docs.select("doc_id", "text").collect()) == told(want), name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        changed.append(told(before) != told(want))
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
    assert all(changed), "each stage has something to do"
    final = sorted(by_tokenizer(want), key=str)
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == final


def test_near_stage_tells_rows_apart_by_text(spark, sf):
    one = " ".join(WORDS[:60])
    rows = [(3, one), (7, one), (7, " ".join(WORDS[30:])), (3, one), (None, one), (None, "alone here")]
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA), sf)
    assert told(got.select("doc_id", "text").collect()) == told([(3, one), (7, " ".join(WORDS[30:])), (None, "alone here")])


def test_words(spark):
    assert re.split(SPACE, "a\x0bb c") == ["a", "b", "c"]
