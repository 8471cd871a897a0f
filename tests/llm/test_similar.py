"""The pipeline's near-duplicate stage against all pairs of a fixture of edited copies."""

import random

import corpus_pipeline


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_copies():
    draw = random.Random(3)
    texts = []
    for _ in range(25):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 400))]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):  # each copy is an edit of the one before it, so some are joined by a chain only
            for _ in range(edits):
                words[draw.randrange(len(words))] = f"x{draw.randrange(5000)}"
            texts.append(" ".join(words))
    texts += [None, "", "few words", "Few  words", "few words more"]
    draw.shuffle(texts)
    return texts


def kept_by_brute_force(texts):
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}, pairs


def test_near_stage_keeps_one_of_each_similar_group(spark, sf):
    texts = edited_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, pairs = kept_by_brute_force(texts)
    got = corpus_pipeline.near_stage(spark, docs, sf).collect()
    assert len(pairs) > 40 and {r["doc_id"] for r in got} == want
    assert all(r["text"] == texts[r["doc_id"]] for r in got)


def test_clusters_in_blocks_lose_no_link(spark):
    """All texts in one cluster, in one task and in many."""
    from tracework.llm import similar
    from tracework.operators.linkage import connected

    texts = sorted({t for t in edited_copies() if t})
    hashes = [similar.np.unique(similar.shingle_hashes(t, 5)) for t in texts]
    rows = [(1, i, len(h), [7] * similar.BANDS, bytearray(h.tobytes())) for i, h in enumerate(hashes)]
    members = spark.createDataFrame(rows, "cluster long, set long, n long, bands array<long>, hashes binary")
    _, pairs = kept_by_brute_force(texts)
    root = list(range(len(texts)))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    for most in (7, 2048):
        links = similar.cluster_links(members, 0.8, block_sets=most)
        found = {r["node"]: r["root"] for r in connected(links).collect()}
        assert [found.get(i, i) for i in range(len(texts))] == root
        assert links.count() < len(texts) * (1 if most == 2048 else 20)


def test_trees_propose_what_no_band_shares(spark):
    """Sets without a common band are candidates if their fingerprints stand within two bits, also by way of a third set."""
    from tracework.llm import similar
    from tracework.operators.linkage import connected

    prints = {1: 0, 2: 0, 3: 0b11, 4: 0b1111, 5: 0b111 << 40, 6: -1}
    rows = [(s, fp, [s * 100 + b for b in range(similar.BANDS)]) for s, fp in prints.items()] + [(7, 0x5555555555555555, [600] * similar.BANDS)]
    links = similar.candidate_links(spark.createDataFrame(rows, "set long, fp long, bands array<long>"))
    assert {r["node"]: r["root"] for r in connected(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}


def test_near_prints_are_tested_for_exact_similarity(spark):
    from tracework.llm import similar

    draw = random.Random(5)
    hashes = [similar.np.array(sorted({draw.getrandbits(64) for _ in range(400)}), similar.np.uint64)]
    while len(hashes) < 8:
        now = similar.np.unique(similar.np.r_[hashes[0][1:], similar.np.uint64(draw.getrandbits(64))])
        if (similar.majority(now) ^ similar.majority(hashes[0])).bit_count() <= 2:
            hashes.append(now)
    # a small set with the print of the first one is no copy of it
    rows = [(1, i, len(h), [i] * similar.BANDS, bytearray(h.tobytes())) for i, h in enumerate(hashes)]
    rows.append((1, 99, 1, [99] * similar.BANDS, bytearray(similar.np.uint64(similar.majority(hashes[0])).tobytes())))
    members = spark.createDataFrame(rows, "cluster long, set long, n long, bands array<long>, hashes binary")
    links = similar.cluster_links(members, 0.8).collect()
    assert {n for r in links for n in r} == set(range(8))
