import random

import numpy as np
import pytest

from tidemark.llm import fingerprints, neardup
from tidemark.llm.components import components


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width=4, similarity=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=1):
    """Groups of copies edited at many rates, of one base each, beside unlike texts."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(20):
            rate = rng.random() * 0.08
            rows.append(" ".join(word() if rng.random() < rate else w for w in base))
    rows += [" ".join([*passage, *[word() for _ in range(60)]]) for _ in range(20)]
    rows += ["one", "one", "ONE", "one two", None, "", "   "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("link", [neardup.link_duplicates, fingerprints.link_by_fingerprint])
def test_components_are_those_of_all_pairs(spark, link):
    rows = corpus()
    frame = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, bands string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(frame).collect()}
    assert got == brute(rows, fingerprints.WIDTH if link is fingerprints.link_by_fingerprint else neardup.WIDTH)


def test_width_and_result_columns(spark):
    rows = corpus(2)
    out = neardup.link_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = out.collect()
    want = brute(rows, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, None, None), (3, "a b c d e f", "y")]
    got = sorted(map(tuple, neardup.link_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (2, 0, 2, True), (3, 3, 1, False)], key=str)
    assert neardup.link_duplicates(spark.createDataFrame([], schema)).collect() == []
    kept = neardup.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]


def test_repeated_ids_lose_no_text(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a, "x", "y"), (1, b, "x", "y"), (2, a, "x", "y"), (3, b, "x", "y"), (1, a, "z", "y"), (5, "", "x", "y"), (5, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, node string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.link_duplicates(docs).collect())
    assert got == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (5, 5, True)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [(1, a), (1, b), (5, ""), (5, "None")]


def test_pairs_of_large_buckets_meet_in_a_grid(spark, monkeypatch):
    """Crowded buckets in cells of a few members: the last search finds all links that the hubs miss."""
    monkeypatch.setattr(neardup, "LEFT", 3)
    monkeypatch.setattr(neardup, "RIGHT", 2)
    rows = corpus(7)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = neardup.link_duplicates(frame, bands=40, rows=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def alike(spark, members, copies):
    """Sets of 60 shingles that all have and 20 that some four have; of the first ones also near copies."""
    sets = [sorted({*range(60), *(1000 + (node * 20 + k * 7919) % (members * 5) for k in range(20))}) for node in range(members)]
    sets += [sorted({*s[:-3], *(10**9 + 10 * i + k for k in range(3))}) for i, s in enumerate(sets[:copies])]
    counts = [[sum(x % neardup.PARTS == k for x in s) for k in range(neardup.PARTS)] for s in sets]
    rows = spark.createDataFrame([(1, i, i, len(s), len(s)) for i, s in enumerate(sets)], "bucket long, node long, own long, n int, v int")
    return rows, spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>"), spark.createDataFrame(list(enumerate(counts)), "node long, c array<int>")


def test_the_last_search_grows_with_the_sets_of_a_bucket(spark):
    """Sets of one bucket, three quarters of each in all others: pairs come from what is rarer."""
    pairs = {m: {(r.a, r.b) for r in neardup._pairs_apart(*alike(spark, m, 50), 80).collect()} for m in (400, 1600)}
    for m, found in pairs.items():
        assert {(i, m + i) for i in range(50)} <= found
        assert len(found) < 20 * m


def test_prefixes_are_the_rarest_shingles(spark):
    sets = {1: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 2: [1, 2, 3, 4, 5, 6, 7, 8, 9, 11], 3: [1, 2, 12], 4: [13]}
    rows = spark.createDataFrame([(i,) for i in sets], "node long")
    got = neardup._prefixes(rows, spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"), 80).collect()
    # 10 - 8 + 1 places, the first of them held by nobody else; 3 - 3 + 1 and 1 - 1 + 1 places.
    assert sorted((r.node, r.place, r.key) for r in got) == [(1, 1, 3), (1, 2, 4), (2, 1, 3), (2, 2, 4)]


def test_circulant_signature_is_the_definition_and_estimates_similarity():
    c = neardup.Circulant(64, universe=1 << 12)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    places, second = c.first[x % np.uint64(1 << 12)].astype(int), c.shifted[:, 0]
    want = [min(second[(p + k) % (1 << 12)] for p in places) for k in range(64)]
    assert c(x).tolist() == want
    big = neardup.Circulant(2048)
    a, b = x, np.concatenate([x[:200], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    assert abs((big(a) == big(b)).mean() - 0.5) < 0.06


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**dict.fromkeys(range(41), 0), **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
