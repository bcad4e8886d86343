import hashlib

import numpy as np

from tidemark.llm.fingerprints import Universal, compare_edited, fingerprint


def jaccard(a, b):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def test_every_row_meets_its_successor(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(20 + i * 3)) for i in range(40)] + ["é日本 😀 x", "", None, "one two", texts_like := "a b c d e f g h", texts_like]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(t, d, "no") for d, t in rows], "text string, doc_id long, place string").repartition(7)
    got = {r.doc_id: r for r in compare_edited(frame).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        t, after = t or "", texts[(d + 1) % len(texts)] or ""
        e = edited(t, after)
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(got[d].near_edited - jaccard(t, e)) < 0.25
        assert abs(got[d].near_next - jaccard(t, after)) < 0.25
    assert got[44].fingerprint == got[45].fingerprint and got[44].near_next == 1.0
    plain = {r.doc_id: r.fingerprint for r in fingerprint(frame).collect()}
    assert plain == {d: got[d].fingerprint for d in got}


def test_fingerprints_are_those_of_the_definition(spark):
    """Each coordinate in plain integers: the least of (a * x + b) mod 2**64 over the shingles, mixed, its top 16 bits."""
    from tidemark.llm.words import shingle_sets

    universal, top = Universal(), (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    texts = ["one two three four five six seven", "one", "a b c d e " * 100, "", None, "É é 日本 x y z w"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint(frame).collect()}
    for d, text in enumerate(texts):
        data = (text or "").encode()
        (own,) = shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 5)
        words = (text or "").split()
        assert len(own) == (len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}) if words else 0)
        least = [min([(a * x + b) & top for x in own.tolist()], default=top) for a, b in zip(universal.times.tolist(), universal.plus.tolist(), strict=True)]
        assert got[d] == "".join(f"{mixed(x) >> 48:04x}" for x in least)


def test_rows_of_one_id_are_dealt_apart(spark):
    rows = [(None if i % 3 else 7, f"text number {i % 50} of the rows " * 3) for i in range(600)]
    out = compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted((str(d), len(t)) for d, t in rows)
    # Equal texts of an id follow one another, but for the last of each.
    assert sum(r.near_next == 1.0 for r in out) >= len(rows) - len(set(rows))


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert compare_edited(spark.createDataFrame([], schema)).collect() == []
    (only,) = compare_edited(spark.createDataFrame([(5, "abcd")], schema)).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = compare_edited(spark.createDataFrame([(None, "x y"), (1, "a b"), (1, "a b"), (2, None)], schema)).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None"]


def test_likeness_of_very_long_texts(spark):
    universal = Universal()
    for n in (500, 20_000, 200_000, 1_000_000):
        hashes = np.random.default_rng(n).integers(0, 1 << 64, 2 * n, dtype=np.uint64)
        own = universal(hashes[:n])
        assert (own == universal(hashes[n:])).mean() < 0.05
        assert abs((own == universal(hashes[n // 2 : n // 2 + n])).mean() - 1 / 3) < 0.2

    n = 120_000
    texts = [" ".join(f"{c}{i:06d}" for i in range(n)) for c in "abc"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = compare_edited(frame).collect()
    assert len(rows) == 3 and len({r.fingerprint for r in rows}) == 3
    for r in rows:
        assert r.near_next < 0.05 and abs(r.near_edited - 1 / 3) < 0.2
