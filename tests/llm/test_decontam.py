import random
import re

from tidemark.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def nearly(w, i, window, last):
    """Whether the window's words stand in order from place i on, none beyond ``last``."""
    return not window or any(w[k] == window[0] and nearly(w, k + 1, window[1:], last) for k in range(i, min(last + 1, len(w))))


def brute(docs, items, width=10, slack=1):
    out = []
    for _, text in docs:
        w, hit, found, near = words(text), set(), set(), set()
        for item, t in items:
            t = words(t)
            size = min(width, len(t))
            windows = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)} if t and item is not None else set()
            for i in range(len(w)):
                if size and tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(item)
                if item not in near and any(v[0] == w[i] and nearly(w, i + 1, v[1:], i + size - 1 + slack) for v in windows):
                    near.add(item)
        out.append((len(w), sorted(hit), sorted(found), sorted(near)))
    return out


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "x", "é"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 11, 25])))) for i in range(15)] + [(99, None), (None, "a b"), (7, "A-b c!")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([0, 5, 40, 200]))]
        if i % 3 == 0:
            t = words(rng.choice(items)[1])
            for _ in range(i % 5 if len(t) > 2 else 0):
                t.insert(rng.randrange(1, len(t)), rng.choice(["q", *t]))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t if i % 2 else t[2:]
        docs.append((i, " ".join(w).upper() if i % 4 == 0 else ", ".join(w)))
    return [*docs, (3, "a b c"), (60, None), (None, docs[3][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame([(t, d, 1) for d, t in docs], "text string, doc_id long, segment int").coalesce(3), spark.createDataFrame(items, "item_id long, text string")


def rows(out):
    return sorted((str(r.doc_id), r.n_words, r.hits, r.items, r.near) for r in out.collect())


def test_hits_are_those_of_a_plain_search(spark):
    for seed, slack in ((1, 1), (2, 0), (5, 3)):
        docs, items = case(seed)
        want = brute(docs, items, slack=slack)
        assert rows(decontam.find_passages(*frames(spark, docs, items), slack=slack)) == sorted((str(d), *x) for (d, _), x in zip(docs, want, strict=True))
        assert slack == 0 or sum(len(x[3]) > len(x[2]) for x in want) > 2


def test_blocks_and_segments_change_nothing(spark, monkeypatch):
    docs, items = case(3)
    want = rows(decontam.find_passages(*frames(spark, docs, items)))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontam, "FILTER_BITS", 4)
    assert rows(decontam.find_passages(*frames(spark, docs, items))) == want


def test_proximity_allows_foreign_words(spark):
    item = [(1, "alpha beta gamma delta")]
    docs = [(1, "alpha beta gamma delta"), (2, "alpha beta x gamma delta"), (3, "alpha x x x beta gamma delta"), (4, "alpha gamma beta delta")]
    d, b = frames(spark, docs, item)
    assert {r.doc_id: (bool(r.hits), bool(r.near)) for r in decontam.find_passages(d, b).collect()} == {1: (True, True), 2: (False, True), 3: (False, False), 4: (False, False)}
    assert {r.doc_id: bool(r.near) for r in decontam.find_passages(d, b, slack=3).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    docs = [(1, "alpha beta gamma"), (1, "quite clean"), (None, "so alpha beta gamma"), (None, "clean too"), (2, None)]
    d = spark.createDataFrame([(t, i, 1, 2) for i, t in docs], "text string, doc_id long, text_key int, row int")
    left = decontam.drop_contaminated(d, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    assert left.columns == d.columns and sorted(str(r.text) for r in left.collect()) == ["None", "clean too", "quite clean"]


def test_empty_tables_and_dropping(spark):
    docs, items = case(4)
    d, b = frames(spark, docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.hits for r in decontam.find_passages(d, none).collect())
    assert decontam.find_passages(d.limit(0), b).collect() == []
    left = decontam.drop_contaminated(d, b)
    clean = [str(i) for (i, _), (_, hits, *_) in zip(docs, brute(docs, items), strict=True) if not hits]
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(clean)
