import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lines, registry
from tidemark.llm.common import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    """The counts of a text in plain Python."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    often = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if often[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def described(texts):
    return lines.describe(*utf8(pa.array(texts, pa.string())))


def features(line, text):
    """The features of a line that can be read off it, in plain Python."""
    words = WORD.findall(line)
    if not words:
        return set()
    letters = [c for c in line if c.isascii() and c.isalpha()]
    size = sum(len(w.encode()) for w in words)
    tests = {
        "any": True, "short": len(words) < 5, "long": len(words) >= 25, "signed": 8 * sum(w[-1] in "#*$%&|<>!" for w in words) >= len(words), "mostly_signed": 2 * sum(w[-1] in "#*$%&|<>!" for w in words) >= len(words),
        "capitals": 2 * sum(c.isupper() for c in letters) > len(letters), "digits": 8 * sum(c in "0123456789" for c in line) >= size, "shouting": 4 * line.count("!") >= len(words), "closed": words[-1][-1] in ".!?:\"')", "opened": words[0][0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "stuttering": 3 * sum(a == b for a, b in itertools.pairwise(words)) >= len(words), "few_words": 2 * len(set(words)) < len(words), "long_words": size > 14 * len(words), "short_words": 2 * size < 5 * len(words),
        "code_signs": 6 * sum(c in "@/\\_=+~^`{}[]" for c in line) >= len(words), "stops": 30 * sum(c in ".,;:?" for c in line) >= len(words),
    }
    return {k for k, v in tests.items() if v}


TEXTS = ["", None, "a", "\n", "\n\n a \n", "a b c a b c", "a b c\na b c\n a b c\na b c\n", "x x x x", "É ö ü z\x85q # |<>", "A!! B!! C!!\r\nD.\tE\x0bF\x0cg\x1fh", "one\n" * 30, "no no no no\n\nyes", "end\n"]


def test_counts_and_features_are_those_counted_by_hand():
    texts = TEXTS + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    counts, codes, words, bounds = described(texts)
    assert counts.tolist() == [by_hand(t) for t in texts]
    for i, text in enumerate(texts):
        own = (text or "").split("\n")
        assert words[bounds[i] : bounds[i + 1]].tolist() == [len(WORD.findall(x)) for x in own]
        seen = set()
        for line, code in zip(own, codes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            got = {f for k, f in enumerate(lines.FEATURES) if code >> k & 1}
            assert got - {"repeated", "windows"} == features(line, text)
            assert ("repeated" in got) == (bool(WORD.search(line)) and line in seen)
            seen.add(line)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#A.", max_size=40), max_size=6))
def test_counts_of_any_texts(texts):
    counts, codes, words, bounds = described(texts)
    assert counts.tolist() == [by_hand(t) for t in texts]
    assert np.diff(bounds).tolist() == [t.count("\n") + 1 for t in texts]


def score(field, content, labels):
    return sum(c for c, y in zip(content, labels, strict=True) if y) + sum(field.pairs[2 * a + b] for a, b in itertools.pairwise(labels))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=7), st.lists(st.integers(-2, 2), min_size=4, max_size=4))
def test_labels_are_those_of_the_greatest_score(content, pairs):
    field = lines.Field(np.zeros(len(lines.FEATURES) + 1), np.array(pairs, float))
    got = field.labels([float(c) for c in content])
    assert len(got) == len(content)
    assert score(field, content, got) == max(score(field, content, y) for y in itertools.product((0, 1), repeat=len(content)))


def test_equal_scores_give_content():
    assert lines.Field(np.zeros(len(lines.FEATURES) + 1), np.zeros(4)).labels([0.0] * 5) == [True] * 5


def test_gradient_is_that_of_all_labellings():
    random = np.random.default_rng(0)
    flat = random.normal(size=len(lines.FEATURES) + 5)
    seqs = [(random.integers(0, 1 << len(lines.FEATURES), n).astype(np.int32), random.integers(0, 2, n).tolist()) for n in (1, 4, 6, 3)]
    size = np.array([len(s) for s, _ in seqs])
    filled = lambda rows, dtype: np.array([[*r, *[0] * (size.max() - len(r))] for r in rows], dtype)

    def whole(flat):
        field = lines.Field.of(flat)
        return sum(score(field, field.content(s), y) - np.log(np.exp([score(field, field.content(s), z) for z in itertools.product((0, 1), repeat=len(s))]).sum()) for s, y in seqs)

    got = lines.gradient(lines.Field.of(flat), filled([s for s, _ in seqs], np.int32), filled([y for _, y in seqs], int), size)
    assert np.isclose(got[0], whole(flat))
    for i in range(len(flat)):
        near = [flat.copy(), flat.copy()]
        near[0][i] += 1e-5
        near[1][i] -= 1e-5
        assert np.isclose(got[1 + i], (whole(near[0]) - whole(near[1])) / 2e-5, atol=1e-6)


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return {r.doc_id: r for r in lines.judge_lines(docs, labels).collect()}, {r.doc_id: r.quality for r in labels.collect()}


def test_held_out_documents_are_told_apart(judged):
    rows, labels = judged
    held = [(rows[d].kept, q) for d, q in labels.items() if zlib.crc32(str(d).encode()) % 3 == 1 and not rows[d].base_failed]
    assert len(held) > 80 and {q for _, q in held} == {0, 1} and all(k == bool(q) for k, q in held)


def test_good_and_bad_lines_of_one_text_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good, bad = ([x for d, q in sorted((r.doc_id, r.quality) for r in labels.collect()) if q == k and texts[d] for x in texts[d].split("\n") if len(x.split()) > 12][:24] for k in (1, 0))
    mixed = [(90_000, "\n".join(good[:12] + bad[:4]), None), (90_001, "\n".join(bad[4:18] + good[12:15]), None), (90_002, "\n".join(good[15:18] + bad[18:21] + good[18:24]), None)]
    out = {r.doc_id: r for r in lines.judge_lines(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(mixed, "doc_id long, text string, lang string")), labels).filter("doc_id >= 90000").collect()}
    assert out[90_000].content == [True] * 12 + [False] * 4 and out[90_000].kept
    assert out[90_001].content == [False] * 14 + [True] * 3 and not out[90_001].kept and not out[90_001].base_failed
    assert out[90_002].content == [True] * 3 + [False] * 3 + [True] * 6 and out[90_002].kept
    cut = spark.createDataFrame([(mixed[0][1], out[90_000].content)], "t string, c array<boolean>").select(lines.content_text("t", "c")).first()[0]
    assert cut == "\n".join(good[:12])


def test_held_out_labels_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted((r.doc_id, r.kept) for r in lines.judge_lines(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_nulls_repeats_missing_labels_and_further_columns(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, good, 1, "x"), (1, good, 1, "x"), (2, None, 2, "x"), (3, "", 3, "x"), (None, good + "\n\n", 4, "x"), (4, "a b c " * 30, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, codes int, n_words string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, None, 0), (4, 0, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        out = lines.judge_lines(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
        for r in out:
            text = next(t for i, t, *_ in rows if i == r.doc_id)
            assert [r[c] for c in lines.COUNTS] == by_hand(text) and len(r.content) == (text or "").count("\n") + 1
            assert r.base_failed == (r.doc_id in (2, 3, 4)) and not (r.base_failed and r.kept)
    assert all(r.kept for r in lines.judge_lines(docs, none).collect() if not r.base_failed)
    assert lines.judge_lines(docs.limit(0), some).collect() == [] == lines.judge_lines(docs.limit(0), none).collect()


def test_a_very_long_text_takes_linear_time():
    began = time.process_time()
    for text in ("word " * 400_000, "a b\n" * 400_000, "x" * 2_000_000, "\n" * 1_000_000):
        counts, codes, words, bounds = described([text, "after"])
        labels = lines._labelled(lines.Field(np.zeros(len(lines.FEATURES) + 1), np.zeros(4)), codes, bounds)
        assert counts[1].tolist() == [1, 5, 0, 0, 0] and len(labels) == text.count("\n") + 2
    assert time.process_time() - began < 30


def test_the_query(spark, sf):
    out = registry.op13_lines(spark, sf)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(texts) and all([r[c] for c in lines.COUNTS] == by_hand(texts[r.doc_id]) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
