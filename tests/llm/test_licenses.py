import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses

WORDS = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "MIT", "x", "licence", "generel"]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=14), st.sampled_from([" ", "-", "\n", ". "]))
def test_exact_phrases_are_all_found(words, between):
    text = between.join(words)
    clean, want = base(text)
    spans = licenses.Notices().spans(f" {' '.join(clean)} ".encode())
    assert sorted((s[1], s[0]) for s in spans if s[4]) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_edits_within_the_bound_are_found(data):
    phrase, label = data.draw(st.sampled_from([n for n in licenses.NOTICES if licenses.edits_allowed(n[0])]))
    text = phrase
    for _ in range(data.draw(st.integers(1, licenses.edits_allowed(phrase)))):
        i = data.draw(st.integers(0, len(text) - 1))
        text = data.draw(st.sampled_from([text[:i] + text[i + 1 :], text[:i] + "q" + text[i + 1 :], text[:i] + "q" + text[i:]]))
    text = " ".join(text.split())
    found = licenses.Notices().spans(f" some words before {text} and after ".encode())
    assert label in {s[0] for s in found}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(draw):
    phrase, _ = draw(st.sampled_from([n for n in licenses.NOTICES if licenses.edits_allowed(n[0])]))
    text = phrase
    for _ in range(draw(st.integers(0, licenses.edits_allowed(phrase) + 1))):
        i = draw(st.integers(0, len(text) - 1))
        text = draw(st.sampled_from([text[:i] + text[i + 1 :], text[:i] + "q" + text[i + 1 :], text[:i] + "é" + text[i:], text[:i] + " " + text[i:]]))
    return text


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_spans_are_those_of_a_plain_bounded_edit_matcher(data):
    """Every span is within its bound, with its true distance as edits; every stretch of words within the bound meets a span."""
    parts = [mutated(data.draw) if data.draw(st.booleans()) else data.draw(st.sampled_from(["any", "old é words", "gnu", "license", "public"])) for _ in range(data.draw(st.integers(1, 4)))]
    words = " ".join(parts).split()
    spans = licenses.Notices().spans(f" {' '.join(words)} ".encode())
    near = {}
    for phrase, label in licenses.NOTICES:
        k = licenses.edits_allowed(phrase)
        for i in range(len(words)):
            for j in range(i, len(words)):
                text = " ".join(words[i : j + 1])
                if abs(len(text) - len(phrase)) <= k and (d := distance(text, phrase)) <= k:
                    near[label, i, j] = min((d, d / len(phrase)), near.get((label, i, j), (99, 99)))
    for label, first, last, edits, exact, similarity in spans:
        d, share = near.get((label, first, last), (0, 0) if exact else (None, None))
        assert edits == d and abs(similarity - (1 - share)) < 1e-9
    for label, i, j in near:
        assert any(s[0] == label and s[1] <= j and i <= s[2] for s in spans), (label, words[i : j + 1])


def test_long_repetitive_texts_take_linear_time():
    import time

    for unit in ("cc by ", "apache license ", "apache licence "):
        clean = f" {unit * (800_000 // len(unit))}".encode()
        start = time.process_time()
        assert len(licenses.Notices().spans(clean)) == 800_000 // len(unit)
        assert time.process_time() - start < 10  # what is quadratic takes minutes


def test_long_words_take_linear_time():
    import time

    for unit, notices in (("許諾" * 10 + "license", 0), ("許諾" * 10 + "license ", 0), ("許諾 apache licence 許諾", 1), ("e" * 50 + "public", 0), ("許" * 20 + " mit lic\u00e9nse ", 1)):
        n = 1_000_000 // len(unit.encode())
        clean = f" {unit * n} ".encode()
        start = time.process_time()
        spans = licenses.Notices().spans(b" " + b" ".join(clean.split()) + b" ")
        assert len(spans) >= n * notices * 0.99 and (notices or not spans)
        assert time.process_time() - start < (10 if notices else 2)  # what is quadratic takes half an hour


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_notices_beside_signs_of_many_bytes(data):
    """What stands beside a notice, or in it, may be of any width in bytes."""
    phrase, label = data.draw(st.sampled_from([n for n in licenses.NOTICES if licenses.edits_allowed(n[0])]))
    i = data.draw(st.integers(1, len(phrase) - 2))
    sign = data.draw(st.sampled_from(["é", "許", "😀"]))
    text = data.draw(st.sampled_from([phrase[:i] + sign + phrase[i:], phrase[:i] + sign + phrase[i + 1 :]]))
    before, after = (data.draw(st.sampled_from(["", "許" * 30 + " ", "😀 "])) for _ in range(2))
    words = f"{before}{text} {after}".split()
    assert label in {s[0] for s in licenses.Notices().spans(f" {' '.join(words)} ".encode())}


def test_pieces_cover_a_phrase_and_plain_text_has_no_notice():
    for phrase, _ in licenses.NOTICES:
        assert "".join(p for _, p in licenses.pieces(phrase, 3)) == phrase
    assert licenses.Notices().spans(b" the general public was given a license to be loud in mit halls ") == []


def test_queries_digest(spark):
    rows = [(1, "Under the MIT License. See the Apache Licence, GNU general  public-license; mit license", "a"), (2, None, "a"), (3, "", "a"), (3, "cc by", "a")]
    out = {(r.doc_id, r.n_words): r for r in licenses.summarise(licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string"))).collect()}
    r = out[1, 14]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (3, 2, 12, "gpl,mit", "apache,gpl,mit", 1.0)
    assert tuple(out[2, 0]) == (2, 0, 0, None, None, "", "", 0.0) == (2, *tuple(out[3, 0])[1:])
    assert out[3, 2].base_labels == "cc-by"
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_table_against_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.summarise(licenses.find_licenses(docs)).collect():
        words, want = base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words), len(want))
        assert r.base_labels == ",".join(sorted({x for _, x in want})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
