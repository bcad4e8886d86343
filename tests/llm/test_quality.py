import math
import re
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import quality
from tidemark.llm.common import utf8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in out.items())
    held = [(out[d].predicted, q) for d, q in labels.items() if out[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert np.mean([p for p, q in held if q == 1]) > 0.97


def test_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_discriminant_matches_gaussian_densities(spark):
    rng = np.random.default_rng(0)
    n = len(quality.STATISTICS)
    x = [rng.normal(k, 1 + k, (400, n)) @ np.diag(1 + rng.random(n)) for k in (0, 1)]
    rows = [(r.tolist(), k) for k in (0, 1) for r in x[k]]
    model = quality.fit(spark.createDataFrame(rows, "stats array<double>, label int").repartition(5), shrink=0.0, pool=0.0)
    from_numpy = []
    probe = rng.normal(0.5, 1, (50, n))
    for k in (0, 1):
        mean, cov = x[k].mean(axis=0), np.cov(x[k].T, bias=True) + 1e-3 * np.eye(n)
        d = probe - mean
        from_numpy.append(np.log(401 / 802) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1))
    assert np.allclose(model.log_odds(probe), from_numpy[1] - from_numpy[0])


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "a b a b\nc", "É!! ### | x", "one\n" * 50, "x" * 5000]
    whole = quality.statistics(*utf8(pa.array(texts)))
    alone = np.vstack([quality.statistics(*utf8(pa.array([t]))) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()


def test_nulls_repeats_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "good text here", 0.1), (1, "good text here", 0.1), (2, None, 0.2), (None, "### %%%", 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, none).collect()
    assert len(out) == 4 and all(np.isfinite(r.score) for r in out)
    some = spark.createDataFrame([(1, 1, None), (1, None, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(quality.score_quality(docs, some).collect()) == 4
    assert quality.score_quality(docs.limit(0), some).collect() == []
    kept = quality.keep_good(docs, some)
    assert kept.columns == docs.columns


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    sf = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    by = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    good, bad = (next(texts[d] for d, q in sorted(by.items()) if q == k and texts[d] and len(texts[d]) > 400) for k in (1, 0))
    more = spark.createDataFrame([(5000, good, 1, 2), (5000, bad, 1, 2), (None, good, 1, 2), (None, bad, 1, 2)], "doc_id long, text string, row int, text_key int")
    docs = table.selectExpr("doc_id", "text", "1 AS row", "2 AS text_key").union(more)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.filter("doc_id IS NULL OR doc_id = 5000").collect()) == [("5000", good), ("None", good)]


def by_hand(text):
    """The sixteen statistics in plain Python, by byte and by word."""
    data = text.encode()
    of = lambda chars: sum(b in chars for b in data)
    share = lambda part, whole, usual, weight=40.0: math.log((part + weight * usual) / (whole + weight) + 2e-4)
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [lower(w) for w in re.split(rb"[ \t-\r]+", data) if w]
    lines = [lower(x) for x in re.split(rb"[\n\r]+", data) if x]
    blank, newline, n, size = b" \t\r\x0b\x0c", b"\n", len(words), len(data)
    classes = {"lower": range(97, 123), "upper": range(65, 91), "digits": range(48, 58), "stops": b".,;:?'\"()", "dashes": b"-_/", "bars": b"|\\<>{}[]=", "marks": b"#$%&*@^~+`", "shouts": b"!", "high": range(128, 256)}
    known = {b for c in classes.values() for b in c} | set(blank) | set(newline)
    signs = sum(a in classes["bars"] or a in classes["marks"] or a in classes["shouts"] for a, b in zip(data, data[1:]) if b in blank or b in newline)
    return [
        math.log(n + 20), math.log((size - of(blank) - of(newline) + 50) / (n + 10)), share(of(classes["upper"]), size, 0.03), share(of(classes["digits"]), size, 0.003),
        share(of(classes["stops"]), size, 0.025), share(of(classes["dashes"]), size, 0.001), share(of(classes["bars"]), size, 0.0005), share(of(classes["marks"]), size, 0.0005),
        share(of(classes["shouts"]), size, 0.0005), share(sum(b not in known for b in data), size, 0.0005), share(of(classes["high"]), size, 0.03), share(len(set(words)), n, 0.7),
        math.log((size + 400) / (len(lines) + 2)), share(len(set(lines)), len(lines), 1.0, 4.0), share(min(signs, n), n, 0.005), share(sum(a == b for a, b in zip(words, words[1:])), n, 0.01),
    ]


def test_statistics_are_those_counted_by_hand():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ["", "a", "A b A b\n\nc\r\nc", "É!! ### | x =\n", "\x00\x01 odd\x7f", "one\n" * 50, "no no no\tyes", "x" * 5000, " \n "]
    got = quality.statistics(*utf8(pa.array(texts)))
    assert np.allclose(got, [by_hand(t or "") for t in texts])
