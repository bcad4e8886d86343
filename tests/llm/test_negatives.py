import math

import numpy as np
import pytest

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows):
    """Every anchor against every row, in plain Python."""
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        row = (i, tuple(math.floor(256 * float(np.float32(c))) for c in v), (label + 1) % 10 if i % 7 == 0 else label)
        if row not in whole:
            whole.append(row)
    out = []
    for i, v, label in whole:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in whole if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(-s, k) for s, k, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, j, rank, k, -p, s) for rank, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, parts=3):
    return sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect())


def rows_of(seed, n, width=5, spread=1.0):
    random = np.random.default_rng(seed)
    length = np.exp(random.normal(0, spread, n))
    return [(int(i) * 10, [float(c) for c in v * s], int(k)) for i, v, s, k in zip(range(n), random.normal(size=(n, width)), length, random.integers(0, 3, n), strict=True)]


@pytest.mark.parametrize("seed,spread", [(0, 0.0), (1, 1.5)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(negatives, "BUCKET_BYTES", 0)
    monkeypatch.setattr(negatives, "FIRST", 1)
    rows = rows_of(seed, 500, spread=spread)
    want = by_hand(rows)
    assert len(want) > 500 and mined(spark, rows) == want


def test_passes_and_anchors_that_are_scored_apart(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PASS", 7)
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    rows = rows_of(2, 200)
    assert mined(spark, rows) == by_hand(rows)


def test_ties_copies_and_rows_without_a_part(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET_BYTES", 0)
    same = [(i, [1.0, 0.5], i % 3) for i in range(400)] + [(1000 + i, [0.5, 0.25], i % 2) for i in range(300)]
    odd = [(None, [1.0, 1.0], 1), (5000, None, 1), (5100, [1.0, None], 1), (5200, [1.0, float("nan")], 1), (5300, [1.0, float("-inf")], 1), (5400, [1.0, 1.0], None), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1)]
    want = by_hand(same + odd)
    assert len(want) > 100 and mined(spark, same + odd) == want
    assert mined(spark, same + odd + [(5500, [3.0], 1), (5600, [], 1)]) == want


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 2), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [-2.0, 1.0], 1), (5, [-1.5, 0.0], 3), (100, [0.0, 0.0], 4), (101, [2.0, 2.0], 4), (102, [1.0, 2.0], 5)]
    assert mined(spark, rows) == by_hand(rows)


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 2.0], 1), (100, [2.0, 1.0], 2), (3, [1.0, 1.0], 1), (4, [2.0, 2.0], 2), (5, [0.5, 0.5], 3), (5, [0.6, 0.5], 3)]
    assert mined(spark, rows) == by_hand(rows)


def test_large_entries_are_summed_exactly(spark):
    rows = [(i, [262144.0 - i, 262143.0 + (i % 5), float(i)], i % 2) for i in range(0, 300, 5)] + [(i, [200000.0, 30000.0 * (i % 3) + i, 1.0], i % 2) for i in range(1, 200, 5)]
    want = by_hand(rows)
    assert want and mined(spark, rows) == want


def test_no_anchors_no_rows_and_further_columns(spark):
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = rows_of(4, 60)
    wide = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", pos string, rank int, part int")
    assert sorted(tuple(r) for r in negatives.mine(wide).collect()) == by_hand(rows)


def test_short_vectors_are_passed_over_by_norm(spark, monkeypatch):
    """Buckets whose longest norm can't reach any limit are not read."""
    monkeypatch.setattr(negatives, "BUCKET_BYTES", 0)
    monkeypatch.setattr(negatives, "FIRST", 1)
    random = np.random.default_rng(5)
    long = [(i * 10, [float(c) for c in 3 + random.random(4)], i % 3) for i in range(100)]
    short = [(5001 + i, [float(c) for c in random.random(4) / 50], i % 3) for i in range(1000)]
    read = []
    search = negatives._search
    counter = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = search(*args)

        def inner(batches):
            def seen():
                for batch in batches:
                    counter.add(batch.num_rows)
                    yield batch

            return run(seen())

        return inner

    monkeypatch.setattr(negatives, "_search", counted)
    assert mined(spark, long + short) == by_hand(long + short)
    read.append(counter.value)
    assert read[0] <= 10  # of 18 buckets, each for two searches
