"""Hard-negative mining: exact windowed top-k by inner product over norm-sorted buckets.

Candidates are sorted by norm, longest first, and cut into buckets. By Cauchy-Schwarz no member of a
bucket scores more than its longest norm times the anchor's: a bucket is passed over by every window
whose lower limit, or whose running k-th score, is above that. The search goes through the order in
rounds, each some times larger than the last, so that later and larger rounds start with the k-th
scores of earlier ones; within a task the k-th scores rise from bucket to bucket. Anchors are taken in
passes of bounded size, each held against all buckets; candidates are never shuffled after the sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import staged
from .vectors import floored, matrix, usual_length, whole

# An entry x becomes floor(SCALE * x); of labels, classes; of anchors, positives and windows.
SCALE, CLASSES, RELABEL, ANCHOR = 256, 10, 7, 100
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Entries are kept within this bound, so that inner products of 512 of them fit in a long.
BOUND = 1 << 27
#: Bytes of vectors in a bucket, and rows at most.
BUCKET_BYTES, BUCKET_ROWS = 1 << 18, 1024
#: Anchors in a pass at most: so many vectors, and POSITIVES windows for each, are broadcast at once.
PASS = 16_384
#: Buckets in the first round, and how many times the rounds so far the next one is.
FIRST, GROWTH = 8, 8
#: Anchors that are scored against a bucket in one product.
TOGETHER = 256

_NONE = np.iinfo(np.int64).min
_BUCKET = "part int, at long, top long, size int, ids binary, labels binary, vectors binary"


@dataclass(frozen=True)
class Windows:
    """Anchors' vectors, ids and labels; and windows: the place of their anchor, score limits, and the k-th score and id so far."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def norms(self) -> np.ndarray:
        return np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)


def _bucket_rows(width: int) -> int:
    return max(64, min(BUCKET_ROWS, BUCKET_BYTES // (4 * max(1, width))))


def _cut(width: int):
    """Sorted rows (vec_id, label, q, norm, part) as buckets; of equal rows in a run the first one stays."""

    def run(batches):
        held, at, most, last, part = [], 0, _bucket_rows(width), None, 0

        def bucket(table):
            nonlocal at
            ids, labels, vectors, norms = table
            out = [pa.array([x], t) for x, t in ((part, pa.int32()), (at, pa.int64()), (int(norms[0]), pa.int64()), (len(ids), pa.int32()), (ids.tobytes(), pa.binary()), (labels.tobytes(), pa.binary()), (vectors.tobytes(), pa.binary()))]
            at += 1
            return pa.RecordBatch.from_arrays(out, names=["part", "at", "top", "size", "ids", "labels", "vectors"])

        def joined():
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(4)[0].as_py()
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width, np.int32), batch.column(3).to_numpy()]
            before = last or [x[:1] for x in rows]
            shifted = [np.concatenate([b, x[:-1]]) for b, x in zip(before, rows, strict=True)]
            new = (rows[0] != shifted[0]) | (rows[1] != shifted[1]) | (rows[2] != shifted[2]).any(axis=1)
            new[0] |= last is None
            last = [x[-1:] for x in rows]
            held.append([x[new] for x in rows])
            if sum(len(h[0]) for h in held) >= most:
                whole_rows = joined()
                n = len(whole_rows[0]) // most * most
                for i in range(0, n, most):
                    yield bucket([x[i : i + most] for x in whole_rows])
                held = [[x[n:] for x in whole_rows]]
        if held and sum(len(h[0]) for h in held):
            yield bucket(joined())

    return run


def norm_buckets(rows: DataFrame, width: int) -> DataFrame:
    """Rows (vec_id, label, q) sorted by norm, longest first, in buckets: rank, top (the largest squared norm), size, ids, labels, vectors.

    Rows of one norm are in the order of their ids, and are dealt out by it too. Repeats of a whole row stay out.
    """
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    order = [F.desc("norm"), F.asc("vec_id"), F.asc("label"), F.asc("q")]
    dealt = rows.withColumn("norm", norm).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    buckets = staged(dealt.select("vec_id", "label", "q", "norm", "part").mapInArrow(_cut(width), _BUCKET), "buckets")
    parts = buckets.groupBy("part").agg(F.count("*").alias("n"))
    starts = parts.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return buckets.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")


def _unpacked(batch: pa.RecordBatch, width: int):
    for top, ids, labels, vectors in zip(*(batch.column(c).to_pylist() for c in ("top", "ids", "labels", "vectors")), strict=True):
        yield top, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int32), np.frombuffer(vectors, np.int32).reshape(-1, width)


def _anchors(buckets: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k, (_, ids, labels, vectors) in enumerate(_unpacked(batch, width)):
                own = np.flatnonzero(ids % ANCHOR == 0)
                rank = batch.column("rank")[k].as_py()
                out = [pa.array(ids[own]), pa.array(labels[own]), pa.array([vectors[i].tobytes() for i in own], pa.binary()), pa.array(rank * BUCKET_ROWS + own, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["anchor_id", "label", "vector", "place"])

    found = buckets.select("rank", "top", "ids", "labels", "vectors").mapInArrow(run, "anchor_id long, label int, vector binary, place long")
    return staged(ranked(found, [], [F.asc("place")]).withColumn("pos", F.col("pos") - 1), "anchors")


def _search(windows: Windows, kth: np.ndarray, kth_id: np.ndarray, k: int, same: bool, width: int):
    """Scores buckets against windows, and gives each window's first ``k`` of what a task has seen."""

    def run(batches):
        w = windows.value
        limit, limit_id = np.maximum(w.low, kth), np.where(kth >= w.low, kth_id, np.iinfo(np.int64).max)
        norms, n = w.norms(), len(w.owner)
        by_float = w.vectors.astype(float)
        score, ids_of = np.full((n, k), _NONE), np.zeros((n, k), np.int64)
        alive_ever = w.low <= w.high
        for batch in batches:
            for top, ids, labels, vectors in _unpacked(batch, width):
                longest = np.sqrt(float(top)) * (1 + 1e-12)
                alive = np.flatnonzero(alive_ever & (limit <= norms[w.owner] * longest))
                exact = len(norms) == 0 or norms.max() * longest < 2.0**53
                columns = vectors.T.astype(float if exact else np.int64)
                owners = np.unique(w.owner[alive])
                for i in range(0, len(owners), TOGETHER):
                    some = owners[i : i + TOGETHER]
                    mine = alive[np.searchsorted(w.owner[alive], some[0], "left") : np.searchsorted(w.owner[alive], some[-1], "right")]
                    products = ((by_float if exact else w.vectors.astype(np.int64))[some] @ columns).astype(np.int64)
                    fits = ((w.labels[some][:, None] == labels) == same) & (w.ids[some][:, None] != ids)
                    at = np.searchsorted(some, w.owner[mine])
                    each = products[at]
                    row, column = np.nonzero(fits[at] & (each >= limit[mine][:, None]) & (each <= w.high[mine][:, None]))
                    got, got_id, win = each[row, column], ids[column], mine[row]
                    better = (got > limit[win]) | (got_id < limit_id[win])
                    got, got_id, win = got[better], got_id[better], win[better]
                    if not len(got):
                        continue
                    touched = np.unique(win)
                    old = score[touched] != _NONE
                    got = np.concatenate([got, score[touched][old]])
                    got_id = np.concatenate([got_id, ids_of[touched][old]])
                    win = np.concatenate([win, np.repeat(touched, old.sum(axis=1))])
                    order = np.lexsort((got_id, -got, win))
                    got, got_id, win = got[order], got_id[order], win[order]
                    place = np.arange(len(win)) - np.searchsorted(win, win)
                    first = place < k
                    score[touched], ids_of[touched] = _NONE, 0
                    score[win[first], place[first]], ids_of[win[first], place[first]] = got[first], got_id[first]
                    full = touched[score[touched, k - 1] != _NONE]
                    rises = full[(score[full, k - 1] > limit[full]) | ((score[full, k - 1] == limit[full]) & (ids_of[full, k - 1] < limit_id[full]))]
                    limit[rises], limit_id[rises] = score[rises, k - 1], ids_of[rises, k - 1]
        row, column = np.nonzero(score != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(score[row, column]), pa.array(ids_of[row, column])], names=["win", "score", "vec_id"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("win").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(buckets: DataFrame, total: int, windows: Windows, k: int, same: bool) -> DataFrame:
    """win, rank, score, vec_id: for each window its first ``k`` candidates of the same label (or another) within its limits.

    ``buckets`` are the ``total`` ranked ones. Every pass over a range of them is a scan; what leaves a
    task is at most ``k`` rows a window.
    """
    width, n = windows.vectors.shape[1], len(windows.owner)
    shared = buckets.sparkSession.sparkContext.broadcast(windows)
    norms = windows.norms()[windows.owner]
    kth, kth_id = np.full(n, _NONE), np.full(n, np.iinfo(np.int64).max)
    found, begin = None, 0
    while begin < total or found is None:
        end = begin + max(FIRST, GROWTH * begin)
        limit = np.maximum(windows.low, kth)
        open_ = (windows.low <= windows.high) & (norms > 0)
        # The least norm that any window asks for; where it isn't positive every bucket is wanted.
        least = 0.0 if (limit[~open_ & (windows.low <= windows.high)] <= 0).any() else min((limit[open_] / norms[open_]).min(initial=np.inf), 1e18)
        wanted = buckets.filter((F.col("rank") >= begin) & (F.col("rank") < end) & (F.col("top") >= (max(0.0, least) ** 2) * (1 - 1e-9)))
        new = wanted.select("top", "ids", "labels", "vectors").mapInArrow(_search(shared, kth, kth_id, k, same, width), "win int, score long, vec_id long")
        found = staged(_first(new if found is None else found.drop("rank").union(new), k), "found")
        begin = end
        if begin < total:
            for win, score, vec_id in found.filter(F.col("rank") == k).select("win", "score", "vec_id").collect():
                kth[win], kth_id[win] = score, vec_id
    return found


def mine(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the
    rows whose vec_id is divisible by 100; scores are inner products of the entries' floor(256 * x); an
    anchor's positives are the first 5 rows of its label. For each of them come the first 10 rows of
    other labels that score from 30 to 90 per cent of it. Higher scores are first, then smaller ids.
    Labels of rows whose vec_id is divisible by 7 move on by one, modulo 10.

    Rows with a null vec_id or label, a null vector or a null or non-finite entry take no part, nor do
    vectors of another length than the commonest (of several, the greatest). Entries beyond 2**27 either
    way count as that. A row that is repeated whole counts once; rows that share an id, but not all, are
    rows of their own, and never each other's positives or negatives. Further columns are ignored; a
    table without anchors, or anchors without positives, give no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole("v"))
    width = usual_length(rows, "v")
    moved = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    rows = rows.filter(F.size("v") == width).select("vec_id", moved.cast("int").alias("label"), floored("v", SCALE, BOUND).cast("array<int>").alias("q"))
    buckets = norm_buckets(rows, width)
    anchors = _anchors(buckets, width)
    total, some = buckets.count(), anchors.count()
    out = []
    for begin in range(0, some, PASS):
        held = anchors.filter((F.col("pos") >= begin) & (F.col("pos") < begin + PASS)).orderBy("pos").select("anchor_id", "label", "vector").collect()
        ids, labels = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int32)
        vectors = np.frombuffer(b"".join(bytes(r[2]) for r in held), np.int32).reshape(len(held), width)
        every = np.arange(len(held))
        nearest = search(buckets, total, Windows(vectors, ids, labels, every, np.full(len(held), _NONE + 1), np.full(len(held), np.iinfo(np.int64).max)), POSITIVES, True)
        positives = nearest.select((F.col("win") * POSITIVES + F.col("rank") - 1).alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("win") + begin).alias("pos"))
        low, high = np.ones(len(held) * POSITIVES, np.int64), np.zeros(len(held) * POSITIVES, np.int64)
        for win, score in positives.select("win", "positive_score").collect():
            low[win], high[win] = -(-LOW * score // 100), HIGH * score // 100
        negatives = search(buckets, total, Windows(vectors, ids, labels, np.repeat(every, POSITIVES), low, high), NEGATIVES, False)
        named = positives.join(anchors.select("pos", "anchor_id"), "pos")
        out.append(negatives.select("win", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "win").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, out)


ORACLE = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 10
"""
