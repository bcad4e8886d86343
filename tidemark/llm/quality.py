"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and towards the pooled one. A
document's score comes from the difference of the classes' log densities, whose Mahalanobis terms
use Cholesky factors made once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, frugal, slices, staged, utf8
from .words import BLANKS, word_hashes

STATISTICS = ("log_words", "word_length", "upper", "digits", "stops", "dashes", "bars", "marks", "shouts", "other_signs", "high_bytes", "new_words", "line_length", "new_lines", "sign_words", "stutters")

#: Classes of bytes that are counted.
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()", b"-_/", b"|\\<>{}[]=", b"#$%&*@^~+`", b"!", bytes(range(0x80, 0x100)), b" \t\r\x0b\x0c", b"\n")):
    _CLASS[list(_bytes)] = _k + 1


def _share(part: float, whole: float, usual: float, weight: float = 40.0) -> float:
    """The logarithm of a share, drawn to the ``usual`` one where there is little to count."""
    return np.log((part + weight * usual) / (whole + weight) + 2e-4)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics of each text; an empty text has those of no counts at all."""
    block = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _CLASS[block]
    hashes, bounds = word_hashes(block, offsets, BLANKS)
    lines, line_bounds = word_hashes(block, offsets, _NEWLINE)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for i in range(len(out)):
        own = kinds[offsets[i] : offsets[i + 1]]
        count = np.bincount(own, minlength=12).astype(float)
        words, rows = hashes[bounds[i] : bounds[i + 1]], lines[line_bounds[i] : line_bounds[i + 1]]
        n, size = len(words), float(len(own))
        ends = own[:-1][(own[1:] >= 10)] if len(own) else own
        signs = float(np.count_nonzero((ends == 6) | (ends == 7) | (ends == 8)))
        stutters = float(np.count_nonzero(words[1:] == words[:-1]))
        out[i] = (
            np.log(n + 20), np.log((size - count[10] - count[11] + 50) / (n + 10)), _share(count[2], size, 0.03), _share(count[3], size, 0.003), _share(count[4], size, 0.025), _share(count[5], size, 0.001),
            _share(count[6], size, 0.0005), _share(count[7], size, 0.0005), _share(count[8], size, 0.0005), _share(count[0], size, 0.0005), _share(count[9], size, 0.03),
            _share(len(np.unique(words)), n, 0.7), np.log((size + 400) / (len(rows) + 2)), _share(len(np.unique(rows)), len(rows), 1.0, 4.0), _share(min(signs, n), n, 0.005), _share(stutters, n, 0.01),
        )
    return out


_NEWLINE = np.zeros(256, bool)
_NEWLINE[[0x0A, 0x0D]] = True


@frugal
def _features(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            values = statistics(data, offsets[i : j + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(STATISTICS)), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), lists], names=["doc_id", "text_key", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and the statistics of every whole text, one row per input row; null reads as empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return texts.mapInArrow(_features, "doc_id long, text_key long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors of the inverse covariances, and log densities' constants, by class."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        terms = [c - 0.5 * (((x - m) @ w) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return terms[1] - terms[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds per statistic as a number from 0 to 1; 0.5 is even odds."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / x.shape[1], -500, 500)))


def fit(labelled: DataFrame, shrink: float = 0.05, pool: float = 0.05) -> Discriminant:
    """A discriminant from rows of (stats, label), label 0 or 1; rows with a null are left out.

    All rows count: each task sums its rows' moments, and only those few numbers meet. A class
    without rows takes the pooled moments (or standard ones, without any rows), so that the score is
    then 0.5 or near it.
    """
    size = len(STATISTICS)

    def moments(frames):
        total = np.zeros((2, 1 + size + size * size))
        for frame in frames:
            x, y = np.array(frame["stats"].tolist(), float).reshape(-1, size), frame["label"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                if len(own):
                    total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pd.DataFrame({"moments": [total.ravel()]})

    rows = labelled.filter("stats IS NOT NULL AND label IN (0, 1)").select("stats", F.col("label").cast("int").alias("label"))
    sums = rows.mapInPandas(moments, "moments array<double>").select(F.posexplode("moments").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * (1 + size + size * size))
    for at, v in sums:
        flat[at] = v
    total = flat.reshape(2, -1)
    both = total.sum(axis=0)

    def shape(t):
        if t[0] < 2:
            return np.zeros(size), np.eye(size)
        mean = t[1 : 1 + size] / t[0]
        return mean, t[1 + size :].reshape(size, size) / t[0] - np.outer(mean, mean)

    pooled = shape(both)
    means, whiten, constants = [], [], []
    for t in total:
        mean, cov = shape(t) if t[0] >= 2 else pooled
        cov = (1 - pool) * cov + pool * pooled[1]
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-3 * np.eye(size)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor).T)
        constants.append(np.log((t[0] + 1) / (both[0] + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(constants))


def with_scores(stats: DataFrame, model: Discriminant) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array(x.tolist(), float).reshape(-1, len(STATISTICS))))

    return stats.withColumn("score", score("stats"))


def held_out_fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = staged(document_statistics(docs), "stats")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(~held_out_fold())
    return with_scores(stats, fit(stats.join(marks, "doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality of every whole text: doc_id, held_out, score and predicted, one row per input row.

    The discriminant learns ``labels.quality`` of the documents outside the held-out fold, by their
    statistics alone. Null doc_ids are never held out, and never labelled. A null or empty text has
    a score as any other. Repeated rows and repeated labels count each time. Further columns are
    ignored; an empty table gives an empty result.
    """
    return _scored(docs, labels).select("doc_id", F.coalesce(held_out_fold(), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns.

    Each row is judged by its own text, also where doc_ids repeat or are null; columns may have any
    names.
    """
    bad = _scored(docs, labels).filter("predicted = 0").select("doc_id", "text_key").distinct()
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_key"))
    return boxed(docs).join(bad, same, "left_anti").select("row.*")
