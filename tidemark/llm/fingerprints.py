"""Document fingerprints: MinHash over word shingles by universal hash functions, in numpy.

Coordinate k of a fingerprint is the least value of (a_k * x + b_k) mod 2**64 over the document's
shingle hashes x, mixed and cut to 16 bits. Least values of long texts all begin with zeros; mixed,
two that differ agree with probability 2**-16 at any length. Two fingerprints agree in about as many
coordinates as their shingle sets have Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, staged, utf8
from .neardup import link_duplicates
from .words import mix, shingle_sets

COORDINATES = 128
WIDTH = 5


class Universal:
    """MinHash signatures from ``coordinates`` multiply-add hash functions."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = 11):
        random = np.random.default_rng(seed)
        self.coordinates = coordinates
        self.times = random.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = random.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.coordinates, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 256):
            np.minimum(least, (hashes[i : i + 256, None] * self.times + self.plus).min(axis=0), out=least)
        return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _signatures(texts: list[bytes], universal: Universal) -> np.ndarray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    data, out = np.frombuffer(b"".join(texts), np.uint8), []
    for i, j in slices(offsets):
        out += [universal(x) for x in shingle_sets(data, offsets[i : j + 1], WIDTH)]
    return np.array(out, np.uint16).reshape(len(texts), universal.coordinates)


def _edit(text: str, after: str) -> bytes:
    """The last half of ``text`` gives way to as much of the start of ``after``, or all of it."""
    half = len(text) // 2
    return (text[: len(text) - half] + after[:half]).encode()


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint (hex) of every whole text of ``docs``.

    A null text reads as empty; all texts without words have one and the same fingerprint, and so
    have equal texts. Further columns are ignored; repeated rows give repeated results.
    """

    def run(batches):
        universal = Universal()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                own = [universal(x).astype(">u2").tobytes().hex() for x in shingle_sets(data, offsets[i : j + 1], WIDTH)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def link_by_fingerprint(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """Near-duplicate classes by these fingerprints: bands joined in Spark, Jaccard verified.

    As ``neardup.link_duplicates``, with universal hash functions in place of the two permutations.
    """
    return link_duplicates(docs, WIDTH, similarity, signer=Universal)


_COMPARED = "place long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _compare(batches):
    """Rows in doc_id order. The partition's last row can't know its successor: it is given with its
    text, at odd places; so is the first row, at even places."""
    universal, part = Universal(), TaskContext.get().partitionId()
    before, first = None, True
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size < 1 << 20):
                size += len(texts[end])
                end += 1
            block = list(zip(ids[at:end], texts[at:end], strict=True))
            if first:
                yield _batch([(2 * part, *block[0][:1], *[None] * 6, block[0][1])])
                first = False
            block = ([before] if before else []) + block
            before = block[-1]
            yield _batch(_compared(block, universal))
            at = end
    if before:
        yield _batch([(2 * part + 1, before[0], *[None] * 6, before[1])])


def _compared(block: list[tuple], universal: Universal) -> list[tuple]:
    if len(block) < 2:
        return []
    texts = [x for _, x in block]
    edited = [_edit(x, y) for x, y in zip(texts, texts[1:], strict=False)]
    own, other = _signatures([x.encode() for x in texts], universal), _signatures(edited, universal)
    near_edited, near_next = (own[:-1] == other).mean(axis=1), (own[:-1] == own[1:]).mean(axis=1)
    show = lambda x: x.astype(">u2").tobytes().hex()
    return [(None, block[i][0], len(texts[i]), hashlib.sha256(edited[i]).hexdigest(), show(own[i]), show(other[i]), float(near_edited[i]), float(near_next[i]), None) for i in range(len(edited))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    names = [x.split()[0] for x in _COMPARED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text of a document: the last floor(n_chars / 2) code points give way to the first as
    many (or all) of the next document's, by ascending doc_id; after the last comes the first. Rows
    with a null doc_id come first; rows of one doc_id are in the order of their texts' hashes. A single
    row is its own successor. A null text reads as empty; an empty table gives an empty result.

    The rows are dealt out by ranges of doc_id, and of one doc_id by ranges of the hash, repeated rows
    too; only the first and last row of each partition meet in a second, small step.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "key", "tie"]
    rows = rows.withColumn("key", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = staged(ranged.select("doc_id", "text").mapInArrow(_compare, _COMPARED), "compared")

    ends = found.filter("place IS NOT NULL").select("place", "doc_id", "text")
    order = Window.orderBy("place")  # two rows a partition
    successor = F.coalesce(F.lead("place").over(order), F.first("place").over(order))
    links = ends.select("place", successor.alias("successor")).filter("place % 2 = 1")
    starts = ends.select(F.col("place").alias("successor"), F.col("text").alias("after"))
    last = ends.join(links, "place").join(starts, "successor").select("doc_id", "text", "after")

    def pairs(batches):
        universal = Universal()
        for batch in batches:
            for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch(_compared([(doc_id, text), (None, after)], universal))

    return found.filter("place IS NULL").union(last.mapInArrow(pairs, _COMPARED)).drop("place", "text")
