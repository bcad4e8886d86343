"""Benchmark decontamination by a positional inverted index over the training tokens.

The index is a table of segments, each the postings of some documents: for every term that may be in
the test set its ascending word positions. It is built once, whatever the test set's size. A window of
a test item is looked up from its rarest term in the corpus: the other terms' position lists, moved by
their offsets, are intersected with the candidates in the order of rarity, so that most lists are
never read. What is left is followed word by word, to the nearest next one, from the rarest term both
ways: without a gap it is the exact phrase, with few foreign words in between a proximity match.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, frugal, slices, staged, utf8
from .words import NOT_WORD, word_hashes

#: Bytes of text in a segment of the index.
SEGMENT_BYTES = 4 << 20
#: Bytes of test items that are searched for at once; a larger test set takes several passes over the index.
BLOCK_BYTES = 8 << 20
#: Bits of a term's hash by which the index leaves out what the test set can't ask for: 2 MB, whatever the test set.
FILTER_BITS = 24

_SEGMENT = "segment long, doc_ids array<long>, text_keys array<long>, n_words array<int>, terms array<long>, sizes array<int>, positions array<int>"
_HITS = "segment long, ord int, hits array<int>, items array<long>, near array<long>"
_FAR = 1 << 40


def _build(known, gap: int):
    """Rows of the index; ``known`` is the broadcast filter of terms."""

    @frugal
    def run(batches):
        wanted, at = np.unpackbits(known.value).view(bool), 0
        shift = np.uint64(65 - len(wanted).bit_length())
        part = TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, keys = batch.column(0), batch.column(2)
            for i, j in slices(offsets, SEGMENT_BYTES):
                postings, counts = [], []
                base, word = 0, 0
                for a, b in slices(offsets[i : j + 1]):
                    hashes, bounds = word_hashes(data, offsets[i + a : i + b + 1], NOT_WORD)
                    own = np.flatnonzero(wanted[hashes >> shift])
                    doc = np.searchsorted(bounds, own, "right") - 1
                    postings.append((hashes[own].view(np.int64), own + word + (doc + base) * gap))
                    counts.append(np.diff(bounds))
                    base, word = base + b - a, word + len(hashes)
                term, position = (np.concatenate(x) for x in zip(*postings, strict=True))
                order = np.argsort(term, kind="stable")
                terms, sizes = np.unique(term, return_counts=True)
                row = [part << 32 | at, ids[i:j].to_pylist(), keys[i:j].to_pylist(), np.concatenate(counts), terms, sizes, position[order]]
                kinds = [pa.int64(), *[pa.list_(x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())]]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _SEGMENT.split(", ")])
                at += 1

    return run


def _items(rows) -> list[tuple[int, np.ndarray]]:
    """(item_id, terms) of the items that have words."""
    data, offsets = utf8(pa.array([r["text"] for r in rows], pa.string()))
    hashes, bounds = word_hashes(data, offsets, NOT_WORD)
    return [(r["item_id"], hashes[bounds[k] : bounds[k + 1]].view(np.int64)) for k, r in enumerate(rows) if bounds[k] < bounds[k + 1]]


def _probes(items: list[tuple[int, np.ndarray]], frequency: dict[int, int], width: int) -> dict[int, list[tuple]]:
    """By rarest term: (item_id, its place, first window, end window, terms, places by rarity, window size)."""
    out: dict[int, list[tuple]] = {}
    for item_id, terms in items:
        size = min(width, len(terms))
        rarity = np.array([frequency.get(t, 0) for t in terms.tolist()])
        windows = np.lib.stride_tricks.sliding_window_view(rarity, size)
        anchors = windows.argmin(axis=1) + np.arange(len(windows))
        for anchor in np.unique(anchors):
            own = np.flatnonzero(anchors == anchor)
            if rarity[anchor] > 0:  # else some term of these windows is nowhere in the corpus
                # Windows with one rarest term are consecutive.
                near = np.arange(own[0], own[-1] + size)
                out.setdefault(int(terms[anchor]), []).append((item_id, int(anchor), int(own[0]), int(own[-1]) + 1, terms, near[np.argsort(rarity[near], kind="stable")].tolist(), size))
    return out


def _followed(lists: dict[int, np.ndarray], terms: np.ndarray, anchor: int, low: int, end: int, found: np.ndarray) -> np.ndarray:
    """Where each of the words low:end stands nearest to the one before it, going out from the anchor."""
    at = np.empty((end - low, len(found)), np.int64)
    at[anchor - low] = found
    for k in range(anchor + 1, end):
        other, last = lists[int(terms[k])], at[k - 1 - low]
        i = np.searchsorted(other, last, "right")
        at[k - low] = np.where(i < len(other), other[np.minimum(i, len(other) - 1)], _FAR)
    for k in range(anchor - 1, low - 1, -1):
        other, last = lists[int(terms[k])], at[k + 1 - low]
        i = np.searchsorted(other, last) - 1
        at[k - low] = np.where(i >= 0, other[np.maximum(i, 0)], -_FAR)
    return at


def _search(probes, slack: int, gap: int):
    @frugal
    def run(batches):
        asked = probes.value
        anchors = np.array(sorted(asked), np.int64)
        for batch in batches:
            for segment, n_words, terms, sizes, positions in zip(*batch.columns, strict=True):
                terms = terms.values.to_numpy()
                both = np.intersect1d(terms, anchors, assume_unique=True)
                if not len(both):
                    continue
                n_words = n_words.values.to_numpy()
                positions = positions.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes.values.to_numpy())
                lists = dict(zip(terms.tolist(), np.split(positions, ends[:-1]), strict=True))
                first = np.cumsum(np.concatenate([[0], n_words[:-1]])) + np.arange(len(n_words)) * gap
                hits: dict[int, list] = {}
                items: dict[int, set] = {}
                near_items: dict[int, set] = {}
                for term in both.tolist():
                    for item_id, anchor, low, high, item, near, size in asked[term]:
                        found = lists[term]
                        alive = np.ones((len(found), high - low), bool)
                        for place in near:
                            if place == anchor:
                                continue
                            other = lists.get(int(item[place]))
                            ok = np.zeros(len(found), bool)
                            if other is not None:
                                wanted = found + (place - anchor)
                                at = np.searchsorted(other, wanted - slack * (place < anchor))
                                ok = (at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= wanted + slack * (place > anchor))
                            alive[~ok, max(0, place - size + 1 - low) : place + 1 - low] = False
                            keep = alive.any(axis=1)
                            if not keep.all():
                                found, alive = found[keep], alive[keep]
                                if not len(found):
                                    break
                        if not len(found):
                            continue
                        reached = np.flatnonzero(alive.any(axis=0))
                        at = _followed(lists, item, anchor, low + int(reached[0]), low + int(reached[-1]) + size, found)
                        for w in reached.tolist():
                            begin = at[w - reached[0]]
                            span = at[w - reached[0] + size - 1] - begin
                            for k in np.flatnonzero(alive[:, w] & (span < size + slack)).tolist():
                                doc = int(np.searchsorted(first, found[k], "right")) - 1
                                near_items.setdefault(doc, set()).add(item_id)
                                if span[k] == size - 1:
                                    start = int(begin[k] - first[doc])
                                    hits.setdefault(doc, []).append((start, start + size))
                                    items.setdefault(doc, set()).add(item_id)
                if near_items:
                    docs = sorted(near_items)
                    spans = [np.unique(np.concatenate([np.arange(a, b) for a, b in set(hits[d])])) if d in hits else [] for d in docs]
                    of = lambda found: pa.array([sorted(found.get(d, ())) for d in docs], pa.list_(pa.int64()))
                    columns = [pa.array([segment.as_py()] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array(spans, pa.list_(pa.int32())), of(items), of(near_items)]
                    yield pa.RecordBatch.from_arrays(columns, names=["segment", "ord", "hits", "items", "near"])

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = 10, slack: int = 1) -> DataFrame:
    """Occurrences of test passages in documents: one row per document.

    Words are runs of letters and digits (and of all beyond ASCII) after A-Z are lower-cased. A
    window is ``width`` consecutive words of an item; an item of fewer, but not none, is one window.
    A window occurs where its words stand in sequence (exact phrase), and nearly so where they stand in
    order with at most ``slack`` foreign words in between (proximity).

    Returns doc_id, text_key (a hash of the text), n_words, hits (ascending word places inside any
    exact occurrence), items (sorted item_ids with one) and near (sorted item_ids with an exact or
    near one). Null texts have no words; null item_ids are ignored. Repeated rows and repeated
    doc_ids give a row each. Empty tables are fine on either side. Further columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    asked = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    if blocks > 1:
        # In the order of blocks, so that each is read from its own part of the table.
        asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartitionByRange("block").sortWithinPartitions("block"), "items")
    items = lambda block: _items((asked.filter(F.col("block") == block) if blocks > 1 else asked).orderBy("item_id", "text").collect())

    wanted = np.zeros(1 << FILTER_BITS, bool)
    kept = None
    for block in range(blocks):
        kept = items(block)
        for _, terms in kept:
            wanted[terms.view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    gap = width + slack + 1
    index = staged(texts.mapInArrow(_build(spark.sparkContext.broadcast(np.packbits(wanted)), gap), _SEGMENT), "index")
    counted = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("n"))
    counted = staged(counted, "terms") if blocks > 1 else counted

    found = None
    for block in range(blocks):
        own = items(block) if blocks > 1 else kept
        # A block's terms are as many as its bytes allow, whatever the corpus.
        vocabulary = spark.createDataFrame(pa.table({"term": np.unique(np.concatenate([np.zeros(0, np.int64), *[t for _, t in own]]))}))
        frequency = dict(counted.join(vocabulary, "term").select("term", "n").collect())
        probes = spark.sparkContext.broadcast(_probes(own, frequency, width))
        hits = index.select("segment", "n_words", "terms", "sizes", "positions").mapInArrow(_search(probes, slack, gap), _HITS)
        found = hits if found is None else found.union(hits)
    if blocks > 1:
        merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near")]
        found = found.groupBy("segment", "ord").agg(*merged)
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("ord", "d")).select("segment", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.n_words").cast("long").alias("n_words"))
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<int>"), ("items", "array<long>"), ("near", "array<long>"))]
    return every.join(found, ["segment", "ord"], "left").select("doc_id", "text_key", "n_words", *none)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no test passage occurs exactly, with all their columns.

    Each row is judged by its own text, also where doc_ids repeat or are null; columns may have any
    names.
    """
    bad = find_passages(docs, benchmark, width).filter(F.size("hits") > 0).select("doc_id", "text_key").distinct()
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_key"))
    return boxed(docs).join(bad, same, "left_anti").select("row.*")


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n),
found AS (
  SELECT doc_id, i, f.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM places) f JOIN windows USING (p, n)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1
), nearly AS (
  SELECT doc_id, item_id FROM (
    SELECT doc_id, n, array_to_string(list_concat(w[i:i + j - 2], w[i + j:i + n]), ' ') AS p
    FROM (SELECT *, unnest(range(2, n + 1)) AS j FROM places WHERE i + n <= len(w))
  ) JOIN windows USING (p, n) UNION SELECT doc_id, item_id FROM found
), near_named AS (
  SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS near FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM nearly) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near, '')) AS near_items_sha256
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near_named USING (doc_id)
"""
