"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard verification.

Two permutations of the universe make the whole signature. The first spreads a document's shingles;
the second, shifted circularly by k, gives coordinate k. Rows of coordinates make bands; documents
that agree in a band share a bucket. In every bucket each member meets one hub, chosen at random
per bucket, so that the pairs grow with the documents and not with the square of a group's size.
Buckets whose members are not all in one component after that are searched further: first against
the member that has most in common with the others, then by the rarest shingles of the members that are still
apart: similar sets share one of a set's rarest fifth, whatever else they and all others share. What can
be similar is bounded exactly: shingles that only one of the searched sets has are in no overlap, and
an overlap is at most the sum, over the parts of the universe, of the smaller count. All pairs are
confirmed on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, frugal, slices, staged, utf8
from .components import components
from .words import mix, shingle_sets

#: Words in a shingle.
WIDTH = 4
#: Bands of rows: a pair of similarity 0.8 shares no band with probability (1 - 0.8**7)**56 < 2e-6.
BANDS, ROWS = 56, 7
#: The universe that shingle hashes are folded to; folding only raises similarities.
UNIVERSE = 1 << 20

#: Parts of the universe in which overlaps are bounded one by one.
PARTS = 64

#: Sets that meet in one task at most at one shingle, of those outside the head's component and of all.
LEFT, RIGHT = 4096, 512

_SIGNATURE = "doc_id long, text_key long, n_shingles long, h1 long, h2 long, bands array<long>"


class Circulant:
    """Signatures of shingle sets from two permutations, the second one shifted circularly."""

    def __init__(self, coordinates: int, universe: int = UNIVERSE, seed: int = 7):
        random = np.random.default_rng(seed)
        self.coordinates, self.universe = coordinates, universe
        self.first = random.permutation(universe).astype(np.uint32)
        second = random.permutation(universe).astype(np.uint32)
        turned = np.concatenate([second, second[:coordinates]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(turned, coordinates)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """min over the set of second[(first[x] + k) mod universe], for k = 0, 1, ..."""
        places = self.first[hashes % np.uint64(self.universe)]
        least = np.full(self.coordinates, self.universe, np.uint32)
        for i in range(0, len(places), 256):
            np.minimum(least, self.shifted[places[i : i + 256]].min(axis=0), out=least)
        return least


def _sign(width: int, bands: int, rows: int, signer):
    @frugal
    def run(batches):
        circulant = signer(bands * rows)
        weights = (mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)).reshape(bands, rows)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for i, j in slices(offsets):
                size, h1, h2, keys = [], [], [], []
                for own in shingle_sets(data, offsets[i : j + 1], width):
                    size.append(len(own))
                    h1.append((own * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))
                    h2.append(mix(own ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).view(np.int64))
                    if len(own):
                        signature = circulant(own).astype(np.uint64).reshape(bands, rows)
                        keys.append(mix((signature * weights).sum(axis=1, dtype=np.uint64)).view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], names=["doc_id", "text_key", "n_shingles", "h1", "h2", "bands"])

    return run


def _sets(width: int):
    @frugal
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            nodes = batch.column(0)
            for i, j in slices(offsets):
                own = [x.view(np.int64) for x in shingle_sets(data, offsets[i : j + 1], width)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                counts = np.concatenate([np.bincount(x & (PARTS - 1), minlength=PARTS) for x in own]).astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) + 1, PARTS), pa.int32()), pa.array(counts))
                yield pa.RecordBatch.from_arrays([nodes.slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(own))), parts], names=["node", "shingles", "parts"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union, on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(100 * shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _relabelled(owner: DataFrame, links: DataFrame) -> DataFrame:
    """(node, own) after ``links`` (a, b) have joined components; ``own`` is a component's smallest node."""
    ends = links.join(owner.toDF("a", "own_a"), "a").join(owner.toDF("b", "own_b"), "b").select("own_a", "own_b")
    joined = components(ends, "own_a", "own_b").toDF("own", "least")
    return owner.join(joined, "own", "left").select("node", F.coalesce("least", "own").alias("own"))


def _open(members: DataFrame, owner: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that hold several components."""
    rows = members.join(owner, "node")
    mixed = rows.groupBy("bucket").agg(F.min("own").alias("least"), F.max("own").alias("most")).filter("least <> most").select("bucket")
    return rows.join(mixed, "bucket", "left_semi")


def _possible(similarity: int, n_x: str, n_y: str, overlap: Column) -> Column:
    """Whether sets of n shingles that have ``overlap`` in common at most can reach the similarity."""
    return 100 * overlap >= similarity * (F.col(n_x) + F.col(n_y) - overlap)


def _prefixes(rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(node, key, place): the rarest shingles of each searched set, as many as decide, with their places.

    All sets order their shingles alike, by how many of the searched sets have them. Sets of n that are
    similar enough share at least ``need`` = n * similarity / 100 shingles, so that they share one of their
    first n - need + 1. A shingle that no other searched set has counts as a place, but meets nobody.
    """
    searched = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    counts = searched.groupBy("s").agg(F.count("*").alias("held"))
    ranked = searched.join(counts, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "s"))).alias("ranked"))
    first = F.size("ranked") - F.floor((F.size("ranked") * F.lit(similarity) + 99) / 100).cast("int") + 1
    placed = ranked.select("node", F.posexplode(F.slice("ranked", F.lit(1), first)).alias("place", "r"))
    return placed.filter("r.held > 1").select("node", F.col("r.s").alias("key"), "place")


def _pairs_apart(rows: DataFrame, sets: DataFrame, shares: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of searched sets that are in different components and can be similar at all.

    ``rows`` has node, own (its component), n and v; ``sets`` node and shingles; ``shares`` node and c.
    Sets meet at the shingles of their prefixes, so that what many sets share brings them together
    only where they have nothing rarer. A pair that meets first at places i and j has at most
    min(n_x - i, n_y - j) in common. Of those that meet at a shingle only members outside the component of
    its head ask; they meet all others, in a grid, so that no task has more than some LEFT of those that
    ask and RIGHT of the others, however many sets share it.
    """
    rows = staged(rows.select("node", "own", "n", "v").distinct(), "open")
    rows = staged(_prefixes(rows, sets, similarity).join(rows, "node"), "prefixes")
    heads = rows.groupBy("key").agg(F.max(F.struct(F.col("v") / F.col("n"), "node", "own")).alias("head"), F.count("*").alias("members")).select("key", F.col("head.own").alias("of_head"), "members")
    asking = rows.join(heads, "key").filter("own <> of_head").groupBy("key").agg(F.count("*").alias("asking"))
    grid = heads.join(asking, "key").select("key", "of_head", F.ceil(F.col("asking") / LEFT).alias("rows"), F.ceil(F.col("members") / RIGHT).alias("columns"))
    rows = rows.join(grid, "key")
    cell = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = rows.filter("own <> of_head").withColumn("i", cell("rows")).withColumn("j", every("columns"))
    x = x.select("key", "i", "j", F.col("node").alias("x"), F.col("own").alias("own_x"), F.col("n").alias("n_x"), F.col("v").alias("v_x"), F.col("place").alias("place_x"))
    y = rows.withColumn("j", cell("columns")).withColumn("i", every("rows"))
    y = y.select(F.col("key").alias("_key"), F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("node").alias("y"), F.col("own").alias("own_y"), "of_head", F.col("n").alias("n_y"), F.col("v").alias("v_y"), F.col("place").alias("place_y"))
    apart = (F.col("own_x") != F.col("own_y")) & ((F.col("own_y") == F.col("of_head")) | (F.col("x") < F.col("y")))
    left = F.least("v_x", "v_y", F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    met = x.join(y, (F.col("key") == F.col("_key")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & apart & _possible(similarity, "n_x", "n_y", left))
    met = met.select("x", "y", "n_x", "n_y").distinct().join(shares.toDF("x", "c_x"), "x").join(shares.toDF("y", "c_y"), "y")
    overlap = sum((F.least(F.get("c_x", F.lit(k)), F.get("c_y", F.lit(k))) for k in range(1, PARTS)), F.least(F.get("c_x", F.lit(0)), F.get("c_y", F.lit(0))))
    return met.filter(_possible(similarity, "n_x", "n_y", overlap)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _classes(docs: DataFrame, width: int, similarity: int, bands: int, rows: int, signer) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, text_key, n_shingles, h1, h2, bands), and the distinct shingle sets
    (h1, h2, n_shingles, doc_id and text_key of the first row that has it, own), where ``own`` names
    the set's class.

    The sets are the nodes, whichever rows and doc_ids have them, and are numbered for the purpose.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = staged(texts.select("doc_id", "text", "text_key").mapInArrow(_sign(width, bands, rows, signer), _SIGNATURE), "signed")
    first = F.min_by(F.struct("doc_id", "text_key", "bands"), F.struct("doc_id", "text_key"))
    nodes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n_shingles").agg(first.alias("s"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n_shingles", "s.*"), "nodes")

    entries = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node", "bucket")).alias("hub")).filter("members > 1")
    crowded = staged(entries.join(hubs, "bucket"), "crowded")

    first = staged(crowded.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    meeting = crowded.select("node").distinct()
    wanted = nodes.join(meeting, "node", "left_semi").select("node", "doc_id", "text_key")
    sets = texts.join(wanted, ["doc_id", "text_key"]).select("node", "text")
    sets = staged(sets.mapInArrow(_sets(width), "node long, shingles array<long>, parts array<int>").dropDuplicates(["node"]), "sets")
    owner = staged(_relabelled(meeting.select("node", F.col("node").alias("own")), staged(_verified(first, sets, similarity), "links")), "owner")

    # What of each set is in any other set of the open buckets bounds its overlap with all of them.
    waiting = staged(_open(crowded.filter("members > 2"), owner), "open")
    searched = sets.join(waiting.select("node").distinct(), "node", "left_semi")
    once = searched.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    by_part = F.array(*[F.count_if(F.pmod("s", F.lit(PARTS)) == k).cast("int") for k in range(PARTS)])
    alone = once.groupBy("node").agg(F.count("*").alias("u"), by_part.alias("alone"))
    common = F.when(F.col("alone").isNull(), F.col("parts")).otherwise(F.zip_with("parts", "alone", lambda a, b: a - b))
    shares = searched.select("node", F.size("shingles").alias("n"), "parts").join(alone, "node", "left")
    shares = staged(shares.select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("v"), common.alias("c")).filter(100 * F.col("v") >= similarity * F.col("n")), "shares")
    waiting = staged(waiting.select("bucket", "node").join(shares.drop("c"), "node"), "open")

    # A second hub for each open bucket: the member that has most in common with others.
    open_rows = waiting.join(owner, "node")
    heads = open_rows.groupBy("bucket").agg(F.max(F.struct(F.col("v") / F.col("n"), "node", "own", "n", "v")).alias("head")).select("bucket", "head")
    second = open_rows.join(heads, "bucket").filter((F.col("own") != F.col("head.own")) & _possible(similarity, "n", "head.n", F.least("v", "head.v")))
    second = second.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = staged(second, "pairs")
    owner = staged(_relabelled(owner, staged(_verified(second, sets, similarity), "links")), "owner")

    # What is still apart meets outright, where the bound lets it.
    third = _pairs_apart(_open(waiting, owner), sets, shares.select("node", "c"), similarity).join(first.union(second), ["a", "b"], "left_anti")
    owner = _relabelled(owner, staged(_verified(third, sets, similarity), "links"))
    return signed, staged(nodes.drop("bands").join(owner, "node", "left").withColumn("own", F.coalesce("own", "node")), "classes")


def link_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = 80, bands: int = BANDS, rows: int = ROWS, signer=Circulant) -> DataFrame:
    """Near-duplicate classes of documents by word shingles.

    ``docs`` has doc_id and text; further columns are ignored. Returns one row per input row:
    doc_id, n_shingles (size of its set of lower-cased ``width``-word shingles), component_id
    (smallest doc_id that links of at least ``similarity`` per cent reach) and kept (whether that is
    the row's own). Equal sets are one node from the start, so copies are never paired.

    A null or wordless text has an empty set and links with nothing. A text of fewer than ``width``
    words is one shingle. Hashes are folded to 2**20 places for the signatures: sets of very many more shingles share
    all their buckets, which costs time; links are confirmed on whole sets all the same. A row with a null doc_id links with nothing: its component_id is null and
    it is kept. Rows that repeat a doc_id with other texts are linked by their texts alone, each in
    its own class. An empty table gives an empty result.
    """
    signed, sets = _classes(docs, width, similarity, bands, rows, signer)
    names = sets.groupBy("own").agg(F.min("doc_id").alias("component_id"))
    named = sets.join(names, "own").select("h1", "h2", "n_shingles", "component_id")
    linked = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate class is kept.

    Of each class the text of the smallest doc_id stays (of several under it the one with the smallest
    hash), in one row where rows repeat it. Texts without words and rows with a null doc_id are in no
    class: these stay, but rows that repeat such a text under the same doc_id stay once. All columns
    stay as they are, whatever their names.
    """
    signed, sets = _classes(docs, width, similarity, BANDS, ROWS, Circulant)
    first = sets.groupBy("own").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.*")
    empty = signed.filter("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct()
    stay = first.union(empty).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    rows = boxed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_key"))
    one = rows.join(stay, (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    return one.select("row.*").union(rows.filter("doc_id IS NULL").select("row.*"))


ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM base
), sets AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM runs),
nodes AS (SELECT h, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM sets WHERE n > 0 GROUP BY h),
flat AS (SELECT node, n, unnest(s) AS x FROM nodes),
pairs AS (
  SELECT a.node AS u, b.node AS v, count(*) AS c, any_value(a.n) AS nu, any_value(b.n) AS nv
  FROM flat a JOIN flat b ON a.x = b.x AND a.node < b.node GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs WHERE 100 * c >= 80 * (nu + nv - c) UNION ALL SELECT v, u FROM pairs WHERE 100 * c >= 80 * (nu + nv - c)
), reach AS (
  SELECT u AS node, u AS r FROM links UNION SELECT links.v, reach.r FROM reach JOIN links ON links.u = reach.node
), least AS (SELECT node, min(r) AS r FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(sets.n AS BIGINT) AS n_shingles, CAST(coalesce(least.r, nodes.node, sets.doc_id) AS BIGINT) AS component_id,
  sets.doc_id = coalesce(least.r, nodes.node, sets.doc_id) AS kept
FROM sets LEFT JOIN nodes ON nodes.h = sets.h AND sets.n > 0 LEFT JOIN least ON least.node = nodes.node
"""
