"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first, and gives out its nearly full bins. The
underfull bins go on as items: they are dealt into groups of bounded size and packed again, level by
level, until one group holds all that can still be put together.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, staged

CAPACITY = 2048
END = 0
#: Pieces that a task packs at once, bins that a group merges at once, and the share of free places with
#: which a bin counts as nearly full.
LOCAL_BLOCK, GROUP, NEARLY_FULL = 1 << 20, 100_000, 1 / 128

_PIECE = "doc_id long, piece int, start long, length long, ids binary"

# Words of these letters, with or without a tail of these signs, are normalised by lower-casing alone
# and fall into just two tokens' worth of text; all other chunks go through the whole tokenizer.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)\Z")


class ChunkTokenizer:
    """Token ids of texts, looked up by chunk of text between ASCII white space.

    The tokenizer's rules never join what white space divides, so that a text's ids are those of its
    chunks in sequence. Chunks seen before come from a cache of bounded size.
    """

    limit = 400_000
    made: dict[str, "ChunkTokenizer"] = {}

    @classmethod
    def of(cls, path: str) -> "ChunkTokenizer":
        """The worker's own tokenizer for this file; it stays for the worker's later tasks, its caches don't."""
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model.tokenize
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): spelt.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(192, 256)])}
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = np.array([t.id for t in self.model(part.translate(self.letters))], "<u4").tobytes()
            if len(self.parts) >= self.limit:
                self.parts = {"": b""}
            self.parts[part] = ids
        return ids

    def _new(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        simple = _SIMPLE.match(text)
        if simple:
            return self._part(simple[1].lower()) + self._part(simple[2])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        chunks = text.split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            if len(self.chunks) + len(chunks) > self.limit:
                self.chunks = {}
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[i]
                    ids = self.chunks.get(chunk)
                    if ids is None:
                        ids = self._new(chunk)
                        if len(self.chunks) < self.limit:
                            self.chunks[chunk] = ids
                    found[i] = ids
        return b"".join(found)

    def forget(self) -> None:
        """Empties the caches."""
        self.chunks, self.parts = {}, {"": b""}


def _cut(tokenizer: str, capacity: int):
    @frugal
    def run(batches):
        encode, step = ChunkTokenizer.of(tokenizer), 4 * capacity
        names = [x.split()[0] for x in _PIECE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        try:
            for batch in batches:
                rows, size = [], 0
                texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "").cast(pa.large_binary())
                for doc_id, text in zip(batch.column(0), texts, strict=True):
                    doc_id, ids = doc_id.as_py(), encode(text.as_py()) + END.to_bytes(4, "little")
                    for k, i in enumerate(range(0, len(ids), step)):
                        own = ids[i : i + step]
                        rows.append((doc_id, k, i // 4, len(own) // 4, own))
                    size += len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        finally:
            encode.forget()

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as token pieces: doc_id, piece (from 0), start, length and ids (little-endian
    unsigned 32-bit numbers).

    A document's ids end with id 0. Only a document longer than ``capacity`` is cut, into pieces of
    ``capacity``; the last may be shorter. A null or empty text is the end id alone. Further columns
    are ignored; repeated rows give repeated pieces.
    """

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(tokenizer, capacity), _PIECE)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item: longest first, each into the fullest bin that still has room.

    Ties keep their order. The bins with r free places lie on stack r; a bit mask of the stacks that
    aren't empty gives the best one at once.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room = mask >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            own = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
        else:
            free, own = capacity, made
            made += 1
        bins[i], offsets[i] = own, capacity - free
        stacks[free - length].append(own)
        mask |= 1 << (free - length)
    return bins, offsets


def _local(capacity: int, block: int):
    @frugal
    def run(batches):
        # Bins are numbered through within a task, which has 40 bits for it.
        made, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def packed():
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            bins, offsets = best_fit(table["length"].to_numpy(), capacity)
            table = table.append_column("bin", pa.array(bins + made)).append_column("at", pa.array(offsets))
            made += int(bins.max()) + 1
            return table.to_batches(max_chunksize=100_000)

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, block - rows))
                rows += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if rows == block:
                    yield from packed()
                    held, rows = [], 0
        if rows:
            yield from packed()

    return run


def _merged(dealt: DataFrame, capacity: int) -> DataFrame:
    """(bin, into, at, filled): the bins (group, bin, fill) of each group packed best-fit once more."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, offsets = best_fit(frame["fill"].to_numpy(), capacity)
        first = pd.Series(frame["bin"].to_numpy()).groupby(bins).transform("first")
        filled = frame["fill"].groupby(bins).transform("sum")
        return pd.DataFrame({"bin": frame["bin"], "into": first, "at": offsets, "filled": filled})

    return dealt.groupBy("group").applyInPandas(merge, "bin long, into long, at long, filled long")


def _dealt(bins: DataFrame, level: int, groups: int, of: int | None = None) -> DataFrame:
    """Bins with a group each; of ``of`` shares, those of the first ``groups``. Each level deals afresh."""
    group = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(of or groups))
    return bins.select("bin", "fill", group.alias("group")).filter(F.col("group") < groups)


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, block: int = LOCAL_BLOCK) -> DataFrame:
    """``items`` with sequence_id and offset: which sequence each piece is in, and where.

    ``items`` has a long ``length`` of 1 to ``capacity`` and any further columns, which ride along,
    whatever their names; columns sequence_id and offset are replaced. Sequences are gapless from 0
    and never longer than ``capacity``. Equal items are packed one by one. An empty table gives an
    empty result.

    ``block`` pieces are packed at once in a task, ``group`` bins in a merge. Of bins packed best-fit
    together no two fit into one, so at most one a group is half full or less. Those go on to the next
    level, with as many fuller ones that have room for the least of them, in groups fewer by far,
    until there is one group: what is lost against merging all bins at once is less than one
    sequence for every ``group`` underfull bins.
    """
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    boxed = items.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("item"), F.col("length").cast("long").alias("length"))
    schema = T.StructType([*boxed.schema.fields, T.StructField("bin", T.LongType()), T.StructField("at", T.LongType())])
    local = staged(boxed.mapInArrow(_local(capacity, block), schema), "local")
    room = F.col("fill") < capacity * (1 - NEARLY_FULL)
    under = staged(local.groupBy("bin").agg(F.sum("length").alias("fill")).filter(room), "underfull")

    count = under.count()
    moves, level, groups = None, 0, -(-count // group)
    dealt = _dealt(under, level, max(groups, 1))
    while count > 1:
        merged = staged(_merged(dealt, capacity), "merged")
        step = merged.select("bin", "into", "at")
        if moves is None:
            moves = step
        else:
            again = step.toDF("into", "next", "more")
            moves = staged(moves.join(again, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")), "moves")
        if groups == 1:
            break
        left = merged.filter("bin = into").select("bin", F.col("filled").alias("fill")).filter(room)
        small = left.filter(2 * F.col("fill") <= capacity)
        n_small, least = small.agg(F.count("*"), F.min("fill")).first()
        if not n_small:
            break
        large = left.filter((2 * F.col("fill") > capacity) & (F.col("fill") + least <= capacity))
        level, groups = level + 1, -(-2 * n_small // group)
        shares = max(groups, -(-2 * large.count() // group))
        dealt = _dealt(small, level, groups).union(_dealt(large, level, groups, shares))
    bins = local if moves is None else local.join(moves.select("bin", "into", F.col("at").alias("from")), "bin", "left")
    if moves is None:
        return bins.select("item.*", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return bins.select("item.*", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("from", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Which sequence holds which piece of which document: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset. The ids themselves are read once and only their checksum moves on."""
    cut = pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut, capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit numbers) and
    the parts (doc_id, piece, offset, length) they are made of. A sequence is at most ``capacity``
    long, so that its pieces may meet in one task."""
    # Lengths alone are packed; the ids join what has been decided.
    cut = staged(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    packed = pack(cut.select("row", "doc_id", "piece", "length"), capacity).join(cut.select("row", "ids"), "row")
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("parts"))
