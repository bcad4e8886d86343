"""Quality rules by line labelling: a linear-chain conditional random field over a text's lines.

A line is described by a few yes-or-no features, kept as the bits of one number. The field scores a
sequence of labels (boilerplate 0, content 1) by weights of features and of label pairs. Its weights
maximise the penalised conditional likelihood of labelled texts' lines: every step is one Spark job in
which tasks run the forward-backward recursions and only gradients meet. Viterbi's recursion then gives
the best labels of each text, and the words in content lines decide whether the text stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, utf8
from .quality import held_out_fold
from .words import BLANKS, mix, range_hashes, word_bounds

# The signs that count as symbols, words that a text needs, and the share of repeats in per cent that fails it.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATS = 50, 50
#: Share of words in content lines, in per cent, that a text needs.
LEAST_CONTENT = 50
#: Lines of a labelled text that make a run in training, at most (longer texts give several), and runs that make a sequence.
RUN, MIXED = 8, 6
#: Weight of the squared weights against the mean log likelihood of a line, steps at most, and the gradient that ends them.
PENALTY, STEPS, ENOUGH = 3e-4, 30, 3e-4

FEATURES = ("any", "short", "long", "signed", "mostly_signed", "capitals", "digits", "shouting", "closed", "opened", "repeated", "stuttering", "few_words", "long_words", "short_words", "code_signs", "stops", "windows")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Classes of bytes.
_LOWER, _UPPER, _DIGIT, _STOP, _SHOUT, _SIGN, _CODE, _MORE = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in ((_LOWER, b"abcdefghijklmnopqrstuvwxyz"), (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_STOP, b".,;:?"), (_SHOUT, b"!"), (_SIGN, SYMBOLS), (_CODE, b"@/\\_=+~^`{}[]"), (_MORE, bytes(range(0x80, 0xC0)))):
    _CLASS[list(_bytes)] = _k
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".!?:\"')")] = True


def _per(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many true ``values`` each of ``n`` owners has; ``of`` names each value's."""
    return np.bincount(of[values], minlength=n)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Whether a key is the first of its kind."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that agree only within an owner."""
    return mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def describe(data: np.ndarray, offsets: np.ndarray):
    """The counts of each text (a row of COUNTS), its lines' features and words, and where each text's lines begin."""
    block = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    # Lines: a text has one more than it has line ends.
    breaks = np.flatnonzero(block == 10)
    text_of_break = np.searchsorted(offsets, breaks, "right") - 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text_of_break, minlength=n) + 1)]).astype(np.int64)
    m = bounds[-1]
    line_of_break = np.arange(len(breaks)) + text_of_break
    begin, end = np.empty(m, np.int64), np.empty(m, np.int64)
    begin[bounds[:-1]], end[bounds[1:] - 1] = offsets[:-1], offsets[1:]
    begin[line_of_break + 1], end[line_of_break] = breaks + 1, breaks
    text_of_line = np.repeat(np.arange(n), np.diff(bounds))
    # Words, and which line and text has each.
    starts, ends, word_place = word_bounds(block, offsets, BLANKS)
    line_of_word = np.searchsorted(begin, starts, "right") - 1
    text_of_word = text_of_line[line_of_word] if m else line_of_word
    words = np.bincount(line_of_word, minlength=m)
    hashes = range_hashes(block, starts, ends)
    # Bytes by line and class.
    size = end - begin
    taken = size.copy()
    taken[line_of_break] += 1
    kinds = _CLASS[block]
    count = np.bincount(np.repeat(np.arange(m), taken) * 9 + kinds, minlength=m * 9).reshape(m, 9)
    symbols = count[:, _SIGN]
    head = (block & 0xC0) != 0x80
    blank = BLANKS[block]
    line_chars = np.concatenate([[0], np.cumsum(head & ~blank)])
    chars = line_chars[end] - line_chars[begin]
    word_bytes = np.bincount(line_of_word, weights=ends - starts, minlength=m).astype(np.int64)
    # Repeats: lines of a text, words of a line, windows of three words of a text.
    with_words = words > 0
    repeated = with_words & ~_firsts(_within(range_hashes(block, begin, end), text_of_line))
    distinct = _per(_firsts(_within(hashes, line_of_word)), line_of_word, m)
    stutters = _per(np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])])[: len(hashes)], line_of_word, m)
    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        inside = text_of_word[2:] == text_of_word[:-2]
        windows = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
        _, kind, often = np.unique(_within(windows, text_of_word[:-2])[inside], return_inverse=True, return_counts=True)
        twice = np.zeros(len(inside), bool)
        twice[inside] = often[kind] > 1
        for k in range(3):
            covered[k : len(hashes) - 2 + k] |= twice
    covered_in = _per(covered, line_of_word, m)
    signed = _per((kinds[ends - 1] == _SIGN) | (kinds[ends - 1] == _SHOUT), line_of_word, m)
    closed, opened = np.zeros(m, bool), np.zeros(m, bool)
    first, last = np.ones(len(starts), bool), np.ones(len(starts), bool)
    first[1:] = last[:-1] = line_of_word[1:] != line_of_word[:-1]
    opened[line_of_word[first]] = kinds[starts[first]] == _UPPER
    closed[line_of_word[last]] = _CLOSING[block[ends[last] - 1]]
    letters = count[:, _LOWER] + count[:, _UPPER]
    bits = (
        with_words, words < 5, words >= 25, signed * 8 >= words, signed * 2 >= words, count[:, _UPPER] * 2 > letters, count[:, _DIGIT] * 8 >= word_bytes, count[:, _SHOUT] * 4 >= words,
        closed, opened, repeated, stutters * 3 >= words, distinct * 2 < words, word_bytes > 14 * words, word_bytes * 2 < 5 * words, count[:, _CODE] * 6 >= words, count[:, _STOP] * 30 >= words, covered_in * 2 >= words,
    )
    codes = sum((b & with_words).astype(np.int32) << k for k, b in enumerate(bits))
    by_text = lambda values: np.bincount(text_of_line, weights=values, minlength=n).astype(np.int64)
    counts = np.stack([np.diff(word_place), by_text(chars), by_text(symbols), by_text(repeated), by_text(covered_in)], axis=1)
    return counts, codes, words.astype(np.int32), bounds


def _described(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            counts, codes, words, bounds = describe(data, offsets[i : j + 1])
            at = pa.array(bounds, pa.int32())
            columns = [batch.column(0).slice(i, j - i), *(pa.array(c) for c in counts.T), pa.ListArray.from_arrays(at, pa.array(codes)), pa.ListArray.from_arrays(at, pa.array(words))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "codes", "words"])


def described_lines(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of every whole text, and of each of its lines the features' code and the words; null reads as empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_described, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", codes array<int>, words array<int>")


@dataclass(frozen=True)
class Field:
    """Weights of the features and the bias for content, and of the label pairs 00, 01, 10, 11."""

    weights: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray) -> Field:
        return cls(flat[: len(FEATURES) + 1], flat[len(FEATURES) + 1 :])

    def content(self, codes: np.ndarray) -> np.ndarray:
        """What each line's features add to the score if it is content."""
        return _bits(codes) @ self.weights

    def labels(self, content: list[float]) -> list[bool]:
        """The labels of the greatest score, by Viterbi's recursion; of equal ones those with content."""
        stay0, up, down, stay1 = self.pairs.tolist()
        if not content:
            return []
        zero, one, came = 0.0, content[0], []
        for c in content[1:]:
            from1_to0, from1_to1 = one + down >= zero + stay0, one + stay1 >= zero + up
            zero, one = (one + down if from1_to0 else zero + stay0), c + (one + stay1 if from1_to1 else zero + up)
            came.append((from1_to0, from1_to1))
        now = one >= zero
        out = [now]
        for back in reversed(came):
            now = back[now]
            out.append(now)
        return out[::-1]


def _bits(codes: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each code, with a 1 for the bias at its end."""
    return np.concatenate([(codes[:, None] >> np.arange(len(FEATURES))) & 1, np.ones((len(codes), 1), codes.dtype)], axis=1).astype(float)


def gradient(field: Field, codes: np.ndarray, labels: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log likelihood and its gradient, summed over labelled sequences.

    ``codes`` and ``labels`` have a row for each sequence, filled up to the longest; ``size`` is their lengths.
    """
    n, longest = codes.shape
    emit = field.content(codes.ravel()).reshape(n, longest)
    t00, t01, t10, t11 = field.pairs
    inside = np.arange(longest) < size[:, None]
    forward, backward = np.zeros((longest, 2, n)), np.zeros((longest, 2, n))
    forward[0, 1] = emit[:, 0]
    for t in range(1, longest):
        zero, one = forward[t - 1]
        forward[t, 0] = np.where(inside[:, t], np.logaddexp(zero + t00, one + t10), zero)
        forward[t, 1] = np.where(inside[:, t], np.logaddexp(zero + t01, one + t11) + emit[:, t], one)
    for t in range(longest - 2, -1, -1):
        zero, one = backward[t + 1, 0], backward[t + 1, 1] + emit[:, t + 1]
        backward[t, 0] = np.where(inside[:, t + 1], np.logaddexp(zero + t00, one + t01), 0)
        backward[t, 1] = np.where(inside[:, t + 1], np.logaddexp(zero + t10, one + t11), 0)
    whole = np.logaddexp(*forward[-1])
    content = np.exp(forward[:, 1] + backward[:, 1] - whole).T * inside
    out = np.zeros(1 + len(field.weights) + 4)
    out[0] = (emit * (labels * inside)).sum() - whole.sum()
    out[1 : 1 + len(field.weights)] = ((labels * inside) - content).ravel() @ _bits(codes.ravel())
    both = inside[:, 1:].T
    before, after = labels[:, :-1].T, labels[:, 1:].T
    for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        seen = (before == a) & (after == b)
        expected = np.exp(forward[:-1, a] + field.pairs[k] + (emit[:, 1:].T if b else 0) + backward[1:, b] - whole)
        out[0] += field.pairs[k] * (seen & both).sum()
        out[1 + len(field.weights) + k] = ((seen - expected) * both).sum()
    return out


def _sequences(described: DataFrame, marks: DataFrame) -> DataFrame:
    """Labelled sequences (codes, labels) of some MIXED runs each, where a run is at most RUN lines of one labelled text.

    Runs of good and bad texts stand side by side, so that the field learns what a change looks like. Equal
    runs count once, and are dealt to sequences by their hashes.
    """
    some = described.filter(F.exists("words", lambda w: w > 0)).join(marks, "doc_id").select("codes", "label")
    runs = some.select("label", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("codes") - 1) / RUN)), lambda k: F.slice("codes", (k * RUN + 1).cast("int"), F.lit(RUN)))).alias("codes"))
    runs = staged(runs.distinct(), "runs")
    groups = -(-runs.count() // MIXED)
    if not groups:
        return runs.select("codes", F.array("label").alias("labels"))
    dealt = runs.withColumn("h", F.xxhash64("codes", "label")).groupBy(F.pmod("h", F.lit(groups)).alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("h").alias("h"), "codes", "label"))).alias("r"))
    labels = F.transform("r", lambda r: F.array_repeat(r["label"], F.size(r["codes"])))
    return dealt.select(F.flatten(F.transform("r", lambda r: r["codes"])).alias("codes"), F.flatten(labels).alias("labels"))


def fit(sequences: DataFrame) -> Field:
    """The field of the greatest penalised likelihood of (codes, labels), by limited-memory quasi-Newton steps.

    All sequences count. Each evaluation is a job whose tasks send one sum each. Without sequences all weights
    are 0, and every line is content.
    """
    spark, size = sequences.sparkSession, 1 + len(FEATURES) + 4
    lines = sequences.agg(F.sum(F.size("codes"))).first()[0]
    if not lines:
        return Field.of(np.zeros(size))

    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
        field = Field.of(flat)

        def run(batches):
            total = np.zeros(1 + size)
            for batch in batches:
                n = np.asarray(batch.column(0).value_lengths().to_numpy(), np.int64)
                codes, labels = (batch.column(c).flatten().to_numpy() for c in (0, 1))
                order, at = np.argsort(n, kind="stable"), np.concatenate([[0], np.cumsum(n)])
                for i in range(0, len(order), 1024):
                    some = order[i : i + 1024]
                    column = np.arange(n[some].max())
                    place = np.minimum(at[some][:, None] + column, len(codes) - 1)
                    inside = column < n[some][:, None]
                    total += gradient(field, np.where(inside, codes[place], 0), np.where(inside, labels[place], 0), n[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "v"])

        out = np.zeros(1 + size)
        for at, v in sequences.select("codes", "labels").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[at] = v
        return -out[0] / lines + PENALTY / 2 * flat @ flat, -out[1:] / lines + PENALTY * flat

    now = np.zeros(size)
    value, slope = evaluate(now)
    steps = []
    for _ in range(STEPS):
        if np.abs(slope).max() < ENOUGH:
            break
        way = _direction(slope, steps)
        length = 1.0 if steps else min(1.0, 1 / np.linalg.norm(slope))
        for _ in range(8):
            there = now + length * way
            new_value, new_slope = evaluate(there)
            if new_value <= value + 1e-4 * length * (slope @ way):
                break
            length /= 4
        else:
            break
        if (new_slope - slope) @ (there - now) > 1e-12:
            steps = [*steps, (there - now, new_slope - slope)][-8:]
        now, value, slope = there, new_value, new_slope
    return Field.of(now)


def _direction(slope: np.ndarray, steps: list) -> np.ndarray:
    """Downhill, bent by the curvature that the last steps have met."""
    way, held = -slope, []
    for moved, turned in reversed(steps):
        share = (moved @ way) / (turned @ moved)
        way = way - share * turned
        held.append(share)
    if steps:
        moved, turned = steps[-1]
        way = way * (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(steps, reversed(held), strict=True):
        way = way + moved * (share - (turned @ way) / (turned @ moved))
    return way


def _marks(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return known.filter(~held_out_fold() & F.col("label").isin(0, 1))


def _labelled(field: Field, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's label; lines of one text are one sequence."""
    known, place = np.unique(codes, return_inverse=True)
    content = field.content(known)[place].tolist() if len(known) else []
    out = []
    for a, b in pairwise(bounds.tolist()):
        out += field.labels(content[a:b])
    return np.array(out, bool)


def judge_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and labelled lines of every whole text, and whether it stays; one row per input row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content (a flag for
    each of the lines between \\n), n_content_words, base_failed and kept. Words are what stands between
    white space. base_failed: fewer than 50 words, or more than half of the words in windows of three that
    occur twice. The field learns from ``labels.quality`` of documents outside the held-out fold (CRC-32 of
    doc_id modulo 3 is 1), each line of a good document being content and of a bad one boilerplate. A text
    is kept if it doesn't fail and half of its words at least are in content lines.

    A null or empty text has one line without words, and fails. Null doc_ids are never labelled; repeated
    rows and repeated labels count each time, further columns are ignored, and without labelled rows every
    line is content. An empty table gives an empty result.
    """
    described = staged(described_lines(docs), "lines")
    field = fit(staged(_sequences(described, _marks(labels)), "sequences"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            lines, words = batch.column("codes"), batch.column("words").flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy())]).astype(np.int64)
            content = _labelled(shared.value, lines.flatten().to_numpy(), bounds)
            sums = np.concatenate([[0], np.cumsum(words * content)])
            flags = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(content))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *COUNTS)), flags, pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())], names=["doc_id", *COUNTS, "content", "n_content_words"])

    out = described.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", content array<boolean>, n_content_words long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_content_words") >= LEAST_CONTENT * F.col("n_words")))


def content_text(text, content):
    """``text`` (a column) without the lines that ``content`` marks as boilerplate."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line, k: F.coalesce(F.get(content, k), F.lit(True))), "\n")
