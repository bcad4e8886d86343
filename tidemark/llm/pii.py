"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

The fixed patterns' finds are the seeds, and so are runs of hexadecimal digits as long as a key or a
digest. The words and signs around a find make lexical patterns; Spark joins patterns and instances
into a graph and judges both sides in turn: a pattern by how many of what it holds is trusted for
one kind, against what is trusted for another kind and what is surely none of them; an instance by
the patterns that hold it, until nothing changes. Trusted patterns then take in look-alikes that the
fixed patterns miss.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, frugal, staged

#: The fixed patterns' kinds, and after them the kind that contexts alone vouch for.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET, NEITHER = 4, -1

# Fixed patterns. Look-behinds keep runs of digits from being tried again from each digit.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alikes: what a context may vouch for, each a token of its own. An address has at most 64
# characters before its sign and 9 labels of at most 63 after it, as mail has.
_SPELT = re.compile(r"(?<![^\s<(\[\"'])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}){0,8}")
_QUAD = re.compile(r"(?<![\w.,])[0-9]{1,3}(?:(?:[.,]|\[\.\]|\(\.\))[0-9]{1,3}){3}(?!\w|[.,][0-9])")
_RUN = re.compile(r"(?<![\w+])[0-9](?:[ ./-]?[0-9])*+(?!\w)")
_DIAL = re.compile(r"(?<![\w+])\(?[0-9](?:[ ().-]{0,2}[0-9])*+(?!\w)")
_HEX = re.compile(r"(?<!\w)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})(?!\w)")
_OPAQUE = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_-]{12,}+={0,2}(?![\w+/=-])")
_NUMBER = re.compile(r"(?<![\w.])[0-9]++(?:[.,:/-][0-9]++)*+(?!\w)")
_DIGIT, _DIGITS, _LETTER = re.compile(r"[0-9]"), re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]")
_TOKEN = re.compile(r"\w+|[^\w\s]")

_FOUND = "row long, doc_id long, text_key long, base array<struct<kind:int,start:int,end:int>>, seen array<struct<kind:int,start:int,end:int,seed:boolean,value:long,patterns:array<long>>>"

#: A pattern is trusted for a kind from this many distinct trusted instances of the kind and this share of
#: them among all that are trusted or surely neither.
SUPPORT, CONFIDENCE = 4, 0.8
#: Code points to either side of a find in which its context is.
REACH = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns' finds, by kind and start; in code points."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and m.end() - m.start() <= 37:
            digits = "".join(_DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) - (1 << 63)


def look_alikes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, seed) of what contexts may vouch for and of what tells against a context.

    Nothing here overlaps ``base``. Kind NEITHER are numbers that are none of the kinds: such as runs
    of 16 to 19 digits that fail the cards' check sum, or quads with a part over 255.
    """
    spelt = "@" in text or "at]" in text or "at)" in text
    if not spelt and not _DIGIT.search(text):
        return []
    # Covered stretches in order, so that an overlap is found by bisection.
    starts, ends = [], []
    for start, end in sorted((s, e) for _, s, e in base):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def free(m) -> bool:
        k = bisect_right(ends, m.start())
        return k == len(ends) or starts[k] >= m.end()

    out, neither = [], []
    if spelt:
        out += [(0, m.start(), m.end(), False) for m in _SPELT.finditer(text) if free(m)]
    for m in _QUAD.finditer(text):
        if free(m):
            kept = all(int(x) <= 255 for x in _DIGITS.findall(m[0]))
            (out if kept else neither).append((1 if kept else NEITHER, m.start(), m.end(), False))
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 13 and free(m):
            digits = "".join(_DIGITS.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end(), False))
            elif len(digits) >= 16:
                neither.append((NEITHER, m.start(), m.end(), False))
    for m in _DIAL.finditer(text):
        if m.end() - m.start() >= 7 and free(m) and 7 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end(), False))
    seeds = {m.span() for m in _HEX.finditer(text) if _LETTER.search(m[0]) and _DIGIT.search(m[0]) and free(m)}
    out += [(SECRET, *span, True) for span in sorted(seeds)]
    for m in _OPAQUE.finditer(text):
        if m.span() not in seeds and free(m) and len(_DIGIT.findall(m[0])) >= 2 and len(_LETTER.findall(m[0])) >= 2:
            out.append((SECRET, m.start(), m.end(), False))
    taken = sorted({(s, e) for _, s, e, _ in out + neither})
    at = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))
    for m in _NUMBER.finditer(text):
        k = bisect_left(at, m.end())
        if free(m) and not (k and reach[k - 1] > m.start()):
            neither.append((NEITHER, m.start(), m.end(), False))
    return out + neither


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span: three tokens before, two before, and one before with one after.

    A token is a word, lower-cased and with each digit as 0, or a single sign. A pattern without any
    word is none.
    """
    before = [_DIGIT.sub("0", w.lower()) for w in _TOKEN.findall(text[max(0, start - REACH) : start])[-3:]]
    after = [_DIGIT.sub("0", w.lower()) for w in _TOKEN.findall(text[end : end + REACH])[:1]]
    out = [[*before[-k:], "_"] for k in (3, 2) if len(before) >= k]
    if before and after:
        out.append([before[-1], "_", after[0]])
    return [" ".join(p) for p in out if any(w[0].isalnum() for w in p)]


@frugal
def _scan(batches):
    part, at = TaskContext.get().partitionId() << 36, 0
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    for batch in batches:
        rows, bases, all_seen = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = fixed_spans(text)
            marks = [(*s, True) for s in base] + look_alikes(text, base)
            bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            all_seen.append([{"kind": k, "start": s, "end": e, "seed": seed, "value": _hash(text[s:e].lower()), "patterns": [_hash(c) for c in contexts(text, s, e)]} for k, s, e, seed in marks])
            rows.append(part + at)
            at += 1
        columns = [pa.array(rows, pa.int64()), batch.column(0), batch.column(2), pa.array(bases, pa.list_(span)), pa.array(all_seen, pa.list_(seen))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_key", "base", "seen"])


def trusted_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind): what the graph of patterns and instances trusts each pattern for.

    Edges are distinct (pattern, kind, value), so that copies of a text don't count twice. Seeds are
    trusted, and so is what a trusted pattern holds of its kind; such instances support further
    patterns, with seeds or without, until nothing changes. A pattern is trusted for a kind from
    SUPPORT trusted instances of it, if these are at least CONFIDENCE of all its instances that are
    trusted for any kind or surely neither, and at least half of its instances of the kind. So a context
    that holds anything, as common words do, is trusted for nothing. Patterns once trusted stay so,
    and the rounds end. Grouped sums are pre-aggregated before each shuffle.
    """
    marks = found.select(F.explode("seen").alias("s"))
    seeds = staged(marks.filter("s.seed").select("s.kind", "s.value").distinct(), "seeds")
    edges = marks.select(F.explode("s.patterns").alias("pattern"), F.col("s.kind").alias("kind"), F.col("s.value").alias("value")).distinct()
    wide = edges.filter(F.col("kind") != NEITHER).groupBy("pattern", "kind").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select("pattern").distinct()
    edges = staged(edges.join(wide, "pattern", "left_semi"), "edges")
    trusted, good, before = seeds, None, 0
    own = lambda k: F.col("kind") == k
    while True:
        marked = edges.join(trusted.withColumn("yes", F.lit(True)), ["kind", "value"], "left").withColumn("yes", F.coalesce("yes", F.lit(False)))
        sums = [c for k in range(len(KINDS)) for c in (F.count_if(own(k) & F.col("yes")).alias(f"s{k}"), F.count_if(own(k)).alias(f"n{k}"))]
        counts = marked.groupBy("pattern").agg(F.count_if(own(NEITHER) | F.col("yes")).alias("sure"), *sums)
        judged = counts.select("pattern", "sure", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("s"), F.col(f"n{k}").alias("n")) for k in range(len(KINDS))])).alias("j"))
        now = judged.filter((F.col("j.s") >= SUPPORT) & (2 * F.col("j.s") >= F.col("j.n")) & (F.col("j.s") >= CONFIDENCE * F.col("sure"))).select("pattern", "j.kind")
        good = staged(now if good is None else good.union(now).distinct(), "good")
        n = good.count()
        if n == before:
            return good
        before = n
        trusted = staged(seeds.union(edges.join(good, ["pattern", "kind"], "left_semi").select("kind", "value")).distinct(), "trusted")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: one row per input row with doc_id, text_key
    (a hash of the text), base and spans.

    ``base`` has the fixed patterns' spans and ``spans`` those and what trusted contexts add, both
    as arrays of (kind, start, end) in the order of KINDS and then of start; code points, ends
    exclusive. Secrets (opaque tokens such as keys) are added by contexts only. An added span
    overlaps no other span of the row; what fails a card's check sum is never added. Contexts reach
    REACH code points to either side. Spelt-out addresses, which contexts may add, are looked for as long as
    mail allows: 64 characters before the sign and 9 labels of 63 after it; the fixed patterns have no such bound. A null or empty text has no spans; repeated rows give repeated
    results; further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    found = staged(texts.mapInArrow(_scan, _FOUND), "found")
    patterns = trusted_patterns(found)
    # What is in ``base`` already isn't added: only secrets are seeds without being there.
    marks = found.select("row", F.explode("seen").alias("s")).filter(f"s.kind = {SECRET} OR (s.kind <> {NEITHER} AND NOT s.seed)")
    marks = marks.select("row", "s.kind", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    added = marks.join(patterns, ["pattern", "kind"], "left_semi").select("row", F.struct("start", "end", "kind").alias("a")).groupBy("row").agg(F.array_sort(F.collect_set("a")).alias("added"))
    # Left to right, each added span gives way to one before it that it overlaps.
    free = F.aggregate("added", F.array().cast("array<struct<start:int,end:int,kind:int>>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, F.lit(-1))["end"] <= x["start"]), F.concat(acc, F.array(x))).otherwise(acc))
    added = added.select("row", F.transform(F.when(F.size("added") > 0, free), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("added"))
    joined = found.select("row", "doc_id", "text_key", "base").join(added, "row", "left")
    return joined.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("spans"))


def _cover(text: str, spans) -> str:
    """``text`` with its spans, or runs of overlapping spans, given as <KIND> of the first of each."""
    out, at = [], 0
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by the name of its kind, like <EMAIL>.

    All other columns stay, but n_chars, where there is one, follows the text. Rows without spans
    are untouched.
    """
    found = find_personal_data(docs).filter(F.size("spans") > 0)
    spans = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "spans").dropDuplicates(["id", "key"])

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cover(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    joined = boxed(docs).join(spans, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("key")), "left")
    clean = joined.filter("spans IS NULL").select("row.*")
    covered = joined.filter("spans IS NOT NULL").select("row", cover(F.col("row.text").cast("string"), "spans").alias("new"))
    new = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return clean.union(covered.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]))
