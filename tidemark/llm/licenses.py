"""License scans: exact phrases, and fuzzy search for short notices.

For a phrase with k errors allowed, k + 1 pieces are cut: wherever the phrase stands with at most k
edits, one piece at least stands unharmed (pigeonhole). The pieces are sought exactly; only the text
around a piece goes to the regex library's bounded-error matching, which verifies the edits and
gives the span.
"""

from __future__ import annotations

from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, NOT_WORD

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Further notices, found with errors only by the method, and their labels.
NOTICES = (
    *PHRASES,
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: One edit is allowed for every so many letters of a phrase; shorter phrases must stand exactly.
LETTERS_PER_EDIT = 9

#: Bytes to themselves in lower case, or to a blank between words.
_CLEAN = bytes(32 if NOT_WORD[LOWER[b]] else int(LOWER[b]) for b in range(256))

_SCHEMA = "doc_id long, n_words long, spans array<struct<label:string,first:int,last:int,edits:int,exact:boolean,similarity:double>>"


def edits_allowed(phrase: str) -> int:
    return len(phrase) // LETTERS_PER_EDIT


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 consecutive pieces of a phrase, each with its offset."""
    cuts = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _places(text: bytes, sought: bytes) -> list[int]:
    """All places of ``sought``, overlapping ones too."""
    out, at = [], text.find(sought)
    while at >= 0:
        out.append(at)
        at = text.find(sought, at + 1)
    return out


def _blanks(text: bytes, unit) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(text, unit) == 32)


class Notices:
    """The compiled phrases: exact ones with blanks around, pieces and bounded-error patterns."""

    def __init__(self, notices=NOTICES, exact=PHRASES):
        import regex

        self.exact = [(f" {p} ".encode(), label, p.count(" ") + 1) for p, label in exact]
        self.fuzzy = []
        for phrase, label in notices:
            k = edits_allowed(phrase)
            if k:
                seeds = [(at, piece.encode()) for at, piece in pieces(phrase, k)]
                body = regex.escape(phrase, special_only=True)
                pattern = regex.compile(rf"(?e)(?<= )(?:{body}){{e<={k}}}(?= )")
                fewer = [regex.compile(rf"(?:{body}){{e<={j}}}") for j in range(k)]
                self.fuzzy.append((phrase, label, k, seeds, pattern, fewer))

    def spans(self, clean: bytes) -> list[tuple]:
        """(label, first word, last word, edits, exact, similarity) of all finds.

        ``clean`` has the words with one blank before and after each. Word numbers come from one
        list of the blanks' places, so that the work is linear in the text.
        """
        out, exact, blanks = [], set(), None
        for phrase, label, words in self.exact:
            places = _places(clean, phrase)
            if places:
                blanks = _blanks(clean, np.uint8) if blanks is None else blanks
                firsts = np.searchsorted(blanks, places).tolist()
                out += [(label, first, first + words - 1, 0, True, 1.0) for first in firsts]
                exact.update((label, first) for first in firsts)
        for phrase, label, k, seeds, pattern, fewer in self.fuzzy:
            windows = set()
            for offset, piece in seeds:
                windows.update(at - offset for at in _places(clean, piece))
            # A find around a seed reaches no further than its edits do, each of four bytes at most; the
            # blanks beside it are asked for where it stands. Windows that overlap are searched as one.
            spare, reach, end = 4 * k + 4, [], -1
            for start in sorted(windows):
                a, b = max(0, start - spare), min(len(clean), start + len(phrase) + spare)
                if a < end:
                    reach[-1][1] = end = max(end, b)
                else:
                    reach.append([a, b])
                    end = b
            for a, b in reach:
                while clean[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(clean) and clean[b] & 0xC0 == 0x80:
                    b -= 1
                window = clean[a:b].decode()
                # A find's edits aren't always the least ones: it is held against smaller bounds as a whole.
                finds = [(m.start(), next((j for j in range(sum(m.fuzzy_counts)) if fewer[j].fullmatch(m[0])), sum(m.fuzzy_counts)), m[0]) for m in pattern.finditer(window, overlapped=False)]
                if not finds:
                    continue
                blanks = _blanks(clean, np.uint8) if blanks is None else blanks
                inside = _blanks(window.encode("utf-32-le"), np.uint32)
                firsts = np.searchsorted(blanks, a) + np.searchsorted(inside, [at for at, _, _ in finds]) - 1
                for first, (_, edits, found) in zip(firsts.tolist(), finds, strict=True):
                    # What stands exactly is one of the exact phrases' finds already, if it is one of those.
                    if (edits or (phrase, label) not in PHRASES) and (label, first) not in exact:
                        out.append((label, first, first + found.count(" "), edits, False, 1 - edits / len(phrase)))
        return sorted(set(out), key=itemgetter(1, 2, 0, 3))


def _scan(batches):
    notices = Notices()
    kinds = pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("edits", pa.int32()), ("exact", pa.bool_()), ("similarity", pa.float64())])
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "").cast(pa.large_binary())
        n_words, spans = [], []
        for text in texts:
            words = text.as_py().translate(_CLEAN).split()
            n_words.append(len(words))
            found = notices.spans(b" " + b" ".join(words) + b" ") if words else []
            spans.append([dict(zip(("label", "first", "last", "edits", "exact", "similarity"), s, strict=True)) for s in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(kinds))], names=["doc_id", "n_words", "spans"])


def find_licenses(docs: DataFrame) -> DataFrame:
    """License notices in every whole text: doc_id, n_words and spans, one row per input row.

    A span has a label, its first and last word (from 0), its edits, whether it is one of the exact
    phrases, and its similarity (1 less the edits per letter). Words are runs of letters, digits and
    all beyond ASCII after A-Z are lower-cased. A null or empty text has no words; repeated rows
    give repeated results; further columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _SCHEMA)


def summarise(found: DataFrame) -> DataFrame:
    """The spans of ``find_licenses`` as counts, labels and a score."""
    exact = F.filter("spans", lambda s: s["exact"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    first, last = F.transform(exact, lambda s: s["first"]), F.transform(exact, lambda s: s["first"])
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"),
        F.array_min(first).cast("long").alias("first_word"), F.array_max(last).cast("long").alias("last_word"),
        names(exact).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
    )
