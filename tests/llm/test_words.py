import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import neardup, quality
from tidemark.llm.common import frugal, slices, utf8
from tidemark.llm.words import BLANKS, NOT_WORD, shingle_hashes, shingle_sets, word_hashes

TEXT = st.text(st.sampled_from(list("abAB 1\t\n.,é—日\x7f")), max_size=60)


def fields(text: str, alphanumeric: bool) -> list[str]:
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if alphanumeric else r"[^\x20\x09-\x0D]+", lowered)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_words_and_shingles_are_those_of_a_plain_split(texts):
    data, offsets = utf8(pa.array(texts))
    for between, alphanumeric in ((BLANKS, False), (NOT_WORD, True)):
        hashes, bounds = word_hashes(data, offsets, between)
        words = [fields(t, alphanumeric) for t in texts]
        assert np.diff(bounds).tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert len(set(hashes.tolist())) == len(set(flat))
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat))
        runs, run_bounds = shingle_hashes(hashes, bounds, 3)
        want = [[tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else [] for w in words]
        assert np.diff(run_bounds).tolist() == [len(w) for w in want]
        flat = [r for ws in want for r in ws]
        assert len(set(zip(flat, runs.tolist(), strict=True))) == len(set(flat)) == len(set(runs.tolist()))
        for own, ws in zip(shingle_sets(data, offsets, 3, between), want, strict=True):
            assert len(own) == len(set(ws))


def test_slices_cover_all_rows_and_nulls_are_empty():
    data, offsets = utf8(pa.array(["a" * 10, None, "b" * 100, "", "c"]))
    assert offsets.tolist() == [0, 10, 10, 110, 110, 111]
    got = list(slices(offsets, 20))
    assert [i for i, _ in got] == [0, *[j for _, j in got[:-1]]] and got[-1][1] == 5
    assert list(slices(np.zeros(1, np.int64))) == []
    sliced, at = utf8(pa.array(["xx", "yy", "zz"]).slice(1, 2))
    assert bytes(sliced[at[0] : at[-1]]) == b"yyzz"


def test_scans_give_arrows_free_memory_back(monkeypatch):
    """At the end of a task, also of one that is broken off or fails; and what they yield is as it was."""
    back = []

    class Pool:
        def release_unused(self):
            back.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)

    @frugal
    def halves(batches):
        for b in batches:
            yield b // 2

    assert list(halves([2, 4])) == [1, 2] and len(back) == 1
    broken = halves([2, 4])
    assert next(broken) == 1 and len(back) == 1
    broken.close()
    assert len(back) == 2
    try:
        list(halves([None]))
    except TypeError:
        pass
    assert len(back) == 3
    for scan in (neardup._sign(4, 2, 2, neardup.Circulant), neardup._sets(4), quality._features):
        back.clear()
        assert list(scan([])) == [] and len(back) == 1
