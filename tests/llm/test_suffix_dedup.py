import hashlib
import random
from collections import Counter

import pytest
from cases import documents, space_words, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import suffix_dedup


def brute(rows: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """(removed, spans, digest of what is kept) of each text."""
    times = Counter(t[k : k + length] for t in rows for k in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if times[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((sum(gone), bytes(gone).replace(b"\x01\x01", b"\x01").count(b"\x00\x01") + bool(gone[:1] == b"\x01") if gone else 0, hashlib.sha256(kept).hexdigest()))
    return [(a, _runs(t, times, length), c) for (a, _, c), t in zip(out, rows)]


def _runs(t: bytes, times: Counter, length: int) -> int:
    runs, end = 0, -1
    for k in range(len(t) - length + 1):
        if times[t[k : k + length]] > 1:
            runs += k > end
            end = k + length
    return runs


def passages(texts: list[str | None], n: int) -> list[int]:
    """Words of each text that n repeated words cover."""
    words = [space_words(t) for t in texts]
    times = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    return [len({p for k in range(len(w) - n + 1) if times[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}) for w in words]


def check(spark, rows, length, passage=suffix_dedup.PASSAGE):
    found = suffix_dedup.dedup_strings(documents(spark, [(i, t, None, None) for i, t in rows]), length, passage).collect()
    data = [(t or "").encode() for _, t in rows]
    want = Counter((i, len(d), *b, p) for (i, _), d, b, p in zip(rows, data, brute(data, length), passages([t for _, t in rows], passage)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in found) == want


@pytest.mark.parametrize("most", [8192, 3, 1])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_FRAGMENTS", most)  # larger groups are split, with 1 down to single strings
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passage = word(300)
    rows = [(k, word(rng.randrange(0, 200)) + passage[rng.randrange(60) : rng.randrange(100, 300)] + word(rng.randrange(200))) for k in range(40)]
    rows += [(50, "ab" * 200), (51, "a" * 150), (52, passage), (53, passage), (54, None), (55, ""), (None, passage[:80]), (56, word(70) * 2)]
    for length, passage in ((40, 9), (64, 12), (101, 30)):
        check(spark, rows, length, passage)


def test_production_length_and_awkward_rows(spark):
    check(spark, [(i, t) for i, t, *_ in texts()], 400)  # the longest text too
    assert suffix_dedup.dedup_strings(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_strings(documents(spark), 20)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=36, max_size=60), st.integers(0, 4)), min_size=2, max_size=6))
def test_columns_find_repeats(parts):
    """One anchor group: strings of 36 bytes around an anchor of 32."""
    length, k = 36, 32
    anchor = "x" * k
    fragments = [(left[:a] + anchor + left[a : a + (length - k)]).encode() for left, a in parts]
    import numpy as np

    distinct = sorted({(f, min(a, len(f))) for f, (_, a) in zip(fragments, parts)})
    units = suffix_dedup.Units(length, k, False, length)
    marks = suffix_dedup.repeated_columns(np.zeros(len(distinct), dtype=np.int32), [np.frombuffer(f, np.uint8) for f, _ in distinct], np.array([a for _, a in distinct]), units)
    for j, (f, a) in enumerate(distinct):
        for s in range(len(f) - length + 1):
            string, place = f[s : s + length], a - s
            others = any(g[b - place : b - place + length] == string for i, (g, b) in enumerate(distinct) if i != j and b - place >= 0 and len(g) >= b - place + length)
            assert marks[length - k - place, j] == others
