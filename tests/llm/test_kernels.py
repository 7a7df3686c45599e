"""The numeric kernels on random input, without Spark."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import segments, substrings, suffixes
from loomline.llm.common import WordHash, gram_hash, slices, sliding_min
from loomline.llm.quality import repeated_words


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
def test_equal_grams_have_equal_hashes(values, k):
    h = np.array(values, np.uint64) + np.uint64(1)
    g = gram_hash(h, k)
    grams = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(g) == len(grams) and len(set(g.tolist())) == len(set(grams))
    assert all((g[i] == g[j]) == (grams[i] == grams[j]) for i in range(len(grams)) for j in range(i))


@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 15))
def test_sliding_min(values, w):
    found = sliding_min(np.array(values, np.uint64), w).tolist()
    assert found == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


def classes_of(order, same):
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate([[True], ~same])) if len(order) else 0
    return group.tolist()


def shared(x, y):
    return next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


STRINGS = st.lists(st.binary(max_size=60).map(lambda b: bytes(c % 3 for c in b)), max_size=8)


@settings(max_examples=60)
@given(STRINGS, st.sampled_from([8, 9, 17, 24]))
def test_suffix_order(strings, window):
    strings = list(dict.fromkeys(strings))
    before, order, common = suffixes.suffix_order(strings, window)
    windows = [s[i : i + window] for s in strings for i in range(len(s) - window + 1)]
    assert before[-1] == len(windows) and sorted(order.tolist()) == list(range(len(windows)))
    ranked = [windows[i] for i in order]
    assert ranked == sorted(windows)
    assert common.tolist() == [shared(x, y) for x, y in zip(ranked, ranked[1:])]


@settings(max_examples=120)
@given(st.binary(max_size=70).map(lambda b: bytes(c % 2 for c in b)), st.sampled_from([8, 11, 16]), st.integers(0, 3))
def test_longest_previous_factor(text, window, jumps):
    """Against the definition, in quadratic time; with few jumps the stack sweep takes over."""
    _, order, common = suffixes.suffix_order([text], window)
    had, suffixes.JUMPS = suffixes.JUMPS, jumps
    try:
        exact = suffixes.longest_previous(order, common)
        bounded = suffixes.longest_previous(order, common, window)
        after = suffixes.longest_previous(len(order) - order, common)
    finally:
        suffixes.JUMPS = had
    w = [text[i : i + window] for i in range(len(text) - window + 1)]
    assert exact.tolist() == [max((shared(w[i], w[j]) for j in range(i)), default=0) for i in order]
    assert after.tolist() == [max((shared(w[i], w[j]) for j in range(i + 1, len(w))), default=0) for i in order]
    assert (bounded >= window).tolist() == (exact >= window).tolist()


@settings(max_examples=60)
@given(STRINGS, st.sampled_from([8, 13]), st.booleans())
def test_repeats_of_packed_strings(strings, window, words):
    """anywhere and earlier flags by both ways of comparing windows; each string's first place is a row of its own."""
    if words:
        strings = [b" ".join(b"%d" % c for c in s) for s in strings]
    strings = [s for s in dict.fromkeys(strings) if s]
    weight = np.array([1 + len(s) % 5 // 4 for s in strings], np.int64)
    row = np.array([(7 * k) % 11 for k in range(len(strings))], np.int64)
    start = np.arange(len(strings), dtype=np.int64)
    unit = substrings.words(window, 3) if words else suffixes.octet_unit(window, 3)
    before, anywhere, earlier = unit.repeats(strings, weight, row, start)
    places = [(tuple(u[i : i + window]), row[k], start[k] + i, weight[k]) for k, u in enumerate(map(unit.split, strings)) for i in range(len(u) - window + 1)]
    assert before[-1] == len(places)
    for (w, r, s, n), any_, early in zip(places, anywhere, earlier):
        same = [p for p in places if p[0] == w]
        assert any_ == (sum(p[3] for p in same) > 1)
        assert early == any((p[1], p[2]) < (r, s) for p in same)


@settings(max_examples=60)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"cc"]), min_size=1, max_size=30), max_size=6), st.integers(1, 7))
def test_sorted_windows(texts, window):
    packed = list(dict.fromkeys(b" ".join(t) for t in texts))
    before, order, same = substrings.sorted_windows(packed, window, WordHash())
    windows = [tuple(p.split(b" ")[i : i + window]) for p in packed for i in range(len(p.split(b" ")) - window + 1)]
    assert before[-1] == len(windows)
    groups = classes_of(order, same)
    assert all((groups[i] == groups[j]) == (windows[i] == windows[j]) for i in range(len(windows)) for j in range(i))


@settings(max_examples=60)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=5))
def test_segments_cover_each_window_once(texts):
    unit = substrings.words(6, 3)
    covered = Counter()
    for row, start, size, _ in segments.segments(unit, [b" ".join(t) for t in texts]):
        for s, n in zip(start.tolist(), size.tolist()):
            covered.update((row, i) for i in range(s, s + n))
    assert covered == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t) - 5))


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(segments, "PIECE", 50)
    rng = np.random.default_rng(0)
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 40, n)) for n in (3, 49, 55, 300, 0, 120)]
    unit = substrings.words(6, 3)
    covered = Counter()
    for row, start, size, _ in segments.segments(unit, texts):
        for s, n in zip(start.tolist(), size.tolist()):
            covered.update((row, i) for i in range(s, s + n))
    assert covered == Counter((k, i) for k, t in enumerate(texts) for i in range(max(0, len(t.split()) - 5)))


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(1, 6)), max_size=15))
def test_united_spans(spans):
    row, low, size = (np.array([s[k] for s in spans], np.int64) for k in range(3))
    a, b, c = segments.united(row, low, low + size)
    cells = {(r, i) for r, s, n in spans for i in range(s, s + n)}
    assert {(r, i) for r, s, e in zip(a.tolist(), b.tolist(), c.tolist()) for i in range(s, e)} == cells
    assert sum(c - b) == len(cells)


@given(st.lists(st.lists(st.sampled_from([b"x", b"y"]), max_size=20), max_size=5))
def test_repeated_words(texts):
    def plain(t):
        n = Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4))
        return len({i + k for i in range(len(t) - 4) if n[tuple(t[i : i + 5])] > 1 for k in range(5)})

    assert repeated_words(texts).tolist() == [plain(t) for t in texts]


@given(st.lists(st.one_of(st.none(), st.binary(max_size=9)), max_size=20), st.integers(1, 12))
def test_slices_cover_all(texts, most):
    parts = list(slices(texts, most))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(texts)))
    assert all(sum(map(bool, texts[a:b])) <= 1 or sum(len(t or b"") for t in texts[a:b]) <= most for a, b in parts)
