"""Byte-level deduplication by suffix order and longest-previous-factor arrays.

Texts are UTF-8 bytes; windows of `window` bytes are partitioned by minimiser (see segments.py), so a bucket holds every
occurrence of the windows it is about. There the suffixes that start a window are put in suffix order to a depth of `window`
bytes, 8 bytes a round, only those still tied going on, with the common prefix of neighbours. Places are numbered in
corpus order (row, then start). A suffix's longest previous factor is the longer of its common prefixes with two others: the
nearest one before it and the nearest one after it in suffix order whose place is smaller. A window whose longest previous
factor reaches its length is a later copy. Mirrored (nearest larger places) the same sweep gives the longest next factor, which tells
the first copies. The operator removes later copies and keeps the first (`keep_first`, the default); the query wants every
byte covered by a string that also starts anywhere else, so it takes both arrays.

Cases: null and empty texts have no bytes; texts shorter than a window stay whole; a very long text is hashed piece by piece;
cuts may split a character, so kept text is bytes; repeated rows are repeats of each other, of equal rows the one with the
smallest number is the first; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.segments import Unit, mask, runs, with_repeats

WINDOW = 200
GRAM = 32


def common_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bytes that two 8-byte numbers share."""
    differ = x ^ y
    return sum((differ < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8)) + (differ == 0)


def suffix_order(packed: list[bytes], window: int):
    """(windows before each string, all windows in suffix order, the common prefix of each with the next), to a depth of
    `window` bytes."""
    lengths = np.fromiter(map(len, packed), np.int64, len(packed))
    counts = np.maximum(lengths - window + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    n = int(before[-1])
    if not n:
        return before, np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(packed) + bytes(8), np.uint8)
    # The 8 bytes from each place on, as one number that sorts like them.
    eight = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | raw[k : len(raw) - 7 + k]
    place = np.arange(n) - np.repeat(before[:-1], counts) + np.repeat(np.cumsum(lengths) - lengths, counts)
    order = np.argsort(eight[place], kind="stable")
    value = eight[place[order]]
    tied = value[1:] == value[:-1]
    common = np.where(tied, window, common_bytes(value[1:], value[:-1]))
    for depth in range(8, window, 8):
        step = min(depth, window - 8)  # the last round looks at the window's last 8 bytes
        loose = np.zeros(n, bool)
        loose[1:] |= tied
        loose[:-1] |= tied
        at = np.flatnonzero(loose)
        if not len(at):
            break
        head = np.ones(n, bool)
        head[1:] = ~tied
        group = np.cumsum(head)[at]
        value = eight[place[order[at]] + step]
        by = np.lexsort((value, group))
        order[at] = order[at[by]]
        value = value[by]
        together = group[1:] == group[:-1]
        apart = np.flatnonzero(together & (value[1:] != value[:-1]))
        common[at[apart]] = step + common_bytes(value[apart], value[apart + 1])
        tied[at[apart]] = False
    return before, order, common


#: Rounds of pointer jumps before the rest is swept with a stack.
JUMPS = 48


def smaller_before(place: np.ndarray, common: np.ndarray, least: int = 0) -> np.ndarray:
    """For each suffix in suffix order, its common prefix with the nearest one before it whose place is smaller (0: none).

    common[i] is that of suffixes i and i + 1. Values below `least` need not be exact: nothing looks for a suffix beyond
    them. Every suffix points to the one before it, and while that has a larger place, to what that one points to."""
    n = len(place)
    value = np.concatenate([[-1], place])  # a suffix before all others, of no length
    reach = np.concatenate([[0, 0], common]) if n > 1 else np.zeros(n + 1, np.int64)
    to = np.maximum(np.arange(n + 1) - 1, 0)
    on = np.arange(1, n + 1)
    for _ in range(JUMPS):
        on = on[(value[to[on]] > value[on]) & (reach[on] >= least)]
        if not len(on):
            return reach[1:]
        over = to[on]
        nearer, further = np.minimum(reach[on], reach[over]), to[over]
        reach[on], to[on] = nearer, further
    link, found = to.tolist(), reach.tolist()
    places = value.tolist()
    for i in on.tolist():  # in suffix order, so what lies before i is settled
        while places[link[i]] > places[i] and found[i] >= least:
            found[i], link[i] = min(found[i], found[link[i]]), link[link[i]]
    return np.array(found[1:], np.int64)


def longest_previous(place: np.ndarray, common: np.ndarray, least: int = 0) -> np.ndarray:
    """The longest-previous-factor array in suffix order: previous and next smaller places, whichever shares more."""
    return np.maximum(smaller_before(place, common, least), smaller_before(place[::-1], common[::-1], least)[::-1])


def factored(packed: list[bytes], weight: np.ndarray, row: np.ndarray, start: np.ndarray, window: int):
    """Which windows of the packed strings occur anywhere else, and which at an earlier place."""
    before, order, common = suffix_order(packed, window)
    of = np.repeat(np.arange(len(packed)), np.diff(before))
    place = np.empty(len(of), np.int64)
    place[np.lexsort((start[of] + np.arange(len(of)) - before[of], row[of]))] = np.arange(len(of))
    anywhere = weight[of] > 1  # a string that occurs twice is a factor of its own copy
    earlier = np.zeros(len(of), bool)
    earlier[order] = longest_previous(place[order], common, window) >= window
    anywhere[order] |= longest_previous(-place[order] + len(of), common, window) >= window
    return before, anywhere | earlier, earlier


def octet_unit(window: int = WINDOW, gram: int = GRAM) -> Unit:
    hashes = lambda t: np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1)
    return Unit(window, gram, lambda t: t, hashes, bytes, lambda *strings: factored(*strings, window))


def byte_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_first: bool = True, with_kept: bool = False, **sizes
) -> DataFrame:
    """Per row: bytes, bytes removed, removed runs, the digest of the kept bytes (and, with_kept, those bytes). Later copies of
    a window go; without keep_first every copy does."""

    def finish(rows: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        n, gone, cuts, digest, left = [], [], [], [], []
        for text, found in zip(rows.column(text_col).cast(pa.binary()).to_pylist(), spans):
            text = text or b""
            drop = mask(len(text), found)
            kept = text if not len(found) else np.frombuffer(text, np.uint8)[~drop].tobytes()
            n.append(len(text))
            gone.append(len(text) - len(kept))
            cuts.append(len(runs(drop, np.zeros(len(drop), np.int8))[0]) if len(found) else 0)
            digest.append(hashlib.sha256(kept).hexdigest())
            left.append(kept)
        long = {k: pa.array(v, pa.int64()) for k, v in (("n_bytes", n), ("n_removed", gone), ("n_spans", cuts))}
        more = {"kept": pa.array(left, pa.binary())} if with_kept else {}
        return pa.table({id_col: rows.column(id_col), **long, "kept_sha256": pa.array(digest, pa.string()), **more})

    picked = docs.select(id_col, text_col)
    schema = f"`{id_col}` {picked.dtypes[0][1]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return with_repeats(picked, octet_unit(window, gram), finish, schema, text_col, keep_first, **sizes)
