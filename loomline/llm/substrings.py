"""Substring deduplication over words by super-k-mers.

Windows of `window` words are partitioned by minimiser (see segments.py); in a bucket the windows of the distinct packed
strings are sorted, which counts every window exactly, and the words of windows that occur more than once are removed.

Cases: null and empty texts have no words; texts shorter than a window keep every word; a very long text is hashed piece by
piece and its own repeats count; repeated rows are repeats of each other; with keep_first ties between equal rows go by row
number; an empty table gives an empty result; further columns are carried by `remove_words` and ignored by `word_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import WordHash, gram_hash
from loomline.llm.segments import Unit, mask, with_repeats

WINDOW = 35
GRAM = 8


def sorted_windows(packed: list[bytes], window: int, hashed: WordHash):
    """Windows of the packed strings in an order in which equal ones adjoin; equality is checked word by word."""
    units = [p.split(b" ") for p in packed]
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    counts = np.maximum(lengths - window + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    if not before[-1]:
        return before, np.empty(0, np.int64), np.empty(0, bool)
    h = hashed([w for ws in units for w in ws])
    place = np.arange(before[-1]) - np.repeat(before[:-1], counts) + np.repeat(np.cumsum(lengths) - lengths, counts)
    salt = np.uint64(0)
    while True:
        g = gram_hash(h ^ salt, window)[place]
        order = np.argsort(g, kind="stable")
        alike = np.flatnonzero(g[order][1:] == g[order][:-1])
        left, right = place[order[alike]], place[order[alike + 1]]
        equal = np.ones(len(alike), bool)
        for k in range(window):
            equal &= h[left + k] == h[right + k]
        if equal.all():
            same = np.zeros(len(order) - 1, bool)
            same[alike] = True
            return before, order, same
        salt += np.uint64(0x9E3779B97F4A7C15)  # two windows shared a hash: hash anew


def counted_windows(packed: list[bytes], weight: np.ndarray, row: np.ndarray, start: np.ndarray, window: int, hashed: WordHash):
    """Which windows of the packed strings occur anywhere else, and which at an earlier place."""
    before, order, same = sorted_windows(packed, window, hashed)
    n = len(order)
    anywhere, earlier = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        of = np.repeat(np.arange(len(packed)), np.diff(before))
        total = np.add.reduceat(weight[of[order]], head)
        anywhere[order] = np.repeat(total > 1, np.diff(np.append(head, n)))
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(np.concatenate([[True], ~same]))
        at = np.lexsort((start[of] + np.arange(n) - before[of], row[of], group))
        earlier[at[1:]] = group[at[1:]] == group[at[:-1]]
    return before, anywhere, earlier


def words(window: int = WINDOW, gram: int = GRAM) -> Unit:
    hashed = WordHash()
    return Unit(window, gram, bytes.split, hashed, b" ".join, lambda *strings: counted_windows(*strings, window, hashed))


def word_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_first: bool = False, **sizes) -> DataFrame:
    """Per row: words, words removed and the digest of the kept ones."""

    def finish(rows: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        n, gone, digest = [], [], []
        for text, found in zip(rows.column(text_col).cast(pa.binary()).to_pylist(), spans):
            ws = (text or b"").split()
            drop = mask(len(ws), found)
            kept = ws if not len(found) else [w for w, d in zip(ws, drop.tolist()) if not d]
            n.append(len(ws))
            gone.append(len(ws) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({id_col: rows.column(id_col), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    picked = docs.select(id_col, text_col)
    schema = f"`{id_col}` {picked.dtypes[0][1]}, n_words bigint, n_removed bigint, kept_sha256 string"
    return with_repeats(picked, words(window), finish, schema, text_col, keep_first, **sizes)


def remove_words(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", window: int = WINDOW, keep_first: bool = False, **sizes) -> DataFrame:
    """The same rows and columns with repeated words gone: a changed text is its kept words joined by one space, and
    `length_col`, if there is one, holds its new number of characters."""

    def finish(rows: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        texts, lengths = [], []
        had = rows.column(length_col).to_pylist() if length_col in rows.column_names else []
        for k, (text, found) in enumerate(zip(rows.column(text_col).to_pylist(), spans)):
            if len(found):
                ws = text.encode().split()
                text = b" ".join(w for w, d in zip(ws, mask(len(ws), found).tolist()) if not d).decode()
            texts.append(text)
            lengths.append(len(text) if len(found) else had[k] if had else None)
        for name, values in ((text_col, texts), (length_col, lengths)):
            if name in rows.column_names:
                at = rows.column_names.index(name)
                rows = rows.set_column(at, name, pa.array(values, rows.schema.field(name).type))
        return rows

    return with_repeats(docs, words(window), finish, docs.schema, text_col, keep_first, **sizes)
