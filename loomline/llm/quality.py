"""Quality rules as a short-circuit cascade.

Every rule's cost (CPU time, with what it has to compute of a text first) and selectivity (share rejected) is measured on a
bounded sample; rules then run in descending order of rejection per cost, and a document leaves the cascade at the first rule
that rejects it, before anything that only later rules need is computed. The order changes only the cost: a document is kept
if no rule rejects it. The base rule is part of the cascade where only the verdict is wanted; where the base counts are results,
they are computed for every text.

Cases: a null text counts as empty; empty texts have no words and fail the base rule; a very long text is judged alone; equal
rows give equal rows; rules of equal worth keep their given order; an empty table gives an empty result and leaves the rules in
their order; columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import MIX, ODD, WHITE, as_bytes, bounded_batches, gram_hash, mix, slices

SYMBOLS = b"#*$%&|<>"
#: Documents whose texts are read, whole, to measure the rules.
SAMPLE = 256


class Doc:
    """A text whose features are computed when a rule first asks for them."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_chars(self) -> int:
        inked = self.text.translate(None, WHITE)
        return len(inked) if inked.isascii() else len(inked.decode("utf-8", "replace"))

    @cached_property
    def n_upper(self) -> int:
        """Words of two letters or more, all capitals."""
        return sum(len(w) > 1 and w.decode("utf-8", "replace").isupper() for w in self.words)

    @cached_property
    def n_shouted(self) -> int:
        return self.text.count(b"!!")

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter."""
        return sum(any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in self.words)


@dataclass(frozen=True)
class Rule:
    """`rejects` judges one document; rules that are cheaper on many documents at once have `reject_all`."""

    name: str
    rejects: Callable[[Doc], bool] | None = None
    reject_all: Callable[[list[Doc]], list[bool]] | None = None

    def judge(self, docs: list[Doc]) -> list[bool]:
        return self.reject_all(docs) if self.reject_all else [self.rejects(d) for d in docs]


#: Shares in hundredths, so that integer arithmetic decides.
RULES = (
    Rule("symbols", lambda d: 100 * d.n_symbols > 30 * d.n_words),
    Rule("shouting", lambda d: 100 * d.n_shouted > 20 * d.n_words),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words),
    Rule("repeated_lines", lambda d: len(d.lines) >= 4 and 100 * d.n_dup_lines > 50 * len(d.lines)),
    Rule("few_distinct", lambda d: d.n_words >= 50 and 100 * d.n_distinct < 2 * d.n_words),
    Rule("capitals", lambda d: 100 * d.n_upper > 60 * d.n_words),
    Rule("unlettered", lambda d: 100 * d.n_lettered < 60 * d.n_words),
)
LEAST_WORDS, MOST_REPEATED = 10, 20


def repeated_words(words: list[list[bytes]], width: int = 5) -> np.ndarray:
    """For each text, its words inside a window of `width` words that the text holds twice or more. Windows are found by their
    hashes and compared word by word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = int(lengths.sum())
    out = np.zeros(len(words), np.int64)
    if total < width:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.uint64, total)
    doc = np.repeat(np.arange(len(words)), lengths)
    inside = doc[: total - width + 1] == doc[width - 1 :]
    salt = np.uint64(0)
    while True:
        g = (gram_hash(mix(ids ^ salt), width) ^ (doc[: total - width + 1].astype(np.uint64) * MIX)) * ODD
        s = np.sort(g[inside])
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            return out
        at = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
        starts = np.flatnonzero(inside & (twice[at] == g))
        by = starts[np.argsort(g[starts], kind="stable")]
        same = g[by[1:]] == g[by[:-1]]
        left, right = by[:-1][same], by[1:][same]
        if (doc[left] == doc[right]).all() and all((ids[left + k] == ids[right + k]).all() for k in range(width)):
            break
        salt += ODD  # two windows shared a hash: hash anew
    cover = np.zeros(total + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(words)).astype(np.int64)


def over_repeated(docs: list[Doc]) -> list[bool]:
    repeats = repeated_words([d.words for d in docs]).tolist()
    return [100 * r > MOST_REPEATED * d.n_words for r, d in zip(repeats, docs)]


#: The base rule as two rules of a cascade.
BASE = (Rule("few_words", lambda d: d.n_words < LEAST_WORDS), Rule("repeated_words", reject_all=over_repeated))


def measured_order(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejection per second on the sample, best first; ties keep the given order. No sample: as given."""
    if not sample:
        return tuple(rules)
    worth = {}
    for rule in rules:
        fresh = [Doc(t) for t in sample]  # no feature is computed yet
        began = time.process_time()
        rejected = sum(rule.judge(fresh))
        worth[rule.name] = (rejected + 1e-3) / (len(fresh) + 1) / max(time.process_time() - began, 1e-6)
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def sample_texts(docs: DataFrame, id_col: str, text_col: str, n: int = SAMPLE) -> list[bytes]:
    """Whole texts of the n ids with the smallest hashes: the first pass reads ids only."""
    ids = [r[0] for r in docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(n).collect()]
    if not ids:
        return []
    rows = docs.where(F.col(id_col).isin(ids)).select(text_col).limit(n).collect()
    return [(r[0] or "").encode() for r in rows]


def cascade(docs: list[Doc], order: tuple[Rule, ...]) -> list[bool]:
    """Which documents no rule rejects; a rule sees those that the rules before it left."""
    kept = [True] * len(docs)
    alive = list(range(len(docs)))
    for rule in order:
        for i, out in zip(alive, rule.judge([docs[i] for i in alive])):
            kept[i] = not out
        alive = [i for i in alive if kept[i]]
    return kept


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base counts and the cascade's verdict for every document."""
    bounded_batches(docs.sparkSession)
    order = measured_order(sample_texts(docs, id_col, text_col), rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in slices(texts):
                ds = [Doc(t) for t in texts[i:j]]
                repeats = repeated_words([d.words for d in ds])
                failed = [d.n_words < LEAST_WORDS or 100 * int(r) > MOST_REPEATED * d.n_words for d, r in zip(ds, repeats)]
                passed = [d for d, f in zip(ds, failed) if not f]
                left = iter(cascade(passed, order))
                kept = [not f and next(left) for f in failed]
                cols = [[d.n_words for d in ds], [d.word_chars for d in ds], [d.n_symbols for d in ds], [d.n_dup_lines for d in ds], repeats]
                arrays = [batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *counts, "base_failed", "kept"])

    picked = docs.select(id_col, text_col)
    schema = f"`{id_col}` {picked.dtypes[0][1]}, " + ", ".join(f"{n} bigint" for n in counts) + ", base_failed boolean, kept boolean"
    return picked.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the base rule and the cascade keep, all columns unchanged."""
    bounded_batches(docs.sparkSession)
    order = measured_order(sample_texts(docs, id_col, text_col), BASE + rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for i, j in slices(texts):
                yield batch.slice(i, j - i).filter(pa.array(cascade([Doc(t) for t in texts[i:j]], order), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
