"""License scan: phrase places, and an exact containment join of text blocks with license templates.

A template is a notice, or the part of a license text that tells it, as licensors publish it, with the phrases that name the
license and its version. A block is a run of consecutive words of a document, as long as the template and a quarter more
(two words at least), wherever lines and paragraphs end. A template is found where a block holds at least THRESHOLD of its distinct
tokens, and in the block each of its phrases stands word by word: "version 3" can't be "version 2", "cc by" can't be
"cc by nc", whatever the share of the tokens.

The join is a prefix-filter set-similarity join. Tokens are ordered by their frequency in the whole corpus, rarest first.
A block that holds at least ceil(threshold x |T|) of the |T| distinct tokens of template T holds one of T's first
|T| - ceil(threshold x |T|) + 1 tokens (prefix filter), has at least ceil(threshold x |T|) tokens (length filter), and the
first shared token's place leaves enough tokens after it (positional filter). A document's blocks hold no more than the document, so
the filters, on the document's tokens, say which templates need a sweep over blocks; the sweep is exact, so every block
that meets the threshold is found. Templates are a fixed list, so their index travels with the task. Blocks stay where they
are: nothing is shuffled but the token counts.

Cases: a null text is empty and has no words, places or labels; a very long text is swept once for each template that passes the
filters, holding one block; of blocks with equal shares any counts; equal texts give equal rows; an empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import ALNUM, as_bytes, bounded_batches

#: Phrase -> label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that must stand in the block; no phrase: the tokens alone decide.
    phrases: tuple[str, ...] = ()


#: Notices and telling parts of license texts, as published.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ("apache license", "2 0"),
    ),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge",),
    ),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use",)),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products",),
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license", "2 0")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)
#: The GNU licenses, their versions; the Creative Commons elements, their names and versions.
GNU = (("gpl", "GNU General Public License", ("2", "3")), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("agpl", "GNU Affero General Public License", ("3",)))
ELEMENTS = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nc": "Attribution-NonCommercial",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def spelt(text: str) -> str:
    """A text's words as the scan sees them."""
    return " ".join(w.decode() for w in words_of(text.encode()))


def templates() -> tuple[Template, ...]:
    """All templates: the notices, and those that a family's members share but for name and version."""
    out = list(NOTICES)
    for short, name, versions in GNU:
        for version in versions:
            label = f"{short}-{version}.0" if "." not in version else f"{short}-{version}"
            phrases = (spelt(name), spelt(f"version {version}"))
            out.append(Template(label, f"This work is licensed under the {name}, version {version}", phrases))
            out.append(
                Template(
                    label,
                    f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} "
                    "of the License, or (at your option) any later version.",
                    phrases,
                )
            )
    for element, name in ELEMENTS.items():
        for version in CC_VERSIONS:
            label = f"cc-{element}-{version}"
            out.append(Template(label, f"CC {element.upper()} {version}", (spelt(f"cc {element} {version}"),)))
            out.append(Template(label, f"Creative Commons {name} {version} International License", (spelt(f"creative commons {name} {version}"),)))
    return tuple(out)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def starts(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """Places where a phrase's words stand one after another."""
    by_first: dict[bytes, list[tuple[bytes, ...]]] = {}
    for p in phrases:
        by_first.setdefault(p[0], []).append(p)
    out = []
    for first, longer in by_first.items():
        at = -1
        for _ in range(words.count(first)):
            at = words.index(first, at + 1)
            out += [(at, phrases[p]) for p in longer if tuple(words[at : at + len(p)]) == p]
    return sorted(out)


def block_words(n: int) -> int:
    """Words of a block for a template of n words."""
    return n + max(2, n // 4)


class ContainmentIndex:
    """Templates by the tokens of their prefixes, under one global order of tokens."""

    def __init__(self, found: tuple[Template, ...], frequency: dict[bytes, int], threshold: float):
        words = [words_of(t.text.encode()) for t in found]
        self.label = [t.label for t in found]
        self.phrases = [[tuple(words_of(p.encode())) for p in t.phrases] for t in found]
        self.tokens = [set(w) for w in words]
        self.length = [block_words(len(w)) for w in words]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.tokens]
        self.rank = {t: i for i, t in enumerate(sorted(set().union(*self.tokens), key=lambda t: (frequency.get(t, 0), t)))}
        self.ranked = [sorted(self.rank[t] for t in s) for s in self.tokens]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.ranked):
            for place, token in enumerate(s[: len(s) - self.need[k] + 1] if s else ()):
                self.prefix.setdefault(token, []).append((k, place))
        self.least = min(self.need, default=0)
        self.keys = {t for t, r in self.rank.items() if r in self.prefix}

    def candidates(self, block: set[bytes]) -> list[int]:
        """Every template of which the block, a set of tokens, meets the threshold."""
        mine = sorted(self.rank[t] for t in block if t in self.rank) if len(block) >= self.least else []
        held, tried, out = set(mine), set(), []
        for i, token in enumerate(mine):
            for k, place in self.prefix.get(token, ()):
                if k in tried:
                    continue
                tried.add(k)  # tokens come in order: this is the first that the two share
                if min(len(self.ranked[k]) - place, len(mine) - i) < self.need[k]:
                    continue
                if sum(t in held for t in self.ranked[k]) >= self.need[k]:
                    out.append(k)
        return out

    def share(self, words: list[bytes], k: int) -> float:
        """The largest share of template k's tokens in a block of the words that meets the threshold and holds its phrases; 0: none."""
        tokens, length, need = self.tokens[k], self.length[k], self.need[k]
        where = [[at for at, _ in starts(words, {p: ""})] for p in self.phrases[k]]
        if not all(where):
            return 0.0
        best = 0
        held: Counter[bytes] = Counter()
        inside: deque[int] = deque()
        for at, word in enumerate(words):
            if word not in tokens:
                continue
            inside.append(at)
            held[word] += 1
            while inside[0] <= at - length:
                gone = words[inside.popleft()]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            if len(held) > best and len(held) >= need and all(self.within(w, p, at - length + 1, at) for w, p in zip(where, self.phrases[k])):
                best = len(held)
        return best / len(tokens)

    @staticmethod
    def within(where: list[int], phrase: tuple[bytes, ...], a: int, b: int) -> bool:
        """Whether a phrase that stands at these places stands among words a to b."""
        i = bisect_left(where, a)
        return i < len(where) and where[i] + len(phrase) - 1 <= b

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """The labels of templates found in the words, with their largest shares."""
        out: dict[str, float] = {}
        if self.keys.isdisjoint(words):
            return out
        for k in self.candidates(set(words)):
            share = self.share(words, k)
            if share:
                out[self.label[k]] = max(share, out.get(self.label[k], 0.0))
        return out


def token_counts(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each token of the vocabulary stands in the corpus: over all documents, pre-summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total.update(filter(vocabulary.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    counts = docs.select(text_col).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n"))
    return {bytes(r[0]): r[1] for r in counts.collect()}  # as many rows as the vocabulary has tokens at most


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, found: tuple[Template, ...] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Per document: words, phrase places, labels of phrases and of templates found in one of its blocks; `score` is the
    largest share of a template's tokens found, 0 where no template is."""
    bounded_batches(docs.sparkSession)
    found = templates() if found is None else found
    vocabulary = {w for t in found for w in words_of(t.text.encode())}
    index = ContainmentIndex(found, token_counts(docs, text_col, vocabulary), threshold)
    wanted = {tuple(words_of(p.encode())): label for p, label in phrases.items()}
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                places = starts(words, wanted)
                base = {label for _, label in places}
                shares = index.matches(words)
                first, last = (places[0][0], places[-1][0]) if places else (None, None)
                rows.append((len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base.union(shares))), max(shares.values(), default=0.0)))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    picked = docs.select(id_col, text_col)
    schema = f"`{id_col}` {picked.dtypes[0][1]}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return picked.mapInArrow(run, schema)
