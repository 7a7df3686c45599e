"""Word alignment: edit distance, words missing at the end, completeness flags, and sentence pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the completeness rule.
MISSING_WORDS, MISSING_SHARE, CHECK_RATE = 2, 1 / 3, 0.25
CUT_OFF_DB, SHORT, LONG, LONG_S = 15.0, 0.5, 2.5, 1.0
#: Distinct words of a pair become the characters from here on, beyond the surrogates; so many there are.
FIRST_CHAR = 0x10000
NATIVE_WORDS = 0x110000 - FIRST_CHAR


def word_errors_native(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of two word arrays through the character-level builtin: each distinct word becomes one
    character. More than NATIVE_WORDS distinct words in a pair raise an error."""
    words = F.array_distinct(F.concat(ref, hyp))
    digits = lambda w: F.lpad(F.hex(F.array_position(words, w) + (FIRST_CHAR - 1)), 8, "0")
    spell = lambda side: F.decode(F.unhex(F.array_join(F.transform(side, digits), "")), "UTF-32")
    empty = F.when(F.size(ref) == 0, F.size(hyp)).when(F.size(hyp) == 0, F.size(ref))
    fits = F.when(F.size(words) > NATIVE_WORDS, F.raise_error(F.lit("too many distinct words in a pair")).cast("int"))
    return F.coalesce(empty, fits, F.levenshtein(spell(ref), spell(hyp)))


#: Differences that are looked for along diagonals, at first and at most, before whole columns are computed.
NEAR, NEAR_AT_MOST = 8, 512


def near_distance(ref: list[str], hyp: list[str], most: int) -> tuple[int | None, int]:
    """The edit distance if it is at most `most`, else None, and how many reference words were reached.

    Of each diagonal only the farthest word that e differences reach is kept, for e from 0 on: the work grows with the square of the
    distance and once with the length."""
    n, m = len(ref), len(hyp)
    goal, far = n - m, {}
    for e in range(most + 1):
        now = {}
        for d in range(-e, e + 1):  # diagonal: reference words less heard words
            i = 0 if not e else max(far.get(d, -2) + 1, far.get(d - 1, -2) + 1, far.get(d + 1, -2))
            i = min(i, n, m + d)
            if i < max(0, d):
                continue
            while i < n and i - d < m and ref[i] == hyp[i - d]:
                i += 1
            now[d] = i
        if now.get(goal) == n:
            return e, n
        far = now
    return None, max(far.values(), default=0)


class Columns:
    """The alignment table column by column, a heard word each. A column is two numbers of a bit a reference word: where the cost
    rises by one from the word before (up) and where it falls by one (down). Python's numbers are as long as the reference,
    so a column costs some twenty operations on them whatever the texts."""

    def __init__(self, ref: list[str], hyp: list[str]):
        self.hyp, self.all, self.top = hyp, (1 << len(ref)) - 1, 1 << max(0, len(ref) - 1)
        self.of: dict[str, int] = {}
        for i, w in enumerate(ref):
            self.of[w] = self.of.get(w, 0) | 1 << i

    def step(self, word: str, up: int, down: int) -> tuple[int, int, int, int]:
        """The next column's (up, down), and where a row's cost rises or falls from the column before."""
        same = self.of.get(word, 0)
        level = (((same & up) + up) ^ up) | same | down
        rises, falls = down | (self.all & ~(level | up)), level & up
        above = (rises << 1 | 1) & self.all
        return (falls << 1 & self.all) | (self.all & ~(level | above)), above & level, rises, falls

    def run(self, every: int) -> tuple[int, list[tuple[int, int]]]:
        """The distance, and the column before each `every` words."""
        up, down, cost, kept = self.all, 0, self.all.bit_length(), []
        for j, word in enumerate(self.hyp):
            if j % every == 0:
                kept.append((up, down))
            up, down, rises, falls = self.step(word, up, down)
            cost += bool(rises & self.top) - bool(falls & self.top)
        return cost, kept


def edit_distance(ref: list[str], hyp: list[str]) -> int:
    """Word-level edit distance. Equal words at both ends are set aside; few differences are found along diagonals, whose number
    doubles while the words reached so far promise a fit; else the columns are run."""
    begun, end = 0, min(len(ref), len(hyp))
    while begun < end and ref[begun] == hyp[begun]:
        begun += 1
    cut = 0
    while cut < end - begun and ref[-1 - cut] == hyp[-1 - cut]:
        cut += 1
    ref, hyp = ref[begun : len(ref) - cut], hyp[begun : len(hyp) - cut]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    most = NEAR
    while abs(len(ref) - len(hyp)) <= most <= NEAR_AT_MOST:
        found, reached = near_distance(ref, hyp, most)
        if found is not None:
            return found
        promised = most * len(ref) / max(1, reached)
        if promised * promised > 4 * len(hyp) * (1 + len(ref) / 2000):  # the columns are cheaper
            break
        most *= 2
    return Columns(ref, hyp).run(len(hyp))[0]


def last_match_lead(ref: list[str], hyp: list[str]) -> int:
    """By how many words the reference is ahead where an optimal alignment last matches a word exactly, 0 where it matches none.

    The alignment is followed back from its end only as far as that match; of steps of equal cost a match goes before a swap, a
    lost word and an added word. Columns are kept at intervals and made again, interval by interval, as far as they are needed."""
    i, j = len(ref), len(hyp)
    if not i or not j:
        return 0
    columns, every = Columns(ref, hyp), max(64, int(len(hyp) ** 0.5))
    kept = None
    block: list[tuple[int, int, int, int]] = []
    first = j  # of the heard words whose columns are in `block`
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            return i - j
        if j <= first:
            if kept is None:
                kept = columns.run(every)[1]
            first = (j - 1) // every * every
            up, down = kept[first // every]
            block = []
            for word in hyp[first:j]:
                up, down, rises, falls = columns.step(word, up, down)
                block.append((up, down, rises, falls))
        up, down, rises, falls = block[j - 1 - first]
        at = 1 << (i - 1)
        rise = bool(up & at) - bool(down & at)
        before = bool(rises & at >> 1) - bool(falls & at >> 1) if i > 1 else 1  # the row above, from the column before
        if rise + before == 1:
            i, j = i - 1, j - 1
        elif rise == 1:
            i -= 1
        else:
            j -= 1
    return 0


def missing_at_end(ref: list[str], hyp: list[str]) -> int:
    """Reference words after the last matched one, less the heard words after it."""
    return max(0, len(ref) - len(hyp) - last_match_lead(ref, hyp))


@F.pandas_udf(T.IntegerType())
def word_errors(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word-level edit distance of two word arrays of any vocabulary."""
    return pd.Series([edit_distance(r.tolist(), h.tolist()) for r, h in zip(ref, hyp)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def trailing_missing(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([missing_at_end(r.tolist(), h.tolist()) for r, h in zip(ref, hyp)], dtype="int32")


def audio_problem(gap_db: Column, duration_s: Column, chars: Column, pace: Column) -> Column:
    """Whether a clip is cut off, too short or too long for its text at its style's pace (characters a second)."""
    expected = chars / pace
    return (
        F.when(gap_db < CUT_OFF_DB, "cut_off")
        .when(duration_s < expected * SHORT, "too_short")
        .when(duration_s > expected * LONG + LONG_S, "too_long")
    )


def completeness(missing: Column, ref_words: Column, problem: Column, errors: Column) -> Column:
    """incomplete, check or null, in this order of rules."""
    return (
        F.when((missing >= MISSING_WORDS) | ((missing >= 1) & (missing / ref_words >= MISSING_SHARE)), "incomplete")
        .when(problem == "too_long", "check")
        .when(problem.isNotNull(), "incomplete")
        .when(errors / ref_words >= CHECK_RATE, "check")
    )


MOST_WORDS, LEAST_EDGE, LEAD_IN = 14, 3, 2
#: Words before which a long clause may be cut, and pauses in seconds by a piece's last character.
CUT_BEFORE = {
    "and", "but", "or", "so", "because", "until", "before", "after", "while", "when", "where", "who", "which", "that", "if",
    "though", "although", "unless", "since", "with", "without", "to", "from", "into", "at", "on", "in",
}
PAUSES = {",": 0.25, ";": 0.3, ":": 0.3, ".": 0.45, "!": 0.45, "?": 0.45}
PAUSE_ELSE = 0.15


SENTENCE_END, CLAUSE_END = ".!?", ",;:"


def middle_cut(words: list[str], a: int, b: int) -> int:
    """Where to cut words a to b in two: looking outwards from the middle, the first listed word, else the middle."""
    middle = a + (b - a) // 2
    outwards = (k for away in range(b - a) for k in (middle - away, middle + away))
    return next((k for k in outwards if a + LEAST_EDGE <= k <= b - LEAST_EDGE and words[k].lower() in CUT_BEFORE), middle)


def cut_places(words: list[str], most: int) -> list[int]:
    """Ends of the pieces, from one pass over the places where a word ends a clause.

    A piece stays open while its next clause fits. A clause too long by itself is cut in the middle until its parts fit; what
    is open goes along with it if that is a lead-in of one or two words."""
    ends: set[int] = set()
    begun = clause = 0
    for end in range(1, len(words) + 1):
        last = words[end - 1][-1]
        if last not in SENTENCE_END + CLAUSE_END and end < len(words):
            continue
        if end - begun > most:
            if end - clause <= most or clause - begun > LEAD_IN:
                ends.add(clause)
                begun = clause
            wide = [(begun, end)] if end - begun > most else []
            for a, b in wide:  # grows while it is read
                at = middle_cut(words, a, b)
                ends.add(at)
                wide += [(x, y) for x, y in ((a, at), (at, b)) if y - x > most]
            if wide:
                begun = end
        if last in SENTENCE_END or end == len(words) or begun == end:
            ends.add(end)
            begun = end
        clause = end
    return sorted(ends - {0})


def pieces(text: str, most: int = MOST_WORDS) -> list[tuple[str, float]]:
    """Short pieces of a text with the pause after each."""
    words = text.split()
    ends = cut_places(words, most)
    out = [" ".join(words[a:b]) for a, b in zip([0, *ends], ends)]
    return [(p, PAUSES.get(p[-1:], PAUSE_ELSE)) for p in out]


@F.pandas_udf(T.ArrayType(T.StructType().add("piece", T.StringType()).add("pause", T.DoubleType())))
def sentence_pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: [] if t is None else [{"piece": p, "pause": s} for p, s in pieces(t)])
