"""English words as an error rate should count them: numbers as digits, contractions spelt out, fillers and asides gone."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Number words, contractions, fillers, titles.
SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
CONTRACTIONS = {"won't": "will not", "can't": "can not", "let's": "let us", "ain't": "is not", "y'all": "you all", "gonna": "going to", "wanna": "want to", "gotta": "got to"}
ENDINGS = {"n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'m": " am", "'d": " would", "'s": " is"}
IS_WORDS = {"it", "he", "she", "that", "there", "what", "who", "where", "here", "how"}
FILLERS = {"hm", "hmm", "mm", "mhm", "mmm", "uh", "um", "er", "erm"}
TITLES = {"mr": "mister", "mrs": "missus", "dr": "doctor", "st": "saint", "prof": "professor", "vs": "versus", "etc": "et cetera"}
#: British endings with the American ones, the shortest word they are changed in, and words that end so by themselves.
SPELLINGS = (("ours", "ors", 6), ("oured", "ored", 7), ("ouring", "oring", 8), ("ourable", "orable", 8), ("ourite", "orite", 8), ("ourful", "orful", 8), ("our", "or", 5),
             ("isations", "izations", 10), ("isation", "ization", 9), ("ised", "ized", 7), ("ises", "izes", 7), ("ising", "izing", 8), ("ise", "ize", 6),
             ("ysed", "yzed", 6), ("yses", "yzes", 6), ("ysing", "yzing", 7), ("yse", "yze", 5), ("elled", "eled", 7), ("elling", "eling", 8), ("eller", "eler", 7), ("ogues", "ogs", 8), ("ogue", "og", 7),
             ("tres", "ters", 6), ("tre", "ter", 5))
UNCHANGED = {
    "hours", "yours", "flour", "floured", "flouring", "scour", "devour", "devoured", "devouring", "detour", "contour", "contours", "velour", "troubadour", "glamour", "paramour", "tours", "pours", "fours", "sours",
    "exercise", "exercised", "exercises", "exercising", "surprise", "surprised", "surprises", "surprising", "promise", "promised", "promises", "promising", "otherwise", "likewise", "advertise", "advertised", "advertising",
    "advise", "advised", "advises", "advising", "revise", "revised", "revises", "revising", "supervise", "supervised", "supervising", "comprise", "comprised", "comprises", "comprising", "enterprise", "enterprises", "expertise", "precise",
    "concise", "paradise", "franchise", "disguise", "disguised", "improvise", "improvised", "compromise", "compromised", "merchandise", "televise", "televised", "despise", "despised", "demise", "devise", "devised", "devising", "treatise", "tortoise",
    "porpoise", "arising", "raising", "praising", "poising", "noising", "noises", "poised", "raised", "praised", "bruised", "cruised", "bruises", "cruises", "cruising", "bruising", "praises", "raises", "precisely", "premise", "premises", "surmise",
    "spelled", "spelling", "speller", "smelled", "smelling", "dwelled", "dwelling", "dweller", "swelled", "swelling", "yelled", "yelling", "selling", "seller", "telling", "teller", "propelled", "propelling", "compelled", "compelling", "expelled",
    "expelling", "rebelled", "rebelling", "excelled", "excelling", "quelled", "shelled", "shelling", "felled", "welling", "welled", "dialogue", "prologue", "epilogue", "vogue", "rogue", "analyses",
}
#: Words spelt apart from any rule.
SPELT = {"grey": "gray", "defence": "defense", "offence": "offense", "licence": "license", "pretence": "pretense", "programme": "program", "programmes": "programs", "tyre": "tire", "tyres": "tires", "kerb": "curb",
         "plough": "plow", "cheque": "check", "cheques": "checks", "storey": "story", "pyjamas": "pajamas", "mum": "mom", "aluminium": "aluminum", "sceptical": "skeptical", "cosy": "cozy", "jewellery": "jewelry"}
ASIDES = re.compile(r"[<\[][^>\]]*[>\]]|\([^)]*\)")
WORD = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+(?:'[^\W\d_]+)?")


def spelt_out(word: str) -> list[str]:
    """A contraction's words; a possessive keeps its own."""
    if word in CONTRACTIONS:
        return CONTRACTIONS[word].split()
    for ending, full in ENDINGS.items():
        stem = word.removesuffix(ending)
        if stem != word and stem and (ending != "'s" or stem in IS_WORDS):
            return (stem + full).split()
    return [word.replace("'", "")]


def in_digits(words: list[str]) -> list[str]:
    """Runs of number words as numbers: a run ends where the next word can't be part of it."""
    out: list[str] = []
    total = part = 0
    last = None  # the kind of the number word before: what may follow it

    def close() -> None:
        nonlocal total, part, last
        if last is not None:
            out.append(str(total + part))
        total, part, last = 0, 0, None

    for k, w in enumerate(words):
        after = words[k + 1] if k + 1 < len(words) else ""
        if w in SMALL or w in TENS:
            fits = last in (None, "hundred", "scale") or (last == "tens" and 0 < SMALL.get(w, 99) < 10)
            if not fits:
                close()
            part += SMALL.get(w, 0) + TENS.get(w, 0)
            last = "tens" if w in TENS else "small"
        elif w == "hundred" and last in ("small", "tens"):
            part, last = part * 100, "hundred"
        elif w in SCALES and last is not None and part:
            total, part, last = total + part * SCALES[w], 0, "scale"
        elif not (w == "and" and last in ("hundred", "scale") and (after in SMALL or after in TENS)):
            close()
            out.append(w)
    close()
    return out


def american(word: str) -> str:
    """A British spelling as the American one; others as they are."""
    if word in SPELT or word in UNCHANGED:
        return SPELT.get(word, word)
    for british, own, least in SPELLINGS:
        if len(word) >= least and word.endswith(british):
            return word.removesuffix(british) + own
    return word


def english_words(text: str) -> list[str]:
    plain = unicodedata.normalize("NFKC", ASIDES.sub(" ", text)).lower().replace("’", "'").replace("%", " percent ")
    plain = re.sub(r"(?<=\d),(?=\d{3})", "", plain)
    words = [x for w in WORD.findall(plain) if w not in FILLERS for x in spelt_out(w)]
    return in_digits([american(y) for w in words for y in TITLES.get(w, w).split()])


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_kept_words(texts: pd.Series) -> pd.Series:
    """The words of English texts, for word errors; null has none."""
    return texts.map(lambda t: english_words(t) if isinstance(t, str) else [])
