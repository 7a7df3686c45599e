"""Scalar text functions as native column expressions, and an exact Arrow twin where Spark has no builtin."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.pieces import by_pieces

#: Apostrophes that vanish and curly ones that count as straight.
APOSTROPHES = "'`‘’"
SPACES = r"[\s   -     　\u0085\u001C-\u001F]+"


def squeeze(text: Column) -> Column:
    """White-space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


#: Characters that NFKC leaves as they are, next to any other of them, and that both engines fold and class alike.
SETTLED = r"\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u0400-\u0482\u2013\u2014\u2018-\u201F\u20AC\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5"


def normalize_native(text: Column) -> Column:
    """Lower case, apostrophes gone, punctuation to spaces, white space squeezed; right for texts of settled characters."""
    plain = F.regexp_replace(F.lower(text), f"[{APOSTROPHES}]+", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}_]+", " "))


GONE, OTHER, BLANK = re.compile(f"[{APOSTROPHES}]"), re.compile(r"[^\w\s]"), re.compile(r"\s+")


def normalized(text: str | None) -> str | None:
    """NFKC, then the same by Python's own notion of a word character."""
    if text is None:
        return None
    plain = OTHER.sub(" ", GONE.sub("", unicodedata.normalize("NFKC", text).lower()))
    return BLANK.sub(" ", plain).strip()


def normalize_transcript_exact(text: Column) -> Column:
    """The same of a column, a few megabytes of text at a time."""
    return by_pieces(lambda texts: [normalized(t) for t in texts], "string", "normalize_transcript_exact")(text)


def normalize_transcript(text: Column) -> Column:
    """The normal form that keys are made of: native where all characters are settled, and only the other texts go to Python."""
    other = text.rlike(rf"(?![\x00-\x7F])[^{SETTLED}]")  # most characters fail at the first, cheap test
    return F.coalesce(normalize_transcript_exact(F.when(other, text)), normalize_native(text))


def strip_emphasis(text: Column) -> Column:
    """Without *emphasis* markers, white space squeezed."""
    return squeeze(F.regexp_replace(text, r"\*", ""))


def stripped_length(text: Column) -> Column:
    """Code points of the text without white space at its ends; null counts as none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACES}|{SPACES}$", ""))


def is_junk(name: Column) -> Column:
    """Files that an archiver or a desktop left behind."""
    return name.startswith("._") | (name == ".DS_Store")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_stem(stem: Column) -> Column:
    """speaker_style[_substyle]_number as a struct; null where the name has another form."""
    form = r"^([^_]+)_([A-Za-z]+(?:_[A-Za-z]+)*)_([0-9]+)$"
    words = F.regexp_extract(stem, form, 2)
    rest = F.regexp_extract(words, r"^[A-Za-z]+_(.*)$", 1)
    parts = F.struct(
        F.regexp_extract(stem, form, 1).alias("speaker"),
        F.regexp_extract(words, r"^([A-Za-z]+)", 1).alias("style"),
        F.when(rest != "", rest).alias("substyle"),
        F.regexp_extract(stem, form, 3).alias("number"),
    )
    return F.when(stem.rlike(form), parts)


def human_bytes(n: Column) -> Column:
    """Bytes with a decimal unit: 999 B, 1.5 kB, 38.4 GB."""
    units = ("B", "kB", "MB", "GB", "TB", "PB")
    out = F.concat(F.format_string("%.1f", n / F.lit(1000.0 ** (len(units) - 1))), F.lit(" " + units[-1]))
    for k in range(len(units) - 2, 0, -1):
        out = F.when(n < 1000 ** (k + 1), F.concat(F.format_string("%.1f", n / F.lit(1000.0**k)), F.lit(" " + units[k]))).otherwise(out)
    return F.when(n < 1000, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def hours_minutes_seconds(seconds: Column) -> Column:
    """h:mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def whole_percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def chars_per_active_second(text: Column, duration_s: Column, active_fraction: Column) -> Column:
    return stripped_length(text) / F.greatest(duration_s * active_fraction, F.lit(0.1))


def described(style: Column, speaker: Column, phrases: dict[str, str], recording: dict[str, str], default: str) -> Column:
    """'<speaker> <phrase of the style>. <recording sentence of the style or the default one>'."""
    pick = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), style)
    sentence = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in recording.items() for x in kv]), style), F.lit(default)) if recording else F.lit(default)
    return F.concat(speaker, F.lit(" "), pick(phrases), F.lit(". "), sentence)


def item_group(item_id: Column) -> Column:
    """An item id without its trailing digits."""
    return F.regexp_replace(item_id, r"[0-9]+$", "")


def item_name(group: Column, number: Column) -> Column:
    return F.format_string("%s%02d", group, number)


def run_label(adapter: Column, smoke: Column) -> Column:
    """Label of a run from its name and whether it is a smoke run."""
    return F.concat(adapter, F.when(smoke, F.lit("-smoke")).otherwise(F.lit("")))


def frame_cap(expected_s: Column, frames_per_s: float, most: int) -> Column:
    """Longest generation for a text of this expected duration."""
    return F.least(F.lit(most), (F.floor(frames_per_s * F.greatest(F.lit(3.0), expected_s * 2.5 + 1.5)) + 10).cast("int"))


def decibels(amplitude: Column, floor: float = 1e-10) -> Column:
    return F.log10(F.greatest(amplitude, F.lit(floor))) * 20


def semitones(low: Column, high: Column) -> Column:
    return F.log2(high / low) * 12


def argmax_first(scores: Column, classes: list[str]) -> Column:
    """The class with the largest score in a map; of equal ones the first in the order of `classes`."""
    values = F.array(*[F.coalesce(F.try_element_at(scores, F.lit(c)), F.lit(float("-inf"))) for c in classes])
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(values, F.array_max(values)).cast("int"))


def kept_words(column: Column) -> Column:
    """The words of a transcript's key that hold a letter or digit; none of a null."""
    words = F.filter(F.split(normalize_transcript(column), " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return F.coalesce(words, F.array().cast("array<string>"))
