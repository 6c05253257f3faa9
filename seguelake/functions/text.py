"""Keys derived from free text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that carry no separable accent mark.
PLAIN_FROM, PLAIN_TO = "łŁøØđĐħĦıŧŦ", "lLoOdDhHitT"
# Words that mark another version of the same title.
VERSION_WORDS = (
    "original", "mix", "remix", "edit", "version", "extended", "radio", "club", "dub",
    "remaster", "remastered", "rework", "bootleg", "vip", "feat", "ft", "featuring",
)
# Words that stand for an unknown title.
PLACEHOLDER_WORDS = ("id", "unreleased", "unknown", "untitled", "track")


@F.pandas_udf(T.StringType())
def decomposed(values: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks (Arrow batches)."""
    import unicodedata

    def strip(text: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return values.map(strip, na_action="ignore")


def unaccented(text: Column) -> Column:
    """Accents removed; rows that are plain ASCII send a null to Python instead of their text."""
    swapped = F.translate(text, PLAIN_FROM, PLAIN_TO)
    return F.coalesce(decomposed(F.when(swapped.rlike(r"[^\x00-\x7f]"), swapped)), swapped)


def whole_word(word: str) -> str:
    """Pattern of a word between characters that are no letter, number or underscore of any script, in any case."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])"


def words_key(text: Column) -> Column:
    """Lower-case words separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(unaccented(text)), r"[^a-z0-9]+", " "))


def compact_key(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(unaccented(text)), r"[^a-z0-9]+", "")


def tokens_of(words: Column, longer_than: int = 0) -> Column:
    """Sorted distinct words of a words key."""
    return F.array_sort(F.array_distinct(F.filter(F.split(words, " "), lambda w: F.length(w) > longer_than)))


def tokens(text: Column, longer_than: int = 0) -> Column:
    return tokens_of(words_key(text), longer_than)


def title_tokens(text: Column) -> Column:
    """Token set of a title without version words and bracket contents."""
    bare = F.regexp_replace(text, r"[\(\[][^\)\]]*[\)\]]", " ")
    return F.filter(tokens(bare), lambda w: ~w.isin(*VERSION_WORDS))


def without_version(words: Column) -> Column:
    """Words key with version words removed."""
    return F.array_join(F.filter(F.split(words, " "), lambda w: ~w.isin(*VERSION_WORDS)), " ")


def is_placeholder(title: Column) -> Column:
    """Empty, punctuation only, or made of placeholder words."""
    words = F.filter(F.split(words_key(title), " "), lambda w: w != "")
    return title.isNull() | F.forall(words, lambda w: w.isin(*PLACEHOLDER_WORDS))


def seconds_of_clock(text: Column) -> Column:
    """``mm:ss`` or ``h:mm:ss`` as seconds; null when malformed."""
    h = F.regexp_extract(text, r"^\s*(?:(\d{1,2}):)?(\d{1,3}):([0-5]\d)\s*$", 1)
    m = F.regexp_extract(text, r"^\s*(?:(\d{1,2}):)?(\d{1,3}):([0-5]\d)\s*$", 2)
    s = F.regexp_extract(text, r"^\s*(?:(\d{1,2}):)?(\d{1,3}):([0-5]\d)\s*$", 3)
    value = F.coalesce(h.try_cast("int"), F.lit(0)) * 3600 + m.try_cast("int") * 60 + s.try_cast("int")
    return F.when(s != "", value)


def seconds_of_iso(text: Column) -> Column:
    """ISO-8601 ``PT..H..M..S`` as seconds; null when malformed."""
    pattern = r"^PT(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = [F.coalesce(F.regexp_extract(text, pattern, i).try_cast("int"), F.lit(0)) for i in (1, 2, 3)]
    return F.when(text.rlike(pattern), part[0] * 3600 + part[1] * 60 + part[2])


def clock_of_seconds(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
