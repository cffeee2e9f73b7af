"""Column functions over caption-like text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([a-z]+(?:-[a-z]+)*)"
HYPHENATED = r"([a-z]+-[a-z]+(?:-[a-z]+)*)"
#: Fixed value: a number followed by a size unit.
SIZE_NUMBER = r"(?iU)\b\d+(?:\.\d+)?\s*(?:µm|μm|um|microns?|micrometers?|mm|x)\b"
#: Function words left out of content words.
STOP_WORDS = (
    "a an and are as at be been being but by can could did do does each either else even for from get got had has have how if in "
    "into is it its just may might more most much my no nor not of on one only or other our out per she should so some such "
    "than that the their them then there these they this those though to too under until up upon very was we were what when where whether "
    "which while who whom whose why will with without would yet you your about also any"
).split()


def tokens(text: Column) -> Column:
    """Lower-case words, hyphens inside kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def hyphenated(text: Column) -> Column:
    """Hyphenated compounds."""
    return F.regexp_extract_all(F.lower(text), F.lit(HYPHENATED), F.lit(1))


def has_digit(text: Column) -> Column:
    """T2."""
    return text.rlike("[0-9]")


def leaks_size(text: Column) -> Column:
    """A number with a size unit."""
    return text.rlike(SIZE_NUMBER)


def sentence_count(text: Column) -> Column:
    """Full stops, exclamation and question marks, at least one (T4)."""
    return F.greatest(F.length(F.regexp_replace(text, "[^.!?]", "")), F.lit(1))


def opens_with(text: Column, opener: str) -> Column:
    """Case-folded opening phrase."""
    return F.lower(text).startswith(opener.lower())


def contains_phrase(text: Column, phrase: str | Column) -> Column:
    """Case-folded containment; closing marks of the phrase do not count."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.lower(text), F.rtrim(F.lower(phrase), F.lit(".,;:!?")))


def leaks_taxon(words: Column, names: Column, unknown: tuple[str, ...] = ("unknown",)) -> Column:
    """Whether text words meet the words of taxon names."""
    return F.arrays_overlap(words, F.array_except(tokens(names), F.array(*map(F.lit, unknown))))


def content_words(words: Column, least: int = 3) -> Column:
    """Words that are no function words and not short."""
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(STOP_WORDS))


def bigrams(text: Column) -> Column:
    """Neighbouring words, letters and hyphens only, neither empty nor a function word."""
    # the whole text is cleaned at once; a word that this empties stays between its two blanks
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "), "[^a-z -]", ""), " ")
    least = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(words, 1, least), F.slice(words, 2, least))
    good = F.filter(pairs, lambda p: (p["0"] != "") & (p["1"] != "") & ~p["0"].isin(STOP_WORDS) & ~p["1"].isin(STOP_WORDS))
    return F.transform(good, lambda p: F.concat_ws(" ", p["0"], p["1"]))


def canonical_key(slide: Column) -> Column:
    """``name_<number>_edf`` -> ``name_edf``."""
    return F.regexp_replace(slide, r"^(.*?)_([0-9]+)(_edf)$", "$1$3")


def strip_thoughts(text: Column) -> Column:
    """Removes think blocks and the space after them."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def run_name(text: Column) -> Column:
    """Keeps letters, digits and ``- _ .``; the rest becomes ``_``."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def model_short_name(text: Column) -> Column:
    """Without ``production_`` before and ``_final`` after."""
    return F.regexp_replace(F.regexp_replace(text, "^production_", ""), "_final$", "")


def file_stem(text: Column) -> Column:
    """Without the suffix of a derived file."""
    return F.regexp_replace(text, "_(captions|filtered|curated|embeddings)$", "")


def genus(name: Column) -> Column:
    """First word, lower case; null for unknown names and single letters."""
    g = F.lower(F.split(F.trim(name), " ")[0])
    return F.when((F.length(g) >= 2) & (g != "unknown"), g)


def pair_key(id_: Column, image_path: Column, mask_index: Column, row: Column) -> Column:
    """First of id, image path, mask index that is not empty; else the row number."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("id:"), some(id_)), F.concat(F.lit("image_path:"), some(image_path)), F.concat(F.lit("mask_index:"), some(mask_index)), F.format_string("row:%08d", row)
    )


def shown(value: Column, decimals: int = 2, absent: str = "-") -> Column:
    """Thousands and decimals, a dash where there is no value."""
    return F.coalesce(F.format_number(value, decimals), F.lit(absent))


def caption_prompt(hint: Column, anchor: Column, size: Column, confidence: Column, polar: Column, equatorial: Column, area: Column) -> Column:
    """The prompt with its measurements."""
    return F.format_string("%s\n%s\nSize class: %s. Confidence: %.2f. Axes: %.1f x %.1f um. Area: %.0f um2.", hint, anchor, size, confidence, polar, equatorial, area)
