"""Text columns: cleaning, counting, hashing, casing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters of Unicode at the ends of a text, for strip().
ENDS = r"^(?U:\s)+|(?U:\s)+$"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def clean_text(c: Column) -> Column:
    """Null as ''; without leading byte order marks and control characters (but tab and line ends); single spaces; at most one blank line; stripped."""
    c = F.regexp_replace(text_or_empty(c), "^\ufeff+", "")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), "\n{3,}", "\n\n")
    return strip(c)


def word_count(c: Column) -> Column:
    """Number of runs without blank characters; null counts 0."""
    return F.size(F.filter(F.split(text_or_empty(c), r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def non_ascii(c: Column) -> Column:
    """Number of characters outside ASCII."""
    return F.length(F.regexp_replace(c, r"[\x00-\x7F]+", ""))


def detect_language(c: Column, least: float = 0.85) -> Column:
    """'en' if more than the given share of the characters is ASCII, else 'other'."""
    c = text_or_empty(c)
    ascii_share = (F.length(c) - non_ascii(c)) / F.greatest(F.length(c), F.lit(1))
    return F.when(ascii_share > least, "en").otherwise("other")


def content_hash(c: Column) -> Column:
    return F.sha2(text_or_empty(c), 256)


def url_hash(c: Column) -> Column:
    return F.md5(c)


def safe_filename(c: Column) -> Column:
    """Host and path with '_' for '/' and '.', other signs dropped, up to 200 characters."""
    place = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    return F.substring(F.regexp_replace(F.translate(place, "/.", "__"), r"[^\w\-]", ""), 1, 200)


def title_case(c: Column) -> Column:
    """Capitals after every character that is no letter, other letters small."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def identifier(c: Column) -> Column:
    """Small letters and digits, '_' between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_label(c: Column) -> Column:
    return title_case(F.translate(c, "-_", "  "))


def first_line_text(c: Column, size: int) -> Column:
    """The first characters on one line."""
    return F.replace(F.replace(F.substring(c, 1, size), F.lit("\n\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def shortened(c: Column, size: int) -> Column:
    """c, or its first characters and an ellipsis."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def stem_label(filename: Column, kind: Column, size: int = 120) -> Column:
    """A file's name without suffix, in words, with its kind."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    words = F.regexp_replace(F.regexp_replace(F.replace(stem, F.lit("%20"), F.lit(" ")), r"[_\-]+", " "), r"\s+", " ")
    return F.substring(F.concat(F.trim(words), F.lit(" ("), kind, F.lit(")")), 1, size)


#: Script residue that is cut out of chunks: server tags up to a line end or a sentence's start, ready handlers up to a semicolon.
SERVER_TAG = r"(?is)\?php.*?(?=\n|\bThe\b|\bThis\b|$)"
READY_HANDLER = r"(?is)jQuery\(document\)\.ready[^;]*;?"
LITERALS = ("?php", "add_library(", "add_js(", "jQuery(document).ready", "collapsible:true", "heightStyle:")


def strip_residue(c: Column) -> Column:
    """Without script residue and leading question marks."""
    c = F.regexp_replace(F.regexp_replace(text_or_empty(c), SERVER_TAG, ""), READY_HANDLER, "")
    return strip(F.regexp_replace(c, r"^[\s?]+", ""))


def clean_chunk(c: Column, literals: tuple[str, ...] = LITERALS) -> Column:
    """A chunk's text without residue and literal patterns, with single spaces and blank lines."""
    c = strip_residue(c)
    for x in literals:
        c = F.replace(c, F.lit(x), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}", " "))


def valid_chunk(c: Column, least: int = 30) -> Column:
    """Long enough, and at most half of it outside ASCII."""
    return (F.length(c) >= least) & (non_ascii(c) <= F.length(c) * 0.5)


def number_after(c: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def tokens(c: Column, least: int = 3) -> Column:
    """The distinct words of at least so many characters, in small letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)\b\w{{{least},}}\b"), F.lit(0)))
