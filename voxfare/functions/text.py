"""Text cleaning as native columns: whitespace, sentinels, headers, flags, keys, tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinel for a missing answer, and the texts that count as "no text".
NOT_RATED = "Not Rated"
NOT_STATED = "Not stated"
PLACEHOLDERS = ("null", "none", "n/a", "na", "not mentioned", "not stated", "", "nan")
MIN_TEXT_LENGTH = 3

# General English words that carry no topic. The words of one's own brand are passed
# separately (``brand_words``), as they differ from user to user.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "is", "was", "were", "are", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must", "very",
    "really", "quite", "also", "just", "even", "still", "already",
    "much", "more", "most", "some", "any", "all", "no", "not", "too",
    "so", "as", "it", "its", "my", "our", "their", "this", "that", "these",
    "those", "i", "we", "they", "he", "she", "you",
    "flight", "airline", "passenger", "service", "staff",
)

# Private characters that stand for a reviewer's name and a date inside a header.
NAME_SIGN, DATE_SIGN = "\ue000", "\ue001"

# White space of any kind: as a pattern, and as characters to trim.
SPACES = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A word of three or more ASCII letters standing alone; accented letters and digits count as word
# characters, so they never split a word.
WORD_PATTERN = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: Column | str) -> Column:
    """Every run of white space (no-break and other Unicode spaces too) becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def strip(c: Column | str) -> Column:
    """White space of any kind removed at both ends (``trim`` alone only knows the blank)."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def clean_text(c: Column | str, sentinel: str = NOT_RATED) -> Column:
    """Squashed text, or the sentinel where nothing is left."""
    return F.coalesce(F.nullif(squash(c), F.lit("")), F.lit(sentinel))


def default_fill(c: Column | str, sentinel: str = NOT_RATED) -> Column:
    """Sentinel instead of NULL."""
    return F.coalesce(_col(c), F.lit(sentinel))


def strip_ordinal(c: Column | str) -> Column:
    """``11th January`` -> ``11 January``."""
    return F.regexp_replace(_col(c), r"(\d{1,2})(st|nd|rd|th)\b", "$1")


def strip_quotes(c: Column | str) -> Column:
    """Drop double quotes around the text, then single ones."""
    no_double = F.regexp_replace(_col(c), '^"+|"+$', "")
    return F.regexp_replace(no_double, "^'+|'+$", "")


def country_from_header(header: Column | str, name: Column | str, shown_date: Column | str) -> Column:
    """The country in ``name (country) date``; otherwise whatever the first parentheses hold."""
    header, name, shown_date = _col(header), _col(name), _col(shown_date)
    usable = (name != NOT_RATED) & (shown_date != NOT_RATED) & (header != "")
    # one sign stands for the name and one for the date, so that the pattern is the same for all rows; the longer text
    # goes first, as it may hold the other
    put = lambda h, c, sign: F.replace(h, c, F.lit(sign))
    name_first = put(put(header, name, NAME_SIGN), shown_date, DATE_SIGN)
    date_first = put(put(header, shown_date, DATE_SIGN), name, NAME_SIGN)
    marked = F.when(F.length(name) >= F.length(shown_date), name_first).otherwise(date_first)
    between = rf"{NAME_SIGN}\s*\((.*?)\)\s*{DATE_SIGN}"
    inner = F.replace(F.replace(F.regexp_extract(marked, between, 1), F.lit(NAME_SIGN), name), F.lit(DATE_SIGN), shown_date)
    found = F.when(usable & marked.rlike(between), inner).otherwise(F.regexp_extract(header, r"\((.*?)\)", 1))
    return clean_text(found)


def verified_flag(body: Column | str) -> Column:
    """Yes / No / sentinel, from the marker in front of a review body."""
    body = _col(body)
    return (
        F.when(body.contains("Trip Verified") | body.contains("Verified Review"), "Yes")
        .when(body.contains("Not Verified"), "No")
        .otherwise(NOT_RATED)
    )


def verified_text(body: Column | str) -> Column:
    """The body after the first bar when a marker is present, else the body itself; cleaned."""
    text = clean_text(body)
    bar = F.instr(text, "|")
    after = F.substring(text, bar + 1, F.length(text))
    return clean_text(F.when((verified_flag(text) != NOT_RATED) & (bar > 0), after).otherwise(text))


def yes_no(c: Column | str) -> Column:
    """Any-case yes / no; all else becomes the sentinel."""
    low = F.lower(_col(c))
    return F.when(low == "yes", "Yes").when(low == "no", "No").otherwise(NOT_RATED)


def not_applicable(c: Column | str) -> Column:
    """``N/A`` in any case becomes the sentinel."""
    return F.when(F.upper(_col(c)) == "N/A", NOT_RATED).otherwise(_col(c))


def norm_key(*cols: Column | str) -> Column:
    """Case- and edge-space-insensitive key over several text columns; NULL counts as empty."""
    parts = [F.lower(strip(F.coalesce(_col(c), F.lit("")))) for c in cols]
    return F.concat_ws("||", *parts)


def clean_voice(c: Column | str) -> Column:
    """Lower-case trimmed free text, NULL for placeholders and for texts that are too short."""
    low = F.lower(strip(c))
    keep = ~low.isin(*PLACEHOLDERS) & (F.char_length(low) >= MIN_TEXT_LENGTH)
    return F.when(keep, low)


def words(c: Column | str) -> Column:
    """Array of the plain words in a text, lower case, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), F.lit(0))


def stop_words(brand_words: Iterable[str] = ()) -> tuple[str, ...]:
    return STOP_WORDS + tuple(w.lower() for w in brand_words)


def text_length(c: Column | str) -> Column:
    return F.char_length(_col(c))
