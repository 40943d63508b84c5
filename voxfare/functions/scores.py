"""Scores, bands, tiers, maps and flags as native columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxfare.functions.text import NOT_RATED, _col, strip

# Rating bands (right-closed), their labels, and the theme / rebook encodings.
BAND_CUTS = (0.0, 3.0, 6.0, 8.0, 10.0)
BAND_LABELS = ("Low (1–3)", "Mid (4–6)", "High (7–8)", "Top (9–10)")
SAMPLE_BAND_LABELS = ("low", "mid", "high", "top")
THEME_CODES = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}
REBOOK_CODES = {"yes": 2.0, "maybe": 1.0, "no": 0.0}
FLAG_CODES = {"true": 1.0, "false": 0.0, "yes": 1.0, "no": 0.0, "1": 1.0, "0": 0.0}

# Short names of aircraft types.
AIRCRAFT_NAMES = {
    "Boeing 777-300ER": "B777-300ER",
    "Boeing 777-300": "B777-300",
    "Boeing 777": "B777",
    "Boeing 777-200LR": "B777-200LR",
    "Boeing 787-8": "B787-8",
    "Boeing 787-9": "B787-9",
    "Boeing 787": "B787",
    "A380-800": "A380-800",
    "A380": "A380",
    "A350-1000": "A350-1000",
    "A350-900": "A350-900",
    "A350": "A350",
    "A330-200": "A330-200",
    "A330": "A330",
    "A320neo": "A320neo",
    "A320": "A320",
    "A321neo": "A321neo",
}
MAKER_PREFIXES = {"A": "Airbus", "B": "Boeing"}


def to_double(c: Column | str) -> Column:
    """Number or NULL; the sentinel and other texts become NULL instead of raising."""
    return _col(c).try_cast("double")


def is_not_rated(c: Column | str, sentinel: str = NOT_RATED) -> Column:
    return F.coalesce(_col(c) == sentinel, F.lit(False))


def band(c: Column | str, cuts: Sequence[float] = BAND_CUTS, labels: Sequence[str] = BAND_LABELS) -> Column:
    """Label of the right-closed interval ``(cuts[i], cuts[i+1]]`` that holds the value, else NULL."""
    c = _col(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(cuts, cuts[1:], labels):
        out = out.when((c > low) & (c <= high), label)
    return out


def band_order(c: Column | str, cuts: Sequence[float] = BAND_CUTS) -> Column:
    """Position of the band, from 1, for ordering labels."""
    c = _col(c)
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, (low, high) in enumerate(zip(cuts, cuts[1:]), start=1):
        out = out.when((c > low) & (c <= high), i)
    return out


def tier(c: Column | str, good: float, fair: float, labels: Sequence[str] = ("green", "amber", "red")) -> Column:
    """Three-step traffic light: at least ``good``, at least ``fair``, below."""
    c = _col(c)
    return F.when(c >= good, labels[0]).when(c >= fair, labels[1]).when(c.isNotNull(), labels[2])


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else str(v)


def literal_map(mapping: Mapping) -> Column:
    """A constant map column, built from one expression text."""
    return F.expr("map(" + ", ".join(_sql_literal(x) for pair in mapping.items() for x in pair) + ")")


def replace_map(c: Column | str, mapping: Mapping) -> Column:
    """Mapped value; values outside the map stay."""
    return F.coalesce(strict_map(c, mapping), _col(c))


def strict_map(c: Column | str, mapping: Mapping) -> Column:
    """Mapped value; values outside the map become NULL."""
    c = _col(c)
    return F.when(c.isNotNull(), F.try_element_at(literal_map(mapping), c))


def prefix_class(c: Column | str, prefixes: Mapping[str, str] = MAKER_PREFIXES, other: str = "Unknown") -> Column:
    """Class by the first characters; no match and NULL give ``other``."""
    c = _col(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, name in prefixes.items():
        out = out.when(c.startswith(prefix), name)
    return out.otherwise(other)


def at_least(c: Column | str, limit: float) -> Column:
    """1.0 / 0.0 flag, NULL counts as 0."""
    return F.coalesce((_col(c) >= limit).cast("double"), F.lit(0.0))


def at_most(c: Column | str, limit: float) -> Column:
    return F.coalesce((_col(c) <= limit).cast("double"), F.lit(0.0))


def holds(cond: Column) -> Column:
    """1.0 where the condition is true, 0.0 where it is false or unknown."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def theme_code(c: Column | str) -> Column:
    return strict_map(F.lower(strip(c)), THEME_CODES)


def rebook_code(c: Column | str) -> Column:
    return strict_map(F.lower(strip(c)), REBOOK_CODES)


def flag_code(c: Column | str) -> Column:
    return strict_map(F.lower(_col(c).cast("string")), FLAG_CODES)


def route_origin(c: Column | str, sep: str = " to ") -> Column:
    return strip(F.split(_col(c), sep)[0])


def route_destination(c: Column | str, sep: str = " to ") -> Column:
    """Text after the last separator; a route without one is its own destination."""
    return strip(F.element_at(F.split(_col(c), sep), -1))


def stars(n_filled: Column | str) -> Column:
    """Number of filled stars as text; none filled means not rated."""
    n = _col(n_filled)
    return F.when(n > 0, n.cast("string")).otherwise(NOT_RATED)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def known_number(c: Column | str) -> Column:
    """A column as double, with NULL for NaN, so that aggregates leave both out."""
    return F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None).cast("double"))
