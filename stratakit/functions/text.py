"""String functions for titles, years and free text (H1-H4, H9) as native
Column expressions.  Patterns are Java regex; ``\\s`` and ``\\d`` are ASCII
there, which is what the inputs hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The year patterns of the reference, in the order they are tried.
ONE_YEAR = r"\((\d{4})\)"
TWO_YEARS = r"\((\d{4})-(\d{4})\)"
OPEN_YEAR = r"\((\d{4})[-–]\s?\)"
NO_GENRES = "(no genres listed)"


def title_prep(c: Column) -> Column:
    """H1: collapse whitespace runs to one space, drop the leading space, lower
    case.  A trailing space survives (as in the reference)."""
    return F.lower(F.ltrim(F.regexp_replace(c, r"\s+", " ")))


def year_from_title(c: Column) -> Column:
    """H2 + H9: exactly one ``(dddd)``; else exactly one ``(dddd-dddd)`` ->
    half-even rounded midpoint; else exactly one ``(dddd-)``/``(dddd– )`` ->
    first year; else null."""
    one = F.regexp_extract_all(c, F.lit(ONE_YEAR), 1)
    two_a = F.regexp_extract_all(c, F.lit(TWO_YEARS), 1)
    two_b = F.regexp_extract_all(c, F.lit(TWO_YEARS), 2)
    opn = F.regexp_extract_all(c, F.lit(OPEN_YEAR), 1)
    mid = F.bround((two_a[0].cast("double") + two_b[0].cast("double")) / F.lit(2.0), 0)
    return (F.when(F.size(one) == 1, one[0].cast("int"))
            .when(F.size(two_a) == 1, mid.cast("int"))
            .when(F.size(opn) == 1, opn[0].cast("int"))
            .otherwise(F.lit(None).cast("int")))


def clean_text(c: Column) -> Column:
    """H3: letters only, single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z]+", " ")))


def genre_list(c: Column, sep: str = "|") -> Column:
    """Split a delimited list and remove the 'no genres' sentinel."""
    import re
    return F.array_except(F.split(c, re.escape(sep)), F.array(F.lit(NO_GENRES)))


def tokens(c: Column) -> Column:
    """Whitespace tokens of already cleaned text (empty text -> empty array)."""
    return F.filter(F.split(c, " "), lambda x: x != F.lit(""))
