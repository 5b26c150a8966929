"""Free-text publication dates -> extracted fragment -> DATE.

The cascade, first match wins:
  1. ``<day> <word> <year>``              -> that fragment (last day of a range)
  2. ``Volume <n>, <word> <year>``         -> the first ``<word> <year>``
  3. any four digits                       -> those digits
Two more day-month-year patterns exist in the original rules but are covered by
the first one, so they never fire.  Parsing tries, in order, ``d MMMM yyyy``,
``MMMM yyyy`` and ``yyyy``; month names are full English names, matched without
regard to case.  ``\\w`` and ``\\d`` are ASCII, as in Java regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extraction patterns and parse formats of the date rules.
DAY_MONTH_YEAR = r"\d{1,2} \w+ \d{4}"
VOLUME_MONTH_YEAR = r"Volume \d+,\s?\w+ \d{4}"
MONTH_YEAR = r"\w+ \d{4}"
YEAR = r"\d{4}"
PARSE_FORMATS = ("d MMMM yyyy", "MMMM yyyy", "yyyy")


def extract_date_text(raw: Column) -> Column:
    """The date fragment of a free-text date, or null when nothing matches."""
    # A match is never empty, so "matches, then extract" is "extract, '' -> null":
    # one regex pass per branch instead of two.
    return F.coalesce(
        F.nullif(F.regexp_extract(raw, DAY_MONTH_YEAR, 0), F.lit("")),
        F.when(raw.rlike(VOLUME_MONTH_YEAR), F.regexp_extract(raw, MONTH_YEAR, 0)),
        F.nullif(F.regexp_extract(raw, YEAR, 0), F.lit("")),
    )


def parse_date_text(fragment: Column) -> Column:
    """First format that parses wins; year 0 (not a calendar year) becomes null."""
    parsed = F.coalesce(*[F.try_to_date(fragment, fmt) for fmt in PARSE_FORMATS])
    return F.when(F.year(parsed) >= 1, parsed)


def year_text(fragment: Column) -> Column:
    """Four-digit year string of the fragment ('' when none, null when null)."""
    return F.regexp_extract(fragment, YEAR, 0)
