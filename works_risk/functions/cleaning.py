"""Cleaning of ids, money, dates, names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from works_risk.params import MIN_TEXT_CHARS

# Patterns of the identifiers inside free text.
WORK_ID = r"(MP\d+/\d{4}-\d{4}/\d+)"
WORK_ID_THIS_CENTURY = r"(MP\d+/20\d\d-\d\d\d\d/\d+)"
TITLE_AFTER_ID = r"MP\d+/\d{4}-\d{4}/\d+-(.*)$"
YEAR_RANGE = r"(\d{4}-\d{4})"
FIRST_DIGITS = r"(\d+)"
TRAILING_NUMBER = r"/(\d+)$"
UNPARSEABLE_TOKEN = r"(?i)^\s*(NA-\S*)"

_BLANKS = r"[\s ]+"


def blank_to_null(c: Column) -> Column:
    """NULL for text that is empty once spaces are trimmed."""
    return F.nullif(trim_name(c), F.lit(""))


def trim_name(c: Column) -> Column:
    """Trim blanks at both ends, the no-break space included."""
    return F.regexp_replace(c, rf"^{_BLANKS}|{_BLANKS}$", "")


def blank_ends(c: Column) -> tuple[Column, Column]:
    """What ``trim_name`` takes off at both ends."""
    return F.regexp_extract(c, f"^{_BLANKS}", 0), F.regexp_extract(c, f"{_BLANKS}$", 0)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, NULL when there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def work_id(c: Column, pattern: str = WORK_ID) -> Column:
    return extracted(c, pattern)


def work_id_or_token(c: Column, drop_unparseable: bool = False) -> Column:
    """The id inside ``c``; a row that carries an NA- token keeps that token as its id."""
    found = work_id(c)
    if drop_unparseable:
        return found
    return F.coalesce(found, extracted(c, UNPARSEABLE_TOKEN))


def work_title(c: Column) -> Column:
    return extracted(c, TITLE_AFTER_ID)


def fiscal_year(c: Column) -> Column:
    return F.regexp_extract(c, YEAR_RANGE, 1)


def mp_number(c: Column) -> Column:
    """Digits of the member number as text, so that leading zeros stay."""
    return F.regexp_extract(c, FIRST_DIGITS, 1)


def work_number(c: Column) -> Column:
    return F.regexp_extract(c, TRAILING_NUMBER, 1)


def is_unparseable(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).startswith("NA-"), F.lit(False))


def money(c: Column, mode: str = "decimal") -> Column:
    """Rupee text to DECIMAL(18,2), sign kept; blank or unreadable text gives 0.

    ``mode="digits"`` keeps digits only and so drops the sign and the decimal point, for comparing with older outputs.
    """
    if mode == "digits":
        plain = F.regexp_replace(c, r"[^0-9]", "")
    elif mode == "decimal":  # the first number, whatever stands before it ("Rs. 1,234.50")
        plain = F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"\s", ""), r"-?[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "")
    else:
        raise ValueError("money mode is decimal or digits")
    number = F.nullif(plain, F.lit("")).try_cast("decimal(18,2)")
    return F.coalesce(number, F.lit(0).cast("decimal(18,2)"))


def unreadable_money(c: Column) -> Column:
    """Whether there is text but no number in it, so that ``money`` gives 0."""
    return F.coalesce((F.trim(c) != "") & ~c.rlike("[0-9]"), F.lit(False))


def day(c: Column) -> Column:
    """``dd-MMM-yyyy`` or ISO text to DATE, NULL when neither fits."""
    return F.coalesce(F.try_to_date(c, "dd-MMM-yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("double"), F.lit(0.0))


def normalised_text(c: Column) -> Column:
    """Lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def has_long_text(c: Column, chars: int = MIN_TEXT_CHARS) -> Column:
    return F.coalesce(F.length(F.trim(c)) >= chars, F.lit(False))


def safe_file_name(c: Column) -> Column:
    named = F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("work"))
