"""Locale-aware parsing of dates, amounts and currencies.

Every parser returns NULL where the text cannot be read, next to an error
expression that gives the reason.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.binding import let
from tallybook.functions.text import collapse_spaces, strip

# Date layouts in the order they are tried.
DAY_FIRST_FORMATS = [
    "%d/%m/%Y", "%Y-%m-%d", "%m/%d/%Y",
    "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d",
    "%d/%m/%y", "%m/%d/%y",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
    "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S",
]

# US exports: month before day wherever both readings exist.
MONTH_FIRST_FORMATS = [
    "%m/%d/%Y", "%Y-%m-%d", "%m-%d-%Y", "%Y/%m/%d", "%m/%d/%y",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%m/%d/%Y %H:%M:%S",
]
# What only a day-first layout reads is still a date there.
MONTH_FIRST_FORMATS += [f for f in DAY_FIRST_FORMATS if f not in MONTH_FIRST_FORMATS]

# Amount cells that mean zero.
ZERO_AMOUNTS = ["", "-", "–", "n/a", "N/A"]

_DIRECTIVES = {
    "d": ("d", r"\d{1,2}"),
    "m": ("M", r"\d{1,2}"),
    "Y": ("yyyy", r"\d{4}"),
    "y": ("yy", r"\d{2}"),
    "H": ("H", r"\d{1,2}"),
    "M": ("m", r"\d{1,2}"),
    "S": ("s", r"\d{1,2}"),
}

_ZERO = r"(?U)\A\s*(?:" + "|".join(ZERO_AMOUNTS) + r")\s*\z"
# Digits may be grouped by underscores; exponents are allowed, "inf" and "nan" are not.
_NUMBER = r"\A[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?\z"


def spark_date_format(strptime_format: str) -> tuple[str, str]:
    """(Spark pattern, shape regex) of a strptime layout."""
    pattern, shape = "", ""
    for directive, literal in re.findall(r"%(\w)|([^%])", strptime_format):
        if directive:
            if directive not in _DIRECTIVES:
                raise ValueError(f"unsupported date directive %{directive}")
            spark_part, regex_part = _DIRECTIVES[directive]
            pattern, shape = pattern + spark_part, shape + regex_part
        else:
            pattern += f"'{literal}'" if literal.isalpha() else literal
            shape += re.escape(literal)
    return pattern, f"^{shape}$"


def date_cell(text: Column) -> Column:
    """Cell text without outer and with single inner blanks."""
    return F.trim(collapse_spaces(F.coalesce(text, F.lit(""))))


def parse_date(text: Column, formats: list[str]) -> Column:
    """First layout that reads the cell.

    A failed parse costs a JVM exception, so each layout runs only on cells
    whose shape fits it.
    """
    def read(cell: Column, fmt: str) -> Column:
        pattern, shape = spark_date_format(fmt)
        day = F.try_to_date(cell, pattern)
        if "%y" in fmt:
            # Two-digit years from 69 on belong to the twentieth century.
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        return F.when(cell.rlike(shape), day)

    return let(date_cell(text), lambda cell: F.coalesce(*[read(cell, f) for f in formats]))


def date_error(text: Column, parsed: Column) -> Column:
    def reason(cell: Column) -> Column:
        return F.when(cell == "", F.lit("missing date")).otherwise(
            F.concat(F.lit("unparseable date '"), cell, F.lit("'"))
        )

    return F.when(parsed.isNull(), let(date_cell(text), reason))


def parse_amount(text: Column, decimal_sep: str = ".", thousands_sep: str = ",") -> Column:
    """Signed DOUBLE of a locale-formatted cell; blank cells are 0, bad ones NULL.

    One chain without branches: each step refers to the one before exactly once,
    so nothing is computed twice.
    """
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), _ZERO, "0")
    digits = F.regexp_replace(digits, r"(?U)[€$£¥\s\x1c-\x1f]", "")
    if thousands_sep:
        digits = F.replace(digits, F.lit(thousands_sep), F.lit(""))
    if decimal_sep == ",":
        digits = F.replace(digits, F.lit(","), F.lit("."))
    digits = F.regexp_replace(digits, r"\A\((.*)\)\z", "-$1")
    # A cast alone would accept suffixes such as "12d"; what is not a number becomes "".
    number = F.regexp_extract(digits, _NUMBER, 0)
    return F.replace(number, F.lit("_"), F.lit("")).try_cast("double")


def amount_error(text: Column, parsed: Column) -> Column:
    return F.when(
        parsed.isNull(),
        F.concat(F.lit("unparseable amount '"), strip(F.coalesce(text, F.lit(""))), F.lit("'")),
    )


def parse_currency(text: Column, default: str) -> Column:
    # Anything that is not three characters long after trimming gives way to the default.
    return F.regexp_replace(F.upper(strip(F.coalesce(text, F.lit("")))), r"(?s)\A(?!.{3}\z).*\z", default)


def or_default(text: Column, default: str) -> Column:
    """Stripped text, or ``default`` where nothing is left."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\A\z", default)
