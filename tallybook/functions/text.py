"""Text clean-up for statement narratives and labels."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Bank prefixes taken off the front of a narrative.
BANK_PREFIXES = (
    r"^(VIR(EMENT)?\s+(SEPA\s+)?|VIREMENT\s+|"
    r"PAIEMENT\s+(CB|PAR CARTE)?\s*|CB\s*\*?\s*|"
    r"PRELEVEMENT\s+(SEPA\s+)?|RETRAIT\s+(DAB\s+)?|"
    r"ACHAT\s+(CB\s+)?|AVOIR\s+)"
)

# (?U) makes \s Unicode-aware (no-break spaces); \x1c-\x1f also count as blank.
_BLANK = r"[\s\x1c-\x1f]"
# The same characters one by one.
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Take Unicode white space off both ends (``trim`` only knows the space)."""
    return F.btrim(text, F.lit(_BLANKS))


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    if text.null_count == len(text):
        return text
    # The Arrow kernel of that name leaves accents decomposed.
    return pa.array(
        [None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string()
    )


def nfkc(text: Column) -> Column:
    """NFKC form. ASCII text is already normal, so only the rest has a value to work on."""
    wide = F.octet_length(text) != F.length(text)
    return F.coalesce(_nfkc(F.when(wide, text)), text)


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){_BLANK}+", " ")


def clean_description(text: Column) -> Column:
    """NFKC, control characters to spaces, bank prefix off if text remains, one space.

    The prefix is an atomic group, so it is never shortened to leave some text;
    the lookahead keeps a narrative that is nothing but a prefix.
    """
    prefix = BANK_PREFIXES.replace("^(", "^(?>", 1)
    plain = F.regexp_replace(nfkc(text), r"[\x00-\x1f\x7f]", " ")
    rest = F.regexp_replace(plain, rf"(?iuUs){prefix}(?=.*\S)", "")
    return F.trim(collapse_spaces(rest))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, as in ``O'Neil 2X A-B``.

    ``initcap`` starts a word at blanks only, so a marker and a blank go after
    every non-letter and come out again afterwards.
    """
    marked = F.regexp_replace(F.lower(text), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def account_label(file_stem: Column, profile: Column) -> Column:
    """Readable account name: drop a ``_YYYY-MM...`` tail, underscores to spaces."""
    base = F.regexp_replace(file_stem, r"[_-]?\d{4}[-_]\d{2}.*$", "")
    label = title_case(F.translate(base, "_", " "))
    return F.when(label != "", label).otherwise(title_case(profile))
