"""Ordered rule tables and the column expressions built from them.

Rules are data: every expression takes another table of the same shape.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    label: str
    pattern: str


# ---------------------------------------------------------------------------
# Narratives of moves between a customer's own accounts.
# ---------------------------------------------------------------------------
INTERNAL_PATTERNS = [
    r"^To Instant Access Savings$",
    r"^From Instant Access Savings$",
    r"^Pocket Withdrawal$",
    r"^To pocket EUR.*",
    r"^Closing transaction$",
    r"^Transfer to savings",
    r"^From savings",
]

# ---------------------------------------------------------------------------
# Transaction types; the first match wins.
# ---------------------------------------------------------------------------
TYPE_RULES = [
    Rule("interest", r"^Interest earned"),
    Rule("fee", r"fee|frais"),
    Rule("refund", r"refund|remboursement|avoir|cashback"),
    Rule("atm", r"^cash withdrawal|^retrait"),
    Rule("exchange", r"^exchange|^transfer to revolut digital assets"),
    Rule("savings_move", r"instant access savings|closing transaction"),
    Rule("pocket_move", r"pocket withdrawal|to pocket eur"),
    Rule("topup", r"^top.up|^apple pay top|payment from |^payment from"),
    Rule("transfer_in", r"^transfer from |^from "),
    Rule("transfer_out", r"^transfer to |^to |^payment$|^beauty |^dkchi|^il reste"),
]
DEFAULT_TYPE = "card_payment"

# ---------------------------------------------------------------------------
# Spending categories; the first match wins.
# ---------------------------------------------------------------------------
CATEGORY_RULES = [
    Rule("Revenus",
         r"payment from |top.up|topup|salaire|virement entrant|"
         r"referral reward|interest earned|card refund|remboursement"),
    Rule("Loyer",
         r"heneo|loyer|rent|bail|charges|syndic|action logement"),
    Rule("Abonnements",
         r"apple$|apple pay|itunes|netflix|spotify|disney|amazon prime|"
         r"free$|free telecom|free mobile|sfr|orange$|bouygues|"
         r"imagine r|comutitres|openai|claude|elevenlabs|"
         r"youtu|deezer|tidal|twitch|github|adobe|canva|notion|"
         r"onlyfans|cleo$"),
    Rule("Transport",
         r"^uber$|uber eats.*fare|bolt$|ratp|sncf|navigo|"
         r"blablacar|ouigo|tgv|transilien|"
         r"azdistribution|breasy|selecta.*transport|"
         r"shell$|bp$|total$|esso"),
    Rule("Alimentation",
         r"franprix|aldi|lidl|carrefour|monoprix|casino|intermarche|"
         r"leclerc|super u|u express|coccinelle|marche voltaire|"
         r"sk\.alimentation|snp ba food|royal primeur|bionac|"
         r"the grocery store|food|alimenta"),
    Rule("Restauration",
         r"uber eats|deliveroo|just eat|glovo|"
         r"pizza hut|mcdonald|burger|kebab|slaim|"
         r"le saint|bistrot|baguette|cafe|café|restaurant|"
         r"royal parmentier|le belvil|tabac|snc voltaire|"
         r"cie parisienne|le zingam|j&m food|dream food|"
         r"land.monkey|indiana|eric kayser|pret|starbucks|"
         r"step burger|aono|rezwan|pedrazzi|corcoran|"
         r"noctambule|robin|le rey|bar |snack|boucherie|"
         r"traiteur|pizz|friterie|ramen|sushi"),
    Rule("Shopping",
         r"amazon(?! prime)|aliexpress|temu|ebay|vinted|leboncoin|"
         r"zara|hm |primark|descamps|sephora(?!.*refund)|"
         r"apple store|mac store|whatnot|dhgate|"
         r"decathlon|action$|nespresso|pixmania|"
         r"fnac|darty|boulanger|electro depot|"
         r"lc waikiki|zalando|shein|asos"),
    Rule("Beauté",
         r"sephora|nocibé|inaya beauty|bleu libellule|"
         r"pharmacie|grande pharmacie|deciem|"
         r"coiff|beauty|vaperture|rez energy|"
         r"black beauty|ar\.oma vap|tavap"),
    Rule("Loisirs",
         r"cinema|ugc|mkp|mlg event|treplay|charlotte club|"
         r"maison louvard|taptap send|pay pal(?!.*refund)|"
         r"oney|idfs|younited|maison des vignes"),
    Rule("Virements",
         r"^to |^transfer to |^payment$|^beauty hdchi|^dkchi|^il reste"),
]
INCOME_CATEGORY = "Revenus"
OTHER_CATEGORY = "Autre"

# Case-blind for all letters (i, u); only \n ends a line (d).
_FLAGS = "(?iud)"
_SPECIAL = set(".^$*+?{}[]|()\\")


def fold(text: Column) -> Column:
    """Lower case for rule matching, with the letters regex case folding equates.

    Store the result in a column of its own (``withColumn``) before matching:
    every rule refers to it.
    """
    wide = F.octet_length(text) != F.length(text)
    return F.when(wide, F.lower(F.translate(text, "İıſ\u212a", "iisk"))).otherwise(F.lower(text))


def alternatives(pattern: str) -> list[str]:
    """Split a regex at its outermost ``|``."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 1
        elif char in "([":
            depth += 1
        elif char in ")]":
            depth -= 1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def plain_alternative(alternative: str) -> tuple[str, str]:
    """(equals, startswith, endswith or contains, literal), or (regex, the alternative as it is)."""
    body = alternative.removesuffix(".*")
    at_start, at_end = body.startswith("^"), body.endswith("$")
    literal = body.removeprefix("^").removesuffix("$").replace("\\.", "\0")
    if not literal or _SPECIAL & set(literal):
        return "regex", alternative
    literal = literal.replace("\0", ".").lower()
    if at_start and at_end:
        return "equals", literal
    return "startswith" if at_start else "endswith" if at_end else "contains", literal


def _matches(folded: Column, alternative: str) -> Column:
    """Plain substrings, prefixes and suffixes need no regex engine."""
    kind, literal = plain_alternative(alternative)
    if kind == "regex":
        return folded.rlike(_FLAGS + alternative)
    return folded == literal if kind == "equals" else getattr(folded, kind)(literal)


def any_match(folded: Column, pattern: str) -> Column:
    tests = [_matches(folded, a) for a in alternatives(pattern)]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def first_match(folded: Column, rules: Sequence[Rule], otherwise: Column) -> Column:
    """Label of the first rule whose pattern occurs in the folded text."""
    cascade = F
    for rule in rules:
        cascade = cascade.when(any_match(folded, rule.pattern), F.lit(rule.label))
    return cascade.otherwise(otherwise) if rules else otherwise


def is_internal(raw: Column, patterns: Sequence[str] = tuple(INTERNAL_PATTERNS)) -> Column:
    """True where the narrative starts like a move between own accounts.

    One anchored regex: filters on it get pushed down, and a single reference
    keeps whatever computes ``raw`` from being repeated there.
    """
    return raw.rlike(_FLAGS + r"\A(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def tx_type(folded: Column, rules: Sequence[Rule] = tuple(TYPE_RULES)) -> Column:
    return first_match(folded, rules, F.lit(DEFAULT_TYPE))


def merchant_category(folded: Column, rules: Sequence[Rule] = tuple(CATEGORY_RULES)) -> Column:
    """Category the text alone decides; NULL where no rule applies."""
    return first_match(folded, rules, F.lit(None).cast("string"))


def sign_category(amount: Column) -> Column:
    return F.when(amount > 0, F.lit(INCOME_CATEGORY)).otherwise(F.lit(OTHER_CATEGORY))
