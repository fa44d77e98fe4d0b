"""The column expressions as SQL functions, for ad-hoc queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from tallybook.functions.rules import (
    CATEGORY_RULES,
    DEFAULT_TYPE,
    INCOME_CATEGORY,
    INTERNAL_PATTERNS,
    OTHER_CATEGORY,
    TYPE_RULES,
    Rule,
    alternatives,
    plain_alternative,
)


def _quote(value: str) -> str:
    return "r'" + value.replace("'", "\\'") + "'"


def _test(alternative: str) -> str:
    """One alternative of a rule on the folded text ``f``; plain ones need no regex engine."""
    kind, literal = plain_alternative(alternative)
    if kind == "regex":
        return f"f RLIKE {_quote('(?iud)' + alternative)}"
    return f"f = {_quote(literal)}" if kind == "equals" else f"{kind}(f, {_quote(literal)})"


def _cascade(column: str, rules: Sequence[Rule], otherwise: str) -> str:
    """A CASE over the text, folded once for all rules."""
    whens = " ".join(
        f"WHEN {' OR '.join(map(_test, alternatives(r.pattern)))} THEN '{r.label}'" for r in rules
    )
    folded = f"lower(translate({column}, 'İıſ\u212a', 'iisk'))"
    return f"element_at(transform(array({folded}), f -> CASE {whens} ELSE {otherwise} END), 1)"


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary functions: tx_type, is_internal_move, rule_category, transaction_id, format_money."""
    internal = "|".join(f"(?:{p})" for p in INTERNAL_PATTERNS)
    sign = f"CASE WHEN amount > 0 THEN '{INCOME_CATEGORY}' ELSE '{OTHER_CATEGORY}' END"
    bodies = {
        "tx_type(raw STRING) RETURNS STRING": _cascade("raw", TYPE_RULES, f"'{DEFAULT_TYPE}'"),
        "is_internal_move(raw STRING) RETURNS BOOLEAN": f"raw RLIKE {_quote('(?iud)^(?:' + internal + ')')}",
        "rule_category(description STRING, amount DOUBLE) RETURNS STRING":
            _cascade("description", CATEGORY_RULES, sign),
        "transaction_id(day DATE, raw STRING, amount DOUBLE, account STRING) RETURNS STRING":
            "sha2(concat_ws('|', cast(day AS STRING), lower(raw), format_string('%.6f', amount), account), 256)",
        "format_money(amount DOUBLE) RETURNS STRING":
            "concat(CASE WHEN amount > 0 THEN '+' ELSE '' END, "
            "translate(format_number(amount, 2), ',', ' '), ' €')",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
