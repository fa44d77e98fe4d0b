"""Content-hash identity of a transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _six_decimals(amount: Column) -> Column:
    """The text that ``%.6f`` gives; by way of a decimal, which costs less, where it can hold the amount."""
    plain = F.abs(amount).between(1e-6, 1e15)
    return F.when(plain, amount.cast("decimal(22,6)").cast("string")).otherwise(F.format_string("%.6f", amount))


def transaction_id(
    date: Column,
    raw_description: Column,
    amount: Column,
    account: Column,
    occurrence_no: Column | None = None,
) -> Column:
    """SHA-256 over day, lower-case text, amount with six decimals and account.

    Two equal purchases on one day share an id; pass ``occurrence_no`` to keep
    them apart.
    """
    parts = [
        date.cast("string"),
        F.lower(raw_description),
        _six_decimals(amount),
        account,
    ]
    if occurrence_no is not None:
        parts.append(occurrence_no.cast("string"))
    return F.sha2(F.concat_ws("|", *parts), 256)


def _from_row() -> Column:
    return transaction_id(F.col("date"), F.col("raw_description"), F.col("amount"), F.col("account"))


def without_ids(rows: DataFrame) -> DataFrame:
    """Ids are NULL where the row's own columns give them: a hash is most of what a row takes to store."""
    given = F.col("transaction_id")
    return rows.withColumn("transaction_id", F.when(~given.eqNullSafe(_from_row()), given))


def with_ids(rows: DataFrame) -> DataFrame:
    """What ``without_ids`` was given."""
    return rows.withColumn("transaction_id", F.coalesce("transaction_id", _from_row()))


def packed_id(given: Column) -> Column:
    """Bytes of an id: a SHA-256 hash in half its length, any other text as it is, told apart by the first byte."""
    is_hash = given.rlike("\\A[0-9a-f]{64}\\z")
    return F.when(is_hash, F.concat(F.lit(b"\x00"), F.unhex(given))).otherwise(F.concat(F.lit(b"\x01"), given.cast("binary")))


def unpacked_id(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
