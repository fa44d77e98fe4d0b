"""Tallybook: bank-statement analytics as Spark DataFrame operators."""
