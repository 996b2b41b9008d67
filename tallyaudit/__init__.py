"""Tally-sheet auditing expressed as Spark DataFrame operators."""
