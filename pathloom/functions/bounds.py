"""What the driver may collect: only what is known to be few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

#: Texts and subjects of a study; results of one row each are collected up to these numbers.
MOST_TEXTS, MOST_SUBJECTS = 100_000, 1_000_000


def few(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of ``df``; raises if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows
