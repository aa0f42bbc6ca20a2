"""A query and its SQL, brought to the same columns, types and rounding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECIMALS = 6


@dataclass(frozen=True)
class Query:
    """``columns``: names, with * behind those of type double (rounded) and # behind those of type long."""

    build: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None = None

    def _columns(self) -> list[tuple[str, str]]:
        """Names, and the mark behind each."""
        return [(c.rstrip("*#"), c[-1]) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        def out(name: str, mark: str) -> Column:
            c = F.col(name)
            if mark == "*":
                return (F.round(c.cast("double"), DECIMALS) + 0.0).alias(name)
            return c.cast("bigint").alias(name) if mark == "#" else c

        return self.build(spark, sf_dir).select(*[out(*c) for c in self._columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None

        def out(name: str, mark: str) -> str:
            if mark == "*":
                return f"round(CAST({name} AS DOUBLE), {DECIMALS}) + 0.0 AS {name}"
            return f"CAST({name} AS BIGINT) AS {name}" if mark == "#" else name

        head, _, body = self.sql.rpartition("\n=>\n")
        return f"{head}\nSELECT {', '.join(out(*c) for c in self._columns())} FROM ({body}) AS result"
