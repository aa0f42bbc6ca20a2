"""Draws as column expressions: a counter-based generator, numbers of rows, halves, and resamples with replacement.

A number depends on its counters only (a seed, a draw, a key, a place), by a digest that SQL engines share. So draws are
made where the rows are, by any number of tasks, come out the same when a task is run again, and SQL can repeat them;
nothing is made on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.sources.scratch import written

#: Numbers are whole and below this.
RANGE = 1 << 32
#: Draws of readers that a task makes.
SLOTS = 250_000


def _counter(c) -> Column:
    return F.lit(c).cast("string") if not isinstance(c, Column) else c.cast("string")


def uniform(*counters) -> Column:
    """A number from 0 to ``RANGE`` - 1 that its counters determine; null counters are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *map(_counter, counters))), 1, 8), 16, 10).cast("bigint")


def uniform_sql(*counters: str) -> str:
    """``uniform`` in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(counters)})), 1, 8))::BIGINT"


def below(n: Column, *counters) -> Column:
    """A number from 0 to n - 1."""
    return F.shiftright(uniform(*counters) * n, 32)


def below_sql(n: str, *counters: str) -> str:
    return f"(({uniform_sql(*counters)} * {n}) >> 32)"


def numbered(rows: DataFrame, by: list[str], *key) -> DataFrame:
    """``rows`` with ``_i``, their numbers from 0 within ``by`` in the order of the key's digest, and ``_n``, how many there are.

    Rows are counted by the first two digits of the digest, so no task orders a group as a whole.
    """
    text = F.concat_ws(":", *map(_counter, key))
    hashed = rows.withColumn("_key", text).withColumn("_hash", F.md5("_key")).withColumn("_slice", F.substring("_hash", 1, 2))
    sizes = hashed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*by)
    before = F.sum("_size").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    places = sizes.select(*by, "_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_hash", "_key"))
    ranked = hashed.withColumn("_own", own).join(places, [*by, "_slice"])
    return ranked.withColumn("_i", F.col("_own") - 1 + F.col("_before")).drop("_key", "_hash", "_slice", "_own", "_before")


def _each(rows: DataFrame, repeats: int, name: str = "draw") -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def half_draws(events: DataFrame, repeats: int, seed: int, by: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """(by, draw, half, subject_id, mult): the subjects of each group in two halves, the first of half their number rounded down."""
    drawn = _each(events.select(*by, "subject_id").distinct(), repeats)
    ranked = numbered(drawn, [*by, "draw"], seed, F.col("draw"), *[F.col(c) for c in by], F.col("subject_id"))
    half = F.when(F.col("_i") < F.floor(F.col("_n") / 2), 0).otherwise(1)
    return ranked.select(*by, "draw", half.alias("half"), "subject_id", F.lit(1).alias("mult"))


def four_subject_draws(events: DataFrame) -> DataFrame:
    """(text_id, draw, half, subject_id, mult): the three ways to part each text's four subjects into pairs; raises for other numbers."""
    subjects = _each(events.select("text_id", "subject_id").distinct(), 3)
    own = Window.partitionBy("text_id", "draw")
    ranked = subjects.withColumn("_i", F.row_number().over(own.orderBy("subject_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    first = F.when(F.col("_n") != 4, F.raise_error(F.lit("exactly four subjects are needed")).cast("boolean"))
    half = F.when(first.isNull() & ((F.col("_i") == 0) | (F.col("_i") == F.col("draw") + 1)), 0).otherwise(1)
    return ranked.select("text_id", "draw", half.alias("half"), "subject_id", F.lit(1).alias("mult"))


def picks(rows: DataFrame, by: list[str], repeats: int, seed: int, *key, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(by, draw, _slot, _pick) of as many draws with replacement as a group has rows, and the ``numbered`` rows.

    ``parts`` is the number of tasks that make the draws; a few rows would else be one task's.
    """
    placed = numbered(rows, by, *key)
    own = placed.select(*by, "_n", F.col("_i").alias("_slot"))
    slots = _each(own.repartition(parts, "_slot") if parts else own, repeats)
    pick = below(F.col("_n"), seed, *[F.col(c) for c in by], F.col("draw"), F.col("_slot"))
    return slots.select(*by, "draw", "_slot", "_n", pick.alias("_pick")), placed


def resampled(rows: DataFrame, by: list[str], repeats: int, seed: int, *key) -> DataFrame:
    """``rows`` with ``draw`` and ``times``, how often a resample of its group has the row; rows that it lacks are left out."""
    drawn, placed = picks(rows, by, repeats, seed, *key)
    times = drawn.groupBy(*by, "draw", F.col("_pick").alias("_i")).agg(F.count(F.lit(1)).alias("times"))
    return placed.join(times, [*by, "_i"]).drop("_i", "_n")


def reader_draws(subjects: DataFrame, repeats: int, seed: int, split: bool = False) -> DataFrame:
    """(draw, half, subject_id, mult): subjects drawn with replacement.

    With ``split`` the first half of the drawn places, rounded down, is half 0; a subject may be in both halves. Draws
    are made and counted by as many tasks as their number asks for, each with all draws of its subjects.
    """
    found = written(subjects.select("subject_id").distinct(), "readers")
    parts = max(1, math.ceil(found.count() * repeats / SLOTS))
    drawn, placed = picks(found, [], repeats, seed, F.col("subject_id"), parts=parts)
    half = F.when(F.lit(split) & (F.col("_slot") >= F.floor(F.col("_n") / 2)), 1).otherwise(0)
    dealt = drawn.select(F.col("_pick").alias("_i"), "draw", half.alias("half")).repartition(parts, "_i")
    times = dealt.groupBy("_i", "draw", "half").agg(F.count(F.lit(1)).alias("mult"))
    return placed.join(times, "_i").select("draw", "half", "subject_id", F.col("mult").cast("int").alias("mult"))


def drawn_means(rows: DataFrame, by: list[str], value: str, repeats: int, seed: int, *key) -> DataFrame:
    """(by, draw, mean): the mean of each resample of a group's values."""
    drawn, placed = picks(rows, by, repeats, seed, *key)
    met = drawn.join(placed.select(*by, F.col("_i").alias("_pick"), value), [*by, "_pick"])
    return met.groupBy(*by, "draw").agg(F.avg(value).alias("mean"))


def mean_interval(rows: DataFrame, keys: list[str], value: str, repeats: int, seed: int, *key, sign_flips: bool = False) -> DataFrame:
    """(keys, n, mean, low, high, p): percentile interval of each group's mean and, if asked, its sign-flip p value.

    Null values do not count. A resample's numbers come from the seed, the keys, the draw and the place; ``key`` names
    the row (by default its text). A mean of flipped values that equals the observed one but for rounding counts.
    """
    defined = written(rows.where(F.col(value).isNotNull()).select(*keys, "text_id", value), "values")
    key = key or (F.col("text_id"),)
    means = drawn_means(defined, keys, value, repeats, seed, *key).groupBy(*keys).agg(
        E.quantile(F.col("mean"), 0.025).alias("low"), E.quantile(F.col("mean"), 0.975).alias("high")
    )
    observed = defined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    out = observed.join(means, keys)
    if not sign_flips:
        return out.withColumn("p", F.lit(None).cast("double"))
    flip = F.when(uniform("flip", seed, *[F.col(k) for k in keys], F.col("draw"), *key) % 2 == 0, F.col(value)).otherwise(-F.col(value))
    flipped = _each(defined, repeats).groupBy(*keys, "draw").agg(F.avg(flip).alias("_flipped"))
    beyond = flipped.join(observed, keys).groupBy(*keys).agg(F.count_if(F.abs("_flipped") >= F.abs("mean") - 1e-12).alias("_beyond"))
    return out.join(beyond, keys).withColumn("p", (1 + F.col("_beyond")) / (repeats + 1)).drop("_beyond")


def permuted_labels(rows: DataFrame, label: str, repeats: int, seed: int, *key) -> DataFrame:
    """(draw, key columns, label): the labels of all rows dealt out anew, ``repeats`` times."""
    placed = numbered(rows, [], *key)
    shuffled = numbered(_each(placed.select(F.col("_i").alias("_from"), F.col(label).alias("_label")), repeats), ["draw"], seed, F.col("draw"), F.col("_from"))
    taken = shuffled.select("draw", "_i", F.col("_label").alias(label))
    return placed.drop(label, "_n").join(taken, "_i").drop("_i")
