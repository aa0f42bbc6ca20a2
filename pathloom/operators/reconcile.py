"""Alignment of two token sequences of a text, and counts of unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.sources.scratch import written


def lexical_form(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def diagonal_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(text_id, i, j, length): all maximal runs of equal tokens of (text_id, i, token) and (text_id, j, token), positions from 0."""
    met = first.join(second, ["text_id", "token"]).select("text_id", "i", "j", (F.col("i") - F.col("j")).alias("_diagonal"))
    along = Window.partitionBy("text_id", "_diagonal").orderBy("i")
    islands = met.withColumn("_island", F.col("i") - F.row_number().over(along))
    return islands.groupBy("text_id", "_diagonal", "_island").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("length")).select(
        "text_id", "i", "j", "length"
    )


def matching_blocks(runs: DataFrame) -> DataFrame:
    """(text_id, i, j, length): the longest run, then those of what is before and behind it, and so on.

    Of equal runs the first in the first sequence is taken, then the first in the second. A round takes the longest run
    of every open segment of every text, and clips the others to the segments on its two sides, where they may be in
    both; rounds go on until no runs are left, about as often as the logarithm of a text's blocks. A segment is named by
    its first positions.
    """
    open_ = written(runs.select("*", F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b")), "runs")
    blocks = []
    while True:
        best = written(
            open_.groupBy("text_id", "_a", "_b").agg(F.max(F.struct("length", -F.col("i"), -F.col("j"))).alias("_best")).select(
                "text_id", "_a", "_b", (-F.col("_best.col2")).alias("_i"), (-F.col("_best.col3")).alias("_j"), F.col("_best.length").alias("_k")
            ),
            "blocks",
        )
        if best.isEmpty():
            break
        blocks.append(best.select("text_id", F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("_k").alias("length")))
        before = F.least("length", F.col("_i") - F.col("i"), F.col("_j") - F.col("j"))
        end_a, end_b = F.col("_i") + F.col("_k"), F.col("_j") + F.col("_k")
        skipped = F.greatest(end_a - F.col("i"), end_b - F.col("j"), F.lit(0))
        left = F.struct(F.col("_a").alias("_a"), F.col("_b").alias("_b"), F.col("i").alias("i"), F.col("j").alias("j"), before.alias("length"))
        right = F.struct(end_a.alias("_a"), end_b.alias("_b"), (F.col("i") + skipped).alias("i"), (F.col("j") + skipped).alias("j"), (F.col("length") - skipped).alias("length"))
        sides = open_.join(best, ["text_id", "_a", "_b"]).select("text_id", F.explode(F.array(left, right)).alias("_side"))
        open_ = written(sides.select("text_id", "_side.*").where("length > 0"), "runs")
    found = open_.select("text_id", "i", "j", "length")  # empty by now
    for block in blocks:
        found = found.unionByName(block)
    return found


def align_tokens(first: DataFrame, second: DataFrame) -> DataFrame:
    """(text_id, op, first_start, first_end, second_start, second_end) of (text_id, position, token) sequences.

    What lies between the ``matching_blocks`` is replaced, deleted or inserted; null tokens match nothing. A frequent
    token of a text costs the product of its places on both sides.
    """
    place = (F.row_number().over(Window.partitionBy("text_id").orderBy("position")) - 1).cast("long")
    a, b = (written(df.select("text_id", "token", place.alias(name)), "tokens") for df, name in ((first, "i"), (second, "j")))
    blocks = matching_blocks(diagonal_runs(a, b))
    count = F.count(F.lit(1)).cast("long")
    sizes = a.groupBy("text_id").agg(count.alias("i")).join(b.groupBy("text_id").agg(count.alias("j")), "text_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    ends = sizes.select("text_id", zero("i"), zero("j"), F.lit(0).cast("long").alias("length"))
    order = Window.partitionBy("text_id").orderBy("i", "j", F.desc("length"))
    behind = lambda c: F.coalesce(F.lag(F.col(c) + F.col("length")).over(order), F.lit(0)).alias(f"_{c}")
    placed = blocks.unionByName(ends).select("text_id", "i", "j", "length", behind("i"), behind("j"))
    in_a, in_b = F.col("i") > F.col("_i"), F.col("j") > F.col("_j")
    op = F.when(in_a & in_b, "replace").when(in_a, "delete").when(in_b, "insert")
    row = lambda kind, *bounds: F.struct(kind.alias("op"), *[x.alias(n) for x, n in zip(bounds, ("first_start", "first_end", "second_start", "second_end"))])
    gap = row(op, F.col("_i"), F.col("i"), F.col("_j"), F.col("j"))
    kept = F.when(F.col("length") > 0, F.lit("equal"))
    same = row(kept, F.col("i"), F.col("i") + F.col("length"), F.col("j"), F.col("j") + F.col("length"))
    return placed.select("text_id", F.explode(F.array(gap, same)).alias("_row")).select("text_id", "_row.*").where("op is not null")


def verified_positions(blocks: DataFrame) -> DataFrame:
    """(text_id, word_index) of the first sequence's tokens in equal blocks."""
    equal = blocks.where("op = 'equal'")
    return equal.select("text_id", F.explode(F.sequence("first_start", F.col("first_end") - 1)).alias("word_index"))


def reconciliation(blocks: DataFrame) -> DataFrame:
    """Tokens by text and kind of block."""
    return blocks.groupBy("text_id", "op").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(F.col("first_end") - F.col("first_start")).alias("first_tokens"),
        F.sum(F.col("second_end") - F.col("second_start")).alias("second_tokens"),
    )


def unique_counts(df: DataFrame, text_col: str, keys: dict[str, list[str]]) -> DataFrame:
    """Rows and distinct keys by text and overall (NULL text), in one pass of grouping sets."""
    return df.rollup(text_col).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_distinct(*[F.col(c) for c in columns]).alias(name) for name, columns in keys.items()],
    )
