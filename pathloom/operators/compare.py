"""Contrasts of conditions, influence of single texts, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E

NORMAL_95 = 1.959963984540054
#: Smallest number of edges of a text in every seed.
MIN_EDGES = 4


def leave_one_out_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``loo_mean``: the mean of the other rows of the keys; NULL for a single row."""
    group = Window.partitionBy(*keys)
    n = F.count(value).over(group)
    return df.withColumn("loo_mean", F.when(n > 1, (F.sum(value).over(group) - F.col(value)) / (n - 1)))


def jackknife_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, se, low, high): normal interval from the leave-one-out means."""
    loo = leave_one_out_means(df, keys, value)
    sums = loo.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop("loo_mean").alias("_v"))
    se = F.sqrt((F.col("n") - 1) * F.col("_v"))
    return sums.select(
        *keys,
        "n",
        "mean",
        se.alias("se"),
        (F.col("mean") - NORMAL_95 * se).alias("low"),
        (F.col("mean") + NORMAL_95 * se).alias("high"),
    )


def median_hierarchy(df: DataFrame, keys: list[str], value: str = "metric") -> DataFrame:
    """Median over texts in each repeat, then over repeats; undefined metrics are skipped."""
    inner = df.groupBy(*keys, "repeat").agg(E.quantile(F.col(value), 0.5).alias("_m"))
    return inner.groupBy(*keys).agg(E.quantile(F.col("_m"), 0.5).alias("median"), F.count("_m").alias("repeats"))


def leave_one_text_out(df: DataFrame, value: str = "metric") -> DataFrame:
    """(deleted, median, repeats): ``median_hierarchy`` without each text in turn.

    A median cannot be made from another, so every text's values go to every other text's deletion: rows times texts.
    """
    deleted = df.select(F.col("text_id").alias("deleted")).distinct()
    return median_hierarchy(df.join(deleted, F.col("text_id") != F.col("deleted")), ["deleted"], value)


def most_influential(estimates: DataFrame, full: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The text whose deletion changes the estimate most; the first in numeric text order on ties.

    ``estimates`` (keys, deleted, median), ``full`` (keys, median): a row for each key.
    """
    keys = keys or []
    whole = full.select(*keys, F.col("median").alias("_full"))
    joined = estimates.join(whole, keys) if keys else estimates.crossJoin(F.broadcast(whole))
    changed = joined.withColumn("change", F.col("median") - F.col("_full"))
    order = Window.partitionBy(*keys).orderBy(F.abs("change").desc_nulls_last(), *E.text_order(F.col("deleted")))
    return changed.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(
        *keys,
        "deleted",
        "median",
        "change",
        (F.signum("median") != F.signum("_full")).alias("sign_reversed"),
    )


def change_flags(estimates: DataFrame, full: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row: whether any deletion takes the estimate's sign, and whether any moves it across a threshold.

    An estimate that reaches 0 has lost its sign. At or below the threshold is one side of it, above the other.
    """
    joined = estimates.crossJoin(F.broadcast(full.select(F.col("median").alias("_full"))))  # one row
    m, f = F.col("median"), F.col("_full")
    lost = (f != 0) & (F.signum(m) != F.signum(f))
    return joined.agg(F.bool_or(lost).alias("sign_reversal"), F.bool_or((m > threshold) != (f > threshold)).alias("threshold_crossing"))


def paired_contrast(runs: DataFrame, first: str, second: str, min_edges: int = MIN_EDGES) -> DataFrame:
    """(text_id, seeds, min_edges, difference, raw_difference): mean over seeds of Fisher-z differences of two conditions.

    ``runs`` (seed, condition, text_id, correlation, n_edges). A text counts if every seed has both correlations
    and ``min_edges`` edges.
    """
    side = lambda name, out: runs.where(F.col("condition") == name).select(
        "seed",
        "text_id",
        F.col("correlation").alias(out),
        F.col("n_edges").alias(f"{out}_n"),
    )
    met = side(first, "a").join(side(second, "b"), ["seed", "text_id"], "full")
    fine = F.coalesce(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.least("a_n", "b_n") >= min_edges), F.lit(False))
    by_text = met.groupBy("text_id").agg(
        F.bool_and(fine).alias("_fine"),
        F.count(F.lit(1)).alias("seeds"),
        F.min(F.least("a_n", "b_n")).alias("min_edges"),
        F.avg(E.fisher(F.col("a")) - E.fisher(F.col("b"))).alias("difference"),
        F.avg(F.col("a") - F.col("b")).alias("raw_difference"),
    )
    return by_text.where("_fine").drop("_fine")


# Thresholds, strata and the bound of nearly perfect correlations.
THRESHOLDS = (4, 10, 20, 30)
STRATA = [(4, 9), (10, 19), (20, 29), (30, None)]
NEARLY_PERFECT = 0.99


def contrast_cells(runs: DataFrame, first: str, others: list[str]) -> DataFrame:
    """(other, text_id, seeds, defined, min_edges, difference, max_r, max_z, near_perfect) of every text that both conditions have.

    ``difference`` is the mean over seeds of Fisher-z differences; ``defined`` counts the seeds with both correlations,
    ``max_r``, ``max_z`` and ``near_perfect`` go over both conditions' correlations.
    """
    side = lambda rows, p: rows.select(
        "seed",
        "text_id",
        F.col("correlation").alias(p),
        F.col("n_edges").alias(f"{p}_n"),
        *(["other"] if p == "b" else []),
    )
    base = side(runs.where(F.col("condition") == first), "a")
    rest = side(runs.where(F.col("condition").isin(*others)).withColumnRenamed("condition", "other"), "b")
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    larger = F.greatest(F.abs(a), F.abs(b))
    near = (F.abs(a) >= NEARLY_PERFECT).cast("int") + (F.abs(b) >= NEARLY_PERFECT).cast("int")
    return base.join(rest, ["seed", "text_id"]).groupBy("other", "text_id").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.count_if(both).alias("defined"),
        F.min(F.least("a_n", "b_n")).alias("min_edges"),
        F.avg(E.fisher(a) - E.fisher(b)).alias("difference"),
        F.max(F.when(both, larger)).alias("max_r"),
        F.max(F.when(both, E.fisher(larger))).alias("max_z"),
        F.sum(F.when(both, near)).alias("near_perfect"),
    )


def retained(cells: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """``cells`` of ``contrast_cells`` once for each threshold that they meet: enough edges in every seed, and all seeds defined."""
    limits = cells.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    return cells.where("defined = seeds").join(limits, F.col("min_edges") >= F.col("threshold"))


def edge_thresholds(kept: DataFrame) -> DataFrame:
    """By (threshold, other) of ``retained``: texts, mean difference, extremes of their correlations, largest contribution to the mean."""
    n = F.count(F.lit(1))
    return kept.groupBy("threshold", "other").agg(
        n.alias("texts"),
        F.avg("difference").alias("mean"),
        F.max("max_r").alias("max_r"),
        F.max("max_z").alias("max_z"),
        F.sum("near_perfect").alias("near_perfect"),
        (F.max(F.abs("difference")) / n).alias("largest_contribution"),
    )


def edge_strata(cells: DataFrame) -> DataFrame:
    """(other, stratum, texts): how many texts have so few edges at least; texts without a defined contrast count, too."""
    named = cells.withColumn("stratum", E.closed_strata(F.col("min_edges"), STRATA)).where("stratum is not null")
    return named.groupBy("other", "stratum").agg(F.count(F.lit(1)).alias("texts"))


def condition_summary(runs: DataFrame) -> DataFrame:
    """By condition: Fisher mean of r over seeds and texts, mean NLL, token-weighted NLL, edges a seed."""
    by_seed = runs.groupBy("condition", "seed").agg(F.sum("n_edges").alias("_edges")).groupBy("condition").agg(F.avg("_edges").alias("edges_per_seed"))
    rows = runs.groupBy("condition").agg(
        E.fisher_mean(F.col("correlation")).alias("macro_r"),
        F.count("correlation").alias("defined"),
        F.avg("mlm_nll").alias("mean_nll"),
        F.expr("try_divide(sum(mlm_nll * mlm_tokens), sum(case when mlm_nll is not null then mlm_tokens end))").alias("token_nll"),
    )
    return rows.join(by_seed, "condition")


def text_contrasts(runs: DataFrame, base: str, others: list[str]) -> DataFrame:
    """(other, text_id, z_difference, nll_difference): means over seeds by text, base less each other condition."""
    by_text = runs.groupBy("condition", "text_id").agg(F.avg(E.fisher(F.col("correlation"))).alias("z"), F.avg("mlm_nll").alias("nll"))
    a = by_text.where(F.col("condition") == base).select("text_id", F.col("z").alias("_z"), F.col("nll").alias("_nll"))
    b = by_text.where(F.col("condition").isin(*others)).withColumnRenamed("condition", "other")
    return b.join(a, "text_id").select(
        "other",
        "text_id",
        (F.col("_z") - F.col("z")).alias("z_difference"),
        (F.col("_nll") - F.col("nll")).alias("nll_difference"),
    )


def learning_curve(curves: DataFrame) -> DataFrame:
    """By (steps, condition): Fisher mean of r over seeds and texts, and mean NLL."""
    return curves.groupBy("steps", "condition").agg(
        E.fisher_mean(F.col("correlation")).alias("macro_r"),
        F.avg("mlm_nll").alias("mean_nll"),
        F.count(F.lit(1)).alias("cells"),
    )


def pooled_correlation(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs, pooled_r): correlation of all edges of a run (keys, seed, x, y), and its mean over runs."""
    from pathloom.operators import metrics

    each = metrics.correlation(scores, [*keys, "seed"])
    return each.groupBy(*keys).agg(F.count("r").alias("runs"), F.avg("r").alias("pooled_r"))
