"""Audits that put several operators together: partitions, nested bootstraps, influence of texts, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.operators import corpus_audit, draws, metrics, model, transitions
from pathloom.sources import readers
from pathloom.sources.scratch import written


def half_residuals(
    design: DataFrame,
    edges: DataFrame,
    draws: DataFrame,
    names: tuple[str, ...],
    folds: DataFrame,
    min_exposure: float = 5,
) -> DataFrame:
    """Cross-fitted residuals of every (draw, half): the counts of its subjects on the one design.

    Subjects' edges are summed up by a join with the draws; the fits of a (draw, half) are one task's work.
    """
    counts = transitions.half_edges(edges, draws)
    predicted = model.crossfit_many(design, counts, names, folds, ["draw", "half"], draws.select("draw", "half").distinct())
    return model.residuals(predicted, ["draw", "half"], min_exposure)


def reliability_by_draw(cells: DataFrame) -> DataFrame:
    """(draw, metric, ...): paired metrics of the two halves of each draw."""
    return metrics.paired_metrics(metrics.paired_halves(cells.where("half = 0"), cells.where("half = 1"), ["draw"]), ["draw"])


def partition_audit(cells: DataFrame) -> DataFrame:
    """By metric, over partitions: distributions of the median over texts and of the shares of negative and undefined texts."""
    by = reliability_by_draw(cells)
    shares = [x for c in ("negative_share", "undefined_share") for x in E.distribution(F.col(c), f"{c}_")]
    below = F.avg((F.col("median") < 0).cast("double")).alias("negative_partitions")
    return by.groupBy("metric").agg(F.count(F.lit(1)).alias("partitions"), *E.distribution(F.col("median")), below, *shares)


def nested_bootstrap(scores: DataFrame, keys: list[str], value: str, inner: int, seed: int) -> DataFrame:
    """(keys, draws, mean, low, high, negative_share): each outer draw of readers has its texts' mean and means of their resamples.

    ``scores`` has a row for each (keys, draw, text); undefined texts are not eligible. The inner resamples follow from
    the seed, the keys and the outer draw.
    """
    kept = scores.where(F.col(value).isNotNull()).select(*keys, F.col("draw").alias("outer"), "text_id", value)
    defined = written(kept, "scores")  # fits stand behind it, and it is read several times
    of_outer = defined.groupBy(*keys, "outer").agg(F.avg(value).alias("_mean")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"), F.avg("_mean").alias("mean")
    )
    means = draws.drawn_means(defined, [*keys, "outer"], value, inner, seed, F.col("text_id"))
    spread = means.withColumnRenamed("mean", "_inner").groupBy(*keys).agg(
        E.quantile(F.col("_inner"), 0.025).alias("low"),
        E.quantile(F.col("_inner"), 0.975).alias("high"),
        F.avg((F.col("_inner") < 0).cast("double")).alias("negative_share"),
    )
    return of_outer.join(spread, keys)


def text_influence(contrasts: DataFrame, names: list[str], resamples: int, seed: int) -> DataFrame:
    """(contrast, deleted, n, mean, low, high, flips): each contrast without each text, with its bootstrap interval.

    ``contrasts`` (contrast, text_id, difference). Whether the interval leaves out 0 is the conclusion; ``flips`` says
    that it differs from the one with all texts. Contrasts need three texts; every (contrast, deleted) has draws of
    its own.
    """
    texts = Window.partitionBy("contrast")
    named = contrasts.where(F.col("contrast").isin(*names) & F.col("difference").isNotNull()).select("contrast", "text_id", "difference")
    enough = written(named.withColumn("_n", F.count(F.lit(1)).over(texts)).where("_n >= 3").drop("_n"), "contrasts")
    clear = (F.col("low") > 0) | (F.col("high") < 0)
    whole = draws.mean_interval(enough, ["contrast"], "difference", resamples, seed).select("contrast", clear.alias("_clear"))
    deleted = enough.select("contrast", F.col("text_id").alias("deleted"))
    rest = enough.join(deleted, "contrast").where("text_id <> deleted")
    each = draws.mean_interval(rest, ["contrast", "deleted"], "difference", resamples, seed)
    return each.join(whole, "contrast").select("contrast", "deleted", "n", "mean", "low", "high", (clear != F.col("_clear")).alias("flips"))


def criterion_contrasts(
    cells: DataFrame,
    scores: DataFrame,
    keys: list[str],
    pairs: list[tuple[str, str]],
    min_edges: int = 4,
) -> DataFrame:
    """(keys, contrast, text_id, difference): Fisher-z differences of how two conditions' scores go with the residuals.

    ``cells`` (keys, text_id, src_word, dst_word, residual, reliable), ``scores`` (condition, seed, text_id, src_word,
    dst_word, score). A text counts if it has ``min_edges`` reliable cells and both conditions a correlation in every seed.
    """
    edge = ["text_id", "src_word", "dst_word"]
    met = cells.where("reliable").select(*keys, *edge, F.col("residual").alias("x")).join(scores.withColumnRenamed("score", "y"), edge)
    each = metrics.correlation(met, [*keys, "condition", "seed", "text_id"])
    texts = each.where(F.col("n") >= min_edges).groupBy(*keys, "condition", "text_id").agg(
        F.bool_and(F.col("r").isNotNull()).alias("fine"), F.avg(E.fisher(F.col("r"))).alias("z")
    )
    fine = texts.where("fine").drop("fine")
    out = []
    for a, b in pairs:
        side = lambda name, z: fine.where(F.col("condition") == name).select(*keys, "text_id", F.col("z").alias(z))
        both = side(a, "_a").join(side(b, "_b"), [*keys, "text_id"])
        out.append(both.select(*keys, F.lit(f"{a}_vs_{b}").alias("contrast"), "text_id", (F.col("_a") - F.col("_b")).alias("difference")))
    return readers.concat_subjects(out)


def audit_corpora(
    first: DataFrame,
    second: DataFrame,
    names: tuple[str, ...],
    resamples: int,
    permutations: int,
    seed: int,
) -> dict[str, DataFrame]:
    """All comparisons of two corpora's designs (with counts), by name."""
    both = first.withColumn("corpus", F.lit("first")).unionByName(second.withColumn("corpus", F.lit("second")))
    summaries = corpus_audit.text_summaries(first).withColumn("corpus", F.lit("first")).unionByName(
        corpus_audit.text_summaries(second).withColumn("corpus", F.lit("second"))
    )
    return {
        "summaries": summaries,
        "features": corpus_audit.feature_differences(both, names, "corpus", "first", "second", resamples, seed),
        "coefficients": corpus_audit.coefficient_audit(first, second, names, resamples, seed + 1),
        "first_to_second": corpus_audit.transported_nll(first, second, names),
        "second_to_first": corpus_audit.transported_nll(second, first, names),
        "classifier": corpus_audit.domain_classifier(summaries, "corpus", "second", permutations, seed + 2),
    }
