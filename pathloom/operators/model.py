"""The source-conditional multinomial model: likelihood, Newton fits, predictions and residuals."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.functions.bounds import MOST_TEXTS, few
from pathloom.operators import responses
from pathloom.operators.responses import NotConverged
from pathloom.sources.scratch import written

GROUP = ["text_id", "src_word"]
KEYS = [*GROUP, "dst_word"]


def trailing_number(text_id: str) -> int:
    return int(str(text_id).split(":")[-1])


def text_folds(text_ids: list[str], n_folds: int = 5, seed: int = 20260711) -> list[list[str]]:
    """Distinct texts in numeric order, shuffled by the seed (the published one's sequence); fold i takes every n-th."""
    ids = sorted(set(text_ids), key=trailing_number)
    random.Random(seed).shuffle(ids)
    return [ids[i::n_folds] for i in range(n_folds)]


def folds_table(spark, text_ids: list[str], n_folds: int = 5, seed: int = 20260711) -> DataFrame:
    return spark.createDataFrame(
        [(t, i) for i, fold in enumerate(text_folds(text_ids, n_folds, seed)) for t in fold],
        "text_id string, fold int",
    )


# -- likelihood on columns -------------------------------------------------------------------------------


def linear_score(coefficients: dict[str, float]) -> Column:
    return sum((F.col(n) * F.lit(float(b)) for n, b in coefficients.items()), F.lit(0.0))


def with_probability(scored: DataFrame, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """``scored`` with ``probability``: a softmax within each source (and whatever other keys are given)."""
    group = Window.partitionBy(*(keys or GROUP))
    e = F.exp(F.col(score) - F.max(score).over(group))
    return scored.withColumn("_e", e).withColumn("probability", F.col("_e") / F.sum("_e").over(group)).drop("_e")


def nll_and_gradient(design: DataFrame, coefficients: dict[str, float], l2: float = 1.0) -> DataFrame:
    """One row: the penalised negative log-likelihood and its gradient, as sums over the design."""
    group = Window.partitionBy(*GROUP)
    scored = design.withColumn("score", linear_score(coefficients)).withColumn("_top", F.max("score").over(group))
    scored = scored.withColumn(
        "_e",
        F.exp(F.col("score") - F.col("_top")),
    ).withColumn("_z", F.sum("_e").over(group)).withColumn("_total", F.sum("count").over(group))
    penalty = 0.5 * l2 * sum(b * b for b in coefficients.values())
    loss = F.sum(F.col("count") * (F.log("_z") + F.col("_top") - F.col("score"))) + F.lit(penalty)
    pull = F.col("_total") * F.col("_e") / F.col("_z") - F.col("count")
    return scored.agg(loss.alias("nll"), *[(F.sum(F.col(n) * pull) + F.lit(l2 * b)).alias(f"d_{n}") for n, b in coefficients.items()])


# -- fits ------------------------------------------------------------------------------------------------


def newton_fit(
    x: np.ndarray,
    count: np.ndarray,
    starts: np.ndarray,
    l2: float = 1.0,
    max_rounds: int = 100,
    tolerance: float = 1e-9,
) -> np.ndarray:
    """Coefficients that minimise the penalised likelihood; groups begin at ``starts``. Raises if it does not settle.

    The penalty makes the problem strictly convex, so the optimum is unique; steps are halved until they help.
    """
    lengths = np.diff(np.append(starts, len(x)))
    total = np.add.reduceat(count, starts) if len(x) else np.zeros(0)
    wide = lambda v: np.repeat(v, lengths)

    def evaluate(beta: np.ndarray):
        s = x @ beta
        top = np.maximum.reduceat(s, starts)
        e = np.exp(s - wide(top))
        z = np.add.reduceat(e, starts)
        loss = 0.5 * l2 * beta @ beta + total @ (np.log(z) + top) - count @ s
        return loss, e / wide(z)

    beta = np.zeros(x.shape[1])
    if not len(x):
        return beta
    loss, p = evaluate(beta)
    for _ in range(max_rounds):
        weight = wide(total) * p
        gradient = l2 * beta + x.T @ (weight - count)
        means = np.add.reduceat(p[:, None] * x, starts)
        hessian = l2 * np.eye(len(beta)) + x.T @ (weight[:, None] * x) - means.T @ (total[:, None] * means)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        settled = np.abs(gradient).max(initial=0) <= tolerance * (1 + total.sum())
        if settled or gradient @ step <= 1e-12 * (1 + abs(loss)):  # the rest is rounding; one last full step
            return beta - step
        while True:
            new_loss, new_p = evaluate(beta - size * step)
            if new_loss <= loss - 1e-4 * size * (gradient @ step) or size < 1e-10:
                break
            size /= 2
        if size < 1e-10:
            if np.abs(gradient).max() <= 1e-5 * (1 + total.sum()):
                return beta
            raise NotConverged("no step lowers the loss")
        beta, loss, p = beta - size * step, new_loss, new_p
    raise NotConverged(f"no convergence in {max_rounds} rounds")


def _fit_frame(names: tuple[str, ...], keys: list[str], l2: float):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(KEYS)
        group = rows[GROUP]
        starts = np.flatnonzero((group != group.shift()).any(axis=1).to_numpy())
        beta = newton_fit(rows[list(names)].to_numpy(float), rows["count"].to_numpy(float), starts, l2)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(names) for k in keys}, "feature": list(names), "coefficient": beta})

    return fit


def fit(design: DataFrame, names: tuple[str, ...], keys: list[str], l2: float = 1.0) -> DataFrame:
    """(keys, feature, coefficient): one fit for each value of ``keys``, all at once."""
    kinds = ", ".join(f"{k} {design.schema[k].dataType.simpleString()}" for k in keys)
    return design.select(*dict.fromkeys([*keys, *KEYS, *names, "count"])).groupBy(*keys).applyInPandas(
        _fit_frame(names, keys, l2),
        f"{kinds}, feature string, coefficient double",
    )


def fit_large(
    design: DataFrame,
    names: tuple[str, ...],
    l2: float = 1.0,
    max_rounds: int = 30,
    tolerance: float = 1e-8,
) -> dict[str, float]:
    """One fit over a design of any size: it is laid out once, and each Newton round is one pass of sums, P + P(P+1)/2 of them."""
    once = F.array(F.struct(F.lit(0).alias("_r"), F.lit(1.0).alias("times")))
    none = F.lit(None).cast("array<struct<_r:int,dst_word:bigint,count:double>>")
    laid = written(responses.lay_out(design, names, count=True).withColumn("counts", none).withColumn("times", once), "design")
    beta = responses.fit_responses(laid, 1, len(names), 1, l2, max_rounds=max_rounds, tolerance=tolerance)
    return dict(zip(names, beta[0, 0].tolist()))


#: Largest design, in cells times features, that every task may hold as a whole: 160 MB.
SHARED_NUMBERS = 20_000_000


class SharedDesign:
    """A design's cells in order, with their features, which every task holds; counts come as sparse rows of a group."""

    def __init__(self, keys: pd.DataFrame, x: np.ndarray, fold: np.ndarray):
        self.keys, self.x, self.fold = keys, x, fold
        change = np.append(
            True,
            (keys[GROUP].iloc[1:].to_numpy() != keys[GROUP].iloc[:-1].to_numpy()).any(axis=1),
        ) if len(keys) else np.zeros(0, bool)
        self.group = np.cumsum(change) - 1
        self.place = pd.Series(np.arange(len(keys)), pd.MultiIndex.from_frame(keys))

    def counts(self, rows: pd.DataFrame) -> np.ndarray:
        """Dense counts from sparse ones; rows of cells that the design lacks fall away."""
        out = np.zeros(len(self.keys))
        at = self.place.reindex(pd.MultiIndex.from_frame(rows[KEYS])).to_numpy()
        found = ~np.isnan(at)
        np.add.at(out, at[found].astype(np.int64), rows["count"].to_numpy(float)[found])
        return out

    def starts(self, used: np.ndarray) -> np.ndarray:
        group = self.group[used]
        return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)

    def fit(self, count: np.ndarray, used: np.ndarray, l2: float) -> np.ndarray:
        return newton_fit(self.x[used], count[used], self.starts(used), l2)

    def probability(self, beta: np.ndarray, used: np.ndarray) -> np.ndarray:
        starts, s = self.starts(used), self.x[used] @ beta
        wide = np.diff(np.append(starts, len(s)))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), wide))
        return e / np.repeat(np.add.reduceat(e, starts), wide)


def share_design(design: DataFrame, names: tuple[str, ...], folds: DataFrame | None = None) -> SharedDesign | None:
    """The design for ``SharedDesign``, or None if it is larger than SHARED_NUMBERS allows."""
    placed = design.join(folds, "text_id") if folds is not None else design.withColumn("fold", F.lit(0))
    limit = SHARED_NUMBERS // max(1, len(names))
    rows = placed.select(*KEYS, "fold", *[F.col(n).cast("double").alias(n) for n in names]).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    table = rows.to_pandas().sort_values(KEYS, kind="stable").reset_index(drop=True)
    return SharedDesign(table[KEYS], table[list(names)].to_numpy(float), table["fold"].to_numpy(int))


def _by_group(counts: DataFrame, by: list[str], one: Callable, schema: str) -> DataFrame:
    """``one`` over the sparse rows of each group; its result's rows begin with the group's keys."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = one(rows[rows["text_id"].notna()])
        for i, k in enumerate(by):
            out.insert(i, k, rows[k].iloc[0])
        return out

    kinds = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by)
    return counts.select(*by, *KEYS, "count").groupBy(*by).applyInPandas(run, f"{kinds}, {schema}")


def crossfit_many(
    design: DataFrame,
    counts: DataFrame,
    names: tuple[str, ...],
    folds: DataFrame,
    by: list[str],
    sides: DataFrame,
    l2: float = 1.0,
) -> DataFrame:
    """(by, KEYS, count, probability) for each row of ``sides`` (by): out-of-fold predictions of its counts on the one design.

    ``counts`` (by, KEYS, count) holds nonzero cells only; with the design in every task they are all that moves, and
    the fits of a group run in one task. A design beyond SHARED_NUMBERS stays where it lies, and the fits of all groups
    take their Newton steps together, by sums over it (``responses``); results are the same.
    """
    shared = share_design(design, names, folds)
    if shared is None:
        return responses.crossfit_responses(design, counts, names, folds, by, sides, l2)
    held = design.sparkSession.sparkContext.broadcast(shared)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        d = held.value
        y, p = d.counts(rows), np.zeros(len(d.keys))
        for f in np.unique(d.fold):
            test = d.fold == f
            p[test] = d.probability(d.fit(y, ~test, l2), test)
        return d.keys.assign(count=y, probability=p)

    # A group without any count still has its predictions.
    empty = sides.select(*by, *[F.lit(None).cast(design.schema[k].dataType).alias(k) for k in KEYS], F.lit(0.0).alias("count"))
    kinds = ", ".join(f"{k} {design.schema[k].dataType.simpleString()}" for k in KEYS)
    return _by_group(counts.select(*by, *KEYS, "count").unionByName(empty), by, one, f"{kinds}, count double, probability double")


def fit_draws(counted: DataFrame, draws: DataFrame, names: tuple[str, ...], l2: float = 1.0) -> DataFrame:
    """(draw, feature, coefficient) of fits that weigh each text's counts by its multiplicity: ``draws`` (draw, text_id, times)."""
    shared = share_design(counted, (*names, "count"))
    if shared is None:
        return responses.fit_weighted(counted, draws, names, l2)
    held = counted.sparkSession.sparkContext.broadcast(shared)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = held.value
        times = d.keys["text_id"].map(dict(zip(rows["text_id"], rows["times"]))).fillna(0).to_numpy(float)
        every = np.ones(len(d.keys), bool)
        beta = newton_fit(d.x[:, :-1], d.x[:, -1] * times, d.starts(every), l2)
        return pd.DataFrame({"draw": rows["draw"].iloc[0], "feature": list(names), "coefficient": beta})

    return draws.groupBy("draw").applyInPandas(run, "draw int, feature string, coefficient double")


def fold_fits(design: DataFrame, names: tuple[str, ...], folds: DataFrame, by: list[str] | None = None, l2: float = 1.0) -> DataFrame:
    """(by, held, feature, coefficient): the fit on all texts of other folds than ``held``."""
    n_folds = folds.select("fold").distinct().count()
    held = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("held")
    training = design.join(folds, "text_id").select("*", held).where("held <> fold")
    return fit(training, names, [*(by or []), "held"], l2)


def fit_predict_folds(
    design: DataFrame,
    names: tuple[str, ...],
    folds: DataFrame,
    by: list[str] | None = None,
    l2: float = 1.0,
) -> DataFrame:
    """``design`` with out-of-fold ``probability``: each text is scored by the fit on all texts of other folds.

    ``by`` names further keys (draw, half, specification) with a fit of their own. The design is laid out once
    for each (by, fold) that trains on it; folds are few, and fits run side by side.
    """
    by = by or []
    fits = fold_fits(design, names, folds, by, l2)
    wide = fits.groupBy(*by, F.col("held").alias("fold")).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("_beta")
    )
    joined = design.join(folds, "text_id").join(wide, [*by, "fold"])
    scored = joined.withColumn("score", sum((F.col(n) * F.element_at("_beta", F.lit(n)) for n in names), F.lit(0.0)))
    return with_probability(scored, keys=[*by, *GROUP]).drop("_beta", "score")


# -- residuals -------------------------------------------------------------------------------------------


def residuals(scored: DataFrame, by: list[str] | None = None, min_exposure: float = 5, check_finite: bool = True) -> DataFrame:
    """``scored`` with exposure, expected, risk_size, residual (Pearson), deviance, deviation and reliable.

    A cell is reliable if its source has ``min_exposure`` events and two candidates, and, if
    ``check_finite``, a defined residual.
    """
    group = Window.partitionBy(*(by or []), *GROUP)
    sized = scored.withColumn("exposure", F.sum("count").over(group)).withColumn("risk_size", F.count(F.lit(1)).over(group))
    out = sized.withColumn("expected", F.col("exposure") * F.col("probability"))
    out = out.withColumn("residual", E.pearson(F.col("count"), F.col("expected"), F.col("probability"), F.col("risk_size")))
    out = out.withColumn(
        "deviance",
        E.deviance(F.col("count"), F.col("expected")),
    ).withColumn("deviation", F.col("count") - F.col("expected"))
    reliable = (F.col("exposure") >= min_exposure) & (F.col("risk_size") >= 2)
    return out.withColumn("reliable", reliable & F.col("residual").isNotNull() if check_finite else reliable)


def crossfit_residuals(
    design: DataFrame,
    names: tuple[str, ...],
    folds: DataFrame,
    by: list[str] | None = None,
    min_exposure: float = 5,
) -> DataFrame:
    return residuals(fit_predict_folds(design, names, folds, by), by, min_exposure)


def robust_targets(residual: DataFrame, train_texts: DataFrame | None = None, clip: float | None = 5.0) -> DataFrame:
    """``residual`` with ``target``: residuals less their median, over 1.4826 times their median absolute deviation.

    Both come from reliable cells (of the training texts, if given); the scale is at least 1e-8.
    """
    base = residual.where("reliable")
    if train_texts is not None:
        base = base.join(F.broadcast(train_texts.select("text_id")), "text_id", "left_semi")
    centre = base.agg(E.quantile(F.col("residual"), 0.5).alias("_centre"))
    spread = base.crossJoin(F.broadcast(centre)).agg(E.quantile(F.abs(F.col("residual") - F.col("_centre")), 0.5).alias("_mad"))
    z = (F.col("residual") - F.col("_centre")) / F.greatest(1.4826 * F.col("_mad"), F.lit(1e-8))
    target = z if clip is None else E.clamped(z, -clip, clip)
    both = residual.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(spread))  # one row each
    return both.withColumn("target", F.when(F.col("reliable"), target).cast("float")).drop("_centre", "_mad")


def split_targets(design: DataFrame, names: tuple[str, ...], train: list[str], min_exposure: float = 5) -> DataFrame:
    """Residuals of training texts by the fit without that text, and of the others by the fit on all training texts."""
    spark = design.sparkSession
    ids = [r[0] for r in few(design.select("text_id").distinct(), MOST_TEXTS, "texts")]
    plan = [(t, t if t in set(train) else "") for t in ids]
    fold_of = spark.createDataFrame(plan, "text_id string, held string")
    helds = sorted({h for _, h in plan})
    in_train = spark.createDataFrame([(t,) for t in train], "text_id string")
    every = F.explode(F.array(*map(F.lit, helds))).alias("held")
    training = design.join(in_train, "text_id", "left_semi").select("*", every).where("held <> text_id")
    entries = F.collect_list(F.struct("feature", "coefficient"))
    wide = fit(training, names, ["held"]).groupBy("held").agg(F.map_from_entries(entries).alias("_beta"))
    joined = design.join(fold_of, "text_id").join(wide, "held")
    scored = joined.withColumn("score", sum((F.col(n) * F.element_at("_beta", F.lit(n)) for n in names), F.lit(0.0)))
    found = residuals(with_probability(scored).drop("_beta", "score", "held"), None, min_exposure)
    return robust_targets(found, in_train)


# -- predictive scores -------------------------------------------------------------------------------------


def text_nll(scored: DataFrame) -> DataFrame:
    """(text_id, events, nll, uniform_nll): mean negative log-likelihood of a text's events; NULL without events."""
    group = Window.partitionBy(*GROUP)
    sized = scored.withColumn("_size", F.count(F.lit(1)).over(group))
    p = F.greatest(F.col("probability"), F.lit(E.MIN_PROBABILITY))
    sums = sized.groupBy("text_id").agg(
        F.sum("count").alias("events"),
        F.sum(-F.col("count") * F.ln(p)).alias("total"),
        F.sum(F.col("count") * F.ln("_size")).alias("uniform"),
    )
    return sums.select(
        "text_id",
        "events",
        F.when(F.col("events") > 0, F.col("total") / F.col("events")).alias("nll"),
        F.when(F.col("events") > 0, F.col("uniform") / F.col("events")).alias("uniform_nll"),
    )


def predictive_score(scored: DataFrame) -> DataFrame:
    """One row: total, mean and uniform NLL, their difference, and the number of events."""
    group = Window.partitionBy(*GROUP)
    p = F.greatest(F.col("probability"), F.lit(E.MIN_PROBABILITY))
    sums = scored.withColumn("_size", F.count(F.lit(1)).over(group)).agg(
        F.sum("count").alias("events"),
        F.sum(-F.col("count") * F.ln(p)).alias("nll"),
        F.sum(F.col("count") * F.ln("_size")).alias("uniform_nll"),
    )
    return sums.select(
        "events",
        "nll",
        "uniform_nll",
        (F.col("uniform_nll") - F.col("nll")).alias("gain"),
        F.when(F.col("events") > 0, F.col("nll") / F.col("events")).alias("mean_nll"),
    )


def crossfit_nll(design: DataFrame, names: tuple[str, ...], folds: DataFrame) -> DataFrame:
    """One row: mean over texts of their held-out mean NLL, and of the uniform one; texts without events do not count."""
    by_text = text_nll(fit_predict_folds(design, names, folds))
    return by_text.agg(F.avg("nll").alias("nll"), F.avg("uniform_nll").alias("uniform_nll"), F.count("nll").alias("texts"))
