"""Differences between corpora: geometry, features, coefficients, transported likelihood, domain classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.operators import draws, model, responses
from pathloom.sources.scratch import written

#: Deviations below this are rounding.
NO_SPREAD = 1e-9
# Names of a text's measures.
SUMMARIES = (
    "words",
    "candidate_pairs",
    "source_groups",
    "candidates_per_source",
    "mean_distance",
    "adjacency_rate",
    "line_span",
    "events_per_source",
    "zero_destination_proportion",
    "destination_concentration",
    "destination_entropy",
)


def text_summaries(counted: DataFrame) -> DataFrame:
    """Eleven measures of each text's candidates and counts; empty sources add 0 to concentration and entropy."""
    total = F.sum("count").over(Window.partitionBy("text_id", "src_word"))
    share = F.when(total > 0, F.col("count") / total).otherwise(F.lit(0.0))
    d = F.col("dst_word") - F.col("src_word")
    cells = counted.withColumn("_p", share)
    sources = cells.groupBy("text_id", "src_word").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("count").alias("events"),
        F.sum(F.col("_p") * F.col("_p")).alias("c"),
        F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p")).otherwise(F.lit(0.0))).alias("h"),
        F.sum(d).alias("d"),
        F.max(d).alias("span"),
        F.count_if(d == 1).alias("adjacent"),
        F.count_if(F.col("count") == 0).alias("zero"),
    )
    texts = sources.groupBy("text_id").agg(
        F.sum("n").alias("candidate_pairs"),
        F.count(F.lit(1)).alias("source_groups"),
        F.avg("n").alias("candidates_per_source"),
        (F.sum("d") / F.sum("n")).alias("mean_distance"),
        (F.sum("adjacent") / F.sum("n")).alias("adjacency_rate"),
        F.max("span").cast("double").alias("line_span"),
        F.avg("events").alias("events_per_source"),
        (F.sum("zero") / F.sum("n")).alias("zero_destination_proportion"),
        F.avg("c").alias("destination_concentration"),
        F.avg("h").alias("destination_entropy"),
    )
    words = counted.select(
        "text_id",
        F.explode(F.array("src_word", "dst_word")).alias("w"),
    ).groupBy("text_id").agg(F.count_distinct("w").alias("words"))
    return texts.join(words, "text_id").select("text_id", *SUMMARIES)


def feature_differences(
    design: DataFrame,
    names: tuple[str, ...],
    corpus: str,
    first: str,
    second: str,
    resamples: int = 0,
    seed: int = 20260711,
) -> DataFrame:
    """(feature, first, second, smd, low, high): text means in either corpus, and their difference in pooled deviations.

    The pooled variance weighs each corpus by its texts less one; a difference over no spread is 0. With
    ``resamples`` the interval is that of the difference under resampled texts of both corpora, over the same
    deviation; every feature has the same draws.
    """
    texts = design.groupBy(corpus, "text_id").agg(*[F.avg(n).alias(n) for n in names]).unpivot(
        [corpus, "text_id"],
        list(names),
        "feature",
        "value",
    )
    if resamples:
        texts = written(texts, "text-means")
    side = lambda c: F.when(F.col(corpus) == c, F.col("value"))
    freedom = lambda c: F.greatest(F.count(side(c)) - 1, F.lit(0))
    within = lambda c: freedom(c) * F.coalesce(F.var_samp(side(c)), F.lit(0.0))
    pooled = F.sqrt((within(first) + within(second)) / F.greatest(freedom(first) + freedom(second), F.lit(1)))
    sums = texts.groupBy("feature").agg(F.avg(side(first)).alias("first"), F.avg(side(second)).alias("second"), pooled.alias("_pooled"))
    smd = F.when(F.col("_pooled") > NO_SPREAD, (F.col("first") - F.col("second")) / F.col("_pooled")).otherwise(F.lit(0.0))
    measured = sums.select("feature", "first", "second", smd.alias("smd"), "_pooled")
    if not resamples:
        none = F.lit(None).cast("double")
        return measured.select("feature", "first", "second", "smd", none.alias("low"), none.alias("high"))

    drawn = draws.resampled(texts.select(corpus, "text_id").distinct(), [corpus], resamples, seed, F.col("text_id"))
    means = texts.join(drawn, [corpus, "text_id"]).groupBy("feature", "draw").agg(
        *[(F.sum(F.col("times") * side(c)) / F.sum(F.when(F.col(corpus) == c, F.col("times")))).alias(f"_{i}") for i, c in enumerate((first, second))]
    )
    gap = F.col("_0") - F.col("_1")
    limits = means.groupBy("feature").agg(E.quantile(gap, 0.025).alias("_low"), E.quantile(gap, 0.975).alias("_high"))
    scaled = lambda c: F.when(F.col("_pooled") > NO_SPREAD, F.col(c) / F.col("_pooled")).otherwise(F.lit(0.0))
    return measured.join(limits, "feature").select(
        "feature",
        "first",
        "second",
        "smd",
        scaled("_low").alias("low"),
        scaled("_high").alias("high"),
    )


def coefficient_audit(first: DataFrame, second: DataFrame, names: tuple[str, ...], resamples: int, seed: int) -> DataFrame:
    """(feature, first, second, difference, low, high): two fits and a paired bootstrap over texts.

    A draw weighs the counts of a text by how often it was drawn, on the unchanged design. Draw -1 is the data.
    """
    sides = {"first": first, "second": second}
    texts = [d.select(F.lit(n).alias("side"), "text_id").distinct() for n, d in sides.items()]
    drawn = draws.resampled(texts[0].unionByName(texts[1]), ["side"], resamples, seed, F.col("text_id"))
    data_rows = texts[0].unionByName(texts[1]).withColumn("draw", F.lit(-1)).withColumn("times", F.lit(1).cast("long"))
    every = data_rows.unionByName(drawn.select(*data_rows.columns))
    fits = [
        model.fit_draws(d, every.where(F.col("side") == n).drop("side"), names).withColumnRenamed("coefficient", n) for n, d in sides.items()
    ]
    both = fits[0].join(fits[1], ["draw", "feature"]).withColumn("_d", F.col("first") - F.col("second"))
    own = F.col("draw") == -1
    data = lambda c: F.max(F.when(own, F.col(c)))
    spread = F.when(~own, F.col("_d"))
    return both.groupBy("feature").agg(
        data("first").alias("first"),
        data("second").alias("second"),
        data("_d").alias("difference"),
        E.quantile(spread, 0.025).alias("low"),
        E.quantile(spread, 0.975).alias("high"),
    )


def transported_nll(fitted_on: DataFrame, scored_on: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row: text-equal NLL on one corpus of the model fitted on the other, and of the uniform one."""
    beta = {r["feature"]: r["coefficient"] for r in model.fit(fitted_on.withColumn("_all", F.lit(0)), names, ["_all"]).collect()}
    scored = model.with_probability(scored_on.withColumn("score", model.linear_score(beta)))
    return model.text_nll(scored).agg(F.avg("nll").alias("nll"), F.avg("uniform_nll").alias("uniform_nll"), F.count("nll").alias("texts"))


# -- domain classification --------------------------------------------------------------------------------------


def stratified_folds(rows: DataFrame, label: str, n_folds: int, seed: int) -> DataFrame:
    """``rows`` (text_id, ...) with ``fold``: each label's rows in the order of a digest, dealt out in turn."""
    placed = draws.numbered(rows, [label], "fold", seed, F.col("text_id"))
    return placed.withColumn("fold", (F.col("_i") % n_folds).cast("int")).drop("_i", "_n")


def _standard(rows: DataFrame, names: tuple[str, ...], n_folds: int) -> np.ndarray:
    """Means and deviations (2 x folds x features) of all rows but those of each fold; deviations of 0 are 1."""
    sums = [f(F.when(F.col("fold") != h, F.col(n))).alias(f"{k}_{h}_{i}") for k, f in enumerate((F.avg, F.stddev_pop)) for h in range(n_folds) for i, n in enumerate(names)]
    row = rows.agg(*sums).first()  # one row of folds x features
    found = np.array([[[row[f"{k}_{h}_{i}"] or 0.0 for i in range(len(names))] for h in range(n_folds)] for k in range(2)])
    # What is left of a constant's deviation by rounding is 0.
    flat = found[1] <= 1e-12 * np.maximum(1.0, np.abs(found[0]))
    return np.stack([found[0], np.where(flat, 1.0, found[1])])


def _with_standard(batch: pa.RecordBatch, names: tuple[str, ...], standard: np.ndarray, held: int) -> np.ndarray:
    x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
    return np.column_stack([(x - standard[0, held]) / standard[1, held], np.ones(len(x))])


def out_of_fold_scores(rows: DataFrame, names: tuple[str, ...], labels: int, n_folds: int) -> DataFrame:
    """(draw, text_id, label, score): penalised logistic scores of every row by the fit without its fold, for each labelling.

    ``rows`` (text_id, fold, names, labels), the labels an array of 0 and 1, one for each labelling. All fits take their
    Newton steps together: tasks add up their rows' gradients and curvatures, which are all that moves. The intercept is
    not penalised; features are standardised within the training rows. Labelling i has draw i - 1.
    """
    laid = written(rows.select("text_id", "fold", *[F.col(n).cast("double").alias(n) for n in names], F.col("labels").cast("array<int>").alias("labels")), "labelled")
    standard = _standard(laid, names, n_folds)
    size = len(names) + 1
    upper = np.triu_indices(size)

    def round_(beta: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((labels, n_folds, responses.numbers_of(size)))
            for batch in batches:
                y = batch.column("labels").flatten().to_numpy().reshape(-1, labels).astype(float)
                fold = batch.column("fold").to_numpy()
                for held in range(n_folds):
                    mine = fold != held
                    x, labelled = _with_standard(batch, names, standard, held)[mine], y[mine]
                    s = x @ beta[:, held].T
                    p = 1 / (1 + np.exp(-s))
                    out = total[:, held]
                    out[:, 0] += (np.logaddexp(0, s) - labelled * s).sum(0)
                    out[:, 1] += len(x)
                    out[:, 2 : 2 + size] += (p - labelled).T @ x
                    out[:, 2 + size :] += (p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
            yield from responses.chunks_of(total)

        return responses.tree_sum(laid.mapInArrow(partial, responses.SUMS), (labels, n_folds, responses.numbers_of(size)))

    beta = responses.newton(round_, (labels, n_folds), np.append(np.ones(len(names)), 0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, n = batch.column("fold").to_numpy(), batch.num_rows
            found = np.zeros((n, labels))
            for held in np.unique(fold):
                mine = fold == held
                found[mine] = _with_standard(batch, names, standard, int(held))[mine] @ beta[:, held].T
            draw, place = np.tile(np.arange(-1, labels - 1, dtype=np.int32), n), pa.array(np.repeat(np.arange(n), labels))
            columns = [pa.array(draw), batch.column("text_id").take(place), batch.column("labels").flatten(), pa.array(found.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["draw", "text_id", "label", "score"])

    kind = rows.schema["text_id"].dataType.simpleString()
    return laid.mapInArrow(score, f"draw int, text_id {kind}, label int, score double")


def classified_well(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, balanced, area) of (keys, label, score): balanced accuracy at 0, and the share of (positive, negative) pairs in
    the right order, ties by half.

    Scores are counted by 256 ranges first, so that no task orders a group as a whole.
    """
    slice_ = F.least(F.floor(256 / (1 + F.exp(-F.col("score")))), F.lit(255))
    cells = scored.groupBy(*keys, slice_.alias("_slice"), "score").agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))
    sizes = cells.groupBy(*keys, "_slice").agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    whole, up_to = Window.partitionBy(*keys), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select(*keys, "_slice", F.coalesce(F.sum("_ns").over(up_to(whole.orderBy("_slice"))), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("_n").over(up_to(Window.partitionBy(*keys, "_slice").orderBy("score"))), F.lit(0))
    won = F.col("_p") * (F.col("_before") + F.col("_inner") + F.col("_n") / 2)
    ordered = cells.withColumn("_inner", inner).join(places, [*keys, "_slice"])
    right = lambda label, good: F.sum(F.when(good, F.col(label)).otherwise(F.lit(0))) / F.sum(label)
    return ordered.groupBy(*keys).agg(
        ((right("_p", F.col("score") >= 0) + right("_n", F.col("score") < 0)) / 2).alias("balanced"),
        (F.sum(won) / (F.sum("_p") * F.sum("_n"))).alias("area"),
    )


def domain_classifier(
    summaries: DataFrame,
    corpus: str,
    second: str,
    permutations: int,
    seed: int,
    n_folds: int = 5,
    names: tuple[str, ...] = SUMMARIES,
) -> DataFrame:
    """One row: balanced accuracy, area and their permutation p of telling two corpora apart by their text summaries.

    Permutations of the labels keep the folds; each text carries its labels under all of them, and nothing but the fits'
    sums comes to the driver. A value that equals the observed one but for rounding counts.
    """
    marked = written(summaries.select("text_id", *names, (F.col(corpus) == second).cast("int").alias("label")), "summaries")
    folded = stratified_folds(marked, "label", n_folds, seed)
    anew = draws.permuted_labels(marked.select("text_id", "label"), "label", permutations, seed, F.col("text_id"))
    listed = anew.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("draw", "label"))).alias("_drawn"))
    own = F.concat(F.array("label"), F.transform("_drawn", lambda x: x["label"])).alias("labels")
    rows = folded.join(listed, "text_id").select("text_id", "fold", *names, own)
    found = written(classified_well(out_of_fold_scores(rows, names, permutations + 1, n_folds), ["draw"]), "classified")
    observed = found.where("draw = -1").select(F.col("balanced").alias("balanced_accuracy"), F.col("area").alias("_area"))
    joined = found.where("draw >= 0").crossJoin(F.broadcast(observed))  # one row
    beyond = lambda c, over: ((1 + F.count_if(F.col(c) >= F.col(over) - 1e-12)) / (F.count(F.lit(1)) + 1))
    status = F.when(F.col("permutations") >= 500, "complete").otherwise("pilot")
    return joined.groupBy("balanced_accuracy", F.col("_area").alias("area_")).agg(
        beyond("balanced", "balanced_accuracy").alias("p"), beyond("area", "_area").alias("p_area"), F.count(F.lit(1)).alias("permutations")
    ).select("balanced_accuracy", F.col("area_").alias("area"), "p", "p_area", "permutations", status.alias("status"))
