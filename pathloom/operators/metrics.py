"""Correlations that know when they are undefined, and summaries of residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E

SOURCE = ["text_id", "src_word"]
# The published edges of the diagnostics by stratum and of the audit of halves; the last bin is open.
DIAGNOSTIC_BINS = {
    "probability": [0.0, 0.05, 0.1, 0.25, 0.5],
    "expected": [0.0, 0.5, 1.0, 5.0],
    "exposure": [0.0, 5.0, 10.0, 25.0],
    "risk_size": [0.0, 2.0, 4.0, 8.0],
}
HALF_BINS = {"probability": [0.0, 0.05, 0.1, 0.2, 0.4], "expected": [0.0, 0.5, 1.0, 2.0, 5.0]}


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def _defined(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(_number(c)) & (F.abs(_number(c)) < float("inf"))


def _spread(c: str) -> Column:
    return F.max(c) > F.min(c)


def correlation(
    df: DataFrame,
    keys: list[str],
    x: str = "x",
    y: str = "y",
    weight: str | None = None,
    constant: float | None = None,
) -> DataFrame:
    """(keys, n, r): weighted correlation of each group; NULL, or ``constant``, if it is undefined.

    Rows with a NULL, an infinite value or no positive weight do not count; fewer than two rows or a
    constant side leave it undefined. Without weights one aggregation of centred moments; with them two,
    means first.
    """
    used = df.where(_defined(x) & _defined(y)).select(
        *keys,
        _number(x).alias("_x"),
        _number(y).alias("_y"),
        *([_number(weight).alias("_w")] if weight else []),
    )
    if weight is None:
        moments = [F.covar_pop("_x", "_y").alias("_xy"), F.var_pop("_x").alias("_xx"), F.var_pop("_y").alias("_yy")]
        sums = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _spread("_x").alias("_vx"), _spread("_y").alias("_vy"), *moments)
    else:
        used = used.where("_w > 0")
        mean = lambda c: F.sum(F.col("_w") * F.col(c)) / F.sum("_w")
        means = used.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            mean("_x").alias("_mx"),
            mean("_y").alias("_my"),
            _spread("_x").alias("_vx"),
            _spread("_y").alias("_vy"),
        )
        centred = used.join(means, keys) if keys else used.crossJoin(F.broadcast(means))  # one row
        dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
        moments = [F.sum(F.col("_w") * a * b).alias(name) for name, a, b in (("_xy", dx, dy), ("_xx", dx, dx), ("_yy", dy, dy))]
        sums = centred.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "_vx", "_vy")], *moments)
    r = _ratio(F.col("n"), F.col("_vx") & F.col("_vy"), F.col("_xy"), F.col("_xx"), F.col("_yy"))
    return sums.select(*keys, "n", (r if constant is None else F.coalesce(r, F.lit(constant))).alias("r"))


def _ratio(n: Column, varies: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """A correlation from centred moments of the same scale; NULL where it is undefined."""
    scale = F.sqrt(xx * yy)
    return F.when((n >= 2) & varies & (scale > 0), xy / scale)


def source_equal(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """For each group: r over edges, r with all sources of equal weight, and the Fisher mean over sources.

    ``df`` needs ``src_word``; with NULL where a side is undefined. One aggregation to the centred moments of each
    source, from which all three follow.
    """
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, "src_word", _number(x).alias("_x"), _number(y).alias("_y"))
    sources = used.groupBy(*keys, "src_word").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_x").alias("_mx"),
        F.avg("_y").alias("_my"),
        F.var_pop("_x").alias("_xx"),
        F.var_pop("_y").alias("_yy"),
        F.covar_pop("_x", "_y").alias("_xy"),
        *[f(c).alias(name) for name, f, c in (("_x0", F.min, "_x"), ("_x1", F.max, "_x"), ("_y0", F.min, "_y"), ("_y1", F.max, "_y"))],
    )
    group, n = Window.partitionBy(*keys), F.col("_n")
    for side in "xy":
        edge = F.sum(n * F.col(f"_m{side}")).over(group) / F.sum("_n").over(group)
        sources = sources.withColumn(f"_e{side}", F.col(f"_m{side}") - edge)
        sources = sources.withColumn(f"_s{side}", F.col(f"_m{side}") - F.avg(f"_m{side}").over(group))
    own = _ratio(n, (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0")), F.col("_xy"), F.col("_xx"), F.col("_yy"))
    # A moment of a text is the sources' own one and that of their means about the text's.
    moments = [F.sum(n * (F.col(f"_{a}{b}") + F.col(f"_e{a}") * F.col(f"_e{b}"))).alias(f"_edge_{a}{b}") for a, b in ("xx", "yy", "xy")]
    moments += [F.sum(F.col(f"_{a}{b}") + F.col(f"_s{a}") * F.col(f"_s{b}")).alias(f"_source_{a}{b}") for a, b in ("xx", "yy", "xy")]
    texts = sources.withColumn("_r", own).groupBy(*keys).agg(
        F.sum("_n").alias("n_edges"),
        ((F.max("_x1") > F.min("_x0")) & (F.max("_y1") > F.min("_y0"))).alias("_varies"),
        *moments,
        F.count(F.lit(1)).alias("n_sources"),
        F.count("_r").alias("defined_sources"),
        E.fisher_mean(F.col("_r")).alias("fisher_equal"),
    )
    ratio = lambda kind: _ratio(F.col("n_edges"), F.col("_varies"), *(F.col(f"_{kind}_{m}") for m in ("xy", "xx", "yy")))
    return texts.select(
        *keys,
        "n_edges",
        ratio("edge").alias("edge_weighted"),
        ratio("source").alias("source_weighted"),
        "n_sources",
        "defined_sources",
        "fisher_equal",
    )


METRICS = ("edge_weighted", "source_weighted", "fisher_equal")


def unpivot_metrics(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return df.unpivot(keys, list(metrics), "metric", "value")


def paired_halves(first: DataFrame, second: DataFrame, keys: list[str] | None = None, check: bool = True) -> DataFrame:
    """Cells of both halves that are reliable in both: (keys, text, src, dst, x, y)."""
    on = [*(keys or []), "text_id", "src_word", "dst_word"]
    a = first.select(*on, F.col("residual").alias("x"), F.col("reliable").alias("_a"))
    b = second.select(*on, F.col("residual").alias("y"), F.col("reliable").alias("_b"))
    both = a.join(b, on).where("_a and _b").drop("_a", "_b")
    return both.where("x is not null and y is not null") if check else both


def paired_metrics(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By (keys, metric): texts with and without a value, share of negative ones, median and quartiles over texts."""
    keys = keys or []
    by_text = unpivot_metrics(source_equal(pairs, [*keys, "text_id"]), [*keys, "text_id"])
    v = F.col("value")
    return by_text.groupBy(*keys, "metric").agg(
        F.count(v).alias("valid"),
        F.count_if(v.isNull()).alias("undefined"),
        F.avg(v.isNull().cast("double")).alias("undefined_share"),
        F.avg((v < 0).cast("double")).alias("negative_share"),
        E.quantile(v, 0.5).alias("median"),
        E.quantile(v, 0.25).alias("q25"),
        E.quantile(v, 0.75).alias("q75"),
    )


def identity(cells: DataFrame, spec: str = "spec", defined_texts_only: bool = False) -> DataFrame:
    """For every two specifications: correlation of their residuals by text (median, quartiles) and pooled.

    ``defined_texts_only`` pools the edges of texts with a defined correlation, as the audit of halves does.
    """
    keys = ["text_id", "src_word", "dst_word"]
    a = cells.select(*keys, F.col(spec).alias("spec_a"), F.col("residual").alias("x"))
    b = cells.select(*keys, F.col(spec).alias("spec_b"), F.col("residual").alias("y"))
    met = a.join(b, keys).where("spec_a < spec_b and x is not null and y is not null")
    pair, r = ["spec_a", "spec_b"], F.col("r")
    by_text = correlation(met, [*pair, "text_id"])
    texts = by_text.groupBy(*pair).agg(
        F.count("r").alias("texts"),
        E.quantile(r, 0.5).alias("median"),
        E.quantile(r, 0.25).alias("q25"),
        E.quantile(r, 0.75).alias("q75"),
    )
    pooled = met.join(
        by_text.where("r is not null").select(*pair, "text_id"),
        [*pair, "text_id"],
        "left_semi",
    ) if defined_texts_only else met
    return texts.join(correlation(pooled, pair).select(*pair, F.col("n").alias("n_edges"), r.alias("pooled")), pair)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, quartiles, range, share of negative values; NULLs are left out, and counted."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        *E.distribution(v),
        F.count_if(v.isNull()).alias("undefined"),
        F.avg((v < 0).cast("double")).alias("negative_share"),
    )


def mean_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(*E.mean_summary(F.col(value)))


def residual_types(cells: DataFrame) -> DataFrame:
    """One row for each cell and type of residual."""
    keep = [c for c in cells.columns if c not in ("residual", "deviance", "deviation")]
    return cells.withColumnRenamed("residual", "pearson").withColumnRenamed("deviation", "raw").unpivot(
        keep,
        ["pearson", "deviance", "raw"],
        "kind",
        "value",
    )


def bin_names(edges: list[float]) -> list[str]:
    """Published labels of half-open bins: low-high, and >=low for the last one."""
    return [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:])] + [f">={edges[-1]:g}"]


def stratified(cells: DataFrame, bins: dict[str, list[float]], overall: bool = True) -> DataFrame:
    """``cells`` once for each stratification: by the bins of each column, and ``overall`` as one."""
    parts = [F.struct(F.lit("all").alias("stratification"), F.lit("all").alias("stratum"))] if overall else []
    parts += [
        F.struct(F.lit(c).alias("stratification"), E.within_bins(F.col(c), edges, bin_names(edges)).alias("stratum"))
        for c, edges in bins.items()
    ]
    return cells.select("*", F.explode(F.array(*parts)).alias("_s")).select(
        *cells.columns,
        "_s.stratification",
        "_s.stratum",
    ).where("stratum is not null")


def full_diagnostics(cells: DataFrame, bins: dict[str, list[float]] | None = None) -> DataFrame:
    """Tail summaries of every residual type of reliable cells, overall and in every stratum; empty ones have no row."""
    each = stratified(residual_types(cells.where("reliable")), bins or DIAGNOSTIC_BINS)
    return each.where("value is not null").groupBy("kind", "stratification", "stratum").agg(*E.tail_summary(F.col("value")))


def stratified_rows(cells: DataFrame, bins: dict[str, list[float]] | None = None) -> DataFrame:
    """Variances of residuals and deviations, mean probability and expectation by stratum; empty ones have no row."""
    return stratified(cells.where("reliable"), bins or HALF_BINS, overall=False).groupBy("stratification", "stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop("residual").alias("residual_variance"),
        F.var_pop("deviation").alias("deviation_variance"),
        F.avg("probability").alias("mean_probability"),
        F.avg("expected").alias("mean_expected"),
    )


def residual_summary(cells: DataFrame) -> DataFrame:
    """By category: edges, texts, population variance and seven quantiles of reliable residuals."""
    r = F.col("residual")
    return cells.where("reliable and residual is not null").groupBy("category").agg(
        F.count(r).alias("n"),
        F.count_distinct("text_id").alias("texts"),
        F.var_pop(r).alias("variance"),
        *[E.quantile(r, q).alias(f"q{round(100 * q):02d}") for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)],
    )


def text_residual_audit(cells: DataFrame) -> DataFrame:
    """By text: mean and sample variance of residuals, share beyond 2, mean square, mean exposure."""
    r = F.col("residual")
    return cells.where(r.isNotNull()).groupBy("text_id").agg(
        F.avg(r).alias("mean"),
        F.when(F.count(r) > 1, F.var_samp(r)).alias("variance"),
        F.avg((F.abs(r) > 2).cast("double")).alias("beyond_2"),
        F.avg(r * r).alias("mean_square"),
        F.avg("exposure").alias("mean_exposure"),
    )


def aggregate_rows(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Distribution of a value in each group of result rows, and how many are defined."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *E.distribution(F.col(value)))


def replicate_summary(rows: DataFrame, keys: list[str], control: Column, value: str = "value") -> DataFrame:
    """Observed against destroyed replicates: both distributions, and whether the observed median is above every control."""
    observed, destroyed = F.when(~control, F.col(value)), F.when(control, F.col(value))
    return rows.groupBy(*keys).agg(
        *E.distribution(observed, "observed_"),
        *E.distribution(destroyed, "control_"),
        F.coalesce(E.quantile(observed, 0.5) > F.max(destroyed), F.lit(False)).alias("above_controls"),
    )


def mode_difference(rows: DataFrame, keys: list[str], mode: str, a: str, b: str, value: str = "value") -> DataFrame:
    """Distribution over repeats of value(a) - value(b), joined on (keys, repeat)."""
    side = lambda name, out: rows.where(F.col(mode) == name).select(*keys, "repeat", F.col(value).alias(out))
    met = side(a, "_a").join(side(b, "_b"), [*keys, "repeat"]).withColumn("difference", F.col("_a") - F.col("_b"))
    return distribution(met, keys, "difference")


def coefficient_variability(fits: DataFrame, keys: list[str]) -> DataFrame:
    """By (keys, feature) of fold-wise fits: their sample deviation and range."""
    c = F.col("coefficient")
    return fits.groupBy(*keys, "feature").agg(
        F.count(c).alias("fits"),
        F.stddev_samp(c).alias("sd"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
    )
