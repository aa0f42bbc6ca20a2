"""Column builders. Undefined values are NULL throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- parsing -------------------------------------------------------------------------------------------


def natural_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*?)(\d*)$", 1)


def natural_number(c: Column) -> Column:
    """Trailing integer of a name, by which names sort within a prefix; NULL without one."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint")


def text_order(c: Column) -> list[Column]:
    return [natural_prefix(c), natural_number(c)]


def positive_integer(c: Column) -> Column:
    """The whole part of a number given as text, if it is 1 or more."""
    n = c.try_cast("double")
    return F.when(n >= 1, F.floor(n).cast("bigint"))


def clean_length(c: Column) -> Column:
    """Number of letters, digits and apostrophes of a word, 1 at least."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(c, r"[^A-Za-z0-9']", ""))).cast("bigint")


def ends_sentence(c: Column) -> Column:
    return F.rtrim(c).rlike(r"""[.!?]["')\]]*$""")


def smoothed_logit(share: Column, count: Column) -> Column:
    """Log-odds of a share of ``count`` answers, with half an answer added to either side; 0 where undefined."""
    p = (share * count + 0.5) / (count + 1)
    return F.when(count.isNotNull() & (count > 0) & share.between(0, 1), F.ln(p / (1 - p))).otherwise(F.lit(0.0))


def zipf(count: Column, total: Column) -> Column:
    """Frequency per billion words, in powers of ten."""
    return F.log10(F.lit(1e9) * count / total)


# -- transitions ---------------------------------------------------------------------------------------
EVENT_TYPES = ("refixation", "forward", "regression", "line_return")


def event_type(src: Column, dst: Column, src_line: Column | None = None, dst_line: Column | None = None) -> Column:
    """Type of a move: the same word, down to a later line, onward or back. Moves to earlier lines go by word order."""
    kind = F.when(src == dst, "refixation")
    if src_line is not None and dst_line is not None:
        kind = kind.when(F.coalesce(dst_line > src_line, F.lit(False)), "line_return")
    return kind.when(dst > src, "forward").otherwise("regression")


# -- pair classes --------------------------------------------------------------------------------------


def separation(src: Column, dst: Column) -> Column:
    d = dst - src
    return F.when(
        d < 1,
        F.raise_error(F.lit("separation needs a later destination")),
    ).when(d == 1, "adjacent").when(d <= 3, "near_skip").otherwise("far_same_line")


def within_bins(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the half-open bin [low, high) that holds a value; the last one is open above."""
    out = None
    for low, high, name in zip(edges, [*edges[1:], None], names):
        hit = value >= low if high is None else (value >= low) & (value < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def closed_strata(value: Column, strata: list[tuple[int, int | None]]) -> Column:
    """Name of the closed stratum low-high that holds a count."""
    out = None
    for low, high in strata:
        hit = value >= low if high is None else value.between(low, high)
        name = f"{low}+" if high is None else f"{low}-{high}"
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# -- residuals -----------------------------------------------------------------------------------------
MIN_PROBABILITY = 1e-300


def pearson(count: Column, expected: Column, probability: Column, candidates: Column) -> Column:
    variance = expected * (1 - probability)
    return F.when((candidates >= 2) & (variance > 0), (count - expected) / F.sqrt(variance))


def deviance(count: Column, expected: Column) -> Column:
    """Signed square root of a cell's deviance; undefined where nothing is expected of a positive count."""
    part = F.when(count > 0, F.when(expected > 0, count * F.ln(count / expected))).otherwise(F.lit(0.0))
    size = F.sqrt(F.greatest(F.lit(0.0), 2 * (part - (count - expected))))
    return F.when((expected <= 0) & (count > 0), None).otherwise(F.signum(count - expected) * size)


# -- summaries -----------------------------------------------------------------------------------------
#: Correlations are held within this of 1 before they are made Fisher's z.
FISHER_MARGIN = 1e-7


def clamped(c: Column, low: float, high: float) -> Column:
    """A value within bounds; NULL stays NULL, which ``greatest`` and ``least`` alone would pass over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def fisher(r: Column) -> Column:
    return F.atanh(clamped(r, FISHER_MARGIN - 1, 1 - FISHER_MARGIN))


def fisher_mean(r: Column) -> Column:
    return F.tanh(F.avg(fisher(r)))


def quantile(c: Column, q: float) -> Column:
    """Interpolated quantile; NULLs do not count."""
    return F.percentile(c, F.lit(q))


def distribution(c: Column, prefix: str = "") -> list[Column]:
    return [
        F.count(c).alias(f"{prefix}n"),
        quantile(c, 0.5).alias(f"{prefix}median"),
        quantile(c, 0.25).alias(f"{prefix}q25"),
        quantile(c, 0.75).alias(f"{prefix}q75"),
        F.min(c).alias(f"{prefix}minimum"),
        F.max(c).alias(f"{prefix}maximum"),
    ]


def mean_summary(c: Column) -> list[Column]:
    """Mean, sample deviation (0 for one value), quartiles and range."""
    return [
        F.avg(c).alias("mean"),
        F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, F.lit(0.0)).alias("sd"),
        quantile(c, 0.5).alias("median"),
        quantile(c, 0.25).alias("q25"),
        quantile(c, 0.75).alias("q75"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
    ]


TAIL_QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def tail_summary(c: Column) -> list[Column]:
    """Count, mean, population deviation, nine quantiles and the shares beyond 2 and 3."""
    share = lambda bound: F.avg((F.abs(c) > bound).cast("double"))
    return [
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("sd"),
        *[quantile(c, q).alias(f"q{round(100 * q):02d}") for q in TAIL_QUANTILES],
        share(2).alias("beyond_2"),
        share(3).alias("beyond_3"),
    ]


def spearman_brown(r: Column) -> Column:
    """Reliability of twice the length, within -1 and 1; undefined where r is."""
    return F.when(r == -1, F.lit(-1.0)).otherwise(clamped(2 * r / (1 + r), -1.0, 1.0))


def attenuation_ceiling(r: Column) -> Column:
    return F.sqrt(clamped(r, 0.0, float("inf")))


def smooth_absolute(d: Column) -> Column:
    """Huber loss of width 1."""
    return F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)
