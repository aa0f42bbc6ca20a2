"""Scores from vectors: pooling, heads, divergences and losses."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E


def word_pool(states: DataFrame, reduce: str = "mean", n_words: DataFrame | None = None) -> DataFrame:
    """(text_id, word_index, n_tokens, state): token vectors of each word, averaged or summed; negative words are special tokens.

    With ``n_words`` (text_id, n_words) all words of a text have a row, a zero vector where a word has no token, and
    ``valid``: whether it has one; a word beyond them raises.
    """
    if reduce not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduce!r}")
    parts = states.where("word_index >= 0").select("text_id", "word_index", F.posexplode("state").alias("dim", "v"))
    pooled = parts.groupBy("text_id", "word_index", "dim").agg(
        (F.avg if reduce == "mean" else F.sum)(F.col("v").cast("double")).alias("v"),
        F.count(F.lit(1)).alias("n"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"])
    words = pooled.groupBy("text_id", "word_index").agg(F.max("n").alias("n_tokens"), ordered.alias("state"))
    if n_words is None:
        return words
    width = words.agg(F.max(F.size("state")).alias("_width"))  # one row
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_words").cast("bigint") - 1)).alias("word_index")
    slots = n_words.where("n_words > 0").select("text_id", every).withColumn("_slot", F.lit(True))
    full = slots.join(words.withColumn("word_index", F.col("word_index").cast("bigint")), ["text_id", "word_index"], "full")
    full = full.crossJoin(F.broadcast(width))
    state = F.when(F.col("_slot").isNull(), F.raise_error(F.lit("n_words is smaller than an observed word")).cast("array<double>"))
    state = state.otherwise(F.coalesce("state", F.array_repeat(F.lit(0.0), F.coalesce("_width", F.lit(0)))))
    return full.select(
        "text_id",
        "word_index",
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        state.alias("state"),
        F.col("n_tokens").isNotNull().alias("valid"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def project(a: Column, weights: np.ndarray) -> Column:
    """Product of a small constant matrix (rows x dim) with a vector column."""
    return F.array(*[dot(F.array(*[F.lit(float(w)) for w in row]), a) for row in weights])


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def low_rank_score(a: Column, b: Column, source: np.ndarray, target: np.ndarray, bias: float = 0.0) -> Column:
    """(S a) . (T b) / sqrt(rank) + bias."""
    projected = once(a, lambda x: project(x, source)), once(b, lambda x: project(x, target))
    return dot(*projected) / float(np.sqrt(len(source))) + F.lit(float(bias))


def bilinear_score(a: Column, b: Column, weights: np.ndarray, bias: float = 0.0) -> Column:
    """a' W b / sqrt(dim) + bias."""
    return dot(a, project(b, weights)) / float(np.sqrt(weights.shape[0])) + F.lit(float(bias))


def error_function(x: Column, terms: int = 90) -> Column:
    """erf(x) to rounding: 2/sqrt(pi) exp(-x^2) times the sum of 2^n x^(2n+1) / (2n+1)!!, whose terms all have the sign of x; 1 beyond 6."""

    def step(state: Column, n: Column) -> Column:
        term = state["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step)["sum"]
    return F.when(F.abs(x) > 6, F.signum(x)).otherwise(F.lit(float(2 / np.sqrt(np.pi))) * F.exp(-x * x) * total)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + error_function(x * float(np.sqrt(0.5))))


def bottleneck(
    a: Column,
    down: np.ndarray,
    up: np.ndarray,
    down_bias: np.ndarray | None = None,
    up_bias: np.ndarray | None = None,
) -> Column:
    """a + U gelu(D a + d) + u, with the exact unit."""

    def shifted(v: Column, bias: np.ndarray | None) -> Column:
        return v if bias is None else F.zip_with(v, F.array(*[F.lit(float(b)) for b in bias]), lambda x, y: x + y)

    inner = F.transform(shifted(project(a, down), down_bias), gelu)
    return once(inner, lambda h: F.zip_with(a, shifted(project(h, up), up_bias), lambda x, y: x + y))


def pair_scores(cells: DataFrame, vectors: DataFrame, score) -> DataFrame:
    """``cells`` with ``score`` from both words' vectors (text_id, word_index, state)."""
    at = lambda end: vectors.select("text_id", F.col("word_index").alias(f"{end}_word"), F.col("state").alias(f"_{end}"))
    return cells.join(at("src"), ["text_id", "src_word"]).join(at("dst"), ["text_id", "dst_word"]).withColumn(
        "score",
        score(F.col("_src"), F.col("_dst")),
    ).drop("_src", "_dst")


def masked_softmax(df: DataFrame, keys: list[str], logit: str = "logit", mask: str = "mask") -> DataFrame:
    """``df`` with ``probability`` over the unmasked entries of each row; rows without any are all 0."""
    group = Window.partitionBy(*keys)
    shown = F.when(F.col(mask), F.col(logit))
    e = F.when(F.col(mask), F.exp(shown - F.max(shown).over(group))).otherwise(F.lit(0.0))
    out = df.withColumn("_e", e).withColumn("_z", F.sum("_e").over(group))
    return out.withColumn("probability", F.when(F.col("_z") > 0, F.col("_e") / F.col("_z")).otherwise(F.lit(0.0))).drop("_e", "_z")


def masked_jsd(df: DataFrame, keys: list[str], p: str = "p", q: str = "q", mask: str = "mask") -> DataFrame:
    """(keys, jsd, valid): Jensen-Shannon divergence of each row's unmasked, renormalised parts; 0 for rows where one is empty."""
    group = Window.partitionBy(*keys)
    shown = lambda c: F.when(F.col(mask), F.greatest(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0))
    parts = df.withColumn("_p", shown(p)).withColumn("_q", shown(q)).withColumn("_sp", F.sum("_p").over(group)).withColumn("_sq", F.sum("_q").over(group))
    a, b = F.when(
        F.col("_sp") > 0,
        F.col("_p") / F.col("_sp"),
    ).otherwise(F.lit(0.0)), F.when(F.col("_sq") > 0, F.col("_q") / F.col("_sq")).otherwise(F.lit(0.0))
    term = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    middle = (F.col("_a") + F.col("_b")) / 2
    valid = (F.min("_sp") > 0) & (F.min("_sq") > 0)
    sums = parts.withColumn("_a", a).withColumn("_b", b).groupBy(*keys).agg(
        F.sum(0.5 * (term(F.col("_a"), middle) + term(F.col("_b"), middle))).alias("jsd"),
        valid.alias("valid"),
    )
    return sums.withColumn("jsd", F.when(F.col("valid"), F.col("jsd")).otherwise(F.lit(0.0)))


def reduce_rows(rows: DataFrame, value: str, reduction: str) -> DataFrame:
    """Mean over valid rows, or sum."""
    return rows.agg((F.avg(F.when(F.col("valid"), F.col(value))) if reduction == "mean" else F.sum(value)).alias(value))


def source_balanced_loss(cells: DataFrame, keys: list[str], difference: str = "difference") -> DataFrame:
    """(keys, loss): smooth absolute loss, averaged within each source and then over sources."""
    per = cells.groupBy(*keys, "src_word").agg(F.avg(E.smooth_absolute(F.col(difference))).alias("_l"))
    return per.groupBy(*keys).agg(F.avg("_l").alias("loss"))


def whole_word_mask(n_words: int, rate: float, seed: int) -> list[bool]:
    """Each word masked with chance ``rate``; at least one is."""
    rng = random.Random(seed)
    mask = [rng.random() < rate for _ in range(n_words)]
    if n_words and not any(mask):
        mask[rng.randrange(n_words)] = True
    return mask


def complementary_masks(n_words: int, variants: int, seed: int) -> list[list[bool]]:
    """A partition of the words into masks: each word is masked in exactly one variant."""
    order = list(range(n_words))
    random.Random(seed).shuffle(order)
    owner = {w: i % variants for i, w in enumerate(order)}
    return [[owner[w] == v for w in range(n_words)] for v in range(variants)]


def checkpoint_mismatches(checkpoints: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(path, field, value, expected) of metadata that differ from what is required."""
    fields = checkpoints.unpivot(["path"], list(expected), "field", "value")
    wanted = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    return fields.withColumn("expected", F.element_at(wanted, F.col("field"))).where(~F.col("value").eqNullSafe(F.col("expected")))
