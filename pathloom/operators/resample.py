"""Split-half reliability, controls and bootstraps over draws of subjects and texts.

Draws are tables with multiplicities that are joined, so no row is ever repeated. ``draws`` makes them of any size; the
lists here follow the generator of the published seeds, for studies of a few subjects.
"""

from __future__ import annotations

import random
from collections import Counter
from heapq import nsmallest
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.operators import draws, metrics

DRAWS = "draw int, half int, subject_id string, mult int"
MIN_SUBJECTS = 4
#: Subjects of all draws together that the driver may list.
MOST_DRAWN = 1_000_000


def subject_splits(subjects: list[str], repeats: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """Halves of the sorted subjects, the first of half the size rounded down.

    The order of calls to the generator is that of the published seeds.
    """
    ids, rng = sorted(subjects), np.random.default_rng(seed)
    out = []
    for _ in range(repeats):
        order = rng.permutation(len(ids))
        half = len(ids) // 2
        out.append((sorted(ids[i] for i in order[:half]), sorted(ids[i] for i in order[half:])))
    return out


def four_subject_partitions(subjects: list[str]) -> list[tuple[list[str], list[str]]]:
    """The three ways to part four subjects into two pairs."""
    if len(subjects) != 4:
        raise ValueError("exactly four subjects are needed")
    a, *others = sorted(subjects)
    return [([a, b], [x for x in others if x != b]) for b in others]


def anchored_partitions(subjects: list[str]) -> list[tuple[list[str], list[str]]]:
    """All partitions into equal halves, each once: the first subject stays in the first half."""
    a, *others = sorted(subjects)
    return [([a, *rest], [x for x in others if x not in rest]) for rest in combinations(others, len(subjects) // 2 - 1)]


def reader_bootstrap(subjects: list[str], repeats: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """Subjects drawn with replacement and split by position; one subject may be in both halves, several times."""
    ids, rng = sorted(subjects), np.random.default_rng(seed)
    out = []
    for _ in range(repeats):
        drawn = rng.permutation(rng.integers(0, len(ids), len(ids)))
        half = len(ids) // 2
        out.append(([ids[i] for i in drawn[:half]], [ids[i] for i in drawn[half:]]))
    return out


def reader_resamples(subjects: list[str], repeats: int, seed: int) -> list[list[str]]:
    """As many subjects as there are, drawn with replacement."""
    ids, rng = sorted(subjects), np.random.default_rng(seed)
    return [[ids[i] for i in rng.integers(len(ids), size=len(ids))] for _ in range(repeats)]


def balanced_subsets(subjects: list[str], k: int, repeats: int, seed: int) -> list[list[str]]:
    """Subsets of k subjects in which uses differ by one at most; who is due is left to chance.

    A round draws one number for each subject, in their order (as the published seeds have it), and takes the k
    subjects with the fewest uses and the smallest numbers.
    """
    ids, rng, uses = sorted(set(subjects)), random.Random(seed), Counter()
    if not 0 < k <= len(ids):
        raise ValueError(f"{k} of {len(ids)} subjects")

    def one_round() -> list[str]:
        due = [(uses[s], rng.random(), s) for s in ids]
        chosen = sorted(s for *_, s in nsmallest(k, due))
        uses.update(chosen)
        return chosen

    return [one_round() for _ in range(repeats)]


def draws_table(spark: SparkSession, splits: list[tuple[list[str], list[str]]]) -> DataFrame:
    """(draw, half, subject_id, mult) of a list of halves, for the published seeds; larger ones are made by ``draws``."""
    if sum(len(half) for halves in splits for half in halves) > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} subjects drawn on the driver")
    rows = []
    for d, halves in enumerate(splits):
        for h, members in enumerate(halves):
            counts: dict[str, int] = {}
            for s in members:
                counts[s] = counts.get(s, 0) + 1
            rows += [(d, h, s, m) for s, m in counts.items()]
    return spark.createDataFrame(rows, DRAWS)


# -- split-half reliability ---------------------------------------------------------------------------------


def split_half(edges: DataFrame, draws: DataFrame, sizes: DataFrame, correct: bool = False, min_subjects: int = MIN_SUBJECTS) -> DataFrame:
    """(text_id, draws, valid, median, half_0, half_1): reliability of row-normalised matrices over draws.

    ``edges`` are one event type's (subject, text, src, dst, count); ``draws`` may have a text_id column, then
    each text has draws of its own. A source counts if both halves have events from it; then all its W
    destinations do, zeros included - those are added to the sums by their number, no grid is made. Texts
    with fewer than ``min_subjects`` subjects (of any event type, from the draws) are undefined.
    """
    own = ["subject_id", "text_id"] if "text_id" in draws.columns else ["subject_id"]
    halves = edges.join(draws, own).groupBy("text_id", "draw", "half", "src_word", "dst_word").agg(
        F.sum(F.col("count") * F.col("mult")).alias("count")
    )
    row = Window.partitionBy("text_id", "draw", "half", "src_word")
    normal = halves.withColumn("_total", F.sum("count").over(row)).where("_total > 0").select(
        "text_id",
        "draw",
        "half",
        "src_word",
        "dst_word",
        (F.col("count") / F.col("_total")).alias("p"),
    )
    cells = normal.groupBy("text_id", "draw", "src_word", "dst_word").agg(
        F.sum(F.when(F.col("half") == 0, F.col("p"))).alias("x"),
        F.sum(F.when(F.col("half") == 1, F.col("p"))).alias("y"),
    )
    source = Window.partitionBy("text_id", "draw", "src_word")
    common = cells.where(F.col("x").isNotNull() | F.col("y").isNotNull()).withColumn(
        "_both",
        (F.count("x").over(source) > 0) & (F.count("y").over(source) > 0),
    ).where("_both")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    sums = common.groupBy("text_id", "draw").agg(
        F.count_distinct("src_word").alias("sources"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"),
    )
    n = F.col("sources") * F.col("n_words")
    vx, vy, c = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2, n * F.col("sxy") - F.col("sx") * F.col("sy")
    tiny = 1e-12 * n * n
    r = F.when((n >= 2) & (vx > tiny) & (vy > tiny), c / F.sqrt(vx * vy))
    r = E.clamped(r, -1.0, 1.0)
    by_draw = sums.join(sizes, "text_id").select("text_id", "draw", (E.spearman_brown(r) if correct else r).alias("r"))
    per_text = draws.groupBy(*[c for c in own if c == "text_id"], "draw").agg(
        F.sum(F.when(F.col("half") == 0, F.col("mult"))).alias("half_0"),
        F.sum(F.when(F.col("half") == 1, F.col("mult"))).alias("half_1"),
    )
    if "text_id" not in own:
        per_text = per_text.crossJoin(edges.select("text_id").distinct())  # texts are few
    full = per_text.join(by_draw, ["text_id", "draw"], "left")
    enough = F.col("half_0") + F.col("half_1") >= min_subjects
    return full.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("draws"),
        F.count(F.when(enough, F.col("r"))).alias("valid"),
        E.quantile(F.when(enough, F.col("r")), 0.5).alias("median"),
        E.quantile(F.col("half_0"), 0.5).alias("half_0"),
        E.quantile(F.col("half_1"), 0.5).alias("half_1"),
    )


# -- controls -------------------------------------------------------------------------------------------------


def permute_destinations(cells: DataFrame, keys: list[str], value: str, seed: int) -> DataFrame:
    """``cells`` with ``value`` shuffled among the destinations of each source, by a seeded hash that SQL engines share."""
    group = Window.partitionBy(*keys, "text_id", "src_word")
    on = [*keys, "text_id", "src_word", "_rank"]
    chance = F.md5(F.concat_ws(":", F.lit(seed), *keys, "text_id", "src_word", "dst_word"))
    ranked = cells.withColumn("_rank", F.row_number().over(group.orderBy("dst_word")))
    drawn = cells.select(
        *keys,
        "text_id",
        "src_word",
        F.col(value).alias("_new"),
        F.row_number().over(group.orderBy(chance, "dst_word")).alias("_rank"),
    )
    return ranked.join(drawn, on).withColumn(value, F.col("_new")).select(*cells.columns)


def thin_categories(edges: DataFrame, seed: int, reference: str = "far_same_line") -> DataFrame:
    """Each subject's counts, thinned so that no category is expected to outweigh ``reference``.

    ``edges`` has subject_id, category and whole counts; the chance to keep an event is the reference's mass
    over the category's, 1 at most and 0 where the reference is empty. Every event has a draw of its own, so counts are
    binomial; an edge has one row.
    """
    mass = edges.groupBy("subject_id", "category").agg(F.sum("count").alias("_mass"))
    far = mass.where(F.col("category") == reference).select("subject_id", F.col("_mass").alias("_far"))
    chance = mass.join(far, "subject_id", "left").select(
        "subject_id",
        "category",
        F.when(F.col("category") == reference, F.lit(1.0)).when(
            F.col("_mass") > 0,
            F.least(F.lit(1.0), F.coalesce("_far", F.lit(0.0)) / F.col("_mass")),
        ).otherwise(F.lit(0.0)).alias("keep"),
    )
    copies = F.explode(F.expr("sequence(1, cast(round(count) as int))"))
    key = [F.col(c) for c in ("subject_id", "text_id", "src_word", "dst_word")]
    kept = edges.where("round(count) >= 1").withColumn("_copy", copies).join(chance, ["subject_id", "category"]).groupBy(
        "subject_id", "category", "text_id", "src_word", "dst_word"
    ).agg(F.count_if(draws.uniform("thin", seed, *key, F.col("_copy")) < F.col("keep") * draws.RANGE).cast("double").alias("_kept"))
    joined = edges.join(kept, ["subject_id", "category", "text_id", "src_word", "dst_word"], "left")
    return joined.withColumn("count", F.coalesce("_kept", F.lit(0.0))).select(*edges.columns)


def keep_probabilities(edges: DataFrame, reference: str = "far_same_line") -> DataFrame:
    """(subject_id, category, keep): what ``thin_categories`` draws with."""
    mass = edges.groupBy("subject_id", "category").agg(F.sum("count").alias("mass"))
    far = mass.where(F.col("category") == reference).select("subject_id", F.col("mass").alias("_far"))
    keep = F.when(F.col("category") == reference, F.lit(1.0)).when(
        F.col("mass") > 0,
        F.least(F.lit(1.0), F.coalesce("_far", F.lit(0.0)) / F.col("mass")),
    ).otherwise(F.lit(0.0))
    return mass.join(far, "subject_id", "left").select("subject_id", "category", "mass", keep.alias("keep"))


def eligibility(first: DataFrame, second: DataFrame, thresholds: list[int]) -> DataFrame:
    """Paired metrics under several exposure thresholds, from the same fits."""
    spark = first.sparkSession
    limits = spark.createDataFrame([(t,) for t in thresholds], "threshold int")
    cut = lambda df: df.crossJoin(limits).withColumn(  # noqa: E731  a handful of thresholds
        "reliable",
        (F.col("exposure") >= F.col("threshold")) & F.col("residual").isNotNull(),
    )
    return metrics.paired_metrics(metrics.paired_halves(cut(first), cut(second), ["threshold"]), ["threshold"])


# -- bootstraps -----------------------------------------------------------------------------------------------


def portable_draws(spark: SparkSession, resamples: int, n: int) -> DataFrame:
    """(draw, pos, pick): draws by a linear congruence that any SQL engine can repeat."""
    grid = spark.range(resamples * n).select((F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("pos"))
    return grid.withColumn("pick", F.pmod((F.col("draw") * 997 + F.col("pos")) * 48271 + 11, F.lit(2147483647)) % n)


def drawn_means(df: DataFrame, draws: DataFrame, index: str, value: str) -> DataFrame:
    """(draw, mean) of a value under draws (draw, pick) of its row numbers."""
    return draws.join(df.select(F.col(index).alias("pick"), value), "pick").groupBy("draw").agg(F.avg(value).alias("mean"))


def manifest(texts: list[str], seed: int, sizes: tuple[int, int, int] = (35, 10, 10)) -> dict[str, list[str]]:
    """Texts split into train, validation and test by a seeded shuffle of their numeric order, as the published seed has it."""
    ids = sorted(set(texts), key=lambda t: int(str(t).split(":")[-1]))
    if len(ids) != sum(sizes):
        raise ValueError(f"{sum(sizes)} texts are needed")
    random.Random(seed).shuffle(ids)
    a, b = sizes[0], sizes[0] + sizes[1]
    return {"train": ids[:a], "validation": ids[a:b], "test": ids[b:]}
