"""Word enrichment and candidate (source, destination) pairs with their features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.operators import trees

#: Tasks whose triangles meet in one step.
FAN_IN = 64
# Feature names, in the order of a design's columns.
DIRECTED = (
    "forward",
    "log1p_abs_distance",
    "forward_x_log_distance",
    "adjacent",
    "source_log_length",
    "target_log_length",
    "source_cloze_logit",
    "target_cloze_logit",
    "source_cloze_missing",
    "target_cloze_missing",
    "source_terminal_punctuation",
    "target_terminal_punctuation",
    "same_sentence",
    "cross_sentence_direction",
    "source_zipf_frequency",
    "target_zipf_frequency",
    "source_frequency_oov",
    "target_frequency_oov",
    "src_head_of_dst",
    "dst_head_of_src",
    "dependency_tree_distance",
    "dependency_missing",
)
COMMON_CORE = (
    "log1p_abs_distance",
    "adjacent",
    "target_log_length",
    "target_zipf_frequency",
    "target_frequency_oov",
    "target_terminal_punctuation",
    "src_head_of_dst",
    "dst_head_of_src",
    "dependency_tree_distance",
    "target_relative_position",
    "target_first2",
    "target_last2",
)
POSITION = ("log1p_abs_distance", "adjacent", "target_relative_position", "target_first2", "target_last2")
CUBIC = ("log1p_abs_distance_squared", "log1p_abs_distance_cubed", "distance_x_target_relative_position")
DIRECTED_SETS = {"basic": DIRECTED[:4], "lexical": DIRECTED[:18], "syntax": DIRECTED, "common_core": COMMON_CORE}
STRICT_SETS = {
    "position_only": POSITION,
    "lexical": POSITION + ("target_log_length", "target_zipf_frequency", "target_frequency_oov", "target_terminal_punctuation"),
    "syntax": COMMON_CORE,
    "flexible": COMMON_CORE + CUBIC,
}
RISK_SETS = ("all", "forward_same_sentence", "forward_same_line")


def feature_names(feature_set: str, risk_set: str) -> tuple[str, ...]:
    """Names of a feature set; the strict-line risk set has its own sets, some under the same names."""
    sets = STRICT_SETS | {"common_core": COMMON_CORE} if risk_set == "forward_same_line" else DIRECTED_SETS
    if feature_set not in sets:
        raise ValueError(f"feature set {feature_set!r} is not defined for risk set {risk_set!r}")
    return sets[feature_set]


def with_frequencies(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``words`` with zipf_frequency and frequency_oov from (surface, zipf); unknown words have 0 and are OOV."""
    found = words.join(lexicon.select("surface", "zipf"), "surface", "left")
    bad = F.col("zipf").isNotNull() & (F.isnan("zipf") | (F.abs("zipf") == float("inf")))
    value = F.when(bad, F.raise_error(F.lit("frequencies must be finite"))).otherwise(F.coalesce("zipf", F.lit(0.0)))
    return found.withColumn("zipf_frequency", value).withColumn("frequency_oov", F.col("zipf_frequency") <= 0).drop("zipf")


def corpus_lexicon(tokens: DataFrame, surface: str = "surface") -> DataFrame:
    """(surface, zipf) of a corpus's own frequencies."""
    counted = tokens.groupBy(surface).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(
        F.col(surface).alias("surface"),
        E.zipf(F.col("n"), F.col("total")).alias("zipf"),
    )  # one row


def word_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per white-space token: length, terminal punctuation and sentence number (from 1)."""
    tokens = documents.select(
        F.col(id_col).alias("text_id"),
        F.posexplode(F.split(F.trim(F.regexp_replace(text_col, r"\s+", " ")), " ")).alias("word_index", "surface"),
    ).where("surface <> ''")
    before = Window.partitionBy("text_id").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)
    ends = E.ends_sentence(F.col("surface"))
    return tokens.select(
        "text_id",
        F.col("word_index").cast("bigint").alias("word_index"),
        "surface",
        E.clean_length(F.col("surface")).alias("length"),
        ends.alias("terminal_punctuation"),
        (1 + F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0))).cast("bigint").alias("sentence_number"),
    )


def fill_sentences(words: DataFrame) -> DataFrame:
    """Missing sentence numbers: the previous word's own number if that word has one and ends no sentence, else the
    next number there is, else the previous word's; raises if there is none. Filled values do not chain."""
    order = Window.partitionBy("text_id").orderBy("word_index")
    previous, ended = F.lag("sentence_number").over(order), F.lag("terminal_punctuation").over(order)
    later = F.first("sentence_number", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    filled = F.coalesce(
        F.col("sentence_number"),
        F.when(previous.isNotNull() & ~F.coalesce(ended, F.lit(False)), previous),
        later,
        previous,
    )
    return words.withColumn("_filled", filled).withColumn(
        "sentence_number",
        F.coalesce("_filled", F.raise_error(F.lit("no sentence number to take over"))),
    ).drop("_filled")


def nearest_area(candidates: DataFrame) -> DataFrame:
    """Of the areas (text_id, word_index, ia_id, ...) of a word the one nearest to its number; ties raise."""
    distance = F.abs(F.col("ia_id") - (F.col("word_index") + 1))
    each = Window.partitionBy("text_id", "word_index")
    ranked = candidates.distinct().withColumn("_rank", F.rank().over(each.orderBy(distance)))
    tied = F.count(F.lit(1)).over(each)
    best = ranked.where("_rank = 1").withColumn("_tied", tied)
    return best.withColumn(
        "ia_id",
        F.when(F.col("_tied") > 1, F.raise_error(F.lit("several nearest areas"))).otherwise(F.col("ia_id")),
    ).drop("_rank", "_tied")


def word_properties(records: DataFrame) -> DataFrame:
    """From (text_id, word_index, surface, length, match_share, responses, sentence_number): parsed word metadata.

    Lengths fall back on the cleaned surface; the log-odds of the match share are smoothed, and 0 with a
    flag where they are undefined.
    """
    share, count = F.col("match_share").try_cast("double"), F.col("responses").try_cast("double")
    missing = share.isNull() | count.isNull() | (count <= 0) | ~share.between(0, 1)
    length = F.coalesce(E.positive_integer(F.col("length")), E.clean_length(F.col("surface")))
    return records.select(
        "text_id",
        "word_index",
        "surface",
        F.ln(length).alias("log_length"),
        F.when(missing, F.lit(0.0)).otherwise(E.smoothed_logit(share, count)).alias("cloze_logit"),
        F.coalesce(missing, F.lit(True)).alias("cloze_missing"),
        E.ends_sentence(F.col("surface")).alias("terminal_punctuation"),
        E.positive_integer(F.col("sentence_number")).alias("sentence_number"),
    )


def build_pairs(words: DataFrame, risk_set: str = "all", feature_set: str = "syntax") -> DataFrame:
    """Candidate pairs of a text with their features as DOUBLE columns.

    ``all``: any other word; ``forward_same_sentence``: later words of the sentence; ``forward_same_line``:
    those of the same line, too. What a word needs (its place in the sentence, its label in the tree) is computed on words,
    before the equi-join; the join's keys are those of the risk set. Sources without candidates have no rows.
    """
    if risk_set not in RISK_SETS:
        raise ValueError(f"unknown risk set {risk_set!r}")
    names = feature_names(feature_set, risk_set)
    need = {"zipf_frequency": "zipf_frequency", "head_word_index": "dependency", "line_id": "line"}
    asked = " ".join(names)
    for column, part in need.items():
        if column not in words.columns and (part in asked or column == "line_id" and risk_set == "forward_same_line"):
            raise ValueError(f"{feature_set!r} in {risk_set!r} needs the column {column}")
    place = Window.partitionBy("text_id", "sentence_number")
    ready = trees.with_tree_labels(words) if "head_word_index" in words.columns else words
    ready = ready.withColumn(
        "ordinal",
        F.row_number().over(place.orderBy("word_index")) - 1,
    ).withColumn("sentence_words", F.count(F.lit(1)).over(place))
    prefixed = lambda p: ready.select("text_id", *[F.col(c).alias(f"{p}_{c}") for c in ready.columns if c != "text_id"])
    s, d = prefixed("s"), prefixed("d")
    on = [s["text_id"] == d["text_id"]]
    if risk_set == "all":
        on.append(F.col("s_word_index") != F.col("d_word_index"))
    else:
        on += [F.col("s_sentence_number") == F.col("d_sentence_number"), F.col("s_word_index") < F.col("d_word_index")]
    if risk_set == "forward_same_line":
        on += [F.col("s_line_id") == F.col("d_line_id"), F.col("s_line_id") >= 0]
    pairs = s.join(d, on).drop(d["text_id"])
    return pairs.select(
        "text_id",
        F.col("s_word_index").alias("src_word"),
        F.col("d_word_index").alias("dst_word"),
        *[feature(n).cast("double").alias(n) for n in names],
    )


def feature(name: str) -> Column:
    """A feature from the columns of both words (s_*, d_*)."""
    c = F.col
    distance = c("d_word_index") - c("s_word_index")
    logged = F.ln(1 + F.abs(distance))
    forward = (distance > 0).cast("double")
    same = c("s_sentence_number") == c("d_sentence_number")
    relative = c("d_ordinal") / F.greatest(F.lit(1), c("d_sentence_words") - 1)
    if name.startswith(("source_", "target_")):
        side, rest = ("s", name[7:]) if name.startswith("source_") else ("d", name[7:])
        if rest == "relative_position":
            return relative
        if rest == "first2":
            return c("d_ordinal") < 2
        if rest == "last2":
            return c("d_ordinal") >= c("d_sentence_words") - 2
        return c(f"{side}_{rest}")
    if name.startswith("dependency_"):
        missing = ~same | c("s_syntax_missing") | c("d_syntax_missing")
        if name == "dependency_missing":
            return missing
        return F.when(missing, F.lit(0)).otherwise(trees.tree_distance(c("s_depth"), c("s_chains"), c("d_depth"), c("d_chains")))
    return {
        "forward": lambda: forward,
        "log1p_abs_distance": lambda: logged,
        "forward_x_log_distance": lambda: forward * logged,
        "adjacent": lambda: F.abs(distance) == 1,
        "same_sentence": lambda: same,
        "cross_sentence_direction": lambda: F.signum(c("d_sentence_number") - c("s_sentence_number")),
        "src_head_of_dst": lambda: F.coalesce(c("d_head_word_index") == c("s_word_index"), F.lit(False)),
        "dst_head_of_src": lambda: F.coalesce(c("s_head_word_index") == c("d_word_index"), F.lit(False)),
        "log1p_abs_distance_squared": lambda: logged * logged,
        "log1p_abs_distance_cubed": lambda: logged * logged * logged,
        "distance_x_target_relative_position": lambda: logged * relative,
    }[name]()


def group_constants(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, constant): whether a feature is the same within every source, and so cannot be told from it."""
    spread = pairs.groupBy("text_id", "src_word").agg(
        *[(F.max(n) - F.min(n)).alias(n) for n in names]
    ).agg(*[(F.max(n) == 0).alias(n) for n in names])
    return spread.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("constant")) for n in names])).alias("x")
    ).select("x.*")


def design_rank(pairs: DataFrame, names: tuple[str, ...]) -> int:
    """Rank of the features, centred within sources.

    By a tree of QR decompositions: a task keeps the triangle of its rows, tasks' triangles are decomposed together, up
    to ``FAN_IN`` at a time, and the last one has the singular values of the whole design, to rounding.
    """
    if not names:
        return 0
    group = Window.partitionBy("text_id", "src_word")
    centred = pairs.select(*[(F.col(n) - F.avg(n).over(group)).cast("double").alias(n) for n in names])
    schema = "n long, triangle array<double>"

    def reduce(batches: Iterator[pa.RecordBatch], rows_of: Callable[[pa.RecordBatch], tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n, triangle = 0, np.zeros((0, len(names)))
        for batch in batches:
            more, rows = rows_of(batch)
            n, triangle = n + more, np.linalg.qr(np.vstack([triangle, rows]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([triangle.ravel().tolist()], pa.list_(pa.float64()))], ["n", "triangle"])

    def of_cells(batch: pa.RecordBatch) -> tuple[int, np.ndarray]:
        return batch.num_rows, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])

    def of_triangles(batch: pa.RecordBatch) -> tuple[int, np.ndarray]:
        flat = batch.column("triangle").flatten().to_numpy(zero_copy_only=False)
        return sum(batch.column("n").to_pylist()), flat.reshape(-1, len(names))

    leaves = centred.mapInArrow(lambda batches: reduce(batches, of_cells), schema)
    near = leaves.withColumn("_near", (F.spark_partition_id() / FAN_IN).cast("int")).repartition("_near").drop("_near")
    nodes = near.mapInArrow(lambda batches: reduce(batches, of_triangles), schema)
    n, triangle = 0, np.zeros((0, len(names)))
    for row in nodes.toLocalIterator():  # a triangle for each FAN_IN tasks
        n, triangle = n + row["n"], np.linalg.qr(np.vstack([triangle, np.reshape(row["triangle"], (-1, len(names)))]), mode="r")
    values = np.linalg.svd(triangle, compute_uv=False)
    return int((values > values.max(initial=0) * max(n, len(names)) * np.finfo(float).eps).sum())


def same_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates that only one of two designs has; empty if they agree."""
    keys = ["text_id", "src_word", "dst_word"]
    return a.select(*keys).exceptAll(b.select(*keys)).withColumn("side", F.lit("first")).unionByName(
        b.select(*keys).exceptAll(a.select(*keys)).withColumn("side", F.lit("second"))
    )


def candidate_audit(counted: DataFrame, min_exposure: float = 10) -> DataFrame:
    """By category of a design with ``count`` and ``category``: edges, sources, texts, mass and exposure."""
    with_exposure = counted.withColumn("exposure", F.sum("count").over(Window.partitionBy("text_id", "src_word")))
    eligible = F.col("exposure") >= min_exposure
    source = F.struct("text_id", "src_word")
    return with_exposure.groupBy("category").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_distinct(source).alias("sources"),
        F.count_distinct("text_id").alias("texts"),
        F.count_if(F.col("count") > 0).alias("nonzero"),
        F.sum("count").alias("mass"),
        F.count_if(eligible).alias("eligible"),
        F.count_distinct(F.when(eligible, source)).alias("eligible_sources"),
        F.sum("exposure").alias("exposure"),
    )


def exposure_audit(scored: DataFrame) -> DataFrame:
    """By category of scored candidates: expected counts, nonzero rate, mass, exposure and risk-set size."""
    sized = scored.withColumn("risk_size", F.count(F.lit(1)).over(Window.partitionBy("text_id", "src_word")))
    both = lambda c: [F.avg(c).alias(f"{c}_mean"), E.quantile(F.col(c), 0.5).alias(f"{c}_median")]
    return sized.groupBy("category").agg(
        *both("expected"),
        F.avg((F.col("count") > 0).cast("double")).alias("nonzero_rate"),
        F.sum("count").alias("mass"),
        *both("exposure"),
        *both("risk_size"),
    )
