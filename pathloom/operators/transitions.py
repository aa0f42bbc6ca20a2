"""From ordered visits to transition events and sparse transition matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E

VISIT = ["subject_id", "text_id"]


def extract_events(visits: DataFrame, weight: str = "count", include_self: bool = True, consecutive_only: bool = False) -> DataFrame:
    """One event for each pair of visits that follow each other in (subject, text), by ``fixation_order``.

    Rows that were dropped before are not bridged if ``consecutive_only``: the orders must differ by 1.
    ``weight`` is count (1), source_duration or target_duration. One window, one shuffle by (subject, text).
    """
    if weight not in ("count", "source_duration", "target_duration"):
        raise ValueError(f"unknown weight {weight!r}")
    lines = "line_id" in visits.columns
    following = Window.partitionBy(*VISIT).orderBy("fixation_order")
    lead = lambda c: F.lead(c).over(following)
    moved = visits.select(
        *VISIT,
        F.col("word_index").alias("src_word"),
        lead("word_index").alias("dst_word"),
        "fixation_order",
        lead("fixation_order").alias("next_order"),
        "duration_ms",
        lead("duration_ms").alias("next_duration"),
        *([F.col("line_id"), lead("line_id").alias("next_line")] if lines else []),
    )
    kind = E.event_type(F.col("src_word"), F.col("dst_word"), *((F.col("line_id"), F.col("next_line")) if lines else ()))
    size = {"count": F.lit(1.0), "source_duration": F.col("duration_ms"), "target_duration": F.col("next_duration")}[weight]
    events = moved.where(F.col("dst_word").isNotNull())
    if consecutive_only:
        events = events.where(F.col("next_order") == F.col("fixation_order") + 1)
    events = events.select(*VISIT, "src_word", "dst_word", kind.alias("event_type"), size.cast("double").alias("weight"))
    return events if include_self else events.where(F.col("event_type") != "refixation")


def select_events(
    events: DataFrame,
    types: list[str] | None = None,
    texts: DataFrame | None = None,
    subjects: DataFrame | None = None,
) -> DataFrame:
    """Events of the given types, texts and subjects."""
    if types is not None:
        events = events.where(F.col("event_type").isin(*types))
    for keys, column in ((texts, "text_id"), (subjects, "subject_id")):
        if keys is not None:
            events = events.join(keys.select(column), column, "left_semi")
    return events


def aggregate_transitions(events: DataFrame, normalize: str = "row", n_words: DataFrame | None = None) -> DataFrame:
    """Sparse matrices: (text_id, event_type, src_word, dst_word, count, probability).

    ``row`` divides by the source's total within the matrix, ``global`` by the matrix's, ``none`` by
    nothing. Sources without events have no rows; in a source that has some, absent destinations are true
    zeros. If ``n_words`` (text_id, n_words) is given, an event beyond a text's words raises.
    """
    cells = events.groupBy("text_id", "event_type", "src_word", "dst_word").agg(F.sum("weight").alias("count"))
    if n_words is not None:
        cells = cells.join(n_words, "text_id", "left")
        beyond = F.greatest("src_word", "dst_word") >= F.col("n_words")
        cells = cells.withColumn(
            "count",
            F.when(beyond, F.raise_error(F.lit("n_words is smaller than the observed words"))).otherwise(F.col("count")),
        ).drop("n_words")
    if normalize == "none":
        return cells.withColumn("probability", F.col("count"))
    keys = {"row": ["text_id", "event_type", "src_word"], "global": ["text_id", "event_type"]}[normalize]
    total = F.sum("count").over(Window.partitionBy(*keys))
    return cells.withColumn("probability", F.when(total > 0, F.col("count") / total))


def text_sizes(events: DataFrame) -> DataFrame:
    """(text_id, n_words): one more than the largest word of any event type."""
    return events.groupBy("text_id").agg((F.max(F.greatest("src_word", "dst_word")) + 1).alias("n_words"))


def dense_matrix(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """All W x W cells of each (text, type), zeros included, with ``valid``: whether the source has events."""
    grid = cells.select("text_id", "event_type").distinct().join(sizes, "text_id").select(
        "text_id",
        "event_type",
        "n_words",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_words") - 1)).alias("src_word"),
    )
    grid = grid.select(
        "text_id",
        "event_type",
        "src_word",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_words") - 1)).alias("dst_word"),
    )
    full = grid.join(cells, ["text_id", "event_type", "src_word", "dst_word"], "left")
    row = Window.partitionBy("text_id", "event_type", "src_word")
    return full.select(
        "text_id",
        "event_type",
        "src_word",
        "dst_word",
        F.coalesce("count", F.lit(0.0)).alias("count"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        (F.sum(F.coalesce("count", F.lit(0.0))).over(row) > 0).alias("valid"),
    )


def subject_edges(events: DataFrame, event_type: str = "forward") -> DataFrame:
    """(subject_id, text_id, src_word, dst_word, count): each subject's weights, once, for all resampling."""
    return events.where(F.col("event_type") == event_type).groupBy(*VISIT, "src_word", "dst_word").agg(F.sum("weight").alias("count"))


def half_edges(edges: DataFrame, draws: DataFrame) -> DataFrame:
    """Sums over the subjects of each (draw, half), multiplicities kept. ``draws`` (draw, half, subject_id, mult) is small."""
    return edges.join(draws, "subject_id").groupBy("draw", "half", "text_id", "src_word", "dst_word").agg(
        F.sum(F.col("count") * F.col("mult")).alias("count")
    )


def edge_counts(events: DataFrame) -> DataFrame:
    """Number of events of any type for each (text, src, dst), whatever their weight."""
    return events.groupBy("text_id", "src_word", "dst_word").agg(F.count(F.lit(1)).alias("n"))


def count_vector(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` with the edges' counts, 0 where there is none; edges that are no candidates fall away."""
    keys = ["text_id", "src_word", "dst_word"]
    return pairs.join(edges.select(*keys, "count"), keys, "left").withColumn("count", F.coalesce("count", F.lit(0.0)))


def verified_only(events: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose both words are verified (text_id, word_index), and the weight of those that are not."""
    at = lambda end: verified.select("text_id", F.col("word_index").alias(end)).distinct()
    marked = events.join(
        at("src_word").withColumn("_src", F.lit(True)),
        ["text_id", "src_word"],
        "left",
    ).join(at("dst_word").withColumn("_dst", F.lit(True)), ["text_id", "dst_word"], "left")
    good = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    dropped = marked.agg(
        F.coalesce(F.sum(F.when(~good, F.col("weight"))), F.lit(0.0)).alias("dropped_weight"),
        F.count_if(~good).alias("dropped_events"),
    )
    return marked.where(good).select(*events.columns), dropped


def candidate_sensitivity(
    pairs: DataFrame,
    max_distance: int | None = None,
    drop_last_two: DataFrame | None = None,
    boxes: DataFrame | None = None,
) -> DataFrame:
    """Forward pairs within a distance, away from a text's last two words (``drop_last_two``: text_id, n_words)
    and whose boxes (text_id, word_index, top, bottom) overlap or touch vertically."""
    kept = pairs.where(F.col("dst_word") > F.col("src_word"))
    if max_distance is not None:
        kept = kept.where(F.col("dst_word") - F.col("src_word") <= max_distance)
    if drop_last_two is not None:
        kept = kept.join(drop_last_two, "text_id").where(F.col("dst_word") < F.col("n_words") - 2).drop("n_words")
    if boxes is not None:
        for end in ("src", "dst"):
            kept = kept.join(
                boxes.select(
                    "text_id",
                    F.col("word_index").alias(f"{end}_word"),
                    F.col("top").alias(f"_{end}_top"),
                    F.col("bottom").alias(f"_{end}_bottom"),
                ),
                ["text_id", f"{end}_word"],
            )
        kept = kept.where((F.col("_src_top") <= F.col("_dst_bottom")) & (F.col("_dst_top") <= F.col("_src_bottom")))
    return kept.select(*pairs.columns)


def with_separation(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("category", E.separation(F.col("src_word"), F.col("dst_word")))

