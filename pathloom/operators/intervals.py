"""Lines from vertical intervals, and consensus bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_intervals(intervals: DataFrame, keys: list[str], top: str = "top", bottom: str = "bottom") -> DataFrame:
    """``intervals`` with ``line_id``: intervals that overlap strictly, directly or through others, share one.

    Lines are numbered from 0 by their top within the keys. Gaps and islands: sorted by (top, bottom), an
    interval begins a new line if nothing before it reaches below its top. Intervals without a top come last and
    overlap nothing.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(top), F.asc_nulls_last(bottom))
    reach = F.max(bottom).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col(top) < reach, 0).otherwise(1)
    return intervals.withColumn("_begins", begins).withColumn(
        "line_id",
        F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1,
    ).drop("_begins")


def consensus_bounds(observed: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """(keys, value, variants, observations, accepted): the commonest value of each key.

    It is accepted if it is the only one or holds a strict majority, so that how ties are broken cannot matter.
    """
    counted = observed.groupBy(*keys, *value).agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(*keys)
    ranked = counted.select(
        *keys,
        *value,
        "n",
        F.row_number().over(each.orderBy(F.col("n").desc(), *value)).alias("rank"),
        F.sum("n").over(each).alias("observations"),
        F.count(F.lit(1)).over(each).alias("variants"),
    )
    return ranked.where("rank = 1").select(
        *keys,
        *value,
        "variants",
        "observations",
        ((F.col("variants") == 1) | (2 * F.col("n") > F.col("observations"))).alias("accepted"),
    )


# Names of an area report's columns, and what stands for a missing number.
TEXT, AREA, NUMBER, TOP, BOTTOM = "Text_ID", "IA_ID", "Word_Number", "IA_TOP", "IA_BOTTOM"
MISSING = ("", ".", "NA")


def observed_bounds(areas: DataFrame) -> DataFrame:
    """(text_id, word_index, top, bottom) of the rows of an area report that have usable bounds; words count from 0.

    A row without a word number is word 1 if it is area 1, and skipped else; so are rows whose numbers cannot be
    read and bounds that are upside down.
    """
    missing = F.col(NUMBER).isNull() | F.col(NUMBER).isin(*MISSING)
    number = F.when(~missing, F.col(NUMBER)).when(F.col(AREA) == "1", F.lit("1"))
    whole = number.try_cast("double").cast("bigint") - 1
    bounds = areas.select(
        F.col(TEXT).alias("text_id"),
        whole.alias("word_index"),
        F.col(TOP).try_cast("double").alias("top"),
        F.col(BOTTOM).try_cast("double").alias("bottom"),
    )
    return bounds.where("word_index is not null and top <= bottom")


def line_map(observed: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """From observed (text_id, word_index, top, bottom): (text_id, word_index, line_id) of accepted words, and the audit.

    Every observed variant of a mapped word must overlap exactly the envelope of its line. ``violations`` counts
    those that do not; reading the map of a text that has some raises, or leaves the text out if not ``strict``.
    """
    consensus = consensus_bounds(observed, ["text_id", "word_index"], ["top", "bottom"])
    lines = cluster_intervals(consensus.where("accepted"), ["text_id"])
    placed = lines.select("text_id", "word_index", "line_id")
    envelope = lines.groupBy("text_id", "line_id").agg(F.min("top").alias("low"), F.max("bottom").alias("high"))
    variant = ["text_id", "word_index", "top", "bottom", "line_id"]
    variants = observed.distinct().join(placed, ["text_id", "word_index"])
    overlap = (F.col("top") < F.col("high")) & (F.col("bottom") > F.col("low"))
    met = variants.join(envelope.withColumnRenamed("line_id", "met_line"), "text_id").where(overlap)
    per = met.groupBy(*variant).agg(F.count(F.lit(1)).alias("n"), F.max("met_line").alias("met"))
    own = (F.col("n") == 1) & (F.col("met") == F.col("line_id"))
    wrong = variants.join(per, variant, "left").where(~F.coalesce(own, F.lit(False)))
    violations = wrong.groupBy("text_id").agg(F.count(F.lit(1)).alias("violations"))
    checked = placed.join(violations, "text_id", "left")
    message = F.concat(F.lit("bounds of a word meet another line in text "), F.col("text_id").cast("string"))
    line = F.when(F.col("violations").isNull(), F.col("line_id")).otherwise(F.raise_error(message)) if strict else F.col("line_id")
    mapped = checked if strict else checked.where("violations is null")
    summary = consensus.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("words"),
        F.count_if(F.col("accepted")).alias("mapped"),
        F.count_if(~F.col("accepted")).alias("ambiguous"),
        F.count_if(F.col("variants") > 1).alias("several_variants"),
        F.sum("observations").alias("observations"),
        F.sum("variants").alias("variants"),
    )
    counted = lines.groupBy("text_id").agg((F.max("line_id") + 1).alias("lines"))
    audit = summary.join(counted, "text_id", "left").join(violations, "text_id", "left").fillna(0, ["lines", "violations"])
    return mapped.select("text_id", "word_index", line.alias("line_id")), audit


def partition_agreement(layouts: DataFrame) -> DataFrame:
    """Lines of every subject's layout (subject_id, text_id, word_index, content, top, bottom) against the first subject's.

    One row per (text, subject) of the first subject's texts and any other's: words of either, differing bounds
    (allowed), differing contents and lines (not allowed). A word or a text that one of the two lacks differs in all.
    """
    lined = cluster_intervals(layouts, ["subject_id", "text_id"])
    first = lined.agg(F.min("subject_id").alias("reference"))  # one row
    marked = lined.crossJoin(F.broadcast(first))
    fields = ("content", "top", "bottom", "line_id")
    subjects = marked.where("subject_id <> reference").select("subject_id").distinct()
    base = marked.where("subject_id = reference").select("text_id", "word_index", *[F.col(c).alias(f"ref_{c}") for c in fields])
    other = marked.where("subject_id <> reference").select("subject_id", "text_id", "word_index", *fields)
    # Words are compared where a subject has them; those that it lacks are the reference's less the ones met.
    met = other.join(base.withColumn("_met", F.lit(1)), ["text_id", "word_index"], "left")
    lacking = F.col("_met").isNull()
    same = lambda *names: F.lit(True) if not names else F.col(names[0]).eqNullSafe(F.col(f"ref_{names[0]}")) & same(*names[1:])
    differing = {"bounds_differ": ("top", "bottom"), "content_differs": ("content",), "line_differs": ("line_id",)}
    found = met.groupBy("text_id", "subject_id").agg(
        F.count(F.lit(1)).alias("_words"),
        F.count("_met").alias("_shared"),
        *[F.count_if(lacking | ~same(*names)).alias(name) for name, names in differing.items()],
    )
    sizes = base.groupBy("text_id").agg(F.count(F.lit(1)).alias("_size"))
    rows = sizes.select("text_id").crossJoin(subjects).join(found, ["text_id", "subject_id"], "full")  # texts by subjects, as the result has
    filled = rows.join(sizes, "text_id", "left").fillna(0, ["_words", "_shared", "_size", *differing])
    missing = F.col("_size") - F.col("_shared")
    return filled.select(
        "text_id", "subject_id", (F.col("_words") + missing).alias("words"), *[(F.col(name) + missing).alias(name) for name in differing]
    )
