"""Readers, validation and conversion of visit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a visit log and of the two kinds of raw reports, and what stands for a missing number.
REQUIRED = ("subject_id", "text_id", "word_index", "fixation_order", "duration_ms")
AREA_REPORT = ("RECORDING_SESSION_LABEL", "Participant_ID", "TRIAL_INDEX", "Text_ID", "IA_ID", "Word_Number", "IA_TOP", "IA_BOTTOM")
FIXATION_REPORT = (
    "RECORDING_SESSION_LABEL",
    "TRIAL_INDEX",
    "page",
    "CURRENT_FIX_INTEREST_AREA_INDEX",
    "CURRENT_FIX_INDEX",
    "CURRENT_FIX_DURATION",
)
MISSING_NUMBERS = ("", ".", "NA")
FIXATIONS = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("text_id", T.StringType()),
        T.StructField("word_index", T.LongType()),
        T.StructField("fixation_order", T.LongType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("line_id", T.LongType()),
    ]
)


def require_columns(df: DataFrame, needed: tuple[str, ...]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_fixations(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """A CSV of visits; ``line_id`` is optional. Values that cannot be read raise, whatever the session's mode; so do missing keys."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, REQUIRED)

    def strict(f: T.StructField) -> Column:
        text, value = F.col(f.name), F.col(f.name).try_cast(f.dataType)
        bad = text.isNull() if f.name != "line_id" else F.lit(False)
        wrong = F.concat(F.lit(f"{f.name} cannot be read: "), F.coalesce(text, F.lit("missing")))
        return F.when(bad | (text.isNotNull() & value.isNull()), F.raise_error(wrong).cast(f.dataType)).otherwise(value).alias(f.name)

    visits = raw.select(*[strict(f) for f in FIXATIONS if f.name in raw.columns])
    if validate:
        bad = violations(visits).where("n > 0").collect()  # one row for each rule
        if bad:
            raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in bad))
    return visits


def violations(visits: DataFrame) -> DataFrame:
    """(rule, n): how many rows or keys break each rule of a visit log."""
    finite = F.col("duration_ms").isNotNull() & ~F.isnan("duration_ms") & (F.abs("duration_ms") < float("inf"))
    single = visits.agg(
        F.count_if(F.coalesce(F.col("word_index") < 0, F.lit(True))).alias("negative_word"),
        F.count_if(~finite | (F.col("duration_ms") < 0)).alias("bad_duration"),
    )
    rules = single.select(F.expr("stack(2, 'negative_word', negative_word, 'bad_duration', bad_duration) as (rule, n)"))
    repeated = visits.groupBy("subject_id", "text_id", "fixation_order").count().agg(F.count_if(F.col("count") > 1).alias("n")).select(
        F.lit("repeated_order").alias("rule"),
        "n",
    )
    rules = rules.unionByName(repeated)
    if "line_id" in visits.columns:
        moved = visits.where("line_id is not null").groupBy("text_id", "word_index").agg(
            (F.min("line_id") != F.max("line_id")).alias("several")
        ).agg(F.count_if(F.col("several")).alias("n")).select(F.lit("several_lines").alias("rule"), "n")
        rules = rules.unionByName(moved)
    return rules


def functional_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) pairs with ``consistent``: whether the key has one value only."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(
        F.min(value).alias(value),
        (F.count_distinct(value) == 1).alias("consistent"),
    )


def checked_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """As ``functional_map``, raising where a key has several values."""
    found = functional_map(df, key, value)
    return found.select(
        key,
        F.when(F.col("consistent"), F.col(value)).otherwise(
            F.raise_error(F.concat(F.lit(f"{key} has several {value}: "), F.col(key).cast("string")))
        ).alias(value),
    )


#: In this order; the first that holds is a row's reason.
EXCLUSIONS = ("missing_trial", "page_mismatch", "outside", "unmapped_area", "missing_line", "bad_number")


def exclusion_reason(conditions: dict[str, Column]) -> Column:
    """The first reason whose condition holds; NULL for rows that stay."""
    reason = None
    for name in EXCLUSIONS:
        if name in conditions:
            hit = F.coalesce(conditions[name], F.lit(False))
            reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return reason


def area_words(areas: DataFrame) -> DataFrame:
    """(Text_ID, IA_ID, word): the word of each area that has a number; an area of several words raises.

    Area 1 of every text is word 1, numbered or not; another number there raises.
    """
    given = areas.where(F.col("Word_Number").isNotNull() & ~F.col("Word_Number").isin(*MISSING_NUMBERS))
    number = F.col("Word_Number").cast("bigint")
    first = F.col("IA_ID") == "1"
    wrong = F.raise_error(F.concat(F.lit("area 1 is another word in text "), F.col("Text_ID"))).cast("bigint")
    named = given.select("Text_ID", "IA_ID", F.when(first & (number != 1), wrong).otherwise(number).alias("word"))
    every = named.unionByName(areas.select("Text_ID", F.lit("1").alias("IA_ID"), F.lit(1).cast("bigint").alias("word")).distinct())
    several = F.raise_error(F.concat(F.lit("an area of several words: "), F.concat_ws(":", "Text_ID", "IA_ID"))).cast("bigint")
    word = F.when(F.min("word") == F.max("word"), F.min("word")).otherwise(several)
    return every.groupBy("Text_ID", "IA_ID").agg(word.alias("word"))


def _windows_text(c: Column) -> Column:
    """Text that was read as ISO 8859-1 as code page 1252, which differs in the characters 0x80 to 0x9F only."""
    codes = {i: bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}
    known = {chr(i): x for i, x in codes.items() if x}
    return F.translate(c, "".join(known), "".join(known.values()))


def read_report(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A raw report in code page 1252 as strings; empty fields are null."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    require_columns(raw, columns)
    return raw.select(*[_windows_text(F.col(c)).alias(c) for c in columns])


def mark_reports(areas: DataFrame, fixations: DataFrame, lines: DataFrame) -> DataFrame:
    """Fixations with what they map to and ``reason``: why a row is no visit, NULL for those that are.

    Sessions map to participants and trials to texts; both must be functions. ``lines`` is (text_id,
    word_index, line_id) of ``intervals.line_map``. Words are numbered from 0 there, and from 1 in areas.
    """
    people = checked_map(areas, "RECORDING_SESSION_LABEL", "Participant_ID")
    trial = F.concat_ws("|", "RECORDING_SESSION_LABEL", "TRIAL_INDEX").alias("_trial")
    texts = checked_map(areas.select(trial, "Text_ID"), "_trial", "Text_ID")
    words = area_words(areas).withColumnRenamed("Text_ID", "_text")
    on_line = lines.select(F.col("text_id").alias("_line_text"), F.col("word_index").alias("_line_word"), "line_id")
    area = F.col("CURRENT_FIX_INTEREST_AREA_INDEX")
    joined = (
        fixations.withColumn("_trial", trial)
        .join(people, "RECORDING_SESSION_LABEL", "left")
        .join(texts, "_trial", "left")
        .join(words, (F.col("Text_ID") == F.col("_text")) & (area == F.col("IA_ID")), "left")
        .join(on_line, (F.col("Text_ID") == F.col("_line_text")) & (F.col("word") - 1 == F.col("_line_word")), "left")
    )
    order, duration = F.col("CURRENT_FIX_INDEX").try_cast("bigint"), F.col("CURRENT_FIX_DURATION").try_cast("double")
    conditions = {
        "missing_trial": F.col("Text_ID").isNull() | F.col("Participant_ID").isNull(),
        "page_mismatch": ~F.col("page").eqNullSafe(F.col("Text_ID")),
        "outside": area.isNull() | area.isin("", "."),
        "unmapped_area": F.col("word").isNull(),
        "missing_line": F.col("line_id").isNull(),
        "bad_number": order.isNull() | duration.isNull() | (duration < 0),
    }
    return joined.withColumn("order", order).withColumn("duration", duration).withColumn("reason", exclusion_reason(conditions))


def convert_reports(areas: DataFrame, fixations: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An area report and a fixation report to visits, and the counts of rows by reason ("written" for those kept)."""
    marked = mark_reports(areas, fixations, lines)
    visits = marked.where("reason is null").select(
        F.col("Participant_ID").alias("subject_id"),
        F.col("Text_ID").alias("text_id"),
        (F.col("word") - 1).alias("word_index"),
        F.col("order").alias("fixation_order"),
        F.col("duration").alias("duration_ms"),
        "line_id",
    )
    return visits, marked.groupBy(F.coalesce("reason", F.lit("written")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def exclusion_map(marked: DataFrame) -> DataFrame:
    """One row: a map from text:area to the number of rows whose area has no word or no line, keys in order."""
    lost = marked.where(F.col("reason").isin("unmapped_area", "missing_line"))
    counted = lost.groupBy(F.concat_ws(":", "Text_ID", "CURRENT_FIX_INTEREST_AREA_INDEX").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("excluded"))


def conversion_report(areas: DataFrame, marked: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: sessions, trials, mapped areas, rows in, written and left out by reason, words with and without a line, the exclusion map.

    ``marked`` is that of ``mark_reports``, ``audit`` that of ``intervals.line_map``.
    """
    from_areas = areas.agg(
        F.count_distinct("RECORDING_SESSION_LABEL").alias("sessions"),
        F.count_distinct("RECORDING_SESSION_LABEL", "TRIAL_INDEX").alias("trials"),
    )
    mapped = area_words(areas).agg(F.count(F.lit(1)).alias("word_mappings"))
    reason = F.col("reason")
    rows = marked.agg(
        F.count(F.lit(1)).alias("fixation_rows"),
        F.count_if(reason.isNull()).alias("written"),
        *[F.count_if(F.coalesce(reason == r, F.lit(False))).alias(f"excluded_{r}") for r in EXCLUSIONS],
    )
    words = audit.agg(F.sum("mapped").alias("line_mapped_words"), F.sum("ambiguous").alias("line_missing_words"))
    out = from_areas
    for one_row in (mapped, rows, words, exclusion_map(marked)):
        out = out.crossJoin(F.broadcast(one_row))
    return out


def write_line_map(mapped: DataFrame, path: str) -> None:
    """The line map as one CSV, in numeric order of texts and words."""
    ordered = mapped.orderBy(F.col("text_id").try_cast("bigint"), "text_id", "word_index")
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def map_claims(sentences: DataFrame, sample_ms: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Nested sentences to visits by the words' claims on positions, and counters by text.

    ``sentences``: text_id, words ARRAY<STRUCT<content, fix_positions ARRAY<DOUBLE>, n_fixations>>, bounds
    ARRAY<ARRAY<DOUBLE>> (left, top, right, bottom), fix ARRAY<STRUCT<x, y, duration>>. Positions count from
    1; claims that are no whole number or out of range are counted and dropped. A position that several
    different words claim is a conflict, one that none claims is outside. Geometry is only counted.
    """
    fix = sentences.select("text_id", F.posexplode("fix").alias("_at", "f")).select(
        "text_id",
        (F.col("_at") + 1).cast("bigint").alias("position"),
        "f.x",
        "f.y",
        "f.duration",
    )
    claims = sentences.select("text_id", F.size("fix").alias("n_fix"), F.posexplode("words").alias("word_index", "w")).select(
        "text_id",
        "n_fix",
        F.col("word_index").cast("bigint").alias("word_index"),
        F.explode("w.fix_positions").alias("p"),
    ).where("p is not null and not isnan(p)")
    valid = (F.col("p") == F.floor("p")) & F.col("p").between(1, F.col("n_fix"))
    by_position = claims.where(valid).groupBy("text_id", F.col("p").cast("bigint").alias("position")).agg(
        F.count_distinct("word_index").alias("claimants"),
        F.min("word_index").alias("word_index"),
    )
    boxes = sentences.select("text_id", F.posexplode("bounds").alias("box", "b")).select(
        "text_id",
        "box",
        *[F.col("b")[i].alias(n) for i, n in enumerate(("left_", "top_", "right_", "bottom_"))],
    )
    inside = fix.join(boxes, "text_id").where(
        F.col("x").between(F.col("left_"), F.col("right_")) & F.col("y").between(F.col("top_"), F.col("bottom_"))
    ).groupBy("text_id", "position").agg(F.count(F.lit(1)).alias("boxes"), F.min("box").cast("bigint").alias("box"))
    met = fix.join(by_position, ["text_id", "position"], "left").join(inside, ["text_id", "position"], "left")
    good = F.col("duration").isNotNull() & ~F.isnan("duration") & (F.col("duration") >= 0) & (F.col("duration") < float("inf"))
    kept = F.coalesce(F.col("claimants") == 1, F.lit(False))
    visits = met.where(kept & good).select(
        "text_id",
        "word_index",
        F.col("position").alias("fixation_order"),
        (F.col("duration") * sample_ms).alias("duration_ms"),
    )
    counted = met.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("fixations"),
        F.count_if(F.col("claimants").isNull()).alias("outside"),
        F.count_if(F.col("claimants") > 1).alias("conflicts"),
        F.count_if(kept & ~good).alias("bad_duration"),
        F.count_if(F.coalesce(F.col("boxes") == 1, F.lit(False))).alias("one_box"),
        F.count_if(F.coalesce(F.col("boxes") > 1, F.lit(False))).alias("several_boxes"),
        F.count_if(
            kept & F.coalesce((F.col("boxes") == 1) & (F.col("box") != F.col("word_index")), F.lit(False))
        ).alias("geometry_differs"),
    )
    dropped = claims.groupBy("text_id").agg(F.count_if(~valid).alias("bad_claims"))
    numbers = sentences.select("text_id", F.explode("words").alias("w")).groupBy("text_id").agg(
        F.count_if(F.size("w.fix_positions") != F.col("w.n_fixations")).alias("count_differs")
    )
    return visits, counted.join(dropped, "text_id", "left").join(numbers, "text_id", "left").fillna(0)


def identity(path: Column) -> tuple[Column, Column]:
    """Subject and upper-case task of a file named results<SUBJECT>_<TASK>.mat; raises on other names."""
    name = r"results([A-Za-z0-9]+)_([A-Za-z0-9]+)\.mat$"
    part = lambda i: F.when(path.rlike(name), F.regexp_extract(path, name, i)).otherwise(
        F.raise_error(F.concat(F.lit("not a result file: "), path))
    )
    return part(1), F.upper(part(2))


def manifest_differences(found: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """(key, problem): files that only one side has, and those whose digests differ; both sides have (key, digest)."""
    a = found.select(key, F.col("digest").alias("_found"))
    b = listed.select(key, F.col("digest").alias("_listed"))
    problem = F.when(F.col("_listed").isNull(), "not listed").when(F.col("_found").isNull(), "not found").when(
        F.col("_found") != F.col("_listed"),
        "differs",
    )
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def nested_rows(results: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Nested maps of a result as rows: one column for each level's key, then ``value``."""
    out = results.select(F.col(column).alias("value"))
    for level in levels:
        keys = [c for c in out.columns if c != "value"]
        out = out.select(*keys, F.explode("value").alias(level, "value"))
    return out


def concat_subjects(tables: list[DataFrame]) -> DataFrame:
    """Tables of the same columns, one below the other."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def relation_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each row as canonical JSON, keys sorted."""
    return df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("digest"))


def run_files(spark: SparkSession, path: str, pattern: str = r"seed(\d+)_([a-z]+)") -> DataFrame:
    """(path, seed, condition) of files named by seed and condition; others fall away."""
    name = F.col("path")
    found = spark.read.format("binaryFile").load(path).select(
        "path",
        F.regexp_extract(name, pattern, 1).try_cast("bigint").alias("seed"),
        F.regexp_extract(name, pattern, 2).alias("condition"),
    )
    return found.where("seed is not null")


def write_result(df: DataFrame, path: str) -> None:
    """A result as JSON with a flat CSV beside it; undefined values are nulls in both."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat = df.select(
        *[
            F.col(f.name).cast("string") if isinstance(
                f.dataType,
                (T.ArrayType, T.MapType, T.StructType),
            ) else F.col(f.name) for f in df.schema
        ]
    )
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def nested_words(sentences: DataFrame) -> DataFrame:
    """Words of nested sentences (text_id, words ARRAY<STRING>, bounds) as metadata: one sentence a text, no cloze values.

    ``top`` and ``bottom`` are those of the word's box, from which ``intervals.cluster_intervals`` makes lines.
    """
    from pathloom.functions import expressions as E

    each = sentences.select("text_id", F.posexplode(F.arrays_zip("words", "bounds")).alias("word_index", "w"))
    surface = F.col("w.words")
    return each.select(
        "text_id",
        F.col("word_index").cast("bigint").alias("word_index"),
        surface.alias("surface"),
        F.ln(E.clean_length(surface)).alias("log_length"),
        F.lit(0.0).alias("cloze_logit"),
        F.lit(True).alias("cloze_missing"),
        E.ends_sentence(surface).alias("terminal_punctuation"),
        F.lit(1).cast("bigint").alias("sentence_number"),
        F.col("w.bounds")[1].alias("top"),
        F.col("w.bounds")[3].alias("bottom"),
    )


def failed_checks(results: dict[str, DataFrame], rules: dict[str, dict[str, Column]]) -> DataFrame:
    """(result, rule, failures) of the rules, each a condition that all rows of a result must meet; empty if all hold.

    A rule on no rows fails once: results must not be empty.
    """
    parts = []
    for name, conditions in rules.items():
        row = results[name].agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in conditions.items()],
        )
        for r in conditions:
            parts.append(
                row.select(
                    F.lit(name).alias("result"),
                    F.lit(r).alias("rule"),
                    F.when(F.col("_n") == 0, F.lit(1)).otherwise(F.col(r)).cast("bigint").alias("failures"),
                )
            )
    return concat_subjects(parts).where("failures > 0")
