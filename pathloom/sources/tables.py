"""The driver's tables as visits, words and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words a text, words a line, words a sentence, and texts.
TEXT_WORDS, LINE_WORDS, SENTENCE_WORDS, TEXTS = 24, 8, 12, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits: the user is the subject, ``props.k`` gives the text and ``value`` the word."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject_id"),
        F.concat(F.lit("T:"), (k % TEXTS).cast("string")).alias("text_id"),
        (F.floor("value") % TEXT_WORDS).cast("bigint").alias("word_index"),
        "ts",
        "event_id",
        (F.col("value") * 10).alias("duration_ms"),
    )
    order = F.row_number().over(Window.partitionBy("subject_id", "text_id").orderBy("ts", "event_id"))
    return e.select(
        "subject_id",
        "text_id",
        "word_index",
        order.cast("bigint").alias("fixation_order"),
        "duration_ms",
        F.floor(F.col("word_index") / LINE_WORDS).cast("bigint").alias("line_id"),
    )


def words(visits: DataFrame) -> DataFrame:
    """Observed words with properties that follow from their number."""
    w = F.col("word_index")
    distinct = visits.select("text_id", "word_index").distinct()
    sentence = F.floor(w / SENTENCE_WORDS)
    return distinct.select(
        "text_id",
        "word_index",
        F.concat(F.lit("w"), w.cast("string")).alias("surface"),
        F.ln(1 + w % 7).alias("log_length"),
        ((w * 5) % 9 - 4).cast("double").alias("cloze_logit"),
        (w % 9 == 0).alias("cloze_missing"),
        (w % SENTENCE_WORDS == SENTENCE_WORDS - 1).alias("terminal_punctuation"),
        (sentence + 1).cast("bigint").alias("sentence_number"),
        (3 + ((w * 7) % 11) / 10).alias("zipf_frequency"),
        (w % 10 == 0).alias("frequency_oov"),
        (sentence * SENTENCE_WORDS + F.floor((w % SENTENCE_WORDS) / 2)).cast("bigint").alias("head_word_index"),
        F.lit(False).alias("syntax_missing"),
        F.floor(w / LINE_WORDS).cast("bigint").alias("line_id"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations as texts (text_id, text); they grow with the table. Without a number there is no id."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(key.alias("text_id"), "text")
