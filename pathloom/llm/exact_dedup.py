"""Exact dedup by progressive refinement, with DataFrame functions only.

Copies are narrowed down in three steps, each of which looks only at what the step before left over:

1. by length: the UTF-8 length of every text is counted; lengths seen once are settled;
2. by prefix hash: texts of surviving lengths are counted by (length, hash of the first characters);
3. by full hash: only texts of surviving (length, prefix) groups are hashed as a whole.

Texts never move: each step counts narrow keys (with partial aggregation before the shuffle, so a
group that holds a third of all rows is one partial count per task), and what survives is sent to
the next step's scan as a bit set, sized by the number of keys up to 2**28 bits. A set bit that belongs
to another group costs one needless hash and never a wrong result, since the last step groups by the full
key; so beyond some 10**8 surviving keys more texts than needed are hashed, and nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bit_set, bits_for, materialize, packed, probe_bit_set

PREFIX_CHARS = 64


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    bits: int | None = None,
    digest_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size`` and ``kept``.

    Of equal texts the row with the largest id stays. Null texts count as empty, and empty texts
    equal each other. A null id never wins against another; if a group has only null ids, keep_id
    is null and its rows are kept. Rows that repeat the winning id are all marked kept: they are one
    document. Texts of any length are compared whole. An empty table gives no rows; other columns of
    ``docs`` are not read. With ``digest_col`` the SHA-256 of every text is returned too, settled ones
    included. ``bits`` sets the size of both bit sets, which else follows the number of keys.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sized = rows.withColumn("_len", F.octet_length("_text").cast("long"))
    lengths = materialize(sized.groupBy("_len").count().where("count > 1").select("_len"), "lengths")
    size = bits or bits_for(lengths.count())
    by_length = probe_bit_set(sized, F.col("_len"), bit_set(lengths, F.col("_len"), size), size)

    prefixed = by_length.withColumn("_prefix", F.when(F.col("_hit"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    prefixes = materialize(prefixed.where("_hit").groupBy("_len", "_prefix").count().where("count > 1").drop("count"), "prefixes")
    prefix_key, size = F.struct("_len", "_prefix"), bits or bits_for(prefixes.count())
    by_prefix = probe_bit_set(prefixed.drop("_hit"), prefix_key, bit_set(prefixes, prefix_key, size), size)

    digest = [F.sha2("_text", 256).alias("_digest")] if digest_col else []
    hashed = by_prefix.select(
        "_id",
        "_len",
        F.when(F.col("_hit") & F.col("_prefix").isNotNull(), F.sha2("_text", 256)).alias("_full"),
        *digest,
    )
    # Grouped by one struct, so that the join deals both sides anew and can split a group of very many copies.
    counted = hashed.where("_full is not null").groupBy(F.struct("_len", "_full").alias("_key")).agg(
        F.max("_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = counted.where("group_size > 1").select("_key.*", "keep_id", "group_size")
    # Rows that are settled already join with nothing; their own key keeps them from meeting in one partition.
    member = hashed.withColumn(
        "_full",
        F.coalesce("_full", F.concat_ws(":", F.lit("single"), F.col("_id").cast("string"), F.col("_len").cast("string"))),
    )
    found = member.join(groups, ["_len", "_full"], "left")
    return found.select(
        F.col("_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        *([F.col("_digest").alias(digest_col)] if digest_col else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text: that of the largest id; repeated rows collapse.

    Columns of any name pass through; of rows that repeat id and text, one stays. An empty table gives no rows.
    """
    verdicts = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__keep")).distinct()
    rows = packed(docs, __id=F.col(id_col), __text=F.col(text_col))
    return rows.join(verdicts, F.col("__id").eqNullSafe(F.col("__keep")), "left_semi").dropDuplicates(["__id", "__text"]).select("__row.*")
