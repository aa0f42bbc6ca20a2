"""Divergence of sources from each other and from their language, term by term.

Texts are counted in portions where they lie; the counts, added up once, go to shards by a hash of language and term, so
that neither a large language nor a large source meets in one task, and every shard holds all sources of its terms. DuckDB works on a
shard as a whole: one query adds the counts up and keeps the terms of enough documents, another gives the partial sums
of each pair of sources over the shard's terms and the shard's best terms of each source. Spark adds the partial sums
up and ranks them.

For counts c of a term in a group with N occurrences of kept terms, and V kept terms in its language,
p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two groups differ in the term by floor((p - q)^2 / (p + q)). A term that a
source lacks has the same p as every other term that it lacks; so the sum over all V terms is V times the difference of
two absent terms, and corrections for the terms that one source has (by a histogram of its counts) and for those that
both have (in the shards). Nothing is laid out for terms that are not there. All numbers are exact.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, materialize, releasing, shuffle_partitions
from pathloom.llm.words import portions, split_words, translated

MIN_DOCUMENTS, TOP_TERMS = 10, 10
#: Bytes of text that are counted together, bytes of text for each shard of counts, and cells for each shard of kept terms.
PORTION, SHARD_BYTES, SHARD_CELLS = 4 << 20, 64 << 20, 100_000

#: Bytes of a term stand for themselves, A-Z for a-z, all others for a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
CELLS = "lang string, term string, source string, n long"

#: Counts of a shard: the terms that enough documents of their language hold.
COUNT_SQL = """
SELECT lang, term, source, n FROM (
    SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS held
    FROM (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM shard GROUP BY lang, term, source)
) WHERE held >= ?
"""
#: A shard's cells with their own p, that of an absent term, and the language's p of the term.
_SHARES = """
WITH shares AS (
    SELECT lang, source, term,
           (1 + (1000000000::HUGEINT * (n + 2)) // (own + 2 * kept))::BIGINT AS p,
           (1 + 2000000000::HUGEINT // (own + 2 * kept))::BIGINT AS absent,
           (1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (whole + 2 * kept))::BIGINT AS q
    FROM shard
)
"""
#: What both sources' having a term adds to the sum of their absent and single terms.
PAIR_SQL = _SHARES + """
SELECT a.lang, a.source, b.source AS item,
       sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p) - (a.p - b.absent) * (a.p - b.absent) // (a.p + b.absent)
           - (a.absent - b.p) * (a.absent - b.p) // (a.absent + b.p)
           + (a.absent - b.absent) * (a.absent - b.absent) // (a.absent + b.absent))::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source
GROUP BY a.lang, a.source, b.source
"""
TERM_SQL = _SHARES + """
SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= ?
"""

_CELLS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])


def _query(shard: pa.Table, sql: str, *parameters) -> pa.Table:
    """SQL over one shard, in memory and on one thread; a shard is bounded, so nothing is written anywhere."""
    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as connection:
        connection.register("shard", shard)
        return connection.sql(sql, params=list(parameters)).to_arrow_table()


def _count_portion(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Occurrences of each term and the documents that hold it, by language and source; a row with a null term for each of these."""
    data, offsets = translated(texts, _TERMS)
    terms = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    counts, places, words = split_words(terms)
    coded = [c.dictionary_encode() for c in (langs, sources)]
    lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded)
    groups, group = np.unique(lang * (len(coded[1].dictionary) + 1) + source, return_inverse=True)
    size = max(1, len(words))
    document = np.repeat(np.arange(len(texts), dtype=np.int64), counts) * size + places
    in_document, times = np.unique(document, return_counts=True)
    cell = group[in_document // size] * size + in_document % size
    cells, where = np.unique(cell, return_inverse=True)
    n = np.bincount(where, weights=times, minlength=len(cells)).astype(np.int64)
    docs = np.bincount(where, minlength=len(cells)).astype(np.int64)
    of_cell = np.concatenate([cells // size, np.arange(len(groups))])
    place = pa.array(np.concatenate([cells % size, np.zeros(len(groups), np.int64)]), mask=np.arange(len(of_cell)) >= len(cells))
    of_group = groups[of_cell]
    zero = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            coded[0].dictionary.take(pa.array(of_group // (len(coded[1].dictionary) + 1))),
            coded[1].dictionary.take(pa.array(of_group % (len(coded[1].dictionary) + 1))),
            words.cast(pa.string()).take(place),
            pa.array(np.concatenate([n, zero])),
            pa.array(np.concatenate([docs, zero])),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) by portions of texts, to be added up; each (lang, source) has rows with a null term too."""
    bounded_batches(docs)
    columns = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in columns])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            start = 0
            for texts in portions(batch.column("text"), PORTION):
                part = batch.slice(start, len(texts))
                start += len(texts)
                held.append(part)
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if size >= PORTION:
                    yield _held(held)
                    held, size = [], 0
        if held:
            yield _held(held)

    return narrow.mapInArrow(releasing(run), COUNTED)


def _held(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts)
    return _count_portion(*(pa.concat_arrays(whole.column(c).chunks) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The cells (lang, term, source, n) of the terms that enough documents of a language hold, and all (lang, source)."""
    spark = docs.sparkSession
    text = columns.get("text_col", "text")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size // SHARD_BYTES))
    # Added up before the shards, by all three keys: else a frequent term's shard had a row of every portion.
    counted = count_terms(docs, **columns).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    key = F.when(F.col("term").isNull(), F.xxhash64("lang", "source")).otherwise(F.xxhash64("lang", "term"))
    counted = counted.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))

    def add_up(rows: pa.Table) -> pa.Table:
        cells = _query(rows.filter(pc.is_valid(rows["term"])), COUNT_SQL, min_documents)
        names = ["lang", "term", "source", "n"]
        return pa.concat_tables([t.select(names).cast(_CELLS) for t in (cells, rows.filter(pc.is_null(rows["term"])))])

    cells = materialize(counted.groupBy("shard").applyInArrow(add_up, CELLS), "cells")
    return cells.where("term is not null"), cells.where("term is null").select("lang", "source")


def _difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _share(n: str, of: str) -> str:
    """SQL of p, in decimals, since a count times 10^9 may be beyond a long."""
    return f"1 + (cast({n} + 2 as decimal(19, 0)) * 1000000000BD) div cast({of} + 2 * kept as decimal(20, 0))"


def audit_sources(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): what sets a source apart.

    Part ``pair`` has each other source of the language, with the sum of differences over all kept terms; part
    ``term`` the ``top`` terms that the source uses more than its language. Ranks go by value, the largest first, ties by
    item. Every row is a document, repeated ones and those without an id included; null texts, languages and sources
    are empty strings, and a group without terms has its pairs all the same (0 where its language keeps no term). Texts
    of any length are counted whole; other columns are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cells, marks = kept_terms(docs, min_documents, text_col=text_col, lang_col=lang_col, source_col=source_col)
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    of_lang = cells.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_distinct("term").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = materialize(
        marks.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *map(zero, ("own", "whole", "kept"))),
        "groups",
    )

    def in_shard(rows: pa.Table) -> pa.Table:
        tables = [("pair", _query(rows, PAIR_SQL)), ("term", _query(rows, TERM_SQL, top))]
        named = [t.append_column("part", pa.array([part] * t.num_rows, pa.string())) for part, t in tables]
        out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        return pa.concat_tables([t.select(out.names).cast(out) for t in named])

    schema = "lang string, source string, part string, item string, value long"
    # As many shards as the kept terms ask for: each gives a row for every pair of sources that meet in it.
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(max(1, -(-cells.count() // SHARD_CELLS)))).alias("shard")
    shared = cells.join(groups, ["lang", "source"]).select(shard, "lang", "term", "source", "n", "own", "whole", "kept")
    partial = materialize(shared.groupBy("shard").applyInArrow(in_shard, schema), "partial")

    # Terms that one source has, by a histogram of its counts, against the other's absent ones; salted, as languages are few.
    salts = shuffle_partitions(spark)
    by_count = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(groups, ["lang", "source"])
    absent = F.expr(f"cast({_share('0', 'own')} as bigint)").alias("absent")
    single = by_count.select("lang", "source", "n", "terms", F.expr(f"cast({_share('n', 'own')} as bigint)").alias("p"), absent)
    # A language's terms that are nobody's: one row of all kept terms for each source.
    none = groups.where("kept > 0").select("lang", "source", F.lit(None).cast("long").alias("n"), F.col("kept").alias("terms"), F.lit(0).cast("long").alias("p"), absent)
    dealt = single.unionByName(none).withColumn("salt", F.pmod(F.xxhash64("source", "n"), F.lit(salts)).cast("int"))
    others = groups.where("kept > 0").select("lang", F.col("source").alias("item"), absent.alias("other")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    one_way = dealt.join(others, ["lang", "salt"]).where("source <> item").select(
        "lang",
        "source",
        "item",
        F.expr(f"terms * if(n is null, {_difference('absent', 'other')}, {_difference('p', 'other')} - {_difference('absent', 'other')})").alias("value"),
        F.col("n").isNull().alias("base"),
    ).groupBy("lang", "source", "item", "base").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = partial.where("part = 'pair'").select("lang", "source", "item", "value")
    columns = ["lang", "source", "item", "value"]
    bare = groups.where("kept = 0").select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    parts = [
        both,
        turned(both),
        one_way.select(*columns),
        turned(one_way.where("not base")),
        bare.withColumn("value", F.lit(0).cast("long")),
    ]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part.select(*columns))
    summed = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = partial.where("part = 'term'")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")
    return ranked(summed).unionByName(ranked(terms).where(F.col("rank") <= top))
