"""Queries over the driver's tables for the operators of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.functions.bounds import MOST_TEXTS, few
from pathloom.operators import (
    audit,
    compare,
    corpus_audit,
    draws,
    intervals,
    lines,
    metrics,
    model,
    pairs,
    reconcile,
    release,
    resample,
    responses,
    scoring,
    training,
    transitions,
    trees,
)
from pathloom.plans import seeded
from pathloom.plans.registry import Query
from pathloom.sources import readers, tables
from pathloom.sources.scratch import written

# -- SQL shared by the oracles; "=>" stands before the final query ---------------------------------------------

FIX = """WITH RECURSIVE fix AS (
    SELECT CAST(user_id AS VARCHAR) AS subject_id, 'T:' || CAST(k % 10 AS VARCHAR) AS text_id,
           CAST(floor(value) AS BIGINT) % 24 AS word_index,
           row_number() OVER (PARTITION BY user_id, k % 10 ORDER BY ts, event_id) AS fixation_order,
           value * 10 AS duration_ms, (CAST(floor(value) AS BIGINT) % 24) // 8 AS line_id
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
TR = (
    FIX
    + """, tr AS (
    SELECT subject_id, text_id, src_word, dst_word, fixation_order, next_order, duration_ms, next_duration,
           CASE WHEN src_word = dst_word THEN 'refixation' WHEN next_line > line_id THEN 'line_return'
                WHEN dst_word > src_word THEN 'forward' ELSE 'regression' END AS event_type
    FROM (SELECT *, word_index AS src_word, lead(word_index) OVER w AS dst_word, lead(line_id) OVER w AS next_line,
                 lead(fixation_order) OVER w AS next_order, lead(duration_ms) OVER w AS next_duration
          FROM fix WINDOW w AS (PARTITION BY subject_id, text_id ORDER BY fixation_order))
    WHERE dst_word IS NOT NULL
), edges AS (
    SELECT subject_id, text_id, src_word, dst_word, CAST(count(*) AS DOUBLE) AS n
    FROM tr WHERE event_type = 'forward' GROUP BY ALL
)"""
)
WORDS = (
    TR
    + """, bare AS (
    SELECT text_id, word_index, ln(1 + word_index % 7) AS log_length, CAST((word_index * 5) % 9 - 4 AS DOUBLE) AS cloze_logit,
           word_index % 9 = 0 AS cloze_missing, word_index % 12 = 11 AS punct, 1 + word_index // 12 AS sentence,
           3 + ((word_index * 7) % 11) / 10.0 AS zipf, word_index % 10 = 0 AS oov,
           (word_index // 12) * 12 + (word_index % 12) // 2 AS head, word_index // 8 AS line
    FROM (SELECT DISTINCT text_id, word_index FROM fix)
), broken AS (
    SELECT DISTINCT a.text_id, a.sentence FROM bare a LEFT JOIN bare b ON a.text_id = b.text_id AND a.sentence = b.sentence AND a.head = b.word_index
    WHERE b.word_index IS NULL
), words AS (
    SELECT bare.*, broken.sentence IS NOT NULL AS missing,
           row_number() OVER (PARTITION BY bare.text_id, bare.sentence ORDER BY word_index) - 1 AS ordinal,
           count(*) OVER (PARTITION BY bare.text_id, bare.sentence) AS n
    FROM bare LEFT JOIN broken ON bare.text_id = broken.text_id AND bare.sentence = broken.sentence
)"""
)
#: Pairs of a line with their distances and counts, without other features.
BARE_COUNTED = (
    WORDS
    + """, line_pairs AS (
    SELECT s.text_id, s.word_index AS src_word, d.word_index AS dst_word, ln(1 + d.word_index - s.word_index) AS ld
    FROM words s JOIN words d ON s.text_id = d.text_id AND s.sentence = d.sentence AND s.line = d.line AND d.word_index > s.word_index
), sums AS (
    SELECT text_id, src_word, dst_word, sum(n) AS n FROM edges GROUP BY ALL
), counted AS (
    SELECT p.*, coalesce(e.n, 0) AS y FROM line_pairs p LEFT JOIN sums e USING (text_id, src_word, dst_word)
)"""
)
WORDS = (
    WORDS
    + """, up(text_id, sentence, word_index, anc, depth) AS (
    SELECT text_id, sentence, word_index, word_index, 0 FROM words
    UNION ALL
    SELECT up.text_id, up.sentence, up.word_index, w.head, depth + 1
    FROM up JOIN words w ON w.text_id = up.text_id AND w.word_index = up.anc AND w.sentence = up.sentence
    WHERE w.head <> up.anc
), tree AS (
    SELECT a.text_id, a.word_index AS src, b.word_index AS dst, min(a.depth + b.depth) AS steps
    FROM up a JOIN up b ON a.text_id = b.text_id AND a.sentence = b.sentence AND a.anc = b.anc GROUP BY ALL
), line_pairs AS (
    SELECT s.text_id, s.word_index AS src_word, d.word_index AS dst_word, ln(1 + d.word_index - s.word_index) AS ld,
           CAST(d.word_index - s.word_index = 1 AS DOUBLE) AS adjacent, d.ordinal / greatest(1, d.n - 1) AS relative,
           CAST(d.ordinal < 2 AS DOUBLE) AS first2, CAST(d.ordinal >= d.n - 2 AS DOUBLE) AS last2, d.log_length, d.zipf,
           CAST(d.oov AS DOUBLE) AS oov, CAST(d.punct AS DOUBLE) AS punct, CAST(d.head = s.word_index AS DOUBLE) AS sh,
           CAST(s.head = d.word_index AS DOUBLE) AS dh, CASE WHEN s.missing OR d.missing THEN 0 ELSE t.steps END AS steps
    FROM words s JOIN words d ON s.text_id = d.text_id AND s.sentence = d.sentence AND s.line = d.line AND d.word_index > s.word_index
    LEFT JOIN tree t ON t.text_id = s.text_id AND t.src = s.word_index AND t.dst = d.word_index
), counted AS (
    SELECT p.*, coalesce(e.n, 0) AS y
    FROM line_pairs p LEFT JOIN (SELECT text_id, src_word, dst_word, sum(n) AS n FROM edges GROUP BY ALL) e USING (text_id, src_word, dst_word)
)"""
)
SCORED = (
    WORDS
    + """, raw_scores AS (
    SELECT *, -1.1 * ld + 0.4 * adjacent - 0.3 * log_length + 0.2 * relative AS s
FROM counted

), scored AS (

    SELECT *, exp(s - top) / sum(exp(s - top)) OVER g AS p, sum(y) OVER g AS exposure, count(*) OVER g AS risk
FROM (SELECT *, max(s) OVER (PARTITION BY text_id, src_word) AS top
FROM raw_scores)
WINDOW g AS (PARTITION BY text_id, src_word)

), resid AS (

    SELECT *, exposure * p AS expected,
           CASE WHEN risk >= 2 AND exposure * p * (1 - p) > 0 THEN (y - exposure * p) / sqrt(exposure * p * (1 - p)) END AS residual,
           CASE WHEN exposure * p <= 0 AND y > 0 THEN NULL
                ELSE sign(y - exposure * p) * sqrt(greatest(0, 2 * (CASE WHEN y > 0 AND exposure * p > 0 THEN y * ln(y / (exposure * p))
                ELSE 0 END - (y - exposure * p)))) END AS deviance,
           y - exposure * p AS deviation,
           CASE WHEN dst_word - src_word = 1 THEN 'adjacent' WHEN dst_word - src_word <= 3 THEN 'near_skip'
           ELSE 'far_same_line' END AS category
FROM scored

), cells AS (

    SELECT *, exposure >= 5 AND risk >= 2 AND residual IS NOT NULL AS reliable
FROM resid
)"""
)
#: Coefficients of the fixed-score queries, the same as in SCORED.
FIXED = {"log1p_abs_distance": -1.1, "adjacent": 0.4, "target_log_length": -0.3, "target_relative_position": 0.2}
HALVES = (
    SCORED
    + """, half_counts AS (
    SELECT h.half, p.text_id, p.src_word, p.dst_word, p.p, coalesce(e.n, 0) AS y
FROM scored p CROSS JOIN (VALUES (0), (1)) h(half)
LEFT JOIN (SELECT CAST(subject_id AS BIGINT) % 2 AS half, text_id, src_word, dst_word, sum(n) AS n
FROM edges
GROUP BY ALL) e
      ON e.half = h.half AND e.text_id = p.text_id AND e.src_word = p.src_word AND e.dst_word = p.dst_word

), half_cells AS (

    SELECT *, CASE WHEN risk >= 2 AND e * (1 - p) > 0 THEN (y - e) / sqrt(e * (1 - p)) END AS residual
FROM (SELECT *, total * p AS e
FROM (SELECT *, sum(y) OVER g AS total, count(*) OVER g AS risk
FROM half_counts
WINDOW g AS (PARTITION BY half, text_id, src_word)))

), met AS (

    SELECT a.text_id, a.src_word, a.dst_word, a.residual AS x, b.residual AS y, least(a.total, b.total) AS exposure
FROM half_cells a JOIN half_cells b USING (text_id, src_word, dst_word)
WHERE a.half = 0 AND b.half = 1 AND a.residual IS NOT NULL AND b.residual IS NOT NULL AND a.total >= 5 AND b.total >= 5
)"""
)


def corr_sql(table: str, keys: str, x: str = "x", y: str = "y", w: str = "1.0") -> str:
    """Weighted correlation by keys, NULL where it is undefined."""
    on = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    pick = f"{keys}, " if keys else ""
    return f"""SELECT {pick}any_value(n) AS n, CASE WHEN any_value(n) >= 2 AND any_value(vx) AND any_value(vy)
        AND sum(_w * (_x - mx) * (_x - mx)) * sum(_w * (_y - my) * (_y - my)) > 0
        THEN sum(_w * (_x - mx) * (_y - my)) / sqrt(sum(_w * (_x - mx) * (_x - mx)) * sum(_w * (_y - my) * (_y - my))) END AS r
    FROM (SELECT {pick}{x} AS _x, {y} AS _y, {w} AS _w FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
    JOIN (SELECT {pick}count(*) AS n, sum({w} * {x}) / sum({w}) AS mx, sum({w} * {y}) / sum({w}) AS my, max({x}) > min({x}) AS vx, max({y}) > min({y}) AS vy
          FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL {group}) {on} {group}"""


def metric_sql(table: str, keys: str) -> str:
    """``by_metric``: the three correlations of a table's x and y by (keys, text)."""
    by = f"{keys}text_id"
    return (
        f", sized AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY {by}, src_word) AS w FROM {table}), e AS ("
        + corr_sql(table, by)
        + "), q AS ("
        + corr_sql("sized", by, w="w")
        + "), o AS ("
        + corr_sql(table, f"{by}, src_word")
        + f"""), by_metric AS (
        SELECT {by}, 'edge_weighted' AS metric, r FROM e
        UNION ALL SELECT {by}, 'source_weighted', r FROM q
        UNION ALL SELECT {by}, 'fisher_equal', tanh(avg(CASE WHEN r IS NOT NULL THEN atanh(greatest(least(r, 1 - 1e-7), 1e-7 - 1)) END)) FROM o GROUP BY {by}
    )"""
    )


RUNS = """WITH cells AS (
    SELECT event_id % 5 AS seed, CASE event_id % 4 WHEN 0 THEN 'mlm' WHEN 1 THEN 'gaze' WHEN 2 THEN 'shuffled'
           ELSE 'position' END AS condition,
           'T:' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS text_id, value
FROM events

), runs AS (

    SELECT seed, condition, text_id, CASE WHEN count(*) % 7 = 0 THEN NULL
           ELSE (CAST(sum(CAST(floor(value) AS BIGINT)) % 199 AS DOUBLE) - 99) / 100 END AS correlation,
           count(*) AS n_edges, avg(value) / 20 AS mlm_nll, count(*) * 3 AS mlm_tokens
FROM cells
GROUP BY ALL
)"""


def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of seed runs."""
    e = tables.table(spark, sf_dir, "events")
    rest = F.col("event_id") % 4
    k = F.get_json_object("props", "$.k").cast("int")
    cells = e.select(
        (F.col("event_id") % 5).alias("seed"),
        F.when(rest == 0, "mlm").when(rest == 1, "gaze").when(rest == 2, "shuffled").otherwise("position").alias("condition"),
        F.concat(F.lit("T:"), (k % 10).cast("string")).alias("text_id"),
        "value",
    )
    r = ((F.sum(F.floor("value")) % 199).cast("double") - 99) / 100
    n = F.count(F.lit(1))
    return cells.groupBy("seed", "condition", "text_id").agg(
        F.when(n % 7 != 0, r).alias("correlation"),
        n.alias("n_edges"),
        (F.avg("value") / 20).alias("mlm_nll"),
        (n * 3).alias("mlm_tokens"),
    )


# -- inputs of the queries ---------------------------------------------------------------------------------------


def _events(spark, sf, **options) -> DataFrame:
    return transitions.extract_events(tables.fixations(spark, sf), **options)


def _words(spark, sf) -> DataFrame:
    return tables.words(tables.fixations(spark, sf))


def _design(spark, sf, feature_set: str = "syntax") -> DataFrame:
    design = pairs.build_pairs(_words(spark, sf), "forward_same_line", feature_set)
    edges = transitions.subject_edges(_events(spark, sf)).groupBy(*model.KEYS).agg(F.sum("count").alias("count"))
    return transitions.count_vector(design, edges)


def _scored(spark, sf) -> DataFrame:
    return model.with_probability(_design(spark, sf).withColumn("score", model.linear_score(FIXED)))


def _cells(spark, sf) -> DataFrame:
    return transitions.with_separation(model.residuals(_scored(spark, sf)))


def _half_cells(spark, sf) -> DataFrame:
    half = F.pmod(F.col("subject_id").cast("bigint"), F.lit(2)).cast("int")
    edges = transitions.subject_edges(_events(spark, sf)).groupBy(half.alias("half"), *model.KEYS).agg(F.sum("count").alias("count"))
    scored = _scored(spark, sf).drop("count").crossJoin(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("half"))))
    counted = scored.join(edges, ["half", *model.KEYS], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    return model.residuals(counted, ["half"])


def _met(spark, sf) -> DataFrame:
    cells = _half_cells(spark, sf)
    return metrics.paired_halves(cells.where("half = 0"), cells.where("half = 1"))


def _parity_draws(spark, sf, draws: int = 3) -> DataFrame:
    subjects = _events(spark, sf).select("subject_id").distinct()
    return subjects.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "subject_id").withColumn(
        "half",
        F.pmod(F.floor(F.col("subject_id").cast("bigint") / F.pow(F.lit(2), F.col("draw"))), F.lit(2)).cast("int"),
    ).withColumn("mult", F.lit(1))


def _forward(spark, sf) -> DataFrame:
    return transitions.subject_edges(_events(spark, sf))


def fixation_violations(spark, sf):
    """The rules on visits with faults put in: negative words, bad durations, repeated orders, moved lines."""
    v = tables.fixations(spark, sf)
    faulty = v.select(
        "subject_id",
        "text_id",
        (F.col("word_index") - F.when(F.col("fixation_order") % 17 == 0, 100).otherwise(0)).alias("word_index"),
        (F.col("fixation_order") - F.when(F.col("fixation_order") % 13 == 0, 1).otherwise(0)).alias("fixation_order"),
        F.when(F.col("fixation_order") % 11 == 0, F.lit(-1.0)).otherwise(F.col("duration_ms")).alias("duration_ms"),
        F.when((F.col("fixation_order") % 29 == 0) & (F.col("word_index") == 3), F.lit(2)).otherwise(F.col("line_id")).alias("line_id"),
    )
    return readers.violations(faulty)


def etl_exclusions(spark, sf):
    """Events as a fixation report with faulty rows, counted by the first reason that applies."""
    e = tables.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    id_ = F.col("event_id")
    reason = readers.exclusion_reason(
        {
            "missing_trial": id_ % 31 == 0,
            "page_mismatch": F.col("k") % 7 == 6,
            "outside": id_ % 5 == 0,
            "unmapped_area": F.col("value") > 45,
            "missing_line": F.floor("value") % 24 == 23,
            "bad_number": F.when(id_ % 19 == 0, F.lit("x")).otherwise(F.lit("1")).try_cast("double").isNull(),
        }
    )
    return e.groupBy(F.coalesce(reason, F.lit("written")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def line_clusters(spark, sf):
    items = tables.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("double").alias("top"),
        (F.col("l_quantity").cast("double") + 5).alias("bottom"),
    )
    return intervals.cluster_intervals(items, ["l_orderkey"]).groupBy("l_orderkey", "line_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("top").alias("low"),
        F.max("bottom").alias("high"),
    )


def consensus_mode(spark, sf):
    items = tables.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    return intervals.consensus_bounds(items, ["l_suppkey"], ["l_returnflag", "l_linestatus"]).select(
        "l_suppkey",
        "variants",
        "observations",
        "accepted",
        F.when(F.col("accepted"), F.col("l_returnflag")).alias("flag"),
    )


def functional_dependency(spark, sf):
    orders = tables.table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("bucket"), "o_orderstatus")
    return readers.functional_map(orders, "bucket", "o_orderstatus").select("bucket", "o_orderstatus", "consistent")


def word_metadata(spark, sf):
    tokens = pairs.word_tokens(
        tables.table(spark, sf, "conversations").select(
            F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"),
            "text",
        )
    )
    lexicon = pairs.corpus_lexicon(tokens.select("surface"))
    return pairs.with_frequencies(tokens, lexicon).select(
        "text_id",
        "word_index",
        "surface",
        "length",
        "terminal_punctuation",
        "sentence_number",
        "zipf_frequency",
    )


def sentence_fill(spark, sf):
    w = _words(spark, sf)
    return pairs.fill_sentences(
        w.withColumn("sentence_number", F.when(F.col("word_index") % 5 != 2, F.col("sentence_number")))
    ).select("text_id", "word_index", "sentence_number")


def tree_distances(spark, sf):
    w = trees.with_tree_labels(_words(spark, sf)).where("not syntax_missing").select("text_id", "sentence_number", "word_index", "depth", "chains")
    b = w.select("text_id", "sentence_number", *[F.col(c).alias(f"dst_{c}") for c in ("word_index", "depth", "chains")])
    return w.join(b, ["text_id", "sentence_number"]).select(
        "text_id",
        F.col("word_index").alias("src_word"),
        F.col("dst_word_index").alias("dst_word"),
        trees.tree_distance(F.col("depth"), F.col("chains"), F.col("dst_depth"), F.col("dst_chains")).alias("steps"),
    )


def risk_set_sizes(spark, sf):
    w = _words(spark, sf)
    parts = [
        pairs.build_pairs(w, r, "common_core").groupBy("text_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("src_word").alias("sources"),
        ).withColumn("risk_set", F.lit(r))
        for r in pairs.RISK_SETS
    ]
    return readers.concat_subjects(parts)


def verified_filter(spark, sf):
    events = _events(spark, sf)
    verified = _words(spark, sf).where(F.col("word_index") % 6 != 0).select("text_id", "word_index")
    verified = verified.unionByName(verified)  # a word that is listed twice is verified once
    return transitions.verified_only(events, verified)[1]


def sensitivity(spark, sf):
    design = _design(spark, sf)
    boxes = _words(spark, sf).select(
        "text_id",
        "word_index",
        (F.col("line_id") * 10 + F.col("word_index") % 3).cast("double").alias("top"),
        (F.col("line_id") * 10 + F.col("word_index") % 3 + 1).cast("double").alias("bottom"),
    )
    sizes = _words(spark, sf).groupBy("text_id").agg((F.max("word_index") + 1).alias("n_words"))
    return transitions.candidate_sensitivity(design, 3, sizes, boxes).groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("count").alias("mass"),
    )


def nll_gradient(spark, sf):
    return model.nll_and_gradient(_design(spark, sf), FIXED)


def fit_one_feature(spark, sf):
    return model.fit(_design(spark, sf).withColumn("_all", F.lit(0)), ("log1p_abs_distance",), ["_all"]).select("feature", "coefficient")


def fit_large_one_feature(spark, sf):
    design = _design(spark, sf).select(*model.KEYS, "log1p_abs_distance", "count").persist()
    try:
        beta = model.fit_large(design, ("log1p_abs_distance",))
    finally:
        design.unpersist()
    return spark.createDataFrame(list(beta.items()), "feature string, coefficient double")


def newton_sql(source: str, rounds: int = 10) -> str:
    """Newton steps of one-feature fits, one for each ``k`` of a table (k, text_id, src_word, ld, y), as a chain to ``fits`` (k, b)."""
    out = f", b0 AS (SELECT DISTINCT k, 0.0 AS b FROM {source})"
    for i in range(rounds):
        out += f"""
    , n{i} AS (
        SELECT k, b, ld, y, exp(b * ld) / sum(exp(b * ld)) OVER g AS p, sum(y) OVER g AS total,
               sum(exp(b * ld) * ld) OVER g / sum(exp(b * ld)) OVER g AS m
        FROM {source} JOIN b{i} USING (k)
        WINDOW g AS (PARTITION BY k, text_id, src_word)
    ), b{i + 1} AS (
        SELECT k, any_value(b) - (any_value(b) + sum(ld * (total * p - y))) / (1 + sum(total * p * (ld - m) * (ld - m))) AS b
        FROM n{i}
        GROUP BY k
    )"""
    return out + f", fits AS (SELECT * FROM b{rounds})"


FIT_SQL = (
    WORDS
    + ", every AS (SELECT 0 AS k, * FROM counted)"
    + newton_sql("every")
    + "\n=>\nSELECT 'log1p_abs_distance' AS feature, b AS coefficient FROM fits"
)


def residual_sql(scored: str, keys: str, exposure: int = 5, name: str = "") -> str:
    """``bundle`` (with a name before it): residuals and reliability of a table (keys, text_id, src_word, dst_word, y, p)."""
    return f""", {name}sized AS (
        SELECT *, sum(y) OVER g AS exposure, count(*) OVER g AS risk, sum(y) OVER g * p AS expected
        FROM {scored}
        WINDOW g AS (PARTITION BY {keys}text_id, src_word)
    ), {name}defined AS (
        SELECT *, CASE WHEN risk >= 2 AND expected * (1 - p) > 0 THEN (y - expected) / sqrt(expected * (1 - p)) END AS residual
        FROM {name}sized
    ), {name}bundle AS (
        SELECT *, exposure >= {exposure} AND risk >= 2 AND residual IS NOT NULL AS reliable
        FROM {name}defined
    )"""


def folds_sql() -> str:
    """Texts and their folds, as the published seed shuffles them."""
    rows = ", ".join(f"('{t}', {i})" for i, fold in enumerate(model.text_folds([f"T:{i}" for i in range(10)], 5)) for t in fold)
    return f", folds(text_id, fold) AS (VALUES {rows})"


CROSSFIT = (
    WORDS
    + folds_sql()
    + """, laid AS (SELECT held AS k, c.*
FROM counted c JOIN folds f USING (text_id), range(5) t(held)
WHERE f.fold <> held)"""
    + newton_sql("laid")
    + """, out_of_fold AS (
        SELECT c.*, exp(b * ld) / sum(exp(b * ld)) OVER (PARTITION BY c.text_id, src_word) AS p
        FROM counted c JOIN folds f USING (text_id) JOIN fits ON fits.k = f.fold
    )"""
    + residual_sql("out_of_fold", "")
)
SPLIT_TARGETS = (
    WORDS
    + """, held(k) AS (SELECT 'T:' || i FROM range(6) t(i) UNION ALL SELECT ''),
    laid AS (SELECT k, c.* FROM counted c, held WHERE CAST(split_part(c.text_id, ':', 2) AS INT) < 6 AND k <> c.text_id)"""
    + newton_sql("laid")
    + """, told AS (
        SELECT c.*, exp(b * ld) / sum(exp(b * ld)) OVER (PARTITION BY c.text_id, src_word) AS p
        FROM counted c JOIN fits ON fits.k = CASE WHEN CAST(split_part(c.text_id, ':', 2) AS INT) < 6 THEN c.text_id ELSE '' END
    )"""
    + residual_sql("told", "")
    + """, trained AS (SELECT * FROM bundle WHERE reliable AND CAST(split_part(text_id, ':', 2) AS INT) < 6),
    mid AS (SELECT quantile_cont(residual, 0.5) AS c FROM trained),
    dev AS (SELECT quantile_cont(abs(residual - c), 0.5) AS m FROM trained, mid)"""
)
HALF_FITS = (
    WORDS
    + folds_sql()
    + """, sides AS (
        SELECT DISTINCT draw, (CAST(subject_id AS BIGINT) // (2 ** draw)::BIGINT) % 2 AS half FROM edges, range(3) t(draw)
    ), part AS (
        SELECT draw, (CAST(subject_id AS BIGINT) // (2 ** draw)::BIGINT) % 2 AS half, text_id, src_word, dst_word, sum(n) AS n
        FROM edges, range(3) t(draw)
        GROUP BY ALL
    ), cells_of AS (
        SELECT draw, half, p.text_id, p.src_word, p.dst_word, p.ld, coalesce(e.n, 0) AS y
        FROM line_pairs p CROSS JOIN sides LEFT JOIN part e USING (draw, half, text_id, src_word, dst_word)
    ), laid AS (
        SELECT draw || ':' || half || ':' || held AS k, c.*
        FROM cells_of c JOIN folds f USING (text_id), range(5) t(held)
        WHERE f.fold <> held
    )"""
    + newton_sql("laid")
    + """, out_of_fold AS (
        SELECT c.*, exp(b * ld) / sum(exp(b * ld)) OVER (PARTITION BY draw, half, c.text_id, src_word) AS p
        FROM cells_of c JOIN folds f USING (text_id) JOIN fits ON fits.k = draw || ':' || half || ':' || f.fold
    )"""
    + residual_sql("out_of_fold", "draw, half, ")
)
TRANSPORT = (
    WORDS
    + """, side AS (SELECT CASE WHEN CAST(split_part(text_id, ':', 2) AS INT) < 4 THEN 'first' ELSE 'second' END AS k, *
FROM counted)"""
    + newton_sql("side")
    + """, told AS (
        SELECT f.k AS fitted, s.k AS scored, s.text_id, s.y, exp(b * ld) / sum(exp(b * ld)) OVER g AS p, count(*) OVER g AS risk
        FROM side s CROSS JOIN fits f
        WINDOW g AS (PARTITION BY f.k, s.text_id, s.src_word)
    ), by_text AS (
        SELECT fitted, scored, text_id, sum(-y * ln(p)) / sum(y) AS nll, sum(y * ln(risk)) / sum(y) AS uniform_nll
        FROM told
        GROUP BY ALL
        HAVING sum(y) > 0
    )"""
)


NAMES = pairs.feature_names("syntax", "forward_same_line")
ONE = ("log1p_abs_distance",)


def _folds(spark, n: int = 5) -> DataFrame:
    return model.folds_table(spark, [f"T:{i}" for i in range(10)], n)


def crossfit_cells(spark, sf):
    return model.crossfit_residuals(_design(spark, sf), NAMES, _folds(spark)).select(
        *model.KEYS,
        "count",
        "probability",
        "exposure",
        "expected",
        "residual",
        "deviance",
        "deviation",
        "reliable",
    )


def crossfit_score(spark, sf):
    return model.predictive_score(model.fit_predict_folds(_design(spark, sf), NAMES, _folds(spark)))


def specification_identity(spark, sf):
    design, folds, frames = _design(spark, sf, "flexible"), _folds(spark), []
    for spec in ("position_only", "lexical", "syntax", "flexible"):
        names = pairs.feature_names(spec, "forward_same_line")
        frames.append(
            model.crossfit_residuals(design, names, folds).where("reliable").select(*model.KEYS, "residual").withColumn("spec", F.lit(spec))
        )
    return metrics.identity(readers.concat_subjects(frames))


def robust_scale(spark, sf):
    return model.robust_targets(_cells(spark, sf)).where("reliable").select(*model.KEYS, "target")


def leave_text_out_targets(spark, sf):
    return model.split_targets(
        _design(spark, sf),
        NAMES,
        [f"T:{i}" for i in range(6)],
    ).select(*model.KEYS, "residual", "target", "reliable")


def identity_of_scores(spark, sf):
    """How residuals under distance alone go with those under all fixed coefficients."""
    design, frames = _design(spark, sf), []
    for spec, beta in (("distance", {"log1p_abs_distance": -1.1}), ("full", FIXED)):
        cells = model.residuals(model.with_probability(design.withColumn("score", model.linear_score(beta))))
        frames.append(cells.where("reliable").select(*model.KEYS, "residual").withColumn("spec", F.lit(spec)))
    return metrics.identity(readers.concat_subjects(frames))


def shared_nuisance(spark, sf, names: tuple[str, ...] = NAMES):
    """Reliability of halves whose residuals use the fit on both halves together."""
    pooled = model.fit_predict_folds(_design(spark, sf), names, _folds(spark)).select(*model.KEYS, "probability")
    half = F.pmod(F.col("subject_id").cast("bigint"), F.lit(2)).cast("int")
    edges = _forward(spark, sf).groupBy(half.alias("half"), *model.KEYS).agg(F.sum("count").alias("count"))
    both = pooled.crossJoin(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("half"))))  # two rows
    counted = both.join(edges, ["half", *model.KEYS], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    cells = model.residuals(counted, ["half"])
    return metrics.paired_metrics(metrics.paired_halves(cells.where("half = 0"), cells.where("half = 1")))


def split_half_draws(spark, sf):
    """Specification reliability over a hundred seeded halves: a fit for each (draw, half, fold)."""
    edges = _forward(spark, sf)
    halves = draws.half_draws(edges, 100, 20260711, by=())
    cells = audit.half_residuals(_design(spark, sf).drop("count"), edges, halves, NAMES, _folds(spark), 3)
    return audit.reliability_by_draw(cells)


def one_feature_halves(spark, sf):
    """Out-of-fold predictions of three draws' halves, with one feature."""
    predicted = model.crossfit_many(
        _design(spark, sf).drop("count"),
        transitions.half_edges(_forward(spark, sf), _parity_draws(spark, sf)),
        ONE,
        _folds(spark),
        ["draw", "half"],
        _parity_draws(spark, sf).select("draw", "half").distinct(),
    )
    return model.residuals(predicted, ["draw", "half"])


def numeric_splits(spark, sf):
    sizes = transitions.text_sizes(_events(spark, sf))
    return resample.split_half(_forward(spark, sf), _parity_draws(spark, sf), sizes)


def seeded_split_half(spark, sf):
    events = _events(spark, sf)
    return resample.split_half(
        _forward(spark, sf),
        draws.half_draws(events, 10, 20260711),
        transitions.text_sizes(events),
        correct=True,
    )


def hashed_split_half(spark, sf):
    events = _events(spark, sf)
    return resample.split_half(_forward(spark, sf), draws.half_draws(events, 4, 20260711), transitions.text_sizes(events))


def permuted_control(spark, sf):
    return resample.permute_destinations(_design(spark, sf), [], "count", 20260711)


def shuffled_labels(spark, sf):
    """Residuals as labels, shuffled among the destinations of their source."""
    return resample.permute_destinations(_cells(spark, sf).select(*model.KEYS, "residual"), [], "residual", 20260712)


def thinning(spark, sf):
    edges = transitions.with_separation(_forward(spark, sf).join(_design(spark, sf).select(*model.KEYS), model.KEYS))
    return resample.keep_probabilities(edges)


def thinned_mass(spark, sf):
    edges = transitions.with_separation(_forward(spark, sf).join(_design(spark, sf).select(*model.KEYS), model.KEYS))
    return resample.thin_categories(edges, 20260711).groupBy("category").agg(F.sum("count").alias("mass"), F.count(F.lit(1)).alias("edges"))


def thresholds_table(spark, sf):
    cells = _half_cells(spark, sf)
    return resample.eligibility(cells.where("half = 0"), cells.where("half = 1"), [1, 3, 5, 10])


def bootstrap_mean(spark, sf):
    contrast = compare.paired_contrast(runs_table(spark, sf), "gaze", "mlm")
    numbered = contrast.select(
        "difference",
        (F.row_number().over(Window.orderBy(*E.text_order(F.col("text_id")))) - 1).alias("pos"),
    )  # a few texts
    n = numbered.count()
    means = resample.drawn_means(numbered, resample.portable_draws(spark, 200, max(n, 1)), "pos", "difference")
    return means.agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg("mean").alias("mean"),
        E.quantile(F.col("mean"), 0.025).alias("low"),
        E.quantile(F.col("mean"), 0.975).alias("high"),
    )


def contrast_intervals(spark, sf):
    runs = runs_table(spark, sf)
    frames = [compare.paired_contrast(runs, "gaze", other).withColumn("other", F.lit(other)) for other in ("mlm", "shuffled", "position")]
    return draws.mean_interval(readers.concat_subjects(frames), ["other"], "difference", 2000, 20260712, sign_flips=True)


CONTRAST = (
    RUNS
    + """, contrast AS (
    SELECT text_id, bool_and(coalesce(a IS NOT NULL AND b IS NOT NULL AND least(an, bn) >= 4, false)) AS fine, count(*) AS seeds,
           min(least(an, bn)) AS min_edges,
           avg(CASE WHEN a IS NOT NULL THEN atanh(greatest(least(a, 1 - 1e-7), 1e-7 - 1)) END - CASE
           WHEN b IS NOT NULL THEN atanh(greatest(least(b, 1 - 1e-7), 1e-7 - 1)) END) AS difference,
           avg(a - b) AS raw_difference
FROM (SELECT seed, text_id, max(correlation) FILTER (WHERE condition = 'gaze') AS a, max(correlation) FILTER (WHERE condition = 'mlm') AS b,
                 max(n_edges) FILTER (WHERE condition = 'gaze') AS an, max(n_edges) FILTER (WHERE condition = 'mlm') AS bn
FROM runs
WHERE condition IN ('gaze', 'mlm')
GROUP BY seed, text_id)
GROUP BY text_id
HAVING fine
)"""
)


CONTRAST_CELLS = (
    RUNS
    + """, met AS (
    SELECT b.condition AS other, a.text_id, a.correlation AS x, b.correlation AS y, least(a.n_edges, b.n_edges) AS n,
           a.correlation IS NOT NULL AND b.correlation IS NOT NULL AS paired
FROM runs a JOIN runs b ON a.seed = b.seed AND a.text_id = b.text_id
WHERE a.condition = 'gaze' AND b.condition <> 'gaze'

), zs AS (

    SELECT *, CASE WHEN x IS NOT NULL THEN atanh(greatest(least(x, 1 - 1e-7), 1e-7 - 1)) END AS zx, CASE
           WHEN y IS NOT NULL THEN atanh(greatest(least(y, 1 - 1e-7), 1e-7 - 1)) END AS zy
FROM met

), contrast_cells AS (

    SELECT other, text_id, count(*) AS seeds, count(*) FILTER (WHERE paired) AS defined, min(n) AS min_edges, avg(zx - zy) AS difference,
           max(greatest(abs(x), abs(y))) FILTER (WHERE paired) AS max_r, max(greatest(abs(zx), abs(zy))) FILTER (WHERE paired) AS max_z,
           sum((abs(x) >= 0.99)::INT + (abs(y) >= 0.99)::INT) FILTER (WHERE paired) AS near_perfect
FROM zs
GROUP BY ALL
)"""
)


def _contrast(spark, sf):
    return compare.paired_contrast(runs_table(spark, sf), "gaze", "mlm")


def _repeats(spark, sf):
    return runs_table(spark, sf).where("condition = 'gaze'").select(
        F.col("seed").alias("repeat"),
        "text_id",
        F.col("correlation").alias("metric"),
    )


REPEATS = RUNS + """, repeats AS (SELECT seed AS repeat, text_id, correlation AS metric
FROM runs
WHERE condition = 'gaze')"""


def influential(spark, sf):
    r = _repeats(spark, sf)
    return compare.most_influential(compare.leave_one_text_out(r), compare.median_hierarchy(r, []))


def _corpus():
    """The first four texts are one corpus, the other six another."""
    return F.when(E.natural_number(F.col("text_id")) < 4, "first").otherwise("second")


def _two_corpora(spark, sf):
    return _design(spark, sf).withColumn("corpus", _corpus())


def coefficient_bootstrap(spark, sf, names: tuple[str, ...] = pairs.POSITION):
    d = _two_corpora(spark, sf)
    return corpus_audit.coefficient_audit(d.where("corpus = 'first'"), d.where("corpus = 'second'"), names, 1000, 20260711)


def transported(spark, sf):
    return _transported(spark, sf, pairs.POSITION)


def _transported(spark, sf, names: tuple[str, ...]):
    d = _two_corpora(spark, sf)
    a, b = d.where("corpus = 'first'"), d.where("corpus = 'second'")
    parts = [
        corpus_audit.transported_nll(x, y, names).withColumn("direction", F.lit(name))
        for x, y, name in ((a, b, "first_to_second"), (b, a, "second_to_first"), (a, a, "within_first"), (b, b, "within_second"))
    ]
    return readers.concat_subjects(parts)


def classified(spark, sf, names: tuple[str, ...] = corpus_audit.SUMMARIES):
    summaries = corpus_audit.text_summaries(_design(spark, sf)).withColumn("corpus", _corpus())
    return corpus_audit.domain_classifier(summaries, "corpus", "second", 500, 20260711, names=names)


def cross_corpus_audit(spark, sf):
    """All comparisons of two corpora at the published size, as (part, item, value): 1,000 resamples and 500 permutations."""
    d = _two_corpora(spark, sf)
    sides = [d.where(F.col("corpus") == c).drop("corpus") for c in ("first", "second")]
    found = audit.audit_corpora(*sides, NAMES, 1000, 500, 20260711)
    rows = lambda part, item, value: found[part].select(F.lit(part).alias("part"), item.alias("item"), value.alias("value"))
    feature = F.col("feature")
    within = [(name, model.crossfit_nll(side, NAMES, _folds(spark))) for name, side in zip(("within_first", "within_second"), sides)]
    found |= dict(within)
    parts = [rows("features", feature, F.col("smd")), rows("coefficients", feature, F.col("difference"))]
    parts += [rows(p, F.lit("nll"), F.col("nll")) for p in ("first_to_second", "second_to_first", "within_first", "within_second")]
    parts += [rows("classifier", F.lit(c), F.col(c)) for c in ("balanced_accuracy", "area", "p", "p_area")]
    return readers.concat_subjects(parts)


POOLED = """WITH s AS (
    SELECT CAST(label AS VARCHAR) AS text_id, vec_id % 20 - 1 AS word_index, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim
    FROM embeddings
), m AS (
    SELECT text_id, word_index, dim, avg(CAST(v AS DOUBLE)) AS v FROM s WHERE word_index >= 0 GROUP BY ALL
)"""


def _states(spark, sf):
    return tables.table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("text_id"),
        (F.col("vec_id") % 20 - 1).alias("word_index"),
        F.col("embedding").alias("state"),
    )


def pooled_words(spark, sf):
    pooled = scoring.word_pool(_states(spark, sf))
    return pooled.select(
        "text_id",
        "word_index",
        "n_tokens",
        F.element_at("state", 1).alias("first"),
        scoring.norm(F.col("state")).alias("norm"),
    )


def word_cosines(spark, sf):
    v = scoring.word_pool(_states(spark, sf))
    cells = v.select("text_id", F.col("word_index").alias("src_word")).join(
        v.select("text_id", F.col("word_index").alias("dst_word")),
        "text_id",
    ).where("dst_word > src_word and dst_word <= src_word + 2")
    return scoring.pair_scores(cells, v, scoring.cosine)


def head_scores(spark, sf):
    """Low-rank scores of neighbouring words, with a head of fixed small numbers."""
    import numpy as np

    r, d = np.arange(4)[:, None], np.arange(64)[None, :]
    source, target = ((r * 7 + d * 3) % 11 - 5) / 10, ((r * 5 + d * 2) % 13 - 6) / 10
    v = scoring.word_pool(_states(spark, sf))
    words = v.select("text_id", F.col("word_index").alias("src_word"))
    cells = words.join(v.select("text_id", F.col("word_index").alias("dst_word")), "text_id").where("dst_word = src_word + 1")
    return scoring.pair_scores(cells, v, lambda a, b: scoring.low_rank_score(a, b, source, target, 0.25))


def adapted_scores(spark, sf):
    """The same after a bottleneck adapter on the target's side."""
    import numpy as np

    rng = np.random.default_rng(3)
    source, target, down, up = (rng.standard_normal(shape) for shape in ((4, 64), (4, 64), (4, 64), (64, 4)))
    v = scoring.word_pool(_states(spark, sf))
    words = v.select("text_id", F.col("word_index").alias("src_word"))
    cells = words.join(v.select("text_id", F.col("word_index").alias("dst_word")), "text_id").where("dst_word = src_word + 1")
    return scoring.pair_scores(
        cells,
        v,
        lambda a, b: scoring.low_rank_score(a, scoring.bottleneck(b, down, up, rng.standard_normal(4)), source, target),
    )


def all_words(spark, sf):
    """Pooled words with a row for every word up to the twenty-second, tokens or none."""
    states = _states(spark, sf)
    sizes = states.select("text_id").distinct().withColumn("n_words", F.lit(22))
    return scoring.word_pool(states, "sum", sizes).select(
        "text_id",
        "word_index",
        "n_tokens",
        "valid",
        scoring.norm(F.col("state")).alias("norm"),
    )


def softmax_rows(spark, sf):
    e = tables.table(spark, sf, "events").select(
        (F.col("event_id") % 50).alias("row"),
        (F.col("event_id") / 50).cast("bigint").alias("col"),
        (F.col("value") / 10).alias("logit"),
        (F.col("event_id") % 3 != 0).alias("mask"),
    )
    return scoring.masked_softmax(e, ["row"])


def divergences(spark, sf):
    e = tables.table(spark, sf, "events").select(
        (F.col("event_id") % 50).alias("row"),
        F.col("value").alias("p"),
        ((F.col("event_id") * 7) % 13).cast("double").alias("q"),
        (F.col("event_id") % 50 != 7).alias("mask"),
    )
    return scoring.masked_jsd(e, ["row"])


def balanced_loss(spark, sf):
    return scoring.source_balanced_loss(
        _cells(spark, sf).where("residual is not null").withColumn("difference", F.col("residual") - 0.25),
        ["text_id"],
    )


def _turns(spark, sf) -> DataFrame:
    """Tokens of every turn, under the turn's own key and that of the turn after it."""
    turns = tables.table(spark, sf, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    key = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    named = turns.withColumn("_n", place).select(key(F.col("_n")).alias("text_id"), key(F.col("_n") + 1).alias("next_id"), "text")
    tokens = named.select("text_id", "next_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("position", "token"))
    return tokens.withColumn("token", reconcile.lexical_form(F.col("token")))


def token_alignment(spark, sf):
    """Every turn of a conversation aligned with the turn before it."""
    tokens = _turns(spark, sf)
    before = tokens.select(F.col("next_id").alias("text_id"), "position", "token")
    return reconcile.align_tokens(before, tokens.select("text_id", "position", "token"))


def token_reconciliation(spark, sf):
    return reconcile.reconciliation(token_alignment(spark, sf))


#: ``ops`` (text_id, op, a1, a2, b1, b2): every turn aligned with the one before, segments opened round by round.
ALIGNED = """WITH RECURSIVE turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_split_to_array(trim(text), '\\s+') AS words FROM conversations
), tokens AS (
    SELECT conv_id || ':' || n AS text_id, conv_id || ':' || (n + 1) AS next_id, unnest(range(len(words))) AS p,
           regexp_replace(lower(trim(unnest(words))), '[^a-z0-9]+', '', 'g') AS token
    FROM turns
), met AS (
    SELECT b.text_id, a.p AS i, b.p AS j FROM tokens a JOIN tokens b ON a.next_id = b.text_id AND a.token = b.token
), runs AS (
    SELECT text_id, min(i) AS i, min(j) AS j, count(*) AS k
    FROM (SELECT *, i - row_number() OVER (PARTITION BY text_id, i - j ORDER BY i) AS island FROM met)
    GROUP BY text_id, i - j, island
), open(text_id, a, b, i, j, k, bi, bj, bk) AS (
    SELECT text_id, 0, 0, i, j, k, first_value(i) OVER g, first_value(j) OVER g, first_value(k) OVER g
    FROM runs WINDOW g AS (PARTITION BY text_id ORDER BY k DESC, i, j)
    UNION ALL
    SELECT text_id, a, b, i, j, k, first_value(i) OVER g, first_value(j) OVER g, first_value(k) OVER g
    FROM (
        SELECT text_id, a, b, i, j, least(k, bi - i, bj - j) AS k FROM open
        UNION ALL
        SELECT text_id, bi + bk, bj + bk, i + greatest(bi + bk - i, bj + bk - j, 0), j + greatest(bi + bk - i, bj + bk - j, 0),
               k - greatest(bi + bk - i, bj + bk - j, 0)
        FROM open
    )
    WHERE k > 0
    WINDOW g AS (PARTITION BY text_id, a, b ORDER BY k DESC, i, j)
), blocks AS (
    SELECT DISTINCT text_id, bi AS i, bj AS j, bk AS k FROM open
    UNION ALL
    SELECT coalesce(x.text_id, y.text_id), coalesce(x.n, 0), coalesce(y.n, 0), 0
    FROM (SELECT next_id AS text_id, count(*) AS n FROM tokens GROUP BY ALL) x
    FULL JOIN (SELECT text_id, count(*) AS n FROM tokens GROUP BY ALL) y ON x.text_id = y.text_id
), placed AS (
    SELECT *, coalesce(lag(i + k) OVER g, 0) AS pi, coalesce(lag(j + k) OVER g, 0) AS pj
    FROM blocks WINDOW g AS (PARTITION BY text_id ORDER BY i, j, k DESC)
), ops AS (
    SELECT text_id, CASE WHEN i > pi AND j > pj THEN 'replace' WHEN i > pi THEN 'delete' ELSE 'insert' END AS op, pi AS a1, i AS a2, pj AS b1, j AS b2
    FROM placed WHERE i > pi OR j > pj
    UNION ALL
    SELECT text_id, 'equal', i, i + k, j, j + k FROM placed WHERE k > 0
)"""


def aligned_tokens(spark, sf):
    """How many tokens of either side the alignment covers: all of them."""
    rows = token_reconciliation(spark, sf)
    return rows.groupBy("text_id").agg(F.sum("first_tokens").alias("first_tokens"), F.sum("second_tokens").alias("second_tokens"))


def key_counts(spark, sf):
    orders = tables.table(spark, sf, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority")
    return reconcile.unique_counts(orders, "o_orderstatus", {"customers": ["o_custkey"], "pairs": ["o_custkey", "o_orderpriority"]})


def layout_agreement(spark, sf):
    """Layouts of three subjects; the last one's bounds are shifted in places and it lacks some words."""
    w, last = _words(spark, sf), F.col("subject_id") == "2"
    shift = F.when(last & (F.col("word_index") % 4 == 0), F.lit(1)).otherwise(F.lit(0))
    laid = w.crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("string").alias("subject_id"))))  # three rows
    seen = laid.where(~(last & (F.col("word_index") % 11 == 5)))
    return intervals.partition_agreement(
        seen.select(
            "subject_id",
            "text_id",
            "word_index",
            F.col("surface").alias("content"),
            (F.col("line_id") * 20 + shift).cast("double").alias("top"),
            (F.col("line_id") * 20 + 10).cast("double").alias("bottom"),
        )
    )


def line_map_audit(spark, sf):
    """Bounds of words that differ by one in places, mapped to lines."""
    v = tables.fixations(spark, sf)
    shift = (F.col("fixation_order") % 3 == 0).cast("int")
    top = (F.col("line_id") * 20 + shift).cast("double")
    observed = v.select("text_id", "word_index", top.alias("top"), (top + 10).alias("bottom"))
    return intervals.line_map(observed)[1]


def word_properties(spark, sf):
    """Parts as words: name, size as length and number of answers, its last digit as the share that match."""
    part = tables.table(spark, sf, "part")
    size = F.col("p_size")
    records = part.select(
        F.lit("t").alias("text_id"),
        F.col("p_partkey").alias("word_index"),
        F.concat(F.col("p_name"), F.when(size % 6 == 0, ".").otherwise("")).alias("surface"),
        F.when(size % 5 == 0, F.lit("NA")).otherwise(size.cast("string")).alias("length"),
        F.when(size % 9 == 0, F.lit("1.5")).otherwise((size % 10 / 10).cast("string")).alias("match_share"),
        F.when(size % 8 == 0, F.lit("0")).otherwise(size.cast("string")).alias("responses"),
        F.when(size % 4 == 0, F.lit(".")).otherwise((size % 4).cast("string")).alias("sentence_number"),
    )
    return pairs.word_properties(records)


def group_constant_flags(spark, sf):
    return pairs.group_constants(_design(spark, sf), NAMES)


def _elimination() -> str:
    """``e0`` .. ``e11``: what is left of each centred feature (d) of its squares (o) after the features before it, one after another."""
    columns = ("ld", "adjacent", "log_length", "zipf", "oov", "punct", "sh", "dh", "steps", "relative", "first2", "last2")
    sql = ", r0 AS (SELECT " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY text_id, src_word) AS c{i}" for i, c in enumerate(columns)) + " FROM counted)"
    sql += ", whole AS (SELECT " + ", ".join(f"sum(c{i} * c{i}) AS o{i}" for i in range(12)) + " FROM r0)"
    for i in range(12):
        later = range(i + 1, 12)
        dots = "".join(f", sum(c{i} * c{j}) AS t{j}" for j in later)
        sql += f", e{i} AS (SELECT any_value(o{i}) AS o{i}, sum(c{i} * c{i}) AS d{i}{dots} FROM r{i}, whole)"
        left = ", ".join([f"CASE WHEN d{i} > 1e-18 * o{i} THEN c{j} - c{i} * t{j} / d{i} ELSE c{j} END AS c{j}" for j in later] or ["1 AS done"])
        sql += f", r{i + 1} AS (SELECT {left} FROM r{i}, e{i})"
    return sql


def rank_of_design(spark, sf):
    return spark.createDataFrame([(len(NAMES), pairs.design_rank(_design(spark, sf), NAMES))], "features int, rank int")


def partitions(spark, sf):
    """All 462 partitions of twelve groups of readers, which hold every reader, on position features."""
    group = F.pmod(F.crc32("subject_id"), F.lit(12)).cast("string")
    edges = _forward(spark, sf).withColumn("subject_id", group)
    draws = resample.draws_table(spark, resample.anchored_partitions([str(i) for i in range(12)]))
    cells = audit.half_residuals(_design(spark, sf, "position_only").drop("count"), edges, draws, pairs.POSITION, _folds(spark), 1)
    return audit.partition_audit(cells)


def _condition_scores(spark, sf) -> DataFrame:
    """Scores of every candidate by four conditions and five seeds, from the words' numbers."""
    cells = _design(spark, sf, "position_only").select(*model.KEYS)
    names = F.array(
        *[
            F.struct(F.lit(c).alias("condition"), F.lit(m).alias("m"))
            for c, m in (("gaze", 3), ("mlm", 5), ("shuffled", 7), ("position", 11))
        ]
    )
    each = cells.withColumn("_c", F.explode(names)).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    score = (F.col("src_word") * F.col("_c.m") + F.col("dst_word") * 13 + F.col("seed") * 5) % 17
    return each.select(F.col("_c.condition").alias("condition"), "seed", *model.KEYS, score.cast("double").alias("score"))


MODEL_PAIRS = [("gaze", "mlm"), ("gaze", "shuffled"), ("gaze", "position")]


def criterion_contrasts(spark, sf):
    return audit.criterion_contrasts(_cells(spark, sf), _condition_scores(spark, sf), [], MODEL_PAIRS)


def reader_text_bootstrap(spark, sf, names: tuple[str, ...] = pairs.POSITION):
    """Two hundred draws of readers: residuals refitted, contrasts of conditions, texts resampled within each draw."""
    edges = _forward(spark, sf)
    readers_of = written(draws.reader_draws(edges.select("subject_id"), 200, 20260711), "reader-draws")
    cells = written(audit.half_residuals(_design(spark, sf, "position_only").drop("count"), edges, readers_of, names, _folds(spark), 3), "cells")
    found = audit.criterion_contrasts(cells, _condition_scores(spark, sf), ["draw"], MODEL_PAIRS)
    return audit.nested_bootstrap(found, ["contrast"], "difference", 200, 20260711)


def influence_report(spark, sf):
    contrasts = compare.text_contrasts(runs_table(spark, sf), "gaze", ["mlm", "shuffled", "position"])
    named = contrasts.select(F.col("other").alias("contrast"), "text_id", F.col("nll_difference").alias("difference"))
    return audit.text_influence(named, ["mlm", "shuffled", "position"], 1000, 20260711)


def flags(spark, sf):
    r = _repeats(spark, sf)
    return compare.change_flags(compare.leave_one_text_out(r), compare.median_hierarchy(r, []))


OTHERS = ["mlm", "shuffled", "position"]


def _contrast_cells(spark, sf) -> DataFrame:
    return compare.contrast_cells(runs_table(spark, sf), "gaze", OTHERS)


def threshold_intervals(spark, sf):
    """Intervals of the mean difference for each threshold and contrast, each with draws of its own; the lowest threshold's are the primary ones."""
    kept = compare.retained(_contrast_cells(spark, sf)).where("threshold > 4")
    higher = draws.mean_interval(kept, ["threshold", "other"], "difference", 100_000, 20260713)
    primary = contrast_intervals(spark, sf).withColumn("threshold", F.lit(4))
    return higher.unionByName(primary.select(*higher.columns))


def _gaze_runs(spark, sf, *conditions) -> DataFrame:
    rows = runs_table(spark, sf).where(F.col("condition").isin(*conditions))
    return rows.select("condition", F.col("seed").alias("repeat"), "text_id", F.col("correlation").alias("value"))


def fold_spread(spark, sf):
    fits = model.fold_fits(_design(spark, sf), ONE, _folds(spark))
    return metrics.coefficient_variability(fits, [])


def turn_pair_features(spark, sf):
    """Pairs of the words of each sentence of each turn, and how often one is read right after the other, summed up."""
    return lines.pair_sums(lines.token_lines(tables.turns(spark, sf)), pairs.POSITION)


def _laid_turns(spark, sf, half) -> DataFrame:
    """Lines of the turns, written once; a turn's steps count for one response, and conversations are dealt into folds."""
    conversation = F.split_part("text_id", F.lit(":"), F.lit(1)).cast("bigint")
    found = lines.token_lines(tables.turns(spark, sf))
    return written(found.withColumn("fold", (conversation % 3).cast("int")).withColumn("response", half.cast("int")), "turn-lines")


def turn_fit_one_feature(spark, sf):
    """A fit over a design that grows with the table, by rounds of sums."""
    laid = _laid_turns(spark, sf, F.lit(0)).withColumn("fold", F.lit(0))
    beta = responses.fit_responses(laid, 1, len(ONE), sources=lines.source_rows(ONE))
    return spark.createDataFrame(list(zip(ONE, beta[0, 0].tolist())), "feature string, coefficient double")


def turn_crossfit_one_feature(spark, sf):
    """Out-of-fold likelihood of the steps in even and in odd turns, with all fits' Newton rounds taken together."""
    turn = F.split_part("text_id", F.lit(":"), F.lit(2)).cast("bigint")
    laid, sources = _laid_turns(spark, sf, turn % 2), lines.source_rows(ONE)
    folds = sorted(r[0] for r in laid.select("fold").distinct().collect())  # folds are few
    if not folds:
        return spark.createDataFrame([], "half int, events double, nll double")
    place = F.create_map(*[F.lit(x) for pair in zip(folds, range(len(folds))) for x in pair])
    numbered = laid.withColumn("fold", F.element_at(place, F.col("fold"))).where("response in (0, 1)")
    beta = responses.fit_responses(numbered, 2, len(ONE), len(folds), sources=sources)
    found = responses.held_out_nll(numbered, beta, sources)
    return spark.createDataFrame([(half, *map(float, found[half])) for half in range(2)], "half int, events double, nll double")


TURNS = r"""WITH toks AS (
    SELECT conv_id || ':' || turn AS text_id, unnest(range(len(regexp_split_to_array(trim(text), '\s+')))) AS pos,
           unnest(regexp_split_to_array(trim(text), '\s+')) AS surface
    FROM conversations
), tokens AS (
    SELECT text_id, pos, min(pos) OVER (PARTITION BY text_id, lower(surface)) AS word,
           coalesce(sum(regexp_matches(surface, '[.!?]$')::INT) OVER (PARTITION BY text_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
    FROM toks
), words AS (
    SELECT text_id, word, line, row_number() OVER g - 1 AS ordinal, count(*) OVER (PARTITION BY text_id, line) AS n
    FROM tokens WHERE pos = word WINDOW g AS (PARTITION BY text_id, line ORDER BY word)
), steps AS (SELECT text_id, word AS src_word, lead(word) OVER (PARTITION BY text_id ORDER BY pos) AS dst_word FROM tokens
), read AS (SELECT text_id, src_word, dst_word, count(*) AS y FROM steps WHERE dst_word > src_word GROUP BY ALL
), counted AS (
    SELECT s.text_id, s.word AS src_word, d.word AS dst_word, ln(1 + d.word - s.word) AS ld, (d.word - s.word = 1)::INT AS adjacent,
           d.ordinal / greatest(1, d.n - 1) AS relative, (d.ordinal < 2)::INT AS first2, (d.ordinal >= d.n - 2)::INT AS last2, coalesce(r.y, 0) AS y
    FROM words s JOIN words d ON s.text_id = d.text_id AND s.line = d.line AND d.word > s.word
    LEFT JOIN read r ON r.text_id = s.text_id AND r.src_word = s.word AND r.dst_word = d.word
)"""


def trained_adapter(spark, sf):
    """Losses of an adapter and a head trained on the embeddings: tokens are vectors, words twenty to a text, edges neighbours."""
    import numpy as np

    rows = tables.table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("text_id"), "vec_id", F.col("embedding").cast("array<double>").alias("state")
    )
    word, index = (F.col("vec_id") % 20).cast("int"), F.col("vec_id").cast("int")
    tokens = rows.select("text_id", index.alias("token_index"), word.alias("word"), "state")
    masked = rows.select("text_id", (F.col("vec_id") % 8).cast("int").alias("variant"), index.alias("token_index"), (F.col("vec_id") % 7).cast("int").alias("label"), "state")
    words = tokens.select("text_id", "word").distinct()
    target = F.greatest(F.lit(-5.0), -F.ln(1 + F.col("dst") - F.col("src")))
    edges = words.withColumnRenamed("word", "src").join(words.withColumnRenamed("word", "dst"), "text_id").where("dst > src and dst <= src + 3")
    laid = training.lay_out(tokens, masked, edges.select("text_id", "src", "dst", target.alias("target")))
    texts = sorted(r["text_id"] for r in few(laid.select("text_id"), MOST_TEXTS, "texts"))
    width = rows.select(F.size("state")).first()[0]
    rng = np.random.default_rng(20260711)
    head, bias = rng.standard_normal((7, width)) / np.sqrt(width), np.zeros(7)
    _, curve = training.train(laid, texts, 8, 12, width, head, bias, 0.2, seed=20260711, at_once=len(texts))
    return spark.createDataFrame(curve, "step int, token_loss double, edge_loss double, norm double")


def _links(spark, sf) -> DataFrame:
    """Pages (p:id) link to names (n:word), and a name leads to the pages that have it in their title."""
    pages = tables.table(spark, sf, "pages")
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}]+", ""))
    page = F.concat(F.lit("p:"), F.col("page_id").cast("string"))
    named = lambda words: F.explode(F.transform(words, lambda w: F.concat(F.lit("n:"), bare(w))))
    out = pages.select(page.alias("source"), named(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    back = pages.select(named(F.split(F.regexp_extract("html", "<title>([^<]*)", 1), " ")).alias("source"), page.alias("target"))
    return out.unionByName(back).where("source <> 'n:' and target <> 'n:'")


def link_closure(spark, sf):
    """Pages that each host's first page reaches over links and titles."""
    first = tables.table(spark, sf, "pages").groupBy(F.regexp_extract("url", "https?://([^/]+)", 1)).agg(F.min("page_id").alias("page_id"))
    roots = first.select(F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("node"))
    return release.reachable(_links(spark, sf), roots).where("node like 'p:%'").select(F.expr("substring(node, 3)").cast("long").alias("page_id"), "depth")


def missing_links(spark, sf):
    """Links whose name no title has."""
    links = _links(spark, sf)
    return release.broken_links(links.where("source like 'p:%'").distinct(), links.where("source like 'n:%'").select(F.col("source").alias("node")))


#: Paths under these may be released, in the findings on pages; a page's limit in bytes.
PUBLIC, PAGE_BYTES = ["en/**", "de/*", "*/?", "# fr is not"], 20_000


def release_findings(spark, sf):
    """Pages as files: outside the public paths, too large, or with a secret."""
    path = F.regexp_extract("url", r"https?://[^/]+/([^?#]*)", 1)
    files = tables.table(spark, sf, "pages").select(path.alias("path"), F.col("html").alias("content"))
    return release.findings(files, PUBLIC, ["README.md"], max_bytes=PAGE_BYTES).groupBy("path", "finding").agg(F.count(F.lit(1)).alias("files"))


LINKS = r"""WITH RECURSIVE parts AS (
    SELECT 'p:' || page_id AS page, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS word, true AS link FROM pages
    UNION ALL
    SELECT 'p:' || page_id, unnest(string_split(regexp_extract(html, '<title>([^<]*)', 1), ' ')), false FROM pages
), named AS (SELECT page, 'n:' || lower(regexp_replace(word, '[^\p{L}]+', '', 'g')) AS name, link FROM parts
), links AS (
    SELECT DISTINCT CASE WHEN link THEN page ELSE name END AS source, CASE WHEN link THEN name ELSE page END AS target FROM named WHERE name <> 'n:'
)"""


def faulted_checks(spark, sf):
    """The rules on scored cells with faults put in: probabilities doubled, counts broken, residuals lost, words turned round."""
    c, n = F.col, F.pmod(F.col("src_word") * 7 + F.col("dst_word"), F.lit(11))
    cells = _cells(spark, sf).select(
        *model.KEYS,
        F.when(n == 1, c("probability") * 2 + 1).otherwise(c("probability")).alias("probability"),
        (c("count") + F.when(n == 2, 0.5).otherwise(0.0)).alias("count"),
        F.when(n != 3, c("residual")).alias("residual"),
        "reliable",
        F.when(n == 4, c("src_word")).otherwise(c("dst_word")).alias("to_word"),
        F.when(n == 5, F.lit(None)).otherwise(c("exposure")).alias("exposure"),
    )
    rules = {
        "cells": {
            "probability is one": c("probability").between(0, 1),
            "counts are whole": c("count") == F.floor("count"),
            "reliable is defined": ~c("reliable") | c("residual").isNotNull(),
            "forward": c("to_word") > c("src_word"),
            "exposure is known": c("exposure").isNotNull(),
            "keys are whole": c("text_id").isNotNull() & (c("src_word") >= 0),
        },
        "none": {"has rows": F.lit(True)},
    }
    return readers.failed_checks({"cells": cells, "none": cells.where("false")}, rules)


def result_checks(spark, sf):
    """Rules that results must meet; no row says that all hold."""
    total = Window.partitionBy("text_id", "src_word")
    cells = _cells(spark, sf).withColumn("mass", F.sum("probability").over(total)).withColumn("deviations", F.sum("deviation").over(total))
    halves = _half_cells(spark, sf).withColumn("total", F.sum("count").over(Window.partitionBy("half", *model.GROUP)))
    matrix = transitions.aggregate_transitions(_events(spark, sf))
    matrix = matrix.withColumn("mass", F.sum("probability").over(Window.partitionBy("text_id", "event_type", "src_word")))
    c = F.col
    unit = lambda x: x.between(0, 1)
    rules = {
        "cells": {
            "mass is 1": F.abs(c("mass") - 1) < 1e-9,
            "deviations cancel": F.abs(c("deviations")) < 1e-6,
            "probability is one": unit(c("probability")),
            "reliable is defined": ~c("reliable") | c("residual").isNotNull(),
            "reliable has events": ~c("reliable") | (c("exposure") >= 5),
            "reliable has a choice": ~c("reliable") | (c("risk_size") >= 2),
            "forward": c("dst_word") > c("src_word"),
            "counts are whole": c("count") == F.floor("count"),
            "signs agree": (F.signum("deviation") == F.signum("deviance")) | c("deviance").isNull(),
        },
        "events": {
            "known type": c("event_type").isin(*E.EVENT_TYPES),
            "refixations stay": (c("event_type") == "refixation") == (c("src_word") == c("dst_word")),
            "forward goes on": (c("event_type") != "forward") | (c("dst_word") > c("src_word")),
            "weight is 1": c("weight") == 1,
            "words are numbered": (c("src_word") >= 0) & (c("dst_word") >= 0),
        },
        "halves": {"a half": c("half").isin(0, 1), "exposure is the total": F.abs(c("exposure") - c("total")) < 1e-9},
        "matrix": {
            "rows add up": F.abs(c("mass") - 1) < 1e-9,
            "no empty cell": c("count") > 0,
            "probability is one": unit(c("probability")),
        },
    }
    return readers.failed_checks({"cells": cells, "events": _events(spark, sf), "halves": halves, "matrix": matrix}, rules)


SPECS: dict[str, Query] = {
    "partition_audit": Query(
        partitions,
        "metric partitions# n# median* q25* q75* negative_partitions* negative_share_median* undefined_share_median*",
    ),
    "reader_text_bootstrap": Query(reader_text_bootstrap, "contrast draws# mean* low* high* negative_share*"),
    "reader_text_bootstrap_one_feature": Query(
        lambda s, d: reader_text_bootstrap(s, d, ONE),
        "contrast draws# mean* low* high* negative_share*",
        BARE_COUNTED
        + folds_sql()
        + ", subj AS (SELECT DISTINCT subject_id FROM edges)"
        + seeded.picks("subj", "rd", (), 200, 20260711, "subject_id")
        + """, times AS (SELECT draw, subject_id, count(*) AS mult FROM rd JOIN rd_placed USING (i) GROUP BY ALL
    ), part AS (SELECT draw, text_id, src_word, dst_word, sum(n * mult) AS n FROM edges JOIN times USING (subject_id) GROUP BY ALL
    ), cells_of AS (
        SELECT draw, p.text_id, p.src_word, p.dst_word, p.ld, coalesce(e.n, 0) AS y
        FROM line_pairs p CROSS JOIN range(200) d(draw) LEFT JOIN part e USING (draw, text_id, src_word, dst_word)
    ), laid AS (SELECT draw || ':' || held AS k, c.* FROM cells_of c JOIN folds f USING (text_id), range(5) t(held) WHERE f.fold <> held)"""
        + newton_sql("laid")
        + """, out_of_fold AS (
        SELECT c.*, exp(b * ld) / sum(exp(b * ld)) OVER (PARTITION BY draw, c.text_id, src_word) AS p
        FROM cells_of c JOIN folds f USING (text_id) JOIN fits ON fits.k = draw || ':' || f.fold
    )"""
        + residual_sql("out_of_fold", "draw, ", 3)
        + """, scores AS (
        SELECT condition, seed, text_id, src_word, dst_word, CAST((src_word * m + dst_word * 13 + seed * 5) % 17 AS DOUBLE) AS y
        FROM line_pairs, (VALUES ('gaze', 3), ('mlm', 5), ('shuffled', 7), ('position', 11)) v(condition, m), range(5) t(seed)
    ), joined AS (
        SELECT c.draw, s.condition, s.seed, s.text_id, c.residual AS x, s.y
        FROM bundle c JOIN scores s ON s.text_id = c.text_id AND s.src_word = c.src_word AND s.dst_word = c.dst_word
        WHERE c.reliable
    ), each AS ("""
        + corr_sql("joined", "draw, condition, seed, text_id")
        + """), by_text AS (
        SELECT draw, condition, text_id, avg(CASE WHEN r IS NOT NULL THEN atanh(greatest(least(r, 1 - 1e-7), 1e-7 - 1)) END) AS z
        FROM each WHERE n >= 4
        GROUP BY ALL HAVING bool_and(r IS NOT NULL)
    ), found AS (
        SELECT 'gaze_vs_' || b.condition AS contrast, a.draw AS "outer", a.text_id, a.z - b.z AS difference
        FROM by_text a JOIN by_text b ON a.draw = b.draw AND a.text_id = b.text_id
        WHERE a.condition = 'gaze' AND b.condition <> 'gaze'
    )"""
        + seeded.means("found", "inner_means", ("contrast", '"outer"'), "difference", 200, 20260711)
        + """, outer_means AS (SELECT contrast, "outer", avg(difference) AS m FROM found GROUP BY ALL
    ), whole AS (SELECT contrast, count(*) AS draws, avg(m) AS mean FROM outer_means GROUP BY ALL
    ), spread AS (
        SELECT contrast, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m < 0)::INT) AS negative_share FROM inner_means GROUP BY ALL
    )
=>
SELECT * FROM whole JOIN spread USING (contrast)""",
    ),
    "criterion_contrasts": Query(
        criterion_contrasts,
        "contrast text_id difference*",
        SCORED
        + """, scores AS (
        SELECT condition, seed, text_id, src_word, dst_word, CAST((src_word * m + dst_word * 13 + seed * 5) % 17 AS DOUBLE) AS y
        FROM counted, (VALUES ('gaze', 3), ('mlm', 5), ('shuffled', 7), ('position', 11)) v(condition, m), range(5) t(seed)
    ), joined AS (
        SELECT s.condition, s.seed, s.text_id, c.residual AS x, s.y
        FROM cells c JOIN scores s ON s.text_id = c.text_id AND s.src_word = c.src_word AND s.dst_word = c.dst_word
        WHERE c.reliable
    ), each AS ("""
        + corr_sql("joined", "condition, seed, text_id")
        + """), by_text AS (
        SELECT condition, text_id, avg(CASE WHEN r IS NOT NULL THEN atanh(greatest(least(r, 1 - 1e-7), 1e-7 - 1)) END) AS z
        FROM each WHERE n >= 4
        GROUP BY ALL HAVING bool_and(r IS NOT NULL)
    )
=>
SELECT 'gaze_vs_' || b.condition AS contrast, text_id, a.z - b.z AS difference
FROM by_text a JOIN by_text b USING (text_id)
WHERE a.condition = 'gaze' AND b.condition <> 'gaze'""",
    ),
    "text_influence": Query(
        influence_report,
        "contrast deleted n# mean* low* high* flips",
        RUNS
        + """, b AS (SELECT condition, text_id, avg(mlm_nll) AS nll FROM runs GROUP BY ALL
    ), contrasts AS (
        SELECT b.condition AS contrast, b.text_id, a.nll - b.nll AS difference
        FROM b JOIN b a ON a.text_id = b.text_id AND a.condition = 'gaze' WHERE b.condition <> 'gaze' AND a.nll - b.nll IS NOT NULL
    ), enough AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY contrast) AS texts FROM contrasts) WHERE texts >= 3
    ), rest AS (SELECT a.contrast, d.text_id AS deleted, a.text_id, a.difference FROM enough a JOIN enough d ON a.contrast = d.contrast AND a.text_id <> d.text_id)"""
        + seeded.interval("enough", "whole", ("contrast",), "difference", 1000, 20260711)
        + seeded.interval("rest", "each", ("contrast", "deleted"), "difference", 1000, 20260711)
        + """
=>
SELECT e.contrast, e.deleted, e.n, e.mean, e.low, e.high, (e.low > 0 OR e.high < 0) <> (w.low > 0 OR w.high < 0) AS flips
FROM each e JOIN whole w USING (contrast)""",
    ),
    "result_checks": Query(
        result_checks,
        "result rule failures#",
        "\n=>\nSELECT 'x' AS result, 'x' AS rule, 0 AS failures WHERE false"),
    "turn_pair_features": Query(
        turn_pair_features,
        "text_id pairs# log1p_abs_distance* adjacent* target_relative_position* target_first2* target_last2* count*",
        TURNS + """
=>
SELECT text_id, count(*) AS pairs, sum(ld) AS log1p_abs_distance, sum(adjacent) AS adjacent, sum(relative) AS target_relative_position,
       sum(first2) AS target_first2, sum(last2) AS target_last2, sum(y) AS count
FROM counted GROUP BY text_id""",
    ),
    "turn_fit_one_feature": Query(
        turn_fit_one_feature,
        "feature coefficient*",
        TURNS + ", every AS (SELECT 0 AS k, text_id, src_word, ld, y FROM counted)" + newton_sql("every")
        + "\n=>\nSELECT 'log1p_abs_distance' AS feature, b AS coefficient FROM fits",
    ),
    "turn_crossfit_one_feature": Query(
        turn_crossfit_one_feature,
        "half# events* nll*",
        TURNS + """, halved AS (
        SELECT half, text_id, src_word, ld, CASE WHEN CAST(split_part(text_id, ':', 2) AS BIGINT) % 2 = half THEN y ELSE 0 END AS y,
               CAST(split_part(text_id, ':', 1) AS BIGINT) % 3 AS fold
        FROM counted, range(2) h(half)
    ), laid AS (SELECT half || ':' || held AS k, text_id, src_word, ld, y FROM halved, range(3) f(held) WHERE fold <> held)"""
        + newton_sql("laid")
        + """, told AS (
        SELECT half, y, exp(b * ld) / sum(exp(b * ld)) OVER (PARTITION BY half, text_id, src_word) AS p
        FROM halved JOIN fits ON k = half || ':' || fold
    )
=>
SELECT half, sum(y) AS events, sum(-y * ln(p)) AS nll FROM told GROUP BY half""",
    ),
    "trained_adapter": Query(trained_adapter, "step# token_loss* edge_loss* norm*"),
    "faulted_checks": Query(
        faulted_checks,
        "result rule failures#",
        SCORED
        + """, faults AS (SELECT *, (src_word * 7 + dst_word) % 11 AS f FROM cells
    ), counts AS (
        SELECT 'probability is one' AS rule, count(*) FILTER (WHERE f = 1) AS failures FROM faults
        UNION ALL SELECT 'counts are whole', count(*) FILTER (WHERE f = 2) FROM faults
        UNION ALL SELECT 'reliable is defined', count(*) FILTER (WHERE f = 3 AND reliable) FROM faults
        UNION ALL SELECT 'forward', count(*) FILTER (WHERE f = 4) FROM faults
        UNION ALL SELECT 'exposure is known', count(*) FILTER (WHERE f = 5) FROM faults
    )
=>
SELECT 'cells' AS result, rule, failures FROM counts WHERE failures > 0 UNION ALL SELECT 'none', 'has rows', 1""",
    ),
    "link_closure": Query(
        lambda s, d: link_closure(s, d).select("page_id"),
        "page_id#",
        LINKS + """, roots AS (SELECT 'p:' || min(page_id) AS node FROM pages GROUP BY regexp_extract(url, 'https?://([^/]+)', 1)
), reach(node) AS (
    SELECT node FROM roots UNION SELECT l.target FROM reach r JOIN links l ON l.source = r.node
)
=>
SELECT CAST(substr(node, 3) AS BIGINT) AS page_id FROM reach WHERE node LIKE 'p:%'""",
    ),
    "missing_links": Query(
        missing_links,
        "source target",
        LINKS + """
=>
SELECT source, target FROM links WHERE source LIKE 'p:%' AND target NOT IN (SELECT source FROM links)""",
    ),
    "release_findings": Query(
        release_findings,
        "path finding files#",
        """WITH files AS (SELECT regexp_extract(url, 'https?://[^/]+/([^?#]*)', 1) AS path, html FROM pages
), found AS (
    SELECT path, 'not declared public' AS finding FROM files WHERE NOT regexp_full_match(path, 'en/.*|de/[^/]*|[^/]*/[^/]')
    UNION ALL SELECT path, 'too large' FROM files WHERE strlen(html) > 20000
    UNION ALL SELECT path, 'possible private key' FROM files WHERE regexp_matches(html, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')
    UNION ALL SELECT path, 'possible GitHub token' FROM files WHERE regexp_matches(html, 'gh[pousr]_[A-Za-z0-9]{30,}')
    UNION ALL SELECT path, 'possible AWS access key' FROM files WHERE regexp_matches(html, 'AKIA[0-9A-Z]{16}')
    UNION ALL SELECT path, 'possible assigned secret' FROM files
    WHERE regexp_matches(html, '(?i)(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\\s*[:=]\\s*[''"][^''"\\s]{8,}[''"]')
    UNION ALL SELECT 'README.md', 'required file is missing'
)
=>
SELECT path, finding, count(*) AS files FROM found GROUP BY ALL""",
    ),
    "transition_events": Query(
        _events,
        "subject_id text_id src_word# dst_word# event_type weight*",
        TR + "\n=>\nSELECT subject_id, text_id, src_word, dst_word, event_type, 1.0 AS weight FROM tr",
    ),
    "event_weights": Query(
        lambda s, d: _events(s, d, weight="source_duration", include_self=False).groupBy("text_id", "event_type").agg(
            F.sum("weight").alias("weight"),
            F.count(F.lit(1)).alias("n"),
        ),
        "text_id event_type weight* n#",
        TR + """
=>
SELECT text_id, event_type, sum(duration_ms) AS weight, count(*) AS n
FROM tr
WHERE event_type <> 'refixation'
GROUP BY ALL""",
    ),
    "event_target_weights": Query(
        lambda s, d: _events(
            s,
            d,
            weight="target_duration",
            consecutive_only=True,
        ).groupBy("subject_id").agg(F.sum("weight").alias("weight")),
        "subject_id weight*",
        TR + """
=>
SELECT subject_id, sum(next_duration) AS weight
FROM tr
WHERE next_order = fixation_order + 1
GROUP BY ALL""",
    ),
    "transition_matrix_row": Query(
        lambda s, d: transitions.aggregate_transitions(_events(s, d)),
        "text_id event_type src_word# dst_word# count* probability*",
        TR + """
=>
SELECT text_id, event_type, src_word, dst_word, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY text_id, event_type,
       src_word) AS probability
FROM tr
GROUP BY text_id, event_type, src_word, dst_word""",
    ),
    "transition_matrix_global": Query(
        lambda s, d: transitions.aggregate_transitions(_events(s, d), "global"),
        "text_id event_type src_word# dst_word# count* probability*",
        TR + """
=>
SELECT text_id, event_type, src_word, dst_word, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY text_id,
       event_type) AS probability
FROM tr
GROUP BY text_id, event_type, src_word, dst_word""",
    ),
    "transition_matrix_dense": Query(lambda s, d: transitions.dense_matrix(
        transitions.aggregate_transitions(_events(s, d)).where("event_type = 'forward'"),
        transitions.text_sizes(_events(s, d)),
    ).groupBy("text_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("valid")).alias("valid"),
        F.sum("count").alias("mass"),
        F.count_if(F.col("count") > 0).alias("nonzero"),
    ), "text_id cells# valid# mass* nonzero#", TR + """, w AS (SELECT text_id, max(greatest(src_word, dst_word)) + 1 AS w
FROM tr
GROUP BY ALL
), f AS (
SELECT text_id, count(DISTINCT src_word) AS sources, count(*) AS mass, count(DISTINCT (src_word, dst_word)) AS nonzero
FROM tr
WHERE event_type = 'forward'
GROUP BY ALL)
=>
SELECT text_id, w * w AS cells, sources * w AS valid, mass, nonzero
FROM w JOIN f USING (text_id)"""),
    "text_sizes": Query(
        lambda s, d: transitions.text_sizes(_events(s, d)),
        "text_id n_words#",
        TR + "\n=>\nSELECT text_id, max(greatest(src_word, dst_word)) + 1 AS n_words FROM tr GROUP BY ALL",
    ),
    "subject_edges": Query(
        _forward,
        "subject_id text_id src_word# dst_word# count*",
        TR + "\n=>\nSELECT subject_id, text_id, src_word, dst_word, n AS count FROM edges",
    ),
    "edge_counts": Query(
        lambda s, d: transitions.edge_counts(_events(s, d)),
        "text_id src_word# dst_word# n#",
        TR + "\n=>\nSELECT text_id, src_word, dst_word, count(*) AS n FROM tr GROUP BY ALL",
    ),
    "half_edges": Query(
        lambda s, d: transitions.half_edges(_forward(s, d), _parity_draws(s, d)),
        "draw# half# text_id src_word# dst_word# count*",
        TR + """
=>
SELECT draw, (CAST(subject_id AS BIGINT) // (2 ** draw)::BIGINT) % 2 AS half, text_id, src_word, dst_word, sum(n) AS count
FROM edges, range(3) t(draw)
GROUP BY ALL""",
    ),
    "selected_events": Query(
        lambda s, d: transitions.select_events(
            _events(s, d),
            ["regression", "line_return"],
            s.createDataFrame([("T:1",), ("T:4",)], "text_id string"),
        ).groupBy("text_id", "event_type").agg(F.count(F.lit(1)).alias("n")),
        "text_id event_type n#",
        TR + """
=>
SELECT text_id, event_type, count(*) AS n
FROM tr
WHERE event_type IN ('regression', 'line_return') AND text_id IN ('T:1', 'T:4')
GROUP BY ALL""",
    ),
    "fixation_violations": Query(
        fixation_violations,
        "rule n#",
        FIX + """, bad AS (SELECT subject_id, text_id, word_index - CASE WHEN fixation_order % 17 = 0 THEN 100 ELSE 0 END AS w, fixation_order - CASE
       WHEN fixation_order % 13 = 0 THEN 1 ELSE 0 END AS o, CASE WHEN fixation_order % 11 = 0 THEN -1 ELSE duration_ms END AS dur, CASE
       WHEN fixation_order % 29 = 0 AND word_index = 3 THEN 2 ELSE line_id END AS line
FROM fix)
=>
SELECT 'negative_word' AS rule, count(*) FILTER (WHERE w < 0) AS n
FROM bad
UNION ALL SELECT 'bad_duration', count(*) FILTER (WHERE dur < 0)
FROM bad
UNION ALL SELECT 'repeated_order', count(*)
FROM (SELECT 1
FROM bad
GROUP BY subject_id, text_id, o
HAVING count(*) > 1)
UNION ALL SELECT 'several_lines', count(*)
FROM (SELECT 1
FROM bad
GROUP BY text_id, w
HAVING min(line) <> max(line))"""),
    "etl_exclusions": Query(
        etl_exclusions,
        "reason n#",
        """
=>
SELECT CASE WHEN event_id % 31 = 0 THEN 'missing_trial' WHEN k % 7 = 6 THEN 'page_mismatch' WHEN event_id % 5 = 0 THEN 'outside'
       WHEN value > 45 THEN 'unmapped_area' WHEN CAST(floor(value) AS BIGINT) % 24 = 23 THEN 'missing_line'
       WHEN event_id % 19 = 0 THEN 'bad_number' ELSE 'written' END AS reason, count(*) AS n
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events)
GROUP BY ALL"""),
    "line_clusters": Query(
        line_clusters,
        "l_orderkey# line_id# n# low* high*",
        """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS top, CAST(l_quantity AS DOUBLE) + 5 AS bottom
FROM lineitem
), b AS (
SELECT *, CASE WHEN top < max(bottom) OVER (PARTITION BY l_orderkey
ORDER BY top, bottom, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins
FROM a
), c AS (
SELECT *, sum(begins) OVER (PARTITION BY l_orderkey
ORDER BY top, bottom, l_linenumber ROWS UNBOUNDED PRECEDING) - 1 AS line_id
FROM b)
=>
SELECT l_orderkey, line_id, count(*) AS n, min(top) AS low, max(bottom) AS high
FROM c
GROUP BY ALL"""),
    "consensus_mode": Query(
        consensus_mode,
        "l_suppkey# variants# observations# accepted flag",
        """WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n
FROM lineitem
GROUP BY ALL
), r AS (
SELECT *, row_number() OVER (PARTITION BY l_suppkey
ORDER BY n DESC, l_returnflag, l_linestatus) AS rank, sum(n) OVER (PARTITION BY l_suppkey) AS observations,
       count(*) OVER (PARTITION BY l_suppkey) AS variants
FROM c)
=>
SELECT l_suppkey, variants, observations, variants = 1 OR 2 * n > observations AS accepted, CASE
       WHEN variants = 1 OR 2 * n > observations THEN l_returnflag END AS flag
FROM r
WHERE rank = 1"""),
    "functional_dependency": Query(
        functional_dependency,
        "bucket# o_orderstatus consistent",
        """
=>
SELECT o_orderkey % 100 AS bucket, min(o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus) = 1 AS consistent
FROM orders
GROUP BY ALL""",
    ),
    "word_metadata": Query(
        word_metadata,
        "text_id word_index# surface length# terminal_punctuation sentence_number# zipf_frequency*",
        r"""WITH t AS (SELECT text_id, unnest(list) AS surface, unnest(range(len(list))) AS word_index
FROM (SELECT conv_id || ':' || turn AS text_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS list
FROM conversations)
), u AS (
SELECT *, regexp_matches(surface, '[.!?]["'')\]]*$') AS e
FROM t
WHERE surface <> ''
), z AS (
SELECT surface, log10(1e9 * count(*) / sum(count(*)) OVER ()) AS zipf_frequency
FROM u
GROUP BY surface)
=>
SELECT text_id, word_index, surface, greatest(1, length(regexp_replace(surface, '[^A-Za-z0-9'']', '', 'g'))) AS length,
       e AS terminal_punctuation, 1 + coalesce(sum(e::INT) OVER (PARTITION BY text_id
ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence_number, zipf_frequency
FROM u JOIN z USING (surface)"""),
    "sentence_fill": Query(
        sentence_fill,
        "text_id word_index# sentence_number#",
        WORDS + """, s AS (SELECT text_id, word_index, punct, CASE WHEN word_index % 5 <> 2 THEN sentence END AS q
FROM words
), l AS (
SELECT *, lag(q) OVER w AS pq, lag(punct) OVER w AS pp, first_value(q IGNORE NULLS) OVER (PARTITION BY text_id
ORDER BY word_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nq
FROM s
WINDOW w AS (PARTITION BY text_id
ORDER BY word_index))
=>
SELECT text_id, word_index, coalesce(q, CASE WHEN pq IS NOT NULL AND NOT coalesce(pp, false) THEN pq END, nq, pq) AS sentence_number
FROM l"""),
    "tree_distance": Query(
        tree_distances,
        "text_id src_word# dst_word# steps#",
        WORDS + """
=>
SELECT t.text_id, t.src AS src_word, t.dst AS dst_word, t.steps
FROM tree t JOIN words w ON w.text_id = t.text_id AND w.word_index = t.src
WHERE NOT w.missing""",
    ),
    "pair_features_line": Query(
        lambda s, d: _design(s, d, "flexible"),
        "text_id src_word# dst_word# log1p_abs_distance* adjacent* target_log_length* "
        "target_zipf_frequency* target_frequency_oov* target_terminal_punctuation* src_head_of_dst* dst_head_of_src* dependency_tree_distance* "
        "target_relative_position* target_first2* target_last2* log1p_abs_distance_squared* log1p_abs_distance_cubed* distance_x_target_relative_position* "
        "count*",
        WORDS + """
=>
SELECT text_id, src_word, dst_word, ld AS log1p_abs_distance, adjacent, log_length AS target_log_length, zipf AS target_zipf_frequency,
       oov AS target_frequency_oov, punct AS target_terminal_punctuation, sh AS src_head_of_dst, dh AS dst_head_of_src,
       steps AS dependency_tree_distance, relative AS target_relative_position, first2 AS target_first2, last2 AS target_last2,
       ld * ld AS log1p_abs_distance_squared, ld * ld * ld AS log1p_abs_distance_cubed,
       ld * relative AS distance_x_target_relative_position, y AS count
FROM counted""",
    ),
    "pair_features_directed": Query(
        lambda s, d: pairs.build_pairs(_words(s, d),
        "all",
        "syntax"), "text_id src_word# dst_word# " + " ".join(f"{n}*" for n in pairs.DIRECTED), WORDS + """
=>
SELECT s.text_id, s.word_index AS src_word, d.word_index AS dst_word, d.word_index > s.word_index AS forward,
       ln(1 + abs(d.word_index - s.word_index)) AS log1p_abs_distance,
  (d.word_index > s.word_index)::INT * ln(1 + abs(d.word_index - s.word_index)) AS forward_x_log_distance,
         abs(d.word_index - s.word_index) = 1 AS adjacent,
  s.log_length AS source_log_length, d.log_length AS target_log_length, s.cloze_logit AS source_cloze_logit,
         d.cloze_logit AS target_cloze_logit, s.cloze_missing AS source_cloze_missing, d.cloze_missing AS target_cloze_missing,
  s.punct AS source_terminal_punctuation, d.punct AS target_terminal_punctuation, s.sentence = d.sentence AS same_sentence,
         sign(d.sentence - s.sentence) AS cross_sentence_direction, s.zipf AS source_zipf_frequency, d.zipf AS target_zipf_frequency,
  s.oov AS source_frequency_oov, d.oov AS target_frequency_oov, d.head = s.word_index AS src_head_of_dst,
         s.head = d.word_index AS dst_head_of_src,
  CASE WHEN s.sentence <> d.sentence OR s.missing OR d.missing THEN 0 ELSE t.steps END AS dependency_tree_distance,
         s.sentence <> d.sentence OR s.missing OR d.missing AS dependency_missing
FROM words s JOIN words d ON s.text_id = d.text_id AND s.word_index <> d.word_index
LEFT JOIN tree t ON t.text_id = s.text_id AND t.src = s.word_index AND t.dst = d.word_index"""),
    "risk_set_sizes": Query(
        risk_set_sizes,
        "risk_set text_id n# sources#",
        WORDS + """
=>
SELECT r AS risk_set, s.text_id, count(*) AS n, count(DISTINCT s.word_index) AS sources
FROM words s JOIN words d ON s.text_id = d.text_id AND s.word_index <> d.word_index, (VALUES ('all'), ('forward_same_sentence'),
       ('forward_same_line')) v(r)
WHERE r = 'all' OR (d.word_index > s.word_index AND s.sentence = d.sentence AND (r = 'forward_same_sentence' OR s.line = d.line))
GROUP BY ALL""",
    ),
    "group_constants": Query(
        group_constant_flags,
        "feature constant",
        WORDS
        + """, spread AS (
        SELECT unnest(['log1p_abs_distance', 'adjacent', 'target_log_length', 'target_zipf_frequency', 'target_frequency_oov',
                       'target_terminal_punctuation', 'src_head_of_dst', 'dst_head_of_src', 'dependency_tree_distance',
                       'target_relative_position', 'target_first2', 'target_last2']) AS feature,
               unnest([max(ld) - min(ld), max(adjacent) - min(adjacent), max(log_length) - min(log_length), max(zipf) - min(zipf),
                       max(oov) - min(oov), max(punct) - min(punct), max(sh) - min(sh), max(dh) - min(dh), max(steps) - min(steps),
                       max(relative) - min(relative), max(first2) - min(first2), max(last2) - min(last2)]) AS width
        FROM line_pairs
        GROUP BY text_id, src_word
    )
=>
SELECT feature, max(width) = 0 AS constant FROM spread GROUP BY feature""",
    ),
    "design_rank": Query(rank_of_design, "features# rank#", WORDS + _elimination() + """
=>
SELECT 12 AS features, """ + " + ".join(f"(SELECT CAST(count(*) FILTER (WHERE d{i} > 1e-18 * o{i}) AS BIGINT) FROM e{i})" for i in range(12)) + " AS rank"),
    "candidate_audit": Query(
        lambda s, d: pairs.candidate_audit(transitions.with_separation(_design(s, d))),
        "category candidates# sources# texts# nonzero# mass* eligible# eligible_sources# exposure*",
        SCORED + """
=>
SELECT category, count(*) AS candidates, count(DISTINCT (text_id, src_word)) AS sources, count(DISTINCT text_id) AS texts,
       count(*) FILTER (WHERE y > 0) AS nonzero, sum(y) AS mass, count(*) FILTER (WHERE exposure >= 10) AS eligible,
       count(DISTINCT (text_id, src_word)) FILTER (WHERE exposure >= 10) AS eligible_sources, sum(exposure) AS exposure
FROM cells
GROUP BY category""",
    ),
    "exposure_audit": Query(
        lambda s, d: pairs.exposure_audit(_cells(s, d)),
        "category expected_mean* expected_median* nonzero_rate* mass* exposure_mean* exposure_median* risk_size_mean* risk_size_median*",
        SCORED + """
=>
SELECT category, avg(expected) AS expected_mean, median(expected) AS expected_median, avg((y > 0)::INT) AS nonzero_rate, sum(y) AS mass,
       avg(exposure) AS exposure_mean, median(exposure) AS exposure_median, avg(risk) AS risk_size_mean, median(risk) AS risk_size_median
FROM cells
GROUP BY category""",
    ),
    "verified_filter": Query(
        verified_filter,
        "dropped_weight* dropped_events#",
        TR + """
=>
SELECT count(*) AS dropped_weight, count(*) AS dropped_events
FROM tr
WHERE src_word % 6 = 0 OR dst_word % 6 = 0""",
    ),
    "candidate_sensitivity": Query(
        sensitivity,
        "text_id n# mass*",
        WORDS + """, w AS (SELECT text_id, max(word_index) + 1 AS w
FROM words
GROUP BY ALL)
=>
SELECT text_id, count(*) AS n, sum(y) AS mass
FROM counted JOIN w USING (text_id)
WHERE dst_word - src_word <= 3 AND dst_word < w - 2 AND abs(src_word % 3 - dst_word % 3) <= 1
GROUP BY ALL"""),
    "softmax_scores": Query(
        _scored,
        "text_id src_word# dst_word# count* probability*",
        SCORED + "\n=>\nSELECT text_id, src_word, dst_word, y AS count, p AS probability FROM scored",
    ),
    "residuals": Query(
        _cells,
        "text_id src_word# dst_word# exposure* risk_size# expected* residual* deviance* deviation* reliable category",
        SCORED + """
=>
SELECT text_id, src_word, dst_word, exposure, risk AS risk_size, expected, residual, deviance, deviation, reliable, category
FROM cells""",
    ),
    "nll_gradient": Query(
        nll_gradient,
        "nll* d_log1p_abs_distance* d_adjacent* d_target_log_length* d_target_relative_position*",
        SCORED + """
=>
SELECT sum(y * (-ln(p))) + 0.5 * (1.21 + 0.16 + 0.09 + 0.04) AS nll, -1.1 + sum(ld * (exposure * p - y)) AS d_log1p_abs_distance,
       0.4 + sum(adjacent * (exposure * p - y)) AS d_adjacent, -0.3 + sum(log_length * (exposure * p - y)) AS d_target_log_length,
       0.2 + sum(relative * (exposure * p - y)) AS d_target_relative_position
FROM scored""",
    ),
    "fit_one_feature": Query(
        fit_one_feature,
        "feature coefficient*",
        FIT_SQL),
    "fit_large_one_feature": Query(
        fit_large_one_feature,
        "feature coefficient*",
        FIT_SQL),
    "crossfit_one_feature": Query(
        lambda s, d: model.crossfit_residuals(_design(s, d), ONE, _folds(s)),
        "text_id src_word# dst_word# count* probability* exposure* expected* residual* reliable",
        CROSSFIT + """
=>
SELECT text_id, src_word, dst_word, y AS count, p AS probability, exposure, expected, residual, reliable
FROM bundle""",
    ),
    "crossfit_nll_one_feature": Query(
        lambda s, d: model.crossfit_nll(_design(s, d), ONE, _folds(s)),
        "nll* uniform_nll* texts#",
        CROSSFIT
        + """, by_text AS (SELECT text_id, sum(-y * ln(p)) / sum(y) AS nll, sum(y * ln(risk)) / sum(y) AS uniform_nll
FROM bundle
GROUP BY text_id
HAVING sum(y) > 0)
=>
SELECT avg(nll) AS nll, avg(uniform_nll) AS uniform_nll, count(*) AS texts
FROM by_text""",
    ),
    "fold_coefficients": Query(
        lambda s, d: model.fold_fits(_design(s, d), ONE, _folds(s)),
        "held# feature coefficient*",
        CROSSFIT + "\n=>\nSELECT k AS held, 'log1p_abs_distance' AS feature, b AS coefficient FROM fits",
    ),
    "coefficient_variability": Query(
        fold_spread,
        "feature fits# sd* minimum* maximum*",
        CROSSFIT + """
=>
SELECT 'log1p_abs_distance' AS feature, count(*) AS fits, stddev_samp(b) AS sd, min(b) AS minimum, max(b) AS maximum
FROM fits""",
    ),
    "half_fits_one_feature": Query(
        one_feature_halves,
        "draw# half# text_id src_word# dst_word# count* probability* residual* reliable",
        HALF_FITS + """
=>
SELECT draw, half, text_id, src_word, dst_word, y AS count, p AS probability, residual, reliable
FROM bundle""",
    ),
    "split_targets_one_feature": Query(
        lambda s, d: model.split_targets(_design(s, d), ONE, [f"T:{i}" for i in range(6)]).where("reliable"),
        "text_id src_word# dst_word# residual* target*",
        SPLIT_TARGETS
        + """
=>
SELECT text_id, src_word, dst_word, residual, CAST(greatest(least((residual - c) / greatest(1.4826 * m, 1e-8), 5), -5) AS FLOAT) AS target
FROM bundle, mid, dev WHERE reliable""",
    ),
    "transported_one_feature": Query(
        lambda s, d: _transported(s, d, ONE),
        "direction nll* uniform_nll* texts#",
        TRANSPORT
        + """
=>
SELECT CASE WHEN fitted = scored THEN 'within_' || fitted ELSE fitted || '_to_' || scored END AS direction,
       avg(nll) AS nll, avg(uniform_nll) AS uniform_nll, count(*) AS texts
FROM by_text GROUP BY 1""",
    ),
    "crossfit_residuals": Query(
        crossfit_cells,
        "text_id src_word# dst_word# count* probability* exposure* expected* residual* deviance* deviation* reliable",
    ),
    "crossfit_score": Query(crossfit_score, "events* nll* uniform_nll* gain* mean_nll*"),
    "specification_identity": Query(specification_identity, "spec_a spec_b texts# median* q25* q75* n_edges# pooled*"),
    "text_nll": Query(
        lambda s, d: model.text_nll(_scored(s, d)),
        "text_id events* nll* uniform_nll*",
        SCORED + """
=>
SELECT text_id, sum(y) AS events, CASE WHEN sum(y) > 0 THEN sum(-y * ln(greatest(p, 1e-300))) / sum(y) END AS nll, CASE
       WHEN sum(y) > 0 THEN sum(y * ln(risk)) / sum(y) END AS uniform_nll
FROM scored
GROUP BY text_id""",
    ),
    "predictive_score": Query(
        lambda s, d: model.predictive_score(_scored(s, d)),
        "events* nll* uniform_nll* gain* mean_nll*",
        SCORED + """
=>
SELECT sum(y) AS events, sum(-y * ln(p)) AS nll, sum(y * ln(risk)) AS uniform_nll, sum(y * ln(risk)) - sum(-y * ln(p)) AS gain,
       sum(-y * ln(p)) / sum(y) AS mean_nll
FROM scored""",
    ),
    "robust_targets": Query(
        robust_scale,
        "text_id src_word# dst_word# target*",
        SCORED + """, c AS (SELECT quantile_cont(residual, 0.5) AS c
FROM cells
WHERE reliable
), m AS (
SELECT quantile_cont(abs(residual - c), 0.5) AS m
FROM cells, c
WHERE reliable)
=>
SELECT text_id, src_word, dst_word, CAST(greatest(least((residual - c) / greatest(1.4826 * m, 1e-8), 5), -5) AS FLOAT) AS target
FROM cells, c, m
WHERE reliable"""),
    "leave_text_out_targets": Query(leave_text_out_targets, "text_id src_word# dst_word# residual* target* reliable"),
    "edge_correlation": Query(
        lambda s, d: metrics.correlation(_met(s, d), ["text_id"]),
        "text_id n# r*",
        HALVES + "\n=>\n" + corr_sql("met", "text_id"),
    ),
    "source_equal": Query(
        lambda s, d: metrics.source_equal(_met(s, d), ["text_id"]),
        "text_id n_edges# edge_weighted* source_weighted* n_sources# defined_sources# fisher_equal*",
        HALVES
        + ", sized AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY text_id, src_word) AS w FROM met), e AS ("
        + corr_sql("met", "text_id")
        + "), q AS ("
        + corr_sql("sized", "text_id", w="w")
        + "), f AS ("
        + corr_sql("met", "text_id, src_word")
        + """)
=>
SELECT e.text_id, e.n AS n_edges, e.r AS edge_weighted, q.r AS source_weighted, count(*) AS n_sources, count(f.r) AS defined_sources,
       tanh(avg(CASE WHEN f.r IS NOT NULL THEN atanh(greatest(least(f.r, 1 - 1e-7), 1e-7 - 1)) END)) AS fisher_equal
FROM e JOIN q USING (text_id) JOIN f USING (text_id)
GROUP BY ALL""",
    ),
    "paired_summary": Query(
        lambda s, d: metrics.paired_metrics(_met(s, d)),
        "metric valid# undefined# undefined_share* negative_share* median* q25* q75*",
        HALVES
        + metric_sql("met", "")
        + """
=>
SELECT metric, count(r) AS valid, count(*) - count(r) AS undefined, avg((r IS NULL)::INT) AS undefined_share, avg((r < 0)::INT) AS negative_share,
       quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.75) AS q75
FROM by_metric GROUP BY metric""",
    ),
    "category_reliability": Query(
        lambda s, d: metrics.paired_metrics(transitions.with_separation(_met(s, d)), ["category"]),
        "category metric valid# undefined# median*",
        HALVES
        + """, named AS (
        SELECT *, CASE WHEN dst_word - src_word = 1 THEN 'adjacent' WHEN dst_word - src_word <= 3 THEN 'near_skip'
        ELSE 'far_same_line' END AS category
FROM met
    )"""
        + metric_sql("named", "category, ")
        + """
=>
SELECT category, metric, count(r) AS valid, count(*) - count(r) AS undefined, quantile_cont(r, 0.5) AS median FROM by_metric GROUP BY ALL""",
    ),
    "spearman_brown": Query(
        lambda s, d: metrics.correlation(_met(s, d), ["text_id"]).select(
            "text_id", E.spearman_brown(F.col("r")).alias("doubled"), E.attenuation_ceiling(E.spearman_brown(F.col("r"))).alias("ceiling")
        ),
        "text_id doubled* ceiling*",
        HALVES
        + ", e AS ("
        + corr_sql("met", "text_id")
        + """), f AS (SELECT text_id, CASE WHEN r = -1 THEN -1 WHEN r IS NOT NULL THEN greatest(-1, least(1, 2 * r / (1 + r))) END AS doubled FROM e)
=>
SELECT text_id, doubled, CASE WHEN doubled IS NOT NULL THEN sqrt(greatest(0, doubled)) END AS ceiling FROM f""",
    ),
    "residual_distribution": Query(
        lambda s, d: metrics.distribution(_cells(s, d), ["category"], "residual"),
        "category n# median* q25* q75* minimum* maximum* undefined# negative_share*",
        SCORED + """
=>
SELECT category, count(residual) AS n, quantile_cont(residual, 0.5) AS median, quantile_cont(residual, 0.25) AS q25, quantile_cont(residual,
       0.75) AS q75, min(residual) AS minimum, max(residual) AS maximum, count(*) - count(residual) AS undefined,
       avg((residual < 0)::INT) AS negative_share
FROM cells
GROUP BY category""",
    ),
    "residual_summary": Query(
        lambda s, d: metrics.residual_summary(_cells(s, d)),
        "category n# texts# variance* q01* q05* q25* q50* q75* q95* q99*",
        SCORED
        + """
=>
SELECT category, count(residual) AS n, count(DISTINCT text_id) AS texts, var_pop(residual) AS variance,
       quantile_cont(residual, 0.01) AS q01, quantile_cont(residual, 0.05) AS q05, quantile_cont(residual, 0.25) AS q25,
       quantile_cont(residual, 0.5) AS q50, quantile_cont(residual, 0.75) AS q75, quantile_cont(residual, 0.95) AS q95,
       quantile_cont(residual, 0.99) AS q99
FROM cells WHERE reliable GROUP BY category""",
    ),
    "full_diagnostics": Query(
        lambda s, d: metrics.full_diagnostics(_cells(s, d)),
        "kind stratification stratum n# mean* sd* q00* q01* q05* q25* q50* q75* q95* q99* q100* beyond_2* beyond_3*",
        SCORED
        + """, u AS (
        SELECT unnest(['pearson', 'deviance', 'raw']) AS kind, unnest([residual, deviance, deviation]) AS v, p, expected, exposure, risk
FROM cells
WHERE reliable
    
), t AS (

        SELECT kind, v, 'all' AS stratification, 'all' AS stratum
FROM u
UNION ALL SELECT kind, v, 'probability', CASE WHEN p < 0.05 THEN '0-0.05' WHEN p < 0.1 THEN '0.05-0.1' WHEN p < 0.25 THEN '0.1-0.25'
                                                      WHEN p < 0.5 THEN '0.25-0.5' ELSE '>=0.5' END
FROM u
UNION ALL SELECT kind, v, 'expected', CASE WHEN expected < 0.5 THEN '0-0.5' WHEN expected < 1 THEN '0.5-1' WHEN expected < 5 THEN '1-5'
       ELSE '>=5' END
FROM u
UNION ALL SELECT kind, v, 'exposure', CASE WHEN exposure < 5 THEN '0-5' WHEN exposure < 10 THEN '5-10' WHEN exposure < 25 THEN '10-25'
       ELSE '>=25' END
FROM u
UNION ALL SELECT kind, v, 'risk_size', CASE WHEN risk < 2 THEN '0-2' WHEN risk < 4 THEN '2-4' WHEN risk < 8 THEN '4-8' ELSE '>=8' END
FROM u
    )
=>
SELECT kind, stratification, stratum, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS q00, quantile_cont(v, 0.01) AS q01,
       quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75,
       quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.99) AS q99, max(v) AS q100,
       avg((abs(v) > 2)::INT) AS beyond_2, avg((abs(v) > 3)::INT) AS beyond_3
FROM t
WHERE v IS NOT NULL
GROUP BY ALL""",
    ),
    "stratified_rows": Query(
        lambda s, d: metrics.stratified_rows(_cells(s, d)),
        "stratification stratum n# residual_variance* deviation_variance* mean_probability* mean_expected*",
        SCORED
        + """, t AS (
        SELECT *, 'probability' AS stratification, CASE WHEN p < 0.05 THEN '0-0.05' WHEN p < 0.1 THEN '0.05-0.1' WHEN p < 0.2 THEN '0.1-0.2'
                                                        WHEN p < 0.4 THEN '0.2-0.4' ELSE '>=0.4' END AS stratum FROM cells WHERE reliable
        UNION ALL
        SELECT *, 'expected', CASE WHEN expected < 0.5 THEN '0-0.5' WHEN expected < 1 THEN '0.5-1' WHEN expected < 2 THEN '1-2'
                                   WHEN expected < 5 THEN '2-5' ELSE '>=5' END FROM cells WHERE reliable
    )
=>
SELECT stratification, stratum, count(*) AS n, var_pop(residual) AS residual_variance, var_pop(deviation) AS deviation_variance,
       avg(p) AS mean_probability, avg(expected) AS mean_expected
FROM t GROUP BY ALL""",
    ),
    "text_residual_audit": Query(
        lambda s, d: metrics.text_residual_audit(_cells(s, d)),
        "text_id mean* variance* beyond_2* mean_square* mean_exposure*",
        SCORED + """
=>
SELECT text_id, avg(residual) AS mean, CASE WHEN count(residual) > 1 THEN var_samp(residual) END AS variance,
       avg((abs(residual) > 2)::INT) AS beyond_2, avg(residual * residual) AS mean_square, avg(exposure) AS mean_exposure
FROM cells
WHERE residual IS NOT NULL
GROUP BY text_id""",
    ),
    "exposure_thresholds": Query(
        thresholds_table,
        "threshold# metric valid# median*",
        HALVES.replace("AND a.total >= 5 AND b.total >= 5", "")
        + """, k AS (SELECT t AS threshold, met.*
FROM met, (VALUES (1), (3), (5), (10)) v(t)
WHERE exposure >= t)"""
        + metric_sql("k", "threshold, ")
        + """
=>
SELECT threshold, metric, count(r) AS valid, quantile_cont(r, 0.5) AS median FROM by_metric GROUP BY ALL""",
    ),
    "split_half": Query(
        numeric_splits,
        "text_id draws# valid# median*",
        TR + """, h AS (SELECT draw, (CAST(subject_id AS BIGINT) // (2 ** draw)::BIGINT) % 2 AS half, text_id, src_word, dst_word, sum(n) AS c
FROM edges, range(3) t(draw)
GROUP BY ALL
), p AS (
SELECT *, c / sum(c) OVER (PARTITION BY draw, half, text_id, src_word) AS p
FROM h
), w AS (
SELECT text_id, max(greatest(src_word, dst_word)) + 1 AS w
FROM tr
GROUP BY ALL
), ok AS (
SELECT draw, text_id, src_word
FROM p
GROUP BY ALL
HAVING count(DISTINCT half) = 2
), grid AS (
SELECT ok.*, unnest(range(w)) AS dst_word
FROM ok JOIN w USING (text_id)
), v AS (
SELECT g.draw, g.text_id, coalesce(max(p) FILTER (WHERE half = 0), 0) AS x, coalesce(max(p) FILTER (WHERE half = 1), 0) AS y
FROM grid g
LEFT JOIN p USING (draw, text_id, src_word, dst_word)
GROUP BY g.draw, g.text_id, g.src_word, g.dst_word), e AS (""" + corr_sql("v", "draw, text_id") + """)
=>
SELECT text_id, 3 AS draws, count(r) AS valid, quantile_cont(r, 0.5) AS median
FROM e
GROUP BY text_id"""),
    "hashed_split_half": Query(
        hashed_split_half,
        "text_id draws# valid# median*",
        TR + """, subj AS (SELECT DISTINCT text_id, subject_id
FROM tr
), dr AS (
SELECT text_id, subject_id, draw, CASE WHEN row_number() OVER (PARTITION BY text_id, draw
ORDER BY md5('20260711:' || draw || ':' || text_id || ':' || subject_id), subject_id) <= count(*) OVER (PARTITION BY text_id,
       draw) // 2 THEN 0 ELSE 1 END AS half
FROM subj, range(4) t(draw)
), h AS (
SELECT draw, half, text_id, src_word, dst_word, sum(n) AS c
FROM edges JOIN dr USING (text_id, subject_id)
GROUP BY ALL
), p AS (
SELECT *, c / sum(c) OVER (PARTITION BY draw, half, text_id, src_word) AS p
FROM h
), w AS (
SELECT text_id, max(greatest(src_word, dst_word)) + 1 AS w
FROM tr
GROUP BY ALL
), ok AS (
SELECT draw, text_id, src_word
FROM p
GROUP BY ALL
HAVING count(DISTINCT half) = 2
), grid AS (
SELECT ok.*, unnest(range(w)) AS dst_word
FROM ok JOIN w USING (text_id)
), v AS (
SELECT g.draw, g.text_id, coalesce(max(p) FILTER (WHERE half = 0), 0) AS x, coalesce(max(p) FILTER (WHERE half = 1), 0) AS y
FROM grid g
LEFT JOIN p USING (draw, text_id, src_word, dst_word)
GROUP BY g.draw, g.text_id, g.src_word, g.dst_word), e AS (""" + corr_sql("v", "draw, text_id") + """)
=>
SELECT text_id, 4 AS draws, count(r) AS valid, quantile_cont(r, 0.5) AS median
FROM e
GROUP BY text_id"""),
    "seeded_split_half": Query(
        seeded_split_half,
        "text_id draws# valid# median* half_0* half_1*",
        TR
        + seeded.split_half(10, 20260711, corr_sql("v", "draw, text_id"))
        + """, twice AS (
        SELECT text_id, draw, CASE WHEN r = -1 THEN -1 ELSE least(greatest(2 * r / (1 + r), -1), 1) END AS r FROM e
    )
=>
SELECT s.text_id, 10 AS draws, count(r) FILTER (WHERE n >= 4) AS valid, quantile_cont(r, 0.5) FILTER (WHERE n >= 4) AS median,
       any_value(n // 2) AS half_0, any_value(n - n // 2) AS half_1
FROM sizes s LEFT JOIN twice USING (text_id)
GROUP BY s.text_id""",
    ),
    "split_half_specification": Query(split_half_draws, "draw# metric valid# undefined# median*"),
    "identity_of_scores": Query(
        identity_of_scores,
        "spec_a spec_b texts# median* q25* q75* n_edges# pooled*",
        SCORED
        + """, alone AS (
        SELECT text_id, src_word, dst_word, y, exp(-1.1 * ld) / sum(exp(-1.1 * ld)) OVER (PARTITION BY text_id, src_word) AS p FROM counted
    )"""
        + residual_sql("alone", "")
        + """, pair AS (
        SELECT a.text_id, a.residual AS x, b.residual AS y
        FROM bundle a JOIN cells b ON a.text_id = b.text_id AND a.src_word = b.src_word AND a.dst_word = b.dst_word
        WHERE a.reliable AND b.reliable
    ), each AS ("""
        + corr_sql("pair", "text_id")
        + "), whole AS ("
        + corr_sql("pair", "")
        + """)
=>
SELECT 'distance' AS spec_a, 'full' AS spec_b, count(r) AS texts, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.25) AS q25,
       quantile_cont(r, 0.75) AS q75, (SELECT n FROM whole) AS n_edges, (SELECT r FROM whole) AS pooled
FROM each""",
    ),
    "shared_nuisance_one_feature": Query(
        lambda s, d: shared_nuisance(s, d, ONE),
        "metric valid# undefined# median* q25* q75*",
        CROSSFIT
        + """, part AS (
        SELECT CAST(subject_id AS BIGINT) % 2 AS half, text_id, src_word, dst_word, sum(n) AS n FROM edges GROUP BY ALL
    ), told AS (
        SELECT h.half, o.text_id, o.src_word, o.dst_word, o.p, coalesce(e.n, 0) AS y
        FROM out_of_fold o CROSS JOIN (VALUES (0), (1)) h(half)
        LEFT JOIN part e ON e.half = h.half AND e.text_id = o.text_id AND e.src_word = o.src_word AND e.dst_word = o.dst_word
    )"""
        + residual_sql("told", "half, ", name="half_")
        + """, pair AS (
        SELECT a.text_id, a.src_word, a.dst_word, a.residual AS x, b.residual AS y
        FROM half_bundle a JOIN half_bundle b USING (text_id, src_word, dst_word)
        WHERE a.half = 0 AND b.half = 1 AND a.reliable AND b.reliable
    )"""
        + metric_sql("pair", "").replace("sized AS", "weighed AS").replace("FROM sized", "FROM weighed")
        + """
=>
SELECT metric, count(r) AS valid, count(*) - count(r) AS undefined, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.25) AS q25,
       quantile_cont(r, 0.75) AS q75
FROM by_metric GROUP BY metric""",
    ),
    "shared_nuisance": Query(shared_nuisance, "metric valid# undefined# median* q25* q75*"),
    "permuted_control": Query(
        permuted_control,
        "text_id src_word# dst_word# count*",
        BARE_COUNTED
        + """, drawn AS (
        SELECT *, row_number() OVER (PARTITION BY text_id, src_word
ORDER BY dst_word) AS place,
               row_number() OVER (PARTITION BY text_id, src_word
ORDER BY md5('20260711:' || text_id || ':' || src_word || ':' || dst_word), dst_word) AS chance
FROM counted
    )
=>
SELECT a.text_id, a.src_word, a.dst_word, b.y AS count
FROM drawn a JOIN drawn b ON a.text_id = b.text_id AND a.src_word = b.src_word AND a.place = b.chance""",
    ),
    "shuffled_labels": Query(
        shuffled_labels,
        "text_id src_word# dst_word# residual*",
        SCORED
        + """, drawn AS (
        SELECT text_id, src_word, dst_word, residual, row_number() OVER (PARTITION BY text_id, src_word ORDER BY dst_word) AS place,
               row_number() OVER (PARTITION BY text_id, src_word
                                  ORDER BY md5('20260712:' || text_id || ':' || src_word || ':' || dst_word), dst_word) AS chance
        FROM cells
    )
=>
SELECT a.text_id, a.src_word, a.dst_word, b.residual
FROM drawn a JOIN drawn b ON a.text_id = b.text_id AND a.src_word = b.src_word AND a.place = b.chance""",
    ),
    "thinning_probabilities": Query(
        thinning,
        "subject_id category mass* keep*",
        WORDS + """, c AS (SELECT subject_id, CASE WHEN dst_word - src_word = 1 THEN 'adjacent' WHEN dst_word - src_word <= 3 THEN 'near_skip'
       ELSE 'far_same_line' END AS category, sum(n) AS mass
FROM edges JOIN line_pairs USING (text_id, src_word, dst_word)
GROUP BY ALL)
=>
SELECT subject_id, category, mass, CASE WHEN category = 'far_same_line' THEN 1 ELSE least(1,
       coalesce(max(mass) FILTER (WHERE category = 'far_same_line') OVER (PARTITION BY subject_id), 0) / mass) END AS keep
FROM c"""),
    "thinned_mass": Query(
        thinned_mass,
        "category mass* edges#",
        BARE_COUNTED + """, c AS (
        SELECT subject_id, text_id, src_word, dst_word, n, CASE WHEN dst_word - src_word = 1 THEN 'adjacent' WHEN dst_word - src_word <= 3 THEN 'near_skip'
               ELSE 'far_same_line' END AS category
        FROM edges JOIN line_pairs USING (text_id, src_word, dst_word)
    ), mass AS (SELECT subject_id, category, sum(n) AS mass FROM c GROUP BY ALL
    ), chance AS (
        SELECT subject_id, category, CASE WHEN category = 'far_same_line' THEN 1 ELSE least(1,
               coalesce(max(mass) FILTER (WHERE category = 'far_same_line') OVER (PARTITION BY subject_id), 0) / mass) END AS keep
        FROM mass
    ), copies AS (SELECT *, unnest(range(1, CAST(n AS INT) + 1)) AS copy FROM c
    ), kept AS (
        SELECT category, count(*) AS mass FROM copies JOIN chance USING (subject_id, category)
        WHERE """ + draws.uniform_sql("'thin'", "20260711", "subject_id", "text_id", "src_word", "dst_word", "copy") + """ < keep * 4294967296.0
        GROUP BY category
    )
=>
SELECT category, coalesce(any_value(k.mass), 0) AS mass, count(*) AS edges FROM c LEFT JOIN kept k USING (category) GROUP BY category""",
    ),
    "leave_one_out_means": Query(
        lambda s, d: compare.leave_one_out_means(_contrast(s, d), [], "difference"),
        "text_id difference* loo_mean*",
        CONTRAST + """
=>
SELECT text_id, difference, CASE WHEN count(*) OVER () > 1 THEN (sum(difference) OVER () - difference) / (count(*) OVER () - 1) END AS loo_mean
FROM contrast""",
    ),
    "jackknife": Query(lambda s, d: compare.jackknife_interval(
        compare.text_contrasts(runs_table(s, d), "gaze", ["mlm", "shuffled"]),
        ["other"],
        "nll_difference",
    ), "other n# mean* se* low* high*", RUNS + """, b AS (SELECT condition, text_id, avg(mlm_nll) AS nll
FROM runs
GROUP BY ALL
), d AS (
SELECT b.condition AS other, a.nll - b.nll AS x
FROM b JOIN b a ON a.text_id = b.text_id AND a.condition = 'gaze'
WHERE b.condition IN ('mlm', 'shuffled')
), l AS (
SELECT *, (sum(x) OVER g - x) / (count(*) OVER g - 1) AS loo
FROM d
WINDOW g AS (PARTITION BY other)
), j AS (
SELECT other, count(*) AS n, avg(x) AS mean, sqrt((count(*) - 1) * var_pop(loo)) AS se
FROM l
GROUP BY other)
=>
SELECT *, mean - 1.959963984540054 * se AS low, mean + 1.959963984540054 * se AS high
FROM j"""),
    "median_hierarchy": Query(
        lambda s, d: compare.median_hierarchy(_repeats(s, d), []),
        "median* repeats#",
        REPEATS + """
=>
SELECT quantile_cont(m, 0.5) AS median, count(m) AS repeats
FROM (SELECT repeat, quantile_cont(metric, 0.5) AS m
FROM repeats
GROUP BY repeat)"""),
    "leave_one_text_out": Query(
        lambda s, d: compare.leave_one_text_out(_repeats(s, d)),
        "deleted median* repeats#",
        REPEATS + """
=>
SELECT deleted, quantile_cont(m, 0.5) AS median, count(m) AS repeats
FROM (SELECT t.text_id AS deleted, repeat, quantile_cont(metric, 0.5) AS m
FROM repeats r JOIN (SELECT DISTINCT text_id
FROM repeats) t ON r.text_id <> t.text_id
GROUP BY ALL)
GROUP BY deleted"""),
    "most_influential": Query(
        influential,
        "deleted median* change* sign_reversed",
        REPEATS + """, f AS (SELECT quantile_cont(m, 0.5) AS f
FROM (SELECT repeat, quantile_cont(metric, 0.5) AS m
FROM repeats
GROUP BY repeat)
), l AS (
SELECT deleted, quantile_cont(m, 0.5) AS median
FROM (SELECT t.text_id AS deleted, repeat, quantile_cont(metric, 0.5) AS m
FROM repeats r JOIN (SELECT DISTINCT text_id
FROM repeats) t ON r.text_id <> t.text_id
GROUP BY ALL)
GROUP BY deleted)
=>
SELECT deleted, median, median - f AS change, sign(median) <> sign(f) AS sign_reversed
FROM l, f
ORDER BY abs(median - f) DESC, CAST(split_part(deleted, ':', 2) AS INT) LIMIT 1"""),
    "paired_contrast": Query(
        _contrast,
        "text_id seeds# min_edges# difference* raw_difference*",
        CONTRAST + "\n=>\nSELECT text_id, seeds, min_edges, difference, raw_difference FROM contrast",
    ),
    "edge_thresholds": Query(
        lambda s, d: compare.edge_thresholds(compare.retained(_contrast_cells(s, d))),
        "threshold# other texts# mean* max_r* max_z* near_perfect# largest_contribution*",
        CONTRAST_CELLS
        + """
=>
SELECT t AS threshold, other, count(*) AS texts, avg(difference) AS mean, max(max_r) AS max_r, max(max_z) AS max_z,
       sum(near_perfect) AS near_perfect, max(abs(difference)) / count(*) AS largest_contribution
FROM contrast_cells, (VALUES (4), (10), (20), (30)) v(t)
WHERE defined = seeds AND min_edges >= t
GROUP BY ALL""",
    ),
    "threshold_intervals": Query(
        threshold_intervals,
        "threshold# other n# mean* low* high*",
        CONTRAST_CELLS
        + """, primary_cells AS (
        SELECT other, text_id, difference FROM contrast_cells WHERE defined = seeds AND min_edges >= 4 AND difference IS NOT NULL
    )"""
        + seeded.interval("primary_cells", "primary_rows", ("other",), "difference", 2000, 20260712, flips=True)
        + """, kept_cells AS (
        SELECT t AS threshold, other, text_id, difference FROM contrast_cells, (VALUES (10), (20), (30)) v(t)
        WHERE defined = seeds AND min_edges >= t AND difference IS NOT NULL
    )"""
        + seeded.interval("kept_cells", "higher", ("threshold", "other"), "difference", 100_000, 20260713)
        + """
=>
SELECT threshold, other, n, mean, low, high FROM higher UNION ALL SELECT 4, other, n, mean, low, high FROM primary_rows""",
    ),
    "change_flags": Query(
        flags,
        "sign_reversal threshold_crossing",
        REPEATS
        + """, f AS (
        SELECT quantile_cont(m, 0.5) AS f FROM (SELECT repeat, quantile_cont(metric, 0.5) AS m FROM repeats GROUP BY repeat)
    ), l AS (
        SELECT deleted, quantile_cont(m, 0.5) AS v
        FROM (SELECT t.text_id AS deleted, repeat, quantile_cont(metric, 0.5) AS m
              FROM repeats r JOIN (SELECT DISTINCT text_id FROM repeats) t ON r.text_id <> t.text_id GROUP BY ALL)
        GROUP BY deleted
    )
=>
SELECT (any_value(f) > 0 AND bool_or(v <= 0)) OR (any_value(f) < 0 AND bool_or(v >= 0)) AS sign_reversal,
       (any_value(f) > 0 AND bool_or(v <= 0)) OR (any_value(f) <= 0 AND bool_or(v > 0)) AS threshold_crossing
FROM l, f""",
    ),
    "mean_summary": Query(
        lambda s, d: metrics.mean_summary(runs_table(s, d), ["condition"], "mlm_nll"),
        "condition mean* sd* median* q25* q75* minimum* maximum*",
        RUNS
        + """
=>
SELECT condition, avg(mlm_nll) AS mean, coalesce(stddev_samp(mlm_nll), 0) AS sd, quantile_cont(mlm_nll, 0.5) AS median,
       quantile_cont(mlm_nll, 0.25) AS q25, quantile_cont(mlm_nll, 0.75) AS q75, min(mlm_nll) AS minimum, max(mlm_nll) AS maximum
FROM runs GROUP BY condition""",
    ),
    "aggregate_rows": Query(
        lambda s, d: metrics.aggregate_rows(runs_table(s, d), ["condition", "seed"], "correlation"),
        "condition seed# rows# n# median* q25* q75* minimum* maximum*",
        RUNS
        + """
=>
SELECT condition, seed, count(*) AS rows, count(correlation) AS n, quantile_cont(correlation, 0.5) AS median, quantile_cont(correlation, 0.25) AS q25,
       quantile_cont(correlation, 0.75) AS q75, min(correlation) AS minimum, max(correlation) AS maximum
FROM runs GROUP BY ALL""",
    ),
    "replicate_summary": Query(
        lambda s, d: metrics.replicate_summary(_gaze_runs(s, d, "gaze", "shuffled"), ["text_id"], F.col("condition") == "shuffled"),
        "text_id observed_n# observed_median* control_n# control_maximum* above_controls",
        RUNS
        + """, o AS (
        SELECT text_id, CASE WHEN condition = 'gaze' THEN correlation END AS a, CASE WHEN condition = 'shuffled' THEN correlation END AS b
        FROM runs WHERE condition IN ('gaze', 'shuffled')
    )
=>
SELECT text_id, count(a) AS observed_n, quantile_cont(a, 0.5) AS observed_median, count(b) AS control_n, max(b) AS control_maximum,
       coalesce(quantile_cont(a, 0.5) > max(b), false) AS above_controls
FROM o GROUP BY text_id""",
    ),
    "mode_difference": Query(
        lambda s, d: metrics.mode_difference(_gaze_runs(s, d, "gaze", "mlm"), ["text_id"], "condition", "gaze", "mlm"),
        "text_id n# median* undefined# negative_share*",
        RUNS
        + """, e AS (
        SELECT a.text_id, a.correlation - b.correlation AS x
        FROM runs a JOIN runs b ON a.text_id = b.text_id AND a.seed = b.seed
        WHERE a.condition = 'gaze' AND b.condition = 'mlm'
    )
=>
SELECT text_id, count(x) AS n, quantile_cont(x, 0.5) AS median, count(*) - count(x) AS undefined, avg((x < 0)::INT) AS negative_share
FROM e GROUP BY text_id""",
    ),
    "word_properties": Query(
        word_properties,
        "word_index# log_length* cloze_logit* cloze_missing terminal_punctuation sentence_number#",
        """WITH p AS (
    SELECT p_partkey, p_size, p_name || CASE WHEN p_size % 6 = 0 THEN '.' ELSE '' END AS surface,
           CASE WHEN p_size % 9 = 0 THEN 1.5 ELSE (p_size % 10) / 10.0 END AS share, CASE WHEN p_size % 8 = 0 THEN 0 ELSE p_size END AS n
    FROM part
), q AS (
    SELECT *, share > 1 OR n <= 0 AS bad, (share * n + 0.5) / (n + 1) AS smooth,
           CASE WHEN p_size % 5 = 0 THEN greatest(1, length(regexp_replace(surface, '[^A-Za-z0-9'']', '', 'g'))) ELSE p_size END AS length
    FROM p
)
=>
SELECT p_partkey AS word_index, ln(length) AS log_length, CASE WHEN bad THEN 0 ELSE ln(smooth / (1 - smooth)) END AS cloze_logit,
       bad AS cloze_missing, p_size % 6 = 0 AS terminal_punctuation, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS sentence_number
FROM q""",
    ),
    "edge_strata": Query(
        lambda s, d: compare.edge_strata(_contrast_cells(s, d)),
        "other stratum texts#",
        CONTRAST_CELLS
        + """
=>
SELECT other, CASE WHEN min_edges <= 9 THEN '4-9' WHEN min_edges <= 19 THEN '10-19' WHEN min_edges <= 29 THEN '20-29'
       ELSE '30+' END AS stratum, count(*) AS texts
FROM contrast_cells
WHERE min_edges >= 4
GROUP BY ALL""",
    ),
    "condition_summary": Query(
        lambda s, d: compare.condition_summary(runs_table(s, d)),
        "condition macro_r* defined# mean_nll* token_nll* edges_per_seed*",
        RUNS + """
=>
SELECT condition, tanh(avg(CASE WHEN correlation IS NOT NULL THEN atanh(greatest(least(correlation, 1 - 1e-7), 1e-7 - 1)) END)) AS macro_r,
       count(correlation) AS defined,
       avg(mlm_nll) AS mean_nll, sum(mlm_nll * mlm_tokens) / sum(mlm_tokens) AS token_nll,
       sum(n_edges) / count(DISTINCT seed) AS edges_per_seed
FROM runs
GROUP BY condition""",
    ),
    "text_contrasts": Query(lambda s, d: compare.text_contrasts(
        runs_table(s, d),
        "gaze",
        ["mlm", "shuffled", "position"],
    ), "other text_id z_difference* nll_difference*", RUNS + """, b AS (
        SELECT condition, text_id, avg(CASE WHEN correlation IS NOT NULL THEN atanh(greatest(least(correlation, 1 - 1e-7),
        1e-7 - 1)) END) AS z, avg(mlm_nll) AS nll
FROM runs
GROUP BY ALL)
=>
SELECT b.condition AS other, b.text_id, a.z - b.z AS z_difference, a.nll - b.nll AS nll_difference
FROM b JOIN b a ON a.text_id = b.text_id AND a.condition = 'gaze'
WHERE b.condition <> 'gaze'"""),
    "learning_curve": Query(
        lambda s, d: compare.learning_curve(runs_table(s, d).withColumn("steps", F.col("seed") * 50)),
        "steps# condition macro_r* mean_nll* cells#",
        RUNS + """
=>
SELECT seed * 50 AS steps, condition, tanh(avg(CASE WHEN correlation IS NOT NULL THEN atanh(greatest(least(correlation, 1 - 1e-7),
       1e-7 - 1)) END)) AS macro_r,
       avg(mlm_nll) AS mean_nll, count(*) AS cells
FROM runs
GROUP BY ALL""",
    ),
    "bootstrap_mean": Query(
        bootstrap_mean,
        "draws# mean* low* high*",
        CONTRAST + """, o AS (SELECT difference, row_number() OVER (ORDER BY CAST(split_part(text_id, ':', 2) AS INT)) - 1 AS pos, count(*) OVER () AS n
FROM contrast
), d AS (
SELECT draw, ((draw * 997 + i) * 48271 + 11) % 2147483647 % n AS pick
FROM range(200) a(draw), (SELECT pos AS i, n
FROM o)
), m AS (
SELECT draw, avg(difference) AS m
FROM d JOIN o ON o.pos = d.pick
GROUP BY draw)
=>
SELECT count(*) AS draws, avg(m) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high
FROM m"""),
    "contrast_intervals": Query(
        contrast_intervals,
        "other n# mean* low* high* p*",
        CONTRAST_CELLS
        + """, primary_cells AS (
        SELECT other, text_id, difference FROM contrast_cells WHERE defined = seeds AND min_edges >= 4 AND difference IS NOT NULL
    )"""
        + seeded.interval("primary_cells", "primary_rows", ("other",), "difference", 2000, 20260712, flips=True)
        + "\n=>\nSELECT * FROM primary_rows",
    ),
    "text_summaries": Query(
        lambda s, d: corpus_audit.text_summaries(_design(s, d)),
        "text_id " + " ".join(f"{n}*" for n in corpus_audit.SUMMARIES),
        WORDS + """, q AS (SELECT *, CASE WHEN sum(y) OVER g > 0 THEN y / sum(y) OVER g ELSE 0 END AS p
FROM counted
WINDOW g AS (PARTITION BY text_id, src_word)
), s AS (
SELECT text_id, src_word, count(*) AS n, sum(y) AS events, sum(p * p) AS c, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h
FROM q
GROUP BY ALL
), t AS (
SELECT text_id, count(*) AS source_groups, avg(n) AS candidates_per_source, avg(events) AS events_per_source,
       avg(c) AS destination_concentration, avg(h) AS destination_entropy
FROM s
GROUP BY ALL
), u AS (
SELECT text_id, count(*) AS candidate_pairs, avg(dst_word - src_word) AS mean_distance,
       avg((dst_word - src_word = 1)::INT) AS adjacency_rate, max(dst_word - src_word) AS line_span,
       avg((y = 0)::INT) AS zero_destination_proportion
FROM q
GROUP BY ALL
), w AS (
SELECT text_id, count(DISTINCT x) AS words
FROM (SELECT text_id, unnest([src_word, dst_word]) AS x
FROM q)
GROUP BY ALL)
=>
SELECT *
FROM t JOIN u USING (text_id) JOIN w USING (text_id)"""),
    "feature_differences": Query(
        lambda s, d: corpus_audit.feature_differences(
            _two_corpora(s, d),
            ("log1p_abs_distance", "target_log_length"),
            "corpus",
            "first",
            "second",
        ),
        "feature first* second* smd*",
        WORDS
        + """, m AS (
        SELECT CASE WHEN CAST(split_part(text_id, ':', 2) AS INT) < 4 THEN 'first' ELSE 'second' END AS corpus, text_id, avg(ld) AS a,
        avg(log_length) AS b
FROM counted
GROUP BY ALL
    
), u AS (

        SELECT corpus, unnest(['log1p_abs_distance', 'target_log_length']) AS feature, unnest([a, b]) AS v
FROM m
    
), g AS (

        SELECT feature, avg(v) FILTER (WHERE corpus = 'first') AS first, avg(v) FILTER (WHERE corpus = 'second') AS second,
               sqrt(((count(*) FILTER (WHERE corpus = 'first') - 1) * var_samp(v) FILTER (WHERE corpus = 'first')
                     + (count(*) FILTER (WHERE corpus = 'second') - 1) * var_samp(v) FILTER (WHERE corpus = 'second')) / (count(*) - 2)) AS pooled
FROM u
GROUP BY feature
    )
=>
SELECT feature, first, second, CASE WHEN pooled > 1e-9 THEN (first - second) / pooled ELSE 0 END AS smd
FROM g""",
    ),
    "feature_intervals": Query(
        lambda s, d: corpus_audit.feature_differences(_two_corpora(s, d), NAMES, "corpus", "first", "second", 1000),
        "feature first* second* smd* low* high*",
        WORDS
        + """, sided AS (
        SELECT CASE WHEN CAST(split_part(text_id, ':', 2) AS INT) < 4 THEN 'first' ELSE 'second' END AS corpus, text_id, avg(ld) AS f1,
               avg(adjacent) AS f2, avg(log_length) AS f3, avg(zipf) AS f4, avg(oov) AS f5, avg(punct) AS f6, avg(sh) AS f7, avg(dh) AS f8,
               avg(steps) AS f9, avg(relative) AS f10, avg(first2) AS f11, avg(last2) AS f12
        FROM counted GROUP BY ALL
    ), u AS (
        SELECT corpus, text_id, unnest(["""
        + ", ".join(f"'{n}'" for n in NAMES)
        + """]) AS feature, unnest([f1, f2, f3, f4, f5, f6, f7, f8, f9, f10, f11, f12]) AS v FROM sided
    ), g AS (
        SELECT feature, avg(v) FILTER (WHERE corpus = 'first') AS first, avg(v) FILTER (WHERE corpus = 'second') AS second,
               sqrt(((count(*) FILTER (WHERE corpus = 'first') - 1) * var_samp(v) FILTER (WHERE corpus = 'first')
                     + (count(*) FILTER (WHERE corpus = 'second') - 1) * var_samp(v) FILTER (WHERE corpus = 'second')) / (count(*) - 2)) AS pooled
        FROM u GROUP BY feature
    ), texts AS (SELECT corpus, text_id FROM sided)"""
        + seeded.picks("texts", "drawn", ("corpus",), 1000, 20260711, "text_id")
        + """, mean_of AS (
        SELECT corpus, draw, feature, avg(v) AS m
        FROM drawn JOIN drawn_placed USING (corpus, i) JOIN u USING (corpus, text_id)
        GROUP BY ALL
    ), gaps AS (SELECT a.feature, a.m - b.m AS d FROM mean_of a JOIN mean_of b USING (draw, feature) WHERE a.corpus = 'first' AND b.corpus = 'second'
    ), limits AS (SELECT feature, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM gaps GROUP BY feature)
=>
SELECT feature, first, second, CASE WHEN pooled > 1e-9 THEN (first - second) / pooled ELSE 0 END AS smd,
       CASE WHEN pooled > 1e-9 THEN low / pooled ELSE 0 END AS low, CASE WHEN pooled > 1e-9 THEN high / pooled ELSE 0 END AS high
FROM g JOIN limits USING (feature)""",
    ),
    "coefficient_bootstrap": Query(coefficient_bootstrap, "feature first* second* difference* low* high*"),
    "coefficient_bootstrap_one_feature": Query(
        lambda s, d: coefficient_bootstrap(s, d, ONE),
        "feature first* second* difference* low* high*",
        BARE_COUNTED
        + """, sided AS (
        SELECT CASE WHEN CAST(split_part(text_id, ':', 2) AS INT) < 4 THEN 'first' ELSE 'second' END AS side, * FROM counted
    ), texts AS (SELECT DISTINCT side, text_id FROM sided)"""
        + seeded.picks("texts", "drawn", ("side",), 1000, 20260711, "text_id")
        + """, times AS (
        SELECT side, draw, text_id, count(*) AS times FROM drawn JOIN drawn_placed USING (side, i) GROUP BY ALL
        UNION ALL SELECT side, -1, text_id, 1 FROM texts
    ), laid AS (SELECT side || ':' || draw AS k, text_id, src_word, ld, y * times AS y FROM sided JOIN times USING (side, text_id))"""
        + newton_sql("laid")
        + """, wide AS (
        SELECT CAST(split_part(k, ':', 2) AS INT) AS draw, max(b) FILTER (WHERE k LIKE 'first%') AS first, max(b) FILTER (WHERE k LIKE 'second%') AS second
        FROM fits GROUP BY ALL
    )
=>
SELECT 'log1p_abs_distance' AS feature, max(first) FILTER (WHERE draw = -1) AS first, max(second) FILTER (WHERE draw = -1) AS second,
       max(first - second) FILTER (WHERE draw = -1) AS difference, quantile_cont(first - second, 0.025) FILTER (WHERE draw >= 0) AS low,
       quantile_cont(first - second, 0.975) FILTER (WHERE draw >= 0) AS high
FROM wide""",
    ),
    "cross_corpus_audit": Query(cross_corpus_audit, "part item value*"),
    "transported_nll": Query(transported, "direction nll* uniform_nll* texts#"),
    "domain_classifier": Query(classified, "balanced_accuracy* area* p* p_area* permutations# status"),
    "domain_classifier_one_feature": Query(
        lambda s, d: classified(s, d, ("events_per_source",)),
        "balanced_accuracy* area* p* p_area* permutations# status",
        BARE_COUNTED
        + """, texts AS (
        SELECT text_id, avg(events) AS x, CASE WHEN CAST(split_part(text_id, ':', 2) AS INT) < 4 THEN 0 ELSE 1 END AS label
        FROM (SELECT text_id, src_word, sum(y) AS events FROM counted GROUP BY ALL) GROUP BY ALL
    )"""
        + seeded.numbered("texts", "folded", ("label",), "'fold'", "20260711", "text_id")
        + seeded.numbered("texts", "placed", (), "text_id")
        + ", anew AS (SELECT i AS origin, label, draw FROM placed, range(500) d(draw))"
        + seeded.numbered("anew", "shuffled", ("draw",), "20260711", "draw", "origin")
        + """, labelled AS (
        SELECT draw, text_id, s.label FROM placed p JOIN shuffled s USING (i) UNION ALL SELECT -1, text_id, label FROM texts
    ), rows AS (SELECT l.draw, l.text_id, l.label AS y, f.x, f.i % 5 AS fold FROM labelled l JOIN folded f USING (text_id)
    ), standard AS (
        SELECT held, avg(x) AS m, CASE WHEN stddev_pop(x) <= 1e-12 * greatest(1, abs(avg(x))) THEN 1 ELSE stddev_pop(x) END AS sd
        FROM (SELECT DISTINCT text_id, x, fold FROM rows), range(5) h(held) WHERE fold <> held GROUP BY held
    ), laid AS (SELECT draw || ':' || held AS k, (x - m) / sd AS z, y FROM rows, standard WHERE fold <> held)"""
        + seeded.logistic("laid", "fits")
        + """, scored AS (
        SELECT draw, y, a * (x - m) / sd + c AS s FROM rows JOIN standard ON held = fold JOIN fits ON k = draw || ':' || held
    ), cells AS (SELECT draw, s, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY ALL
    ), found AS (
        SELECT draw, (coalesce(sum(p) FILTER (WHERE s >= 0), 0) / sum(p) + coalesce(sum(n) FILTER (WHERE s < 0), 0) / sum(n)) / 2 AS balanced,
               sum(p * (under + n / 2)) / (sum(p) * sum(n)) AS area
        FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY draw ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM cells)
        GROUP BY draw
    ), own AS (SELECT balanced AS ob, area AS oa FROM found WHERE draw = -1)
=>
SELECT ob AS balanced_accuracy, oa AS area, (1 + count(*) FILTER (WHERE balanced >= ob - 1e-12)) / 501.0 AS p,
       (1 + count(*) FILTER (WHERE area >= oa - 1e-12)) / 501.0 AS p_area, count(*) AS permutations, 'complete' AS status
FROM found, own WHERE draw >= 0 GROUP BY ob, oa""",
    ),
    "word_pool": Query(
        pooled_words,
        "text_id word_index# n_tokens# first* norm*",
        """WITH s AS (SELECT CAST(label AS VARCHAR) AS text_id, vec_id % 20 - 1 AS word_index, unnest(embedding) AS v,
       unnest(range(len(embedding))) AS dim
FROM embeddings
), m AS (
SELECT text_id, word_index, dim, avg(CAST(v AS DOUBLE)) AS v, count(*) AS n
FROM s
WHERE word_index >= 0
GROUP BY ALL)
=>
SELECT text_id, word_index, max(n) AS n_tokens, max(v) FILTER (WHERE dim = 0) AS first, sqrt(sum(v * v)) AS norm
FROM m
GROUP BY text_id, word_index"""),
    "word_cosines": Query(
        word_cosines,
        "text_id src_word# dst_word# score*",
        """WITH s AS (SELECT CAST(label AS VARCHAR) AS text_id, vec_id % 20 - 1 AS word_index, unnest(embedding) AS v,
       unnest(range(len(embedding))) AS dim
FROM embeddings
), m AS (
SELECT text_id, word_index, dim, avg(CAST(v AS DOUBLE)) AS v
FROM s
WHERE word_index >= 0
GROUP BY ALL)
=>
SELECT a.text_id, a.word_index AS src_word, b.word_index AS dst_word,
       sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS score
FROM m a JOIN m b ON a.text_id = b.text_id AND a.dim = b.dim AND b.word_index > a.word_index AND b.word_index <= a.word_index + 2
GROUP BY ALL"""),
    "head_scores": Query(
        head_scores,
        "text_id src_word# dst_word# score*",
        POOLED
        + """, heads AS (
        SELECT text_id, word_index, r, sum(v * ((r * 7 + dim * 3) % 11 - 5) / 10.0) AS source, sum(v * ((r * 5 + dim * 2) % 13 - 6) / 10.0) AS target
        FROM m, range(4) t(r)
        GROUP BY ALL
    )
=>
SELECT a.text_id, a.word_index AS src_word, b.word_index AS dst_word, sum(a.source * b.target) / 2 + 0.25 AS score
FROM heads a JOIN heads b ON a.text_id = b.text_id AND a.r = b.r AND b.word_index = a.word_index + 1
GROUP BY ALL""",
    ),
    "adapted_scores": Query(adapted_scores, "text_id src_word# dst_word# score*"),
    "all_words": Query(
        all_words,
        "text_id word_index# n_tokens# valid norm*",
        """WITH s AS (
    SELECT CAST(label AS VARCHAR) AS text_id, vec_id % 20 - 1 AS word_index, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim
FROM embeddings

), m AS (

    SELECT text_id, word_index, dim, sum(CAST(v AS DOUBLE)) AS v, count(*) AS n
FROM s
WHERE word_index >= 0
GROUP BY ALL

), w AS (

    SELECT text_id, word_index, max(n) AS n, sqrt(sum(v * v)) AS norm
FROM m
GROUP BY ALL

), slots AS (

    SELECT text_id, i AS word_index
FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS text_id
FROM embeddings), range(22) t(i)
)
=>
SELECT text_id, word_index, coalesce(n, 0) AS n_tokens, n IS NOT NULL AS valid, coalesce(norm, 0) AS norm
FROM slots
LEFT JOIN w USING (text_id, word_index)""",
    ),
    "masked_softmax": Query(
        softmax_rows,
        "row# col# probability*",
        """WITH e AS (SELECT event_id % 50 AS row, event_id // 50 AS col, value / 10 AS logit, event_id % 3 <> 0 AS mask
FROM events
), m AS (
SELECT *, CASE WHEN mask THEN exp(logit - max(logit) FILTER (WHERE mask) OVER (PARTITION BY row)) ELSE 0 END AS x
FROM e)
=>
SELECT row, col, CASE WHEN sum(x) OVER (PARTITION BY row) > 0 THEN x / sum(x) OVER (PARTITION BY row) ELSE 0 END AS probability
FROM m"""),
    "masked_jsd": Query(
        divergences,
        "row# jsd* valid",
        """WITH e AS (SELECT event_id % 50 AS row, CASE WHEN event_id % 50 <> 7 THEN value ELSE 0 END AS p, CASE
       WHEN event_id % 50 <> 7 THEN (event_id * 7) % 13 ELSE 0 END AS q
FROM events
), n AS (
SELECT row, CASE WHEN sum(p) OVER g > 0 THEN p / sum(p) OVER g ELSE 0 END AS a, CASE WHEN sum(q) OVER g > 0 THEN q / sum(q) OVER g
       ELSE 0 END AS b, sum(p) OVER g > 0 AND sum(q) OVER g > 0 AS valid
FROM e
WINDOW g AS (PARTITION BY row))
=>
SELECT row, sum(0.5 * (CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2))
       ELSE 0 END)) AS jsd, bool_and(valid) AS valid
FROM n
GROUP BY row"""),
    "balanced_loss": Query(
        balanced_loss,
        "text_id loss*",
        SCORED + """, l AS (SELECT text_id, src_word, avg(CASE WHEN abs(residual - 0.25) < 1 THEN 0.5 * (residual - 0.25) * (residual - 0.25)
       ELSE abs(residual - 0.25) - 0.5 END) AS l
FROM cells
WHERE residual IS NOT NULL
GROUP BY ALL)
=>
SELECT text_id, avg(l) AS loss
FROM l
GROUP BY text_id"""),
    "token_reconciliation": Query(
        token_reconciliation,
        "text_id op blocks# first_tokens# second_tokens#",
        ALIGNED + """
=>
SELECT text_id, op, count(*) AS blocks, sum(a2 - a1) AS first_tokens, sum(b2 - b1) AS second_tokens FROM ops GROUP BY ALL""",
    ),
    "token_alignment": Query(
        token_alignment,
        "text_id op first_start# first_end# second_start# second_end#",
        ALIGNED + """
=>
SELECT text_id, op, a1 AS first_start, a2 AS first_end, b1 AS second_start, b2 AS second_end FROM ops""",
    ),
    "aligned_tokens": Query(
        aligned_tokens,
        "text_id first_tokens# second_tokens#",
        r"""WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id
ORDER BY turn) AS n,
           len(string_split(trim(regexp_replace(trim(text), '\s+', ' ', 'g')), ' ')) AS tokens
FROM conversations
)
=>
SELECT coalesce(a.conv_id, b.conv_id) || ':' || coalesce(a.n + 1, b.n) AS text_id, coalesce(a.tokens, 0) AS first_tokens, coalesce(b.tokens,
       0) AS second_tokens
FROM t a
FULL JOIN t b ON a.conv_id = b.conv_id AND b.n = a.n + 1""",
    ),
    "key_counts": Query(
        key_counts,
        "o_orderstatus rows# customers# pairs#",
        """
=>
SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs
FROM orders
GROUP BY ROLLUP (o_orderstatus)""",
    ),
    "layout_agreement": Query(
        layout_agreement,
        "text_id subject_id words# bounds_differ# content_differs# line_differs#",
        WORDS
        + """
=>
SELECT text_id, s AS subject_id, count(*) AS words, count(*) FILTER (WHERE s = '2'
       AND (word_index % 4 = 0 OR word_index % 11 = 5)) AS bounds_differ,
       count(*) FILTER (WHERE s = '2' AND word_index % 11 = 5) AS content_differs, count(*) FILTER (WHERE s = '2'
       AND word_index % 11 = 5) AS line_differs
FROM words, (VALUES ('1'), ('2')) v(s)
GROUP BY ALL""",
    ),
    "line_map_audit": Query(
        line_map_audit,
        "text_id words# mapped# ambiguous# several_variants# observations# variants# lines# violations#",
        FIX
        + """, o AS (
        SELECT text_id, word_index, line_id, line_id * 20 + (fixation_order % 3 = 0)::INT AS top, count(*) AS n FROM fix GROUP BY ALL
    ), w AS (
        SELECT text_id, word_index, any_value(line_id) AS line, sum(n) AS observations, count(*) AS variants, max(n) AS most FROM o GROUP BY ALL
    ), x AS (
        SELECT *, variants = 1 OR 2 * most > observations AS accepted FROM w
    )
=>
SELECT text_id, count(*) AS words, count(*) FILTER (WHERE accepted) AS mapped, count(*) FILTER (WHERE NOT accepted) AS ambiguous,
       count(*) FILTER (WHERE variants > 1) AS several_variants, sum(observations) AS observations, sum(variants) AS variants,
       count(DISTINCT line) FILTER (WHERE accepted) AS lines, 0 AS violations
FROM x GROUP BY text_id""",
    ),
}


def queries() -> dict:
    return {name: q.run for name, q in SPECS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in SPECS.items() if (sql := q.oracle()) is not None}
