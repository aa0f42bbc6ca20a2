"""Draws as column expressions, against the same digests in Python; the classifier against dense Newton steps."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import corpus_audit, draws, responses


def md5(*counters):
    return hashlib.md5(":".join(map(str, counters)).encode()).hexdigest()


def uniform(*counters):
    return int(md5(*counters)[:8], 16)


def in_order(keys, *prefix):
    """Keys by the digest of what stands before them and themselves."""
    return sorted(keys, key=lambda k: (md5(*prefix, k), k))


@pytest.fixture(scope="module")
def subjects(spark):
    rows = [(f"t{t}", f"s{i}") for t in range(3) for i in range(4 + 7 * t)]
    return spark.createDataFrame(rows * 2, "text_id string, subject_id string").repartition(3)


def test_numbers_follow_the_digest(spark):
    ids = [f"k{i}" for i in range(700)]
    got = {r.k: (r._i, r._n) for r in draws.numbered(spark.createDataFrame([(k,) for k in ids], "k string"), [], 5, F.col("k")).collect()}
    assert got == {k: (i, 700) for i, k in enumerate(in_order(ids, 5))}


def test_halves(subjects):
    got = {(r.text_id, r.draw, r.subject_id): r.half for r in draws.half_draws(subjects, 3, 9).collect()}
    assert len(got) == 3 * (4 + 11 + 18)
    for t, n in enumerate((4, 11, 18)):
        for d in range(3):
            order = in_order([f"s{i}" for i in range(n)], 9, d, f"t{t}")
            assert [got[f"t{t}", d, s] for s in order] == [0] * (n // 2) + [1] * (n - n // 2)


def test_four_subjects(subjects):
    rows = draws.four_subject_draws(subjects.where("text_id = 't0'")).collect()
    halves = {d: {r.subject_id for r in rows if r.draw == d and r.half == 0} for d in range(3)}
    assert halves == {0: {"s0", "s1"}, 1: {"s0", "s2"}, 2: {"s0", "s3"}} and len(rows) == 12
    with pytest.raises(Exception, match="four subjects"):
        draws.four_subject_draws(subjects).collect()


def test_resamples_and_readers(spark, subjects):
    got = {(r.draw, r.subject_id): r.times for r in draws.resampled(subjects.distinct(), ["text_id"], 4, 3, F.col("subject_id")).where("text_id = 't2'").collect()}
    order = in_order([f"s{i}" for i in range(18)])
    for d in range(4):
        want = Counter(order[uniform(3, "t2", d, j) * 18 >> 32] for j in range(18))
        assert {s: n for (x, s), n in got.items() if x == d} == want
    split = draws.reader_draws(subjects.select("subject_id"), 5, 3, split=True).groupBy("draw", "half").agg(F.sum("mult").alias("n")).collect()
    assert {(r.draw, r.half): r.n for r in split} == {(d, h): 9 for d in range(5) for h in (0, 1)}
    whole = draws.reader_draws(subjects.select("subject_id"), 5, 3).groupBy("draw", "half").agg(F.sum("mult").alias("n")).collect()
    assert {(r.draw, r.half): r.n for r in whole} == {(d, 0): 18 for d in range(5)}


def test_many_subjects_are_drawn_where_they_are(spark):
    """Draws over many subjects have no list on the driver; they are uniform and sum to the number of subjects."""
    many = spark.range(200_000).select(F.col("id").cast("string").alias("subject_id"))
    drawn = draws.reader_draws(many, 3, 1).groupBy("draw").agg(F.sum("mult").alias("n"), F.count(F.lit(1)).alias("different"), F.max("mult").alias("most"))
    for r in drawn.collect():
        assert r.n == 200_000 and abs(r.different / 200_000 - (1 - np.exp(-1))) < 0.01 and r.most < 14
    halves = draws.half_draws(many, 2, 1, by=()).groupBy("draw", "half").count().collect()
    assert {r["count"] for r in halves} == {100_000}


def test_intervals(spark):
    values = {f"t{i}": v for i, v in enumerate([-0.2, 0.1, 0.3, 0.4, 0.35])}
    rows = [("x", t, v) for t, v in values.items()] + [("x", "none", None), ("y", "t0", 1.0)]
    df = spark.createDataFrame(rows, "k string, text_id string, v double")
    row = {r.k: r for r in draws.mean_interval(df, ["k"], "v", 400, 5, sign_flips=True).collect()}
    order = in_order(values)
    means = [np.mean([values[order[uniform(5, "x", d, j) * 5 >> 32]] for j in range(5)]) for d in range(400)]
    flips = [np.mean([v if uniform("flip", 5, "x", d, t) % 2 == 0 else -v for t, v in values.items()]) for d in range(400)]
    mean = np.mean(list(values.values()))
    assert (row["x"].n, row["x"].mean) == (5, pytest.approx(mean))
    assert (row["x"].low, row["x"].high) == pytest.approx(tuple(np.quantile(means, (0.025, 0.975))))
    assert row["x"].p == pytest.approx((1 + sum(abs(f) >= abs(mean) - 1e-12 for f in flips)) / 401)
    assert (row["y"].n, row["y"].low, row["y"].high) == (1, 1.0, 1.0)


def test_permuted_labels(spark):
    df = spark.createDataFrame([(f"t{i}", int(i < 3)) for i in range(9)], "text_id string, label int")
    rows = draws.permuted_labels(df, "label", 6, 4, F.col("text_id")).collect()
    assert len(rows) == 54 and all(sum(r.label for r in rows if r.draw == d) == 3 for d in range(6))
    order = in_order([f"t{i}" for i in range(9)])
    label = {f"t{i}": int(i < 3) for i in range(9)}
    for d in range(6):
        dealt = sorted(range(9), key=lambda i: (md5(4, d, i), f"4:{d}:{i}"))
        assert {r.text_id: r.label for r in rows if r.draw == d} == {order[to]: label[order[i]] for to, i in enumerate(dealt)}


# -- classifier -----------------------------------------------------------------------------------------------------


def dense_logistic(x, y):
    """Newton steps on a dense design; the last coefficient is the free intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty, beta = np.append(np.ones(x.shape[1] - 1), 0.0), np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ beta))
        beta = beta - np.linalg.solve(x.T @ ((q * (1 - q))[:, None] * x) + np.diag(penalty), x.T @ (q - y) + penalty * beta)
    return beta


def test_scores_equal_dense_fits(spark):
    rng = np.random.default_rng(2)
    x, labels = rng.normal(size=(60, 3)), rng.integers(0, 2, (60, 4))
    x[:, 2] = 7.0  # a constant feature
    fold = np.arange(60) % 3
    rows = [(f"t{i}", int(fold[i]), *map(float, x[i]), labels[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "text_id string, fold int, a double, b double, c double, labels array<int>").repartition(4)
    got = {(r.draw, r.text_id): (r.score, r.label) for r in corpus_audit.out_of_fold_scores(df, ("a", "b", "c"), 4, 3).collect()}
    for k in range(4):
        for f in range(3):
            train = fold != f
            mean, sd = x[train].mean(0), np.where(x[train].std(0) < 1e-9, 1.0, x[train].std(0))
            beta = dense_logistic((x[train] - mean) / sd, labels[train, k])
            for i in np.flatnonzero(~train):
                assert got[k - 1, f"t{i}"] == (pytest.approx((x[i] - mean) / sd @ beta[:-1] + beta[-1], abs=1e-8), labels[i, k])


def test_area_counts_ties_by_half(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 2)), float(np.round(rng.normal() * (1, 40)[k], 1))) for k in range(2) for _ in range(300)]
    got = {r.k: r for r in corpus_audit.classified_well(spark.createDataFrame(rows, "k int, label int, score double"), ["k"]).collect()}
    for k in range(2):
        pos, neg = (np.array([s for kk, y, s in rows if kk == k and y == label]) for label in (1, 0))
        area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert got[k].area == pytest.approx(area) and got[k].balanced == pytest.approx(((pos >= 0).mean() + (neg < 0).mean()) / 2)


def test_reader_draws_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    many = spark.range(300).select(F.col("id").cast("string").alias("subject_id"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    few = rows(draws.reader_draws(many, 5, 3, split=True))
    monkeypatch.setattr(draws, "SLOTS", 200)
    dealt = draws.reader_draws(many, 5, 3, split=True)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and ", 8), REPARTITION_BY_NUM" in plan
    assert rows(dealt) == few and sum(r[3] for r in few) == 5 * 300


def test_a_design_is_laid_out_once_whatever_the_draws(spark):
    """Rows that are written are one a source; draws add entries to them, not copies."""
    rows = [(f"t:{t}", s, d, float(d)) for t in range(3) for s in range(4) for d in range(s + 1, 6)]
    design = spark.createDataFrame(rows, "text_id string, src_word long, dst_word long, a double")
    counts = spark.createDataFrame([(k, f"t:{k % 3}", 0, 1, 2.0) for k in range(40)] + [(0, "t:0", 0, 77, 5.0)], "draw int, text_id string, src_word long, dst_word long, count double")
    numbers = responses.number_responses(counts, ["draw"])
    laid = responses.with_counts(responses.lay_out(design, ("a",)), counts, numbers, ["draw"])
    assert laid.count() == 12 and len(numbers) == 40
    beta = responses.fit_responses(laid, 40, 1)
    assert beta.shape == (40, 1, 1) and np.allclose(beta[3:6, 0, 0], beta[0:3, 0, 0])  # the count of no candidate falls away
    with pytest.raises(responses.NotConverged):
        responses.newton(lambda b: np.ones((*b.shape[:2], responses.numbers_of(1))) * (1 + np.abs(b).sum() * 1e9), (1, 1), np.zeros(1), max_rounds=5)
