"""Probes, their targets and the evaluation of scorers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import probe


@pytest.fixture(scope="module")
def planted(spark):
    """Cells whose residual is a low-rank score of the words' vectors; one text is noise."""
    rng = np.random.default_rng(3)
    s, t = rng.standard_normal((2, 2, 6))
    states = {(f"t:{i}", w): rng.standard_normal(6) for i in range(5) for w in range(12)}
    cells = []
    for i in range(5):
        for a in range(12):
            for b in range(a + 1, 12):
                score = (s @ states[f"t:{i}", a]) @ (t @ states[f"t:{i}", b])
                cells.append((f"t:{i}", a, b, float(score if i < 4 else 100 * rng.normal()), (a + b) % 7 != 0))
    vectors = spark.createDataFrame([(k[0], k[1], v.tolist()) for k, v in states.items()], "text_id string, word_index long, state array<double>")
    return spark.createDataFrame(cells, "text_id string, src_word long, dst_word long, residual double, reliable boolean"), vectors


def test_a_probe_finds_what_was_planted_and_sees_listed_texts_only(spark, planted, monkeypatch):
    cells, vectors = planted
    train = [f"t:{i}" for i in range(3)]
    fitted = probe.fit_probe(cells, vectors, train, rank=2, epochs=400, rate=0.03)
    scored = fitted.score(cells.where("text_id = 't:3'"), vectors)
    assert scored.agg(F.corr("score", "residual")).first()[0] > 0.9
    changed = cells.withColumn("residual", F.when(F.col("text_id").isin(*train), F.col("residual")).otherwise(F.lit(7.0)))
    again = probe.fit_probe(changed, vectors, train, rank=2, epochs=3)
    first = probe.fit_probe(cells, vectors, train, rank=2, epochs=3)
    assert again.source == pytest.approx(first.source) and (again.median, again.scale) == (first.median, first.scale)
    monkeypatch.setattr(probe, "LOCAL_NUMBERS", 10)
    spread = probe.fit_probe(cells, vectors, train, rank=2, epochs=3)
    assert spread.source == pytest.approx(first.source, abs=1e-9) and spread.bias == pytest.approx(first.bias, abs=1e-9)
    with pytest.raises(ValueError, match="every listed text"):
        probe.fit_probe(cells, vectors, ["t:0", "t:9"])


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    a, b, y = rng.standard_normal((7, 3)), rng.standard_normal((7, 3)), rng.standard_normal(7)
    w = rng.standard_normal(13)
    loss = lambda w: 0.5 * ((((a @ w[:6].reshape(2, 3).T) * (b @ w[6:12].reshape(2, 3).T)).sum(1) / math.sqrt(2) + w[12] - y) ** 2).sum()
    numeric = [(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(13)]
    assert probe._gradient(a, b, y, *probe._parts(w, 2)) == pytest.approx(numeric, abs=1e-5)


def test_position_targets(spark):
    rows = [("t:1", 0, d, True) for d in (1, 2, 3)] + [("t:2", 0, 40, True)]
    got = probe.position_targets(spark.createDataFrame(rows, "text_id string, src_word long, dst_word long, reliable boolean"), ["t:1"])
    x = -np.log1p([1, 2, 3])
    scale = 1.4826 * np.median(np.abs(x - np.median(x)))
    assert {r.dst_word: r.target for r in got.collect()} == pytest.approx({1: (x[0] - x[1]) / scale, 2: 0.0, 3: (x[2] - x[1]) / scale, 40: -5.0}, abs=1e-6)
    assert probe.schedule(["a", "b", "c"], 2, 5) == [("a", 0), ("b", 1), ("c", 0), ("a", 1), ("b", 0)]


def test_scorers_are_evaluated_by_text_and_overall(spark):
    tokens = spark.createDataFrame([("t:1", 1.0, True), ("t:1", 3.0, False), ("t:2", 5.0, True)], "text_id string, nll double, correct boolean")
    edges = spark.createDataFrame([("t:1", 0, 0.0, 0.5), ("t:1", 0, 1.0, 1.5), ("t:1", 1, 0.0, 3.0), ("t:2", 0, 1.0, 1.0)], "text_id string, src_word long, target double, prediction double")
    rows = {r.text_id: r for r in probe.evaluate(tokens, edges).collect()}
    assert (rows["t:1"].nll, rows["t:1"].accuracy, rows["t:1"].tokens, rows["t:1"].edges) == (2.0, 0.5, 2, 3)
    assert rows["t:1"].loss == pytest.approx((0.125 + 2.5) / 2) and rows["t:2"].correlation is None
    assert (rows[None].nll, rows[None].tokens, rows[None].edges) == (3.0, 3, 4) and rows[None].loss == pytest.approx((0.125 + 2.5) / 4)
    assert rows[None].correlation == pytest.approx(float(np.corrcoef([0, 1, 0, 1], [0.5, 1.5, 3, 1])[0, 1]))
