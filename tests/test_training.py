"""Back-propagation against finite differences, and training against a dense copy of its steps."""

import math

import numpy as np
import pytest

from pathloom.operators import probe, training

WIDTH, RANK, CLASSES = 6, 3, 5


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    rows = {}
    for t in range(4):
        n = 7 + t
        tokens = [{"token_index": i, "word": i // 2, "state": rng.normal(size=WIDTH).tolist()} for i in range(n)]
        masked = [{"variant": i % 2, "token_index": i, "label": int(rng.integers(CLASSES)), "state": rng.normal(size=WIDTH).tolist()} for i in range(n)]
        edges = [{"src": s, "dst": d, "target": float(2 * rng.normal())} for s in range(n // 2) for d in range(s + 1, n // 2)]
        rows[f"t{t}"] = {"text_id": f"t{t}", "tokens": tokens, "masked": masked, "edges": edges}
    return rows, rng.normal(size=(CLASSES, WIDTH)), rng.normal(size=CLASSES)


@pytest.fixture(scope="module")
def laid(spark, texts):
    rows = texts[0]
    flat = lambda name, *keys: [(t, *(x[k] for k in keys)) for t, row in rows.items() for x in row[name]]
    tokens = spark.createDataFrame(flat("tokens", "token_index", "word", "state"), "text_id string, token_index int, word int, state array<double>")
    masked = spark.createDataFrame(flat("masked", "variant", "token_index", "label", "state"), "text_id string, variant int, token_index int, label int, state array<double>")
    edges = spark.createDataFrame(flat("edges", "src", "dst", "target"), "text_id string, src int, dst int, target double")
    return training.lay_out(tokens.repartition(3), masked, edges)


def test_the_adapter_changes_nothing_at_first(texts):
    p = training.Parameters.start(WIDTH, RANK, 1)
    x = np.random.default_rng(0).normal(size=(5, WIDTH))
    assert np.array_equal(training._Adapted(x, p).out, x) and len(p.flat) == sum(a.size for a in p.parts())


def test_gradients_equal_finite_differences(texts):
    rows, head, bias = texts
    p = training.Parameters.start(WIDTH, RANK, 1)
    p.flat = p.flat + 0.1 * np.random.default_rng(3).normal(size=len(p.flat))
    found = training.text_gradient(rows["t2"], 1, p, head, bias, 0.7)

    def loss(flat):
        got = training.text_gradient(rows["t2"], 1, training.Parameters(flat, WIDTH, RANK), head, bias, 0.7)
        return got[0] + 0.7 * got[1]

    for i in range(len(p.flat)):
        ahead, behind = (p.flat + step * (np.arange(len(p.flat)) == i) for step in (1e-6, -1e-6))
        assert found[2 + i] == pytest.approx((loss(ahead) - loss(behind)) / 2e-6, abs=1e-6)


def test_training_equals_dense_steps(texts, laid):
    rows, head, bias = texts
    p, curve = training.train(laid, ["t0", "t2", "t1"], 2, 4, WIDTH, head, bias, 0.5, RANK, seed=9, at_once=2)
    q = training.Parameters.start(WIDTH, RANK, 9)
    m, v = np.zeros_like(q.flat), np.zeros_like(q.flat)
    order = ["t0", "t2", "t1"]
    for t in range(4):
        chosen = [order[(2 * t + k) % 3] for k in range(2)]
        g = np.mean([training.text_gradient(rows[x], t % 2, q, head, bias, 0.5) for x in chosen], axis=0)
        assert curve[t] == (t + 1, pytest.approx(g[0]), pytest.approx(g[1]), pytest.approx(np.linalg.norm(g[2:])))
        g = g[2:] * min(1, 1 / (np.linalg.norm(g[2:]) + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        q.flat = q.flat * (1 - 1e-5) - 1e-3 * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
    assert p.flat == pytest.approx(q.flat, abs=1e-9)


def test_the_loss_falls_and_runs_repeat(texts, laid):
    _, head, bias = texts
    run = lambda: training.train(laid, ["t0", "t1", "t2", "t3"], 2, 24, WIDTH, head, bias, 1.0, RANK, seed=2, at_once=4)
    (p, curve), (again, _) = run(), run()
    total = [a + b for _, a, b, _ in curve]
    assert total[-1] < total[0] and np.allclose(p.flat, again.flat, atol=1e-12)
    rows = training.predictions(laid, p)
    assert rows.count() == sum(len(r["edges"]) for r in texts[0].values())
    losses = probe.evaluate(laid.selectExpr("text_id", "0.5D nll", "true correct").limit(1), rows).collect()
    assert all(r.loss is None or math.isfinite(r.loss) for r in losses)
    alone, curve = training.train(laid, ["t0"], 2, 2, WIDTH, head, bias, 0.0, RANK)
    heads = lambda x: np.concatenate([a.ravel() for a in x.parts()[4:6]])
    assert np.allclose(heads(alone), heads(training.Parameters.start(WIDTH, RANK, 0)) * (1 - 1e-5) ** 2) and curve[0][2] == 0
