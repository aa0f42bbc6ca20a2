"""Low-rank probes on word vectors, fitted anew on listed texts; targets and evaluation of trained scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.operators import metrics, model, scoring

#: Largest number of vector components, both ends of all edges, that the driver fits by itself.
LOCAL_NUMBERS = 20_000_000
# The published fit.
RANK, EPOCHS, RATE, DECAY = 8, 200, 1e-2, 1e-4


@dataclass(frozen=True)
class Probe:
    """score(a, b) = (S a) . (T b) / sqrt(rank) + bias, on targets less their median, over their spread."""

    source: np.ndarray
    target: np.ndarray
    bias: float
    median: float
    scale: float

    def score(self, cells: DataFrame, vectors: DataFrame) -> DataFrame:
        return scoring.pair_scores(cells, vectors, lambda a, b: scoring.low_rank_score(a, b, self.source, self.target, self.bias))


def _gradient(a: np.ndarray, b: np.ndarray, y: np.ndarray, source: np.ndarray, target: np.ndarray, bias: float) -> np.ndarray:
    """Sums over edges of half the squared error's gradient, flat: source, target, bias."""
    width = np.sqrt(len(source))
    left, right = a @ source.T, b @ target.T
    error = (left * right).sum(1) / width + bias - y
    pull = error[:, None] / width
    return np.concatenate([((pull * right).T @ a).ravel(), ((pull * left).T @ b).ravel(), [error.sum()]])


def _parts(weights: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, float]:
    half = (len(weights) - 1) // 2
    return weights[:half].reshape(rank, -1), weights[half:-1].reshape(rank, -1), float(weights[-1])


def _descend(weights: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], epochs: int, rate: float, decay: float) -> np.ndarray:
    """Adam with decoupled weight decay."""
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, epochs + 1):
        g = gradient(weights)
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        step = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights = weights * (1 - rate * decay) - rate * step
    return weights


def fit_probe(
    residuals: DataFrame,
    vectors: DataFrame,
    train: list[str],
    rank: int = RANK,
    seed: int = 0,
    epochs: int = EPOCHS,
    rate: float = RATE,
    decay: float = DECAY,
) -> Probe:
    """The probe of the reliable cells of the listed texts (text_id, src_word, dst_word, residual, reliable) only.

    ``vectors`` is (text_id, word_index, state). Texts without reliable cells or vectors raise. Edges that are few
    are fitted on the driver; of more, each epoch is one pass of sums over them.
    """
    spark = residuals.sparkSession
    listed = spark.createDataFrame([(t,) for t in train], "text_id string")
    chosen = residuals.where("reliable").join(listed, "text_id", "left_semi").select(*model.KEYS, "residual")
    centre = chosen.agg(E.quantile(F.col("residual"), 0.5).alias("m")).first()["m"]
    spread = chosen.agg(E.quantile(F.abs(F.col("residual") - F.lit(centre)), 0.5).alias("m")).first()["m"]
    end = lambda name, out: vectors.select(
        "text_id",
        F.col("word_index").alias(name),
        F.col("state").cast("array<double>").alias(out),
    )
    edges = chosen.join(end("src_word", "a"), ["text_id", "src_word"]).join(end("dst_word", "b"), ["text_id", "dst_word"])
    found = edges.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("a")).alias("dim"), F.count_distinct("text_id").alias("texts")).first()
    if not train or found["texts"] != len(set(train)):
        raise ValueError("every listed text needs reliable cells and vectors")
    scale, n, dim = max(1.4826 * spread, 1e-8), found["n"], found["dim"]
    rows = edges.select("a", "b", ((F.col("residual") - F.lit(centre)) / F.lit(scale)).alias("y"), *model.KEYS)
    rng = np.random.default_rng(seed)
    start = np.append(rng.uniform(-1, 1, 2 * rank * dim) / np.sqrt(dim), 0.0)

    def arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
        flat = lambda c: np.asarray(pa.concat_arrays(c.chunks if isinstance(c, pa.ChunkedArray) else [c]).flatten())
        return flat(batch.column("a")).reshape(-1, dim), flat(batch.column("b")).reshape(-1, dim), np.asarray(batch.column("y"))

    if 2 * n * dim <= LOCAL_NUMBERS:
        held = arrays(rows.orderBy(*model.KEYS).toArrow())
        gradient = lambda w: 2 / n * _gradient(*held, *_parts(w, rank))
        weights = _descend(start, gradient, epochs, rate, decay)
    else:
        kept = rows.select("a", "b", "y").persist()

        def one_pass(w: np.ndarray) -> np.ndarray:
            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(len(w))
                for batch in batches:
                    total += _gradient(*arrays(batch), *_parts(w, rank))
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

            # One row of 2 rank dim + 1 numbers a task.
            return 2 / n * np.sum([r["g"] for r in kept.mapInArrow(sums, "g array<double>").collect()], axis=0)

        try:
            weights = _descend(start, one_pass, epochs, rate, decay)
        finally:
            kept.unpersist()
    return Probe(*_parts(weights, rank), float(centre), float(scale))


def position_targets(cells: DataFrame, train: list[str], clip: float = 5.0) -> DataFrame:
    """``cells`` with ``target``: -ln(1 + distance), less the training texts' median, over their spread, held within ``clip``."""
    distance = F.col("dst_word") - F.col("src_word")
    listed = cells.sparkSession.createDataFrame([(t,) for t in train], "text_id string")
    return model.robust_targets(cells.withColumn("residual", -F.ln(1 + distance)), listed, clip)


def schedule(train: list[str], variants: int, steps: int) -> list[tuple[str, int]]:
    """(text, variant) of each training step, both in turn."""
    return [(train[i % len(train)], i % variants) for i in range(steps)]


def evaluate(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """By text, and overall (NULL text): masked-token NLL, accuracy and number, correlation and loss of edge predictions.

    ``tokens`` (text_id, nll, correct) has a row a masked token, ``edges`` (text_id, src_word, target, prediction) one a
    reliable edge. The overall loss is the mean over texts of their source-balanced loss; a constant side has no correlation.
    """
    measures = [F.avg("nll").alias("nll"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("tokens")]
    none = F.lit(None).cast("string").alias("text_id")
    masked = tokens.groupBy("text_id").agg(*measures).unionByName(tokens.agg(*measures).select(none, "nll", "accuracy", "tokens"))
    each = scoring.source_balanced_loss(edges.withColumn("difference", F.col("prediction") - F.col("target")), ["text_id"])
    losses = each.unionByName(each.agg(F.avg("loss").alias("loss")).select(none, "loss"))
    by_text = metrics.correlation(edges, ["text_id"], "target", "prediction")
    whole = metrics.correlation(edges, [], "target", "prediction").select(none, "n", "r")
    fits = by_text.unionByName(whole).withColumnsRenamed({"n": "edges", "r": "correlation"})
    out = masked
    for other in (fits, losses):
        named = other.withColumnRenamed("text_id", "_text")
        out = out.join(named, out["text_id"].eqNullSafe(named["_text"]), "left").drop("_text")
    return out
