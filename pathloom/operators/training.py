"""Training of an adapter and a scoring head on fixed states, by back-propagation where the texts lie.

A text is a row with all its arrays. A step takes some texts, each in one of its masked variants: tasks run them forward
and back, the gradients are added up in a tree, and the driver, which holds the parameters (a few times width by rank),
clips their norm and takes the optimizer's step. The encoder that made the states stays as it is, and so does the
token head, through which gradients pass to the adapter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.responses import SUMS, chunks_of, tree_sum
from pathloom.sources.scratch import written

# The published optimizer.
RATE, DECAY, CLIP = 1e-3, 1e-2, 1.0

TOKENS = "array<struct<token_index:int,word:int,state:array<double>>>"
MASKED = "array<struct<variant:int,token_index:int,label:int,state:array<double>>>"
EDGES = "array<struct<src:int,dst:int,target:double>>"


@dataclass
class Parameters:
    """The adapter x + U gelu(D x + d) + u, and the head (S a) . (T b) / sqrt(rank) + bias, as one flat vector."""

    flat: np.ndarray
    width: int
    rank: int

    @classmethod
    def start(cls, width: int, rank: int, seed: int) -> Parameters:
        """The adapter changes nothing at first: U and u are 0."""
        rng = np.random.default_rng(seed)
        inner, heads = (rng.uniform(-1, 1, (n, rank, width)) / math.sqrt(width) for n in (1, 2))
        shapes = (inner[0], rng.uniform(-1, 1, rank) / math.sqrt(width), np.zeros((width, rank)), np.zeros(width), heads[0], heads[1], np.zeros(1))
        return cls(np.concatenate([a.ravel() for a in shapes]), width, rank)

    def parts(self, flat: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Views of D, d, U, u, S, T, bias."""
        flat, r, w = self.flat if flat is None else flat, self.rank, self.width
        out, at = [], 0
        for shape in ((r, w), (r,), (w, r), (w,), (r, w), (r, w), (1,)):
            size = math.prod(shape)
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return tuple(out)


_erf = np.vectorize(math.erf, otypes=[float])


def _gelu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact unit and its slope."""
    below = 0.5 * (1 + _erf(z / math.sqrt(2)))
    return z * below, below + z * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


class _Adapted:
    """States through the adapter, and the way back."""

    def __init__(self, x: np.ndarray, p: Parameters):
        down, shift, up, lift = p.parts()[:4]
        self.x, self.up = x, up
        self.inner, self.slope = _gelu(x @ down.T + shift)
        self.out = x + self.inner @ up.T + lift

    def back(self, pull: np.ndarray, total: tuple[np.ndarray, ...]) -> None:
        down, shift, up, lift = total[:4]
        up += pull.T @ self.inner
        lift += pull.sum(0)
        inner = pull @ self.up * self.slope
        down += inner.T @ self.x
        shift += inner.sum(0)


def token_loss(states: np.ndarray, labels: np.ndarray, head: np.ndarray, bias: np.ndarray, p: Parameters, total: tuple[np.ndarray, ...]) -> float:
    """Mean cross entropy of masked tokens through the fixed token head; adds its gradient to ``total``."""
    if not len(labels):
        return 0.0
    adapted = _Adapted(states, p)
    logits = adapted.out @ head.T + bias
    logits -= logits.max(1, keepdims=True)
    q = np.exp(logits)
    q /= q.sum(1, keepdims=True)
    loss = -np.log(q[np.arange(len(labels)), labels]).mean()
    q[np.arange(len(labels)), labels] -= 1
    adapted.back(q @ head / len(labels), total)
    return float(loss)


def edge_loss(states: np.ndarray, words: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], p: Parameters, total: tuple[np.ndarray, ...], weight: float) -> float:
    """Huber loss of the head on pooled words, averaged within each source, then over sources; adds ``weight`` times its gradient."""
    src, dst, target = edges
    if not len(src):
        return 0.0
    adapted = _Adapted(states, p)
    named, place = np.unique(words, return_inverse=True)
    pool = np.zeros((len(named), len(words)))
    pool[place, np.arange(len(words))] = 1.0
    pool /= pool.sum(1, keepdims=True)
    v = pool @ adapted.out
    left, right, bias = p.parts()[4:]
    s, d = np.searchsorted(named, src), np.searchsorted(named, dst)
    a, b = v[s] @ left.T, v[d] @ right.T
    gap = (a * b).sum(1) / math.sqrt(p.rank) + bias[0] - target
    _, group, size = np.unique(src, return_inverse=True, return_counts=True)
    share = 1 / (size[group] * len(size))
    loss = float((share * np.where(np.abs(gap) < 1, 0.5 * gap * gap, np.abs(gap) - 0.5)).sum())
    pull = weight * share * np.clip(gap, -1, 1)
    scaled = pull[:, None] / math.sqrt(p.rank)
    total[4][...] += (scaled * b).T @ v[s]
    total[5][...] += (scaled * a).T @ v[d]
    total[6][...] += pull.sum()
    at_words = np.zeros_like(v)
    np.add.at(at_words, s, scaled * b @ left)
    np.add.at(at_words, d, scaled * a @ right)
    adapted.back(pool.T @ at_words, total)
    return loss


def lay_out(tokens: DataFrame, masked: DataFrame, edges: DataFrame) -> DataFrame:
    """(text_id, tokens, masked, edges): a row for each text, written once.

    ``tokens`` (text_id, token_index, word, state), ``masked`` (text_id, variant, token_index, label, state) with the states
    of the masked input at masked places, ``edges`` (text_id, src, dst, target), reliable ones only, between words that
    have tokens. A text is held by one task as a whole.
    """
    listed = lambda df, name, kind, *c: df.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct(*c))).cast(kind).alias(name))
    parts = (
        listed(tokens, "tokens", TOKENS, "token_index", "word", "state"),
        listed(masked, "masked", MASKED, "variant", "token_index", "label", "state"),
        listed(edges, "edges", EDGES, "src", "dst", "target"),
    )
    empty = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
    joined = parts[0].join(parts[1], "text_id", "left").join(parts[2], "text_id", "left")
    return written(joined.select("text_id", "tokens", empty("masked", MASKED), empty("edges", EDGES)), "texts")


def text_gradient(row: dict, variant: int, p: Parameters, head: np.ndarray, bias: np.ndarray, weight: float) -> np.ndarray:
    """(token loss, edge loss, gradient) of one text in one variant, flat."""
    total = np.zeros(2 + len(p.flat))
    parts = p.parts(total[2:])
    field = lambda name, key: [x[key] for x in row[name]]
    masked = [x for x in row["masked"] if x["variant"] == variant]
    hidden = np.array([x["state"] for x in masked]).reshape(-1, p.width)
    total[0] = token_loss(hidden, np.array([x["label"] for x in masked], int), head, bias, p, parts)
    if weight:
        ends = (np.array(field("edges", "src"), int), np.array(field("edges", "dst"), int), np.array(field("edges", "target"), float))
        total[1] = edge_loss(np.array(field("tokens", "state")).reshape(-1, p.width), np.array(field("tokens", "word")), ends, p, parts, weight)
    return total


def step_gradient(laid: DataFrame, chosen: dict[str, int], p: Parameters, head: np.ndarray, bias: np.ndarray, weight: float) -> np.ndarray:
    """Mean of ``text_gradient`` over the chosen texts, each with its variant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 2 + len(p.flat)))
        for batch in batches:
            for row in batch.to_pylist():
                total[0] += text_gradient(row, chosen[row["text_id"]], p, head, bias, weight)
        yield from chunks_of(total)

    texts = laid.where(F.col("text_id").isin(*chosen))
    return tree_sum(texts.mapInArrow(run, SUMS), (1, 2 + len(p.flat)))[0] / len(chosen)


def train(
    laid: DataFrame,
    texts: list[str],
    variants: int,
    steps: int,
    width: int,
    head: np.ndarray,
    bias: np.ndarray,
    weight: float,
    rank: int = 16,
    seed: int = 0,
    at_once: int = 1,
) -> tuple[Parameters, list[tuple[int, float, float, float]]]:
    """The parameters after ``steps``, and (step, token loss, edge loss, norm of the gradient) of each before it was taken.

    Step i takes the i-th ``at_once`` texts of the list, in turn, in variant i modulo ``variants``. ``weight`` 0 trains
    on tokens alone. Runs of equal arguments are equal but for the order of sums.
    """
    p = Parameters.start(width, rank, seed)
    first, second, curve = np.zeros_like(p.flat), np.zeros_like(p.flat), []
    for t in range(1, steps + 1):
        chosen = {texts[((t - 1) * at_once + k) % len(texts)]: (t - 1) % variants for k in range(at_once)}
        found = step_gradient(laid, chosen, p, head, bias, weight)
        gradient, norm = found[2:], float(np.linalg.norm(found[2:]))
        curve.append((t, float(found[0]), float(found[1]), norm))
        gradient = gradient * min(1.0, CLIP / (norm + 1e-6))
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient * gradient - second)
        step = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        p.flat = p.flat * (1 - RATE * DECAY) - RATE * step
    return p, curve


def predictions(laid: DataFrame, p: Parameters) -> DataFrame:
    """(text_id, src_word, target, prediction) of every edge, through the adapter and the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, bias = p.parts()[4:]
        for batch in batches:
            for row in batch.to_pylist():
                if not row["edges"]:
                    continue
                out = _Adapted(np.array([x["state"] for x in row["tokens"]]).reshape(-1, p.width), p).out
                words = np.array([x["word"] for x in row["tokens"]])
                of = {w: out[words == w].mean(0) for w in np.unique(words)}
                scores = [float((left @ of[e["src"]]) @ (right @ of[e["dst"]])) / math.sqrt(p.rank) + float(bias[0]) for e in row["edges"]]
                columns = [[row["text_id"]] * len(scores), [e["src"] for e in row["edges"]], [e["target"] for e in row["edges"]], scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.float64()))], ["text_id", "src_word", "target", "prediction"])

    return laid.mapInArrow(run, "text_id string, src_word int, target double, prediction double")
