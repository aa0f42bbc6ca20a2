"""Fits of many responses over one design of any size, by Newton steps whose sums are taken for all responses at once.

A response is a set of counts on the design: those of a draw's half, or the design's own counts weighed by how often a
draw has their text; with folds, each response has a fit for each fold held out. The design is laid out once, a row for
each source with its candidates, and stays where it is written. A round reads it, scores the candidates under every
fit's coefficients, and adds up each fit's loss, gradient and curvature as arrays, in tasks and then in a tree; what a
round moves is these sums, whatever the design's size. The steps are taken on the driver, which holds P^2 numbers a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.bounds import few
from pathloom.sources.scratch import written

#: Responses that a study may have, fits that are under way at a time, and numbers that a task works on at a time.
MOST_RESPONSES, FITS, NUMBERS = 1_000_000, 4_000, 4_000_000
#: Tasks whose sums meet in a first step, and fits whose sums go together.
FAN_IN, CHUNK = 64, 64
SOURCE = ["text_id", "src_word"]
KEYS = [*SOURCE, "dst_word"]
SUMS = "chunk int, sums binary"
Sources = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]


class NotConverged(RuntimeError):
    pass


def number_responses(sides: DataFrame, by: list[str]) -> list[tuple]:
    """The responses in order; a response's number is its place."""
    rows = few(sides.select(*by).distinct(), MOST_RESPONSES, "responses")
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def lay_out(design: DataFrame, names: tuple[str, ...], folds: DataFrame | None = None, count: bool = False) -> DataFrame:
    """(text_id, src_word, fold, cells): each source's candidates in order, with their features and, if asked, their count."""
    placed = design.join(folds, "text_id") if folds is not None else design.withColumn("fold", F.lit(0))
    own = F.col("count").cast("double") if count else F.lit(0.0)
    cell = F.struct("dst_word", F.array(*[F.col(n).cast("double") for n in names]).alias("x"), own.alias("count"))
    return placed.groupBy(*SOURCE).agg(F.first("fold").cast("int").alias("fold"), F.sort_array(F.collect_list(cell)).alias("cells"))


def with_counts(laid: DataFrame, counts: DataFrame, responses: list[tuple], by: list[str]) -> DataFrame:
    """``laid`` with ``counts``: (response, dst_word, count) of each source, from sparse rows (by, KEYS, count)."""
    spark = laid.sparkSession
    kinds = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by)
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(responses)], f"{kinds}, _r int")
    entry = F.struct("_r", "dst_word", F.col("count").cast("double").alias("count"))
    same = F.lit(True)
    for k in by:
        same = same & counts[k].eqNullSafe(numbered[k])
    tallies = counts.join(F.broadcast(numbered), same).groupBy(*SOURCE).agg(F.collect_list(entry).alias("counts"))
    return laid.join(tallies, SOURCE, "left").withColumn("times", F.lit(None).cast("array<struct<_r:int,times:double>>"))


def with_times(laid: DataFrame, draws: DataFrame, responses: list[tuple]) -> DataFrame:
    """``laid`` with ``times``: how often each draw has the source's text, from (draw, text_id, times)."""
    numbered = laid.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(responses)], "draw int, _r int")
    entry = F.struct("_r", F.col("times").cast("double").alias("times"))
    drawn = draws.join(F.broadcast(numbered), "draw").groupBy("text_id").agg(F.collect_list(entry).alias("times"))
    return laid.withColumn("counts", F.lit(None).cast("array<struct<_r:int,dst_word:bigint,count:double>>")).join(drawn, "text_id", "left")


def _over(f: Callable[[np.ndarray, np.ndarray], np.ndarray], values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``f`` of each column of ``values``; along rows numpy is several times slower where columns are few."""
    return np.column_stack([f(np.ascontiguousarray(v), by) for v in values.T]) if values.shape[1] <= 4 else f(values, by)


def _by_source(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums (sources x columns) of cells' numbers."""
    return _over(lambda v, at: np.add.reduceat(v, at, axis=0), values, starts)


def _wide(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each source's numbers for each of its cells."""
    return _over(lambda v, n: np.repeat(v, n, axis=0), values, lengths)


class Block:
    """Some sources of a batch, as arrays: cells in order, where each source's begin, and the counts of every response."""

    def __init__(self, rows: pa.Table, features: int, first: int, stop: int):
        cells = rows["cells"].combine_chunks()
        lengths = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = cells.flatten()
        self.x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
        self.dst = flat.field("dst_word").to_numpy(zero_copy_only=False)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.fold = rows["fold"].to_numpy()
        self.source = np.repeat(np.arange(len(lengths)), lengths)
        self.count = np.zeros((len(self.x), stop - first))
        times = rows["times"].combine_chunks()
        given = rows["counts"].combine_chunks()
        if len(times.flatten()):
            entry = times.flatten()
            times_of = np.zeros((len(lengths), stop - first))
            owner = np.repeat(np.arange(len(lengths)), times.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            r = entry.field("_r").to_numpy() - first
            on = (r >= 0) & (r < stop - first)
            np.add.at(times_of, (owner[on], r[on]), entry.field("times").to_numpy()[on])
            self.count += flat.field("count").to_numpy(zero_copy_only=False)[:, None] * times_of[self.source]
        if len(given.flatten()):
            entry = given.flatten()
            owner = np.repeat(np.arange(len(lengths)), given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            r, dst = entry.field("_r").to_numpy() - first, entry.field("dst_word").to_numpy()
            # A source's candidates are in order, so (source, candidate) is sorted; counts of others fall away.
            low, high = min(int(self.dst.min()), int(dst.min())), max(int(self.dst.max()), int(dst.max()))
            if len(lengths) * (high - low + 1) < 1 << 62:
                keys, asked = self.source * (high - low + 1) + (self.dst - low), owner * (high - low + 1) + (dst - low)
            else:
                values, code = np.unique(np.concatenate([self.dst, dst]), return_inverse=True)
                keys, asked = self.source * len(values) + code[: len(self.dst)], owner * len(values) + code[len(self.dst) :]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            on = (r >= 0) & (r < stop - first) & (keys[at] == asked)
            np.add.at(self.count, (at[on], r[on]), entry.field("count").to_numpy()[on])

    def probabilities(self, beta: np.ndarray, cells: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells x fits) probabilities under coefficients (fits x features), and the log of each source's sum."""
        s = self.x[cells] @ beta.T
        top = _over(lambda v, at: np.maximum.reduceat(v, at, axis=0), s, starts)
        e = np.exp(s - _wide(top, lengths))
        z = _by_source(e, starts)
        return e / _wide(z, lengths), np.log(z) + top


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    return (pa.Table.from_batches([batch]) for batch in batches)


def _blocks(tables: Iterator[pa.Table], features: int, first: int, stop: int, wide: int) -> Iterator[tuple[pa.Table, Block]]:
    """The tables' rows in blocks of a bounded number of cells times ``wide``."""
    for rows in tables:
        cells = np.cumsum(rows["cells"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        limit, start = max(1, NUMBERS // max(1, wide)), 0
        while start < rows.num_rows:
            done = int(cells[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(cells, done + limit, "right")))
            part = rows.slice(start, end - start)
            yield part, Block(part, features, first, stop)
            start = end


def _shares(block: Block) -> Iterator[tuple[int, slice, np.ndarray]]:
    """(fold, responses, sources) of a block that have counts together; where few have, each response is on its own."""
    mass = _by_source(block.count, block.starts) if len(block.starts) else np.zeros(block.count[:0].shape)
    several = mass.shape[1] > 1 and 2 * np.count_nonzero(mass) <= mass.size
    for f in np.unique(block.fold):
        mine = block.fold == f
        for r in range(mass.shape[1]) if several else [None]:
            sources = mine & (mass[:, r] > 0) if several else mine
            if sources.any():
                yield int(f), slice(r, r + 1) if several else slice(None), sources


def _sums(block: Block, beta: np.ndarray, total: np.ndarray, n_folds: int) -> None:
    """Add to ``total`` (responses x held folds x numbers) the loss, mass, gradient and curvature of a block's sources."""
    features = block.x.shape[1]
    upper = np.triu_indices(features)
    for f, r, mine in _shares(block):
        cells = mine[block.source]
        lengths = block.lengths[mine]
        starts = np.cumsum(lengths) - lengths
        x, c = block.x[cells], block.count[cells, r]
        mass = _by_source(c, starts)
        products = x[:, upper[0]] * x[:, upper[1]]
        for held in range(n_folds):
            if n_folds > 1 and held == f:
                continue
            p, log_sum = block.probabilities(beta[r, held], cells, starts, lengths)
            w = p * _wide(mass, lengths)
            out = total[r, held]
            out[:, 0] += (mass * log_sum).sum(0) - ((x.T @ c) * beta[r, held].T).sum(0)
            out[:, 1] += mass.sum(0)
            out[:, 2 : 2 + features] += (w - c).T @ x
            means = np.stack([_by_source(p * x[:, i : i + 1], starts) for i in range(features)])  # features x sources x fits
            spread = np.einsum("gr,igr,jgr->rij", mass, means, means, optimize=True)
            out[:, 2 + features :] += w.T @ products - spread[:, upper[0], upper[1]]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, values in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
            v = np.frombuffer(values)
            held[chunk] = held[chunk] + v if chunk in held else v
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["chunk", "sums"])


def tree_sum(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Arrays of (chunk, sums) rows of tasks, added up in two steps and put together."""
    near = parts.withColumn("near", (F.spark_partition_id() / FAN_IN).cast("int")).repartition("chunk", "near")
    added = near.select("chunk", "sums").mapInArrow(_add, SUMS).repartition("chunk").mapInArrow(_add, SUMS)
    total = np.zeros(shape)
    for chunk, sums in added.collect():  # a row for each chunk of fits
        at = chunk * CHUNK
        total[at : at + CHUNK] += np.frombuffer(sums).reshape(-1, *shape[1:])
    return total


def chunks_of(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums as (chunk, sums) rows, if it has any."""
    if total.any():
        starts = range(0, len(total), CHUNK)
        numbers = pa.array([i // CHUNK for i in starts], pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, pa.array([total[i : i + CHUNK].tobytes() for i in starts], pa.binary())], ["chunk", "sums"])


def numbers_of(features: int) -> int:
    """Numbers of a fit's sums: loss, mass, gradient, and the curvature's upper half."""
    return 2 + features + features * (features + 1) // 2


def _round(laid: DataFrame, beta: np.ndarray, first: int, n_folds: int, sources: Sources = _tables) -> np.ndarray:
    """Sums of all fits (responses x held folds x numbers) at their coefficients."""
    fits, _, features = beta.shape

    def partial(batches):
        total = np.zeros((fits, n_folds, numbers_of(features)))
        for _, block in _blocks(sources(batches), features, first, first + fits, fits):
            _sums(block, beta, total, n_folds)
        yield from chunks_of(total)

    return tree_sum(laid.mapInArrow(partial, SUMS), (fits, n_folds, numbers_of(features)))


def newton(round_: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], penalty: np.ndarray, max_rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Coefficients (shape x features) that minimise each fit's loss plus half its squared coefficients times ``penalty``.

    ``round_`` gives the sums of all fits at their coefficients. Each fit halves its own step until it helps; raises if
    one does not settle.
    """
    features = len(penalty)
    upper = np.triu_indices(features)
    beta, trial = np.zeros((*shape, features)), np.zeros((*shape, features))
    loss, size = np.full(shape, np.inf), np.ones(shape)
    step, slope = np.zeros((*shape, features)), np.zeros(shape)
    gradient = np.zeros((*shape, features))
    done = np.zeros(shape, bool)
    for _ in range(max_rounds):
        sums = round_(trial)
        new_loss = sums[..., 0] + 0.5 * (penalty * trial**2).sum(-1)
        better = ~done & ((new_loss <= loss - 1e-4 * size * slope) | np.isinf(loss))
        beta[better], loss[better] = trial[better], new_loss[better]
        gradient[better] = (penalty * trial + sums[..., 2 : 2 + features])[better]
        hessian = np.zeros((*shape, features, features))
        hessian[..., upper[0], upper[1]] = hessian[..., upper[1], upper[0]] = sums[..., 2 + features :]
        step[better] = np.linalg.solve((hessian + np.diag(penalty + 1e-10))[better], gradient[better][..., None])[..., 0]
        slope = (gradient * step).sum(-1)
        mass, steepest = sums[..., 1], np.abs(gradient).max(-1, initial=0)
        size = np.where(better, 1.0, size / 2)
        settled = better & ((steepest <= tolerance * (1 + mass)) | (slope <= 1e-12 * (1 + np.abs(loss))))
        beta[settled] -= step[settled]  # the rest is rounding; one last full step
        stuck = ~done & ~better & (size < 1e-10)
        if (stuck & (steepest > 1e-5 * (1 + mass))).any():
            raise NotConverged("no step lowers the loss")
        done |= settled | stuck
        if done.all():
            return beta
        trial = np.where(done[..., None], beta, beta - size[..., None] * step)
    raise NotConverged(f"no convergence in {max_rounds} rounds")


def fit_responses(laid: DataFrame, responses: int, features: int, n_folds: int = 1, l2: float = 1.0, sources: Sources = _tables, **limits) -> np.ndarray:
    """Coefficients (responses x held folds x features); with one fold nothing is held out. Raises if a fit does not settle.

    ``laid`` is read once a round and should be written somewhere; fits are taken some thousand at a time. ``sources``
    makes tables of sources from its batches, if it has other rows. ``limits`` are those of ``newton``.
    """
    at_once, parts = max(1, FITS // n_folds), []
    for first in range(0, responses, at_once):
        shape = (min(at_once, responses - first), n_folds)
        parts.append(newton(lambda beta, first=first: _round(laid, beta, first, n_folds, sources), shape, np.full(features, float(l2)), **limits))
    return np.concatenate(parts) if parts else np.zeros((0, n_folds, features))


def held_out_nll(laid: DataFrame, beta: np.ndarray, sources: Sources = _tables) -> np.ndarray:
    """(responses x 2): each response's counts and their negative log-likelihood, each text's by the fit that held out its fold."""
    responses, _, features = beta.shape

    def partial(batches):
        total = np.zeros((responses, 2))
        for _, block in _blocks(sources(batches), features, 0, responses, responses):
            for f, r, mine in _shares(block):
                cells, lengths = mine[block.source], block.lengths[mine]
                starts = np.cumsum(lengths) - lengths
                _, log_sum = block.probabilities(beta[r, f], cells, starts, lengths)
                c = block.count[cells, r]
                mass = _by_source(c, starts)
                total[r, 0] += mass.sum(0)
                total[r, 1] += (mass * log_sum).sum(0) - ((block.x[cells].T @ c) * beta[r, f].T).sum(0)
        yield from chunks_of(total)

    return tree_sum(laid.mapInArrow(partial, SUMS), (responses, 2))


def predict_responses(laid: DataFrame, beta: np.ndarray, responses: list[tuple], by: list[str], kinds: str, out: DataFrame) -> DataFrame:
    """(by, KEYS, count, probability) of every response and cell, each text by the fit that held out its fold."""
    features, at_once = beta.shape[2], 64
    key_kinds = ", ".join(f"{k} {out.schema[k].dataType.simpleString()}" for k in KEYS)
    schema = f"{kinds}, {key_kinds}, count double, probability double"
    empty = laid.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches):
        for batch in batches:
            for first in range(0, len(responses), at_once):
                stop = min(first + at_once, len(responses))
                for rows, block in _blocks(_tables([batch]), features, first, stop, 8 * at_once):
                    for f in np.unique(block.fold):
                        mine = block.fold == f
                        cells = mine[block.source]
                        lengths = block.lengths[mine]
                        p, _ = block.probabilities(beta[first:stop, f], cells, np.cumsum(lengths) - lengths, lengths)
                        n = int(cells.sum())
                        sources = pa.array(np.tile(block.source[cells], stop - first))
                        number = np.repeat(np.arange(first, stop), n)
                        columns = [pa.array([responses[i][k] for i in range(first, stop)], empty.field(k).type).take(pa.array(number - first)) for k in range(len(by))]
                        columns += [rows[c].combine_chunks().take(sources) for c in SOURCE]
                        columns += [pa.array(np.tile(block.dst[cells], stop - first)), pa.array(block.count[cells].T.ravel()), pa.array(p.T.ravel())]
                        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, empty.types)], empty.names)

    return laid.mapInArrow(run, schema)


def crossfit_responses(design: DataFrame, counts: DataFrame, names: tuple[str, ...], folds: DataFrame, by: list[str], sides: DataFrame, l2: float = 1.0) -> DataFrame:
    """(by, KEYS, count, probability): out-of-fold predictions of each response's counts on the one design."""
    responses = number_responses(sides, by)
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())  # folds are few
    place = F.create_map(*[x for i, f in enumerate(numbers) for x in (F.lit(f), F.lit(i))])
    numbered = folds.select("text_id", F.element_at(place, F.col("fold")).alias("fold"))
    laid = written(with_counts(lay_out(design, names, numbered), counts, responses, by), "responses")
    beta = fit_responses(laid, len(responses), len(names), len(numbers), l2)
    kinds = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by)
    return predict_responses(laid, beta, responses, by, kinds, design)


def fit_weighted(counted: DataFrame, draws: DataFrame, names: tuple[str, ...], l2: float = 1.0) -> DataFrame:
    """(draw, feature, coefficient) of fits that weigh each text's counts by its multiplicity in a draw."""
    responses = number_responses(draws, ["draw"])
    laid = written(with_times(lay_out(counted, names, count=True), draws, responses), "responses")
    beta = fit_responses(laid, len(responses), len(names), 1, l2)
    rows = [(responses[r][0], n, float(beta[r, 0, i])) for r in range(len(responses)) for i, n in enumerate(names)]
    return counted.sparkSession.createDataFrame(rows, "draw int, feature string, coefficient double")
