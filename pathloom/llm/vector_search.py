"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Vectors are dealt into lists by their nearest centroid; the centroids are fitted on a bounded sample,
but every row is indexed. A query probes the lists whose centroids have the largest inner product with
it. In a list, vectors are rotated at random and kept in blocks of columns. Once a query has k exact
scores, the others must earn theirs: after each block the squared distance so far, scaled up to all
columns, is tested against the largest distance at which the candidate could still enter, and candidates
that fail are abandoned. What survives is scored exactly on the original vectors in double precision.

The number of lists to probe is the smallest that reaches a target recall on the sample; a query whose lists
hold fewer rows than it has neighbours to find goes on to the next ones until they do. Lists are cut
into parts of a bounded number of rows, so that many copies of one vector do not meet in one task, and
queries stream past the part that is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, shuffle_partitions

SAMPLE_ROWS = 20_000
PART_ROWS = 4096
COLUMN_BLOCK = 16
#: Queries that are scanned together: with a part's rows they bound what a worker holds, about 8 MB an array.
QUERY_BLOCK = 256
#: The hypothesis test's margin: larger abandons less.
EPSILON = 2.1
TARGET_RECALL = 0.95
SEED = 7


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector in double precision) of the vectors that take part, whatever their length."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    ) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k-means on the sample; empty lists keep their centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        nearest = nearest_list(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centroids))
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


def nearest_list(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids**2).sum(1)
    return np.concatenate(
        [np.argmax(vectors[i : i + 4096] @ centroids.T - half, axis=1) for i in range(0, len(vectors), 4096)] or [np.zeros(0, np.int64)]
    )


def choose_probes(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, n_queries: int = 400) -> int:
    """Smallest number of lists that holds ``target`` of the true neighbours within the sample."""
    queries = sample[: min(n_queries, len(sample))]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = np.argsort(-(queries @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, nearest_list(sample, centroids)[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


#: Stands for an id where there is none; the largest, so that ties leave it behind.
_NO_ID = np.iinfo(np.int64).max
#: Share of pairs below which they are scanned one by one.
_FEW = 0.03
#: Queries whose best candidates a task keeps at a time.
KEPT_QUERIES = 100_000


class Best:
    """The k best candidates so far of the queries that a task has met."""

    def __init__(self, k: int):
        self.k, self.row_of = k, {}
        self.ids, self.scores = np.full((1024, k), _NO_ID), np.full((1024, k), -np.inf)

    def rows(self, queries: np.ndarray) -> np.ndarray:
        """The rows of queries, new ones for those that had none."""
        rows = np.array([self.row_of.setdefault(q, len(self.row_of)) for q in queries.tolist()], np.int64)
        if len(self.row_of) > len(self.ids):
            more = max(len(self.ids), len(self.row_of) - len(self.ids))
            self.ids = np.concatenate([self.ids, np.full((more, self.k), _NO_ID)])
            self.scores = np.concatenate([self.scores, np.full((more, self.k), -np.inf)])
        return rows

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in candidates of distinct rows."""
        ids, scores = np.concatenate([self.ids[rows], ids], axis=1), np.concatenate([self.scores[rows], scores], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.ids[rows], self.scores[rows] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def batch(self) -> pa.RecordBatch:
        queries = np.repeat(np.fromiter(self.row_of, np.int64, len(self.row_of)), self.k)
        ids, scores = self.ids[: len(self.row_of)].ravel(), self.scores[: len(self.row_of)].ravel()
        found = scores > -np.inf
        columns = (queries[found], ids[found], scores[found])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])


class Part:
    """Vectors of a part of a list: rotated, in blocks of columns."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, block: int):
        self.ids, self.vectors, self.rotation = ids, vectors, rotation
        rotated = vectors @ rotation
        self.blocks = [np.ascontiguousarray(rotated[:, i : i + block]) for i in range(0, rotated.shape[1], block)]
        self.norms = (vectors**2).sum(1)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, epsilon: float, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of each query, a row for each, best first and ties to smaller ids; empty places score -inf.

        ``bar`` is what a query's candidates must reach, -inf at first; the k-th best of the first 4 k vectors may raise
        it. All queries are scanned at once, block of columns by block: a pair of query and candidate that fails a test
        is abandoned. While many pairs are left, a block's distances come from one product of matrices; of few, pair
        by pair.
        """
        n, dim = self.vectors.shape
        first = min(4 * k, n)
        other = self.ids != ids[:, None]
        near = np.where(other[:, :first], queries @ self.vectors[:first].T, -np.inf)
        if first >= k:
            bar = np.maximum(bar, np.partition(near, first - k, axis=1)[:, first - k])
        q, c = np.nonzero(near >= self._floor(bar))
        about = near[q, c]
        if n > first:
            at, which, rest = self._scan(queries, other[:, first:], first, bar, epsilon, dim)
            q, c, about = np.concatenate([q, at]), np.concatenate([c, which]), np.concatenate([about, rest])
        # Of what is left, those that can be among the k best but for rounding are scored on the original vectors.
        order = np.lexsort((-about, q))
        q, c, about = q[order], c[order], about[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kth = np.maximum(bar, -np.inf)
        kth[q[rank == k - 1]] = np.maximum(kth[q[rank == k - 1]], about[rank == k - 1])
        keep = about >= self._floor(kth)[q, 0]
        q, c = q[keep], c[keep]
        # The same sum for the same vectors, wherever they stand.
        scores = (self.vectors[c] * queries[q]).sum(1)
        order = np.lexsort((self.ids[c], -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < k
        found = np.full((len(ids), k), _NO_ID), np.full((len(ids), k), -np.inf)
        found[0][q[best], rank[best]], found[1][q[best], rank[best]] = self.ids[c[best]], scores[best]
        return found

    @staticmethod
    def _floor(bar: np.ndarray) -> np.ndarray:
        """A column of bars, lowered by more than rounding; no bar admits every defined score."""
        return np.where(np.isfinite(bar), bar - 1e-9 * (1 + np.abs(bar)), -np.finfo(float).max)[:, None]

    def _scan(
        self, queries: np.ndarray, alive: np.ndarray, first: int, bar: np.ndarray, epsilon: float, dim: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score but for rounding) of the pairs behind the first vectors that pass every test."""
        length, turned, norms = (queries**2).sum(1), queries @ self.rotation, self.norms[first:]
        with np.errstate(invalid="ignore"):
            limit = np.maximum(length[:, None] + norms - 2 * bar[:, None], 0)
        partial, done, at = np.zeros(alive.shape), 0, None
        for columns in self.blocks:
            begin, done = done, done + columns.shape[1]
            own, block = turned[:, begin:done], columns[first:]
            if at is None and alive.sum() < _FEW * alive.size:
                at, which = np.nonzero(alive)
                partial, limit = partial[at, which], limit[at, which]
            if at is None:
                partial += (own**2).sum(1)[:, None] + (block**2).sum(1) - 2 * own @ block.T
                alive = alive & self._passes(partial, limit, done, dim, epsilon)
            else:
                partial = partial + ((block[which] - own[at]) ** 2).sum(1)
                keep = self._passes(partial, limit, done, dim, epsilon)
                at, which, partial, limit = at[keep], which[keep], partial[keep], limit[keep]
        if at is None:
            at, which = np.nonzero(alive)
            partial = partial[at, which]
        return at, first + which, (length[at] + norms[which] - partial) / 2

    @staticmethod
    def _passes(partial: np.ndarray, limit: np.ndarray, done: int, dim: int, epsilon: float) -> np.ndarray:
        """If the squared distance so far, scaled up to all columns, may still be within the limit."""
        return partial * dim <= limit * done * (1 + epsilon / np.sqrt(done)) ** 2 + 1e-9


def _distinct(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most QUERY_BLOCK distinct ids in order, and where they stand; a repeated id is in a later block."""
    left = np.arange(len(ids))
    while len(left):
        _, first = np.unique(ids[left], return_index=True)
        first = np.sort(first)
        for i in range(0, len(first), QUERY_BLOCK):
            where = left[first[i : i + QUERY_BLOCK]]
            yield ids[where], where
        left = np.delete(left, first)


def nearest(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    part_rows: int = PART_ROWS,
    target_recall: float = TARGET_RECALL,
    epsilon: float = EPSILON,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is a multiple of ``query_every``, its k nearest.

    Nearness is the largest inner product; ties go to the smaller id. No row of a query's own id is its
    neighbour, rows of other ids with an equal vector are. Rows that repeat an id are candidates each; where
    they are queries, their neighbours are ranked together, a neighbour once for each of them. Vectors that
    are null, empty, zero or hold null or non-finite components take no part, nor do null ids, nor vectors
    of another length than the most frequent one (the smaller of two as frequent). Fewer candidates than k
    give fewer rows; an empty table gives none. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    bounded_batches(vectors)
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.col("n").desc(), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = most["dim"]
    rows = rows.where(F.size("v") == dim)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column(0).combine_chunks()
    sample = np.asarray(drawn.flatten()).reshape(-1, dim)
    # The lists follow the table's size, within what the sample can fit.
    n_lists = int(max(1, min(round(most["n"] ** 0.5), len(sample) // 16)))
    centroids = fit_centroids(sample, n_lists)
    probes = choose_probes(sample, centroids, k, target_recall)
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]
    index = spark.sparkContext.broadcast((centroids, rotation))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, _ = index.value
        for batch in batches:
            matrix = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
            where = nearest_list(matrix, centers).astype(np.int32)
            packed = [row.tobytes() for row in matrix]
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column(0), pa.array(packed, pa.binary())], ["list", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, _ = index.value
        for batch in batches:
            matrix = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
            order = np.argsort(-(matrix @ centers.T), axis=1, kind="stable").astype(np.int32)
            # Besides the lists that every query probes, those up to which there are k rows of other ids.
            short = np.cumsum(held_rows.value[order], axis=1) < k + batch.column(2).to_numpy()[:, None]
            counts = np.minimum(np.maximum(probes, short.sum(1) + 1), order.shape[1])
            taken = pa.array(np.repeat(np.arange(len(matrix)), counts))
            packed = pa.array([row.tobytes() for row in matrix], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[np.arange(order.shape[1]) < counts[:, None]]), batch.column(0).take(taken), packed.take(taken)],
                ["list", "id", "v"],
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of list, part and kind: a part's vectors, then the queries that stream past it.

        A query's k best of a task's parts so far are the bar for the next part.
        """
        _, turn = index.value
        at, ids, held, part, best = None, [], [], None, Best(k)
        for batch in batches:
            places = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            keys = batch.column(3).to_numpy()
            edges = np.flatnonzero(np.append(True, (places[1:] != places[:-1]).any(axis=1))).tolist()
            for a, b in zip(edges, [*edges[1:], len(places)]):
                if at != tuple(places[a, :2]):
                    at, ids, held, part = tuple(places[a, :2]), [], [], None
                data = b"".join(batch.column(4).slice(a, b - a).to_pylist())
                if places[a, 2] == 0:
                    ids.append(keys[a:b])
                    held.append(data)
                elif ids:
                    if part is None:
                        part = Part(np.concatenate(ids), np.frombuffer(b"".join(held)).reshape(-1, dim), turn, COLUMN_BLOCK)
                        held = []
                    queries = np.frombuffer(data).reshape(-1, dim)
                    for own, i in _distinct(keys[a:b]):
                        if len(best.row_of) + len(own) > KEPT_QUERIES:
                            yield best.batch()
                            best = Best(k)
                        rows_of = best.rows(own)
                        best.merge(rows_of, *part.search(own, queries[i], k, epsilon, best.scores[rows_of, -1]))
        yield best.batch()

    dealt = rows.mapInArrow(deal, "list int, id long, v binary")
    # One number for each list; the lists are bounded by the sample.
    found_rows = dealt.groupBy("list").count().collect()
    row_counts = np.zeros(len(centroids), np.int64)
    row_counts[[r[0] for r in found_rows]] = [r[1] for r in found_rows]
    held_rows = spark.sparkContext.broadcast(row_counts)
    sizes = spark.createDataFrame([(r[0], -(-r[1] // part_rows)) for r in found_rows], "list int, parts int")
    parted = dealt.join(F.broadcast(sizes), "list").select(
        "list",
        F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
        F.lit(0).alias("kind"),
        "id",
        "v",
    )
    queries = rows.where(F.col("id") % query_every == 0)
    # Rows of a query's own id are no neighbours.
    own = queries.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    asked = queries.join(own, "id").select("id", "v", "own").mapInArrow(probe, "list int, id long, v binary")
    asked = asked.join(F.broadcast(sizes), "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(1).alias("kind"),
        "id",
        "v",
    )
    met = parted.unionByName(asked).repartition(
        shuffle_partitions(spark),
        "list",
        "part",
    ).sortWithinPartitions("list", "part", "kind", "id")
    candidates = met.mapInArrow(scan, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return candidates.withColumn(
        "rank",
        F.row_number().over(nearest_first),
    ).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
