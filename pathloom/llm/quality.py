"""Quality classifier: random-indexing vectors, pooled by document, and a two-layer network.

A word gives three tokens: its letters in lower case, its shape (case pattern and marks), and whether it is the word
before it once more. The first two are hashed into a fixed number of slots. A slot has a sparse random index vector, a
function of its number, and a context vector: the sum of the index vectors of the tokens beside it, over all documents.
Each task sums its own part of that table, and the parts are added up by ranges of slots, so what moves and what is
broadcast has a fixed size. The third token has one of two index vectors of its own. A document's features are the means
of its tokens' vectors, each of the three kinds by itself, and nothing else. The network is fitted on a bounded sample
of the labelled rows; a temperature, fitted on a part of the sample that the network did not see, calibrates its
probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pathloom.llm.common import bounded_batches, column, packed, releasing, tree_sum
from pathloom.llm.words import hashes, portions, split_words

SLOT_BITS, DIM, NONZERO = 15, 64, 4
SLOTS = 1 << SLOT_BITS
#: Labelled rows that the network is fitted on, at most.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 30, 256, 3e-3, 1e-2, 11
THRESHOLD = 0.3
HOLD_OUT_FOLDS = 5
#: Ranges of slots that a task's table is cut into, and the tasks that add them up at last. A range is at most 128 KB.
_RANGES, _ADDERS = 128, 16
_RANGE_SLOTS = SLOTS // _RANGES
#: Bytes of texts whose words are held as arrays at a time, and words whose vectors are.
_PORTION_BYTES, _BLOCK_WORDS = 4_000_000, 1 << 14


def slots(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the slot of its letters in lower case and the slot of its shape.

    The shape is the letters' case (none, lower, upper, capitalised, mixed) and, of the first 16 characters,
    the marks around runs of letters. A shape holds a colon, which letters never do.
    """
    plain = pc.utf8_is_alpha(distinct)
    odd = distinct.filter(pc.invert(plain))
    letters = pc.replace_with_mask(distinct, pc.invert(plain), pc.replace_substring_regex(odd, r"[^\p{L}]+", ""))
    marks = pc.utf8_slice_codeunits(pc.replace_substring_regex(odd, r"\p{L}+", "a"), 0, 16)
    marks = pc.replace_with_mask(pa.array(["a"] * len(distinct), distinct.type), pc.invert(plain), marks)
    lower = pc.utf8_lower(letters)
    kinds = pc.make_struct(
        pc.equal(pc.binary_length(letters), 0),
        pc.equal(letters, lower),
        pc.equal(letters, pc.utf8_upper(letters)),
        pc.equal(letters, pc.utf8_capitalize(letters)),
        field_names=["none", "lower", "upper", "capital"],
    )
    case = pc.case_when(kinds, *(pa.scalar(c, distinct.type) for c in ("0:", "x:", "X:", "Xx:", "xX:")))
    shapes = pc.binary_join_element_wise(case, marks, "").dictionary_encode()
    slot_of = lambda words: (hashes(words) % np.uint64(SLOTS)).astype(np.int64)
    return slot_of(lower), slot_of(shapes.dictionary)[shapes.indices.to_numpy(zero_copy_only=False)]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero components of every slot's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (SLOTS, NONZERO)), rng.choice((-1.0, 1.0), (SLOTS, NONZERO))


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(SLOTS * DIM)
    for texts in (p for batch in batches for p in portions(batch.column(0), _PORTION_BYTES)):
        counts, words, distinct = split_words(texts)
        inside = np.ones(len(words), bool)
        inside[(np.cumsum(counts) - counts)[counts > 0]] = False
        later = np.flatnonzero(inside)
        for slot in slots(distinct) if len(later) else ():
            after, before = slot[words[later]], slot[words[later - 1]]
            for target, neighbour in ((after, before), (before, after)):
                for j in range(NONZERO):
                    total += np.bincount(target * DIM + place[neighbour, j], sign[neighbour, j], SLOTS * DIM)
    for r, part in enumerate(np.split(total, _RANGES)):
        yield _sums_row(r, part)


def _sums_row(r: int, part: np.ndarray) -> pa.RecordBatch:
    """A range's sums, which are whole numbers, in the narrowest integers that hold them."""
    most = np.abs(part).max()
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << (8 * w - 1))
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part.astype(f"<i{width}").tobytes()], pa.binary())], ["range", "sums"])


def _sums_read(sums: bytes) -> np.ndarray:
    return np.frombuffer(sums, f"<i{len(sums) // (_RANGE_SLOTS * DIM)}")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            if r not in totals:
                totals[r] = np.zeros(_RANGE_SLOTS * DIM, np.int64)
            totals[r] += _sums_read(sums.as_py())
    for r, total in totals.items():
        yield _sums_row(r, total)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A unit vector for each slot: its own index vector and what it was seen beside, over all documents."""
    bounded_batches(docs)
    parts = tree_sum(docs.select(text_col).mapInArrow(releasing(_context_sums), "range int, sums binary"), _added, "range int, sums binary", _ADDERS)
    table = np.zeros((SLOTS, DIM))
    for r, sums in parts.collect():  # a table of fixed size, in _RANGES rows
        table[r * _RANGE_SLOTS : (r + 1) * _RANGE_SLOTS] += _sums_read(sums).reshape(-1, DIM)
    place, sign = index_vectors()
    own = np.zeros((SLOTS, DIM))
    np.add.at(own, (np.arange(SLOTS)[:, None], place), sign)
    unit = lambda m: m / np.maximum(np.sqrt((m**2).sum(1, keepdims=True)), 1e-12)
    return (0.5 * (unit(table) + unit(own))).astype(np.float32)


def _sums(tables: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray) -> np.ndarray:
    """Sums over the words of each text of what the tables hold for them, a block of words at a time.

    Beside each table is every word's row in it. A text is cut from its own beginning, and added up in one way
    whatever stands beside it, so that equal texts have equal sums.
    """

    def rows(begin: int, end: int) -> np.ndarray:
        held = tables[0][0][tables[0][1][begin:end]]
        for table, row in tables[1:]:
            held += table[row[begin:end]]
        return held

    out = np.zeros((len(counts), tables[0][0].shape[1]))
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        begin = int(ends[i] - counts[i])
        if counts[i] > _BLOCK_WORDS:
            for a in range(begin, int(ends[i]), _BLOCK_WORDS):
                out[i] += rows(a, min(a + _BLOCK_WORDS, int(ends[i]))).sum(0, dtype=np.float64)
            i += 1
            continue
        j = int(np.searchsorted(ends, begin + _BLOCK_WORDS, "right"))
        held = np.flatnonzero(counts[i:j]) + i
        if len(held):
            out[held] = np.add.reduceat(rows(begin, int(ends[j - 1])), ends[held] - counts[held] - begin, axis=0)
        i = j
    return out


def _again(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Share of each text's words that are the word before."""
    same = np.zeros(len(words) + 1)
    same[2:] = words[1:] == words[:-1]
    ends = np.cumsum(counts)
    same[(ends - counts)[counts > 0] + 1] = 0
    sums = np.cumsum(same)
    return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


def repeat_vectors() -> np.ndarray:
    """Unit index vectors of the third token: of a word that is the one before it, and of one that is not."""
    rng = np.random.default_rng(SEED + 1)
    own = np.zeros((2, DIM))
    np.add.at(own, (np.arange(2)[:, None], rng.integers(0, DIM, (2, NONZERO))), rng.choice((-1.0, 1.0), (2, NONZERO)))
    return own / np.sqrt((own**2).sum(1, keepdims=True))


def _placed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By portion of texts: their numbers of words, each word's slots of letters and of shape, the texts' shares of repeats."""
    for part in portions(texts, _PORTION_BYTES):
        counts, words, distinct = split_words(part)
        letters, shape = slots(distinct)
        del distinct
        yield counts, letters[words], shape[words], _again(words, counts)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of texts: means of the word, of the shape and of the repeat vectors."""
    third, parts = repeat_vectors(), []
    for counts, letters, shape, again in _placed(texts):
        size, new = np.maximum(counts, 1)[:, None], (counts > 0) - again
        repeats = np.outer(again, third[0]) + np.outer(new, third[1])
        parts.append(np.hstack([_sums([(vectors, letters)], counts) / size, _sums([(vectors, shape)], counts) / size, repeats]))
    return np.concatenate([np.zeros((0, 3 * DIM)), *parts])


class Network:
    """Two layers over standardised features; the output's logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        self.temperature = 1.0
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5) if len(x) >= 10 else 0
        check, fit = order[:cut], order[cut:]
        self.w1 = rng.standard_normal((x.shape[1], HIDDEN)) / math.sqrt(x.shape[1])
        self.b1, self.w2 = np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / math.sqrt(HIDDEN)
        rate = float(np.clip(y[fit].mean(), 1e-3, 1 - 1e-3)) if len(fit) else 0.5
        self.b2 = np.array(math.log(rate / (1 - rate)))
        if len(np.unique(y[fit] >= 0.5)) < 2:
            self.w2[:] = 0  # one class only: its rate
            return
        self._fit((x[fit] - self.mean) / self.scale, y[fit], rng)
        if cut:
            grid = np.exp(np.linspace(math.log(0.25), math.log(8), 121))
            z = self.logits(x[check])
            losses = [np.mean(np.logaddexp(0, z / t) - y[check] * z / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        weights = [self.w1, self.b1, self.w2, self.b2]
        first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                xb, yb = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
                h = np.tanh(xb @ self.w1 + self.b1)
                g = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - yb) / len(xb)
                back = np.outer(g, self.w2) * (1 - h**2)
                t += 1
                for w, d, m, v in zip(
                    weights,
                    (xb.T @ back + DECAY * self.w1, back.sum(0), h.T @ g + DECAY * self.w2, g.sum()),
                    first,
                    second,
                ):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d**2 - v)
                    w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._calibrated(self.logits(x))

    def _calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -60, 60)))

    def scorer(self, vectors: np.ndarray):
        """From texts to probabilities. The first layer is linear in the means, so it is applied to the slots' vectors once."""
        layer = self.w1 / self.scale[:, None]
        first, second = ((vectors @ layer[i * DIM : (i + 1) * DIM]).astype(np.float32) for i in range(2))
        third = repeat_vectors() @ layer[2 * DIM :]
        bias = self.b1 - self.mean @ layer

        def score(texts: pa.Array) -> np.ndarray:
            parts = []
            for counts, letters, shape, again in _placed(texts):
                means = _sums([(first, letters), (second, shape)], counts) / np.maximum(counts, 1)[:, None]
                means += np.outer(again, third[0]) + np.outer((counts > 0) - again, third[1])
                # A sum for each row, not a product of matrices, which rounds by a row's place among the others.
                parts.append(self._calibrated((np.tanh(means + bias) * self.w2).sum(1) + self.b2))
            return np.concatenate([np.zeros(0), *parts])

        return score


def fold(id_col: str = "doc_id", folds: int = HOLD_OUT_FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def fit_network(
    docs: DataFrame,
    labels: DataFrame,
    vectors: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Network | None:
    """The network, fitted on at most ``sample_rows`` labelled rows of the folds that are learned from; None without any."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 0))
    known = usable.groupBy(F.col(id_col).alias("_labelled")).agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
    # A row's place in the sample is its hash's, so that every label may be drawn; at most sample_rows ids.
    drawn = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample_rows)
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(0), table.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()), batch.column(1), batch.column(2)],
                ["x", "y", "id"],
            )

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    labelled = rows.join(F.broadcast(drawn), F.col("_id") == F.col("_labelled")).select("_text", "_label", F.col("_id").cast("string"))
    # Rows may repeat an id, so the limit holds for rows, too.
    found = labelled.mapInArrow(releasing(features), "x binary, y double, id string").orderBy(F.xxhash64("id"), "id", "x").limit(sample_rows).collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: (r[2], r[0]))
    return Network(np.array([np.frombuffer(r[0], "<f4") for r in found], float), np.array([r[1] for r in found]))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Labels are learned from rows whose fold (CRC-32 of the id modulo 5) is not 0, at most ``sample_rows``
    of them by a hash of the id; several labels of an id are averaged, null ones left out. Without labels
    of both classes every score is the rate of the labels there are (0.5 without any). Null texts count as
    empty, and empty texts have a score too; texts of any length are scored whole. Null ids are never
    labelled; rows that repeat an id are scored each, and equal texts alike. All columns pass through; a
    column of ``docs`` with the name of a new one is replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col)
    net = fit_network(docs, labels, vectors, id_col, text_col, label_col, sample_rows)
    shared = spark.sparkContext.broadcast(vectors)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    spot = kept.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = net.scorer(shared.value) if net else lambda texts: np.full(len(texts), 0.5)
        for batch in batches:
            columns = batch.column(0).flatten()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scorer(columns[spot]))], [*kept, "score"])

    rows = docs.select(*map(column, kept))
    scored = packed(rows).mapInArrow(releasing(score), StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("held_out", fold(id_col) == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
