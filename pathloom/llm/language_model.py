"""Language-model scores: context-tree weighting over bytes, and the unigram baseline.

A text is its bytes, A-Z in lower case, and an end byte that UTF-8 never has. A byte is eight binary
decisions; each has, for the contexts of 0 to ``DEPTH`` bytes before it, a Krichevsky-Trofimov estimate
from the counts of the training texts, and the tree weighting mixes the estimates of all depths: a node's
probability of its counts is half its own estimate's and half the product of its children's, and how
these two compare gives its weight. A context that training never saw is no node, and the mix ends above it.

The tree is exact and grows with the corpus: every (context, byte) that occurs has its own count, none is
hashed into another's place or left out. Documents are dealt into chunks of a bounded size. A chunk asks for
each of its distinct (context, byte)s once, with its training count. The questions are dealt into ranges by
the two bytes before, so that a range holds whole subtrees from depth 2 down; their number grows with that of
the chunks. A range adds up the counts and sends up what depths 0 and 1, a table of fixed size, need of it;
once these are weighed, it answers each chunk with the log-probabilities of what the chunk asked.

The baseline's words go the same way: counts are added up by ranges of word hashes (64 bits), so a frequent
word is one entry a chunk, and the answers go back to the chunk, which keeps what its documents hold as
sparse arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, materialize, releasing, shuffle_partitions
from pathloom.llm.words import hashes, split_words

DEPTH = 5
END = 0xFF
HOLD_OUT_FOLDS, HELD_OUT_FOLD = 7, 2
CHUNK_BYTES, CHUNK_DOCS = 8_000_000, 8192
#: Bytes of texts whose contexts are held as arrays at a time.
PORTION_BYTES = 2_500_000
#: Chunks for each range of contexts; there are at least twice as many ranges as shuffle partitions.
CHUNKS_A_RANGE = 16
#: Questions of a range that are held before equal ones are added up.
_HELD = 2_000_000
#: Depths 0 and 1: a place for each byte before (depth 1) and each node of the byte's decisions.
_TOP = 1 << 16
_SLOT_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and their ends: the byte and the DEPTH bytes before it, as one number; and where texts begin."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join(pad + t.lower() + pad[:1] for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths + DEPTH) - lengths
    here = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    keys = np.zeros(len(here), np.uint64)
    for back in range(DEPTH + 1):
        keys |= data[here - back].astype(np.uint64) << np.uint64(8 * back)
    return keys, np.cumsum(lengths) - lengths


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def key_counts(texts: list[bytes], training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of texts, in order, and how often each is in those of them that are learned from."""
    held: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for group in _in_chunks(zip(texts, training.tolist()), PORTION_BYTES):
        keys, starts = grams([t for t, _ in group])
        learned = np.repeat(np.array([x for _, x in group], np.uint64), np.diff(starts, append=len(keys)))
        # Below the key whether it is learned from: one sort without an index.
        marked = np.sort(keys << np.uint64(1) | learned)
        first = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]]))
        times = np.diff(first, append=len(marked)).astype(np.uint64) * (marked[first] & np.uint64(1))
        held = _added(np.concatenate([held[0], marked[first] >> np.uint64(1)]), np.concatenate([held[1], times]))
    return held


def range_of(n_ranges: int) -> np.ndarray:
    """For every pair of bytes before, the range that holds its subtree."""
    pairs = np.arange(1 << 16, dtype=np.uint64)
    return (((pairs + np.uint64(1)) * _MIX >> np.uint64(40)) % np.uint64(n_ranges)).astype(np.uint16 if n_ranges <= 1 << 16 else np.uint32)


def _dealt(keys: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by range, and the range of each."""
    r = ranges[((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
    return np.argsort(r, kind="stable"), r


class Tree:
    """All nodes of some contexts of two bytes from depth 2 down, from the distinct keys in order and their training counts.

    Keys that were only asked for have the count 0. A key's low byte is the one decided, so that the keys that
    pass a node are neighbours among the keys cut to its depth.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {DEPTH: (keys, counts.astype(np.float64))}
        #: By depth, for each key of it the place of the key one depth higher.
        self.up: dict[int, np.ndarray] = {}
        for depth in range(DEPTH - 1, 0, -1):
            below, n = self.levels[depth + 1]
            cut, which = np.unique(below & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            self.levels[depth], self.up[depth + 1] = (cut, np.bincount(which, n, len(cut))), which

    def _nodes(self, depth: int, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First key of each node that decides ``bit``, the node of each key, and the nodes' zeros and ones."""
        keys, counts = self.levels[depth]
        node = keys >> np.uint64(bit + 1)
        new = np.concatenate([[True], node[1:] != node[:-1]])
        first = np.flatnonzero(new)
        ones = np.add.reduceat(counts * ((keys >> np.uint64(bit)) & np.uint64(1)), first)
        return first, np.cumsum(new) - 1, np.add.reduceat(counts, first) - ones, ones

    def _weighed(self, bit: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Of one bit: by depth, the deepest first, first keys of nodes, nodes of keys, own estimates (0: no node) and weights;
        and the nodes of depth 1, as places of the top, with their zeros, ones and the sums of their children."""
        chain: list[tuple] = []
        below = None
        for depth in range(DEPTH, 0, -1):
            first, node, zeros, ones = self._nodes(depth, bit)
            if chain:
                below = np.bincount(node[self.up[depth + 1][chain[-1][0]]], tree, len(first))
            if depth == 1:
                return chain, _top_place(self.levels[1][0][first], bit), np.array([zeros, ones, below])
            weight, tree = _weighed(zeros, ones, below)
            chain.append((first, node, _estimate(zeros, ones), weight))
        raise AssertionError

    def top(self) -> np.ndarray:
        """What depth 1 needs: zeros, ones and the sum of the children's log-probabilities, by place."""
        out = np.zeros((3, _TOP))
        for bit in range(8 if len(self.keys) else 0):
            _, place, values = self._weighed(bit)
            out[:, place] = values
        return out

    def log10(self, top: np.ndarray) -> np.ndarray:
        """Log-probability of each key's byte in its context; ``top`` is that of ``weigh_top``."""
        total = np.zeros(len(self.keys))
        for bit in range(8 if len(self.keys) else 0):
            chain, _, _ = self._weighed(bit)
            at, mix = chain[0][0], chain[0][2]
            for depth, (_, node, own, weight) in zip(range(DEPTH - 1, 1, -1), chain[1:]):
                at = self.up[depth + 1][at]
                mix = _mixed(own[node[at]], weight[node[at]], mix)
            place = _top_place(self.keys[chain[0][0]], bit)
            for p in (place, _TOP + (place & 255)):
                mix = _mixed(top[0, p], top[1, p], mix)
            one = np.where(mix > 0, mix, 0.5)[chain[0][1]]
            total += np.log10(np.where((self.keys >> np.uint64(bit)) & np.uint64(1), one, 1 - one))
        return total


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The estimates that the bit is 1; 0 where there is no node."""
    return np.where(zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1), 0.0)


def _mixed(own: np.ndarray, weight: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The mix one depth higher; where there is no node below, it is the own estimate."""
    return np.where(below > 0, weight * own + (1 - weight) * below, own)


def _top_place(keys: np.ndarray, bit: int) -> np.ndarray:
    """Places in the top of the keys' nodes of depth 1; a low byte of theirs, after _TOP, is the place of depth 0."""
    node = ((keys & np.uint64(255)) | np.uint64(256)) >> np.uint64(bit + 1)
    return (((keys >> np.uint64(8)) & np.uint64(255)) << np.uint64(8) | node).astype(np.int64)


def _weighed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The weight of the nodes' own estimates, and the logarithm of the tree's probability of their counts."""
    own = _own(zeros, ones)
    if below is None:
        return np.ones(len(own)), own
    both = np.logaddexp(own, below)
    return np.exp(own - both), both - np.log(2)


def weigh_top(sums: np.ndarray) -> np.ndarray:
    """Estimates (0: no node) and weights of depth 1, then of depth 0, from the sums of all ranges' ``Tree.top``."""
    zeros, ones, below = sums
    parts = []
    for _ in range(2):
        weight, tree = _weighed(zeros, ones, below)
        parts.append([_estimate(zeros, ones), weight])
        zeros, ones, below = (x.reshape(-1, 256).sum(0) for x in (zeros, ones, np.where(zeros + ones > 0, tree, 0.0)))
    return np.concatenate(parts, axis=1)


_CODEC = pa.Codec("zstd", compression_level=5)


def _zip(values: np.ndarray, kind: str) -> bytes:
    """The bytes of numbers of a kind, the equal places of all together, compressed; their number before."""
    planes = np.ascontiguousarray(values.astype(kind).ravel().view("u1").reshape(values.size, np.dtype(kind).itemsize).T)
    return planes.size.to_bytes(8, "little") + (_CODEC.compress(planes.tobytes(), asbytes=True) if planes.size else b"")


def _unzip(blob: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = _CODEC.decompress(blob[8:], size, asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(width, size // width).T).view(kind).ravel()


def _zip_keys(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=keys.dtype.type(0)), "<u8")


def _unzip_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unzip(blob, "<u8"), dtype=np.uint64)


def _in_chunks(rows: Iterator[tuple], limit: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Groups of (text, ...) rows of a bounded size."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[0])
        if size >= limit or len(group) >= CHUNK_DOCS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function (Stirling's series after a shift of seven)."""
    shift = np.log(x) + sum(np.log(x + i) for i in range(1, 7))
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _own(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the estimate's probability of these counts, in blocks, for the intermediate arrays' sake."""
    out = np.empty(len(n0))
    for i in range(0, len(n0), 1 << 18):
        a, b = n0[i : i + (1 << 18)], n1[i : i + (1 << 18)]
        out[i : i + (1 << 18)] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return out


def train(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The whole model of a one-column table of few training texts: distinct keys and counts, on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t.as_py() or "").encode() for t in batch.column(0)]
            keys, counts = key_counts(rows, np.ones(len(rows), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_zip_keys(keys)], pa.binary()), pa.array([_zip(counts, "<u8")], pa.binary())],
                ["keys", "counts"],
            )

    parts = texts.mapInArrow(releasing(count), "keys binary, counts binary").collect()
    return _added(
        np.concatenate([np.zeros(0, np.uint64), *(_unzip_keys(k) for k, _ in parts)]),
        np.concatenate([np.zeros(0, np.uint64), *(_unzip(c, "<u8") for _, c in parts)]),
    )


class Scorer:
    """Log-probabilities of bytes in context by a whole model."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.model = model

    def _log10(self, keys: np.ndarray) -> np.ndarray:
        tree = Tree(*_added(np.concatenate([self.model[0], keys]), np.concatenate([self.model[1], np.zeros(len(keys), np.uint64)])))
        return tree.log10(weigh_top(tree.top()))[np.searchsorted(tree.keys, keys)]


#: The end token's hash: that of a string with white space, which no word has.
_END_WORD = xxhash.xxh3_64_intdigest(b"\n end")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % HOLD_OUT_FOLDS == HELD_OUT_FOLD


def _word_counts(texts: list[bytes], training: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of tokens of each text; and packed: distinct hashes, their training counts, and (word, text, times) of all."""
    n = len(texts)
    counts, places, words = split_words(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
    # The end is a word of every text.
    distinct, which = np.unique(np.append(hashes(words), np.uint64(_END_WORD)), return_inverse=True)
    held = np.concatenate([which[places] * n + np.repeat(np.arange(n), counts), which[-1] * n + np.arange(n)])
    pairs, times = np.unique(held, return_counts=True)
    word, doc = np.divmod(pairs, n)
    trained = np.bincount(word, times * training[doc], len(distinct)).astype("<u4")
    return counts + 1, [_zip_keys(distinct), _zip(trained, "<u4"), _zip_keys(word), _zip(doc, "<u2"), _zip(times, "<u4")]


def _chunk(id_type: pa.DataType) -> object:
    """Rows (text, id, held_out) to rows of chunks: ids, texts, distinct keys, and sparse word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        rows = (
            ((t.as_py() or "").encode(), i, h)
            for batch in batches
            for t, i, h in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist())
        )
        for group in _in_chunks(rows):
            texts = [t for t, _, _ in group]
            training = ~np.array([h for _, _, h in group], bool)
            sizes, blobs = _word_counts(texts, training)
            keys, learned = key_counts(texts, training)
            row = {
                "chunk": pa.array([task << 32 | number], pa.int64()),
                "ids": pa.array([[i.as_py() for _, i, _ in group]], pa.list_(id_type)),
                "held_out": pa.array([[h for _, _, h in group]], pa.list_(pa.bool_())),
                "texts": pa.array([_zip(np.frombuffer(b"".join(texts), "u1"), "u1")], pa.binary()),
                "lengths": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                "keys": pa.array([_zip_keys(keys)], pa.binary()),
                "learned": pa.array([_zip(learned, "<u4")], pa.binary()),
                "n_tokens": pa.array([sizes.tolist()], pa.list_(pa.int64())),
            }
            row |= {name: pa.array([b], pa.binary()) for name, b in zip(("hashes", "trained", "word", "doc", "times"), blobs)}
            yield pa.RecordBatch.from_pydict(row)
            number += 1

    return run


def _ask(n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(r << 64) // n_ranges for r in range(1, n_ranges)], np.uint64)
        for batch in batches:
            for chunk, hashes, trained in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h, t = _unzip_keys(hashes), _unzip(trained, "<u4")
                cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                parts = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _, _ in parts], pa.int32()),
                        pa.array([chunk] * len(parts), pa.int64()),
                        pa.array([_zip_keys(h[a:b]) for _, a, b in parts], pa.binary()),
                        pa.array([_zip(t[a:b], "<u4") for _, a, b in parts], pa.binary()),
                    ],
                    ["range", "chunk", "hashes", "trained"],
                )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """All questions for a range of hashes: their total counts, for each chunk; and the range's tokens and distinct words."""
    hashes = [_unzip_keys(x) for x in table.column("hashes").to_pylist()]
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, np.concatenate([_unzip(x, "<u4") for x in table.column("trained").to_pylist()]), len(distinct)).astype("<u8")
    ends = np.cumsum([len(h) for h in hashes])
    replies = [_zip(total[which[e - len(h) : e]], "<u8") for h, e in zip(hashes, ends)]
    return pa.table(
        [
            pa.chunked_array([table.column("range").combine_chunks(), pa.array([table.column("range")[0].as_py()], pa.int32())]),
            pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            pa.array([*replies, None], pa.binary()),
            pa.array([0] * len(replies) + [int(total.sum())], pa.int64()),
            pa.array([0] * len(replies) + [int((total > 0).sum())], pa.int64()),
        ],
        names=["range", "chunk", "counts", "tokens", "words"],
    )


def _ask_keys(n_ranges: int):
    """Chunks' keys and counts to questions, one a chunk and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = range_of(n_ranges)
        for batch in batches:
            for chunk, blob, learned in zip(*(batch.column(i) for i in range(3))):
                keys, counts = _unzip_keys(blob.as_py()), _unzip(learned.as_py(), "<u4")
                order, r = _dealt(keys, ranges)
                keys, counts, r = keys[order], counts[order], r[order]
                cuts = [*np.flatnonzero(np.concatenate([[True] * (len(r) > 0), r[1:] != r[:-1]])).tolist(), len(r)]
                parts = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(r[x]) for x, _ in parts], pa.int32()),
                        pa.array([1] * len(parts), pa.int32()),
                        pa.array([chunk.as_py()] * len(parts), pa.int64()),
                        pa.array([_zip_keys(keys[x:y]) for x, y in parts], pa.binary()),
                        pa.array([_zip(counts[x:y], "<u4") for x, y in parts], pa.binary()),
                    ],
                    ["range", "kind", "chunk", "keys", "counts"],
                )

    return run


_QUESTION = "range int, kind int, chunk long, keys binary, counts binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions in order of their range to one row a range: its distinct keys with their counts, and its share of the top."""
    at, keys, counts, held = None, [], [], 0

    def row() -> pa.RecordBatch:
        total = _added(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at], pa.int32()),
                pa.array([0], pa.int32()),
                pa.array([None], pa.int64()),
                pa.array([_zip_keys(total[0])], pa.binary()),
                pa.array([_zip(total[1], "<u8")], pa.binary()),
                pa.array([_zip(Tree(*total).top(), "<f8")], pa.binary()),
            ],
            ["range", "kind", "chunk", "keys", "counts", "top"],
        )

    for batch in batches:
        for r, k, c in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
            if r != at:
                if keys:
                    yield row()
                at, keys, counts, held = r, [], [], 0
            keys.append(_unzip_keys(k.as_py()))
            counts.append(_unzip(c.as_py(), "<u4").astype(np.uint64))
            held += len(keys[-1])
            if held > _HELD + 2 * len(keys[0]):
                merged = _added(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
    if keys:
        yield row()


def _add_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, _TOP))
    for batch in batches:
        for blob in batch.column(0):
            total += _unzip(blob.as_py(), "<f8").reshape(3, _TOP)
    yield pa.RecordBatch.from_arrays([pa.array([_zip(total, "<f8")], pa.binary())], ["top"])


def _answer_keys(top):
    """Rows in order of range and kind: a range's keys and counts, then its questions; to the questions' answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = values = None
        for batch in batches:
            out = []
            for r, kind, chunk, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
                keys = _unzip_keys(k.as_py())
                if kind == 0:
                    known, values = keys, Tree(keys, _unzip(c.as_py(), "<u8")).log10(top.value)
                else:
                    out.append((1, r, chunk, _zip(values[np.searchsorted(known, keys)], "<f4")))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    ["kind", "range", "chunk", "counts"],
                )

    return run


def _looked_up(asked: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys among known ones in order; most are found in a table of slots, the others by search."""
    slot = lambda keys: ((keys * _MIX) >> np.uint64(64 - _SLOT_BITS)).astype(np.int32)
    table = np.zeros(1 << _SLOT_BITS, np.int32)
    table[slot(known)] = np.arange(len(known), dtype=np.int32)
    at = table[slot(asked)]
    missed = np.flatnonzero(known[at] != asked)
    at[missed] = np.searchsorted(known, asked[missed])
    return values[at]


def _scores(texts: bytes, lengths: list[int], known: np.ndarray, values: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths).tolist()
    out = [np.zeros(0)]
    for group in _in_chunks(((texts[e - n : e],) for n, e in zip(lengths, ends)), PORTION_BYTES):
        keys, starts = grams([t for t, in group])
        out.append(np.add.reduceat(_looked_up(keys, known, values), starts))
    return np.concatenate(out)


def _finish(tokens: int, words: int, n_ranges: int, id_type: pa.DataType):
    def run(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        order = np.lexsort((replies.column("range").to_numpy(), replies.column("kind").to_numpy()))
        kinds, blobs = replies.column("kind").to_pylist(), replies.column("counts").to_pylist()
        counts, found = (
            np.concatenate([_unzip(blobs[i], kind) for i in order if kinds[i] == k]).astype(np.float64)
            for k, kind in enumerate(("<u8", "<f4"))
        )
        out = []
        for row in chunks.to_pylist():
            n = len(row["ids"])
            word, doc, times = (
                x.astype(np.int64)
                for x in (_unzip_keys(row["word"]), _unzip(row["doc"], "<u2"), _unzip(row["times"], "<u4"))
            )
            base = np.bincount(doc, times * (np.log10(counts + 1) - np.log10(tokens + words + 1))[word], n)
            known = np.bincount(doc, times * (counts > 0)[word], n).astype(np.int64)
            keys = _unzip_keys(row["keys"])
            values = np.empty(len(keys))
            values[_dealt(keys, range_of(n_ranges))[0]] = found
            score = _scores(_unzip(row["texts"], "u1").tobytes(), row["lengths"], keys, values)
            bits = -score / np.log10(2) / (np.array(row["lengths"], np.int64) + 1)
            columns = {
                "id": pa.array(row["ids"], id_type),
                "held_out": pa.array(row["held_out"], pa.bool_()),
                "n_tokens": pa.array(row["n_tokens"], pa.int64()),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, tokens, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(bits, pa.float64()),
            }
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose CRC-32 of the id modulo 7 is not 2 are learned from. ``score`` is the model's log10
    probability of the whole text and ``bits_per_byte`` its code length for each byte, the end included;
    ``base_score`` is that of an add-one unigram model of words and one end token a text. The counts are
    those of all training texts; they stay as they are while a text is scored, so that scores do not depend
    on the order of rows. Null texts count as empty: one token, the end. Null ids are those of an empty
    string for the fold. Without training texts the estimates are those of no counts. Repeated rows count
    and are scored each; texts of any length are scored whole; other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    bounded_batches(docs)
    rows = docs.select(text_col, id_col, held_out(id_col).alias("held_out"))
    chunks = materialize(
        rows.mapInArrow(
            releasing(_chunk(id_type)),
            f"chunk long, ids array<{kind}>, held_out array<boolean>, texts binary, lengths array<long>, keys binary, learned binary, "
            "n_tokens array<long>, hashes binary, trained binary, word binary, doc binary, times binary",
        ),
        "chunks",
    )
    n = shuffle_partitions(spark)
    n_ranges = max(2 * n, chunks.count() // CHUNKS_A_RANGE)
    questions = chunks.select("chunk", "keys", "learned").mapInArrow(releasing(_ask_keys(n_ranges)), _QUESTION)
    contexts = materialize(
        questions.repartition(n, "range").sortWithinPartitions("range").mapInArrow(releasing(_gather), f"{_QUESTION}, top binary"),
        "contexts",
    )
    sums = contexts.select("top").mapInArrow(releasing(_add_tops), "top binary").repartition(1).mapInArrow(releasing(_add_tops), "top binary").first()
    top = spark.sparkContext.broadcast(weigh_top(_unzip(sums["top"], "<f8").reshape(3, _TOP) if sums else np.zeros((3, _TOP))))
    both = questions.withColumn("counts", F.lit(None).cast("binary")).unionByName(contexts.drop("top"))
    met = both.repartition(n, "range").sortWithinPartitions("range", "kind")
    scored = met.mapInArrow(releasing(_answer_keys(top)), "kind int, range int, chunk long, counts binary")
    asked = chunks.select("chunk", "hashes", "trained").mapInArrow(releasing(_ask(n)), "range int, chunk long, hashes binary, trained binary")
    answers = materialize(
        asked.groupBy("range").applyInArrow(_answer, "range int, chunk long, counts binary, tokens long, words long"),
        "answers",
    )
    totals = answers.where("chunk is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    replies = answers.where("chunk is not null").select(F.lit(0).alias("kind"), "chunk", "range", "counts").unionByName(scored)
    finish = _finish(totals[0], totals[1], n_ranges, id_type)
    done = chunks.select(
        "chunk",
        "ids",
        "held_out",
        "texts",
        "lengths",
        "keys",
        "n_tokens",
        "word",
        "doc",
        "times",
    ).groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        finish,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )
    return done.withColumnRenamed("id", id_col)
