"""Exact Jaccard self-join of word n-gram sets, and its connected components.

Two texts link when their sets of n-gram hashes have a Jaccard similarity of the threshold or more. The
join is exact and finds the components of all links without listing the pairs of a group:

1. *Who can link at all.* In any order of all n-grams that both texts agree on, a linked pair shares an
   n-gram among the first ``n - ceil(t * n) + 1`` of each. The order is by how many sets hold an n-gram,
   rare ones first; so a text that has enough n-grams of its own has no partner and is done, and passages
   that many texts share come last. The numbers are exact: each batch of documents sends its sorted
   distinct n-grams, once each and with their number of sets, to ranges of hashes, where they are added
   up and answered. There are twice as many ranges as shuffle partitions, and a task holds one at a time.
   Texts that are not done post the first of their n-grams that others have, too.
2. *Candidate clusters.* Postings of an n-gram are chained by set size as far as sizes allow a link:
   within a batch before anything is shuffled, then within salts, where a chain becomes one posting, then
   across the salts. So a frequent n-gram is a few rows a batch and a bounded number a salt. Linked texts
   end in the same cluster.
3. *Prefix-tree join.* A cluster's sets, in the order of the n-grams' hashes, which holds for all sets, are
   stored in a trie. A set is matched by going down the trie: the overlap with a common beginning is
   computed once for all sets below it, and subtrees are left out when the lengths that remain cannot
   reach the threshold or when all their sets are linked to it already. Clusters beyond a bounded size are
   dealt into shards; what the shards leave apart is joined by representatives and then by pairs of
   blocks, so that no link between different parts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import bit_set, bounded_batches, materialize, probe_bit_set, releasing, shuffle_partitions
from pathloom.llm.components import connected_components
from pathloom.llm.words import hashes, portions, split_words

WORDS, PERCENT = 5, 80
BATCH_BYTES, BATCH_DOCS = 8_000_000, 16_384
#: Largest number of sets, and of n-grams in them, that one trie holds.
SHARD_SETS, SHARD_GRAMS = 2000, 2_000_000
FETCH_BITS = 25
#: Parts that the postings of an n-gram are dealt into before they meet.
SALTS = 32
#: Fixed odd multipliers of the n-gram hash.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    m = len(words) - k + 1
    x = np.full(m, k, np.uint64)
    for j in range(k):
        x = (x ^ words[j : j + m]) * _ODD[j % len(_ODD)]
        x ^= x >> np.uint64(29)
    return x * _ODD[1]


def gram_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of words; of all its words if it has fewer; none without words."""
    counts, places, distinct = split_words(pc.ascii_lower(texts))
    words = hashes(distinct)[places]
    runs = _runs(words, n) if len(words) >= n else words[:0]
    sets = []
    for end, count in zip(np.cumsum(counts).tolist(), counts.tolist()):
        if count >= n:
            sets.append(np.unique(runs[end - count : end - n + 1]))
        else:
            sets.append(_runs(words[end - count : end], count) if count else words[:0])
    return sets


def gram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    return gram_sets(pa.array([text], pa.string()), n)[0]


def _fingerprint(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


# -- the prefix tree -----------------------------------------------------------------------------------
class PrefixTree:
    """A compressed trie over sorted sequences: nodes are runs of the sequences, in lexicographic order."""

    def __init__(self, sets: list[np.ndarray]):
        """``sets``: arrays of n-gram hashes in order."""
        grams, which = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        ranked = [which[e - len(s) : e].astype(">u4") for s, e in zip(sets, ends)]
        self.order = sorted(range(len(sets)), key=lambda i: ranked[i].tobytes())
        self.sets = [ranked[i].astype(np.int64) for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.universe = len(grams)
        shared = np.zeros(len(sets) + 1, np.int64)  # length of the common beginning with the set before
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = differ[0] if len(differ) else m
        self._build(shared)

    def _build(self, shared: np.ndarray) -> None:
        #: node -> (depth, first set, end, smallest size, largest size, children)
        self.depth, self.first, self.end, self.children = [], [], [], []
        stack: list[int] = [self._node(0, 0)]
        for i in range(len(self.sets)):
            last = None
            while self.depth[stack[-1]] > shared[i]:
                last = stack.pop()
                self.end[last] = i
                if self.depth[stack[-1]] >= shared[i]:
                    self.children[stack[-1]].append(last)
                    last = None
            if last is not None:  # the common beginning ends inside an edge
                middle = self._node(int(shared[i]), self.first[last])
                self.children[middle].append(last)
                stack.append(middle)
            stack.append(self._node(len(self.sets[i]), i))
        while len(stack) > 1:
            last = stack.pop()
            self.end[last] = len(self.sets)
            self.children[stack[-1]].append(last)
        self.end[stack[0]] = len(self.sets)
        self.least = [int(self.sizes[a:b].min()) for a, b in zip(self.first, self.end)]
        self.most = [int(self.sizes[a:b].max()) for a, b in zip(self.first, self.end)]

    def _node(self, depth: int, first: int) -> int:
        self.depth.append(depth)
        self.first.append(first)
        self.end.append(-1)
        self.children.append([])
        return len(self.depth) - 1

    def components(self, percent: int, group: np.ndarray | None = None) -> np.ndarray:
        """A label for each set, in the order given: sets that links connect have the same one.

        Sets of the same ``group`` count as linked from the start.
        """
        label = np.arange(len(self.sets))
        if group is not None:
            label = np.unique(group[self.order], return_index=True, return_inverse=True)
            label = label[1][label[2]]
        held = np.zeros(self.universe, bool)
        for x, mine in enumerate(self.sets):
            held[mine] = True
            self._match(x, mine, held, label, percent)
            held[mine] = False
        out = np.empty(len(self.sets), np.int64)
        out[self.order] = np.array(self.order)[label]
        return out

    def _match(self, x: int, mine: np.ndarray, held: np.ndarray, label: np.ndarray, percent: int) -> None:
        n = len(mine)
        low, high = -(-percent * n // 100), 100 * n // percent
        stack = [(child, 0, 0) for child in self.children[0]]
        while stack:
            node, above, overlap = stack.pop()
            a, b = self.first[node], self.end[node]
            small, large = max(low, self.least[node]), min(high, self.most[node])
            if small > large or b <= x + 1:  # links to sets before x were found from there
                continue
            if (label[a:b] == label[x]).all():
                continue
            depth = self.depth[node]
            path = self.sets[a]
            overlap += int(held[path[above:depth]].sum())
            # With a set of size y below, the overlap is at most overlap + min(y - depth, what is left of x).
            left = n - int(np.searchsorted(mine, path[depth - 1], "right"))
            y = min(max(left + depth, small), large)
            best = overlap + min(y - depth, left)
            if best * (100 + percent) < percent * (n + y):
                continue
            # Equal sets are one, so at most one set ends here: the first of the run.
            if depth == len(path) and a > x and label[a] != label[x] and overlap * (100 + percent) >= percent * (n + depth):
                label[label == label[a]] = label[x]
            stack += [(child, depth, overlap) for child in self.children[node]]


# -- step 1: which n-grams are shared ----------------------------------------------------------------
def _planes(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as gaps, byte by byte, so that the high bytes, mostly 0, compress."""
    gaps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint64)


_RANGE, _BATCH, _DOCS = 0, 1, 2
_BLOBS = [f"b{i}" for i in range(1, 8)]
_DOC, _MEMBER, _POSTING = 0, 1, 2


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, content hash, id) of a bounded size."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_DOCS):
            rows = batch.slice(start, BATCH_DOCS)
            start = 0
            for part in portions(rows.column(0), BATCH_BYTES):
                yield rows.slice(start, len(part))
                start += len(part)


def _sent_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("range", pa.int32()),
            ("kind", pa.int32()),
            ("batch", pa.int64()),
            ("ids", pa.list_(id_type)),
            *((b, pa.binary()) for b in _BLOBS),
        ]
    )


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows (range, kind, batch, ids, up to seven blobs) of one batch of documents or of one range."""
    full = [(*row, *[None] * (len(schema) - len(row))) for row in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*full), schema)], schema=schema)


def _send(n: int, bits: int, id_type: pa.DataType):
    """Documents to rows for the ranges of their distinct n-grams, and rows about the batch that pass through."""
    schema = _sent_schema(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, seen = TaskContext.get().partitionId(), 0, set()
        for part in _groups(batches):
            batch = task << 24 | number
            number += 1
            sets = gram_sets(part.column(0), n)
            prints = [_fingerprint(s) for s in sets]
            sizes = np.array([len(s) for s in sets])
            contents = part.column(1).to_numpy()
            home = batch % (1 << bits)
            rows = [
                (
                    home,
                    _DOCS,
                    batch,
                    part.column(2).to_pylist(),
                    np.array(prints, "<i8").tobytes(),
                    sizes.astype("<u4").tobytes(),
                    contents.astype("<i8").tobytes(),
                )
            ]
            firsts = []
            for i, f in enumerate(prints):
                if sizes[i] and f not in seen:
                    seen.add(f)
                    firsts.append(i)
            if firsts:
                rows += _for_ranges(batch, bits, home, np.array(prints, "<i8")[firsts], [sets[i] for i in firsts])
            yield _rows(rows, schema)

    return run


def _for_ranges(batch: int, bits: int, home: int, prints: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple]:
    """A batch's row of what its documents share among themselves, and its rows for the ranges."""
    sizes = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    docs = np.repeat(np.arange(len(sets)), sizes).astype("<u2")
    order = np.argsort(grams)
    keys, docs = grams[order] >> np.uint64(32 - bits), docs[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.diff(np.append(starts, len(keys)))
    distinct, common = keys[starts], times > 1
    many = np.repeat(common, times)
    yield home, _BATCH, batch, None, prints.tobytes(), sizes.astype("<u4").tobytes(), keys[many].tobytes(), docs[many].tobytes()
    ranges = (distinct >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])), len(ranges))
    low, first = distinct.astype(np.uint32), docs[starts]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        shared = common[a:b]
        own, held = first[a:b][~shared].tobytes(), times[a:b][shared].astype("<u2").tobytes()
        yield int(ranges[a]), _RANGE, batch, None, _planes(low[a:b]), np.packbits(shared).tobytes(), own, held


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their range to answers, for each batch: how many n-grams its documents have for themselves,
    and the others with the number of sets that hold them. Rows about batches pass through."""
    at, rows, schema = None, [], None
    for batch in batches:
        schema = batch.schema
        ranges, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if (kinds != _RANGE).any():
            yield batch.filter(pa.array(kinds != _RANGE))
        for i in np.flatnonzero(kinds == _RANGE).tolist():
            if ranges[i] != at:
                if rows:
                    yield _rows(list(_answered(at, rows)), schema)
                at, rows = int(ranges[i]), []
            rows.append([batch.column(j)[i].as_py() for j in (2, 4, 5, 6, 7)])
    if rows:
        yield _rows(list(_answered(at, rows)), schema)


def _answered(r: int, rows: list[list]) -> Iterator[tuple]:
    """The answers to all batches' rows for a range."""
    values = [_values(x[1]) for x in rows]
    common = [np.unpackbits(np.frombuffer(x[2], np.uint8), count=len(v)).astype(bool) for x, v in zip(rows, values)]
    ends = np.cumsum([len(v) for v in values])
    every, holders = np.concatenate(values), np.ones(int(ends[-1]), np.int64)
    holders[np.concatenate(common)] = np.frombuffer(b"".join(x[4] for x in rows), "<u2")
    order = np.argsort(every)
    ordered = every[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sets = np.empty(len(every), "<u4")
    sets[order] = np.repeat(np.add.reduceat(holders[order], starts), np.diff(np.append(starts, len(ordered))))
    top = np.uint64(r) << np.uint64(32)
    for (batch, _, _, own, _), v, many, e in zip(rows, values, common, ends):
        held = sets[e - len(v) : e]
        docs, single = np.frombuffer(own, "<u2"), held[~many]
        alone, counts = np.unique(docs[single == 1], return_counts=True)
        shared = single > 1
        blobs = (alone.astype("<u2"), counts.astype("<u4"), v[~many][shared] | top, docs[shared], single[shared], v[many] | top, held[many])
        yield r, _RANGE, batch, None, *(b.tobytes() for b in blobs)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of n nodes reaches by the edges."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _post(percent: int, id_type: pa.DataType):
    """All rows about a batch to its documents, its candidates' chains and their postings."""
    out = pa.schema(
        [
            ("kind", pa.int32()),
            ("id", id_type),
            ("content", pa.int64()),
            ("fp", pa.int64()),
            ("n", pa.int64()),
            ("root", pa.int64()),
            ("gram", pa.int64()),
            ("lo", pa.int64()),
            ("hi", pa.int64()),
        ]
    )

    def rows(kind: int, count: int, **columns) -> pa.Table:
        columns["kind"] = np.full(count, kind, np.int32)

        def column(f: pa.Field) -> pa.Array:
            given = columns.get(f.name)
            return pa.nulls(count, f.type) if given is None else given if isinstance(given, pa.Array) else pa.array(given, f.type)

        return pa.table([column(f) for f in out], schema=out)

    def run(table: pa.Table) -> pa.Table:
        found, alone, parts, local, prints = [out.empty_table()], [], [], [], None
        for kind, ids, *blobs in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", *_BLOBS))):
            if kind == _DOCS:
                fp, n, content = (np.frombuffer(b, k) for b, k in zip(blobs[:3], ("<i8", "<u4", "<i8")))
                found.append(rows(_DOC, len(fp), id=pa.array(ids, id_type), content=content, fp=fp, n=n.astype(np.int64)))
            elif kind == _BATCH:
                prints, sizes = np.frombuffer(blobs[0], "<i8"), np.frombuffer(blobs[1], "<u4").astype(np.int64)
                common = np.frombuffer(blobs[2], "<u8"), np.frombuffer(blobs[3], "<u2")
            else:
                alone.append((np.frombuffer(blobs[0], "<u2"), np.frombuffer(blobs[1], "<u4")))
                parts.append((np.frombuffer(blobs[2], "<u8"), np.frombuffer(blobs[3], "<u2"), np.frombuffer(blobs[4], "<u4")))
                local.append((np.frombuffer(blobs[5], "<u8"), np.frombuffer(blobs[6], "<u4")))
        if prints is None:
            return pa.concat_tables(found)
        own = np.zeros(len(prints), np.int64)
        for docs, counts in alone:
            own[docs] += counts
        wanted = np.maximum(prefix_length(sizes, percent) - own, 0)
        known, known_sets = (np.concatenate(x) for x in zip(*local))
        order = np.argsort(known)
        held = known_sets[order][np.searchsorted(known[order], common[0])]
        gram, doc, sets = (np.concatenate(x) for x in zip((*common, held), *parts))
        open_ = wanted[doc] > 0
        gram, doc, sets = gram[open_], doc[open_].astype(np.int64), sets[open_]
        # The order that all texts agree on: by number of sets, then by hash.
        order = np.lexsort((gram, sets, doc))
        gram, doc = gram[order], doc[order]
        first = np.searchsorted(doc, np.arange(len(prints)))
        kept = np.arange(len(doc)) - first[doc] < wanted[doc]
        gram, doc = gram[kept], doc[kept]
        if len(doc):
            order = np.lexsort((sizes[doc], gram))
            gram, doc = gram[order], doc[order]
            size = sizes[doc]
            chained = (gram[1:] == gram[:-1]) & (size[:-1] * 100 >= percent * size[1:])
            edges = np.unique(np.stack([doc[:-1][chained], doc[1:][chained]], axis=1), axis=0)
            root = _roots(edges[:, 0], edges[:, 1], len(prints))
            nodes = np.unique(doc)
            found.append(rows(_MEMBER, len(nodes), fp=prints[nodes], n=sizes[nodes], root=prints[root[nodes]]))
            order = np.lexsort((root[doc], gram))
            gram, own_root, size = gram[order], root[doc][order], size[order]
            starts = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (own_root[1:] != own_root[:-1])))
            found.append(
                rows(
                    _POSTING,
                    len(starts),
                    root=prints[own_root[starts]],
                    gram=gram[starts].astype(np.int64),
                    lo=np.minimum.reduceat(size, starts),
                    hi=np.maximum.reduceat(size, starts),
                )
            )
        return pa.concat_tables(found)

    return run


# -- step 3: tries over clusters -----------------------------------------------------------------------
def _sets(n: int):
    """(text, fp, label, shard, group) to (label, shard, group, fp, grams) where the text has the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for part in portions(batch.column(0), BATCH_BYTES) for x in gram_sets(part, n)]
            right = [i for i, (s, f) in enumerate(zip(sets, batch.column(1).to_pylist())) if _fingerprint(s) == f]
            taken = pa.array(right, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j).take(taken) for j in (2, 3, 4, 1)), pa.array([sets[i].tobytes() for i in right], pa.binary())],
                ["label", "shard", "group", "fp", "grams"],
            )

    return run


def _join_tries(percent: int):
    """Rows sorted by (label, shard) to (label, group, fp, root): the sets that links connect within a shard."""

    def joined(key, members: dict) -> pa.RecordBatch:
        prints = np.array(list(members))
        group = np.array([g for g, _ in members.values()])
        labels = PrefixTree([s for _, s in members.values()]).components(percent, group)
        n = len(prints)
        # The smallest fingerprint names a component.
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, labels, prints)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, key[0])), pa.array(group), pa.array(prints), pa.array(least[labels])],
            ["label", "group", "fp", "root"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, {}
        for batch in batches:
            for label, shard, group, fp, grams in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                if at != (label, shard):
                    if members:
                        yield joined(at, members)
                    at, members = (label, shard), {}
                members[fp] = (group, np.frombuffer(grams.as_py(), np.uint64))
        if members:
            yield joined(at, members)

    return run


def _link(docs: DataFrame, tasks: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Join within the shards of ``tasks`` (fp, id, content, label, shard, group), whose sets are made from the texts."""
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).withColumn("_content", F.xxhash64("_text"))
    wanted = bit_set(tasks.select("content").distinct(), F.col("content"), FETCH_BITS)
    likely = probe_bit_set(source, F.col("_content"), wanted, FETCH_BITS).where("_hit").drop("_hit")
    fetched = likely.join(tasks, (F.col("_content") == F.col("content")) & F.col("_id").eqNullSafe(F.col("id")))
    sets = fetched.select("_text", "fp", "label", "shard", "group").mapInArrow(
        releasing(_sets(n)),
        "label long, shard long, group long, fp long, grams binary",
    )
    dealt = sets.repartition(shuffle_partitions(spark), "label", "shard").sortWithinPartitions("label", "shard", "fp")
    return dealt.mapInArrow(releasing(_join_tries(percent)), "label long, group long, fp long, root long")


def _chains(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the roots of postings (gram, root, lo, hi) that sizes chain together.

    Chains are made within salts first; each becomes one posting, and these are chained. Two chains of a salt are
    further apart than the threshold allows, so a salt has few, however many postings an n-gram has.
    """

    def chained(rows: DataFrame, *keys: str) -> DataFrame:
        by_size = Window.partitionBy(*keys).orderBy("lo", "hi", "root")
        reach = F.max("hi").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
        linked = F.coalesce(reach * 100 >= F.col("lo") * percent, F.lit(False))
        return rows.select(*keys, "root", "lo", "hi", F.lag("root").over(by_size).alias("before"), linked.alias("linked"))

    def edges(rows: DataFrame) -> DataFrame:
        return rows.where("linked and before <> root").select(F.col("before").alias("a"), F.col("root").alias("b"))

    salted = chained(postings.withColumn("salt", F.pmod(F.xxhash64("root"), F.lit(SALTS))), "gram", "salt")
    by_salt = Window.partitionBy("gram", "salt").orderBy("lo", "hi", "root")
    chains = salted.withColumn("chain", F.sum((~F.col("linked")).cast("int")).over(by_salt)).groupBy("gram", "salt", "chain")
    whole = chains.agg(F.min("root").alias("root"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return edges(salted).unionByName(edges(chained(whole, "gram")))


def similar_components(
    docs: DataFrame,
    n: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_sets: int = SHARD_SETS,
    shard_grams: int = SHARD_GRAMS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` (set size) and ``component_id``.

    Words are split at ASCII white space with A-Z in lower case; a set holds the distinct n-grams, or
    all words as one if there are fewer. Two texts link when 100 * intersection >= percent * union;
    component_id is the smallest id that links reach. Null, empty and blank texts have an empty set and
    link with nothing: component_id is their own id. Null ids are never the smallest; if a component has
    no other, it is null. Repeated rows are linked, equal sets being equal. N-grams and sets are compared
    by 64-bit hashes. Other columns are not read; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    bounded_batches(docs)
    parts = shuffle_partitions(spark)
    bits = max(4, ceil(log2(2 * parts)))
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("content"), F.col(id_col).alias("id"))
    sent = rows.mapInArrow(
        releasing(_send(n, bits, id_type)),
        f"range int, kind int, batch long, ids array<{kind}>, " + ", ".join(f"{b} binary" for b in _BLOBS),
    )
    met = sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(releasing(_meet), sent.schema)
    posted = materialize(
        met.groupBy("batch").applyInArrow(
            _post(percent, id_type),
            f"kind int, id {kind}, content long, fp long, n long, root long, gram long, lo long, hi long",
        ),
        "posted",
    )
    every = posted.where(F.col("kind") == _DOC).select("id", "content", "fp", "n")
    members = posted.where(F.col("kind") == _MEMBER).select("fp", "n", "root")
    postings = posted.where(F.col("kind") == _POSTING).select("gram", "root", "lo", "hi")

    labels = connected_components(_chains(postings, percent))
    in_cluster = members.join(labels, members["root"] == labels["node"], "left").groupBy("fp").agg(
        F.min(F.coalesce("component", "root")).alias("label"),
        F.first("n").alias("n"),
    )
    clusters = in_cluster.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams")).where("sets > 1")
    sized = clusters.select(
        "label",
        F.ceil(F.greatest(F.col("sets") / shard_sets, F.col("grams") / shard_grams)).cast("long").alias("shards"),
    )
    speaker = every.where("n > 0").groupBy("fp").agg(F.min(F.struct("id", "content")).alias("s")).select("fp", "s.id", "s.content")
    tasks = materialize(
        in_cluster.join(sized, "label").join(speaker, "fp").select(
            "fp",
            "id",
            "content",
            "label",
            "shards",
            F.pmod(F.xxhash64("fp"), F.col("shards")).alias("shard"),
            F.col("fp").alias("group"),
        ),
        "tasks",
    )

    linked = materialize(_link(docs, tasks, n, percent, id_col, text_col), "linked").select("label", "fp", "root")
    if tasks.where("shards > 1").limit(1).count():
        linked = _across(docs, tasks, linked, n, percent, id_col, text_col, shard_sets)

    named = every.where("n > 0").groupBy("fp").agg(F.min("id").alias("id")).join(linked.select("fp", "root"), "fp", "left").select(
        "fp",
        "id",
        F.coalesce("root", "fp").alias("root"),
    )
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    # Keyed by a struct, so that the join deals both sides anew and can split the rows of very many copies.
    by_set = named.where("fp is not null").join(smallest, "root").select(F.struct("fp").alias("_set"), "component_id")
    out = every.join(by_set, F.struct("fp") == F.col("_set"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _across(
    docs: DataFrame,
    tasks: DataFrame,
    linked: DataFrame,
    n: int,
    percent: int,
    id_col: str,
    text_col: str,
    shard_sets: int,
) -> DataFrame:
    """Links between the shards of clusters that have several: first of representatives, then what those leave apart."""
    split = tasks.where("shards > 1").select("fp", "id", "content", "label")

    def merged(parts: DataFrame, more: DataFrame) -> DataFrame:
        """``parts`` (label, fp, root) after the links of ``more`` (group, root: what a join made of those groups)."""
        same = more.select(F.col("group").alias("a"), F.col("least").alias("b"))
        found = connected_components(same)
        return materialize(
            parts.join(found, parts["root"] == found["node"], "left").select("label", "fp", F.coalesce("component", "root").alias("root")),
            "linked",
        )

    def regrouped(result: DataFrame) -> DataFrame:
        # A component of a join names its smallest fingerprint; what it links are the groups of its sets.
        return result.groupBy("label", "root").agg(F.min("group").alias("least")).join(
            result.select("label", "root", "group").distinct(),
            ["label", "root"],
        ).select("group", "least")

    # One set of each part of a cluster, dealt into shards by the thousand as before.
    parts = linked.join(split.select("label").distinct(), "label", "left_semi")
    speakers = parts.groupBy("label", "root").agg(F.min("fp").alias("fp"))
    count = speakers.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard_sets).cast("long").alias("k"))
    first = materialize(
        speakers.join(count, "label").join(split.drop("label"), "fp").select(
            "fp",
            "id",
            "content",
            "label",
            F.pmod(F.xxhash64("fp"), F.col("k")).alias("shard"),
            F.col("root").alias("group"),
        ),
        "speakers",
    )
    linked = merged(linked, regrouped(materialize(_link(docs, first, n, percent, id_col, text_col), "met")))

    # What is still apart in a cluster: sets outside its largest part, in blocks, against blocks of all its sets.
    parts = linked.join(split.select("label").distinct(), "label", "left_semi")
    sizes = parts.groupBy("label", "root").agg(F.count(F.lit(1)).alias("sets"))
    largest = sizes.groupBy("label").agg(
        F.max(F.struct("sets", "root")).alias("m"),
        F.sum("sets").alias("all"),
        F.count(F.lit(1)).alias("n_parts"),
    ).where("n_parts > 1")
    half = shard_sets // 2
    plan = largest.select(
        "label",
        F.col("m.root").alias("main"),
        F.ceil((F.col("all") - F.col("m.sets")) / half).cast("long").alias("rest"),
        F.ceil(F.col("all") / half).cast("long").alias("blocks"),
    )
    if not plan.limit(1).count():
        return linked
    apart = parts.join(plan, "label").join(split.drop("label"), "fp")
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))
    rest = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("rest"))
    across = apart.select(
        "fp",
        "id",
        "content",
        "label",
        F.col("root").alias("group"),
        "rest",
        "blocks",
        block.alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).alias("against"),
    )
    own = apart.where("root <> main").select(
        "fp",
        "id",
        "content",
        "label",
        F.col("root").alias("group"),
        "rest",
        "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        rest.alias("against"),
    )
    pairs = materialize(
        across.unionByName(own).select(
            "fp",
            "id",
            "content",
            "label",
            (F.col("block") * F.col("rest") + F.col("against")).alias("shard"),
            "group",
        ).distinct(),
        "pairs",
    )
    return merged(linked, regrouped(materialize(_link(docs, pairs, n, percent, id_col, text_col), "met")))
