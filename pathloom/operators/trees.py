"""Depths and distances in the trees that words' heads form, for sentences of any length.

A word's label is what is needed of its way to the root: the heavy chains that the way passes, from the root down, and
the depth at which it leaves each. A way passes at most log2(n) + 1 chains, so labels of a chain of heads are no longer
than those of a balanced tree, and two labels give the words' distance without their sentence.

Sentences are dealt by their key; in a task, all sentences of a block are labelled at once, in rounds of pointer
doubling: each round joins a word with its ancestor's ancestor, so there are as many as the logarithm of the longest
sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "depth int, chains array<struct<chain:bigint,until:int>>"
_CHAIN = pa.struct([("chain", pa.int64()), ("until", pa.int32())])
#: Rows that are labelled together, if their sentences end there.
BLOCK = 50_000


def _rounds(n: int) -> range:
    return range(max(1, int(n).bit_length()))


def label_words(sentence: np.ndarray, word: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(broken, depth, chain, until, in_step) of words sorted by sentence number and word; a head that is absent is -1.

    Step i of a word's way up, from the word to the root, is the chain with the word number ``chain[i]``, left at depth
    ``until[i]``; ``in_step[v]`` is the number of steps. Words of broken sentences have none: those without exactly
    one word that is its own head, or with a word that does not reach it.
    """
    n = len(word)
    own = np.arange(n)
    parent = np.where(head < 0, own, head)
    sizes = np.bincount(sentence, minlength=1)
    roots = np.bincount(sentence, weights=head == own, minlength=1)
    ups, top, depth = [], parent, (parent != own).astype(np.int64)
    for _ in _rounds(sizes.max(initial=1)):
        ups.append(top)
        depth = depth + depth[top]
        top = top[top]
    lost = np.bincount(sentence, weights=head[top] != top, minlength=1) if n else np.zeros(1)
    broken = ((roots != 1) | (lost > 0))[sentence]

    below = (~broken).astype(np.float64)  # words at and under a word, those within 2^k steps after round k
    for k, up in enumerate(ups):
        far = ~broken & (depth >= 1 << k)
        below = below + np.bincount(up[far], weights=below[far], minlength=n)
    children = np.flatnonzero(~broken & (parent != own))
    order = children[np.lexsort((children, -below[children], parent[children]))]
    first = np.append(True, parent[order][1:] != parent[order][:-1])[: len(order)]
    chain = own.copy()  # the word a chain begins with
    chain[order[first]] = parent[order[first]]
    for _ in ups:
        chain = chain[chain]

    at, steps_chain, steps_until = np.where(broken, -1, own), [], []
    in_step = np.zeros(n, np.int64)
    while (on := at >= 0).any():
        here = np.where(on, at, 0)
        steps_chain.append(word[chain[here]])
        steps_until.append(depth[here])
        in_step += on
        begin = chain[here]
        at = np.where(on & (parent[begin] != begin), parent[begin], -1)
    return broken, depth, steps_chain, steps_until, in_step


def _labelled(rows: pa.Table, number: np.ndarray) -> pa.Table:
    word = rows["word_index"].to_numpy()
    wanted = pc.fill_null(rows["head_word_index"].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
    values, place = np.unique(np.concatenate([word, wanted]), return_inverse=True)
    keys, asked = number * len(values) + place[: len(word)], number * len(values) + place[len(word) :]
    if len(keys) and (keys[1:] == keys[:-1]).any():
        raise ValueError("a word occurs twice in its sentence")
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    head = np.where(keys[at] == asked, at, -1)
    broken, depth, chains, untils, in_step = label_words(number, word, head)
    offsets = np.concatenate([[0], np.cumsum(in_step)])
    chain, until = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int32)
    for i, (c, u) in enumerate(zip(chains, untils)):
        on = np.flatnonzero(in_step > i)
        to = offsets[on + 1] - 1 - i  # from the root down
        chain[to], until[to] = c[on], u[on]
    structs = pa.StructArray.from_arrays([pa.array(chain), pa.array(until)], fields=list(_CHAIN))
    bounds = pa.array(offsets.astype(np.int32), mask=np.append(broken, False))
    flag = pa.array(broken)
    if "syntax_missing" in rows.column_names:
        flag = pc.or_kleene(rows["syntax_missing"].combine_chunks(), flag)
        rows = rows.drop_columns(["syntax_missing"])
    out = rows.append_column("depth", pa.array(depth.astype(np.int32), mask=broken))
    return out.append_column("chains", pa.ListArray.from_arrays(bounds, structs)).append_column("syntax_missing", flag)


def with_tree_labels(words: DataFrame) -> DataFrame:
    """``words`` with ``depth``, ``chains`` and ``syntax_missing``.

    Heads are looked up within the sentence; a sentence needs exactly one word that is its own head, reached by all.
    Where its heads form no such tree, ``syntax_missing`` is set and the others are null. A sentence is held whole by
    one task, as three numbers a word; a word that occurs twice in its sentence raises.
    """
    key = ["text_id", "sentence_number"]
    columns = [c for c in words.columns if c != "syntax_missing"]
    missing = ["syntax_missing"] if "syntax_missing" in words.columns else []
    dealt = words.select(*columns, *missing).repartition(*key).sortWithinPartitions(*key, "word_index")
    kinds = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def numbers(rows: pa.Table) -> np.ndarray:
            """Numbers of the rows' sentences, from 0."""
            codes = [c.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in (rows[k] for k in key)]
            change = np.zeros(rows.num_rows, bool)
            for c in codes:
                change[1:] |= c[1:] != c[:-1]
            return np.cumsum(change)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = pa.Table.from_batches(held)
            number = numbers(rows)
            stop = rows.num_rows if last else int(np.searchsorted(number, number[-1]))
            if stop:
                yield from _labelled(rows.slice(0, stop), number[:stop]).combine_chunks().to_batches()
            held = rows.slice(stop).to_batches()
            size = rows.num_rows - stop

        wait = BLOCK
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= wait:
                yield from flush(False)
                wait = max(BLOCK, 2 * size)  # a sentence longer than a block is looked through a few times only
        if size:
            yield from flush(True)

    return dealt.mapInArrow(run, f"{kinds}, {LABEL}, syntax_missing boolean")


def tree_distance(depth_a: Column, chains_a: Column, depth_b: Column, chains_b: Column) -> Column:
    """Steps between two words of a sentence through their nearest common ancestor, by their labels."""
    met = F.zip_with(chains_a, chains_b, lambda x, y: F.when(x["chain"] == y["chain"], F.least(x["until"], y["until"])))
    return depth_a + depth_b - 2 * F.array_max(met)
