"""Lines of words as they lie in their texts. Their pairs are laid out in the tasks that use them, and neither written nor moved.

A line is a row: its words in order, and the steps from a word to a later one of the line, with their counts. Pairs grow
with the square of a line's words, lines with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a task lays out at a time.
CELLS = 500_000
STEP = pa.struct([("src_word", pa.int64()), ("dst_word", pa.int64()), ("count", pa.float64())])
COUNT = pa.struct([("_r", pa.int32()), ("dst_word", pa.int64()), ("count", pa.float64())])
TIMES = pa.list_(pa.struct([("_r", pa.int32()), ("times", pa.float64())]))
KINDS = "text_id string, words array<bigint>, steps array<struct<src_word:bigint,dst_word:bigint,count:double>>"


def lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def token_lines(texts: DataFrame) -> DataFrame:
    """(text_id, words, steps) of the lines of two words and more, from (text_id, text).

    The word of a token is its first place in the text, whatever its case; a line ends with a sentence. A step leads from
    one token's word to the next token's, if that is later and in the same line. Texts that share an id are read as
    one, place by place. Whole texts move once, to their ids.
    """
    parts = F.transform("texts", lambda t: F.split(F.trim(t), r"[\t\n\f\r ]+"))
    each = lambda f: F.transform("parts", lambda p: F.transform(p, f))
    together = texts.where("text_id is not null").groupBy("text_id").agg(F.collect_list("text").alias("texts"))
    tokens = together.select("text_id", parts.alias("parts"))
    return tokens.select("text_id", each(F.lower).alias("surfaces"), each(lambda s: s.rlike(r"[.!?]\z")).alias("ends")).mapInArrow(_lines, KINDS)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ends = batch.column("surfaces"), batch.column("ends").flatten().flatten().to_numpy(zero_copy_only=False)
        tokens = rows.flatten()
        sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = tokens.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((place, owner))
        owner, place, code, ends = owner[order], place[order], code[order], ends[order].astype(np.int64)
        if not len(owner):
            continue
        _, first, of = np.unique(owner * (code.max() + 1) + code, return_index=True, return_inverse=True)
        first = first[of]  # the first token of each token's word
        line = np.cumsum(ends) - ends  # goes on from text to text
        kept = np.flatnonzero(place == place[first])
        begins = np.append(True, (owner[kept][1:] != owner[kept][:-1]) | (line[kept][1:] != line[kept][:-1]))
        number = np.full(len(owner), -1)
        number[kept] = np.cumsum(begins) - 1
        src, dst = first[:-1], first[1:]
        step = (owner[1:] == owner[:-1]) & (place[dst] > place[src]) & (number[src] == number[dst])
        pair, count = np.unique(src[step] * len(owner) + dst[step], return_counts=True)
        src, dst = pair // len(owner), pair % len(owner)
        lines = int(begins.sum())
        words = lists(pa.array(place[kept]), np.bincount(number[kept], minlength=lines))
        given = pa.StructArray.from_arrays([pa.array(place[src]), pa.array(place[dst]), pa.array(count.astype(float))], fields=list(STEP))
        steps = lists(given, np.bincount(number[src], minlength=lines))
        out = pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(owner[kept][begins])), words, steps], ["text_id", "words", "steps"])
        yield out.filter(pa.array(words.value_lengths().to_numpy() > 1))


class Lines:
    """A batch of lines as arrays: words in order, where each one's line and later words begin and end."""

    def __init__(self, batch: pa.RecordBatch):
        words = batch.column("words")
        size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.flatten().to_numpy(zero_copy_only=False)
        self.line = np.repeat(np.arange(len(size)), size)
        self.size = size[self.line]
        end = np.cumsum(size)
        self.ordinal = np.arange(len(self.words)) - (end - size)[self.line]
        new = np.append(True, (self.words[1:] != self.words[:-1]) | (self.line[1:] != self.line[:-1]))[: len(self.words)]
        after = np.append(np.flatnonzero(new)[1:], len(self.words))
        self.later = after[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)  # the first larger word
        self.candidates = end[self.line] - self.later

    def pairs(self, sources: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sources, their destinations one after another), places of ``words``, in portions of a bounded number of pairs."""
        sources = sources[self.candidates[sources] > 0]
        done, start = np.cumsum(self.candidates[sources]), 0
        while start < len(sources):
            before = int(done[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(done, before + CELLS, "right")))
            part = sources[start:end]
            n = self.candidates[part]
            yield part, np.arange(n.sum()) + np.repeat(self.later[part] - (np.cumsum(n) - n), n)
            start = end

    def features(self, names: tuple[str, ...], sources: np.ndarray, destinations: np.ndarray) -> np.ndarray:
        """(pairs x features) of a position design."""
        distance = self.words[destinations] - np.repeat(self.words[sources], self.candidates[sources])
        ordinal, size = self.ordinal[destinations], self.size[destinations]
        of = {
            "log1p_abs_distance": lambda: np.log(1.0 + distance),
            "adjacent": lambda: distance == 1,
            "target_relative_position": lambda: ordinal / np.maximum(1, size - 1),
            "target_first2": lambda: ordinal < 2,
            "target_last2": lambda: ordinal >= size - 2,
        }
        return np.column_stack([of[n]().astype(float) for n in names])


def pair_sums(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(text_id, pairs, features, count): each text's pairs, and the sums of their features and counts."""
    columns = ["pairs", *names, "count"]
    schema = "text_id string, pairs long, " + ", ".join(f"`{c}` double" for c in columns[1:])

    def run(batches):
        for batch in batches:
            lines, sums = Lines(batch), np.zeros((batch.num_rows, len(names)))
            pairs = np.bincount(lines.line, lines.candidates, minlength=batch.num_rows).astype(np.int64)
            for sources, destinations in lines.pairs(np.arange(len(lines.words))):
                n = lines.candidates[sources]
                of_source = np.add.reduceat(lines.features(names, sources, destinations), np.cumsum(n) - n)
                np.add.at(sums, lines.line[sources], of_source)
            given = batch.column("steps")
            owner = np.repeat(np.arange(batch.num_rows), given.value_lengths().to_numpy(zero_copy_only=False))
            count = np.bincount(owner, given.flatten().field("count").to_numpy(zero_copy_only=False), minlength=batch.num_rows)
            whole = pa.table([batch.column("text_id"), pa.array(pairs), *map(pa.array, sums.T), pa.array(count)], ["text_id", *columns])
            found = whole.group_by("text_id").aggregate([(c, "sum") for c in columns]).rename_columns(["text_id", *columns])
            yield from found.to_batches()

    return lines.mapInArrow(run, schema).groupBy("text_id").agg(*[F.sum(c).alias(c) for c in columns]).where("pairs > 0")


def source_rows(names: tuple[str, ...]):
    """A function from batches of lines (text_id, words, steps, fold, response) to tables of sources with their cells, as
    ``responses.lay_out`` and ``with_counts`` give them.

    Sources without a step are left out: they have no part in a likelihood. A line's steps count for its own response.
    """

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            lines, given = Lines(batch), batch.column("steps")
            steps, owner = given.flatten(), np.repeat(np.arange(batch.num_rows), given.value_lengths().to_numpy(zero_copy_only=False))
            if not len(steps):
                continue
            src, dst = steps.field("src_word").to_numpy(), steps.field("dst_word").to_numpy()
            span = int(lines.words.max()) + 1
            at = np.searchsorted(lines.line * span + lines.words, owner * span + src)  # lines and their words are in order
            order = np.argsort(at, kind="stable")
            at, owner, dst, count = at[order], owner[order], dst[order], steps.field("count").to_numpy()[order]
            response = batch.column("response").to_numpy(zero_copy_only=False)[owner].astype(np.int32)
            counts = pa.StructArray.from_arrays([pa.array(response), pa.array(dst), pa.array(count)], fields=list(COUNT))
            first, fold = 0, batch.column("fold").to_numpy(zero_copy_only=False)
            for sources, destinations in lines.pairs(np.unique(at)):
                n = lines.candidates[sources]
                x = lists(pa.array(lines.features(names, sources, destinations).ravel()), np.full(len(destinations), len(names)))
                cells = pa.StructArray.from_arrays([pa.array(lines.words[destinations]), x, pa.array(np.zeros(len(destinations)))], ["dst_word", "x", "count"])
                owned = np.searchsorted(at, sources, "right") - np.searchsorted(at, sources)
                own = counts.slice(first, int(owned.sum()))
                first += len(own)
                yield pa.table({
                    "fold": pa.array(fold[lines.line[sources]]), "cells": lists(cells, n), "counts": lists(own, owned), "times": pa.nulls(len(sources), TIMES),
                })

    return lay_out
