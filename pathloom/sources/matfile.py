"""Result files in the public MAT-file format, level 5, as nested sentences.

The format: a header of 128 bytes, then data elements, each a tag (type and size, 8 bytes, or 4 for up to 4
bytes of data) and data padded to 8 bytes. An array is an element of elements: flags with the class, the
dimensions, the name, and what the class needs. Files are read by Spark as binary rows, one a file; a file is
one task's work.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources import readers

# Element types, with the numbers that they hold, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED, UTF8, UTF16 = 14, 15, 16, 17
CELL, STRUCT, OBJECT, CHARACTERS = 1, 2, 3, 4
NUMERIC = range(6, 16)


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, data) of each element."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # the size stands in the upper half, the data in the tag
            kind, size, begin, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            begin, step = at + 8, 8 + size + (-size % 8 if kind != COMPRESSED else 0)
        yield kind, data[begin : begin + size]
        at += step


def _numbers(kind: int, data: bytes, order: str) -> np.ndarray:
    return np.frombuffer(data, order + NUMBERS[kind])


def _array(data: bytes, order: str) -> tuple[str, object]:
    """Name and value of an array: numbers as an array, text as a string, cells as a list, structures as a list of dicts."""
    if not data:
        return "", np.zeros(0)
    parts = _elements(data, order)
    flags = int(_numbers(*next(parts), order)[0])
    shape = [int(n) for n in _numbers(*next(parts), order)]
    name = next(parts)[1].decode("ascii", "replace")
    kind, count = flags & 0xFF, int(np.prod(shape))
    if kind == CELL:
        return name, [_array(next(parts)[1], order)[1] for _ in range(count)]
    if kind in (STRUCT, OBJECT):
        if kind == OBJECT:
            next(parts)  # the class's name
        width = int(_numbers(*next(parts), order)[0])
        names = next(parts)[1]
        fields = [names[i : i + width].split(b"\0")[0].decode() for i in range(0, len(names), width)]
        return name, [{f: _array(next(parts)[1], order)[1] for f in fields} for _ in range(count)]
    if kind == CHARACTERS:
        form, text = next(parts, (UTF8, b""))
        if form == UTF8:
            return name, text.decode("utf-8", "replace")
        return name, "".join(map(chr, _numbers(form, text, order).tolist()))
    if kind in NUMERIC:
        form, values = next(parts, (9, b""))
        return name, _numbers(form, values, order).astype(float).reshape(shape, order="F")
    return name, None


def variables(content: bytes) -> dict[str, object]:
    """All variables of a file."""
    if content[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT-file of level 5")
    order = "<" if content[126:128] == b"IM" else ">"
    found = {}
    for kind, data in _elements(content[128:], order):
        if kind == COMPRESSED:
            kind, data = next(_elements(zlib.decompress(data), order))
        if kind == MATRIX:
            name, value = _array(data, order)
            found[name] = value
    return found


def _floats(value: object) -> list[float | None]:
    """Numbers in order, None for those that are not finite."""
    if value is None or isinstance(value, (list, str)):
        return []
    return [float(v) if np.isfinite(v) else None for v in np.asarray(value, float).ravel(order="F")]


SENTENCES = (
    "subject_id string, text_id string, slot int, content string, "
    "words array<struct<content string, fix_positions array<double>, n_fixations int>>, "
    "bounds array<array<double>>, fix array<struct<x double, y double, duration double>>"
)

COLUMNS = ("subject_id", "text_id", "slot", "content", "words", "bounds", "fix")


def sentence(subject: str, task: str, slot: int, item: object) -> tuple:
    """One row of SENTENCES; a slot without words or fixations has nulls in their place."""
    item = item if isinstance(item, dict) else {}
    words, fixes = item.get("word"), item.get("allFixations")
    named = isinstance(words, list) and words and all(isinstance(w, dict) and "content" in w for w in words)
    seen = isinstance(fixes, list) and fixes and isinstance(fixes[0], dict) and "x" in fixes[0]
    content = item.get("content") if isinstance(item.get("content"), str) else None
    if not (named and seen):
        return subject, f"{task}:{slot}", slot, content, None, None, None
    claims = []
    for w in words:
        positions = [p for p in _floats(w.get("fixPositions")) if p is not None]
        declared = [n for n in _floats(w.get("nFixations")) if n is not None]
        claims.append({"content": str(w["content"]), "fix_positions": positions, "n_fixations": int(declared[0]) if declared else 0})
    bounds = np.asarray(item.get("wordbounds"), float)
    if bounds.shape != (len(words), 4):
        raise ValueError(f"{task}:{slot} has no row of four bounds for each word")
    columns = [_floats(fixes[0].get(c)) for c in ("x", "y", "duration")]
    if len({len(c) for c in columns}) != 1:
        raise ValueError(f"{task}:{slot} has fixations of several lengths")
    fix = [dict(zip(("x", "y", "duration"), row)) for row in zip(*columns)]
    return subject, f"{task}:{slot}", slot, content, claims, bounds.tolist(), fix


def read_results(spark: SparkSession, path: str, subjects: list[str] | None = None) -> DataFrame:
    """SENTENCES of all result files under a path, named results<SUBJECT>_<TASK>.mat; slots count from 1.

    Any store that Spark reads will do; files of other subjects than those asked for are not opened.
    """
    wanted = "*.mat" if subjects is None else f"results{{{','.join(subjects)}}}_*.mat"
    files = spark.read.format("binaryFile").option("pathGlobFilter", wanted).load(path)
    subject, task = readers.identity(F.col("path"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                found = variables(bytes(row.content))
                if "sentenceData" not in found:
                    raise ValueError(f"no sentenceData in {os.path.basename(row.path)}")
                rows = [sentence(row.subject, row.task, i, s) for i, s in enumerate(found["sentenceData"], 1)]
                yield pd.DataFrame(rows, columns=list(COLUMNS))

    return files.select("path", "content", subject.alias("subject"), task.alias("task")).mapInPandas(parse, SENTENCES)


def slot_counts(sentences: DataFrame) -> DataFrame:
    """(subject_id, slots, valid, missing) of ``read_results``."""
    missing = F.col("words").isNull()
    return sentences.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("slots"),
        F.count_if(~missing).alias("valid"),
        F.count_if(missing).alias("missing"),
    )
