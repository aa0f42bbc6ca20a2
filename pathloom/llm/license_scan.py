"""Fuzzy search for short license notices.

A text's canonical form is its words, in lower case, joined by one space. A notice may differ in k edits, which grow
with its length up to a bound; cut into p > k pieces, p - k of them must stand unchanged, each within k places of where
the notice has it, wherever the notice occurs. So an automaton over the pieces of all notices finds every place that
can hold one. The ``regex`` library then looks for the best match within k edits in the window around such a place, and
reports what it spans. Words that tell a notice from its neighbours (a version, a clause) must stand in the match as
they are.

Phrases are found beside it: places where their words stand consecutively, without edits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, releasing
from pathloom.llm.words import portions, translated

#: Characters of a notice for each edit that it may have, and the most edits; pieces have this many characters at least,
#: unless the edits ask for more pieces.
EDIT_EVERY, MOST_EDITS, PIECE = 8, 3, 7
#: Bytes of text whose canonical forms are made together.
PORTION = 4 << 20

# The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    """Words of a short notice, and those of them that must stand unchanged."""

    label: str
    words: str
    exact: tuple[str, ...] = ()

    @property
    def edits(self) -> int:
        return min(MOST_EDITS, len(self.words) // EDIT_EVERY)

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece) of more pieces than there may be edits, of even lengths."""
        n = max(self.edits + 1, len(self.words) // PIECE)
        cuts = [len(self.words) * i // n for i in range(n + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]


NOTICES = (
    Notice("mit", "under the mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("apache-2", "under the apache license version 2", ("2",)),
    Notice("bsd", "under the bsd license", ("bsd",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("gpl-2", "gnu general public license version 2", ("2",)),
    Notice("gpl-3", "gnu general public license version 3", ("3",)),
    Notice("lgpl-2.1", "gnu lesser general public license version 2 1", ("lesser", "2", "1")),
    Notice("lgpl-3", "gnu lesser general public license version 3", ("lesser", "3")),
    Notice("agpl-3", "gnu affero general public license version 3", ("affero", "3")),
    Notice("mpl-2", "mozilla public license version 2", ("2",)),
    Notice("epl-2", "eclipse public license version 2", ("2",)),
    Notice("cc-by", "licensed under cc by 4 0", ("by", "4")),
    Notice("cc-by-sa", "licensed under cc by sa", ("sa",)),
    Notice("cc-by-nc", "licensed under cc by nc", ("nc",)),
    Notice("cc-by-nd", "licensed under cc by nd", ("nd",)),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc0", "to the extent possible under law the author has waived all copyright"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Bytes of a word stand for themselves, A-Z for a-z, all others for a space.
_CANONICAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("found", pa.string())])
_BASE = pa.struct([("label", pa.string()), ("word", pa.int64())])


def phrase_places(canonical: str, phrases=PHRASES) -> list[tuple[int, str]]:
    """(word number, label) of all places where a phrase's words stand consecutively, in order."""
    padded, found = f" {canonical} ", []
    for phrase, label in phrases:
        wanted, at, words, done = f" {phrase} ", -1, 0, 0
        while (at := padded.find(wanted, at + 1)) >= 0:
            words, done = words + padded.count(" ", done, at), at
            found.append((words, label))
    return sorted(found)


class NoticeSearch:
    """Matches of notices within their edits, in canonical texts."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        holders: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                holders.setdefault(piece, []).append((i, offset))
        self.least = [len(n.pieces()) - n.edits for n in notices]
        self.automaton = ahocorasick.Automaton()
        for piece, places in holders.items():
            self.automaton.add_word(piece, (len(piece), tuple(places)))
        if notices:
            self.automaton.make_automaton()
        patterns = [regex.compile(f"(?b)(?:{regex.escape(n.words)}){{e<={n.edits}}}") for n in notices]
        # Windows repeat as notices do; the number of those kept is bounded, not what is found.
        self.best = lru_cache(1 << 14)(lambda i, window: (m.span(), sum(m.fuzzy_counts)) if (m := patterns[i].search(window)) else None)

    def windows(self, canonical: str) -> set[tuple[int, int, int]]:
        """(notice, start, end) of the windows that can hold a match: enough pieces stand where the notice has them."""
        seeds: dict[int, set[tuple[int, int]]] = {}
        for last, (length, places) in self.automaton.iter(canonical) if self.notices else ():
            for i, offset in places:
                seeds.setdefault(i, set()).add((last + 1 - length - offset, offset))
        found = set()
        for i, placed in seeds.items():
            notice, starts = self.notices[i], sorted(placed)
            k, size, stop = notice.edits, len(notice.words), 0
            for j, (start, _) in enumerate(starts):
                while stop < len(starts) and starts[stop][0] <= start + 2 * k:
                    stop += 1
                if stop - j >= self.least[i] and len({offset for _, offset in starts[j:stop]}) >= self.least[i]:
                    found.add((i, max(0, start - k), min(len(canonical), start + size + k)))
        return found

    def matches(self, canonical: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits); of matches that overlap the one with fewest edits, then the longest, then the first."""
        found = set()
        for i, start, end in self.windows(canonical):
            if (hit := self.best(i, canonical[start:end])) is None:
                continue
            (a, b), edits = (start + hit[0][0], start + hit[0][1]), hit[1]
            stripped = canonical[a:b].strip()
            a = canonical.index(stripped, a)
            b = a + len(stripped)
            first, stop = canonical.rfind(" ", 0, a) + 1, canonical.find(" ", b)
            words = canonical[first : stop if stop >= 0 else None].split(" ")
            if stripped and all(w in words for w in self.notices[i].exact):
                found.add((edits, a - b, a, i))
        kept: list[tuple[int, int, int, int]] = []
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for edits, length, a, i in sorted(found):
            b = a - length
            at = bisect_left(taken, (a, b))
            if (at == len(taken) or taken[at][0] >= b) and (at == 0 or taken[at - 1][1] <= a):
                taken.insert(at, (a, b))
                kept.append((a, b, i, edits))
        return sorted(kept)


def _places(text: str, canonical: str, spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Where spans of the canonical form stand in the text."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = np.cumsum([0, *(b - a + 1 for a, b in words)])

    def place(at: int) -> int:
        w = min(int(np.searchsorted(starts, at, "right")) - 1, len(words) - 1)
        return min(words[w][0] + at - int(starts[w]), words[w][1])

    for a, b, _, _ in spans:
        yield place(a), place(b - 1) + 1 if b > a else place(a)


def find_notices(
    docs: DataFrame,
    notices: tuple[Notice, ...] = NOTICES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, phrases, notices) of every row: places of phrases, and spans of notices with their edits.

    ``phrases`` is an array of (label, word), words counted from 0; ``notices`` one of (label, start, end, edits,
    similarity, found): code points of the text, the end exclusive, ``similarity`` 1 less edits over the notice's
    length, ``found`` the canonical words matched. Null texts are empty and, as blank ones, have no words and nothing
    found; texts of any length are searched whole. Repeated rows and null ids are rows like others, other columns are
    not read, an empty table gives no rows. Rows stay where they are: nothing is shuffled.
    """
    bounded_batches(docs)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        search = NoticeSearch(notices)
        for batch in batches:
            at = 0
            for texts in portions(batch.column("text"), PORTION):
                ids, n_words, base, spans = batch.column("id").slice(at, len(texts)), [], [], []
                at += len(texts)
                data, offsets = translated(texts, _CANONICAL)
                for row, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    words = data[a:b].split()
                    canonical = b" ".join(words).decode()
                    n_words.append(len(words))
                    base.append([{"label": label, "word": w} for w, label in phrase_places(canonical, phrases)])
                    found = search.matches(canonical)
                    at_text = _places(texts[row].as_py(), canonical, found) if found else ()
                    spans.append(
                        [
                            {"label": notices[i].label, "start": s, "end": e, "edits": edits, "similarity": 1 - edits / len(notices[i].words), "found": canonical[x:y]}
                            for (x, y, i, edits), (s, e) in zip(found, at_text)
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words, pa.int64()), pa.array(base, pa.list_(_BASE)), pa.array(spans, pa.list_(_SPAN))],
                    ["id", "n_words", "phrases", "notices"],
                )

    base_kind = "array<struct<label:string,word:bigint>>"
    span_kind = "array<struct<label:string,start:bigint,end:bigint,edits:int,similarity:double,found:string>>"
    found = narrow.mapInArrow(releasing(run), f"id {kind}, n_words long, phrases {base_kind}, notices {span_kind}")
    return found.withColumnRenamed("id", id_col)


def _labels(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(a, lambda x: x["label"]) for a in arrays]))), ",")


def license_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is the similarity of the best match: 1 with a phrase, 0 with nothing; ``spans`` lists the notices'
    ``label:start:end:edits``. Odd rows are treated as ``find_notices`` says.
    """
    found = find_notices(docs, id_col=id_col, text_col=text_col, **options)
    places = F.transform("phrases", lambda x: x["word"])
    best = F.coalesce(F.array_max(F.transform("notices", lambda x: x["similarity"])), F.lit(0.0))
    listed = F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"), x["edits"].cast("string")))
    return found.select(
        id_col,
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        _labels(F.col("phrases")).alias("base_labels"),
        _labels(F.col("phrases"), F.col("notices")).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.array_join(listed, ",").alias("spans"),
    )
