"""Byte-level BPE: encoding to identifiers, decoding, and counting without identifiers.

The vocabulary file is a parameter and is read where it lies. Texts are cut at special strings, then
at single spaces into chunks, each chunk into the words of the byte-level pattern, and each word is
merged on its own. All cuts are exact: a word can begin with a space but never holds one further on,
except in runs of white space, and texts with such runs are cut by a pattern instead. A portion of
texts is cut in Arrow, and each of its distinct chunks is merged once. Memory is bounded: portions have
a bounded size, and the results of words are kept in a cache of a fixed number of entries.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from pathloom.llm.common import bounded_batches, releasing
from pathloom.llm.words import portions

#: White space as the pattern's ``\s`` has it (Unicode property White_Space).
_SPACE = "\t-\r \x85\xa0  -     　"
#: A space with white space or the end behind it.
_WIDE = re.compile(f" (?:[{_SPACE}]|\\Z)")
#: Fixed value: the public byte-level word pattern.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Entries of a generation of the word cache, which has two.
WORD_ENTRIES = 400_000
_LONGEST_CACHED = 64
#: Bytes of texts that are cut into chunks at a time.
PORTION_BYTES = 8_000_000
#: Identifiers take 17 bits in a pair's key; this one stands for a merged-away symbol and is in no pair.
_ID_BITS, _GONE = 17, (1 << 17) - 1
_POSITION_BITS = 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for that the words and merges here do not do."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    found = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    found += [f"model {model['type']}"] if model.get("type", "BPE") != "BPE" else []
    found += ["normalizer"] if spec.get("normalizer") else []
    found += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) else []
    odd = [t["content"] for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    return found + [f"added token {t!r}" for t in odd]


class _Cache(dict):
    """A dictionary that computes what it misses; when full it becomes the old generation, from which hits move on."""

    def __init__(self, compute, entries: int):
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= _LONGEST_CACHED:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Vocabulary, merges and special strings of a byte-level BPE file; a file that needs another pipeline is refused."""

    def __init__(self, path: str, word_entries: int = WORD_ENTRIES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if found := unsupported(spec):
            raise ValueError(f"{path}: {', '.join(found)} not supported")
        model, vocab = spec["model"], spec["model"]["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.first_id = [vocab[c] for c in byte_alphabet()]
        #: key of (left id, right id) -> queue entry, less its position; ids of the merged symbols by rank
        self._entry = {vocab[a] << _ID_BITS | vocab[b]: rank << _POSITION_BITS for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.pieces: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        bigram = [[self._entry.get(a << _ID_BITS | b) for b in self.first_id] for a in self.first_id]
        #: the same by two bytes
        self._first_entry = {bytes((a, b)): e for a, row in enumerate(bigram) for b, e in enumerate(row) if e is not None}
        self._word_ids = _Cache(self._encode_word, word_entries)
        self._word_count = _Cache(self._count_word, word_entries)

    @staticmethod
    def _of_chunk(words: _Cache, join, chunk: str):
        """What the words of a chunk, which begins with a space, give together; most are letters, perhaps with one mark behind."""
        if chunk[1:].isalpha():
            return words[chunk]
        if chunk[1:-1].isalpha() and chunk[-1] in ".,":
            return join((words[chunk[:-1]], words[chunk[-1]]))
        return join(map(words.__getitem__, _WORD.findall(chunk)))

    def _merge(self, word: bytes) -> tuple[list[int], int]:
        """Symbols of a word (with the marks of merged-away ones) and the number of merges.

        The queue holds rank and position of adjacent pairs, lowest rank first and then leftmost; the
        symbols are a doubly linked list. ``now`` has the rank of the pair that stands at each position,
        -1 if it has none; a popped entry of another rank is stale and is skipped.
        """
        entry_of, n = self._first_entry.get, len(word)
        symbol = [*map(self.first_id.__getitem__, word)]
        now = [entry_of(word[i : i + 2], -1) for i in range(n - 1)]
        queue = [e + i for i, e in enumerate(now) if e >= 0]
        if not queue:
            return symbol, 0
        entry_of_pair, merged, mask, shift, bits, gone = self._entry.get, self.merged, (1 << _POSITION_BITS) - 1, _POSITION_BITS, _ID_BITS, _GONE
        heapify(queue)
        after, before, merges = [*range(1, n + 1)], [*range(-1, n - 1)], 0
        now.append(-1)
        while queue:
            entry = heappop(queue)
            i = entry & mask
            if now[i] + i != entry:
                continue
            merges += 1
            new = symbol[i] = merged[entry >> shift]
            j = after[i]
            symbol[j], now[j] = gone, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = e = entry_of_pair(new << bits | symbol[k], -1)
                if e >= 0:
                    heappush(queue, e + i)
            else:
                now[i] = -1
            if i:
                h = before[i]
                now[h] = e = entry_of_pair(symbol[h] << bits | new, -1)
                if e >= 0:
                    heappush(queue, e + h)
        return symbol, merges

    # -- encoding ---------------------------------------------------------------------------------
    def _encode_word(self, word: str) -> bytes:
        """Identifiers of a word as little-endian 32-bit integers."""
        symbol, _ = self._merge(word.encode())
        return array("I", [s for s in symbol if s != _GONE]).tobytes()

    def _whole(self, text: str, words: _Cache, special, join):
        """What all words of a text give together; special(id) is what a special string gives."""
        parts = self._cut.split(text) if self._cut else [text]
        return join(
            [special(self.special[part]) if part in self.special else join(map(words.__getitem__, _WORD.findall(part))) for part in parts]
        )

    def _chunks(self, texts: pa.Array, words: _Cache, special, join) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """By portion of texts: where each text's chunks end, the place of each chunk, and what each place gives."""
        for part in portions(texts, PORTION_BYTES):
            rows = [t or "" for t in part.to_pylist()]
            odd = [i for i, t in enumerate(rows) if _WIDE.search(t) or self._cut and self._cut.search(t)]
            whole = [self._whole(rows[i], words, special, join) for i in odd]
            for i in odd:
                rows[i] = ""
            lists = pc.split_pattern(pa.array(rows, pa.string()), " ")
            coded = lists.flatten().dictionary_encode()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            heads = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            distinct = coded.dictionary.to_pylist()
            # No space stands before a text's first chunk; a text that was taken whole has this one only.
            first = {}
            for i, k in enumerate(places[heads].tolist()):
                if k not in first:
                    first[k] = join(map(words.__getitem__, _WORD.findall(distinct[k])))
            behind = np.ones(len(places), bool)
            behind[heads] = False
            used = np.zeros(len(distinct), bool)
            used[places[behind]] = True
            given = [self._of_chunk(words, join, " " + c) if u else None for c, u in zip(distinct, used.tolist())]
            place_of = {k: len(given) + j for j, k in enumerate(first)}
            places[heads] = [place_of[k] for k in places[heads].tolist()]
            places[heads[odd]] = len(given) + len(first) + np.arange(len(odd))
            yield ends, places, [*given, *first.values(), *whole]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Identifiers of each text as little-endian 32-bit integers."""
        for ends, places, given in self._chunks(texts, self._word_ids, lambda i: i.to_bytes(4, "little"), b"".join):
            begin = 0
            for end in ends.tolist():
                yield b"".join(map(given.__getitem__, places[begin:end].tolist()))
                begin = end

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text])))

    def decode(self, ids: bytes) -> bytes:
        """Concatenated vocabulary strings of identifiers, as UTF-8; invalid bytes become U+FFFD."""
        joined = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode()

    # -- counting ---------------------------------------------------------------------------------
    def _count_word(self, word: str) -> int:
        """Initial symbols minus merges."""
        data = word.encode()
        return len(data) - self._merge(data)[1]

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        out = [np.zeros(0, np.int64)]
        for ends, places, given in self._chunks(texts, self._word_count, lambda _: 1, sum):
            tokens = np.array([g or 0 for g in given], np.int64)[places]
            out.append(np.add.reduceat(tokens, np.concatenate([[0], ends[:-1]])))
        return np.concatenate(out)

    def count(self, text: str) -> int:
        return int(self.count_all(pa.array([text]))[0])


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The vocabulary at ``path``, once for each Python worker."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array of int) of the whole text and ``decoded``, the text that the ids give back.

    Null and empty texts give no ids. Special strings inside texts become their identifier. Texts of any
    length are encoded whole. Null or repeated ids pass through, a row each; other columns are not read,
    whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            encoded = list(bpe.encode_all(batch.column(1)))
            offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array([bpe.decode(e).decode() for e in encoded], pa.string())],
                ["id", "ids", "decoded"],
            )

    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(run), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, but with n_tokens and SHA-256 digests in place of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = [(len(ids) // 4, sha(ids), sha(bpe.decode(ids))) for ids in bpe.encode_all(batch.column(1))]
            counts, id_digests, text_digests = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        releasing(run),
        f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    ).withColumnRenamed("id", id_col)


def count_tokens(
    docs: DataFrame,
    vocab_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Texts of any length are counted whole. Null or repeated
    ids pass through, a row each, as do the columns named in ``keep``; other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            counts = bpe.count_all(batch.column(0))
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                [*(f"c{i}" for i in range(len(names))), "n_bytes", "n_tokens", "over_limit"],
            )

    bounded_batches(docs)
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = docs.select(text_col, *names).mapInArrow(releasing(run), f"{kinds}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.toDF(*names, "n_bytes", "n_tokens", "over_limit")
