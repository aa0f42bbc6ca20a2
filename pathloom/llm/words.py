"""Words of texts in Arrow arrays: each distinct word of a portion once, and every word as a place among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def portions(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive texts of a bounded size in UTF-8 together; a longer text is a portion of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        done = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text, the place of every word among the distinct ones, and these.

    Words are runs without ASCII white space. Null, empty and blank texts have none.
    """
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    coded = lists.flatten().dictionary_encode()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    places = coded.indices.to_numpy(zero_copy_only=False)
    # A text without words is split into one empty string.
    blank = np.flatnonzero(pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False))
    if len(blank):
        places = np.delete(places, (np.cumsum(counts) - counts)[blank])
        counts[blank] = 0
    return counts, places, coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def translated(texts: pa.Array, table: bytes) -> tuple[bytes, np.ndarray]:
    """The texts' UTF-8 in one piece, every byte replaced by what ``table`` has for it, and their bounds; null texts are empty."""
    whole = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = whole.buffers()[2]
    return (data.to_pybytes() if data is not None else b"").translate(table), offsets
