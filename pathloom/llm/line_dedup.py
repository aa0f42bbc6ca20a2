"""Dedup of lines across documents.

Each document gives one row for each distinct line key: a 128-bit hash, the document and the line's
positions. The rows are range-partitioned by (hash, document), so that a line that a third of all
documents hold is split over many partitions, and sorted by hash, document and text. A stream over each
partition counts the documents of a hash and passes on the rows of hashes that reach the threshold.
Only the first and the last hash of a partition can go on in another one; of these, and of hashes of
which a task would have to hold too many rows of one document, the counts are added up and broadcast. What
comes out are compressed bitmaps of the lines to keep, one for each document that loses any. A bit set of
these lets the texts of all other documents pass where they are; only the others' texts are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ASCII_SPACE, bit_set, bits_for, bounded_batches, materialize, packed, probe_bit_set, releasing, shuffle_partitions

MIN_DOCUMENTS = 10
MIN_CHARS = 1
_STRIP = ASCII_SPACE.encode()
_DROP, _OPEN, _COUNT = 0, 1, 2
_KEYS = ["h1", "h2", "doc", "content"]
#: Rows of a hash that a task holds back before it passes them on undecided.
HELD_ROWS = 50_000


def line_keys(data: bytes) -> list[bytes]:
    """Keys of the lines of a text in UTF-8: stripped of ASCII white space, A-Z in lower case."""
    return [line.strip(_STRIP) for line in data.lower().split(b"\n")]


def _chars(key: bytes) -> int:
    return len(key) - sum(1 for b in key if b & 0xC0 == 0x80)


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, row_of, positions, lines = [], [], [], []
            for row, text in enumerate(batch.column(2)):
                at: dict[bytes, list[int]] = {}
                keys = line_keys((text.as_py() or "").encode())
                for i, key in enumerate(keys):
                    if key:
                        at.setdefault(key, []).append(i)
                for key, where in at.items():
                    if min_chars <= 1 or _chars(key) >= min_chars:
                        hashes.append(xxhash.xxh3_128_digest(key))
                        row_of.append(row)
                        positions.append(np.array(where, "<u4").tobytes())
                        lines.append(len(keys))
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            taken = pa.array(row_of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    pa.array(lines, pa.int32()),
                    pa.array(positions, pa.binary()),
                ],
                ["h1", "h2", "doc", "content", "n_lines", "positions"],
            )

    return run


def _stream(threshold: int, held_rows: int = HELD_ROWS):
    """Over rows sorted by hash and document: rows of frequent hashes, and what is open at both ends of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "content", "n_lines", "positions", "state", "n_docs"]

        def rows(part: pa.RecordBatch, state: int) -> pa.RecordBatch:
            n = part.num_rows
            return pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(n, state, np.int32)), pa.array(np.zeros(n, np.int64))],
                names,
            )

        # The hash that the last batch ended in: its documents so far, its last document, the rows held back,
        # and if some were passed on undecided.
        current, count, last_doc, held, passed, first = None, 0, None, [], False, True

        def close(at_edge: bool) -> Iterator[pa.RecordBatch]:
            if current is None or not (at_edge or passed):
                return  # inside the partition, fewer documents than the threshold: the lines stay
            yield from (rows(part, _OPEN) for part in held)
            template = template_of
            nulls = [pa.nulls(1, template.schema.field(c).type) for c in ("doc", "content", "n_lines", "positions")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([current[0]], pa.int64()),
                    pa.array([current[1]], pa.int64()),
                    *nulls,
                    pa.array([_COUNT], pa.int32()),
                    pa.array([count], pa.int64()),
                ],
                names,
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            template_of = batch
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc = batch.column(2).to_pylist()
            new_hash = np.ones(n, bool)
            new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = np.ones(n, bool)
            new_doc[1:] = new_hash[1:] | np.fromiter((a != b for a, b in zip(doc[1:], doc[:-1])), bool, n - 1)
            starts = np.flatnonzero(new_hash)
            ends = np.append(starts[1:], n)
            docs_of = np.add.reduceat(new_doc.astype(np.int64), starts)
            same = current == (h1[0], h2[0])
            if not same:
                yield from close(first)
                if current is not None:
                    first = False
                current, count, last_doc, held, passed = (h1[0], h2[0]), 0, None, [], False
            # The first run of the batch goes on with the current hash.
            count += int(docs_of[0]) - int(same and doc[0] == last_doc)
            held.append(batch.slice(0, ends[0]))
            last_doc = doc[ends[0] - 1]
            if count >= threshold:
                yield from (rows(part, _DROP) for part in held)
                held = []
            elif sum(part.num_rows for part in held) > held_rows:
                yield from (rows(part, _OPEN) for part in held)
                held, passed = [], True
            if len(starts) > 1:
                yield from close(first)
                first = False
                # Runs that begin and end in this batch.
                frequent = docs_of[1:-1] >= threshold
                if frequent.any():
                    picked = np.zeros(n, bool)
                    picked[starts[1]: starts[-1]] = np.repeat(frequent, (ends - starts)[1:-1])
                    yield rows(batch.filter(pa.array(picked)), _DROP)
                # The last run may go on in the next batch.
                current, count, held, passed = (h1[-1], h2[-1]), int(docs_of[-1]), [batch.slice(starts[-1])], False
                last_doc = doc[-1]
                if count >= threshold:
                    yield from (rows(part, _DROP) for part in held)
                    held = []
        yield from close(True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, dropped = [], []
        for lines, lists in zip(batch.column(2), batch.column(3)):
            keep = np.ones(lines.as_py(), bool)
            keep[np.frombuffer(b"".join(lists.as_py()), "<u4")] = False
            dropped.append(int(len(keep) - keep.sum()))
            kept.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())],
            ["doc", "content", "n_lines", "n_dropped", "keep_bitmap"],
        )


def line_keep_bitmaps(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc, content, n_lines, n_dropped, keep_bitmap) for the documents that lose a line.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of
    ``min_chars`` code points or more that ``min_documents`` or more documents hold lose all their
    lines. A document is an id: rows that repeat an id count once for a key, and rows with a null id
    count as one document; the rows of one key and id are in one task. ``content`` is the hash of the text,
    which tells apart rows that share an id. ``keep_bitmap`` is a zlib-compressed bit string with a 1 for
    each line to keep. Null or empty texts have one empty line, which is never dropped. Texts of any length
    are split whole; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("content"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    row = f"h1 bigint, h2 bigint, doc {kind}, content bigint, n_lines int, positions binary"
    sorted_rows = rows.mapInArrow(releasing(_occurrences(min_chars)), row).repartitionByRange(
        shuffle_partitions(spark),
        "h1",
        "h2",
        "doc",
    ).sortWithinPartitions(*_KEYS)
    streamed = materialize(sorted_rows.mapInArrow(releasing(_stream(min_documents)), f"{row}, state int, n_docs bigint"), "lines")
    over_edges = streamed.where(F.col("state") == _COUNT).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_documents)
    # At most two rows a partition, and one for every HELD_ROWS rows.
    resolved = streamed.where(F.col("state") == _OPEN).join(F.broadcast(over_edges), ["h1", "h2"], "left_semi")
    dropped = streamed.where(F.col("state") == _DROP).unionByName(resolved)
    by_document = dropped.groupBy("doc", "content").agg(F.max("n_lines").alias("n_lines"), F.collect_list("positions").alias("lists"))
    return by_document.mapInArrow(releasing(_bitmaps), f"doc {kind}, content bigint, n_lines int, n_dropped bigint, keep_bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (__row, __keep): the rows of ``docs`` as structs, with their bitmap, or null if they keep all their lines."""
    wanted = materialize(
        bitmaps.select(F.col("doc").alias("__doc"), F.col("content").alias("__loses"), F.col("keep_bitmap").alias("__keep")),
        "bitmaps",
    )
    bits = bits_for(wanted.count())
    rows = packed(docs, __id=F.col(id_col), __content=F.xxhash64(F.coalesce(text_col, F.lit(""))))
    probed = probe_bit_set(rows, F.col("__content"), bit_set(wanted, F.col("__loses"), bits), bits)
    passed = probed.where("not _hit").select("__row", F.lit(None).cast("binary").alias("__keep"))
    # A merge join at any size: bitmaps grow with the table.
    asked = probed.where("_hit").join(wanted.hint("merge"), F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__content") == F.col("__loses")), "left")
    return passed.unionByName(asked.select("__row", "__keep"))


def kept_lines(data: bytes, bitmap: bytes | None) -> tuple[list[bytes], int]:
    """The lines of a text that stay, and how many there were."""
    lines = data.split(b"\n")
    if bitmap is None:
        return lines, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return [line for line, k in zip(lines, keep.tolist()) if k], len(lines)


def line_dedup_digests(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped and the SHA-256 of the lines that stay, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, digests = [], [], []
            for text, bitmap in zip(batch.column(1), batch.column(2)):
                lines, n = kept_lines((text.as_py() or "").encode(), bitmap.as_py())
                before.append(n)
                after.append(n - len(lines))
                digests.append(hashlib.sha256(b"\n".join(lines)).hexdigest())
            columns = [batch.column(0), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_lines", "n_dropped", "kept_sha256"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = with_bitmaps(read, line_keep_bitmaps(read, min_documents, min_chars, "id", "text"), "id", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    found = joined.select("__row.id", "__row.text", "__keep").mapInArrow(
        releasing(run),
        f"id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string",
    )
    return found.withColumnRenamed("id", id_col)


def drop_repeated_lines(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; null texts stay null, other columns, of any name, pass through."""
    spot, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[spot]
            lose = [i for i, k in enumerate(batch.column(1)) if k.is_valid]
            left = [b"\n".join(kept_lines(texts[i].as_py().encode(), batch.column(1)[i].as_py())[0]).decode() for i in lose]
            mask = np.zeros(batch.num_rows, bool)
            mask[lose] = True
            columns[spot] = pc.replace_with_mask(texts, pa.array(mask), pa.array(left, texts.type))
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = with_bitmaps(docs, line_keep_bitmaps(docs, min_documents, min_chars, id_col, text_col), id_col, text_col)
    return joined.mapInArrow(releasing(run), docs.schema)
