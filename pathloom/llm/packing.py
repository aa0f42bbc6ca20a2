"""Best-fit packing of documents into fixed-size bins under conflicts.

A bin may hold one document of a source and one of a cluster of copies. Rows that are equal in all that counts are
first added up, and their copies dealt in small portions by a hash, as all others, into shards of a bounded number of
rows; each shard is packed on its own, so that the work of a task does not grow with the table and no source, cluster
or repeated row meets in one task as a whole. In a shard, open bins are ordered by residual capacity, and every source
and every cluster has the bitmap of the bins that hold it; the successor search goes up from the tightest residual that
fits until a residual has a bin in neither bitmap, of several the oldest, else a bin is opened. Documents longer than a
bin are cut into pieces, never shortened; a piece is a range of units of length (by default bytes of UTF-8, where a cut
may fall inside a character: the pieces of a document joined again are its text).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
SHARD_ROWS = 4096
#: Copies of one row that are dealt together.
COPIES = 64
#: A shard's bins are numbered from its own number times this.
_BINS_A_SHARD = 1 << 32


def fingerprint(text_col: str = "text") -> Column:
    """Cluster of exact copies, but for case and white space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))))


class BestFit:
    """Open bins by residual capacity, and by source and cluster, as bitmaps over the bins."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins = 0
        self.open = 0
        self.present = 0  # bit r: a bin has residual r
        self.by_residual: dict[int, int] = defaultdict(int)
        self.of_source: dict = defaultdict(int)
        self.of_cluster: dict = defaultdict(int)

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """Bin of an item and the item's offset in it; a null source or cluster conflicts with nothing."""
        free = self.open & ~self.of_source.get(source, 0) & ~self.of_cluster.get(cluster, 0)
        at = size
        while free and (rest := self.present >> at):
            at += (rest & -rest).bit_length() - 1
            if fits := self.by_residual[at] & free:
                b = (fits & -fits).bit_length() - 1
                self.by_residual[at] ^= 1 << b
                if not self.by_residual[at]:
                    self.present ^= 1 << at
                self._put(b, at - size, source, cluster)
                return b, self.capacity - at
            at += 1
        self.bins += 1
        self._put(self.bins - 1, self.capacity - size, source, cluster)
        return self.bins - 1, 0

    def _put(self, b: int, residual: int, source, cluster) -> None:
        bit = 1 << b
        if source is not None:
            self.of_source[source] |= bit
        if cluster is not None:
            self.of_cluster[cluster] |= bit
        self.open |= bit
        self.by_residual[residual] |= bit
        self.present |= 1 << residual


def pack_shard(items: list[tuple], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, piece_len, bin, offset) of a shard's (length, source, cluster) items.

    Items go in by decreasing length of their last piece; ties in the order given.
    """
    fit, placed, whole, lasts = BestFit(capacity), [], [], []
    for i, (length, _, _) in enumerate(items):
        full = max(0, (length - 1) // capacity)
        whole += [(i, p, capacity) for p in range(full)]
        lasts.append((i, full, length - full * capacity))
    for i, piece, size in sorted(lasts, key=lambda x: -x[2]):
        placed.append((i, piece, size, *fit.place(size, *items[i][1:])))
    return placed + [(i, p, size, fit.bins + k, 0) for k, (i, p, size) in enumerate(whole)]


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length: Column | None = None,
    cluster: Column | None = None,
) -> DataFrame:
    """Rows (id, piece, piece_start, piece_len, bin_id, bin_offset): where each piece of each document lies.

    ``length`` is a document's length in the unit of ``capacity``, by default its UTF-8 bytes; ``cluster``
    names its group of copies, by default ``fingerprint``, which knows exact copies only; near copies are
    kept apart where a join's component is given. In a bin no two documents share a source or a cluster;
    null sources and clusters conflict with nothing. Null or empty texts have length 0 and one piece. Every
    row is packed, repeated ones and null ids included, and ids of any size come back as they are; longer items go in
    first, ties by id, text and source, and of bins with equal residuals the oldest is taken. Other columns are not read, whatever their names; an
    empty table gives no rows.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) if length is None else length
    narrow = docs.select(
        F.col(id_col).alias("id"),
        size.cast("long").alias("length"),
        F.col(source_col).cast("string").alias("source"),
        (fingerprint(text_col) if cluster is None else cluster).alias("cluster"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("content"),
    )
    n_shards = max(1, -(-docs.count() // shard_rows))
    same = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("copies"))
    portions = same.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    times = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("part") * COPIES).alias("times")
    shard = F.pmod(F.xxhash64("id", "content", "source", "part"), F.lit(n_shards)).alias("shard")
    dealt = portions.select(*narrow.columns, "part", times, shard)

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("id", "content", "source", "part")]))
        rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), rows["times"].to_numpy())))
        packed = pack_shard([*zip(*(rows[c].to_pylist() for c in ("length", "source", "cluster")))], capacity)
        item, piece, piece_len, bins, offset = np.array(packed, np.int64).reshape(-1, 5).T
        # Ids stay in Arrow: as doubles, which pandas makes of integers beside nulls, large ones would change.
        columns = [rows["id"].take(pa.array(item)), piece, piece * capacity, piece_len, bins + key[0].as_py() * _BINS_A_SHARD, offset]
        return pa.table(columns, names=["id", "piece", "piece_start", "piece_len", "bin_id", "bin_offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInArrow(
        pack,
        f"id {kind}, piece long, piece_start long, piece_len long, bin_id long, bin_offset long",
    )
    return packed.withColumnRenamed("id", id_col)
