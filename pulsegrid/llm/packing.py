"""Best-fit decreasing packing of token sequences.

Documents become pieces of at most CAPACITY tokens.  Pieces are dealt by hash
into groups of about GROUP pieces, and each group is packed by best-fit
decreasing: a segment tree over remaining capacities names the tightest open
bin in logarithmic time.  Only piece sizes travel, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.pretoken import END_OF_TEXT, encoder
from pulsegrid.session import cut_lineage

CAPACITY = 1024
#: Pieces a packing task sees; best-fit decreasing wastes next to nothing at this many.
GROUP = 60_000
_PIECES = "piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Open bins by remaining capacity, with the count of bins below every node."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        at = self.leaves + remaining
        while at:
            self.count[at] += 1
            at >>= 1

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """(remaining, bin) of an open bin with the least remaining capacity >= size, taken out."""
        at, count = self.leaves + size, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        remaining = at - self.leaves
        number = self.bins[remaining].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return remaining, number


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of every length; ties of length are taken in the given order."""
    tree, opened = CapacityTree(capacity), 0
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[i]
        found = tree.pop_tightest(size) if size < capacity else None
        if found is None:
            remaining, number, opened = capacity, opened, opened + 1
        else:
            remaining, number = found
        bins[i], offsets[i] = number, capacity - remaining
        if remaining > size:
            tree.push(remaining - size, number)
    return bins, offsets


def _pieces(path: str, capacity: int):
    end = np.array([END_OF_TEXT], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_many
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    begin = 0
                    for k in range(-(-n // capacity)):
                        stop = first if k == 0 else begin + capacity
                        docs.append(i)
                        piece.append(k)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(zlib.crc32(ids[4 * begin : 4 * stop]))
                        begin = stop
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(docs, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    A document is its ids and the id 2; a null or empty text is that id alone.
    Longer ones are cut into pieces of ``capacity``, the first of which may be
    shorter.  Rows that repeat an id are packed each on its own.  Extra columns
    are ignored.  Fewer than ``group`` pieces make one packing task.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    # the pieces are used twice, so the costly ids are made once
    pieces = cut_lineage(plain.mapInArrow(_pieces(tokenizer_path, capacity), f"doc_id {kind}, {_PIECES}"))
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit_decreasing(rows["length"].tolist(), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + np.array(bins, np.int64)
        rows["offset"] = np.array(offsets, np.int64)
        return rows.drop(columns=["deal"])

    return dealt.groupBy("deal").applyInPandas(pack, f"doc_id {kind}, {_PIECES}, sequence_id long, offset long")
