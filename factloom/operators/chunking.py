"""Greedy chunks of pages: a page opens a new chunk if the current one has pages and would grow beyond a size.

The fold is sequential, but what it depends on is small. From a page that opens a chunk the next
opening page follows from running sums of sizes by binary search, so openings are pointers.
A run of pages is entered with a chunk of some length, and that decides no more than where its
first opening is; from there on the pointers lead, and doubling them gives for every
possible first opening how many follow and how long the last chunk is.

1. Pages (key, order and size only) are sorted into ranges by key and order, so a key with
   any share of the pages lies in many ranges; the ranges are written once.
2. Ranges say for the key that they begin and the key that they end with what leaves them for each
   way to be entered: as many ways as pages fit into one chunk, at most.
3. These summaries stream by in order, a key's ranges one after the other, and give the chunk that
   each range is entered with.
4. Ranges number their pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _keys(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The table in order, and where its keys begin, with its length at the end."""
    order = [(c, "ascending") for c in ("k", "o", "n")]
    table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start")).combine_chunks()
    k = table["k"].combine_chunks() if isinstance(table["k"], pa.ChunkedArray) else table["k"]
    same = pc.fill_null(pc.equal(k[1:], k[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(k[1:]).to_numpy(zero_copy_only=False) & pc.is_null(k[:-1]).to_numpy(zero_copy_only=False))
    return table, np.flatnonzero(np.r_[True, ~same.astype(bool), True])


class Run:
    """Sizes of sorted pages; keys begin at ``starts``."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray, most: int):
        n = len(sizes)
        self.sums, self.most, self.starts = np.concatenate([[0], np.cumsum(sizes)]), most, starts
        ends = np.repeat(starts[1:], np.diff(starts))
        # The page whose end is the first beyond the limit, but not the opening one; the end of the key if that is nearer.
        beyond = np.searchsorted(self.sums, self.sums[:-1] + most, "right") - 1
        self.next = np.minimum(np.maximum(np.arange(n) + 1, beyond), ends)

    def first_opening(self, length: int, end: int) -> int:
        """Where the first chunk opens if the run is entered with one of this length."""
        return min(max(0, int(np.searchsorted(self.sums, self.most - length, "right")) - 1), end)

    def summary(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For every page start..end - 1 as an opening: openings up to ``end``, itself included, and the last chunk's length."""
        last = np.arange(end - start)
        onward = self.next[start:end] - start
        count = (onward < end - start).astype(np.int64)
        hop = np.where(count > 0, onward, last)
        while count.any() and (hop != hop[hop]).any():
            count = count + count[hop]
            hop = hop[hop]
        return count + 1, self.sums[end] - self.sums[start + hop]

    def openings(self, first: int) -> np.ndarray:
        """True for pages that open chunks; no page before ``first`` does."""
        out = np.zeros(len(self.next) + 1, bool)
        at, follow, n = first, self.next.tolist(), len(self.next)
        while at < n:
            out[at] = True
            at = follow[at]
        return out[:n]


def _summaries(most: int):
    def run(table: pa.Table) -> pa.Table:
        """Of the first and the last key of a range: entry lengths from which on each first opening holds, and what follows."""
        table, starts = _keys(table)
        r, rows = Run(table["n"].to_numpy(), starts, most), []
        for which in dict.fromkeys((0, len(starts) - 2)):
            a, b = int(starts[which]), int(starts[which + 1])
            count, left = r.summary(a, b)
            fit = max(1, int(np.searchsorted(r.sums[a : b + 1] - r.sums[a], most, "right")))
            rows.append((table["part"][a].as_py(), which == 0, int(r.sums[b] - r.sums[a]), (r.sums[a + 1 : min(b, a + fit) + 1] - r.sums[a]).tolist(), count[:fit].tolist(), left[:fit].tolist(), table["k"][a].as_py()))
        cols = list(zip(*rows, strict=True))
        kinds = (("part", pa.int32()), ("begins", pa.bool_()), ("total", pa.int64()), ("upto", pa.list_(pa.int64())), ("opened", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("k", table.schema.field("k").type))
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], schema=pa.schema(kinds))

    return run


def _entered(most: int):
    def run(batches):
        """The chunk and its length that each range's first key is entered with; keys come together, ranges in order."""
        key, chunk, length, seen = None, 0, 0, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not seen or row["k"] != key:
                    key, chunk, length, seen = row["k"], -1, most + 1, True  # as if full: the first page opens chunk 0
                if row["begins"]:
                    out.append((row["part"], chunk, length))
                at = int(np.searchsorted(row["upto"], most - length, "right"))
                if at == len(row["upto"]):
                    length += row["total"]
                else:
                    chunk, length = chunk + row["opened"][at], row["last"][at]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "chunk", "length"])

    return run


def _numbered(most: int):
    def run(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, starts = _keys(table)
        r = Run(table["n"].to_numpy(), starts, most)
        opens = r.openings(r.first_opening(entry["length"][0].as_py(), int(starts[1])))
        chunk = np.cumsum(opens)
        base = np.repeat(np.where(starts[:-1] == 0, -entry["chunk"][0].as_py(), chunk[np.minimum(starts[:-1], len(chunk) - 1)]), np.diff(starts))
        return pa.table({"k": table["k"], "o": table["o"], "chunk": pa.array((chunk - base).astype(np.int32))})

    return run


def chunked(pages: DataFrame, most: int, key: str = "doc_id", order: str = "page_num", size: Column | None = None) -> DataFrame:
    """(key, order, chunk): a page opens a new chunk if the current one has pages and would grow beyond ``most`` characters.

    Pages without an order come first; pages of one order follow by size."""
    size = F.length(F.coalesce("text", F.lit(""))) if size is None else size
    rows = pages.select(F.col(key).alias("k"), F.col(order).alias("o"), size.cast("long").alias("n"))
    kind, by = rows.schema["k"].dataType.simpleString(), rows.schema["o"].dataType.simpleString()
    rows = staged(rows.repartitionByRange("k", "o", "n").withColumn("part", F.spark_partition_id()), "page-ranges")
    ends = rows.groupBy("part").applyInArrow(_summaries(most), f"part int, begins boolean, total long, upto array<long>, opened array<long>, last array<long>, k {kind}")
    entries = ends.repartition("k").sortWithinPartitions("k", "part").mapInArrow(_entered(most), "part int, chunk long, length long")
    out = rows.groupBy("part").cogroup(entries.groupBy("part")).applyInArrow(_numbered(most), f"k {kind}, o {by}, chunk int")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "chunk")
