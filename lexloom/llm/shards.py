"""Shards of nearly equal bytes by longest-processing-time scheduling of groups that must stay together.

The rule: groups go by size, the largest first, each to the shard that is least loaded so far (the smaller number at
equal loads), kept in a heap.  Groups of one size are interchangeable, so the schedule
needs only how many groups there are of each size.  Distinct sizes that sum up to T bytes are at most sqrt(2 T)
many (14 million for 100 TB), whatever the number of documents: that histogram alone comes to the driver, and a
long run of equal groups is dealt at once.  The schedule is exact; the groups of a size then take its places by rank.

Defined results: null text is empty (both are one group, of size 1 a row); rows that repeat a doc_id are rows of
their own; groups are told apart by the SHA-256 of their text; slots follow doc_id (nulls first), then text; a
group of copies that is larger than a shard's share is a shard that is too full, as it must stay together;
only the named columns are looked at, so others may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize
from .graph import field
from .ranks import positions

#: Rows of a schedule (about 30 bytes each) up to which it is broadcast.
_BROADCAST = 500_000


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """sizes: (size, how many), the largest first.  (size, low, high, shard): where the groups of a size go, by rank among them."""
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        taken = [0] * shards
        if count > 2 * shards:
            count -= _level(heap, size, count, taken)
        for _ in range(count):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            taken[s] += 1
        low = 0
        for s, n in enumerate(taken):
            if n:
                yield size, low, low + n, s
                low += n


def _level(heap: list[tuple[int, int]], size: int, count: int, taken: list[int]) -> int:
    """Deal as many of `count` equal groups as leaves each shard with those that begin under one level; returns how many.

    One at a time they would go to the places load, load + size, load + 2 size ... of the shards, the lowest first; so
    those under a level are the same.  What is over (less than a round) is left to the heap.
    """

    def under(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load, _ in heap]

    low, high = heap[0][0], heap[0][0] + size * (count + 1)  # under(low) has none, under(high) too many
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(under(mid)) <= count else (low, mid)
    dealt = under(low)
    for k, n in enumerate(dealt):
        load, s = heap[k]
        heap[k] = (load + size * n, s)
        taken[s] += n
    heapq.heapify(heap)
    return sum(dealt)


def _schedule(groups: DataFrame, shards: int) -> DataFrame:
    """size, low, high, shard for the groups' sizes (a column `total`)."""
    counts = groups.groupBy("total").count().orderBy(F.desc("total"))
    columns = [array("q") for _ in range(4)]
    for row in longest_first(((r["total"], r["count"]) for r in counts.toLocalIterator()), shards):
        for c, v in zip(columns, row, strict=True):
            c.append(v)
    kinds = [pa.int64()] * 3 + [pa.int32()]
    plan = pa.table({n: pa.array(c, pa.int64()).cast(k) for n, c, k in zip(("_size", "_low", "_high", "shard"), columns, kinds, strict=True)})
    out = groups.sparkSession.createDataFrame(plan)
    return F.broadcast(out) if len(columns[0]) <= _BROADCAST else materialize(out, "schedule")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and one), text_crc32, shard, slot (from 0, without gaps in a shard); rows of equal text share a shard."""
    text = F.coalesce(field(text_col), F.lit(""))
    thin = docs.select(field(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialize(thin, "rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("total")), "groups")
    ranked = positions(groups, "total", ["digest"], "_rank")
    at = (F.col("total") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    placed = materialize(ranked.join(_schedule(groups, shards), at).select("digest", "shard"), "placed")
    # two tables, so that the join sees two plain shuffles, of which adaptive execution splits a frequent text's
    dealt = materialize(rows.join(placed, "digest"), "dealt")
    discard(rows, groups, placed)
    return positions(dealt, "shard", ["doc_id", "digest"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
