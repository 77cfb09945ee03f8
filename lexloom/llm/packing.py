"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Token counts are integers of at most `capacity`, so a packing problem of any size is
its histogram: at most `capacity` rows, whatever the corpus.  The plan is made on
that histogram and applied to the pieces by rank, in parallel.

The plan first applies the Martello-Toth reduction.  For an item size j it fixes
{j} when nothing fits beside it, {j, i} when i fills the rest exactly or when only one
item fits and i is the largest, and {j, a, b} when two items fit at most and the pair
dominates every other pair; each is part of some optimal packing.  What is left is
packed by best fit, largest first, in bulk over equal sizes.

Defined results: null and empty texts are one piece that holds only the end token; rows that repeat a doc_id or a text are
documents of their own; of equally long pieces the order decides which goes where, and repeated ones are interchangeable; texts longer than a
sequence are cut, none is shortened; columns other than id and text aren't looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize
from .bpe import text_chunks, tokenizer

Bins = list[tuple[tuple[int, ...], int]]


class _Stock:
    """How many items of each size are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for size, count in counts.items():
            if not 1 <= size <= capacity:
                raise ValueError(f"size {size} is outside 1..{capacity}")
            self.n[size] += count

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest size of at most `most` that is left besides `without`; 0 if none."""
        while most > 0:
            at = np.flatnonzero(self.n[1 : most + 1])
            if not len(at):
                return 0
            size = int(at[-1]) + 1
            if self.n[size] > without.count(size):
                return size
            most = size - 1
        return 0

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items besides one of size `without`."""
        out: list[int] = []
        for size in np.flatnonzero(self.n):
            out += [int(size)] * int(min(k, self.n[size] - (size == without)))
            if len(out) >= k:
                break
        return out[:k]

    def take(self, pattern: tuple[int, ...]) -> int:
        """Take the pattern as often as the stock allows."""
        times = min(int(self.n[s]) // pattern.count(s) for s in set(pattern))
        for s in pattern:
            self.n[s] -= times
        return times


def _dominant(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every other feasible set with j, if the tests find one."""
    room = capacity - j
    low = stock.smallest(3, j)
    if not low or low[0] > room:
        return (j,)
    i = stock.largest(room, (j,))
    if i == room or len(low) < 2 or low[0] + low[1] > room:
        return (j, i)
    if len(low) < 3 or sum(low) > room:
        b = stock.largest(room - i, (j, i))
        if b == 0:
            return None
        rival = stock.largest(room // 2, (j,))  # the largest smaller item of any pair
        if rival <= b:
            return (j, i, b)
    return None


def plan_bins(counts: dict[int, int], capacity: int) -> Bins:
    """Patterns of sizes and how many bins each fills; they hold every item exactly once."""
    stock, bins = _Stock(counts, capacity), []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while stock.n[j]:
                pattern = _dominant(stock, j, capacity)
                if pattern is None:
                    break
                bins.append((pattern, stock.take(pattern)))
                changed = True
    return bins + _best_fit(stock, capacity)


def _best_fit(stock: _Stock, capacity: int) -> Bins:
    """Best fit decreasing; open bins of one pattern are handled together."""
    open_bins: dict[int, list[list]] = {capacity: []}
    for j in range(capacity, 0, -1):
        left = int(stock.n[j])
        while left:
            room = min((r for r, groups in open_bins.items() if r >= j and groups), default=None)
            group = open_bins[room].pop() if room is not None else [(), left]
            room = capacity if room is None else room
            each = room // j
            full = min(group[1], left // each)
            if full:
                open_bins.setdefault(room - each * j, []).append([group[0] + (j,) * each, full])
                left -= full * each
                rest = group[1] - full
            else:
                open_bins.setdefault(room - left * j, []).append([group[0] + (j,) * left, 1])
                left, rest = 0, group[1] - 1
            if rest and group[0]:
                open_bins[room].append([group[0], rest])
        stock.n[j] = 0
    return [(tuple(p), n) for groups in open_bins.values() for p, n in groups]


def slots(bins: Bins) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of a length go, by rank."""
    out, taken, sequence = [], {}, 0
    for pattern, times in bins:
        offset = 0
        for size in pattern:
            low = taken.get(size, 0)
            out.append((size, low, low + times, sequence, offset))
            taken[size] = low + times
            offset += size
        sequence += times
    return out


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then `end_id`.  Of a longer document the first piece takes
    what is over; all others are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for a, _, texts in text_chunks(batch, 1):
                ids, counts = t.encode(texts)
                ends = np.cumsum(counts)
                data = np.insert(ids, ends, end_id).astype("<u4").tobytes()
                totals = counts + 1
                begins = np.cumsum(totals) - totals
                n = -(-totals // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = totals - capacity * (n - 1)
                start = np.where(piece == 0, 0, head[doc] + capacity * (piece - 1))
                length = np.where(piece == 0, head[doc], capacity)
                at = (begins[doc] + start) * 4
                crc = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + a)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(pieces: DataFrame, capacity: int = 1024, per_group: int = 1000) -> DataFrame:
    """Adds sequence_id and offset to pieces (a column `length` of 1..capacity; other columns stay).

    `pieces` is read three times: pass a table, not a costly plan.  Ranks within a length are
    dealt over hash groups of about `per_group` rows, so that a length that most pieces
    share is not one task's work.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = slots(plan_bins(counts, capacity)) or [(0, 0, 0, 0, 0)]
    lookup = spark.createDataFrame(plan, "_size long, _low long, _high long, _first long, _offset long")
    groups = max(1, -(-max(counts.values(), default=1) // per_group))
    names = pieces.columns
    keyed = pieces.select("*", F.struct(*names).alias("_row")).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = keyed.groupBy(F.col("length").alias("_l"), F.col("_group").alias("_g")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_l").orderBy("_g")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_group").orderBy("_row")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_group") == F.col("_g"))).withColumn("_rank", F.col("_before") + F.col("_k"))
    placed = ranked.join(F.broadcast(lookup), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    return placed.select(*names, (F.col("_first") + F.col("_rank") - F.col("_low")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit_pack(materialize(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
