"""Substring dedup: repeated 50-word windows, found with a count-min prefilter.

Every window of `size` words contains exactly one smallest `gram`-word hash
(its minimiser), so windows that are equal have equal minimisers and a window
occurs at most as often as its minimiser.  Pass one counts minimisers (one a
document) in a count-min sketch for each partition; merged, the sketch never
underestimates.  Pass two looks only at windows whose estimate is two or more
and groups those exactly, by a 128-bit hash of the window's words.  No repeated
window is lost: the sketch errs only towards more work.

The sketch is sized from the corpus and bounded by `max_cells` a row; it is
kept as one bit a cell (two or more), so what is broadcast never exceeds
`DEPTH * max_cells / 8` bytes (128 MB at the default).  Beyond that it fills up and
the prefilter lets more windows through; results stay the same.

Defined results: null text has no words; a text of fewer than `size` words loses
nothing; rows that repeat a doc_id are one document for the comparison of ids, but
only the windows of a row's own text are taken out of it; a null doc_id counts as larger than any other;
an empty table gives an empty table; columns other than id and text aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import materialize
from . import words as W
from .graph import ROW, keyed, prefilter

DEPTH = 2
_LAST = (1 << 63) - 1
_ROWS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_BLOCK = 1 << 21


def _cells(key: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (W.mix(key * np.uint64(_ROWS[row])) & np.uint64(cells - 1)).astype(np.int64)


def _windows(texts: list[bytes], size: int, gram: int):
    """Words, their hashes, which windows lie in one document, and each window's minimiser."""
    w = W.Words(texts)
    h = w.hashes()
    ok = W.same_doc(w.doc, size)
    least = W.sliding_min(W.grams(h, gram), size - gram + 1)
    return w, h, ok, least


def _sketch(cells: int, size: int, gram: int):
    """Mapper: one saturated sketch for each partition, sent as the touched cells of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = [np.zeros(cells >> 3, dtype=np.uint8) for _ in range(DEPTH)]
        twice = [np.zeros(cells >> 3, dtype=np.uint8) for _ in range(DEPTH)]
        for batch in batches:
            for _, _, texts in W.parts(batch, 0):
                w, _, ok, least = _windows(texts, size, gram)
                if not ok.any():
                    continue
                key, doc = least[ok], w.doc[: len(ok)][ok]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
                key, doc = key[new], doc[new]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                key = key[np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))]
                for row in range(DEPTH):
                    cell, n = np.unique(_cells(key, row, cells), return_counts=True)
                    bit = (1 << (cell & 7)).astype(np.uint8)
                    again = (n > 1) | ((once[row][cell >> 3] & bit) > 0)
                    np.bitwise_or.at(twice[row], cell[again] >> 3, bit[again])
                    np.bitwise_or.at(once[row], cell >> 3, bit)
        out: dict[str, list] = {"row": [], "block": [], "once": [], "twice": []}
        for row in range(DEPTH):
            for block in range(max(1, cells // _BLOCK)):
                part = slice(block * _BLOCK >> 3, (block + 1) * _BLOCK >> 3)
                if once[row][part].any():
                    out["row"].append(row)
                    out["block"].append(block)
                    out["once"].append(_pack(once[row][part]))
                    out["twice"].append(_pack(twice[row][part]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return run


def _pack(bits: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Saturating sum of sketches: a cell is at two when any sketch has two, or two sketches have one."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    once = twice = None
    for a, b in zip(group["once"], group["twice"], strict=True):
        a, b = (np.frombuffer(unpack.decompress(x), dtype=np.uint8) for x in (a, b))
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    first = group.iloc[0]
    return pd.DataFrame({"row": [first["row"]], "block": [first["block"]], "once": [_pack(once)], "twice": [_pack(twice)]})


def _candidates(sketch, cells: int, size: int, gram: int):
    """Mapper: the windows that the sketch estimates at two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for batch in batches:
            ids, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for a, b, texts in W.parts(batch, 2):
                w, h, ok, least = _windows(texts, size, gram)
                if not ok.any():
                    continue
                for row in range(DEPTH):
                    cell = _cells(least, row, cells)
                    ok = ok & ((bits[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                one, two = W.grams(h, size), W.grams(W.mix(h + np.uint64(_ROWS[0])), size, 0xD6E8FEB86659FD93)
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(ids[a:b][doc]), pa.array(own[a:b][doc]), pa.array((at - w.first[doc]).astype(np.int32))],
                    names=["h1", "h2", "doc", ROW, "pos"],
                )

    return run


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper: texts compressed one by one, as they cross the network whole."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([pack.compress(t) for t in W.encoded(batch.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", ROW, "packed"])


def _apply(size: int):
    """Mapper: take out the words of a row that the given windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for packed, at in zip(batch.column(1), batch.column(2), strict=True):
                own = unpack.decompress(packed.as_py()).split()
                if at.is_valid and len(own):
                    delta = np.zeros(len(own) + 1, dtype=np.int32)
                    at = np.unique(at.values.to_numpy())
                    at = at[at + size <= len(own)]
                    delta[at] += 1
                    np.subtract.at(delta, at + size, 1)
                    gone = np.cumsum(delta[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    n_words.append(len(own))
                    own = [own[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    n_removed.append(0)
                    n_words.append(len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, gram: int = 8, max_cells: int = 1 << 29) -> DataFrame:
    """Remove words covered by a `size`-word window that also starts in a document of a smaller id.

    Returns doc_id, n_words, n_removed, kept (the words left, joined by one space).
    """
    spark = docs.sparkSession
    rows = keyed(docs).select(ROW, F.col("own").getField(id_col).alias("doc_id"), F.coalesce(F.col("own").getField(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max_cells, 1 << max(21, (chars // 16).bit_length()))
    blocks = (
        rows.select("text")
        .mapInArrow(_sketch(cells, size, gram), "row int, block int, once binary, twice binary")
        .withColumn("salt", F.spark_partition_id() % 32)
    )
    schema = "row int, block int, once binary, twice binary"
    merged = blocks.groupBy("row", "block", "salt").applyInPandas(_merge, schema).groupBy("row", "block").applyInPandas(_merge, schema).select("row", "block", "twice")
    bits = np.zeros((DEPTH, cells >> 3), dtype=np.uint8)
    import zstandard

    for x in merged.collect():  # at most DEPTH * max_cells bits
        bits[x["row"], x["block"] * _BLOCK >> 3 : (x["block"] + 1) * _BLOCK >> 3] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(x["twice"])), dtype=np.uint8)
    sketch = spark.sparkContext.broadcast(bits)
    windows = rows.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), ROW, "text").mapInArrow(_candidates(sketch, cells, size, gram), f"h1 long, h2 long, doc long, {ROW} long, pos int")
    # a table, and only of windows that more than one document has: the second pass shuffles little else, and its join sees two
    # plain shuffles, of which adaptive execution splits a frequent window's
    several = windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("last > least")
    repeated = materialize(several.select("h1", "h2", "least"), "repeated")
    covered = prefilter(windows, "h1", repeated, repeated.count()).join(repeated, ["h1", "h2"]).where("doc > least").groupBy(ROW).agg(F.collect_list("pos").alias("at"))
    packed = rows.select("doc_id", ROW, "text").mapInArrow(_shrink, T.StructType([rows.schema["doc_id"], T.StructField(ROW, T.LongType()), T.StructField("packed", T.BinaryType())]))
    return (
        packed.join(covered, ROW, "left")
        .select("doc_id", "packed", "at")
        .mapInArrow(_apply(size), "doc_id long, n_words long, n_removed long, kept string")
    )
