"""Suffix-array dedup with a sparse suffix array.

Of each document only the suffixes at minimiser positions are kept: every run of `size`
words holds one `gram` of words that its content selects (the first of the smallest hashes), so two
equal runs keep the suffix at the same place.  Suffixes whose gram occurs in one document
alone can't match and are left out (by a bitmap of at most 2^26 bits, whatever the corpus; a full
bitmap keeps more, and loses none).  The rest, each as the codes of the words from there on and of the
words before it, are dealt by their gram and sorted: a part of the suffix array for each task.

In the sorted order neighbours are compared: the prefix that each shares with the one before
it bounds the runs of rows whose first r words are equal.  The words to the left of the suffixes are sorted
and compared in the same way.  Rows that agree in r words from the suffix on and in
`size` - r words before it hold one passage of `size` words, extended from the anchor to both sides; of each
such group all rows but those of the smallest id are copies.  That is done for every r in whole-array
operations, so all repeated passages are found, whatever the left contexts are.  A suffix between two of
smaller hashes is also asked for the windows next to its own: where both are copies its neighbours' spans hold its own.

Where a gram has more than `hot_rows` rows its rows are dealt over several parts (a table of 2^20
cells says into how many; a cell shared by two grams costs work alone).  Each part then passes on the rows of the smallest id in
each group, with a hash of the group's words, and the least id over all parts covers those
of the others.  So no key, however frequent, is one task's work, and nothing but the bitmap and
this table is broadcast.

The result: words inside a passage of `size` words or more that an earlier document (of smaller
id) holds too are removed.  Word codes have 32 bits of a hash: a passage that differs from another in one word
alone is taken for its copy with a probability of 2^-32.

Defined results: null text has no words; a null doc_id counts as larger than any other; rows
that repeat a doc_id are one document for the comparison of ids, but a span found in a row is
taken out of that row alone; texts of fewer than `size` words lose nothing; an empty table gives
an empty table; columns of other names, clashing ones too, stay as they are (`whole_rows`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import discard, materialize
from . import words as W
from .graph import ROW, flagged, keyed

_LAST = (1 << 63) - 1
_CELLS = 1 << 20
_FOUND = f"{ROW} long, pos int, stop int, node long, h1 long, h2 long"
_NAMES = [ROW, "pos", "stop", "node", "h1", "h2"]
_FLUSH = 1 << 14


def _anchors(w: W.Words, h: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimiser positions (the first of equal minima in a window), the hashes of their grams, and the first and last window each stands for."""
    g = W.grams(h, gram)
    ok = W.same_doc(w.doc, size)
    if not ok.any():
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 2)
    width = size - gram + 1
    start = np.flatnonzero(ok)
    windows = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.concatenate([windows[start[k : k + 8192]].argmin(axis=1) for k in range(0, len(start), 8192)]) + start
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))  # the places never fall
    return at[new], g[at[new]], start[new], start[np.append(new[1:], len(at)) - 1]


def _grams_of(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, texts in W.parts(batch, 1):
                w = W.Words(texts)
                at, g, _, _ = _anchors(w, w.hashes(), size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[a:b][w.doc[at]])], names=["g", "node"])

    return run


def _context(code: np.ndarray, w: W.Words, at: np.ndarray, length: int, step: int, need: np.ndarray) -> np.ndarray:
    """Codes of the `need` words from each place on (step 1) or back from the word before it (step -1); 0 beyond them."""
    ahead = np.arange(length)
    place = at[:, None] + (ahead if step > 0 else -1 - ahead)[None, :]
    return np.where(ahead[None, :] < need[:, None], code[np.clip(place, 0, len(code) - 1)], 0).astype(">u4")


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of an array as binary values of one length."""
    raw = np.ascontiguousarray(x)
    wide = raw.dtype.itemsize * raw.shape[1]
    ends = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * wide)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, ends.buffers()[1], pa.py_buffer(raw.tobytes())])


def _suffixes(known, size: int, gram: int):
    """Mapper: the suffixes that may match, with as many words on either side as their windows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, salts = known.value
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            ids, places = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b, texts in W.parts(batch, 1):
                w = W.Words(texts)
                h = w.hashes()
                at, g, low, high = _anchors(w, h, size, gram)
                slot = (g & mask).astype(np.int64)
                twice = ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1) > 0
                keep = np.flatnonzero(twice)
                code = (h >> np.uint64(32)).astype(np.uint32)
                code[code == 0] = 1
                # between two neighbours of smaller hashes, whose windows follow on both sides
                thin = np.zeros(len(at), dtype=bool)
                thin[1:-1] = (g[1:-1] > g[:-2]) & (g[1:-1] > g[2:]) & (low[1:-1] == high[:-2] + 1) & (high[1:-1] + 1 == low[2:])
                for k in range(0, len(keep), 8192):
                    own = keep[k : k + 8192]
                    left, right = at[own] - low[own], high[own] + size - at[own]
                    more = thin[own].astype(np.int64)
                    node, place = ids[a:b][w.doc[at[own]]], at[own] - w.first[w.doc[at[own]]]
                    codes, before = _context(code, w, at[own], size, 1, right + more), _context(code, w, at[own], size - gram, -1, left + more)
                    # a phrase that a text repeats on and on has one suffix again and again: a run of them is one row
                    again = np.zeros(len(own), dtype=bool)
                    again[1:] = (own[1:] == own[:-1] + 1) & (g[own[1:]] == g[own[:-1]]) & (node[1:] == node[:-1]) & (w.doc[at[own[1:]]] == w.doc[at[own[:-1]]])
                    again[1:] &= (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (codes[1:] == codes[:-1]).all(axis=1) & (before[1:] == before[:-1]).all(axis=1)
                    one = np.flatnonzero(~again)
                    run = at[own[np.append(one[1:], len(own)) - 1]] - at[own[one]]
                    own, node, place, left, right, codes, before = own[one], node[one], place[one], left[one], right[one], codes[one], before[one]
                    parts = salts[(g[own] >> np.uint64(40)).astype(np.int64) & (_CELLS - 1)].astype(np.uint64)
                    salt = W.mix(node.view(np.uint64) * np.uint64(31) + place.astype(np.uint64)) & ((np.uint64(1) << parts) - np.uint64(1))
                    salt = np.where(parts > 0, salt.astype(np.int64), -1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(g[own].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(node), pa.array(place.astype(np.int32)), pa.array(run.astype(np.int32)),
                            pa.array((size - right).astype(np.int16)), pa.array(left.astype(np.int16)), pa.array(thin[own]), _fixed(codes), _fixed(before), pa.array(places[a:b][w.doc[at[own]]]),
                        ],
                        names=["g", "salt", "node", "pos", "run", "low", "high", "thin", "codes", "before", ROW],
                    )

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading codes each pair of rows shares; the 0 beyond a suffix's end is never shared."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(0, len(a), 1 << 14):
        same = (a[k : k + (1 << 14)] == b[k : k + (1 << 14)]) & (a[k : k + (1 << 14)] != 0)
        out[k : k + (1 << 14)] = np.where(same.all(axis=1), a.shape[1], (~same).argmax(axis=1))
    return out


def _bytes(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    raw = b"".join(bytes(memoryview(c.buffers()[2]))[c.offset * wide : (c.offset + len(c)) * wide] for c in column.chunks if len(c))
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, wide)


def _copies(rows: pa.Table, size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Covered spans among sorted rows of whole parts, and the rows of the smallest ids that other parts of a hot gram may cover."""
    n = rows.num_rows
    g, salt, node, pos, more, low, high = (rows.column(c).to_numpy() for c in ("g", "salt", "node", "pos", "run", "low", "high"))
    raw_before = _bytes(rows.column("before"), 4 * (size - gram))
    codes, before = _bytes(rows.column("codes"), 4 * size).view(">u4").astype(np.uint32), raw_before.view(">u4").astype(np.uint32)
    place, thin = rows.column(ROW).to_numpy(), rows.column("thin").to_numpy(zero_copy_only=False)
    under = np.zeros(n, dtype=np.int8)  # 1: the window before the first is a copy too, 2: the one after the last
    lcp = np.zeros(n, dtype=np.int64)
    lcp[1:] = np.where((g[1:] == g[:-1]) & (salt[1:] == salt[:-1]), _common(codes[1:], codes[:-1]), 0)
    order = np.argsort(np.ascontiguousarray(raw_before).view(f"S{raw_before.shape[1]}").ravel(), kind="stable")
    lcp_left = np.zeros(n, dtype=np.int64)
    lcp_left[1:] = _common(before[order[1:]], before[order[:-1]])
    first, last = np.full(n, size, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    hot, sent = salt >= 0, []
    side = np.empty(n, dtype=np.int64)
    for left in range(size - gram + 1):
        at = np.flatnonzero((low - thin <= left) & (left <= high + thin))
        if not len(at):
            continue
        side[order] = np.cumsum(lcp_left < left)
        key = np.cumsum(lcp < size - left)[at] * (n + 1) + side[at]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.repeat(np.minimum.reduceat(node[at], starts), np.diff(np.append(starts, len(at))))
        found = at[node[at] > least]
        under[found[left > high[found]]] |= 1
        under[found[left < low[found]]] |= 2
        found = found[(low[found] <= left) & (left <= high[found])]
        last[found] = left
        first[found] = np.minimum(first[found], left)
        if hot.any():
            own = at[(node[at] == least) & hot[at] & (low[at] <= left) & (left <= high[at])]
            if len(own):
                sent.append((own, np.full(len(own), left)))
    # all windows of a suffix hold its first word, so together they are one span; the spans of both neighbours may hold it
    at = np.flatnonzero((last >= 0) & (under < 3))
    none = pa.nulls(len(at), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array((pos[at] - last[at]).astype(np.int32)), pa.array((pos[at] - first[at] + size + more[at]).astype(np.int32)), none, none, none], names=_NAMES)
    if not sent:
        return
    rng = np.random.default_rng(size)
    scale = rng.integers(0, 1 << 63, (2, 2 * size), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    for own, left in sent:
        k = int(left[0])
        words = np.concatenate((before[own, :k][:, ::-1], codes[own, : size - k]), axis=1).astype(np.uint64)
        h1, h2 = ((words * scale[i, :size][None, :]).sum(axis=1, dtype=np.uint64) for i in (0, 1))
        begin = (pos[own] - k).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place[own]), pa.array(begin), pa.array(begin + np.int32(size) + more[own]), pa.array(node[own]), pa.array(W.mix(h1).view(np.int64)), pa.array(W.mix(h2).view(np.int64))], names=_NAMES)


def _sorted_parts(size: int, gram: int):
    """Mapper over sorted rows: whole grams are gathered until they are many enough for array operations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if count >= _FLUSH:
                g, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                g0, salt0 = held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()
                other = np.flatnonzero((g != g0) | (salt != salt0))
                if len(other):
                    cut = int(other[0])
                    yield from _copies(pa.Table.from_batches([*held, batch.slice(0, cut)]), size, gram)
                    held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from _copies(pa.Table.from_batches(held), size, gram)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the covered words out of each text."""
    for batch in batches:
        for a, b, texts in W.parts(batch, 1):
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(texts, batch.column(2).slice(a, b - a), strict=True):
                own = text.split()
                n_words.append(len(own))
                if spans.is_valid and len(own):
                    delta = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(delta, spans.values.field(0).to_numpy(), 1)
                    np.subtract.at(delta, spans.values.field(1).to_numpy(), 1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(delta[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *(c.slice(a, b - a) for c in batch.columns[3:])],
                names=["doc_id", "n_words", "n_removed", "kept", *batch.schema.names[3:]],
            )


def _known(grams: DataFrame, hot_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of the grams that two documents or more have (at most 8 MB), and into how many parts, as a power of two, the rows of a cell of grams go (1 MB)."""
    found = grams.groupBy("g").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    twice = materialize(found.where("a < b").select("g", "n"), "repeated")
    bits = 1 << max(20, min(26, (16 * twice.count()).bit_length()))
    slot = twice.select((F.col("g").bitwiseAND(F.lit(bits - 1)) + 1).alias("slot"))  # bit k stands for value k + 1
    pages = slot.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits >> 3, dtype=np.uint8)
    for r in pages.collect():  # a page is 4 KB; pages count from 1
        k = (r["page"] - 1) * 4096
        out[k : k + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[: len(out) - k]
    salts = np.zeros(_CELLS, dtype=np.uint8)
    cell = F.shiftrightunsigned("g", 40).bitwiseAND(F.lit(_CELLS - 1))
    hot = twice.where(F.col("n") > hot_rows).groupBy(cell.alias("cell")).agg(F.max("n").alias("n"))
    for r in hot.collect():  # at most a row a cell
        salts[r["cell"]] = min(30, int(r["n"] // hot_rows).bit_length())
    discard(twice)
    return out, salts


def passages(rows: DataFrame, size: int = 50, gram: int = 16, hot_rows: int = 50_000) -> DataFrame:
    """rows: node (long, not null), text, _row.  Returns _row, pos, stop: word spans that an earlier document holds too."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(_known(rows.select("node", "text").mapInArrow(_grams_of(size, gram), "g long, node long"), hot_rows))
    suffixes = rows.select("node", "text", ROW).mapInArrow(_suffixes(known, size, gram), f"g long, salt int, node long, pos int, run int, low short, high short, thin boolean, codes binary, before binary, {ROW} long")
    ordered = suffixes.repartition("g", "salt").sortWithinPartitions("g", "salt", "codes")
    found = materialize(ordered.mapInArrow(_sorted_parts(size, gram), _FOUND), "spans")
    several = found.where("h1 IS NOT NULL")
    least = several.groupBy("h1", "h2").agg(F.min("node").alias("least"))
    across = several.join(least, ["h1", "h2"]).where("node > least").select(ROW, "pos", "stop")
    return found.where("h1 IS NULL").select(ROW, "pos", "stop").unionByName(across)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, gram: int = 16, whole_rows: bool = False, hot_rows: int = 50_000) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept (the words left, joined by one space), and with whole_rows the row of docs as `own`.

    Texts of rows that lose nothing aren't shuffled.
    """
    own = keyed(docs)
    doc_id, text = F.col("own").getField(id_col), F.coalesce(F.col("own").getField(text_col), F.lit(""))
    rows = own.select(ROW, F.coalesce(doc_id, F.lit(_LAST)).cast("long").alias("node"), text.alias("text"))
    spans = materialize(passages(rows, size, gram, hot_rows).groupBy(ROW).agg(F.collect_list(F.struct("pos", "stop")).alias("spans")), "spans")
    marked = flagged(own if whole_rows else own.select(ROW, F.struct(doc_id.alias(id_col), text.alias(text_col)).alias("own")), ROW, spans, spans.count())
    columns, out = [doc_id.cast("long").alias("doc_id"), text.alias("text"), F.col("spans")], T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string")
    if whole_rows:
        columns, out = [*columns, F.col("own")], out.add("own", own.schema["own"].dataType)
    some = marked.where("_maybe").join(spans.hint("merge"), ROW, "left").select(*columns)
    others = marked.where("NOT _maybe").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*columns)
    return some.unionByName(others).mapInArrow(_remove, out)
