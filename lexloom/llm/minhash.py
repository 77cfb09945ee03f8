"""MinHash near-dedup with an LSH forest.

Texts are sets of word shingles.  Documents with equal sets are one class, whatever its
size (equal word sequences by their digest, others confirmed on the full sets); classes go through the forest.  A signature has TREES * DEPTH minimum hashes; tree t
sorts all signatures by the hashes from t * DEPTH on.  Documents next to each other in a
sorted order, with a common prefix of DEPTH hashes or more, are candidates.  How deep
the order really compares adapts to the region: where few documents share a prefix all of
them are neighbours, where many do the neighbours are those with the longest common
prefixes.  Candidates are confirmed on the full shingle sets.

Links only matter between different components, so candidates are confirmed in rounds: the
nearest neighbours in some trees first, then all neighbours in all trees that are still
in different components.  Last, where more rows share DEPTH hashes than neighbours reach and
aren't all in one component, every pair of different components is looked at: such a region is cut into lanes of
set sizes and these into blocks of about BLOCK rows, and pairs of blocks whose sizes allow the similarity are dealt
over the cluster.  Signatures go first (a pair at the similarity has too few hashes in common with a probability of
1e-12); the full sets decide about rows that have a partner left.  At a similarity of 0.85 a pair shares DEPTH = 5 hashes in
none of 24 trees with a probability of 8e-7.

The orders are range-partitioned by key and id, so a prefix that many documents share
spreads over tasks; rows at the edges of partitions (a few for each) meet on the driver.

Defined results: an empty table gives an empty table; columns other than id and text aren't looked at, whatever their names; texts without
words have an empty set and are linked with nothing; texts of fewer words than a shingle are one shingle; a null doc_id counts as larger than any other
(its component_id is null where no other id is reached); rows that repeat a doc_id are one document with several texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize
from . import words as W
from .graph import components, prefilter

TREES, DEPTH, KEY = 24, 5, 12
FIRST_TREES, NEIGHBOURS = 4, 3
BLOCK, _COLUMNS = 256, 4096
_LAST = (1 << 63) - 1
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    w = W.Words(texts, lower=True)
    h = w.hashes()
    grams, first = W.grams(h, size), w.first
    out = []
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:  # the whole sequence
            out.append(W.mix(W.grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in W.parts(batch, 1):
                sets = shingle_sets(texts, size)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                flat = np.concatenate(sets)
                starts = (np.cumsum(n) - n)[full]
                one, two = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
                sig = np.zeros((len(n), TREES * DEPTH), dtype=np.uint16)
                if len(full):
                    one[full] = np.add.reduceat(W.mix(flat), starts)
                    two[full] = np.add.reduceat(W.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    low, buf = (flat >> np.uint64(32)).astype(np.uint32), np.empty(len(flat), dtype=np.uint32)
                    for k in range(TREES * DEPTH):
                        np.multiply(low, _MUL[k], out=buf)
                        np.add(buf, _ADD[k], out=buf)
                        sig[full, k] = (W.mix(np.minimum.reduceat(buf, starts).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
                words = pa.array([blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), words, pa.array([r.tobytes() for r in sig.astype(">u2")], pa.binary())],
                    names=["node", "n_shingles", "d1", "d2", "words", "sig"],
                )

    return run


def _forest(trees: list[int]):
    """Mapper: for each tree a row with the sort key, KEY hashes from the tree's place on (wrapping around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                twice = np.concatenate((sig, sig), axis=1)
                for t in trees:
                    keys = np.ascontiguousarray(twice[:, 2 * t * DEPTH : 2 * (t * DEPTH + KEY)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, t, dtype=np.int16)), pa.array([k.tobytes() for k in keys], pa.binary()), part.column(0), part.column(1)], names=["tree", "key", "node", "n"]
                    )

    return run


def _near(tree: np.ndarray, key: np.ndarray, node: np.ndarray, n: np.ndarray, step: int, share: float) -> np.ndarray:
    """Places i whose row and row i + step have DEPTH hashes in common and sizes that allow the similarity."""
    if len(tree) <= step:
        return np.zeros(0, dtype=np.int64)
    small, large = np.minimum(n[step:], n[:-step]), np.maximum(n[step:], n[:-step])
    ok = (tree[step:] == tree[:-step]) & (small >= share * large) & (node[step:] != node[:-step])
    return np.flatnonzero(ok & (key[step:, : 2 * DEPTH] == key[:-step, : 2 * DEPTH]).all(axis=1))


def _pairs(neighbours: int, share: float):
    """Mapper over sorted rows: candidate pairs, and the rows at the edges of the partition (b is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, edge_at = TaskContext.get().partitionId(), None, 0
        head: list = []

        def found(rows, fresh):
            tree, raw, node, n = rows
            key = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(tree), -1)
            a, b = [], []
            for step in range(1, neighbours + 1):
                at = _near(tree, key, node, n, step, share)
                at = at[at + step >= fresh]  # the others were found with the batch before
                a.append(node[at])
                b.append(node[at + step])
            return np.concatenate(a), np.concatenate(b)

        def edges(rows, side):
            tree, raw, node, n = rows
            k = len(tree)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(k, pa.int64()), pa.array(tree), pa.array(raw, pa.binary()), pa.array(n), pa.array(np.full(k, pid * 2 + side)), pa.array(np.arange(k))], names=names)

        names = ["a", "b", "tree", "key", "n", "edge", "at"]
        for batch in batches:
            rows = [batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()]
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                rows = [np.concatenate((h, r)) if isinstance(r, np.ndarray) else h + r for h, r in zip(held, rows, strict=True)]
            elif len(rows[0]):
                head = [x[:neighbours] for x in rows]
            a, b = found(rows, fresh)
            k = len(a)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(k, pa.int16()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
            held = [x[-neighbours:] for x in rows]
            edge_at += len(rows[0])
        if held is not None:
            yield edges(head, 0)
            yield edges(held, 1)

    return run


def _across(edges: list, neighbours: int, share: float) -> list[tuple[int, int]]:
    """Candidates whose rows lie in different partitions, from the edge rows of each."""
    parts: dict[int, dict[int, list]] = {}
    for e in sorted(edges, key=lambda e: (e["edge"], e["at"])):
        parts.setdefault(e["edge"] // 2, {}).setdefault(e["edge"] % 2, []).append(e)
    out, tail = [], []
    for pid in sorted(parts):
        head, end = parts[pid].get(0, []), parts[pid].get(1, [])
        rows = tail + head
        if tail and head:
            tree, node, n = (np.array([r[c] for r in rows]) for c in ("tree", "a", "n"))
            key = np.frombuffer(b"".join(bytes(r["key"]) for r in rows), dtype=np.uint8).reshape(len(rows), -1)
            for step in range(1, neighbours + 1):
                out += [(int(node[i]), int(node[i + step])) for i in _near(tree, key, node, n, step, share) if i < len(tail) <= i + step]
        short = len(head) < neighbours  # a short partition: rows before it stay neighbours of those after it
        tail = ((tail + end) if short else end)[-neighbours:]
    return out


def _candidates(reps: DataFrame, trees: list[int], neighbours: int, share: float) -> DataFrame:
    rows = reps.select("node", "n_shingles", "sig").mapInArrow(_forest(trees), "tree short, key binary, node long, n long")
    ordered = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = materialize(ordered.mapInArrow(_pairs(neighbours, share), "a long, b long, tree short, key binary, n long, edge long, at long"), "neighbours")
    across = _across(found.where("b IS NULL").collect(), neighbours, share)
    pairs = found.where("b IS NOT NULL").select("a", "b")
    if across:
        pairs = pairs.unionByName(reps.sparkSession.createDataFrame(across, "a long, b long"))
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    discard(found)
    return pairs


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, left in W.parts(batch, 2):
                right = W.encoded(batch.column(3).slice(x, y - x))
                for p, q in W.chunks(right):  # either side may have the long texts
                    sets = shingle_sets(left[p:q] + right[p:q], size)
                    for i in range(q - p):
                        a, b = sets[i], sets[q - p + i]
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if both and 100 * both >= percent * (len(a) + len(b) - both):
                            good.append(x + p + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The candidate pairs that are links; a table."""
    wanted = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    some = prefilter(texts, "node", wanted, wanted.count()).join(wanted, "node").dropDuplicates(["node", "text"])
    left = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(some.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    links = materialize(both.select("a", "b", "left", "right").mapInArrow(_confirm(size, percent), "u long, v long"), "links")
    discard(pairs, wanted)
    return links


def _regions(signed: bool):
    """Mapper: node, comp, n_shingles, sig; for each tree a row with a hash of the tree and its DEPTH hashes, with the signature where it is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sig = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=">u2").reshape(part.num_rows, TREES, DEPTH).astype(np.uint64)
                h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2])
                for k in range(DEPTH):
                    h = W.mix((h << np.uint64(16)) ^ h ^ (sig[:, :, k] + np.uint64(1)))
                rest, names = [part.column(1), *([part.column(0), part.column(2), part.column(3)] if signed else [])], ["comp", *(["node", "n_shingles", "sig"] if signed else [])]
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, t]).view(np.int64)), pa.array(np.full(part.num_rows, t, dtype=np.int16)), *rest], names=["region", "tree", *names])

    return run


def least_agreement(share: float, risk: float = 1e-12) -> int:
    """How many hashes of a signature two sets of that similarity have in common at least, but for this risk."""
    n, total, k = TREES * DEPTH, 0.0, 0
    while total + comb(n, k) * share**k * (1 - share) ** (n - k) <= risk:
        total += comb(n, k) * share**k * (1 - share) ** (n - k)
        k += 1
    return k


def _possible(percent: int):
    """Rows of a cell that have a partner: of another component, with a size and a signature that leave the similarity possible."""
    cut = least_agreement(percent / 100)

    def run(cell: pa.Table) -> pa.Table:
        comp, n = cell.column("comp").to_numpy(), cell.column("n_shingles").to_numpy()
        mine = cell.column("mine").to_numpy().astype(bool)
        left = np.flatnonzero(mine)
        right = left if mine.all() else np.flatnonzero(~mine)
        has = np.zeros(len(comp), dtype=bool)
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), dtype=np.uint16).reshape(len(comp), TREES * DEPTH)
        trees = cell.column("tree")[0].as_py() * DEPTH
        for a in range(0, len(left), 64):
            rows = left[a : a + 64]
            ok = comp[rows][:, None] != comp[right][None, :]
            ok &= 100 * np.minimum(n[rows][:, None], n[right]) >= percent * np.maximum(n[rows][:, None], n[right])
            if not ok.any():
                continue
            same = sig[rows][:, None, :] == sig[right][None, :, :]
            ok &= same.sum(axis=2) >= cut
            if trees:  # a pair that shares several regions is looked at in that of the first tree
                ok &= ~same[:, :, :trees].reshape(len(rows), len(right), -1, DEPTH).all(axis=3).any(axis=2)
            has[rows[ok.any(axis=1)]] = True
            has[right[ok.any(axis=0)]] = True
        return cell.select(["region", "at", "i", "j", "mine", "node", "comp"]).filter(pa.array(has))

    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each of the left sets has in common with each of the right ones."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = n > 1
    keep = several[at]
    row, col = row[keep], (np.cumsum(several) - 1)[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int(several.sum()), _COLUMNS):
        a, b = np.searchsorted(col, [start, start + _COLUMNS])
        has = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        has[row[a:b], col[a:b] - start] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _block(size: int, percent: int):
    """Links between the components of two blocks of a region, one for each pair of components, on the full sets."""

    def run(cell: pa.Table) -> pa.Table:
        comp, node = cell.column("comp").to_numpy(), cell.column("node").to_numpy()
        mine = cell.column("mine").to_numpy().astype(bool)
        left = np.flatnonzero(mine)
        right = left if mine.all() else np.flatnonzero(~mine)
        wanted = comp[left][:, None] != comp[right][None, :]
        if not wanted.any():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        texts, sets = W.encoded(cell.column("text").combine_chunks()), []
        for x, y in W.chunks(texts):
            sets += shingle_sets(texts[x:y], size)
        n = np.array([len(s) for s in sets])
        both = _shared(sets, left, right)
        i, j = np.nonzero(wanted & (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)))
        u, v = left[i], right[j]
        _, one = np.unique(np.sort(np.column_stack((comp[u], comp[v])), axis=1), axis=0, return_index=True)
        return pa.table({"u": pa.array(node[u[one]]), "v": pa.array(node[v[one]])})

    return run


def _cells(hot: DataFrame, lanes: DataFrame) -> DataFrame:
    """hot: region, lane, block and more.  A row for each cell (region, at, i, j, mine) that the row's block is part of.

    lanes: region, lane, others and tops (blocks).  A lane holds sets of about one size, so blocks meet those of their own lane
    and of the two beside it; two blocks of the component with most rows never meet.
    """
    side = lambda step, name: lanes.select("region", (F.col("lane") - step).alias("lane"), F.struct("others", "tops").alias(name))
    rows = hot.join(side(0, "own"), ["region", "lane"]).join(side(1, "up"), ["region", "lane"], "left").join(side(-1, "down"), ["region", "lane"], "left")
    upto = lambda first, end: F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))
    count = lambda c: F.coalesce(F.col(f"{c}.others") + F.col(f"{c}.tops"), F.lit(0))
    cell = lambda at, i, j, mine: F.struct(at.cast("int").alias("at"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(mine).alias("mine"))
    b, zero, top = F.col("block"), F.lit(0), F.col("block") >= F.col("own.others")
    limit = lambda c: F.when(top, F.coalesce(F.col(f"{c}.others"), zero)).otherwise(count(c))
    every = [
        F.transform(F.when(top, F.array().cast("array<int>")).otherwise(upto(b, count("own"))), lambda j: cell(2 * F.col("lane"), b, j, 1)),
        F.transform(upto(zero, F.least(b, F.col("own.others"))), lambda i: cell(2 * F.col("lane"), i, b, 0)),
        F.transform(upto(zero, limit("up")), lambda j: cell(2 * F.col("lane") + 1, b, j, 1)),
        F.transform(upto(zero, limit("down")), lambda i: cell(2 * F.col("lane") - 1, i, b, 0)),
    ]
    rest = [c for c in hot.columns if c not in ("lane", "block", "region")]
    return rows.select("region", *rest, F.explode(F.concat(*every)).alias("cell")).select("region", "cell.at", "cell.i", "cell.j", "cell.mine", *rest)


def _rest(reps: DataFrame, linked: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links of the regions that have more rows than neighbours reach, in several components; a table.

    The component with most rows of a region never meets itself: its rows go only to the blocks of the others.  Blocks are
    compared by size and signature first; texts follow only rows that have a partner left.
    """
    placed = reps.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "n_shingles", "sig")
    parts = placed.mapInArrow(_regions(False), "region long, tree short, comp long").groupBy("region", "comp").agg(F.count("*").alias("n"))
    tops = parts.groupBy("region").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("kinds"), F.sum("n").alias("m"))
    mixed = materialize(tops.where((F.col("kinds") > 1) & (F.col("m") > NEIGHBOURS + 1)).select("region", F.col("top.comp").alias("top")), "mixed")
    n = mixed.count()
    if not n:
        discard(mixed)
        return None
    lane = F.floor(F.log("n_shingles") / (math.log(100 / percent) * (1 + 1e-9))).cast("int")  # sizes that allow the similarity are a lane apart at most
    cells = placed.mapInArrow(_regions(True), "region long, tree short, comp long, node long, n_shingles long, sig binary")
    sized = prefilter(cells, "region", mixed, n).join(mixed, "region")
    hot = materialize(sized.select("region", "tree", "node", "comp", "n_shingles", "sig", lane.alias("lane"), (F.col("comp") == F.col("top")).alias("is_top")), "hot")
    discard(mixed)
    blocks = lambda c: F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int")
    lanes = materialize(hot.groupBy("region", "lane").agg(blocks(~F.col("is_top")).alias("others"), blocks(F.col("is_top")).alias("tops")), "lanes")
    at = F.xxhash64("node")
    block = F.when(F.col("is_top"), F.col("others") + F.pmod(at, F.col("tops"))).otherwise(F.pmod(at, F.col("others"))).cast("int")
    dealt = hot.join(lanes, ["region", "lane"]).select("region", "tree", "node", "comp", "n_shingles", "sig", "lane", block.alias("block"))
    key = ["region", "at", "i", "j"]
    some = _cells(dealt, lanes).groupBy(*key).applyInArrow(_possible(percent), "region long, at int, i int, j int, mine int, node long, comp long")
    some = materialize(some, "possible")
    discard(hot, lanes)
    if some.isEmpty():
        discard(some)
        return None
    wanted = materialize(some.select("node").distinct(), "wanted")
    found = prefilter(texts, "node", wanted, wanted.count()).join(wanted, "node").dropDuplicates(["node", "text"])
    links = materialize(some.join(found, "node").groupBy(*key).applyInArrow(_block(size, percent), "u long, v long"), "links")
    discard(some, wanted)
    if links.isEmpty():
        discard(links)
        return None
    return links


def _classes(sigs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """d1, d2, words, first, rep of all word sequences (first: its least node): those of equal sets have one rep, a table.

    Equal word sequences have equal sets.  Where sequences differ and the hashes of their sets don't, the full sets are compared.
    """
    variants = sigs.where("n_shingles > 0").groupBy("d1", "d2", "words").agg(F.min("node").alias("first"))
    variants = materialize(variants, "variants")
    heads = variants.groupBy("d1", "d2").agg(F.min("first").alias("rep"))
    both = materialize(variants.join(heads, ["d1", "d2"]), "classes")
    discard(variants)
    doubtful = both.where("first <> rep")
    if doubtful.isEmpty():
        return both.select("d1", "d2", "words", "first", "rep")
    equal = _confirmed(materialize(doubtful.select(F.col("first").alias("a"), F.col("rep").alias("b")), "doubtful"), texts, size, 100)
    told = both.join(equal.select(F.col("u").alias("first"), F.lit(True).alias("equal")), "first", "left")
    out = materialize(told.select("d1", "d2", "words", "first", F.when(F.col("equal"), F.col("rep")).otherwise(F.col("first")).alias("rep")), "classes")
    discard(both, equal)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reached), kept.
    With `row_col` (a number of its own for each row) every row is a document, whatever its doc_id,
    and one row of a component is kept; the column is returned too.
    """
    node = F.coalesce(F.col(id_col), F.lit(_LAST)) if row_col is None else F.col(row_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), node.cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts, share = rows.select("node", "text"), percent / 100
    sigs = materialize(texts.mapInArrow(_signatures(size), "node long, n_shingles long, d1 long, d2 long, words binary, sig binary"), "signatures")
    classes = _classes(sigs, texts, size)
    first = classes.where("first = rep").select(F.col("rep").alias("node"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    reps = materialize(sigs.join(first, "node").where("d1 = e1 AND d2 = e2").select("node", "n_shingles", "sig").dropDuplicates(["node", "n_shingles", "sig"]), "reps")
    links = _confirmed(_candidates(reps, list(range(FIRST_TREES)), 1, share), texts, size, percent)
    known = materialize(components(links), "known")
    discard(links)
    left = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    near = _candidates(reps, list(range(TREES)), NEIGHBOURS, share)
    more = near.join(left, "a", "left").join(right, "b", "left")
    more = more.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    apart = materialize(more, "apart")
    discard(near)
    again = _confirmed(apart, texts, size, percent)
    stars = known.select(F.col("node").alias("u"), F.col("component").alias("v"))
    linked = materialize(components(stars.unionByName(again)), "linked")
    discard(again, known)
    rest = _rest(reps, linked, texts, size, percent)
    discard(reps)
    found = linked
    if rest is not None:
        found = components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest))
        discard(linked, rest)
    whole, sigs = sigs, materialize(sigs.select("node", "n_shingles", "d1", "d2", "words"), "digests")
    discard(whole)
    placed = sigs.join(classes.drop("first"), ["d1", "d2", "words"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    out = placed.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reached = F.coalesce("component", "rep", "node")
    null_last = lambda c: F.nullif(c, F.lit(_LAST))
    if row_col is not None:
        placed = rows.select("node", "doc_id", F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("id")).join(out.select("node", "n_shingles", reached.alias("label")), "node")
        placed = materialize(placed, "placed")
        least = placed.groupBy("label").agg(F.min(F.struct("id", "node")).alias("least"))
        kept = F.col("node") == F.col("least.node")
        return placed.join(least, "label").select("doc_id", "n_shingles", null_last(F.col("least.id")).alias("component_id"), kept.alias("kept"), F.col("node").alias(row_col))
    return out.select(null_last(F.col("node")).alias("doc_id"), "n_shingles", null_last(reached).alias("component_id"), (F.col("node") == reached).alias("kept"))
