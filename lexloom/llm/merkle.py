"""A Merkle manifest of a table: one root for all rows, a proof for each, and the check of rows against it.

Rows are leaves of one tree a group (a language), in order of their id; the trees' roots are leaves of a last tree.
In every tree a node is the hash of the runs of two consecutive nodes below it (the last run may be one node).

A leaf partition is a run of 2^bits consecutive leaves of a tree.  Its own tree is derived from its leaves; the trees
above are built 2^bits nodes at a time, in passes that are each 2^bits times smaller than the one before.  Proofs follow the octopus multiproof: a partition computes the
coordinates (level, index) of the nodes that all its leaves together lack and can't derive, fetches these
in one join, derives the interiors that the leaves share, and expands a proof for each leaf on the spot.

Defined results: a null field is hashed as `-`; a null id comes first in its group, rows of one id follow each other by
leaf hash; a group that is null is the first, the others go by bytes; repeated rows are leaves of their own; a claimed leaf
that is null is as the original; columns that aren't named may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .graph import field
from .ranks import positions

#: The last tree, whose leaves are the groups' roots; keys of groups are empty (null) or begin with a plus.
_TOP = "="
_NODES = "tree string, level int, idx long, hash string"


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 (hex) of the columns in a form that tells them apart: each `-` if null, else number of bytes, colon, value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def node(children: list[str]) -> str:
    """The hash (hex) of a run of nodes."""
    return sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels above a run of nodes that begins at an even place on each of them."""
    out = []
    for _ in range(levels):
        nodes = [node(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def missing(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """(level, index) of all nodes that the leaves first..last of a tree of n leaves lack for their proofs and can't derive."""
    out = []
    for level in range(height(n)):
        if first & 1:
            out.append((level, first - 1))
        if not last & 1 and last < (n - 1) >> level:
            out.append((level, last + 1))
        first, last = first >> 1, last >> 1
    return out


def derived(first: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[tuple[int, list[str]]], str]:
    """(index of the first node, nodes) of each level over a run of leaves, fetched ones included, and the root."""
    rows, nodes = [], leaves
    for level in range(height(n)):
        left, right = fetched.get((level, first - 1)), fetched.get((level, first + len(nodes)))
        if first & 1:
            first, nodes = first - 1, [left, *nodes]
        if right is not None:
            nodes = [*nodes, right]
        rows.append((first, nodes))
        first, nodes = first >> 1, grown(nodes, 1)[0]
    return rows, nodes[0]


def siblings(at: int, rows: list[tuple[int, list[str]]], level: int = 0) -> list[str | None]:
    """The sibling of a leaf's ancestor on each level from `level` on; None where the run has no other."""
    out = []
    for k in range(level, len(rows)):
        first, nodes = rows[k]
        place = (at >> k ^ 1) - first
        out.append(nodes[place] if 0 <= place < len(nodes) else None)
    return out


def folded(leaf: str, at: int, path: list[str | None]) -> str:
    """The root that a leaf and its siblings lead to; `at` is its index on the path's first level."""
    for other in path:
        leaf = node([leaf] if other is None else [other, leaf] if at & 1 else [leaf, other])
        at >>= 1
    return leaf


@dataclass(frozen=True)
class Manifest:
    """partitions: tree, block, n, leaves (array of pos, id, leaf, claimed); nodes: all that partitions fetch; groups: tree, subroot, place, trees, root."""

    partitions: DataFrame
    nodes: DataFrame
    groups: DataFrame
    bits: int


def _raised(rows: DataFrame, bits: int, last_only: bool = False) -> DataFrame:
    """rows: tree, n, level, block, hashes (of up to 2^bits nodes of that level).  The nodes above them, or the last level of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            out: list[tuple] = []
            for tree, n, level, block, hashes in zip(*columns, strict=True):
                above = grown(hashes, min(bits, height(n) - level))
                for k, nodes in enumerate(above, 1):
                    if k == len(above) or not last_only:
                        begin = (block << bits) >> k
                        out += [(tree, level + k, begin + i, h) for i, h in enumerate(nodes)]
            if out:
                tree, level, idx, h = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(h)], names=["tree", "level", "idx", "hash"])

    return rows.select("tree", "n", "level", "block", "hashes").mapInArrow(run, _NODES)


def _nodes(level_rows: DataFrame, level: int, tallest: int, bits: int) -> list[DataFrame]:
    """level_rows: tree, n, idx, hash of all nodes of one level.  Tables of the nodes above, up to each tree's root."""
    out = []
    while level < tallest:
        runs = level_rows.where(F.col("n") > F.lit(1 << level)).groupBy("tree", "n", F.shiftright("idx", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("all"))
        table = materialize(_raised(runs.select("tree", "n", F.lit(level).alias("level"), "block", F.col("all.hash").alias("hashes")), bits), "nodes")
        out.append(table)
        level += bits
        level_rows = table.where(F.col("level") == level).join(level_rows.select("tree", "n").distinct(), "tree").select("tree", "n", "idx", "hash")
    return out


def build_manifest(leaves: DataFrame, bits: int = 9) -> Manifest:
    """leaves: tree (string), id, leaf and claimed (hex; null: as leaf).  Read three times: pass a table."""
    sizes = materialize(leaves.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    placed = positions(leaves, "tree", ["id", "leaf"])
    entry = F.struct("pos", "id", F.unhex("leaf").alias("leaf"), F.unhex("claimed").alias("claimed"))
    runs = placed.groupBy("tree", F.shiftright("pos", bits).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("leaves"))  # at most 2^bits entries
    partitions = materialize(runs.join(sizes, "tree"), "partitions")
    tallest = height(sizes.agg(F.max("n")).first()[0] or 1)

    # a partition's own tree stays inside it, but for its root
    bottom = partitions.select("tree", "n", F.lit(0).alias("level"), "block", F.transform("leaves.leaf", lambda x: F.lower(F.hex(x))).alias("hashes"))
    roots = _raised(bottom.where("n > 1"), bits, last_only=True).join(sizes, "tree")
    lone = partitions.where("n = 1").select("tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), F.lower(F.hex(F.col("leaves.leaf")[0])).alias("hash"), "n")
    first = materialize(roots.select("tree", "level", "idx", "hash", "n").unionByName(lone), "roots")
    tables = [first.drop("n"), *_nodes(first.where(F.col("level") == bits).select("tree", "n", "idx", "hash"), bits, tallest, bits)]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    # of each tree the root is the one node on the highest level
    tops = every.where("idx = 0").groupBy("tree").agg(F.max(F.struct("level", "hash")).alias("t")).select("tree", F.col("t.hash").alias("hash"), F.lit(_TOP).alias("top"))
    subroots = materialize(tops, "subroots")
    m = subroots.count()
    order = materialize(positions(subroots, "top", ["tree"], "idx").select(F.lit(_TOP).alias("tree"), F.lit(m).cast("long").alias("n"), "idx", "hash", F.col("tree").alias("of")), "order")
    last = [order.select("tree", F.lit(0).alias("level"), "idx", "hash"), *_nodes(order.select("tree", "n", "idx", "hash"), 0, height(max(m, 1)), bits)]
    for t in last:
        every = every.unionByName(t)
    root = last[-1].orderBy(F.desc("level"), "idx").first()
    groups = order.select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), F.col("idx").alias("place"), F.lit(m).cast("long").alias("trees"), F.lit(root["hash"] if root else None).cast("string").alias("root"))
    return Manifest(partitions, every, groups, bits)


def _coordinates(runs: DataFrame) -> DataFrame:
    """runs: tree, block, n, first, last, place, trees.  The nodes that each of them lacks: tree, block, of, level, idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, block, n, first, last, place, trees in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                out += [(tree, block, tree, level, idx) for level, idx in missing(first, last, n)]
                out += [(tree, block, _TOP, level, idx) for level, idx in missing(place, place, trees)]
            if out:
                tree, block, of, level, idx = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(block, pa.int64()), pa.array(of), pa.array(level, pa.int32()), pa.array(idx, pa.int64())], names=["tree", "block", "of", "level", "idx"])

    return runs.select("tree", "block", "n", "first", "last", "place", "trees").mapInArrow(run, "tree string, block long, of string, level int, idx long")


def prove(manifest: Manifest) -> DataFrame:
    """id, leaf, subroot, root, proof (the siblings from the leaf to the root, hex, joined), folded_root (from the claimed leaf and the proof)."""
    bits = manifest.bits
    groups = manifest.groups
    runs = manifest.partitions.select("tree", "block", "n", F.shiftleft("block", bits).alias("first"), F.least(F.col("n") - 1, F.shiftleft(F.col("block") + 1, bits) - 1).alias("last"))
    wanted = materialize(_coordinates(runs.join(groups.select("tree", "place", "trees"), "tree")), "wanted")
    nodes = manifest.nodes.withColumnRenamed("tree", "of")
    found = wanted.join(nodes, ["of", "level", "idx"]).groupBy("tree", "block").agg(F.collect_list(F.struct("of", "level", "idx", "hash")).alias("fetched"))  # two a level
    rows = manifest.partitions.join(materialize(found, "fetched"), ["tree", "block"], "left").join(groups, "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tree, block, n, leaves, fetched, subroot, place, trees, root = (c[k] for c in batch.columns)
                n, first, entries = n.as_py(), block.as_py() << bits, leaves.values
                own, top = {}, {}
                for x in fetched.as_py() or ():
                    (top if x["of"] == _TOP else own)[x["level"], x["idx"]] = x["hash"]
                hashes = [x.hex() for x in entries.field("leaf").to_pylist()]
                rows, derived_root = derived(first, hashes, n, own)
                if derived_root != subroot.as_py():
                    raise ValueError("the leaves of a partition don't lead to their tree's root")
                place = place.as_py()
                low = min(bits, len(rows))
                above = siblings(first, rows, low) + siblings(place, derived(place, [derived_root], trees.as_py(), top)[0])
                shared = "".join(h for h in above if h)
                block_at, tree_levels = first >> low, len(rows) - low
                known: dict[str, str] = {}  # of a partition's root: where the path from there leads
                proofs, ends = [], []
                for i, (h, said) in enumerate(zip(hashes, entries.field("claimed").to_pylist(), strict=True)):
                    path = siblings(first + i, rows[:low])
                    at = folded(h if said is None else said.hex(), first + i, path)
                    if at not in known:
                        known[at] = folded(folded(at, block_at, above[:tree_levels]), place, above[tree_levels:])
                    proofs.append("".join(h for h in path if h) + shared)
                    ends.append(known[at])
                same = lambda x: pa.array([x.as_py()] * len(hashes), pa.string())
                yield pa.RecordBatch.from_arrays([entries.field("id"), pa.array(hashes), same(subroot), same(root), pa.array(proofs), pa.array(ends)], names=["id", "leaf", "subroot", "root", "proof", "folded_root"])

    kind = manifest.partitions.schema["leaves"].dataType.elementType["id"].dataType.simpleString()
    columns = ["tree", "block", "n", "leaves", "fetched", "subroot", "place", "trees", "root"]
    return rows.select(columns).mapInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof string, folded_root string")


def table_leaves(docs: DataFrame, fields: list[str], group_col: str, id_col: str, claimed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Leaves of the rows of docs.  `claimed`: fields as someone else states them, in rows where `when` holds."""
    own = [field(c) for c in fields]
    said = F.when(F.coalesce(F.lit(False) if when is None else when, F.lit(False)), leaf_hash([(claimed or {}).get(c, field(c)) for c in fields]))
    key = F.coalesce(F.concat(F.lit("+"), field(group_col)), F.lit(""))
    return materialize(docs.select(key.alias("tree"), field(id_col).alias("id"), leaf_hash(own).alias("leaf"), said.alias("claimed")), "leaves")
