"""Filter audit, Merkle manifest and shards against plain versions, and on edges."""

import heapq
import random
import zlib
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm.audit import audit_steps, failure_masks, filter_audit, mask_counts, potentials, removed_by
from lexloom.llm.merkle import build_manifest, derived, height, missing, prove, table_leaves
from lexloom.llm.ranks import positions
from lexloom.llm.shards import longest_first, shard_documents
from lexloom.plans.scratch import materialize

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, digest string, tree string, pos int, size string"
CLASH = ("p", 1, "d", "t", 2, "s")


def docs_of(spark, rows):
    return materialize(spark.createDataFrame([(*r, *CLASH) for r in rows], DOCS), "given")


def edge_rows():
    talk = " ".join(f"w{i}" for i in range(300))
    rng = random.Random(4)
    rows = [(1, talk, "en", "a", 9), (1, talk, "en", "a", 9), (2, talk, None, "a", None), (3, None, "en", None, 0), (4, "", "", "", 0), (None, talk, "en", "b", 1), (None, None, None, None, None)]
    rows += [(5, "LOUD " * 250, "fr", "b", 1250), (6, "x " * 40_000, "fr", "b", 80_000), (7, talk + " 100%", "fr", "a", 1), (8, " \t\r\n ", "é", "a", 4)]
    rows += [(100 + i, rng.choice([talk, "few", "A$", talk + " Z"]), rng.choice(["en", "fr", "ü"]), rng.choice("ab"), i) for i in range(60)]
    return rows


# filter audit


def plain_audit(rows, good, toxic):
    """Applies every order to the documents, one by one."""
    words = lambda t: t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    at = lambda d: (d is None, d or 0)
    docs = []
    for d, text, _, source, _ in rows:
        t = text or ""
        ws = [w for w in words(t) if w]
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": any((o or "") == t and at(k) < at(d) for k, o, *_ in rows),
        }
        docs.append((source or "", {x for x in fails if fails[x]}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_audit_is_every_order_applied(spark):
    rows = edge_rows()
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 1), (6, 0, 1), (None, 1, 1), (105, 1, None), (110, None, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit(docs_of(spark, rows), labels).collect()
    want = plain_audit(rows, {1, 5, 105}, {5, 6, 110})
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found} == want
    assert len(found) == 3 * 600


def test_audit_of_nothing(spark):
    docs = docs_of(spark, edge_rows()).limit(0)
    assert filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_other_conditions(spark):
    """Two conditions and copies; orders of three filters."""
    docs = docs_of(spark, [(1, "aa", None, "s", 0), (2, "aa", None, "s", 0), (3, "b", None, "s", 0)])
    masks = failure_masks(docs, [lambda t: F.length(t) == 2, lambda t: t.contains("b")])
    assert sorted((r["doc_id"], r["mask"]) for r in masks.collect()) == [(1, 1), (2, 5), (3, 2)]
    steps = audit_steps(mask_counts(masks, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")), "xyz").where("filter_order = 'zxy'").orderBy("step")
    assert [list(r)[3:] for r in steps.collect()] == [[2, 1, 0, 0, 1, 0, 3], [1, 1, 1, 1, 0, 0, 9], [0, 1, 0, 1, 0, 0, 6]]
    with pytest.raises(ValueError):
        audit_steps(mask_counts(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "abcdefgh")


def test_potentials_give_shapley_values():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5):
        v = removed_by(rng.integers(0, 100, 1 << k))
        p, every = potentials(v), (1 << k) - 1
        for i in range(k):
            marginal = 0
            for order in permutations(range(k)):
                before = sum(1 << j for j in order[: order.index(i)])
                marginal += v[before | 1 << i] - v[before]
            assert p[every] - k * p[every & ~(1 << i)] == marginal


# Merkle manifest


def plain_h(*xs):
    return sha256("".join(xs).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([plain_h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        path.append((run[:at % 2], run[at % 2 + 1 :]))
        at //= 2
    return path


def plain_manifest(rows):
    leaf = lambda r: plain_h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])])
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    levels = {x: plain_tree([leaf(r) for r in trees[x]]) for x in langs}
    top = plain_tree([levels[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            path = plain_path(levels[x], i) + plain_path(top, k)
            said = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            at = leaf((*r[:4], r[4] + 1)) if said else leaf(r)
            for a, b in path:
                at = plain_h(*a, at, *b)
            out.append((str(r[0]), leaf(r), levels[x][-1][0], top[-1][0], "".join(h for a, b in path for h in a + b), at))
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 2, 9])
def test_manifest_is_the_plain_tree(spark, bits):
    """Few leaves a partition, so that proofs cross partitions and the nodes take several passes."""
    rows = edge_rows()
    forged = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    leaves = table_leaves(docs_of(spark, rows), FIELDS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, forged)
    found = prove(build_manifest(leaves, bits)).collect()
    assert sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"]) for r in found) == plain_manifest(rows)
    assert any(r["folded_root"] != r["root"] for r in found)


def test_manifests_of_one_row_and_of_none(spark):
    rows = [(5, "x", "en", "s", 1)]
    docs = docs_of(spark, rows)
    (one,) = prove(build_manifest(table_leaves(docs, FIELDS, "lang", "doc_id"))).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == ""
    assert prove(build_manifest(table_leaves(docs.limit(0), FIELDS, "lang", "doc_id"))).count() == 0


def test_missing_nodes_are_the_least():
    """What a run of leaves fetches is needed, and is enough for the root and all proofs."""
    for n in range(1, 20):
        levels = plain_tree([plain_h(str(i)) for i in range(n)])
        assert len(levels) - 1 == height(n)
        for first in range(n):
            for last in range(first, n):
                wanted = missing(first, last, n)
                held = {(k, i >> k) for k in range(height(n)) for i in range(first, last + 1)}
                lack = {(k, i ^ 1) for k, i in held if (i ^ 1) < len(levels[k])} - held
                assert set(wanted) == lack and len(wanted) == len(lack)
                rows, root = derived(first, levels[0][first : last + 1], n, {(k, i): levels[k][i] for k, i in wanted})
                assert root == levels[-1][0]
                for k, (begin, nodes) in enumerate(rows):
                    assert nodes == levels[k][begin : begin + len(nodes)]


# ranks and shards


def test_positions_of_hot_groups_and_equal_rows(spark):
    rows = [("hot", None if i % 5 == 0 else i % 7) for i in range(400)] + [("b", 3), ("c", None)]
    found = positions(materialize(spark.createDataFrame(rows, "g string, x int").repartition(5), "rows"), "g", ["x"]).collect()
    for g in ("hot", "b", "c"):
        mine = sorted((r["pos"], (r["x"] is not None, r["x"] or 0)) for r in found if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [x for _, x in mine] == sorted(x for _, x in mine)


def plain_schedule(sizes, shards):
    heap, out = [(0, s) for s in range(shards)], []
    for size, count in sizes:
        taken = []
        for _ in range(count):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            taken.append(s)
        taken.sort()
        out += [(size, s) for s in taken]
    return out


def test_runs_of_equal_groups_are_dealt_as_one_by_one():
    rng = random.Random(5)
    for _ in range(200):
        shards = rng.randint(1, 9)
        sizes = sorted({rng.randint(1, 60): rng.choice([1, 2, rng.randint(1, 300)]) for _ in range(rng.randint(1, 8))}.items(), reverse=True)
        got = [(size, s) for size, low, high, s in longest_first(sizes, shards) for _ in range(low, high)]
        assert got == plain_schedule(sizes, shards)


def test_shards_keep_groups_and_balance_bytes(spark):
    rng = random.Random(6)
    rows = edge_rows() + [(1000 + i, "z" * rng.choice([7, 7, 7, rng.randint(1, 400)]) + str(rng.randint(0, 300)), "en", "s", 0) for i in range(700)]
    found = shard_documents(docs_of(spark, rows), 8).collect()
    text = {}
    for d, t, *_ in rows:
        text.setdefault(str(d), []).append(t or "")
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    for s in range(8):
        mine = sorted((r["slot"], (r["doc_id"] is not None, r["doc_id"] or 0)) for r in found if r["shard"] == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)
    groups = {}
    for _, t, *_ in rows:
        groups.setdefault(sha256((t or "").encode()).digest(), []).append(len((t or "").encode()) + 1)
    by_crc = {}
    for r in found:
        by_crc.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_crc.values())
    totals = [(sum(v), d) for d, v in groups.items()]
    sizes = sorted({t: sum(x == t for x, _ in totals) for t, _ in totals}.items(), reverse=True)
    places = {}
    for size, s in plain_schedule(sizes, 8):
        places.setdefault(size, []).append(s)
    want = {d: places[t][sorted(x for y, x in totals if y == t).index(d)] for t, d in totals}
    assert {(str(r["doc_id"]), r["size"]): r["shard"] for r in found if r["doc_id"] is not None} == {(str(d), len((t or "").encode()) + 1): want[sha256((t or "").encode()).digest()] for d, t, *_ in rows if d is not None}


def test_shards_of_nothing(spark):
    assert shard_documents(docs_of(spark, edge_rows()).limit(0)).count() == 0
