"""How filters on documents interact: every order of applying them, and Shapley values.

A document fails a set of filters, its mask.  For a part of the table (a source) all that any
order of filters does follows from how many documents have each mask: a coalition S of filters removes
v(S) = the documents whose mask meets S, and a filter that is applied after the set S removes
v(S + filter) - v(S).  So the table is reduced to at most 2^k counts a part before anything else, and hot
parts are summed before they are shuffled.

Shapley values come from the potential of Hart and Mas-Colell: P(empty) = 0 and
|S| P(S) = v(S) + sum of P(S - i) over i in S; the value of filter i is P(all) - P(all - i).  It is kept
times |S|!, so that everything is an integer: what is returned is the sum over all orders.

Defined results: null text is empty; a null part is the empty string; a null doc_id counts as larger than any
other and has no label; rows that repeat a doc_id are documents of their own, and copies of one
smallest doc_id all stay; a doc_id that has several labels is good (toxic) if one of them says so; texts are
compared by the first 128 bits of their SHA-256; only the named columns are looked at, so others may
have any names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .graph import field

_LAST = (1 << 63) - 1
_WHITE = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_STEPS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _WHITE), lambda w: w != "")


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(words(text)) < least


def repetitive(text: Column, percent: int = 50) -> Column:
    """Fewer distinct words than this share of all words."""
    return F.transform(F.array(words(text)), lambda w: 100 * F.size(F.array_distinct(w)) < percent * F.size(w))[0]


def shouting(text: Column, percent: int = 2) -> Column:
    """More capitals A-Z than this share of all characters."""
    return 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > percent * F.length(text)


def marks(text: Column, any_of: str = "#$%&*|") -> Column:
    return text.rlike("[" + "".join(f"\\x{ord(c):02x}" for c in any_of) + "]")


#: Failure conditions, the first four of the usual five; the fifth is being a copy of an earlier document.
CONDITIONS: tuple[Callable[[Column], Column], ...] = (few_words, repetitive, shouting, marks)


def failure_masks(docs: DataFrame, conditions: Sequence[Callable[[Column], Column]] = CONDITIONS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask: bit i is set where condition i holds, and the bit after the last where a smaller doc_id has the same text.

    The texts are read once.  Of each text only the smallest doc_id is looked for, and rows meet it by text and
    doc_id together, so that a text with very many copies is no hot key.
    """
    text = F.coalesce(field(text_col), F.lit(""))
    given = docs.select(field(id_col).cast("long").alias("doc_id"), F.coalesce(field(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(c(F.col("text")), F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    digest = F.substring(F.unhex(F.sha2("text", 256)), F.lit(1), F.lit(16))
    rows = materialize(given.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("order_id"), "part", mask.cast("int").alias("own"), digest.alias("digest")), "audit")
    first = rows.groupBy("digest").agg(F.min("order_id").alias("order_id")).withColumn("first", F.lit(0))
    copy = F.coalesce("first", F.lit(1 << len(conditions)))
    return rows.join(first, ["digest", "order_id"], "left").select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: documents, and those labelled quality 1 or toxic 1."""
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(f"_{c}")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(yes("quality"), yes("toxic"))
    rows = masks.join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.coalesce(F.sum("_quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))


def removed_by(counts: np.ndarray) -> np.ndarray:
    """counts: (..., mask).  How many each coalition removes: (..., coalition)."""
    sets = np.arange(counts.shape[-1])
    return counts @ ((sets[:, None] & sets[None, :]) != 0).astype(np.int64)


def potentials(v: np.ndarray) -> np.ndarray:
    """v: (..., coalition) of a game.  Potential of each coalition times the factorial of its size."""
    out = np.zeros_like(v)
    for s in range(1, v.shape[-1]):  # every subset of s comes before s
        members = [i for i in range(s.bit_length()) if s >> i & 1]
        out[..., s] = factorial(len(members) - 1) * v[..., s] + sum(out[..., s & ~(1 << i)] for i in members)
    return out


def audit_steps(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """counts: part, mask, docs, good, toxic; filter i (bit i of the mask) is called names[i].

    Returns a row for each part, order of the filters, and step: kept (after it), removed (by it), redundant (fail its filter, gone
    before), unique_fails (fail only its filter), good_lost and toxic_lost (removed by it), shapley (removed
    by its filter, summed over all orders).
    """
    k = len(names)
    if k > 7:
        raise ValueError(f"{k} filters have {factorial(k)} orders")
    orders = np.array(list(permutations(range(k))))
    after = np.cumsum(1 << orders, axis=1)
    before, every = after - (1 << orders), (1 << k) - 1
    label = pa.array(["".join(names[i] for i in o) for o in orders for _ in range(k)])
    step = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = np.zeros((3, 1 << k), dtype=np.int64)
                for m in masks:
                    table[:, m["mask"]] += (m["docs"], m["good"], m["toxic"])
                v = removed_by(table)
                p = potentials(v[0])
                removed = v[:, after] - v[:, before]
                columns = {
                    "kept": table[0].sum() - v[0, after], "removed": removed[0], "redundant": v[0, 1 << orders] - removed[0], "unique_fails": v[0, every] - v[0, every & ~(1 << orders)],
                    "good_lost": removed[1], "toxic_lost": removed[2], "shapley": p[every] - k * p[every & ~(1 << orders)],
                }
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(label)), label, step, *[pa.array(columns[c].ravel()) for c in _COUNTS]], names=["part", "filter_order", "step", *_COUNTS])

    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks")).mapInArrow(run, _STEPS)  # at most 2^k entries a part


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: Sequence[Callable[[Column], Column]] = CONDITIONS, names: str = "ABCDE", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The steps of every order of the conditions and the copy filter, for each part of docs."""
    return audit_steps(mask_counts(failure_masks(docs, conditions, id_col, text_col, part_col), labels), names)
