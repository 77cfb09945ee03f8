"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs (its lines that aren't empty).  Every paragraph hashes to a vector: WIDE lanes of 32 bits, and
LANES lanes that count the set bits of its pieces' hashes, a piece ending at a blank that follows certain characters, so
that where it ends depends on its content alone.  A fingerprint is the sum of these vectors, lane by
lane, modulo 2^32, with the numbers of pieces and paragraphs.  Sums commute: equal multisets have equal
fingerprints in any order, and a paragraph is inserted or deleted by adding or subtracting
its vector.  The wide lanes tell multisets apart (512 bits); the others say how alike they are: as such a lane counts set bits, twice the
lane less the number of pieces is a sum of signs, and the inner product of two such vectors estimates how many pieces two
texts share; likeness is its cosine, cut to 0..1.

Within a long an addition serves three lanes at once (21 bits each); pieces are
summed in groups of at most 2^20 before lanes can overflow into each other.  All of it is
DataFrame functions: no Python touches a row.

Defined results: columns other than id and text aren't looked at, whatever their names; an empty table gives an empty table; null text is empty and has the zero fingerprint; two empty texts have
likeness 1, an empty and another 0; the next document is the next larger doc_id (nulls last), after the last the
first; rows that repeat a doc_id follow each other by text; a table of one row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SEEDS = (11, 29)
_SHIFTS = 21
LANES = len(_SEEDS) * _SHIFTS * 3
#: Each hash of a paragraph gives two wide lanes.
_WIDE_SEEDS = (101, 211, 307, 401, 503, 601, 701, 809)
WIDE = 2 * len(_WIDE_SEEDS)
_ONES = 1 | 1 << 21 | 1 << 42
_CUT = r"(?<=[.,;:!?aeosnd])[\x20\x09\x0B-\x0D]+"
_GROUP_BITS = 20
_LAST = (1 << 63) - 1


def paragraphs(text: Column) -> Column:
    """The multiset of paragraphs of a text, as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda p: p != "")


def pieces(text: Column) -> Column:
    """The multiset of pieces of a text's paragraphs, as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n+|" + _CUT), lambda p: p != "")


def _sums() -> list[Column]:
    """Partial fingerprints: three lanes in each long."""
    return [F.coalesce(F.sum(F.shiftright(f"_h{s}", i).bitwiseAND(F.lit(_ONES))), F.lit(0)).alias(f"s{s}_{i}") for s in range(len(_SEEDS)) for i in range(_SHIFTS)]


def _wide_sums() -> list[Column]:
    """Wide lanes of the paragraphs, before the modulus; a group has at most 2^20 of them, so no sum overflows."""
    out = []
    for k in range(len(_WIDE_SEEDS)):
        out += [F.coalesce(F.sum(half), F.lit(0)).alias(f"w{k}_{i}") for i, half in enumerate((F.col(f"_w{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_w{k}", 32)))]
    return out


def _lanes() -> Column:
    """The lanes of packed sums, as an array of long."""
    packed = [F.col(f"s{s}_{i}") for s in range(len(_SEEDS)) for i in range(_SHIFTS)]
    return F.array(*[F.shiftright(p, 21 * k).bitwiseAND(F.lit((1 << 21) - 1)) for p in packed for k in range(3)])


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and `lanes`: LANES sums, the number of pieces, WIDE sums modulo 2^32, the number of paragraphs, as an array of long.

    One row for each distinct combination of keys; texts without paragraphs have zeros.
    """
    of = lambda array, whole: F.transform(array, lambda p: F.struct(p.alias("p"), F.lit(whole).alias("whole")))
    rows = texts.select(*keys, F.posexplode_outer(F.concat(of(paragraphs(F.col(text_col)), True), of(pieces(F.col(text_col)), False))).alias("_at", "_x"))
    whole, part_of = F.coalesce(F.col("_x.whole"), F.lit(False)), F.coalesce(~F.col("_x.whole"), F.lit(False))
    hashes = [F.when(part_of, F.xxhash64(F.lit(s), F.col("_x.p"))).alias(f"_h{i}") for i, s in enumerate(_SEEDS)] + [F.when(whole, F.xxhash64(F.lit(s), F.col("_x.p"))).alias(f"_w{i}") for i, s in enumerate(_WIDE_SEEDS)]
    hashed = rows.select(*keys, F.coalesce(F.shiftright("_at", _GROUP_BITS), F.lit(0)).alias("_group"), part_of.alias("_piece"), whole.alias("_whole"), *hashes)
    packed = hashed.groupBy(*keys, "_group").agg(*_sums(), F.sum(F.col("_piece").cast("long")).alias("_n"), *_wide_sums(), F.sum(F.col("_whole").cast("long")).alias("_m"))
    wide = [F.pmod(F.col(f"w{k}_{i}"), F.lit(1 << 32)) for k in range(len(_WIDE_SEEDS)) for i in range(2)]
    part = packed.select(*keys, F.concat(_lanes(), F.array("_n"), F.array(*wide, F.col("_m"))).alias("_part"))
    # texts of more than 2^20 pieces have several parts, all others one
    parts = part.groupBy(*keys).agg(F.collect_list("_part").alias("_parts"))
    zero = F.array_repeat(F.lit(0).cast("long"), LANES + WIDE + 2)
    return parts.select(*keys, F.when(F.size("_parts") == 1, F.element_at("_parts", 1)).otherwise(F.aggregate("_parts", zero, add)).alias("lanes"))


def wrapped(lanes: Column) -> Column:
    """Lanes modulo 2^32; the counts stay."""
    return F.transform(lanes, lambda v, k: F.when((k != LANES) & (k != LANES + WIDE + 1), F.pmod(v, F.lit(1 << 32))).otherwise(v))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets (insertion)."""
    return wrapped(F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a without b (deletion)."""
    return wrapped(F.zip_with(a, b, lambda x, y: x - y))


def as_text(lanes: Column) -> Column:
    """A fingerprint as a string: the wide lanes, the others (eight hex digits each), the numbers of paragraphs and pieces."""
    hexed = lambda start, n: F.array_join(F.transform(F.slice(lanes, start, n), lambda v: F.lpad(F.hex(v), 8, "0")), "")
    count = lambda at: F.element_at(lanes, at).cast("string")
    return F.lower(F.concat_ws(":", hexed(LANES + 2, WIDE), hexed(1, LANES), count(LANES + WIDE + 2), count(LANES + 1)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two multisets from their fingerprints, 0 to 1; exact for equal ones."""
    n_a, n_b = F.element_at(a, LANES + 1), F.element_at(b, LANES + 1)
    signs = lambda v, n: F.transform(F.slice(v, 1, LANES), lambda x: (2 * x - n).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = signs(a, n_a), signs(b, n_b)
    cosine = dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, F.lit(1.0)).when((n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def _bucket(order: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most `order`; two short scans instead of one long one."""
    if not bounds:
        return F.lit(0)
    m = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    coarse = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda b: b <= order))
    fine = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * m + F.size(F.filter(fine, lambda b: b <= order)))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20, max_buckets: int = 10_000) -> DataFrame:
    """Fingerprints of documents and of edited texts, and how alike they are.

    The edited text replaces the last half of the code points by the start of the next
    document.  Neighbours are found inside ranges of ids, so texts are shuffled once; only
    the first document of each range is fetched for the last one of the range before.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("order"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(32, min(max_buckets, size // bucket_bytes))
    cuts = rows.agg(F.percentile_approx("order", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    rows = rows.withColumn("bucket", _bucket(F.col("order"), sorted(set(cuts))))
    heads = sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.min("order").alias("head")).collect())  # a row a bucket
    follow = [(b, heads[(k + 1) % len(heads)][1]) for k, (b, _) in enumerate(heads)]
    after = spark.createDataFrame(follow, "bucket_before int, order long")
    first = rows.select("order", "text").join(F.broadcast(after), "order").groupBy(F.col("bucket_before").alias("bucket")).agg(F.min("text").alias("first_text"))
    w = Window.partitionBy("bucket").orderBy("order", "text")
    placed = rows.select("bucket", "doc_id", "text", F.row_number().over(w).alias("at"), F.lead("text").over(w).alias("lead_text")).join(first, "bucket", "left")
    last = F.col("lead_text").isNull()
    half = F.floor(F.length("text") / 2).cast("int")
    placed = placed.withColumn("next_text", F.coalesce("lead_text", "first_text")).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    kinds = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")), F.struct(F.when(last, F.lit(2)).alias("kind"), F.col("first_text").alias("text"))), lambda x: x["kind"].isNotNull())
    keys = ["bucket", "at", "doc_id", "n_chars", "edited_sha256"]
    every = placed.select("bucket", "at", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(kinds).alias("x")).select(*keys, "x.kind", "x.text")
    found = fingerprints(every, [*keys, "kind"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kind", "lanes"))).alias("f"))
    own, edited = F.col("f")[0], F.col("f")[1]
    ahead = F.coalesce(F.col("f")[2], F.lead(own).over(Window.partitionBy("bucket").orderBy("at")))
    return found.select("doc_id", "n_chars", "edited_sha256", own.alias("own"), edited.alias("edited"), ahead.alias("ahead")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("ahead")).alias("near_next"),
    )
