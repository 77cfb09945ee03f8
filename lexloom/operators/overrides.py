"""Layered overrides and edits: validation, precedence, upserts, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize

_TIERS, _TRACKS = ("global", "novel", "user"), ("phrase", "name")


def tier_rank(tier: Column, track: Column) -> Column:
    """global phrase < global name < novel phrase < novel name < user phrase < user name."""
    return F.array_position(F.array(*map(F.lit, _TIERS)), tier) * 2 + F.array_position(F.array(*map(F.lit, _TRACKS)), track)


def merge_layers(overrides: DataFrame, scopes: DataFrame) -> DataFrame:
    """The layer of each scope (a novel): later tiers win a phrase, the cap style travels with its value.

    overrides: tier, track, novel_id (null for global), phrase, value, cap, is_active.
    """
    active = overrides.where("is_active")
    shared = active.where("tier = 'global'").drop("novel_id").join(scopes, F.lit(True))
    own = active.where("tier <> 'global'")
    rows = shared.select("novel_id", "phrase", "value", "cap", "tier", "track").unionByName(own.select("novel_id", "phrase", "value", "cap", "tier", "track"))
    best = rows.groupBy("novel_id", "phrase").agg(F.max(F.struct(tier_rank(F.col("tier"), F.col("track")).alias("rank"), "value", "cap", "tier", "track")).alias("b"))
    return best.select("novel_id", "phrase", "b.value", "b.cap", "b.tier", "b.track")


def split_layers(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The global layer (phrase, value, cap) and those of single scopes (scope, phrase, value, cap); in each the higher tier and track wins a phrase."""
    active = overrides.where("is_active")
    top = F.max(F.struct(tier_rank(F.col("tier"), F.col("track")).alias("rank"), "value", "cap")).alias("b")
    shared = active.where("tier = 'global'").groupBy("phrase").agg(top).select("phrase", "b.value", "b.cap")
    own = active.where("tier <> 'global'").groupBy(F.col("novel_id").alias("scope"), "phrase").agg(top).select("scope", "phrase", "b.value", "b.cap")
    return shared, own


def reader_layers(overrides: DataFrame, readers: DataFrame) -> DataFrame:
    """The layers of single readers (scope, phrase, value, cap): the novel's shared entries under the reader's own.

    overrides have user_id (null but in the user tier); readers: novel_id, user_id.  A scope is `reader_scope` of both;
    nobody sees what another reader has of their own.
    """
    active = overrides.where("is_active AND tier <> 'global'")
    pairs = readers.select("novel_id", "user_id").distinct()
    shared = active.where("tier = 'novel'").drop("user_id").join(pairs, "novel_id")
    own = active.where("tier = 'user'").join(pairs, ["novel_id", "user_id"], "left_semi")
    top = F.max(F.struct(tier_rank(F.col("tier"), F.col("track")).alias("rank"), "value", "cap")).alias("b")
    best = shared.unionByName(own).groupBy(reader_scope().alias("scope"), "phrase").agg(top)
    return best.select("scope", "phrase", "b.value", "b.cap")


def reader_scope(novel: str = "novel_id", user: str = "user_id") -> Column:
    return F.to_json(F.array(F.col(novel).cast("string"), F.col(user).cast("string")))


def reject_reason(phrase: Column, value: Column, cap: Column, track: Column) -> Column:
    """Why an override isn't acceptable, or null."""
    return (
        F.when(F.coalesce(phrase, F.lit("")).eqNullSafe("") | F.coalesce(value, F.lit("")).eqNullSafe(""), "missing")
        .when(phrase.contains("\n"), "line break")
        .when(F.length(phrase) > 60, "phrase too long")
        .when(F.length(value) > 200, "value too long")
        .when(F.size(F.split(value, "/", -1)) > 8, "too many alternatives")
        .when(~F.coalesce(cap.isin("NONE", "FIRST_LETTER", "ALL_WORDS"), F.lit(False)), "cap style")
        .when(~F.coalesce(track.isin(*_TRACKS), F.lit(False)), "track")
    )


def apply_upserts(base: DataFrame, edits: DataFrame, keys: list[str], set_cols: list[str], seq: str = "seq", keep_cols: list[str] = ()) -> DataFrame:
    """Insert or replace by key, the last edit wins; keep_cols stay as first inserted.  Base rows have seq null."""
    rows = base.withColumn(seq, F.coalesce(F.col(seq), F.lit(-1))).unionByName(edits)
    last = F.max(F.struct(seq, *set_cols)).alias("_last")
    first = [F.min(F.struct(seq, c)).alias(f"_first_{c}") for c in keep_cols]
    out = rows.groupBy(*keys).agg(last, *first)
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in set_cols], *[F.col(f"_first_{c}.{c}").alias(c) for c in keep_cols], F.col(f"_last.{seq}").alias(seq))


def set_active(base: DataFrame, toggles: DataFrame, keys: list[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """base with the last toggle of each key applied, and the toggles of unknown keys."""
    changed = toggles.groupBy(*keys).agg(F.max(F.struct(seq, "is_active")).alias("_t"))
    out = base.join(changed, keys, "left").withColumn("is_active", F.coalesce("_t.is_active", "is_active")).drop("_t")
    return out, toggles.join(base.select(*keys), keys, "left_anti")


def version_as_of(rows: DataFrame, edits: DataFrame, at: str, name: str = "version", seq: str = "seq") -> DataFrame:
    """rows and `name`: the dictionary's version at the place `at` of the edit log (1 before every edit, and where `at` is null).

    Edits and rows are sorted together over ranges of the log; a range begins with the edits of the ranges before it, of
    which there is one count each, so no task sees more than its range.
    """
    names = rows.columns
    shared = edits.where(F.col("tier") != "user").select(F.col(seq).cast("long").alias("_seq"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.select(F.struct(*names)).schema[0].dataType).alias("_row"))
    asked = rows.select(F.coalesce(F.col(at).cast("long"), F.lit(-(1 << 63))).alias("_seq"), F.lit(1).alias("_kind"), F.struct(*names).alias("_row"))
    tied = shared.unionByName(asked).withColumn("_tie", F.monotonically_increasing_id())
    placed = materialize(tied.repartitionByRange("_seq", "_kind", "_tie").withColumn("_part", F.spark_partition_id()), "log")
    own = F.sum(1 - F.col("_kind")).over(Window.partitionBy("_part").orderBy("_seq", "_kind"))
    counts = placed.groupBy("_part").agg(F.sum(1 - F.col("_kind")).alias("_n"))  # a row a range
    before = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    out = placed.withColumn("_own", own).where("_kind = 1").join(F.broadcast(before), "_part")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], (1 + F.col("_before") + F.col("_own")).alias(name))


def dictionary_version(edits: DataFrame) -> DataFrame:
    """1 + edits of shared tiers."""
    return edits.agg((1 + F.count(F.when(F.col("tier") != "user", 1))).alias("version"))
