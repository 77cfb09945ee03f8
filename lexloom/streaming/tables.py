"""A table of the last row of each key that a stream keeps up: a snapshot, and the changes since by batch.

A batch writes only its own rows, into a folder of its number: run again after a failure, it writes the same folder.  When the
changes have grown to half of the snapshot they are folded into a new one, so the work of all folds together stays in proportion to the rows that
came in.  Folding stops before the batch at hand; so whatever is run again finds the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import delete, folders

_BATCH = "_batch"


class KeyedTable:
    """Rows by key under a folder of a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, share: float = 0.5, deltas: int = 64):
        self.spark, self.path, self.keys, self.share, self.deltas = spark, path.rstrip("/"), keys, share, deltas
        self.schema = schema
        self.stored = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])

    def _known(self, kind: str, before: int | None) -> list[int]:
        """Numbers of the complete folders of a kind, those of later batches left out."""
        found = [int(n.partition("=")[2]) for n in folders(self.spark, f"{self.path}/{kind}")]
        return sorted(n for n in found if before is None or n < before)

    def _parts(self, before: int | None) -> tuple[int, list[int]]:
        snapshots = self._known("snapshot", before)
        base = snapshots[-1] if snapshots else -1
        return base, [n for n in self._known("delta", before) if n > base]

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{kind}/n={n}" for n in numbers])

    def _merged(self, before: int | None) -> DataFrame:
        base, since = self._parts(before)
        rest = [c for c in self.stored.names if c not in self.keys]
        last = self._read("delta", since).groupBy(*self.keys).agg(F.max(F.struct(_BATCH, *[c for c in rest if c != _BATCH])).alias("_b"))
        new = last.select(*self.keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
        if base < 0:
            return new.select(self.stored.names)
        # rows of the snapshot are only looked up among the changed keys, not grouped again
        old = self._read("snapshot", [base])
        gone = new.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        same = None
        for k in self.keys:
            c = F.col(k).eqNullSafe(F.col(f"_{k}"))
            same = c if same is None else same & c
        return old.join(gone, same, "left_anti").select(self.stored.names).unionByName(new.select(self.stored.names))

    def read(self, before: int | None = None) -> DataFrame:
        """The last row of each key, as of all batches or those before one."""
        return self._merged(before).select(self.schema.names)

    def write(self, part: DataFrame, n: int) -> None:
        """Store the rows of batch n; a key has one row in a batch, or any of its rows may count."""
        base, since = self._parts(n)
        if len(since) >= self.deltas or (since and self._read("delta", since).count() > self.share * max(1000, self._read("snapshot", [base]).count() if base >= 0 else 0)):
            self._fold(n, since[-1])
        part.select(self.schema.names).withColumn(_BATCH, F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.path}/delta/n={n}")

    def _fold(self, before: int, upto: int) -> None:
        self._merged(before).write.mode("overwrite").parquet(f"{self.path}/snapshot/n={upto}")
        # the snapshot before this one and the changes since stay, for those who read them now
        old = self._known("snapshot", upto)
        for n in old[:-1]:
            delete(self.spark, f"{self.path}/snapshot/n={n}")
        for n in self._known("delta", upto):
            if old and n <= old[-1]:
                delete(self.spark, f"{self.path}/delta/n={n}")
