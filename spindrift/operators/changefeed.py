"""Applying a stream of inserts, updates and deletes: append-only files with equality deletes.

A change is appended to one of two kinds of files: rows that insert or update go to *data* files, deletions go to
*delete* files that hold nothing but the key. Both carry a sequence, the position of the change in its feed. Nothing
is rewritten. A reader takes the latest row of every key and anti-joins it against delete keys of a later sequence,
so repeated and out-of-order deliveries need no ordering on the way in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import exists, fresh_path


class EqualityDeleteTable:
    """A table of data files and equality-delete files below one folder.

    ``key`` names the columns that identify a row, ``sequence`` those that order its changes (nulls come first).

    * Rows whose key is null in any column name nothing and are left out.
    * A row delivered again, whole, changes nothing. At equal sequences a data row outlives a deletion, since a
      delete file holds for rows of an earlier sequence only; of two data rows the greater payload holds.
    * ``deleted`` null counts as an insert or update.
    * An empty feed gives an empty table with the same columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], sequence: Sequence[str]):
        self.spark, self.path, self.key, self.sequence = spark, path, list(key), list(sequence)

    @classmethod
    def fresh(cls, spark: SparkSession, key: Sequence[str], sequence: Sequence[str]) -> EqualityDeleteTable:
        return cls(spark, fresh_path(spark, "changefeed"), key, sequence)

    def _position(self) -> F.Column:
        return F.struct(*self.sequence)

    def _latest(self, rows: DataFrame, payload: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
        """One row a key, the latest; combined before the shuffle, so a hot key costs a row per task."""
        value = F.struct(self._position().alias("s"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
        best = rows.groupBy(*self.key, *more).agg(F.max(value).alias("_v"))
        return best.select(
            *self.key, *more, *[F.col(f"_v.s.{c}").alias(c) for c in self.sequence], *[F.col(f"_v.p{i}").alias(c) for i, c in enumerate(payload)]
        )

    def append(self, changes: DataFrame, deleted: str, payload: Sequence[str] = ()) -> None:
        """Add one batch, read once. It is compacted to the latest change per key and kind; earlier ones can't be seen by any reader."""
        gone = F.coalesce(F.col(deleted), F.lit(False))
        named = (
            changes.where(" and ".join(f"`{c}` is not null" for c in self.key))
                .select(
                    *self.key, *self.sequence, F.when(gone, "deletes").otherwise("data").alias("kind"),
                    *[F.when(~gone, F.col(c)).alias(c) for c in payload]
                )
        )
        self._latest(named, payload, ["kind"]).write.mode("append").option("compression", "zstd").partitionBy("kind").parquet(self.path)
        for kind, kept in (("data", payload), ("deletes", ())):
            if not exists(self.spark, f"{self.path}/kind={kind}"):  # a kind without rows keeps its columns
                named.where("false").select(*self.key, *self.sequence, *kept).write.mode("ignore").parquet(f"{self.path}/kind={kind}")

    def _kind(self, kind: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/kind={kind}")
        return found if kind == "data" else found.select(*self.key, *self.sequence)

    def read(self) -> DataFrame:
        """The current rows: latest data row per key, without those that a later delete key matches."""
        data = self._kind("data")
        rows = self._latest(data, [c for c in data.columns if c not in {*self.key, *self.sequence}])
        keys = (
            self._latest(self._kind("deletes"), ())
                .select(*[F.col(c).alias(f"_d_{c}") for c in self.key], F.struct(*[F.col(c) for c in self.sequence]).alias("_d_seq"))
        )
        match = [F.col(c) == F.col(f"_d_{c}") for c in self.key]
        return rows.join(keys, [*match, F.col("_d_seq") > self._position()], "left_anti")

    def fold(self, path: str | None = None) -> EqualityDeleteTable:
        """The same table in one data file set and one delete file set: current rows, and the last deletion of every key.

        Deletions stay, since an earlier change may still arrive. Nothing is changed in place; readers of the old
        folder are not disturbed, writers go on with the new table.
        """
        new = EqualityDeleteTable(self.spark, path or fresh_path(self.spark, "changefeed"), self.key, self.sequence)
        self.read().write.option("compression", "zstd").parquet(f"{new.path}/kind=data")
        self._latest(self._kind("deletes"), ()).write.option("compression", "zstd").parquet(f"{new.path}/kind=deletes")
        return new


def current_files(feed: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """The files that a feed of file changes leaves: (volume, frn, checkpoint_usn, feed_cursor, payload...).

    ``feed`` has volume, frn, checkpoint_usn, feed_cursor and deleted. A null or 0 frn names no file.
    """
    at = EqualityDeleteTable.fresh(feed.sparkSession, ("volume", "frn"), ("checkpoint_usn", "feed_cursor"))
    at.append(feed.where("frn <> 0"), "deleted", payload)
    return at.read()
