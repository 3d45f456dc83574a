"""Sums over subtrees, posting lists of grams, duplicates and other aggregates over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _above(paths: str = "path") -> F.Column:
    parts = F.split(paths, r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))


def folder_bytes(entries: DataFrame) -> DataFrame:
    """Bytes and files below every folder, however deep, and the first name: volume, path, bytes, files, first_name."""
    files = entries.where("not is_dir").where(F.size(F.split("path", r"\\")) > 1)
    own = (
        files.withColumn("folder", F.substring("path", F.lit(1), F.length("path") - F.length("name") - 1))
            .groupBy("volume", "folder")
            .agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("name_l").alias("m"))
    )
    up = own.select(
        "volume",
        F.explode(F.when(F.instr("folder", "\\") > 0, F.concat(_above("folder"), F.array("folder"))).otherwise(F.array("folder"))).alias("path"), "b",
        "n", "m"
    )
    return up.groupBy("volume", "path").agg(F.sum("b").alias("bytes"), F.sum("n").alias("files"), F.min("m").alias("first_name"))


def with_sizes(rows: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Rows of ``entries`` (all, if not given) whose folders carry the bytes below them instead of their own size."""
    sums = folder_bytes(rows if entries is None else entries).select(F.col("volume").alias("_v"), F.col("path").alias("_p"), "bytes")
    return (
        rows.join(sums, F.col("volume").eqNullSafe(F.col("_v")) & (F.col("path") == F.col("_p")), "left")
            .withColumn("size", F.when(F.col("is_dir"), F.coalesce("bytes", F.lit(0))).otherwise(F.col("size")))
            .drop("_v", "_p", "bytes")
    )


def folder_deltas(changes: DataFrame) -> DataFrame:
    """How much each folder grows by changes (path, old_size, new_size; null: the file isn't there): path, delta."""
    own = changes.where(F.instr("path", "\\") > 0).withColumn("d", F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0)))
    return own.select(F.explode(_above()).alias("path"), "d").groupBy("path").agg(F.sum("d").alias("delta"))


def grams(rows: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """Distinct grams of each row: gram, key."""
    low = F.lower(column)
    found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n))))
    return rows.where(F.length(column) >= n).select(F.explode(found).alias("gram"), key)


def gram_counts(rows: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """How many rows hold each gram; the lists themselves stay rows of ``grams``."""
    return grams(rows, key, column, n).groupBy("gram").agg(F.count("*").alias("n_rows"))


def duplicates(entries: DataFrame) -> DataFrame:
    """Texts that stand in several files: digest, files, bytes (of the copies beyond the first)."""
    sized = entries.where("text is not null").select(F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("b"))
    return (
        sized.groupBy("digest", "b")
            .agg(F.count("*").alias("files"))
            .where("files > 1")
            .select("digest", "files", (F.col("b") * (F.col("files") - 1)).alias("bytes"))
    )


def aliases(entries: DataFrame) -> DataFrame:
    """Every copy with the file that stands for its text (the least path): path, first_path."""
    keyed = entries.where("text is not null").select("path", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("b"))
    first = keyed.groupBy("digest", "b").agg(F.min("path").alias("first_path"))
    return keyed.join(first, ["digest", "b"]).where("path <> first_path").select("path", "first_path")


def statistics(entries: DataFrame) -> DataFrame:
    """Names, distinct names and their letters per volume."""
    return (
        entries.groupBy("volume")
            .agg(
                F.count("*").alias("n_entries"), F.countDistinct("name").alias("n_names"), F.sum(F.length("name")).alias("name_chars"),
                F.sum(F.col("is_dir").cast("int")).alias("n_folders")
            )
    )


def latencies(times: DataFrame, column: str) -> DataFrame:
    """Least, median, 90th, 95th, 99th percentile and greatest of a column, by rank."""
    return times.agg(
        *[
            F.percentile_approx(column, p, 1_000_000).alias(n)
            for n, p in (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("max", 1.0))
        ]
    )
