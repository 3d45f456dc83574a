"""Where results go: plain lines, JSON lines, lines of text with their place, and a listing to be searched later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_paths(rows: DataFrame, path: str) -> None:
    """One path a line."""
    rows.select("path").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line; unknown fields are left out."""
    rows.write.mode("overwrite").json(path)


def grep_lines(lines: DataFrame) -> DataFrame:
    """``path:LINE:text`` for matches and ``path-LINE-text`` for their neighbours."""
    mark = F.when(F.col("match"), ":").otherwise("-")
    return lines.select("path", "line", F.concat(F.col("path"), mark, F.col("line").cast("string"), mark, F.col("text")).alias("shown"))


def write_index(rows: DataFrame, path: str) -> None:
    """A listing in files of its own per volume; the write is committed as a whole or not at all."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("volume").parquet(path)
