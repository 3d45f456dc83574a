"""File systems as sources of entries, and query files."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import written
from spindrift.sources.entries import DIR_BIT, enriched

ROWS = "volume string, frn long, path string, mode long, size long, mod_ns long, source string, text string"


#: Entries that a task lists before it hands the folders still to be read to the next round.
SHARE = 20_000
_FOUND = f"{ROWS}, pending boolean"


def _listed(folders: Iterator[str]) -> Iterator[tuple]:
    """What is below some folders, as rows; once ``SHARE`` entries are listed, folders come back as pending instead."""
    stack, seen = list(folders), 0
    while stack:
        at = stack.pop()
        if seen >= SHARE:
            yield (None, None, at, None, None, None, "walk", None, True)
            continue
        try:
            for x in os.scandir(at):
                try:
                    s, is_dir = x.stat(follow_symlinks=False), x.is_dir(follow_symlinks=False)
                except OSError:
                    continue
                seen += 1
                yield (None, s.st_ino, x.path, DIR_BIT | 0x10 if is_dir else 0x20, 0 if is_dir else s.st_size, s.st_mtime_ns, "walk", None, False)
                if is_dir:
                    stack.append(x.path)
        except OSError:
            continue


def walk(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Everything below some folders that all executors see; what can't be read is left out, links aren't followed.

    Folders are walked in rounds: a task that has listed its share gives back the folders it hasn't read, and the next
    round spreads them over all tasks, so one huge folder tree keeps every core busy.
    """
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(list(_listed(frame["path"])), columns=names)

    parts: list[DataFrame] = []
    pending = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path string")
    while not pending.isEmpty():
        spread = pending.repartition(4 * spark.sparkContext.defaultParallelism)
        found, _ = written(spread.mapInPandas(run, _FOUND), "walk")
        parts.append(found.where("not pending").drop("pending"))
        pending = found.where("pending").select("path")
    return enriched(reduce(DataFrame.unionByName, parts, spark.createDataFrame([], ROWS)))


def exists(entries: DataFrame) -> DataFrame:
    """Adds ``exists``: whether the file is there now."""

    @F.pandas_udf("boolean")
    def there(paths: pd.Series) -> pd.Series:
        return paths.map(os.path.exists)

    return entries.withColumn("exists", there(F.translate("path", "\\", "/")))


def queries_of(path: str) -> list[str]:
    """One query a line; ``#`` begins a comment."""
    with open(path, encoding="utf-8") as lines:
        return [x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#")]


#: Entries that a fallback walk lists at most, and seconds that it takes.
VISITS, SECONDS = 100_000, 2.0


def fallback(spark: SparkSession, folder: str, visits: int = VISITS, seconds: float = SECONDS) -> tuple[DataFrame, bool]:
    """A bounded listing of one folder for a search whose index has nothing there, and whether it is complete.

    It runs on the driver and is bounded by ``visits`` and ``seconds``; it is never used for counts.
    """
    began, rows, stack, complete = time.monotonic(), [], [folder], True
    while stack:
        if len(rows) >= visits or time.monotonic() - began > seconds:
            complete = False
            break
        at = stack.pop()
        try:
            for x in os.scandir(at):
                s = x.stat(follow_symlinks=False)
                is_dir = x.is_dir(follow_symlinks=False)
                rows.append((None, s.st_ino, x.path, DIR_BIT | 0x10 if is_dir else 0x20, 0 if is_dir else s.st_size, s.st_mtime_ns, "fallback", None))
                if is_dir:
                    stack.append(x.path)
        except OSError:
            continue
    return enriched(spark.createDataFrame(rows[:visits], ROWS)), complete
