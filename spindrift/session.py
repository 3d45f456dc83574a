"""What every operator needs from the session: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, as the cluster names it.

    Where it is unset a temporary folder is made and set as the checkpoint folder, on a local master only: on a
    cluster each executor would write to a disk of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses, below a folder of this application that goes when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = f"{shared_dir(spark).rstrip('/')}/spindrift/{app}"
        where, fs = _file_system(spark, root)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _ROOTS[app] = root
    return f"{_ROOTS[app]}/{what}-{uuid.uuid4().hex}"


_ROOTS: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is on; a path that is gone is no error."""
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, what: str, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """The same rows read back from a table in the shared folder, and its path: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of one computation, to be removed when they have been read; the rest goes with the application."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, defaultdict(list)

    def keep(self, df: DataFrame, what: str, by: Sequence[str] = ()) -> DataFrame:
        found, path = written(df, what, by)
        self.paths[what].append(path)
        return found

    def forget(self, *what: str) -> None:
        for w in what:
            for path in self.paths.pop(w, []):
                remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def text_or(column: str, other: str = "") -> F.Column:
    return F.coalesce(F.col(column), F.lit(other))


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _file_system(spark, path)
    return fs.exists(where)


def listing_of(df: DataFrame) -> str:
    """A name for the present files of the tables that a frame reads: it changes when any file comes, goes or is written anew."""
    spark = df.sparkSession
    found = []
    for path in sorted(df.inputFiles()):
        where, fs = _file_system(spark, path)
        status = fs.getFileStatus(where)
        found.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:16]
