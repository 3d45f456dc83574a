"""Processing only new or changed records: log-based capture with offsets, a write-ahead plan and an idempotent sink.

A batch goes through three steps, each kept in the shared folder, so that a run that dies between any two of them is
taken up where it stopped:

1. ``plan``: per partition (a volume) the offset from which to read and up to which run, written before any work;
2. ``execute``: reads what the *written* plan says - a second attempt reads the same plan, not a new one;
3. ``commit``: rows go to a folder of the batch, then a marker. Readers see marked batches only and keep, per key, the
   row of the highest offset, so a batch that is delivered again adds nothing.

Change numbers restart when a volume's journal is replaced, so an offset is (time of the run, change number, time seen).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import exists, fresh_path, remove

PLAN = "volume string, open_run long, source string, mode string, from_usn long, journal_id long, built_at timestamp"
#: What a sink row carries besides its key; the first three are its offset.
ROW = "built_at timestamp, usn long, seen_at timestamp, journal_id long, print_size long, print_mod long, batch long"


def offsets(runs: DataFrame) -> DataFrame:
    """The plan: for each volume with an open run, how its files are to be told apart.

    ``all``: nothing was processed before or the journal was replaced; ``journal``: files whose change number is at or
    above ``from_usn``; ``compare``: no journal, so prints are compared with those of earlier successful runs.
    """
    runs = runs.select("run_id", "volume", "source", "journal_id", "checkpoint_usn", "state", "built_at", "last_persist")
    opened = (
        runs.where("state = 'replaying' and volume is not null")
            .groupBy("volume")
            .agg(F.max(F.struct("built_at", "run_id", "source", "journal_id")).alias("o"))
    )
    done = runs.where("state = 'ready' and last_persist is not null and volume is not null")
    last = (
        done.join(opened, "volume")
            .where("built_at < o.built_at or (built_at = o.built_at and run_id <> o.run_id)")
            .groupBy("volume")
            .agg(F.max(F.struct("built_at", "run_id", "journal_id", "checkpoint_usn")).alias("l"))
    )
    mode = (
        F.when(F.col("o.source") == "walk", "compare")
            .when(F.col("l").isNull() | ~F.col("l.journal_id").eqNullSafe(F.col("o.journal_id")) | F.col("l.checkpoint_usn").isNull(), "all")
            .otherwise("journal")
    )
    return (
        opened.join(last, "volume", "left")
            .select(
                "volume", F.col("o.run_id").alias("open_run"), F.col("o.source").alias("source"), mode.alias("mode"),
                F.col("l.checkpoint_usn").alias("from_usn"), F.col("o.journal_id").alias("journal_id"), F.col("o.built_at").alias("built_at")
            )
    )


def changed(prints: DataFrame, runs: DataFrame, plan: DataFrame) -> DataFrame:
    """The files of the planned runs that are new or changed: volume, frn, built_at, usn, seen_at, journal_id, print_size, print_mod.

    Of several prints of a file in one run the latest ``seen_at`` holds. Prints of runs that neither succeeded nor are
    planned say nothing. Sizes and times compare null-safe; a null change number counts as changed.
    """
    prints = prints.select("run_id", "volume", "frn", "print_size", "print_mod", "usn", "seen_at")
    done = (
        runs.where("state = 'ready' and last_persist is not null")
            .groupBy("run_id", F.col("volume").alias("_v"))
            .agg(F.max("built_at").alias("built_at"))
    )
    roles = (
        done.join(plan.where("mode = 'compare'").select(F.col("volume").alias("_v")), "_v", "left_semi")
            .select("run_id", "_v", "built_at", F.lit(False).alias("opened"))
    )
    roles = roles.unionByName(
        plan.select(
            F.col("open_run").alias("run_id"), F.col("volume").alias("_v"), F.lit(None).cast("timestamp").alias("built_at"),
            F.lit(True).alias("opened")
        )
    )
    facts = F.struct("seen_at", "usn", "print_size", "print_mod")
    seen = prints.where("frn is not null").join(roles, [prints["run_id"] == roles["run_id"], prints["volume"] == roles["_v"]]).groupBy("volume", "frn").agg(
        F.max(F.when(F.col("opened"), facts)).alias("now"),
        F.max(F.when(~F.col("opened"), F.struct("built_at", roles["run_id"], facts.alias("p")))).alias("before"),
    )
    same = (
        F.col("before").isNotNull()
        & F.col("before.p.print_size").eqNullSafe(F.col("now.print_size"))
        & F.col("before.p.print_mod").eqNullSafe(F.col("now.print_mod"))
    )
    case = (
        F.when(F.col("mode") == "all", True)
            .when(F.col("mode") == "journal", F.coalesce(F.col("now.usn") >= F.col("from_usn"), F.lit(True)))
            .otherwise(~same)
    )
    return (
        seen.where("now is not null")
            .join(
                plan.select("volume", "mode", "from_usn", F.col("built_at").alias("o_built_at"), F.col("journal_id").alias("o_journal_id")), "volume"
            )
            .where(case)
            .select(
                "volume", "frn", F.col("o_built_at").alias("built_at"), "now.usn", "now.seen_at", F.col("o_journal_id").alias("journal_id"),
                "now.print_size", "now.print_mod"
            )
    )


class IncrementalJob:
    """One job's log: plans, batches and markers below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "incremental")

    def plan(self, batch: int, runs: DataFrame) -> DataFrame:
        """The written plan of a batch; written now if there is none yet, else the one that an earlier attempt wrote."""
        at = f"{self.path}/plans/{batch}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            offsets(runs).coalesce(1).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(PLAN).parquet(at)

    def run(self, batch: int, prints: DataFrame, runs: DataFrame) -> None:
        """Process a batch once: a batch that is marked done is left alone; what an unfinished attempt wrote is replaced."""
        at = f"{self.path}/batches/{batch}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            if exists(self.spark, at):
                remove(self.spark, at)
            changed(
                prints, runs, self.plan(batch, runs)
            ).withColumn("batch", F.lit(batch).cast("long")).write.option("compression", "zstd").parquet(at)

    def read(self) -> DataFrame:
        """All committed rows, one a key: the one of the highest offset, then of the latest batch."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [str(x.getPath()) for x in fs.listStatus(root) if exists(self.spark, f"{x.getPath()}/_SUCCESS")] if fs.exists(root) else []
        schema = f"volume string, frn long, {ROW}"
        if not done:
            return self.spark.createDataFrame([], schema)
        names = [x.split()[0] for x in ROW.split(", ")]
        order = ["built_at", "usn", "seen_at", "batch", *[c for c in names[3:] if c != "batch"]]
        rows = self.spark.read.schema(schema).parquet(*done).groupBy("volume", "frn").agg(F.max(F.struct(*order)).alias("r"))
        return rows.select("volume", "frn", *[F.col(f"r.{c}").alias(c) for c in names])


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a walk found against what is indexed, by (volume, frn): state is added, changed, removed or same.

    Both have volume, frn, size and mod; repeated rows count once (the greatest size and time), nulls compare as equal.
    """
    one = lambda rows, side: rows.where("frn is not null").groupBy("volume", "frn").agg(F.max(F.struct("mod", "size")).alias(side))
    both = one(old, "o").join(one(new, "n"), ["volume", "frn"], "full")
    state = (
        F.when(F.col("o").isNull(), "added")
            .when(F.col("n").isNull(), "removed")
            .when(F.col("o.size").eqNullSafe(F.col("n.size")) & F.col("o.mod").eqNullSafe(F.col("n.mod")), "same")
            .otherwise("changed")
    )
    return both.select("volume", "frn", state.alias("state"))
