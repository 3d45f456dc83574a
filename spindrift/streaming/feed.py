"""The change feed as a stream, and what changed between two states of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators.changefeed import EqualityDeleteTable


def apply_stream(
    changes: DataFrame, table: EqualityDeleteTable, deleted: str, checkpoint: str, payload: list[str] = (), floor: str | None = None,
    own: list[str] = (), every: str | None = None
) -> StreamingQuery:
    """Append a stream of changes to an equality-delete table, batch by batch.

    A batch that runs again after a failure appends the same rows again; readers keep one, so the state is right after
    any restart. ``floor`` is a condition that late changes fail, such as one on the checkpoint of a base. Changes of
    files below the folders ``own`` (the engine's own, told by ``path``) are left out, as they would feed on
    themselves. ``every`` (as ``500 milliseconds``) gathers changes for so long; without it, what is there is taken.
    """
    low = [x.lower().replace("/", "\\").rstrip("\\") for x in own]

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.where(floor) if floor else rows
        for folder in low:
            path = F.translate(F.lower(F.coalesce("path", F.lit(""))), "/", "\\")
            rows = rows.where((path != folder) & ~path.startswith(folder + "\\"))
        table.append(rows, deleted, payload)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Change files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def _events(rows: DataFrame, a: str, b: str, came: F.Column, gone: F.Column) -> DataFrame:
    moved = ~gone & ~came & (F.col(f"{a}.path") != F.col(f"{b}.path"))
    touched = ~gone & ~came & ~moved & ~(F.col(f"{a}.size").eqNullSafe(F.col(f"{b}.size")) & F.col(f"{a}.mod_ns").eqNullSafe(F.col(f"{b}.mod_ns")))
    event = lambda kind, side: F.struct(F.lit(kind).alias("event"), *[F.col(f"{side}.{c}").alias(c) for c in ("path", "size", "mod_ns")])
    events = F.array_compact(
        F.array(F.when(came | moved, event("created", b)), F.when(touched, event("modified", b)), F.when(gone | moved, event("deleted", a)))
    )
    return rows.select(F.explode(events).alias("e")).select("e.*")


def watch(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events between two states (volume, frn, path, size, mod_ns): event, path, size, mod_ns.

    A file that came and went in between leaves none; a renamed file is deleted under its old path and created under
    the new one. Without a record number the path names the file.
    """
    key = F.coalesce(F.concat(F.lit("f"), F.col("frn").cast("string")), F.concat(F.lit("p"), F.col("path")))
    a, b = (x.select("volume", key.alias("key"), "path", "size", "mod_ns").alias(n) for x, n in ((old, "a"), (new, "b")))
    both = a.join(b, (F.col("a.volume") == F.col("b.volume")) & (F.col("a.key") == F.col("b.key")), "full")
    return _events(both, "a", "b", F.col("a.key").isNull(), F.col("b.key").isNull())


def transitions(changes: DataFrame, order: list[str], since: F.Column | str) -> DataFrame:
    """Each file's state at a point and now, from one reading of its changes: volume, frn, a, b (null: not there).

    ``changes``: volume, frn, deleted, path, size, mod_ns and the columns of ``order``; ``since`` is true for changes
    up to the point. Rows without a volume or record number name no file; a state without a path isn't there.
    """
    state = F.struct(*order, F.coalesce(~F.col("deleted"), F.lit(True)).alias("_live"), "path", "size", "mod_ns")
    upto = F.expr(since) if isinstance(since, str) else since
    best = (
        changes.where("volume is not null and frn <> 0").groupBy("volume", "frn").agg(F.max(F.when(upto, state)).alias("a"), F.max(state).alias("b"))
    )
    there = lambda s: F.when(
        F.col(f"{s}._live") & F.col(f"{s}.path").isNotNull(), F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("path", "size", "mod_ns")])
    ).alias(s)
    return best.select("volume", "frn", there("a"), there("b")).where("a is not null or b is not null")


def watch_feed(changes: DataFrame, order: list[str], since: F.Column | str) -> DataFrame:
    """``watch`` over a change feed, from a point in it until now."""
    return _events(transitions(changes, order, since), "a", "b", F.col("a").isNull(), F.col("b").isNull())


def watch_from(changes: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a watcher sees since its last call: its new cursors (volume, seq, reset), and the events.

    ``changes``: volume, frn, seq, deleted, path, size, mod_ns; ``cursors``: volume, seq. A volume without a cursor
    gets one and no events. A cursor beyond the last change belongs to a feed that was rebuilt: it is reset to the
    last change, without events, and the watcher must read that volume anew. Other volumes give the events behind
    their cursor.
    """
    marks = changes.where("volume is not null").groupBy("volume").agg(F.max("seq").alias("_last"))
    known = cursors.select("volume", F.col("seq").alias("_since"))
    placed = (
        marks.join(known, "volume", "left")
            .select("volume", F.col("_last").alias("seq"), F.coalesce(F.col("_since") > F.col("_last"), F.lit(False)).alias("reset"), "_since")
    )
    live = placed.where("_since is not null and not reset").select("volume", "_since")
    return placed.select("volume", "seq", "reset"), watch_feed(changes.join(live, "volume"), ["seq"], "seq <= _since")


def overlay(base: DataFrame, changes: DataFrame, checkpoint: str = "true") -> DataFrame:
    """A base listing under the latest change of each file: rows of the base that no change names, and live changes.

    ``changes``: volume, frn, usn, seq, deleted and the columns of the base; ``checkpoint`` drops late ones.
    """
    columns = base.columns
    latest = (
        changes.where("frn <> 0")
            .where(checkpoint)
            .groupBy("volume", "frn")
            .agg(F.max_by(F.struct("deleted", *[c for c in columns if c not in ("volume", "frn")]), F.struct("usn", "seq")).alias("c"))
    )
    live = (
        latest.where("not coalesce(c.deleted, false)")
            .select("volume", "frn", *[F.col(f"c.{c}").alias(c) for c in columns if c not in ("volume", "frn")])
    )
    return base.join(latest.select("volume", "frn"), ["volume", "frn"], "left_anti").unionByName(live.select(*columns))


def cascade(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries without deleted or renamed folders (volume, path_l) and everything below them, by equality on each ancestor."""
    parts = F.split("path_l", r"\\")
    above = entries.select(
        "volume", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))).alias("root")
    )
    hidden = above.join(gone.select("volume", F.col("path_l").alias("root")).distinct(), ["volume", "root"]).select("volume", "path").distinct()
    return entries.join(hidden, ["volume", "path"], "left_anti")


def renamed(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """Entries after folders were renamed or moved (volume, old, new: full paths): all that lies below goes along.

    A path follows the deepest of its folders that moved, once; ``path``, ``name`` and what is derived from them must
    be made anew by the caller (``sources.entries.enriched``), so only volume, frn and path come back.
    """
    parts = F.split("path", r"\\")
    above = entries.select(
        "volume", "frn", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))).alias("_at")
    )
    named = moves.select(F.col("volume").alias("_v"), F.lower("old").alias("_old"), "new")
    hit = above.join(named, (F.col("volume") == F.col("_v")) & (F.lower("_at") == F.col("_old"))).select("volume", "path", "_at", "new")
    deepest = hit.groupBy("volume", "path").agg(F.max_by(F.struct("_at", "new"), F.length("_at")).alias("_m"))
    moved = entries.select("volume", "frn", "path").join(deepest, ["volume", "path"], "left")
    return moved.select(
        "volume", "frn",
        F.when(F.col("_m").isNotNull(), F.concat("_m.new", F.substring("path", F.length("_m._at") + 1, F.length("path"))))
            .otherwise(F.col("path"))
            .alias("path")
    )


def current_occupant(changes: DataFrame) -> DataFrame:
    """Only the changes of each record number's latest sequence: a reused number forgets its former file."""
    latest = changes.groupBy("volume", "frn").agg(F.max_by("seq", F.struct("usn", "seq")).alias("_s"))
    return changes.join(latest, ["volume", "frn"]).where(F.col("seq") == F.col("_s")).drop("_s")
