"""Ranking by use: what a person opened and picked, nearness to a place, and the state in version control.

Signals only reorder inside bands, so a page keeps the order that the query asked for; with no signal at all it is
returned as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.ordering import running_total
from spindrift.plans.grammar import Query

#: Days in which an opening loses half of its weight; picks of a path for a query from which it counts as a habit; sizes of a compacted store.
HALF_LIFE, HABIT, FILES, QUERIES, PATHS = 30.0, 3, 5000, 2000, 8


def frecency(opens: DataFrame, now: Column) -> DataFrame:
    """Per user and path the number of openings, their decayed sum and the last: user_id, path, opens, score, last_open.

    ``opens``: user_id, path, opened (unix seconds). Unknown and future times count as now.
    """
    age = F.greatest(F.lit(0.0), (now - F.coalesce("opened", now)) / 86400.0)
    return (
        opens.where("path is not null")
            .groupBy("user_id", "path")
            .agg(F.count("*").alias("opens"), F.sum(F.pow(F.lit(0.5), age / HALF_LIFE)).alias("score"), F.max("opened").alias("last_open"))
    )


def habits(picks: DataFrame) -> DataFrame:
    """Paths that were picked often enough for a query: user_id, query_norm, path, pick_count."""
    return picks.groupBy("user_id", "query_norm", "path").agg(F.max("pick_count").alias("pick_count")).where(F.col("pick_count") >= HABIT)


def recent(signals: DataFrame, limit: int) -> DataFrame:
    """The paths opened last, newest first."""
    return (
        signals.where("last_open_unix is not null")
            .groupBy("user_id", "path")
            .agg(F.max("last_open_unix").alias("last_open_unix"))
            .orderBy(F.desc("last_open_unix"), "path", "user_id")
            .limit(limit)
    )


def normal_query(text: str) -> str:
    return " ".join(text.lower().split())


def compact(signals: DataFrame, files: int = FILES) -> DataFrame:
    """Every user's store cut to its best files; what is cut is the feature. A user who owns most rows spans many tasks."""
    once = (
        signals.groupBy("user_id", "path")
            .agg(F.max("opens").alias("opens"), F.max("score").alias("score"), F.max("last_open_unix").alias("last_open_unix"))
    )
    placed = running_total(
        once, ["user_id"], [F.desc_nulls_last("score"), F.desc_nulls_last("last_open_unix"), F.col("path").asc()], F.lit(1), "place"
    )
    return placed.withColumn("place", F.col("place").cast("int")).where(F.col("place") <= files)


def compact_picks(picks: DataFrame, queries: int = QUERIES, paths: int = PATHS) -> DataFrame:
    """Every user's picks cut to the latest queries, and of a query to the most picked paths."""
    once = picks.groupBy("user_id", "query_norm", "path").agg(F.max("pick_count").alias("pick_count"), F.max("last_unix").alias("last_unix"))
    asked = once.groupBy("user_id", "query_norm").agg(F.max("last_unix").alias("at"))
    latest = running_total(asked, ["user_id"], [F.desc_nulls_last("at"), F.col("query_norm").asc()], F.lit(1), "nth").where(F.col("nth") <= queries)
    kept = once.join(latest.select("user_id", "query_norm"), ["user_id", "query_norm"], "left_semi")
    placed = running_total(
        kept, ["user_id", "query_norm"], [F.desc_nulls_last("pick_count"), F.desc_nulls_last("last_unix"), F.col("path").asc()], F.lit(1), "place"
    )
    return placed.withColumn("place", F.col("place").cast("int")).where(F.col("place") <= paths)


def hops(path: Column, anchor: str) -> Column:
    """Steps between two folders: up to the common one and down again; a file counts from its folder."""
    here = F.array(*[F.lit(x) for x in anchor.lower().rstrip("\\").split("\\")])
    there = F.slice(F.split(F.lower(path), r"\\"), 1, F.greatest(F.lit(0), F.size(F.split(path, r"\\")) - 1))
    same = F.size(
        F.filter(
            F.transform(
                F.sequence(
                    F.lit(1), F.greatest(F.lit(1), F.least(F.size(here), F.size(there)))
                ), lambda i: F.slice(here, 1, i) == F.slice(there, 1, i)
            ), lambda x: x
        )
    )
    return F.size(here) + F.size(there) - 2 * same


def band(q: Query) -> Column:
    """The stretch of a page inside which signals may reorder: the kind of match of a single name term, else the name."""
    if len(q.terms) == 1 and not q.path_mode:
        t = q.terms[0].lower()
        return F.when(F.col("name_l") == t, "0").when(F.col("name_l").startswith(t), "1").when(F.col("name_l").contains(t), "2").otherwise("3")
    return F.col("name_l")


def git_class() -> Column:
    """0 dirty, 1 unknown, 2 untracked, 3 clean or anything else."""
    flag = lambda c: F.coalesce(F.col(f"git.{c}"), F.lit(False))
    return F.when(F.col("git").isNull(), 1).when(flag("conflict") | flag("modified") | flag("staged"), 0).when(flag("untracked"), 2).otherwise(3)


def blend(
    page: DataFrame, q: Query, query_text: str, user: str, signals: DataFrame, picks: DataFrame, near: str = "", current: str = "",
    commits: DataFrame | None = None
) -> DataFrame:
    """A page (in order, with its ``position``) reordered by one person's signals; adds ``place``.

    Inside a band: habits for this query first, then nearness, frecency, state in version control, files (and folders
    above files) of the latest ``commits`` (path), time, the file at hand last, and the path. A page is limited
    already, so one task orders it.
    """
    mine = signals.where(F.col("user_id") == user).groupBy("path").agg(F.max("score").alias("frecency"))
    habit = (
        habits(picks.where((F.col("user_id") == user) & (F.col("query_norm") == normal_query(query_text)))).select("path", F.lit(1).alias("habit"))
    )
    rows = page.join(mine, "path", "left").join(habit, "path", "left")
    near = near or q.near
    keys = [F.coalesce("habit", F.lit(0)).desc()]
    if near:
        keys.append(hops(F.col("path"), near).asc())
    keys.append(F.coalesce("frecency", F.lit(0.0)).desc())
    if "git" in page.columns:
        keys.append(git_class().asc())
    if commits is not None:
        parts = F.split("path", r"\\")
        above = (
            commits.select(
                F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))).alias("path")
            )
                .distinct()
        )
        rows = rows.join(above.select("path", F.lit(1).alias("_commit")), "path", "left")
        keys.append(F.coalesce("_commit", F.lit(0)).desc())
    keys.append(F.col("mod_ns").desc())
    if current:
        keys.append((F.col("path_l") == current.lower()).asc())
    everything = Window.partitionBy()
    any_signal = (
        F.lit(bool(near or current or commits is not None))
        | (F.max(F.when(F.col("habit").isNotNull() | F.col("frecency").isNotNull(), 1).otherwise(0)).over(everything) == 1)
    )
    banded = rows.withColumn("_b", band(q)).withColumn("_any", any_signal)
    blended = F.row_number().over(Window.orderBy("_b", *keys, "path"))
    return banded.withColumn("place", F.when(F.col("_any"), blended).otherwise(F.col("position"))).drop("_b", "_any", "_commit")


def evidence(paths: DataFrame, repositories: DataFrame, states: DataFrame) -> DataFrame:
    """Paths with the state that the deepest repository above them reports: adds ``git`` (null outside).

    ``repositories``: root; ``states``: root, relative, and flags. Every path is matched with its ancestors by equality,
    so no path meets a repository that isn't above it.
    """
    parts = F.split("path", r"\\")
    above = paths.select(
        "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))).alias("root")
    )
    deepest = above.join(repositories.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    flags = [c for c in states.columns if c not in ("root", "relative")]
    found = (
        deepest.withColumn("relative", F.substring(F.col("path"), F.length("root") + 2, F.length("path"))).join(states, ["root", "relative"], "left")
    )
    return paths.join(found.select("path", F.struct(*flags).alias("git")), "path", "left")
