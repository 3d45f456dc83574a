"""One ranking from several scores on unlike scales: the first principal component of their ranks.

Each score is replaced by its mid-rank among all items, so no range or outlier can dominate. The correlation matrix of
the ranks is one aggregate over all items; its leading eigenvector (a matrix of as many rows as scores, solved on the
driver) gives the loadings, turned so that they agree with the declared directions. An item's fused score is its
projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ordering import running_total
from spindrift.session import written


def mid_ranks(items: DataFrame, scores: Sequence[str]) -> DataFrame:
    """``items`` with each score replaced by its mid-rank from 1: equal values share one, null and NaN stay null.

    All scores are ranked at once, as rows of (item, score, value). Values are counted before they are ordered, so a
    value that most items have costs one row a task; the ranks are joined back by value - a side that is unique, and
    sent to the others or split by its measured size - and gathered by item.
    """
    held, _ = written(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    pairs = ", ".join(f"{i}, cast(`{c}` as double)" for i, c in enumerate(scores))
    long = held.selectExpr("_item", f"stack({len(scores)}, {pairs}) as (signal, value)").where("value is not null and not isnan(value)")
    counted = long.groupBy("signal", "value").count()
    ranks = running_total(counted, ["signal"], [F.col("value")], F.col("count"), "upto")
    own = ranks.select("signal", "value", (F.col("upto") - F.col("count") + (F.col("count") + 1) / 2).alias("_r"))
    wide = (
        long.join(own, ["signal", "value"])
            .groupBy("_item")
            .agg(*[F.max(F.when(F.col("signal") == i, F.col("_r"))).alias(f"_r{i}") for i in range(len(scores))])
    )
    out = held.join(wide, "_item", "left")
    return out.select(*[F.col(f"_r{scores.index(c)}").alias(c) if c in scores else F.col(c) for c in items.columns])


def first_component(ranked: DataFrame, directions: Mapping[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and loadings of the ranks; pairs of scores count where both are known.

    A score that is constant or unknown gets loading 0. Of the two signs of the component the one is taken under which
    the loadings, each turned by its declared direction, have the larger sum.
    """
    names = list(directions)
    wanted = [F.avg(c).alias(f"m{i}") for i, c in enumerate(names)] + [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    both = lambda i, j: F.when(F.col(names[j]).isNotNull(), F.col(names[i]))
    wanted += [F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]
    wanted += [F.stddev_pop(both(i, j)).alias(f"d{i}_{j}") for a, b in pairs for i, j in ((a, b), (b, a))]
    found = ranked.agg(*wanted).collect()[0]
    mean = np.array([0.5 if found[f"m{i}"] is None else found[f"m{i}"] for i in range(len(names))])
    dev = np.array([found[f"s{i}"] or 0.0 for i in range(len(names))])
    matrix = np.eye(len(names))
    for i, j in pairs:
        spread = (found[f"d{i}_{j}"] or 0.0) * (found[f"d{j}_{i}"] or 0.0)
        matrix[i, j] = matrix[j, i] = found[f"c{i}_{j}"] / spread if spread else 0.0
    live = dev > 0
    loading = np.zeros(len(names))
    if live.any():
        _, vectors = np.linalg.eigh(matrix[np.ix_(live, live)])
        loading[live] = vectors[:, -1]
    turned = loading * np.array([directions[c] for c in names])
    return mean, dev, loading if turned.sum() >= 0 else -loading


def fuse(items: DataFrame, group: Sequence[str], item: str, directions: Mapping[str, int]) -> DataFrame:
    """Items with ``fused`` (the projection) and ``place`` (1 is best) within each group.

    ``directions`` has +1 for a score where more is better, -1 where less is. An unknown score stands in the middle of
    its ranks, so one known score never weighs as much as several; an item without any gets 0. Ties are ordered by
    ``item``. Whole repeated rows are ranked like any other; no items give no rows.
    """
    names = list(directions)
    ranked, _ = written(mid_ranks(items.select(*group, item, *names), names), "ranked")
    mean, dev, loading = first_component(ranked, directions)
    top = F.lit(0.0)
    for i, c in enumerate(names):
        if dev[i] > 0:
            top = top + F.coalesce((F.col(c) - float(mean[i])) / float(dev[i]) * float(loading[i]), F.lit(0.0))
    fused = F.round(top, 9)
    scored = ranked.select(*group, item, fused.alias("fused"))
    return running_total(scored, list(group), [F.col("fused").desc(), F.col(item).asc()], F.lit(1).cast("long"), "place")


def seconds(column: str) -> F.Column:
    """A unix time in seconds, whatever unit a client sent: milli-, micro- and nanoseconds are told by their size."""
    c = F.col(column).cast("double")
    return F.when(c > 1e17, c / 1e9).when(c > 1e14, c / 1e6).when(c > 1e11, c / 1e3).otherwise(c)


def search_items(picks: DataFrame, signals: DataFrame) -> DataFrame:
    """The items to rank: each path picked by a user for a query, with that user's signals for the path.

    Repeated rows count once. A pick without a count is no evidence of a pick and ranks as 0. A last opening later than
    the latest pick of all (and a day) comes from a wrong clock and counts as unknown, as do zeros and negatives.
    """
    now = picks.agg(F.max(seconds("last_unix")).alias("t")).collect()[0]["t"]
    one = (
        signals.groupBy("user_id", "path")
            .agg(F.max("opens").alias("opens"), F.max("score").alias("score"), F.max(seconds("last_open_unix")).alias("opened"))
    )
    opened = (
        F.when((F.col("opened") > 0) & (F.col("opened") <= F.lit(now) + 86400), F.col("opened"))
        if now is not None
        else F.when(F.col("opened") > 0, F.col("opened"))
    )
    mine = picks.groupBy("user_id", "query_norm", "path").agg(F.coalesce(F.max("pick_count"), F.lit(0)).alias("pick_count"))
    return (
        mine.join(one, ["user_id", "path"], "left").select("user_id", "query_norm", "path", "pick_count", "opens", "score", opened.alias("last_open"))
    )


def rank_paths(picks: DataFrame, signals: DataFrame) -> DataFrame:
    """One order of paths per (user_id, query_norm): user_id, query_norm, path, fused, place."""
    return fuse(search_items(picks, signals), ["user_id", "query_norm"], "path", {"opens": 1, "score": 1, "last_open": 1, "pick_count": 1})
