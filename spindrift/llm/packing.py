"""Filling containers of fixed capacity with texts: first-fit decreasing over a tournament tree of free room.

Items are dealt by a hash of their id into groups of about ``GROUP`` items - at random as far as sizes go - and every
group is packed by itself, so the work is linear in the data and a group always fits a task. The tree's leaves are the
containers in order, its inner nodes the most room below them: the first container that an item fits is found by
walking down from the top.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one group, on average.
GROUP = 4096


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The container of each item (numbered from 0); every size is at most ``capacity``, and sizes fall."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * width)
    out = []
    for size in sizes:
        at = 1
        while at < width:
            at *= 2
            if room[at] < size:
                at += 1
        out.append(at - width)
        room[at] -= size
        while at > 1:
            at >>= 1
            a, b = room[2 * at], room[2 * at + 1]
            most = a if a > b else b
            if room[at] == most:
                break
            room[at] = most
    return out


def _pieces(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, part, size and whether it fills a container alone: only an item above the capacity is split."""
    parts = np.maximum(1, -(-sizes // capacity))
    owner = np.repeat(np.arange(len(ids)), parts)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(capacity, sizes[owner] - part * capacity)
    return ids[owner], part, size, owner


def _pack(group: int, ids: np.ndarray, sizes: np.ndarray, configs: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
    for pack, capacity in configs:
        doc, part, size, _ = _pieces(ids, sizes, capacity)
        order = np.lexsort((part, doc, -size))
        doc, part, size = doc[order], part[order], size[order]
        where = np.asarray(first_fit_decreasing(size.tolist(), capacity), np.int64) if len(size) else np.zeros(0, np.int64)
        yield pd.DataFrame(
            {"pack_id": pack, "container": (np.int64(group) << 32) + where, "doc_id": doc, "part": part.astype(np.int32), "tokens": size}
        )


def pack(items: DataFrame, configs: DataFrame, group_size: int = GROUP) -> DataFrame:
    """Every item (doc_id, n_tokens) placed once per config (pack_id, capacity): pack_id, container, doc_id, part, tokens.

    A null or negative size counts as 0; items without an id are left out; configs without a positive capacity give no
    rows. Repeated items are placed once, at their greatest size. ``configs`` is a table of parameters and is read to
    the driver. No items give no rows.
    """
    wanted = sorted(
        (r["pack_id"], r["capacity"])
        for r in configs.where("pack_id is not null and capacity > 0").select("pack_id", "capacity").distinct().collect()
    )
    sized = items.where("doc_id is not null").select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    groups = max(1, math.ceil(sized.count() / group_size))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.groupby("doc_id", as_index=False)["n_tokens"].max()
        made = list(_pack(int(key[0]), one["doc_id"].to_numpy(), one["n_tokens"].to_numpy(), wanted))
        return pd.concat(made) if made else pd.DataFrame({"pack_id": [], "container": [], "doc_id": [], "part": [], "tokens": []})

    dealt = sized.withColumn("_group", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, "pack_id long, container long, doc_id long, part int, tokens long")
