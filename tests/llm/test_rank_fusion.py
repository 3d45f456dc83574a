from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from spindrift.llm import rank_fusion

DATA = "/root/testdata/sf0.1"
PICKS = "user_id string, query_norm string, path string, pick_count long, last_unix long, score double"
SIGNALS = "user_id string, path string, opens long, score double, last_open_unix long, place long"


def test_no_range_dominates_and_directions_hold(spark):
    r = np.random.default_rng(1)
    quality = r.normal(size=300)
    rows = pd.DataFrame(
        {
            "g": "q", "item": [f"i{i:03}" for i in range(300)], "a": quality + r.normal(size=300) * 0.3,
            "b": np.exp(9 * (quality + r.normal(size=300) * 0.3)), "c": -quality + r.normal(size=300) * 0.3
        }
    )
    out = rank_fusion.fuse(spark.createDataFrame(rows), ["g"], "item", {"a": 1, "b": 1, "c": -1}).toPandas().sort_values("item")
    assert np.corrcoef(out["place"], pd.Series(-quality).rank())[0, 1] > 0.95
    assert sorted(out["place"]) == list(range(1, 301))
    ranks = rows[["a", "b", "c"]].rank() / 300
    z = (ranks - ranks.mean()) / ranks.std(ddof=0)
    load = np.linalg.eigh(np.corrcoef(ranks.T))[1][:, -1]
    load = load * np.sign(load[0])
    assert np.allclose(out["fused"], (z @ load) / (load**2).sum(), atol=1e-6)


def test_ties_gaps_constants_and_repeats(spark):
    rows = [
        ("g1", "x", 1.0, None, 5.0), ("g1", "y", 1.0, None, 5.0), ("g1", "y", 1.0, None, 5.0), ("g2", "z", None, None, 5.0),
        (None, "w", 3.0, float("nan"), 5.0)
    ]
    out = (
        rank_fusion.fuse(spark.createDataFrame(rows, "g string, item string, a double, b double, c double"), ["g"], "item", {"a": 1, "b": 1, "c": 1})
            .collect()
    )
    assert sorted((r["g"] or "", r["item"], r["place"]) for r in out) == [
        ("", "w", 1), ("g1", "x", 1), ("g1", "y", 2), ("g1", "y", 3), ("g2", "z", 1)
    ]
    assert next(r["fused"] for r in out if r["item"] == "z") == 0.0
    none = spark.createDataFrame([], "g string, item string, a double")
    assert rank_fusion.fuse(none, ["g"], "item", {"a": 1}).count() == 0


def test_paths_with_wrong_units_and_clocks(spark):
    now = 1_780_000_000
    picks = [("u", "q", f"p{i}", i or None, now, 0.0) for i in range(6)] + [("u", "q", "p1", 1, now, 0.0)]
    signals = (
        [("u", f"p{i}", i, float(i), (now - (6 - i) * 86400) * (1000 if i == 5 else 1), 9) for i in range(6)] + [("u", "p0", 0, None, now * 2, 9)]
    )
    out = rank_fusion.rank_paths(spark.createDataFrame(picks, PICKS), spark.createDataFrame(signals, SIGNALS)).toPandas().sort_values("place")
    assert out["path"].tolist() == ["p5", "p4", "p3", "p2", "p1", "p0"]


def test_one_known_score_weighs_less_than_several(spark):
    rows = [("g", f"i{k:02}", float(k), float(k), float(k)) for k in range(20)] + [("g", "one", 99.0, None, None)]
    out = (
        rank_fusion.fuse(spark.createDataFrame(rows, "g string, item string, a double, b double, c double"), ["g"], "item", {"a": 1, "b": 1, "c": 1})
            .toPandas()
            .set_index("item")
    )
    assert out["place"]["i19"] == 1 and out["place"]["one"] > out["place"]["i16"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_judged_picks_are_in_better_order_than_by_any_single_score(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    keys = ["user_id", "query_norm", "path"]
    items = rank_fusion.search_items(read("query_picks"), read("file_signals")).toPandas()
    fused = rank_fusion.rank_paths(read("query_picks"), read("file_signals")).toPandas()[[*keys, "fused"]]
    judged = read("rank_labels").toPandas().merge(items, on=keys, how="left").merge(fused, on=keys, how="left")

    def in_order(column):
        right = pairs = 0.0
        for _, g in judged.groupby(keys[:2]):
            x, y = g[column].fillna(-1e9).to_numpy(float), g["grade"].to_numpy()
            better = y[:, None] > y[None, :]
            sign = np.sign(x[:, None] - x[None, :])[better]
            right, pairs = right + (sign > 0).sum() + 0.5 * (sign == 0).sum(), pairs + better.sum()
        return right / pairs

    assert in_order("fused") > 0.03 + max(in_order(c) for c in ("opens", "score", "last_open", "pick_count"))
