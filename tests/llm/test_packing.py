import random

import pytest

from spindrift.llm import packing


def naive(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        i = next((i for i, r in enumerate(rooms) if r >= s), None)
        if i is None:
            rooms.append(capacity)
            i = len(rooms) - 1
        rooms[i] -= s
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tree_places_like_first_fit(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(0, 100) for _ in range(r.randint(0, 300))), reverse=True)
    assert packing.first_fit_decreasing(sizes, 100) == naive(sizes, 100)


def test_containers_hold_everything_once(spark):
    r = random.Random(9)
    items = [(i, r.choice([None, 0, -5, r.randint(1, 300), 1000, 2500]), "clash") for i in range(500)] + [(None, 5, "x")]
    df = spark.createDataFrame(items + items[:50], "doc_id long, n_tokens long, container string")
    configs = spark.createDataFrame([(1, 1000), (2, 300), (2, 300), (3, 0), (4, None)], "pack_id long, capacity long")
    got = packing.pack(df, configs, group_size=100).toPandas()
    for pack, capacity in ((1, 1000), (2, 300)):
        own = got[got["pack_id"] == pack]
        assert own.groupby("container")["tokens"].sum().max() <= capacity
        sizes = own.groupby("doc_id")["tokens"].sum()
        assert sizes.to_dict() == {i: max(0, n or 0) for i, n, _ in items if i is not None}
        parts = own.groupby("doc_id").size()
        assert all(parts[i] == max(1, -(-max(0, n or 0) // capacity)) for i, n, _ in items if i is not None)
    assert set(got["pack_id"]) == {1, 2}
    assert packing.pack(df.where("false"), configs).count() == 0
