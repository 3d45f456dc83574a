"""Change feed, incremental runs, orphan references, hierarchies and bitmaps against brute force and odd input."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import session
from spindrift.operators import changefeed, hierarchy, incremental, ordering, references
from spindrift.operators.bitmaps import Bitmap

FEED = "volume string, frn long, checkpoint_usn long, feed_cursor long, deleted boolean, path string, s string"
T0 = datetime(2026, 1, 1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bitmaps_are_sets():
    r = np.random.default_rng(1)
    for n, m in ((10, 20), (6000, 50), (50, 6000), (20_000, 30_000)):
        a, b = set(r.integers(0, 1 << 16, n).tolist()), set(r.integers(0, 1 << 16, m).tolist())
        x, y = Bitmap.of(np.array(sorted(a))), Bitmap.of(np.array(sorted(b)))
        assert set((x | y).members().tolist()) == a | b and set(x.and_not(y).members().tolist()) == a - b


def test_feed_gives_the_latest_state_whatever_the_order(spark):
    r = random.Random(2)
    data = []
    for i in range(400):
        data.append(
            (
                r.choice(["C:", "D:"]), r.choice([1, 2, 3, 4, 0, None]), r.randint(1, 9) if r.random() < 0.95 else None, i, r.random() < 0.3, f"p{i}",
                "clash"
            )
        )
    data += r.sample(data, 100)  # delivered again
    r.shuffle(data)
    want = {}
    for v, f, u, c, d, *_ in data:
        if f and (v, f) not in want or f and ((u is not None, u or 0), c) > ((want[v, f][0] is not None, want[v, f][0] or 0), want[v, f][1]):
            want[v, f] = (u, c, d)
    got = rows_of(changefeed.current_files(spark.createDataFrame(data, FEED)))
    assert got == sorted(((v, f, u, c) for (v, f), (u, c, d) in want.items() if not d), key=repr)
    assert changefeed.current_files(spark.createDataFrame([], FEED)).count() == 0


def test_feed_in_batches_equals_the_feed_at_once_and_again(spark):
    data = [("C:", i % 7 + 1, i, 0, i % 3 == 0, f"p{i}", None) for i in range(60)]
    df = spark.createDataFrame(data, FEED)
    at = changefeed.EqualityDeleteTable.fresh(spark, ["volume", "frn"], ["checkpoint_usn", "feed_cursor"])
    for part in (df.where("checkpoint_usn >= 30"), df.where("checkpoint_usn < 30"), df.where("checkpoint_usn < 10")):
        at.append(part, "deleted", ["path"])
    once = changefeed.current_files(df, ["path"])
    assert rows_of(at.read()) == rows_of(once.select(*at.read().columns))


RUNS = "run_id long, volume string, source string, journal_id long, checkpoint_usn long, state string, built_at timestamp, last_persist timestamp, o string"
PRINTS = "run_id long, volume string, frn long, print_size long, print_mod long, usn long, seen_at timestamp, mode string, opened boolean"


def _world(spark):
    day = lambda n: T0 + timedelta(days=n)
    runs = [
        (1, "C:", "usn", 7, 100, "ready", day(1), day(1), "x"), (2, "C:", "usn", 7, 200, "ready", day(2), None, "x"),
        (3, "C:", "usn", 7, 300, "replaying", day(3), None, "x"), (3, "C:", "usn", 7, 300, "replaying", day(3), None, "x")
    ]
    runs += [(4, "D:", "usn", 7, 100, "ready", day(1), day(1), ""), (5, "D:", "usn", 8, 1, "replaying", day(2), None, "")]  # journal replaced
    runs += [
        (6, "W:", "walk", None, None, "ready", day(1), day(1), None), (7, "W:", "walk", None, None, "error", day(2), None, None),
        (8, "W:", "walk", None, None, "replaying", day(3), None, None)
    ]
    runs += [(9, "N:", "usn", 7, 5, "replaying", day(1), None, None)]
    prints = [
        (3, "C:", 1, 1, 1, 99, day(3)), (3, "C:", 1, 1, 1, 100, day(2)), (3, "C:", 2, 1, 1, 100, day(3)), (3, "C:", 3, None, None, None, day(3)),
        (2, "C:", 4, 1, 1, 500, day(2))
    ]
    prints += [(5, "D:", 1, 1, 1, 0, day(2)), (9, "N:", 1, 1, 1, 0, day(2))]
    prints += [
        (6, "W:", 1, 5, 5, None, day(1)), (8, "W:", 1, 5, 5, None, day(3)), (6, "W:", 2, 5, 5, None, day(1)), (7, "W:", 2, 6, 5, None, day(2)),
        (8, "W:", 2, 6, 5, None, day(3)), (8, "W:", 3, 1, 1, None, day(3)), (6, "W:", 4, None, 1, None, day(1)), (8, "W:", 4, None, 1, None, day(3))
    ]
    return spark.createDataFrame([(*p, "m", True) for p in prints], PRINTS), spark.createDataFrame(runs, RUNS)


WANT = [("C:", 2), ("C:", 3), ("D:", 1), ("N:", 1), ("W:", 2), ("W:", 3)]


def test_incremental_finds_new_and_changed_files(spark):
    prints, runs = _world(spark)
    job = incremental.IncrementalJob(spark)
    job.run(0, prints, runs)
    assert rows_of(job.read().select("volume", "frn")) == WANT
    job.run(0, prints, runs)  # done already
    job.run(1, prints, runs)  # delivered again in another batch
    assert rows_of(job.read().select("volume", "frn")) == WANT


def test_a_failed_run_is_replayed_from_its_written_plan(spark):
    prints, runs = _world(spark)
    job = incremental.IncrementalJob(spark)
    first = rows_of(job.plan(0, runs))
    with pytest.raises(Exception):
        job.run(0, prints.withColumn("usn", F.expr("raise_error('lost')").cast("long")), runs)
    assert job.read().count() == 0  # nothing of a failed batch is seen
    later = runs.where("state <> 'ready'")  # the runs have moved on; the plan of the batch has not
    job.run(0, prints, runs)
    assert rows_of(job.plan(0, later)) == first and rows_of(job.read().select("volume", "frn")) == WANT


@pytest.mark.parametrize("crash", ["planned", "half written", "not marked", None])
def test_three_batches_over_a_replaced_journal(spark, crash):
    """Whatever step a batch dies behind, the row of the later journal holds, though its change numbers are smaller."""
    day = lambda n: T0 + timedelta(days=n)
    runs = [(1, "C:", "usn", 7, 9000), (2, "C:", "usn", 8, 11), (3, "C:", "usn", 8, 20)]
    prints = spark.createDataFrame(
        [
            (1, "C:", 1, 1, 1, 9000, day(1), "m", True), (1, "C:", 2, 1, 1, 9001, day(1), "m", True), (2, "C:", 1, 2, 2, 10, day(2), "m", True),
            (3, "C:", 1, 2, 2, 10, day(3), "m", True), (3, "C:", 2, 3, 3, 20, day(3), "m", True)
        ],
        PRINTS
    )
    job = incremental.IncrementalJob(spark)
    for k in range(3):
        state = lambda i: "ready" if i < k else "replaying"  # noqa: B023, E731
        known = spark.createDataFrame([(*r, state(i), day(r[0]), day(r[0]) if i < k else None, "") for i, r in enumerate(runs[: k + 1])], RUNS)
        if crash == "planned":
            job.plan(k, known)
        elif crash == "half written":
            with pytest.raises(Exception):
                job.run(k, prints.withColumn("usn", F.expr("raise_error('lost')").cast("long")), known)
        elif crash == "not marked":
            job.run(k, prints, known)
            session.remove(spark, f"{job.path}/batches/{k}/_SUCCESS")
            assert rows_of(job.read().where(f"batch = {k}")) == []
        job.run(k, prints, known)
        job.run(k, prints, known)
    assert rows_of(job.read().select("frn", "journal_id", "usn", "print_size", "batch")) == [(1, 8, 10, 2, 1), (2, 8, 20, 3, 2)]


def test_incremental_on_nothing(spark):
    prints, runs = _world(spark)
    job = incremental.IncrementalJob(spark)
    job.run(0, prints.where("false"), runs.where("false"))
    assert job.read().count() == 0


PARENTS = "space string, key long, period string, deleted boolean, version long"
REFS = "space string, key long, period string, row_id long, gone boolean"


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_orphans_like_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(references, "BLOCK_ROWS", block)
    r = random.Random(3)
    pick = lambda n: (r.choice(["C:", "D:", None]), r.choice([None, *range(n)]), r.choice(["2026-01", "2026-02", "2026-03", None]))
    parents = [(*pick(40), r.choice([True, False, None]), i) for i in range(80)]
    refs = [(*pick(50), i, True) for i in range(300)] + [("C:", 7, "2026-02", 1000 + i, None) for i in range(150)]  # a hot key
    refs += refs[:50]

    def orphan(s, k, p):
        held = [(q, v, d) for t, j, q, d, v in parents if (t, j) == (s, k) and q is not None and q <= p]
        return not held or bool(max(held, key=lambda x: (x[0], x[1]))[2])

    want = sorted({x for x in refs if None not in x[:3] and orphan(*x[:3])}, key=repr)
    got = references.orphan_rows(spark.createDataFrame(parents, PARENTS), spark.createDataFrame(refs, REFS))
    assert rows_of(got) == want
    nothing = spark.createDataFrame([], PARENTS)
    assert references.orphan_rows(nothing, spark.createDataFrame(refs, REFS)).count() == len({x for x in refs if None not in x[:3]})
    assert references.orphan_rows(nothing, spark.createDataFrame([], REFS)).count() == 0


RECORDS = "row_id long, volume string, frn long, parent_frn long, name string, deleted boolean, scan_month string, received_at timestamp, cycle long"


def _brute(nodes):
    """(volume, frn) -> (path or None, depth, top, cycle) by walking."""
    out = {}
    for n in nodes:
        chain, at = [n], n
        while True:
            p = (at[0], nodes[at][0])
            if nodes[at][0] is None or p not in nodes:
                out[n] = ("\\".join(nodes[x][1] for x in reversed(chain)), len(chain) - 1, at[1], None)
                break
            if p in chain:
                out[n] = (None, None, None, min(x[1] for x in chain[chain.index(p) :]))
                break
            chain.append(p)
            at = p
    return out


@pytest.mark.parametrize("split,local", [(3, 0), (3, 1 << 20), (1000, 0)])
def test_hierarchies_like_brute_force(spark, split, local, monkeypatch):
    """With many splitters, few, and none at all, solved in one task and by rounds; deep chains, wide folders, circles of all sizes, gaps and deletions."""
    monkeypatch.setattr(hierarchy, "SPLIT", split)
    monkeypatch.setattr(hierarchy, "LOCAL", local)
    r = random.Random(4)
    rows, n = [], 0

    def add(v, frn, parent, deleted=False, month="2026-01"):
        nonlocal n
        n += 1
        rows.append((n, v, frn, parent, None if frn == 5 else f"n{frn}", deleted, month, T0, 0))

    add("C:", 1, None)
    for i in range(2, 60):
        add("C:", i, i - 1)  # a chain
    for i in range(60, 100):
        add("C:", i, r.randint(1, i - 1))
    for i in range(100, 140):
        add("C:", i, 30)  # a wide folder
    for base, size in ((200, 1), (210, 2), (220, 17)):
        for i in range(size):
            add("C:", base + i, base + (i + 1) % size)
        for i in range(3):
            add("C:", base + 500 + i, base if not i else base + 499 + i)
    add("C:", 300, 999)  # parent missing
    add("C:", 301, 300)
    add("C:", 302, 0)
    add("C:", 303, 302)
    add("C:", 302, 0, True, "2026-02")  # deleted later
    add("D:", 1, 2)
    add("D:", 2, 1)
    add("D:", 2, None, False, "2026-03")  # the newest row breaks the circle
    rows += rows[:20]
    rows.append((0, None, 1, None, "x", False, "2026-01", T0, 0))
    df = spark.createDataFrame(rows, RECORDS)
    latest = {}
    for _, v, f, p, name, d, m, *_ in rows:
        if v and ((v, f) not in latest or m >= latest[v, f][3]):
            latest[v, f] = (p or None, name or "", d, m)
    want = _brute({k: x for k, x in latest.items() if not x[2]})
    above = {k: 0 for k in want}
    for (v, f), (_, _, _, c) in want.items():
        at = (v, f)
        while c is None and latest[at][0] is not None and (v, latest[at][0]) in want:
            at = (v, latest[at][0])
            above[at] += 1
    rows_found = hierarchy.tree(df).collect()
    got = {(x["volume"], x["frn"]): (x["path"], x["depth"], x["root_frn"], x["cycle_frn"]) for x in rows_found}
    assert got == want
    assert {(x["volume"], x["frn"]): x["n_descendants"] for x in rows_found} == {k: n if want[k][3] is None else None for k, n in above.items()}
    assert {(x["volume"], x["frn"]): x["status"] for x in rows_found if x["root_frn"] == 300} == {("C:", 300): "missing", ("C:", 301): "missing"}
    circles = sorted((v, f, c[3]) for (v, f), c in want.items() if c[3] is not None)
    assert rows_of(hierarchy.circles(df)) == circles
    if local:
        found = {(x["volume"], x["frn"]): x for x in hierarchy.intervals(df).collect()}
        assert set(found) == {k for k, x in want.items() if x[3] is None}
        for k, x in found.items():
            below = {j for j, y in found.items() if j[0] == k[0] and y["root_frn"] == x["root_frn"] and x["first"] < y["first"] <= x["last"]}
            assert len(below) == above[k] and all(want[j][0].startswith(want[k][0] + "\\") for j in below)


def test_a_chain_of_a_hundred_thousand(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "LOCAL", 10_000)
    n = 100_000
    chain = (
        spark.range(1, n + 1)
            .selectExpr(
                "id as row_id", "'C:' as volume", "id as frn", "nullif(id - 1, 0) as parent_frn", "'x' as name", "false as deleted",
                "'2026-01' as scan_month", "timestamp '2026-01-01' as received_at"
            )
    )
    got = hierarchy.tree(chain, paths=False).where(f"depth = frn - 1 and root_frn = 1 and n_descendants = {n} - frn").count()
    assert got == n
    ring = chain.withColumn("parent_frn", F.expr(f"if(frn = 1, {n}, frn - 1)"))
    assert hierarchy.circles(ring).where("cycle_frn = 1").count() == n


def test_descendants_count_what_pairs_list(spark):
    rows = [(i, "C:", i, i // 2 or None, f"n{i}", False, "2026-01", T0, 0) for i in range(1, 40)]
    df = spark.createDataFrame(rows, RECORDS)
    pairs = hierarchy.descendants(df).collect()
    counts = {x["frn"]: x["n_descendants"] for x in hierarchy.tree(df).collect()}
    for f in range(1, 40):
        assert counts[f] == sum(p["frn"] == f for p in pairs)
    assert all(p["distance"] == 1 or p["descendant_frn"] // 2 != p["frn"] for p in pairs)


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], RECORDS)
    assert hierarchy.tree(empty).count() == 0 and hierarchy.circles(empty).count() == 0 and hierarchy.descendants(empty).count() == 0


def test_running_totals_over_hot_groups(spark):
    r = random.Random(5)
    data = [("hot" if r.random() < 0.7 else r.choice(["a", None]), i, r.randint(0, 9)) for i in range(500)]
    got = (
        ordering.running_total(spark.createDataFrame(data, "g string, i long, w long").repartition(4), ["g"], [F.col("i")], F.col("w"), "t").collect()
    )
    total = {}
    for g, i, w in sorted(data, key=lambda x: x[1]):
        total[g] = total.get(g, 0) + w
        assert next(x["t"] for x in got if x["i"] == i) == total[g]
