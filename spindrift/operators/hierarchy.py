"""Parent-child rows to full hierarchies: path, depth, root and descendants of every node, and the circles.

Only nodes that are a parent to something take part in the search; the leaves look their parent up at the end.

1. A hash of the key makes about one node in ``SPLIT`` a splitter. Nodes without a node above them are tops.
2. Every node walks to its next splitter or top by pointer jumping, four times as far in every round, carrying what
   lies on the way. The expected walk is ``SPLIT`` long whatever the depth of the tree, so rounds are few, and each
   moves and rewrites only what still walks.
3. Walks that don't arrive lie on or below a circle without a splitter. They go on alone until no walk arrives any
   more and they have made as many steps as there are nodes left; what then still walks, circles.
4. The splitters form a reduced graph, ``SPLIT`` times smaller. It is solved the same way with another hash, level by
   level, until one task can hold it (``LOCAL`` nodes); both ways give the same.
5. Every node puts its own stretch behind what its splitter found. Descendants are counted from below: a node counts
   for those on its own stretch, a splitter with all that is below it.

The state of each round is a table in the shared folder, so plans stay short and a lost executor loses no lineage; the
tables are removed when they have been read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spindrift.operators.ordering import running_total
from spindrift.session import Scratch

#: One node in how many is a splitter; nodes of a reduced graph, or of circles without a splitter, that one task solves.
SPLIT, LOCAL = 8, 1 << 20
#: Where a walk stands: it goes on, it is at a splitter, it is at a top (or where a node of a reduced graph leaves it).
WALKS, SPLITTER, TOP = 0, 1, 2
_TYPES = {
    "v": "string", "id": "long", "ptr": "long", "hops": "long", "low": "long", "miss": "boolean", "state": "int", "weight": "long", "seg": "string",
    "chain": "array<long>", "between": "array<long>"
}


def newest(records: DataFrame) -> DataFrame:
    """The newest row of every (volume, frn) by scan_month, then arrival; rows that are deleted or name no file are left out."""
    best = (
        records.where("volume is not null and frn is not null")
            .groupBy("volume", "frn")
            .agg(
                F.max(F.struct("scan_month", "received_at", "row_id", F.coalesce("deleted", F.lit(False)).alias("deleted"), "parent_frn", "name"))
                    .alias("r")
            )
    )
    return (
        best.where("not r.deleted")
            .select(
                F.col("volume").alias("v"), F.col("frn").alias("id"), F.when(F.col("r.parent_frn") != 0, F.col("r.parent_frn")).alias("parent"),
                F.coalesce(F.col("r.name"), F.lit("")).alias("name")
            )
    )


def _splitter(key: str, level: int) -> str:
    return f"(pmod(xxhash64({level}, v, {key}), {SPLIT}) = 0)"


def _on(left: str, v: str, right: str) -> Column:
    return F.expr(f"v = {v} and {left} = {right}")


class _Walk:
    """Pointer jumping with the finished walks kept apart, in one table per round."""

    def __init__(self, start: DataFrame, level: int, columns: list[str], scratch: Scratch):
        self.columns, self.level, self.scratch = columns, level, scratch
        self.parts: list[DataFrame] = []
        self.before, self.splitters = -1, 0
        self._keep(start)
        while self.left and not (self.left == self.before and 4 ** (len(self.parts) - 1) >= self.left):
            if self.left == self.before and self.left <= LOCAL:
                break  # only circles are left
            self.before = self.left
            self._round()

    def _keep(self, rows: DataFrame) -> None:
        seen = Observation()
        counted = rows.observe(
            seen, F.expr(f"count_if(state = {WALKS})").alias("left"),
            F.expr(f"count_if({_splitter('id', self.level)} and state <> {WALKS})").alias("splitters")
        )
        self.parts.append(self.scratch.keep(counted, "walk", ["state"]).select(*self.columns))
        self.left = seen.get["left"]
        self.splitters += seen.get["splitters"]

    @property
    def walking(self) -> DataFrame:
        return self.parts[-1].where(f"state = {WALKS}")

    def finished(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.where(f"state <> {WALKS}") for x in self.parts])

    def _round(self) -> None:
        there = self.finished().unionByName(self.walking).selectExpr(*[f"{c} as t_{c}" for c in self.columns if c != "weight"])
        went = {
            "ptr": "t_ptr", "hops": "hops + t_hops", "low": "least(low, t_low)", "miss": "t_miss", "state": "t_state", "seg": "concat(t_seg, seg)", "chain": "concat(t_chain, chain)",
            "between": "concat(t_between, if(t_ptr = ptr, cast(array() as array<long>), array(ptr)), between)",
        }
        moved = [f"if(state = {WALKS}, {went[c]}, {c}) as {c}" if c in went else c for c in self.columns]
        rows = self.walking
        for _ in range(3):  # each stretch is the one of the round before: three more make four times as far
            rows = rows.join(there, F.expr(f"v = t_v and if(state = {WALKS}, ptr, id) = t_id")).selectExpr(*moved)
        self._keep(rows)

    def circling(self) -> DataFrame:
        """(v, id, cycle) of what never arrives: its pointer lies on the circle and has seen all of it."""
        if self.left <= LOCAL:
            return _local(self.walking.select("v", "id", "ptr", "hops", "low"), ["v", "id", "cycle"])
        on = self.walking.select(F.col("v").alias("tv"), F.col("id").alias("tid"), F.col("low").alias("cycle"))
        return self.walking.join(on, _on("ptr", "tv", "tid")).select("v", "id", "cycle")


def _solve_in_memory(rows: pd.DataFrame) -> pd.DataFrame:
    """End, hops, circle and carried columns of every node of a graph of pointers; what leaves the graph ends there."""
    n = len(rows)
    at = pd.Series(np.arange(n), index=pd.MultiIndex.from_frame(rows[["v", "id"]]))
    leaves = rows["leaves"].to_numpy(bool) if "leaves" in rows else np.zeros(n, bool)
    found = at.reindex(pd.MultiIndex.from_arrays([rows["v"], rows["ptr"]])).to_numpy()
    above = np.where(leaves | np.isnan(found), np.arange(n), np.nan_to_num(found)).astype(np.int64)
    # what ends here points at itself, over a stretch of no steps
    ends = leaves | np.isnan(found)
    own = rows["hops"].to_numpy(np.int64)
    ptr, hops, low, steps = above.copy(), np.where(ends, 0, own), rows["low"].to_numpy(np.int64), (~ends).astype(np.int64)
    for _ in range(max(1, int(n).bit_length())):
        low, hops, steps, ptr = np.minimum(low, low[ptr]), hops + hops[ptr], steps + steps[ptr], ptr[ptr]
    circles = ~ends[ptr]
    out = pd.DataFrame({"v": rows["v"], "id": rows["id"]})
    out["end"] = pd.arrays.IntegerArray(rows["ptr"].to_numpy(np.int64)[ptr], circles)
    out["hops"] = hops + own[ptr]
    out["cycle"] = pd.arrays.IntegerArray(low[ptr], ~circles)
    out["miss"] = rows["miss"].iloc[ptr].to_numpy() if "miss" in rows else False
    order = np.argsort(steps, kind="stable")
    order = order[~circles[order]]
    for c in ("seg", "chain"):
        if c in rows:
            whole = rows[c].tolist()
            for i in order.tolist():
                if not ends[i]:
                    whole[i] = whole[above[i]] + whole[i] if c == "seg" else [*whole[above[i]], *whole[i]]
            out[c] = whole
    if "weight" in rows:
        own_weight = rows["weight"].fillna(0).to_numpy(np.int64)
        below = own_weight.copy()
        for i in order[::-1].tolist():
            if not ends[i]:
                below[above[i]] += below[i]
        out["weight"] = below - own_weight
    return out


def _local(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``_solve_in_memory`` in one task; callers have checked the number of rows."""
    types = _TYPES | {"end": "long", "cycle": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            found = _solve_in_memory(pa.Table.from_batches(held).to_pandas())
            yield pa.RecordBatch.from_pandas(found[columns], schema=schema, preserve_index=False)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c, kinds[types[c]]) for c in columns])
    return rows.repartition(1).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns))


def _solve(start: DataFrame, level: int, carried: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every node with the end of its path: v, id, end, hops, cycle, miss[, seg, chain, weight], and the lost: v, id, cycle.

    ``start`` has a walk's columns; its rows stand at their first step. ``weight`` becomes the weight of all nodes
    below. Nodes that circle have no end.
    """
    columns = list(dict.fromkeys(["v", "id", "ptr", "hops", "low", "miss", "state", *carried]))
    walk = _Walk(start.selectExpr(*columns), level, columns, scratch)
    lost = scratch.keep(walk.circling(), "lost") if walk.left else None
    arrived = walk.finished()
    shown, weights = [c for c in ("seg", "chain") if c in carried], "weight" in carried
    ends = lost.selectExpr("v as lv", "id as lid", "cycle as l_cycle") if lost is not None else None
    solved = None
    if walk.splitters:
        solved = _solve_splitters(walk, arrived, ends, shown, weights, scratch)
        # rows that stand at a top look nothing up, and are kept from meeting in one partition
        placed = arrived.join(solved, F.expr(f"v = av and if(state = {SPLITTER}, ptr, id) = aid"), "left")
        by = f"state = {SPLITTER} and aid is not null"
        placed = placed.selectExpr(
            "v", "id", f"if({by}, a_end, ptr) as end", f"if({by}, hops + a_hops, hops) as hops", f"if({by}, a_cycle, null) as cycle",
            f"if({by}, a_miss, miss) as miss", *[f"if({by}, concat(a_{c}, {c}), {c}) as {c}" for c in shown]
        )
    else:
        placed = arrived.selectExpr("v", "id", "ptr as end", "hops", "cast(null as long) as cycle", "miss", *shown)
    if ends is not None:
        placed = placed.join(ends, _on("end", "lv", "lid"), "left").withColumn("cycle", F.expr("coalesce(cycle, l_cycle)"))
    placed = placed.selectExpr(
        "v", "id", *[f"if(cycle is null, {c}, null) as {c}" for c in ("end", "hops")], "cycle", "miss",
        *[f"if(cycle is null, {c}, null) as {c}" for c in shown]
    )
    if weights:
        # a node counts for those on its stretch (and the top that it reached), a splitter with all below it
        whole = arrived.selectExpr("*", "weight as mass")
        if solved is not None:
            whole = (
                arrived.join(solved.selectExpr("av", "aid", "a_weight"), _on("id", "av", "aid"), "left")
                    .selectExpr("*", "weight + coalesce(a_weight, 0) as mass")
            )
        spread = (
            whole.selectExpr("v as wv", f"explode(if(state = {TOP} and ptr <> id, concat(between, array(ptr)), between)) as wid", "mass")
                .groupBy("wv", "wid")
                .agg(F.sum("mass").alias("way"))
        )
        placed = placed.join(spread, _on("id", "wv", "wid"), "left")
        if solved is not None:
            placed = placed.join(solved.selectExpr("av as sv", "aid as sid", "a_weight"), _on("id", "sv", "sid"), "left")
        total = "coalesce(a_weight, way, 0)" if solved is not None else "coalesce(way, 0)"
        placed = placed.selectExpr("v", "id", "end", "hops", "cycle", "miss", *shown, f"{total} as weight")
    return placed, lost if lost is not None else arrived.where("false").selectExpr("v", "id", "cast(null as long) as cycle")


def _solve_splitters(walk: _Walk, arrived: DataFrame, ends: DataFrame | None, shown: list[str], weights: bool, scratch: Scratch) -> DataFrame:
    """The reduced graph, solved: av, aid, a_end, a_hops, a_cycle, a_miss[, a_seg, a_chain, a_weight]."""
    inner = arrived.where(_splitter("id", walk.level))
    if ends is not None:  # a splitter can stand below a circle that has none
        inner = inner.join(ends, _on("ptr", "lv", "lid"), "left").withColumn("state", F.expr(f"if(lid is not null, {TOP}, state)"))
    columns = ["v", "id", "end", "hops", "cycle", "miss", *shown, *(["weight"] if weights else [])]
    if weights:
        mass = arrived.where(f"state = {SPLITTER}").groupBy(F.expr("v as mv"), F.expr("ptr as mid")).agg(F.sum("weight").alias("mass"))
        inner = inner.drop("weight").join(mass, _on("id", "mv", "mid"), "left").withColumn("weight", F.expr("coalesce(mass, 0)"))
    inner = inner.select("v", "id", "ptr", "hops", "low", "miss", "state", *columns[6:])
    if walk.splitters <= LOCAL:
        solved = _local(inner.selectExpr("*", f"state = {TOP} as leaves").drop("state"), columns)
    else:
        standing = f"case when state = {TOP} then {TOP} when {_splitter('ptr', walk.level + 1)} then {SPLITTER} else {WALKS} end"
        below = inner.withColumn("state", F.expr(standing)).withColumn("between", F.expr("cast(array() as array<long>)"))
        solved, deeper = _solve(below, walk.level + 1, [*shown, *(["weight", "between"] if weights else [])], scratch)
        solved = solved.unionByName(deeper, allowMissingColumns=True).select(*columns)
    if weights:  # what is below a splitter: its own stretches, and what is below the splitters on them
        solved = solved.join(mass, _on("id", "mv", "mid"), "left").selectExpr(*columns[:-1], "coalesce(weight, 0) + coalesce(mass, 0) as weight")
    return scratch.keep(solved, "solved").selectExpr("v as av", "id as aid", *[f"{c} as a_{c}" for c in columns[2:]])


def forest(nodes: DataFrame, carried: tuple[str, ...] = (), hops: str | None = None) -> DataFrame:
    """Every node with its top, depth and circle: v, id, parent, top, miss, depth, cycle[, path, chain, below].

    ``nodes``: v, id, parent, name (and ``hops``, the steps from a node's parent, 1 if not given) with unique (v, id);
    a null parent makes a root. ``miss``: the topmost node names a parent that isn't there. A root has depth 0. On or
    below a circle ``cycle`` is the smallest id on it and the rest is null. ``carried`` may ask for ``path`` (the names
    from the top down, a synthetic ``.`` left out), ``chain`` (the ids from the top down to the node) and ``below``
    (how many nodes are below); without them no row grows with its depth. No nodes give no rows.
    """
    scratch = Scratch(nodes.sparkSession)
    step = F.col(hops).alias("step") if hops else F.lit(1).cast("long").alias("step")
    nodes = nodes.select("v", "id", "parent", "name", step)
    children = nodes.where("parent is not null").groupBy(F.col("v").alias("cv"), F.col("parent").alias("cid")).agg(F.count("*").alias("kids"))
    nodes = scratch.keep(
        nodes.join(children, _on("id", "cv", "cid"), "left")
            .select("v", "id", "parent", "name", "step", F.col("kids").isNotNull().alias("inner"), F.coalesce("kids", F.lit(0)).alias("kids")),
        "nodes", ["inner"]
    )
    inner = nodes.where("inner")
    up = inner.select(F.col("v").alias("pv"), F.col("id").alias("pid"))
    top = F.col("pid").isNull()
    name = F.when(F.col("name") == ".", "").otherwise(F.concat(F.lit("\\"), F.col("name")))
    none = F.array().cast("array<long>")
    columns = {"seg": name, "chain": F.array("id"), "weight": F.col("own"), "between": none}
    wanted = [{"path": "seg", "chain": "chain", "below": "weight"}[c] for c in carried]
    wanted += ["between"] if "weight" in wanted else []
    own = inner
    if "weight" in wanted:  # a folder counts for itself and its leaves
        folders = inner.where("parent is not null").groupBy(F.col("v").alias("fv"), F.col("parent").alias("fid")).agg(F.count("*").alias("folders"))
        own = (
            inner.join(folders, _on("id", "fv", "fid"), "left")
                .withColumn("n_leaves", F.col("kids") - F.coalesce("folders", F.lit(0)))
                .withColumn("own", F.col("n_leaves") + 1)
                .drop("fv", "fid", "folders")
        )
    linked = own.join(up, _on("parent", "pv", "pid"), "left")
    start = linked.select(
        "v", "id", F.when(top, F.col("id")).otherwise(F.col("pid")).alias("ptr"), F.when(top, 0).otherwise(F.col("step")).cast("long").alias("hops"),
        F.col("id").alias("low"), (top & F.col("parent").isNotNull()).alias("miss"),
        F.when(top, TOP).when(F.expr(_splitter("pid", 0)), SPLITTER).otherwise(WALKS).alias("state"), *[columns[c].alias(c) for c in wanted]
    )
    placed, lost = _solve(start, 0, wanted, scratch)
    dirs = placed.unionByName(lost, allowMissingColumns=True)
    facts = own.select(F.col("v").alias("ov"), F.col("id").alias("oid"), F.col("parent"), *([F.col("n_leaves")] if "weight" in wanted else []))
    dirs = dirs.join(facts, _on("id", "ov", "oid"))
    alive = F.col("cycle").isNull()
    shown = {"path": F.col("seg"), "chain": F.col("chain"), "below": F.when(alive, F.col("weight") + F.col("n_leaves"))} if carried else {}
    dirs = scratch.keep(
        dirs.select(
            "v", "id", "parent", F.col("end").alias("top"), F.when(alive, F.col("miss")).alias("miss"), F.col("hops").alias("depth"), "cycle",
            *[shown[c].alias(c) for c in carried]
        ),
        "dirs"
    )
    scratch.forget("walk", "lost", "solved")

    above = dirs.select(
        F.col("v").alias("dv"), F.col("id").alias("did"), *[F.col(c).alias(f"d_{c}") for c in ("top", "miss", "depth", "cycle", *carried)]
    )
    under = nodes.where("not inner").join(above, _on("parent", "dv", "did"), "left")
    alone = F.col("did").isNull()
    leaf = (
        {
            "path": F.when(alone, name).otherwise(F.concat("d_path", name)),
            "chain": F.when(alone, F.array("id")).otherwise(F.concat("d_chain", F.array("id"))),
            "below": F.when(F.col("d_cycle").isNull(), F.lit(0).cast("long"))
        }
        if carried
        else {}
    )
    rows = under.select(
        "v", "id", "parent", F.when(alone, F.col("id")).otherwise(F.col("d_top")).alias("top"),
        F.when(alone, F.col("parent").isNotNull()).otherwise(F.col("d_miss")).alias("miss"),
        F.when(alone, F.lit(0)).otherwise(F.col("d_depth") + F.col("step")).cast("long").alias("depth"), F.col("d_cycle").alias("cycle"),
        *[leaf[c].alias(c) for c in carried]
    )
    return dirs.unionByName(rows)


def circles(records: DataFrame) -> DataFrame:
    """The records whose chain of parents runs into a circle: volume, frn, cycle_frn."""
    found = forest(newest(records)).where("cycle is not null")
    return found.select(F.col("v").alias("volume"), F.col("id").alias("frn"), F.col("cycle").alias("cycle_frn"))


def tree(records: DataFrame, paths: bool = True) -> DataFrame:
    """Path, depth, root and number of descendants of every live file and folder.

    ``path`` joins the names from the top down (a root is named like its volume; a synthetic ``.`` is left out).
    ``status``: ``root`` (the chain ends at a root), ``missing`` (at a parent that isn't there; ``root_frn`` is the last
    node found) or ``circle`` (path, depth, root and descendants are null). Without ``paths`` nothing grows with depth.
    """
    found = forest(newest(records), ("path", "below") if paths else ("below",))
    status = F.when(F.col("cycle").isNotNull(), "circle").when(F.col("miss"), "missing").otherwise("root")
    return found.select(
        F.col("v").alias("volume"), F.col("id").alias("frn"), *([F.substring("path", F.lit(2), F.length("path")).alias("path")] if paths else []),
        "depth", F.col("top").alias("root_frn"), F.col("below").alias("n_descendants"), status.alias("status"), F.col("cycle").alias("cycle_frn")
    )


def intervals(records: DataFrame) -> DataFrame:
    """All descendants in one row a node: volume, frn, root_frn, first, last.

    Nodes of one tree are numbered from 0 so that a node's descendants are those of its tree with numbers above its
    own (``first``) up to ``last``; siblings are numbered in the order of their frn. What circles has no row. The
    numbers are sums along the path of the sizes of earlier siblings, found by the same walk as the depth.
    """
    scratch = Scratch(records.sparkSession)
    sized = scratch.keep(forest(newest(records), ("below",)).where("cycle is null").select("v", "id", "parent", "top", "below"), "sized")
    # a folder may hold a third of all nodes, so siblings are put in order by range
    upto = running_total(sized.where("parent is not null"), ["v", "parent"], [F.col("id").asc()], F.col("below") + 1, "upto")
    placed = upto.select("v", "id", "parent", F.lit("").alias("name"), (F.col("upto") - F.col("below")).alias("offset"))
    placed = placed.unionByName(
        sized.where("parent is null").select("v", "id", "parent", F.lit("").alias("name"), F.lit(0).cast("long").alias("offset"))
    )
    numbered = forest(placed, (), "offset").select(F.col("v").alias("nv"), F.col("id").alias("nid"), F.col("depth").alias("first"))
    return (
        sized.join(numbered, _on("id", "nv", "nid"))
            .select(
                F.col("v").alias("volume"), F.col("id").alias("frn"), F.col("top").alias("root_frn"), "first",
                (F.col("first") + F.col("below")).alias("last")
            )
    )


def descendants(records: DataFrame) -> DataFrame:
    """Every pair of a folder and something below it, however deep: volume, frn, descendant_frn, distance.

    Their number grows with the depth of the tree; ``intervals`` says the same in one row a node.
    """
    found = forest(newest(records), ("chain",)).where("cycle is null and size(chain) > 1")
    pairs = found.select("v", "id", F.size("chain").alias("n"), F.posexplode(F.slice("chain", 1, F.size("chain") - 1)).alias("at", "above"))
    return pairs.select(
        F.col("v").alias("volume"), F.col("above").alias("frn"), F.col("id").alias("descendant_frn"),
        (F.col("n") - 1 - F.col("at")).cast("int").alias("distance")
    )
