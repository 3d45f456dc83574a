"""Queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import changefeed, hierarchy, incremental, references
from spindrift.session import table


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records, documents = table(spark, sf_dir, "records"), table(spark, sf_dir, "documents")
    held = records.select(
        F.col("volume").alias("space"), F.col("frn").alias("key"), F.col("scan_month").alias("period"), "deleted",
        F.struct("received_at", "row_id").alias("version")
    )
    named = (
        records.where("not coalesce(deleted, false) and parent_frn <> 0")
            .select(
                F.lit("records").alias("table_name"), "row_id", F.col("volume").alias("space"), F.col("parent_frn").alias("key"),
                F.col("scan_month").alias("period")
            )
    )
    named = named.unionByName(
        documents.where("frn <> 0")
            .select(
                F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), F.col("volume").alias("space"), F.col("frn").alias("key"),
                F.col("scan_month").alias("period")
            )
    )
    return held, named


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_rows(*_references(spark, sf_dir)).select("table_name", F.col("period").alias("scan_month"), "row_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and period."""
    return p2_found(spark, sf_dir).groupBy("table_name", "scan_month").agg(F.count("*").alias("n_orphans"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = incremental.IncrementalJob(spark)
    job.run(0, table(spark, sf_dir, "file_prints"), table(spark, sf_dir, "index_runs"))
    return job.read().select("volume", "frn")


def p4_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each volume's open run takes up: from a change number, by comparison, or with everything (``all``: nothing done yet, or a new journal)."""
    return incremental.offsets(table(spark, sf_dir, "index_runs")).select("volume", "open_run", "mode", "from_usn", "journal_id")


def p4_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink after two batches: one as of the last successful run of every volume, and one of the open run."""
    prints, runs = table(spark, sf_dir, "file_prints"), table(spark, sf_dir, "index_runs")
    done = runs.where("state = 'ready' and last_persist is not null").groupBy("volume").agg(F.max(F.struct("built_at", "run_id")).alias("l"))
    earlier = (
        runs.where("state <> 'replaying'")
            .join(done, "volume", "left")
            .withColumn("state", F.when(F.col("run_id") == F.col("l.run_id"), "replaying").otherwise(F.col("state")))
            .drop("l")
    )
    job = incremental.IncrementalJob(spark)
    job.run(0, prints, earlier)
    job.run(1, prints, runs)
    return job.read().select("volume", "frn", "journal_id", "usn", "print_size", "print_mod", "batch")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_files(table(spark, sf_dir, "feature_feed"))


def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present files with what the feed says of them."""
    return changefeed.current_files(table(spark, sf_dir, "feature_feed"), ["path", "name", "size", "mod_unix", "mode"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.circles(table(spark, sf_dir, "records"))


def p7_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tree(table(spark, sf_dir, "records"))


def p7_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every node as one interval of numbers."""
    return hierarchy.intervals(table(spark, sf_dir, "records"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "records"))


QUERIES = {
    f.__name__: f for f in (p2_found, p2_report, p4_found, p4_plan, p4_two_batches, p6_found, p6_files, p7_found, p7_tree, p7_intervals, p7_descendants)
}

_ORPHANS = """
with refs as (select distinct 'records' as table_name, scan_month, row_id, volume, parent_frn as frn from records where not coalesce(deleted, false) and parent_frn <> 0
 union all select 'documents', scan_month, doc_id, volume, frn from documents where frn <> 0),
r as (select distinct volume, frn, scan_month, deleted from records),
o as (select table_name, scan_month, row_id from (select refs.*, r.deleted, row_number() over (partition by table_name, row_id
 order by r.scan_month desc nulls last) as rn
 from refs left join r on r.volume = refs.volume and r.frn = refs.frn and r.scan_month <= refs.scan_month) where rn = 1 and coalesce(deleted, true))
"""
_LATEST = """
with l as (select * from (select *, row_number() over (partition by volume, frn
 order by checkpoint_usn desc, feed_cursor desc, path desc nulls last, name desc nulls last, size desc nulls last) as rn
 from feature_feed where frn is not null and frn <> 0 and volume is not null) where rn = 1 and not coalesce(deleted, false))
"""
_NODES = """
with recursive n as (select volume, frn, case when parent_frn <> 0 then parent_frn end as parent_frn, coalesce(name, '') as name from
 (select *, row_number() over (partition by volume, frn order by scan_month desc, received_at desc, row_id desc) as rn from records) where rn = 1
 and not coalesce(deleted, false)),
t(volume, frn, path, depth, root_frn, status) as (
 select n.volume, n.frn, n.name, 0, n.frn, case when n.parent_frn is null then 'root' else 'missing' end from n left
 join n as p on p.volume = n.volume and p.frn = n.parent_frn where p.frn is null
 union all select n.volume, n.frn, t.path || chr(92) || n.name, t.depth + 1, t.root_frn, t.status from n join t on n.volume = t.volume and n.parent_frn = t.frn),
c as (select n.* from n anti join t on n.volume = t.volume and n.frn = t.frn),
w(volume, frn, cur) as (select volume, frn, parent_frn from c union select w.volume, w.frn, c.parent_frn from w join c on c.volume = w.volume and c.frn = w.cur),
r as (select volume, frn from w where cur = frn),
m as (select w.volume, w.frn, min(w.cur) as cycle_frn from w join r on r.volume = w.volume and r.frn = w.cur group by 1, 2),
a(volume, frn, descendant_frn, distance) as (
 select n.volume, n.parent_frn, n.frn, 1 from n join t on t.volume = n.volume and t.frn = n.frn join n as p on p.volume = n.volume and p.frn = n.parent_frn
 union all select a.volume, n.parent_frn, a.descendant_frn, a.distance + 1 from a join n on n.volume = a.volume and n.frn = a.frn
 join n as p on p.volume = n.volume and p.frn = n.parent_frn)
"""
_RUNS = "select distinct volume, run_id, source, journal_id, checkpoint_usn, built_at from index_runs"
_OPEN = f"{_RUNS} where state = 'replaying'"
_OK = f"{_RUNS} where state = 'ready' and last_persist is not null"
_LAST_AS_OPEN = f"select * exclude rn from (select *, row_number() over (partition by volume order by built_at desc, run_id desc) as rn from ({_OK})) where rn = 1"
_OK_BEFORE_LAST = f"select * exclude rn from (select *, row_number() over (partition by volume order by built_at desc, run_id desc) as rn from ({_OK})) where rn > 1"


def _changed(opened: str, ok: str) -> str:
    """``c``: the new and changed files of some open runs, seen from the successful ones."""
    return f"""
with o as ({opened}), ok as ({ok}),
l as (select * from (select ok.*, row_number() over (partition by volume order by built_at desc) as rn from ok) where rn = 1),
n as (select * from (select p.*, row_number() over (partition by p.volume, p.frn order by seen_at desc) as rn from file_prints as p
 join o on o.run_id = p.run_id and o.volume = p.volume) where rn = 1),
b as (select * from (select p.*, row_number() over (partition by p.volume, p.frn order by ok.built_at desc, seen_at desc) as rn
 from file_prints as p join ok on ok.run_id = p.run_id and ok.volume = p.volume) where rn = 1),
c as (select n.volume, n.frn, o.built_at, n.usn, n.seen_at, o.journal_id, n.print_size, n.print_mod from n join o on o.volume = n.volume left
 join l on l.volume = n.volume left join b on b.volume = n.volume and b.frn = n.frn
where case when o.source = 'walk' then b.frn is null or b.print_size is distinct from n.print_size or b.print_mod is distinct from n.print_mod
 else l.run_id is null or l.journal_id is distinct from o.journal_id or coalesce(n.usn >= l.checkpoint_usn, true) end)"""


SQL = {
    "p2_found": _ORPHANS + "select table_name, scan_month, row_id from o",
    "p2_report": _ORPHANS + "select table_name, scan_month, count(*) as n_orphans from o group by 1, 2",
    "p4_found": f"{_changed(_OPEN, _OK)} select volume, frn from c",
    "p4_plan": f"""with o as ({_OPEN}), l as (select * from (select *, row_number() over (partition by volume
 order by built_at desc, run_id desc) as rn from ({_OK})) where rn = 1)
select o.volume, o.run_id as open_run, case when o.source = 'walk' then 'compare' when l.run_id is null or l.journal_id is distinct
 from o.journal_id or l.checkpoint_usn is null then 'all' else 'journal' end as mode, l.checkpoint_usn as from_usn, o.journal_id
from o left join l on l.volume = o.volume""",
    "p4_two_batches": f"""with a as ({_changed(_LAST_AS_OPEN, _OK_BEFORE_LAST)} select *, 0 as batch from c), b as ({_changed(_OPEN, _OK)} select *, 1 as batch from c)
select volume, frn, journal_id, usn, print_size, print_mod, cast(batch as bigint) as batch from (select *, row_number() over (partition by volume, frn order by built_at desc, usn desc nulls last, seen_at desc, batch desc) as rn from (select * from a union all select * from b)) where rn = 1""",
    "p6_found": _LATEST + "select volume, frn, checkpoint_usn, feed_cursor from l",
    "p6_files": _LATEST + "select volume, frn, checkpoint_usn, feed_cursor, path, name, size, mod_unix, mode from l",
    "p7_found": _NODES + "select volume, frn, cycle_frn from m",
    "p7_tree": _NODES + """, d as (select volume, frn, count(*) as n from a group by 1, 2)
select t.volume, t.frn, t.path, cast(t.depth as bigint) as depth, t.root_frn, coalesce(d.n, 0) as n_descendants, t.status, cast(null as bigint) as cycle_frn from t left join d on d.volume = t.volume and d.frn = t.frn
union all select volume, frn, null, null, null, null, 'circle', cycle_frn from m""",
    "p7_intervals": _NODES + """, i(volume, frn, root_frn, ids) as (select t.volume, t.frn, t.root_frn, [t.frn] from t where t.depth = 0
 union all select n.volume, n.frn, i.root_frn, list_append(i.ids, n.frn) from n join i on n.volume = i.volume and n.parent_frn = i.frn),
k as (select *, row_number() over (partition by volume, root_frn order by ids) - 1 as first from i), d as (select volume, frn, count(*) as n from a group by 1, 2)
select k.volume, k.frn, k.root_frn, k.first, k.first + coalesce(d.n, 0) as last from k left join d on d.volume = k.volume and d.frn = k.frn""",
    "p7_descendants": _NODES + "select volume, frn, descendant_frn, distance from a",
}
