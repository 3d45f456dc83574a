"""The relation that queries run over: one row a file or folder, with the columns that conditions need.

``volume, frn, path, name, ext_l, parent_l, path_l, name_l, path_f, name_f, is_dir, mode, size, mod_ns, depth, source,
text``; the folded and lower-case forms are made once here. The test data has no listing of its own, so one is
projected from its tables; the same projection in SQL is ``ENTRIES_SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.folding import folded
from spindrift.operators.changefeed import current_files
from spindrift.session import exists, listing_of, table, written

DIR_BIT = 1 << 31
#: Extensions given to documents in turn.
EXTENSIONS = ["txt", "md", "json", "log", "csv", "html"]


def enriched(rows: DataFrame) -> DataFrame:
    """Derived columns for rows of volume, frn, path, mode, size, mod_ns, source, text. Rows without a path are left out."""
    clean = rows.where("path is not null and path <> ''").withColumn("path", F.translate("path", "/", "\\"))
    name = F.substring_index("path", "\\", -1)
    parts = F.split("path", r"\\")
    return clean.select(
        "volume", "frn", "path", name.alias("name"), F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")).alias("ext_l"),
        F.coalesce(F.lower(F.try_element_at(parts, F.lit(-2))), F.lit("")).alias("parent_l"), F.lower("path").alias("path_l"), F.lower(name).alias("name_l"), folded(F.col("path")).alias("path_f"), folded(name).alias("name_f"),
        (F.col("mode").bitwiseAND(F.lit(DIR_BIT | 0x10)) != 0).alias("is_dir"), "mode",
        F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size"), F.coalesce("mod_ns", F.lit(0)).cast("long").alias("mod_ns"),
        (F.size(parts) - 1).alias("depth"), "source", "text"
    )


def folders(files: DataFrame) -> DataFrame:
    """All folders above some files, with the latest time below; a folder has no record number here."""
    parts = F.split("path", r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))
    rows = (
        files.where(F.size(parts) > 1)
            .select("volume", F.explode(above).alias("path"), "mod_ns")
            .groupBy("volume", "path")
            .agg(F.max("mod_ns").alias("mod_ns"))
    )
    return rows.select(
        "volume", F.lit(None).cast("long").alias("frn"), "path", F.lit(DIR_BIT | 0x10).cast("long").alias("mode"),
        F.lit(0).cast("long").alias("size"), "mod_ns", F.lit("folder").alias("source"), F.lit(None).cast("string").alias("text")
    )


def _documents(documents: DataFrame) -> DataFrame:
    ext: Column = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6).cast("int"))
    path = F.concat(
        F.col("volume"), F.lit("\\corpus\\"), F.col("source"), F.lit("\\"), F.coalesce("lang", F.lit("und")), F.lit("\\doc_"),
        F.col("doc_id").cast("string"), F.lit("."), ext
    )
    mode = (
        F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
        + F.when(F.col("doc_id") % 7 == 0, 2).otherwise(0)
        + F.when(F.col("doc_id") % 2 == 0, 32).otherwise(0)
    )
    return documents.select(
        "volume", F.col("doc_id").alias("frn"), path.alias("path"), mode.cast("long").alias("mode"), F.col("n_chars").alias("size"),
        ((F.lit(1704067200) + F.col("doc_id") % 100000 * 600) * 1_000_000_000).alias("mod_ns"), F.lit("corpus").alias("source"), "text"
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with text, the present files of the change feed, and all folders above either."""
    feed = current_files(table(spark, sf_dir, "feature_feed"), ["path", "size", "mod_unix", "mode"])
    files = (
        _documents(table(spark, sf_dir, "documents"))
            .unionByName(
                feed.where("path is not null")
                    .select(
                        "volume", "frn", F.translate("path", "/", "\\").alias("path"), "mode", "size", F.col("mod_unix").alias("mod_ns"),
                        F.lit("feed").alias("source"), F.lit(None).cast("string").alias("text")
                    )
            )
    )
    return enriched(files.unionByName(folders(files)))


_INDEXED: dict[tuple[str, str, str], tuple[str, object]] = {}


def index(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    """A listing written to the shared folder, to be searched again and again."""
    return written(rows, "index")


def _kept(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made from the data folder, written once a session for the present files of its tables."""
    sources = listing_of(table(spark, sf_dir, "documents")) + listing_of(table(spark, sf_dir, "feature_feed"))
    key = (spark.sparkContext.applicationId, f"{sf_dir} {sources}", what)
    path, schema = _INDEXED.get(key, ("", None))
    if path and exists(spark, f"{path}/_SUCCESS"):
        return spark.read.schema(schema).parquet(path)
    found, path = index(spark, make())
    _INDEXED[key] = (path, found.schema)
    return found


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entries``, indexed: the first search builds the index, later ones read it until a table changes."""
    return _kept(spark, sf_dir, "entries", lambda: entries(spark, sf_dir))


def indexed_words(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], what: str) -> DataFrame:
    """A vocabulary of the indexed entries, written beside them."""
    return _kept(spark, sf_dir, what, lambda: make(indexed(spark, sf_dir)))


ENTRIES_SQL = """
with fl as (select * from (select *, row_number() over (partition by volume, frn order by checkpoint_usn desc, feed_cursor desc) as rn
 from feature_feed where frn is not null and frn <> 0 and volume is not null) where rn = 1 and not coalesce(deleted, false)),
files as (select volume, doc_id as frn, volume || chr(92) || 'corpus' || chr(92) || source || chr(92) || coalesce(lang, 'und') || chr(92) || 'doc_' || doc_id || '.' || (['txt', 'md', 'json', 'log', 'csv', 'html'])[doc_id % 6 + 1] as path,
 cast(case when doc_id % 5 = 0 then 1 else 0 end + case when doc_id % 7 = 0 then 2 else 0 end + case when doc_id % 2 = 0 then 32 else 0 end as bigint) as mode, n_chars as size, (1704067200 + doc_id % 100000 * 600) * 1000000000 as mod_ns, 'corpus' as source, text from documents
 union all select volume, frn, replace(path, '/', chr(92)), mode, size, mod_unix, 'feed', null from fl where path is not null),
parts as (select volume, string_split(path, chr(92)) as p, mod_ns from files),
above as (select volume, array_to_string(p[1:i], chr(92)) as path, mod_ns from (select volume, p, mod_ns, unnest(range(1, len(p))) as i from parts)),
allrows as (select * from files union all select volume, null, path, 2147483664, 0, max(mod_ns), 'folder', null from above group by volume, path),
named as (select *, string_split(path, chr(92))[-1] as name from allrows where path <> ''),
e as (select volume, frn, path, name, lower(case when contains(name, '.') then string_split(name, '.')[-1] else '' end) as ext_l, coalesce(lower(string_split(path, chr(92))[-2]), '') as parent_l, lower(path) as path_l, lower(name) as name_l,
 strip_accents(lower(path)) as path_f, strip_accents(lower(name)) as name_f, (mode & 2147483664) <> 0 as is_dir, mode, cast(greatest(coalesce(size, 0), 0) as bigint) as size, cast(coalesce(mod_ns, 0) as bigint) as mod_ns, len(string_split(path, chr(92))) - 1 as depth, source, text from named)
"""
