"""Queries of the operators for language-model data, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import leakage, mojibake, packing, rank_fusion, truncation, value_counts
from spindrift.session import table


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts.term_counts(table(spark, sf_dir, "posting_counts"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_counts(spark, sf_dir).where("mark is not null").select("posting_kind", "term", "mark")


def p1_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams of one to five words that are not rare, over whole texts."""
    return value_counts.text_grams(table(spark, sf_dir, "documents"), "doc_id", "text", 5)


def p1_all_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grams of one to five words, over whole texts, with a mark on the rare and the common ones."""
    return value_counts.marked_grams(table(spark, sf_dir, "documents"), "doc_id", "text", 5)


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.rank_paths(table(spark, sf_dir, "query_picks"), table(spark, sf_dir, "file_signals"))


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        mojibake.garbled(table(spark, sf_dir, "search_results"), "result_id", "snippet")
            .select("result_id", F.array_join("pairs", ", ").alias("pairs"), "restored")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "search_results"), "result_id", "snippet").select("result_id").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_configs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that leaked, and into how many documents."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p10_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_source(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_counts, p1_grams, p1_all_grams, p3_ranking, p5_found, p5_restored, p8_containers, p9_found, p9_items, p10_found,
        p10_by_source
    )
}

_COUNTS = """
with d as (select posting_kind, shard, term, doc_id, arg_max(coalesce(tf, entry_count, gram_count), received_at) as n from posting_counts
 where posting_kind is not null and term is not null group by all),
t as (select posting_kind, sum(t) as total from (select posting_kind, shard, max(shard_total) as t from posting_counts group by all) group by 1),
c as (select posting_kind, term, cast(sum(n) as bigint) as occurrences, cast(case when posting_kind = 'doc_tf' then count(distinct doc_id) else sum(n) end as bigint) as records from d where n > 0 group by 1, 2),
m as (select c.posting_kind, term, occurrences, records, case when records < 3 then 'rare' when records > total * 0.1 then 'common' end as mark
 from c join t using (posting_kind))
"""
SQL = {
    "p1_counts": _COUNTS + "select posting_kind, term, occurrences, records, mark from m",
    "p1_grams": r"""with w as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') as w from documents where text is not null and doc_id is not null),
i as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w), g as (select doc_id, w, i, unnest([1, 2, 3, 4, 5]) as n from i),
c as (select n, array_to_string(w[i:i + n - 1], ' ') as gram, count(*) as occurrences, count(distinct doc_id) as records from g where i + n - 1 <= len(w) group by 1, 2)
select n, gram, occurrences, records, case when records > 0.1 * (select count(distinct doc_id) from w) then 'common' end as mark from c where records >= 3""",
    "p1_all_grams": r"""with w as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') as w from documents where text is not null and doc_id is not null),
i as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w), g as (select doc_id, w, i, unnest([1, 2, 3, 4, 5]) as n from i),
c as (select n, array_to_string(w[i:i + n - 1], ' ') as gram, count(*) as occurrences, count(distinct doc_id) as records from g where i + n - 1 <= len(w) group by 1, 2)
select n, gram, occurrences, records,
 case when records < 3 then 'rare' when records > 0.1 * (select count(distinct doc_id) from w) then 'common' end as mark from c""",
    "p1_found": _COUNTS + "select posting_kind, term, mark from m where mark is not null",
}
