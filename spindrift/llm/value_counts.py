"""How often every value or term occurs, and in how many records: a distributed suffix array.

Every position of every record's token sequence is a suffix, cut to the longest gram asked for. Suffixes are put in
order by range over all partitions (ties by record, so that a frequent gram spreads over many partitions); each
partition then compares neighbours: the length of their common prefix opens and closes one interval per gram length,
and an interval is a gram with all its occurrences. The number of records is the number of suffixes of the interval
less its within-record duplicates: pairs of suffixes of one record that follow each other in suffix order inside the
interval. Intervals that touch the edge of a block may go on in the next one; only those are carried on. Where records
are in order (grams of full length) the records inside such a part are in no other, so its sums, first and last record
are enough; else each of its records is carried once.

A posting list is the same thing in run-length form: a term that stands ``tf`` times in a record is one suffix of
weight ``tf``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes that a task holds at once.
BLOCK = 1 << 18


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before; two nulls are alike."""
    code = column.combine_chunks().dictionary_encode(null_encoding="encode")
    i = code.indices.to_numpy(zero_copy_only=False) if isinstance(code, pa.DictionaryArray) else np.zeros(0, np.int64)
    return i[1:] != i[:-1]


def _intervals(block: pa.Table, n: int, least: int) -> Iterator[pa.RecordBatch]:
    rows = len(block)
    if not rows:
        return
    differs = _changes(block["space"])
    records = block["record"].combine_chunks().dictionary_encode()
    record = records.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    weight = block["weight"].to_numpy().astype(np.int64)
    at = np.lexsort((np.arange(rows), record))
    same_record = record[at[1:]] == record[at[:-1]]
    for k in range(1, n + 1):
        token = block[f"t{k}"]
        differs = differs | _changes(token)  # the common prefix of neighbours is shorter than k
        start = np.r_[True, differs]
        interval = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        whole = ~token.is_null().to_numpy()[first] if k > 1 else np.ones(len(first), bool)
        occurrences = np.add.reduceat(weight, first)
        duplicates = np.bincount(interval[at[1:]][same_record & (interval[at[1:]] == interval[at[:-1]])], minlength=len(first))
        held = np.diff(np.r_[first, rows]) - duplicates
        inner = whole & (held >= least)
        inner[[0, -1]] = False
        yield _out(block, first[inner], k, n, occurrences[inner], held[inner], None)
        for i in sorted({0, len(first) - 1}):
            if whole[i]:
                yield _edge(block, first[i], first[i + 1] if i + 1 < len(first) else rows, k, n, record, weight, records.dictionary)


def _edge(block: pa.Table, a: int, b: int, k: int, n: int, record: np.ndarray, weight: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """An interval that may have parts in other blocks: its records, or sums and the first and last record."""
    codes, number = np.unique(record[a:b], return_inverse=True)
    sums = np.bincount(number, weight[a:b]).astype(np.int64)
    shown = np.arange(len(codes)) if k < n else np.unique(number[[0, -1]])
    rest = len(codes) - len(shown)
    # the row without a record sums up those that are in no other block
    occurrences = np.r_[sums[shown], sums.sum() - sums[shown].sum()][: len(shown) + (rest > 0)]
    own = pa.concat_arrays([names.take(pa.array(codes[shown])), pa.nulls(int(rest > 0), names.type)])
    return _out(block, np.full(len(occurrences), a), k, n, occurrences, np.r_[np.zeros(len(shown), np.int64), rest][: len(occurrences)], own)


def _out(block: pa.Table, rows: np.ndarray, k: int, n: int, occurrences: np.ndarray, records: np.ndarray, record: pa.Array | None) -> pa.RecordBatch:
    picked = block.select(["space", *[f"t{i}" for i in range(1, k + 1)]]).take(pa.array(rows))
    none = pa.nulls(len(rows), pa.string())
    columns = [
        picked["space"].combine_chunks(), pa.array(np.full(len(rows), k, np.int32)),
        *[picked[f"t{i}"].combine_chunks() if i <= k else none for i in range(1, n + 1)]
    ]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(occurrences, pa.int64()), pa.array(records, pa.int64()), none if record is None else record],
        ["space", "n", *[f"t{i}" for i in range(1, n + 1)], "occurrences", "records", "record"]
    )


def gram_counts(suffixes: DataFrame, n: int, least: int = 1) -> DataFrame:
    """Counts of all grams of 1 to ``n`` tokens: space, n, t1..tn, occurrences, records.

    ``suffixes``: space (a collection; grams never cross collections), t1..tn (null beyond the record's end), record
    (a string, never null), weight. Grams in fewer than ``least`` records are counted and left out of the result. No
    suffixes give no rows.
    """
    tokens = [f"t{i}" for i in range(1, n + 1)]
    order = ["space", *tokens, "record"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                yield from _intervals(pa.Table.from_batches(held), n, least)
                held = []
        if held:
            yield from _intervals(pa.Table.from_batches(held), n, least)

    ordered = suffixes.select(*order, F.col("weight").cast("long").alias("weight")).repartitionByRange(*order).sortWithinPartitions(*order)
    fields = "".join(f"{t} string, " for t in tokens)
    parts = ordered.mapInArrow(walk, f"space string, n int, {fields}occurrences long, records long, record string")
    by = ["space", "n", *tokens]
    held = F.when(F.col("record").isNull(), F.sum("records")).otherwise(1).alias("records")
    once = parts.groupBy(*by, "record").agg(F.sum("occurrences").alias("occurrences"), held)
    return once.groupBy(*by).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where(F.col("records") >= least)


def text_suffixes(texts: DataFrame, record: str, tokens: Column, n: int) -> DataFrame:
    """The suffixes of token sequences, for ``gram_counts``: null and empty sequences have none; a row holds ``n`` tokens, not its text."""
    at = texts.select(F.col(record).cast("string").alias("record"), tokens.alias("_t")).where("record is not null and size(_t) > 0")
    zipped = at.selectExpr("record", f"explode(arrays_zip(_t{''.join(f', slice(_t, {i}, size(_t))' for i in range(2, n + 1))})) as _z")
    names = ["_t", *map(str, range(1, n))]
    return zipped.select(
        F.lit("").alias("space"), *[F.col("_z")[c].alias(f"t{i}") for i, c in enumerate(names, 1)], "record", F.lit(1).alias("weight")
    )


def marked_grams(texts: DataFrame, record: str, column: str, n: int, rare_below: int = 3, common_share: float = 0.1, least: int = 1) -> DataFrame:
    """All grams of 1 to ``n`` words: n, gram, occurrences, records, mark.

    Words are runs of letters and digits, compared as stored. ``mark``: ``rare`` below ``rare_below`` records, else
    ``common`` above ``common_share`` of the records with a text, else null. Grams in fewer than ``least`` records are
    counted and left out. Null and empty texts, and rows without a record, hold nothing; a record delivered twice
    counts once in ``records``.
    """
    named = texts.where(F.col(record).isNotNull() & F.col(column).isNotNull())
    words = F.regexp_extract_all(F.col(column), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    counted = gram_counts(text_suffixes(named, record, words, n), n, least)
    total = named.agg(F.count_distinct(record)).collect()[0][0]
    joined = F.array_join(F.array(*[f"t{i}" for i in range(1, n + 1)]), " ").alias("gram")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > total * common_share, "common")
    return counted.select("n", joined, "occurrences", "records", mark.alias("mark"))


def text_grams(texts: DataFrame, record: str, column: str, n: int, rare_below: int = 3, common_share: float = 0.1) -> DataFrame:
    """The rows of ``marked_grams`` that aren't rare: of real texts a small part, as most grams stand in one or two records."""
    return marked_grams(texts, record, column, n, rare_below, common_share, least=rare_below)


def term_counts(postings: DataFrame, rare_below: int = 3, common_share: float = 0.1) -> DataFrame:
    """Totals, documents (or names) and mark of every term: posting_kind, term, occurrences, records, mark.

    Of deliveries of one (kind, shard, term, document) the latest holds, of equally late ones the greatest number. A
    kind that lists documents counts distinct ones; a kind that counts them adds its numbers up over shards. Rows
    without a kind, a term, or a number above 0 count for nothing. ``mark``: ``rare`` below ``rare_below`` records,
    else ``common`` above ``common_share`` of the kind's total (the sum over its shards), else null.
    """
    number = F.coalesce("tf", "entry_count", "gram_count")
    key = ["posting_kind", "shard", "term", "doc_id"]
    latest = (
        postings.where("posting_kind is not null and term is not null")
            .groupBy(*key)
            .agg(F.max(F.struct("received_at", number.alias("n"))).alias("d"))
    )
    listed = F.col("posting_kind") == "doc_tf"
    record = F.when(listed, F.col("doc_id").cast("string")).otherwise(F.coalesce("shard", F.lit("")))
    suffixes = (
        latest.where("d.n > 0")
            .select(
                F.col("posting_kind").alias("space"), F.col("term").alias("t1"), F.coalesce(record, F.lit("")).alias("record"),
                F.col("d.n").alias("weight")
            )
    )
    counted = (
        gram_counts(suffixes, 1)
            .select(
                F.col("space").alias("posting_kind"), F.col("t1").alias("term"), "occurrences",
                F.when(F.col("space") == "doc_tf", F.col("records")).otherwise(F.col("occurrences")).alias("records")
            )
    )
    totals = postings.groupBy("posting_kind", "shard").agg(F.max("shard_total").alias("t")).groupBy("posting_kind").agg(F.sum("t").alias("_total"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("_total") * common_share, "common")
    return counted.join(totals, "posting_kind", "left").select("posting_kind", "term", "occurrences", "records", mark.alias("mark"))
