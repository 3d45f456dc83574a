"""References to records that do not exist: missing, deleted, or arriving only in a later period.

All keys that are held or referred to are put in order and numbered (a dictionary), 65,536 to a range. Per range and
period three compressed bitmaps are built - keys delivered, keys delivered as deleted, keys referred to - and walked
in the order of periods: ``live = (live or delivered) and-not deleted``, ``orphan = referred and-not live``. Only the
surviving bits are decoded to keys, and joined back to the rows that refer to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.bitmaps import EMPTY, RANGE, Bitmap

#: Rows that a task holds at once, at least; a block ends with a whole key.
BLOCK_ROWS = 1 << 18


def _orphans_of(block: pa.Table) -> pa.RecordBatch:
    """The (space, key, period) of a sorted block that are referred to while not live."""
    space = block["space"].combine_chunks().dictionary_encode()
    code, key = space.indices.to_numpy(zero_copy_only=False), block["key"].to_numpy()
    names, period = np.unique(block["period"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    gone = block["gone"].to_numpy(zero_copy_only=False).astype(float)  # nan: no delivery in that period
    ref = block["ref"].to_numpy(zero_copy_only=False).astype(bool)
    new = np.r_[True, (code[1:] != code[:-1]) | (key[1:] != key[:-1])] if len(key) else np.zeros(0, bool)
    number, first = np.cumsum(new) - 1, np.flatnonzero(new)
    out: list[tuple[np.ndarray, int]] = []
    for start in range(0, len(first), RANGE):
        a, b = first[start], first[start + RANGE] if start + RANGE < len(first) else len(key)
        low, p, g, r = (number[a:b] - start).astype(np.uint16), period[a:b], gone[a:b], ref[a:b]
        live = EMPTY
        for i in range(len(names)):
            at = p == i
            live = (live | Bitmap.of(low[at & (g == 0)])).and_not(Bitmap.of(low[at & (g == 1)]))
            out.append((first[start + Bitmap.of(low[at & r]).and_not(live).members().astype(np.int64)], i))
    rows = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
    when = np.concatenate([np.full(len(x), i) for x, i in out]) if out else np.zeros(0, np.int64)
    found = block.take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [found["space"].combine_chunks(), found["key"].combine_chunks(), pa.array(names[when].tolist(), pa.string())], ["space", "key", "period"]
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK_ROWS:
            block = pa.Table.from_batches(held).combine_chunks()
            last, space, key = len(block) - 1, block["space"][-1], block["key"][-1]
            while last > 0 and block["key"][last - 1] == key and block["space"][last - 1] == space:
                last -= 1
            if last:
                yield _orphans_of(block.slice(0, last))
            held = block.slice(last).to_batches()
    if held:
        yield _orphans_of(pa.Table.from_batches(held).combine_chunks())


def orphan_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """The (space, key, period) that ``references`` names while ``parents`` doesn't hold them.

    ``parents``: space, key, period, deleted, version (the greatest version of a key's period holds).
    ``references``: space, key, period. Rows with a null in space, key or period name nothing, on either side.
    Repeated rows and hot keys are combined before the shuffle. Empty parents make every reference an orphan.
    """
    named = "space is not null and key is not null and period is not null"
    state = F.struct(F.col("version"), F.coalesce(F.col("deleted"), F.lit(False)).cast("int").alias("gone"))
    held = parents.where(named).select("space", "key", "period", state.alias("state"), F.lit(False).alias("ref"))
    wanted = (
        references.where(named)
            .select("space", "key", "period", F.lit(None).cast(held.schema["state"].dataType).alias("state"), F.lit(True).alias("ref"))
    )
    facts = held.unionByName(wanted).groupBy("space", "key", "period").agg(F.max("state").alias("state"), F.max("ref").alias("ref"))
    ordered = (
        facts.select("space", "key", "period", F.col("state.gone").alias("gone"), "ref")
            .repartitionByRange("space", "key")
            .sortWithinPartitions("space", "key")
    )
    return ordered.mapInArrow(_walk, "space string, key long, period string")


def orphan_rows(parents: DataFrame, references: DataFrame) -> DataFrame:
    """The rows of ``references`` (with any further columns) whose key isn't held in their period; whole rows once.

    The join back is on a unique key of the orphans' side. Where many rows refer to one key the engine splits that
    partition (adaptive skew join); where the orphans are few it sends them to the rows instead, by their size.
    """
    found = orphan_keys(parents, references).select(F.col("space").alias("_s"), F.col("key").alias("_k"), F.col("period").alias("_p"))
    return (
        references.join(found, [F.col("space") == F.col("_s"), F.col("key") == F.col("_k"), F.col("period") == F.col("_p")])
            .drop("_s", "_k", "_p")
            .distinct()
    )
