"""Searching entries: one plan per query - conditions, order, page - and counts, snippets and result rows."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.folding import folded
from spindrift.operators import content, rollup
from spindrift.plans.grammar import Query, QueryError, Settings, parse, smart_case
from spindrift.plans.predicates import compile_query
from spindrift.sources.walk import exists as there

DEFAULT_LIMIT = 100


#: Sort keys in SQL, with whether they descend; none is ever null.
_BY_NAME = [("name_l", False), ("path_l", False), ("path", False)]
_BY_PATH = [("path_l", False), ("path", False)]
_LAST = [("frn is null", False), ("coalesce(frn, 0)", False)]
_KEYS = {
    "size": [("size", False), *_BY_NAME],
    "modified": [("mod_ns = 0", False), ("mod_ns", True), *_BY_NAME],
    "extension": [("ext_l", False), *_BY_NAME],
    "type": [("is_dir", True), *_BY_NAME],
    "path": _BY_PATH,
    "relevance": [("relevance", True), ("tier", False), ("first_at", False), *_BY_NAME],
}


def keys(q: Query, bias: str = "") -> list[tuple[str, bool]]:
    """The order of a query's results, ending in the path; the path is unique but for files known twice.

    A query on texts that names one symbol has files named after it first. ``bias``: a folder whose files come first.
    """
    promoted = content.promotion(q) if not q.sort else None
    found = _KEYS.get(q.sort) or [*([(promoted, False)] if promoted else []), *(_BY_PATH if q.path_mode else _BY_NAME)]
    if bias:
        low = bias.lower().rstrip("\\").replace("\\", "\\\\").replace("'", "\\'")
        found = [(f"path_l = '{low}' or startswith(path_l, '{low}\\\\')", True), *found]
    return [*found, *_LAST]


def order(q: Query, bias: str = "") -> list[Column]:
    return [F.expr(e).desc() if down else F.expr(e).asc() for e, down in keys(q, bias)]


def with_content(rows: DataFrame, q: Query) -> DataFrame:
    if "text" in rows.columns and "text_f" not in rows.columns and any(x.of("content") for x in q.queries()):
        rows = rows.withColumn("text_f", folded(F.col("text")))
    return rows


def matching(entries: DataFrame, q: Query, features: dict[str, Callable] | None = None, words: DataFrame | None = None) -> DataFrame:
    """All entries that a query matches, unordered. ``words``: a vocabulary written before, for ``content~``.

    ``features`` are companions: from a term to a condition, or to a set of files (volume, frn), which is joined by
    key, however large it is.
    """
    q = content.expand(entries, q, words)
    rows, conditions = _with_features(with_content(entries, q), q, features or {})
    return rows.where(compile_query(q, set(entries.columns), conditions)).select(*entries.columns)


def _with_features(rows: DataFrame, q: Query, features: dict[str, Callable]) -> tuple[DataFrame, dict[str, Callable[[str], Column]]]:
    flags: dict[tuple[str, str], Column] = {}
    for name, term in dict.fromkeys(x.value for y in q.queries() for x in y.of("feature")):
        if name in features:
            found = features[name](term)
            if isinstance(found, DataFrame):
                flag = f"_feature_{len(flags)}"
                held = found.where("frn is not null").select("volume", "frn").distinct().withColumn(flag, F.lit(True))
                rows, found = rows.join(held, ["volume", "frn"], "left"), F.coalesce(F.col(flag), F.lit(False))
            flags[name, term] = found
    return rows, {name: (lambda term, name=name: flags[name, term]) for name in features}


def search(
    entries: DataFrame, text: str, settings: Settings = Settings(), limit: int = DEFAULT_LIMIT, offset: int = 0, bias: str = "",
    features: dict | None = None, words: DataFrame | None = None, query: Query | None = None, existing: bool = False, last: list | None = None
) -> DataFrame:
    """One page of results in order. ``limit`` 0 or less means the default; ``bias`` puts what lies under a folder first.

    ``existing`` keeps files that are there now; ``last`` has the keys of a row behind which the page begins.
    ``sort:size`` gives folders the bytes below them.
    """
    q = query or parse(text, settings)
    rows = matching(entries, q, features, words)
    if existing:
        rows = there(rows).where("exists").drop("exists")
    if q.sort == "relevance":
        rows = content.relevance(rows, q)
    elif q.sort == "size":
        rows = rollup.with_sizes(rows, entries)
    if last is not None:
        rows = after(rows, keys(q, bias), last)
    page = rows.orderBy(*order(q, bias))
    return (page.offset(offset) if offset else page).limit(limit if limit > 0 else DEFAULT_LIMIT)


def count(
    entries: DataFrame, text: str, settings: Settings = Settings(), features: dict | None = None, words: DataFrame | None = None,
    query: Query | None = None
) -> DataFrame:
    """The number of matches; limits don't apply."""
    return matching(entries, query or parse(text, settings), features, words).agg(F.count("*").alias("n"))


def cursor(text: str, settings: Settings, offset: int) -> str:
    """A token for the next page, bound to the query and its settings."""
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "o": offset, "h": _print(text, settings)}).encode()).decode()


def resume(token: str, text: str, settings: Settings) -> int:
    try:
        found = json.loads(base64.urlsafe_b64decode(token))
        if found["v"] != 1 or found["h"] != _print(text, settings):
            raise ValueError
        return int(found["o"])
    except (ValueError, KeyError, TypeError):
        raise QueryError("the cursor belongs to another query") from None


def _print(text: str, settings: Settings) -> str:
    return hashlib.sha256(repr((text, settings)).encode()).hexdigest()[:16]


def key_cursor(page: DataFrame, text: str, settings: Settings, identity: str = "", bias: str = "") -> str | None:
    """A token for what comes behind a page, by the keys of its last row; None behind an empty page.

    It is bound to the query and to ``identity``, the version of the listing.
    """
    rows = page.selectExpr(*[f"{e} as k{i}" for i, (e, _) in enumerate(keys(parse(text, settings), bias))]).tail(1)
    if not rows:
        return None
    return base64.urlsafe_b64encode(json.dumps({"v": 2, "k": list(rows[0]), "h": _print(text, settings), "i": identity}).encode()).decode()


def resume_keys(token: str, text: str, settings: Settings, identity: str = "") -> list:
    """The keys in a token; a token of another query or of another version of the listing raises ``QueryError``."""
    try:
        found = json.loads(base64.urlsafe_b64decode(token))
        if found["v"] != 2 or found["h"] != _print(text, settings):
            raise ValueError
    except (ValueError, KeyError, TypeError):
        raise QueryError("the cursor belongs to another query") from None
    if found["i"] != identity:
        raise QueryError("the listing has changed since: start again")
    return found["k"]


def after(rows: DataFrame, by: list[tuple[str, bool]], last: Sequence) -> DataFrame:
    """Keyset paging: the rows behind a row in an order of (SQL, descends), without counting what came before. Keys are never null."""
    ahead = F.lit(False)
    same = F.lit(True)
    for (e, down), v in zip(by, last):
        ahead = ahead | (same & (F.expr(e) < F.lit(v) if down else F.expr(e) > F.lit(v)))
        same = same & (F.expr(e) == F.lit(v))
    return rows.where(ahead)


def results(rows: DataFrame, q: Query | None = None) -> DataFrame:
    """The result rows that callers see: path, name, volume, is_dir, size, modified (RFC 3339, null if unknown), index_source[, snippet, git_status]."""
    seconds = (F.col("mod_ns") / 1_000_000_000).cast("long")
    fraction = F.rtrim(F.lpad((F.col("mod_ns") % 1_000_000_000).cast("string"), 9, "0"), F.lit("0"))
    modified = F.when(
        F.col("mod_ns") != 0,
        F.concat(
            F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z")
        )
    )
    columns = ["path", "name", "volume", "is_dir", "size", modified.alias("modified"), F.col("source").alias("index_source")]
    if q is not None and "text" in rows.columns:
        columns.append(content.snippet(q, smart_case(q)).alias("snippet"))
    columns += ["exists"] if "exists" in rows.columns else []
    if "git" in rows.columns:
        columns.append(git_status().alias("git_status"))
    return rows.select(*columns)


def git_status() -> Column:
    """One word for the state in version control, the most telling first."""
    out = None
    for c in ("conflict", "modified", "staged", "ignored", "untracked", "clean", "tracked"):
        flag = F.coalesce(F.col(f"git.{c}"), F.lit(False))
        out = F.when(flag, c) if out is None else out.when(flag, c)
    return out


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def page_hash(page: DataFrame) -> DataFrame:
    """SHA-256 of the paths of one page in its order, each ended by a NUL: hash.

    The paths of an ordered page pass through the driver one partition at a time, so a page of any length has its
    hash; an empty page has that of nothing.
    """
    digest = hashlib.sha256()
    for row in page.select("path").toLocalIterator():
        digest.update(row["path"].encode() + b"\0")
    return page.sparkSession.createDataFrame([(digest.hexdigest(),)], "hash string")


def dedupe(rows: DataFrame) -> DataFrame:
    """One row a file: by (volume, record number), else (volume, lower-case path); the newest, then the first path, stays."""
    key = F.coalesce(F.concat(F.lit("f"), F.col("frn").cast("string")), F.concat(F.lit("p"), F.col("path_l")))
    columns = rows.columns
    best = (
        rows.withColumn("_k", key)
            .groupBy("volume", "_k")
            .agg(F.max_by(F.struct(*columns), F.struct("mod_ns", F.struct(*[c for c in ("path", "size") if c in columns]))).alias("r"))
    )
    return best.select("r.*")
