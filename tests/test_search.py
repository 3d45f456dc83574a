"""Conditions and orders against a second, plain implementation, over random entries and queries."""

import random

import pytest

from spindrift.functions.folding import fold
from spindrift.operators import search
from spindrift.plans.grammar import NANO, QueryError, Settings, parse
from spindrift.sources.entries import enriched
from spindrift.sources.walk import ROWS

AT = Settings(now=1_782_847_516 * NANO)
WORDS = ["main", "src", "Test", "Résumé", "data", "журнал", "資料", "a", "read me", "x.y"]
EXTS = ["go", "md", "PDF", "txt", ""]


def rows(seed, n=240):
    r = random.Random(seed)
    out = []
    for i in range(n):
        parts = [r.choice(["C:", "D:"])] + [r.choice(WORDS) for _ in range(r.randint(0, 3))]
        ext = r.choice(EXTS)
        name = r.choice(WORDS) + r.choice(["", f"_{i}"]) + (f".{ext}" if ext else "")
        text = None if r.random() < 0.3 else "\n".join(r.choice(WORDS) for _ in range(5))
        out.append(
            (
                parts[0], i + 1, "\\".join([*parts, name]), 0x10 if r.random() < 0.2 else r.choice([0x20, 0x21, 0x22]),
                r.choice([0, 10, 5000, 2 << 20]), r.choice([0, AT.now - 3600 * NANO, AT.now - 40 * 86400 * NANO]), "t", text
            )
        )
    return out


def plain(row, q):
    """A second implementation of conditions, row by row."""
    _, _, path, mode, size, mod, _, text = row
    name = path.split("\\")[-1]
    hay = path if q.path_mode else name

    def has(h, v, quoted=False):
        return v in h if q.exact_case else v in h.lower() or (not quoted and fold(v) in fold(h))

    def leaf(x):
        v = x.value
        if x.kind == "term":
            return has(hay, v, x.quoted)
        if x.kind == "ext":
            return ("." in name) and name.rsplit(".", 1)[-1].lower() == v
        if x.kind == "dir":
            return has(path, v)
        if x.kind == "starts":
            return name.lower().startswith(v) or fold(name).startswith(fold(v))
        if x.kind == "any":
            return any(plain(row, y) for y in v)
        if x.kind == "not":
            return not plain(row, v)
        if x.kind == "size":
            return {">": size > v[1], "<": size < v[1], ">=": size >= v[1], "<=": size <= v[1], "=": size == v[1]}[v[0]]
        if x.kind == "when":
            return mod != 0 and mod >= v[0] and (v[1] is None or mod < v[1])
        if x.kind == "attributes":
            return mode & v == v
        if x.kind == "volume":
            return path[:2].upper() == v
        if x.kind == "content":
            return text is not None and (v in text.lower() or (fold(v) == v and v in fold(text)))
        raise AssertionError(x.kind)

    return not q.impossible and all(leaf(x) for x in q.leaves) and (not q.kind or (q.kind == "dir") == bool(mode & 0x10))


QUERIES = [
    "main", "src main", '"read me"', "resume", "résumé", "журнал", "資料", "ext:go", "ext:pdf|txt", "type:dir", "type:file !main", "dir:src",
    "path:src main", "!main x", "main|data", "size:>1k", "dm:today", "attrib:A", "^re", "C: main", "content:main", "!content:main ext:md",
    "ext:md content:data|test", "a", "x.y"
]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_like_the_plain_implementation(spark, seed):
    data = rows(seed)
    entries = enriched(spark.createDataFrame(data, ROWS)).cache()
    for text in QUERIES:
        q = parse(text, AT)
        got = sorted(r["frn"] for r in search.matching(entries, q).select("frn").collect())
        assert got == sorted(x[1] for x in data if plain(x, q)), text


def test_order_of_tokens_limits_and_impossible_negations_change_nothing(spark):
    entries = enriched(spark.createDataFrame(rows(3), ROWS)).cache()
    page = lambda text, n=50: [r["path"] for r in search.search(entries, text, AT, limit=n).select("path").collect()]
    assert page("main type:file ext:go") == page("ext:go main type:file")
    assert page("main", 10) == page("main", 50)[:10]
    assert page("main !nohit-zzz") == page("main")
    assert search.count(entries, "main", AT).collect()[0]["n"] == len(page("main", 10_000))


def test_sorts(spark):
    entries = enriched(spark.createDataFrame(rows(4), ROWS)).cache()
    got = [(r["size"], r["name_l"]) for r in search.search(entries, "a sort:size", AT, limit=500).collect()]
    assert got == sorted(got)
    times = [r["mod_ns"] for r in search.search(entries, "a sort:modified", AT, limit=500).collect()]
    known = [t for t in times if t]
    assert known == sorted(known, reverse=True) and times == known + [0] * (len(times) - len(known))


def test_cursor_belongs_to_its_query():
    token = search.cursor("main", AT, 100)
    assert search.resume(token, "main", AT) == 100
    with pytest.raises(QueryError):
        search.resume(token, "other", AT)
    with pytest.raises(QueryError):
        search.resume("rubbish", "main", AT)


def test_missing_columns_are_an_error(spark):
    entries = enriched(spark.createDataFrame(rows(5, 5), ROWS)).drop("text")
    with pytest.raises(QueryError):
        search.matching(entries, parse("content:x", AT)).count()
    with pytest.raises(QueryError):
        search.matching(entries, parse("git:clean", AT)).count()


def test_empty_listing_and_null_paths(spark):
    assert search.search(enriched(spark.createDataFrame([], ROWS)), "x", AT).count() == 0
    odd = [("C:", None, None, None, None, None, None, None), ("C:", 1, "C:\\x", None, None, None, None, None)]
    got = search.search(enriched(spark.createDataFrame(odd, ROWS)), "x", AT).collect()
    assert [(r["path"], r["size"], r["mod_ns"]) for r in got] == [("C:\\x", 0, 0)]
