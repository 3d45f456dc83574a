"""Texts, ranking, slips of the keys, sums, admission, the API and the feed as a stream."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.api import SYNTAX, Catalogue
from spindrift.functions.distance import budget, likely, osa, window
from spindrift.operators import admission, content, fuzzy, ranking, rollup, search
from spindrift.operators.changefeed import EqualityDeleteTable
from spindrift.plans.grammar import NANO, QueryError, Settings, parse
from spindrift.plans.predicates import required_literals
from spindrift.sources.entries import enriched
from spindrift.sources.walk import ROWS
from spindrift.streaming import feed

AT = Settings(now=1_782_847_516 * NANO)
FILES = [
    ("C:", 1, "C:\\src\\report.md", 32, 10, 5, "t", "One line\nabout the Journal\nand more\n"),
    ("C:", 2, "C:\\src\\Journal.h", 32, 20, 6, "t", "class Journal {\n"),
    ("C:", 3, "C:\\src\\deep\\reprot.py", 33, 30, 7, "t", "def journal():\n    return 1\n"),
    ("C:", 4, "C:\\src\\deep\\other.txt", 34, 40, 8, "t", None),
    ("C:", None, "C:\\src", 16, 0, 0, "t", None),
    ("C:", None, "C:\\src\\deep", 16, 0, 0, "t", None),
]


@pytest.fixture(scope="module")
def files(spark):
    return enriched(spark.createDataFrame(FILES, ROWS)).cache()


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance_is_symmetric_bounded_and_counts_swaps(a, b):
    d = osa(a, b, 9)
    assert d == osa(b, a, 9) and (d == 0) == (a == b) and d <= max(len(a), len(b))
    assert osa(a, b, 1) == min(d, 2)


def test_distance_examples():
    assert osa("report", "reprot", 2) == 1 and osa("ca", "abc", 3) == 3
    assert window("chorme", "google chrome setup", 1) == (1, 7)
    assert [budget(w) for w in ("ab", "abc", "abcdefgh")] == [0, 1, 2] and budget("abc", content=True) == 0


@given(st.text("abc", min_size=3, max_size=6), st.text("abc", max_size=9))
def test_window_like_all_stretches(term, name):
    most = 2
    best = min(((osa(term, name[i:j], most), i) for i in range(len(name) + 1) for j in range(i, len(name) + 1)), default=(most + 1, -1))
    got = window(term, name, most)
    assert got[0] == best[0] and (got[0] > most or osa(term, name[got[1] :], 99) >= got[0])
    for most in (1, 2):
        if got[0] <= most and len(term) >= (3 if most == 1 else 6):
            assert re.search(likely(term, most), name)


@given(st.text("abc", min_size=8, max_size=10), st.lists(st.tuples(st.sampled_from("dirs"), st.integers(0, 9), st.sampled_from("abcx")), max_size=2))
def test_no_name_within_the_edits_is_left_out_beforehand(term, edits):
    name = term
    for kind, i, c in edits:
        i = min(i, len(name) - 1)
        name = {
            "d": name[:i] + name[i + 1 :], "i": name[:i] + c + name[i:], "r": name[:i] + c + name[i + 1 :],
            "s": name[:i] + name[i : i + 2][::-1] + name[i + 2 :]
        }[kind]
    if osa(name, term, 2) <= 2:
        assert re.search(likely(term, 2), f"x{name}y")


def test_close_names_and_top_up(spark, files):
    q = parse("report", AT)
    assert [(r["name"], r["dist"]) for r in fuzzy.close_names(files, q).collect()] == [("report.md", 0), ("reprot.py", 1)]
    page = search.matching(files, q)
    assert [(r["name"], r["dist"]) for r in fuzzy.topped_up(files, page, q, 10).collect()] == [("report.md", 0), ("reprot.py", 1)]
    assert not fuzzy.eligible(parse("path:report", AT)) and not fuzzy.eligible(parse('"report"', AT))
    assert fuzzy.rewritten(files, parse("repotr md", AT))[1] == ["report", "md"]


def test_relevance_definitions_and_lines(files):
    found = [r["name"] for r in search.search(files, "content:journal sort:relevance", AT).collect()]
    assert found == ["Journal.h", "report.md", "reprot.py"] or found[0] in ("Journal.h", "reprot.py")
    assert {r["name"] for r in search.matching(files, parse("sym:Journal", AT)).collect()} == {"Journal.h"}
    assert {r["name"] for r in search.matching(files, parse("sym:journal", AT)).collect()} == {"reprot.py"}
    q = parse("content:Journal ext:md", AT)
    got = [(r["line"], r["match"]) for r in content.lines(search.matching(files, q), q, before=1, after=1).orderBy("line").collect()]
    assert got == [(1, False), (2, True), (3, False)]
    assert search.results(search.matching(files, q), q).collect()[0]["snippet"] == "One line about the Journal and more "


def test_vocabulary_and_near_words(files):
    words = {r["term"]: (r["tf"], r["df"]) for r in content.vocabulary(files).collect()}
    assert words["journal"] == (3, 3) and words["line"] == (1, 1)
    assert [r["term"] for r in content.near_words(files, "jurnal", 1).collect()] == ["journal"]
    assert search.matching(files, parse("content~1:jurnal", AT)).count() == 3
    assert search.matching(files, parse("content~1:zzzz", AT)).count() == 0


def test_searches_without_a_match_are_respelt(spark, files):
    shop = Catalogue(files).content_index()
    assert [r["name"] for r in shop.search("jurnal", AT).collect()] == ["Journal.h"]  # close names
    assert [r["name"] for r in shop.search("jurnal", AT, forgive=False).collect()] == []
    assert [r["name"] for r in shop.search("repotr md", AT).collect()] == ["report.md"]  # one of several terms
    assert sorted(r["name"] for r in shop.search("content:jurnal", AT).collect()) == ["Journal.h", "report.md", "reprot.py"]
    assert shop.count("content:jurnal", AT).collect()[0]["n"] == 3 and shop.count("content:jurnal", AT, forgive=False).collect()[0]["n"] == 0
    assert shop.count('content:"abuot the jurnal"', AT).collect()[0]["n"] == 1  # all words at once
    assert shop.count("content:zzzzzz", AT).collect()[0]["n"] == 0 and shop.count("content:Jurnal", AT).collect()[0]["n"] == 0  # with case
    assert [r["name"] for r in shop.content("line", AT).collect()] == ["report.md"]


def test_files_named_after_a_symbol_come_first(files):
    assert [r["name"] for r in search.search(files, "content:journal", AT).collect()] == ["Journal.h", "report.md", "reprot.py"]
    assert content.promotion(parse("content:one content:two", AT)) is None and content.promotion(parse("content:a", AT)) is None
    assert [r["name"] for r in search.search(files, "content:/(def|about) .*/", AT).collect()] == ["report.md", "reprot.py"]
    assert search.search(files, r"content:/it's|journal/", AT).count() == 3


def test_folders_are_sorted_by_the_bytes_below(files):
    got = [(r["name"], r["size"]) for r in search.search(files, "path:src sort:size", AT).collect()]
    assert got == [("report.md", 10), ("Journal.h", 20), ("reprot.py", 30), ("other.txt", 40), ("deep", 70), ("src", 100)]


@pytest.mark.parametrize("sort", ["", "size", "modified", "extension", "type", "path"])
def test_pages_by_key_are_the_whole(files, sort):
    shop, text = Catalogue(files, identity="v1"), f"in:C:\\src sort:{sort}" if sort else "in:C:\\src"
    whole = [r["path"] for r in shop.search(text, AT, 100).collect()]
    seen, cursor = [], ""
    while True:
        page = shop.search(text, AT, 2, cursor=cursor)
        seen += [r["path"] for r in page.collect()]
        cursor = shop.cursor_behind(page, text, AT)
        if cursor is None:
            break
    assert seen == whole and len(whole) == 6
    token = shop.cursor_behind(shop.search(text, AT, 2), text, AT)
    with pytest.raises(QueryError, match="changed"):
        Catalogue(files, identity="v2").search(text, AT, cursor=token)
    with pytest.raises(QueryError, match="another"):
        shop.search("ext:md", AT, cursor=token)


def test_only_files_that_are_there(spark, tmp_path):
    (tmp_path / "here.txt").write_text("x")
    files = enriched(spark.createDataFrame([("/", i, f"{tmp_path}/{n}.txt", 32, 1, 1, "t", None) for i, n in enumerate(("here", "gone"))], ROWS))
    shop, under = Catalogue(files), Settings(now=1, under=str(tmp_path).replace("/", "\\"))
    assert [r["name"] for r in shop.search("ext:txt", AT, existing=True).collect()] == ["here.txt"]
    assert [r["name"] for r in shop.search("ext:txt", under).collect()] == ["here.txt"]  # a folder of this machine
    assert shop.search("ext:txt", AT).count() == 2 and shop.count("ext:txt", under).collect()[0]["n"] == 2


def test_a_folder_that_the_listing_does_not_know_is_listed(files, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "found.txt").write_text("x")
    under = Settings(now=1, under=str(tmp_path).replace("/", "\\"))
    shop = Catalogue(files)
    assert [r["name"] for r in shop.search("found", under).collect()] == ["found.txt"]
    assert shop.search("found", under, forgive=False).count() == 0 and shop.count("found", under).collect()[0]["n"] == 0


def test_page_hash_of_any_length(spark):
    import hashlib

    paths = [f"C:\\p{i:06}" for i in range(60_000)]
    page = spark.createDataFrame([(p,) for p in paths], "path string").repartition(3).orderBy("path")
    assert search.page_hash(page).collect()[0]["hash"] == hashlib.sha256(b"".join(p.encode() + b"\0" for p in paths)).hexdigest()


def test_sums_over_folders(files):
    sums = {r["path"]: (r["bytes"], r["files"]) for r in rollup.folder_bytes(files).collect()}
    assert sums == {"C:": (100, 4), "C:\\src": (100, 4), "C:\\src\\deep": (70, 2)}
    sized = {r["path"]: r["size"] for r in rollup.with_sizes(files).collect()}
    assert sized["C:\\src"] == 100 and sized["C:\\src\\report.md"] == 10


def test_literals_of_patterns_only_widen():
    assert required_literals(r".*test.*\.cc$") == ["test", ".cc"] and required_literals("a|b") == [] and required_literals("(abc)?") == []
    assert required_literals("corpus.*amber") == ["corpus", "amber"] and required_literals("colou?r") == ["colo"]


def test_admission_reasons(spark):
    paths = [
        "C:\\a\\x.exe", "C:\\a\\go.sum", "C:\\a\\big.json", "C:\\a\\x.min.js", "C:\\build\\x.c", "C:\\node_modules\\x.c", "C:\\.cache\\x.c",
        "C:\\repo\\build\\x.c", "C:\\repo\\skip.log", "C:\\repo\\keep.log", "C:\\a\\build"
    ]
    rows = enriched(spark.createDataFrame([("C:", i, p, 32, 200_000, 1, "t", None) for i, p in enumerate(paths)], ROWS))
    rules = {"C:\\repo": admission.ignore_rules(["# no", "*.log", "!keep.log", "/out/"])}
    why = {r["path"]: r["why"] for r in rows.select("path", admission.reason(repositories=["C:\\repo"], rules=rules).alias("why")).collect()}
    assert [why[p] for p in paths] == [
        "binary", "lockfile", "large_json", "minified", "build_output", "dependency", "cache", None, "gitignore", None, None
    ]
    text = spark.createDataFrame([("x" * 50_000,), ("short\n" * 20_000,)], "t string")
    assert [r[0] for r in text.select(admission.minified_text(F.col("t"))).collect()] == [True, False]


def test_signals_reorder_inside_bands_only(spark, files):
    signals = spark.createDataFrame(
        [("u", "C:\\src\\deep\\reprot.py", 3, 9.0, 1)], "user_id string, path string, opens long, score double, last_open_unix long"
    )
    picks = spark.createDataFrame(
        [("u", "r", "C:\\src\\deep\\other.txt", 5, 1)], "user_id string, query_norm string, path string, pick_count long, last_unix long"
    )
    shop = Catalogue(files, signals, picks)
    got = [r["name"] for r in shop.ranked("r type:file", "u", AT).orderBy("place").collect()]
    assert got[:2] == ["reprot.py", "report.md"]
    nobody = [(r["position"], r["place"]) for r in shop.ranked("r", "nobody", AT).collect()]
    assert all(a == b for a, b in nobody)
    assert shop.opened("u", "C:\\x", 99).recent(1).collect()[0]["path"] == "C:\\x"
    hops = (
        spark.createDataFrame([("C:\\a\\b\\x",), ("C:\\a\\y",), ("D:\\z",)], "path string").select(ranking.hops(F.col("path"), "C:\\a\\b")).collect()
    )
    assert [h[0] for h in hops] == [0, 1, 4]


def test_repository_state_comes_from_the_deepest_root(spark):
    paths = spark.createDataFrame([("C:\\r\\a",), ("C:\\r\\s\\b",), ("C:\\x",)], "path string")
    roots = spark.createDataFrame([("C:\\r",), ("C:\\r\\s",)], "root string")
    states = spark.createDataFrame(
        [("C:\\r", "a", True), ("C:\\r", "s\\b", False), ("C:\\r\\s", "b", True)], "root string, relative string, modified boolean"
    )
    got = {r["path"]: r["git"]["modified"] if r["git"] else None for r in ranking.evidence(paths, roots, states).collect()}
    assert got == {"C:\\r\\a": True, "C:\\r\\s\\b": True, "C:\\x": None}


def test_api(files):
    shop = Catalogue(files)
    assert shop.count("ext:md", AT).collect()[0]["n"] == 1 and shop.info().count() == 1
    assert [r["name"] for r in shop.search("repotr~", AT).collect()] == ["report.md", "reprot.py"] or shop.search("repotr~", AT).count() >= 1
    token = shop.next_cursor("type:file", AT, 2)
    assert shop.search("type:file", AT, cursor=token).count() == 2
    assert shop.watch(files.where("frn = 1")).where("event = 'created'").count() == 5
    assert "content~" in SYNTAX and shop.bench(["ext:md"], AT, 1).count() == 1


def test_companions_are_conditions(files):
    shop = Catalogue(files, features={"big": lambda term: F.col("size") > int(term)})
    assert shop.count("feature:big:25", AT).collect()[0]["n"] == 2


def test_companions_may_be_sets_of_files(spark, files):
    found = spark.createDataFrame([("C:", 1), ("C:", 1), ("D:", 2), ("C:", None), ("C:", 4)], "volume string, frn long")
    shop = Catalogue(files, features={"set": lambda term: found.where(F.col("frn") >= int(term))})
    assert sorted(r["name"] for r in shop.search("feature:set:1", AT).collect()) == ["other.txt", "report.md"]
    assert sorted(r["name"] for r in shop.search("!feature:set:1 type:file", AT).collect()) == ["Journal.h", "reprot.py"]
    assert sorted(r["name"] for r in shop.search("feature:set:3|ext:h", AT).collect()) == ["Journal.h", "other.txt"]


def test_files_of_the_latest_commits_come_before_others(spark, files):
    none = spark.createDataFrame([], "user_id string, path string, opens long, score double, last_open_unix long")
    picks = spark.createDataFrame([], "user_id string, query_norm string, path string, pick_count long, last_unix long")
    commits = spark.createDataFrame([("C:\\src\\deep\\other.txt",)], "path string")
    got = [r["name"] for r in Catalogue(files, none, picks).ranked("e", "u", AT, commits=commits).orderBy("place").collect()]
    assert got.index("deep") < got.index("report.md") and got.index("other.txt") < got.index("reprot.py")


def test_caps_worktrees_and_estimates(spark):
    mb = 1 << 20
    data = [
        ("C:", 1, "C:\\a\\big.txt", 32, mb + 10, 1, "t", "é" * (mb // 2 + 5)), ("C:", 2, "C:\\a\\huge.txt", 32, 3 * mb, 1, "t", "x"),
        ("C:", 3, "C:\\r\\big.txt", 32, 3 * mb, 1, "t", "x" * (3 * mb)),
        ("C:", 4, "C:\\w\\.git", 32, 9, 1, "t", "gitdir: C:\\r\\.git\\worktrees\\w\n"), ("C:", 5, "C:\\r\\.git", 16, 0, 1, "t", None),
        ("C:", 6, "C:\\r\\go.sum", 32, 7, 1, "t", None)
    ]
    files = enriched(spark.createDataFrame(data, ROWS))
    got = {
        r["frn"]: (len(r["text"].encode()) if r["text"] else None, r["truncated"], r["skipped"])
        for r in admission.capped(files, ["C:\\r"]).where("frn < 4").collect()
    }
    assert got == {1: (mb, True, False), 2: (None, False, True), 3: (3 * mb, False, False)}
    assert [r["root"] for r in admission.linked_worktrees(files).collect()] == ["C:\\w"]
    sums = {
        (r["unit"], r["ext"], r["reason"]): (r["files"], r["bytes"])
        for r in admission.estimate(files, admission.reason(), ["C:\\a", "C:\\r"], ["C:\\r"]).collect()
    }
    assert sums == {("C:\\a", "txt", "admitted"): (2, 2 * mb), ("C:\\r", "txt", "admitted"): (1, 3 * mb), ("C:\\r", "sum", "lockfile"): (1, 7)}


def test_ignore_files_deepest_wins_and_ignored_folders_are_final(spark):
    rules = {
        "C:\\r\\sub": admission.ignore_rules(["!*.log", "tmp"]),
        "C:\\r": admission.ignore_rules(["*.log", "out/", "!out/keep.txt", "/only.md", "name/"])
    }
    want = {
        "C:\\r\\a.log": True, "C:\\r\\sub\\a.log": False, "C:\\r\\out\\keep.txt": True, "C:\\r\\sub\\only.md": False, "C:\\r\\only.md": True,
        "C:\\r\\sub\\tmp\\x.log": True, "C:\\r\\name": False, "C:\\r\\A.LOG": False, "C:\\x\\a.log": False
    }
    rows = spark.createDataFrame([(p, False) for p in want], "path string, is_dir boolean")
    assert {r["path"]: r["i"] for r in rows.select("path", admission.ignored(F.col("path"), F.col("is_dir"), rules).alias("i")).collect()} == want


def test_watch_events(spark):
    schema = "volume string, frn long, path string, size long, mod_ns long"
    old = spark.createDataFrame([("C:", 1, "a", 1, 1), ("C:", 2, "b", 1, 1), ("C:", 3, "c", 1, 1), ("C:", 4, "d", None, 1)], schema)
    new = spark.createDataFrame([("C:", 1, "a", 2, 1), ("C:", 2, "b2", 1, 1), ("C:", 4, "d", None, 1), ("C:", 5, "e", 1, 1)], schema)
    got = sorted((r["event"], r["path"]) for r in feed.watch(old, new).collect())
    assert got == [("created", "b2"), ("created", "e"), ("deleted", "b"), ("deleted", "c"), ("modified", "a")]


def test_cursors_of_a_watcher(spark):
    schema = "volume string, frn long, seq long, deleted boolean, path string, size long, mod_ns long"
    changes = spark.createDataFrame(
        [
            ("C:", 1, 1, False, "a", 1, 1), ("C:", 1, 5, False, "b", 1, 1), ("C:", 2, 6, False, "c", 1, 1), ("C:", 2, 7, True, None, None, None),
            ("C:", 3, 2, False, "d", 1, 1), ("C:", 3, 2, False, "d", 1, 1), ("D:", 1, 3, False, "x", 1, 1), ("E:", 1, 4, False, "y", 1, 1),
            (None, 1, 9, False, "z", 1, 1), ("C:", 0, 9, False, "z", 1, 1)
        ],
        schema
    )
    cursors, events = feed.watch_from(changes, spark.createDataFrame([("C:", 2), ("D:", 99)], "volume string, seq long"))
    assert sorted(map(tuple, cursors.collect())) == [("C:", 9, False), ("D:", 3, True), ("E:", 4, False)]
    assert sorted((r["event"], r["path"]) for r in events.collect()) == [("created", "b"), ("deleted", "a")]
    none = changes.where("false")
    assert [x.count() for x in feed.watch_from(none, spark.createDataFrame([("C:", 2)], "volume string, seq long"))] == [0, 0]


def test_folders_renamed_and_volumes_apart(spark):
    rows = [("C:", 1, "C:\\a\\x"), ("C:", 2, "C:\\a\\b\\y"), ("C:", 3, "C:\\ab"), ("D:", 4, "C:\\a\\x"), ("C:", 5, "C:\\A")]
    files = spark.createDataFrame(rows, "volume string, frn long, path string")
    moves = spark.createDataFrame([("C:", "C:\\a", "E:\\n"), ("C:", "C:\\a\\b", "C:\\m")], "volume string, old string, new string")
    assert {r["frn"]: r["path"] for r in feed.renamed(files, moves).collect()} == {
        1: "E:\\n\\x", 2: "C:\\m\\y", 3: "C:\\ab", 4: "C:\\a\\x", 5: "E:\\n"
    }
    gone = spark.createDataFrame([("C:", "c:\\a")], "volume string, path_l string")
    assert sorted(r["frn"] for r in feed.cascade(files.withColumn("path_l", F.lower("path")), gone).collect()) == [3, 4]


def test_a_table_is_the_same_when_folded(spark):
    r = random.Random(8)
    rows = [("C:", r.randint(1, 30), i, r.random() < 0.4, f"p{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "volume string, frn long, usn long, deleted boolean, path string")
    whole = EqualityDeleteTable.fresh(spark, ["volume", "frn"], ["usn"])
    parts = EqualityDeleteTable.fresh(spark, ["volume", "frn"], ["usn"])
    whole.append(df, "deleted", ["path"])
    for part in (
        df.where("usn >= 150 and deleted"), df.where("usn >= 150 and not deleted"), df.where("usn between 50 and 149"), df.where("usn < 50")
    ):
        parts.append(part, "deleted", ["path"])
        parts = parts.fold()  # a deletion outlives the folding: earlier changes come after it
    assert sorted(map(tuple, parts.read().collect())) == sorted(map(tuple, whole.read().select(*parts.read().columns).collect()))


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    r = random.Random(1)
    schema = "volume string, frn long, checkpoint_usn long, feed_cursor long, deleted boolean"
    data = [("C:", r.randint(1, 9), i, 0, r.random() < 0.3) for i in range(90)]
    r.shuffle(data)
    at = EqualityDeleteTable(spark, str(tmp_path / "table"), ["volume", "frn"], ["checkpoint_usn", "feed_cursor"])
    for part in (data[:40], data[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed.apply_stream(feed.file_stream(spark, str(tmp_path / "in"), schema), at, "deleted", str(tmp_path / "progress")).awaitTermination()
    want = {}
    for v, f, u, _, d in sorted(data, key=lambda x: x[2]):
        want[f] = None if d else u
    assert {x["frn"]: x["checkpoint_usn"] for x in at.read().collect()} == {f: u for f, u in want.items() if u is not None}


def test_a_stream_leaves_out_its_own_files(spark, tmp_path):
    schema = "volume string, frn long, checkpoint_usn long, feed_cursor long, deleted boolean, path string"
    rows = [("C:", i, i, 0, False, p) for i, p in enumerate(["C:\\Own\\x", "C:/own/y/z", "C:\\own", "C:\\owner\\x", None], 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    at = EqualityDeleteTable(spark, str(tmp_path / "table"), ["volume", "frn"], ["checkpoint_usn", "feed_cursor"])
    feed.apply_stream(
        feed.file_stream(spark, str(tmp_path / "in"), schema), at, "deleted", str(tmp_path / "c"), floor="checkpoint_usn > 0", own=["c:\\own"]
    ).awaitTermination()
    assert sorted(r["frn"] for r in at.read().collect()) == [4, 5]
    late = feed.apply_stream(feed.file_stream(spark, str(tmp_path / "in"), schema), at, "deleted", str(tmp_path / "c2"), every="200 milliseconds")
    late.processAllAvailable()
    late.stop()
    assert at.read().count() == 5


def test_overlay_cascade_and_occupants(spark):
    base = spark.createDataFrame([("C:", 1, "C:\\a"), ("C:", 2, "C:\\b")], "volume string, frn long, path string")
    changes = spark.createDataFrame(
        [
            ("C:", 1, 5, 1, True, None), ("C:", 1, 4, 1, False, "C:\\a2"), ("C:", 3, 6, 1, False, "C:\\c"), ("C:", 2, 1, 1, True, None),
            ("C:", 0, 9, 1, False, "C:\\z")
        ],
        "volume string, frn long, usn long, seq long, deleted boolean, path string"
    )
    assert sorted(r["path"] for r in feed.overlay(base, changes, "usn >= 3").collect()) == ["C:\\b", "C:\\c"]
    files = enriched(spark.createDataFrame([("C:", 1, "C:\\x\\y\\z", 32, 1, 1, "t", None), ("C:", 2, "C:\\xy", 32, 1, 1, "t", None)], ROWS))
    assert [r["path"] for r in feed.cascade(files, spark.createDataFrame([("C:", "c:\\x")], "volume string, path_l string")).collect()] == ["C:\\xy"]
    reused = spark.createDataFrame([("C:", 1, 1, 5), ("C:", 1, 2, 9), ("C:", 1, 2, 10)], "volume string, frn long, seq long, usn long")
    assert sorted(r["usn"] for r in feed.current_occupant(reused).collect()) == [9, 10]


def test_long_lines_are_printed_cut_behind_a_whole_character(spark, tmp_path, monkeypatch):
    from spindrift import catalogue_queries

    lines = [
        "Journal " + "x" * 492, "Journal " + "x" * 493, "Journal " + "é" * 400, "Journal x" + "é" * 300, "Journal " + "検" * 200, "Journal ends…",
        "other " + "x" * 600
    ]
    files = enriched(
        spark.createDataFrame(
            [("C:", 1, r"C:\a.txt", 32, 0, 0, "x", "\n".join(lines))],
            "volume string, frn long, path string, mode long, size long, mod_ns long, source string, text string"
        )
    )
    monkeypatch.setattr(catalogue_queries, "entries", lambda *_: files)
    want = [lines[0], lines[0] + "…", "Journal " + "é" * 246 + "…", "Journal x" + "é" * 245 + "…", "Journal " + "検" * 164 + "…", lines[5]]
    assert [
        r["shown"] for r in catalogue_queries.o_grep(spark, "").orderBy("line").collect()
    ] == [rf"C:\a.txt:{k}:{t}" for k, t in enumerate(want, 1)]
