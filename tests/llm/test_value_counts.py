import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.llm import queries, value_counts

SCHEMA = "posting_kind string, shard string, term string, doc_id long, tf long, entry_count long, gram_count long, single boolean, shard_total long, received_at timestamp, space string, record string"
T = datetime(2026, 1, 1)


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_grams_like_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(value_counts, "BLOCK", block)
    texts = [
        (1, ["a", "b", "a", "b", "c"]), (2, ["a", "b", "a"]), (3, []), (4, ["b"] * 40), (5, None), (6, ["a", "b", "a", "b", "c"]),
        (7, ["é" * 500, "a"])
    ]
    occurs, records = Counter(), defaultdict(set)
    for i, t in texts:
        for n in (1, 2, 3):
            for j in range(len(t or []) - n + 1):
                occurs[tuple(t[j : j + n])] += 1
                records[tuple(t[j : j + n])].add(i)
    df = spark.createDataFrame(texts, "id long, t array<string>").repartition(3)
    got = value_counts.gram_counts(value_counts.text_suffixes(df, "id", F.col("t"), 3), 3).collect()
    assert {
        tuple(x for x in (r["t1"], r["t2"], r["t3"])[: r["n"]]): (r["occurrences"], r["records"]) for r in got
    } == {k: (occurs[k], len(records[k])) for k in occurs}


def test_frequent_grams_of_texts(spark):
    texts = (
        [(i, f"the red fox no{i} the red") for i in range(30)]
        + [(31, None), (32, ""), (None, "the red"), (33, "fox " * 50_000), (34, "red fox"), (35, "red fox"), (36, "fox, red!")]
    )
    got = {
        r["gram"]: (r["n"], r["occurrences"], r["records"], r["mark"])
        for r in value_counts.text_grams(spark.createDataFrame(texts, "id long, t string"), "id", "t", 2, common_share=0.93).collect()
    }
    assert got == {
        "the": (1, 60, 30, None), "red": (1, 63, 33, "common"), "fox": (1, 50_033, 34, "common"), "the red": (2, 60, 30, None),
        "red fox": (2, 32, 32, None)
    }


@pytest.mark.parametrize("block", [8, 1 << 18])
def test_all_grams_of_texts_with_marks(spark, block, monkeypatch):
    monkeypatch.setattr(value_counts, "BLOCK", block)
    texts = (
        [(i, f"the red fox no{i} the red") for i in range(12)]
        + [(12, "fox, red! once"), (13, "fox red once"), (14, "once alone alone"), (14, "once alone alone"), (15, ""), (16, None), (None, "lost")]
    )
    occurs, records = Counter(), defaultdict(set)
    for i, t in texts:
        words = re.findall(r"[^\W_]+", t or "") if i is not None else []
        for n in (1, 2, 3):
            for j in range(len(words) - n + 1):
                gram = (n, " ".join(words[j : j + n]))
                occurs[gram] += 1
                records[gram].add(i)
    mark = lambda held: "rare" if held < 3 else "common" if held > 16 * 0.8 else None
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    got = value_counts.marked_grams(df, "id", "t", 3, common_share=0.8).collect()
    assert len(got) == len(occurs)
    assert {(r["n"], r["gram"]): (r["occurrences"], r["records"], r["mark"]) for r in got} == {
        k: (occurs[k], len(records[k]), mark(len(records[k]))) for k in occurs
    }
    assert Counter(r["mark"] for r in got)["rare"] > len(got) / 2  # most of the work
    shown = value_counts.text_grams(df, "id", "t", 3, common_share=0.8).collect()
    assert set(shown) == {r for r in got if r["mark"] != "rare"}


def test_all_grams_are_a_query_with_marks(spark, tmp_path):
    texts = [(i, "one two") for i in range(4)] + [(4, "one once")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["gram"]: (r["n"], r["occurrences"], r["records"], r["mark"]) for r in queries.QUERIES["p1_all_grams"](spark, str(tmp_path)).collect()}
    assert got == {
        "one": (1, 5, 5, "common"), "two": (1, 4, 4, "common"), "once": (1, 1, 1, "rare"), "one two": (2, 4, 4, "common"),
        "one once": (2, 1, 1, "rare")
    }


def test_terms_latest_delivery_marks_and_odd_rows(spark):
    d = lambda term, doc, tf, day=0, kind="doc_tf", shard="s1": (kind, shard, term, doc, tf, None, None, None, 50, T + timedelta(days=day), "x", "y")
    rows = (
        [d("hot", i, 2) for i in range(20)]
        + [d("rare", 1, 5), d("rare", 1, 7, 1), d("rare", 1, 7, 1), d("rare", 2, 1)]
        + [d("mid", i, 1) for i in range(4)]
    )
    rows += [
        d(None, 1, 1), d("zero", 1, 0), d("none", 1, None), (None, "s1", "x", 1, 1, None, None, None, 50, T, None, None), d("late", 3, 1, 5),
        d("late", 3, 9, 2)
    ]
    rows += [("gram_entry", s, "abc", None, None, n, None, False, t, T, None, None) for s, n, t in (("s1", 1, 60), ("s2", 8, 20))]
    got = {
        (r["posting_kind"], r["term"]): (r["occurrences"], r["records"], r["mark"])
        for r in value_counts.term_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    assert got == {
        ("doc_tf", "hot"): (40, 20, "common"), ("doc_tf", "rare"): (8, 2, "rare"), ("doc_tf", "mid"): (4, 4, None),
        ("doc_tf", "late"): (1, 1, "rare"), ("gram_entry", "abc"): (9, 9, "common")
    }
    assert value_counts.term_counts(spark.createDataFrame([], SCHEMA)).count() == 0
