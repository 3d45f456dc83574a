import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from spindrift.functions.folding import words_only
from spindrift.llm import leakage
from spindrift.llm.wu_manber import Patterns

VERBS = "opens hides moves counts signs sends quotes tags".split()
NOUNS = "garden ledger manual harbour printer calendar teacher window river office button letter".split()
STOCK = "Please attach the output of the doctor command when you report a problem to us."


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([3, 6, 12, 20]), st.data())
def test_search_like_brute_force(length, data):
    patterns = data.draw(st.lists(st.text("ab ", min_size=length, max_size=length), min_size=1, max_size=5))
    texts = data.draw(st.lists(st.text("ab ", max_size=90), max_size=6))
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    pos, number = (
        Patterns([p.encode() for p in patterns], length).search(np.frombuffer("".join(texts).encode() + bytes(16), np.uint8), starts, lengths)
    )
    want = sorted(
        (int(s) + i, k) for s, t in zip(starts, texts) for i in range(len(t) - length + 1) for k, p in enumerate(patterns) if t[i : i + length] == p
    )
    assert sorted(zip(pos.tolist(), number.tolist())) == want


def sentence(r, n=14):
    return (
        " ".join(
            f"{r.choice(['the', 'every', 'our'])} {r.choice(NOUNS)} {r.choice(VERBS)}" if i % 3 == 0 else f"{r.choice(NOUNS)}{r.randint(1, 99)}"
            for i in range(n)
        )
            .capitalize()
        + "."
    )


def test_whole_sentences_runs_and_altered_text_leak_but_quotes_and_stock_do_not(spark):
    r = random.Random(1)
    items = [(k, [sentence(r) for _ in range(4)]) for k in range(30)]
    rows, want = [], set()

    def doc(text):
        rows.append((len(rows), " ".join([sentence(r), text, sentence(r)]), "clash"))
        return len(rows) - 1

    for k, own in items[:10]:
        want.add((k, doc(own[1])))  # one sentence
        want.add((k, doc("\n".join(own).upper().replace(" ", "  "))))  # everything, in capitals
        words = " ".join(own).split()
        half = len(words) // 2
        want.add((k, doc(" ".join(words[half // 2 : half // 2 + half + 4]))))  # a run of more than half
        altered = [w if i % 8 else "that" for i, w in enumerate(words)]
        want.add((k, doc(" ".join(altered))))
        doc("Somebody wrote “" + " ".join(own[0].split()[3:9]) + "”.")  # a short quotation
    for i in range(600):
        doc(STOCK if i % 10 == 0 else "")
    rows += [(9998, None, "x"), (9999, "", "x"), (None, items[0][1][0], "x"), (9997, "x" * 200_000, "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    tests = spark.createDataFrame(
        [(k, " ".join([*own, STOCK])) for k, own in items] + [(None, "x"), (77, None), (78, ""), (0, " ".join([*items[0][1], STOCK]))],
        "item_id long, text string"
    )
    got = {(x["item_id"], x["doc_id"]) for x in leakage.leaks(docs, tests).collect()}
    assert got == want
    assert leakage.leaks(docs.where("false"), tests).count() == 0 and leakage.leaks(docs, tests.where("false")).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    items = [(k, sentence(r)) for k in range(9)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 400)
    got = sorted((x["item_id"], x["doc_id"]) for x in leakage.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(k, k) for k in range(9)]


def _pairs(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(x["item_id"], x["doc_id"]) for x in leakage.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_copies_of_a_leaked_text_do_not_make_its_sentences_stock(spark):
    r = random.Random(3)
    own, other, one = ([sentence(r) for _ in range(4)] for _ in range(3))
    items = [(0, " ".join(own)), (1, " ".join(other)), (2, STOCK)]
    leaked = " ".join([sentence(r), *own, sentence(r)])
    docs = [leaked] * 30 + [f"{sentence(r)} {own[2]} {sentence(r)}"]  # one text, and one sentence elsewhere
    docs += [f"{sentence(r)} {' '.join(other)} {sentence(r)}" for _ in range(30)]  # different texts, more than half of an item in each
    docs += [f"{sentence(r)} {STOCK} {sentence(r)}" for _ in range(30)] + one
    assert _pairs(spark, docs, items) == {(0, k) for k in range(31)} | {(1, k) for k in range(31, 61)}


def test_a_run_around_a_stock_sentence_leaks(spark):
    r = random.Random(4)
    b, c = (sentence(r).split() for _ in range(2))
    items = [(0, " ".join([*b, STOCK, *c])), (1, f"{sentence(r, 5)} {STOCK}")]  # the stock is more than half of the second
    run = " ".join([*b[-(len(b) * 6 // 10) :], STOCK, *c[: len(c) * 6 // 10]])
    docs = (
        [f"{sentence(r)} {run} {sentence(r)}", f"{STOCK} {sentence(r) * 30} {run} {sentence(r)}"]
        + [f"{sentence(r)} {STOCK} {sentence(r)}" for _ in range(30)]
    )
    assert _pairs(spark, docs, items) == {(0, 0), (0, 1)}


def test_sentences_that_several_items_share_leak_in_any_blocks(spark, monkeypatch):
    r = random.Random(5)
    shared = [sentence(r) for _ in range(3)]
    items = [(k, " ".join([*shared, STOCK])) for k in range(-2, 3)]
    docs = (
        [f"{sentence(r)} {' '.join(shared)} {sentence(r)}", f"{sentence(r)} {shared[1]} {sentence(r)}"]
        + [f"{sentence(r)} {STOCK} {sentence(r)}" for _ in range(30)]
    )
    for size in (1, 700, 1 << 22):
        monkeypatch.setattr(leakage, "BLOCK_BYTES", size)
        assert _pairs(spark, docs, items) == {(k, d) for k in range(-2, 3) for d in (0, 1)}


def test_short_sentences_and_texts_leak_where_they_stand_as_sentences(spark):
    r = random.Random(6)
    items = [
        (0, "Go home now. " + sentence(r)), (1, "検索は速いです。索引は小さいままです。"), (2, "Ja."),
        (3, "Try it twice. Then rest. Wake up late. Eat well. Sing aloud.")
    ]
    docs = ["Go home now.", "He said: “Go\nhome now!” and left", "when you go home now and then", "検索は速いです。", "それから、検索は速いです。次へ", "ja, ja", "x\nJa\ny"]
    docs += ["they did it twice then rest wake up late eat well and so on", "", "-" * 100_000 + "\n" + "= " * 50_000]
    assert _pairs(spark, docs, items) == {(0, 0), (0, 1), (1, 3), (1, 4), (2, 6), (3, 7)}


def test_one_hit_and_long_words_are_enough(spark):
    r = random.Random(7)
    words = sentence(r, 12).rstrip(".").split()
    items = [(0, " ".join(words) + "."), (1, "The quick brown fox jumps over the lazy dog.")]
    long = [w + "x" * 40 if i % 5 == 4 else w for i, w in enumerate(words)]
    docs = [
        f"{sentence(r)} {' '.join(long)} {sentence(r)}", "once the quick brown cat jumps over the lazy dog again",
        "the slow brown fox sleeps below a lazy dog"
    ]
    assert _pairs(spark, docs, items) == {(0, 0), (1, 1)}


def test_a_run_in_a_script_of_wide_characters(spark):
    text = "索引は夜の間に静かに作られ古い記録は別の棚に移され利用者は朝になると新しい結果をすぐに見ることができる"
    docs = ["前置き" + text[5:40] + "後書き", "前置き" + text[5:15] + "後書き"]
    assert _pairs(spark, docs, [(0, text + "。")]) == {(0, 0)}


def test_folding_with_and_without_lines_holds_the_same_words(spark):
    texts = ["One two. Three\n\n“four” (five)", "…", "", "a.b c-d!e", "ÉCOLE naïve ＡＢ", "検索。索引", "-" * 50 + "x", " . \n . "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(leakage.sentence_lines(F.col("t")).alias("l"), words_only(F.col("t")).alias("w")).collect()
    assert all(r["l"].replace("\n", " ").strip() == r["w"] and r["l"].startswith("\n") and r["l"].endswith("\n") for r in got)
