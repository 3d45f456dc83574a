import random

from spindrift.llm import truncation

NOUNS = "garden ledger manual harbour printer calendar teacher window river office button letter".split()


def prose(r, n=6):
    return " ".join(f"The {r.choice(NOUNS)} near the {r.choice(NOUNS)} hides every {r.choice(NOUNS)} behind our {r.choice(NOUNS)}." for _ in range(n))


def test_cut_texts_are_found_and_whole_ones_are_not(spark):
    r = random.Random(3)
    rows, cut = [], set()

    def add(text, source="a", bad=False):
        rows.append((len(rows), text, source, "clash"))
        if bad:
            cut.add(len(rows) - 1)

    for i in range(300):
        add(prose(r) + r.choice(["", "\n\nSee also X:\\a\\b.md", "\n\nBest wishes\nriver team", "\n- add garden.md", "\nwatch = true"]), f"s{i % 5}")
    for i in range(60):
        text = prose(r, 12)[:500]
        add(text, "limited", not text.endswith("."))
    for i in range(20):
        add(prose(r)[: 200 + i].rstrip(". ") + " and" + r.choice(["...", "…", " [truncated]"]), "b", True)
    words = prose(r).split()
    add(" ".join(words[:20]) + " The gard", "c", True)  # in the middle of a word
    add(" ".join(words[:20]) + " The garden near the", "c", True)  # in the middle of a sentence
    add(prose(r) + " \n ", "c")
    add('The entry is called "Open garden with..."', "c")
    for text in (None, "", "   ", "\n"):
        add(text, None)
    add(prose(r, 20_000), "long")
    rows += [(None, "The gard", "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut string")
    assert {x["doc_id"] for x in truncation.truncated(df).collect()} == cut
    shares = {x["source"]: (x["texts"], x["cut"]) for x in truncation.by_source(df).collect()}
    assert shares["b"] == (20, 20) and shares["s1"] == (60, 0) and shares[None] == (4, 0)
    assert truncation.truncated(df.where("false")).count() == 0


def test_trie_holds_proper_prefixes(spark):
    words = spark.createDataFrame([("car",), ("cart",), ("c",)], "word string")
    assert sorted(map(tuple, truncation.trie(words).collect())) == [("c", 2), ("ca", 2), ("car", 1)]


def test_long_marks_and_peaks_beside_others(spark):
    r = random.Random(4)
    rows = (
        [(k, prose(r), "a") for k in range(60)]
        + [(100, prose(r)[:100].rstrip() + " gar" + " [truncated]" * 30, "a"), (101, prose(r) + " ..." * 60, "a")]
    )
    texts = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {x["doc_id"]: x for x in truncation.endings(texts).where("doc_id >= 100").collect()}
    assert found[100]["marker"] and found[100]["prefix"] and found[100]["cut"] and not found[101]["cut"]
    judged = [
        (s, n, 0, 1000 * n + k, True)
        for s, n, times in (("a", 50, 6), ("a", 55, 1), ("a", 300, 6), ("a", 310, 3), (None, 50, 3), ("b", 50, 2))
        for k in range(times)
    ]
    judged += [("a", 700, 0, 9_000_000 + k, k < 2) for k in range(8)]  # most of them are whole
    peaks = (
        truncation.limits(spark.createDataFrame(judged, "source string, chars int, bytes int, print long, other boolean"))
            .where("measure = 'chars'")
            .collect()
    )
    assert {(x["source"], x["size"]) for x in peaks} == {("a", 50), (None, 50)}
