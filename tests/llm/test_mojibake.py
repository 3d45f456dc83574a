"""Round trips: clean text, garbled by known pairs, must be found and come back."""

from pathlib import Path

import numpy as np
import pytest

from spindrift.llm import mojibake

DATA = "/root/testdata/sf0.1"
SENTENCES = """Où se trouve la clé qui décrit le répertoire numéro {n} du système protégé ?
Für {n} müssen zunächst größere Blöcke gelesen werden, bevor die Prüfung fertig ist.
Después de la versión {n}, el índice guardó más páginas que ningún otro año.
Não há mais espaço para a memória: a extensão já ocupa {n} MB.
Proszę sprawdzić, czy plik {n} leży w folderze i czy wskaźnik został zamknięty.
Проверьте, что каталог закрыт, и запустите проверку ещё раз через {n} минут.
Žádný přehled nesmí být větší než {n} položek, říká správce.
Ο κατάλογος δεν περιέχει το αρχείο στη θέση {n}.
The report lists {n} files and none of them was moved.
検索結果は {n} 件までしか保存できません。""".split("\n")
PAIRS = [
    ("utf-8", "cp1252", "Für"), ("utf-8", "cp1251", "Für"), ("utf-8", "mac_roman", "Não"), ("utf-8", "cp437", "Проверьте"),
    ("cp1251", "cp1252", "Проверьте"), ("koi8_r", "cp1251", "Проверьте"), ("cp1250", "cp1252", "Proszę"), ("cp1253", "cp1252", "Ο κατ"),
    ("cp1252", "cp850", "Für")
]


def _corpus():
    return [(i, SENTENCES[i % 10].format(n=i * 7919 % 1000)) for i in range(3000)]


def test_garbled_text_is_found_and_restored(spark):
    rows, want = _corpus(), {}
    for k, (true, wrong, start) in enumerate(PAIRS):
        text = next(s for s in SENTENCES if s.startswith(start)).format(n=k)
        rows.append((10_000 + k, text.encode(true).decode(wrong)))
        want[10_000 + k] = text
    twice = SENTENCES[1].format(n=77)
    rows.append((20_000, twice.encode().decode("cp1252").encode().decode("cp1252")))
    partly = "The report lists 5 files, né"
    rows.append((20_001, "The report lists 5 files, nÃ©"))
    rows.append((20_002, "Für � gr��ere Bl�cke"))
    want |= {20_000: twice, 20_001: partly, 20_002: None}
    rows += [
        (30_000, None), (30_001, ""), (30_002, "plain"), (30_003, "ÄÖÜ ß | ÅØÆ " + SENTENCES[5].format(n=1)), (10_000, rows[3000][1]),
        (30_004, SENTENCES[1].format(n=2) * 400)
    ]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, snippet string, text string")
    got = {r["id"]: r["restored"] for r in mojibake.garbled(df, "id", "snippet").collect()}
    assert got == want


def test_nothing_to_do(spark):
    assert mojibake.garbled(spark.createDataFrame([], "id long, s string"), "id", "s").count() == 0
    assert mojibake.garbled(spark.createDataFrame([(1, "abc"), (2, None)], "id long, s string"), "id", "s").count() == 0


def test_suspects_miss_nothing_that_labelling_finds(spark):
    rows = _corpus()[:500]
    texts = [t for _, t in rows] + [next(s for s in SENTENCES if s.startswith(p[2])).format(n=1).encode(p[0]).decode(p[1]) for p in PAIRS]
    labeller = mojibake.Labeller(mojibake.train(spark.createDataFrame(rows, "id long, s string"), "s"))
    texts += [
        SENTENCES[9].format(n=1).encode(true).decode(wrong, "replace") for true, wrong in (("cp932", "latin_1"), ("euc_jp", "latin_1"))
    ] + ["the カ report", "ｱ one ±" + "©×é"]
    found = labeller.suspects(texts)[1].any(1)
    everything = np.ones((len(texts), len(labeller.pairs)), bool)
    assert [x.tolist() for x in labeller.label(texts, everything)] == [x.tolist() for x in labeller.label(texts)]
    labelled = np.array([x.any() for x in labeller.label(texts)])
    assert not (labelled & ~found).any() and labelled[len(rows) : len(rows) + len(PAIRS) + 2].all()


def test_swapped_and_wide_text_comes_back_whole(spark):
    kanji = "検索の最後の結果は一件ＯＫです。"
    labeller = mojibake.Labeller(
        mojibake.train(spark.createDataFrame([*_corpus(), *[(5000 + i, kanji) for i in range(50)]], "id long, s string"), "s")
    )
    line = SENTENCES[9].replace("保存", "検索")  # 保 swapped is half of a surrogate pair
    swapped = [line.format(n=3), kanji + line.format(n=4)]
    wide = [s.format(n=n) for s in SENTENCES for n in (3, 44) if len(s.format(n=n).encode()) % 2 == 0]
    want = swapped + wide + wide
    texts = (
        [t.encode("utf-16-le").decode("utf-16-be") for t in swapped]
        + [t.encode().decode(order) for order in ("utf-16-le", "utf-16-be") for t in wide]
    )
    assert [(t, whole) for _, t, whole in labeller.restore(texts)[0]] == [(t, True) for t in want]


def test_text_garbled_many_times_comes_back_whole(spark):
    text, rows, want = SENTENCES[1].format(n=5), _corpus(), {}
    for k in range(1, 8):
        rows.append((40_000 + k, text))
        for _ in range(k):
            rows[-1] = (rows[-1][0], rows[-1][1].encode().decode("latin-1"))
        want[40_000 + k] = text
    assert {r["id"]: r["restored"] for r in mojibake.garbled(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()} == want


def test_characters_beyond_the_alphabet_share_a_class_per_block(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "ALPHABET", 60)
    model = mojibake.train(spark.createDataFrame(_corpus()[:300], "id long, s string"), "s")
    one, two, other = model.ids(np.array([ord("検"), ord("椼"), ord("件")])).tolist()
    assert one == two > 60 and other > 60 and other != one and model.ids(np.array([0x1F600]))[0] == 0
    assert model.log.shape[0] == model.alphabet.size == 61 + len(model.alphabet.blocks)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_held_out_snippets_come_back(spark):
    """Snippets that the model hasn't seen, garbled here: at least nine in ten are found, and of those that lost no byte nine in ten are restored exactly."""
    clean = (
        spark.read.parquet(f"{DATA}/search_results.parquet")
            .select("result_id", "snippet")
            .where("snippet is not null")
            .distinct()
            .orderBy("result_id")
            .limit(4000)
            .collect()
    )
    seen, held = [tuple(r) for r in clean[:3000]], [r["snippet"] for r in clean[3000:]]
    labeller = mojibake.Labeller(mojibake.train(spark.createDataFrame(seen, "id long, s string"), "s"))
    ready, _ = labeller.restore(held)
    held = [t for t, (pairs, *_) in zip(held, ready) if not pairs and sum(ord(c) > 127 for c in t) > 4]
    made = []
    for t in held:
        for true, wrong in (("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("cp1250", "cp1252")):
            try:
                garbled = t.encode(true).decode(wrong)
                made += [(t, garbled)] if garbled != t else []
            except UnicodeError:
                continue
    found, _ = labeller.restore([g for _, g in made])
    assert len(made) > 300
    assert sum(bool(p) for p, *_ in found) > 0.9 * len(made)
    assert sum(text == t for (t, _), (_, text, _) in zip(made, found)) > 0.9 * len(made)
