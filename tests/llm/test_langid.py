import random

import numpy as np

from heapspan.llm.langid import FEW, Model, identify, keep_identified, learn, normalise, phrases, predict, train

SYLLABLES = {"aa": ["ka", "lo", "mi", "ré"], "bb": ["tor", "gan", "els", "ün"], "cc": ["sho", "wix", "pe", "ña"]}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def brute(symbols, sample):
    """Greedy longest matches in sample."""
    count, i, text = 0, 0, "".join(map(chr, sample))
    run = "".join(map(chr, symbols))
    while i < len(run):
        n = 1
        while i + n <= len(run) and run[i : i + n] in text:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


def test_phrases_by_brute_force():
    """A table and sorted pairs; enough texts to go side by side, and longer ones that end alone."""
    r = random.Random(3)
    texts = [prose("aa", r.randint(1, 60), i) for i in range(FEW + 10)] + [prose("bb", 80, 2), "", "x", "漢字 ka lo", "".join(r.choice("kalomiré z") for _ in range(3000)), prose("aa", 900, 5)]
    for dense in (1 << 28, 0):
        model = train({"aa": [prose("aa", 60, 1)]}, 4000, dense)
        assert (model.tables[0].table is None) == (not dense)
        code = model.code()
        sample = normalise(prose("aa", 60, 1), code).tolist() + [0]
        parts = sorted((normalise(t, code) for t in texts), key=lambda x: -len(x))
        length = np.array([len(x) for x in parts])
        got = phrases(np.concatenate(parts), model.tables[0], np.cumsum(length) - length, length)
        assert got.tolist() == [brute(x.tolist(), sample[:4000]) for x in parts]


def test_many_scripts(spark):
    """More letters than any one script has, languages of one script each, and two of the same."""
    r = random.Random(8)
    letters = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 600))), "ja": "".join(map(chr, range(0x3041, 0x3090)))}
    words = {k: ["".join(r.choice(x) for _ in range(r.randint(2, 5))) for _ in range(40)] for k, x in letters.items()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i in range(60) for k in letters]
    df = spark.createDataFrame([(n, t, k) for n, (_, t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    model = learn(df.where("doc_id % 2 = 0"), chars=3000, slots=16)
    assert set(model.names) == set(letters)
    got = {x.doc_id: x.lang_pred for x in identify(df, model).collect()}
    assert all(got[n] == k for n, (_, _, k) in enumerate(rows))


def test_long_texts_and_short_ones(spark):
    df = spark.createDataFrame([(1, prose("aa", 30_000, 1), "aa"), (2, prose("bb", 40, 2), "bb"), (3, "Lo.", None), (4, None, None)], "doc_id long, text string, lang string")
    model = learn(df, chars=2000)
    assert {r.doc_id: r.lang_pred for r in identify(df, model).collect()}[1] == "aa"
    assert sorted(r.doc_id for r in keep_identified(df, model).collect()) == [1, 2, 3]


def test_held_out_and_cases(spark):
    rows = [(i, prose(lang, 40, i), lang, "c") for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(500, prose("aa", 30, 9), None, "c"), (None, prose("bb", 30, 9), "bb", "c"), (None, prose("bb", 30, 9), "bb", "c")]
    odd = [(600, None, "aa", "c"), (601, "", "aa", "c"), (602, "12 ?! 3", "bb", "c"), (603, "漢字", None, "c")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    model = learn(df.where("doc_id % 3 <> 1 or doc_id is null"), chars=2000, slots=8)
    assert model.names == ["aa", "bb", "cc"] or set(model.names) <= {"aa", "bb", "cc"}
    model = learn(df, chars=2000, slots=8)
    got = {(r.doc_id, r.lang_pred) for r in identify(df, model).collect()}
    assert {(i, lang) for i, _, lang, _ in rows if lang and i is not None} <= got and (500, "aa") in got and (None, "bb") in got
    assert {(600, "und"), (601, "und"), (602, "und")} <= got
    assert all(0 <= r.score <= 1 for r in identify(df, model).collect())
    kept = keep_identified(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, *_ in rows)
    assert identify(df.limit(0), model).collect() == []
    assert {r.lang_pred for r in identify(df, learn(df.limit(0))).collect()} == {"und"}


def test_no_model():
    assert predict(["text"], Model([], [], [], {}), Model([], [], [], {}).code()) == [("und", 0.0, 0.0)]
