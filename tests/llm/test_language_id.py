import os
import random
import zlib

import pytest

from tessera.llm import language_id as li


def greedy(text, reference):
    """Phrases by definition, with substring search."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k] in reference and text[i : i + k + 1] in reference:
            k += 1
        i += k
        n += 1
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(5)
    refs = tuple("".join(rng.choice("abcde ") for _ in range(400)).replace("  ", " ") for _ in range(3))
    parser = li.Parser(li.Model(("x", "y", "z"), refs))
    texts = ["".join(rng.choice("abcdefß") for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["", "a", "ß"]
    codes, bounds, _ = parser.symbols(texts)
    got = parser.phrases(codes, bounds)
    for i, text in enumerate(texts):
        assert [got[k, i] for k in range(3)] == [greedy(text, ref) for ref in refs], text


@pytest.mark.parametrize("room", [None, 1500])
def test_phrases_of_long_texts_do_not_depend_on_blocks(monkeypatch, room):
    """The greedy parse from the first symbol to the last, whatever the blocks; texts that end at a block's border too."""
    if room:
        monkeypatch.setattr(li, "parse_room", lambda n: room)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    refs = tuple(f" {say(150)} " for _ in range(3))
    parser = li.Parser(li.Model(("x", "y", "z"), refs))
    whole = say(10_000)
    texts = [whole[:n] for n in (1, 1023, 1024, 1025, 2048, 2049, 3100, 20_000, 50_000)] + [refs[0].strip() * 9, "a" * 5000, "ß" * 3000, "ab" * 4000]
    codes, bounds, _ = parser.symbols(texts)
    got = parser.phrases(codes, bounds)
    for i, text in enumerate(texts):
        plain = "".join(" " if c == 0 else chr(0xDF) if c == parser.width - 1 else "abcde"[c - 1] for c in codes[bounds[i] : bounds[i + 1]].tolist())
        assert [got[k, i] for k in range(3)] == [greedy(plain, ref) for ref in refs], len(text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no generated tables here")
def test_accuracy_on_generated_tables(spark):
    from tessera.llm.queries import queries

    found = queries()["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = found.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    judged = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(judged) >= 0.97 * len(judged)


def test_rows_without_an_id_are_predicted_and_never_learned_from(spark):
    docs = spark.createDataFrame([(None, "ta ke lo", "aa"), (1, "ta ke lo", "aa")], "doc_id long, text string, lang string")
    assert [r[0] for r in docs.select(li.held_out()).collect()] == [True, False]
    assert [r["lang_pred"] for r in li.identify(docs, li.fit(docs.where(~li.held_out()))).collect()] == ["aa", "aa"]


def test_symbols_normalise_and_blocks_cover_long_texts():
    parser = li.Parser(li.Model(("x",), (" ab cd ",)))
    codes, bounds, letters = parser.symbols(["  AB,, cd!", None or "", "123", "ab" * 5000])
    assert [len(codes[a:b]) for a, b in zip(bounds, bounds[1:])] == [6, 0, 0, 10000]
    assert letters.tolist() == [4, 0, 0, 10000]


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(7)
    vowels = {"aa": ("ta", "ke", "lo"), "bb": ("sch", "ung", "ei"), "cc": ("ão", "nh", "que")}
    rows = []
    for i in range(400):
        lang = rng.choice(list(vowels))
        text = " ".join("".join(rng.choice(vowels[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang, "junk"))
    rows += [(900, None, "aa", ""), (901, "", None, ""), (902, "1234 !!", "bb", ""), (903, "ta ke " * 40_000, None, ""), (903, "ta ke " * 40_000, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = li.fit(docs.where(~li.held_out()), docs_per_lang=30)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    pred = {d: p for d, p, _ in got}
    out = [(pred[i], lang) for i, _, lang, _ in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in out) >= 0.98 * len(out)
    assert pred[900] == pred[901] == pred[902] == "und" and pred[903] == "aa"


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in li.identify(docs, li.fit(docs)).collect()] == ["und"]
    assert li.identify(docs.limit(0), li.Model((), ())).count() == 0


def test_learns_behind_a_shared_header_and_every_language(spark):
    header = "this licence text opens every document " * 25
    own = {"aa": "ta ke lo ", "bb": "sch ung ei ", "cc": "nh que ao "}
    rows = [(i, header + own[lang] * 40, lang) for i, lang in enumerate(["aa", "bb", "cc"] * 4)]
    rows += [(100 + i, f"{chr(0x4E00 + i) * 3}", f"l{i}") for i in range(300)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 303 and li.Parser(li.Model(model.langs[:3], model.texts[:3])).predict(list(own.values()))[0] == list(own)
