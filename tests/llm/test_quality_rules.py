import re
from collections import Counter

import pytest

from tessera.llm import quality_rules as q

TEXTS = [
    None,
    "",
    " \n\t ",
    "one two three",
    "a b c d e a b c d e a b c d e",
    "the same line here\nthe same line here\nanother line\n\n  \nthe same line here",
    "café naïve Über 你好 #tag *x* $5 %7 a|b <c> &d",
    "no break space em\x1csep stays inside words of the text yes it does",
    "word " * 3000,
    "x" * 50_000,
]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", TEXTS)
def test_measurements_equal_brute_force(text):
    m = dict(zip(q.MEASURES, q.measure(text)))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute(text)


def test_ledger_policies_and_ablations(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(90, TEXTS[6], "clash"), (90, TEXTS[6], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    book = q.apply_policy(q.ledger(docs)).cache()
    got = {r["doc_id"]: r for r in book.collect()}
    assert book.count() == len(rows)
    for i, t in enumerate(TEXTS):
        n, _, _, _, rep = brute(t)
        assert got[i]["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    for r in q.ablations(book).collect():
        bit = 1 << list(q.RULES).index(r["rule"])
        all_bits = q.mask("v1")
        assert r["n_failed"] == sum(bool(x["fail_bits"] & bit) for x in book.collect())
        assert r["n_failed_alone"] == sum((x["fail_bits"] & all_bits) == bit for x in book.collect())
        assert r["n_kept_without"] == sum((x["fail_bits"] & all_bits & ~bit) == 0 for x in book.collect())
    kept = q.apply_quality_rules(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in book.collect() if r["kept"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.apply_policy(q.ledger(docs)).count() == 0
    assert q.apply_quality_rules(docs).count() == 0


def test_names_of_the_caller_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "a", "b", "c")], "doc_id long, text string, __m string, measured string, Measured_ string")
    row = q.ledger(docs).first()
    assert (row["__m"], row["measured"], row["Measured_"], row["n_words"]) == ("a", "b", "c", 5)
