"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for a document and its outcome is one bit of ``fail_bits``, next to the measurements it
came from. A policy is a named, versioned set of rules; applying one, comparing two, or asking what a rule alone
removes needs the stored bits only, never the text again.

Defined results: a null or empty text has no words, so all measurements are 0 and it fails ``few_words``; very long
texts are measured whole, with memory in proportion to the one text; ties and repeated rows do not interact; an empty
table gives an empty ledger; other columns, whatever their names, are carried through untouched, except that the
ledger's own columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.memory import release
from tessera.llm.names import unused

SPACES = " \t\n\x0b\x0c\r"
_SPACE_BYTES = SPACES.encode()
_SYMBOL_BYTES = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_letters", "n_upper")
_MEASURE_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])

#: Rule -> failing condition over the measurements, in integers; the place in this order is the rule's bit, for good.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "100 * n_symbols > 10 * word_chars",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_letters": "100 * n_letters < 50 * word_chars",
    "few_distinct_words": "n_words >= 50 and 100 * n_distinct_words < 10 * n_words",
    "shouting": "100 * n_upper > 60 * n_letters",
}

#: Policies by version. A new version is a new entry, so that old verdicts can be had again.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "short_words", "long_words", "few_letters", "few_distinct_words", "shouting"),
}


def _repeated(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found at least twice, its first place included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(n)
    for at, window in enumerate(windows):
        seen = first.setdefault(window, at)
        if seen != at:
            hit[seen] = hit[at] = 1
    covered, last = 0, -1
    at = hit.find(1)
    while at >= 0:
        covered += min(size, at + size - 1 - last)
        last = at + size - 1
        at = hit.find(1, at + 1)
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly the six ASCII spaces
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    spaces = len(raw) - len(raw.translate(None, _SPACE_BYTES))
    symbols = len(raw) - len(raw.translate(None, _SYMBOL_BYTES))
    # beyond ASCII every code point counts as a letter, and a two-byte capital of Latin-1 as a capital
    ascii_letters = len(raw) - len(raw.translate(None, _LETTERS))
    wide = len(text) - len(raw.translate(None, _HIGH))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (len(words), len(text) - spaces, symbols, len(lines), len(lines) - len(set(lines)), _repeated(words), len(set(words)), ascii_letters + wide, upper)


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_HIGH = bytes(range(128, 256))


@F.pandas_udf(_MEASURE_TYPE)
def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")
    release()


def fail_bits(rules: dict[str, str] | None = None) -> Column:
    """One bit a rule, over measurement columns."""
    bits = F.lit(0).cast("long")
    for bit, condition in enumerate((rules or RULES).values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    place = list(RULES)
    return sum(1 << place.index(name) for name in names)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``: each rule evaluated once, nothing decided yet."""
    (held,) = unused([*docs.columns, *MEASURES], "measured")
    out = docs.withColumn(held, _measures(F.col(text)))
    out = out.withColumns({name: F.col(f"{held}.{name}") for name in MEASURES}).drop(held)
    return out.withColumn("fail_bits", fail_bits())


def verdict(policy: str | tuple[str, ...] = "v1") -> Column:
    """True where no rule of the policy failed; reads ``fail_bits`` alone."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(book: DataFrame, policy: str = "v1", base: str = "base") -> DataFrame:
    """A ledger with ``base_failed`` and ``kept``; the base rules hold under every policy."""
    return book.withColumns({"base_failed": ~verdict(base), "kept": verdict(base) & verdict(policy)})


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept were it left out.

    The ledger is first grouped by its bits (at most 2^rules groups, summed map-side), so the rest works on few rows.
    """
    groups = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    all_bits = mask(policy)
    order = list(RULES)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << order.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    bits = F.col("fail_bits").bitwiseAND(F.lit(all_bits).cast("long"))
    rest = bits.bitwiseAND(F.bitwise_not(F.col("r.bit")))
    fails = bits.bitwiseAND(F.col("r.bit")) != 0
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return (
        groups.withColumn("r", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(count(fails).alias("n_failed"), count(fails & (rest == 0)).alias("n_failed_alone"), count(rest == 0).alias("n_kept_without"))
    )


def apply_quality_rules(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Documents a policy keeps, with their own columns."""
    judged = docs.select(F.struct("*").alias("__doc"), _measures(F.col("text")).alias("__m")).select("__doc", "__m.*")
    return judged.withColumn("fail_bits", fail_bits()).where(verdict("base") & verdict(policy)).select("__doc.*")


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents
),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
),
rep AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) , (SELECT unnest(range(0, 5)) AS d)
  WHERE c >= 2 GROUP BY doc_id
),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^ \\t-\\r]') GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(ln.n_lines, 0) AS n_lines, len(list_distinct(ws)) AS n_distinct_words,
    length(regexp_replace(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 60 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_letters < 50 * word_chars
    OR (n_words >= 50 AND 100 * n_distinct_words < 10 * n_words) OR 100 * n_upper > 60 * n_letters) AS kept
FROM m
"""
