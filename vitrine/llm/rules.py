"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios.

A measure is an expression over the counts of a text; a rule bounds one measure. The counts of a text come from one expression: its words
are split once and bound to a name, from which everything else follows by array functions. There are no user functions and no shuffle;
a text is judged where it lies, in time that grows with its length (times its logarithm where windows of words repeat).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, read

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "was", "it", "he", "for", "on", "are", "as", "his", "they", "at", "this", "from", "or", "had", "by", "not",
    "der", "die", "das", "und", "ist", "nicht", "mit", "den", "dem", "des", "ein", "eine", "zu", "von", "sich", "auf", "für", "im", "auch", "als",
    "le", "la", "les", "et", "un", "une", "du", "est", "que", "qui", "dans", "pas", "pour", "sur", "avec", "au", "ne", "se", "ce",
    "el", "los", "las", "de", "y", "en", "no", "una", "con", "por", "para", "del", "su", "lo", "más", "como",
)
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Words in a window that counts as repeated.
WINDOW = 3


class Rule(NamedTuple):
    """A text passes if at_least <= measure <= at_most; a bound of None is open, and a measure of a text without words or lines is 0."""

    name: str
    measure: str
    at_least: float | None = None
    at_most: float | None = None


#: What a text without words, or with too few or too repetitive ones, fails; every text that passes these goes on to RULES.
BASE = (Rule("words", "n_words", 50), Rule("repeated_words", "n_repeat_words / n_words", None, 0.5))
#: The table of thresholds. Web-text heuristics of published filters, with room for prose in any of the languages above.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.5, 10.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("lettered_words", "n_lettered / n_words", 0.8),
    Rule("stop_words", "n_stop / n_words", 0.02),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.4),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the array has twice or more, the first time included.

    Hashes of windows show whether any can repeat; only then are windows sorted by hash and words, and equal neighbours taken.
    """
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def covered(order: Column) -> Column:
        same = lambda i, j: (F.get(order, i)["h"] == F.get(order, j)["h"]) & (F.get(order, i)["w"] == F.get(order, j)["w"])
        twice = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        found = F.sort_array(F.transform(twice, lambda i: F.get(order, i)["at"]))
        #: A window adds its words but for those that the window before it has as well.
        added = lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"))
        return F.aggregate(found, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), added, lambda acc: acc["n"])

    ordered = F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*window(i)).alias("h"), F.concat_ws(" ", *window(i)).alias("w"), i.alias("at"))))
    may = _bound(F.transform(places, lambda i: F.xxhash64(*window(i))), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).when(may, _bound(ordered, covered)).otherwise(F.lit(0))


def counts(text: Column) -> Column:
    """A struct of the counts of a text, all long; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_words = lambda w: F.struct(
        F.size(w).alias("n_words"), F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop"), F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("n_lettered"), repeated_words(w).alias("n_repeat_words")
    )
    of_lines = lambda ls: F.struct(
        F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"), F.size(F.filter(ls, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
    )
    of_text = F.struct(F.length(F.translate(text, _SPACE, "")).alias("word_chars"), (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).alias("n_symbols"))
    both = F.struct(_bound(words, of_words).alias("w"), _bound(lines, of_lines).alias("l"), of_text.alias("t"))
    names = {"w": ("n_words", "n_stop", "n_lettered", "n_repeat_words"), "l": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"), "t": ("word_chars", "n_symbols")}
    return _bound(both, lambda b: F.struct(*(b[k][n].cast("long").alias(n) for k, group in names.items() for n in group)))


def _measure(of: Column, measure: str) -> Column:
    part, _, whole = (x.strip() for x in measure.partition("/"))
    return F.coalesce(of[part].cast("double") / F.nullif(of[whole].cast("double"), F.lit(0.0)), F.lit(0.0)) if whole else of[part].cast("double")


def failed(of: Column, rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a struct of counts fails, in order."""
    low = lambda r: [] if r.at_least is None else [_measure(of, r.measure) < float(r.at_least)]
    high = lambda r: [] if r.at_most is None else [_measure(of, r.measure) > float(r.at_most)]
    tests = [(r.name, test) for r in rules for test in low(r) + high(r)]
    return F.array_distinct(F.filter(F.array(F.lit(None).cast("string"), *(F.when(test, F.lit(name)) for name, test in tests)), lambda x: x.isNotNull()))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """Adds to every row of docs: counts (struct of long), base_failed and rules_failed (names of the rules that it fails) and kept.

    A null or empty text has no words, so it fails the base; repeated rows, ties and rows without an id are judged like others; no
    rows: no rows. Other columns stay as they are, but for those named like the new ones, which are replaced.
    """
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("counts", "base_failed", "rules_failed", "kept")), counts(F.col(f"`{text}`")).alias("counts"))
    rows = rows.withColumns({"base_failed": failed(F.col("counts"), base), "rules_failed": failed(F.col("counts"), rules)})
    return rows.withColumn("kept", (F.size("base_failed") == 0) & (F.size("rules_failed") == 0))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of RULES on every document, with the counts of the base."""
    of = F.col("counts")
    columns = [of[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *columns, (F.size("base_failed") > 0).alias("base_failed"), "kept")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, unnest(list_zip(range(1, len(w) - 1), w[:len(w) - 2], w[2:len(w) - 1], w[3:])) AS x FROM w WHERE len(w) > 2),
g AS (SELECT r, x[1] AS i, count(*) OVER (PARTITION BY r, x[2], x[3], x[4]) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_lettered,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN c USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5::DOUBLE AND 10::DOUBLE AND n_symbols / n_words <= 0.1::DOUBLE AND n_lettered / n_words >= 0.8::DOUBLE AND n_stop / n_words >= 0.02::DOUBLE
    AND n_dup_lines / n_lines <= 0.4::DOUBLE AND n_bullet_lines / n_lines <= 0.9::DOUBLE AND n_ellipsis_lines / n_lines <= 0.3::DOUBLE AS kept
FROM b
"""
