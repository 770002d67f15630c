"""Quality rules, line first, in DataFrame functions only.

Every line with a word is judged by itself: by its punctuation (it must end as a sentence does
and not be strewn with marks), as navigation (short entries between separators), and as
boilerplate (a stock phrase in a short line). Lines that fail are removed; a document is rejected
when the lines that stay hold too small a share of its characters, or when its counts fail.

All of it is computed inside the row: no shuffle, whatever the input.

Defined cases: a null or empty text has no words and fails the word count; rows that share an id
are judged each for itself; an empty table gives no row. ``clean_lines`` passes other columns
through; ``text`` becomes the text of the lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import SPACE_CLASS, let, strip, words

SYMBOLS = r"[#*$%&|<>]"
# Fixed values of the line rules; both Java's and RE2's syntax.
MARKS = r"[#*$%&|<>{}=~^_+@\\]"
SHOUTS = r"[!?]"
SEPARATORS = r"[|>»›•·]"
SENTENCE_END = r"[.!?…:;。？！][\x22\x27)»”’\]]*$"
BOILERPLATE = (r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|sign in|sign up|log ?in|"
               r"subscribe|newsletter|click here|read more|javascript|lorem ipsum|share this|skip to content)")
WINDOW = 5


def word_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: strip(x) != "")


def line_passes(line: Column, boiler_words: int = 20) -> Column:
    """The rules for one line with a word."""
    bare = strip(line)
    n = F.size(F.split(bare, SPACE_CLASS))
    return let(n, lambda n: (
        bare.rlike(SENTENCE_END)
        & (F.regexp_count(line, F.lit(MARKS)) * 4 <= n)
        & (F.regexp_count(line, F.lit(SHOUTS)) * 2 <= F.greatest(n, F.lit(4)))
        & ~((F.regexp_count(line, F.lit(SEPARATORS)) >= 2) & (F.regexp_count(line, F.lit(SEPARATORS)) * 6 >= n))
        & ~((n <= boiler_words) & line.rlike(BOILERPLATE))))


def repeated_words(words_: Column) -> Column:
    """Words in windows of five words that the text holds twice or more."""
    def windows(hashes: Column) -> Column:
        ahead = [lambda i, k=k: F.get(hashes, i + k) for k in range(1, WINDOW)]
        return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
                           lambda h, i: F.xxhash64(h, *[get(i) for get in ahead]))

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(ordered, lambda s: let(F.sort_array(F.transform(F.filter(
            F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (
                F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])),
            lambda at: F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))),
                                   F.lit(0), lambda total, x: total + x)))

    hashes = F.transform(words_, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda grams: F.when(
        F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered(grams))))


def rule_columns(text: Column) -> dict[str, Column]:
    """Counts of the whole text and of the characters in lines that stay."""
    whole = F.coalesce(text, F.lit(""))
    lines = word_lines(whole)
    return {
        "n_words": let(words(whole), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda total, x: total + F.char_length(x)).alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"))),
        "lines": let(lines, lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.aggregate(x, F.lit(0).cast("long"), lambda total, y: total + F.char_length(y)).alias("line_chars"),
            F.aggregate(F.filter(x, lambda y: line_passes(y)), F.lit(0).cast("long"),
                        lambda total, y: total + F.char_length(y)).alias("kept_chars"))),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
    }


def clean_lines(docs: DataFrame, min_words: int = 10, max_repeat_pct: int = 20, min_kept_pct: int = 50,
                with_text: bool = True) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and, if asked, the cleaned ``text``."""
    made = rule_columns(F.col("text"))
    out = docs.select("*", made["n_words"].alias("__w"), made["lines"].alias("__l"), made["n_symbols"].alias("__s"))
    failed = (F.col("__w.n_words") < min_words) | (F.col("__w.n_repeat_words") * 100 > F.col("__w.n_words") * max_repeat_pct)
    enough = F.col("__l.kept_chars") * 100 >= F.col("__l.line_chars") * min_kept_pct
    results = {
        "n_words": F.col("__w.n_words"), "word_chars": F.col("__w.word_chars"), "n_symbols": F.col("__s"),
        "n_dup_lines": F.col("__l.n_dup_lines"), "n_repeat_words": F.col("__w.n_repeat_words"),
        "line_chars": F.col("__l.line_chars"), "kept_chars": F.col("__l.kept_chars"),
        "base_failed": failed, "kept": ~failed & enough}
    names = [c for c in docs.columns if c not in results]
    if with_text:
        results["text"] = F.array_join(F.filter(word_lines(F.coalesce("text", F.lit(""))), lambda y: line_passes(y)), "\n")
        names = [c for c in names if c != "text"]
    return out.select(*names, *[c.alias(n) for n, c in results.items()])
