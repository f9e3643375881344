"""Operator 9, line-first cleaning: rules judge each line, failing lines go, documents losing too much text are rejected.

DataFrame functions only. Nothing is shuffled: each document is judged from its own row, so the operator costs one
scan at any size and no key can be hot.

Defined results: null text has no words and is rejected (base_failed); a text of white space likewise; repeated rows
get equal verdicts; an empty table gives no rows; columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, total, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Largest share of word characters that the line rules may remove.
MAX_LOST_PERCENT = 30
WINDOW = 5

SYMBOLS = r"[#*$%&|<>]"
TERMINAL = r"[.!?:;…。！？；：؟।\"”’»')\]]$"
SHORT_LINE_WORDS = 4
MAX_SYMBOLS_PER_100_WORDS = 25
MAX_BANGS_PER_100_WORDS = 30
LONG_LINE_WORDS = 20
MIN_DISTINCT_PERCENT = 25
BOILERPLATE_WORDS = 25
#: Phrases of navigation and notices, matched in lower-cased lines of fewer than BOILERPLATE_WORDS words. Fixed values.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "forgot password",
    "log in to", "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign in to", "sign up for",
    "skip to content", "subscribe to", "terms of service", "terms of use", "use of cookies",
)


def repeat_words(words: Column) -> Column:
    """Number of words inside WINDOW-word windows that occur twice or more in the array, all occurrences counted."""
    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    )

    def covered(starts: Column) -> Column:
        return total(F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW)))))

    def repeated(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x: (F.get(s, x)["h"])
        twice = lambda s: F.filter(s, lambda x, j: (x["h"] == F.when(j > 0, same(s, j - 1))) | (x["h"] == same(s, j + 1)))
        return let(let(ranked, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))), covered)

    none = F.lit(0).cast("long")
    some = lambda w: let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(repeated(h)))
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, none).otherwise(some(w)))


def line_fails(line: Column, w: Column, symbols: Column) -> Column:
    """True if a line (its words w, its number of symbols) breaks a punctuation, symbol and navigation, shouting, repetition or boilerplate rule."""
    n = F.size(w)
    return (n > 0) & (
        ((n < SHORT_LINE_WORDS) & ~F.rlike(F.get(w, n - 1), F.lit(TERMINAL)))
        | (symbols * 100 > n * MAX_SYMBOLS_PER_100_WORDS)
        | (F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit("!!")) * 100 > n * MAX_BANGS_PER_100_WORDS))
        | ((n >= SHORT_LINE_WORDS) & (F.upper(line) == line) & (F.lower(line) != line))
        | ((n >= LONG_LINE_WORDS) & (F.size(F.array_distinct(w)) * 100 < n * MIN_DISTINCT_PERCENT))
        | ((n < BOILERPLATE_WORDS) & F.rlike(F.lower(line), F.lit("|".join(BOILERPLATE))))
    )


def chars_of(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_lines, lost_chars, kept, cleaned).

    cleaned is the text without its failing lines; it is the text itself where none fails.
    """
    one = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def judged_line(line: Column) -> Column:
        counted = F.struct(words_of(line).alias("w"), F.regexp_count(line, F.lit(SYMBOLS)).alias("s"))
        return let(counted, lambda c: F.struct(line.alias("line"), c["w"].alias("w"), c["s"].alias("s"), line_fails(line, c["w"], c["s"]).alias("fails")))

    def document(lines: Column) -> Column:
        gone = F.flatten(F.transform(F.filter(lines, lambda x: x["fails"]), lambda x: x["w"]))
        seen = F.transform(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda x: x["line"])
        words = F.flatten(F.transform(lines, lambda x: x["w"]))
        of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), chars_of(w).alias("chars"), repeat_words(w).alias("repeat"))
        return F.struct(
            let(words, of_words).alias("words"),
            total(F.transform(lines, lambda x: x["s"])).alias("n_symbols"),
            let(seen, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x["fails"])).cast("long").alias("n_failed"),
            chars_of(gone).alias("lost"),
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("rest"),
        )

    parts = one.select(id_col, "t", let(F.transform(F.split("t", "\n"), judged_line), document).alias("d"))
    d = parts.select(
        id_col, "t", F.col("d.words.n").alias("n_words"), F.col("d.words.chars").alias("word_chars"), "d.n_symbols", "d.n_dup_lines",
        F.col("d.words.repeat").alias("n_repeat_words"), "d.n_failed", "d.lost", "d.rest",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return d.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.col("n_failed").alias("n_failed_lines"),
        F.col("lost").alias("lost_chars"),
        (~failed & (F.col("lost") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)).alias("kept"),
        F.when(F.col("n_failed") == 0, F.col("t")).otherwise(F.col("rest")).alias("cleaned"),
    )


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that are kept, with their own columns: the text cleaned, n_chars (if there) counted anew."""
    verdict = quality_rules(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("body")), "row", "body").where("kept")
    value = {text_col: F.col("cleaned"), chars_col: F.length("cleaned").cast("long")}
    return verdict.select(*[value.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
