"""Quality rules: line-first cleaning, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; lines
that fail are removed, and a document that loses too large a share of its words
with them is rejected.  Three base rules judge the whole text: fewer than 20
words, or more than 30 % of the words inside 8-word windows that occur twice.

Defined results: a NULL or empty text has no words and fails by its length; a
line without a word passes; repeated rows are judged one by one; a table
without rows gives none; an input column that has the name of a result is
replaced by it.  Everything happens inside a row, so there is no shuffle and no
key to be hot; a long text costs a sort of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, carried, new_text, once, with_results, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A document may lose this share of its words with failed lines.
MAX_LOST_PERCENT = 30

SYMBOLS = "#*$%&|<>"
#: More symbols than this per 100 words fail a line.
MAX_SYMBOLS_PER_100 = 20
#: A line of this many letters and more fails if over half of them are capitals.
SHOUT_LETTERS = 20
#: Doubled end marks ("!!") per 100 words beyond which a line fails.
MAX_DOUBLED_PER_100 = 30
#: Separators between short items that make a line a navigation bar.
MIN_BARS = 3
#: A line of at most this many words that speaks of these things is boilerplate.
BOILERPLATE_WORDS = 25
BOILERPLATE = (
    r"(?i)\b(enable javascript|javascript is disabled|accept (all )?cookies|we use cookies|all rights reserved|"
    r"subscribe to our newsletter|back to top|skip to (main )?content|terms of (use|service) apply)\b"
)
#: A short line that is only the name of a page element is navigation.
NAVIGATION = r"(?i)^(home|menu|login|log in|sign in|sign up|search|share|next|previous|read more|click here|contact us|about us)[.!:]?$"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_facts(line: Column) -> Column:
    """What the rules need to know of one line."""
    trimmed = F.trim(line, F.lit(SPACES))
    return F.struct(
        line.alias("line"),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_RUN))).alias("n"),
        _count(line, SYMBOLS).alias("symbols"),
        _count(line, "|").alias("bars"),
        F.length(F.regexp_replace(line, r"[^\p{L}]+", "")).alias("letters"),
        F.length(F.regexp_replace(line, r"[^\p{Lu}]+", "")).alias("capitals"),
        F.when(
            line.contains("!!") | line.contains("??"),
            F.size(F.split(line, r"[!?]{2,}")) - 1,
        ).otherwise(0).alias("doubled"),
        trimmed.alias("trimmed"),
    )


def line_fails(x: Column) -> Column:
    """Does a line (as :func:`line_facts`) with at least one word fail a rule?"""
    return (x.n > 0) & (
        (x.symbols * 100 > MAX_SYMBOLS_PER_100 * x.n)
        | ((x.letters >= SHOUT_LETTERS) & (x.capitals * 2 > x.letters))
        | (x.doubled * 100 > MAX_DOUBLED_PER_100 * x.n)
        | (x.bars >= MIN_BARS)
        | ((x.n <= 3) & x.trimmed.rlike(NAVIGATION))
        | ((x.n <= BOILERPLATE_WORDS) & x.trimmed.rlike(BOILERPLATE))
    )


def _judged(docs: DataFrame, text: str) -> DataFrame:
    rows = docs.select(*carried(docs.columns), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    rows = once(rows, words=words(F.col("body")), lines=F.split("body", "\n", -1))
    rows = once(
        rows,
        facts=F.transform("lines", line_facts),
        grams=F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("words", i, WINDOW)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Windows next to an equal one in sorted order, as positions in the text.
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    rows = once(
        rows,
        ordered=F.when(
            repeated, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    )
    rows = once(
        rows,
        starts=F.array_sort(
            F.transform(
                F.filter(
                    "ordered",
                    lambda x, k: (F.get(F.col("ordered"), k - 1).h == x.h)
                    | (F.get(F.col("ordered"), k + 1).h == x.h),
                ),
                lambda x: x.i,
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "starts",
            lambda p, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - p, F.lit(WINDOW))
            ).cast("bigint"),
        ),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    wordy = F.transform(F.filter("facts", lambda x: x.n > 0), lambda x: x.line)
    rows = once(
        rows,
        n_words=F.size("words").cast("bigint"),
        word_chars=F.length(F.translate("body", SPACES, "")).cast("bigint"),
        n_symbols=_count(F.col("body"), SYMBOLS).cast("bigint"),
        n_dup_lines=(F.size(wordy) - F.size(F.array_distinct(wordy))).cast("bigint"),
        n_repeat_words=F.coalesce(covered, F.lit(0).cast("bigint")),
        n_lost_words=F.aggregate(
            F.filter("facts", line_fails),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x.n,
        ),
        clean_text=F.array_join(
            F.transform(F.filter("facts", lambda x: ~line_fails(x)), lambda x: x.line), "\n"
        ),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    loses = F.col("n_lost_words") * 100 > F.col("n_words") * MAX_LOST_PERCENT
    return rows.withColumns({"base_failed": base_failed, "kept": ~(base_failed | loses)})


RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "clean_text", "base_failed", "kept",
)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its counts, ``clean_text`` (the lines that passed),
    ``n_lost_words``, ``base_failed`` and ``kept``."""
    return _judged(docs, text).select(*with_results(docs.columns, {c: F.col(c) for c in RESULTS}))


def keep_clean(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: accepted documents with the lines that passed."""
    names = docs.columns
    return _judged(docs, "text").where("kept").select(*with_results(names, new_text(names, F.col("clean_text"))))
