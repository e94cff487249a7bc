"""Line-first cleaning: rules on every line, failed lines go, then documents which lost too much text go.

Only built-in functions.  Nothing is shuffled: a document is judged from its own row.

Defined results: a null text counts as an empty one; an empty text has no words and is rejected; blank lines are kept and weigh
nothing; equal rows are judged alike, each on its own; an empty table gives an empty table.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, let

#: ASCII white space; everything between belongs to words.
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Fewer words, or a larger share of words in repeated windows, fail the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line of some length fails with a larger share of characters which are neither letters, digits nor white space.
PUNCTUATION_FROM, MAX_PUNCTUATION_PERCENT = 20, 20
#: A line fails as navigation with this many menu separators, one for every so many words at least.
NAVIGATION_MARKS, NAVIGATION_WORDS_PER_MARK = 3, 3
NAVIGATION = "[|>»›•·]"
#: A line fails as boilerplate if it holds one of these phrases and no more words than this.
BOILERPLATE_WORDS = 30
BOILERPLATE = (
    "accept all cookies", "back to top", "by continuing to use this site", "click here to", "cookie policy", "enable javascript",
    "forgot your password", "javascript is disabled", "log in to your account", "lorem ipsum", "powered by wordpress", "read more at",
    "share on facebook", "share this article", "sign in to your account", "sign up for our newsletter", "skip to content",
    "skip to main content", "subscribe to our newsletter", "terms of service apply", "this site uses cookies", "we use cookies",
)
#: Documents which lose a larger share of their characters with the failed lines are rejected.
MAX_LOST_PERCENT = 30


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words in windows found twice or more.  Windows with unlike hashes are unlike, so most documents end at the first test;
    in the rest the windows are sorted by hash and neighbours compared as word lists."""

    def positions(ordered: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW))

        def found(entry: Column, at: Column) -> Column:
            before, after = F.get(ordered, at - 1), F.get(ordered, at + 1)
            return F.coalesce(same(entry, before), F.lit(False)) | F.coalesce(same(entry, after), F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, found), lambda entry: entry["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda start, at: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, at + 1) - start, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    full = let(let(ordered, positions), covered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(full)


def has_phrase(text: Column) -> Column:
    """Whether the text holds a boilerplate phrase; asked once for a document, so that most lines need no look at the phrases."""
    lower = F.lower(text)
    return reduce(operator.or_, [lower.contains(phrase) for phrase in BOILERPLATE])


def line_verdict(line: Column, phrases: Column) -> Column:
    """Why a line fails: ``punctuation``, ``navigation``, ``boilerplate``; null for a line which stays.  ``phrases``: whether the
    line's document has a boilerplate phrase at all."""
    marks = F.length(F.regexp_replace(line, "[\\p{L}\\p{M}\\p{N}\\s]+", ""))
    menu = F.length(line) - F.length(F.regexp_replace(line, NAVIGATION, ""))
    n_words = F.size(_words(line))
    return (
        F.when((F.length(line) >= PUNCTUATION_FROM) & (marks * 100 > F.length(line) * MAX_PUNCTUATION_PERCENT), "punctuation")
        .when((menu >= NAVIGATION_MARKS) & (menu * NAVIGATION_WORDS_PER_MARK >= n_words), "navigation")
        .when(phrases & (n_words <= BOILERPLATE_WORDS) & has_phrase(line), "boilerplate")
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Struct ``row`` of the input and the measures, the cleaned text and the verdicts beside it."""
    base = boxed(docs, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    split = base.select("row", "text", _words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"), has_phrase(F.col("text")).alias("phrases"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    parts = split.select(
        "row", "text", "words", "lines",
        F.when(F.size("words") >= WINDOW, let(
            F.transform("words", lambda word: F.xxhash64(word)),
            lambda hashes: F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))))
        .otherwise(F.array().cast("array<bigint>")).alias("hashes"),
        F.transform("lines", lambda line: F.struct(line.alias("line"), line_verdict(line, F.col("phrases")).alias("fails"))).alias("judged"),
        F.filter("lines", lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("filled"),
    )
    numbers = parts.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.aggregate("judged", F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"])).alias("line_chars"),
        F.aggregate("judged", F.lit(0).cast("long"), lambda n, x: n + F.when(x["fails"].isNotNull(), F.length(x["line"])).otherwise(0)).alias("lost_chars"),
        F.array_join(F.transform(F.filter("judged", lambda x: x["fails"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return numbers.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("line_chars")))


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its id, the base measures and both verdicts."""
    return judge(docs, text).select(
        F.col("row")[doc_id].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The kept documents with the columns of the input; failed lines are gone from their texts and ``length`` follows."""
    # A filter on the verdict would be moved below the projections, and with it all they compute; a filter on what is generated stays.
    judged = F.array(F.struct("row", "lost_chars", "clean_text", "kept"))
    good = judge(docs, text).select(F.explode_outer(F.filter(judged, lambda x: x["kept"])).alias("good")).filter("good is not null").select("good.*")
    columns = []
    for name in docs.columns:
        column = F.col("row")[name]
        if name == text:
            column = F.when(F.col("lost_chars") > 0, F.col("clean_text")).otherwise(column)
        elif name == length:
            column = F.when(F.col("lost_chars") > 0, F.length("clean_text").cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return good.select(*columns)
