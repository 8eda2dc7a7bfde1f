"""Quality rules by line-first cleaning, in DataFrame functions only.

**Lines first.**  A text is cut at line feeds and every line with a word is judged on its own, by the first rule it fails:

1. *navigation*: two or more item separators, and one for every ``WORDS_AN_ITEM`` words or fewer, or nothing but a menu entry;
2. *boilerplate*: a stock phrase of web pages in a line of at most ``BOILERPLATE_WORDS`` words;
3. *punctuation*: it does not end as a sentence does (terminal mark, then closing quotes or brackets), or has an exclamation mark, question mark
   or symbol for every ``WORDS_A_MARK`` words or fewer (three such marks at least).

Failing lines are removed.  Then the **document** is rejected if its remaining lines hold less than ``LEAST_PERCENT`` percent of its words.

**Base checks** come before: fewer than ``MIN_WORDS`` words, or more than ``REPEAT_PERCENT`` percent of the words inside five-word windows that the text
holds twice or more.  Windows are compared by hash to find the texts that may hold one twice; only
these are counted, on the windows' words themselves, so a hash collision can't change a count.

Everything works within a row: nothing is shuffled, joined or grouped, so no hot source, line or document exists for it, and a very long text costs its own task
memory in proportion to its length.  Defined results: a NULL or empty text has no words (``base_failed``, not kept); NULL ids and rows that repeat an id
are judged each by its own text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
LEAST_PERCENT = 50
WORDS_A_MARK = 4
WORDS_AN_ITEM = 4
BOILERPLATE_WORDS = 40

# White space, symbols, sentence ends, separators, menu entries and stock phrases (lower case).
WHITE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = "[.!?…。！？؟।][\"'“”‘’»」)\\]]*[\\x20\\x09-\\x0D]*$"
MARKS = "[!?！？#*$%&|<>]"
ITEMS = "[|»›•·]"
MENU = ("home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back", "back to top", "share",
        "read more", "more", "contact", "contact us", "about", "about us", "sitemap", "skip to content", "skip to main content", "print", "reply")
STOCK = ("lorem ipsum", "javascript", "cookie policy", "uses cookies", "use cookies", "use of cookies", "privacy policy", "terms of use",
         "terms of service", "terms and conditions", "all rights reserved", "powered by", "click here", "subscribe to our newsletter", "follow us on")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _windows(w: Column) -> Column:
    """All runs of WINDOW neighbouring words, as structs."""
    n = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(w, F.lit(k + 1), n).alias(f"w{k}") for k in range(WINDOW)))


def repeated_words(w: Column) -> Column:
    """Words of ``w`` (an array column) inside windows that it holds twice or more."""
    hashes = F.transform(_windows(w), lambda x: F.xxhash64(x))
    may = F.size(F.array_distinct(hashes)) < F.size(w) - (WINDOW - 1)
    # equal windows stand together once sorted; a window holds no white space but between its words
    placed = F.sort_array(F.transform(_windows(w), lambda x, i: F.struct(F.concat_ws(" ", F.array(*(x[f"w{k}"] for k in range(WINDOW)))).alias("w"), i.alias("i"))))
    twins = _let(placed, lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
                                              lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    covered = _let(starts, lambda s: F.aggregate(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                                                 F.lit(0).cast("long"), lambda total, x: total + x))
    return F.when(may, covered).otherwise(F.lit(0).cast("long"))


def failed_rule(line: Column, n: Column) -> Column:
    """The first rule that a line of ``n`` words fails; NULL if it fails none."""
    marks, items = F.regexp_count(line, F.lit(MARKS)), F.regexp_count(line, F.lit(ITEMS))
    low = F.lower(F.btrim(line, F.lit(WHITE)))
    return (F.when((items >= 2) & (items * WORDS_AN_ITEM >= n) | low.isin(*MENU), "navigation")
            .when((n <= BOILERPLATE_WORDS) & low.rlike("|".join(STOCK)), "boilerplate")
            .when(~line.rlike(SENTENCE_END) | (marks >= 3) & (marks * WORDS_A_MARK >= n), "punctuation"))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's counts, verdicts and cleaned text.

    (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_punctuation, n_navigation, n_boilerplate, kept_words,
    clean_text); the last six tell what line-first cleaning found and left.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select(id_col, "text", words(F.col("text")).alias("words"),
                       F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"))
    judged = F.transform("lines", lambda x: _let(
        F.size(F.split(F.btrim(x, F.lit(WHITE)), SPACES)), lambda n: F.struct(x.alias("line"), n.alias("n"), failed_rule(x, n).alias("rule"))))
    rows = rows.select(
        id_col, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), judged.alias("judged"))
    good = F.filter("judged", lambda x: x["rule"].isNull())
    rows = rows.select(*(c for c in rows.columns), good.alias("good"))
    of_rule = lambda rule: F.size(F.filter("judged", lambda x: x["rule"] == rule)).cast("long").alias(f"n_{rule}")
    kept_words = F.aggregate("good", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select(*rows.columns[:6], base_failed.alias("base_failed"), F.size("judged").cast("long").alias("n_lines"),
                       *(of_rule(r) for r in ("punctuation", "navigation", "boilerplate")), kept_words.alias("kept_words"),
                       F.array_join(F.transform("good", lambda x: x["line"]), "\n").alias("clean_text"))
    kept = ~F.col("base_failed") & (100 * F.col("kept_words") >= LEAST_PERCENT * F.col("n_words"))
    return rows.select(*rows.columns[:7], kept.alias("kept"), *rows.columns[7:])
