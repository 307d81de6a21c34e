"""Line-first quality rules, in DataFrame expressions alone.

Rules on punctuation, navigation and boilerplate look at each line by itself; failing lines are removed, and a document
that keeps too little of its text is rejected. Rules on whole documents (the base) go first: too few words, or too many
words in repeated windows of five. All of it is one projection: no shuffle, no Python, and a document is never split
over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rules.
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
#: A line fails if more than this share of its words end in a symbol or bang, or it has more than this share of bars.
PUNCTUATION_SHARE, NAVIGATION_SHARE = 0.3, 0.2
#: A document is rejected if it keeps less than this share of its words.
KEPT_SHARE = 0.5
#: What boilerplate lines say, in lower case; longer lines than this many words say something else besides.
BOILERPLATE_WORDS = 40
BOILERPLATE = ("licensed under the", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "copyright (c)", "subscribe to our newsletter", "sign in", "log in", "click here", "lorem ipsum", "javascript is disabled")
#: A word that ends in marks of emphasis or noise; a separator that stands alone. MARKED finds texts that can have one.
NOISY_WORD = r"(?:[#*$%&<>]+|!{2,}[.,!?]*)\z"
SEPARATOR = r"^(?:\||»|›|::|/|>)\z"
MARKED = r"[#*$%&<>|»›/]|!!|::"
#: A phrase as words of its own.
PHRASE = "(?:^|[^a-z0-9])(?:" + "|".join(p.replace("(", "[(]").replace(")", "[)]") for p in BOILERPLATE) + ")(?:$|[^a-z0-9])"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "clean_words", "kept")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that the text has twice or more, each counted once.

    Windows are compared by 64-bit hashes of their words' hashes. Only texts with a repeat sort them: equal neighbours
    in the order of (hash, place) mark places, and the union of the marked windows is the sum of the gaps between
    successive places, of at most ``WINDOW`` each.
    """

    def windows(each: Column) -> Column:
        return F.slice(F.transform(each, lambda h, i: F.xxhash64(h, *(F.get(each, i + k) for k in range(1, WINDOW)))), F.lit(1), F.size(each) - (WINDOW - 1))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, count))


def _covered(hashes: Column) -> Column:
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(a: Column) -> Column:
        twice = F.filter(a, lambda w, k: F.coalesce(w["h"] == F.get(a, k - 1)["h"], F.lit(False)) | F.coalesce(w["h"] == F.get(a, k + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda w: w["i"]))

    def union(m: Column) -> Column:
        return F.aggregate(F.transform(m, lambda p, k: F.least(p - F.coalesce(F.get(m, k - 1), F.lit(-WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b)

    return _let(_let(ranked, places), union)


def line_passes(line: Column) -> Column:
    """Whether a line with words passes the rules on punctuation, navigation and boilerplate."""

    def shares(ws: Column) -> Column:
        n = F.size(ws)
        noisy = F.size(F.filter(ws, lambda w: w.rlike(NOISY_WORD)))
        bars = F.size(F.filter(ws, lambda w: w.rlike(SEPARATOR)))
        return (noisy <= PUNCTUATION_SHARE * n) & (bars <= NAVIGATION_SHARE * n)

    return (~line.rlike(MARKED) | _let(words_of(line), shares)) & ~(_let(F.lower(line), says_phrase) & (F.size(words_of(line)) <= BOILERPLATE_WORDS))


def has_boilerplate(low: Column) -> Column:
    """Whether a text has one of the phrases at all, also within other words: a quick look."""
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | low.contains(phrase)
    return out


def says_phrase(low: Column) -> Column:
    return has_boilerplate(low) & low.rlike(PHRASE)


def quality_rules(docs: DataFrame, text: str = "text", kept_share: float = KEPT_SHARE) -> DataFrame:
    """``docs`` with its columns and the rules' results after them.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text (the passing lines),
    clean_words, kept. Null and empty texts have no words, fail the base and are not kept; their clean text is empty.
    Repeated rows are judged alike, long texts whole. Columns of ``docs`` with an added name are replaced.

    Texts without any mark or phrase that the line rules look for keep all their lines, which is told by one pass over
    the whole text.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    body = F.coalesce(F.col(text), F.lit(""))
    wordy = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^ \t-\r]"))
    out = docs.select(*names, words_of(body).alias("_words"), wordy.alias("_lines"), (body.rlike(MARKED) | has_boilerplate(F.lower(body))).alias("_looked_at"), F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"))
    out = out.select(
        *names,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("bigint").alias("n_repeat_words"),
        F.array_join(F.when(F.col("_looked_at"), F.filter("_lines", line_passes)).otherwise(F.col("_lines")), "\n").alias("clean_text"),
        "_looked_at",
    )
    words = F.when(F.col("_looked_at"), F.size(words_of(F.col("clean_text"))).cast("bigint")).otherwise(F.col("n_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "clean_words": words})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("clean_words") >= kept_share * F.col("n_words")))
    return out.select(*names, *ADDED)
