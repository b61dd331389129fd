"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

DataFrame functions only; one row in, one row out, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.expr import let
from palimpsest.llm.common import texts, words

#: Documents below this many words fail at once.
MIN_WORDS = 50
#: ... and those with more than this share (per cent) of words in repeated 3-word windows.
MAX_REPEATED = 50
#: Of its words a document must keep this share (per cent) after the removal of lines.
MIN_KEPT = 50

#: Lines of more words are no menus, and of more than ``MAX_FURNITURE`` no page furniture.
MAX_ENTRIES = 12
MAX_FURNITURE = 20

SYMBOLS = "[#*$%&|<>]"
# A sentence, clause or quotation ends somewhere in the line.
_SENTENCE_END = r"""[.!?…:;。！？।؟](["'”’»)\]]|\s|$)"""
# Every second word or more ends in exclamation marks: shouting, not prose.
_SHOUTED = r"!{2,}(\s|$)"
# Columns and breadcrumbs: separators that stand alone between entries.
_NAVIGATION_MARK = r"\s[|»›>·•]+(\s|$)"
_NAVIGATION_SIGNS = "|»›>·•"
# How most sentences end; asked first because it is cheap.
_USUAL_ENDS = (".", "!", "?")
#: Entries of menus, in lower case; a line made of these alone is navigation.
NAVIGATION_WORDS = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous",
    "back to top", "contact", "contact us", "about", "about us", "skip to content", "read more", "share",
)
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "use cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "javascript is disabled", "click here", "subscribe to our newsletter",
)


def _any_of(phrases: tuple[str, ...]) -> str:
    return "(" + "|".join(phrases) + ")"


def _failure(line: Column, n: Column) -> Column:
    """The rule that a line with ``n`` words fails, or null."""
    marks = lambda pattern: F.regexp_count(line, F.lit(pattern))
    signs = reduce(Column.__or__, (line.contains(c) for c in _NAVIGATION_SIGNS))
    ended = reduce(Column.__or__, (line.endswith(c) for c in _USUAL_ENDS)) | line.rlike(_SENTENCE_END)
    entries = rf"^\W*{_any_of(NAVIGATION_WORDS)}(\W+{_any_of(NAVIGATION_WORDS)})*\W*$"
    return (
        F.when(
            ((n <= MAX_ENTRIES) & F.lower(line).rlike(entries))
            | (signs & (marks(_NAVIGATION_MARK) * 3 >= n)),
            "navigation",
        )
        .when((n <= MAX_FURNITURE) & F.lower(line).rlike(_any_of(BOILERPLATE)), "boilerplate")
        .when(~ended | (line.contains("!!") & (n >= 3) & (marks(_SHOUTED) * 2 >= n)), "punctuation")
    )


def _repeated_words(word_list: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def count(hashes: Column) -> Column:
        n = F.size(hashes)
        starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(
            starts, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
        )

        def covered(keys: Column) -> Column:
            # Ordered by window, equal ones are neighbours.
            ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def in_runs(o: Column) -> Column:
                equal = F.filter(
                    o,
                    lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"]),
                )
                each = F.transform(equal, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
                return F.size(F.array_distinct(F.flatten(each)))

            return let(ordered, in_runs)

        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), count)


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, the lines that pass, and the verdict for each row of ``docs``.

    A line without words is neutral: it is kept and fails no rule.  Others fail as
    navigation (menu entries alone, or entries set apart by bars and arrows), as
    boilerplate (short, with a phrase of page furniture) or by punctuation (no
    sentence ends in it, or every second word is shouted).  ``cleaned`` has the
    lines that are left.  ``kept`` is false for documents that fail the base counts
    and for those of whose words less than ``MIN_KEPT`` per cent is left.

    Null and empty texts have no words and fail; a null id stays null; repeated rows
    give repeated results; an empty table gives an empty one.  Other columns are not
    looked at.  Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_kept_words, n_failed_lines, cleaned.
    """

    def judged(text: Column) -> Column:
        each = F.transform(
            F.split(text, "\n"),
            lambda line: let(
                words(line),
                lambda w: F.struct(
                    line.alias("line"), w.alias("words"), F.when(F.size(w) > 0, _failure(line, F.size(w))).alias("failure")
                ),
            ),
        )
        return let(each, lambda lines: let(F.flatten(lines["words"]), lambda w: _row(text, lines, w)))

    def _row(text: Column, lines: Column, w: Column) -> Column:
        worded = F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), lambda x: x["line"])

        def left(passed: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeated_words(w).cast("long").alias("n_repeat_words"),
                F.aggregate(passed, F.lit(0).cast("long"), lambda a, x: a + F.size(x["words"])).alias("n_kept_words"),
                (F.size(lines) - F.size(passed)).cast("long").alias("n_failed_lines"),
                F.array_join(passed["line"], "\n").alias("cleaned"),
            )

        return let(F.filter(lines, lambda x: x["failure"].isNull()), left)

    r = texts(docs, id_column, text_column).select("doc_id", judged(F.col("text")).alias("r"))
    counted = r.select("doc_id", "r.*")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_kept_words") * 100 >= F.col("n_words") * MIN_KEPT)).alias("kept"),
        "n_kept_words", "n_failed_lines", "cleaned",
    )


