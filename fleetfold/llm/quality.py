"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by itself (punctuation, navigation, boilerplate), lines that fail are
removed, and a document that loses too much of its text that way is rejected. Counts over the whole
text (``base_counts``) reject what is too short or too repetitive before that. Nothing is shuffled:
each row is decided from its own text, and the work is linear in it but for one sort of its windows.

Null, empty and blank texts have no words: all counts are 0 and the document is rejected as too short.
Null ids, repeated rows and other columns pass through unchanged; columns of the input that have the
name of a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import fixed, words

SYMBOLS = r"[#*$%&|<>]"
# How a sentence ends, what separates the entries of a menu, phrases of page furniture.
SENTENCE_END = r"[.!?:;…][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SEPARATORS = r"[|›»·•→]"
MARKS = r"[#*$%&|<>!?›»·•→]"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|uses cookies|enable javascript"
    r"|licensed under|copyright|©|click here|sign up|log in|subscribe|read more|share this)"
)


@dataclass(frozen=True)
class Limits:
    """``min_words``, ``max_repeat_percent``: of a document. The others: of a line."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 50
    open_line_words: int = 12  # a line that does not end like a sentence must have this many words
    max_symbol_percent: int = 10  # symbols of a line, of its characters that are not blanks
    max_shouts: int = 5  # marks in doubled exclamation or question marks
    menu_separators: int = 3
    menu_entry_words: int = 4  # a line with so many separators has at least this many words to each
    boilerplate_words: int = 30  # a phrase of page furniture condemns a line shorter than this


FEW = 32


def _windows(words_: Column) -> Column:
    """A hash for each three-word window, in order."""
    hashed = F.transform(words_, lambda w, i: F.xxhash64(w, F.get(words_, i + 1), F.get(words_, i + 2)))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words_) - 2, F.lit(0)))


def _positions(rows: DataFrame) -> DataFrame:
    """Replace ``_hashes`` by ``_at``: in order, where windows stand that are not alone.

    Sorted hashes show which occur twice or more. A few of them are looked for in every window; for
    more than ``FEW`` the windows are sorted with their positions, so that equal ones meet. Both ways
    give the same positions. Arrays that a lambda function refers to are computed columns here.
    """
    rows = fixed(rows, _ordered=F.sort_array("_hashes"))
    repeats = F.filter("_ordered", lambda h, i: (i > 0) & h.eqNullSafe(F.get("_ordered", i - 1)))
    rows = fixed(rows, _doubled=F.array_distinct(repeats)).drop("_ordered")
    pairs = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = fixed(rows, _pairs=F.when(F.size("_doubled") > FEW, F.sort_array(pairs)))
    sought = F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), lambda i: F.array_contains("_doubled", F.get("_hashes", i)))
    same = lambda p, k: F.get("_pairs", k)["h"].eqNullSafe(p["h"])
    met = F.transform(F.filter("_pairs", lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])
    none = F.array().cast("array<int>")
    at = F.when(F.size("_doubled") == 0, none).when(F.size("_doubled") <= FEW, sought).otherwise(F.sort_array(met))
    return rows.withColumn("_at", at).drop("_hashes", "_doubled", "_pairs")


def _width(positions: Column) -> Column:
    """Words covered by three-word windows at sorted positions."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def line_words(line: Column) -> Column:
    return F.struct(line.alias("line"), words(line).alias("words"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the array ``_lines``.

    ``_lines`` holds each line that has a word, with its words. A line break is a blank, so the words
    of the text are those of its lines.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line_words), lambda x: F.size(x["words"]) > 0)
    rows = fixed(docs.drop(*(n for n in names if n != text)), _lines=lines)
    rows = fixed(rows, _words=F.flatten(F.col("_lines")["words"]))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct(F.col("_lines")["line"]))).cast("long"),
            "_hashes": _windows(F.col("_words")),
        }
    )
    rows = _positions(rows.drop("_words"))
    return rows.withColumn("n_repeat_words", _width(F.col("_at"))).drop("_at")


def line_fails(entry: Column, limits: Limits) -> Column:
    """Whether a line (see ``line_words``) is removed. Cheap conditions stand before the costly ones."""
    line, count = entry["line"], F.size(entry["words"])
    solid = F.length(F.array_join(entry["words"], ""))
    open_end = (count < limits.open_line_words) & ~F.rlike(line, F.lit(SENTENCE_END))
    noisy = 100 * F.regexp_count(line, F.lit(SYMBOLS)) > limits.max_symbol_percent * solid
    shouting = F.regexp_count(line, F.lit(r"[!?]{2}")) >= limits.max_shouts
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    menu = (separators >= limits.menu_separators) & (count < limits.menu_entry_words * (separators + 1))
    marked = F.rlike(line, F.lit(MARKS)) & (noisy | shouting | menu)
    furniture = (count < limits.boilerplate_words) & F.rlike(line, F.lit(BOILERPLATE))
    return open_end | furniture | marked


def clean(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Add the base counts, clean_text, n_removed_lines, lost_chars, base_failed and kept."""
    rows = base_counts(docs, text)
    rows = fixed(rows, _good=F.filter("_lines", lambda x: ~line_fails(x, limits)))
    solid = F.length(F.array_join(F.flatten(F.col("_good")["words"]), ""))
    base_failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )
    lost = (F.col("word_chars") - solid).cast("long")
    rows = rows.withColumns(
        {
            "clean_text": F.array_join(F.col("_good")["line"], "\n"),
            "n_removed_lines": (F.size("_lines") - F.size("_good")).cast("long"),
            "lost_chars": lost,
            "base_failed": base_failed,
        }
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= limits.max_lost_percent * F.col("word_chars"))
    return rows.withColumn("kept", kept).drop("_lines", "_good")
