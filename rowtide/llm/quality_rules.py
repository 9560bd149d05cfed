"""Line-first document cleaning with DataFrame expressions only.

Every line is judged by itself on three rules (punctuation, navigation,
boilerplate); failing lines are removed, and a document that loses more than
``max_loss`` of its characters is rejected.  Beside the verdict stand the usual
whole-document counts.  It is one narrow projection: no shuffle and no Python.

Defined results: a null or empty text has no words, loses nothing and fails the
base rule (fewer than ``min_words`` words).  A very long text is judged whole.  Equal rows give equal results, rows
never influence each other, an empty table gives an empty one.  Input columns
named like an output column are replaced by it; others are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import WORD, let, words

SYMBOLS = "#*$%&|<>"
#: A line that holds none of these marks is no sentence; among them those of Arabic, Urdu, Hindi, Armenian, Ethiopic, Burmese, Khmer and Tibetan
#: and of full width.  Thai and Lao (U+0E00 to U+0EFF) mark no sentences, so any of their letters counts as one.
SENTENCE_MARKS = r"[.!?,;:\x{2026}\x{0589}\x{060C}\x{061B}\x{061F}\x{06D4}\x{0964}\x{0965}\x{0E00}-\x{0EFF}\x{0F0D}-\x{0F11}\x{104A}\x{104B}\x{1362}\x{17D4}\x{17D5}\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}]"
#: Marks that separate the entries of a menu or trail.
MENU_MARKS = "|»›•·>"
#: In lower case; a line that holds one of these is no prose.
BOILERPLATE = (
    "lorem ipsum",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "subscribe to our",
    "click here",
    "sign in to",
    "log in to",
    "licensed under",
    "permission is hereby granted",
    "copyright (c)",
    "alle rechte vorbehalten",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "hier klicken",
    "tous droits réservés",
    "politique de confidentialité",
    "cliquez ici",
    "todos los derechos reservados",
    "política de privacidad",
    "haga clic aquí",
)


def has_word(line: Column) -> Column:
    return line.rlike(WORD)


def line_fails(line: Column) -> Column:
    """True if a line with a word breaks one of the three rules."""
    no_sentence = ~line.rlike(SENTENCE_MARKS)
    marks = F.regexp_count(line, F.lit(f"[{MENU_MARKS}]"))
    navigation = (marks >= 3) & (marks * 24 > F.length(line))
    boilerplate = let(F.lower(line), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in BOILERPLATE]))
    return has_word(line) & (no_sentence | navigation | boilerplate)


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in ``w``.

    Windows are compared by a 64-bit hash; sorting (hash, place) pairs puts equal
    windows side by side, so the cost is n log n for texts of any length.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )

    def places(s: Column) -> Column:
        same = lambda x, y: F.coalesce(y["h"] == x["h"], F.lit(False))
        return F.transform(
            F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, F.when(j > 0, j - 1).otherwise(F.size(s))))),
            lambda x: x["i"],
        )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = let(pairs, lambda s: F.sort_array(places(s)))
        steps = let(marked, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
        total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def clean_lines(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: float = 0.5, max_loss: float = 0.5) -> DataFrame:
    """``docs`` with counts, ``clean_text`` (the lines that passed) and the verdict ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeated"))

    def by_lines(x: Column) -> Column:
        passed = let(F.filter(x, lambda y: ~line_fails(y)), lambda k: F.struct(F.size(k).alias("n"), F.array_join(k, "\n").alias("text")))
        repeats = let(F.filter(x, has_word), lambda k: F.size(k) - F.size(F.array_distinct(k)))
        return F.struct(F.size(x).alias("n"), repeats.cast("long").alias("repeats"), passed.alias("passed"))

    # Words, lines and the lines that pass are each made once a row.
    bound = docs.withColumns({"__w": let(words(F.col(text)), by_words), "__l": let(F.split(body, "\n"), by_lines)})
    counted = bound.withColumns(
        {
            "n_words": F.col("__w.n"),
            "word_chars": F.col("__w.chars"),
            "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": F.col("__l.repeats"),
            "n_repeat_words": F.col("__w.repeated"),
            "n_removed_lines": (F.col("__l.n") - F.col("__l.passed.n")).cast("long"),
            "clean_text": F.when(F.col(text).isNotNull(), F.col("__l.passed.text")),
        }
    ).drop("__w", "__l")
    lost = F.length(body) - F.coalesce(F.length("clean_text"), F.lit(0))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 1.0 > F.col("n_words") * F.lit(max_repeat))
    return (
        counted.withColumn("lost_chars", lost.cast("long"))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 1.0 <= F.length(body) * F.lit(max_loss)))
    )
