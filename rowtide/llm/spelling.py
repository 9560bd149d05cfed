"""Spelling variants: words one edit apart, grouped under the form that is far more common.

Every letter has a bit in one of three bands, and a word's mask holds the parity of each
letter's count.  One inserted or deleted letter flips one bit, a replaced one flips two
at most, so of three bands at least one stays as it is.  Words join on an equal band and
length (equal lengths for a replacement, a length and the next for the others), and the
edit distance decides.  A band that keeps its parity under one edit has none of its
letters touched, so its letters in their order are equal too: they are part of the key,
which so parts anagrams and words that merely share parities.  Groups of a key with more
than ``hot`` words are parted once more, by the first and by the last half of the word:
one edit leaves one of the two as it is.  So no pair is lost, whatever the sizes.

Candidates never leave the join: the distance is part of its condition.  The vocabulary,
counted with map-side sums, is written to the shared folder; from there on all work is
on distinct words.  Forms point to words five times as common, so chains have at most
log5 of the largest count; they are followed by doubling.

Defined results: a null text has no words, a null doc_id reads as an empty one; texts of
any length are read whole; repeated rows count again; ties in counts go to the word first
in code-point order; an empty table gives an empty one; columns but doc_id and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import cut

#: What words are made of; only A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS = 3
BITS = 21
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))


def band_of(letter: str) -> int:
    """Neighbours in the alphabet lie in different bands, which so get about a third of any text each."""
    return ord(letter) % BANDS


def bit_of(letter: str) -> int:
    return ord(letter) // BANDS % BITS


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, misspell: int | None = None) -> DataFrame:
    """word and n of all words of so many letters and occurrences.

    With ``misspell`` a word loses a letter where that number divides the CRC-32 of
    ``doc_id:word``: typing errors that can be made again.
    """
    # A run that is shorter can't become long enough.
    runs = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"([{LETTERS}]{{{least_length},}})"), 1)
    plain = F.octet_length("run") == F.length("run")
    low = F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", low.alias("word"))
    if misspell:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        words = words.withColumn("h", h)
        at = (F.col("h") % F.length("word")).cast("int")
        cut_out = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % misspell == 0, cut_out).otherwise(F.col("word")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def mask(word: Column, band: int) -> Column:
    """The parities of the letters of one band, a bit each."""
    bit = {c: 1 << bit_of(c) for c in ALPHABET if band_of(c) == band}
    known = F.create_map(*[F.lit(x) for pair in bit.items() for x in pair])
    return F.aggregate(F.split(word, ""), F.lit(0), lambda all_, c: all_.bitwiseXOR(F.coalesce(known[c], F.lit(0))))


def banded(words: DataFrame) -> DataFrame:
    """word, band, mask and letters of that band; ``at`` is the length of the shorter of a pair.

    Each word is there once for pairs in which it is the shorter (or of the same length),
    and once for pairs in which it is the longer by one.
    """
    others = ["".join(c for c in ALPHABET if band_of(c) != b) for b in range(BANDS)]
    bands = F.array(*[F.struct(F.lit(b).alias("band"), mask(F.col("word"), b).alias("mask"), F.translate("word", others[b], "").alias("letters")) for b in range(BANDS)])
    rows = words.select("word", F.length("word").alias("len"), F.explode(bands).alias("b")).select("word", "len", "b.*")
    return rows.select("word", "band", "mask", "letters", F.explode(F.array(F.struct(F.lit(False).alias("longer"), F.col("len").alias("at")), F.struct(F.lit(True).alias("longer"), (F.col("len") - 1).alias("at")))).alias("s")).select("word", "band", "mask", "letters", "s.*")


KEY = ("band", "mask", "letters", "at")


def near_pairs(words: DataFrame, hot: int = 1000) -> DataFrame:
    """(a, b) and (b, a) of all words that differ by one inserted, deleted or replaced letter."""
    rows = cut(banded(words))
    sizes = rows.groupBy(*KEY).agg(F.count_if("longer").alias("longer"), F.count_if(~F.col("longer")).alias("own"))
    # A group without a pair needs no join; one that is hot is parted by halves.
    wanted = sizes.where((F.col("own") > 1) | (F.col("own") * F.col("longer") > 0)).select(*KEY, (F.col("own") + F.col("longer") > hot).alias("hot"))
    half = F.floor(F.col("at") / 2).cast("int")
    halves = F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), half)), F.concat(F.lit(">"), F.right("word", F.col("at") - half)))
    parts = F.explode(F.when(F.col("hot"), halves).otherwise(F.array(F.lit("")))).alias("part")
    dealt = cut(rows.join(wanted, list(KEY)).select("word", "longer", *KEY, parts))
    key = [*KEY, "part"]
    one = dealt.where("not longer").select(F.col("word").alias("a"), *key)
    two = dealt.select(F.col("word").alias("b"), "longer", *key)
    close = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    found = one.join(two, key).where(close).select("a", "b").distinct()
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form) of ``forms``: where its chain of forms ends."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = now.select(F.col("word").alias("__at"), F.col("root").alias("beyond"))
        step = cut(now.join(beyond, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 5, **options) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row (word, n) of ``words``."""
    words = cut(words)
    pairs = near_pairs(words, **options)
    named = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = pairs.join(named, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("top"))
    near = best.select(F.col("a").alias("word"), "n_near", F.col("top.b").alias("first"), (-F.col("top.m")).alias("first_n"))
    follows = F.col("first_n") >= times * F.col("n")
    known = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("first")).alias("form"), F.when(follows, F.col("first_n")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
