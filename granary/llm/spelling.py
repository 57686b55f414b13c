"""Groups of spelling variants: letter-parity masks in three bands, joined, filtered by length and verified."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import Scratch

#: Letters a run consists of, the least length of a word, its least count, one run in how many loses a letter.
LETTERS, LEAST, TWICE, DAMAGED = "A-Za-z\\u00C0-\\u00FF", 7, 2, 31
#: How many times as frequent a word's form is.
RATIO = 10
#: Parity bits: a-z have one each, dealt to the bands in turn; the others share the rest. Three bands of 21.
BITS, BANDS = 63, 3


def damaged_words(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Every counted occurrence of a word: lower-cased runs, of which one in DAMAGED loses a letter."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        # a run that is too short, or gets too short, is no word, so shorter ones are not taken out at all
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST)


def parity_mask(word: Column) -> Column:
    """One bit for each letter that occurs an odd number of times: one edit flips at most two bits."""
    code = lambda c: F.ascii(c)  # noqa: E731  the code point
    rest = BITS - 26
    bit = lambda c: F.when(code(c) < 128, code(c) - 97).otherwise(26 + (code(c) - 192) % rest)
    flip = lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int")))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(flip(mask, c)))


#: The bits of each band: every third one, so that each has a third of a-z.
_BAND = [sum(1 << b for b in range(BITS) if b % BANDS == i) for i in range(BANDS)]


def _half(word: Column, base: Column, side: int) -> Column:
    """The first base // 2 letters, or the last base - base // 2: one edit leaves one of the two as it is."""
    k = F.floor(base / 2).cast("int")
    return F.substring(word, F.lit(1), k) if side == 0 else F.right(word, base - k)


def _posted(words: DataFrame, base: Column) -> DataFrame:
    """Words under their keys: each band's bits with each half, among words of a base length."""
    keys = [
        F.struct(F.lit(2 * i + s).cast("byte").alias("no"), F.xxhash64(F.lit(2 * i + s), "base", F.col("mask").bitwiseAND(F.lit(_BAND[i])), _half(F.col("word"), F.col("base"), s)).alias("key"))
        for i in range(BANDS)
        for s in (0, 1)
    ]
    return words.withColumn("base", base).withColumn("post", F.explode(F.array(*keys))).select("post.key", "post.no", "word", "n", "len", "base", "mask")


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of ``words`` (word, n, len, mask) that differ by one letter: word, n, near, near_n; each pair once.

    Words meet under an equal band of their masks. A band alone has few values, so a key also
    holds the length of the shorter word and the half of the word that the edit leaves
    alone: no key gathers a share of the vocabulary. A pair comes from its first common key only.
    """
    left = _posted(words, F.col("len"))
    same = words.withColumn("base", F.col("len"))
    longer = words.withColumn("base", F.col("len") - 1).filter(F.col("base") >= LEAST)
    right = _posted(same.unionByName(longer), F.col("base")).select("key", *[F.col(c).alias(f"{c}2") for c in ("no", "word", "n", "len", "base", "mask")])
    flipped = F.col("mask").bitwiseXOR(F.col("mask2"))
    # of the bands that are equal the first, and the first half before the second
    first = F.lit(BANDS)
    for i in reversed(range(BANDS)):
        first = F.when(flipped.bitwiseAND(F.lit(_BAND[i])) == 0, i).otherwise(first)
    second = (_half(F.col("word"), F.col("base"), 0) != _half(F.col("word2"), F.col("base"), 0)).cast("int")
    met = (
        (left["key"] == right["key"])
        & (F.col("base") == F.col("base2"))
        & (F.col("no") == F.col("no2"))
        & F.when(F.col("len") == F.col("len2"), F.col("word") < F.col("word2")).otherwise(F.col("len2") == F.col("len") + 1)
        & (F.bit_count(flipped) <= F.when(F.col("len") == F.col("len2"), 2).otherwise(1))
        & (F.col("no") == 2 * first + second)
        & (F.levenshtein("word", "word2", 1) == 1)
    )
    return left.join(right, met).select("word", "n", F.col("word2").alias("near"), F.col("n2").alias("near_n"))


def roots(links: DataFrame, hops: int, work: Scratch) -> DataFrame:
    """The last word that each word's forms lead to, by pointer doubling; counts rise tenfold at each hop, so there are few."""
    now = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, hops))))):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = work.keep(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return now


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, how many words are one letter away, and the form and root of each.

    Words are the runs of letters of whole texts, A-Z in lower case, after one run in 31 (by a
    checksum of id and run) has lost a letter, that have at least 7 letters and occur at least
    twice. Near words differ by one letter put in, left out or replaced. The form is the near
    word of the largest count, at least ten times the word's own; ties go to the smallest by code
    point. The root is where the forms lead.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count
    each; long runs are words like others; an empty table, or one without such words, gives
    no rows. Other columns are ignored.
    """
    work = Scratch(docs.sparkSession, "spelling")
    counts = damaged_words(docs, id_col=id_col, text_col=text_col).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= TWICE)
    words = work.keep(counts.select("word", "n", F.length("word").alias("len"), parity_mask(F.col("word")).alias("mask")), "words")
    pairs = near_pairs(words).select(
        F.explode(
            F.array(
                F.struct("word", "n", F.col("near").alias("other"), F.col("near_n").alias("m")),
                F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")),
            )
        ).alias("p")
    ).select("p.*")
    best = F.min(F.when(F.col("m") >= RATIO * F.col("n"), F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))))
    near = work.keep(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "near")
    most = words.agg(F.max("n")).first()[0] or TWICE
    last = roots(near.filter(F.col("form").isNotNull()), int(math.log(most / TWICE, RATIO)) + 1, work)
    return (
        words.join(near, "word", "left")
        .join(last, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
    )
