"""Text functions: folding, tokens, keywords, BM25 and name stems."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folds()

#: Words that are never keywords.
STOPWORDS = """about above after again against along also among another because been before being below between
both cannot could does doing down during each either every from further having here itself just make many more most
much must never only other over same should some such than that their them then there these they this those through
under until very were what when where which while will with within without would your yours page slide figure table
http https www com""".split()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"))


def has_all_terms(text: Column, terms: Sequence[str]) -> Column:
    """Whether every term is a token of the text; no terms match nothing."""
    if not terms:
        return F.lit(False)
    out, t = F.lit(True), tokens(text)
    for x in terms:
        out = out & F.array_contains(t, folded(F.lit(x)))
    return out


def prefix_search(blocks: DataFrame, prefix: str, key: str = "asset_id", body: str = "body") -> DataFrame:
    """(key, n): documents with tokens that begin with a prefix, and how many."""
    n = F.size(F.filter(tokens(F.col(body)), lambda t: F.startswith(t, folded(F.lit(prefix)))))
    return blocks.select(key, n.cast("long").alias("n")).filter("n > 0")


def inverted_index(blocks: DataFrame, key: str = "asset_id", body: str = "body") -> DataFrame:
    """(term, key, tf, len): postings with term frequencies and document lengths."""
    t = blocks.select(F.col(key), tokens(F.col(body)).alias("t"))
    return t.select(key, F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def bm25(blocks: DataFrame, query: Sequence[str], *, key: str = "asset_id", body: str = "body", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents that hold every query term, with their BM25 score (higher is better).

    Only postings of the query's terms are counted: the filter stands before the grouping.
    """
    wanted = F.array(*[folded(F.lit(x)) for x in query])
    docs = blocks.select(F.col(key), tokens(F.col(body)).alias("t"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    hits = docs.select(key, F.size("t").alias("len"), F.explode(F.filter("t", lambda x: F.array_contains(wanted, x))).alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("found")).filter(F.col("found") == len(set(query))).drop("found")


def search_files(files: DataFrame, blocks: DataFrame, query: Sequence[str]) -> DataFrame:
    """Files (asset_id, …) whose content holds every query term, with its score and a snippet; a content's copies are all found."""
    hits = bm25(blocks, query)
    shown = blocks.join(hits, "asset_id").select("asset_id", "score", snippet(F.col("body"), query).alias("snippet"))
    return files.join(shown, "asset_id")


def snippet(text: Column, terms: Sequence[str], width: int = 12) -> Column:
    """``width`` words around the first term found, with found terms in brackets."""
    words = F.split(F.trim(text), r"\s+")
    wanted = F.array(*[folded(F.lit(x)) for x in terms])
    bare = lambda w: F.regexp_replace(folded(w), r"[^\p{L}\p{N}]", "")
    at = F.array_position(F.transform(words, lambda w: F.array_contains(wanted, bare(w))), True)
    start = F.greatest(at - width // 2, F.lit(1)).cast("int")
    cut = F.transform(F.slice(words, start, width), lambda w: F.when(F.array_contains(wanted, bare(w)), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.when(at > 0, F.array_join(cut, " "))


def keywords(blocks: DataFrame, *, key: str = "asset_id", body: str = "body", top: int = 12, shortest: int = 4, scan: int | None = None, least_chars: int = 0) -> DataFrame:
    """(key, word, n, confidence): the most frequent words of each text, ties by first appearance.

    Whole texts count, or the first ``scan`` characters of those with at least ``least_chars``.
    """
    t = F.regexp_extract_all(F.lower(body if scan is None else F.substring(body, 1, scan)), F.lit(r"([\p{L}\p{N}_-]+)"))
    words = blocks.filter(F.length(body) >= least_chars).select(key, F.posexplode(t).alias("pos", "word"))
    words = words.filter((F.length("word") >= shortest) & ~F.col("word").rlike(r"^\p{N}") & ~F.col("word").isin(STOPWORDS))
    n = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n >= 2")
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    ranked = n.withColumn("place", F.row_number().over(w)).withColumn("peak", F.max("n").over(Window.partitionBy(key))).filter(F.col("place") <= top)
    return ranked.select(key, "word", "n", F.round(F.col("n") / F.col("peak"), 3).alias("confidence"))


def name_stem(name: Column) -> Column:
    """A file name without extension and marks of copies and versions; never empty."""
    base = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    out = base
    for _ in range(3):  # stacked marks such as _final_v2
        out = F.regexp_replace(out, r"(?:[\s_.-]+(?:v\d+(?:\.\d+)*|final|draft|copy|rev\d+)|\s*\(\d+\))$", "")
    return F.when(F.length(F.trim(out)) > 0, out).otherwise(base)


def name_words(name: Column) -> Column:
    """The words of a file name: letters only, longer than two."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"\.[^.]*$", ""), "[^a-z]+"), lambda w: F.length(w) > 2)
