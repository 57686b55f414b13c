"""Language identification by fusing the evidence of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ROW, map_rows, possibly_in, row_key
from granary.session import materialize

#: Hashed letter trigrams; documents of each language that the text model is fitted on (the documented bound); languages counted at once in a task.
BUCKETS, PER_LANGUAGE, AT_ONCE = 1 << 15, 1500, 64
#: Neighbouring trigrams are not independent: so much of their log-likelihood counts.
TEMPER = 1 / 3
#: Weights of the broader level in the smoothing of hosts by suffixes, and of suffixes by all rows.
HOST_PRIOR, SUFFIX_PRIOR = 10.0, 20.0
UNKNOWN = "und"
#: Declared languages that have a model each, and the name of the model that all others share.
MOST_LANGUAGES, OTHER = 255, "other"
UNKNOWN_PRIOR = 1e-3


def _letter_table() -> np.ndarray:
    t = np.zeros(0x3000, bool)
    for c in range(0x3000):
        t[c] = chr(c).isalpha()
    return t


_LETTER = _letter_table()


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams around each letter; whatever is no letter counts as one space."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(x < 0x3000, _LETTER[np.minimum(x, 0x2FFF)], x >= 0x3040)
    x = np.where(letter, x, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = letter[:1]
    x = np.concatenate([[32], x[keep], [32]]).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return ((h >> np.uint32(17)) & np.uint32(BUCKETS - 1))[x[1:-1] != 32].astype(np.intp)


@dataclass
class TextModel:
    """Log-likelihoods by bucket, sparse: ``languages[lang[k]]`` gains ``gain[k]`` over ``base`` for k from start[bucket] on."""

    languages: list[str]
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray  # by language, of a trigram that it never showed; the last is the uniform model

    def log_likelihoods(self, text: str) -> list[float]:
        h = trigrams(text)
        n = np.bincount(h, minlength=BUCKETS)
        seen = np.flatnonzero(n)
        size = self.start[seen + 1] - self.start[seen]
        at = np.arange(size.sum()) + np.repeat(self.start[seen] - (np.cumsum(size) - size), size)
        total = np.bincount(self.lang[at], self.gain[at] * np.repeat(n[seen], size), minlength=len(self.base)) + len(h) * self.base
        return (TEMPER * total).tolist()


def base_language(declared: Column) -> Column:
    """A declared value in lower case without region or script (en-US is en)."""
    return F.regexp_replace(F.lower(F.trim(declared)), r"[-_].*$", "")


def fit_text(rows: DataFrame, *, per_language: int = PER_LANGUAGE, most: int = MOST_LANGUAGES) -> TextModel:
    """Trigram models of all declared languages of (id, text, declared), however rare.

    The ``most`` most frequent ones (ties: the first by name) have a model each; all others share the model OTHER,
    so that rows, models and what reaches the driver stay bounded whatever stands in the data.
    Of each language about ``per_language`` rows with the least hashes are used; only their
    summed counts by language and bucket reach the driver. Rows without declared language or text do
    not count. Half a count for every bucket shrinks rare languages towards the uniform model; a
    trigram that a language never showed costs at least twice as much as in the uniform model, so
    that a language with next to no text does not stand for all unknown ones.
    """
    spark = rows.sparkSession
    named = rows.filter("declared IS NOT NULL AND text IS NOT NULL AND text <> ''").filter(~F.col("declared").isin("", UNKNOWN))
    every = named.groupBy("declared").agg(F.count("*").alias("n"))
    counts = {r["declared"]: r["n"] for r in every.filter(F.col("declared") != OTHER).orderBy(F.desc("n"), "declared").limit(most).collect()}
    rest = every.filter(~F.col("declared").isin(list(counts))).agg(F.sum("n")).first()[0]
    if rest:
        named = named.withColumn("declared", F.when(F.col("declared").isin(list(counts)), F.col("declared")).otherwise(OTHER))
        counts[OTHER] = rest
    names = sorted(counts)
    shares = spark.createDataFrame([(d, min(1.0, per_language / n)) for d, n in counts.items()], "declared string, share double")
    spot = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = named.join(F.broadcast(shares), "declared").filter(spot < F.col("share")).select("declared", "text")
    at = {x: i for i, x in enumerate(names)}

    def flat(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            j = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), lang)), pa.array(j), pa.array(n[j])], names=["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    k = at[lang]
                    if k not in total:
                        if len(total) >= AT_ONCE:
                            yield from flat(total)
                            total = {}
                        total[k] = np.zeros(BUCKETS, np.int64)
                    total[k] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield from flat(total)

    got = picked.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas().sort_values(["bucket", "lang"])
    lang, bucket, n = (got[c].to_numpy(np.int64) for c in ("lang", "bucket", "n"))
    kept, lang = np.unique(lang, return_inverse=True)  # languages without a letter have no model
    whole = np.bincount(lang, n, minlength=len(kept)) + BUCKETS / 2
    base = np.log(np.minimum(0.5 / whole, 0.5 / BUCKETS))
    return TextModel([names[k] for k in kept], np.searchsorted(bucket, np.arange(BUCKETS + 1)), lang.astype(np.int32), np.log((n + 0.5) / whole[lang]) - base[lang], np.append(base, -np.log(BUCKETS)))


def _argmax(v: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def _counts(df: DataFrame, by: list[str], names: Sequence[str], out: str) -> DataFrame:
    """Rows of each language by ``by``: only the languages that are there are counted, the others are 0."""
    each = df.groupBy(*by, "guess").agg(F.count("*").cast("double").alias("n"))
    found = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("found"))
    return found.select(*by, F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at("found", n), F.lit(0.0))).alias(out))


def identify(
    rows: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    suffix_col: str | None = None,
    model: TextModel | None = None,
    least: float = 0.5,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The most probable language of each row, from all evidence at once.

    log posterior = tempered log-likelihood of the text's letter trigrams + log P(declared | language)
    + log P(language | host), where host priors are smoothed by those of the address suffix, and
    these by all rows; all three come from grouped aggregations over the languages that the text
    alone suggests, as does P(declared | language). A further hypothesis "und" has a uniform text
    model. ``accepted`` is false where "und" wins, the best posterior is below ``least``, or the
    text has no letter: null, empty and letterless texts are never accepted. Where nothing can
    speak for a text, because its declared language has no model or no language is declared at
    all, it is accepted as it is.

    Declared values count without region (en-US is en). Those that are too rare for a model of
    their own (see ``fit_text``) share one, as evidence too; where it wins, the language is what the row declares, or "other".

    One row per input row. Null or unknown declared languages, hosts and suffixes are values like
    others; of equal posteriors the first language by name wins. ``keep`` names columns to carry through.
    """
    get = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), base_language(get(declared_col)).alias("declared"), F.lower(get(host_col)).alias("host"), F.lower(get(suffix_col)).alias("suffix"), *[F.col(k).alias(f"keep{i}") for i, k in enumerate(keep)])
    kept = [f"keep{i}" for i in range(len(keep))]
    model = model or fit_text(slim)
    names = [*model.languages, UNKNOWN]
    held = rows.sparkSession.sparkContext.broadcast(model)
    said_as = F.col("declared")  # as evidence, the values without a model of their own are one, if there is a model of them
    if OTHER in model.languages:
        said_as = F.when(said_as.isin("", *names), said_as).otherwise(OTHER)

    def start():
        def step(cols):
            ll = [held.value.log_likelihoods(t or "") for t in cols["text"]]
            return {c: cols[c] for c in ("id", "declared", "host", "suffix", *kept)} | {"ll": ll, "letters": [any(x) for x in ll]}

        return step

    kind = slim.schema["id"].dataType.simpleString()
    more = "".join(f", {c} {slim.schema[c].dataType.simpleString()}" for c in kept)
    seen = map_rows(slim, start, f"id {kind}, declared string, host string, suffix string{more}, ll array<double>, letters boolean")
    for c in ("declared", "host", "suffix"):
        seen = seen.withColumn(c, F.coalesce(c, F.lit("")))
    seen = materialize(seen.withColumn("evidence", said_as).withColumn("guess", F.when(F.col("letters"), _argmax(F.col("ll"), names))), "language-text")
    # three grouped aggregations; the totals are bounded by the number of languages
    totals = {r["guess"]: float(r["count"]) for r in seen.groupBy("guess").count().collect()}
    all_ = [totals.get(n, 0.0) for n in names]
    base = [(x + 1) / (sum(all_) + len(names)) for x in all_]
    base[-1] = min(base[-1], UNKNOWN_PRIOR)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    smooth = lambda c, prior, weight: F.zip_with(c, prior, lambda n, p: (n + weight * p) / (F.aggregate(c, F.lit(0.0), lambda s, x: s + x) + weight))
    suffixes = _counts(seen.filter("guess IS NOT NULL"), ["suffix"], names, "n").select("suffix", smooth(F.col("n"), lit(base), SUFFIX_PRIOR).alias("by_suffix"))
    hosts = _counts(seen.filter("guess IS NOT NULL"), ["host", "suffix"], names, "n").join(suffixes, "suffix")
    hosts = materialize(hosts.select("host", "suffix", smooth(F.col("n"), F.col("by_suffix"), HOST_PRIOR).alias("prior")), "language-hosts")
    declared = _counts(seen.filter("guess IS NOT NULL"), ["evidence"], names, "n")
    # P(declared | language) by adding one to each declared value there is, so it sums to 1; no declaration says nothing
    said = {r["guess"]: float(r["n"]) for r in seen.filter("guess IS NOT NULL AND evidence <> ''").groupBy("guess").agg(F.count("*").alias("n")).collect()}
    values = seen.filter("guess IS NOT NULL AND evidence <> ''").agg(F.countDistinct("evidence")).first()[0]
    total = lit([said.get(n, 0.0) + values for n in names])
    stated = declared.select("evidence", F.when(F.col("evidence") == "", lit([0.0] * len(names))).otherwise(F.zip_with("n", total, lambda n, a: F.log((n + 1) / a))).alias("stated"))
    out = seen.join(hosts, ["host", "suffix"], "left").join(stated, "evidence", "left")
    prior = F.transform(F.coalesce("prior", lit(base)), lambda p: F.log(p))
    score = F.zip_with(F.zip_with("ll", prior, lambda a, b: a + b), F.coalesce("stated", lit([0.0] * len(names))), lambda a, b: a + b)
    out = out.withColumn("post", score).withColumn("best", F.array_max("post"))
    posterior = F.lit(1.0) / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    out = out.withColumn("language", F.when(F.col("letters"), _argmax(F.col("post"), names)).otherwise(UNKNOWN)).withColumn("posterior", posterior)
    own_name = F.when((F.col("language") == OTHER) & ~F.col("declared").isin("", *names), F.col("declared")).otherwise(F.col("language"))
    unmodelled = ~F.col("evidence").isin("", *names) if model.languages else F.lit(True)
    accepted = F.col("letters") & (unmodelled | ((F.col("language") != UNKNOWN) & (F.col("posterior") >= least)))
    result = [F.col("id").alias(id_col), own_name.alias("language"), F.round("posterior", 6).alias("posterior"), F.coalesce("guess", F.lit(UNKNOWN)).alias("text_language"), F.col("declared"), accepted.alias("accepted")]
    return out.select(*result, *[F.col(k).alias(n) for k, n in zip(kept, keep, strict=True)])


def drop_unidentified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", **more) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language ``identify`` accepts.

    The verdict depends on text, declared language and host and is carried by a hash of the
    three, not by the id: rows with one id, or without id, are judged one by one. The texts are
    not shuffled unless a bitmap says that a row may be among the rejected ones.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]  # no name clashes with the marks
    at = dict(zip(docs.columns, own, strict=True))
    keyed = docs.toDF(*own).withColumns(row_key(at[text_col], at[declared_col], at[host_col]))
    judged = identify(keyed, id_col=at[id_col], text_col=at[text_col], declared_col=at[declared_col], host_col=at[host_col], keep=ROW, **more)
    rejected = materialize(judged.filter("NOT accepted").select(*ROW).distinct(), "language-rejected")
    suspect = possibly_in(rejected)(ROW[0])
    passed = keyed.filter(suspect).join(rejected, list(ROW), "left_anti").select(*own)
    return keyed.filter(~suspect).select(*own).unionByName(passed).toDF(*docs.columns)


def identify_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **more) -> DataFrame:
    """``identify`` for web pages: the html tag's lang attribute, the host and the last label of the host are the evidence beside the text."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>?", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    rows = pages.select(F.col(id_col), text.alias("_text"), F.nullif(declared, F.lit("")).alias("_declared"), host.alias("_host"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("_suffix"))
    return identify(rows, id_col=id_col, text_col="_text", declared_col="_declared", host_col="_host", suffix_col="_suffix", **more)
