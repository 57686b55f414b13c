"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD
from granary.session import materialize

#: A document's place in its source: the first 60 bits of md5(id); 12 bits make a histogram level.
KEY_BITS, LEVEL_BITS = 60, 12


def hash_key(id_col: str) -> Column:
    """Uniform 60-bit key of a document id; null ids count as the empty string."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_ranks(sources: DataFrame) -> DataFrame:
    """0-based rank of each source by code point, null last, without one task seeing all sources."""
    parts = materialize(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("pid", F.spark_partition_id()),
        "mix-sources",
    )
    # one row for each partition of the range sort: bounded by the number of partitions, not by the sources
    before = F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.coalesce(before, F.lit(0)).alias("off"))
    w = Window.partitionBy("pid").orderBy(F.col("source").isNull(), "source")
    return parts.join(F.broadcast(offsets), "pid").withColumn("rank", F.col("off") + F.row_number().over(w) - 1).drop("pid", "off")


def water_level(sources: DataFrame, budget: float) -> float:
    """The words a unit of weight gets when capped sources give their excess to the others.

    Each round only brings three sums to the driver; it ends when no further source is capped.
    """
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        full, weight, n = sources.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(over.cast("long"))
        ).first()
        if n is None or n == capped or not weight:
            return level
        level, capped = max(level, (budget - full) / weight), n


def _boundary(hist: DataFrame, by: str) -> DataFrame:
    """The bucket of each source in which the running sum first exceeds ``want``."""
    run = F.sum("words").over(Window.partitionBy("skey").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("run", run).filter((F.col("run") > F.col("want")) & (F.col("run") - F.col("words") <= F.col("want")))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """How many words a mixture takes of each document.

    Sources, ordered by code point with null last, have the weights in turn. They share
    ``share`` times all words by weight; a target stops at ``cap`` times its source's words
    and the excess goes to the others by weight. A source takes every document
    floor(target / words) times; of the rest, it takes the documents whose hash is below a
    threshold. The threshold comes from nested histograms: words by source and the first 12
    bits of the hash, then only the boundary bucket by the next 12 bits, then its documents.
    The document on the threshold gives just the missing words (shared in proportion if rows
    have the same id).

    Null or empty texts have size 0 and take 0; null sources are one source; repeated rows
    count each; an empty table gives an empty result. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            size.alias("size"),
            hash_key(id_col).alias("key"),
        ).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))),
        "mix-sizes",
    )
    shift = KEY_BITS - LEVEL_BITS
    first = F.shiftright("key", shift)
    second = F.shiftright("key", shift - LEVEL_BITS)
    # salted by bucket: a hot source is summed by many tasks before its total is taken
    hist = slim.groupBy("skey", "source", first.alias("b1")).agg(F.sum("size").alias("words"))
    hist = materialize(hist, "mix-histogram")
    sources = hist.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    w = F.array(*[F.lit(int(x)) for x in weights])
    sources = source_ranks(sources).withColumns(
        {
            "weight": F.get(w, (F.col("rank") % len(weights)).cast("int")).cast("double"),
            "cap": F.lit(float(cap)) * F.col("source_size"),
        }
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, float(share) * total)
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        sources.withColumn("target", target)
        .withColumn("whole", whole.cast("long"))
        .withColumn("want", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .select("skey", "source_size", "target", "whole", "want")
    )
    one = _boundary(hist.join(plan.select("skey", "want"), "skey"), "b1")
    one = one.select("skey", "b1", (F.col("want") - (F.col("run") - F.col("words"))).alias("want"))
    inner = slim.withColumn("b1", first).join(one, ["skey", "b1"])
    two = _boundary(inner.groupBy("skey", "want", second.alias("b2")).agg(F.sum("size").alias("words")), "b2")
    two = two.select("skey", "b2", (F.col("want") - (F.col("run") - F.col("words"))).alias("want"))
    # a boundary bucket of two levels holds about one in 2**24 of a source's documents
    last = slim.withColumn("b2", second).join(two, ["skey", "b2"]).groupBy("skey", "want", "key").agg(F.sum("size").alias("words"))
    cut = _boundary(last, "key").select(
        "skey", F.col("key").alias("cut"), (F.col("want") - (F.col("run") - F.col("words"))).alias("rest"), F.col("words").alias("tied")
    )
    plan = materialize(plan.drop("want").join(cut, "skey", "left"), "mix-plan")
    extra = (
        F.when(F.col("key") < F.col("cut"), F.col("size"))
        .when(F.col("key") == F.col("cut"), F.floor(F.col("rest") * F.col("size") / F.col("tied")))
        .otherwise(0)
    )
    return slim.join(plan, "skey").select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken")
    )


#: The same in SQL: one running sum over the hash order instead of histograms.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s0, source IS NULL AS sn,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT sn, s0, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY sn, s0) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY sn, s0
), level(n, lv) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT x.n, (x.budget - x.full_) / x.weight
  FROM (
    SELECT l.n AS was, sum(CASE WHEN l.n >= 0 AND 2.0 * source_size <= l.lv * weight THEN 1 ELSE 0 END)::BIGINT AS n,
           sum(CASE WHEN l.n >= 0 AND 2.0 * source_size <= l.lv * weight THEN 2.0 * source_size ELSE 0 END)::DOUBLE AS full_,
           sum(CASE WHEN l.n >= 0 AND 2.0 * source_size <= l.lv * weight THEN 0 ELSE weight END)::DOUBLE AS weight,
           (1.5 * sum(source_size))::DOUBLE AS budget
    FROM level l, s GROUP BY l.n, l.lv
  ) x WHERE x.n <> x.was AND x.weight > 0
), p AS (
  SELECT sn, s0, source_size, least(2.0 * source_size::DOUBLE, (SELECT max(lv) FROM level) * weight) AS target FROM s
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p
), t AS (
  SELECT d.*, q.source_size, q.target, q.whole, CAST(floor(q.target - q.whole * q.source_size) AS BIGINT) AS want,
         sum(size) OVER (PARTITION BY d.sn, d.s0, key) AS tied,
         sum(size) OVER (PARTITION BY d.sn, d.s0 ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM d JOIN q ON d.sn = q.sn AND d.s0 = q.s0
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(whole * size + CASE WHEN run <= want THEN size WHEN run - tied < want AND tied > 0
            THEN floor((want - (run - tied)) * size / tied) ELSE 0 END AS BIGINT) AS taken
FROM t
"""
