"""Summaries of a selection: exact counts, money and flags, and a brief in Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns worth a sentence of their own.
NOTABLE = {"credentials": "looks like it holds credentials", "national-id": "has something shaped like a national id", "date-of-birth": "states a date of birth", "medical-terms": "uses clinical language"}
MOST_DETAIL, EXCERPT = 25, 400


def axes(items: DataFrame, columns: list[str]) -> DataFrame:
    """(axis, value, n) for several columns in one pass over ``items`` (one row per content)."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return items.select(parts).filter("x.value IS NOT NULL").groupBy("x.axis", "x.value").agg(F.count("*").alias("n"))


def axes_grouping_sets(items: DataFrame, columns: list[str]) -> DataFrame:
    """The same by GROUPING SETS, for axes that share a selection query."""
    sets = ", ".join(f"({c})" for c in columns)
    axis = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns) + " END"
    return items.sparkSession.sql(f"SELECT {axis} AS axis, coalesce({', '.join(f'cast({c} AS string)' for c in columns)}) AS value, count(*) AS n FROM {{items}} GROUP BY GROUPING SETS ({sets})", items=items).filter("value IS NOT NULL")


def span(items: DataFrame, at: str = "event_at") -> DataFrame:
    """First and last event and how many contents have none."""
    return items.agg(F.count("*").alias("n"), F.min(at).alias("earliest"), F.max(at).alias("latest"), F.count_if(F.col(at).isNull()).alias("undated"))


#: The kinds of tags that a digest of files counts.
DIGEST_KINDS = ("doctype", "topic", "author", "entity", "date", "pattern")


def digest_files(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(axis, value, n) over the files of a selection: tags by kind, media types, and folders by their first two segments.

    files(file_id, parent_rel, media_type), tags(file_id, kind, name). All axes are counted in one grouping.
    """
    folder = F.array_join(F.slice(F.filter(F.split("parent_rel", "/"), lambda x: x != ""), 1, 2), "/")
    own = files.select(F.explode(F.array(F.struct(F.lit("media").alias("axis"), F.col("media_type").alias("value")), F.struct(F.lit("folder").alias("axis"), F.nullif(folder, F.lit("")).alias("value")))).alias("x")).select("x.axis", "x.value")
    by = tags.filter(F.col("kind").isin(*DIGEST_KINDS)).join(files.select("file_id"), "file_id", "left_semi").select("file_id", F.col("kind").alias("axis"), F.col("name").alias("value")).distinct()
    return own.filter("value IS NOT NULL").unionByName(by.select("axis", "value")).groupBy("axis", "value").agg(F.count("*").alias("n"))


def digest_totals(files: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: files, bytes, first and last change (a time of 0 is none), and how many bear no date tag."""
    dated = tags.filter("kind = 'date'").select("file_id").distinct().withColumn("dated", F.lit(True))
    at = F.when(F.col("mtime_ns") != 0, F.col("mtime_ns"))
    return files.join(dated, "file_id", "left").agg(F.count("*").alias("count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.min(at).alias("earliest"), F.max(at).alias("latest"), F.count_if(F.col("dated").isNull()).alias("undated"))


def money_totals(items: DataFrame, money: str = "money") -> DataFrame:
    """Per currency: contents that name it, the sum of their greatest amounts, and the greatest of all."""
    m = items.select(F.explode(F.map_entries(money)).alias("e"))
    return m.groupBy(F.col("e.key").alias("currency")).agg(F.count("*").alias("documents"), F.round(F.sum("e.value.max"), 2).alias("total"), F.max("e.value.max").alias("largest"))


def flags(items: DataFrame, patterns: str = "patterns") -> DataFrame:
    """(flag, sentence, n) for the notable patterns that fired."""
    fired = items.select(F.explode(F.array_distinct(patterns)).alias("flag")).filter(F.col("flag").isin(list(NOTABLE))).groupBy("flag").agg(F.count("*").alias("n"))
    said = F.create_map(*[F.lit(x) for kv in NOTABLE.items() for x in kv])
    return fired.select("flag", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " item ").otherwise(" items "), said[F.col("flag")]).alias("sentence"), "n")


def brief(items: DataFrame, label: str) -> dict[str, str]:
    """A Markdown brief of a selection; only its counts and the first items reach the driver."""
    def date(t):
        return t and __import__("datetime").datetime.fromtimestamp(t, __import__("datetime").timezone.utc).strftime("%d %b %Y").lstrip("0")

    n, first, last, undated = span(items).first()
    kinds = [r for r in axes(items, ["doctype"]).orderBy(F.desc("n"), "value").limit(5).collect()]
    plural = lambda k, word: f"{k} {word}{'' if k == 1 else 's'}"
    title = ", ".join(plural(r["n"], r["value"]) for r in kinds[:3]) or plural(n, "item")
    lines = [f"# {title}", "", f"Selection: {label}.", ""]
    if first is not None:
        lines += [f"Dates run from {date(first)} to {date(last)}" + (f"; {undated} undated." if undated else "."), ""]
    for r in money_totals(items).orderBy("currency").collect():
        lines.append(f"- {r['currency']}: {plural(r['documents'], 'document')}, {r['total']:,.2f} in total, {r['largest']:,.2f} at most")
    for r in flags(items).orderBy("flag").collect():
        lines.append(f"- Note: {r['sentence']}.")
    for r in items.orderBy(F.desc_nulls_last("event_at"), "name").limit(MOST_DETAIL).select("name", F.substring(F.coalesce("excerpt", F.lit("")), 1, EXCERPT).alias("excerpt")).collect() if "excerpt" in items.columns else []:
        lines.append(f"- **{r['name']}** {r['excerpt']}".rstrip())
    return {"title": title, "body": "\n".join(lines)}
