"""What to look at next: files with gaps, and names that repeat across folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import name_stem, name_words


def queue(files: DataFrame, tags: DataFrame, most: int = 120) -> DataFrame:
    """Files by how much they miss: no doctype 3, no topic 2, few tags, deep folders and speaking names.

    files(file_id, name, rel_path, parent_rel), tags(file_id, kind, name).
    """
    t = tags.groupBy("file_id").agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))
    j = files.join(t, "file_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "kinds": F.coalesce("kinds", F.array().cast("array<string>"))})
    no = lambda k: ~F.array_contains("kinds", k)
    depth = F.size(F.filter(F.split("parent_rel", "/"), lambda x: x != ""))
    score = F.when(no("doctype"), 3).otherwise(0) + F.when(no("topic"), 2).otherwise(0) + F.greatest(F.lit(0), 6 - F.col("n")) + F.least(F.lit(2), depth) + F.least(F.lit(3), F.size(name_words(F.col("name"))))
    out = j.filter(no("doctype") | no("topic")).withColumn("priority", score.cast("long"))
    return out.select("file_id", "rel_path", "priority", no("doctype").alias("no_doctype"), no("topic").alias("no_topic")).orderBy(F.desc("priority"), "rel_path").limit(most)


def repeats(files: DataFrame, least_folders: int = 2) -> DataFrame:
    """Names that, without marks of versions and copies, stand in several folders, and how many contents they have."""
    g = files.withColumn("stem", name_stem(F.col("name"))).groupBy("stem", "ext").agg(F.count("*").alias("files"), F.countDistinct("parent_rel").alias("folders"), F.countDistinct("asset_id").alias("contents"))
    return g.filter((F.col("files") >= 2) & (F.col("folders") >= least_folders))
