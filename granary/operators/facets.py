"""Counts for the filter rail, and the details of single contents."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.catalog import Catalog, band, duplicate_groups, tag_facet_view

#: How many tags of a kind are shown.
TOP, TOP_OTHER = 40, 16
WIDE_KINDS = ("doctype", "topic", "author", "date", "custom")


def facet_rail(c: Catalog) -> DataFrame:
    """The most frequent tags of each kind over all indexed files."""
    n = tag_facet_view(c)
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    limit = F.when(F.col("kind").isin(*WIDE_KINDS), TOP).otherwise(TOP_OTHER)
    return n.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def conditioned(c: Catalog, files: DataFrame, tags: DataFrame | None = None, top: int = 16) -> DataFrame:
    """The most frequent tags of each kind among given files, counted per file."""
    t = (tags if tags is not None else c.asset_tag).select("asset_id", "kind", "name").distinct()
    n = files.select("file_id", "asset_id").join(t, "asset_id").groupBy("kind", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    return n.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def media_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("media_type").agg(F.count("*").alias("n"))


def colour_counts(c: Catalog) -> DataFrame:
    """Contents by the bucket of one of their first three colours, with the strongest colour as swatch."""
    t = c.color.filter("rank <= 2")
    best = F.max_by("hex", F.struct("proportion", "hex")).alias("swatch")
    return t.groupBy("bucket").agg(F.countDistinct("asset_id").alias("n"), best)


def size_bands(files: DataFrame) -> DataFrame:
    return files.groupBy(band().alias("band")).agg(F.count("*").alias("n"), F.min("size_bytes").alias("least"))


def unclassified(c: Catalog) -> DataFrame:
    """How many indexed files have no topic."""
    topics = c.asset_tag.filter("kind = 'topic'").select("asset_id")
    return c.indexed.join(topics, "asset_id", "left_anti").agg(F.count("*").alias("n"))


def reclaimable(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("bytes"))


def tint(c: Catalog, files: DataFrame) -> DataFrame:
    """Files with the first colour of their content and how many files hold it."""
    top = c.color.groupBy("asset_id").agg(F.min_by("hex", "rank").alias("tint"))
    copies = c.file.groupBy("asset_id").agg(F.count("*").alias("copies"))
    return files.join(top, "asset_id", "left").join(copies, "asset_id", "left")


def detail_tags(c: Catalog, most: int = 60) -> DataFrame:
    """Tags of each content with their best confidence, whether a person gave them, and their sources."""
    g = c.asset_tag.groupBy("asset_id", "kind", "name").agg(F.max("confidence").alias("confidence"), F.bool_or(F.col("source") == "user").alias("by_user"), F.listagg(F.col("source"), F.lit(",")).alias("sources"))
    w = Window.partitionBy("asset_id").orderBy(F.desc("by_user"), F.desc("confidence"), "kind", "name")
    return g.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")


def per_content(files: DataFrame, events: DataFrame | None = None, most: int | None = 400) -> DataFrame:
    """One row for each content of a selection: its least name and path, latest events first; ``most`` (or no bound) rows."""
    g = files.groupBy("asset_id").agg(F.min("name").alias("name"), F.min("rel_path").alias("rel_path"), F.min("media_type").alias("media_type"), F.min("size_bytes").alias("size_bytes"), F.count("*").alias("copies"))
    if events is not None:
        g = g.join(events.select("asset_id", "event_at"), "asset_id", "left")
    else:
        g = g.withColumn("event_at", F.lit(None).cast("long"))
    g = g.orderBy(F.desc_nulls_last("event_at"), "name", "asset_id")
    return g if most is None else g.limit(most)


def workspace_summary(c: Catalog, files: DataFrame) -> DataFrame:
    tags = files.select("asset_id").distinct().join(c.asset_tag, "asset_id").agg(F.countDistinct("kind", "name").alias("tags"))
    return files.agg(F.count("*").alias("files"), F.countDistinct("asset_id").alias("contents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.countDistinct("root").alias("libraries")).crossJoin(F.broadcast(tags))


def libraries(c: Catalog) -> DataFrame:
    """Each root with its files by state."""
    s = F.col("state")
    return c.file.groupBy("root").agg(F.count("*").alias("files"), F.count_if(s == "indexed").alias("indexed"), F.count_if(s == "missing").alias("missing"), F.count_if(s == "error").alias("failed"), F.sum(F.when(s == "indexed", F.col("size_bytes")).otherwise(0)).alias("bytes"))


def library_totals(c: Catalog) -> DataFrame:
    """(root, files, contents, bytes, tags): what each library holds; tags count once, people's own too."""
    f = c.file.groupBy("root").agg(F.count("*").alias("files"), F.countDistinct("asset_id").alias("contents"), F.sum("size_bytes").alias("bytes"))
    t = c.file.select("root", "asset_id").distinct().join(c.asset_tag.select("asset_id", "kind", "name").distinct(), "asset_id").groupBy("root").agg(F.countDistinct("kind", "name").alias("tags"))
    return f.join(t, "root", "left").withColumn("tags", F.coalesce("tags", F.lit(0)))


def status(c: Catalog, audit: DataFrame) -> DataFrame:
    """One row: files by state and contents by media type as maps, contents, duplicates, and files that changed while they were read."""
    by = lambda df, k: df.groupBy(k).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(f"by_{k}"))
    parts = [
        by(c.file, "state"), by(c.asset, "media_type"), c.asset.agg(F.count("*").alias("assets")), reclaimable(duplicate_groups(c)).select(F.col("groups").alias("duplicate_groups"), F.col("bytes").alias("reclaimable_bytes")),
        audit.agg(F.count_if(F.col("verdict") == "mutated").alias("mutations")), unclassified(c).select(F.col("n").alias("unclassified")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def gaps(c: Catalog, tags: DataFrame | None = None) -> DataFrame:
    """Indexed files without doctype, without topic, and with either gap."""
    t = (c.asset_tag if tags is None else tags).filter("kind IN ('doctype', 'topic')").groupBy("asset_id").agg(F.collect_set("kind").alias("kinds"))
    f = c.indexed.join(t, "asset_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    no = lambda k: ~F.array_contains("kinds", k)
    return f.agg(F.count_if(no("doctype")).alias("no_doctype"), F.count_if(no("topic")).alias("no_topic"), F.count_if(no("doctype") | no("topic")).alias("gaps"))


#: How much of a content's texts its details show.
MOST_TEXTS, TEXT_CHARS = 8, 1200


def details(c: Catalog, metas: Mapping[str, DataFrame] | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Everything that is shown of each content, one row each.

    Colours by rank, up to 60 tags (those of people first), the first texts, extractor runs, the
    paths of indexed copies, and one struct for each metadata table (asset_id, …) in ``metas``. What a content lacks is null.
    """
    ordered = lambda *cols: F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda x: x)
    colours = c.color.groupBy("asset_id").agg(ordered("rank", "hex", "bucket", "proportion").alias("colours"))
    tags = detail_tags(c).withColumn("order", F.struct((~F.col("by_user")).alias("own"), (-F.col("confidence")).alias("less"), "kind", "name"))
    tags = tags.groupBy("asset_id").agg(ordered("order", "kind", "name", "confidence", "by_user", "sources").alias("tags"))
    w = Window.partitionBy("asset_id").orderBy("source", "ord")
    texts = c.text_block.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= MOST_TEXTS)
    texts = texts.groupBy("asset_id").agg(ordered("k", "source", "ord", F.substring("body", 1, TEXT_CHARS).alias("body")).alias("texts"))
    copies = c.indexed.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("rel_path", "root"))).alias("copies"))
    parts = [colours, tags, texts, copies]
    if runs is not None:
        parts.append(runs.groupBy("asset_id").agg(ordered("extractor", "version", "status").alias("runs")))
    for name, meta in (metas or {}).items():
        parts.append(meta.select("asset_id", F.struct(*[x for x in meta.columns if x != "asset_id"]).alias(name)))
    return reduce(lambda a, b: a.join(b, "asset_id", "left"), parts, c.asset)
