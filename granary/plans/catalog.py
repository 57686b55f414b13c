"""The catalogue: table schemas, views, and a projection of the shipped tables onto them.

Content is identified by a hash of its bytes (``asset``); a ``file`` is a path that holds it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.text_index import TextIndex
from granary.session import materialize, scratch, stamp, table

#: Schemas of the stored tables, declared and never inferred.
SCHEMAS = {
    "root": "id long, path string, label string, enabled boolean, added_at long",
    "scan_run": "id long, root_id long, kind string, status string, started_at long, files_seen long",
    "asset": "asset_id string, size_bytes long, mime string, media_type string, pipeline_state string",
    "file": "file_id long, root string, rel_path string, parent_rel string, name string, ext string, size_bytes long, mtime_ns long, asset_id string, state string, attempts int, priority int, last_scan_id long",
    "extractor_run": "asset_id string, extractor string, version int, status string, duration_ms long",
    "tag": "kind string, name string, display string",
    "asset_tag": "asset_id string, kind string, name string, source string, confidence double, instances int",
    "text_block": "asset_id string, source string, ord int, body string",
    "color": "asset_id string, rank int, hex string, proportion double, bucket string",
    "finding": "asset_id string, doctype string, topic string, author string, topic_score double, event_at long, patterns array<string>, money map<string, struct<count: long, max: double, sum: double>>, decided_by string, escalated boolean",
    "brief": "query string, produced_by string, title string, body string, created_at long",
    "integrity_audit": "root string, rel_path string, verdict string, at long",
}

#: Bounds of the size bands in bytes, half open.
SIZE_BANDS = {
    "tiny": (0, 100 * 1024),
    "small": (100 * 1024, 2 * 1024**2),
    "medium": (2 * 1024**2, 50 * 1024**2),
    "large": (50 * 1024**2, 500 * 1024**2),
    "huge": (500 * 1024**2, 1 << 62),
}


@dataclass
class Catalog:
    """The tables that queries read, as DataFrames."""

    file: DataFrame
    asset: DataFrame
    asset_tag: DataFrame
    text_block: DataFrame
    color: DataFrame
    #: The stored index over ``text_block``, if there is one; searches without it scan the texts.
    text_index: TextIndex | None = None

    @property
    def indexed(self) -> DataFrame:
        return self.file.filter("state = 'indexed'")

    def register(self, prefix: str = "") -> None:
        """Name the tables and the stored views for SQL."""
        for n in ("file", "asset", "asset_tag", "text_block", "color"):
            getattr(self, n).createOrReplaceTempView(f"{prefix}{n}")
        for n, f in (("v_library", library), ("v_tag_facet", tag_facet_view), ("v_state_counts", state_counts), ("v_duplicate_group", duplicate_groups)):
            f(self).createOrReplaceTempView(f"{prefix}{n}")


#: What the library view takes of each metadata table of contents.
METAS = {"image_meta": ("width", "height", "captured_at"), "video_meta": ("width", "height", "captured_at", "duration_s"), "audio_meta": ("duration_s",), "doc_meta": ("page_count",), "geo": ("lat", "lon", "locality", "country_code"), "thumbnail": ("cache_key",)}


def library(c: Catalog, roots: DataFrame | None = None, metas: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Files with their root, their content and its metadata; metadata tables join one to one and never add rows.

    ``roots`` (root, label) is an inner join; ``metas`` has tables by the names in METAS, and of
    thumbnails only those of the grid count. Columns of tables that are not given are null.
    """
    a = c.asset.select("asset_id", "mime", "media_type", "pipeline_state")
    out = c.file.drop("media_type").join(a, "asset_id", "left")
    if roots is not None:
        out = out.join(roots, "root")
    for name, cols in METAS.items():
        t = (metas or {}).get(name)
        if t is None:
            out = out.withColumns({f"_{name}_{x}": F.lit(None) for x in cols})
        else:
            t = t.filter("kind = 'grid'") if name == "thumbnail" else t
            out = out.join(t.select("asset_id", *[F.col(x).alias(f"_{name}_{x}") for x in cols]), "asset_id", "left")
    first = lambda col, *tables: F.coalesce(*[F.col(f"_{t}_{col}") for t in tables]).alias(col)
    kept = [x for x in out.columns if not x.startswith("_")]
    return out.select(
        *kept, *[first(x, "image_meta", "video_meta") for x in ("width", "height", "captured_at")], first("duration_s", "video_meta", "audio_meta"), first("page_count", "doc_meta"), F.col("_thumbnail_cache_key").alias("thumb_key"), *[first(x, "geo") for x in METAS["geo"]]
    )


def tag_facet_view(c: Catalog) -> DataFrame:
    """Contents per tag, counted over indexed files."""
    live = c.indexed.select("asset_id").distinct()
    return c.asset_tag.join(live, "asset_id", "left_semi").groupBy("kind", "name").agg(F.countDistinct("asset_id").alias("n"))


def state_counts(c: Catalog) -> DataFrame:
    return c.file.groupBy("state").agg(F.count("*").alias("n"))


def duplicate_groups(c: Catalog) -> DataFrame:
    """Contents that several indexed files hold, and the bytes that all but the smallest copy take."""
    g = c.indexed.groupBy("asset_id").agg(F.count("*").alias("copies"), F.sum("size_bytes").alias("total"), F.min("size_bytes").alias("least"))
    return g.filter("copies > 1").select("asset_id", "copies", (F.col("total") - F.col("least")).alias("reclaimable"))


def band(size: str = "size_bytes"):
    """The name of the size band of a column."""
    out = F
    for name, (lo, hi) in SIZE_BANDS.items():
        out = out.when((F.col(size) >= lo) & (F.col(size) < hi), name)
    return out


class Projected(Catalog):
    """A catalogue over ``documents`` and ``labels``: one file per row, one content per text.

    Every table is projected when it is first read, written once for a session and folder, and
    read from there by all later queries, so the texts are hashed and searched once and not in
    every branch of every plan. Input tables that are rewritten are projected anew by the next catalogue of the folder.
    """

    _written: dict[tuple, DataFrame | TextIndex] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._of = (spark.sparkContext.applicationId, sf_dir, *[stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")])

    def _once(self, name: str, make) -> DataFrame:
        key = (*self._of, name)
        if key not in self._written:
            self._written[key] = materialize(make(), f"catalog-{name}")
        return self._written[key]

    @property
    def _base(self) -> DataFrame:
        """The rows of documents without texts, and what is read off the texts."""

        def make():
            d = table(self.spark, self.sf_dir, "documents", spread=True)
            return d.select(
                "doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("asset_id"), (F.regexp_count("text", F.lit("https?://")) > 0).alias("url"), (F.regexp_count("text", F.lit("[a-z0-9]+@[a-z0-9]+\\.[a-z]+")) > 0).alias("mail")
            )

        return self._once("base", make)

    @property
    def file(self) -> DataFrame:
        d = self._base
        ext = F.get(F.array(*[F.lit(x) for x in ("txt", "pdf", "docx", "md", "jpg", "mp3")]), (F.col("doc_id") % 6).cast("int"))
        scale = F.get(F.array(F.lit(1), F.lit(64), F.lit(4096)), (F.col("doc_id") % 3).cast("int"))
        media = F.when(F.col("doc_id") % 6 == 4, "image").when(F.col("doc_id") % 6 == 5, "audio").otherwise("document")
        state = F.when(F.col("doc_id") % 13 == 0, "missing").when(F.col("doc_id") % 17 == 0, "error").when(F.col("doc_id") % 19 == 0, "queued").otherwise("indexed")
        name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("ext"))
        return d.withColumn("ext", ext).select(
            F.col("doc_id").alias("file_id"), F.col("source").alias("root"), F.concat_ws("/", "source", "lang", name).alias("rel_path"), F.concat_ws("/", "source", "lang").alias("parent_rel"), name.alias("name"), "ext", (F.col("n_chars") * scale).alias("size_bytes"), ((F.lit(1_700_000_000) + F.col("doc_id") * 3600) * 1_000_000_000).alias("mtime_ns"), "asset_id", media.alias("media_type"), state.alias("state")
        )

    @property
    def asset(self) -> DataFrame:
        return self._once("asset", lambda: self.file.groupBy("asset_id").agg(F.min("size_bytes").alias("size_bytes"), F.min("media_type").alias("media_type")).withColumns({"mime": F.lit(None).cast("string"), "pipeline_state": F.lit("complete")}))

    @property
    def asset_tag(self) -> DataFrame:
        def make():
            d = self._base
            t = lambda k, n: F.struct(F.lit(k).alias("kind"), n.cast("string").alias("name"))
            tags = d.select(
                "asset_id",
                F.explode(
                    F.array(
                        t("doctype", F.col("lang")), t("topic", F.concat(F.lit("topic"), (F.col("n_chars") % 12).cast("string"))), t("author", F.concat(F.lit("author"), (F.col("n_chars") % 9).cast("string"))), t("date", 2010 + F.col("n_chars") % 8), t("entity", F.col("source")),
                        t("pattern", F.when(F.col("url"), F.lit("url"))), t("pattern", F.when(F.col("mail"), F.lit("email-address"))),
                    )
                ).alias("t"),
            ).select("asset_id", "t.kind", "t.name", F.lit("agent").alias("source"))
            toxic = table(self.spark, self.sf_dir, "labels").filter("toxic = 1").select("doc_id")
            custom = d.join(toxic, "doc_id", "left_semi").select("asset_id", F.lit("custom").alias("kind"), F.lit("toxic").alias("name"), F.lit("user").alias("source"))
            return tags.filter("name IS NOT NULL").unionByName(custom).distinct().withColumn("confidence", F.when(F.col("source") == "user", 1.0).otherwise(0.7))

        return self._once("asset_tag", make)

    @property
    def _texts(self) -> DataFrame:
        """The text of each row of documents under the id of its content; copies are not taken out."""
        return table(self.spark, self.sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("asset_id"), F.col("text").alias("body"))

    @property
    def text_block(self) -> DataFrame:
        def make():
            return self._texts.select("asset_id", F.lit("text").alias("source"), F.lit(0).alias("ord"), "body").repartition(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), "asset_id").dropDuplicates(["asset_id"])

        return self._once("text_block", make)

    @property
    def text_index(self) -> TextIndex:
        key = (*self._of, "text_index")
        if key not in self._written:
            index = TextIndex(self.spark, scratch(self.spark, "catalog-text-index"))
            index.add(self._texts, copies=True)  # not from text_block, which would be written and shuffled for it
            self._written[key] = index
        return self._written[key]

    @property
    def color(self) -> DataFrame:
        def make():
            shade = F.get(F.array(*[F.lit(x) for x in ("red", "orange", "yellow", "green", "teal", "blue", "purple", "black")]), (F.conv(F.substring("hex", 1, 1), 16, 10).cast("int") / 2).cast("int"))
            share = F.get(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.15), F.lit(0.05)), F.col("rank"))
            each = self._base.select("asset_id").distinct().select("asset_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank"))
            return each.withColumn("hex", F.expr("substring(asset_id, 1 + 6 * rank, 6)")).select("asset_id", "rank", "hex", share.alias("proportion"), shade.alias("bucket"))

        return self._once("color", make)


def from_documents(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue over the shipped tables of a folder."""
    return Projected(spark, sf_dir)


#: The same projection as common table expressions for the SQL that the results are compared with.
SQL = """
file AS (
  SELECT doc_id AS file_id, source AS root, source || '/' || lang || '/' || name0 AS rel_path, source || '/' || lang AS parent_rel,
         name0 AS name, ext, n_chars * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 64 ELSE 4096 END) AS size_bytes,
         (1700000000 + doc_id * 3600) * 1000000000 AS mtime_ns, md5(text) AS asset_id,
         CASE doc_id % 6 WHEN 4 THEN 'image' WHEN 5 THEN 'audio' ELSE 'document' END AS media_type,
         CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 19 = 0 THEN 'queued' ELSE 'indexed' END AS state
  FROM (SELECT *, 'doc_' || doc_id || '.' || ext AS name0 FROM (SELECT *, ['txt','pdf','docx','md','jpg','mp3'][1 + doc_id % 6] AS ext FROM documents))
), indexed AS (SELECT * FROM file WHERE state = 'indexed'
), asset_tag AS (
  SELECT DISTINCT md5(text) AS asset_id, kind, name, source, CASE WHEN source = 'user' THEN 1.0 ELSE 0.7 END AS confidence FROM (
    SELECT text, 'doctype' AS kind, lang AS name, 'agent' AS source FROM documents
    UNION ALL SELECT text, 'topic', 'topic' || (n_chars % 12), 'agent' FROM documents
    UNION ALL SELECT text, 'author', 'author' || (n_chars % 9), 'agent' FROM documents
    UNION ALL SELECT text, 'date', CAST(2010 + n_chars % 8 AS VARCHAR), 'agent' FROM documents
    UNION ALL SELECT text, 'entity', source, 'agent' FROM documents
    UNION ALL SELECT text, 'pattern', 'url', 'agent' FROM documents WHERE regexp_matches(text, 'https?://')
    UNION ALL SELECT text, 'pattern', 'email-address', 'agent' FROM documents WHERE regexp_matches(text, '[a-z0-9]+@[a-z0-9]+\\.[a-z]+')
    UNION ALL SELECT text, 'custom', 'toxic', 'user' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  )
), text_block AS (SELECT DISTINCT md5(text) AS asset_id, 'text' AS source, 0 AS ord, text AS body FROM documents
), color AS (
  SELECT asset_id, rank, substr(asset_id, 1 + 6 * rank, 6) AS hex, [0.5, 0.3, 0.15, 0.05][1 + rank] AS proportion,
         ['red','orange','yellow','green','teal','blue','purple','black'][1 + CAST(('0x' || substr(asset_id, 1 + 6 * rank, 1)) AS INT) // 2] AS bucket
  FROM (SELECT DISTINCT md5(text) AS asset_id FROM documents), (SELECT unnest([0, 1, 2, 3]) AS rank)
)
"""
