"""The registry of extractors, and running those whose work is out of date."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import classify, text
from granary.operators import reconcile
from granary.session import materialize
from granary.sources import media, readers


@dataclass(frozen=True)
class Extractor:
    """A table function over contents. ``run`` takes pending contents (asset_id, …) and returns
    rows with asset_id and, where a content failed, a non-null ``error``. Without ``run`` its library is missing."""

    name: str
    media_types: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame] | None = None
    version: int = 1
    tier: str = "cheap"
    order: int = 0


def _needs(*columns: str):
    """Note the columns that a run reads; where the contents come without them it is skipped and stays pending."""

    def wrap(run):
        run.needs = frozenset(columns)
        return run

    return wrap


def _rows(df: DataFrame, *extensions: str) -> DataFrame:
    return df.filter(F.lower("ext").isin(*extensions)).select(F.col("name").alias("path"), "asset_id", F.lower("ext").alias("ext"), "content")


def _errors(got: DataFrame) -> DataFrame:
    return got.withColumn("error", F.when(F.col("status") != "ok", F.col("status"))).drop("status", "path")


@_needs("name", "ext", "content")
def doc_text(df: DataFrame) -> DataFrame:
    """(asset_id, source, ord, body) of text files."""
    return readers.plain_text_of(_rows(df, *readers.TEXTS)).select("asset_id", F.lit("doc_text").alias("source"), F.lit(0).alias("ord"), "body")


def _office(ext: str):
    @_needs("name", "ext", "content")
    def run(df: DataFrame) -> DataFrame:
        return _errors(readers.office_text_of(_rows(df, ext))).withColumn("source", F.lit(f"doc_{ext}"))

    return run


@_needs("text_block")
def keywords_of(df: DataFrame) -> DataFrame:
    """Keywords of the texts of contents (column text_block)."""
    return text.keywords(df.filter("text_block IS NOT NULL").select("asset_id", F.col("text_block").alias("body")))


@_needs("name", "ext", "content")
def image_exif(df: DataFrame) -> DataFrame:
    return _errors(media.photos_of(_rows(df, "jpg", "jpeg")))


@_needs("name", "ext", "content")
def image_color(df: DataFrame) -> DataFrame:
    return _errors(media.pictures_of(_rows(df, "png")))


@_needs("name", "ext", "content")
def audio_tags(df: DataFrame) -> DataFrame:
    return _errors(media.audio_tags_of(_rows(df, "mp3")))


@_needs("name", "ext", "media_type", "text_block")
def agent_inspect(df: DataFrame) -> DataFrame:
    """Verdicts over the texts of contents (column text_block)."""
    none = F.lit(None).cast("long")
    docs = df.select("asset_id", "name", "ext", "media_type", F.coalesce("text_block", F.lit("")).alias("text"), F.create_map().cast("map<string,string>").alias("meta"), none.alias("captured_at"), none.alias("created_at"), none.alias("modified_at"))
    return classify.inspect(docs, key="asset_id").drop("hits")


ALL = ("image", "video", "audio", "document", "other")
#: The known extractors; those that need libraries or models which are not here have no ``run`` and are skipped.
KNOWN = (
    Extractor("doc.text", ("document",), doc_text), Extractor("doc.pdf", ("document",)), Extractor("doc.docx", ("document",), _office("docx")), Extractor("doc.pptx", ("document",), _office("pptx")), Extractor("doc.pdf_ocr", ("document",), tier="ml"),
    Extractor("text.keywords", ("document", "image", "audio", "video"), keywords_of, order=50), Extractor("image.exif", ("image",), image_exif), Extractor("image.color", ("image",), image_color), Extractor("image.thumb", ("image",)), Extractor("image.ocr", ("image",), tier="ml"),
    Extractor("video.probe", ("video",)), Extractor("video.thumb", ("video",)), Extractor("audio.tags", ("audio",), audio_tags), Extractor("agent.inspect", ALL, agent_inspect, order=60), Extractor("agent.classify", ("document", "image"), tier="ml", order=60),
    Extractor("ai.vision", ("image",), tier="ml"), Extractor("ai.document", ("document",), tier="ml"),
)


def registry(runs: Mapping[str, Callable[[DataFrame], DataFrame]], known: tuple[Extractor, ...] = KNOWN) -> list[Extractor]:
    """The known extractors, with the given functions in place of their own, in order of tier, place and name."""
    out = [Extractor(e.name, e.media_types, runs.get(e.name, e.run), e.version, e.tier, e.order) for e in known]
    return sorted(out, key=lambda e: (("cheap", "ml").index(e.tier), e.order, e.name))


def pending(assets: DataFrame, ledger: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """(asset_id, extractor, version) still to do."""
    v = assets.sparkSession.createDataFrame([(e.name, e.version, list(e.media_types)) for e in extractors], "extractor string, version int, media_types array<string>")
    return reconcile.backlog(assets, ledger, v)


def run_all(assets: DataFrame, ledger: DataFrame, extractors: list[Extractor], *, tier: str | None = None, budget: int | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows by extractor, and the ledger entries of this run: ok, unsupported, error or skipped.

    ``budget`` limits how many contents each extractor of the ml tier is asked for: it is a spending cap, and
    what it leaves stays pending.
    """
    todo = pending(assets, ledger, extractors)
    rows, entries = {}, []
    for e in extractors:
        if tier and e.tier != tier:
            continue
        mine = assets.join(todo.filter(F.col("extractor") == e.name).select("asset_id"), "asset_id", "left_semi")
        entry = lambda status, e=e: [F.lit(e.name).alias("extractor"), F.lit(e.version).alias("version"), status.alias("status")]
        if e.run is None or not getattr(e.run, "needs", frozenset()) <= set(assets.columns):
            entries.append(mine.select("asset_id", *entry(F.lit("skipped"))))
            continue
        if e.tier == "ml" and budget is not None:
            mine = mine.orderBy("asset_id").limit(budget)
        got = rows[e.name] = materialize(e.run(mine), f"rows-{e.name.replace('.', '-')}")  # read by the caller and for the ledger
        error = F.max(F.col("error")) if "error" in got.columns else F.max(F.lit(None).cast("string"))
        done = got.groupBy("asset_id").agg(error.alias("_error")).withColumn("_done", F.lit(True))
        status = F.when(F.col("_error").isNotNull(), "error").when(F.col("_done"), "ok").otherwise("unsupported")
        entries.append(mine.select("asset_id").join(done, "asset_id", "left").select("asset_id", *entry(status)))
    return rows, reduce(DataFrame.unionByName, entries)
