"""The facet algebra: OR within an axis, AND across axes; scopes, albums and colour rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from granary.functions.text import has_all_terms
from granary.plans.catalog import SIZE_BANDS, Catalog

#: Axes that select by the kind of a tag.
TAG_AXES = ("doctype", "topic", "author", "date", "pattern", "entity", "custom", "keyword")
PAGE = 120
DEFAULT_COLOUR = "#677686"


@dataclass
class FilterSpec:
    """What a caller asked for; empty parts ask for nothing."""

    type: str | None = None
    ext: str | None = None
    root: str | None = None
    size: str | None = None
    color: str | None = None
    tags: dict[str, list[str]] = field(default_factory=dict)
    any_tag: list[str] = field(default_factory=list)
    q: str | None = None
    cursor: int | None = None

    @classmethod
    def parse(cls, params: Mapping[str, Sequence[str] | str]) -> FilterSpec:
        """From request parameters: repeats and commas both give several values; a bad cursor is ignored."""
        values = {k: _values(v) for k, v in params.items()}
        first = lambda k: next(iter(values.get(k, [])), None)
        cursor = first("cursor")
        return cls(
            type=first("type"), ext=(first("ext") or "").lower().lstrip(".") or None, root=first("root"), size=first("size"), color=first("color"),
            tags={k: [x.lower() for x in values[k]] for k in TAG_AXES if values.get(k)},
            any_tag=[x.lower() for x in values.get("tag", [])], q=" ".join(values.get("q", [])) or None,
            cursor=int(cursor) if cursor and cursor.isdigit() else None,
        )

    def canonical(self) -> str:
        """One string for all equal filters: sorted keys and values, without the cursor."""
        pairs = [(k, v) for k in ("type", "ext", "root", "size", "color", "q") if (v := getattr(self, k))]
        pairs += [(k, v) for k, vs in self.tags.items() for v in set(vs)] + [("tag", v) for v in set(self.any_tag)]
        return "&".join(f"{quote(k)}={quote(str(v))}" for k, v in sorted(pairs))


def _values(v: Sequence[str] | str) -> list[str]:
    parts = [v] if isinstance(v, str) else list(v)
    return [x for p in parts for x in (y.strip() for y in p.split(",")) if x]


def label(spec: FilterSpec, display: Mapping[tuple[str, str], str] | None = None) -> str:
    """A filter in words, such as "Finance, Invoice, by Jane Doe"."""
    show = lambda k, n: (display or {}).get((k, n), n.replace("-", " ").title())
    parts = []
    for kind in ("topic", "doctype", "author", "entity", "pattern", "custom", "keyword", "date"):
        names = spec.tags.get(kind, [])
        if names:
            text = " or ".join(show(kind, n) for n in names)
            parts.append({"author": f"by {text}", "entity": f"mentioning {text}", "date": f"from {text}"}.get(kind, text))
    parts += [show("tag", n) for n in spec.any_tag]
    parts += [x for x in (spec.type, spec.ext and f".{spec.ext}", spec.size, spec.color) if x]
    if spec.q:
        parts.append(f'matching "{spec.q}"')
    return ", ".join(parts) or "Everything"


def terms(q: str) -> list[str]:
    """The terms of a free-text query; operators of the query language are no terms."""
    return re.findall(r"[\w']+", q)


def tagged(c: Catalog, names: Iterable[str], kind: str | None = None) -> DataFrame:
    """Ids of the contents that bear any of the names (of one kind)."""
    wanted = [n.strip().lower() for n in names if n.strip()]
    t = c.asset_tag.filter(F.lower("name").isin(wanted))
    return (t.filter(F.col("kind") == kind) if kind else t).select("asset_id").distinct()


def matching(c: Catalog, files: DataFrame, q: str) -> DataFrame:
    """Files whose name or a tag contains ``q``, or whose text holds all its terms: three indexes, one OR.

    Each index gives a set of ids that is semi-joined, so no file is counted twice. Texts are read only
    in a catalogue without a stored text index.
    """
    like = F.contains(F.lower("name"), F.lit(q.lower()))
    by_tag = c.asset_tag.filter(like).select("asset_id")
    index = getattr(c, "text_index", None)
    by_text = index.holding(terms(q)).select(F.col("key").alias("asset_id")) if index else c.text_block.filter(has_all_terms(F.col("body"), terms(q))).select("asset_id")
    content = by_tag.union(by_text).distinct().withColumn("_hit", F.lit(True))
    return files.join(content, "asset_id", "left").filter(like | F.col("_hit")).drop("_hit")


def selection(c: Catalog, spec: FilterSpec, base: DataFrame | None = None) -> DataFrame:
    """The indexed files that fulfil every part of ``spec``. Each axis is one semi-join: rows never multiply."""
    out = c.indexed if base is None else base
    for col, value in (("media_type", spec.type), ("ext", spec.ext), ("root", spec.root)):
        if value is not None:
            out = out.filter(F.col(col) == value)
    if spec.size in SIZE_BANDS:
        lo, hi = SIZE_BANDS[spec.size]
        out = out.filter((F.col("size_bytes") >= lo) & (F.col("size_bytes") < hi))
    if spec.color:
        out = out.join(c.color.filter((F.col("bucket") == spec.color) & (F.col("rank") <= 2)).select("asset_id"), "asset_id", "left_semi")
    for kind, names in spec.tags.items():
        out = out.join(tagged(c, names, kind), "asset_id", "left_semi")
    if spec.any_tag:
        out = out.join(tagged(c, spec.any_tag), "asset_id", "left_semi")
    return matching(c, out, spec.q) if spec.q else out


def matching_lens(files: DataFrame, lens: DataFrame, *, album: DataFrame | None = None, media_type: str | None = None, q: str | None = None, tags: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The visible files of a workspace that fulfil a query over its lens (file_id, kind, name).

    An album is a table of file ids (an empty one lets nothing through); ``q`` is part of the name in
    any case; names of one kind of tag are alternatives, and every kind that has names must hold.
    """
    out = files
    if album is not None:
        out = out.join(album.select("file_id").distinct(), "file_id", "left_semi")
    if media_type:
        out = out.filter(F.col("media_type") == media_type)
    if q:
        out = out.filter(F.contains(F.lower("name"), F.lit(q.lower())))
    for kind, names in (tags or {}).items():
        if names:
            out = out.join(lens.filter((F.col("kind") == kind) & F.col("name").isin(list(names))).select("file_id"), "file_id", "left_semi")
    return out


def not_ai(source: Column) -> Column:
    """Whether a text block is not a model's: ``_`` in the pattern stands for any character."""
    return ~source.like("ai_%")


def media_split(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pictures and videos, and all other files."""
    shown = F.col("media_type").isin("image", "video")
    return files.filter(shown), files.filter(~F.coalesce(shown, F.lit(False)))


def keyset_page(c: Catalog, spec: FilterSpec, size: int = PAGE) -> DataFrame:
    """Files after the cursor in id order, one more than a page so that the caller knows whether another follows."""
    out = selection(c, spec)
    if spec.cursor is not None:
        out = out.filter(F.col("file_id") > spec.cursor)
    return out.orderBy("file_id").limit(size + 1)


class Page(NamedTuple):
    """The files of a page, how many the whole selection has, and the cursor of the next page, if there is one."""

    items: list[Row]
    total: int
    next: int | None


def page(c: Catalog, spec: FilterSpec, columns: Sequence[str] = ("file_id", "name"), size: int = PAGE) -> Page:
    """A page with the total of its selection, from one pass: the rows are counted on their way to the page."""
    seen = Observation()
    out = selection(c, spec).observe(seen, F.count(F.lit(1)).alias("total"))
    if spec.cursor is not None:
        out = out.filter(F.col("file_id") > spec.cursor)
    rows = out.select("file_id", *[x for x in columns if x != "file_id"]).orderBy("file_id").limit(size + 1).collect()  # one page
    return Page(rows[:size], seen.get["total"], rows[size - 1]["file_id"] if len(rows) > size else None)


@dataclass
class Scope:
    """What a grant lets through; an empty scope lets everything through."""

    path_prefixes: list[str] = field(default_factory=list)
    include_tags: list[str] = field(default_factory=list)
    exclude_tags: list[str] = field(default_factory=list)
    media_types: list[str] = field(default_factory=list)


def in_scope(c: Catalog, files: DataFrame, scope: Scope) -> DataFrame:
    """Files under any prefix, of any media type, with any included tag, and with no excluded tag: exclusion wins.

    Only tags that the machine gave count; people's own tags cannot widen a grant.
    """
    machine = c.asset_tag.filter("source <> 'user'")
    out = files
    if scope.path_prefixes:
        out = out.filter(_any(F.startswith(F.col("rel_path"), F.lit(p)) for p in scope.path_prefixes))
    if scope.media_types:
        out = out.filter(F.col("media_type").isin(scope.media_types))
    if scope.include_tags:
        out = out.join(machine.filter(F.col("name").isin(scope.include_tags)).select("asset_id"), "asset_id", "left_semi")
    if scope.exclude_tags:
        out = out.join(machine.filter(F.col("name").isin(scope.exclude_tags)).select("asset_id"), "asset_id", "left_anti")
    return out


def describe_scope(scope: Scope) -> str:
    """A grant in words, such as "2 folders + 3 topics + image/video + excluding 1"."""
    n = len(scope.path_prefixes)
    parts = [f"{n} folder{'' if n == 1 else 's'}"] if n else []
    parts += [f"{len(scope.include_tags)} topics"] if scope.include_tags else []
    parts += ["/".join(scope.media_types)] if scope.media_types else []
    parts += [f"excluding {len(scope.exclude_tags)}"] if scope.exclude_tags else []
    return " + ".join(parts) or "the whole library"


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for x in conditions:
        out = out | x
    return out


@dataclass
class ColourRule:
    """One predicate and its colour; of several rules the first that is enabled and true wins."""

    by: str  # tag, kind, path, media, ext, name or untagged
    value: str
    colour: str
    enabled: bool = True

    def test(self) -> Column:
        v = self.value
        return {
            "tag": lambda: F.exists("tags", lambda t: t["name"] == v), "kind": lambda: F.exists("tags", lambda t: t["kind"] == v), "path": lambda: F.startswith(F.col("rel_path"), F.lit(v)),
            "media": lambda: F.col("media_type") == v, "ext": lambda: F.lower("ext") == v.lower().lstrip("."), "name": lambda: F.contains(F.lower("name"), F.lit(v.lower())), "untagged": lambda: F.size("tags") == 0,
        }[self.by]()

    def describe(self) -> str:
        """The rule in words."""
        return {"kind": f"any {self.value}", "path": f"path:{self.value}", "media": f"type:{self.value}", "ext": f"ext:{self.value}", "name": f'name contains "{self.value}"', "untagged": "untagged"}.get(self.by, self.value)

    @classmethod
    def parse(cls, text: str) -> ColourRule:
        """From shorthand such as ``ext:pdf=#ff0000`` or ``untagged=#ccc``."""
        query, _, colour = text.rpartition("=")
        by, _, value = query.partition(":")
        return cls(by.strip(), value.strip(), colour.strip())


def coloured(c: Catalog, files: DataFrame, rules: Sequence[ColourRule], default: str = DEFAULT_COLOUR) -> DataFrame:
    """Files with the colour of their first matching rule."""
    tags = c.asset_tag.groupBy("asset_id").agg(F.collect_list(F.struct("kind", "name")).alias("tags"))
    out = files.join(tags, "asset_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<kind:string,name:string>>")))
    colour = F
    for r in rules:
        if r.enabled:
            colour = colour.when(r.test(), r.colour)
    return out.withColumn("colour", F.lit(default) if colour is F else colour.otherwise(default)).drop("tags")


def used_rules(coloured_files: DataFrame, rules: Sequence[ColourRule]) -> list[ColourRule]:
    """The enabled rules whose colour some file has; only the colours of the rules reach the driver."""
    own = [r.colour for r in rules if r.enabled]
    present = {r["colour"] for r in coloured_files.filter(F.col("colour").isin(own)).select("colour").distinct().collect()}
    return [r for r in rules if r.enabled and r.colour in present]
