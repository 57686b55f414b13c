"""What a workspace sees: grants with scopes, people's own tags, and its corrections laid over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Caps of one overlay.
MOST_REMOVALS, MOST_ADDITIONS, MOST_ALBUMS, MOST_IN_ALBUM = 400, 200, 20, 250
LEVELS = ("viewer", "editor", "owner")


def effective(members: DataFrame, grants: DataFrame) -> DataFrame:
    """(user, workspace, level): the lesser of a member's role and the workspace's best grant; no membership, no row."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(c))
    best = grants.groupBy("workspace_id").agg(F.max(rank("access")).alias("best"))
    level = F.least(rank("role"), F.col("best")).cast("int")
    return members.join(best, "workspace_id").select("user_id", "workspace_id", F.get(F.array(*[F.lit(x) for x in LEVELS]), level - 1).alias("level"))


def visible(files: DataFrame, tags: DataFrame, grants: DataFrame) -> DataFrame:
    """Files that any grant of a workspace shows, each once.

    files(file_id, library_id, rel_path, media_type), tags(file_id, name) by the machine, and
    grants(workspace_id, library_id, path_prefixes, include_tags, exclude_tags, media_types) with
    arrays; an empty array restricts nothing and an excluded tag wins.
    """
    # no file meets a grant but by a prefix of its path: of each file as many prefixes are looked up as
    # the grants of its library have lengths, however many grants there are
    free = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    parts = ["path_prefixes", "include_tags", "exclude_tags", "media_types"]
    g = grants.dropDuplicates(["workspace_id", "library_id", *parts]).withColumn("_g", F.sha2(F.to_json(F.struct("workspace_id", "library_id", *parts), {"ignoreNullFields": "false"}), 256))
    looked = g.select("_g", "workspace_id", "library_id", "media_types", (~free("include_tags")).alias("_some"), F.explode(F.when(free("path_prefixes"), F.array(F.lit(""))).otherwise(F.col("path_prefixes"))).alias("_prefix"))
    lengths = looked.groupBy("library_id").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    path = F.coalesce("rel_path", F.lit(""))
    f = files.join(lengths, "library_id").select("file_id", "library_id", "media_type", path.alias("_path"), F.explode(F.filter("_lengths", lambda n: n <= F.length(path))).alias("_n"))
    f = f.withColumn("_prefix", F.left("_path", F.col("_n"))).drop("_path", "_n")
    met = f.join(looked, ["library_id", "_prefix"]).filter(free("media_types") | F.array_contains("media_types", F.col("media_type"))).select("file_id", "_g", "workspace_id", "_some").distinct()
    named = met.join(tags.select("file_id", "name").distinct(), "file_id")
    each = lambda c: g.select("_g", F.explode(c).alias("name"))
    gone = named.join(each("exclude_tags"), ["_g", "name"], "left_semi").select("file_id", "_g")
    held = met.filter("NOT _some").select("file_id", "_g", "workspace_id").unionByName(named.filter("_some").join(each("include_tags"), ["_g", "name"], "left_semi").select("file_id", "_g", "workspace_id"))
    shown = held.join(gone, ["file_id", "_g"], "left_anti").select("workspace_id", "file_id").distinct()
    return shown.join(files, "file_id").select("workspace_id", *files.columns)


def lens(machine: DataFrame, own: DataFrame, additions: DataFrame, removals: DataFrame) -> DataFrame:
    """Distinct (file_id, tag): machine tags, the workspace's own and accepted ones, without those it removed."""
    key = ["file_id", "tag"]
    return machine.select(*key).unionByName(own.select(*key)).unionByName(additions.select(*key)).distinct().join(removals.select(*key), key, "left_anti")


def accept(additions: DataFrame, removals: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepting a suggestion adds it and clears an earlier removal of the same tag."""
    key = ["file_id", "tag"]
    return additions.select(*key).unionByName(accepted.select(*key)).distinct(), removals.join(accepted.select(*key), key, "left_anti")


def remove(additions: DataFrame, removals: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removing a tag drops an addition of it and remembers the removal."""
    key = ["file_id", "tag"]
    return additions.join(gone.select(*key), key, "left_anti"), removals.select(*key).unionByName(gone.select(*key)).distinct()


def album(files: DataFrame, albums: DataFrame, name: str) -> DataFrame:
    """The files of an album; an unknown album is empty."""
    return files.join(albums.filter(F.col("album") == name).select(F.explode("file_ids").alias("file_id")).distinct(), "file_id", "left_semi")


def decode_overlay(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """An overlay from its wire form ``version|r!file-tag!…|t!file-tag!…|a!name!file!…`` with ids in base 36."""
    parts = [p.split("!") for p in text.split("|")[1:]]
    pair = lambda k: [tuple(int(x, 36) for x in v.lstrip("f").split("-")) for p in parts if p[0] == k for v in p[1:] if v]
    albums = [(p[1], [int(x, 36) for x in p[2:] if x][:MOST_IN_ALBUM]) for p in parts if p[0] == "a" and len(p) > 1][:MOST_ALBUMS]
    return {"removals": spark.createDataFrame(pair("r")[:MOST_REMOVALS], "file_id long, tag long"), "additions": spark.createDataFrame(pair("t")[:MOST_ADDITIONS], "file_id long, tag long"), "albums": spark.createDataFrame(albums, "album string, file_ids array<long>")}


def encode_overlay(removals, additions, albums, version: int = 1) -> str:
    """The wire form of rows collected from an overlay (its caps bound them)."""
    def b36(n: int) -> str:
        digits = ""
        while True:
            n, r = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
            if not n:
                return digits

    out = [str(version)]
    for k, rows in (("r", removals[:MOST_REMOVALS]), ("t", additions[:MOST_ADDITIONS])):
        if rows:
            out.append("!".join([k, *[f"f{b36(a)}-{b36(b)}" for a, b in rows]]))
    out += ["!".join(["a", name, *[b36(i) for i in ids[:MOST_IN_ALBUM]]]) for name, ids in albums[:MOST_ALBUMS]]
    return "|".join(out)


#: The version of the wire form, the parts of an overlay, and the name of an album without one.
WIRE_VERSION, UNNAMED = "1", "Untitled album"


def _unescaped(c: Column) -> Column:
    """A percent-encoded text, or the text itself where an escape is broken; a plus sign is no blank."""
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(out, F.lit("\ufffd")), c).otherwise(F.coalesce(out, c))


def decode_overlays(overlays: DataFrame, *, key: str = "workspace_id", wire: str = "wire", escaped: bool = True) -> dict[str, DataFrame]:
    """The overlays of many workspaces, one a row, as tables: removals, additions and albums.

    The wire form is ``1|r!file-tag!…|t!file-tag!…|a!id~name~file.file!…``: ids of files are texts, of tags
    numbers in base 36, names percent-encoded; ``escaped`` undoes an encoding of the whole text first.
    removals and additions(key, file_id string, tag_id long), albums(key, album_id, name, file_ids array<string>).
    Another version, a null or an empty text gives no rows; a section of an unknown kind and an item without
    both ids are passed over. Caps count items by their place in a section, bad ones too. Rows are told apart by ``pos``,
    (section, place) in the wire. One row of ``overlays`` is one task's work at most: its caps bound it.
    """
    o = overlays.select(F.col(key), F.split(_unescaped(F.col(wire)) if escaped else F.col(wire), "\\|").alias("_parts")).filter(F.get("_parts", F.lit(0)) == WIRE_VERSION)
    o = o.select(key, F.posexplode("_parts").alias("_section", "_part")).filter("_section > 0")
    items = F.filter(F.split(F.substring("_part", 2, 1 << 30), "!"), lambda x: x != "")
    most = F.when(F.col("_kind") == "r", MOST_REMOVALS).when(F.col("_kind") == "t", MOST_ADDITIONS).when(F.col("_kind") == "a", MOST_ALBUMS)
    o = o.select(key, "_section", F.left("_part", F.lit(1)).alias("_kind"), items.alias("_items")).filter("_kind IN ('r', 't', 'a')")
    o = o.select(key, "_section", "_kind", F.posexplode(F.slice("_items", F.lit(1), most)).alias("_place", "_item"))
    pos = F.struct(F.col("_section").alias("section"), F.col("_place").alias("place")).alias("pos")
    # the tag is what follows the last hyphen, as far as its digits go
    file, tag = F.regexp_extract("_item", "(?s)^(.+)-[^-]*$", 1), F.regexp_extract("_item", "-([0-9A-Za-z]+)[^-]*$", 1)
    pairs = o.filter("_kind <> 'a'").select(key, "_kind", pos, file.alias("file_id"), F.conv(F.nullif(tag, F.lit("")), 36, 10).try_cast("long").alias("tag_id")).filter("file_id <> '' AND tag_id IS NOT NULL")
    field = F.split("_item", "~")
    files = F.slice(F.filter(F.split(F.coalesce(F.get(field, F.lit(2)), F.lit("")), "\\."), lambda x: x != ""), 1, MOST_IN_ALBUM)
    name = F.coalesce(F.nullif(_unescaped(F.coalesce(F.get(field, F.lit(1)), F.lit(""))), F.lit("")), F.lit(UNNAMED))
    albums = o.filter("_kind = 'a'").select(key, pos, F.get(field, F.lit(0)).alias("album_id"), name.alias("name"), files.alias("file_ids")).filter("album_id <> ''")
    return {"removals": pairs.filter("_kind = 'r'").drop("_kind"), "additions": pairs.filter("_kind = 't'").drop("_kind"), "albums": albums}


def encode_overlays(removals: DataFrame, additions: DataFrame, albums: DataFrame, *, key: str = "workspace_id") -> DataFrame:
    """(key, wire) of the workspaces that have any rows; rows and albums in order of ``pos``, or of their ids without it.

    Everything in a name but letters, digits and ``.-*_`` is percent-encoded, so no name can break the form.
    Only as many rows as the caps let through are gathered, whatever a workspace has.
    """
    def section(kind: str, rows: DataFrame, most: int, item: Column, ids: list[str]) -> DataFrame:
        order = ["pos"] if "pos" in rows.columns else ids
        first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_k") <= most)
        return first.groupBy(key).agg(F.concat(F.lit(f"{kind}!"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", item.alias("_item")))), lambda x: x["_item"]), "!")).alias(f"_{kind}"))

    pair = F.concat("file_id", F.lit("-"), F.lower(F.conv(F.col("tag_id").cast("string"), 10, 36)))
    name = F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20"))
    album = F.concat_ws("~", "album_id", name, F.array_join(F.slice("file_ids", 1, MOST_IN_ALBUM), "."))
    parts = [section("r", removals, MOST_REMOVALS, pair, ["file_id", "tag_id"]), section("t", additions, MOST_ADDITIONS, pair, ["file_id", "tag_id"]), section("a", albums, MOST_ALBUMS, album, ["album_id"])]
    out = parts[0].join(parts[1], key, "full_outer").join(parts[2], key, "full_outer")
    return out.select(key, F.concat_ws("|", F.lit(WIRE_VERSION), "_r", "_t", "_a").alias("wire"))


def scopes_described(grants: DataFrame) -> DataFrame:
    """``grants`` with ``words``: each scope as a person reads it, such as "2 folders + 3 topics + image/video + excluding 1"."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    said = lambda c, words: F.when(n(c) > 0, words)
    folders = F.concat(n("path_prefixes").cast("string"), F.when(n("path_prefixes") == 1, " folder").otherwise(" folders"))
    words = F.concat_ws(" + ", said("path_prefixes", folders), said("include_tags", F.concat(n("include_tags").cast("string"), F.lit(" topics"))), said("media_types", F.array_join("media_types", "/")), said("exclude_tags", F.concat(F.lit("excluding "), n("exclude_tags").cast("string"))))
    return grants.withColumn("words", F.coalesce(F.nullif(words, F.lit("")), F.lit("the whole library")))


def get_file(shown: DataFrame, file_id) -> DataFrame:
    """One file by id among those a workspace sees: a guessed id of another library gives no row."""
    return shown.filter(F.col("file_id") == file_id)


def count_for_grants(files: DataFrame, tags: DataFrame, grants: DataFrame, key: str = "grant_id") -> DataFrame:
    """(key, n): how many files of its library each grant lets through."""
    each = visible(files, tags, grants.drop("workspace_id").withColumnRenamed(key, "workspace_id"))
    n = each.groupBy(F.col("workspace_id").alias(key)).agg(F.count("*").alias("n"))
    return grants.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


#: The tint of a media type where a file has none of its own.
MEDIA_TINT = {"document": "#6b5d3f", "other": "#4a4a5e"}


def file_view(files: DataFrame, lens: DataFrame, tints: DataFrame | None = None, media_tint=MEDIA_TINT) -> DataFrame:
    """Files as they are shown: their lens tags, their first doctype (else the media type) as label, and a tint.

    lens(file_id, kind, name, display), tints(file_id, tint).
    """
    t = lens.groupBy("file_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "name"))).alias("tags"), F.min(F.when(F.col("kind") == "doctype", F.struct("name", F.coalesce("display", "name").alias("display")))).alias("doctype"))
    out = files.join(t, "file_id", "left")
    out = out.join(tints, "file_id", "left") if tints is not None else out.withColumn("tint", F.lit(None).cast("string"))
    by_media = F.create_map(*[F.lit(x) for kv in media_tint.items() for x in kv])
    return out.select(*files.columns, F.coalesce("doctype.display", "media_type").alias("label"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("tint", F.try_element_at(by_media, F.col("media_type"))).alias("tint"))
