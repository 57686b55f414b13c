"""Further queries of the catalogue with their SQL: sources, extractors, workspaces, digests, details and tag graphs."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from granary.functions import classify, identity
from granary.functions import text as tx
from granary.operators import digest, extractors, facets, graph, reconcile, tenancy, text_index
from granary.operators import selection as sel
from granary.operators.selection import ColourRule, Scope
from granary.plans import catalog as cat
from granary.plans.queries import NODES, QUERIES, TOKENS, query
from granary.session import scratch, table
from granary.sources import readers
from granary.streaming import streams

__all__ = ["QUERIES"]

# --- the library view and the details of a content

META = "CAST(('0x' || substr(asset_id, {}, 3)) AS INT)"
IDS = "(SELECT DISTINCT asset_id FROM file)"


def _number(at: int):
    return F.conv(F.substring("asset_id", at, 3), 16, 10).cast("int")


def _metas(c):
    """Metadata of some contents, read off their hashes."""
    a = c.asset.select("asset_id")
    n = _number
    return {
        "image_meta": a.filter(n(1) % 3 == 0).select("asset_id", n(4).alias("width"), n(7).alias("height"), n(10).cast("long").alias("captured_at")),
        "video_meta": a.filter(n(1) % 2 == 0).select("asset_id", n(13).alias("width"), n(16).alias("height"), F.lit(None).cast("long").alias("captured_at"), (n(19) / 8).alias("duration_s")),
        "audio_meta": a.filter(n(1) % 5 == 0).select("asset_id", (n(22) / 4).alias("duration_s")),
        "doc_meta": a.filter(n(1) % 7 == 0).select("asset_id", n(25).alias("page_count")),
        "geo": a.filter(n(1) % 11 == 0).select("asset_id", (n(4) % 90).cast("double").alias("lat"), (n(7) % 180).cast("double").alias("lon"), F.lit("Town").alias("locality"), F.lit("NL").alias("country_code")),
        "thumbnail": a.select("asset_id", F.when(n(1) % 2 == 0, "grid").otherwise("strip").alias("kind"), F.substring("asset_id", 1, 8).alias("cache_key")),
    }


@query(f"""SELECT file_id, i.root, 'Library ' || i.root AS label, state, coalesce(CASE WHEN h % 3 = 0 THEN {META.format(4)} END, CASE WHEN h % 2 = 0 THEN {META.format(13)} END) AS width, coalesce(CASE WHEN h % 3 = 0 THEN {META.format(7)} END, CASE WHEN h % 2 = 0 THEN {META.format(16)} END) AS height,
  CASE WHEN h % 3 = 0 THEN CAST({META.format(10)} AS BIGINT) END AS captured_at, coalesce(CASE WHEN h % 2 = 0 THEN {META.format(19)} / 8 END, CASE WHEN h % 5 = 0 THEN {META.format(22)} / 4 END) AS duration_s, CASE WHEN h % 7 = 0 THEN {META.format(25)} END AS page_count,
  CASE WHEN h % 2 = 0 THEN substr(asset_id, 1, 8) END AS thumb_key, CASE WHEN h % 11 = 0 THEN ({META.format(4)} % 90)::DOUBLE END AS lat, CASE WHEN h % 11 = 0 THEN 'Town' END AS locality FROM (SELECT *, {META.format(1)} AS h FROM file) i WHERE i.root <> 'src0'""")
def v_library_metas(c):
    """The library view with all its metadata tables; a root that is not registered drops its files."""
    roots = c.file.filter("root <> 'src0'").select("root").distinct().select("root", F.concat(F.lit("Library "), "root").alias("label"))
    return cat.library(c, roots, _metas(c)).select("file_id", "root", "label", "state", "width", "height", "captured_at", "duration_s", "page_count", "thumb_key", "lat", "locality")


@query(f"""SELECT asset_id, string_agg(DISTINCT rank || ':' || hex || ':' || bucket, ',' ORDER BY rank || ':' || hex || ':' || bucket) AS colours, any_value(tags) AS tags, any_value(body) AS body, any_value(copies) AS copies, any_value(pages) AS pages, any_value(runs) AS runs
  FROM {IDS} a JOIN color USING (asset_id)
  JOIN (SELECT asset_id, string_agg(kind || ':' || name, ',' ORDER BY by_user DESC, kind, name) AS tags FROM (SELECT asset_id, kind, name, bool_or(source = 'user') AS by_user FROM asset_tag GROUP BY ALL) GROUP BY asset_id) USING (asset_id)
  JOIN (SELECT asset_id, substr(body, 1, 1200) AS body FROM text_block) USING (asset_id)
  LEFT JOIN (SELECT asset_id, string_agg(rel_path, ',' ORDER BY rel_path) AS copies FROM indexed GROUP BY asset_id) USING (asset_id)
  LEFT JOIN (SELECT asset_id, CASE WHEN {META.format(1)} % 7 = 0 THEN {META.format(25)} END AS pages, CASE WHEN asset_id < '8' THEN 'doc.text:1:ok' END AS runs FROM {IDS}) USING (asset_id) GROUP BY asset_id""")
def content_details(c):
    """Everything the detail panel shows, for every content."""
    runs = c.asset.filter("asset_id < '8'").select("asset_id", F.lit("doc.text").alias("extractor"), F.lit(1).alias("version"), F.lit("ok").alias("status"))
    join = lambda col, f: F.array_join(F.transform(col, f), ",")
    return facets.details(c, _metas(c), runs).select(
        "asset_id", join("colours", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["hex"], x["bucket"])).alias("colours"), join("tags", lambda x: F.concat_ws(":", x["kind"], x["name"])).alias("tags"), F.get("texts", F.lit(0))["body"].alias("body"),
        F.nullif(join("copies", lambda x: x["rel_path"]), F.lit("")).alias("copies"), F.col("doc_meta.page_count").alias("pages"), F.nullif(join("runs", lambda x: F.concat_ws(":", x["extractor"], x["version"].cast("string"), x["status"])), F.lit("")).alias("runs"),
    )


# --- workspaces

LENS_SQL = "(SELECT file_id, kind, t.name FROM indexed JOIN asset_tag t USING (asset_id) WHERE source <> 'user' UNION SELECT file_id, 'topic', 'mine' FROM indexed WHERE file_id % 10 = 0)"


def _lens(c):
    own = c.indexed.filter("file_id % 10 = 0").select("file_id", F.lit("topic").alias("kind"), F.lit("mine").alias("name"))
    return c.indexed.select("file_id", "asset_id").join(c.asset_tag.filter("source <> 'user'"), "asset_id").select("file_id", "kind", "name").unionByName(own).distinct()


@query(f"SELECT file_id, indexed.name FROM indexed WHERE media_type = 'document' AND contains(lower(name), 'c_1') AND file_id IN (SELECT file_id FROM {LENS_SQL} WHERE kind = 'topic' AND name IN ('mine', 'topic3')) AND file_id IN (SELECT file_id FROM {LENS_SQL} WHERE kind = 'doctype' AND name = 'en')")
def lens_matches(c):
    """A query over the lens of a workspace, whose own tags count like those of the machine."""
    return sel.matching_lens(c.indexed, _lens(c), media_type="document", q="C_1", tags={"topic": ["mine", "topic3"], "doctype": ["en"], "author": []}).select("file_id", "name")


@query("SELECT grant_id, count(file_id) AS n FROM (SELECT unnest([1, 2, 3]) AS grant_id) LEFT JOIN (SELECT 1 AS g, file_id FROM indexed WHERE root = 'src1' UNION ALL SELECT 2, file_id FROM indexed WHERE root = 'src2' AND media_type = 'image') ON g = grant_id GROUP BY grant_id")
def grant_counts(c):
    files = c.indexed.withColumn("library_id", F.col("root"))
    tags = files.select("file_id", "asset_id").join(c.asset_tag.filter("source <> 'user'"), "asset_id").select("file_id", "name")
    rows = [(1, "w", "src1", [], [], [], []), (2, "w", "src2", [], [], [], ["image"]), (3, "v", "none", [], [], [], [])]
    grants = c.file.sparkSession.createDataFrame(rows, "grant_id int, workspace_id string, library_id string, path_prefixes array<string>, include_tags array<string>, exclude_tags array<string>, media_types array<string>")
    return tenancy.count_for_grants(files, tags, grants)


@query("SELECT file_id, name FROM indexed WHERE root = 'src1' AND file_id = (SELECT min(file_id) FROM indexed WHERE root = 'src1')")
def file_by_id(c):
    """A file by id through what a workspace sees; the id of a file of another library, asked for too, gives no row."""
    shown = c.indexed.filter("root = 'src1'")
    mine, other = (c.indexed.filter(f).agg(F.min("file_id")).first()[0] for f in ("root = 'src1'", "root <> 'src1'"))
    return tenancy.get_file(shown, mine).unionByName(tenancy.get_file(shown, other)).select("file_id", "name")


@query(f"SELECT file_id, coalesce(min(CASE WHEN kind = 'doctype' THEN upper(l.name) END), any_value(media_type)) AS label, count(DISTINCT (kind, l.name)) AS n FROM indexed JOIN {LENS_SQL} l USING (file_id) GROUP BY file_id")
def file_views(c):
    lens = _lens(c).withColumn("display", F.upper("name"))
    return tenancy.file_view(c.indexed, lens).select("file_id", "label", F.size("tags").cast("long").alias("n"))


@query("""SELECT DISTINCT colour, rule FROM (SELECT CASE WHEN asset_id IN (SELECT asset_id FROM asset_tag WHERE name = 'topic1') THEN '#f00' WHEN starts_with(rel_path, 'src2') THEN '#0f0' WHEN ext = 'zip' THEN '#00f' END AS colour FROM indexed)
  JOIN (SELECT unnest(['#f00', '#0f0', '#00f']) AS colour, unnest(['topic1', 'path:src2', 'ext:zip']) AS rule) USING (colour)""")
def rules_in_use(c):
    """The legend of a colouring: rules without a file, and switched-off ones, are left out."""
    rules = [ColourRule("tag", "topic1", "#f00"), ColourRule("path", "src2", "#0f0"), ColourRule("ext", "zip", "#00f"), ColourRule("media", "audio", "#fff", enabled=False)]
    used = sel.used_rules(sel.coloured(c, c.indexed, rules), rules)
    return c.file.sparkSession.createDataFrame([(r.colour, r.describe()) for r in used], "colour string, rule string")


@query("SELECT '2 folders + 4 topics + document/image + excluding 1' AS a, 'the whole library' AS b", catalogue=False)
def scopes_in_words(spark, sf_dir):
    a = sel.describe_scope(Scope(["src1", "src2/en"], ["topic1", "topic2", "topic3", "topic4"], ["author1"], ["document", "image"]))
    return spark.createDataFrame([(a, sel.describe_scope(Scope()))], "a string, b string")


@query("""SELECT root, concat_ws(' + ', CASE WHEN f > 0 THEN f || CASE f WHEN 1 THEN ' folder' ELSE ' folders' END END, CASE WHEN t > 0 THEN t || ' topics' END, CASE WHEN m <> '' THEN m END, CASE WHEN x > 0 THEN 'excluding ' || x END) AS words
  FROM (SELECT root, count(DISTINCT CASE WHEN size_bytes > 1000000 THEN parent_rel END) AS f, coalesce(string_agg(DISTINCT media_type, '/' ORDER BY media_type), '') AS m FROM indexed GROUP BY root)
  JOIN (SELECT root, count(DISTINCT CASE WHEN kind = 'topic' THEN t.name END) AS t, count(DISTINCT CASE WHEN kind = 'custom' THEN t.name END) AS x FROM indexed JOIN asset_tag t USING (asset_id) GROUP BY root) USING (root)""")
def scopes_described(c):
    """A grant for each root, with the folders, topics and types that it has, in words."""
    f = c.indexed.groupBy("root").agg(F.collect_set(F.when(F.col("size_bytes") > 1_000_000, F.col("parent_rel"))).alias("path_prefixes"), F.array_sort(F.collect_set("media_type")).alias("media_types"))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("name")))
    t = c.indexed.select("root", "asset_id").join(c.asset_tag, "asset_id").groupBy("root").agg(of("topic").alias("include_tags"), of("custom").alias("exclude_tags"))
    return tenancy.scopes_described(f.join(t, "root")).select("root", "words")


@query("""SELECT 'r' AS part, w, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id * 31 + n_chars) AS BIGINT) AS total FROM (SELECT doc_id // 500 AS w, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS k FROM documents) WHERE k <= 400 GROUP BY w
  UNION ALL SELECT 't', w, count(*), CAST(sum(doc_id * 31 + n_chars * 7) AS BIGINT) FROM (SELECT doc_id // 500 AS w, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1) WHERE k <= 200 GROUP BY w
  UNION ALL SELECT 'a', w, count(*), CAST(sum(least(n, 250) * 31 + length(name)) AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY album) AS k FROM (SELECT doc_id // 500 AS w, source || ' & ' || lang || '!' AS name, source || lang AS album, count(*) AS n FROM documents GROUP BY ALL)) WHERE k <= 20 GROUP BY w""", catalogue=False)
def overlays_decoded(spark, sf_dir):
    """Corrections and albums of workspaces of 500 documents each, encoded to one text a workspace and decoded again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang", F.floor(F.col("doc_id") / 500).alias("workspace_id"))
    row = lambda tag: ["workspace_id", F.concat(F.lit("f"), "doc_id").alias("file_id"), tag.cast("long").alias("tag_id"), F.col("doc_id").alias("pos")]
    albums = d.groupBy("workspace_id", F.concat("source", "lang").alias("album_id"), F.concat("source", F.lit(" & "), "lang", F.lit("!")).alias("name")).agg(F.array_sort(F.collect_list(F.concat(F.lit("f"), "doc_id"))).alias("file_ids"))
    wire = tenancy.encode_overlays(d.select(*row(F.col("n_chars"))), d.filter("doc_id % 2 = 1").select(*row(F.col("n_chars") * 7)), albums)
    got = tenancy.decode_overlays(wire, escaped=False)
    pairs = lambda t: F.sum(F.expr("CAST(substr(file_id, 2) AS LONG)") * 31 + F.col("tag_id"))
    parts = [got[t].groupBy("workspace_id").agg(F.count("*").alias("n"), pairs(t).alias("total")).withColumn("part", F.lit(p)) for t, p in (("removals", "r"), ("additions", "t"))]
    parts.append(got["albums"].groupBy("workspace_id").agg(F.count("*").alias("n"), F.sum(F.size("file_ids") * 31 + F.length("name")).alias("total")).withColumn("part", F.lit("a")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", F.col("workspace_id").alias("w"), "n", "total")


@query("SELECT shown, count(*) AS n FROM (SELECT CASE WHEN media_type IN ('image', 'video') THEN 'media' ELSE 'other' END AS shown FROM indexed) GROUP BY shown")
def media_or_not(c):
    a, b = sel.media_split(c.indexed)
    return a.select(F.lit("media").alias("shown")).unionByName(b.select(F.lit("other").alias("shown"))).groupBy("shown").agg(F.count("*").alias("n"))


@query("SELECT asset_id FROM (SELECT asset_id, ['doc_text', 'ai_vision', 'aiXv', 'air'][1 + CAST(('0x' || substr(asset_id, 1, 1)) AS INT) % 4] AS source FROM text_block) WHERE NOT (length(source) >= 3 AND source[1:2] = 'ai')")
def text_without_models(c):
    """Blocks that are no model's; as in the pattern, any character may stand for the underscore."""
    source = F.get(F.array(*[F.lit(x) for x in ("doc_text", "ai_vision", "aiXv", "air")]), F.conv(F.substring("asset_id", 1, 1), 16, 10).cast("int") % 4)
    return c.text_block.withColumn("source", source).filter(sel.not_ai(F.col("source"))).select("asset_id")


@query(f"SELECT asset_id, CAST(len(list_filter({TOKENS}, lambda x: starts_with(x, 'the'))) AS BIGINT) AS n FROM text_block WHERE len(list_filter({TOKENS}, lambda x: starts_with(x, 'the'))) > 0")
def prefix_hits(c):
    """From the stored index: only the terms with the prefix are read."""
    return c.text_index.prefix("Thé").select(F.col("key").alias("asset_id"), "n")


WORDS_AT = r"list_transform(list_filter(list_transform(regexp_split_to_array(trim(body, ' '), '[ \t\n\v\f\r]+'), lambda w, i: {{'i': i, 'hit': len(list_intersect(regexp_extract_all(strip_accents(lower(w)), '[\p{{L}}\p{{N}}]+'), ['{}', '{}'])) > 0}}), lambda x: x.hit), lambda x: x.i)".format
SNIPPET = f"""WITH t AS (SELECT asset_id, body, {TOKENS} AS t FROM text_block), h AS (SELECT asset_id, regexp_split_to_array(trim(body, ' '), '[ \t\n\v\f\r]+') AS w, {WORDS_AT('then', 'and')} AS hit FROM t WHERE list_contains(t, 'then') AND list_contains(t, 'and'))
 SELECT asset_id, array_to_string(list_transform(range(greatest(hit[1] - 6, 1), least(greatest(hit[1] - 6, 1) + 12, len(w) + 1)), lambda i: CASE WHEN list_contains(hit, i) THEN '[' || w[i] || ']' ELSE w[i] END), ' ') AS snippet FROM h"""


@query(", " + SNIPPET.removeprefix("WITH "))
def search_snippets(c):
    """Twelve words around the first word found, by the positions that the index holds; found words in brackets."""
    return text_index.snippets(c.text_index.bm25(["then", "and"]), c.text_block).select(F.col("key").alias("asset_id"), "snippet")


@query(f"""SELECT asset_id, word AS term, CAST(count(*) AS BIGINT) AS tf, len FROM (SELECT asset_id, unnest({TOKENS}) AS word, CAST(len({TOKENS}) AS BIGINT) AS len FROM
  (SELECT asset_id, CASE WHEN asset_id < '2' THEN replace(body, 'e', 'i') || ' twice twice' ELSE body END AS body FROM text_block WHERE asset_id NOT LIKE 'f%' OR asset_id LIKE 'fe%')) GROUP BY ALL""")
def text_index_segments(c):
    """The index loaded in two segments, some contents deleted, some of them added again, some texts replaced, then merged."""
    index = text_index.TextIndex(c.spark, scratch(c.spark, "text-index"))
    at = F.col("asset_id")
    index.add(c.text_block.filter(at < "8"))
    index.add(c.text_block.filter(at >= "8"))
    index.delete(c.text_block.filter(at.startswith("f")).select("asset_id"))
    index.add(c.text_block.filter(at.startswith("fe")))
    index.add(c.text_block.filter(at < "2").withColumn("body", F.concat(F.replace("body", F.lit("e"), F.lit("i")), F.lit(" twice twice"))))
    index.merge()
    return index.postings().select(F.col("key").alias("asset_id"), "term", "tf", "len")


@query(f"""SELECT file_id, score FROM indexed JOIN (SELECT asset_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM (
  SELECT h.*, count(*) OVER (PARTITION BY term) AS df, s.n, s.mean FROM (SELECT asset_id, len, term, count(*) AS tf FROM (SELECT asset_id, len({TOKENS}) AS len, unnest({TOKENS}) AS term FROM text_block) WHERE term IN ('the', 'en') GROUP BY ALL) h,
  (SELECT count(*) AS n, avg(len({TOKENS})) AS mean FROM text_block) s) GROUP BY asset_id HAVING count(*) = 2) USING (asset_id)""")
def search_files(c):
    """The indexed files whose text holds all words of a search, with the score of their content."""
    found = c.text_index.bm25(["the", "en"]).select(F.col("key").alias("asset_id"), "score")
    return c.indexed.join(found, "asset_id").select("file_id", F.round("score", 4).alias("score"))


# --- digests and gaps

GAP_TAGS = "(SELECT * FROM asset_tag WHERE NOT (kind = 'topic' AND name IN ('topic1', 'topic2')) AND NOT (kind = 'doctype' AND name = 'es'))"


@query(f"SELECT count(*) FILTER (NOT d) AS no_doctype, count(*) FILTER (NOT t) AS no_topic, count(*) FILTER (NOT d OR NOT t) AS gaps FROM (SELECT asset_id IN (SELECT asset_id FROM {GAP_TAGS} WHERE kind = 'doctype') AS d, asset_id IN (SELECT asset_id FROM {GAP_TAGS} WHERE kind = 'topic') AS t FROM indexed)")
def gap_counts(c):
    """Files without a doctype, without a topic, and with either gap, where some tags have not been found."""
    t = c.asset_tag.filter("NOT (kind = 'topic' AND name IN ('topic1', 'topic2')) AND NOT (kind = 'doctype' AND name = 'es')")
    return facets.gaps(c, t)


@query("""SELECT axis, value, count(*) AS n FROM (
  SELECT 'media' AS axis, media_type AS value FROM indexed UNION ALL SELECT 'folder', parent_rel FROM indexed WHERE parent_rel <> ''
  UNION ALL SELECT kind, name FROM (SELECT DISTINCT file_id, kind, t.name FROM indexed JOIN asset_tag t USING (asset_id) WHERE kind IN ('doctype', 'topic', 'author', 'entity', 'date', 'pattern'))) GROUP BY ALL""")
def digest_of_files(c):
    return digest.digest_files(c.indexed.withColumn("parent_rel", F.concat(F.lit("/"), "parent_rel", F.lit("//deep/er"))), c.indexed.select("file_id", "asset_id").join(c.asset_tag, "asset_id").select("file_id", "kind", "name"))


@query("SELECT count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(mtime_ns) AS earliest, max(mtime_ns) AS latest, count(*) FILTER (asset_id NOT IN (SELECT asset_id FROM asset_tag WHERE kind = 'date' AND name <> '2010')) AS undated FROM indexed")
def digest_of_selection(c):
    tags = c.indexed.select("file_id", "asset_id").join(c.asset_tag.filter("NOT (kind = 'date' AND name = '2010')"), "asset_id").select("file_id", "kind", "name")
    return digest.digest_totals(c.indexed, tags)


@query("SELECT root, count(*) AS files, count(DISTINCT asset_id) AS contents, CAST(sum(size_bytes) AS BIGINT) AS bytes, any_value(tags) AS tags FROM file JOIN (SELECT root, count(DISTINCT (kind, t.name)) AS tags FROM file JOIN asset_tag t USING (asset_id) GROUP BY root) USING (root) GROUP BY root")
def library_totals(c):
    return facets.library_totals(c)


@query("""SELECT (SELECT string_agg(state || '=' || n, ',' ORDER BY state) FROM (SELECT state, count(*) AS n FROM file GROUP BY state)) AS states, (SELECT string_agg(media_type || '=' || n, ',' ORDER BY media_type) FROM (SELECT media_type, count(*) AS n FROM (SELECT asset_id, min(media_type) AS media_type FROM file GROUP BY asset_id) GROUP BY media_type)) AS media,
  (SELECT count(DISTINCT asset_id) FROM file) AS assets, (SELECT count(*) FROM (SELECT asset_id FROM indexed GROUP BY asset_id HAVING count(*) > 1)) AS duplicate_groups, (SELECT count(*) FROM file WHERE file_id % 7 = 0) AS mutations""")
def status_report(c):
    audit = c.file.select(F.when(F.col("file_id") % 7 == 0, "mutated").otherwise("unchanged").alias("verdict"))
    said = lambda col: F.array_join(F.transform(F.map_entries(col), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return facets.status(c, audit).select(said("by_state").alias("states"), said("by_media_type").alias("media"), "assets", "duplicate_groups", "mutations")


# --- tag graphs

FILE_NODES = NODES.replace("count(DISTINCT asset_id) AS n FROM asset_tag WHERE asset_id IN (SELECT asset_id FROM indexed) AND", "count(DISTINCT file_id) AS n FROM (SELECT file_id, t.kind, t.name FROM indexed JOIN asset_tag t USING (asset_id)) WHERE")


@query(f"""SELECT a.kind || ':' || a.name AS source, b.kind || ':' || b.name AS target, count(*) AS weight
  FROM (SELECT DISTINCT file_id, t.kind, t.name FROM indexed JOIN asset_tag t USING (asset_id) JOIN ({FILE_NODES}) k ON k.kind = t.kind AND k.name = t.name) a
  JOIN (SELECT DISTINCT file_id, t.kind, t.name FROM indexed JOIN asset_tag t USING (asset_id) JOIN ({FILE_NODES}) k ON k.kind = t.kind AND k.name = t.name) b ON a.file_id = b.file_id AND (b.kind, b.name) > (a.kind, a.name) GROUP BY 1, 2 HAVING count(*) >= 2""")
def graph_edges_by_file(c):
    """All edges, counted per file instead of per content."""
    t = c.indexed.select("file_id", "asset_id").join(c.asset_tag, "asset_id").select("file_id", "kind", "name")
    nodes = graph.tag_nodes(t, c.indexed, key="file_id")
    return graph.tag_edges(t, c.indexed, nodes, most=None, key="file_id").select("source", "target", "weight")


PARTS = "SELECT DISTINCT 'b' || p_brand AS source, 't' || (p_partkey % 97) || p_brand AS target FROM part UNION SELECT 'b' || min(p_brand), 'b' || max(p_brand) FROM part"


@query(f"WITH RECURSIVE e AS ({PARTS}), u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node", catalogue=False)
def graph_components(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.select(F.concat(F.lit("b"), "p_brand").alias("source"), F.concat(F.lit("t"), (F.col("p_partkey") % 97).cast("string"), "p_brand").alias("target")).distinct()
    bridge = p.agg(F.concat(F.lit("b"), F.min("p_brand")).alias("source"), F.concat(F.lit("b"), F.max("p_brand")).alias("target"))
    return graph.components(e.unionByName(bridge))


@query(f"SELECT node, CAST(1 + (k // 12) AS BIGINT) AS row, CAST(k % 12 AS BIGINT) AS col FROM (SELECT node, row_number() OVER (ORDER BY n DESC, node) - 1 AS k FROM (SELECT kind || ':' || name AS node, n FROM ({NODES})) WHERE node NOT IN ('doctype:en', 'topic:topic1'))")
def loose_tags(c):
    """Tags outside the hierarchy, wrapped in rows below its base."""
    nodes = graph.tag_nodes(c.asset_tag, c.indexed).select(F.concat_ws(":", "kind", "name").alias("node"), "n")
    dag = nodes.sparkSession.createDataFrame([("doctype:en", "topic:topic1")], "parent string, child string")
    return graph.wrapped(nodes, dag).select("node", (F.col("row") - 1).alias("row"), "col")


# --- states, priorities, claims

@query("SELECT state, n_ok, n_bad FROM (SELECT state, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_bad FROM (SELECT state, NOT (state = 'error' AND to_ = 'indexed') AS ok FROM (SELECT state, ['queued', 'indexed', 'error', 'missing'][1 + file_id % 4] AS to_ FROM file)) GROUP BY state)")
def state_changes(c):
    """How many changes of state are legal: a failed file has to be queued before it can be indexed."""
    to = F.get(F.array(*[F.lit(x) for x in ("queued", "indexed", "error", "missing")]), (F.col("file_id") % 4).cast("int"))
    ok = reconcile.legal(F.col("state"), to)
    return c.file.groupBy("state").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_bad"))


@query("SELECT priority, count(*) AS n FROM (SELECT CASE WHEN file_id * 1000000 >= 2147483648 THEN 300 WHEN mtime_ns / 1e9 > 1700000000 + 2 * 2592000 - 2592000 THEN 80 ELSE 100 END AS priority FROM file) GROUP BY priority")
def scan_priorities(c):
    p = reconcile.priority("big", "mtime_ns", now=1_700_000_000 + 2 * 2_592_000)
    return c.file.withColumn("big", F.col("file_id") * 1_000_000).groupBy(p.alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT file_id, length(body) AS chars, CASE WHEN asset_id < '8' THEN 2 END AS version, CASE WHEN asset_id >= '4' THEN 'later' END AS hint FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY root, rel_path) AS k FROM file WHERE state = 'queued') JOIN text_block USING (asset_id) WHERE k = 1")
def claimed_work(c):
    """All queued files, one for each content, with the texts, past runs and hints that their work needs."""
    every = reconcile.claim(c.file.withColumn("priority", F.lit(100)), 2**31 - 1)
    runs = c.asset.filter("asset_id < '8'").select("asset_id", F.lit("doc.text").alias("extractor"), F.lit(2).alias("version"), F.lit("ok").alias("status"))
    hints = c.asset.filter("asset_id >= '4'").select("asset_id", F.lit("later").alias("hint"))
    got = reconcile.gathered(every, c.text_block, runs, hints)
    return got.select("file_id", F.length("text").cast("long").alias("chars"), F.try_element_at("done", F.lit("doc.text")).alias("version"), F.get("hints", F.lit(0)).alias("hint"))


# --- sources and extractors: small files are written below the shared folder and read back

def _docx(text: pd.Series) -> pd.Series:
    def one(t: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
            z.writestr(zipfile.ZipInfo("word/document.xml"), f"<w:document {w}><w:body><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:body></w:document>")
            z.writestr(zipfile.ZipInfo("word/footer1.xml"), f"<w:ftr {w}><w:p><w:r><w:t>the end</w:t></w:r></w:p></w:ftr>")
        return out.getvalue()

    return text.map(one)


def _contents(spark, sf_dir):
    """Three files of each customer: its comment-like line as text, the same as DOCX, and a damaged DOCX."""
    docx = F.pandas_udf(_docx, "binary")
    cust = table(spark, sf_dir, "customer", spread=True).select(F.col("c_custkey").cast("string").alias("k"), F.concat_ws(" ", F.lit("invoice number"), F.col("c_custkey").cast("string"), F.lit("amount due for"), "c_name").alias("line"))
    each = F.explode(F.array(F.struct(F.lit("txt").alias("ext"), F.col("line").cast("binary").alias("content")), F.struct(F.lit("docx").alias("ext"), docx("line").alias("content")), F.struct(F.lit("pptx").alias("ext"), F.lit(b"PK damaged").alias("content")))).alias("x")
    return cust.select("k", "line", each).select("k", "line", "x.ext", "x.content")


CUSTOMERS = "(SELECT CAST(c_custkey AS VARCHAR) AS k, 'invoice number ' || c_custkey || ' amount due for ' || c_name AS line FROM customer)"


@query(f"SELECT 'd' || (CAST(k AS INT) % 7) AS parent_rel, k || '.txt' AS name, CAST(octet_length(encode(line)) AS BIGINT) AS size_bytes, 'document' AS media_type, 'text/plain' AS mime, false AS truncated, sha256(line) AS asset_id, line AS body FROM {CUSTOMERS}", catalogue=False)
def files_read(spark, sf_dir):
    """A folder of text files: listed, identified by their bytes, and read. Hidden and unknown files are passed over."""
    out = scratch(spark, "files")
    rows = _contents(spark, sf_dir).filter("ext = 'txt'").withColumn("path", F.concat(F.lit("d"), (F.col("k").cast("int") % 7).cast("string"), F.lit("/"), "k", F.lit(".txt")))
    readers.write_files(rows, out)
    readers.write_files(rows.filter("k = '1'").select(F.explode(F.array(F.lit(".git/1.txt"), F.lit("d1/1.xyz"))).alias("path"), "content"), out)
    name = F.regexp_extract("path", r"[^/]*$", 0).alias("name")
    found = readers.identify(spark, out).filter(identity.indexable(F.regexp_replace("path", "^.*/files-[0-9a-f]*/", ""))).select(name, "mime", "media_type", "truncated", "asset_id")
    text = readers.plain_text(spark, out).filter("path NOT LIKE '%/.git/%'").select(name, "body")
    return readers.listing(spark, out).select("parent_rel", "name", "size_bytes").join(found, "name").join(text, "name")


@query(f"""SELECT extractor, status, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT 'doc.text' AS extractor, 'ok' AS status, length(line) AS chars FROM {CUSTOMERS} UNION ALL SELECT 'doc.text', 'unsupported', 0 FROM {CUSTOMERS} UNION ALL SELECT 'doc.text', 'unsupported', 0 FROM {CUSTOMERS}
  UNION ALL SELECT 'doc.docx', 'ok', length(line) + 7 FROM {CUSTOMERS} UNION ALL SELECT 'doc.docx', 'unsupported', 0 FROM {CUSTOMERS} UNION ALL SELECT 'doc.docx', 'unsupported', 0 FROM {CUSTOMERS}
  UNION ALL SELECT 'doc.pptx', 'error', 0 FROM {CUSTOMERS} UNION ALL SELECT 'doc.pptx', 'unsupported', 0 FROM {CUSTOMERS} UNION ALL SELECT 'doc.pptx', 'unsupported', 0 FROM {CUSTOMERS}
  UNION ALL SELECT 'doc.pdf', 'skipped', 0 FROM {CUSTOMERS} UNION ALL SELECT 'doc.pdf', 'skipped', 0 FROM {CUSTOMERS} UNION ALL SELECT 'doc.pdf', 'skipped', 0 FROM {CUSTOMERS}) GROUP BY ALL""", catalogue=False)
def extractor_ledger(spark, sf_dir):
    """The ledger after the document extractors ran over whole files, and how much text they found."""
    assets = _contents(spark, sf_dir).select(F.sha2(F.concat("content", F.col("k").cast("binary")), 256).alias("asset_id"), F.lit("document").alias("media_type"), "ext", F.concat_ws(".", "k", "ext").alias("name"), "content")
    none = spark.createDataFrame([], "asset_id string, extractor string, version int, status string")
    only = [e for e in extractors.registry({}) if e.name in ("doc.text", "doc.docx", "doc.pptx", "doc.pdf")]
    rows, ledger = extractors.run_all(assets, none, only)
    text = [rows[n].select("asset_id", F.lit(n).alias("extractor"), F.length("body").alias("chars")) for n in ("doc.text", "doc.docx", "doc.pptx")]
    chars = text[0].unionByName(text[1]).unionByName(text[2]).groupBy("asset_id", "extractor").agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    return ledger.join(chars, ["asset_id", "extractor"], "left").groupBy("extractor", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


@query(f"SELECT k, 'invoice' AS doctype, line AS text FROM {CUSTOMERS}", catalogue=False)
def inspected_lines(spark, sf_dir):
    """Verdicts through the extractor: the lines of customers read as invoices; their evidence is put in order first."""
    line = _contents(spark, sf_dir).filter("ext = 'txt'").select(F.col("k").alias("asset_id"), "line")
    blocks = line.select("asset_id", F.lit("ai_vision").alias("source"), F.lit(0).alias("ord"), F.lit("").alias("body")).unionByName(line.select("asset_id", F.lit("doc_text").alias("source"), F.lit(7).alias("ord"), F.col("line").alias("body")))
    files = line.select("asset_id", F.concat(F.lit("a/b/c/"), "asset_id", F.lit(".txt")).alias("rel_path"), F.concat("asset_id", F.lit(".txt")).alias("name"), F.lit("txt").alias("ext"), F.lit("document").alias("media_type"))
    seen = classify.evidence(files, blocks).withColumn("text_block", F.regexp_replace("text", "\n$", ""))
    got = extractors.agent_inspect(seen).select("asset_id", "doctype")
    return got.join(seen.select("asset_id", F.col("text_block").alias("text")), "asset_id").select(F.col("asset_id").alias("k"), "doctype", "text")


@query("SELECT key, count(*) AS calls, CAST(sum(allowed) AS BIGINT) AS allowed FROM (SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts) <= 2 THEN 1 ELSE 0 END AS allowed FROM events) GROUP BY key", catalogue=False)
def bucket_calls(spark, sf_dir):
    """The events as a stream through the token bucket with a daily cap of two; its state is kept per key between batches."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    calls = streams.token_bucket(e.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), rate=1e9, daily=2)
    out = scratch(spark, "bucket")
    calls.writeStream.outputMode("append").option("checkpointLocation", scratch(spark, "bucket-log")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(calls.schema).parquet(out).groupBy("key").agg(F.count("*").alias("calls"), F.sum(F.col("allowed").cast("long")).alias("allowed"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
  r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST(2 AS DOUBLE) AS tokens, CAST(0 AS DOUBLE) AS last, 0 AS ok FROM e
    UNION ALL SELECT key, k, CASE WHEN t >= 1 THEN t - 1 ELSE t END, "at", CASE WHEN t >= 1 THEN 1 ELSE 0 END FROM (
      SELECT e.key, e.k, e."at", least(CAST(2 AS DOUBLE), r.tokens + greatest(CAST(0 AS DOUBLE), e."at" - r.last) * (CAST(1 AS DOUBLE) / 64800)) AS t FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
  SELECT key, CAST(count(*) AS BIGINT) AS calls, CAST(sum(ok) AS BIGINT) AS allowed FROM r WHERE k > 0 GROUP BY key""", catalogue=False)
def bucket_refusals(spark, sf_dir):
    """The events as a stream through a bucket of two tokens that gains one in 18 hours, so that calls are refused."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    calls = streams.token_bucket(e.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), rate=1 / 64800, size=2.0)
    return _streamed(spark, calls, "bucket").groupBy("key").agg(F.count("*").alias("calls"), F.sum(F.col("allowed").cast("long")).alias("allowed"))


def _streamed(spark, stream, label):
    """What a stream over tables gives until its input ends."""
    out = scratch(spark, label)
    stream.writeStream.outputMode("append").option("checkpointLocation", scratch(spark, f"{label}-log")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS file, event_id AS id, epoch_us(ts) // 1000 AS "at", 'w' || (event_id % 3) AS worker, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'queue' ELSE 'claim' END AS what FROM events),
  w AS (SELECT max("at") - 3600000 AS mark FROM e), o AS (SELECT e.*, row_number() OVER (PARTITION BY file ORDER BY "at", id) AS k FROM e, w WHERE "at" < mark),
  r AS (SELECT DISTINCT file, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS "at", CAST(NULL AS VARCHAR) AS worker, CAST(NULL AS VARCHAR) AS outcome, 'new' AS status, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS BIGINT) AS until, false AS ran_out, CAST(NULL AS VARCHAR) AS was, CAST(0 AS BIGINT) AS ended FROM o
    UNION ALL SELECT file, k, id, "at", worker, outcome,
      CASE outcome WHEN 'queued' THEN 'queued' WHEN 'released' THEN 'queued' WHEN 'claimed' THEN 'leased' WHEN 'completed' THEN 'done' ELSE st END, CASE WHEN outcome = 'claimed' THEN worker WHEN st = 'leased' AND outcome NOT IN ('released', 'completed') THEN owner END, CASE WHEN outcome = 'claimed' THEN "at" + 43200000 ELSE until END, ran_out, owner, until
    FROM (SELECT *, CASE WHEN what = 'queue' THEN CASE WHEN st = 'leased' THEN 'held' ELSE 'queued' END WHEN what = 'claim' THEN CASE WHEN st = 'queued' THEN 'claimed' ELSE 'refused' END
        WHEN st = 'leased' AND owner = worker THEN CASE WHEN what = 'fail' THEN 'released' ELSE 'completed' END ELSE 'late' END AS outcome
      FROM (SELECT o.file, o.k, o.id, o."at", o.worker, o.what, r.owner, r.until, r.status = 'leased' AND r.until < o."at" AS ran_out, CASE WHEN r.status = 'leased' AND r.until < o."at" THEN 'queued' ELSE r.status END AS st FROM r JOIN o ON o.file = r.file AND o.k = r.k + 1)))
  SELECT file, id, "at" AS at_ms, worker, outcome FROM r WHERE k > 0 UNION ALL SELECT file, NULL, ended, was, 'expired' FROM r WHERE ran_out
  UNION ALL SELECT file, NULL, until, owner, 'expired' FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k DESC) AS back FROM r), w WHERE back = 1 AND status = 'leased' AND until < mark""", catalogue=False)
def lease_outcomes(spark, sf_dir):
    """The events as a log of queues, claims and results on files, with leases of twelve hours that run out when their worker is lost."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    what = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "queue").otherwise("claim")
    log = e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("worker"), what.alias("what"))
    return _streamed(spark, streams.leases(log, lease_ms=12 * 3_600_000), "leases").withColumnRenamed("at", "at_ms")


@query("""SELECT file_id, CASE WHEN k <= 20 THEN 'w1' WHEN held THEN 'gone' WHEN k IS NOT NULL AND k <= 45 THEN 'w2' END AS owner FROM (SELECT file_id, state = 'queued' AND file_id % 5 = 0 AS held FROM file)
  LEFT JOIN (SELECT file_id, row_number() OVER (ORDER BY file_id % 3, root, rel_path) AS k FROM file WHERE state = 'queued' AND file_id % 5 <> 0) USING (file_id)""")
def leased_files(c):
    """Two workers take queued files one after the other; what a third one holds yet is left to it."""
    held = (F.col("state") == "queued") & (F.col("file_id") % 5 == 0)
    f = c.file.withColumns({"priority": F.col("file_id") % 3, "lease_owner": F.when(held, "gone"), "lease_expires_at": F.when(held, F.lit(100)).cast("long")})
    two = reconcile.lease(reconcile.lease(f, "w1", 20, now=90), "w2", 25, now=100)
    return two.select("file_id", F.col("lease_owner").alias("owner"))


# --- pages, surrogate ids, grants by the thousand, sinks

@query("SELECT file_id, name, CAST((SELECT count(*) FROM s) AS BIGINT) AS total, CAST((SELECT max(file_id) FROM p) AS BIGINT) AS next FROM p".replace("FROM p", "FROM (SELECT file_id, name FROM s WHERE file_id > 200 ORDER BY file_id LIMIT 120)").replace("FROM s", "FROM (SELECT * FROM indexed WHERE asset_id IN (SELECT asset_id FROM asset_tag WHERE kind = 'doctype' AND name = 'en'))"))
def library_page_total(c):
    """A page of a selection with the total of all its files and the cursor of the next page, from one pass."""
    p = sel.page(c, sel.FilterSpec(tags={"doctype": ["en"]}, cursor=200))
    rows = [(r["file_id"], r["name"], p.total, p.next) for r in p.items]
    return c.file.sparkSession.createDataFrame(rows, "file_id long, name string, total long, next long")


@query(""", k AS (SELECT DISTINCT kind, name FROM asset_tag), a AS (SELECT *, row_number() OVER (ORDER BY kind, name) AS id FROM k WHERE kind IN ('author', 'entity'))
  SELECT * FROM a UNION ALL SELECT *, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY kind, name) FROM k WHERE kind NOT IN ('author', 'entity')""")
def tag_ids(c):
    """Ids of tags after two loads: the second numbers on, and a third, of the same tags, changes nothing."""
    none = c.file.sparkSession.createDataFrame([], "kind string, name string, id long")
    first = reconcile.with_ids(none, c.asset_tag.filter("kind IN ('author', 'entity')"), ["kind", "name"])
    second = reconcile.with_ids(first, c.asset_tag, ["kind", "name"])
    return reconcile.with_ids(second, c.asset_tag, ["kind", "name"])


@query("""SELECT DISTINCT 'w' || g % 7 AS workspace_id, file_id FROM indexed JOIN (SELECT unnest(range(600)) AS g) ON root = 'src' || g % 20 AND starts_with(rel_path, 'src' || g % 20 || '/' || ['en', 'de/doc_1', '', 'fr/doc_'][1 + g % 4])
  WHERE (g % 3 > 0 OR media_type = 'document') AND (g % 5 > 0 OR asset_id IN (SELECT asset_id FROM asset_tag WHERE source <> 'user' AND name IN ('topic1', 'author3', '2012'))) AND NOT (g % 2 = 0 AND asset_id IN (SELECT asset_id FROM asset_tag WHERE source <> 'user' AND name IN ('topic4', 'url')))""")
def granted_files(c):
    """What 600 grants of seven workspaces show: paths meet their prefixes by an equi-join, exclusions by an anti-join."""
    spark = c.file.sparkSession
    g = F.col("id")
    root = F.concat(F.lit("src"), (g % 20).cast("string"))
    none = F.array().cast("array<string>")
    grants = spark.range(600).select(
        F.concat(F.lit("w"), (g % 7).cast("string")).alias("workspace_id"), root.alias("library_id"), F.array(F.concat(root, F.lit("/"), F.get(F.array(*map(F.lit, ("en", "de/doc_1", "", "fr/doc_"))), (g % 4).cast("int")))).alias("path_prefixes"),
        F.when(g % 5 == 0, F.array(*map(F.lit, ("topic1", "author3", "2012")))).otherwise(none).alias("include_tags"), F.when(g % 2 == 0, F.array(*map(F.lit, ("topic4", "url")))).otherwise(none).alias("exclude_tags"), F.when(g % 3 == 0, F.array(F.lit("document"))).otherwise(none).alias("media_types"),
    )
    files = c.indexed.withColumn("library_id", F.col("root"))
    tags = files.select("file_id", "asset_id").join(c.asset_tag.filter("source <> 'user'"), "asset_id").select("file_id", "name")
    return tenancy.visible(files, tags, grants).select("workspace_id", "file_id")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'no customer' WHEN o_totalprice >= 200000 THEN 'too dear' END AS error FROM orders""", catalogue=False)
def quarantined_orders(spark, sf_dir):
    """Orders through a stream whose sink puts rows that break a rule aside; the stream runs twice and each row comes once."""
    out = scratch(spark, "quarantine")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("customer"), F.col("o_totalprice").cast("double").alias("price"))
    o.repartition(4).write.parquet(f"{out}/in")
    step = streams.quarantined({"no customer": F.col("customer").isNotNull(), "too dear": F.col("price") < 200_000}, f"{out}/sink")
    for _ in range(2):
        streams.ingest(spark, f"{out}/in", "id long, customer long, price double", f"{out}/state", step, files_per_trigger=1)
    return streams.committed(spark, f"{out}/sink").select("id", F.lit(None).cast("string").alias("error")).unionByName(streams.committed(spark, f"{out}/sink", "errors").select("id", "error"))
