"""Every catalogue query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import classify, colour, patterns, people
from granary.functions import text as tx
from granary.operators import digest, facets, graph, reconcile, review, tenancy, text_index
from granary.operators import selection as sel
from granary.operators.selection import ColourRule, FilterSpec, Scope
from granary.plans import catalog as cat
from granary.session import table
from granary.streaming import streams

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None, catalogue: bool = True):
    """Register a function of a catalogue (or of spark and folder) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(cat.from_documents(spark, sf_dir))) if catalogue else f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {cat.SQL}{sql}" if catalogue else sql
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- the filter rail

FACETS = "SELECT kind, name, count(DISTINCT asset_id) AS n FROM asset_tag WHERE asset_id IN (SELECT asset_id FROM indexed) GROUP BY kind, name"


@query(FACETS)
def facet_counts(c):
    return cat.tag_facet_view(c)


@query(f"SELECT kind, name, n, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS place FROM ({FACETS})) WHERE place <= CASE WHEN kind IN ('doctype','topic','author','date','custom') THEN 40 ELSE 16 END")
def facet_topk_per_axis(c):
    return _long(facets.facet_rail(c), "place")


CONDITION = FilterSpec(tags={"doctype": ["en", "fr"]}, size="small")
CONDITION_SQL = "SELECT * FROM indexed WHERE size_bytes >= 102400 AND size_bytes < 2097152 AND asset_id IN (SELECT asset_id FROM asset_tag WHERE kind = 'doctype' AND name IN ('en', 'fr'))"


@query(f"SELECT kind, name, n, place FROM (SELECT kind, name, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS place FROM (SELECT t.kind, t.name, count(*) AS n FROM ({CONDITION_SQL}) f JOIN (SELECT DISTINCT asset_id, kind, name FROM asset_tag) t USING (asset_id) GROUP BY t.kind, t.name)) WHERE place <= 16")
def facet_conditioned(c):
    return _long(facets.conditioned(c, sel.selection(c, CONDITION)), "place")


@query("SELECT media_type, count(*) AS n FROM indexed GROUP BY media_type")
def media_counts(c):
    return facets.media_counts(c.indexed)


@query("SELECT bucket, count(DISTINCT asset_id) AS n, arg_max(hex, (proportion, hex)) AS swatch FROM color WHERE rank <= 2 GROUP BY bucket")
def colour_counts(c):
    return facets.colour_counts(c)


BAND = "CASE WHEN size_bytes < 102400 THEN 'tiny' WHEN size_bytes < 2097152 THEN 'small' WHEN size_bytes < 52428800 THEN 'medium' WHEN size_bytes < 524288000 THEN 'large' ELSE 'huge' END"


@query(f"SELECT {BAND} AS band, count(*) AS n, min(size_bytes) AS least FROM indexed GROUP BY 1")
def size_bands(c):
    return facets.size_bands(c.indexed)


@query("SELECT state, count(*) AS n FROM file GROUP BY state")
def state_counts(c):
    return cat.state_counts(c)


DUPLICATES = "SELECT asset_id, count(*) AS copies, CAST(sum(size_bytes) - min(size_bytes) AS BIGINT) AS reclaimable FROM indexed GROUP BY asset_id HAVING count(*) > 1"


@query(DUPLICATES)
def duplicate_groups(c):
    return cat.duplicate_groups(c)


@query(f"SELECT count(*) AS groups, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS bytes FROM ({DUPLICATES})")
def reclaimable_total(c):
    return facets.reclaimable(cat.duplicate_groups(c))


@query("SELECT count(*) AS n FROM indexed WHERE asset_id NOT IN (SELECT asset_id FROM asset_tag WHERE kind = 'topic')")
def unclassified(c):
    return facets.unclassified(c)


@query("SELECT root, count(*) AS files, count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'error') AS failed, CAST(sum(CASE WHEN state = 'indexed' THEN size_bytes ELSE 0 END) AS BIGINT) AS bytes FROM file GROUP BY root")
def libraries(c):
    return facets.libraries(c)


# --- selections

F_COLS = ("file_id", "rel_path", "asset_id")
F_SQL = "SELECT file_id, rel_path, asset_id FROM"


def _tag_in(kind: str, *names: str) -> str:
    return f"asset_id IN (SELECT asset_id FROM asset_tag WHERE kind = '{kind}' AND name IN ({', '.join(repr(n) for n in names)}))"


@query(f"{F_SQL} indexed WHERE {_tag_in('topic', 'topic1', 'topic2')} AND {_tag_in('author', 'author3')} AND {_tag_in('doctype', 'en', 'de')}")
def filter_axes(c):
    """(topic1 or topic2) and author3 and (en or de)."""
    return sel.selection(c, FilterSpec(tags={"topic": ["topic1", "topic2"], "author": ["author3"], "doctype": ["en", "de"]})).select(*F_COLS)


@query(f"{F_SQL} indexed WHERE asset_id IN (SELECT asset_id FROM asset_tag WHERE name IN ('toxic', 'url'))")
def filter_tag_any(c):
    return sel.selection(c, FilterSpec(any_tag=["toxic", " URL "])).select(*F_COLS)


@query(f"{F_SQL} indexed WHERE media_type = 'document' AND ext = 'pdf' AND size_bytes >= 102400 AND size_bytes < 2097152 AND root = 'src1'")
def filter_plain(c):
    return sel.selection(c, FilterSpec.parse({"type": "document", "ext": ".PDF", "size": "small", "root": ["src1", "src2"]})).select(*F_COLS)


@query(f"{F_SQL} indexed WHERE asset_id IN (SELECT asset_id FROM color WHERE bucket = 'blue' AND rank <= 2)")
def filter_colour(c):
    return sel.selection(c, FilterSpec(color="blue")).select(*F_COLS)


TOKENS = "regexp_extract_all(strip_accents(lower(body)), '[\\p{L}\\p{N}]+')"


@query(f"{F_SQL} indexed WHERE contains(lower(name), 'then') OR asset_id IN (SELECT asset_id FROM asset_tag WHERE contains(lower(name), 'then')) OR asset_id IN (SELECT asset_id FROM text_block WHERE list_contains({TOKENS}, 'then'))")
def search_q_or(c):
    return sel.selection(c, FilterSpec(q="then")).select(*F_COLS)


@query("SELECT file_id, name, size_bytes FROM indexed WHERE file_id > 200 ORDER BY file_id LIMIT 121")
def library_page_keyset(c):
    return sel.keyset_page(c, FilterSpec.parse({"cursor": "200"})).select("file_id", "name", "size_bytes")


@query("SELECT file_id, name FROM indexed ORDER BY size_bytes DESC, file_id LIMIT 120 OFFSET 120")
def library_page_offset(c):
    return c.indexed.orderBy(F.desc("size_bytes"), "file_id").offset(120).limit(120).select("file_id", "name")


@query("SELECT file_id, tint, copies FROM indexed LEFT JOIN (SELECT asset_id, hex AS tint FROM color WHERE rank = 0) USING (asset_id) LEFT JOIN (SELECT asset_id, count(*) AS copies FROM file GROUP BY asset_id) USING (asset_id)")
def tint_and_copies(c):
    return facets.tint(c, c.indexed).select("file_id", "tint", "copies")


@query("SELECT asset_id, kind, name, confidence, by_user, sources FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY by_user DESC, confidence DESC, kind, name) AS k FROM (SELECT asset_id, kind, name, CAST(max(confidence) AS DOUBLE) AS confidence, bool_or(source = 'user') AS by_user, string_agg(source, ',') AS sources FROM asset_tag GROUP BY ALL)) WHERE k <= 60")
def detail_tags(c):
    return facets.detail_tags(c)


@query("SELECT asset_id, min(name) AS name, min(rel_path) AS rel_path, min(media_type) AS media_type, min(size_bytes) AS size_bytes, count(*) AS copies, min(file_id) * 100 AS event_at FROM indexed WHERE " + _tag_in("doctype", "en") + " GROUP BY asset_id ORDER BY event_at DESC NULLS LAST, name, asset_id LIMIT 400")
def selection_per_asset(c):
    events = c.indexed.groupBy("asset_id").agg((F.min("file_id") * 100).alias("event_at"))
    return facets.per_content(sel.selection(c, FilterSpec(tags={"doctype": ["en"]})), events)


@query("SELECT (SELECT count(*) FROM indexed) AS files, (SELECT count(DISTINCT asset_id) FROM indexed) AS contents, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM indexed) AS bytes, (SELECT count(DISTINCT root) FROM indexed) AS libraries, (SELECT count(*) FROM (SELECT DISTINCT kind, name FROM asset_tag WHERE asset_id IN (SELECT asset_id FROM indexed))) AS tags")
def workspace_summary(c):
    return facets.workspace_summary(c, c.indexed)


@query("SELECT i.file_id, i.name, i.root, a.size_bytes AS content_bytes, a.media_type, i.state FROM file i JOIN (SELECT asset_id, min(size_bytes) AS size_bytes, min(media_type) AS media_type FROM file GROUP BY asset_id) a USING (asset_id)")
def v_library(c):
    a = c.asset.select("asset_id", F.col("size_bytes").alias("content_bytes"), "media_type")
    return c.file.drop("media_type").join(a, "asset_id", "left").select("file_id", "name", "root", "content_bytes", "media_type", "state")


# --- text

def inverted_index_postings(c):
    """Postings grouped where their text stands; no word is shuffled."""
    return text_index.postings_of(c.text_block, "asset_id").select(F.col("key").alias("asset_id"), "term", "tf", "len")


@query(f"SELECT asset_id, word AS term, CAST(count(*) AS BIGINT) AS tf, len FROM (SELECT asset_id, unnest({TOKENS}) AS word, CAST(len({TOKENS}) AS BIGINT) AS len FROM text_block) GROUP BY ALL HAVING count(*) >= 20")
def inverted_index_heavy(c):
    """Postings of frequent terms in their documents, as its SQL says; ``inverted_index`` has all of them."""
    return inverted_index_postings(c).filter("tf >= 20")


@query(f"SELECT asset_id, word AS term, CAST(count(*) AS BIGINT) AS tf, len FROM (SELECT asset_id, unnest({TOKENS}) AS word, CAST(len({TOKENS}) AS BIGINT) AS len FROM text_block) GROUP BY ALL")
def inverted_index(c):
    """The whole index: every posting of every term over all text blocks."""
    return inverted_index_postings(c)


@query(f"""SELECT asset_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM (
  SELECT h.*, count(*) OVER (PARTITION BY term) AS df, s.n, s.mean FROM (SELECT asset_id, len, term, count(*) AS tf FROM (SELECT asset_id, len({TOKENS}) AS len, unnest({TOKENS}) AS term FROM text_block) WHERE term IN ('then', 'other', 'and') GROUP BY ALL) h,
  (SELECT count(*) AS n, avg(len({TOKENS})) AS mean FROM text_block) s) GROUP BY asset_id HAVING count(*) = 2""".replace("'then', 'other', 'and'", "'then', 'and'"))
def bm25_search(c):
    """From the stored index: no text is read."""
    return c.text_index.bm25(["then", "and"]).select(F.col("key").alias("asset_id"), F.round("score", 4).alias("score"))


@query(f"""SELECT asset_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM (
  SELECT h.*, count(*) OVER (PARTITION BY term) AS df, s.n, s.mean FROM (SELECT asset_id, len, term, count(*) AS tf FROM (SELECT asset_id, len({TOKENS}) AS len, unnest({TOKENS}) AS term FROM text_block) WHERE term IN ('then', 'and') GROUP BY ALL) h,
  (SELECT count(*) AS n, avg(len({TOKENS})) AS mean FROM text_block) s) GROUP BY asset_id HAVING count(*) = 2""")
def bm25_scan(c):
    """The same without an index: one scan of the texts."""
    return tx.bm25(c.text_block, ["then", "and"]).select("asset_id", F.round("score", 4).alias("score"))


@query(r"""SELECT asset_id, word, n, round(n / peak, 3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, first) AS k, max(n) OVER (PARTITION BY asset_id) AS peak FROM (
  SELECT asset_id, word, count(*) AS n, min(pos) AS first FROM (SELECT asset_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT asset_id, regexp_extract_all(lower(substr(body, 1, 200000)), '[\p{L}\p{N}_-]+') AS t FROM text_block WHERE length(body) >= 200))
  WHERE length(word) >= 4 AND NOT regexp_matches(word, '^\p{N}') AND word NOT IN (STOP) GROUP BY ALL HAVING count(*) >= 2)) WHERE k <= 12""".replace("STOP", ", ".join(repr(w) for w in tx.STOPWORDS)))
def keywords_topn(c):
    """Bounded as in its SQL; ``keywords_whole`` has no bounds."""
    return tx.keywords(c.text_block, scan=200_000, least_chars=200)


@query(r"""SELECT asset_id, word, n, round(n / peak, 3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, first) AS k, max(n) OVER (PARTITION BY asset_id) AS peak FROM (
  SELECT asset_id, word, count(*) AS n, min(pos) AS first FROM (SELECT asset_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT asset_id, regexp_extract_all(lower(body), '[\p{L}\p{N}_-]+') AS t FROM text_block))
  WHERE length(word) >= 4 AND NOT regexp_matches(word, '^\p{N}') AND word NOT IN (STOP) GROUP BY ALL HAVING count(*) >= 2)) WHERE k <= 12""".replace("STOP", ", ".join(repr(w) for w in tx.STOPWORDS)))
def keywords_whole(c):
    """Keywords of whole texts of any length."""
    return tx.keywords(c.text_block)


@query("SELECT file_id, 'doc_' || (file_id % 50) AS stem FROM file")
def name_stems(c):
    """Stems of names that bear marks of versions and copies, one or several."""
    return c.file.select("file_id", tx.name_stem(_marked(c)).alias("stem"))


def _marked(c):
    marks = F.get(F.array(F.lit("_v2"), F.lit(" (1)"), F.lit("_final_v2"), F.lit("")), (F.col("file_id") % 4).cast("int"))
    return F.concat(F.lit("doc_"), (F.col("file_id") % 50).cast("string"), marks, F.lit("."), F.col("ext"))


#: Detectors whose patterns both engines read alike over these texts: no look-arounds, no word edges beside letters with marks.
ALIKE = ("blank-field", "log-line", "clause-numbering", "ip-address", "percentage", "url", "money", "table-row", "severity-level")
_LIKE = [d for d in patterns.DETECTORS if d.name in ALIKE]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{d.name}' AS pattern, CAST(len(regexp_extract_all(text, '(?{d.flags or 's'})" + d.regex.replace("'", "''") + f"')) AS BIGINT) AS n, {d.least} AS least FROM documents" for d in _LIKE) + ") WHERE n >= least", catalogue=False)
def pattern_hits(spark, sf_dir):
    """The detectors themselves, as far as SQL reads their patterns alike."""
    d = table(spark, sf_dir, "documents", spread=True)
    found = patterns.hits(F.col("text"), F.lit(""), detectors=_LIKE)
    least = F.create_map(*[F.lit(x) for k in _LIKE for x in (k.name, k.least)])
    return d.select("doc_id", F.explode(found).alias("h")).select("doc_id", F.col("h.name").alias("pattern"), "h.n", least[F.col("h.name")].alias("least"))


@query(catalogue=False)
def pattern_detect(spark, sf_dir):
    """All detectors over whole documents; look-arounds have no SQL twin."""
    d = table(spark, sf_dir, "documents", spread=True)
    return d.select("doc_id", F.explode(patterns.hits(F.col("text"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))).alias("h")).select("doc_id", "h.name", "h.n")


MONEY_TEXT = "'total $' || p_size || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.50 and ' || p_partkey || '.25 EUR'"


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'USD' AS currency, 1::BIGINT AS count, p_size * 1000 + p_partkey % 1000 + 0.5::DOUBLE AS max, p_size * 1000 + p_partkey % 1000 + 0.5::DOUBLE AS sum FROM part UNION ALL SELECT p_partkey, 'EUR', 1, p_partkey + 0.25::DOUBLE, p_partkey + 0.25::DOUBLE FROM part", catalogue=False)
def money_by_currency(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("text", F.format_string("total $%d,%03d.50 and %d.25 EUR", F.col("p_size"), (F.col("p_partkey") % 1000).cast("int"), F.col("p_partkey")))
    return patterns.money_amounts(p, "p_partkey", "text")


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 86400 + 43200 AS at, CAST(year(o_orderdate) AS INT) AS year FROM orders", catalogue=False)
def dates_found(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("text", F.concat(F.lit("Ordered on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(".")))
    at = patterns.modal(patterns.dates(F.col("text")))
    return o.select("o_orderkey", at.alias("at"), F.year(F.timestamp_seconds(at)).alias("year"))


@query("SELECT s_suppkey, replace(s_name, '#', '') || ' Holdings' AS org FROM supplier", catalogue=False)
def organisations_found(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("text", F.concat(F.lit("an order from "), F.regexp_replace("s_name", "#", ""), F.lit(" Holdings, paid")))
    return s.select("s_suppkey", F.get(people.organisations(F.col("text")), F.lit(0)).alias("org"))


def _evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents", spread=True)
    none = F.lit(None).cast("long")
    return d.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("txt").alias("ext"), F.lit("document").alias("media_type"), "text", F.create_map().cast("map<string,string>").alias("meta"), none.alias("captured_at"), none.alias("created_at"), none.alias("modified_at"))


#: What some documents say beside their text, so that the vocabulary has something to find.
SAID = ("Invoice number 7, amount due; the INVOICE is net 30.", "Thank you for your purchase: receipt, refund and receipt.", "boarding pass and flight number, flight to the airport, hotel", "")
_TERMS = sorted({t.lower() for kind in classify.VOCABULARY.values() for cat_ in kind.values() for t in (*cat_[0], *cat_[1])})
_LEX = [(axis, c, t.lower(), w) for axis, cats in classify.VOCABULARY.items() for c, v in cats.items() for w, names in ((classify.STRONG, v[0]), (classify.TERM, v[1])) for t in names]
_CUES = [(axis, c, t.lower()) for axis, cats in classify.VOCABULARY.items() for c, v in cats.items() for t in v[2]]
_EXTS = [(axis, c, t.lower()) for axis, cats in classify.VOCABULARY.items() for c, v in cats.items() for t in v[3]]
_q = lambda x: "'" + str(x).replace("'", "''") + "'"
_values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


LEXICON_SQL = rf"""WITH d AS (SELECT doc_id AS file_id, lower(text || ' ' || [@SAID@][1 + doc_id % @N@]) AS low, 'doc_' || doc_id || '.txt' AS name FROM documents),
 w AS (SELECT file_id, regexp_extract_all(low, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]+') AS t FROM d),
 g AS (SELECT file_id, unnest(flatten([list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' ')) for n in range(1, 6)])) AS term FROM w),
 h AS (SELECT file_id, term, count(*) AS n FROM g WHERE term IN ({', '.join(map(_q, _TERMS))}) GROUP BY ALL),
 s AS (SELECT file_id, axis, category, weight * least(n, {classify.TERM_CAP}) AS score FROM h JOIN {_values(_LEX)} v(axis, category, term, weight) USING (term)
   UNION ALL SELECT file_id, axis, category, {classify.CUE} FROM d JOIN {_values(_CUES)} v(axis, category, term) ON contains(name, term)
   UNION ALL SELECT file_id, axis, category, {classify.EXT} FROM d JOIN {_values(_EXTS)} v(axis, category, term) ON term = 'txt')
 SELECT file_id, axis, category, CAST(sum(score) AS DOUBLE) AS score FROM s GROUP BY ALL"""


@query(LEXICON_SQL.replace("@SAID@", ", ".join(map(_q, SAID))).replace("@N@", "4"), catalogue=False)
def lexicon_scores(spark, sf_dir):
    """Vocabulary hits over whole documents, to each of which a sentence of the vocabulary's kind is added."""
    e = _evidence(spark, sf_dir)
    said = F.get(F.array(*[F.lit(x) for x in SAID]), (F.col("file_id") % 4).cast("int"))
    return classify.lexicon_scores(e.withColumn("text", F.concat_ws(" ", "text", said)), classify.lexicon(spark)).drop("place")


#: A sentence of the strong terms of every category, so that each has its documents.
SAID_ALL = [", ".join(t for t in v[0] if t.replace(" ", "").isalnum()) + ". " + "; ".join(v[1][:3]) for cats in classify.VOCABULARY.values() for v in cats.values()]


@query(LEXICON_SQL.replace("@SAID@", ", ".join(map(_q, SAID_ALL))).replace("@N@", str(len(SAID_ALL))), catalogue=False)
def lexicon_categories(spark, sf_dir):
    """Vocabulary hits where each document also says a sentence of one of all categories in turn."""
    e = _evidence(spark, sf_dir)
    said = F.get(F.array(*[F.lit(x) for x in SAID_ALL]), (F.col("file_id") % len(SAID_ALL)).cast("int"))
    return classify.lexicon_scores(e.withColumn("text", F.concat_ws(" ", "text", said)), classify.lexicon(spark)).drop("place")


FOUND = """f AS (SELECT c_custkey AS k, ['invoice', 'log', NULL][1 + c_custkey % 3] AS doctype, (c_custkey % 50) * 1.5 AS ds, ['finance', NULL, 'hr', 'legal'][1 + c_custkey % 4] AS topic, (c_custkey % 37) * 2.5 AS ts,
  CASE WHEN c_custkey % 5 > 0 THEN 'P' || (c_custkey % 12) END AS author, ['metadata', 'id3', 'signature', 'byline', 'filename', 'email', 'elsewhere'][1 + c_custkey % 7] AS source, c_custkey % 4 AS n1, c_custkey % 3 AS n2 FROM customer)"""


@query(f"""WITH {FOUND} SELECT k, kind, name, confidence::DOUBLE AS confidence FROM (
  SELECT k, 'doctype' AS kind, doctype AS name, round(least(1.0, 0.4 + ds / 60), 3) AS confidence FROM f UNION ALL SELECT k, 'topic', topic, round(least(1.0, 0.4 + ts / 60), 3) FROM f
  UNION ALL SELECT k, 'author', author, CASE source WHEN 'metadata' THEN 0.95 WHEN 'id3' THEN 0.95 WHEN 'signature' THEN 0.8 WHEN 'byline' THEN 0.8 WHEN 'filename' THEN 0.6 ELSE 0.5 END FROM f
  UNION ALL SELECT k, 'topic', unnest(['a', 'b', 'c']), 0.4 FROM f UNION ALL SELECT k, 'date', unnest(['2015', '2016', '2017', '2018', '2019', '2020']), 0.9 FROM f UNION ALL SELECT k, 'pattern', unnest(['money', 'url']), 1.0 FROM f
  UNION ALL SELECT k, 'entity', 'Org' || unnest(range(8)), 0.7 FROM f UNION ALL SELECT k, 'entity', p, 0.6 FROM (SELECT k, author, 'P' || unnest(range(8)) AS p FROM f) WHERE p IS DISTINCT FROM author) WHERE name IS NOT NULL""", catalogue=False)
def finding_tags(spark, sf_dir):
    """The tags of verdicts with their confidences: people are entities, but not the author; further topics, years and names have their limits."""
    f = _findings(spark, sf_dir)
    each = lambda prefix, n: F.array(*[F.lit(f"{prefix}{i}") for i in range(n)])
    return classify.findings_to_tags(f.withColumns({"topic_others": F.array(*map(F.lit, "abcd")), "years": F.sequence(F.lit(2015), F.lit(2022)), "patterns": F.array(F.lit("money"), F.lit("url")), "entities": each("Org", 10), "people": each("P", 9)}), key="k")


def _findings(spark, sf_dir):
    """Verdicts read off the customers."""
    k = F.col("c_custkey")
    of = lambda *names: F.get(F.array(*[F.lit(x) for x in names]), (k % len(names)).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), of("invoice", "log", None).alias("doctype"), ((k % 50) * 1.5).alias("doctype_score"), of("finance", None, "hr", "legal").alias("topic"), ((k % 37) * 2.5).alias("topic_score"), F.when(k % 5 > 0, F.concat(F.lit("P"), k % 12)).alias("author"),
        of("metadata", "id3", "signature", "byline", "filename", "email", "elsewhere").alias("author_source"), F.array(F.struct(F.lit("url").alias("name"), (k % 4).alias("n")), F.struct(F.lit("nothing").alias("name"), F.lit(9).cast("long").alias("n")), F.struct(F.lit("money").alias("name"), (k % 3).alias("n"))).alias("hits"),
    )


@query(f"""WITH {FOUND}, g AS (SELECT *, CASE doctype WHEN 'invoice' THEN 'Invoice' WHEN 'log' THEN 'Log' END AS a, CASE topic WHEN 'finance' THEN 'finance' WHEN 'hr' THEN 'people & hr' WHEN 'legal' THEN 'legal' END AS b,
  list_filter([CASE WHEN n1 >= n2 AND n1 > 0 THEN 'web links' END, CASE WHEN n2 > 0 THEN 'currency figures appear in the text' END, CASE WHEN n1 < n2 AND n1 > 0 THEN 'web links' END, CASE WHEN author IS NOT NULL THEN 'author from ' || source END], lambda x: x IS NOT NULL) AS why FROM f)
  SELECT k, coalesce(a || ' (' || b || ')', a, b, 'no confident classification') || ' -- ' || CASE WHEN len(why) > 0 THEN array_to_string(why, '; ') ELSE 'txt with no distinctive content' END AS reasoning FROM g""", catalogue=False)
def verdict_reasons(spark, sf_dir):
    """The line that says why: both labels, what the most frequent patterns found, and where the author is from."""
    hits = F.filter("hits", lambda h: h["n"] > 0)
    source = F.when(F.col("author").isNotNull(), F.col("author_source"))
    return _findings(spark, sf_dir).select("k", classify.reasoning(F.col("doctype"), F.col("topic"), hits, source, F.lit("txt")).alias("reasoning"))


@query(catalogue=False)
def inspect_documents(spark, sf_dir):
    """Verdicts over whole documents; the office texts of the tests pin the values."""
    return classify.inspect(_evidence(spark, sf_dir)).drop("hits")


# --- graphs

NODES = "SELECT kind, name, n FROM (SELECT *, list_position(['topic','doctype','author','custom','pattern','entity','date'], kind) AS o, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS k FROM (SELECT kind, name, count(DISTINCT asset_id) AS n FROM asset_tag WHERE asset_id IN (SELECT asset_id FROM indexed) AND kind IN ('topic','doctype','author','custom','pattern','entity','date') GROUP BY kind, name)) WHERE k <= 12 ORDER BY o, n DESC, name LIMIT 60"
EDGES = f"""SELECT a.kind || ':' || a.name AS source, b.kind || ':' || b.name AS target, count(*) AS weight, round(count(*) / least(a.n, b.n), 4) AS strength, a.n AS n_source, b.n AS n_target
  FROM (SELECT DISTINCT asset_id, t.kind, t.name, n FROM asset_tag t JOIN ({NODES}) USING (kind, name) WHERE asset_id IN (SELECT asset_id FROM indexed)) a
  JOIN (SELECT DISTINCT asset_id, t.kind, t.name, n FROM asset_tag t JOIN ({NODES}) USING (kind, name) WHERE asset_id IN (SELECT asset_id FROM indexed)) b ON a.asset_id = b.asset_id AND (b.kind, b.name) > (a.kind, a.name)
  GROUP BY a.kind, a.name, b.kind, b.name, a.n, b.n HAVING count(*) >= 2"""


@query(NODES)
def graph_nodes(c):
    return graph.tag_nodes(c.asset_tag, c.indexed)


@query(f"{EDGES} ORDER BY strength DESC, weight DESC, source, target LIMIT 240")
def graph_edges(c):
    return graph.tag_edges(c.asset_tag, c.indexed, graph.tag_nodes(c.asset_tag, c.indexed))


DAG = f"SELECT CASE WHEN n_source > n_target OR (n_source = n_target AND source < target) THEN source ELSE target END AS parent, CASE WHEN n_source > n_target OR (n_source = n_target AND source < target) THEN target ELSE source END AS child, weight / least(n_source, n_target) AS share FROM ({EDGES}) WHERE weight / least(n_source, n_target) >= 0.3"


def _dag(c):
    return graph.containment(graph.tag_edges(c.asset_tag, c.indexed, graph.tag_nodes(c.asset_tag, c.indexed), most=None), 0.3)


@query(f"SELECT parent, child, round(share, 6) AS share FROM ({DAG})")
def containment_edges(c):
    return _dag(c).select("parent", "child", F.round("share", 6).alias("share"))


# three levels of a part hierarchy: size within brand within maker
HIER = "SELECT DISTINCT p_brand AS parent, p_brand || '/' || p_type AS child FROM part UNION SELECT DISTINCT p_brand || '/' || p_type, p_brand || '/' || p_type || '/' || p_size FROM part UNION SELECT DISTINCT p_brand, p_brand || '/' || p_type || '/' || p_size FROM part WHERE p_size % 2 = 0"


def _hier(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mid, low = F.concat_ws("/", "p_brand", "p_type"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))
    e = lambda a, b, f: f.select(a.alias("parent"), b.alias("child"))
    return e(F.col("p_brand"), mid, p).union(e(mid, low, p)).union(e(F.col("p_brand"), low, p.filter("p_size % 2 = 0"))).distinct()


@query(f"WITH h AS ({HIER}) SELECT parent, child FROM h e WHERE NOT EXISTS (SELECT 1 FROM h x JOIN h y ON x.child = y.parent WHERE x.parent = e.parent AND y.child = e.child)", catalogue=False)
def reduced_dag(spark, sf_dir):
    return graph.reduced(_hier(spark, sf_dir))


@query(f"WITH RECURSIVE h AS ({HIER}), w AS (SELECT node, 0 AS depth FROM (SELECT parent AS node FROM h UNION SELECT child FROM h) UNION SELECT h.child, w.depth + 1 FROM w JOIN h ON h.parent = w.node) SELECT node, CAST(max(depth) AS INT) AS depth FROM w GROUP BY node", catalogue=False)
def dag_depths(spark, sf_dir):
    return graph.depths(_hier(spark, sf_dir))


IDF = "SELECT kind, name, count(*) AS df, ln((SELECT count(DISTINCT asset_id) FROM asset_tag) / count(*)) AS idf FROM (SELECT DISTINCT asset_id, kind, name FROM asset_tag) GROUP BY kind, name"


@query(f"SELECT kind, name, df, round(idf, 6) AS idf FROM ({IDF})")
def tag_idf(c):
    return graph.tag_idf(c.asset_tag).withColumn("idf", F.round("idf", 6))


KNN = f"""SELECT a, b, max(shared) AS shared, CAST(least(greatest(round(255 * max(sim)), 1), 255) AS BIGINT) AS weight FROM (
 SELECT *, row_number() OVER (PARTITION BY own ORDER BY round(sim, 9) DESC, other) AS k FROM (
  SELECT a, b, sim, shared, unnest([a, b]) AS own, unnest([b, a]) AS other FROM (
   SELECT p.a, p.b, p.shared, p.dot / (x.norm * y.norm) AS sim FROM (
     SELECT l.asset_id AS a, r.asset_id AS b, sum(l.idf * l.idf) AS dot, count(*) AS shared FROM w l JOIN w r ON l.kind = r.kind AND l.name = r.name AND l.asset_id < r.asset_id GROUP BY 1, 2 HAVING count(*) >= 2) p
   JOIN m x ON x.asset_id = p.a JOIN m y ON y.asset_id = p.b) WHERE sim >= 0.35)) WHERE k <= 5 GROUP BY a, b"""


@query(f", w AS (SELECT DISTINCT t.asset_id, t.kind, t.name, i.idf FROM asset_tag t JOIN ({IDF}) i USING (kind, name) WHERE i.df <= 0.25 * (SELECT count(DISTINCT asset_id) FROM asset_tag)), m AS (SELECT asset_id, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY asset_id) {KNN}")
def knn_edges(c):
    return graph.nearest(c.asset_tag)


@query(f"""SELECT count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM ({EDGES}) WHERE starts_with(source, 'author') AND starts_with(target, 'topic')""")
def induced_edges(c):
    e = graph.tag_edges(c.asset_tag, c.indexed, graph.tag_nodes(c.asset_tag, c.indexed), most=None)
    n = c.asset_tag.filter("kind IN ('author', 'topic')").select(F.concat_ws(":", "kind", "name").alias("node")).distinct()
    return graph.induced(e, n, "source", "target").filter("startswith(source, 'author') AND startswith(target, 'topic')").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query(f""", w AS (SELECT DISTINCT t.asset_id, t.kind, t.name, i.idf FROM asset_tag t JOIN ({IDF}) i USING (kind, name)), m AS (SELECT asset_id, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY asset_id), q AS (SELECT asset_id AS id FROM file ORDER BY file_id LIMIT 1)
  SELECT asset_id, round(score, 4) AS score, through FROM (SELECT r.asset_id, sum(l.idf * l.idf) / (any_value(x.norm) * any_value(y.norm)) AS score, arg_max(l.name, (l.idf, l.name)) AS through FROM w l JOIN q ON l.asset_id = q.id JOIN w r ON l.kind = r.kind AND l.name = r.name AND r.asset_id <> q.id JOIN m x ON x.asset_id = q.id JOIN m y ON y.asset_id = r.asset_id GROUP BY r.asset_id)
  WHERE score > 0 ORDER BY round(score, 9) DESC, asset_id LIMIT 8""")
def related_files(c):
    """The contents most like that of the first file."""
    return graph.related(c.asset_tag, c.file.orderBy("file_id").first()["asset_id"])


# --- scans: orders before and after

def _before(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    path = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    return o.select(F.lit("r").alias("root"), path.alias("rel_path"), path.alias("name"), F.lit("txt").alias("ext"), F.col("o_custkey").alias("size_bytes"), F.col("o_orderkey").alias("mtime_ns"), F.md5(path.cast("binary")).alias("asset_id"), F.when(F.col("o_orderkey") % 11 == 0, "missing").otherwise("indexed").alias("state"), F.lit(1).alias("attempts"), F.lit(100).alias("priority"), F.lit(1).cast("long").alias("last_scan_id"))


def _listing(spark, sf_dir):
    """Every fifth path is gone; of these every third is found under a new name; every ninth is larger."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0")
    path = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "new/o").otherwise("o"), F.col("o_orderkey").cast("string"))
    size = F.col("o_custkey") + F.when(F.col("o_orderkey") % 9 == 0, F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(1000000)).otherwise(0)
    return o.select(F.lit("r").alias("root"), path.alias("rel_path"), path.alias("name"), F.lit("txt").alias("ext"), size.alias("size_bytes"), F.col("o_orderkey").alias("mtime_ns"))


SCAN = """WITH before AS (SELECT 'o' || o_orderkey AS rel_path, o_custkey AS size_bytes, o_orderkey AS mtime_ns, md5('o' || o_orderkey) AS asset_id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'indexed' END AS state FROM orders WHERE o_orderkey % 7 <> 0),
listing AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'new/o' ELSE 'o' END || o_orderkey AS rel_path, o_custkey + CASE WHEN o_orderkey % 9 = 0 AND o_orderkey % 5 <> 0 THEN 1000000 ELSE 0 END AS size_bytes, o_orderkey AS mtime_ns FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0),
scanned AS (SELECT coalesce(b.rel_path, l.rel_path) AS rel_path, coalesce(l.size_bytes, b.size_bytes) AS size_bytes, coalesce(l.mtime_ns, b.mtime_ns) AS mtime_ns,
  CASE WHEN l.rel_path IS NOT NULL AND (b.rel_path IS NULL OR b.size_bytes <> l.size_bytes) THEN NULL ELSE b.asset_id END AS asset_id,
  CASE WHEN l.rel_path IS NOT NULL AND (b.rel_path IS NULL OR b.size_bytes <> l.size_bytes OR b.state = 'missing') THEN 'queued' ELSE b.state END AS state, CASE WHEN l.rel_path IS NOT NULL THEN 2 ELSE 1 END AS last_scan_id
  FROM before b FULL JOIN listing l USING (rel_path)),
swept AS (SELECT * REPLACE (CASE WHEN last_scan_id = 1 THEN 'missing' ELSE state END AS state) FROM scanned),
moved AS (SELECT g.rel_path AS old_path, n.rel_path AS new_path FROM (SELECT *, row_number() OVER (PARTITION BY size_bytes, mtime_ns ORDER BY rel_path) AS k FROM swept WHERE state = 'missing') g JOIN (SELECT *, row_number() OVER (PARTITION BY size_bytes, mtime_ns ORDER BY rel_path) AS k FROM swept WHERE state = 'queued' AND asset_id IS NULL) n USING (size_bytes, mtime_ns, k)) """


@query(SCAN + "SELECT rel_path, size_bytes, asset_id, state, CAST(last_scan_id AS BIGINT) AS last_scan_id FROM scanned", catalogue=False)
def upsert_files(spark, sf_dir):
    return reconcile.upsert(_before(spark, sf_dir), _listing(spark, sf_dir), 2).select("rel_path", "size_bytes", "asset_id", "state", "last_scan_id")


@query(SCAN + "SELECT state, count(*) AS n FROM swept GROUP BY state", catalogue=False)
def sweep_missing(spark, sf_dir):
    return reconcile.sweep(reconcile.upsert(_before(spark, sf_dir), _listing(spark, sf_dir), 2), 2).groupBy("state").agg(F.count("*").alias("n"))


@query(SCAN + "SELECT old_path, new_path FROM moved", catalogue=False)
def reconcile_moves(spark, sf_dir):
    return reconcile.moves(reconcile.sweep(reconcile.upsert(_before(spark, sf_dir), _listing(spark, sf_dir), 2), 2)).select("old_path", "new_path")


@query(SCAN + "SELECT coalesce(m.new_path, s.rel_path) AS rel_path, CASE WHEN m.new_path IS NOT NULL THEN 'indexed' ELSE s.state END AS state FROM swept s LEFT JOIN moved m ON m.old_path = s.rel_path WHERE s.rel_path NOT IN (SELECT new_path FROM moved)", catalogue=False)
def files_after_scan(spark, sf_dir):
    f = reconcile.sweep(reconcile.upsert(_before(spark, sf_dir), _listing(spark, sf_dir), 2), 2)
    return reconcile.apply_moves(f, reconcile.moves(f)).select("rel_path", "state")


@query(SCAN + "SELECT b.rel_path, CASE WHEN l.rel_path IS NULL THEN 'vanished' WHEN l.size_bytes <> b.size_bytes THEN 'mutated' ELSE 'unchanged' END AS verdict FROM before b LEFT JOIN listing l USING (rel_path)", catalogue=False)
def integrity_audit(spark, sf_dir):
    return reconcile.audit(_before(spark, sf_dir), _listing(spark, sf_dir)).select("rel_path", "verdict")


RUNS = "SELECT asset_id, 'doc.text' AS extractor, CAST(1 + (row_number() OVER (ORDER BY asset_id)) % 2 AS INT) AS version FROM (SELECT DISTINCT asset_id FROM file WHERE media_type = 'document') WHERE asset_id < '8'"


@query("SELECT asset_id, extractor, version FROM (SELECT asset_id, 'doc.text' AS extractor, 2 AS version FROM (SELECT asset_id, min(media_type) AS media_type FROM file GROUP BY asset_id) WHERE media_type = 'document') WHERE NOT (asset_id < '8' AND substr(asset_id, 2, 1) < '8')")
def ledger_backlog(c):
    runs = c.asset.filter("asset_id < '8'").select("asset_id", F.lit("doc.text").alias("extractor"), F.when(F.substring("asset_id", 2, 1) < "8", 2).otherwise(1).alias("version"), F.lit("ok").alias("status"))
    spark = c.asset.sparkSession
    versions = spark.createDataFrame([("doc.text", 2, ["document"])], "extractor string, version int, media_types array<string>")
    return reconcile.backlog(c.asset, runs, versions)


@query("SELECT asset_id, min(size_bytes) AS size_bytes FROM file WHERE asset_id >= '4' GROUP BY asset_id")
def asset_bind(c):
    return reconcile.new_assets(c.asset.filter("asset_id < '4'"), c.file).select("asset_id", "size_bytes")


@query("SELECT DISTINCT asset_id FROM file WHERE root = 'src1' AND asset_id NOT IN (SELECT asset_id FROM file WHERE root <> 'src1')")
def forget_orphans(c):
    return reconcile.orphaned(c.file, "src1")


@query("SELECT asset_id, kind, name, source, CAST(max(confidence) AS DOUBLE) AS confidence, CAST(max(instances) AS INT) AS instances FROM (SELECT *, 1 AS instances FROM asset_tag UNION ALL SELECT asset_id, kind, name, source, 0.9, 3 FROM asset_tag WHERE kind = 'topic') GROUP BY ALL")
def tag_fact_merge(c):
    old = c.asset_tag.withColumn("instances", F.lit(1))
    new = old.filter("kind = 'topic'").withColumn("confidence", F.lit(0.9)).withColumn("instances", F.lit(3))
    return reconcile.merge_tags(old, new)


@query("SELECT state, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts, max(priority) AS priority FROM (SELECT CASE WHEN file_id % 4 = 0 AND attempts < 3 THEN 'queued' WHEN file_id % 2 = 0 THEN 'error' ELSE state END AS state, attempts, CASE WHEN file_id % 4 = 0 AND attempts < 3 THEN 200 ELSE 100 END AS priority FROM (SELECT *, CAST(file_id % 3 AS INT) + CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END AS attempts FROM file)) GROUP BY state")
def failure_routing(c):
    f = c.file.withColumn("attempts", (F.col("file_id") % 3).cast("int")).withColumn("priority", F.lit(100))
    bad = c.file.filter("file_id % 2 = 0").select("root", "rel_path", F.when(F.col("file_id") % 4 == 0, "timeout").otherwise("corrupt").alias("error"))
    return reconcile.route_failures(f, bad).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"), F.max("priority").alias("priority"))


@query("SELECT file_id, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY root, rel_path) AS k FROM file WHERE state = 'queued') WHERE k = 1 ORDER BY root, rel_path LIMIT 30")
def claim_batch(c):
    return reconcile.claim(c.file.withColumn("priority", F.lit(100)), 30).select("file_id", "asset_id")


# --- digests

@query("SELECT axis, value, count(*) AS n FROM (SELECT unnest(['media_type', 'root', 'ext']) AS axis, unnest([media_type, root, ext]) AS value FROM (SELECT asset_id, min(media_type) AS media_type, min(root) AS root, min(ext) AS ext FROM indexed GROUP BY asset_id)) GROUP BY ALL")
def digest_axes(c):
    items = c.indexed.groupBy("asset_id").agg(F.min("media_type").alias("media_type"), F.min("root").alias("root"), F.min("ext").alias("ext"))
    return digest.axes_grouping_sets(items, ["media_type", "root", "ext"])


@query("SELECT 'USD' AS currency, count(*) AS documents, round(sum(c_acctbal), 2) AS total, max(c_acctbal) AS largest FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'EUR', count(*), round(sum(c_custkey), 2), max(c_custkey) FROM customer WHERE c_custkey % 2 = 0", catalogue=False)
def digest_money(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    m = lambda code, v: F.map_from_arrays(F.array(F.lit(code)), F.array(F.struct(F.lit(1).alias("count"), v.cast("double").alias("max"), v.cast("double").alias("sum"))))
    none = F.create_map().cast("map<string,struct<count:int,max:double,sum:double>>")
    money = F.map_concat(F.when(F.col("c_acctbal") > 0, m("USD", F.col("c_acctbal"))).otherwise(none), F.when(F.col("c_custkey") % 2 == 0, m("EUR", F.col("c_custkey"))).otherwise(none))
    return digest.money_totals(cust.select(money.alias("money")))


@query("SELECT name AS flag, count(DISTINCT asset_id) AS n FROM asset_tag WHERE kind = 'pattern' AND name = 'url' GROUP BY name")
def pattern_counts(c):
    return c.asset_tag.filter("kind = 'pattern' AND name = 'url'").groupBy(F.col("name").alias("flag")).agg(F.countDistinct("asset_id").alias("n"))


# --- tenancy

SCOPE = Scope(path_prefixes=["src1", "src2/en"], include_tags=["topic1", "topic2", "topic3", "topic4"], exclude_tags=["author1"], media_types=["document", "image"])
SCOPE_SQL = "(starts_with(rel_path, 'src1') OR starts_with(rel_path, 'src2/en')) AND media_type IN ('document', 'image') AND asset_id IN (SELECT asset_id FROM asset_tag WHERE source <> 'user' AND name IN ('topic1', 'topic2', 'topic3', 'topic4')) AND asset_id NOT IN (SELECT asset_id FROM asset_tag WHERE source <> 'user' AND name = 'author1')"


@query(f"{F_SQL} indexed WHERE {SCOPE_SQL}")
def scope_filter(c):
    return sel.in_scope(c, c.indexed, SCOPE).select(*F_COLS)


@query(f"SELECT CASE WHEN file_id % 2 = 0 THEN 'w1' ELSE 'w2' END AS workspace_id, file_id FROM indexed WHERE {SCOPE_SQL} AND file_id % 2 = 0 UNION SELECT 'w2', file_id FROM indexed WHERE root = 'src3'")
def visible_files(c):
    files = c.indexed.withColumn("library_id", F.when(F.col("root") == "src3", "l3").when(F.col("file_id") % 2 == 0, "l1").otherwise("l2"))
    tags = files.select("file_id", "asset_id").join(c.asset_tag.filter("source <> 'user'"), "asset_id").select("file_id", "name")
    rows = [("w1", "l1", SCOPE.path_prefixes, SCOPE.include_tags, SCOPE.exclude_tags, SCOPE.media_types), ("w2", "l3", [], [], [], []), ("w2", "l3", ["src3/en"], [], [], [])]
    grants = c.file.sparkSession.createDataFrame(rows, "workspace_id string, library_id string, path_prefixes array<string>, include_tags array<string>, exclude_tags array<string>, media_types array<string>")
    return tenancy.visible(files, tags, grants).select("workspace_id", "file_id")


@query("SELECT file_id, tag FROM (SELECT file_id, kind || ':' || asset_tag.name AS tag FROM indexed JOIN asset_tag USING (asset_id) WHERE source <> 'user' UNION SELECT file_id, 'mine:' || file_id % 3 FROM indexed WHERE file_id % 10 = 0 UNION SELECT file_id, 'added:x' FROM indexed WHERE file_id % 15 = 0) EXCEPT SELECT file_id, tag FROM (SELECT file_id, 'topic:topic1' AS tag FROM indexed UNION SELECT file_id, 'added:x' FROM indexed WHERE file_id % 30 = 0)")
def lens_tags(c):
    machine = c.indexed.select("file_id", "asset_id").join(c.asset_tag.filter("source <> 'user'"), "asset_id").select("file_id", F.concat_ws(":", "kind", "name").alias("tag"))
    own = c.indexed.filter("file_id % 10 = 0").select("file_id", F.concat(F.lit("mine:"), (F.col("file_id") % 3).cast("string")).alias("tag"))
    add = c.indexed.filter("file_id % 15 = 0").select("file_id", F.lit("added:x").alias("tag"))
    gone = c.indexed.select("file_id", F.lit("topic:topic1").alias("tag")).union(add.filter("file_id % 30 = 0"))
    return tenancy.lens(machine, own, add, gone)


@query("SELECT file_id FROM indexed WHERE file_id IN (3, 5, 8, 21)")
def album_filter(c):
    albums = c.file.sparkSession.createDataFrame([("best", [3, 5, 8, 21, 21]), ("other", [1])], "album string, file_ids array<long>")
    return tenancy.album(c.indexed, albums, "best").select("file_id")


@query("SELECT file_id, CASE WHEN asset_id IN (SELECT asset_id FROM asset_tag WHERE name = 'toxic') THEN '#f00' WHEN starts_with(rel_path, 'src2') THEN '#0f0' WHEN ext = 'pdf' THEN '#00f' WHEN contains(name, '77') THEN '#ff0' WHEN media_type = 'audio' THEN '#0ff' ELSE '#677686' END AS colour FROM indexed")
def colour_rules(c):
    rules = [ColourRule("tag", "toxic", "#f00"), ColourRule("media", "image", "#fff", enabled=False), ColourRule("path", "src2", "#0f0"), ColourRule.parse("ext:.PDF=#00f"), ColourRule("name", "77", "#ff0"), ColourRule("media", "audio", "#0ff"), ColourRule("untagged", "", "#000")]
    return sel.coloured(c, c.indexed, rules).select("file_id", "colour")


# --- review

@query("""SELECT file_id, rel_path, CAST(CASE WHEN d THEN 0 ELSE 3 END + CASE WHEN t THEN 0 ELSE 2 END + greatest(0, 6 - n) + 2 + 1 AS BIGINT) AS priority, NOT d AS no_doctype, NOT t AS no_topic FROM (
  SELECT file_id, rel_path, asset_id, coalesce(bool_or(kind = 'doctype'), false) AS d, coalesce(bool_or(kind = 'topic'), false) AS t, count(kind) AS n FROM indexed LEFT JOIN (SELECT * FROM asset_tag WHERE NOT (kind = 'topic' AND name IN ('topic1', 'topic2')) AND NOT (kind = 'doctype' AND name = 'es')) USING (asset_id) GROUP BY ALL) WHERE NOT d OR NOT t ORDER BY priority DESC, rel_path LIMIT 120""")
def review_queue(c):
    t = c.asset_tag.filter("NOT (kind = 'topic' AND name IN ('topic1', 'topic2')) AND NOT (kind = 'doctype' AND name = 'es')")
    return review.queue(c.indexed, c.indexed.select("file_id", "asset_id").join(t, "asset_id").select("file_id", "kind", "name"))


@query("SELECT stem, ext, count(*) AS files, count(DISTINCT parent_rel) AS folders, count(DISTINCT asset_id) AS contents FROM (SELECT 'doc_' || (file_id % 50) AS stem, ext, parent_rel, asset_id FROM indexed) GROUP BY stem, ext HAVING count(*) >= 2 AND count(DISTINCT parent_rel) >= 2")
def name_repeats(c):
    name = F.concat(F.lit("doc_"), (F.col("file_id") % 50).cast("string"), F.get(F.array(F.lit("_v2"), F.lit(" (1)"), F.lit("_final_v2"), F.lit("")), (F.col("file_id") % 4).cast("int")), F.lit("."), F.col("ext"))
    return review.repeats(c.indexed.withColumn("name", name))


# --- colour, place, likeness

def _channel(i: int) -> str:
    return f"CAST('0x' || substr(hex, {i}, 2) AS INT)"


LAB = f"""SELECT hex, round(116 * fy - 16, 4) AS l, round(500 * (fx - fy), 4) AS a, round(200 * (fy - fz), 4) AS b FROM (SELECT hex, CASE WHEN x > 0.008856 THEN pow(x, 1.0 / 3) ELSE 7.787 * x + 16.0 / 116 END AS fx, CASE WHEN y > 0.008856 THEN pow(y, 1.0 / 3) ELSE 7.787 * y + 16.0 / 116 END AS fy, CASE WHEN z > 0.008856 THEN pow(z, 1.0 / 3) ELSE 7.787 * z + 16.0 / 116 END AS fz FROM (
  SELECT hex, (r * 0.4124 + g * 0.3576 + b * 0.1805) * 100 / 95.047 AS x, (r * 0.2126 + g * 0.7152 + b * 0.0722) AS y, (r * 0.0193 + g * 0.1192 + b * 0.9505) * 100 / 108.883 AS z FROM (
  SELECT hex, {', '.join(f"CASE WHEN {n} <= 0.04045 THEN {n} / 12.92 ELSE pow(({n} + 0.055) / 1.055, 2.4) END AS {n}" for n in 'rgb')} FROM (SELECT DISTINCT hex, {', '.join(f"{_channel(i)} / 255.0::DOUBLE AS {n}" for n, i in zip('rgb', (1, 3, 5), strict=True))} FROM color))))"""


def _hexes(c):
    """The stored colours, once each, dealt to all cores: few bytes, but much to compute."""
    h = c.color.select("hex").distinct()
    return h.repartition(h.sparkSession.sparkContext.defaultParallelism, "hex")


@query(LAB)
def lab_values(c):
    v = _hexes(c).select("hex", colour.lab_struct(*colour.rgb(F.col("hex"))).alias("v"))
    return v.select("hex", *[F.round(f"v.{x}", 4).alias(x) for x in "lab"])


BUCKET = f"""SELECT hex, CASE WHEN chroma < 12 AND l < 22 THEN 'black' WHEN chroma < 12 AND l > 85 THEN 'white' WHEN chroma < 12 THEN 'gray' WHEN l < 12 THEN 'black' WHEN h >= 12 AND h < 55 AND l < 60 AND chroma < 60 THEN 'brown'
  WHEN (h < 12 OR h >= 345) AND l > 70 AND chroma < 45 THEN 'pink' WHEN h < 12 THEN 'red' WHEN h < 42 THEN 'orange' WHEN h < 72 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 200 THEN 'teal' WHEN h < 258 THEN 'blue' WHEN h < 310 THEN 'purple' WHEN h < 345 THEN 'pink' ELSE 'red' END AS bucket
  FROM (SELECT v.hex, l, sqrt(a * a + v.b * v.b) AS chroma, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (60 * ((g - bl) / (hi - lo)) + 360) % 360 WHEN hi = g THEN 60 * ((bl - r) / (hi - lo) + 2) ELSE 60 * ((r - g) / (hi - lo) + 4) END AS h
  FROM ({LAB}) v JOIN (SELECT DISTINCT hex, {_channel(1)}::DOUBLE AS r, {_channel(3)}::DOUBLE AS g, {_channel(5)}::DOUBLE AS bl, greatest(r, g, bl) AS hi, least(r, g, bl) AS lo FROM color) c ON c.hex = v.hex)"""


@query(BUCKET)
def lab_bucket(c):
    """The colour group of every stored colour, by the axes that ``lab_values`` gives; a content without text has no colour."""
    return _hexes(c).filter("hex IS NOT NULL").select("hex", colour.bucket(*colour.rgb(F.col("hex")), digits=4).alias("bucket"))


@query("""SELECT c_custkey, array_to_string(list_transform(range(9), lambda i: '0123456789bcdefghjkmnpqrstuvwxyz'[1 + CAST(list_sum(list_transform(range(5), lambda k:
    (CASE WHEN (5 * i + k) % 2 = 0 THEN (x >> (22 - (5 * i + k) // 2)) & 1 ELSE (y >> (21 - (5 * i + k) // 2)) & 1 END) << (4 - k))) AS INT)]), '') AS geohash
  FROM (SELECT c_custkey, CAST(floor((lon + 180) / 360 * 8388608) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 4194304) AS BIGINT) AS y FROM (SELECT c_custkey, (c_custkey * 7 % 180 - 90) + 0.125 AS lat, (c_custkey * 13 % 360 - 180) + 0.25 AS lon FROM customer))""", catalogue=False)
def geohash9(spark, sf_dir):
    """Geohashes of places derived from customers."""
    cust = table(spark, sf_dir, "customer")
    return cust.select("c_custkey", colour.geohash((F.col("c_custkey") * 7 % 180 - 90).cast("double") + 0.125, (F.col("c_custkey") * 13 % 360 - 180).cast("double") + 0.25).alias("geohash"))


@query("""WITH h AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) AS h FROM embeddings), n AS (SELECT vec_id, h, unnest([0, 8, 20]) AS k FROM h),
  p AS (SELECT vec_id * 3 + CASE k WHEN 0 THEN 0 WHEN 8 THEN 1 ELSE 2 END AS vec_id, list_transform(range(1, 65), lambda i: CASE WHEN k > 0 AND i % k = 0 AND i <= 3 * k THEN 1 - h[i] ELSE h[i] END) AS h FROM n)
  SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(list_zip(a.h, b.h), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INT) AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.h, b.h), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) <= 7""", catalogue=False)
def hamming_near_dup(spark, sf_dir):
    """Pairs of 64-bit perceptual hashes at most seven bits apart, where every vector's signs stand for a picture and for two
    copies with three flipped bits: of eight bytes one must be equal, and a pair is formed only at the first equal byte."""
    bit = lambda i, v: F.shiftleft(v.cast("long"), i)
    sign = lambda i: (F.get("embedding", F.lit(i)) > 0).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in enumerate((0, 8, 20))])).alias("x"), "embedding")
    flip = lambda i: ((F.col("x.k") > 0) & (F.lit(i + 1) % F.greatest(F.col("x.k"), F.lit(1)) == 0) & (F.lit(i + 1) <= 3 * F.col("x.k"))).cast("int")
    h = bit(0, sign(0).bitwiseXOR(flip(0)))
    for i in range(1, 64):
        h = h.bitwiseOR(bit(i, sign(i).bitwiseXOR(flip(i))))
    p = e.select((F.col("vec_id") * 3 + F.col("x.m")).alias("vec_id"), h.alias("h"))
    return colour.near_hashes(p, "vec_id", "h", 7)


@query("SELECT vec_id, place FROM (SELECT e.vec_id, CAST(row_number() OVER (ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) DESC, e.vec_id) AS INT) AS place FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0) WHERE place <= 10", catalogue=False)
def embedding_topk(spark, sf_dir):
    """The ten vectors most like the first, by cosine (a top-k report)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    s = e.filter("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", (dot("embedding", "q") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("q", "q")))).alias("sim"))
    top = s.orderBy(F.desc("sim"), "vec_id").limit(10)
    return top.select("vec_id", F.row_number().over(Window.orderBy(F.desc("sim"), "vec_id")).alias("place"))


# --- events (extensions)

@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", catalogue=False)
def events_tumbling(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) - 3600 * k AS start, count(*) AS n, round(count(*) / 21600, 8) AS rate FROM events, (SELECT unnest(range(6)) AS k) GROUP BY 1", catalogue=False)
def rate_window(spark, sf_dir):
    return streams.sliding_rate(table(spark, sf_dir, "events")).withColumn("rate", F.round("rate", 8))


@query("SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) + 43200 AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s", catalogue=False)
def events_session(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS used, CAST(greatest(0, 3 - count(*)) AS BIGINT) AS \"left\" FROM events GROUP BY 1, 2", catalogue=False)
def viewer_budgets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return streams.budgets(e.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), 3)
