"""Verdicts on addresses by pattern rules that are found under their rarest literal token (DataFrame operations only)."""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import row_key
from granary.session import Scratch


class Rule(NamedTuple):
    """A pattern and what it says of an address that it fits.

    In ``text``, a leading ``||`` is the start of the host or of a part of it after a dot, a leading
    or trailing ``|`` is either end, ``*`` is any run of characters, ``^`` is one character that is no
    letter or digit, or an end; everything else is itself. ``part`` is what is looked at:
    ``url`` (host and path) or ``host``. Listed rules go before the others.
    """

    text: str
    verdict: str
    part: str = "url"
    listed: bool = False


def listed(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains, and the paths that begin with ``path``."""
    return Rule(f"||{host}{path}", verdict, "url", True)


#: The rules of the registered query.
LISTED = [
    listed("com", "/", "allow"),
    listed("example.com", "/en/", "block"),
    listed("www.example.com", "/en/", "allow"),
    listed("net", "/es/", "block"),
    listed("net", "/fr/", "block"),
]
#: Words of host names that no text is taken from: betting, adult, drugs, spam, advertising, stolen goods.
WORDS = "casino casinos poker slots bet bets betting gambling lottery jackpot adult porn porno xxx sex escort escorts webcam nude pills pill viagra cialis pharma spam spammer malware phishing ads ad adserver adtrack adclick doubleclick popunder banner tracker torrent torrents warez keygen cracked".split()
#: Host words, by themselves between other characters, then addresses of files and scripts that are no pages.
PATTERNS = [Rule(f"^{w}^", "block", "host") for w in WORDS] + [Rule(t, "block") for t in ("/adserver/", "/adclick/", "/pagead/", "/doorway/*.php|", "/linkfarm/")]
#: Rules up to which the index goes to every task as one map, which is searched from end to end; more are joined.
MAP_RULES = 500


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table: text, verdict, part, listed."""
    rows = [F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.part).alias("part"), F.lit(r.listed).alias("listed")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _regex(text: Column) -> Column:
    """The regular expression of a rule's text."""
    x = F.regexp_replace(text, r"[^A-Za-z0-9*^|]", r"\\$0")
    x = F.regexp_replace(x, r"^\|\|", "<host>")
    x = F.regexp_replace(x, r"^\|", "<start>")
    x = F.regexp_replace(x, r"\|$", "<end>")
    for what, by in (("|", r"\|"), ("^", r"(?:[^A-Za-z0-9]|^|$)"), ("*", ".*"), ("<host>", r"^(?:[^/]*\.)?"), ("<start>", "^"), ("<end>", "$")):
        x = F.replace(x, F.lit(what), F.lit(by))
    return F.concat(F.lit("(?s)"), x)


def _rule_tokens(text: Column) -> Column:
    """Tokens that stand whole in every address that a rule fits: nothing on either side can lengthen them."""
    return F.array_distinct(F.regexp_extract_all(_lower(text), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of an address; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return _lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of an address; the empty one has the rules that have no token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(_lower(F.concat(host, path)), F.lit("[a-z0-9]+"), F.lit(0))))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """One row for each rule, under the rarest of its tokens among the addresses (ties: the smallest).

    Only tokens that stand in a rule are counted; each address counts once for a token.
    """
    rules = rules.filter(F.col("text").isNotNull()).dropDuplicates(["text", "part", "listed"]).withColumn("tokens", _rule_tokens(F.col("text")))
    asked = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    seen = rules.select("text", "part", "listed", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = seen.groupBy("text", "part", "listed").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token")).getField("token").alias("token"))
    return rules.join(rarest, ["text", "part", "listed"], "left").select(
        F.coalesce("token", F.lit("")).alias("token"),
        F.struct(
            # in the order in which rules go before each other: listed, then longer, then smaller in text
            (~F.col("listed")).alias("unlisted"),
            (-F.length("text")).alias("less"),
            "text",
            "verdict",
            "part",
            _regex(F.col("text")).alias("regex"),
        ).alias("rule"),
    )


def _fits(rule: Column) -> Column:
    return F.regexp_like(F.when(rule["part"] == "host", F.col("host")).otherwise(F.concat("host", "path")), rule["regex"])


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", map_rules: int = MAP_RULES) -> DataFrame:
    """A verdict for every address, by the first of the listed rules that fit it, else of the patterns, else ``otherwise``.

    An address looks up its tokens in the index of rules and runs only the regular expressions it
    finds there. Of the rules that fit, the longest wins (ties: the smallest text). Up to
    ``map_rules`` rules the index is one map in every task, and addresses are neither
    exploded nor shuffled; more rules are joined by token, with the tokens of many addresses
    dealt to several tasks.

    Null addresses and those without ``://`` have an empty host and path and fit no listed rule;
    repeated rows and null ids are judged each; an empty table, or no rules, is no error; of rules
    with the same text, part and rank one counts. Only the address is read; other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", _url_tokens(F.col("host"), F.col("path")))
    index = rule_index(rules, urls)
    n = rules.limit(map_rules + 1).count()
    if n <= map_rules:
        found = _looked_up(urls, index)
    else:
        found = _joined(urls, index)
    is_listed = ~F.col("best.unlisted")
    return found.select(
        "page_id",
        "host",
        "path",
        F.when(is_listed, F.regexp_replace("best.text", r"^\|\|", "")).alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
        F.when(~is_listed, F.col("best.text")).alias("pattern"),
    )


def _looked_up(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The best rule by a map from token to rules; the map is a scalar of a checked size."""
    held = index.groupBy("token").agg(F.collect_list("rule").alias("rules"))
    by_token = held.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("m")).scalar()
    near = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at("by_token", t)), lambda r: r.isNotNull()))
    return urls.withColumn("by_token", by_token).withColumn("best", F.array_min(F.filter(near, _fits)))


#: Tasks that the addresses of one token are dealt to.
TOKEN_SALTS = 16


def _joined(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The same by joins. Equal addresses are judged once, so that a row needs no id."""
    spark = urls.sparkSession
    work = Scratch(spark, "url-rules")
    distinct = work.keep(urls.select("host", "path", "tokens").dropDuplicates(["host", "path"]).withColumns(row_key("host", "path")), "urls")
    keys = ["_row1", "_row2"]
    many = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TOKEN_SALTS - 1))))
    posts = distinct.select(*keys, "host", "path", F.explode("tokens").alias("token")).withColumn("_salt", F.pmod("_row1", F.lit(TOKEN_SALTS)).cast("int"))
    fits = posts.join(many, ["token", "_salt"]).filter(_fits(F.col("rule")))
    best = work.keep(fits.groupBy(*keys).agg(F.min("rule").alias("best")), "best")
    return urls.drop("tokens").withColumns(row_key("host", "path")).join(best, keys, "left").drop(*keys)


#: The same in SQL, without an index: every rule is compared with every address, part by part.
ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT page_id, s.host, s.path, max(length(h || p)) AS most FROM s LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY ALL
), best AS (
  SELECT f.page_id, f.host, f.path, h || p AS rule, v FROM f LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) AND length(h || p) = most
), pats AS (
  SELECT *, list_concat(
    list_transform(list_filter(string_split('{words}', ' '), lambda w: list_contains(string_split_regex(host, '[^A-Za-z0-9]'), w)), lambda w: '^' || w || '^'),
    list_filter(['/adserver/', '/adclick/', '/pagead/', '/linkfarm/'], lambda t: contains(path, t)),
    CASE WHEN regexp_matches(path, '/doorway/.*\\.php$') THEN ['/doorway/*.php|'] ELSE CAST([] AS VARCHAR[]) END) AS found
  FROM best
), one AS (
  SELECT *, substr(list_min(list_transform(found, lambda t: lpad(CAST(1000 - length(t) AS VARCHAR), 4, '0') || t)), 5) AS pat FROM pats
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN pat IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN pat END AS pattern
FROM one
""".replace("{words}", " ".join(WORDS))
