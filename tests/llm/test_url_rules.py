"""op13: both ways to look rules up against every rule on every address, and on awkward addresses."""

from __future__ import annotations

import random
import re

import pytest

from granary.llm import url_rules
from granary.llm.url_rules import Rule, judge_urls, listed, rule_table

URLS = "page_id long, url string, host string, verdict int"


def _split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


def _fits(r, host, path):
    subject = host if r.part == "host" else host + path
    text, head, tail = r.text, "", ""
    if text.startswith("||"):
        head, text = r"^(?:[^/]*\.)?", text[2:]
    elif text.startswith("|"):
        head, text = "^", text[1:]
    if text.endswith("|"):
        tail, text = "$", text[:-1]
    body = "".join({"*": ".*", "^": "(?:[^A-Za-z0-9]|^|$)"}.get(c, re.escape(c)) for c in text)
    return re.search("(?s)" + head + body + tail, subject) is not None


def _brute(rules, url):
    host, path = _split(url)
    fit = sorted((not r.listed, -len(r.text), r.text, r.verdict) for r in rules if _fits(r, host, path))
    if not fit:
        return host, path, None, "allow", None
    unlisted, _, text, verdict = fit[0]
    return host, path, None if unlisted else text.removeprefix("||"), verdict, text if unlisted else None


def _got(df):
    return sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in df.collect())


def _urls(rng, n):
    words = ["com", "example", "en", "casino", "win", "ads", "a", "b-c", "net", "es", "x.y", "doorway", "q.php", "spam"]
    for i in range(n):
        host = ".".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        path = "".join("/" + rng.choice(words) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "?a=/en/", "#://x"])
        yield i, rng.choice(["http://", "HTTPS://", ""]) + rng.choice([host, host.upper()]) + path


@pytest.mark.parametrize("most", [1000, 0], ids=["map", "joined"])
def test_equals_every_rule_on_every_address(spark, most):
    rng = random.Random(most)
    rows = list(_urls(rng, 400))
    words = ["com", "example", "casino", "a", "b", "en", "q"]
    rules = url_rules.LISTED + url_rules.PATTERNS
    for k in range(40):
        text = rng.choice(["", "|", "||", "^", "*"]) + rng.choice([".", "/", "^", "*", "-"]).join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "|", "^", "/", "*"])
        rules.append(Rule(text, rng.choice(["allow", "block"]), rng.choice(["url", "host"]), k % 3 == 0))
    rules = list({(r.text, r.part, r.listed): r for r in rules}.values())
    unique = {}
    for r in rules:  # of a text and rank that stands twice, both parts say the same
        unique.setdefault((r.text, r.listed), r)
    rules = list(unique.values())
    df = spark.createDataFrame(rows, "page_id long, url string")
    assert _got(judge_urls(df, rule_table(spark, rules), map_rules=most)) == sorted((i, *_brute(rules, u)) for i, u in rows)


@pytest.mark.parametrize("most", [1000, 0], ids=["map", "joined"])
def test_awkward_addresses(spark, most):
    urls = [None, "", "no scheme", "://", "http://COM/", "http://com", "http://com?/", "http://a.example.com/en/x", "http://example.com/EN/", "http://www.example.com/en/", "http://xexample.com/en/", "http://e.net/es/", "http://u:p@h.com:80/a", "http://casino-win.example.net/en/1", "http://m.CASINO.org/", "http://casinos2.org/", "http://h.org/" + "a/" * 100_000, "http://a.org/://b.com/", "http://x\n.com/\n", "http://x.com/Ä"]
    rows = [(i if i % 5 else None, u, "h", 1) for i, u in enumerate([*urls, *urls[:3]])]
    rules = url_rules.LISTED + url_rules.PATTERNS
    df = spark.createDataFrame(rows, URLS)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in judge_urls(df, rule_table(spark, rules), map_rules=most).collect()), key=key)
    assert got == sorted(((i, *_brute(rules, u)) for i, u, *_ in rows), key=key)
    assert judge_urls(df.limit(0), rule_table(spark, rules), map_rules=most).count() == 0
    assert {r["verdict"] for r in judge_urls(df, rule_table(spark, [listed("x", "/", "allow")]).limit(0), map_rules=most).collect()} == {"allow"}


def test_rules_stand_under_their_rarest_token(spark):
    df = spark.createDataFrame([(i, f"http://s{i}.example.com/en/") for i in range(5)] + [(9, "http://rare.com/")], "page_id long, url string")
    host, path = url_rules.split_url(df["url"])
    urls = df.select(url_rules._url_tokens(host, path).alias("tokens"))
    index = {r["rule"]["text"]: r["token"] for r in url_rules.rule_index(rule_table(spark, [Rule("||rare.com/", "block"), Rule("||example.com/en/x", "block"), Rule("no*token", "block"), Rule("^never^com^", "block")]), urls).collect()}
    assert index == {"||rare.com/": "rare", "||example.com/en/x": "en", "no*token": "", "^never^com^": "never"}
