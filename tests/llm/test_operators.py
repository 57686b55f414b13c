"""Each dealt operator against a brute-force version, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import decontam, fingerprints, html_text, language, mixing, near_dup, secrets, tokens, toxicity, warc
from granary.llm.common import WordHashes
from granary.llm.components import components
from granary.session import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, part int"
LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, null and repeated ids, columns with clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, LONG, "en", "a", len(LONG)), (5, LONG, "en", None, len(LONG)), (6, "one two three", "en", "b", 13), (6, "one two three", "en", "b", 13), (None, "null id here is one of two", "de", "b", 26), (None, None, None, None, None), (9, "x" * 50_000, None, "b", 50_000)]
    return spark.createDataFrame([(*r, "c", 0) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1

def _jaccard(a: str, b: str) -> float:
    h = WordHashes()
    x, y = ({int(k): int(n) for k, n in zip(*fingerprints.weighted_terms(t, h), strict=True)} for t in (a, b))
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    rng, err = random.Random(5), []
    for _ in range(150):
        a = [rng.choice("abcdefgh") for _ in range(60)]
        b = a[: rng.randint(5, 60)] + [rng.choice("abcdefgh") for _ in range(30)]
        h = WordHashes()
        s = [fingerprints.sample(*fingerprints.weighted_terms(" ".join(t), h)) for t in (a, b)]
        err.append(fingerprints.likeness(*s) - _jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.09


def test_fingerprints_of_ring(spark, odd, none):
    docs = [(i, f"text {i} " + "word%d " % (i % 3) * i) for i in range(1, 40)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and got[i]["n_chars"] == len(t)
    rows = fingerprints.fingerprint_with_next(odd).collect()
    assert len(rows) == 10
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[4] == by[5] and by[1] == by[2] == {fingerprints.EMPTY} and len(by[6]) == 1
    assert fingerprints.fingerprint_with_next(none).count() == 0
    assert fingerprints.fingerprint_with_next(spark.createDataFrame([(7, "only one")], "doc_id long, text string")).count() == 1
    assert fingerprints.fingerprint_with_next(spark.createDataFrame([(None, "a b"), (None, "c d")], "doc_id long, text string")).count() == 2


# 2

PAGES = "page_id long, url string, html string, shard int"


def test_warc_round_trip(spark):
    body = "<p>" + "é text " * 40 + "</p>"
    rows = [(5, "http://a/ b", body), (3, "http://b", body), (3, "http://b", body), (9, None, None), (10, "u", ""), (11, "u", "short"), (12, "u", "short"), (None, "n", body), (20, "x", body + "!" * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], PAGES)
    out = scratch(spark, "t-warc")
    manifest = warc.write_warc(df, out, shards=3, roll_bytes=200)
    got = warc.read_warc(spark, out).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    assert kinds == sorted([("5", "revisit", "3"), ("3", "response", "None"), ("3", "revisit", "3"), ("9", "response", "None"), ("10", "response", "None"), ("11", "response", "None"), ("12", "response", "None"), ("None", "revisit", "3"), ("20", "response", "None")])
    for r in got:
        if r["html"] is not None:
            assert r["payload_digest"] == hashlib.sha256(r["html"].encode()).hexdigest() and r["payload_bytes"] == len(r["html"].encode())
    again = scratch(spark, "t-warc")
    m2 = warc.write_warc(df.orderBy(F.desc("url")), again, shards=3, roll_bytes=200)
    assert {(r["name"], r["sha256"]) for r in manifest.collect()} == {(r["name"], r["sha256"]) for r in m2.collect()}
    warc.commit(m2, again)  # may be repeated
    empty = scratch(spark, "t-warc")
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_reader_follows_the_manifest(spark):
    """A smaller second write leaves no old records behind; urls and very long payloads come back as they were."""
    out = scratch(spark, "t-warc")
    rows = [(i, u, f"page {i} " * (300_000 if i == 3 else 30)) for i, u in enumerate([None, "", "http://a/ b%20c\n", "http://ü/x", "plain"] * 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(df, out, shards=4, roll_bytes=500)
    names = lambda: {r["name"] for r in spark.read.parquet(f"{out}/_manifest").collect()}
    first = names()
    warc.write_warc(df.filter("page_id < 6"), out, shards=1)
    assert names() < first
    got = {r["page_id"]: (r["url"], r["html"]) for r in warc.read_warc(spark, out).collect()}
    assert got == {i: (u, h) for i, u, h in rows[:6]}
    fs, path = warc._filesystem(out)
    with fs.open_output_stream(f"{path}/{names().pop()}", compression=None) as f:
        f.write(warc.record(1, "u", b"x", hashlib.sha256(b"x").hexdigest(), None, 1, 0))
    with pytest.raises(Exception, match="is not the archive"):
        warc.read_warc(spark, out).count()


# 3

def test_mixing_meets_targets(spark, odd, none):
    rng = random.Random(2)
    docs = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(800)]
    got = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    src = {i: s for i, _, s in docs}
    for r in got:
        s = src[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] + 1e-6
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 10 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_sources(none).count() == 0


# 4

def _base(text: str) -> str:
    out = []
    for kind, p in (("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(p, text):
            if (kind == "assign" and len(m[1]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secret_spans(spark, odd, none):
    rng = random.Random(4)
    pieces = ["password", "Token", " = ", ":", '"', "'", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4, "api_key", "apikey=", "abc", " ", "\n", "é", "ſecret: abcdefg", "hunter2hunter2", "pwd: ", "xK9#qL2$vB7!", "pass is ", "19991231"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(df).collect():
        want = _base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert set(want.split(",")) - {""} <= set(r["spans"].split(","))
    assert secrets.scan_secrets(odd).count() == 10 and secrets.scan_secrets(none).count() == 0
    assert secrets.redact("x password = abcdef123 y") == "x [assign] y"
    back = secrets.redact_secrets(odd)
    assert back.columns == odd.columns and back.count() == 10 and back.schema == odd.schema


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("password") < 1 and cost("passwordpassword") < 2 and cost("aaaaaaaaaaaa") < 3.5
    assert cost("qwertyuiop") < 5 and cost("abcdefghij") < 5 and cost("19991231") < 6
    assert cost("p@ssw0rd") < 3 and cost("xK9qL2vB7rT4wZ") > 14 and cost("") == 0
    assert cost("monkey" + "1987") < cost("zqxjkv" + "8461")


# 5

def test_prefix_counts_equal_the_library(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), tokens.load(path)
    rng = random.Random(3)
    parts = list("ab 's're ll  \n\té1中-_!'tTHE") + ["<|endoftext|>", "  ", " the", "'re", "aaaaaaaa", "ing"]
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        kept = tokens.PrefixCounts(own, text)
        exact = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [kept.count(i) for i in range(len(text) + 1)] == exact and own.count(text) == exact[-1], text
        for budget in (0, 1, 3, 7):
            assert exact[kept.fit(budget)] <= budget
    got = {r["doc_id"]: r for r in tokens.count_tokens(odd, path).collect()}
    assert got[1]["n_tokens"] == 0 and got[4]["n_tokens"] == len(lib.encode(LONG, add_special_tokens=False).ids) and got[4]["over_limit"]
    assert tokens.count_tokens(none, path).count() == 0
    assert tokens.prefix_token_counts(odd, path).filter("size(ends) <> size(counts)").count() == 0


# 6

def test_toxicity_held_out(spark, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "th", "in", "on", "re", "st"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(700):
        w = [word() for _ in range(rng.randint(20, 200))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "zumpf"]) + word()
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (9999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(d, lab)
    out = toxicity.score_toxicity(d, m).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) / len(held) > 0.95
    rows = toxicity.score_toxicity(odd, m).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(none, toxicity.fit(none.select("doc_id", "text"), lab.limit(0))).count() == 0


# 7

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><div class="cookie-notice">We use cookies, sure</div>
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id=wrap><div class="sidebar"><p>Side, text, more</p></div><div class="post">{body}</div>
<div id="comments"><p>Nice, post, really, great, read</p></div></div><form><p>x</p></form><footer>c</footer></body>"""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Four<script>x</p></script></article><footer>no</footer>", "A & B\n\nOne two three\n\nFour"),
        (PAGE.format(body="<h2>Title</h2><p>Short.</p><p>Long text, with commas, and more words here.</p><ul><li>one<li>two</ul><aside>ad</aside>"), "Title\n\nShort.\n\nLong text, with commas, and more words here.\n\none\n\ntwo"),
        ("", ""), (None, ""), ("<p", ""), ("plain text", "plain text"), ("<p>a&nbsp;&nbsp;b</p>", "a b"), ("<article><p>cut off he", "cut off he"), ("<div hidden><p>a, b, c</p></div><div><p>kept, yes</p></div>", "kept, yes"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (1, "u", "<p>x</p>" * 20_000, 3), (None, None, "", 3)], PAGES)
    rows = html_text.extract(df).collect()
    assert len(rows) == 3 and max(r["n_chars"] for r in rows) == 20_000 + 2 * 19_999
    assert html_text.extract(df.limit(0)).count() == 0


# 8

def _sets(docs):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def _brute(docs):
    sets = _sets(docs)
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    par[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _family(rng, n, base):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    common = " ".join(f"common{i}" for i in range(30))
    texts = ["", None, "a b", "A  b", "one two three four five", *(" ".join(f"w{rng.randint(0, 5000)}" for _ in range(80)) + " " + common for _ in range(60))]
    for k in range(4):
        texts += _family(rng, 45, " ".join(f"f{k}w{i}" for i in range(110)))
    texts += texts[:40]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, sets = _brute(docs), _sets(docs)
    for block, chunk in ((near_dup.BLOCK, near_dup.CHUNK), (10, 7)):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "CHUNK", chunk)
        for r in near_dup.near_duplicates(df).collect():
            assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_collisions_of_pairs_at_the_threshold():
    """Signatures lose no pair at exactly 0.75, whatever the size of the union."""
    rng = np.random.default_rng(75)
    for size in (4, 20, 100, 400):
        for _ in range(400):
            x = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
            both, own = x[: 3 * size // 4], (size - 3 * size // 4) // 2
            a, b = np.sort(np.concatenate([both, x[len(both) : len(both) + own]])), np.sort(np.concatenate([both, x[len(both) + own :]]))
            assert near_dup.collide(near_dup.signature(a)[None, :], near_dup.signature(b)[None, :])[0]


def test_collide_counts_all_coordinates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (1, near_dup.COORDINATES)).astype(np.uint32)
    b = np.where(rng.random((500, 1)) < rng.random((500, near_dup.COORDINATES)), a, 9).astype(np.uint32)
    assert (near_dup.collide(a, b) == ((a == b).sum(1) >= near_dup.MATCHES)).all()


def test_drop_near_duplicates_by_row(spark):
    """Repeated ids with different texts, repeated rows and null ids have verdicts of their own."""
    text = [" ".join(f"{k}w{i}" for i in range(40)) for k in "abc"]
    rows = [(1, text[0], "x"), (1, text[1], "x"), (2, text[0] + " end", "x"), (3, text[1], "y"), (3, text[2], "z"), (3, text[2], "y"), (None, text[2], "x"), (None, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = sorted(near_dup.drop_near_duplicates(docs).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, text[0], "x"), (1, text[1], "x"), (3, text[2], "y"), (None, "", "x"), (None, "", "x")], key=lambda r: str(docs.sparkSession.createDataFrame([r], docs.schema).first()))


def test_near_duplicates_odd_rows(spark, odd, none):
    rows = near_dup.near_duplicates(odd).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 10 and by[4] == by[5] == 4 and by[1] == 1 and by[2] == 2 and by[6] == 6 and by[None] is None
    assert near_dup.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(25)] + [(7, 7), (None, 3)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in par}


# 9

def _speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_fusion(spark, odd, none):
    rng = random.Random(9)
    kinds = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "ung", "keit", "der"], "fr": ["eau", "ment", "ou", "que"]}
    rows = []
    for i in range(300):
        true = ["en", "de", "fr"][i % 3]
        said = true if i % 10 else "en"
        rows.append((i, _speech(rng, kinds[true], 40), said, f"host-{true}", true))
    rows += [(900, "", "en", "host-en", None), (901, "1234 ### 77", "en", "host-en", None), (902, "漢字漢字漢字漢字漢字漢字漢字", None, "host-x", None), (903, "ou", None, "host-fr", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, true string")
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert all(got[r[0]]["language"] == r[4] and got[r[0]]["accepted"] for r in rows[:300])
    assert not any(got[i]["accepted"] for i in (900, 901, 902)) and got[903]["language"] == "fr"
    assert language.identify(odd).count() == 10 and language.identify(none).count() == 0
    pages = spark.createDataFrame([(i, f"http://www.{r[3]}.example.{r[2]}/p", f'<html lang="{r[2]}"><script>the and</script><p>{r[1]}</p>') for i, r in enumerate(rows[:300])] + [(900, None, None)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in language.identify_pages(pages).collect()}
    assert all(out[i]["language"] == r[4] for i, r in enumerate(rows[:300])) and not out[900]["accepted"]


def test_language_equals_brute_force(spark):
    """Likelihoods, declared language, suffix and host priors fused row by row in plain Python."""
    rng = random.Random(19)
    kinds = {"de": ["sch", "ung", "keit", "der"], "en": ["the", "ing", "and", "tion"], "fr": ["eau", "ment", "ou", "que"]}
    rows = [(i, _speech(rng, kinds[rng.choice("de en fr".split())], rng.choice([1, 2, 30])), rng.choice(["de", "en", "fr", "xx", None]), f"h{rng.randint(0, 6)}", rng.choice(["de", "com"])) for i in range(200)] + [(200, "77", "en", "h1", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tld string")
    model = language.fit_text(df.selectExpr("doc_id AS id", "text", "lang AS declared"))
    names = [*model.languages, "und"]
    ll = {r[0]: model.log_likelihoods(r[1]) for r in rows}
    guess = {i: int(np.argmax(v)) if any(v) else None for i, v in ll.items()}
    judged = [r for r in rows if guess[r[0]] is not None]
    n = lambda test: np.array([sum(guess[r[0]] == k and test(r) for r in judged) for k in range(len(names))], float)
    base = (n(lambda r: True) + 1) / (len(judged) + len(names))
    base[-1] = min(base[-1], language.UNKNOWN_PRIOR)
    smooth = lambda c, p, w: (c + w * p) / (c.sum() + w)
    values = {r[2] for r in judged if r[2]}
    said = n(lambda r: r[2] is not None) + len(values)
    assert np.allclose(sum((n(lambda r, d=d: r[2] == d) + 1) / said for d in values), 1)
    for got in language.identify(df, suffix_col="tld", model=model).collect():
        i, _, lang, host, tld = rows[got["doc_id"]]
        if guess[i] is None:
            assert not got["accepted"] and got["language"] == "und"
            continue
        by_suffix = smooth(n(lambda r: r[4] == tld), base, language.SUFFIX_PRIOR)
        post = np.array(ll[i]) + np.log(smooth(n(lambda r: (r[3], r[4]) == (host, tld)), by_suffix, language.HOST_PRIOR))
        if lang:
            post += np.log((n(lambda r: r[2] == lang) + 1) / said)
        p = np.exp(post - post.max())
        assert got["language"] == names[int(post.argmax())] and abs(got["posterior"] - 1 / p.sum()) < 1e-5


def test_unidentified_rows_go_one_by_one(spark):
    rows = [(1, _speech(random.Random(k), ["the", "ing", "and", "tion"], 30), "en", "h") for k in range(40)] + [(1, "123", "en", "h"), (None, "###", "en", "h"), (None, "the thing and tion", "en", "h"), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r["text"] for r in language.drop_unidentified(docs).collect()) == sorted(r[1] for r in rows[:40] + rows[42:43])


# 10

def _items(rng, n):
    return [(i, " ".join(f"v{rng.randint(0, 400)}" for _ in range(rng.randint(6, 40))) + (". " if i % 2 else "? ") + " ".join(f"a{rng.randint(0, 90)}" for _ in range(rng.randint(1, 9))) + ".") for i in range(n)]


@pytest.mark.parametrize(("block", "group"), [(64, 64), (8, 2), (1, 3)])
def test_wand_retrieves_all_above_threshold(monkeypatch, block, group):
    """Against exhaustive sums computed from the BM25 formula, with large and small blocks."""
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    monkeypatch.setattr(decontam, "GROUP_BLOCKS", group)
    rng = random.Random(10)
    items = _items(rng, 170)
    index = decontam.Index(items)
    bags = {i: Counter(decontam.TOKEN.findall(t.lower())) for i, t in items}
    df = Counter(w for c in bags.values() for w in c)
    mean = sum(sum(c.values()) for c in bags.values()) / len(bags)

    def weight(c, w):
        idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
        return idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))

    share = {i: {w: weight(c, w) for w in c} for i, c in bags.items()}
    share = {i: {w: x / sum(v.values()) for w, x in v.items()} for i, v in share.items()}
    for _ in range(200):
        words = {f"v{rng.randint(0, 400)}" for _ in range(60)} | set(decontam.TOKEN.findall(rng.choice(items)[1])[:12])
        terms = np.unique(index.terms(sorted(words)))
        for least in (0.2, 0.4):
            want = {i: s for i, v in share.items() if (s := sum(x for w, x in v.items() if w in words)) >= least}
            found, scores = index.candidates(terms[terms >= 0], least)
            got = {index.ids[k]: x for k, x in zip(found, scores, strict=True)}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_takes_few_bytes():
    items = _items(random.Random(2), 5000)
    chars = sum(len(t) for _, t in items)
    assert decontam.Index(items).nbytes < 24 * chars and decontam.INDEX_CHARS * 24 <= 96 << 20


def test_leaks_are_found_and_clean_texts_stay(spark, odd, none):
    rng = random.Random(11)
    items = _items(rng, 40)
    noise = lambda n: " ".join(f"v{rng.randint(0, 400)}" for _ in range(n))
    docs = [(i, noise(300)) for i in range(60)] + [(100 + i, noise(rng.randint(0, 700)) + "\n" + items[i][1].upper() + "\n" + noise(50)) for i in range(40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (500, None), (501, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(40)}
    kept = decontam.drop_leaks(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(60)) and kept.columns == df.columns
    assert decontam.find_leaks(odd, bench).count() == 0 and decontam.drop_leaks(odd, bench).count() == 10
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_index_in_several_passes(spark, monkeypatch):
    items = _items(random.Random(12), 30)
    df = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontam.find_leaks(df, bench).collect())
    one = found()
    monkeypatch.setattr(decontam, "INDEX_CHARS", 900)
    assert found() == one and {(d, i) for d, i, _ in one} >= {(i, i) for i, _ in items}
