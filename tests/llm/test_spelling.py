"""op11 against a brute-force version, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import spelling
from granary.llm import queries as q

DOCS = "doc_id long, text string, word string, n int"


def _words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= 7
    return {w: n for w, n in seen.items() if n >= 2}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _brute(rows):
    n = _words(rows)
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) <= 1 and _one_edit(v, w)]
        form = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (n[w], len(near), form if form and n[form] >= 10 * n[w] else None)
    last = {}
    for w in out:
        x = w
        while out[x][2]:
            x = out[x][2]
        last[w] = x
    return {(w, f, last[w], k, m, n[f] if f else None) for w, (k, m, f) in out.items()}


def _got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "abcéÉßÿ×"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(len(letters))
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(25)]

    def typed():
        w = list(rng.choice(stems[: rng.randint(1, 25)]))
        while rng.random() < 0.3:
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)]])
        return "".join(w).title() if rng.random() < 0.2 else "".join(w)

    rows = [(i, rng.choice([" ", ", ", "-"]).join(typed() for _ in range(rng.randint(0, 60)))) for i in range(120)]
    want = _brute(rows)
    assert len(want) > 30 and _got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_forms_lead_to_roots_over_several_hops(spark):
    rows = [(7, " ".join(["abcdefgx"] * 4000 + ["abcdefgh"] * 300 + ["abcdefghi"] * 20 + ["abcdefghij"] * 2))]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["abcdefghij"]["form"] == "abcdefghi" and got["abcdefghij"]["root"] == "abcdefgx" and got["abcdefgx"]["form"] is None


def test_awkward_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "long" * 50_000 + " " + "long" * 50_000, "x", 1), (None, "repeated repeated", "x", 1), (5, "once twicetwice twicetwice", None, None), (5, "once twicetwice twicetwice", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert _got(spelling.spelling_variants(df)) == _brute([r[:2] for r in rows])
    assert spelling.spelling_variants(df.filter(F.lit(False))).count() == 0


def test_query_equals_brute_force_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(q.op11_spelling(spark, sf)) == _brute(rows)
