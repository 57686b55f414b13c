"""Rare, many and missing declared languages."""

from __future__ import annotations

import random

from granary.llm import language

SCHEMA = "doc_id long, text string, lang string, source string"


def _said(rng, letters, n=40):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_rare_languages_in_their_own_script(spark):
    rng = random.Random(1)
    rows = [(i, _said(rng, ["the", "ing", "and", "tion"]), "en", "h") for i in range(200)]
    rows += [(900, _said(rng, "αβγδεηικλμν"), "el", "h"), (901, _said(rng, "бвгдежзиклм"), "bg", "h"), (902, _said(rng, "漢字仮名交文"), None, "h")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[i]["language"], got[i]["accepted"]) for i in (0, 900, 901)] == [("en", True), ("el", True), ("bg", True)]
    assert all(got[i]["accepted"] for i in range(200)) and not got[902]["accepted"]


def test_more_than_64_languages(spark):
    rng = random.Random(2)
    rows = []
    for k in range(90):
        letters = [chr(0x4E00 + 20 * k + j) for j in range(12)]
        rows += [(10 * k + j, _said(rng, letters), f"l{k:02}", f"h{k}") for j in range(5 if k % 2 else 1)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r["language"] == f"l{r['doc_id'] // 10:02}" and r["accepted"] for r in got)


def test_no_or_unknown_declared_language(spark):
    rows = [(i, t, None, "h") for i, t in enumerate(["some words", "λόγος", "", "123", None])]
    got = {r["doc_id"]: r["accepted"] for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}
    rng = random.Random(3)
    model = language.fit_text(spark.createDataFrame([(i, _said(rng, ["the", "ing"]), "en") for i in range(50)], "id long, text string, declared string"))
    greek = spark.createDataFrame([(1, _said(rng, "αβγδεηικ"), "el", "h"), (2, _said(rng, "αβγδεηικ"), None, "h"), (3, "77", "el", "h")], SCHEMA)
    assert {r["doc_id"]: r["accepted"] for r in language.identify(greek, model=model).collect()} == {1: True, 2: False, 3: False}


def test_languages_beyond_the_bound_share_a_model(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for i, (name, letters) in enumerate((("en", ["the", "ing", "and"]), ("de-AT", ["sch", "ung", "ein"]), ("el", "αβγδεηικλμν"), ("bg", "бвгдежзиклм"), ("ka", "აბგდევზთიკლ"))):
        for _ in range(60 - 10 * i):
            rows.append((k, _said(rng, letters), name, f"h{i}"))
            k += 1
    rows += [(900, _said(rng, "αβγδεηικλμν"), "other", "h9"), (901, "12 3", "bg", "h9"), (902, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.fit_text(df.select(df.doc_id.alias("id"), "text", language.base_language(df.lang).alias("declared")), most=2)
    assert model.languages == ["de", "en", "other"]
    got = {r["doc_id"]: r for r in language.identify(df, model=model).collect()}
    assert all(got[i]["language"] == name.split("-")[0] and got[i]["accepted"] for i, _, name, _ in rows[:k])
    assert got[900]["language"] == "other" and got[900]["accepted"] and not got[901]["accepted"] and not got[902]["accepted"]
