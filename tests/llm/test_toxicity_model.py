"""Kneser-Ney probabilities from their definition, and which labels count."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from granary.llm import toxicity as t


def _docs(rng):
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(120):
        words = [word(["ba", "no", "tu", "é"]) for _ in range(12)]
        if i % 3 == 0:
            words += [word(["gr", "rx", "ba"]) for _ in range(4)]
        rows.append((i, " ".join(words) + " x² 77 " + words[0].upper()))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


def test_probabilities_equal_the_definition(spark):
    rows, labels = _docs(random.Random(6))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = t.fit(d, lab)
    # which documents gave the counts is read off the operator's own rules
    tuned = {r[0] for r in d.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'tune'), 4) = 0 AS t").collect() if r["t"]}
    held = {r[0] for r in d.select("doc_id", t.held_out("doc_id").alias("h")).collect() if r["h"]}
    toxic = dict(labels)
    own = (Counter(), Counter())
    for i, text in rows:
        if i not in tuned and i not in held:
            for w in t.LETTERS.findall(text.lower()):
                s = t.EDGE * (t.ORDER - 1) + w + t.EDGE
                own[toxic[i]].update(s[k : k + t.ORDER] for k in range(len(w) + 1))
    full = set(own[0]) | set(own[1])

    def low(gram):
        if not gram:
            return 1 / 256
        longer = full
        for _ in range(t.ORDER - 1 - len(gram)):
            longer = {g[1:] for g in longer}
        count = Counter(g[1:] for g in longer)
        same = {g: n for g, n in count.items() if g[:-1] == gram[:-1]}
        if not same:
            return low(gram[1:])
        return (max(count[gram] - t.DISCOUNT, 0) + t.DISCOUNT * len(same) * low(gram[1:])) / sum(same.values())

    def p(gram, c):
        same = {g: n for g, n in own[c].items() if g[:-1] == gram[:-1]}
        if not same:
            return low(gram[1:])
        return (max(own[c][gram] - t.DISCOUNT, 0) + t.DISCOUNT * len(same) * low(gram[1:])) / sum(same.values())

    for w in ("grrxba", "bano", "tué", "zzz", "b", "rxno"):
        s = t.EDGE * (t.ORDER - 1) + w + t.EDGE
        grams = [s[k : k + t.ORDER] for k in range(len(w) + 1)]
        for g in grams:
            assert m.probability(g, 1) == pytest.approx(p(g, 1)) and m.probability(g, 0) == pytest.approx(p(g, 0))
        assert m.word(w) == pytest.approx(sum(math.log(p(g, 1) / p(g, 0)) for g in grams))
    # probabilities of the 256 letters of the uniform model sum to 1
    ctx = t.EDGE * (t.ORDER - 1)
    assert sum(m.probability(ctx + chr(c), 1) for c in range(2, 258)) == pytest.approx(1)


def test_conflicting_labels_count_for_neither_class(spark):
    rows, labels = _docs(random.Random(7))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    both = labels + [(i, 1 - y) for i, y in labels[:60]] + [(None, 1), (5000, 1), (3, None)]
    a = t.fit(d, spark.createDataFrame(both, "doc_id long, toxic int"))
    b = t.fit(d, spark.createDataFrame(labels[60:], "doc_id long, toxic int"))
    assert a.own == b.own and a.weights == pytest.approx(b.weights)
    ties = t.score_toxicity(spark.createDataFrame([(1, "ba no"), (2, "ba no"), (3, None), (4, "")], "doc_id long, text string"), a).collect()
    by = {r["doc_id"]: r["score"] for r in ties}
    assert by[1] == by[2] and by[3] == by[4]
