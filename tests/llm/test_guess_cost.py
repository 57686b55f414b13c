"""The guess cost against a segmentation that tries every substring, and spans in long texts."""

from __future__ import annotations

import math
import random
import time

import pytest

from granary.llm import secrets as s


def _segment(value, low, i, j):
    """Least cost of value[i:j] as one segment that is no brute-force span, by definition."""
    part, own, out = low[i:j], value[i:j], math.inf
    plain = part.translate(s.LEET)
    n = j - i
    if 2 <= n <= s.LONGEST_WORD:
        if part in s.RANK:
            out = math.log10(s.RANK[part] + 1) + 0.5 * (own != part)
        if plain != part and plain in s.RANK:
            out = min(out, math.log10(s.RANK[plain] + 1) + 0.5 + 0.5 * (own != part))
    if s.DATE.fullmatch(part):
        out = min(out, s.YEAR_COST if n == 4 else s.DATE_COST)
    if n >= 3:
        steps = {ord(b) - ord(a) for a, b in zip(part, part[1:], strict=False)}
        length = s.TWICE * int(math.log2(n))
        if steps == {0}:
            out = min(out, math.log10(s._alphabet(part[0])) + length)
        if steps in ({1}, {-1}):
            out = min(out, math.log10(52) + length)
        if all(s._adjacent(a, b) for a, b in zip(part, part[1:], strict=False)):
            out = min(out, math.log10(376) + length)
    return out


def _brute(value):
    low = value.lower()
    n = len(value)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            span = sum(math.log10(s._alphabet(c)) + (s.TWICE if c.isupper() else 0) for c in value[i:j])
            best[j] = min(best[j], best[i] + (s.TWICE if i else 0) + min(span, _segment(value, low, i, j)))
    return best[n]


def _value(rng):
    parts = [lambda: rng.choice(s.WORDS), lambda: rng.choice("a1x!") * rng.randint(1, 9), lambda: rng.choice(["20240101", "1999", "3-4-2001", "12/31/1987"]), lambda: "".join(rng.choice("abcdeXYZ019$@") for _ in range(rng.randint(1, 5))), lambda: rng.choice(["qwertz", "zxcvbn", "hgfds", "abcdefg", "9876543", "qazxsw"])[rng.randint(0, 2) :], lambda: rng.choice(s.WORDS).replace("a", "@").replace("o", "0").title()]
    return "".join(rng.choice(parts)() for _ in range(rng.randint(1, 5)))[:26]


def test_cost_is_the_minimum():
    rng = random.Random(4)
    for _ in range(2000):
        v = _value(rng)
        assert s.guess_cost(v) == pytest.approx(_brute(v)), v


@pytest.mark.parametrize("value", ["aaaadmin", "zxcvbnmaster", "hgfdsadmin20240101x", "aaaaadminsssssecret", "20240101" * 2, "a", "A", "İstanbul"])
def test_named_values(value):
    assert s.guess_cost(value) <= (_brute(value) if len(value.lower()) == len(value) else 99) + 1e-9


def test_long_values_and_texts_take_little_time():
    start = time.perf_counter()
    assert s.guess_cost("x" * 50_000) < 10 < s.guess_cost("k7$Qz" * 2000)
    s.find_spans("password = abcdef12 pwd: aaaaadminsssssecret " * 20_000)
    assert time.perf_counter() - start < 20


def test_easy_value_is_no_secret():
    assert not s.find_spans("pwd: aaaaadminsssssecret")[0]


def test_words_of_the_corpus_rank_behind_the_fixed_ones(spark):
    docs = spark.createDataFrame([(1, "zorblax zorblax Zorblax wimbly wimbly qux1 nine"), (2, None), (3, "")], "doc_id long, text string")
    ranks = s.rank_words(docs)
    assert ranks["password"] == 1 and ranks["zorblax"] == len(s.RANK) + 1 and ranks["wimbly"] == len(s.RANK) + 2
    assert s.guess_cost("zorblaxwimbly", ranks) < 6 < s.guess_cost("zorblaxwimbly")
    text = "passphrase: zorblaxwimblyzorblax"
    assert s.find_spans(text)[0] and not s.find_spans(text, ranks=ranks)[0]
    assert s.rank_words(docs.limit(0)) == s.RANK
