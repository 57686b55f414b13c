"""The longest prefix within a budget, by trying all prefixes."""

from __future__ import annotations

import random

import public_tokenizers

from granary.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fit_is_the_longest_prefix():
    bpe, rng = tokens.load(PATH), random.Random(8)
    parts = list("ab 's're ll  \n\t\u3000é1中-_!'tTHE") + ["<|endoftext|>", "  ", " the", "'re", "aaaaaaaa", "ing", "!!!!", " " * 9, "漢字漢字", "x😀😀"]
    for n in range(600):
        text = "".join(rng.choice(parts) * rng.choice((1, 1, 1, 30)) for _ in range(rng.randint(0, 12)))
        kept = tokens.PrefixCounts(bpe, text)
        counts = [kept.count(i) for i in range(len(text) + 1)]
        for budget in (0, 1, 2, 3, 5, 9, 20):
            assert kept.fit(budget) == max(i for i, c in enumerate(counts) if c <= budget), (text, budget)


def test_fit_of_one_long_piece(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(10_000)), "漢字仮名" * 2_500]
    got = [r["fit_chars"] for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).orderBy("doc_id").collect()]
    bpe = tokens.load(PATH)
    for text, n in zip(texts, got, strict=True):
        assert n > 400 and bpe.count(text[:n]) <= 1024 and all(bpe.count(text[:i]) > 1024 for i in range(n + 1, n + 20))
