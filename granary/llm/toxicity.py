"""Toxicity from class-conditional Kneser-Ney models over the letters of words."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_rows

LETTERS = regex.compile(r"\p{L}+")
#: Kneser-Ney order in letters, discount, and labelled documents used of each class (the documented bound).
ORDER, DISCOUNT, PER_CLASS = 6, 0.75, 4000
#: Words whose ratios count among the largest.
TOP = 8
REMEMBERED, GRAMS_REMEMBERED = 400_000, 600_000
EDGE = "\x02"  # stands before and after a word


def held_out(id_col: str):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Counts of letter n-grams by class, and shared backoff counts."""

    own: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])  # n-grams of full order
    total: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])  # by context
    kinds: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])  # different letters after a context
    cont: dict[str, int] = field(default_factory=dict)  # continuation counts of shorter n-grams, both classes
    cont_total: dict[str, int] = field(default_factory=dict)
    cont_kinds: dict[str, int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def __post_init__(self):
        self._low: dict[str, float] = {}
        self._gram: dict[str, float] = {}
        self._word: dict[str, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_low", "_gram", "_word")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def low(self, gram: str) -> float:
        """Shared backoff probability of the last letter after the others."""
        p = self._low.get(gram)
        if p is None:
            if not gram:
                return 1 / 256
            ctx = gram[:-1]
            below = self.low(gram[1:])
            n = self.cont_total.get(ctx, 0)
            p = (max(self.cont.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * self.cont_kinds[ctx] * below) / n if n else below
            if len(self._low) < REMEMBERED:
                self._low[gram] = p
        return p

    def probability(self, gram: str, toxic: int) -> float:
        """P(last letter | the others, class): discounted counts, and the shared backoff with what the discount frees."""
        ctx, low = gram[:-1], self.low(gram[1:])
        n = self.total[toxic].get(ctx, 0)
        return (max(self.own[toxic].get(gram, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[toxic][ctx] * low) / n if n else low

    def word(self, w: str) -> float:
        """log p(word | toxic) - log p(word | ordinary)."""
        v = self._word.get(w)
        if v is None:
            s, v, known = EDGE * (ORDER - 1) + w + EDGE, 0.0, self._gram
            for i in range(len(w) + 1):
                g = s[i : i + ORDER]
                x = known.get(g)
                if x is None:
                    x = math.log(self.probability(g, 1) / self.probability(g, 0))
                    if len(known) < GRAMS_REMEMBERED:
                        known[g] = x
                v += x
            if len(self._word) >= REMEMBERED:
                self._word.clear()
            if len(w) < 64:
                self._word[w] = v
        return v

    def features(self, text: str) -> tuple[float, float, float]:
        """Log-likelihood ratios: length-normalised over the whole text, over its TOP words, and over its most toxic word.

        The first alone misses a toxic expression in a long text, which all other words dilute.
        """
        words = LETTERS.findall(text.lower())
        if not words:
            return 0.0, 0.0, 0.0
        r = np.fromiter(map(self.word, words), float, len(words))
        top = np.partition(r, -TOP)[-TOP:] if len(r) > TOP else r
        return float(r.mean()), float(np.maximum(top, 0).sum() / TOP), float(top.max())

    def score(self, text: str) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _grams(words: DataFrame) -> DataFrame:
    """Counts of the full-order n-grams of padded words, by class."""
    pad = F.concat(F.lit(EDGE * (ORDER - 1)), "word", F.lit(EDGE))
    at = F.explode(F.transform(F.sequence(F.lit(1), F.length("pad") - (ORDER - 1)), lambda i: F.substr(F.col("pad"), i, F.lit(ORDER))))
    n = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}")
    return words.withColumn("pad", pad).select("toxic", "n", at.alias("gram")).groupBy("gram").agg(n(0), n(1))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, chosen by hash of the id.

    Three quarters of them give the n-gram counts, the rest the weights of the three features.
    Only n-gram counts of this bounded sample reach the driver; every occurrence of a word counts.
    Labels that are null, or whose document is missing, and ids with both labels are left out;
    without both classes every score is 0.5 or below.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id"))
    usable = usable.agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    pick = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(usable.filter("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "doc_id").dropDuplicates(["doc_id", "toxic"])
    chosen = chosen.withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(4)) == 0)
    words = (
        chosen.filter(~F.col("tune"))
        .select("toxic", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"))).alias("word"))
        .groupBy("toxic", "word")
        .agg(F.count("*").alias("n"))
    )
    m = Model()
    grams = set()
    for gram, n0, n1 in _grams(words).toLocalIterator(prefetchPartitions=True):
        grams.add(gram)
        ctx = gram[:-1]
        for c, n in ((0, n0), (1, n1)):
            if n:
                m.own[c][gram] = n
                m.total[c][ctx] = m.total[c].get(ctx, 0) + n
                m.kinds[c][ctx] = m.kinds[c].get(ctx, 0) + 1
    for _ in range(ORDER - 1):
        shorter: dict[str, int] = {}
        for g in grams:
            shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        for g, n in shorter.items():
            m.cont[g] = n
            m.cont_total[g[:-1]] = m.cont_total.get(g[:-1], 0) + n
            m.cont_kinds[g[:-1]] = m.cont_kinds.get(g[:-1], 0) + 1
        grams = set(shorter)
    tune = chosen.filter("tune").select("toxic", "text")
    held = tune.sparkSession.sparkContext.broadcast(m)

    def start():
        def step(cols):
            f = [held.value.features(t or "") for t in cols["text"]]
            return {"y": cols["toxic"], "a": [x[0] for x in f], "b": [x[1] for x in f], "c": [x[2] for x in f]}

        return step

    rows = map_rows(tune, start, "y int, a double, b double, c double").collect()  # at most 2 * per_class rows
    m.weights = _logistic(np.array([r[1:] for r in rows], dtype=float).reshape(-1, 3), np.array([r[0] for r in rows], dtype=float))
    held.unpersist()
    return m


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Ridge-penalised logistic regression by Newton steps, on standardised features."""
    if not len(y) or y.min() == y.max():
        return [-10.0, 0.0, 0.0, 0.0]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(y), 1)), (x - mean) / scale])
    w, pen = np.zeros(4), np.diag([1e-6, ridge, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (y - p) - pen @ w)
    out = w[1:] / scale
    return [float(w[0] - out @ mean), *map(float, out)]


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by ``model``; one row per input row.

    Null and empty texts get the score of no evidence. Ids may be null (never held out) or
    repeated. Labels, language, source and id are no inputs of the score.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def step(cols):
            s = [held.value.score(t or "") for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s]}

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, start, f"doc_id {kind}, held_out boolean, score double, predicted int")
