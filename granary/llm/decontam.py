"""Benchmark decontamination: a BM25 index of test items with block-max WAND, then overlap checks."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordHashes, map_rows, shingles
from granary.session import Scratch

TOKEN = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach, and share of the word triples of question and of answer.
LEAST_SCORE, LEAST_OVERLAP, GRAM = 0.5, 0.6, 3
#: Most items of a block (a small benchmark has smaller ones), blocks of a group of blocks, and words of a passage.
BLOCK_ITEMS, GROUP_BLOCKS, PASSAGE = 64, 64, 256
LEAST_ITEMS = 16
#: Most text of items in one broadcast index, at most about 96 MiB in memory; a larger benchmark is searched in several passes.
INDEX_CHARS = 4 << 20
#: Sums in another order differ by rounding; bounds are compared with so much room.
ROOM = 1e-9


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: up to the last question mark, else all but the last sentence, else halves."""
    cut = text.rfind("?") + 1
    if not cut or not TOKEN.search(text[cut:]):
        ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
        cut = ends[-1] if ends else 0
    q, a = TOKEN.findall(text[:cut].lower()), TOKEN.findall(text[cut:].lower())
    if not q or not a:
        both = q + a
        q, a = both[: (len(both) + 1) // 2], both[(len(both) + 1) // 2 :]
    return q, a


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All indexes of the ranges [start, end), one range after another."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _levels(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ``keys`` (sorted), where the entries of each begin (and the end), and the greatest value of each."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.intp)
    most = np.maximum.reduceat(values, at) if len(at) else np.zeros(0)
    return keys[at], np.append(at, len(keys)), most


class Index:
    """An inverted index in flat arrays: postings by term and item, their blocks, and groups of blocks.

    Weights are BM25 contributions divided by the item's score for itself, so one threshold
    holds for all items. Items are ordered by length: those of a block have similar weights.
    Every term knows its greatest weight at all, in each group and in each block. ``whole`` has the number
    of items, their mean and greatest length and the df of terms where ``items`` are only a
    part of the benchmark.
    """

    def __init__(self, items: Sequence[tuple[object, str | None]], whole: tuple[int, float, int, dict[str, int]] | None = None):
        parsed = [(i, *split_item(t or "")) for i, t in items]
        parsed = sorted((p for p in parsed if p[1] or p[2]), key=lambda p: (len(p[1]) + len(p[2]), str(p[0])))
        sizes = [len(q) + len(a) for _, q, a in parsed]
        tf = [Counter(q + a) for _, q, a in parsed]
        df = Counter(w for c in tf for w in c)
        n, mean, self.longest = len(parsed), sum(sizes) / max(1, len(parsed)), max(sizes, default=0)
        if whole:
            n, mean, self.longest, known = whole
            df = {w: known[w] for w in df}
        mean = max(1.0, mean)
        self.ids = [i for i, _, _ in parsed]
        hashes = WordHashes()
        h = lambda words: hashes.of([w.encode() for w in words])
        self.place = place = {w: k for k, w in enumerate(sorted(df))}
        term, item, weight = [], [], []
        for k, c in enumerate(tf):
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * sizes[k] / mean)) for t, f in c.items()}
            own = sum(w.values())
            term += [place[t] for t in w]
            item += [k] * len(w)
            weight += [x / own for x in w.values()]
        term, item, weight = np.array(term, np.int64), np.array(item, np.int64), np.array(weight, float)
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order].astype(np.int32), weight[order]
        #: items of a block: so few that a benchmark of one group has as many blocks as a group may have
        self.size = min(BLOCK_ITEMS, max(LEAST_ITEMS, len(parsed) // GROUP_BLOCKS))
        self.blocks = -(-len(parsed) // self.size)
        self.groups = -(-self.blocks // GROUP_BLOCKS)
        keys, self.block_start, self.block_most = _levels(term * max(1, self.blocks) + self.item // self.size, self.weight)
        self.block, of = (keys % max(1, self.blocks)).astype(np.int32), keys // max(1, self.blocks)
        # of each group of each term: its key (term, group), its first block and its greatest weight
        self.group, self.group_start, self.group_most = _levels(of * max(1, self.groups) + self.block // GROUP_BLOCKS, self.block_most)
        _, _, self.most = _levels(self.group // max(1, self.groups), self.group_most)
        parts = [shingles(h(w), GRAM) for _, q, a in parsed for w in (q, a)]
        #: word triples of question and answer of each item, and how long they are (short ones are a whole part)
        self.grams = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.gram_start = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        self.gram_size = np.array([min(GRAM, len(w)) for _, q, a in parsed for w in (q, a)], np.int8)

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays, and about as many as the dictionary of the words takes."""
        return sum(x.nbytes for x in self.__dict__.values() if isinstance(x, np.ndarray)) + sum(120 + len(w) for w in self.place)

    def terms(self, words: list[str]) -> np.ndarray:
        """The terms of words, -1 for words of no item."""
        get = self.place.get
        return np.fromiter([get(w, -1) for w in words], np.int64, len(words))

    def candidates(self, terms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Items whose score for the different ``terms`` is at least ``least``, and their scores.

        Block-max WAND: the lists stand at their next group of blocks; in the order of these, the
        one with which the sum of greatest weights reaches ``least`` gives the pivot, and lists
        before it skip to it. The pivot's group is left out if the greatest weights in the group
        do not reach ``least``; else its blocks are, and the items of those that stay are scored. With
        one group its block bounds are taken at once: pivots between so few blocks cost more than they skip.
        """
        most, groups = self.most[terms], self.groups
        least -= ROOM
        if most.sum() < least:
            return np.zeros(0, np.intp), np.zeros(0)
        if groups == 1:  # every list has this one group, under the number of its term
            return self._group(terms, 0, least)
        base = terms * groups
        keys, n = self.group, len(self.group)
        at = np.searchsorted(keys, base)
        found = []
        while True:
            where = np.where(at < n, keys[np.minimum(at, n - 1)] - base, groups)
            where = np.minimum(where, groups)  # the next term's entries mean that this list has ended
            order = np.argsort(where, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(most[order]), least))
            if pivot >= len(order) or (goal := where[order[pivot]]) >= groups:
                break
            late = where < goal
            if late.any():
                at[late] = np.searchsorted(keys, base[late] + goal)
                where = np.minimum(np.where(at < n, keys[np.minimum(at, n - 1)] - base, groups), groups)
            here = at[where == goal]
            if self.group_most[here].sum() >= least:
                found.append(self._group(here, int(goal) * GROUP_BLOCKS, least))
            at[where == goal] += 1
        if not found:
            return np.zeros(0, np.intp), np.zeros(0)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _group(self, entries: np.ndarray, first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the items in the blocks of one group that the greatest weights of blocks allow."""
        b = _ranges(self.group_start[entries], self.group_start[entries + 1])
        own = self.block[b] - first
        live = np.bincount(own, self.block_most[b], minlength=GROUP_BLOCKS) >= least
        b = b[live[own]]
        p = _ranges(self.block_start[b], self.block_start[b + 1])
        score = np.bincount(self.item[p] - first * self.size, self.weight[p])
        hit = np.flatnonzero(score >= least)
        return hit + first * self.size, score[hit]

    def search(self, text: str, hashes: WordHashes, least: float = LEAST_SCORE, overlap: float = LEAST_OVERLAP) -> list[tuple[object, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of the items found in a text, best passage of each."""
        if not self.ids:
            return []
        words = TOKEN.findall(text.lower())
        ids = self.terms(words)
        # every run of words as long as the longest item lies whole in some passage
        width = max(PASSAGE, 2 * self.longest)
        step = width - self.longest + 1
        best: dict[int, tuple[float, float, float]] = {}
        for s in range(0, max(1, len(words) - self.longest + 1), step):
            part = ids[s : s + width]
            part = np.sort(part[part >= 0])
            if not len(part):
                continue
            items, scores = self.candidates(part[np.append(True, part[1:] != part[:-1])], least)
            if not len(items):
                continue
            h, have = hashes.of([w.encode() for w in words[s : s + width]]), {}
            for k, score in zip(items.tolist(), scores.tolist(), strict=True):
                q, a = (self._share(2 * k + side, h, have) for side in (0, 1))
                if q >= overlap and a >= overlap and (k not in best or best[k][0] < score):
                    best[k] = (score, q, a)
        return [(self.ids[k], *v) for k, v in sorted(best.items())]

    def _share(self, part: int, h: np.ndarray, have: dict[int, np.ndarray]) -> float:
        """Share of the word triples of a question or answer that are in a passage."""
        want = self.grams[self.gram_start[part] : self.gram_start[part + 1]]
        if not len(want):
            return 1.0
        n = int(self.gram_size[part])
        if n not in have:
            have[n] = shingles(h, n)
        return len(np.intersect1d(want, have[n], assume_unique=True)) / len(want)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str):
    """Broadcast indexes that cover all items, each over at most INDEX_CHARS of text."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // INDEX_CHARS))
    held = benchmark.sparkSession.sparkContext.broadcast
    if passes == 1:
        yield held(Index([(r[0], r[1]) for r in rows.collect()]))
        return
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(passes)))

    def start():
        def step(cols):
            words = [[w for half in split_item(t) for w in half] for t in cols["text"]]
            return {"part": cols["part"], "size": list(map(len, words)), "words": [sorted(set(w)) for w in words]}

        return step

    # n, mean and greatest length and df are those of all items, whatever part an item is in
    work = Scratch(benchmark.sparkSession, "benchmark")
    words = work.keep(map_rows(rows.select("part", "text"), start, "part long, size long, words array<string>").filter("size > 0"), "words")
    n, mean, longest = words.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(0.0)), F.coalesce(F.max("size"), F.lit(0))).first()
    each = words.select("part", F.explode("words").alias("word")).groupBy("part", "word").agg(F.count("*").alias("n"))
    df = work.keep(each.join(each.groupBy("word").agg(F.sum("n").alias("df")), "word").select("part", "word", "df"), "df")
    for k in range(passes):
        own = {r[0]: r[1] for r in df.filter(F.col("part") == k).select("word", "df").collect()}
        yield held(Index([(r[0], r[1]) for r in rows.filter(F.col("part") == k).select("item", "text").collect()], (n, mean, longest, own)))
    work.drop()


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE, overlap: float = LEAST_OVERLAP) -> DataFrame:
    """One row for each document and test item that it contains: scores and overlaps of the best passage.

    Every passage of every whole text is a query (passages overlap by the longest item's length).
    All items whose BM25 score is at least ``least`` of their score for themselves are retrieved;
    a pair stays if at least ``overlap`` of the word triples of its question and of its answer are
    in the passage. Null and empty texts and items match nothing; repeated rows give repeated
    pairs. The index is broadcast in parts of a bounded size, however large the benchmark.
    """
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for held in _indexes(benchmark, item_col, item_text_col):

        def start(held=held):
            hashes = WordHashes()

            def step(cols):
                got: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "score", "question_overlap", "answer_overlap")}
                for i, t in zip(cols["doc_id"], cols["text"], strict=True):
                    for x in held.value.search(t or "", hashes, least, overlap):
                        for c, v in zip(got, (i, *x), strict=True):
                            got[c].append(v)
                return got

            return step

        part = map_rows(rows, start, f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE, overlap: float = LEAST_OVERLAP) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts contain no test item; see ``find_leaks``."""
    names = docs.columns
    at = names.index(text_col)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for held in _indexes(benchmark, item_col, item_text_col):

        def start(held=held):
            hashes = WordHashes()

            def step(cols):
                keep = [not held.value.search(t or "", hashes, least, overlap) for t in cols[f"c{at}"]]
                return {c: [x for x, k in zip(v, keep, strict=True) if k] for c, v in cols.items()}

            return step

        rows = map_rows(rows, start, schema)
    return rows.toDF(*names)
