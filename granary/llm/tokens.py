"""Token counts from a prefix dynamic programme over a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from granary.llm.common import map_rows

#: Fixed value: how a byte-level BPE splits text before merging (White_Space written out for \s).
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts of code points below 256, with the classes written out: twice as fast.
LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: Pieces remembered by a task before the memory starts anew.
REMEMBERED, PAIRS = 1_200_000, 800_000
NEVER = 1 << 60


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Exact token counts of all prefixes of a piece.

    A sequence of tokens is a BPE encoding exactly if each two neighbours are the encoding of
    their own bytes. So every prefix has one last token that fits the last token of the prefix
    before it, and count[i] = count[i - len(token)] + 1.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to = _byte_chars()
        raw = lambda s: bytes(to[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        #: how a token came about: its two parts and the rank of their merge
        self.split: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (a, b), i in self.rank.items():
            self.split.setdefault(a + b, (a, b, i))
        self._edges: tuple[dict, dict] = ({}, {})
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if all(c in to for c in s)}
        ends: dict[bytes, set[int]] = {}
        for t in self.vocab:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        #: lengths of the longer tokens that end with these three bytes, and those of all ends, longest first
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self.counts = _Counts(self)

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of ``token`` at one end, smallest first, each with the rank of the merge that ends it."""
        got = self._edges[side].get(token)
        if got is None:
            got, end = [(token, NEVER)], token
            while (split := self.split.get(end)) is not None:
                end = split[side]
                got.append((end, split[2]))
            got.reverse()
            self._edges[side][token] = got
        return got

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether no merge crosses from a to b (either may be empty): is [a, b] the encoding of a + b?

        Both ends grow from single bytes in rank order; a crossing merge would have to come
        before the merge that next takes either neighbour away (the left one first if equal).
        """
        if not a:
            return True
        k = (a, b)
        if (v := self._fits.get(k)) is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            left, right, rank, i, j, v = self._edge(a, 1), self._edge(b, 0), self.rank, 0, 0, True
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                m = rank.get((x, y), NEVER)
                if m < x_end and m <= y_end:
                    v = False
                    break
                if x_end == y_end == NEVER:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            self._fits[k] = v
        return v

    def prefix_counts(self, word: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes."""
        n, vocab, fits, lengths = len(word), self.vocab, self.fits, self.lengths
        count, last = [0] * (n + 1), [b""] * (n + 1)
        known = self._fits
        for i in range(1, n + 1):
            for size in lengths.get(word[i - 3 : i] if i > 2 else b"", (2, 1)):
                if size <= i:
                    t = word[i - size : i]
                    if t in vocab:
                        j = i - size
                        if j and ((ok := known.get((last[j], t))) is False or (ok is None and not fits(last[j], t))):
                            continue
                        count[i], last[i] = count[j] + 1, t
                        break
            else:
                raise ValueError(f"no token fits at byte {i}")
        return count

    def segments(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, special?) of the text between special strings, and of these."""
        if not any(s in text for s in self.special):
            return [(0, len(text), False)]
        out, at = [], 0
        for m in regex.finditer("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), text):
            out += [(at, m.start(), False), (m.start(), m.end(), True)]
            at = m.end()
        return [*out, (at, len(text), False)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, get = 0, self.counts.__getitem__
        find = (LATIN if max(text) < "\u0100" else PIECES).findall
        for a, b, special in self.segments(text):
            total += 1 if special else sum(map(get, find(text[a:b])))
        return total


class _Counts(dict):
    """Tokens of a whole piece, by the piece."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self.bpe.prefix_counts(piece.encode())[-1]
        if len(piece) < 64:
            self[piece] = n
        return n


class PrefixCounts:
    """The token count of every prefix of one text, kept at the ends of its pieces."""

    def __init__(self, bpe: PrefixBpe, text: str):
        self.bpe, self.text = bpe, text
        self.starts, self.totals, self.kept = [], [0], []
        for a, b, special in bpe.segments(text):
            spans = [(a, b)] if special else [(a + m.start(), a + m.end()) for m in PIECES.finditer(text[a:b])]
            for s, e in spans:
                self.starts.append(s)
                self.kept.append(special)
                self.totals.append(self.totals[-1] + (1 if special else bpe.counts[text[s:e]]))
        self.ends = [*self.starts[1:], len(text)]
        self._inside: dict[int, list[int]] = {}

    def inside(self, k: int) -> list[int]:
        """Tokens of every byte prefix of piece ``k``, computed once."""
        if k not in self._inside:
            self._inside[k] = self.bpe.prefix_counts(self.text[self.starts[k] : self.ends[k]].encode())
        return self._inside[k]

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points, as if they were the whole text."""
        if chars >= len(self.text):
            return self.totals[-1]
        k = bisect_right(self.starts, chars) - 1 if self.starts else 0
        if chars <= 0 or not self.starts:
            return 0
        if self.starts[k] == chars:
            k -= 1
        if chars == self.ends[k] and self.kept[k]:
            return self.totals[k + 1]
        if self.kept[k] and k and not self.kept[k - 1]:
            k -= 1  # a cut special string is ordinary text, one piece with what stands before it
        # white space before the cut is one piece with what follows it
        while k and not self.kept[k - 1] and not self.kept[k] and self.text[self.starts[k - 1] : self.ends[k - 1]].isspace():
            k -= 1
        s = self.starts[k]
        part = self.text[s:chars]
        pieces = PIECES.findall(part)
        if len(pieces) == 1 and not self.kept[k] and chars <= self.ends[k]:  # the cut piece is a prefix of the whole one
            return self.totals[k] + self.inside(k)[len(part.encode())]
        return self.totals[k] + sum(self.bpe.counts[p] for p in pieces)

    def fit(self, budget: int) -> int:
        """The longest prefix, in code points, of at most ``budget`` tokens.

        It ends in the piece that exceeds the budget, or in the next one where the cut changes how
        white space or special strings are split. Inside a piece the counts of all its prefixes
        are known at once; only cuts that may be split otherwise are counted on their own.
        """
        k = bisect_right(self.totals, budget) - 1
        if k >= len(self.starts):
            return len(self.text)
        for j in range(min(k + 1, len(self.starts) - 1), k - 1, -1):
            s, e = self.starts[j], self.ends[j]
            piece = self.text[s:e]
            # a white-space piece after another is one piece with it if the text ends there
            split = self.kept[j] or (j and piece.isspace() and not self.kept[j - 1] and self.text[s - 1].isspace())
            low = s if split else min(s + 3, e - 1)  # contractions and a leading space are shorter than four
            if self.count(e) <= budget:
                return e
            if low < e - 1 and not split:
                room = budget - self.totals[j]
                if room > 0:
                    counts = self.inside(j)
                    size = len(counts) - 1
                    for i in range(e - 1, low, -1):
                        size -= len(self.text[i].encode())
                        if counts[size] <= room:
                            return i
                top = low
            else:
                top = e - 1
            for i in range(top, s, -1):
                if self.count(i) <= budget:
                    return i
        return self.starts[k]


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Token counts of whole texts, and how many code points fit into ``limit`` tokens.

    Null texts count as empty: 0 bytes, 0 tokens. Special strings inside a text are one token
    each, as the tokenizer's file says. One row per input row; ids may be null or repeated.
    """

    def start():
        bpe = load(path)

        def step(cols):
            texts = [t or "" for t in cols["text"]]
            n = [bpe.count(t) for t in texts]
            fit = [len(t) if k <= limit else PrefixCounts(bpe, t).fit(limit) for t, k in zip(texts, n, strict=True)]
            return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n], "fit_chars": fit}

        return step

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, start, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the ends of its pieces (code points) and the token count up to each.

    Between two ends the count follows from the piece alone (``PrefixCounts.count``), so
    truncation and budget questions need no second encoding. Empty arrays for null or empty texts.
    """

    def start():
        bpe = load(path)

        def step(cols):
            kept = [PrefixCounts(bpe, t or "") for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "ends": [k.ends if k.starts else [] for k in kept], "counts": [k.totals[1:] for k in kept]}

        return step

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, start, f"doc_id {kind}, ends array<long>, counts array<long>", chunk=64)
