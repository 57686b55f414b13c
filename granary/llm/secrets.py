"""Secret scans: fixed patterns, and guess costs of values in credential contexts."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_rows
from granary.session import Scratch

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider credential contexts, in which a value counts only if it is hard to guess. The key may be the end of a longer name (DB_PASS).
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|pin|credentials?|auth|authorization|bearer|private_?key|client_?key|access_?key|signing_?key)\b["']?\x20*(?:[:=]|\bis\b)\x20*(?:bearer\x20+)?["']?([^\s"'<>,;|]+)""",
    re.I | re.A,
)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
WIDER = ("pwd", "pass", "pin", "credential", "auth", "bearer", "key")

#: Words of the corpus that follow the password words in the ranking (the documented bound of the table).
CORPUS_WORDS, LONGEST_WORD = 30_000, 20
#: Frequent password words, most frequent first (the place is the guess rank).
WORDS = """password admin welcome letmein monkey dragon login princess master hello sunshine shadow football
baseball iloveyou secret superman batman trustno hunter summer winter spring autumn flower freedom whatever
qazwsx ninja mustang michael jordan harley ranger buster soccer hockey killer george charlie andrew michelle
love pepper daniel access joshua maggie starwars silver william dallas yankees hammer thunder ginger orange
purple banana cookie chicken cheese coffee computer internet service test guest user root server database
oracle system manager changeme default temp demo example sample public private key token api dev prod stage
live main house green blue black white happy lucky angel friend family money power magic music tiger lion
eagle wolf bear horse apple google amazon android windows linux ubuntu docker cloud data code the and you
for me my one two three""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LEET = str.maketrans("@4301!5$7+2", "aaeoiissttz")
#: Rows of a keyboard; neighbours on a row, or across rows at the same place, are adjacent.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_MONTH, _DAY = "(?:1[0-2]|0?[1-9])", "(?:3[01]|[12][0-9]|0?[1-9])"
DATE = re.compile(rf"(?:19|20)[0-9]{{2}}[-/._]?{_MONTH}[-/._]?{_DAY}|{_DAY}[-/._]?{_MONTH}[-/._]?(?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}")
DATE_COST, YEAR_COST = math.log10(366 * 120), math.log10(120)
#: Guesses for a further segment, an upper-case letter or twice the length: a factor of 2.
TWICE = math.log10(2)


def _adjacent(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(c: str) -> float:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 200


def rank_words(docs: DataFrame, *, text_col: str = "text", most: int = CORPUS_WORDS) -> dict[str, int]:
    """Guess ranks: the password words, then at most ``most`` of the most frequent words of a-z in ``docs``.

    The words of all texts are counted in one grouped aggregation. How many words have each
    count gives the count above which at most ``most`` words lie; only these reach the driver
    (words that tie with the next one are left out together). Null and empty texts have no words.
    """
    work = Scratch(docs.sparkSession, "words")
    words = F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit(f"(?<![a-z])([a-z]{{3,{LONGEST_WORD}}})(?![a-z])"))
    counted = work.keep(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "counts")
    above, cut = 0, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        above += r["words"]
        if above > most:
            cut = r["n"]
            break
    top = sorted(counted.filter(F.col("n") > cut).collect(), key=lambda r: (-r["n"], r["w"]))
    work.drop()
    out = dict(RANK)
    for r in top:
        out.setdefault(r["w"], len(out) + 1)
    return out


def cost_of_length(n: int) -> float:
    """log10 of the guesses for the length of a repeat, walk or sequence: a factor of 2 for each doubling."""
    return TWICE * (n.bit_length() - 1)


class _Starts:
    """The cheapest start of a segment of at least three characters inside one span, in amortised constant time per doubling.

    The cost of a length changes only with its bits, so for every number of bits the starts form a
    sliding window, of which the minimum is kept.
    """

    def __init__(self):
        self.first, self.windows = None, []

    def least(self, first: int, end: int, best: list[float]) -> float:
        """Least best[i] + cost_of_length(end - i) for first <= i <= end - 3; ``end`` grows by one from first + 3 on."""
        if first != self.first:
            self.first, self.windows = first, []
        out, bits = math.inf, 1
        while (shortest := max(3, 1 << bits)) <= end - first:
            if bits > len(self.windows):
                self.windows.append(deque())
            w, i = self.windows[bits - 1], end - shortest
            while w and best[w[-1]] >= best[i]:
                w.pop()
            w.append(i)
            while w[0] <= end - (2 << bits):
                w.popleft()
            out = min(out, best[w[0]] + TWICE * bits)
            bits += 1
        return out


def guess_cost(value: str, ranks: Mapping[str, int] = RANK) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``.

    Segments are ranked words (also capitalised or with look-alike digits), dates and years,
    repeats of one character, keyboard walks and alphabet sequences of three or more characters,
    and brute-force spans of any length, character by character. Every segment but the first
    costs a factor of 2. The minimum is exact: ``known`` is the least cost of a prefix whose last
    segment is no brute-force span, ``brute`` of one whose last segment is, which may go on.
    """
    n = len(value)
    low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    known, brute, start = [math.inf] * (n + 1), [math.inf] * (n + 1), [math.inf] * (n + 1)
    known[0] = start[0] = 0.0  # start[i]: least cost before a new segment at i, its factor included
    digit = [c in "0123456789" for c in low]
    repeats, walks, sequences = _Starts(), _Starts(), _Starts()
    run = walk = step = 0  # where the repeat, walk and sequence that end here began
    d = 0
    for j in range(1, n + 1):
        i = j - 1
        if i:
            run = run if low[i] == low[i - 1] else i
            walk = walk if _adjacent(low[i], low[i - 1]) else i
            was, d = d, ord(low[i]) - ord(low[i - 1])
            step = (step if d == was else i - 1) if abs(d) == 1 else i
        best = math.inf
        for size in range(2, min(LONGEST_WORD, j) + 1):
            a = j - size
            own, w = low[a:j], plain[a:j]
            for r, changed in ((ranks.get(own), 0), (ranks.get(w) if w != own else None, 1)):
                if r:
                    best = min(best, start[a] + math.log10(r + 1) + 0.5 * (changed + (value[a:j] != own)))
        if digit[i]:
            for size in (4, 6, 7, 8, 9, 10):
                if size <= j and digit[j - size] and DATE.fullmatch(low, j - size, j):
                    best = min(best, start[j - size] + (YEAR_COST if size == 4 else DATE_COST))
        if j - run >= 3:
            best = min(best, repeats.least(run, j, start) + math.log10(_alphabet(low[i])))
        if j - walk >= 3:
            best = min(best, walks.least(walk, j, start) + math.log10(47 * 8))
        if j - step >= 3:
            best = min(best, sequences.least(step, j, start) + math.log10(26 * 2))
        known[j] = best
        one = math.log10(_alphabet(low[i])) + (TWICE if value[i].isupper() else 0.0)
        brute[j] = min(brute[i], start[i]) + one
        start[j] = min(known[j], brute[j]) + TWICE
    return min(known[n], brute[n]) if n else 0.0


def find_spans(text: str, strong: float = 10.0, ranks: Mapping[str, int] = RANK) -> tuple[list[tuple[int, int, str]], int]:
    """(start, end, kind) in order of start and kind, and how many assigned values are hard to guess."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    hard = 0
    # lower() may change a text's length, so it only says whether a pattern is worth running
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                spans.append((m.start(), m.end(), "assign"))
                hard += guess_cost(m[2], ranks) >= strong
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if (":" in text or "=" in text or " is " in low) and any(h in low for h in WIDER):
        base = sorted(spans)
        starts, ends = [s for s, _, _ in base], [0, *accumulate((e for _, e, _ in base), max)]
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            # of the base spans that start before b, none may end after a
            if ends[bisect_left(starts, b)] <= a and guess_cost(m[1], ranks) >= strong:
                spans.append((a, b, "guess"))
    spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return spans, hard


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strong: float = 10.0, ranks: Mapping[str, int] | None = None) -> DataFrame:
    """Spans of secrets in every whole text; one row per input row.

    Base spans come from three patterns; the method adds values in wider credential contexts
    whose guess cost is at least 10**strong, with ``ranks`` of words (``rank_words`` of ``docs``
    where none are given; of fixed size, so they are broadcast). Null texts count as empty: no spans. Ids may be
    null or repeated. Very long texts and values are scanned whole, in n log n steps.
    """

    held = docs.sparkSession.sparkContext.broadcast(rank_words(docs, text_col=text_col) if ranks is None else dict(ranks))

    def start():
        def step(cols):
            out = {"doc_id": cols["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_guess": [], "n_strong": []}
            for text in cols["text"]:
                spans, hard = find_spans(text or "", strong, held.value)
                base = [s for s in spans if s[2] != "guess"]
                kinds = [s[2] for s in spans]
                for k in KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["n_strong"].append(hard)
            return out

        return step

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, start, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_strong long")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", strong: float = 10.0, ranks: Mapping[str, int] | None = None) -> DataFrame:
    """The same rows with every span of a secret replaced by ``[kind]``; overlapping spans become one.

    All other columns, whatever their names, pass unchanged; null texts stay null.
    """
    names = docs.columns
    at = names.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(rank_words(docs, text_col=text_col) if ranks is None else dict(ranks))

    def start():
        def step(cols):
            out = dict(cols)
            out[f"c{at}"] = [t if t is None else redact(t, strong, held.value) for t in cols[f"c{at}"]]
            return out

        return step

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return map_rows(docs.toDF(*[f"c{i}" for i in range(len(names))]), start, schema).toDF(*names)


def redact(text: str, strong: float = 10.0, ranks: Mapping[str, int] = RANK) -> str:
    spans, _ = find_spans(text, strong, ranks)
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{k}]"]
        at = b
    return "".join([*out, text[at:]])
