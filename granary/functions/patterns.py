"""Pattern detectors over texts and names, money, dates, people and organisations."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters of a sample that are kept.
SAMPLE = 60


class Detector(NamedTuple):
    """A pattern with its flags, the hits it takes to fire, and its votes (category, weight)."""

    name: str
    flags: str
    regex: str
    least: int = 1
    doctype: tuple[str, float] | None = None
    topic: tuple[str, float] | None = None
    cap: int = 4
    on_name: bool = False


#: The detectors, in order of their votes. Flags: i ignores case, m lets ^ and $ match at lines.
DETECTORS = (
    Detector("money", "i", r"(?:[$€£¥]\s?\d[\d,]*(?:\.\d{1,2})?|\b\d[\d,]*\.\d{2}\s?(?:USD|EUR|GBP|CAD|AUD|CHF|JPY)\b)", 2, None, ("finance", 1.5)),
    Detector("invoice-number", "i", r"\b(?:invoice|inv)\s*(?:number|no\.?|#)\s*[:\-]?\s*[A-Z0-9][A-Z0-9\-/]{2,}", 1, ("invoice", 8.0), ("finance", 3.0)),
    Detector("amount-due", "i", r"\b(?:total|amount|balance)\s+(?:due|payable|outstanding)\b", 1, ("invoice", 6.0), ("finance", 2.0)),
    Detector("tax-id", "i", r"\b(?:VAT|GST|EIN|TIN|ABN)\s*(?:number|no\.?|#|reg(?:istration)?)?\s*[:\-]?\s*[A-Z0-9][A-Z0-9\- ]{5,}", 1, None, ("finance", 2.0)),
    Detector("iban", "", r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){3,7}[A-Z0-9]{1,4}\b", 1, ("statement", 3.0), ("finance", 2.0)),
    Detector("accounting-period", "i", r"\b(?:Q[1-4]|FY)\s?(?:20)?\d{2}\b|\bfiscal\s+(?:year|quarter)\b", 1, None, ("finance", 2.0)),
    Detector("log-line", "m", r"^\s*(?:\[)?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", 5, ("log", 4.0), ("engineering", 1.5), 6),
    Detector("severity-level", "", r"\b(?:ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|FATAL|CRITICAL)\b", 4, ("log", 2.5), ("engineering", 1.0), 6),
    Detector("stack-trace", "m", r"Traceback \(most recent call last\)|^\s+at [\w$.]+\(.*?:\d+\)|^\s+File \".*?\", line \d+", 1, ("log", 7.0), ("engineering", 3.0)),
    Detector("source-code", "m", r"^\s*(?:def |class |function |import |from \w+ import|#include|public\s+(?:static|class)|const \w+\s?=|package \w+;)", 3, ("source-code", 4.0), ("engineering", 2.0), 5),
    Detector("sql", "i", r"\bSELECT\b[\s\S]{0,200}?\bFROM\b|\b(?:CREATE|ALTER|DROP)\s+TABLE\b", 2, None, ("engineering", 2.0)),
    Detector("url", "i", r"https?://[\w.\-]+(?:/[\w./\-%?=&#+]*)?", 2),
    Detector("email-address", "i", r"\b[\w.+\-]+@[\w\-]+\.[\w.\-]{2,}\b"),
    Detector("phone-number", "i", r"(?<![\d\-.])(?<!\d )(?:\+\d{1,3}[ \-.]?)?(?:\(\d{2,4}\)|\d{2,4})[ \-.]\d{3,4}[ \-.]?\d{3,4}(?!\d)(?![-.]\d)(?! \d)"),
    Detector("ip-address", "i", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 2, None, ("engineering", 1.0)),
    Detector("signature-block", "i", r"(?:^|\n)\s*(?:sincerely|yours faithfully|yours sincerely|best regards|kind regards|regards|thanks|many thanks)\s*,?\s*\n", 1, ("letter", 4.0)),
    Detector("salutation", "i", r"(?:^|\n)\s*dear\s+(?:mr|mrs|ms|miss|dr|prof|sir|madam|colleagues|team|all)\b", 1, ("letter", 4.0)),
    Detector("action-items", "im", r"\baction\s+items?\b|\bfollow[- ]ups?\b|\bowner\s*[:|]|^\s*(?:TODO|ACTION)\b", 1, ("meeting-notes", 4.0)),
    Detector("attendees", "i", r"\b(?:attendees|present|apologies|participants)\s*[:|]", 1, ("meeting-notes", 5.0)),
    Detector("legalese", "i", r"\b(?:hereinafter|hereunder|whereas|thereof|herein|in witness whereof|shall be deemed|notwithstanding)\b", 2, ("contract", 4.0), ("legal", 3.0), 5),
    Detector("clause-numbering", "m", r"^\s*\d+\.\d+(?:\.\d+)?\s+[A-Z]", 4, ("contract", 2.5), ("legal", 1.0)),
    Detector("citation", "i", r"\bet al\.?\b|\[\d{1,3}\]\s|\bdoi:\s?10\.\d{4,}", 2, ("paper", 3.0), ("research", 2.0)),
    Detector("table-row", "m", r"^[^\n|]{1,60}(?:\s\|\s[^\n|]{1,60}){2,}$", 3, ("spreadsheet", 1.5), None, 8),
    Detector("blank-field", "m", r"_{4,}|\.{6,}\s*$|\[\s*\]", 4, ("form", 4.0), None, 6),
    Detector("percentage", "i", r"\b\d{1,3}(?:\.\d+)?\s?%", 3),
    Detector("credentials", "i", r"\b(?:api[_ \-]?key|secret[_ \-]?key|access[_ \-]?token|client[_ \-]?secret|password|passwd|bearer)\b\s*[:=]\s*\S{6,}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})\b", 1, None, ("security", 4.0)),
    Detector("national-id", "", r"\b\d{3}-\d{2}-\d{4}\b|\b[A-Z]{2}\d{6}[A-D]\b"),
    Detector("date-of-birth", "i", r"\b(?:date of birth|d\.?o\.?b\.?|born on)\b"),
    Detector("medical-terms", "i", r"\b(?:diagnosis|prescribed|dosage|mg\b|patient id|icd-?10|symptoms)\b", 2, None, ("medical", 3.0)),
    Detector("screenshot-name", "i", r"screen[ _\-]?shot|screenshot|snip|capture[ _\-]?\d", 1, ("screenshot", 8.0), on_name=True),
    Detector("sequence-name", "i", r"^(?:img|dsc|dcim|p|photo|vid|mov)[ _\-]?\d{3,}", on_name=True),
    Detector("version-name", "i", r"\b(?:v\d+(?:\.\d+)*|final|draft|rev\d+|copy|\(\d+\))\b", on_name=True),
)
#: What each detector found, as it is said in a verdict's reasoning.
NOTES = {
    "money": "currency figures appear in the text",
    "invoice-number": "an invoice reference field",
    "amount-due": "a payable total",
    "tax-id": "a tax registration number",
    "iban": "something shaped like an IBAN",
    "accounting-period": "a fiscal quarter or year",
    "log-line": "lines that start with a timestamp",
    "severity-level": "uppercase severity keywords",
    "stack-trace": "a stack trace",
    "source-code": "declarations in a programming language",
    "sql": "SQL statements",
    "url": "web links",
    "email-address": "email addresses",
    "phone-number": "telephone numbers",
    "ip-address": "IP addresses",
    "signature-block": "a closing signature",
    "salutation": "an opening salutation",
    "action-items": "tracked actions",
    "attendees": "an attendee list",
    "legalese": "contractual boilerplate",
    "clause-numbering": "hierarchically numbered clauses",
    "citation": "academic citations",
    "table-row": "rows of tabular data",
    "blank-field": "blanks waiting to be filled in",
    "percentage": "percentage figures",
    "credentials": "text shaped like a credential -- worth reviewing",
    "national-id": "something shaped like a national insurance or social security number",
    "date-of-birth": "a date of birth field",
    "medical-terms": "clinical vocabulary",
    "screenshot-name": "the filename says screenshot",
    "sequence-name": "a camera's own filename",
    "version-name": "a version or draft marker in the filename",
}
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
MONTHS = "january february march april may june july august september october november december".split()


def java(regex: str, flags: str = "") -> str:
    """The pattern with Unicode classes and \\n as the only line end."""
    return f"(?Ud{flags}){regex}"


def scanned(text: Column, scan: int | None = None) -> Column:
    """The whole text, or its first ``scan`` characters; null is empty."""
    return F.coalesce(text if scan is None else F.substring(text, 1, scan), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Alternatives up to which a set of characters counts as literals.
FEW = 8


def _needs(parsed) -> frozenset[tuple[str, bool]]:
    """Of a parsed pattern: alternatives (literal, digit), of which every match holds one: the literal, and a digit if so said."""
    best, digit, run = frozenset({("", False)}), False, ""

    def worth(found):
        # the alternative that says least counts, then how many there are
        return min(len(x) + 0.5 * d for x, d in found), -len(found)

    def offer(found):
        nonlocal best
        best = max(best, frozenset(found), key=worth)

    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            run += chr(arg)
            offer({(run, False)})
            continue
        if kind == "MAX_REPEAT" and arg[0] and [str(o) for o, _ in arg[2]] == ["LITERAL"]:
            offer({(run + chr(arg[2][0][1]) * arg[0], False)})
        run = ""
        if kind == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= FEW:
                offer({(chr(a), False) for _, a in arg})
            digit = digit or [(str(o), str(a)) for o, a in arg] == [("CATEGORY", "CATEGORY_DIGIT")]
        elif kind == "SUBPATTERN" or (kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0]):
            found = _needs(arg[-1])
            digit = digit or all(d for _, d in found)
            offer(found)
        elif kind == "BRANCH":
            each = frozenset().union(*map(_needs, arg[1]))
            digit = digit or all(d for _, d in each)
            offer(each)
    return frozenset((x, d or digit) for x, d in best)


@cache
def needs(d: Detector) -> tuple[tuple[str, bool], ...]:
    """What a text needs before a detector is run on it: any of these alternatives."""
    flags = re.IGNORECASE * ("i" in d.flags)
    return tuple(sorted({(x.lower() if flags else x, digit) for x, digit in _needs(re._parser.parse(d.regex, flags))}))


def hits(text: Column, name: Column, scan: int | None = None, detectors: Sequence[Detector] = DETECTORS) -> Column:
    """Array of (name, n, sample) of the detectors that fire, in order; samples are only cut for those.

    A pattern only runs on texts that hold one of the literals, and a digit if any, that its every match has.
    """
    low = F.lower(F.coalesce(name, F.lit("")))
    body = scanned(text, scan)
    # letters that match i and s in any case, beside those that lower() maps to them
    plain = F.replace(F.replace(F.lower(F.replace(body, F.lit("\u0130"), F.lit("i"))), F.lit("\u0131"), F.lit("i")), F.lit("\u017f"), F.lit("s"))

    def count(d: Detector, v: Column) -> Column:
        p = F.lit(java(d.regex, d.flags))
        if d.on_name:
            return F.regexp_count(low, p)
        may = F.lit(False)
        for x, digit in needs(d):
            held = F.contains(v["plain"] if "i" in d.flags else v["body"], F.lit(x)) if x else F.lit(True)
            may = may | (v["digit"] & held if digit else held)
        return F.when(may, F.regexp_count(v["body"], p)).otherwise(0)

    def found(v: Column) -> Column:
        out = [F.struct(F.lit(d.name).alias("name"), count(d, v).cast("long").alias("n"), F.lit(java(d.regex, d.flags)).alias("p"), F.lit(d.least).alias("least"), F.lit(d.on_name).alias("on_name")) for d in detectors]
        kept = F.filter(F.array(*out), lambda h: h["n"] >= h["least"])
        cut = lambda h: F.substring(F.trim(F.regexp_substr(F.when(h["on_name"], low).otherwise(v["body"]), h["p"])), 1, SAMPLE)
        return F.transform(kept, lambda h: F.struct(h["name"].alias("name"), h["n"].alias("n"), cut(h).alias("sample")))

    return let(F.struct(body.alias("body"), plain.alias("plain"), body.rlike(r"\p{Nd}").alias("digit")), found)


def money_amounts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, currency, count, max, sum) of the amounts in each text."""
    p = r"(?i)[$€£¥]\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*\.\d{2}\s?(?:USD|EUR|GBP|CAD|AUD|CHF|JPY)"
    found = rows.select(key, F.explode(F.regexp_extract_all(scanned(F.col(text)), F.lit(p), F.lit(0))).alias("m"))
    code = F.upper(F.regexp_extract("m", "(?i)([A-Z]{3})$", 1))
    symbol = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])[F.substring("m", 1, 1)]
    value = F.regexp_replace(F.regexp_extract("m", r"\d[\d,]*(?:\.\d{1,2})?", 0), ",", "").cast("double")
    return found.select(key, F.coalesce(symbol, code).alias("currency"), value.alias("v")).groupBy(key, "currency").agg(F.count("*").alias("count"), F.max("v").alias("max"), F.round(F.sum("v"), 2).alias("sum"))


def _noon(y: Column, m: Column, d: Column) -> Column:
    """Epoch seconds of noon; days past the end of a month roll over, other nonsense is null."""
    ok = y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31)
    first = F.make_date(F.when(ok, y), F.when(ok, m), F.lit(1))
    return F.unix_seconds(F.date_add(first, d - 1).cast("timestamp")) + 43200


def _month(name: Column) -> Column:
    low, out = F.lower(name), F
    for i, m in enumerate(MONTHS):
        out = out.when(low.isin(m, m[:3]), i + 1)
    return out.otherwise(None)


def _stamps(take: str, stamp):
    return lambda m: stamp(*[F.nullif(F.regexp_extract(m, take, i), F.lit("")) for i in (1, 2, 3)])


def dates(text: Column, scan: int | None = None, most: int | None = None) -> Column:
    """Epoch seconds of the plausible dates in a text, format by format; all of them, or the first ``most``."""
    body = scanned(text, scan)
    formats = (
        (r"\b\d{4}-\d{2}-\d{2}\b", r"(\d+)-(\d+)-(\d+)", lambda a, b, c: _noon(a.cast("int"), b.cast("int"), c.cast("int"))),
        (r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"(\d+)/(\d+)/(\d+)", lambda a, b, c: F.coalesce(_noon(c.cast("int"), b.cast("int"), a.cast("int")), _noon(c.cast("int"), a.cast("int"), b.cast("int")))),
        (r"\b\d{1,2}[ \-][A-Za-z]{3,9}\.?[ \-]\d{4}\b", r"(\d+)[ \-]([A-Za-z]+)\.?[ \-](\d+)", lambda a, b, c: _noon(c.cast("int"), _month(b), a.cast("int"))),
        (r"\b[A-Za-z]{3,9}\.?[ \-]\d{1,2},?[ \-]?\d{4}\b", r"([A-Za-z]+)\.?[ \-](\d{1,2}?),?[ \-]?(\d{4})$", lambda a, b, c: _noon(c.cast("int"), _month(a), b.cast("int"))),
    )
    parts = []
    for find, take, stamp in formats:
        found = F.regexp_extract_all(body, F.lit(java(find)), F.lit(0))
        parts.append(F.filter(F.transform(found, _stamps(take, stamp)), lambda x: x.isNotNull()))
    return F.concat(*parts) if most is None else F.slice(F.concat(*parts), 1, most)


def date_in_name(name: Column) -> Column:
    p = r"(20\d{2}|19\d{2})[-_.]?(\d{2})[-_.]?(\d{2})"
    return _noon(*[F.nullif(F.regexp_extract(name, p, i), F.lit("")).cast("int") for i in (1, 2, 3)])


def modal(values: Column) -> Column:
    """The most frequent value of an array, of ties the first seen."""

    def pick(v: Column) -> Column:
        # equal values are neighbours once sorted, so one pass counts them
        seen = F.array_sort(F.transform(F.filter(v, lambda x: x.isNotNull()), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.get(v, F.lit(-1)).alias("x"))
        run = lambda s, y: F.when(s["run"]["x"] == y["x"], F.struct((s["run"]["n"] + 1).alias("n"), s["run"]["i"].alias("i"), y["x"].alias("x"))).otherwise(F.struct(F.lit(1).alias("n"), (-y["i"]).alias("i"), y["x"].alias("x")))
        step = lambda s, y: let(run(s, y), lambda r: F.struct(r.alias("run"), F.greatest(s["best"], r).alias("best")))
        return F.aggregate(seen, F.struct(none.alias("run"), none.alias("best")), step, lambda s: s["best"]["x"])

    return let(values, pick)


def event_date(found: Column, captured: Column, created: Column, name: Column, modified: Column) -> Column:
    """struct(at, source): capture time, then a creation date that the text bears out, then the text, the name, the change date."""
    best, day = modal(found), 86400
    positive = lambda c: c.isNotNull() & (c > 0)
    borne_out = best.isNull() | F.exists(found, lambda x: F.abs(x - created) <= 365 * day)
    made = lambda at, source: F.struct(at.cast("long").alias("at"), F.lit(source).alias("source"))
    return (
        F.when(positive(captured), made(captured, "capture time")).when(positive(created) & borne_out, made(created, "document properties")).when(best.isNotNull(), made(best, "text"))
        .when(date_in_name(name).isNotNull(), made(date_in_name(name), "filename")).when(positive(modified), made(modified, "document properties")).otherwise(F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("source")))
    )


def years(found: Column, at: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(found, F.array(at)), lambda x: F.year(F.timestamp_seconds(x))), lambda y: y.isNotNull())))
