"""People, organisations and authors, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.patterns import java, let, scanned

#: Company endings, authorship phrases, closings, and words that are no names.
COMPANY = "Inc|Incorporated|LLC|LLP|Ltd|Limited|GmbH|PLC|Corp|Corporation|Company|Holdings|Partners|Group|University|Institute|Foundation|Bank|Trust"
COMPANY_MORE = "associates|solutions|services|technologies|systems"
NO_NAME = """the this that these those page total subject date from to cc bcc re fwd dear sincerely regards thanks note please invoice receipt report summary
confidential draft final copyright all rights reserved company customer client project chapter section appendix figure table""".split()
#: Programs and placeholders that stand in author fields.
SOFTWARE = r"microsoft|adobe|acrobat|word|excel|powerpoint|libreoffice|openoffice|google|docs|pages|keynote|latex|pdflatex|tex|ghostscript|quartz|pdfium|skia|chrome|canva|figma|scanner|scansnap|epson|canon|hp\b|printer|distiller|writer|producer|unknown|admin|user|owner|none|python|reportlab|openpyxl|xlsxwriter|pandoc|wkhtmltopdf|weasyprint|imagemagick|ffmpeg|pillow|jasper|itext|fpdf|tcpdf|prince|chromium"
PLACEHOLDER = r"^\(.*\)$|^(?:anonymous|unspecified|untitled|not set|n/?a|null|nil|tbd|default|test|sample|example|author|creator|me|self)$"

#: A name after a closing, and a name after a phrase of authorship.
SIGNATURE = r"(?:sincerely|yours faithfully|yours sincerely|best regards|kind regards|regards|many thanks|thanks)\s*,?\s*\n+\s*([A-Z][\w.'\-]+(?:[ \t]+[A-Z][\w.'\-]+){0,2})"
BYLINE = r"(?:\b(?:author|authored by|prepared by|written by|submitted by|created by|reported by|presented by)|(?:^|\n)\s*from)\s*[:\-]?\s*([A-Z][\w.'\-]+(?:[ \t]+[A-Z][\w.'\-]+){0,2})"


def _clean(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(name, java(r"\s+"), " ")), r"^[.,;:]+|[.,;:]+$", "")


def plausible(name: Column) -> Column:
    """Up to three capitalised words of two letters or more, none of them a form word, no company."""
    parts = F.split(name, " ")
    good = F.forall(parts, lambda p: (F.length(p) >= 2) & ~F.lower(p).isin(NO_NAME) & p.rlike(java(r"^\p{Lu}")))
    return (F.length(name) > 0) & (F.size(parts) <= 3) & good & ~name.rlike(java(rf"\b(?:{COMPANY}|{COMPANY_MORE})\b\.?$", "i"))


def _found(text: Column, regex: str, source: str, flags: str = "i") -> Column:
    names = F.regexp_extract_all(scanned(text), F.lit(java(regex, flags)), F.lit(1))
    return F.transform(F.filter(F.transform(names, _clean), plausible), lambda n: F.struct(n.alias("name"), F.lit(source).alias("source")))


def people(text: Column, most: int | None = None) -> Column:
    """Array of (name, source), best evidence first, each name once: closings, bylines, then addresses; all, or the first ``most``."""
    sign = _found(text, SIGNATURE, "signature")
    by = _found(text, BYLINE, "byline")
    local = F.regexp_extract_all(scanned(text), F.lit(java(r"\b([\w.+\-]+)@([\w\-]+)\.[\w.\-]{2,}\b")), F.lit(1))
    named = F.transform(F.filter(local, lambda x: x.rlike("[._]")), lambda x: _clean(F.initcap(F.regexp_replace(x, "[._]+", " "))))
    mail = F.transform(F.filter(named, plausible), lambda n: F.struct(n.alias("name"), F.lit("email").alias("source")))
    none = F.array().cast("array<struct<name:string,source:string>>")
    once = F.aggregate(F.concat(sign, by, mail), none, lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k["name"]) == F.lower(x["name"])), kept).otherwise(F.array_append(kept, x)))
    return once if most is None else F.slice(once, 1, most)


def organisations(text: Column, most: int | None = None) -> Column:
    """Company names, the most frequent first (ties by first appearance): all of them, or the first ``most``."""
    p = rf"\b[A-Z][\w&.'\-]*(?:[ ][A-Z][\w&.'\-]*){{0,3}}[ ](?:{COMPANY})\b"
    found = F.filter(F.regexp_extract_all(scanned(text), F.lit(java(p)), F.lit(0)), lambda n: F.length(n) <= 60)

    def rank(f: Column) -> Column:
        each = F.transform(F.array_distinct(f), lambda n, i: F.struct((-F.size(F.filter(f, lambda x: x == n))).alias("n"), i.alias("i"), n.alias("name")))
        names = F.transform(F.array_sort(each), lambda x: x["name"])
        return names if most is None else F.slice(names, 1, most)

    return let(found, rank)


def person_or_null(value: Column) -> Column:
    """An author field as a person's name; programs, placeholders and identifiers are null, addresses become names."""
    n = F.regexp_replace(F.trim(F.regexp_replace(value, java(r"\s+"), " ")), r"^[ .,;:_-]+|[ .,;:_-]+$", "")
    bad = ~F.length(n).between(2, 60) | n.rlike(java(SOFTWARE, "i")) | n.rlike(java(PLACEHOLDER, "i")) | ~n.rlike(r"\p{L}")
    bad = bad | (~F.contains(n, F.lit(" ")) & (F.lower(n) == n) & n.rlike(r"[\d-]"))
    local = F.split(n, "@")[0]
    mail = F.initcap(F.array_join(F.filter(F.split(local, r"[._\-]"), lambda x: x != ""), " "))
    return F.when(~F.coalesce(bad, F.lit(True)), F.when(F.contains(n, F.lit("@")), mail).otherwise(n))


def name_in_filename(filename: Column) -> Column:
    """The person after the last separator of a file name such as "Report - Jane Doe.docx"."""
    stem = F.regexp_replace(filename, r"\.[A-Za-z0-9]{1,5}$", "")
    out = F.lit(None).cast("string")
    for sep in ("_-_", " -- ", " by ", " - "):
        tail = F.trim(F.regexp_extract(stem, rf"(?is)^.*{sep}(.*)$", 1))
        out = F.when((F.size(F.split(tail, " ")) >= 2) & plausible(tail), tail).otherwise(out)
    return out


def author(meta: Column, filename: Column, p: Column) -> Column:
    """struct(name, source): the file's own fields, then closing or byline, then the file name, then an address.

    ``p`` is a column that holds ``people`` of the text, so that it is found only once.
    """
    said = F.get(F.filter(p, lambda x: x["source"].isin("signature", "byline")), F.lit(0))
    mail = F.get(F.filter(p, lambda x: x["source"] == "email"), F.lit(0))
    made = lambda n, s: F.when(n.isNotNull(), F.struct(n.alias("name"), F.lit(s).alias("source")))
    fields = [made(person_or_null(meta[k]), s) for k, s in (("author", "metadata"), ("artist", "id3"), ("album_artist", "id3"), ("creator", "metadata"))]
    return F.coalesce(*fields, said, made(name_in_filename(filename), "filename"), mail)
