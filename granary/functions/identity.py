"""What a file is: extension, media type, type by its first bytes, completeness, content hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by media type.
EXTENSIONS = {
    "image": "jpg jpeg png webp gif bmp tif tiff heic heif avif jxl".split(),
    "video": "mp4 mkv webm mov avi m4v wmv flv mpg mpeg".split(),
    "audio": "mp3 wav flac m4a aac ogg opus wma aiff".split(),
    "document": "pdf docx pptx xlsx doc ppt xls odt odp ods rtf txt md log csv tsv epub".split(),
}
#: Folders that are never read.
SKIPPED = (
    "$recycle.bin", "system volume information", "$windows.~ws", "$windows.~bt", ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv",
    ".cache", ".thumbnails", ".ds_store", "@eadir", ".trash", ".trashes", "appdata", "application data",
)
#: First bytes of file types, in the order in which they are tried.
MAGIC = (
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"BM", "image/bmp"),
    (b"II*\x00", "image/tiff"),
    (b"MM\x00*", "image/tiff"),
    (b"%PDF-", "application/pdf"),
    (b"\x1a\x45\xdf\xa3", "video/x-matroska"),
    (b"OggS", "audio/ogg"),
    (b"fLaC", "audio/flac"),
    (b"ID3", "audio/mpeg"),
    (b"\xff\xfb", "audio/mpeg"),
    (b"\xff\xf3", "audio/mpeg"),
    (b"\xff\xf2", "audio/mpeg"),
    (b"{\\rtf", "application/rtf"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
)
#: Brands of ISO media (others are MP4), and kinds of RIFF files.
BRANDS = dict.fromkeys(("heic", "heix", "hevc", "heim", "heis", "mif1", "msf1"), "image/heic") | dict.fromkeys(("avif", "avis"), "image/avif") | {"M4A ": "audio/mp4", "M4B ": "audio/mp4", "qt  ": "video/quicktime"}
RIFF = {"WEBP": "image/webp", "WAVE": "audio/x-wav", "AVI ": "video/x-msvideo"}
#: What the first bytes of a ZIP name, and how far they are searched.
OFFICE = {"word/": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "ppt/": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xl/": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "mimetypeapplication/epub": "application/epub+zip", "mimetypeapplication/vnd.oasis": "application/vnd.oasis.opendocument.text"}
ZIP_HEAD = 8192
#: How complete files end (hex), and within how many last bytes.
ENDS = {"image/png": ("49454e44", 16), "image/jpeg": ("ffd9", 32), "image/gif": ("3b", 4), "application/pdf": ("2525454f46", 2048)}


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"[^/.]\.([^./]*)$", 1))


def media_type(ext: Column) -> Column:
    out = F
    for kind, names in EXTENSIONS.items():
        out = out.when(ext.isin(names), kind)
    return out.otherwise("other")


def indexable(path: Column) -> Column:
    """Whether a path has a known extension and no hidden or skipped folder."""
    parts = F.split(F.lower(path), "/")
    bad = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(list(SKIPPED)))
    return extension(path).isin([x for v in EXTENSIONS.values() for x in v]) & ~bad


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sniff(content: Column, ext: Column) -> Column:
    """MIME type by the first bytes; containers by their brand or members; else by the extension."""
    head = lambda a, n: F.substring(content, a, n)
    starts = lambda at, mark: head(at, len(mark)) == F.lit(bytearray(mark))
    within = lambda n: F.decode(head(1, n), "ISO-8859-1")
    out = F
    for magic, mime in MAGIC:
        if mime == "video/x-matroska":
            out = out.when(starts(1, magic) & F.contains(within(64), F.lit("webm")), "video/webm")
        out = out.when(starts(1, magic), mime)
    brand = F.decode(head(9, 4), "ISO-8859-1")
    for b, mime in BRANDS.items():
        out = out.when(starts(5, b"ftyp") & (brand == b), mime)
    out = out.when(starts(5, b"ftyp"), "video/mp4")
    for kind, mime in RIFF.items():
        out = out.when(starts(1, b"RIFF") & (brand == kind), mime)
    for member, mime in OFFICE.items():
        out = out.when(starts(1, b"PK") & F.contains(within(ZIP_HEAD), F.lit(member)), mime)
    out = out.when(starts(1, b"PK"), "application/zip")
    text = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values", "log": "text/plain"}
    for e, mime in text.items():
        out = out.when(ext == e, mime)
    return out.otherwise("application/octet-stream")


def truncated(content: Column, mime: Column) -> Column:
    """Whether a file of a type with an end mark lacks it."""
    out = F
    for m, (mark, last) in ENDS.items():
        tail = F.hex(F.substring(content, -last, last))
        out = out.when(mime == m, ~F.contains(tail, F.lit(mark.upper())))
    return out.otherwise(False)
