"""Sources: folder listings, plain text, office documents, JSON catalogues, a synthetic catalogue."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import identity
from granary.session import materialize

#: A bound in bytes that callers may set, the characters of both ends that are kept beyond it, what stands between.
LONG_TEXT, EACH_END, GAP = 800_000, 100_000, "\n[...]\n"


def _windows() -> tuple[str, str]:
    """The C1 controls of Latin-1 and what Windows-1252 has in their place."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs if b)


_WINDOWS = _windows()


def _filesystem(path: str):
    """The file system of a folder and its path there; none where Spark's readers alone know the scheme."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^(\w+):/*", r"\1:///", path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError):
        return None


#: Files and bytes that a task holds at once, and files that a task reads.
AT_ONCE, BYTES_AT_ONCE, FILES_OF_A_TASK = 1000, 8 << 20, 2000

_FOUND = "path string, folder boolean, modified long, length long"


def _shown(path: str) -> bool:
    """Whether Spark's readers see a name: none that begins with a point or an underscore."""
    name = path.rpartition("/")[2]
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _walked(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length) of the files below a folder, listed by tasks, a level of folders at a time.

    Neither names nor states of files come to the driver, which only asks whether a level has folders.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, _ = _filesystem(path)
        for b in batches:
            for folder in b.column(0).to_pylist():
                held = where.get_file_info(fs.FileSelector(folder))
                for i in range(0, len(held), 10 * AT_ONCE):
                    rows = [(f.path, f.type == fs.FileType.Directory, (f.mtime_ns or 0) // 1000, f.size or 0) for f in held[i:i + 10 * AT_ONCE] if _shown(f.path)]
                    columns = list(zip(*rows, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["path", "folder", "modified", "length"])

    level, files = spark.createDataFrame([(_filesystem(path)[1].rstrip("/") or "/",)], "path string"), []
    while not level.isEmpty():
        found = materialize(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(look, _FOUND), "listed")
        files.append(found.filter("NOT folder AND length > 0"))
        level = found.filter("folder").select("path")
    return reduce(DataFrame.unionByName, files).drop("folder")


def _binary(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder, as Spark's binaryFile has them.

    Spark's reader keeps the state of every file on the driver, so tasks list the folders and open the files
    themselves; it only serves schemes that Arrow does not know.
    """
    held = _filesystem(path)
    if held is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    scheme, host = re.match(r"(?:(\w+):)?(?://([^/]*))?", path).groups()
    prefix = "file:" if scheme in (None, "file") else f"{scheme}://{host or ''}" if held[1].startswith("/") else f"{scheme}://"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _filesystem(path)

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "modified", "length", "content"])

        rows, size = [], 0
        for b in batches:
            for at, modified, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = None
                if content:
                    with where.open_input_stream(at, compression=None) as f:
                        data = f.read()
                rows.append((prefix + at, modified, length, data))
                size += len(data or b"")
                if len(rows) >= AT_ONCE or size >= BYTES_AT_ONCE:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    files = _walked(spark, path).select("path", "modified", "length")
    tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // FILES_OF_A_TASK)) if content else None
    files = files.repartition(tasks, "path") if tasks else files
    got = files.mapInArrow(read, "path string, modified long, length long, content binary")
    return got.select("path", F.timestamp_micros("modified").alias("modificationTime"), "length", "content")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(root, rel_path, parent_rel, name, ext, size_bytes, mtime_ns) of the indexable files below a folder.

    No file is opened. Empty, hidden and unknown files are left out.
    """
    root = path.rstrip("/")
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", root)) + "/", "")
    f = _binary(spark, path, content=False).select(F.lit(root).alias("root"), rel.alias("rel_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    name = F.regexp_extract("rel_path", r"[^/]*$", 0)
    return f.filter((F.col("size_bytes") > 0) & identity.indexable(F.col("rel_path"))).select("root", "rel_path", F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("parent_rel"), name.alias("name"), identity.extension(name).alias("ext"), "size_bytes", "mtime_ns")


def identify(spark: SparkSession, path: str) -> DataFrame:
    """(path, asset_id, mime, media_type, truncated, size_bytes) from the bytes of each file."""
    f = _binary(spark, path).withColumn("ext", identity.extension(F.col("path"))).withColumn("mime", identity.sniff(F.col("content"), F.col("ext")))
    return f.select("path", identity.content_hash(F.col("content")).alias("asset_id"), "mime", identity.media_type(F.col("ext")).alias("media_type"), identity.truncated(F.col("content"), F.col("mime")).alias("truncated"), F.col("length").alias("size_bytes"))


#: Extensions of files that are read as text.
TEXTS = ("txt", "md", "log", "csv", "tsv")


def plain_text(spark: SparkSession, path: str, extensions=TEXTS, *, most: int | None = None) -> DataFrame:
    """(path, asset_id, body) of the text files below a folder, whole or with both ends of those above ``most`` bytes."""
    f = _binary(spark, path).filter(identity.extension(F.col("path")).isin(list(extensions)))
    return plain_text_of(f.select("path", identity.content_hash(F.col("content")).alias("asset_id"), "content"), most=most)


def plain_text_of(f: DataFrame, *, most: int | None = None) -> DataFrame:
    """``f`` with the text of its ``content`` as ``body``: UTF-16 with a mark, UTF-8, else Windows-1252; whole, or both ends of those above ``most`` bytes."""
    utf8 = F.try_validate_utf8(F.decode("content", "UTF-8"))
    marked = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(marked, F.decode("content", "UTF-16")).when(valid, utf8).otherwise(F.translate(F.decode("content", "ISO-8859-1"), *_WINDOWS))
    cut = F.col("text") if most is None else F.when(F.octet_length("content") > most, F.concat(F.substring("text", 1, EACH_END), F.lit(GAP), F.expr(f"right(text, {EACH_END})"))).otherwise(F.col("text"))
    return f.withColumn("text", F.regexp_replace(text, "^﻿", "")).withColumn("body", cut).drop("text", "content")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def docx_text(data: bytes) -> tuple[list[str], dict[str, str]]:
    """Body blocks of a DOCX (paragraphs, and table rows as a | b) and its properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        text = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
        ends = [ElementTree.fromstring(z.read(n)) for n in sorted(z.namelist()) if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)]
        out = []
        for x in body if body is not None else ():
            if x.tag == f"{_W}p":
                out.append(text(x))
            elif x.tag == f"{_W}tbl":
                out += [" | ".join(" ".join(text(p) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")) for r in x.iter(f"{_W}tr")]
        out += [text(p) for x in ends for p in x.iter(f"{_W}p")]  # headers and footers come last
        return [b for b in out if b.strip()], _core(z)


def pptx_text(data: bytes) -> tuple[list[str], dict[str, str]]:
    """One block per slide of a PPTX, with its notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for n in slides:
            parts = [n, n.replace("slides/slide", "notesSlides/notesSlide")]
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for m in parts if m in z.namelist() for p in ElementTree.fromstring(z.read(m)).iter(f"{_A}p")]
            out.append("\n".join(x for x in lines if x.strip()))
        return [b for b in out if b], _core(z)


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    tree = ElementTree.fromstring(z.read("docProps/core.xml"))
    return {k: v for k, v in (("author", tree.findtext(f"{_DC}creator")), ("title", tree.findtext(f"{_DC}title"))) if v}


def office_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, asset_id, ord, body, author, title, status) of DOCX and PPTX files; damaged ones give one row with an error."""
    f = _binary(spark, path).withColumn("ext", identity.extension(F.col("path"))).filter("ext IN ('docx', 'pptx')")
    return office_text_of(f.select("path", identity.content_hash(F.col("content")).alias("asset_id"), "ext", "content"))


def office_text_of(rows: DataFrame) -> DataFrame:
    """The same of rows (path, asset_id, ext, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path_, asset, ext, data = (c[i].as_py() for c in b.columns)
                try:
                    blocks, meta = (docx_text if ext == "docx" else pptx_text)(data)
                    got = [(path_, asset, k, t, meta.get("author"), meta.get("title"), "ok") for k, t in enumerate(blocks)] or [(path_, asset, 0, "", None, None, "ok")]
                except Exception as e:  # a damaged file is a row, not a failed job
                    got = [(path_, asset, None, None, None, None, f"error: {type(e).__name__}")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], names=["path", "asset_id", "ord", "body", "author", "title", "status"])

    return rows.mapInArrow(read, "path string, asset_id string, ord int, body string, author string, title string, status string")


def write_files(rows: DataFrame, out: str) -> None:
    """Write each row (path, content) as one file below the shared folder ``out``; tasks that run twice write the same file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(out)
        made = set()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                with where.open_output_stream(f"{base}/{path}", compression=None) as f:
                    f.write(content)
            yield b.select(["path"])

    rows.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def json_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of a JSON catalogue (one array per file)."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def synthetic_workspaces(spark: SparkSession, n: int, libraries: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``n`` workspaces with members, and their grants on ``libraries``: one library each whole, one restricted to a folder, the same for the same seed."""
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(m)).cast("int")
    w = spark.range(n)
    role = F.get(F.array(*[F.lit(x) for x in ("viewer", "editor", "owner")]), h("role", 3))
    members = w.select(F.format_string("w%d", "id").alias("workspace_id"), F.format_string("u%d", h("user", 10 * n)).alias("user_id"), role.alias("role"))
    none = F.array().cast("array<string>")
    first, second = h("lib", libraries), F.pmod(h("lib", libraries) + 1, F.lit(libraries))
    grant = lambda lib, prefixes: F.struct(F.format_string("l%d", lib).alias("library_id"), prefixes.alias("path_prefixes"), none.alias("include_tags"), none.alias("exclude_tags"), none.alias("media_types"))
    folder = F.array(F.format_string("folder%d/", h("dir", 40)))
    grants = w.select(F.format_string("w%d", "id").alias("workspace_id"), F.explode(F.array(grant(first, none), grant(second, folder))).alias("g")).select("workspace_id", "g.*", F.lit("viewer").alias("access"))
    return members, grants


def synthetic(spark: SparkSession, n: int, seed: int = 7, tags: int = 200) -> DataFrame:
    """``n`` files with Zipf-distributed tags, the same for the same seed on any number of partitions.

    ``doctype`` depends on the extension and ``topic`` on the folder, each for most files only.
    """
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(m))
    u = h("u", 1 << 30) / F.lit(float(1 << 30))
    ext = F.get(F.array(*[F.lit(x) for x in ("pdf", "docx", "jpg", "png", "mp4", "txt")]), h("ext", 6).cast("int"))
    zipf = lambda k: F.floor(F.pow(F.lit(float(tags)), h(f"t{k}", 1 << 30) / F.lit(float(1 << 30)))).cast("long")
    folder = F.concat(F.lit("folder"), h("dir", 40).cast("string"))
    name = F.concat(F.lit("file_"), F.col("id").cast("string"), F.lit("."), ext)
    return spark.range(n).select(F.col("id").alias("file_id"), name.alias("name"), F.concat_ws("/", folder, name).alias("rel_path"), folder.alias("parent_rel"), ext.alias("ext"), F.floor(F.exp(F.lit(6.0) + u * 14)).cast("long").alias("size_bytes"), F.array_distinct(F.array(*[zipf(k) for k in range(4)])).alias("tags"), F.when(h("typed", 5) > 0, F.when(ext.isin("jpg", "png"), "photo").when(ext == "mp4", "recording").otherwise(F.get(F.array(F.lit("invoice"), F.lit("letter"), F.lit("report")), h("kind", 3).cast("int")))).alias("doctype"), F.when(h("known", 10) > 1, F.concat(F.lit("topic"), (h("dir", 40) % 8).cast("string"))).alias("topic"))
