"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import place_in
from granary.session import Scratch, remove

#: Payloads shorter than this are never revisits.
SHORTEST = 100
ROLL_BYTES = 16 << 20
#: Payload bytes of a shard on average, and most shards (of more bytes the shards get larger and roll more files).
SHARD_BYTES, MOST_SHARDS = 16 << 20, 20_000
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"

MANIFEST = "shard int, seq int, temp string, name string, records long, bytes long, sha256 string"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int, order: int, date: str = DATE) -> bytes:
    """One gzip member: headers are made anew from the row, so equal rows give equal bytes."""
    kind = "response" if refers_to is None else "revisit"
    if kind == "response":
        http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
        block = http + payload
    else:
        block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}".encode()
    rid = uuid.UUID(bytes=hashlib.sha256(f"{page_id}|{order}|{digest}".encode()).digest()[:16], version=4)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {date}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", _percent, url)
        lines.append(f"WARC-Target-URI: {safe}")
        if safe != url or not url:
            lines.append(f"X-Source-URI: {json.dumps(url)}")  # as it stood in the row
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = CRLF.join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, 6, mtime=0)


def _percent(m: re.Match) -> str:
    return f"%{ord(m[0]):02X}"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one inflated record; a wrong block digest is an error."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split(CRLF)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of an archive that comes in pieces, one after another."""
    z, parts = None, []
    for piece in pieces:
        while piece:
            if z is None:
                z, parts = zlib.decompressobj(31), []
            parts.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z = None
    if z is not None:
        raise ValueError("the archive is cut off")


def _filesystem(uri: str):
    """(file system, path) for file:, hdfs:, s3: and the like; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^(\w+):/*", r"\1:///", uri))


class _Roller:
    """Writes the records of one shard into temporary files and starts a new file when one is full."""

    def __init__(self, uri: str, shard: int, roll: int):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
        t = TaskContext.get()
        self.tag = f"{t.taskAttemptId()}" if t else "0"
        self.shard, self.roll, self.seq, self.out, self.done = shard, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temp = f"_temporary/{self.shard:06d}-{self.seq:05d}-{self.tag}"
            self.out, self.n, self.size, self.sha = self.fs.open_output_stream(f"{self.path}/{self.temp}"), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.n, self.size = self.n + 1, self.size + len(data)
        self.sha.update(data)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.done.append((self.shard, self.seq, self.temp, name, self.n, self.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def first_copies(slim: DataFrame) -> DataFrame:
    """(digest, first): the smallest id of each payload of at least SHORTEST bytes that occurs more than once in (id, digest, size)."""
    return slim.filter(F.col("size") >= SHORTEST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")


def write_warc(
    pages: DataFrame, out: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shards: int | None = None, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Write one record for each row below ``out`` and return the manifest of committed files.

    Rows are dealt to shards by ranges of the id and sorted within them; the number of shards
    follows from the bytes of all payloads, so a rerun on the same rows writes the same bytes.
    Tasks write files under names of their own attempt in ``_temporary``; only attempts that
    Spark accepts appear in the manifest, and the commit renames just those (a rename that was
    done before is skipped, so it may be repeated). Files that an earlier write left below
    ``out`` are replaced or stand in no manifest.

    Of rows with equal payloads of at least 100 bytes the one with the smallest id is the
    response (of repeated rows with that id one, by url), the others are revisits. Null html is an
    empty payload; null ids come last and are never referred to. An empty table gives no files.
    """
    spark = pages.sparkSession
    work = Scratch(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    slim = work.keep(pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "digests")
    total = slim.agg(F.sum("size")).first()[0] or 0
    n = int(shards or min(MOST_SHARDS, max(1, -(-total // SHARD_BYTES))))
    cuts = slim.select(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0] or []
    cuts = sorted({c for c in cuts if c is not None})[: n - 1]  # fewer than the shards
    shard = F.coalesce(place_in(cuts, right=True)(F.col("id")), F.lit(len(cuts)))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # only rows that repeat another payload get a decision; it travels beside the payloads, which are shuffled once
    repeats = slim.select("id", "digest").distinct().join(first_copies(slim), "digest")
    decided = repeats.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    both = rows.withColumn("first", F.lit(None).cast(pages.schema[id_col].dataType)).unionByName(decided)
    kind = pages.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, order, found = None, None, 0, {}
        done: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for s, i, url, data, digest, first in zip(*(part[c] for c in ("shard", "id", "url", "payload", "digest", "first")), strict=True):
                    if roller is None or roller.shard != s:
                        if roller is not None:
                            roller.close()
                            done += roller.done
                        roller, last = _Roller(out, s, roll_bytes), None
                    if last is None or last[0] != i:
                        last, order, found = (i,), 0, {}
                    if data is None:  # a decision for the rows of this id, which follow
                        found[digest] = first
                        continue
                    refers = None
                    if len(data) >= SHORTEST and digest in found:
                        if found[digest] != i:
                            refers = found[digest]
                        elif (digest, "kept") in found:
                            refers = i
                        found[(digest, "kept")] = True
                    roller.add(record(i, url, data, digest, refers, len(data), order))
                    order += 1
        if roller is not None:
            roller.close()
            done += roller.done
        cols = list(zip(*done, strict=True)) or [[]] * 7
        names = ["shard", "seq", "temp", "name", "records", "bytes", "sha256"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    dealt = both.withColumn("shard", shard.cast("int")).repartitionById(n, "shard").sortWithinPartitions(
        "shard", F.col("id").asc_nulls_last(), F.col("payload").isNotNull(), "digest", "url"
    )
    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{out}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    commit(manifest, out)
    work.drop()
    return manifest


def commit(manifest: DataFrame, out: str) -> None:
    """Give the files of the manifest their final names; may be repeated after a failure."""

    def rename(batches):
        fs, path = _filesystem(out)
        for batch in batches:
            for temp, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = fs.get_file_info([f"{path}/{temp}", f"{path}/{name}"])
                if a.type.name == "File":
                    if b.type.name == "File":  # of an earlier write; not every file system replaces it by a rename
                        fs.delete_file(b.path)
                    fs.move(a.path, b.path)
                elif b.type.name != "File":
                    raise FileNotFoundError(f"neither {temp} nor {name} exists")
            yield batch

    manifest.select("temp", "name").mapInArrow(rename, "temp string, name string").write.format("noop").mode("overwrite").save()
    remove(manifest.sparkSession, f"{out}/_temporary")  # what lost attempts wrote


READ = "page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, html string"


def read_warc(spark: SparkSession, out: str, *, id_type: str = "bigint", html: bool = True) -> DataFrame:
    """The records of the archives that the manifest below ``out`` names; digests are computed anew and compared.

    Other files are not read. Each archive is streamed by one task, whatever its size; its records
    and its SHA-256 must be those of the manifest. The html of a revisit is null, an absent url too.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest").select("name", "records", "sha256")
    cast = int if id_type in ("bigint", "int", "smallint", "tinyint") else str

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = pa.int64() if id_type == "bigint" else to_arrow_type(_parse_type(id_type))
        types = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.string()]
        fs, path = _filesystem(out)
        full = lambda got: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=NAMES)
        for batch in batches:
            for name, records, sha256 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got, size, count, seen = [], 0, 0, hashlib.sha256()

                def pieces(name=name, seen=seen):
                    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                        while piece := f.read(1 << 14):
                            seen.update(piece)
                            yield piece

                for m in members(pieces()):
                    got.append(_row(m, cast, html))
                    size, count = size + len(m), count + 1
                    if len(got) == 512 or size > 8 << 20:
                        yield full(got)
                        got, size = [], 0
                if count != records or seen.hexdigest() != sha256:
                    raise ValueError(f"{name} is not the archive of the manifest")
                if got:
                    yield full(got)

    NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    files = manifest.count()
    return manifest.repartition(max(1, min(files, 4 * spark.sparkContext.defaultParallelism)), "name").mapInArrow(rows, READ.format(kind=id_type))


def _row(member: bytes, cast, html: bool) -> tuple:
    f, block = parse(member)
    page = cast(f["X-Page-ID"]) if f["X-Page-ID"] else None
    digest, size, revisit = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"]), f["WARC-Type"] == "revisit"
    body = None
    if not revisit:
        body = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(body).hexdigest() != digest or len(body) != size:
            raise ValueError(f"damaged payload of page {page}")
    url = json.loads(f["X-Source-URI"]) if "X-Source-URI" in f else f.get("WARC-Target-URI")
    return page, url, size, digest, f["WARC-Type"], cast(f["X-Refers-To-Page"]) if revisit else None, body.decode() if html and body is not None else None


def _parse_type(name: str):
    from pyspark.sql.types import ByteType, IntegerType, ShortType, StringType

    return {"int": IntegerType(), "smallint": ShortType(), "tinyint": ByteType()}.get(name, StringType())


#: The result of writing and reading back, in SQL.
ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first,
         row_number() OVER (PARTITION BY payload_digest, page_id) AS copy FROM p
), t AS (
  SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS DISTINCT FROM first OR copy > 1) AS again FROM r
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM t
"""
