"""Media sources without extra libraries: PNG pixels, EXIF and ID3 fields, palettes and perceptual hashes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import colour, identity

#: Colours cut and kept of a picture, and the side to which it is thinned first.
CUT, KEEP, SIDE = 8, 5, 128


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) of an 8-bit PNG without interlacing: grey, RGB, palette, with or without alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, raw, plte = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, ctype, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace:
                raise ValueError("unsupported PNG")
        elif kind == b"PLTE":
            plte = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            raw += body
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[ctype]
    rows = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
    for y in range(h):
        f, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if f == 2:
            line = line + above
        elif f:
            up = above.astype(np.int32)
            for x in range(len(line)):
                left = line[x - channels] if x >= channels else 0
                if f == 1:
                    line[x] += left
                elif f == 3:
                    line[x] += (left + up[x]) // 2
                else:
                    corner = up[x - channels] if x >= channels else 0
                    p = left + up[x] - corner
                    line[x] += min((left, up[x], corner), key=lambda v: abs(p - v))
                line[x] &= 255
        out[y] = above = (line & 255).astype(np.uint8)
    px = out.reshape(h, w, channels)
    if ctype == 3:
        return plte[px[..., 0]]
    return np.repeat(px[..., :1], 3, 2) if channels < 3 else px[..., :3]


def palette(px: np.ndarray) -> list[tuple[str, float]]:
    """(hex, share) of the largest colours by median cut."""
    step = max(1, -(-max(px.shape[:2]) // SIDE))
    boxes = [px[::step, ::step].reshape(-1, 3)]
    total = len(boxes[0])
    while len(boxes) < CUT:
        spread = [int(np.ptp(b, 0).max()) * (len(b) > 1) for b in boxes]
        k = int(np.argmax(spread))
        if not spread[k]:
            break
        b = boxes.pop(k)
        axis = int(np.argmax(np.ptp(b, 0)))
        b = b[np.argsort(b[:, axis], kind="stable")]
        cut = int(np.searchsorted(b[:, axis], b[len(b) // 2, axis])) or int(np.searchsorted(b[:, axis], b[0, axis], side="right"))
        boxes += [b[:cut], b[cut:]]
    sized = sorted(((len(b) / total, *np.rint(b.mean(0)).astype(int).tolist()) for b in boxes), reverse=True)
    return [("%02x%02x%02x" % c[1:], round(c[0], 4)) for c in sized[:KEEP]]


def dhash(px: np.ndarray) -> int:
    """64 signed bits: is each of 9 x 8 averaged grey cells darker than its right neighbour?"""
    grey = px.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    ys, xs = np.linspace(0, grey.shape[0], 9).astype(int), np.linspace(0, grey.shape[1], 10).astype(int)
    cell = np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(xs, xs[1:], strict=False)] for a, b in zip(ys, ys[1:], strict=False)])
    bits = (cell[:, :-1] < cell[:, 1:]).ravel()
    v = int("".join("1" if b else "0" for b in bits), 2)
    return v - (1 << 64) if v >= 1 << 63 else v


def exif(data: bytes) -> dict:
    """Camera, time of capture and place of a JPEG; fields that are missing or damaged are left out."""
    at = data.find(b"Exif\0\0")
    if at < 0:
        return {}
    t = data[at + 6 :]
    order = "<" if t[:2] == b"II" else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def entries(off: int) -> dict:
        out = {}
        (n,) = struct.unpack(order + "H", t[off : off + 2])
        for i in range(n):
            tag, kind, count, value = struct.unpack(order + "HHI4s", t[off + 2 + 12 * i : off + 14 + 12 * i])
            size = sizes.get(kind, 0) * count
            body = value[:size] if size <= 4 else t[struct.unpack(order + "I", value)[0] :][:size]
            if kind == 2:
                out[tag] = body.split(b"\0")[0].decode("latin-1").strip()
            elif kind in (3, 4):
                out[tag] = struct.unpack(order + str(count) + ("H" if kind == 3 else "I"), body)[0]
            elif kind == 5:
                r = struct.unpack(order + str(2 * count) + "I", body)
                out[tag] = [a / b if b else 0.0 for a, b in zip(r[::2], r[1::2], strict=True)]
        return out

    first = entries(struct.unpack(order + "I", t[4:8])[0])
    more = entries(first[0x8769]) if 0x8769 in first else {}
    gps = entries(first[0x8825]) if 0x8825 in first else {}
    got = {"camera": " ".join(x for x in (first.get(0x010F), first.get(0x0110)) if x) or None, "taken": more.get(0x9003) or first.get(0x0132)}
    if len(gps.get(2, ())) == 3 and len(gps.get(4, ())) == 3:
        lat, lon = (sum(v / k for v, k in zip(gps[i], (1, 60, 3600), strict=True)) * (-1 if gps.get(i - 1) in ("S", "W") else 1) for i in (2, 4))
        if (lat, lon) != (0, 0):
            got |= {"lat": lat, "lon": lon}
    return {k: v for k, v in got.items() if v is not None}


def id3(data: bytes) -> dict:
    """Title, artist, album and genre of an ID3v2.3 or 2.4 tag."""
    if data[:3] != b"ID3":
        return {}
    names = {b"TIT2": "title", b"TPE1": "artist", b"TPE2": "album_artist", b"TALB": "album", b"TCON": "genre"}
    safe = lambda b: (b[0] << 21) | (b[1] << 14) | (b[2] << 7) | b[3]
    end, at, out = 10 + safe(data[6:10]), 10, {}
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = safe(data[at + 4 : at + 8]) if data[3] >= 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        kind, body = data[at : at + 4], data[at + 10 : at + 10 + size]
        if kind in names and body:
            out[names[kind]] = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").strip("\0")
        at += 10 + size
    return out


def _read(spark: SparkSession, path: str, extensions: tuple[str, ...], step: Callable[[bytes], dict], schema: str) -> DataFrame:
    """(path, asset_id, fields, status): one row per file; a damaged file is a row with an error."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(identity.extension(F.col("path")).isin(list(extensions)))
    return _of(f.select("path", identity.content_hash(F.col("content")).alias("asset_id"), "content"), step, schema)


def _of(rows: DataFrame, step: Callable[[bytes], dict], schema: str) -> DataFrame:
    """The same of rows (path, asset_id, content)."""
    spark = rows.sparkSession
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    full = f"path string, asset_id string, {schema}, status string"
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], full).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path_, asset, data = (c[i].as_py() for c in b.columns)
                try:
                    got, status = step(data), "ok"
                except Exception as e:  # noqa: BLE001
                    got, status = {}, f"error: {type(e).__name__}"
                yield pa.RecordBatch.from_pydict({"path": [path_], "asset_id": [asset], **{n: [got.get(n)] for n in names}, "status": [status]}, schema=target)

    return rows.select("path", "asset_id", "content").mapInArrow(run, full)


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Size, palette and perceptual hash of PNG files."""
    return _read(spark, path, ("png",), *_PICTURE)


def pictures_of(rows: DataFrame) -> DataFrame:
    return _of(rows, *_PICTURE)


def _picture():
    def step(data: bytes) -> dict:
        px = png_pixels(data)
        p = palette(px)
        return {"height": px.shape[0], "width": px.shape[1], "dhash": dhash(px), "hexes": [h for h, _ in p], "shares": [s for _, s in p]}

    return step, "width int, height int, dhash long, hexes array<string>, shares array<double>"


_PICTURE = _picture()


def colours(found: DataFrame) -> DataFrame:
    """(asset_id, rank, hex, proportion, bucket) of pictures."""
    c = found.filter("status = 'ok'").select("asset_id", F.posexplode(F.arrays_zip("hexes", "shares")).alias("rank", "c"))
    return c.select("asset_id", "rank", F.col("c.hexes").alias("hex"), F.col("c.shares").alias("proportion"), colour.bucket(*colour.rgb(F.col("c.hexes"))).alias("bucket"))


def photos(spark: SparkSession, path: str) -> DataFrame:
    """Camera, capture time (epoch seconds), place and geohash of JPEG files."""
    return _placed(_read(spark, path, ("jpg", "jpeg"), exif, _EXIF))


def photos_of(rows: DataFrame) -> DataFrame:
    return _placed(_of(rows, exif, _EXIF))


_EXIF = "camera string, taken string, lat double, lon double"
_ID3 = "title string, artist string, album_artist string, album string, genre string"


def _placed(got: DataFrame) -> DataFrame:
    at = F.unix_timestamp(F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")))
    return got.withColumn("captured_at", at).withColumn("geohash", colour.geohash(F.col("lat"), F.col("lon"))).drop("taken")


def audio_tags(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ("mp3",), id3, _ID3)


def audio_tags_of(rows: DataFrame) -> DataFrame:
    return _of(rows, id3, _ID3)
