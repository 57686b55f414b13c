"""Media parsers and the extractor registry."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from granary.operators import extractors as ex
from granary.sources import media


def png(px: np.ndarray, filters=(0,)) -> bytes:
    h, w, _ = px.shape
    lines, above = b"", np.zeros(w * 3, np.int32)
    for y in range(h):
        line, f = px[y].reshape(-1).astype(np.int32), filters[y % len(filters)]
        left = np.concatenate([np.zeros(3, np.int32), line[:-3]])
        corner = np.concatenate([np.zeros(3, np.int32), above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines += bytes([f]) + ((line - {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: paeth}[f]) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_palette_and_hash(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (17, 13, 3), np.uint8)
    assert (media.png_pixels(png(px, (0, 1, 2, 3, 4))) == px).all()
    flag = np.zeros((20, 40, 3), np.uint8)
    flag[:, :30] = (255, 0, 0)
    flag[:, 30:] = (0, 0, 255)
    assert media.palette(flag) == [("ff0000", 0.75), ("0000ff", 0.25)]
    ramp = np.repeat(np.arange(90, dtype=np.uint8)[None, :, None], 80, 0).repeat(3, 2)
    assert media.dhash(ramp) == -1 and media.dhash(ramp[:, ::-1]) == 0
    (tmp_path / "a.png").write_bytes(png(flag))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    got = media.pictures(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["status"].split(":")[0] for r in got.collect()} == {"a.png": "ok", "bad.png": "error"}
    assert [(r["rank"], r["hex"], r["bucket"]) for r in media.colours(got).orderBy("rank").collect()] == [(0, "ff0000", "red"), (1, "0000ff", "blue")]


def _exif() -> bytes:
    def ifd(entries, at):
        head, tail, pos = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, count, body in entries:
            if len(body) <= 4:
                head += struct.pack("<HHI4s", tag, kind, count, body.ljust(4, b"\0"))
            else:
                head += struct.pack("<HHII", tag, kind, count, pos + len(tail))
                tail += body
        return head + b"\0\0\0\0" + tail

    dms = lambda d, m, s: struct.pack("<6I", d, 1, m, 1, s, 1)
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, dms(10, 30, 0)), (3, 2, 2, b"E\0"), (4, 5, 3, dms(20, 0, 36))]
    main = lambda g: [(0x010F, 2, 5, b"Acme\0"), (0x0132, 2, 20, b"2020:02:03 04:05:06\0"), (0x8825, 4, 1, struct.pack("<I", g))]
    g = 8 + len(ifd(main(0), 8))
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + ifd(main(g), 8) + ifd(gps, g)


def test_exif_and_id3(spark, tmp_path):
    (tmp_path / "p.jpg").write_bytes(_exif())
    r = media.photos(spark, str(tmp_path)).first()
    assert (r["camera"], r["captured_at"], r["lat"], round(r["lon"], 2)) == ("Acme", 1580702706, -10.5, 20.01) and r["geohash"]
    frame = b"TPE1" + struct.pack(">I", 5) + b"\0\0" + b"\x03Jane"
    assert media.id3(b"ID3\x03\0\0\0\0\0" + bytes([len(frame)]) + frame) == {"artist": "Jane"} and media.id3(b"xx") == {} and media.exif(b"") == {}


def test_only_outdated_work_runs(spark):
    assets = spark.createDataFrame([("a", "document"), ("b", "document"), ("c", "image")], "asset_id string, media_type string")
    ledger = spark.createDataFrame([("a", "doc.text", 1, "ok")], "asset_id string, extractor string, version int, status string")
    run = lambda df: df.select("asset_id", F.lit("body").alias("body"), F.when(F.col("asset_id") == "b", "bad").alias("error"))
    rows, new = ex.run_all(assets, ledger, ex.registry({"doc.text": run, "image.exif": lambda df: df.filter("false")}), tier="cheap")
    got = {(r["asset_id"], r["extractor"]): r["status"] for r in new.collect()}
    assert got["b", "doc.text"] == "error" and ("a", "doc.text") not in got and got["c", "image.exif"] == "unsupported" and got["a", "doc.pdf"] == "skipped" and ("a", "ai.document") not in got
    assert [e.name for e in ex.registry({})][-1] == "agent.classify" and rows["doc.text"].count() == 1
