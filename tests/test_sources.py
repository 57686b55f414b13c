"""Listings, readers and streams."""

from __future__ import annotations

import hashlib
import zipfile

from pyspark.sql import functions as F

from granary.sources import readers
from granary.streaming import streams


def test_listing_and_identity(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "sub dir").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a.txt").write_text("hello")
    (root / "sub dir" / "copy+1.txt").write_text("hello")
    (root / "empty.mp3").write_bytes(b"")
    (root / ".git" / "x.txt").write_text("no")
    (root / "pic.jpg").write_bytes(b"\x89PNG\r\n\x1a\n..IEND....")
    (root / "cut.pdf").write_bytes(b"%PDF-1.4 half")
    got = {r["rel_path"]: r for r in readers.listing(spark, str(root)).collect()}
    assert set(got) == {"a.txt", "sub dir/copy+1.txt", "pic.jpg", "cut.pdf"} and got["sub dir/copy+1.txt"]["parent_rel"] == "sub dir" and got["a.txt"]["size_bytes"] == 5
    ident = {r["path"].rsplit("/", 1)[1]: r for r in readers.identify(spark, str(root)).collect()}
    assert ident["a.txt"]["asset_id"] == hashlib.sha256(b"hello").hexdigest() and ident["pic.jpg"]["mime"] == "image/png" and ident["cut.pdf"]["truncated"]
    text = {r["path"].rsplit("/", 1)[1]: r["body"] for r in readers.plain_text(spark, str(root)).collect()}
    assert text["a.txt"] == "hello"


def test_folders_are_listed_by_tasks_as_sparks_reader_does(spark, tmp_path):
    root = tmp_path / "l%b é"
    for n in ("a.txt", "d 1/ü+%41.txt", "d 1/e/f#g.txt", "_h/x.txt", ".k/x.txt", "d 1/_y.txt", "d 1/p=1/_z=1.txt"):
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    (root / "empty.txt").write_text("")
    for path in (str(root), f"file://{tmp_path}/plain"):
        (tmp_path / "plain").mkdir(exist_ok=True)
        (tmp_path / "plain" / "b.txt").write_text("b")
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        got = readers._binary(spark, path)
        rows = lambda df: {(r["path"], r["length"], bytes(r["content"]), int(r["modificationTime"].timestamp())) for r in df.collect()}
        assert rows(got) == rows(want) and got.count() > 0
        assert {r["rel_path"] for r in readers.listing(spark, path).collect()} == ({"a.txt", "d 1/ü+%41.txt", "d 1/e/f#g.txt", "d 1/p=1/_z=1.txt"} if "plain" not in path else {"b.txt"})
        assert not got.inputFiles() or all("listed-" in f for f in got.inputFiles())  # no file of the folder is known to the driver


def test_plain_text_encodings(spark, tmp_path):
    for n, b in (("u8", "é".encode()), ("u16", "é".encode("utf-16")), ("cp", "é€".encode("cp1252")), ("long", b"x" * 900_000)):
        (tmp_path / f"{n}.txt").write_bytes(b)
    (tmp_path / "han.txt").write_bytes("中文字".encode("utf-16"))
    whole = {r["path"].rsplit("/", 1)[1]: r["body"] for r in readers.plain_text(spark, str(tmp_path)).collect()}
    assert whole["long.txt"] == "x" * 900_000 and whole["han.txt"] == "中文字"
    got = {r["path"].rsplit("/", 1)[1]: r["body"] for r in readers.plain_text(spark, str(tmp_path), most=readers.LONG_TEXT).collect()}
    assert got["u8.txt"] == "é" and got["u16.txt"] == "é" and got["cp.txt"] == "é€" and len(got["long.txt"]) == 200_000 + len(readers.GAP)


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Jane</dc:creator></c:coreProperties>')
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:t>Slide</a:t></a:p></p>')
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04 no zip")
    got = {(r["path"].rsplit("/", 1)[1], r["ord"]): (r["body"], r["author"], r["status"]) for r in readers.office_text(spark, str(tmp_path)).collect()}
    assert got["a.docx", 0] == ("One", "Jane", "ok") and got["a.docx", 1][0] == "a | b" and got["b.pptx", 0][0] == "Slide" and got["bad.docx", None][2].startswith("error")


def test_synthetic_and_json(spark, tmp_path):
    a = readers.synthetic(spark, 500).orderBy("file_id").collect()
    assert a == readers.synthetic(spark, 500).repartition(7).orderBy("file_id").collect() and {r["ext"] for r in a} >= {"pdf", "txt"}
    (tmp_path / "tags.json").write_text('[{"id": 1, "name": "a"},\n {"id": 2, "name": "b"}]')
    assert readers.json_catalog(spark, str(tmp_path / "tags.json"), "id long, name string").count() == 2


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    step = lambda df, _: seen.extend(r["id"] for r in df.collect())
    spark.range(5).coalesce(1).write.parquet(src)
    for _ in range(2):
        streams.ingest(spark, src, "id long", str(tmp_path / "ck"), step)
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    streams.ingest(spark, src, "id long", str(tmp_path / "ck"), step)
    assert sorted(seen) == list(range(8))


def test_windows_on_a_stream_equal_the_table(spark, tmp_path):
    rows = [(i, 1_700_000_000 + i * 1800, i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = streams.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("tumbling_t").collect()} == {tuple(r) for r in streams.tumbling(df).collect()}
    assert sum(r["n"] for r in streams.sessions(df, gap="1 hour").collect()) == 200


def test_token_bucket_keeps_state(spark, tmp_path):
    src = str(tmp_path / "r")
    put = lambda rows: spark.createDataFrame(rows, "key string, at double").coalesce(1).write.mode("append").parquet(src)
    put([("a", float(i)) for i in range(4)] + [("b", 0.0)])
    seen: list = []
    for batch in (None, [("a", 4.0), ("a", 300.0)]):
        if batch:
            put(batch)
        stream = spark.readStream.schema("key string, at double").parquet(src)
        q = streams.token_bucket(stream, rate=0.01, size=2.0).writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(tuple(r)[:3] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(k, at): ok for k, at, ok in seen}
    assert [got["a", float(i)] for i in range(5)] == [True, True, False, False, False] and got["a", 300.0]
    assert got["b", 0.0] and len(seen) == 7


def test_token_bucket_takes_a_key_by_time_over_arrow_batches(spark, tmp_path):
    times = [(i * 7919 % 600) * 1800.0 for i in range(600)]  # out of order
    spark.createDataFrame([(k, at) for at in times for k in "ab"], "key string, at double").coalesce(1).write.parquet(str(tmp_path / "r"))
    calls = streams.token_bucket(spark.readStream.schema("key string, at double").parquet(str(tmp_path / "r")), rate=1 / 3600, size=2.0, daily=5)
    seen: list = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        calls.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r)[:3] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokens, last, day, used, want = 2.0, 0.0, -1, 0, []
    for at in sorted(times):
        day, used = (day, used) if at // 86400 == day else (at // 86400, 0)
        ok, left = streams.take_tokens(tokens, last, at, rate=1 / 3600, size=2.0)
        capped = ok and used >= 5
        tokens, last, used = left + capped, at, used + (ok and not capped)
        want.append((at, ok and not capped))
    for k in "ab":
        assert sorted((at, ok) for key, at, ok in seen if key == k) == want


def test_entry_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {"graph_edges", "facet_counts"} <= set(q)
