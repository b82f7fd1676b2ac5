import base64
import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import readers, sinks


def docx(*paragraphs):
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{p}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files_by_reader(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("FINDINGS OF FACT", "Tom &amp; Jane  agree."))
    (tmp_path / "b.docx").write_bytes(b"# Not a zip\n\nplain text")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\nBT (Rule \\(a\\)) Tj (holds) Tj ET")
    (tmp_path / "d.md").write_bytes("# Order\nline one\nline two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n".encode())
    (tmp_path / "e.txt").write_bytes(b"one\r\nmore\n\n\ntwo")
    (tmp_path / "f.txt").write_bytes(b" \n\n ")
    found = readers.with_paragraphs(readers.files(spark, str(tmp_path)))
    by_name = {r.path.rsplit("/", 1)[1]: r.paragraphs for r in found.collect()}
    assert by_name["a.docx"] == ["FINDINGS OF FACT", "Tom & Jane agree."]
    assert by_name["b.docx"] == ["Not a zip", "plain text"]
    assert by_name["c.pdf"] == ["Rule (a)", "holds"]
    assert by_name["d.md"] == ["Order", "line one line two", "a | b", "1 | 2"]
    assert by_name["e.txt"] == ["one\nmore", "two"]
    assert by_name["f.txt"] == []
    page = readers.page_of_files(readers.files(spark, str(tmp_path), "*.docx"), 1, 1).collect()
    assert [r.path.rsplit("/", 1)[1] for r in page] == ["b.docx"]


def test_uploads(spark):
    rows = spark.createDataFrame([("x", base64.b64encode(b"hello").decode()), ("y", "!!"), ("z", ""), ("n", None)], "id string, content_base64 string")
    got = {r.id: (r.error, r.content and bytes(r.content)) for r in readers.uploads(rows).collect()}
    assert got["x"] == (None, b"hello")
    assert got["y"][0] == "invalid_base64" and got["z"][0] == "empty" and got["n"][1] is None


def test_csv_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi", you'), (2, None), (3, "two\nlines")], "id int, note string")
    lines = [r.line for r in sinks.csv_lines(rows.orderBy("id")).collect()]
    assert lines == ['1,"say ""hi"", you"', "2,", '3,"two\nlines"']
    sinks.write_csv(rows, str(tmp_path / "out"))
    back = readers.csv_rows(spark, str(tmp_path / "out"), "id int, note string")
    assert sorted((r.id, r.note) for r in back.collect()) == [(1, 'say "hi", you'), (2, None), (3, "two\nlines")]
    paragraphs = spark.createDataFrame([(1, 1, "b < c", "Order"), (1, 0, "a", "Findings")], "id int, paragraph_order int, paragraph_text string, section_label string")
    assert sinks.exported(paragraphs, "html").first().body == "<h2>Findings</h2><p>a</p><h2>Order</h2><p>b &lt; c</p>"
    assert sinks.exported(paragraphs, "markdown").first().body == "## Findings\n\na\n\n## Order\n\nb < c"
    sinks.write_json(rows, str(tmp_path / "json"))
    assert readers.json_reports(spark, str(tmp_path / "json")).count() == 3


def test_store_by_key(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.overwrite_by_key(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    sinks.overwrite_by_key(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(tuple(r) for r in sinks.read_store(spark, path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    # what a failed write leaves is not part of the store
    spark.createDataFrame([(1, "x")], "k int, v string").write.parquet(path + "/left-over")
    (tmp_path / "store" / "_versions" / "draft-1").write_text("{}")
    assert sinks.read_store(spark, path).count() == 3 and sinks.read_store(spark, str(tmp_path / "none")) is None
    # only touched buckets are written anew
    many = spark.range(1000).selectExpr("CAST(id AS INT) AS k", "'m' AS v")
    sinks.overwrite_by_key(spark, path, many, ["k"])
    before = sinks._listing(spark, path)[1]
    sinks.overwrite_by_key(spark, path, spark.createDataFrame([(5, "n")], "k int, v string"), ["k"])
    after = sinks._listing(spark, path)[1]
    assert sum(before[k] != after[k] for k in after) == 1 and sinks.read_store(spark, path).count() == 1000
    known = sinks.read_store(spark, path).where("k < 4").select("k")
    fresh = readers.unseen(spark.createDataFrame([(3,), (4,), (4,)], "k int"), known, ["k"])
    assert [r.k for r in fresh.collect()] == [4]
    first = sinks.first_of_each(spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, n int"), ["k"], ["n"])
    assert sorted(tuple(r) for r in first.collect()) == [(1, 1), (2, 5)]


def test_links(spark):
    rows = spark.createDataFrame([("object://x", "k1"), ("http://y", "k2")], "link string, key string")
    got = [r.v for r in rows.select(readers.source_link(F.col("link"), F.col("key"), "/api").alias("v")).collect()]
    assert got == ["/api/source/k1", "http://y"]
    assert readers.missing_tables(spark, ["nowhere_to_be_found"]) == ["nowhere_to_be_found"]
