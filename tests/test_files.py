"""Files, journals, archives, word boxes and records on literal cases."""

import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from loomspan.operators import records
from loomspan.sources import files, html


def test_local_seeds(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    sha = hashlib.sha256(b"hello").hexdigest()
    want = spark.createDataFrame([("a.txt", sha), ("b.txt", sha), ("c.txt", sha), ("../a.txt", sha), ("/etc/passwd", sha)], "path string, sha256 string")
    got = {r.path: (r.status, r.content) for r in files.local_seeds(spark, want, str(tmp_path), 50).collect()}
    assert got["a.txt"] == ("read", bytearray(b"hello")) and {k: v[0] for k, v in got.items() if k != "a.txt"} == {"b.txt": "too_large", "c.txt": "missing", "../a.txt": "outside", "/etc/passwd": "outside"}


def test_journal_round_trip_and_torn_tail(spark, tmp_path):
    path = str(tmp_path / "j")
    log = spark.createDataFrame([("r", i, f"e{i}") for i in range(5)], "run string, seq long, event string")
    files.write_journal(log, path, "run", "seq")
    read = lambda: sorted(map(tuple, files.read_journal(spark, path, "run string, seq long, event string", "run", "seq").collect()))
    assert read() == [("r", i, f"e{i}") for i in range(5)]
    (tmp_path / "j" / "part-x.json").write_text('{"run":"r","seq":5,"ev')
    assert read() == [("r", i, f"e{i}") for i in range(5)]


def test_media_and_archives(spark):
    df = spark.createDataFrame([("application/pdf", b"x"), ("application/octet-stream", b"%PDF-1.7"), ("text/html", b"%PDF-1.7"), (None, b"%PDF-")], "mime string, raw binary")
    assert [r.m for r in df.select(files.media(F.col("mime"), F.col("raw")).alias("m")).collect()] == ["pdf", "pdf", None, "pdf"]

    def archive(*names, data=b"x"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, data)
        return out.getvalue()

    assert files.archive_reason(archive("word/document.xml", "[Content_Types].xml")) is None and files.archive_reason(archive("word/document.xml")) == "no_document"
    assert files.archive_reason(archive("word/document.xml", "[Content_Types].xml", data=b"<!doctype x>")) == "declaration"
    assert files.archive_reason(archive("word/document.xml", "../x")) == "unsafe_name"
    assert files.archive_reason(archive("a")) == "no_document" and files.archive_reason(b"no") == "no_archive" and files.archive_reason(None) == "no_archive"
    assert files.archive_reason(archive("word/document.xml", data=b"0" * (8 << 20))) == "expansion"


def test_word_boxes(spark):
    tsv = "level\tpage\n5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t91.5\tword\n5\t1\t1\t1\t1\t2\t10\t20\t30\t10\t20\tlow\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t3\t1\t1\t0\t5\t95\tflat"
    got = files.word_boxes(spark.createDataFrame([(1, tsv, 100, 200)], "id long, tsv string, w int, h int"), "id", "tsv", "w", "h", 60.0).collect()
    assert [(r.text, r.left, r.top, r.right, r.bottom) for r in got] == [("word", 0.1, 0.1, 0.4, 0.15)]


def test_figures(spark):
    df = spark.createDataFrame([("A map of rivers", [(1, 10.0, 190.0, 50.0, 150.0, "BOTTOMLEFT")], 100.0, 200.0), ("A map", [], 100.0, 200.0), ("none", [(1, 0.0, 0.0, 1.0, 1.0, "TOPLEFT")], 100.0, 200.0)], "caption string, regions array<struct<page:int,left:double,top:double,right:double,bottom:double,origin:string>>, page_width double, page_height double")
    got = files.figure_boxes(df, ["MAP"]).collect()
    assert [r.status for r in got] == ["admitted", "regions", "caption"]
    assert tuple(got[0].box) == (0.1, 0.05, 0.5, 0.25) and got[1].box is None


def test_onion_index(spark):
    raw = '{"timed_out":false,"_shards":{"failed":0},"hits":{"hits":[{"_source":{"url":"http://a.onion/","title":"A","meta":"m","content":"c","updated_on":90}},{"_source":{"url":"http://b.onion/","title":"B","meta":" ","content":"long","is_banned":false,"updated_on":95}},{"_source":{"url":"http://c.onion/","title":"C","is_banned":true,"updated_on":95}},{"_source":{"url":"http://d.onion/","title":"D","updated_on":101}}]}}'
    df = spark.createDataFrame([(1, raw), (2, raw.replace('"failed":0', '"failed":1'))], "id long, raw string")
    got = files.onion_search(df, "id", "raw", F.lit(100.0), 50, 3, lambda h: F.endswith(h, F.lit(".onion"))).orderBy("ordinal").collect()
    assert [(r.id, r.title, r.snippet) for r in got] == [(1, "A", "m"), (1, "B", "lon")]


def test_images(spark):
    df = spark.createDataFrame([("/logo.png", "x", "", None, None), ("/a.png", "A Map", "", 300, 200), ("/b.png", "map", "", 10, 10), ("/c.png", "cat", "", None, None)], "url string, caption string, attributes string, width int, height int")
    assert [r.admitted for r in html.image_candidates(df, ["map", "logo"], 100, 100, ["logo"]).collect()] == [False, True, False, False]


def test_text_references(spark):
    t = F.lit("see https://a.org/x). and <https://b.org/y>, https://a.org/x) `http://c.org`;")
    assert spark.range(1).select(html.text_references(t, 2).alias("x")).first().x == ["https://a.org/x", "https://b.org/y"]


def test_context_and_findings(spark):
    c = spark.createDataFrame([(1, "a", 0, 50, 0.9, False), (1, "a", 40, 60, 0.8, False), (1, "b", 0, 50, 0.7, False), (1, "c", 0, 10, 0.95, True), (1, "c", 100, 300, 0.6, False)], "i long, d string, s long, e long, score double, req boolean")
    got = {(r.d, r.s): r.status for r in records.evidence_context(c, "i", "d", "s", "e", "score", "req", 2, 2, 200).collect()}
    assert got == {("c", 0): "shown", ("a", 0): "shown", ("a", 40): "overlap", ("b", 0): "document_limit", ("c", 100): "character_limit"}
    f = spark.createDataFrame([(1, "d", 0, 5, 100), (2, "d", 0, 5, 100), (3, "d", 12, 14, 100), (4, "d", 90, 101, 100), (5, "d", 50, 60, 100)], "finding_id long, doc string, start long, end long, chars long")
    k = spark.createDataFrame([("d", 10, 20)], "doc string, start long, end long")
    assert {r.finding_id: r.reason for r in records.coverage_findings(f, k, "doc").collect()} == {1: None, 2: "repeated", 3: "already_covered", 4: "outside_text", 5: None}


def test_outbox_and_attempts(spark):
    items = spark.createDataFrame([(1, "pending", 0, 5, 9), (2, "pending", 1, 5, 9), (3, "pending", 0, 5, None)], "id long, state string, attempts int, next_attempt long, lease_until long")
    done = spark.createDataFrame([(1, True), (2, False)], "id long, delivered boolean")
    got = {r.id: (r.state, r.attempts, r.next_attempt, r.lease_until) for r in records.outbox_finish(items, done, "id", F.lit(100), 30).collect()}
    assert got == {1: ("acknowledged", 1, 5, None), 2: ("pending", 2, 130, None), 3: ("pending", 0, 5, None)}
    a = spark.createDataFrame([("a", 1, False, False), ("a", 2, True, True), ("b", 1, False, True), ("b", 2, True, True), ("c", 1, True, False)], "doc string, n long, generic boolean, succeeded boolean")
    assert {(r.doc, r.reason) for r in records.attempt_violations(a, "doc", "n").collect()} == {("b", "after_success"), ("c", "first_generic")}
