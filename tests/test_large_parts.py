"""Large documents: neither reading nor writing holds a part, or its nodes, whole."""

import tracemalloc

import pytest
from packages import archive, document, package, para, rels, run
from pyspark.sql import functions as F

from vellumflow.operators import structure
from vellumflow.plans.convert import convert_files, field_frames
from vellumflow.sources import docx, samples

LONG = document(*[para(run(f"text {k}")) for k in range(20_000)])


def peak_mb(rows):
    """Rows gone through one by one, and the most memory that this took."""
    tracemalloc.start()
    n = sum(1 for _ in rows)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return n, peak


def test_reading_holds_open_nodes_only():
    (row,) = docx.inflate("x", archive({"word/document.xml": LONG}), docx.Caps())
    assert row[4] is None and docx.unpacked(row[7]) == LONG.encode()
    n, peak = peak_mb(docx.closed_nodes(docx.pieces(None, row[7]), docx.Caps()))
    assert n == 2 + 20_000 * 3 + 1 and peak < 5


def test_checked_before_nodes_go_out():
    for content, match in ((LONG[:-20], "no element|unclosed"), (LONG.replace("text 19999", "<a>" * 300), "nest"), ("<!DOCTYPE a>" + LONG, "refused")):
        (row,) = docx.inflate("x", archive({"a.xml": content}), docx.Caps())
        with pytest.raises(Exception, match=match):
            docx.check(docx.pieces(None, row[7]), docx.Caps())


def test_writing_holds_no_part():
    rows = ((f"d{k}", 0, f"<w:p>{i:060}</w:p>") for k in range(2) for i in range(40_000))
    n, peak = peak_mb(samples.write_packages(rows, {"a.xml": "<a/>"}, [("b.xml", "<b>", "</b>"), ("c.xml", "<c>", "</c>")]))
    assert n == 2 and peak < 3
    made = dict(samples.write_packages([("p", 0, "<x/>"), ("p", 1, "<y/>"), ("q", 1, "<z/>")], {}, [("b", "<b>", "</b>"), ("c", "<c>", "</c>")]))
    assert [[bytes(r[4]) for r in docx.inflate(p, made[p], docx.Caps())] for p in "pq"] == [[b"<b><x/></b>", b"<c><y/></c>"], [b"<b></b>", b"<c><z/></c>"]]


def test_large_documents_are_converted_whole(spark):
    blip = '<w:drawing><a:blip r:embed="rIdI"/></w:drawing>'
    picture = document(para(f"<w:r>{blip}</w:r>"))
    odd = package(picture, links=[("rIdI", "image", "media/pic.xml")], extra={"word/media/pic.xml": LONG})
    cut = archive({"_rels/.rels": rels(("rId1", "officeDocument", "word/document.xml")), "word/document.xml": LONG[:-20]})
    files = spark.createDataFrame([("long", bytearray(package(LONG))), ("cut", bytearray(cut)), ("odd", bytearray(odd))], "path string, content binary")
    made = convert_files(files)
    got = {r["doc_id"]: (r["status"], r["markdown"]) for r in made.documents.collect()}
    assert got["long"] == (0, "\n\n".join(f"text {k}" for k in range(20_000)) + "\n")
    assert got["cut"] == (docx.STATUS["not_a_package"], None)
    assert [bytes(r["content"]) for r in made.media.collect()] == [LONG.encode()]


def test_innermost_equals_brute_force(spark):
    """Nested, adjoining and unclosed intervals, and keys without any."""
    intervals = [("a", 0, 9), ("a", 2, 7), ("a", 3, 4), ("a", 10, 12), ("a", 14, 99), ("a", 16, 99), ("b", 5, 6)]
    points = [(k, i) for k in "abc" for i in range(20)]
    want = {(k, i): max(b for d, b, e in intervals if d == k and b <= i <= e) for k, i in points if any(d == k and b <= i <= e for d, b, e in intervals)}
    found = structure.innermost(spark.createDataFrame(points, "k string, i int"), spark.createDataFrame(intervals, "k string, b int, e int").withColumn("v", F.col("b")), ["k"], "i", "b", "e", "v")
    assert {(r["k"], r["i"]): r["v"] for r in found.collect()} == want


def test_fields_of_a_document_do_not_meet_in_pairs(spark):
    """The instructions of a document's fields are found by position, not by a join of all with all."""
    parts = spark.createDataFrame([("x", "word/document.xml", bytearray(LONG.encode()), None)], "doc_id string, part_key string, content binary, packed binary")
    plan = field_frames(docx.parse_xml(parts))._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x and ("<=" in x or ">=" in x)] == []


def test_packages_are_made_once(spark):
    """What reads the packages, or only their paths, reads what was made before."""
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "k int, o int, t string")
    files = samples.packages(rows, "k", "o", "t")
    assert "MapInArrow" not in files.select("path")._jdf.queryExecution().toString()
    assert {r["path"]: r["markdown"] for r in convert_files(files).documents.withColumnRenamed("doc_id", "path").collect()} == {"1": "a\n\nb\n", "2": ""}
