"""Hand-derived expectations and properties of the operators."""

import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.operators import audit, ebook, skeleton, structure, tokens
from folioframe.operators.html_md import to_markdown
from folioframe.plans.books import epub_bytes, mobi_bytes


@pytest.mark.parametrize("html, md", [
    ("<h1>A</h1><p>b<br>c</p>", "# A\n\nb c"), ("<ol><li>x</li><li>y</li></ol>", "1. x\n\n2. y"), ("<ul><li><p>x</p></li></ul>", "-\n\nx"), ("<blockquote><p>q</p></blockquote>", "> q"),
    ("<p>a<sup>[1]</sup></p>", "a[^1]"), ('<p>x<img src="i/a%20b.png">y</p>', "x\n\n![a b](images/a b.png)\n\ny"), ("<td>a</td><td>b</td>", "ab"), ("<title>T</title><h1>A</h1>", "T\n\n# A"),
    ("<script>z</script><p><b>k</b></p>", "**k**"), ("a<hr>b", "a\n\n---\n\nb"), ("<p>a<sup>lost", "a"), ("", ""), ("tail &am", ""), (None, None),
])
def test_html_to_md(html, md):
    assert to_markdown(html) == md


@pytest.mark.parametrize("packed, text", [("414243", b"ABC"), ("E1", b" a"), ("4142438018", b"ABCABC"), ("027879", b"xy"), ("00", b"\0"), ("", b""), ("80", b""), ("418070", b"A")])
def test_lz77(packed, text):
    assert ebook.lz77(bytes.fromhex(packed)) == text


def test_trailing_entries():
    assert ebook.trailers(0b111) == (True, 2) and ebook.trailers(0) == (False, 0)
    assert ebook.trimmed(b"textXX\x83", False, 1) == b"text"
    assert ebook.trimmed(b"text\x00", True, 0) == b"text"


def test_books(spark):
    epub = epub_bytes("Title", "Writer", ["<body><h1>One</h1><p>a</p></body>", "<p> </p>", "<p>b<sup>2</sup></p>"])
    mobi = mobi_bytes('<head><title>Cover</title></head><p>x</p><img recindex="2"/><img recindex="9"/>', [b"BM1", b"GIF8"])
    rows = spark.createDataFrame([("/a/x.epub", bytearray(epub)), ("/a/b.mobi", bytearray(mobi)), ("/bad", bytearray(b"zz"))], "path string, content binary")
    got = {r["path"]: r for r in ebook.convert(rows).collect()}
    assert got["/a/x.epub"]["md"] == "# Title\n\n**作者：** Writer\n\n---\n\n# One\n\na\n\nb[^2]\n" and got["/a/x.epub"]["parts"] == 2
    assert got["/a/b.mobi"]["md"] == "# b\n\n---\n\nx\n\n![img0002](images/img0002.gif)\n" and got["/a/b.mobi"]["images"] == 2
    assert got["/bad"]["error"] and got["/bad"]["md"] is None


def test_mobi_prefers_the_newer_section_and_refuses_others():
    old = bytearray(mobi_bytes("<p>old</p>", []))
    records = ebook.palm_records(bytes(old))
    head = bytearray(records[0])
    struct.pack_into(">I", head, 208, 3)
    newer = bytearray(mobi_bytes("<p>new text</p>", []))
    new_records = ebook.palm_records(bytes(newer))
    parts = [bytes(head), records[1], b"BOUNDARY", *new_records[:2]]
    start, offsets = 78 + 8 * len(parts), []
    for p in parts:
        offsets.append(start)
        start += len(p)
    data = bytes(76) + struct.pack(">H", len(parts)) + b"".join(struct.pack(">II", o, 0) for o in offsets) + b"".join(parts)
    book = ebook.mobi_text(data)
    assert book["section"] == "KF8" and book["html"] == "<p>new text</p>"
    for kind, word in ((17480, "HUFF"), (7, "unknown")):
        bad = bytearray(old)
        struct.pack_into(">H", bad, ebook.palm_records(bytes(old)) and struct.unpack_from(">I", old, 78)[0], kind)
        with pytest.raises(ValueError, match=word):
            ebook.mobi_text(bytes(bad))


def test_decode_fallback():
    assert ebook.decoded("é".encode()) == "é" and ebook.decoded("hi".encode("utf-16")) == "hi" and ebook.decoded("中文字".encode("gb18030") + b"a") == "中文字a"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_missing_and_present_are_disjoint(spark, ordinals):
    rows = spark.createDataFrame([(1, x) for x in ordinals], "g int, last int")
    r = skeleton.with_missing(skeleton.ordinal_sets(rows, ["g"])).first()
    kept = set(ordinals) - set(r["outliers"])
    assert not set(r["missing"]) & kept
    if len(set(ordinals)) >= 2:
        assert sorted(set(r["missing"]) | kept) == list(range(min(kept), max(kept) + 1))


def test_multisets(spark):
    rows = spark.createDataFrame([(1, "≤5 ＜6 Ⅲ 1.90 1.9 ± x"), (2, None), (3, "")], "doc_id int, text string")
    got = {(r["kind"], r["tok"]): r["cnt"] for r in tokens.multiset(rows, ["doc_id"], F.col("text")).collect()}
    assert got == {("cmp", "≤"): 1, ("num", "5"): 1, ("cmp", "<"): 1, ("num", "6"): 1, ("rom", "Ⅲ"): 1, ("num", "1.90"): 1, ("num", "1.9"): 1, ("unit", "±"): 1}
    bag = tokens.multiset(rows, ["doc_id"], F.col("text"))
    assert tokens.deficit(bag.withColumn("page", F.lit(1)), bag).count() == 0
    other = tokens.multiset(rows, ["doc_id"], F.regexp_replace("text", "5", "7"))
    ab, ba = (tokens.difference(x, y, ["doc_id"]) for x, y in ((bag, other), (other, bag)))
    assert {(r["tok"], r["a"], r["b"]) for r in ab.collect()} == {(r["tok"], r["b"], r["a"]) for r in ba.collect()} == {("5", 1, 0), ("7", 0, 1)}


def test_blind_spots_stay(spark):
    # a shifted cell keeps its tokens: nothing is reported
    a = spark.createDataFrame([(1, "1 a 2 b")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "2 b 1 a")], "doc_id int, text string")
    assert tokens.difference(tokens.multiset(a, ["doc_id"], F.col("text")), tokens.multiset(b, ["doc_id"], F.col("text")), ["doc_id"]).count() == 0


def test_tiers_are_disjoint(spark):
    pages = lambda *p: spark.createDataFrame([(1, x) for x in p], "doc_id int, page int")
    got = {r["page"]: r["tier"] for r in audit.tiers(pages(1, 2), pages(2, 3), pages(1, 3, 4)).collect()}
    assert got == {1: "A", 2: "A", 3: "B", 4: "C"}


def test_text_functions(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first()["y"]
    assert row(t.fuse_digits, "1 . 9 0 and 3\n4.1") == "1.90 and 34.1"
    assert row(t.latex_symbols, r"2\times3 \leq \leqslant \phi\varphi") == "2×3 ≤ \\leqslant φφ"
    assert row(t.strip, "　  a b \n") == "a b"
    assert row(t.collapse_newlines, "\n\na\n\n\n\nb \n") == "a\n\nb\n"
    assert [row(t.is_running_head, x) for x in ("- 12 -", "GB 50010", "GB50010正文", "", "x" * 30)] == [True, True, False, False, False]
    assert row(t.without_leader, "1.1 总则......109") == "1.1 总则"
    assert row(t.without_asr_tags, "<|zh|><|NEUTRAL|>你好。") == "你好。"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert skeleton.issues(skeleton.parse_lines(skeleton.lines_of(docs)), ["doc_id", "kind", "parent"]).count() == 0
    assert tokens.multiset(docs, ["doc_id"], F.col("text")).count() == 0
    assert audit.glitches(docs, ["doc_id"]).count() == 0
    assert structure.outline_lint(docs.withColumn("line_no", F.lit(1))).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    from folioframe.sources import files, sinks

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_bytes("4.1.1 x\n4.1.3 y".encode())
    (tmp_path / "in/sub/b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "in/c.txt").write_text("no")
    got = {r["path"].rpartition("/")[2]: r["text"] for r in files.markdown(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": "4.1.1 x\n4.1.3 y", "b.md": "bad � byte"}
    assert files.discovered(spark, str(tmp_path / "in")).count() == 2
    (tmp_path / "s.json").write_text('[{"text": "a", "timestamp": [[0, 1]]}, {"text": "b"}]')
    seg = files.segments(spark, str(tmp_path / "s.json"))
    assert [r["text"] for r in seg.orderBy("seq").collect()] == ["a", "b"] and sinks.transcript(seg).first()["text"] == "a\nb"
    lines = spark.createDataFrame([(1, 2, 1, "c"), (1, 1, 2, "b"), (1, 1, 1, "a")], "doc_id int, section int, ord int, line string")
    report = sinks.report_text(lines)
    assert report.first()["report"] == "a\nb\nc"
    sinks.write_text(report, str(tmp_path / "out"), "report", by="doc_id")
    assert (tmp_path / "out/doc_id=1").exists()
    record = spark.createDataFrame([(1, "notes", 1, "x")], "book_id int, section string, seq int, payload string")
    for _ in range(2):
        sinks.append_record(record, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2


def test_docx(spark):
    import io
    import zipfile

    from folioframe.sources import files

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="1"/></w:pPr><w:r><w:t>1 </w:t><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>2.1 y</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", '<w:styles xmlns:w="w"><w:style w:styleId="1"><w:name w:val="heading 1"/></w:style></w:styles>')
    rows = files.docx(spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary"))
    found = structure.headings(rows.withColumn("doc_id", F.col("path"))).orderBy("para_no").collect()
    assert [(r["style"], r["styled"], r["level"]) for r in found] == [("Heading 1", True, None), ("Normal", False, 2)]


def test_stream(spark, tmp_path):
    from folioframe.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("4.1.1 x\n4.1.2 y\n4.1.4 z")
    q = ingest.audit_numbering(ingest.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["ordinals"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["3"]


def test_parts_and_images(spark):
    parts = spark.createDataFrame([(1, 200, 399, "b"), (1, 0, 199, "a"), (2, 0, 9, "c"), (2, 11, 20, "d")], "doc_id int, first_page int, last_page int, text string")
    got = {r["doc_id"]: (r["n_parts"], r["contiguous"], r["text"]) for r in structure.merged_parts(parts).collect()}
    assert got == {1: (2, True, "a\n\nb"), 2: (2, False, "c\n\nd")}
    books = spark.createDataFrame([("/b.mobi", bytearray(mobi_bytes("<p>x</p>", [b"BM1", b"GIF8"]))), ("/bad", bytearray(b"zz")), ("/none.epub", bytearray(epub_bytes("T", "", ["<p>a</p>"])))], "path string, content binary")
    assert [(r["name"], bytes(r["content"])) for r in ebook.images(books).orderBy("name").collect()] == [("img0001.bmp", b"BM1"), ("img0002.gif", b"GIF8")]
