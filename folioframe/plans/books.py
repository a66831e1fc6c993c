"""Queries on HTML conversion and ebooks. The ebooks are built in memory from region and nation."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.operators import ebook as eb
from folioframe.operators.html_md import html_to_md as to_md
from folioframe.plans.registry import Literal, query, table
from folioframe.sources import files


def epub_bytes(title: str, author: str, chapters: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="c{k}.xhtml"/>' for k in range(len(chapters)))
        refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters))) + '<itemref idref="dangling"/>'
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for k, c in enumerate(chapters):
            z.writestr(f"OPS/c{k}.xhtml", c)
    return out.getvalue()


def _mobi_head(size: int, records: int, packed: bool, flags: int, boundary: int = 0xFFFFFFFF) -> bytes:
    head = bytearray(260)
    struct.pack_into(">H", head, 0, 2 if packed else 1)
    struct.pack_into(">IH", head, 4, size, records)
    head[16:20] = b"MOBI"
    struct.pack_into(">I", head, 28, 65001)
    struct.pack_into(">I", head, 208, boundary)
    struct.pack_into(">H", head, 242, flags)
    return bytes(head)


def _packed(text: bytes) -> bytes:
    """PalmDOC data of ``text``: runs of literals, and a back-reference for every repeat of the eight bytes before."""
    out, at = bytearray(), 0
    while at < len(text):
        if at >= 8 and text[at - 8 : at] == text[at : at + 8]:
            out += struct.pack(">H", 0x8000 | 8 << 3 | 8 - 3)
            at += 8
        else:
            run = text[at : at + 4]
            out += bytes([len(run)]) + run
            at += len(run)
    return bytes(out)


def mobi_bytes(html: str, images: list[bytes], others: int = 1, newer: str | None = None) -> bytes:
    """A stored MOBI: header record, one text record, then records of which only images take a number.

    With ``newer`` a second, compressed section follows, whose text records end in a trailing entry and a multibyte tail.
    """
    text = html.encode()
    records = [_mobi_head(len(text), 1, False, 0), text, *[b"junk"] * others, *images]
    if newer is not None:
        raw = newer.encode()
        pieces = [_packed(raw[k : k + 4096]) + b"\x00" + b"tail\x85" for k in range(0, len(raw), 4096)]
        records[0] = _mobi_head(len(text), 1, False, 0, boundary=len(records) + 1)
        records += [b"BOUNDARY", _mobi_head(len(raw), len(pieces), True, 0b11), *pieces]
    start, offsets = 78 + 8 * len(records), []
    for r in records:
        offsets.append(start)
        start += len(r)
    return bytes(76) + struct.pack(">H", len(records)) + b"".join(struct.pack(">II", o, 0) for o in offsets) + b"".join(records)


def _books(spark, d, make):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names")).collect()  # five regions
    return spark.createDataFrame([(f"/books/{r['r_name']}", bytearray(make(r["r_name"], r["names"]))) for r in g], "path string, content binary")


@query("html_to_md")
def html_to_md(spark, d):
    return to_md(table(spark, d, "pages"), "page_id")


@query("html_md_stats")
def html_md_stats(spark, d):
    md = F.col("md")
    return to_md(table(spark, d, "pages"), "page_id").select("page_id", F.length(md).alias("chars"), t.headings(md).alias("headings"), t.footnote_refs(md).alias("footnote_refs"))


_NAMES = "FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
_BREAK = "chr(10) || chr(10)"


# pages by hand, with what the rules for tags make of them
MARKED = Literal("fx", "html string, md string", [
    ("<h2>A <i>b</i></h2><p>c<br>d</p>", "## A *b*\n\nc d"), ("<ol><li>x<ol><li>y</li></ol></li><li>z</li></ol><ul><li>u</li></ul>", "1. x\n\n1. y\n\n2. z\n\n- u"), ("<blockquote><blockquote><p>q</p></blockquote><p>r</p></blockquote>s", "> > q\n\n> r\n\ns"),
    ("<p>a<sup>[12]</sup> b<sup> （3） </sup><sup></sup></p>", "a[^12] b[^3]"), ('x<img src="a/b%20c.tar.gz">y<img data-src="http://h/i.png?"><img src="http://h/">z', "x\n\n![b c.tar](images/b c.tar.gz)\n\ny\n\n![i](images/i.png?)\n\nz"),
    ("<style>p{}</style><script>s</script>t<hr>u &lt;&#233;&gt;", "t\n\n---\n\nu <é>"), ("<li>loose</li><p> </p><td>1</td><td>2</td>", "- loose\n\n12"), ("<h1>open<p>heading", "# open\n\n# heading"), ("", ""),
])


@query("html_md_fixture", f"WITH {MARKED.sql} SELECT html, md FROM fx")
def html_md_fixture(spark, d):
    return to_md(MARKED.df(spark).select("html", F.col("html").alias("page")), "html", "page")


@query("epub_convert", f"""SELECT '/books/' || r_name AS path, r_name AS title, 'author' AS creator, md, 'EPUB' AS section, n AS parts, 0 AS images, length(md)::BIGINT AS chars, n + 1 AS headings, n AS footnote_refs, NULL::VARCHAR AS error
FROM (SELECT r_name, count(*)::INT AS n, '# ' || r_name || {_BREAK} || '**作者：** author' || {_BREAK} || '---' || {_BREAK} || string_agg('# ' || n_name || {_BREAK} || n_name || ' text[^1]', {_BREAK} ORDER BY n_name) || chr(10) AS md {_NAMES})""")
def epub_convert(spark, d):
    return eb.convert(_books(spark, d, lambda title, names: epub_bytes(title, "author", [f"<html><body><h1>{x}</h1><p>{x} text<sup>[1]</sup></p></body></html>" for x in names])))


def _mobi_page(title: str, names: list[str]) -> str:
    return f"<html><head><title>{title}</title></head><body>" + "".join(f'<h2>{x}</h2><p>x</p><img recindex="1"/>' for x in names) + "</body></html>"


def _mobi_sql(section: str, warning: str) -> str:
    return f"""SELECT '/books/' || r_name AS path, r_name AS title, '' AS creator, '# ' || r_name || {_BREAK} || '---' || {_BREAK} || body AS md, '{section}' AS section, 1 AS parts, 2 AS images, length(body)::BIGINT AS chars, n AS headings, 0 AS footnote_refs, NULL::VARCHAR AS error, '{warning}' AS warning
FROM (SELECT r_name, count(*)::INT AS n, string_agg('## ' || n_name || {_BREAK} || 'x' || {_BREAK} || '![img0001](images/img0001.png)', {_BREAK} ORDER BY n_name) || chr(10) AS body {_NAMES})"""


@query("mobi_convert", _mobi_sql("MOBI6", "old_section"))
def mobi_convert(spark, d):
    page = lambda title, names: mobi_bytes(_mobi_page(title, names), [b"\x89PNG..", b"GIF89a"])
    return eb.convert(_books(spark, d, page)).withColumn("warning", eb.sanity(F.col("section"), F.col("chars")))


@query("mobi_newer_section", _mobi_sql("KF8", "short"))
def mobi_newer_section(spark, d):
    page = lambda title, names: mobi_bytes("<p>the old section</p>", [b"\x89PNG..", b"GIF89a"], newer=_mobi_page(title, names))
    return eb.convert(_books(spark, d, page)).withColumn("warning", eb.sanity(F.col("section"), F.col("chars")))


@query("book_images", f"SELECT '/books/' || r_name AS path, format('img{{:04d}}.png', row_number() OVER (PARTITION BY r_name ORDER BY n_name)) AS name, length(n_name)::INT + 4 AS size, md5('\\x89PNG'::BLOB || encode(n_name)) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey")
def book_images(spark, d):
    page = lambda title, names: mobi_bytes("<p>x</p>", [b"\x89PNG" + x.encode() for x in names])
    return eb.images(_books(spark, d, page)).select("path", "name", F.length("content").alias("size"), F.md5("content").alias("digest"))


PACKED = Literal("fx", "packed string, text string", [("414243", "ABC"), ("E1", " a"), ("4142438018", "ABCABC"), ("027879", "xy"), ("8018", ""), ("41C0", "A @"), ("0461626364801F", "abcdbcdbcdbcdb"), ("4142800D", "AB" + "B" * 8), ("", "")])


@query("lz77_fixture", f"WITH {PACKED.sql} SELECT packed, text FROM fx")
def lz77_fixture(spark, d):
    return eb.unpacked(PACKED.df(spark).select("packed", F.unhex("packed").alias("data")), "packed", "data")


DOCX_STYLES = '<w:styles xmlns:w="{0}"><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="z2"><w:name w:val="标题 2"/></w:style></w:styles>'


def docx_bytes(paragraphs: list[tuple[str, str]]) -> bytes:
    """A DOCX of paragraphs (style id, text)."""
    styled = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else ""
    body = "".join(f"<w:p>{styled(s)}<w:r><w:t>{x}</w:t></w:r></w:p>" for s, x in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{eb.WORD}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", DOCX_STYLES.format(eb.WORD))
    return out.getvalue()


@query("docx_contents", f"""WITH n AS (SELECT r_name, r_regionkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT r_name, 0 AS o, 0 AS k, 'Normal' AS style, '目录' AS text FROM region UNION ALL SELECT r_name, 1, 0, 'Normal', '{eb.CONTENTS_HINT}' FROM region UNION ALL SELECT r_name, 2, 0, 'Normal', '' FROM region
UNION ALL SELECT r_name, 3, 0, 'Heading 1', '1 ' || r_name FROM region UNION ALL SELECT r_name, 4, k * 2, '标题 2', '1.' || k || ' ' || n_name FROM n UNION ALL SELECT r_name, 4, k * 2 + 1, 'Normal', 'text of ' || n_name FROM n)
SELECT '/books/' || r_name AS path, row_number() OVER (PARTITION BY r_name ORDER BY o, k)::INT AS para_no, style, text FROM p""")
def docx_contents(spark, d):
    make = lambda title, names: docx_bytes([("", f"1 {title}"), *[x for k, n in enumerate(names) for x in (("", f"1.{k + 1} {n}"), ("", f"text of {n}"))]])
    return files.docx(eb.insert_contents(_books(spark, d, make), levels=2, apply=True).where("content IS NOT NULL"))


@query("docx_contents_state", """SELECT '/books/' || r_name AS path, CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 0 END AS n_styled, count(*)::INT AS n_candidates, 0 AS n_applied, r_regionkey % 2 = 0 AS inserted, NULL::VARCHAR AS error FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""")
def docx_contents_state(spark, d):
    even = {r["r_name"] for r in table(spark, d, "region").where("r_regionkey % 2 = 0").collect()}  # of five
    make = lambda title, names: docx_bytes([("h1" if title in even else "", title), *[("", f"{k + 1}、{n}") for k, n in enumerate(names)], ("", "9 " + "x" * 80)])
    return eb.insert_contents(_books(spark, d, make)).select("path", "n_styled", "n_candidates", "n_applied", F.col("content").isNotNull().alias("inserted"), "error")


# the third has an odd number of bytes and a cut-off character, so only what fits is read; the fourth fits nothing
DECODED = Literal("fx", "path string, text string", [("a", "中文"), ("b", ""), ("c", "hi"), ("d", "")])


@query("decode_fallback", f"WITH {DECODED.sql} SELECT path, text FROM fx")
def decode_fallback(spark, d):
    rows = [("a", bytearray("中文".encode())), ("b", bytearray("中文字".encode("gb18030")[:5])), ("c", bytearray("hi".encode("utf-16"))), ("d", bytearray(b"\xff\xff\xff"))]
    return files.with_fallback(spark.createDataFrame(rows, "path string, content binary"))


DOCX = Literal("fx", "doc_id int, xml string", [(1, '<w:tbl><w:tr w:a="1"><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:t xml:space="preserve">b </w:t><w:t>c</w:t></w:tc></w:tr><w:tr><w:tc><w:t>d</w:t></w:tc></w:tr></w:tbl>'), (2, "<w:p/>")])


@query("docx_cells", rf"""WITH {DOCX.sql}, r AS (SELECT doc_id, unnest(regexp_extract_all(xml, '(?s)<w:tr[ >].*?</w:tr>')) AS r, generate_subscripts(regexp_extract_all(xml, '(?s)<w:tr[ >].*?</w:tr>'), 1)::INT - 1 AS row_no FROM fx),
c AS (SELECT doc_id, row_no, unnest(regexp_extract_all(r, '(?s)<w:tc[ >].*?</w:tc>')) AS c, generate_subscripts(regexp_extract_all(r, '(?s)<w:tc[ >].*?</w:tc>'), 1)::INT - 1 AS col_no FROM r)
SELECT doc_id, row_no, col_no, array_to_string(regexp_extract_all(c, '<w:t(?:\s[^>]*)?>([^<]*)</w:t>', 1), '') AS text, contains(c, '<w:vMerge') AS merged FROM c""")
def docx_cells(spark, d):
    rows = DOCX.df(spark).select("doc_id", F.posexplode(eb.docx_cells(F.col("xml"))).alias("row_no", "r"))
    return rows.select("doc_id", "row_no", F.posexplode("r").alias("col_no", "c")).select("doc_id", "row_no", "col_no", "c.text", "c.merged")


@query("palm_records", """WITH n AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS k, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT r_name, k + 2 AS rec, length(n_name) + 4 AS size, n, 'png' AS ext FROM n UNION ALL SELECT r_name, x.rec, x.size, n, NULL FROM n, (VALUES (0, 260), (1, 8), (2, 4)) x(rec, size) WHERE k = 1)
SELECT '/books/' || r_name AS path, rec::INT AS rec, (78 + 8 * (n + 3) + sum(size) OVER (PARTITION BY r_name ORDER BY rec) - size)::BIGINT AS start, (78 + 8 * (n + 3) + sum(size) OVER (PARTITION BY r_name ORDER BY rec))::BIGINT AS stop, ext FROM r""")
def palm_records(spark, d):
    page = lambda title, names: mobi_bytes("<p>x</p>", [b"\x89PNG" + x.encode() for x in names])
    return eb.record_spans(_books(spark, d, page))


@query("epub_spine", "SELECT '/books/' || r_name AS path, row_number() OVER (PARTITION BY r_name ORDER BY n_name)::INT - 1 AS ord, 'OPS/c' || (row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1) || '.xhtml' AS href, '<p>' || n_name || '</p>' AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def epub_spine(spark, d):
    books = _books(spark, d, lambda title, names: epub_bytes(title, "", [f"<p>{x}</p>" for x in names]))
    return eb.spine(eb.epub_entries(books)).select("path", "ord", "href", F.decode("content", "utf-8").alias("text"))
