"""Ebook containers and codecs: bytes in, rows out. Pure functions first, then their Arrow wrappers."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import GENERIC_TITLES
from folioframe.operators import media
from folioframe.operators.html_md import blocks_of
from folioframe.runtime import ship

MAGICS = [(bytes.fromhex(first), f".{ext}") for first, ext in media.MAGICS]
# fixed values: field offsets of the record header, compression kinds, encoding
COMPRESSION, LENGTH, RECORDS, MARK, ENCODING, FIRST_IMAGE, BOUNDARY, FLAGS = 0, 4, 8, 16, 28, 112, 208, 242
HUFF, STORED, LZ77, UTF8 = 17480, 1, 2, 65001


def lz77(data: bytes) -> bytes:
    """PalmDOC decompression. A back-reference beyond the output is skipped; distance 0 repeats the first byte."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        byte = data[at]
        at += 1
        if 1 <= byte <= 8:
            out += data[at : at + byte]
            at += byte
        elif byte < 0x80:
            out.append(byte)
        elif byte >= 0xC0:
            out += bytes((32, byte & 0x7F))
        elif at < end:
            code = byte << 8 | data[at]
            at += 1
            back, run = code >> 3 & 0x7FF, (code & 7) + 3
            if back <= len(out):
                start = len(out) - back if back else 0
                for k in range(run):
                    out.append(out[start + k] if back else out[0] if out else 0)
    return bytes(out)


def trailers(flags: int) -> tuple[bool, int]:
    """Whether records end in a multibyte tail, and how many trailing entries they have."""
    return bool(flags & 1), bin(flags >> 1).count("1")


def trimmed(record: bytes, multibyte: bool, entries: int) -> bytes:
    for _ in range(entries):
        size = 0
        for b in record[-4:]:
            size = b & 0x7F if b & 0x80 else size << 7 | b
        if size:
            record = record[:-size]
    return record[: -((record[-1] & 3) + 1)] if multibyte and record else record


def _int(data: bytes, at: int, size: int, missing: int = 0) -> int:
    return int.from_bytes(data[at : at + size], "big") if len(data) >= at + size else missing


def palm_records(data: bytes) -> list[bytes]:
    """Records of a PalmDB: each ends where the next begins, the last with the file."""
    if len(data) < 78:
        raise ValueError("too small for a PalmDB")
    n = struct.unpack_from(">H", data, 76)[0]
    starts = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(n)]
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]


def mobi_text(data: bytes) -> dict:
    """html, section, text_records, images (number -> name, bytes) and title source of a MOBI file."""
    records = palm_records(data)
    head = records[0] if records else b""
    if head[MARK : MARK + 4] != b"MOBI":
        raise ValueError("no MOBI header")
    kind = _int(head, COMPRESSION, 2)
    if kind == HUFF:
        raise ValueError("HUFF/CDIC compression is not supported")
    if kind not in (STORED, LZ77):
        raise ValueError(f"unknown compression {kind}")
    old_count = _int(head, RECORDS, 2)
    at, section, own = 0, "MOBI6", head
    boundary = _int(head, BOUNDARY, 4, 0xFFFFFFFF)
    if 0 < boundary < len(records):
        for k in range(boundary, min(boundary + 16, len(records))):
            if len(records[k]) > 40 and records[k][MARK : MARK + 4] == b"MOBI":
                at, section, own = k, "KF8", records[k]
                break
    count, multi = _int(own, RECORDS, 2), trailers(_int(own, FLAGS, 2))
    pieces = [trimmed(r, *multi) for r in records[at + 1 : at + 1 + count]]
    raw = b"".join(lz77(p) if _int(own, COMPRESSION, 2) == LZ77 else p for p in pieces)[: _int(own, LENGTH, 4)]
    first = _int(head, FIRST_IMAGE, 4)
    images = {}
    for r in records[first if 0 < first < len(records) else old_count + 1 :]:
        ext = next((e for m, e in MAGICS if r.startswith(m)), None)
        if ext:  # only images take a number
            images[len(images) + 1] = (f"img{len(images) + 1:04d}{ext}", r)
    return {"html": raw.decode("utf-8" if _int(head, ENCODING, 4) == UTF8 else "cp1252", "ignore"), "section": section, "text_records": count, "images": images}


def with_image_names(html: str, names: dict[int, str]) -> str:
    """References by base-36 embed and by decimal recindex become plain ones; unknown ones go."""
    def put(base: int) -> Callable[[re.Match], str]:
        return lambda m: f'<img src="{names[int(m[1], base)]}"/>' if int(m[1], base) in names else ""

    html = re.sub(r'<img[^>]*?src=["\']kindle:embed:([0-9A-Za-z]+)[^>]*>', put(36), html, flags=re.I)
    html = re.sub(r'<(?:img|image)[^>]*?recindex=["\']?(\d+)["\']?[^>]*>', put(10), html, flags=re.I)
    return re.sub(r"(?is)<head[^>]*>.*?</head>", "", re.sub(r"(?i)<mbp:pagebreak[^>]*>", "<hr/>", html))


def decoded(data: bytes) -> str:
    """utf-8, else utf-16, else gb18030, else utf-8 without what does not fit."""
    for name in ("utf-8", "utf-16", "gb18030"):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, UnicodeError):
            continue
    return data.decode("utf-8", "ignore")


def _finished(blocks: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", blocks).strip() + "\n"


def _counts(md: str) -> dict:
    return {"chars": len(md), "headings": len(re.findall(r"^#{1,6} ", md, re.M)), "footnote_refs": len(re.findall(r"\[\^.+?\]", md))}


def mobi_book(path: str, data: bytes) -> dict:
    book = mobi_text(data)
    md = _finished("\n\n".join(blocks_of(with_image_names(book["html"], {k: n for k, (n, _) in book["images"].items()}))))
    found = re.search(r"(?is)<title[^>]*>(.*?)</title>", book["html"])
    title = re.sub(r"\s+", " ", found[1]).strip() if found else ""
    if title.lower() in GENERIC_TITLES:
        title = posixpath.splitext(posixpath.basename(path))[0]
    return {"path": path, "title": title, "creator": "", "md": f"# {title}\n\n---\n\n{md}", "section": book["section"], "parts": book["text_records"], "images": len(book["images"]), **_counts(md)}


def epub_package(data: bytes) -> dict:
    """title, creator, spine (paths in reading order; entries without a manifest item or a file are dropped) and parts by path."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        local = lambda e: e.tag.rpartition("}")[2]
        where = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        package = list(ElementTree.fromstring(z.read(where)).iter())
        first = lambda name: next(((e.text or "").strip() for e in package if local(e) == name), "")
        items = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(where), e.get("href"))) for e in package if local(e) == "item"}
        spine = [items[e.get("idref")] for e in package if local(e) == "itemref" and e.get("idref") in items]
        images = [n for n in sorted(names) if n.lower().endswith((".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".bmp"))]
        return {"title": first("title"), "creator": first("creator"), "spine": spine, "parts": {p: z.read(p) for p in spine if p in names}, "images": images}


def epub_book(path: str, data: bytes) -> dict:
    book = epub_package(data)
    texts = ["\n\n".join(blocks_of(decoded(book["parts"][p]))) for p in book["spine"] if p in book["parts"]]
    texts = [x for x in texts if x.strip()]
    title = book["title"] or posixpath.splitext(posixpath.basename(path))[0]
    head = [f"# {title}"] + ([f"**作者：** {book['creator']}"] if book["creator"] else []) + ["---"]
    md = _finished("\n\n".join(head + texts))
    return {"path": path, "title": title, "creator": book["creator"], "md": md, "section": "EPUB", "parts": len(texts), "images": len(book["images"]), **_counts(md)}


BOOK = "path string, title string, creator string, md string, section string, parts int, images int, chars long, headings int, footnote_refs int, error string"
_BOOK = pa.schema([("path", pa.string()), ("title", pa.string()), ("creator", pa.string()), ("md", pa.string()), ("section", pa.string()), ("parts", pa.int32()), ("images", pa.int32()), ("chars", pa.int64()), ("headings", pa.int32()), ("footnote_refs", pa.int32()), ("error", pa.string())])


def convert(files: DataFrame) -> DataFrame:
    """One row for each file (path, content) with its Markdown and statistics; a file that cannot be read has its ``error``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out.append((epub_book if data[:2] == b"PK" else mobi_book)(path, data))
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError, struct.error, TypeError) as e:
                    out.append({"path": path, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(out, _BOOK)

    return files.select("path", "content").mapInArrow(run, BOOK)


def images(files: DataFrame) -> DataFrame:
    """``path, name, content``: every image of every readable file (path, content); of equal names in an EPUB the last one stands."""
    ship(files.sparkSession)

    def held(data: bytes) -> dict[str, bytes]:
        if data[:2] != b"PK":
            return dict(mobi_text(data)["images"].values())
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {posixpath.basename(n): z.read(n) for n in epub_package(data)["images"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = held(data)
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError, struct.error, TypeError):
                    continue  # ``convert`` reports the error
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["path", "name", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def sanity(section: Column, chars: Column) -> Column:
    """Warning of a converted book: old section, or hardly any text."""
    return F.when(section == "MOBI6", "old_section").when(chars < 2000, "short")


def docx_paragraphs(data: bytes) -> list[tuple[int, str, str]]:
    """(number, style name, text) of a DOCX body's paragraphs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter():
                if s.tag.endswith("}style"):
                    name = next((n for n in s if n.tag.endswith("}name")), None)
                    value = lambda e, k: next((v for a, v in e.attrib.items() if a.endswith(k)), "")
                    styles[value(s, "styleId")] = value(name, "val") if name is not None else ""
    out = []
    for p in (e for e in body.iter() if e.tag.endswith("}p")):
        style = next((v for e in p.iter() if e.tag.endswith("}pStyle") for a, v in e.attrib.items() if a.endswith("val")), "")
        text = "".join(e.text or "" for e in p.iter() if e.tag.endswith("}t"))
        name = styles.get(style, style)
        out.append((len(out) + 1, name[:1].upper() + name[1:] if name.startswith("heading") else name or "Normal", text))
    return out


def docx_cells(xml: Column) -> Column:
    """Rows of all tables in WordprocessingML: array of arrays of struct<text, merged>."""
    def cell(c: Column) -> Column:
        return F.struct(F.array_join(F.regexp_extract_all(c, F.lit(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>"), F.lit(1)), "").alias("text"), c.contains("<w:vMerge").alias("merged"))

    rows = F.regexp_extract_all(xml, F.lit(r"(?s)<w:tr[ >].*?</w:tr>"), F.lit(0))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<w:tc[ >].*?</w:tc>"), F.lit(0)), cell))


# fixed values: names of WordprocessingML, the field of a table of contents, and the text that stands in it until it is updated
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
CONTENTS_FIELD, CONTENTS_HINT = ' TOC \\o "1-{}" \\h \\z \\u ', "右键此处选“更新域”，或按 Ctrl+A 再按 F9 生成目录"
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*)[\s、\.．]+\S"


def _element(name: str, parent=None, text: str | None = None, **values: str):
    e = ElementTree.Element(f"{{{WORD}}}{name}", {f"{{{WORD}}}{k}": v for k, v in values.items()})
    e.text = text
    if parent is not None:
        parent.append(e)
    return e


def _contents(title: str, levels: int) -> list:
    """Paragraphs: a bold, centred title in no heading style, the field, and a page break."""
    head, field, end = (_element("p") for _ in range(3))
    _element("jc", _element("pPr", head), val="center")
    run = _element("r", head)
    look = _element("rPr", run)
    _element("b", look)
    _element("sz", look, val="32")
    _element("t", run, title)
    run = _element("r", field)
    for kind, text in (("begin", None), (None, CONTENTS_FIELD.format(levels)), ("separate", None), ("", CONTENTS_HINT), ("end", None)):
        if kind:
            _element("fldChar", run, fldCharType=kind)
        else:
            e = _element("instrText" if kind is None else "t", run, text)
            e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    _element("br", _element("r", end), type="page")
    return [head, field, end]


def with_contents(data: bytes, title: str = "目录", levels: int = 3, apply: bool = False, longest: int = 60) -> tuple[bytes | None, int, int, int]:
    """A DOCX with a table-of-contents field before its first paragraph; how many paragraphs have heading styles, could be headings, and were given a style.

    Unstyled paragraphs that begin with a number, of at most ``longest`` characters, could be headings of the level that the number has parts. With ``apply`` those of a level up
    to ``levels`` get that heading style, if the document has it under its English or else its Chinese name. Without headings nothing is inserted (null).
    """
    q = lambda name: f"{{{WORD}}}{name}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    tree = ElementTree.fromstring(parts["word/document.xml"])
    body = next(tree.iter(q("body")))
    ids = {}
    if "word/styles.xml" in parts:
        for s in ElementTree.fromstring(parts["word/styles.xml"]).iter(q("style")):
            name = s.find(q("name"))
            if name is not None:
                ids[(name.get(q("val")) or "").lower()] = s.get(q("styleId"))
    names = {v: k for k, v in ids.items()}
    styled, could, applied = 0, 0, 0
    paragraphs = [p for p in body if p.tag == q("p")]
    for p in paragraphs:
        look = p.find(q("pPr"))
        style = look.find(q("pStyle")) if look is not None else None
        name = names.get(style.get(q("val")), style.get(q("val")) or "") if style is not None else ""
        if name.lower().startswith("heading") or name.startswith("标题"):
            styled += 1
            continue
        text = "".join(t.text or "" for t in p.iter(q("t"))).strip()
        found = re.match(NUMBERED_HEADING, text)
        if not found or len(text) > longest:
            continue
        could += 1
        level = found[1].count(".") + 1
        wanted = next((ids[n] for n in (f"heading {level}", f"标题 {level}") if n in ids), None)
        if apply and level <= levels and wanted is not None:
            if look is None:
                look = ElementTree.Element(q("pPr"))
                p.insert(0, look)
            if style is None:
                style = ElementTree.Element(q("pStyle"))
                look.insert(0, style)
            style.set(q("val"), wanted)
            applied += 1
    if styled + applied == 0:
        return None, styled, could, applied
    at = list(body).index(paragraphs[0])
    for k, p in enumerate(_contents(title, levels)):
        body.insert(at + k, p)
    ElementTree.register_namespace("w", WORD)
    parts["word/document.xml"] = ElementTree.tostring(tree, "utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue(), styled, could, applied


_CONTENTS = pa.schema([("path", pa.string()), ("content", pa.binary()), ("n_styled", pa.int32()), ("n_candidates", pa.int32()), ("n_applied", pa.int32()), ("error", pa.string())])


def insert_contents(files: DataFrame, title: str = "目录", levels: int = 3, apply: bool = False) -> DataFrame:
    """``path, content, n_styled, n_candidates, n_applied, error`` of DOCX files (path, content); ``content`` is null where there are no headings."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    content, styled, could, applied = with_contents(data, title, levels, apply)
                    out.append({"path": path, "content": content, "n_styled": styled, "n_candidates": could, "n_applied": applied})
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError, TypeError) as e:
                    out.append({"path": path, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(out, _CONTENTS)

    return files.select("path", "content").mapInArrow(run, "path string, content binary, n_styled int, n_candidates int, n_applied int, error string")


def unpacked(rows: DataFrame, key: str, packed: str) -> DataFrame:
    """``key, text``: bytes of ``packed`` after PalmDOC decompression, each as the character of its number."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else lz77(x).decode("latin-1") for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return rows.select(key, packed).mapInArrow(run, f"`{key}` {kind}, text string")


def record_spans(files: DataFrame) -> DataFrame:
    """``path, rec, start, stop, ext``: records of PalmDB files (path, content); each ends where the next begins, the last with the file. ``ext`` names image records.

    Offsets are read with byte functions; no record's bytes leave the row.
    """
    def number(at: Column, size: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("content"), at, F.lit(size))), 16, 10).cast("long")

    n = F.coalesce(number(F.lit(77), 2), F.lit(0))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: number((k * 8 + 79).cast("int"), 4)))
    stops = F.concat(F.slice(F.col("starts"), F.lit(2), F.size("starts")), F.array(F.length("content").cast("long")))
    head = F.transform(F.col("starts"), lambda a: media.sniffed(F.substring(F.col("content"), (a + 1).cast("int"), F.lit(4))))
    rows = files.withColumn("starts", starts).select("path", F.posexplode(F.arrays_zip(F.col("starts").alias("start"), stops.alias("stop"), head.alias("ext"))).alias("rec", "x"))
    return rows.select("path", "rec", "x.start", "x.stop", "x.ext")


_ENTRIES = pa.schema([("path", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("id", pa.string()), ("href", pa.string()), ("content", pa.binary())])


def epub_entries(files: DataFrame) -> DataFrame:
    """``path, kind, ord, id, href, content`` of EPUB files: manifest items ('item'), spine references ('ref') and files ('file')."""
    ship(files.sparkSession)

    def of(path: str, data: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            local = lambda e: e.tag.rpartition("}")[2]
            where = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
            package = list(ElementTree.fromstring(z.read(where)).iter())
            for k, e in enumerate(e for e in package if local(e) == "item"):
                yield {"path": path, "kind": "item", "ord": k, "id": e.get("id"), "href": posixpath.normpath(posixpath.join(posixpath.dirname(where), unquote(e.get("href"))))}
            for k, e in enumerate(e for e in package if local(e) == "itemref"):
                yield {"path": path, "kind": "ref", "ord": k, "id": e.get("idref")}
            for k, n in enumerate(z.namelist()):
                yield {"path": path, "kind": "file", "ord": k, "href": n, "content": z.read(n)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    yield pa.RecordBatch.from_pylist(list(of(path, data)), _ENTRIES)
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError, TypeError):
                    continue  # ``convert`` reports the error

    return files.select("path", "content").mapInArrow(run, "path string, kind string, ord int, id string, href string, content binary")


def spine(entries: DataFrame) -> DataFrame:
    """``path, ord, href, content``: parts of books in reading order, from ``epub_entries``. References without a manifest item or a file drop out; of equal item ids the last stands."""
    of = lambda kind: entries.where(F.col("kind") == kind)
    items = of("item").groupBy("path", "id").agg(F.max_by("href", "ord").alias("href"))
    parts = of("file").groupBy("path", "href").agg(F.max_by("content", "ord").alias("content"))
    return of("ref").select("path", "ord", "id").join(items, ["path", "id"]).join(parts, ["path", "href"]).select("path", "ord", "href", "content")
