import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pytest

from palimp.functions import xhtml
from palimp.sources import epub

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="{version}"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> The Door </dc:title><dc:creator>A. Nother</dc:creator><dc:language>en</dc:language>{meta}</metadata>
<manifest><item id="c1" href="text/ch1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/ch2.xhtml" media-type="application/xhtml+xml"/><item id="img" href="../images/cover.png" media-type="image/png"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest>
<spine toc="ncx"><itemref idref="c1"/><itemref idref="c2"/><itemref idref="img"/></spine></package>"""
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
CH1 = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head><body><h1>One</h1><p>He &nbsp;saw AT&T.</p><p> </p><blockquote><p>Nested.</p></blockquote><p><em>All</em> in <b>bold</b></p></body></html>'
CH2 = "<html><body><p>Not closed<p>Second</body></html>"
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint playOrder="1"><navLabel><text>First</text></navLabel><content src="1/1/OEBPS/a.xhtml"/></navPoint><navPoint playOrder="2"><navLabel><text>Second</text></navLabel><content src="1/2/b.xhtml#x"/></navPoint></navMap></ncx>'


def png(width=3, height=5):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def book(version="3.0", meta="", items="", extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OEBPS/content.opf", OPF.format(version=version, meta=meta, items=items))
        z.writestr("OEBPS/text/ch1.xhtml", CH1)
        z.writestr("OEBPS/text/CH2.xhtml", CH2)
        z.writestr("images/cover.png", png())
        z.writestr("OEBPS/toc.ncx", NCX)
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("books")
    (place / "door.epub").write_bytes(book())
    (place / "old.epub").write_bytes(book("2.0"))
    (place / "bad.epub").write_bytes(b"no zip")
    return str(place)


def test_reading(spark, folder):
    df = epub.archives(spark, folder)
    meta = {r["path"].rsplit("/", 1)[1]: r for r in epub.read_meta(df).collect()}
    assert (meta["door.epub"]["title"], meta["door.epub"]["epub_version"], meta["door.epub"]["n_chapters"], meta["door.epub"]["n_paragraphs"]) == ("The Door", "3.0", 2, 7)
    assert meta["bad.epub"]["title"] is None and "BadZipFile" in meta["bad.epub"]["problem"]
    rows = epub.read_paragraphs(df).filter("path like '%door.epub'").orderBy("chapter_idx", "para_idx").collect()
    # the quotation itself has no text of its own, but its paragraph's counts as text of a direct child
    assert [r["tag"] for r in rows] == ["h1", "p", "blockquote", "p", "p", "p", "p"]
    assert rows[1]["text"] == "He \xa0saw AT&T." and rows[1]["n_words"] == 3 and rows[1]["xhtml"] == "<p>He \xa0saw AT&amp;T.</p>"
    assert rows[4]["xhtml"] == "<p><em>All</em> in <b>bold</b></p>" and [r["text"] for r in rows[5:]] == ["Not closed", "Second"]
    chapters = epub.read_chapters(df).filter("path like '%door.epub'").orderBy("pos").collect()
    assert len(chapters) == 2 and chapters[0]["text"].startswith("One")
    items = {r["item_id"]: r for r in epub.read_items(df).filter("path like '%door.epub'").collect()}
    assert items["img"]["name"] == "images/cover.png" and items["c2"]["spine_place"] == 1 and items["ncx"]["spine_place"] is None


def test_covers(spark, folder):
    found = {r["path"].rsplit("/", 1)[1]: (r["name"], r["how"]) for r in epub.read_covers(epub.archives(spark, folder)).collect()}
    assert found == {"door.epub": ("images/cover.png", "name"), "old.epub": ("images/cover.png", "name")}
    assert epub.Archive(book(meta='<meta name="cover" content="img"/>')).cover()[2] == "meta"
    new = epub.replace_cover(book(), png(9, 9), "image/png")
    assert epub.image_size(zipfile.ZipFile(io.BytesIO(new)).read("images/cover.png")) == (9, 9) and epub.Archive(new).cover()[2] == "property"
    assert epub.image_size(png()) == (3, 5) and epub.image_size(b"GIF89a\x07\0\x08\0") == (7, 8) and epub.image_size(b"text") is None
    assert epub.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03") == (6, 5)


def test_cover_page(spark):
    page = b'<html xmlns="http://www.w3.org/1999/xhtml"><body><svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="100%" viewBox="0 0 3 5"><image width="3" height="5" xlink:href="images/cover.png"/></svg><img src="images/other.png" width="3"/></body></html>'
    raw = book(items='<item id="cp" href="cover.xhtml" media-type="application/xhtml+xml"/>', extra={"cover.xhtml": page, "images/other.png": png()})
    a = epub.Archive(raw)
    name = a.cover()[0]
    assert [(n, len(shown)) for n, _, shown in a.cover_pages(name)] == [("cover.xhtml", 1)]
    new = epub.Archive(epub.replace_cover(raw, png(9, 8)))
    root = new.zip.read("cover.xhtml").decode()
    assert 'viewBox="0 0 9 8"' in root and 'width="100%"' in root and 'width="9"' in root and 'height="8"' in root and 'width="3"' in root
    fixed = epub.Archive(epub.fix_cover(raw, "New title", "Someone"))
    assert fixed.cover()[2] == "meta" and fixed.first("title") == "New title" and any(e.get("href", "").endswith("cover.xhtml") and e.get("type") == "cover" for e in fixed.opf.iter())
    again = epub.fix_cover(epub.fix_cover(raw))
    assert epub.fix_cover(again) == again
    with pytest.raises(ValueError):
        epub.replace_cover(raw, b"no image")
    dead = epub.Archive(book(meta='<meta name="cover" content="gone"/>', items='<item id="gone" href="missing.png" media-type="image/png"/>'))
    assert dead.cover()[0] == "images/cover.png"
    df = spark.createDataFrame([("a/1.epub", bytearray(raw))], "path string, content binary")
    assert epub.read_covers(epub.covered(df, png(2, 2))).first()["content"] == png(2, 2) and epub.read_covers(epub.covered(df)).first()["how"] == "meta"


def test_archives_of_tables(spark):
    books = spark.createDataFrame([(7, None, None, None, None), (8, "B & C", "X", "de", "3.0")], "book_id bigint, title string, author string, book_lang string, epub_version string")
    rows = spark.createDataFrame([(7, 3, 1, "p", "a < b & c"), (7, 3, 0, "h2", "T"), (7, 9, 0, None, "z"), (8, 0, 0, "p", " ")], "book_id bigint, chapter_idx int, para_idx int, tag string, text string")
    held = epub.build_archives(books, rows)
    assert {tuple(r) for r in epub.read_paragraphs(held).select("path", "chapter_idx", "para_idx", "tag", "text").collect()} == {("7.epub", 0, 0, "h2", "T"), ("7.epub", 0, 1, "p", "a < b & c"), ("7.epub", 1, 0, "p", "z")}
    meta = {r["path"]: (r["title"], r["author"], r["language"], r["epub_version"], r["word_count"]) for r in epub.read_meta(held).collect()}
    assert meta == {"7.epub": ("7", "Unknown", "en", "2.0", 7), "8.epub": ("B & C", "X", "de", "3.0", 0)}


def test_writing(spark, folder, tmp_path):
    df = epub.archives(spark, folder).filter("path not like '%bad%'")
    rows = epub.read_paragraphs(df).selectExpr("path", "chapter_idx", "para_idx", "if(para_idx = 1, '<p>broken', concat('<', tag, '>Х & ', para_idx, '</', tag, '>')) as xhtml")
    made = epub.translate_archives(df, rows, "ru")
    out = str(tmp_path / "out")
    assert {r["n_failed"] for r in made.collect()} == {2} and epub.save(made, out, "_ru") == 2
    again = epub.archives(spark, out)
    assert {r["language"] for r in epub.read_meta(again).collect()} == {"ru"}
    texts = [r["text"] for r in epub.read_paragraphs(again).filter("path like '%door_ru.epub'").orderBy("chapter_idx", "para_idx").collect()]
    assert texts[0] == "Х & 0" and texts[1] == "He \xa0saw AT&T."
    with zipfile.ZipFile(f"{out}/door_ru.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and z.read("images/cover.png") == png()


def test_unchanged_paragraphs_round_trip(spark, folder):
    df = epub.archives(spark, folder).filter("path like '%door%'")
    rows = epub.read_paragraphs(df).filter("tag <> 'blockquote'").select("path", "chapter_idx", "para_idx", "xhtml")
    content = epub.translate_archives(df, rows).first()["content"]
    before = [(xhtml.fragment(e)) for _, _, root in epub.Archive(book()).chapters() for e in xhtml.paragraphs(root)]
    after = [(xhtml.fragment(e)) for _, _, root in epub.Archive(bytes(content)).chapters() for e in xhtml.paragraphs(root)]
    assert before == after


@pytest.mark.parametrize("epub3", [True, False])
def test_notes(epub3):
    one = xhtml.read('<html xmlns="http://www.w3.org/1999/xhtml"><head/><body><p>Он видел скрип и <a>Облако</a>, потом Облако.</p><p>Тут Облаком.</p></body></html>'.encode())
    two = xhtml.read("<html><body><p>И в Облаке скрипа нет.</p></body></html>".encode())
    noted = xhtml.inject([one, two], [("Облако", "n", "cloud"), ("скрип", "m", "paper")], epub3)
    assert noted == ["Облако", "скрип"]
    text = ET.tostring(one, encoding="unicode")
    assert text.index("скрип<sup") < text.index("[1]") < text.index("Облако<sup") < text.index("[2]") and "reader-note" not in ET.tostring(two, encoding="unicode")
    items = [e for e in one.iter() if e.get("class") == xhtml.ITEM]
    assert [e.get("id") for e in items] == ["reader-note-1", "reader-note-2"] and "paper" in "".join(items[0].itertext())
    assert (xhtml.local(items[0]) == "aside") is epub3 and any(e.get("class") == xhtml.BLOCK for e in one.iter()) is not epub3
    assert sum(e.get("id") == xhtml.STYLE_ID for e in one.iter()) == 1 and not any(e.get("id") == xhtml.STYLE_ID for e in two.iter())
    assert xhtml.inject([one], [("Облако", "n", "cloud")], epub3, "all") == ["Облако"] * 2
    assert sum(e.get("id") == xhtml.STYLE_ID for e in one.iter()) == 1


def test_anthology(spark):
    items = '<item id="a" href="1/1/OEBPS/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="1/2/b.xhtml" media-type="application/xhtml+xml"/>'
    raw = book("2.0", items=items, extra={"OEBPS/1/1/OEBPS/a.xhtml": CH2, "OEBPS/1/2/b.xhtml": CH2})
    raw_df = spark.createDataFrame([("x.epub", bytearray(raw))], "path string, content binary")
    got = epub.read_anthology(raw_df).orderBy("book_no").collect()
    assert [(r["title"], r["prefix"], r["n_items"]) for r in got] == [("First", "1/1/", 1), ("Second", "1/2/", 1)]
    one = epub.Archive(epub.split_anthology(raw, "1/2/", "Second"))
    assert {i["id"] for i in one.items} == {"b", "ncx"} and one.first("title") == "Second" and "OEBPS/1/1/OEBPS/a.xhtml" not in one.names
    assert [epub.book_prefix(h) for h in ("1/1/OEBPS/c.xml", "3/t.xhtml", "a%20b/x.html", "c.xml")] == ["1/1/", "3/", "a b/", ""]
