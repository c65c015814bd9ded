"""EPUB archives as tables, and tables as EPUB archives. One archive is the unit of work."""

from __future__ import annotations

import io
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.functions import xhtml

META = "path string, title string, author string, language string, epub_version string, word_count bigint, n_chapters int, n_paragraphs int, problem string"
PARAGRAPHS = "path string, chapter_idx int, name string, para_idx int, tag string, xhtml string, text string, n_words int"
CHAPTERS = "path string, pos int, name string, text string"
ITEMS = "path string, place int, item_id string, href string, name string, media_type string, properties string, spine_place int, n_bytes bigint"
BOOKS = "path string, book_no int, title string, prefix string, entry string, n_items int, spine array<string>"
COVERS = "path string, name string, media_type string, how string, content binary"
DOCUMENTS = {"application/xhtml+xml", "text/html"}
#: Folders inside a book of an anthology.
INNER = {"OEBPS", "xhtml", "text", "images", "css"}


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _image_link(element: ET.Element) -> str | None:
    """What an ``img`` or an SVG ``image`` shows."""
    if _local(element.tag).lower() not in ("img", "image"):
        return None
    return next((v for k, v in element.attrib.items() if _local(k) in ("src", "href")), None)


class Archive:
    """What one archive's package says."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        self.opf_name = self._opf()
        self.opf = ET.fromstring(self.zip.read(self.opf_name))
        self.base = posixpath.dirname(self.opf_name)
        self.items = [dict(e.attrib) for e in self.opf.iter() if _local(e.tag) == "item"]
        self.by_id = {i.get("id"): i for i in self.items}
        self.spine = [e.get("idref") for e in self.opf.iter() if _local(e.tag) == "itemref"]

    def _opf(self) -> str:
        try:
            root = ET.fromstring(self.zip.read("META-INF/container.xml"))
            wanted = next(e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile")
            found = self.resolve(wanted)
            if found:
                return found
        except (KeyError, StopIteration, ET.ParseError):
            pass
        return next(n for n in self.names if n.lower().endswith(".opf"))

    def resolve(self, name: str) -> str | None:
        """The member of this name: exactly, else but for case, else by its end."""
        low = name.lower()
        return next((n for n in self.names if n == name), None) or next((n for n in self.names if n.lower() == low), None) or next((n for n in self.names if n.lower().endswith("/" + low)), None)

    def member(self, href: str) -> str | None:
        path = posixpath.normpath(posixpath.join(self.base, unquote(urlparse(href).path)))
        return self.resolve(path) or self.resolve(href)

    def first(self, field: str, default: str = "") -> str:
        return next((t for e in self.opf.iter() if _local(e.tag) == field and (t := (e.text or "").strip())), default)

    @property
    def version(self) -> str:
        return self.opf.get("version") or "2.0"

    def chapters(self):
        """(place in the spine, member, root) of every document in reading order."""
        for place, idref in enumerate(self.spine):
            item = self.by_id.get(idref)
            if item and item.get("media-type", "application/xhtml+xml") in DOCUMENTS and (name := self.member(item.get("href", ""))):
                yield place, name, xhtml.read(self.zip.read(name))

    def cover(self) -> tuple[str, str, str] | None:
        """(member, media type, how it was found): by the cover meta, the cover-image property, or an image
        named cover."""
        named = next((e.get("content") for e in self.opf.iter() if _local(e.tag) == "meta" and e.get("name") == "cover"), None)
        tries = [("meta", self.by_id.get(named))] if named else []
        tries += [("property", i) for i in self.items if "cover-image" in i.get("properties", "")]
        tries += [("name", i) for i in self.items if i.get("media-type", "").startswith("image/") and "cover" in (i.get("id", "") + " " + i.get("href", "")).lower()]
        for how, item in tries:
            if item and (name := self.member(item.get("href", ""))):
                return name, item.get("media-type", "image/jpeg"), how
        return None

    def cover_pages(self, cover: str):
        """(member, root, the elements that show it) of every page that shows the cover image."""
        for item in self.items:
            name = self.member(item.get("href", "")) if item.get("media-type") in DOCUMENTS else None
            if name:
                root = xhtml.read(self.zip.read(name))
                here = posixpath.dirname(name)
                shown = [e for e in root.iter() if (link := _image_link(e)) and posixpath.normpath(posixpath.join(here, unquote(urlparse(link).path))) == cover]
                if shown:
                    yield name, root, shown

    def books(self):
        """The books of an anthology: the top points of its table of contents."""
        ncx = next((self.member(i["href"]) for i in self.items if i.get("media-type") == "application/x-dtbncx+xml"), None)
        if not ncx:
            return
        nav = next((e for e in ET.fromstring(self.zip.read(ncx)).iter() if _local(e.tag) == "navMap"), None)
        for n, point in enumerate((e for e in nav if _local(e.tag) == "navPoint") if nav is not None else (), 1):
            title = next(((e.text or "").strip() for e in point.iter() if _local(e.tag) == "text"), f"Book {n}")
            entry = next((e.get("src") for e in point.iter() if _local(e.tag) == "content"), "")
            prefix = book_prefix(entry)
            held = [i for i in self.items if unquote(urlparse(i.get("href", "")).path).startswith(prefix)]
            ids = {i.get("id") for i in held}
            yield n, title, prefix, unquote(urlparse(entry).path), len(held), [s for s in self.spine if s in ids]


def book_prefix(href: str) -> str:
    """The folder of a book inside an anthology: the path up to a file or an inner folder."""
    steps = []
    for step in unquote(urlparse(href).path).split("/"):
        if "." in step or step in INNER:
            break
        if step:
            steps.append(step)
    return "/".join(steps) + "/" if steps else ""


def archives(spark: SparkSession, folder: str, glob: str = "*.epub") -> DataFrame:
    """``(path, content)`` of the archives below a folder; few per task, as each is opened whole."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def _each(df: DataFrame, schema: str, rows) -> DataFrame:
    """Runs ``rows(archive)`` on every archive. Rows come in chunks, so one large book is no large batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                out = []
                try:
                    for row in rows(Archive(content)):
                        out.append((path, *row))
                        if len(out) == 2000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except (zipfile.BadZipFile, StopIteration, KeyError, ET.ParseError) as e:
                    if "problem" in names:
                        out.append((path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=names)

    return df.select("path", "content").mapInPandas(run, schema)


def read_meta(df: DataFrame) -> DataFrame:
    """One row per archive; an unreadable one has only its ``problem``. Without a title the file's name stands for
    it, without a language English."""

    def rows(a: Archive):
        held = [xhtml.paragraphs(root) for _, _, root in a.chapters()]
        words = sum(len(xhtml.plain(e).split()) for es in held for e in es)
        yield a.first("title"), a.first("creator", "Unknown"), a.first("language", "en"), a.version, words, len(held), sum(map(len, held)), None

    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return _each(df, META, rows).withColumn("title", F.when(F.col("title") == "", stem).otherwise(F.col("title")))


def read_chapters(df: DataFrame) -> DataFrame:
    """The flat reading: the stripped text of every document that has any, in reading order."""

    def rows(a: Archive):
        pos = 0
        for _, name, root in a.chapters():
            body = next((e for e in root.iter() if xhtml.local(e) == "body"), root)
            if text := xhtml.plain(body).strip():
                yield pos, name, text
                pos += 1

    return _each(df, CHAPTERS, rows)


def read_paragraphs(df: DataFrame) -> DataFrame:
    """The structured reading: every translatable element, in document order."""

    def rows(a: Archive):
        for place, name, root in a.chapters():
            for n, e in enumerate(xhtml.paragraphs(root)):
                text = xhtml.plain(e)
                yield place, name, n, xhtml.local(e), xhtml.fragment(e), text, len(text.split())

    return _each(df, PARAGRAPHS, rows)


def read_items(df: DataFrame) -> DataFrame:
    def rows(a: Archive):
        at = {idref: n for n, idref in enumerate(a.spine)}
        for n, i in enumerate(a.items):
            name = a.member(i.get("href", ""))
            yield n, i.get("id"), i.get("href"), name, i.get("media-type"), i.get("properties"), at.get(i.get("id")), a.zip.getinfo(name).file_size if name else None

    return _each(df, ITEMS, rows).withColumn("spine_place", F.col("spine_place").cast("int"))


def read_anthology(df: DataFrame) -> DataFrame:
    return _each(df, BOOKS, lambda a: a.books())


def read_covers(df: DataFrame) -> DataFrame:
    def rows(a: Archive):
        if found := a.cover():
            yield (*found, a.zip.read(found[0]))

    return _each(df, COVERS, rows)


def rewrite(content: bytes, changed: dict[str, bytes], dropped: set[str] = frozenset()) -> bytes:
    """The archive with some members replaced: mimetype first and stored, others in their order."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        names = [n for n in old.namelist() if n not in dropped]
        for name in sorted(names, key=lambda n: n != "mimetype"):
            data = changed.get(name)
            how = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED if data is not None else old.getinfo(name).compress_type
            new.writestr(name, old.read(name) if data is None else data, how)
        for name in changed.keys() - set(names):
            new.writestr(name, changed[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _document(root: ET.Element) -> bytes:
    return b'<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(root, encoding="utf-8")


def _opf(a: Archive, language: str | None, title: str | None) -> dict[str, bytes]:
    wanted = {"language": language, "title": title}
    changed = False
    for e in a.opf.iter():
        value = wanted.pop(_local(e.tag), None) if _local(e.tag) in wanted else None
        if value and (e.text or "").strip() != value:
            e.text, changed = value, True
    return {a.opf_name: _document(a.opf)} if changed else {}


def translate_archive(content: bytes, texts: dict[tuple[int, int], str], language: str | None = None, title: str | None = None, terms: list | None = None, scope: str = "first-in-book", heading: str = "Notes") -> tuple[bytes, int]:
    """The archive with paragraphs (place in the spine, number) replaced, language and title set and notes
    for terms added; and how many texts did not parse and left their paragraph as it was."""
    a = Archive(content)
    changed, failed, documents = {}, 0, list(a.chapters())
    for place, name, root in documents:
        own = False
        for n, e in enumerate(xhtml.paragraphs(root)):
            if (place, n) in texts:
                fine = xhtml.replace(e, texts[place, n])
                own, failed = own or fine, failed + (not fine)
        if own:
            changed[name] = root
    if terms:
        before = {name: ET.tostring(root) for _, name, root in documents}
        xhtml.inject([root for _, _, root in documents], terms, a.version.startswith("3"), scope, heading)
        changed |= {name: root for _, name, root in documents if ET.tostring(root) != before[name]}
    return rewrite(content, {n: _document(r) for n, r in changed.items()} | _opf(a, language, title)), failed


def translate_archives(df: DataFrame, texts: DataFrame, language: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """``(path, content, n_failed)``: every archive with its paragraphs in ``texts(path, chapter_idx, para_idx,
    xhtml)`` replaced and notes for ``terms(path, translation, gender, note, place)`` added. A book's texts
    and terms meet its archive in one row."""
    held = texts.groupBy("path").agg(F.collect_list(F.struct("chapter_idx", "para_idx", "xhtml")).alias("_t"))
    joined = df.select("path", "content").join(held, "path", "left")
    if terms is not None:
        joined = joined.join(terms.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "translation", "gender", "note"))).alias("_n")), "path", "left")
    else:
        joined = joined.withColumn("_n", F.lit(None).cast("array<struct<place:int,translation:string,gender:string,note:string>>"))

    def run(frames):
        for frame in frames:
            out = []
            for path, content, rows, notes in zip(frame["path"], frame["content"], frame["_t"], frame["_n"]):
                given = {(int(r["chapter_idx"]), int(r["para_idx"])): r["xhtml"] for r in (rows if rows is not None else ()) if r["xhtml"] is not None}
                terms_ = [(n["translation"], n["gender"], n["note"]) for n in (notes if notes is not None else ())]
                out.append((path, *translate_archive(content, given, language, terms=terms_)))
            yield pd.DataFrame(out, columns=["path", "content", "n_failed"])

    return joined.mapInPandas(run, "path string, content binary, n_failed int")


def _resized(root: ET.Element, shown: list[ET.Element], width: int, height: int) -> bool:
    """Gives the image, and an SVG around it, the new size where they name one in plain pixels; a share or a size
    with a unit is the book's layout and stays. Whether anything changed."""
    size, before = {"width": str(width), "height": str(height)}, ET.tostring(root)
    around = [e for e in root.iter() if _local(e.tag) == "svg" and any(x in shown for x in e.iter())]
    for e in [*shown, *around]:
        for name, value in size.items():
            if (e.get(name) or "").strip().isdigit():
                e.set(name, value)
        box = re.split(r"[\s,]+", (e.get("viewBox") or "").strip())
        if e in around and len(box) == 4:
            e.set("viewBox", " ".join([*box[:2], *size.values()]))
    return ET.tostring(root) != before


def _declared(a: Archive, cover: str, media_type: str | None, title: str | None, author: str | None, everywhere: bool = False) -> bool:
    """Makes the package name the cover: its item's type, the ``cover-image`` property in EPUB 3, the ``cover`` meta
    where the property is not (or ``everywhere``, as some readers know no other), a guide reference to the
    page that shows it; and title and author if given. Whether anything changed."""
    before = ET.tostring(a.opf)
    ns = a.opf.tag[: a.opf.tag.index("}") + 1] if a.opf.tag.startswith("{") else ""
    item = next((e for e in a.opf.iter() if _local(e.tag) == "item" and a.member(e.get("href", "")) == cover), None)
    if item is not None:
        if media_type:
            item.set("media-type", media_type)
        if a.version.startswith("3") and "cover-image" not in item.get("properties", "").split():
            item.set("properties", f"{item.get('properties', '')} cover-image".strip())
        metadata = next((e for e in a.opf.iter() if _local(e.tag) == "metadata"), None)
        metas = [e for e in a.opf.iter() if _local(e.tag) == "meta" and e.get("name") == "cover"]
        if metas:
            metas[0].set("content", item.get("id", ""))
        elif metadata is not None and (everywhere or "cover-image" not in item.get("properties", "")):
            ET.SubElement(metadata, f"{ns}meta", {"name": "cover", "content": item.get("id", "")})
    page = next((name for name, *_ in a.cover_pages(cover)), None)
    if page and not any(_local(e.tag) == "reference" and e.get("type") == "cover" for e in a.opf.iter()):
        guide = next((e for e in a.opf.iter() if _local(e.tag) == "guide"), None)
        guide = ET.SubElement(a.opf, f"{ns}guide") if guide is None else guide
        ET.SubElement(guide, f"{ns}reference", {"type": "cover", "title": "Cover", "href": posixpath.relpath(page, a.base or ".")})
    for field, value in (("title", title), ("creator", author)):
        held = next((e for e in a.opf.iter() if _local(e.tag) == field), None)
        if value and held is not None:
            held.text = value
    return ET.tostring(a.opf) != before


def replace_cover(content: bytes, image: bytes, media_type: str | None = None, title: str | None = None, author: str | None = None) -> bytes:
    """The archive with another cover image: declared in the package, and pages that show it sized to it. The type
    is told from the image if not given; one that is no image is an error. Without a cover the archive
    comes back as it is."""
    a = Archive(content)
    found = a.cover()
    if not found:
        return content
    media_type = media_type or image_type(image)
    if media_type is None:
        raise ValueError("not an image of a known type")
    changed, size = {found[0]: image}, image_size(image)
    for name, root, shown in a.cover_pages(found[0]) if size else ():
        if _resized(root, shown, *size):
            changed[name] = _document(root)
    _declared(a, found[0], media_type, title, author)
    return rewrite(content, changed | {a.opf_name: _document(a.opf)})


def fix_cover(content: bytes, title: str | None = None, author: str | None = None) -> bytes:
    """The archive with its cover declared as readers look for it; as it is if all is in order or there is none."""
    a = Archive(content)
    found = a.cover()
    if not found or not _declared(a, found[0], image_type(a.zip.read(found[0])), title, author, True):
        return content
    return rewrite(content, {a.opf_name: _document(a.opf)})


def covered(df: DataFrame, image: bytes | None = None) -> DataFrame:
    """``(path, content)``: every archive with ``image`` as its cover or, without one, its own declared."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [fix_cover(c) if image is None else replace_cover(c, image) for c in frame["content"]]})

    return df.select("path", "content").mapInPandas(run, "path string, content binary")


#: How images of each type begin.
IMAGE_STARTS = [(b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff")]


def image_type(data: bytes) -> str | None:
    """The media type that the first bytes tell."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return next((kind for start, kind in IMAGE_STARTS if data.startswith(start)), None)


def make_archive(title: str, author: str | None, language: str | None, version: str | None, chapters: list[list[str]]) -> bytes:
    """An archive of chapters, each a list of paragraphs as markup; what is null is left out of the package."""
    from xml.sax.saxutils import escape

    item = lambda n: f'<item id="c{n}" href="text/{n:05d}.xhtml" media-type="application/xhtml+xml"/>'
    named = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in (("title", title), ("creator", author), ("language", language)) if v)
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" version="{escape(version or "2.0")}"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{named}</metadata><manifest>{"".join(item(n) for n in range(len(chapters)))}</manifest><spine>{"".join(f"""<itemref idref="c{n}"/>""" for n in range(len(chapters)))}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        for n, paragraphs in enumerate(chapters):
            z.writestr(f"OEBPS/text/{n:05d}.xhtml", f'<html xmlns="{xhtml.XHTML}"><head><title>{n}</title></head><body>{"".join(paragraphs)}</body></html>')
    return out.getvalue()


def build_archives(books: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``(path, content)``: ``<book_id>.epub`` for every book of ``books(book_id, title, author, book_lang, epub_version)``
    with paragraphs in ``paragraphs(book_id, chapter_idx, para_idx, tag, text)``. An archive is one file, so
    a book's paragraphs meet in one row."""
    chapters = paragraphs.groupBy("book_id", "chapter_idx").agg(F.array_sort(F.collect_list(F.struct("para_idx", "tag", "text"))).alias("ps"))
    held = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", "ps"))).alias("cs"))
    joined = books.select("book_id", "title", "author", "book_lang", "epub_version").join(held, "book_id")

    def run(frames):
        from xml.sax.saxutils import escape

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                marked = [[f"<{p['tag'] or 'p'}>{escape(p['text'])}</{p['tag'] or 'p'}>" for p in c["ps"]] for c in row.cs]
                out.append((f"{row.book_id}.epub", make_archive(row.title or "", row.author, row.book_lang, row.epub_version, marked)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return joined.mapInPandas(run, "path string, content binary")


def split_anthology(content: bytes, prefix: str, title: str) -> bytes:
    """One book of an anthology as an archive of its own: its members, manifest, spine and contents."""
    a = Archive(content)
    inside = lambda href: unquote(urlparse(href or "").path).startswith(prefix)
    ids = {i.get("id") for i in a.items if inside(i.get("href"))}
    ncx = next((i for i in a.items if i.get("media-type") == "application/x-dtbncx+xml"), None)
    keep = ids | ({ncx["id"]} if ncx else set())
    for parent in list(a.opf.iter()):
        for child in list(parent):
            if (_local(child.tag) == "item" and child.get("id") not in keep) or (_local(child.tag) == "itemref" and child.get("idref") not in ids):
                parent.remove(child)
        if _local(parent.tag) == "title":
            parent.text = title
    changed = {a.opf_name: _document(a.opf)}
    if ncx and (name := a.member(ncx["href"])):
        root = ET.fromstring(a.zip.read(name))
        order = 0
        for parent in list(root.iter()):
            for child in [c for c in parent if _local(c.tag) == "navPoint"]:
                sources = [e.get("src") for e in child.iter() if _local(e.tag) == "content"]
                if not any(map(inside, sources)):
                    parent.remove(child)
        for point in root.iter():
            if _local(point.tag) == "navPoint":
                order += 1
                point.set("playOrder", str(order))
        changed[name] = _document(root)
    held = {a.member(i.get("href", "")) for i in a.items if i.get("id") in keep} | {a.opf_name, "mimetype", "META-INF/container.xml"}
    return rewrite(content, changed, set(a.names) - held)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height that a PNG, GIF, BMP, WebP or JPEG header tells."""
    big, little = (lambda b: int.from_bytes(b, "big")), (lambda b: int.from_bytes(b, "little"))
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return big(data[16:20]), big(data[20:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return little(data[6:8]), little(data[8:10])
    if data[:2] == b"BM" and len(data) >= 26:
        return little(data[18:22]), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return little(data[24:27]) + 1, little(data[27:30]) + 1
        if data[12:16] == b"VP8 ":
            return little(data[26:28]) & 0x3FFF, little(data[28:30]) & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = little(data[21:25])
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if data[:2] == b"\xff\xd8":
        for m in re.finditer(rb"\xff([\xc0-\xc3\xc5-\xc7\xc9-\xcb\xcd-\xcf])..(.)(..)(..)", data, re.S):
            return big(m[4]), big(m[3])
    return None


def save(df: DataFrame, folder: str, suffix: str = "") -> int:
    """Writes each ``(path, content)`` as a file of the same name below a shared folder; returns how many.
    A task that runs twice writes the same bytes: each file is put in place by a rename."""

    def write(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                stem, end = os.path.splitext(os.path.basename(path))
                place = os.path.join(folder, f"{stem}{suffix}{end}")
                os.makedirs(folder, exist_ok=True)
                with open(f"{place}.{os.getpid()}.part", "wb") as out:
                    out.write(content)
                os.replace(out.name, place)
            yield pd.DataFrame({"n": [len(frame)]})

    return df.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
