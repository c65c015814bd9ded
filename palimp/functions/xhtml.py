"""XHTML documents: tolerant reading, paragraphs, note markup. Pure functions over ElementTree."""

from __future__ import annotations

import html.entities
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

from palimp.functions.declension import pattern

XHTML, OPS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops"
ET.register_namespace("", XHTML)
ET.register_namespace("epub", OPS)
#: Elements that hold a paragraph; classes of our own markup.
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}
MARK, BLOCK, TITLE, ITEM, BODY, BACK = "reader-note", "reader-notes", "reader-notes-title", "reader-note-item", "reader-note-text", "reader-note-back"
VOID = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "wbr"}
_ENTITY = re.compile(r"&(\w+);")
_BARE = re.compile(r"&(?!(?:\w+|#\d+|#x[0-9a-fA-F]+);)")
_KNOWN = {"amp", "lt", "gt", "quot", "apos"}


class _Tree(HTMLParser):
    """Builds a tree from markup that is not well formed: open elements are closed where they must be."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in PARAGRAPHS - {"blockquote"}:
            while self.open[-1].tag in PARAGRAPHS - {"blockquote"}:
                self.open.pop()
        made = ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs if ":" not in k})
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag, attrs):
        ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs if ":" not in k})

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        at = self.open[-1]
        if len(at):
            at[-1].tail = (at[-1].tail or "") + data
        else:
            at.text = (at.text or "") + data


def well_formed(fragment: str | None) -> bool:
    """Whether a fragment, markup or plain text, parses once bare ampersands are escaped; named entities
    count as text."""
    if fragment is None:
        return False
    if "<" not in fragment and "&" not in fragment and "]]>" not in fragment and fragment.isprintable():
        return True
    body = _ENTITY.sub(lambda m: m[0] if m[1] in _KNOWN else "", _BARE.sub("&amp;", fragment))
    try:
        ET.fromstring(f"<x>{body}</x>")
    except ET.ParseError:
        return False
    return True


def read(content: bytes) -> ET.Element:
    """The document's root. Named entities become characters, bare ampersands text; what is still not
    well formed is read as HTML."""
    text = content.decode("utf-8-sig", "replace")
    clean = _ENTITY.sub(lambda m: m[0] if m[1] in _KNOWN else html.entities.html5.get(m[1] + ";", "&amp;" + m[1] + ";"), _BARE.sub("&amp;", text))
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", clean))
    except ET.ParseError:
        tree = _Tree()
        tree.feed(re.sub(r"<(script|style)\b.*?</\1>", "", text, flags=re.S | re.I))
        return tree.root


def local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1].lower() if isinstance(element.tag, str) else ""


def is_translatable(element: ET.Element) -> bool:
    """A paragraph element with text of its own, or directly in or behind a child."""
    if local(element) not in PARAGRAPHS:
        return False
    return bool((element.text or "").strip()) or any((child.text or child.tail or "").strip() for child in element)


def paragraphs(root: ET.Element) -> list[ET.Element]:
    return [e for e in root.iter() if is_translatable(e)]


def fragment(element: ET.Element) -> str:
    """The element as markup, without namespaces and tail."""
    text = ET.tostring(element, encoding="unicode", short_empty_elements=True)
    end = text.rfind(">") + 1
    text = re.sub(r'\sxmlns(?::\w+)?="[^"]*"', "", text[:end])
    return re.sub(r"(</?)\w+:", r"\1", text)


def plain(element: ET.Element) -> str:
    return "".join(element.itertext())


def replace(element: ET.Element, markup: str) -> bool:
    """Puts the content of ``markup`` (one element, or bare text) into the element; False if it does not
    parse, the element then stays."""
    ns = element.tag[: element.tag.index("}") + 1] if element.tag.startswith("{") else ""
    text = _BARE.sub("&amp;", markup.strip())
    try:
        made = ET.fromstring(f"<x>{text}</x>")
    except ET.ParseError:
        return False
    if len(made) == 1 and not (made.text or "").strip() and not (made[0].tail or "").strip() and local(made[0]) == local(element):
        made = made[0]
    for e in made.iter():
        if isinstance(e.tag, str) and not e.tag.startswith("{"):
            e.tag = ns + e.tag
    element[:] = list(made)
    element.text = made.text
    return True


def _nodes(element: ET.Element, closed: bool = False) -> Iterator[tuple[ET.Element, ET.Element | None, str, bool]]:
    """(owner, parent of a tail's owner, text, usable) of every text node in order; links, notes and our own
    markup are not usable, what stands behind them is."""
    inside = closed or local(element) == "a" or "footnote" in element.get(f"{{{OPS}}}type", "") or element.get("class", "") in {MARK, BLOCK, TITLE, ITEM, BODY}
    if element.text:
        yield element, None, element.text, not inside
    for child in element:
        yield from _nodes(child, inside)
        if child.tail:
            yield child, element, child.tail, not closed and not (inside and local(element) == "a")


def mark(paragraph: ET.Element, term: str, gender: str | None, number: int) -> bool:
    """Puts a note reference behind the first occurrence of the term that counts and lies in one usable
    text node; False if there is none."""
    forms = pattern(term, gender)
    nodes = list(_nodes(paragraph))
    text = "".join(n[2] for n in nodes)
    for held in forms.finditer(text) if forms else ():
        start = 0
        for owner, parent, part, usable in nodes:
            if start <= held.start() < start + len(part):
                if usable and held.end() <= start + len(part):
                    _insert(owner, parent, part, held.end() - start, number, paragraph)
                    return True
                break
            start += len(part)
    return False


def _insert(owner, parent, part, at, number, paragraph) -> None:
    ns = paragraph.tag[: paragraph.tag.index("}") + 1] if paragraph.tag.startswith("{") else ""
    sup = ET.Element(f"{ns}sup", {"class": MARK})
    link = ET.SubElement(sup, f"{ns}a", {f"{{{OPS}}}type": "noteref", "role": "doc-noteref", "id": f"reader-note-{number}-ref", "href": f"#reader-note-{number}"})
    link.text = f"[{number}]"
    sup.tail = part[at:]
    if parent is None:
        owner.text = part[:at]
        owner.insert(0, sup)
    else:
        owner.tail = part[:at]
        parent.insert(list(parent).index(owner) + 1, sup)


def note(ns: str, number: int, text: str, epub3: bool) -> ET.Element:
    item = ET.Element(f"{ns}{'aside' if epub3 else 'div'}", {f"{{{OPS}}}type": "footnote", "role": "doc-footnote", "id": f"reader-note-{number}", "class": ITEM})
    body = ET.SubElement(item, f"{ns}{'p' if epub3 else 'div'}", {"class": BODY})
    body.text = f"{text} "
    back = ET.SubElement(body, f"{ns}a", {"class": BACK, "role": "doc-backlink", "href": f"#reader-note-{number}-ref"})
    back.text = "↩"
    return item


#: How notes look, and the marker by which the rules are found again.
STYLE_ID = "reader-notes-style"
STYLE = f".{MARK}{{font-size:.75em;line-height:0}} .{BLOCK}{{margin-top:2em;border-top:1px solid}} .{TITLE}{{font-weight:bold}} .{ITEM}{{font-size:.9em;margin:.5em 0}} .{BACK}{{text-decoration:none}}"


def ensure_styles(root: ET.Element) -> bool:
    """Puts the rules for notes into the document's head, once; False if they were there. A document without a
    head gets one."""
    if any(e.get("id") == STYLE_ID for e in root.iter()):
        return False
    ns = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    head = next((e for e in root if local(e) == "head"), None)
    if head is None:
        head = ET.Element(f"{ns}head")
        root.insert(0, head)
    ET.SubElement(head, f"{ns}style", {"id": STYLE_ID, "type": "text/css"}).text = STYLE
    return True


def add_notes(root: ET.Element, notes: list[ET.Element], epub3: bool, heading: str) -> None:
    """Notes at the end of the body: bare in EPUB 3, else in one block under a heading, made once."""
    ns = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    body = next((e for e in root.iter() if local(e) == "body"), root)
    if not epub3:
        block = next((e for e in body.iter() if e.get("class") == BLOCK), None)
        if block is None:
            block = ET.SubElement(body, f"{ns}div", {"class": BLOCK, "role": "doc-endnotes"})
            ET.SubElement(block, f"{ns}div", {"class": TITLE}).text = heading
        body = block
    body.extend(notes)


def renumber(root: ET.Element) -> None:
    """Lets the numbers of a document's notes rise in reading order; the set of numbers stays. Nothing is
    touched unless every mark has a note of ours."""
    links = [link for sup in root.iter() if sup.get("class") == MARK for link in sup if local(link) == "a"]
    notes = {e.get("id"): e for e in root.iter() if e.get("class") == ITEM}
    ids = [link.get("href", "")[1:] for link in links]
    if len(ids) < 2 or len(set(ids)) < len(ids) or not all(i in notes and re.fullmatch(r"reader-note-\d+", i) for i in ids):
        return
    held = [notes[i] for i in ids]
    for link, item, n in zip(links, held, sorted(int(i.rsplit("-", 1)[1]) for i in ids)):
        link.set("href", f"#reader-note-{n}")
        link.set("id", f"reader-note-{n}-ref")
        link.text = f"[{n}]"
        item.set("id", f"reader-note-{n}")
        for back in item.iter():
            if back.get("class") == BACK:
                back.set("href", f"#reader-note-{n}-ref")
    for parent in root.iter():
        own = [item for item in held if item in list(parent)]
        if len(own) == len(held):
            for item in held:
                parent.remove(item)
            parent.extend(held)
            break


def inject(chapters: list[ET.Element], terms: list[tuple[str, str | None, str]], epub3: bool, scope: str = "first-in-book", heading: str = "Notes") -> list[str]:
    """Notes for terms (translation, gender, note; longest first) into a book's chapters, numbered through
    the book (after notes it already has); returns the terms noted. Scope: each term once per book,
    chapter or paragraph."""
    number = max((int(i) for c in chapters for e in c.iter() if e.get("class") == ITEM and (i := e.get("id", "").rsplit("-", 1)[-1]).isdigit()), default=0)
    done, noted = set(), []
    for chapter in chapters:
        if scope == "first-in-chapter":
            done = set()
        ns = chapter.tag[: chapter.tag.index("}") + 1] if chapter.tag.startswith("{") else ""
        notes = []
        for paragraph in paragraphs(chapter):
            for term, gender, text in terms:
                if term not in done and mark(paragraph, term, gender, number + 1):
                    number += 1
                    notes.append(note(ns, number, text, epub3))
                    noted.append(term)
                    if scope != "all":
                        done.add(term)
        if notes:
            add_notes(chapter, notes, epub3, heading)
            ensure_styles(chapter)
            renumber(chapter)
    return noted
