"""Small per-file readers for zipped office formats, run inside Spark tasks.

Each takes the bytes of one file and returns text; a file that cannot be read raises.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

# --- fixed values: part names and name spaces of the formats ------------------------------
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
DOCUMENT_PART = "word/document.xml"
STRINGS_PART = "xl/sharedStrings.xml"
SLIDE_PART = "ppt/slides/slide{}.xml"
_SLIDE_NAME = re.compile(r"ppt/slides/slide([0-9]+)\.xml")
DECK_PART, DECK_LINKS = "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_L = "{http://schemas.openxmlformats.org/package/2006/relationships}"

_RUN_TEXT = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}


def _part(data: bytes, name: str) -> ET.Element | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _paragraph(p: ET.Element) -> str:
    runs = [r for child in p for r in ([child] if child.tag == _W + "r" else
            child.findall(_W + "r") if child.tag == _W + "hyperlink" else [])]
    out = []
    for run in runs:
        for node in run:
            name = node.tag.removeprefix(_W)
            if name == "t":
                out.append(node.text or "")
            elif name == "br":  # page and column breaks carry no text
                out.append("\n" if node.get(_W + "type", "textWrapping") == "textWrapping" else "")
            else:
                out.append(_RUN_TEXT.get(name, ""))
    return "".join(out)


def docx_text(data: bytes) -> str:
    """Non-empty body paragraphs in order; tables are left out."""
    root = _part(data, DOCUMENT_PART)
    if root is None:
        raise ValueError("no document part")
    body = root.find(_W + "body")
    paragraphs = [] if body is None else body.findall(_W + "p")
    return "\n".join(t for t in map(_paragraph, paragraphs) if t)


def xlsx_text(data: bytes) -> str:
    """The shared strings, joined by a space; numbers and inline strings are not text here."""
    root = _part(data, STRINGS_PART)
    return "" if root is None else " ".join(t.text for t in root.iter(_S + "t") if t.text)


def _shape_text(shape: ET.Element) -> str:
    lines = []
    for p in shape.iterfind(f"{_P}txBody/{_A}p"):
        lines.append("".join(t.text or "" for t in p.iter(_A + "t")))
    return "\n".join(lines).strip()


def _deck_order(z: zipfile.ZipFile, names: set[str]) -> list[str]:
    """Parts of the slides in the order of the deck's own list; by their numbers where a deck has
    none. A slide that the list leaves out is not shown, and none here."""
    if DECK_PART in names and DECK_LINKS in names:
        links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read(DECK_LINKS)).iter(_L + "Relationship")}
        listed = [links.get(s.get(_R + "id"), "") for s in ET.fromstring(z.read(DECK_PART)).iter(_P + "sldId")]
        # a target is named from the deck's folder, or with a slash from the top
        parts = [posixpath.normpath(posixpath.join("/ppt", t)).lstrip("/") for t in listed]
        return [p for p in parts if p in names]
    numbered = {int(m[1]): name for name in names if (m := _SLIDE_NAME.fullmatch(name))}
    return [numbered[n] for n in sorted(numbered)]


def _slides(data: bytes) -> list[tuple[int, ET.Element]]:
    """All slides, numbered from 1 in the order in which the deck shows them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        order = _deck_order(z, set(z.namelist()))
        return [(n, ET.fromstring(z.read(name))) for n, name in enumerate(order, 1)]


def slide_texts(data: bytes) -> list[tuple[int, int, str]]:
    """``(slide_no, pos, text)`` of the shapes with text on every slide.

    When the first slide has none, every single text node of the slides counts instead.
    """
    roots = _slides(data)
    by_shape = {
        n: [_shape_text(s) for s in root.iterfind(f"{_P}cSld/{_P}spTree/{_P}sp")]
        for n, root in roots
    }
    if not any(by_shape.get(1, [])):
        by_shape = {
            n: [(t.text or "").strip() for t in root.iter(_A + "t")]
            for n, root in roots
        }
    return [
        (n, pos, text)
        for n, texts in by_shape.items()
        for pos, text in enumerate(t for t in texts if t)
    ]
