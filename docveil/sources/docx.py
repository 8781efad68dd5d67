"""Word documents: text with places, edits that keep the runs, metadata, and documents with tracked changes.

Only the standard library's ZIP reader and patterns over the XML are used; a document is a row with its bytes.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column

from ..functions.udf import arrow_function

# fixed values: parts with text, in reading order
PARTS = [r"word/document\.xml", r"word/header\d*\.xml", r"word/footer\d*\.xml", r"word/footnotes\.xml", r"word/endnotes\.xml", r"word/comments\.xml", r"word/diagrams/data\d*\.xml", r"word/charts/chart\d*\.xml"]
_RUN = re.compile(r"<(w:t|w:delText|w:instrText|a:t)(\s[^>]*)?>([^<]*)</\1>|<w:tab/>|<w:(?:br|cr)(?:\s[^>]*)?/>|</[wa]:p>|<w:noBreakHyphen/>")
BETWEEN = "\n\n"


@dataclass
class Run:
    part: str
    kind: str
    xml_from: int  # of its tag
    text_from: int  # of its text in the XML
    xml_to: int
    start: int  # in the document's text
    text: str


@dataclass
class Document:
    parts: dict[str, str]
    runs: list[Run]
    text: str


def escape(s: str) -> str:
    return html.escape(s, quote=True).replace("&#x27;", "'")


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def read(data: bytes) -> Document:
    """Raises ValueError for what isn't a .docx."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if "word/document.xml" not in names:
                raise ValueError("not a Word document")
            parts = {n: z.read(n).decode("utf-8") for p in PARTS for n in sorted((n for n in names if re.fullmatch(p, n)), key=_natural)}
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError) as e:
        raise ValueError("not a Word document") from e
    out: list[str] = []
    runs: list[Run] = []
    at = 0

    def put(s: str) -> None:
        nonlocal at
        out.append(s)
        at += len(s)

    for k, (name, xml) in enumerate(parts.items()):
        if k:
            put(BETWEEN)
        for m in _RUN.finditer(xml):
            if m[1]:
                code = m[1] == "w:instrText"
                if code:
                    put("\n")
                text = html.unescape(m[3])
                runs.append(Run(name, m[1], m.start(), m.start(3), m.end(3), at, text))
                put(text)
                if code:
                    put("\n")
            else:
                put("\t" if m[0] == "<w:tab/>" else "-" if m[0] == "<w:noBreakHyphen/>" else "\n")
    return Document(parts, runs, "".join(out))


def rewrite(data: bytes, new: dict[str, str], drop: frozenset[str] = frozenset()) -> bytes:
    """The archive with some parts replaced or left out."""
    buf = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as o:
        for i in z.infolist():
            if i.filename not in drop:
                o.writestr(zipfile.ZipInfo(i.filename, i.date_time), new[i.filename].encode() if i.filename in new else z.read(i.filename), zipfile.ZIP_DEFLATED)
    return buf.getvalue()


def edited(data: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    """Replace spans of the text: the new text goes into the first run that a span touches, the rest of the span is cut from the others."""
    doc = read(data)
    by_run: dict[int, list[tuple[int, int, str]]] = {}
    for s, e, new in edits:
        placed = False
        for k, r in enumerate(doc.runs):
            lo, hi = max(s, r.start) - r.start, min(e, r.start + len(r.text)) - r.start
            if hi > lo:
                by_run.setdefault(k, []).append((lo, hi, "" if placed else new))
                placed = True
    parts = dict(doc.parts)
    for k in sorted(by_run, reverse=True):
        r = doc.runs[k]
        t = r.text
        for lo, hi, new in sorted(by_run[k], reverse=True):
            t = t[:lo] + new + t[hi:]
        xml = parts[r.part]
        tag = xml[r.xml_from : r.text_from]
        if t != t.strip() and "xml:space=" not in tag:
            tag = tag[:-1] + ' xml:space="preserve">'
        parts[r.part] = xml[: r.xml_from] + tag + escape(t) + xml[r.xml_to :]
    return rewrite(data, {n: x for n, x in parts.items() if x != doc.parts[n]})


def body_text(data: bytes) -> str:
    """The visible text of the body: no deleted text, field codes or fallbacks."""
    xml = re.sub(r"<mc:Fallback\b.*?</mc:Fallback>", "", read(data).parts["word/document.xml"], flags=re.S)
    out = []
    for m in _RUN.finditer(xml):
        out.append((html.unescape(m[3]) if m[1] in ("w:t", "a:t") else "") if m[1] else "\t" if m[0] == "<w:tab/>" else "-" if m[0] == "<w:noBreakHyphen/>" else "\n")
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def scrubbed(data: bytes, substitute=lambda s: s) -> tuple[bytes, list[str]]:
    """(document, what was removed): authors, company, thumbnail, comment authors and local paths; other properties and links go through ``substitute``."""
    new: dict[str, str] = {}
    drop: set[str] = set()
    removed: list[str] = []
    empty = lambda xml, tag: re.sub(rf"<{tag}(\s[^>]*)?>[^<]*</{tag}>", rf"<{tag}\1></{tag}>", xml)
    filled = lambda xml, tag: re.search(rf"<{tag}(?:\s[^>]*)?>[^<]*\S[^<]*</{tag}>", xml) is not None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if re.fullmatch(r"docProps/thumbnail\.[a-z]+", n, re.I):
                drop.add(n)
                removed.append("thumbnail")
                continue
            if not n.endswith((".xml", ".rels")):
                continue
            xml = old = z.read(n).decode("utf-8", "replace")
            if n == "docProps/core.xml":
                if filled(xml, "dc:creator") or filled(xml, "cp:lastModifiedBy"):
                    removed.append("author")
                xml = empty(empty(xml, "dc:creator"), "cp:lastModifiedBy")
                for tag in ("dc:title", "dc:subject", "dc:description", "cp:keywords", "cp:category"):
                    xml = re.sub(rf"(<{tag}(?:\s[^>]*)?>)([^<]*)(</{tag}>)", lambda m: m[1] + escape(substitute(html.unescape(m[2]))) + m[3], xml)
            elif n == "docProps/app.xml":
                if filled(xml, "Company") or filled(xml, "Manager"):
                    removed.append("company")
                xml = empty(empty(xml, "Company"), "Manager")
            elif n.startswith("word/") and n.endswith(".xml"):
                xml = re.sub(r'\b(w:author|w15:author)="[^"]*"', r'\1="Autor"', xml)
                xml = re.sub(r'\bw15:userId="[^"]*"', 'w15:userId=""', re.sub(r'\bw:initials="[^"]*"', 'w:initials="A"', xml))
                if xml != old:
                    removed.append("comment authors")
            elif n.endswith(".rels"):
                xml = re.sub(r'<Relationship\b[^>]*Type="[^"]*/thumbnail"[^>]*/>', "", xml)
                if re.search('Target="file:', xml, re.I):
                    removed.append("local path")
                xml = re.sub(r'(Target=")file:[^"]*?([^"\\/]*")', r"\1\2", xml, flags=re.I)
                xml = re.sub(r'(Target=")([^"]*)(")', lambda m: m[1] + escape(substitute(html.unescape(m[2]))) + m[3], xml)
            if xml != old:
                new[n] = xml
    return rewrite(data, new, frozenset(drop)), list(dict.fromkeys(removed))


_CT = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def build(paragraphs: list[list[tuple[int, str]]], author: str = "docveil", date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A document of paragraphs of (op, text): 0 plain, -1 a tracked deletion, 1 a tracked insertion.  Accepting all changes gives the new version,
    rejecting them the old one."""
    count = 0

    def run(op: int, text: str) -> str:
        nonlocal count
        count += 1
        who = f'w:id="{count}" w:author="{escape(author)}" w:date="{date}"'
        t = f'<w:r><w:{"delText" if op < 0 else "t"} xml:space="preserve">{escape(text)}</w:{"delText" if op < 0 else "t"}></w:r>'
        return f"<w:del {who}>{t}</w:del>" if op < 0 else f"<w:ins {who}>{t}</w:ins>" if op > 0 else t

    def paragraph(ops: list[tuple[int, str]]) -> str:
        nonlocal count
        whole = {o for o, _ in ops}
        mark = ""
        if whole in ({-1}, {1}):
            count += 1
            mark = f'<w:pPr><w:rPr><w:{"del" if whole == {-1} else "ins"} w:id="{count}" w:author="{escape(author)}" w:date="{date}"/></w:rPr></w:pPr>'
        return f"<w:p>{mark}{''.join(run(o, t) for o, t in ops)}</w:p>"

    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(map(paragraph, paragraphs)) + "</w:body></w:document>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in (("[Content_Types].xml", _CT), ("_rels/.rels", _RELS), ("word/document.xml", xml)):
            z.writestr(zipfile.ZipInfo(n, (2000, 1, 1, 0, 0, 0)), c, zipfile.ZIP_DEFLATED)
    return buf.getvalue()


def tracked(a: list[str], b: list[str], result: dict) -> bytes:
    """The comparison of two versions (see operators.compare) as a document with tracked changes."""
    words = {c["id"]: c["words"] for c in result["changes"]}
    out: list[list[tuple[int, str]]] = []
    for r in result["rows"]:
        if r["kind"] == "modificado":
            out.append([tuple(w.values()) if isinstance(w, dict) else w for w in words[r["change_id"]]])
        elif r["kind"] == "eliminado":
            out.append([(-1, a[r["a"]])])
        elif r["kind"] in ("anadido", "movido"):
            out.append([(1, b[r["b"]])])
        else:
            out.append([(0, b[r["b"]])])
    return build(out)


def accepted(data: bytes, new: bool = True) -> list[str]:
    """Paragraphs with all changes accepted, or rejected."""
    xml = read(data).parts["word/document.xml"]
    gone, kept = ("w:del", "w:ins") if new else ("w:ins", "w:del")
    out = []
    for p in re.findall(r"<w:p>.*?</w:p>", xml, re.S):
        if re.search(rf"<w:pPr><w:rPr><{gone} ", p):
            continue
        p = re.sub(rf"<{gone} [^/>]*>.*?</{gone}>", "", p, flags=re.S)
        out.append("".join(html.unescape(m[3]) for m in _RUN.finditer(p) if m[1]))
    return out


@arrow_function("struct<text:string,error:string>")
def _text(content: pd.Series) -> pd.DataFrame:
    rows = []
    for b in content:
        try:
            rows.append((body_text(bytes(b)), None))
        except (ValueError, TypeError) as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["text", "error"])


@arrow_function("binary")
def _edited(content: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([edited(bytes(b), [(x["start"], x["end"], x["text"]) for x in e]) for b, e in zip(content, edits, strict=True)])


def docx_text(content: Column) -> Column:
    """struct<text, error> of documents' bodies."""
    return _text(content)


def docx_edited(content: Column, edits: Column) -> Column:
    """Documents with spans (start, end, text) of their full text replaced."""
    return _edited(content, edits)
