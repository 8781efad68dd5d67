"""Hidden metadata of images: an inventory of what a file tells besides its picture, and stripping it without touching the picture.

JPEG, PNG and WebP containers are read and rewritten byte by byte; other formats are searched for embedded EXIF and XMP.  Each image is a
row with its bytes; one Arrow call a batch.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow_function

# fixed values: chunks that only say how to draw the image, EXIF tag numbers and IPTC data sets
PNG_KEPT = "IHDR PLTE IDAT IEND tRNS cHRM gAMA iCCP sBIT sRGB cICP mDCV mDCv cLLI cLLi bKGD pHYs acTL fcTL fdAT".split()
WEBP_KEPT = ["VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP"]
TAGS = {"Programa": 0x0131, "Autor": 0x013B, "Derechos de autor": 0x8298}
EXIF_TAGS = {"Propietario de la cámara": 0xA430, "Número de serie de la cámara": 0xA431, "Número de serie del objetivo": 0xA435}
ORIENTATION, MAKE, MODEL, DESCRIPTION, CHANGED = 0x0112, 0x010F, 0x0110, 0x010E, 0x0132
EXIF_IFD, GPS_IFD, TAKEN, DIGITIZED, USER_COMMENT, LENS, THUMBNAIL = 0x8769, 0x8825, 0x9003, 0x9004, 0x9286, 0xA434, 0x0201
PLACE = [92, 90, 95, 101]
THUMB = ("Miniatura escondida", "Sí", True, True)
XMP_MARK = ("Datos de edición (XMP)", "Sí", False, True)


def file_format(b: bytes) -> str:
    if b[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return "webp"
    if b[4:8] == b"ftyp":
        brand = b[8:12]
        return "avif" if brand in (b"avif", b"avis") else "heic" if brand in (b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis", b"mif1", b"msf1") else "otro"
    if b[:4] in (b"GIF8",):
        return "gif"
    if b[:2] == b"BM":
        return "bmp"
    if b[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "pdf" if b[:5] == b"%PDF-" else "otro"


def format_of(content: Column) -> Column:
    """The format by its first bytes, in the JVM."""
    h = F.hex(F.substring(content, 1, 12))
    brand = F.substring(h, 17, 8)
    code = lambda *names: [n.encode().hex().upper() for n in names]
    iso = F.when(brand.isin(code("avif", "avis")), "avif").when(brand.isin(code("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")), "heic").otherwise("otro")
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("52494646") & (brand == "57454250"), "webp").when(F.substring(h, 9, 8) == "66747970", iso)
        .when(h.startswith("47494638"), "gif").when(h.startswith("424D"), "bmp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").when(h.startswith("255044462D"), "pdf").otherwise("otro")
    )


# ---------------------------------------------------------------- containers


def png_chunks(b: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(type, begin, data begin, end) of whole chunks."""
    at = 8
    while at + 12 <= len(b):
        n = int.from_bytes(b[at : at + 4], "big")
        if at + 12 + n > len(b):
            return
        kind = b[at + 4 : at + 8].decode("latin-1")
        yield kind, at, at + 8, at + 12 + n
        at += 12 + n
        if kind == "IEND":
            return


def webp_chunks(b: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(type, begin, data begin, end with padding); an end beyond the file marks a cut file."""
    at = 12
    while at + 8 <= len(b):
        n = int.from_bytes(b[at + 4 : at + 8], "little")
        yield b[at : at + 4].decode("latin-1"), at, at + 8, at + 8 + n + n % 2
        at += 8 + n + n % 2


def jpeg_segments(b: bytes) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """([(marker, begin, data begin, end)], end of the image); None if it isn't whole.  A scan's segment holds its compressed data."""
    if b[:2] != b"\xff\xd8":
        return None
    at, out = 2, []
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        m = b[at + 1]
        if m == 0xFF:
            at += 1
            continue
        if m == 0xD9:
            return out, at + 2
        if m == 0x01 or 0xD0 <= m <= 0xD7:
            out.append((m, at, at + 2, at + 2))
            at += 2
            continue
        end = at + 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        if end > len(b) or end < at + 4:
            return None
        if m == 0xDA:
            while (end := b.find(b"\xff", end)) >= 0 and end + 1 < len(b) and (b[end + 1] == 0 or 0xD0 <= b[end + 1] <= 0xD7 or b[end + 1] == 0xFF):
                end += 1 if b[end + 1] == 0xFF else 2
            if end < 0 or end + 1 >= len(b):
                return None
        out.append((m, at, at + 4, end))
        at = end
    return (out, at + 2) if b[at : at + 2] == b"\xff\xd9" else None


# ---------------------------------------------------------------- fields

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def read_tiff(b: bytes, t0: int) -> dict[str, dict[int, object]]:
    """Tags of the directories 0 and 1, Exif and GPS of a TIFF header at t0."""
    out: dict[str, dict[int, object]] = {"0": {}, "1": {}, "exif": {}, "gps": {}}
    order = "<" if b[t0 : t0 + 2] == b"II" else ">"

    def value(kind: int, n: int, at: int) -> object:
        size = _SIZES.get(kind, 0) * n
        if not size or size > 1 << 20:
            return None
        p = at if size <= 4 else t0 + struct.unpack_from(order + "I", b, at)[0]
        data = b[p : p + size]
        if len(data) < size:
            return None
        if kind == 2:
            return data.split(b"\0")[0].decode("utf-8", "replace")
        if kind in (1, 6, 7):
            return data if kind == 7 or n > 1 else data[0]
        if kind in (5, 10):
            pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * n, data)
            v = [p / q if q else float("nan") for p, q in zip(pairs[::2], pairs[1::2], strict=True)]
            return v if n > 1 else v[0]
        v = list(struct.unpack(order + {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}[kind] * n, data))
        return v if n > 1 else v[0]

    def directory(name: str, at: int) -> int:
        if at < t0 + 8 or at + 2 > len(b):
            return 0
        n = struct.unpack_from(order + "H", b, at)[0]
        for k in range(min(n, 512)):
            p = at + 2 + 12 * k
            if p + 12 > len(b):
                return 0
            tag, kind, count = struct.unpack_from(order + "HHI", b, p)
            if (v := value(kind, count, p + 8)) is not None:
                out[name][tag] = v
        end = at + 2 + 12 * n
        return struct.unpack_from(order + "I", b, end)[0] if end + 4 <= len(b) else 0

    try:
        follows = directory("0", t0 + struct.unpack_from(order + "I", b, t0 + 4)[0])
        if follows:
            directory("1", t0 + follows)
        for name, tag in (("exif", EXIF_IFD), ("gps", GPS_IFD)):
            if isinstance(p := out["0"].get(tag), int):
                directory(name, t0 + p)
    except struct.error:
        pass
    return out


@dataclass
class Inventory:
    format: str = "otro"
    fields: list[tuple[str, str, bool]] = field(default_factory=list)
    gps: tuple[float, float] | None = None
    orientation: int = 1
    alpha: bool = False
    lossless: bool = False
    others: list[str] = field(default_factory=list)

    def add(self, label: str, value: object, delicate: bool = False, once: bool = False) -> None:
        v = re.sub(r"[\x00-\x1f\s]+", " ", str(value or "")).strip()
        if v and not any(f[0] == label and (once or f[1] == v) for f in self.fields):
            self.fields.append((label, v, delicate))

    def place(self, lat: float | None, lon: float | None) -> None:
        if self.gps or lat is None or lon is None or (lat == 0 and lon == 0) or abs(lat) > 90 or abs(lon) > 180:
            return
        self.gps = (lat, lon)
        shown = lambda x, pos, neg: f"{abs(x):.4f}".replace(".", ",") + "° " + (pos if x >= 0 else neg)
        self.fields.insert(0, ("Ubicación exacta (GPS)", f"{shown(lat, 'N', 'S')}, {shown(lon, 'E', 'O')}", True))


def degrees(v: object, ref: object) -> float | None:
    if not isinstance(v, list) or len(v) < 3 or any(x != x for x in v):
        return None
    d = v[0] + v[1] / 60 + v[2] / 3600
    return -d if ref in ("S", "W") else d


def shown_date(s: object) -> object:
    m = re.match(r"(\d{4})[:-](\d{2})[:-](\d{2})(?:[ T](\d{2}):(\d{2}))?", str(s or ""))
    return f"{m[3]}/{m[2]}/{m[1]}" + (f", {m[4]}:{m[5]}" if m[4] else "") if m else s


def _short(s: str, n: int) -> str:
    s = " ".join(s.split())
    return s if len(s) <= n else s[: n - 1].rstrip() + "…"


def _is_tiff(b: bytes, at: int) -> bool:
    return b[at : at + 4] in (b"II*\0", b"MM\0*")


def _from_tiff(b: bytes, t0: int, r: Inventory) -> None:
    t = read_tiff(b, t0)
    zero, exif, gps = t["0"], t["exif"], t["gps"]
    before = len(r.fields)
    r.place(degrees(gps.get(2), gps.get(1)), degrees(gps.get(4), gps.get(3)))
    r.add("Fecha en que se hizo", shown_date(exif.get(TAKEN) or exif.get(DIGITIZED) or zero.get(CHANGED)), True, True)
    make, model = (str(zero.get(k) or "").strip() for k in (MAKE, MODEL))
    r.add("Móvil o cámara", model if model.lower().startswith(make.lower()) else f"{make} {model}", False, True)
    for label, tag in TAGS.items():
        r.add(label, zero.get(tag), label != "Programa", label == "Programa")
    for label, tag in EXIF_TAGS.items():
        r.add(label, exif.get(tag), True)
    if isinstance(d := zero.get(DESCRIPTION), str):
        r.add("Descripción", _short(d, 140), True)
    if isinstance(c := exif.get(USER_COMMENT), bytes) and len(c) > 8:
        r.add("Comentario", _short(c[8:].decode("utf-8", "replace"), 140), True)
    r.add("Objetivo", exif.get(LENS))
    if t["1"].get(THUMBNAIL):
        r.add(*THUMB)
    if isinstance(o := zero.get(ORIENTATION), int) and 1 <= o <= 8:
        r.orientation = o
    # an EXIF block with nothing but the orientation, as stripping leaves it, tells nothing
    if len(r.fields) == before and (exif or gps or t["1"] or any(k != ORIENTATION for k in zero)):
        r.add("Datos técnicos de la foto (EXIF)", "Sí")


def _xmp_value(x: str, name: str) -> str:
    import html

    if (m := re.search(rf"\s{re.escape(name)}=\"([^\"]*)\"", x)) and m[1].strip():
        return html.unescape(m[1])
    if not (m := re.search(rf"<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>", x, re.S)):
        return ""
    li = re.search(r"<rdf:li[^>]*>(.*?)</rdf:li>", m[1], re.S)
    return html.unescape(re.sub("<[^>]+>", " ", li[1] if li else m[1]))


def _xmp_degrees(s: str) -> float | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?),(\d+(?:\.\d+)?)(?:,(\d+(?:\.\d+)?))?([NSEW])", s.strip())
    if not m:
        return None
    d = float(m[1]) + float(m[2]) / 60 + float(m[3] or 0) / 3600
    return -d if m[4] in "SW" else d


def _from_xmp(x: str, r: Inventory) -> None:
    v = lambda n: _xmp_value(x, n)
    r.place(_xmp_degrees(v("exif:GPSLatitude")), _xmp_degrees(v("exif:GPSLongitude")))
    r.add("Autor", v("dc:creator"), True)
    r.add("Derechos de autor", v("dc:rights"), True)
    r.add("Lugar", ", ".join(dict.fromkeys(s for n in ("Iptc4xmpCore:Location", "photoshop:City", "photoshop:State", "photoshop:Country") if (s := v(n).strip()))), True)
    r.add("Descripción", _short(v("dc:description"), 140), True)
    r.add("Título", _short(v("dc:title"), 100))
    r.add("Fecha en que se hizo", shown_date(v("photoshop:DateCreated") or v("exif:DateTimeOriginal") or v("xmp:CreateDate")), True, True)
    r.add("Programa", v("xmp:CreatorTool"), False, True)
    r.add(*XMP_MARK)


def _find_xmp(b: bytes, r: Inventory, end: int) -> None:
    i = b.find(b"<x:xmpmeta", 0, end)
    if i < 0:
        if b.find(b"http://ns.adobe.com/xap/1.0/", 0, end) >= 0:
            r.add(*XMP_MARK)
        return
    f = b.find(b"</x:xmpmeta>", i, end)
    _from_xmp(b[i : f if f >= 0 else i + 262_144].decode("utf-8", "replace"), r)


def _from_photoshop(b: bytes, at: int, end: int, r: Inventory) -> None:
    while at + 12 <= end and b[at : at + 4] == b"8BIM":
        kind = int.from_bytes(b[at + 4 : at + 6], "big")
        p = at + 6 + ((b[at + 6] + 2) & ~1)
        n = int.from_bytes(b[p : p + 4], "big")
        p += 4
        if p + n > end:
            return
        if kind == 0x0404:
            sets: dict[int, list[str]] = {}
            i = p
            while i + 5 <= p + n and b[i] == 0x1C:
                size = int.from_bytes(b[i + 3 : i + 5], "big")
                if size & 0x8000:
                    break
                if b[i + 1] == 2:
                    sets.setdefault(b[i + 2], []).append(b[i + 5 : i + 5 + size].decode("utf-8", "replace").strip())
                i += 5 + size
            one = lambda k: sets.get(k, [""])[0]  # noqa: E731, B023
            r.add("Autor", one(80), True)
            r.add("Derechos de autor", one(116), True)
            r.add("Lugar", ", ".join(dict.fromkeys(filter(None, map(one, PLACE)))), True)
            r.add("Descripción", _short(one(120), 140), True)
            r.add("Título", one(5))
            r.add("Palabras clave", _short(", ".join(sets.get(25, [])), 100))
            if sets:
                r.add("Datos de agencia o de edición (IPTC)", "Sí", False, True)
        elif kind in (0x0409, 0x040C):
            r.add(*THUMB)
        at = p + n + n % 2


def _tail(b: bytes, at: int, r: Inventory) -> None:
    rest = b[at:]
    if not rest.strip(b"\0"):
        return
    if re.search(rb"ftyp[A-Za-z0-9 ]{4}", rest):
        r.add("Vídeo escondido en la foto", "Sí", True, True)
    elif b"\xff\xd8\xff" in rest:
        r.add("Otras imágenes dentro del archivo", "Sí", False, True)
    else:
        r.add("Datos pegados al final del archivo", "Sí", False, True)


def _jpeg(b: bytes, r: Inventory) -> None:
    got = jpeg_segments(b)
    if not got:
        _any(b, r)
        return
    r.lossless = True
    seen = False
    for m, _, p, e in got[0]:
        d = b[p:e]
        if m == 0xE1 and d[:6] == b"Exif\0\0" and _is_tiff(d, 6):
            if not seen:
                _from_tiff(b, p + 6, r)
            seen = True
        elif m == 0xED and d[:14] == b"Photoshop 3.0\0":
            _from_photoshop(b, p + 14, e, r)
        elif m == 0xFE:
            r.add("Comentario", _short(d.decode("utf-8", "replace"), 140), True)
        elif m == 0xE0:
            if (d[:5] == b"JFIF\0" and len(d) > 13 and (d[12] or d[13])) or d[:5] == b"JFXX\0":
                r.add(*THUMB)
            elif d[:5] != b"JFIF\0":
                r.others.append("APP0")
        elif m == 0xEB and d[:2] == b"JP":
            r.add("Credenciales de contenido (C2PA)", "Sí", False, True)
        elif m == 0xE2 and (d[:12] == b"ICC_PROFILE\0" or d[:4] == b"MPF\0") or m == 0xEE and d[:5] == b"Adobe" or m == 0xE1:
            continue
        elif 0xE2 <= m <= 0xEF:
            r.others.append(f"APP{m - 0xE0}")
    scan = next((s for m, s, _, _ in got[0] if m == 0xDA), got[1])
    _find_xmp(b, r, scan)
    _tail(b, got[1], r)


def _png(b: bytes, r: Inventory) -> None:
    for kind, _, p, e in png_chunks(b):
        d = b[p : e - 4]
        if kind == "IHDR":
            r.alpha = len(d) > 9 and d[9] in (4, 6)
        elif kind == "tRNS":
            r.alpha = True
        elif kind == "IEND":
            r.lossless = True
        elif kind == "eXIf" and _is_tiff(d, 0):
            _from_tiff(b, p, r)
        elif kind in ("tEXt", "iTXt", "zTXt"):
            name, _, rest = d.partition(b"\0")
            key, value = name.decode("latin-1").strip(), ""
            if kind == "tEXt":
                value = rest.decode("latin-1")
            elif kind == "iTXt" and rest[:1] == b"\0":
                value = rest[2:].split(b"\0", 2)[-1].decode("utf-8", "replace")
            if key == "XML:com.adobe.xmp":
                _from_xmp(value, r) if "<x:xmpmeta" in value else r.add(*XMP_MARK)
            elif re.fullmatch("Raw profile type (exif|APP1)", key, re.I):
                r.add("Datos de la cámara guardados como texto (EXIF)", "Sí", True, True)
            elif key.lower().startswith("raw profile type "):
                r.add("Datos de agencia o de edición (IPTC)", "Sí", False, True)
            elif key:
                delicate = key.lower() in ("author", "copyright", "comment", "description", "title", "source", "disclaimer", "location")
                r.add("Texto guardado en el PNG", f"{key}: {_short(value, 100)}" if value.strip() else key, delicate)
        elif kind == "tIME":
            r.add("Fecha de modificación (PNG)", f"{d[3]:02}/{d[2]:02}/{int.from_bytes(d[:2], 'big')}, {d[4]:02}:{d[5]:02}" if len(d) == 7 else "Sí")
        elif kind == "caBX":
            r.add("Credenciales de contenido (C2PA)", "Sí", False, True)
        elif kind not in PNG_KEPT and kind != "eXIf":
            r.others.append(kind)


def _webp(b: bytes, r: Inventory) -> None:
    r.lossless = True
    for kind, _, p, e in webp_chunks(b):
        if e > len(b):
            r.lossless = False
            return
        d = b[p:e]
        if kind == "VP8X":
            r.alpha |= bool(d[0] & 0x10)
        elif kind == "ALPH":
            r.alpha = True
        elif kind == "VP8L":
            r.alpha |= len(d) > 4 and bool(d[4] & 0x10)
        elif kind == "EXIF":
            t0 = p + 6 if d[:6] == b"Exif\0\0" else p
            if _is_tiff(b, t0):
                _from_tiff(b, t0, r)
        elif kind == "XMP ":
            x = d.decode("utf-8", "replace")
            _from_xmp(x, r) if "<x:xmpmeta" in x else r.add(*XMP_MARK)
        elif kind not in WEBP_KEPT:
            r.others.append(kind.strip())


def _any(b: bytes, r: Inventory) -> None:
    at = b.find(b"Exif\0\0")
    while at >= 0 and not _is_tiff(b, at + 6):
        at = b.find(b"Exif\0\0", at + 1)
    if at >= 0 or _is_tiff(b, 0):
        _from_tiff(b, at + 6 if at >= 0 else 0, r)
    _find_xmp(b, r, len(b))


def inventory(b: bytes) -> Inventory:
    r = Inventory(file_format(b))
    {"jpeg": _jpeg, "png": _png, "webp": _webp}.get(r.format, _any)(b, r)
    if r.others:
        r.add("Otros datos del programa o de la cámara", ", ".join(dict.fromkeys(r.others)))
    return r


# ---------------------------------------------------------------- stripping


def orientation_tiff(o: int) -> bytes:
    return b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", ORIENTATION, 3, 1, o, 0) + b"\0\0\0\0"


def strip(b: bytes) -> bytes | None:
    """The same picture without metadata; its orientation and colour profile stay.  None if it would have to be encoded anew."""
    r = inventory(b)
    if not r.lossless:
        return None
    turn = orientation_tiff(r.orientation) if 1 < r.orientation <= 8 else b""
    if r.format == "jpeg":
        jfif, colour, rest = b"", [], []
        for m, s, p, e in jpeg_segments(b)[0]:
            d = b[p:e]
            if m == 0xE0:
                if d[:5] == b"JFIF\0" and len(d) >= 12 and not jfif:
                    jfif = b"\xff\xe0\0\x10" + d[:12] + b"\0\0"
            elif m == 0xE2 and d[:12] == b"ICC_PROFILE\0" or m == 0xEE and d[:5] == b"Adobe":
                colour.append(b[s:e])
            elif not (0xE1 <= m <= 0xEF) and m != 0xFE:
                rest.append(b[s:e])
        exif = b"\xff\xe1" + struct.pack(">H", 8 + len(turn)) + b"Exif\0\0" + turn if turn else b""
        return b"\xff\xd8" + jfif + exif + b"".join(colour + rest) + b"\xff\xd9"
    if r.format == "png":
        out = [b[:8]]
        for kind, s, _, e in png_chunks(b):
            if kind in PNG_KEPT:
                out.append(b[s:e])
            if kind == "IHDR" and turn:
                out.append(struct.pack(">I", len(turn)) + b"eXIf" + turn + struct.pack(">I", zlib.crc32(b"eXIf" + turn)))
        return b"".join(out)
    parts = []
    for kind, s, _, e in webp_chunks(b):
        if kind in WEBP_KEPT:
            c = bytearray(b[s:e])
            if kind == "VP8X":
                c[8] = c[8] & ~0x0C | (0x08 if turn else 0)
            parts.append(bytes(c))
    if turn:
        parts.append(b"EXIF" + struct.pack("<I", len(turn)) + turn)
    body = b"WEBP" + b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


METADATA = "struct<format:string,fields:array<struct<label:string,value:string,delicate:boolean>>,lat:double,lon:double,orientation:int,alpha:boolean,lossless:boolean,any:boolean>"


@arrow_function(METADATA)
def _metadata(content: pd.Series) -> pd.DataFrame:
    rows = []
    for b in content:
        r = inventory(bytes(b or b""))
        rows.append((r.format, [dict(zip(("label", "value", "delicate"), f, strict=True)) for f in r.fields], *(r.gps or (None, None)), r.orientation, r.alpha, r.lossless, bool(r.fields)))
    out = pd.DataFrame(rows, columns=["format", "fields", "lat", "lon", "orientation", "alpha", "lossless", "any"])
    return out.astype({"lat": "float64", "lon": "float64"})


@arrow_function("binary")
def _stripped(content: pd.Series) -> pd.Series:
    return content.map(lambda b: strip(bytes(b)) if b is not None else None)


def metadata(content: Column) -> Column:
    return _metadata(content)


def stripped(images: DataFrame, content: str = "content") -> DataFrame:
    """Images with ``clean`` and ``status``: clean, nothing to remove, damaged, format (to be encoded anew), or left (something stayed)."""
    df = images.withColumn("_m", _metadata(F.col(content))).withColumn("clean", _stripped(F.col(content)))
    left = _metadata(F.col("clean"))
    df = df.withColumn("_left", F.when(F.col("clean").isNotNull(), left))
    known = F.col("_m.format").isin("jpeg", "png", "webp")
    status = F.when(F.col("clean").isNull(), F.when(known, "damaged").otherwise("format")).when(F.col("_left.any"), "left").when(~F.col("_m.any"), "nothing to remove").otherwise("clean")
    return df.withColumn("status", status).drop("_m", "_left")
