"""What needs codecs that are not here: protocols to plug a PDF reader, an OCR engine or a renderer in.

Without one, asking for it raises ``NotAvailable``; nothing is made up.
"""

from __future__ import annotations

from typing import Protocol


class NotAvailable(RuntimeError):
    """The codec for this is not installed."""


class PageExtractor(Protocol):
    """Bytes of a document to pages: dicts with page_no, text, items, fields, draws_image."""

    def pages(self, content: bytes) -> list[dict]: ...


class OcrReader(Protocol):
    """An image to words: dicts with text, x, y, w, h, confidence."""

    def words(self, image: bytes) -> list[dict]: ...


class Renderer(Protocol):
    """Pages with rectangles to the bytes of a redacted document."""

    def redact(self, content: bytes, rects: dict[int, list[tuple[float, float, float, float]]]) -> bytes: ...


class CardFinder(Protocol):
    """Quadrilaterals of cards in a photo, with their edge support."""

    def candidates(self, image: bytes) -> list[dict]: ...


_plugged: dict[str, object] = {}


def plug(kind: str, adapter: object) -> None:
    if kind not in ("pages", "ocr", "render", "cards"):
        raise ValueError(f"unknown kind of adapter {kind!r}")
    _plugged[kind] = adapter


def plugged(kind: str) -> object:
    if kind not in _plugged:
        raise NotAvailable(f"no adapter for {kind!r}; plug one in with docveil.adapters.plug")
    return _plugged[kind]
