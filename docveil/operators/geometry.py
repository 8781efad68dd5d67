"""Geometry of redaction and of cards: rectangles, the test for text that is there but not seen, quadrilaterals.

Rectangles are structs ``(x, y, w, h)``, quadrilaterals arrays of four points ``(x, y)``, top left first and clockwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.udf import arrow_function

RECT = "struct<x:double,y:double,w:double,h:double>"
QUAD = "array<struct<x:double,y:double>>"
#: Letters below this size in points can't be read.
SMALLEST = 3.0


def inflated(r: Column, margin: float, size: Column | None = None) -> Column:
    s = r["h"] if size is None else F.coalesce(size, r["h"])
    mx, my = F.least(F.lit(margin), F.greatest(F.lit(0.4), s * 0.12)), F.least(F.lit(margin), s * 0.04)
    return F.struct((r["x"] - mx).alias("x"), (r["y"] - my).alias("y"), (r["w"] + mx * 2).alias("w"), (r["h"] + my * 2).alias("h"))


def united(rects: Column) -> Column:
    """Neighbouring rectangles of one line (within 3 up or down and 6 across) as one, in reading order."""
    ordered = F.transform(F.sort_array(F.transform(rects, lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["w"].alias("w"), r["h"].alias("h")))), lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")))
    none = F.expr(f"cast(array() as array<{RECT}>)")

    def step(out: Column, r: Column) -> Column:
        p = F.get(out, F.size(out) - 1)
        near = F.coalesce((F.abs(p["y"] - r["y"]) < 3) & (r["x"] - (p["x"] + p["w"]) < 6), F.lit(False))
        left = F.least(p["x"], r["x"])
        both = F.struct(left.alias("x"), p["y"].alias("y"), (F.greatest(p["x"] + p["w"], r["x"] + r["w"]) - left).alias("w"), F.greatest(p["h"], r["h"]).alias("h"))
        return F.when(near, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(ordered, none, step)


def span_rects(text: Column, items: Column, start: Column, end: Column, margin: float = 2.0) -> Column:
    """Rectangles that cover a span of a text of placed words ``(start, end, rect)``.

    A word's part is measured by letters.  What is left of a word is covered too if it is signs only; a cut between letters is
    widened by half a letter.
    """
    hit = F.filter(items, lambda e: e["rect"].isNotNull() & (e["end"] > start) & (e["start"] < end) & (e["end"] > e["start"]))
    letter = "[0-9A-Za-zÀ-ÿ]"

    def part(e: Column) -> Column:
        n = e["end"] - e["start"]
        word = F.substring(text, e["start"] + 1, n)
        lo, hi = F.greatest(F.lit(0), start - e["start"]), F.least(n, end - e["start"])
        lo = F.when((lo > 0) & ~F.substring(word, F.lit(1), lo).rlike(letter), 0).otherwise(lo)
        hi = F.when((hi < n) & ~F.substring(word, hi + 1, n).rlike(letter), n).otherwise(hi)
        a = F.when(lo > 0, F.greatest(F.lit(0.0), lo - 0.5)).otherwise(F.lit(0.0))
        b = F.when(hi < n, F.least(n.cast("double"), hi + 0.5)).otherwise(n.cast("double"))
        r = e["rect"]
        return F.struct((r["x"] + a / n * r["w"]).alias("x"), r["y"].alias("y"), ((b - a) / n * r["w"]).alias("w"), r["h"].alias("h"))

    rects = F.filter(F.transform(hit, part), lambda r: (r["w"] > 0) & (r["h"] > 0))
    return united(F.transform(rects, lambda r: inflated(r, margin)))


def hidden_reason(low: Column, high: Column, mean: Column, size: Column) -> Column:
    """Why text is not seen, by the least, largest and mean sum of channels in its middle band; null if it is."""
    return F.when((size > 0) & (size < SMALLEST), "diminuto").when(high - low >= 120, F.lit(None)).when(mean < 300, "tapado").when(mean.isNotNull(), "invisible")


def band(pixels: bytes, width: int, height: int, rect: tuple[float, float, float, float], row: int | None = None, start: int = 0) -> tuple[float, float, float] | None:
    """(least, largest, mean) of red + green + blue in the middle of a rectangle of an image of four bytes a pixel; None if it is too small."""
    x, y, w, h = rect
    half_up = lambda v: math.floor(v + 0.5)
    x0, x1 = max(0, half_up(x + w * 0.12)), min(width, half_up(x + w * 0.88))
    y0, y1 = max(0, half_up(y + h * 0.3)), min(height, half_up(y + h * 0.7))
    if x1 - x0 < 3 or y1 - y0 < 1:
        return None
    row = row or width * 4
    a = np.frombuffer(pixels, np.uint8)
    sums = np.stack([a[start + k * row + x0 * 4 : start + k * row + x1 * 4].reshape(-1, 4)[:, :3].sum(1, dtype=np.int64) for k in range(y0, y1)])
    return float(sums.min()), float(sums.max()), float(sums.mean())


@arrow_function("struct<low:double,high:double,mean:double>")
def band_of(pixels: pd.Series, width: pd.Series, height: pd.Series, rect: pd.DataFrame) -> pd.DataFrame:
    got = [band(p, int(w), int(h), (r.x, r.y, r.w, r.h)) or (None, None, None) for p, w, h, r in zip(pixels, width, height, rect.itertuples(), strict=True)]
    return pd.DataFrame(got, columns=["low", "high", "mean"], dtype="float64")


# ---------------------------------------------------------------- quadrilaterals


def _edge(q: Column, i: int) -> tuple[Column, Column]:
    return F.get(q, F.lit(i % 4)), F.get(q, F.lit((i + 1) % 4))


def quad_area(q: Column) -> Column:
    return F.abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in (_edge(q, i) for i in range(4)))) / 2


def side(q: Column, i: int) -> Column:
    a, b = _edge(q, i)
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def ordered_quad(q: Column) -> Column:
    """Corners clockwise around their centre, from the one nearest the top left."""
    cx = F.aggregate(q, F.lit(0.0), lambda acc, p: acc + p["x"] / 4)
    cy = F.aggregate(q, F.lit(0.0), lambda acc, p: acc + p["y"] / 4)
    turned = F.transform(F.sort_array(F.transform(q, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("t"), p.alias("p")))), lambda s: s["p"])
    first = F.array_position(F.transform(turned, lambda p: p["x"] + p["y"]), F.array_min(F.transform(turned, lambda p: p["x"] + p["y"]))).cast("int")
    return F.concat(F.slice(turned, first, F.lit(4)), F.slice(turned, F.lit(1), first - 1))


def is_convex(q: Column) -> Column:
    def turn(i: int) -> Column:
        a, b = _edge(q, i)
        c = F.get(q, F.lit((i + 2) % 4))
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    t = [turn(i) for i in range(4)]
    return (F.least(*t) >= 1e-6) | (F.greatest(*t) <= -1e-6)


def angles(q: Column) -> Column:
    def at(i: int) -> Column:
        p, c, n = (F.get(q, F.lit((i + k) % 4)) for k in (3, 0, 1))
        d = F.abs(F.atan2(p["y"] - c["y"], p["x"] - c["x"]) - F.atan2(n["y"] - c["y"], n["x"] - c["x"])) * (180 / math.pi)
        return F.when(d > 180, 360 - d).otherwise(d)

    return F.array(*[at(i) for i in range(4)])


def quad_score(q: Column, support: Column, width: Column, height: Column, ratio: float = 85.6 / 53.98) -> Column:
    """A candidate's mark: how well its sides lie on edges (``support``, four shares), its shape, size and place; null if it can't be a card."""
    area = quad_area(q) / (width * height)
    ang = angles(q)
    l1, l2 = (side(q, 0) + side(q, 2)) / 2, (side(q, 1) + side(q, 3)) / 2
    r = F.greatest(l1, l2) / F.greatest(F.lit(1.0), F.least(l1, l2))
    mean = F.aggregate(support, F.lit(0.0), lambda acc, v: acc + v / 4)
    right = 1 - F.aggregate(ang, F.lit(0.0), lambda acc, a: acc + F.abs(a - 90)) / 140
    m = F.least(width, height) * 0.01
    touching = F.size(F.filter(q, lambda p: (p["x"] <= m) | (p["y"] <= m) | (p["x"] >= width - m) | (p["y"] >= height - m)))
    mark = mean * 0.45 + F.array_min(support) * 0.15 + F.exp(-F.pow((r - ratio) / 0.18, 2)) * 0.25 + right * 0.05 + F.least(F.lit(1.0), area / 0.3) * 0.1 - F.when(touching >= 2, 0.15).otherwise(0.0)
    ok = is_convex(q) & area.between(0.06, 0.995) & (F.array_min(ang) >= 55) & (F.array_max(ang) <= 125)
    return F.when(ok, mark)


def confidence(score: Column, worst: Column, agreed: Column) -> Column:
    """alta, media or baja by mark and weakest side; one less if no second method agrees."""
    level = F.when((score >= 0.72) & (worst >= 0.45), 3).when(score >= 0.6, 2).otherwise(1)
    level = F.greatest(level - F.when(agreed, 0).otherwise(1), F.lit(1))
    return F.when(level == 3, "alta").when(level == 2, "media").otherwise("baja")


def edge_support(gx: np.ndarray, gy: np.ndarray, q: list[tuple[float, float]], least: float) -> list[float]:
    """Share of 41 points along each side that have a gradient across the side within two pixels."""
    h, w = gx.shape
    out = []
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1], strict=True):
        n = math.hypot(bx - ax, by - ay) or 1.0
        nx, ny = -(by - ay) / n, (bx - ax) / n
        t = 0.1 + 0.8 * np.arange(41) / 40
        px, py = ax + (bx - ax) * t, ay + (by - ay) * t
        inside = (px >= 1) & (py >= 1) & (px < w - 1) & (py < h - 1)
        s = np.arange(-2, 3)
        x = np.floor(px[inside, None] + nx * s + 0.5).astype(int)
        y = np.floor(py[inside, None] + ny * s + 0.5).astype(int)
        ok = (x >= 0) & (y >= 0) & (x < w) & (y < h)
        vx, vy = gx[y.clip(0, h - 1), x.clip(0, w - 1)], gy[y.clip(0, h - 1), x.clip(0, w - 1)]
        m = np.hypot(vx, vy)
        hits = (ok & (m > least) & (np.abs(vx * nx + vy * ny) > 0.85 * m)).any(1)
        out.append(float(hits.mean()) if inside.any() else 0.0)
    return out


def overlap_ratio(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Common area of two convex quadrilaterals as a share of the smaller one."""
    area = lambda p: sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True)) / 2
    way = 1 if area(b) >= 0 else -1
    poly = list(a)
    for (px, py), (qx, qy) in zip(b, b[1:] + b[:1], strict=True):
        dist = [way * ((qx - px) * (y - py) - (qy - py) * (x - px)) for x, y in poly]
        out = []
        for k, (c, d) in enumerate(zip(poly, poly[1:] + poly[:1], strict=True)):
            dc, dd = dist[k], dist[(k + 1) % len(poly)]
            if dc >= 0:
                out.append(c)
            if (dc >= 0) != (dd >= 0):
                t = dc / (dc - dd)
                out.append((c[0] + (d[0] - c[0]) * t, c[1] + (d[1] - c[1]) * t))
        poly = out
        if not poly:
            return 0.0
    return abs(area(poly)) / max(1e-9, min(abs(area(a)), abs(area(b)))) if len(poly) > 2 else 0.0


@arrow_function("double")
def quad_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    pts = lambda q: [(p["x"], p["y"]) for p in q]
    return pd.Series([overlap_ratio(pts(x), pts(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """An image array turned by its EXIF orientation, 1 to 8."""
    if orientation in (2, 3, 4):
        return {2: pixels[:, ::-1], 3: pixels[::-1, ::-1], 4: pixels[::-1]}[orientation]
    if orientation in (5, 6, 7, 8):
        t = pixels.swapaxes(0, 1)
        return {5: t, 6: t[:, ::-1], 7: t[::-1, ::-1], 8: t[::-1]}[orientation]
    return pixels


def reduced(pixels: np.ndarray, longest: int) -> np.ndarray:
    """Area-weighted reduction so that the longer side has at most this many pixels."""
    h, w = pixels.shape[:2]
    k = max(h, w) / longest
    if k <= 1:
        return pixels

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        for i in range(m):
            lo, hi = i * n / m, (i + 1) * n / m
            for j in range(int(lo), min(n, math.ceil(hi))):
                out[i, j] = min(hi, j + 1) - max(lo, j)
        return out / out.sum(1, keepdims=True)

    r, c = weights(h, max(1, round(h / k))), weights(w, max(1, round(w / k)))
    return np.rint(np.einsum("ih,hwk,jw->ijk", r, pixels.astype(float), c)).astype(np.uint8)


def blacked(pixels: np.ndarray, rects: list[tuple[float, float, float, float]]) -> np.ndarray:
    out = pixels.copy()
    for x, y, w, h in rects:
        out[max(0, math.floor(y)) : max(0, math.ceil(y + h)), max(0, math.floor(x)) : max(0, math.ceil(x + w)), :3] = 0
    return out


def pixelated(pixels: np.ndarray, rect: tuple[int, int, int, int], cell: int) -> np.ndarray:
    out = pixels.copy()
    x, y, w, h = rect
    for i in range(y, y + h, cell):
        for j in range(x, x + w, cell):
            block = out[i : min(i + cell, y + h), j : min(j + cell, x + w)]
            if block.size:
                block[...] = block.reshape(-1, block.shape[-1]).mean(0).round().astype(np.uint8)
    return out
