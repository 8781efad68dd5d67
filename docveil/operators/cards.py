"""Cards in photographs: four-cornered candidates from line segments, agreement of methods, the choice of several cards, and their sides refined.

Everything is keyed by picture (``image_id``) and needs no pixels but for ``edge_points``.  What one picture holds (segments, candidates) is
bounded by the picture; pictures are dealt out, so nothing here grows with their number.  What is made of few columns looks small to the planner
however many pictures there are, so joins by picture ask for a merge: neither side is held whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import arrow_function
from .geometry import confidence, ordered_quad, quad_area, quad_overlap

# fixed values: when two lines are one or near-parallel (radians, shares of the shorter side), how many lines count
SAME_ANGLE, SAME_PLACE, PARALLEL, OUTSIDE, LINES = 0.05, 0.015, 0.35, 0.03, 14
# fixed values: how near another method comes and how much worse it may be; further cards: mark, size against the first, common area
AGREE, WORSE, LEAST_MARK, SIZES, COMMON = 0.015, 0.25, 0.6, (0.6, 1.65), 0.1
# fixed values: a picture that is the document itself; points a side needs, and how far a corner may move
WHOLE_MARK, WHOLE_RATIO, LEAST_POINTS, MOVE = 0.55, 0.06, 10, 0.08
CARD = 85.6 / 53.98


def _between(a: Column, b: Column) -> Column:
    d = F.abs(a["theta"] - b["theta"])
    return F.least(d, math.pi - d)


def _one_line(a: Column, b: Column, near: Column) -> Column:
    """Directions are of half a turn: across its end the distance changes its sign."""
    d = F.abs(a["theta"] - b["theta"])
    rho = F.when(d > math.pi - d, -b["rho"]).otherwise(b["rho"])
    return (_between(a, b) < SAME_ANGLE) & (F.abs(a["rho"] - rho) < near)


def longest_lines(segments: DataFrame) -> DataFrame:
    """(image_id, width, height, lines): a picture's segments (image_id, width, height, seq, x1, y1, x2, y2) as lines, the longest first.

    Segments join the first line, by ``seq``, that they nearly lie on, and add their length to it.  Segments with a null, and points, are left out.
    """
    s = segments.dropna(subset=["x1", "y1", "x2", "y2"]).where("x1 <> x2 or y1 <> y2")
    turned = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    s = s.withColumn("theta", F.when(turned < 0, turned + math.pi).when(turned >= math.pi, turned - math.pi).otherwise(turned))
    rho = F.col("y1") * F.cos("theta") - F.col("x1") * F.sin("theta")
    line = F.struct("seq", "theta", rho.alias("rho"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"))
    near = F.least("width", "height") * SAME_PLACE
    none = F.expr("cast(array() as array<struct<seq:bigint,theta:double,rho:double,length:double>>)")

    def longer(known: Column, new: Column, at: Column) -> Column:
        return F.transform(known, lambda k, i: F.when(i == at, F.struct(k["seq"].alias("seq"), k["theta"].alias("theta"), k["rho"].alias("rho"), (k["length"] + new["length"]).alias("length"))).otherwise(k))

    def step(known: Column, new: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(known, lambda k: _one_line(k, new, near)), True), F.lit(0))
        return F.when(at > 0, longer(known, new, at - 1)).otherwise(F.concat(known, F.array(new)))

    own = s.select("image_id", "width", "height", line.alias("line")).groupBy("image_id", "width", "height").agg(F.sort_array(F.collect_list("line")).alias("all"))
    typed = F.transform("all", lambda x: F.struct(x["seq"].cast("long").alias("seq"), x["theta"].alias("theta"), x["rho"].alias("rho"), x["length"].alias("length")))
    merged = own.withColumn("all", F.aggregate(typed, none, step))
    ranked = F.sort_array(F.transform("all", lambda x: F.struct((-x["length"]).alias("_l"), x["seq"].alias("seq"), x.alias("x"))))
    return merged.select("image_id", "width", "height", F.slice(F.transform(ranked, lambda r: r["x"]), 1, LINES).alias("lines"))


def _crossing(a: Column, b: Column) -> Column:
    """Where two lines meet; null where they don't."""
    nx, ny, mx, my = -F.sin(a["theta"]), F.cos(a["theta"]), -F.sin(b["theta"]), F.cos(b["theta"])
    det = nx * my - ny * mx
    return F.when(F.abs(det) >= 1e-6, F.struct(((a["rho"] * my - ny * b["rho"]) / det).alias("x"), ((nx * b["rho"] - a["rho"] * mx) / det).alias("y")))


def line_quads(lines: DataFrame) -> DataFrame:
    """(image_id, width, height, q): where two near-parallel lines of ``longest_lines`` cross two others, once each, corners within the picture."""
    pairs = F.flatten(F.transform("lines", lambda a, i: F.transform(F.slice("lines", i + 2, F.size("lines")), lambda b, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), a.alias("a"), b.alias("b")))))
    paired = lines.select("image_id", "width", "height", F.filter(pairs, lambda p: _between(p["a"], p["b"]) < PARALLEL).alias("pairs"))
    both = paired.select("*", F.explode("pairs").alias("p")).select("image_id", "width", "height", "p", F.explode("pairs").alias("r"))
    p, r = F.col("p"), F.col("r")
    # one pair is the earlier one; near-parallel lines are within it, so the other's first line is none of its own
    both = both.where((p["i"] < r["i"]) & (p["j"] != r["i"]) & (p["j"] != r["j"]) & (_between(p["a"], r["a"]) >= PARALLEL))
    q = F.array(_crossing(p["a"], r["a"]), _crossing(r["a"], p["b"]), _crossing(p["b"], r["b"]), _crossing(r["b"], p["a"]))
    m = F.least("width", "height") * OUTSIDE
    inside = F.forall(q, lambda c: F.coalesce(c["x"].between(-m, F.col("width") + m) & c["y"].between(-m, F.col("height") + m), F.lit(False)))
    return both.select("image_id", "width", "height", q.alias("q"), inside.alias("_in")).where("_in").select("image_id", "width", "height", ordered_quad(F.col("q")).alias("q"))


# ---------------------------------------------------------------- agreement and choice


def family(origin: Column) -> Column:
    """The method without its pass: ``bordes3`` and ``bordes1`` are one."""
    return F.regexp_replace(origin, "[-0-9].*$", "")


def _middle(q: Column, part: str) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda acc, p: acc + p[part] / 4)


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, r: F.hypot(p["x"] - r["x"], p["y"] - r["y"]) / 4), F.lit(0.0), lambda acc, d: acc + d)


def with_agreement(candidates: DataFrame, least: float = LEAST_MARK) -> DataFrame:
    """The candidates of a mark of ``least`` or more, and each picture's best, with ``agreed``: how many other families reach the same corners.

    Candidates are (image_id, width, height, seq, origin, q, score, worst), ``seq`` differs within a picture.  Corners as near as that have their
    middles in the same or a neighbouring cell of a grid, which the join is on.
    """
    best = Window.partitionBy("image_id").orderBy(F.desc("score"), "seq")
    c = candidates.where("score is not null").withColumn("_rank", F.row_number().over(best)).withColumn("_family", family(F.col("origin")))
    reach = F.least("width", "height") * AGREE
    c = c.withColumn("_x", F.floor(_middle(F.col("q"), "x") / reach)).withColumn("_y", F.floor(_middle(F.col("q"), "y") / reach))
    asked = c.where((F.col("score") >= least) | (F.col("_rank") == 1))
    cells = F.array(*[F.struct((F.col("_x") + i).alias("x"), (F.col("_y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = asked.select("image_id", "seq", F.col("q").alias("_q"), F.col("score").alias("_score"), F.col("_family").alias("_own"), (F.least("width", "height") * AGREE).alias("_reach"), F.explode(cells).alias("c")).select("*", F.col("c.x").alias("_x"), F.col("c.y").alias("_y")).drop("c")
    met = around.join(c.select("image_id", "_x", "_y", "q", "score", "_family").hint("merge"), ["image_id", "_x", "_y"]).where((F.col("_family") != F.col("_own")) & (F.col("score") >= F.col("_score") - WORSE) & (_distance(F.col("q"), F.col("_q")) < F.col("_reach")))
    votes = met.groupBy("image_id", "seq").agg(F.count_distinct("_family").alias("agreed"))
    out = asked.join(votes.hint("merge"), ["image_id", "seq"], "left").withColumn("agreed", F.coalesce("agreed", F.lit(0)))
    return out.drop("_x", "_y", "_family")


def chosen_cards(candidates: DataFrame, images: DataFrame, most: int = 2, ratio: float = CARD) -> DataFrame:
    """(image_id, n, origin, q, score, agreed, confidence): up to ``most`` cards of each of the ``images`` (image_id, width, height), in reading order.

    The best candidate, then others of a like size that overlap none chosen before and whose confidence is not low.  A picture with the shape of a card and
    no good candidate is the card; without any candidate its corners are null.
    """
    rated = with_agreement(candidates).withColumn("confidence", confidence(F.col("score"), F.col("worst"), F.col("agreed") > 0))
    cols = ["image_id", "seq", "origin", "q", "score", "agreed", "confidence"]
    best = rated.where("_rank = 1").select(*cols, F.lit(1).alias("_turn"))
    first = best.select("image_id", quad_area(F.col("q")).alias("_size"), F.col("q").alias("_taken"))
    rest = rated.where((F.col("_rank") > 1) & (F.col("score") >= LEAST_MARK) & (F.col("confidence") != "baja")).select(*cols)
    rest = rest.join(first.hint("merge"), "image_id").where((quad_area(F.col("q")) / F.col("_size")).between(*SIZES)).drop("_size")
    taken = best
    for turn in range(2, most + 1):
        rest = rest.where(quad_overlap(F.col("q"), F.col("_taken")) <= COMMON).drop("_taken")
        ranked = rest.withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "seq")))
        taken = taken.unionByName(ranked.where("_n = 1").select(*cols, F.lit(turn).alias("_turn")))
        if turn < most:
            after = ranked.withColumn("_taken", F.first("q").over(Window.partitionBy("image_id").orderBy(F.desc("score"), "seq")))
            rest = after.where("_n > 1").drop("_n")
    card = F.struct("_turn", "origin", "q", "score", "agreed", "confidence")
    listed = taken.groupBy("image_id").agg(F.sort_array(F.collect_list(card)).alias("cards"))
    got = images.select("image_id", "width", "height").join(listed.hint("merge"), "image_id", "left")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    shape = F.greatest(w, h) / F.least(w, h)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    alone = lambda origin, q, mark, level: F.array(F.struct(F.lit(1).alias("_turn"), F.lit(origin).alias("origin"), q.alias("q"), F.lit(mark).alias("score"), F.lit(0).cast("long").alias("agreed"), F.lit(level).alias("confidence")))
    corners = F.array(pt(zero, zero), pt(w, zero), pt(w, h), pt(zero, h))
    whole = (F.coalesce(F.get("cards", F.lit(0))["score"], zero) < WHOLE_MARK) & (F.abs(shape - ratio) / ratio < WHOLE_RATIO)
    cards = F.when(whole, alone("whole", corners, WHOLE_MARK, "media")).when(F.col("cards").isNull(), alone(None, F.lit(None).cast("array<struct<x:double,y:double>>"), 0.0, "baja")).otherwise(F.col("cards"))
    out = got.select("image_id", F.posexplode(_in_reading_order(cards)).alias("n", "c"))
    return out.select("image_id", (F.col("n") + 1).alias("n"), "c.origin", "c.q", "c.score", "c.agreed", "c.confidence")


def _in_reading_order(cards: Column) -> Column:
    """Cards that share over half of the lower one's height stand in a row, left to right; rows go down."""
    ys = lambda c: F.transform(c["q"], lambda p: p["y"])

    def before(a: Column, b: Column) -> Column:
        top, bottom = F.greatest(F.array_min(ys(a)), F.array_min(ys(b))), F.least(F.array_max(ys(a)), F.array_max(ys(b)))
        lower = F.least(F.array_max(ys(a)) - F.array_min(ys(a)), F.array_max(ys(b)) - F.array_min(ys(b)))
        row = bottom - top > lower * 0.5
        d = F.when(row, _middle(a["q"], "x") - _middle(b["q"], "x")).otherwise(_middle(a["q"], "y") - _middle(b["q"], "y"))
        return F.when(d < 0, -1).when(d > 0, 1).otherwise(0)

    return F.when(F.size(cards) > 1, F.array_sort(cards, before)).otherwise(cards)


# ---------------------------------------------------------------- refinement


def edge_points_of(grey: np.ndarray, q: list[tuple[float, float]]) -> list[tuple[int, float, float]]:
    """(side, x, y): for 37 places along each side the strongest change of grey across it, where it is over 12."""
    h, w = grey.shape
    reach = max(4, math.floor(min(w, h) * 0.012 + 0.5))
    off = np.arange(-reach, reach + 0.25, 0.5)
    t = 0.12 + 0.76 * np.arange(37) / 36

    def sample(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = (x >= 0) & (y >= 0) & (x < w - 1) & (y < h - 1)
        cx, cy = np.where(ok, x, 0), np.where(ok, y, 0)
        i, j = np.floor(cx).astype(int).clip(0, max(w - 2, 0)), np.floor(cy).astype(int).clip(0, max(h - 2, 0))
        fx, fy = cx - i, cy - j
        upper = grey[j, i] * (1 - fx) + grey[j, i + 1] * fx
        lower = grey[j + 1, i] * (1 - fx) + grey[j + 1, i + 1] * fx
        return np.where(ok, upper * (1 - fy) + lower * fy, np.nan)

    out = []
    if min(w, h) < 2:
        return out
    for side, ((ax, ay), (bx, by)) in enumerate(zip(q, q[1:] + q[:1], strict=True)):
        n = math.hypot(bx - ax, by - ay) or 1.0
        nx, ny = -(by - ay) / n, (bx - ax) / n
        x, y = (ax + (bx - ax) * t)[:, None] + nx * off, (ay + (by - ay) * t)[:, None] + ny * off
        change = np.nan_to_num(np.abs(sample(x + nx, y + ny) - sample(x - nx, y - ny)), nan=-1.0)
        best = change.argmax(1)
        rows = np.flatnonzero(change[np.arange(37), best] > 12)
        out += [(side, float(x[k, best[k]]), float(y[k, best[k]])) for k in rows]
    return out


@arrow_function("array<struct<side:int,x:double,y:double>>")
def edge_points(grey: pd.Series, width: pd.Series, height: pd.Series, q: pd.Series) -> pd.Series:
    """Points on a candidate's sides in a picture of one byte a pixel."""
    out = [
        [dict(zip(("side", "x", "y"), p, strict=True)) for p in edge_points_of(np.frombuffer(g, np.uint8).reshape(int(h), int(w)).astype(float), [(c["x"], c["y"]) for c in c4])]
        for g, w, h, c4 in zip(grey, width, height, q, strict=True)
    ]
    return pd.Series(out, dtype=object)


def refined(quads: DataFrame, points: DataFrame) -> DataFrame:
    """The quads (image_id, width, height, q) with ``q`` moved onto the points (image_id, side, x, y) found along their sides.

    A side with ten points or more is their least-squares line, by its principal direction; others stay.  A corner is where two sides meet,
    unless that is too far off.  Points meet by aggregates of each side, so nothing of them is gathered.
    """
    a = lambda c: F.avg(c)
    moments = points.groupBy("image_id", "side").agg(
        F.count("x").alias("n"), a("x").alias("x"), a("y").alias("y"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy")
    ).where(F.col("n") >= LEAST_POINTS)
    turn = F.atan2(F.col("xy") * 2, F.col("xx") - F.col("yy")) / 2
    fitted = moments.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("x", "y", F.cos(turn).alias("dx"), F.sin(turn).alias("dy"))))).alias("_fit"))
    j = quads.join(fitted.hint("merge"), "image_id", "left")

    def line(i: int) -> Column:
        p, r = F.get("q", F.lit(i)), F.get("q", F.lit((i + 1) % 4))
        t = F.atan2(r["y"] - p["y"], r["x"] - p["x"])
        own = F.struct(p["x"].alias("x"), p["y"].alias("y"), F.cos(t).alias("dx"), F.sin(t).alias("dy"))
        return F.coalesce(F.try_element_at("_fit", F.lit(i)), own)

    j = j.withColumn("_sides", F.array(*[line(i) for i in range(4)]))
    side = lambda i: F.get("_sides", F.lit(i % 4))

    def corner(i: int) -> Column:
        a, b, old = side(i + 3), side(i), F.get("q", F.lit(i))
        det = a["dx"] * b["dy"] - a["dy"] * b["dx"]
        t = ((b["x"] - a["x"]) * b["dy"] - (b["y"] - a["y"]) * b["dx"]) / F.when(F.abs(det) >= 1e-6, det)
        x, y = a["x"] + a["dx"] * t, a["y"] + a["dy"] * t
        near = F.hypot(x - old["x"], y - old["y"]) < F.least("width", "height") * MOVE
        return F.when(near, F.struct(x.alias("x"), y.alias("y"))).otherwise(old)

    return j.withColumn("q", F.when(F.col("q").isNotNull(), F.array(*[corner(i) for i in range(4)]))).drop("_fit", "_sides")
