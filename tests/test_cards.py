"""Cards in photographs against plain simulations, and on what is drawn."""

import math
import random

import numpy as np
import pytest

from docveil.operators import cards
from docveil.operators.geometry import ordered_quad, quad_area

SEG = "image_id long, width double, height double, seq long, x1 double, y1 double, x2 double, y2 double"
CAND = "image_id long, width double, height double, seq int, origin string, q array<struct<x:double,y:double>>, score double, worst double"


def _merged(rows, shorter):
    lines = []
    for x1, y1, x2, y2 in rows:
        t = math.atan2(y2 - y1, x2 - x1) % math.pi
        rho, length = y1 * math.cos(t) - x1 * math.sin(t), math.hypot(x2 - x1, y2 - y1)
        for line in lines:
            d = abs(line[0] - t)
            if min(d, math.pi - d) < 0.05 and abs(line[1] - (rho if d <= math.pi - d else -rho)) < shorter * 0.015:
                line[2] += length
                break
        else:
            lines.append([t, rho, length])
    return sorted(lines, key=lambda x: -x[2])[:14]


def test_lines_as_a_plain_loop_merges_them(spark):
    rng = random.Random(3)
    data, want = [], {}
    for image in range(6):
        rows = []
        for _ in range(60):
            a, r = rng.choice([0.0, 1.2, 1.6, 3.1]) + rng.uniform(-0.06, 0.06), rng.uniform(0, 300)
            s, n = rng.uniform(-50, 50), rng.uniform(5, 80)
            p = [(-math.sin(a) * r + math.cos(a) * k, math.cos(a) * r + math.sin(a) * k) for k in (s, s + n)]
            rows.append((*p[0], *p[1]) if rng.random() < 0.5 else (*p[1], *p[0]))
        want[image] = _merged(rows, 400)
        data += [(image, 600.0, 400.0, k, *map(float, r)) for k, r in enumerate(rows)]
    data += [(9, 600.0, 400.0, 0, None, 1.0, 2.0, 3.0), (9, 600.0, 400.0, 1, 5.0, 5.0, 5.0, 5.0)]
    got = {r.image_id: r.lines for r in cards.longest_lines(spark.createDataFrame(data, SEG)).collect()}
    assert set(got) == set(want)
    for image, lines in want.items():
        assert [x.length for x in got[image]] == pytest.approx([x[2] for x in lines])
        assert [x.rho for x in got[image]] == pytest.approx([x[1] for x in lines])


def test_no_lines_no_quads(spark):
    one = [(1, 600.0, 400.0, 0, 1.0, 1.0, 90.0, 1.0)]
    assert cards.line_quads(cards.longest_lines(spark.createDataFrame(one, SEG))).count() == 0
    assert cards.line_quads(cards.longest_lines(spark.createDataFrame([], SEG))).count() == 0


def _box(x, y, w=200, h=120):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def test_cards_of_a_picture(spark):
    rows = [
        (1, 900.0, 500.0, 0, "bordes1", _box(50, 50), 0.9, 0.8),
        (1, 900.0, 500.0, 1, "zonas0", _box(51, 50), 0.7, 0.8),
        (1, 900.0, 500.0, 2, "bordes2", _box(350, 60), 0.8, 0.8),
        (1, 900.0, 500.0, 3, "lineas", _box(350, 61), 0.8, 0.8),
        (1, 900.0, 500.0, 4, "zonas-inv1", _box(50, 300), 0.75, 0.5),
        (1, 900.0, 500.0, 5, "zonas1", _box(400, 100), 0.79, 0.8),
        (1, 900.0, 500.0, 6, "bordes0", _box(700, 300, 60), 0.85, 0.8),
        (2, 900.0, 300.0, 0, "bordes0", _box(50, 50), 0.5, 0.1),
        (4, 900.0, 300.0, 0, "bordes0", _box(50, 50), None, 0.1),
    ]
    images = spark.createDataFrame([(1, 900.0, 500.0), (2, 900.0, 300.0), (3, 856.0, 540.0), (4, 900.0, 300.0)], "image_id long, width double, height double")
    got = cards.chosen_cards(spark.createDataFrame(rows, CAND), images, most=4).orderBy("image_id", "n").collect()
    assert [(r.image_id, r.n, r.origin, r.agreed, r.confidence) for r in got] == [
        (1, 1, "bordes1", 1, "alta"), (1, 2, "bordes2", 1, "alta"), (1, 3, "zonas-inv1", 0, "media"),
        (2, 1, "bordes0", 0, "baja"), (3, 1, "whole", 0, "media"), (4, 1, None, 0, "baja"),
    ]
    assert got[-1].q is None and got[-2].q[2].x == 856.0
    two = cards.chosen_cards(spark.createDataFrame(rows, CAND), images, most=2).where("image_id = 1").orderBy("n").collect()
    assert [r.origin for r in two] == ["bordes1", "bordes2"]


def test_sides_move_onto_a_drawn_edge(spark):
    grey = np.full((200, 300), 30, np.uint8)
    grey[50:151, 60:241] = 220
    off = [(62.0, 47.0), (238.0, 52.0), (242.0, 149.0), (58.0, 152.0)]
    found = cards.edge_points_of(grey.astype(float), off)
    assert {s for s, *_ in found} == {0, 1, 2, 3}
    rows = spark.createDataFrame([(1, bytearray(grey.tobytes()), 300.0, 200.0, off), (2, bytearray(bytes(60_000)), 300.0, 200.0, off)], "image_id long, grey binary, width double, height double, q array<struct<x:double,y:double>>")
    from pyspark.sql import functions as F

    points = rows.select("image_id", F.explode(cards.edge_points("grey", F.col("width"), F.col("height"), F.col("q"))).alias("p")).select("image_id", "p.*")
    got = {r.image_id: r for r in cards.refined(rows.drop("grey"), points).select("image_id", ordered_quad(F.col("q")).alias("q"), quad_area(F.col("q")).alias("area")).collect()}
    assert got[1].area == pytest.approx(180.5 * 100.5, rel=0.02)
    for (x, y), p in zip([(59.5, 49.5), (240.5, 49.5), (240.5, 150.5), (59.5, 150.5)], got[1].q, strict=True):
        assert math.hypot(p.x - x, p.y - y) < 1.5
    assert [c for p in got[2].q for c in (p.x, p.y)] == pytest.approx([c for p in off for c in p])  # nothing to see: corners stay


def test_no_join_of_pictures_holds_a_side_whole(spark):
    from pyspark.sql import functions as F

    b = spark.range(3).select(F.col("id").alias("image_id"), F.lit(600.0).alias("width"), F.lit(400.0).alias("height"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    q = F.array(corner(50.0, 50.0), corner(250.0, 50.0), corner(250.0, 170.0), corner(50.0, 170.0))
    made = b.select("*", F.lit(0).alias("seq"), F.lit("bordes1").alias("origin"), q.alias("q"), F.lit(0.9).alias("score"), F.lit(0.1).alias("worst"))
    points = b.select("image_id", F.lit(0).alias("side"), F.lit(60.0).alias("x"), F.lit(50.0).alias("y"))
    for df in (cards.chosen_cards(made, b), cards.refined(b.withColumn("q", q), points)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
