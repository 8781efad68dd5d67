"""Letters travel to their page in pieces, not a row each."""

import numpy as np
import pyarrow as pa

from docveil.operators import align


def test_glyphs_that_follow_each_other_are_one_row():
    chars = ["a", "ﬁ", None, " ", "b"] * 10_000 + ["x", "y", "½"]
    numbers = [*range(50_000), 7, 9, 10]
    batch = pa.RecordBatch.from_pydict({"page": [1] * 30_000 + [2] * 20_003, "_n": pa.array(numbers, pa.int32()), "_c": chars})
    (out,) = align._packed(iter([batch]))
    rows = out.to_pylist()
    assert [(r["page"], r["_n"], r["_size"], len(r["_text"])) for r in rows] == [(1, 0, 30_000, 24_000), (2, 30_000, 20_000, 16_000), (2, 7, 1, 1), (2, 9, 2, 4)]
    assert rows[0]["_odd"][:6] == [1, 2, 2, 0, 3, 0] and rows[3]["_odd"] == [1, 3]
    letters, number = align._drawn([(r["_n"], r["_size"], r["_text"], r["_odd"]) for r in rows[2:]])
    assert letters.tobytes().decode("utf-32-le") == "xy1⁄2" and number.tolist() == [7, 9, 10, 10, 10]


def test_one_shuffle_and_nothing_stored(spark):
    texts = spark.createDataFrame([(1, "hola fin")], "page long, text string")
    glyphs = spark.createDataFrame([(1, 0, "h"), (1, 1, "ﬁ")], "page long, n int, c string")
    plan = align.aligned(texts, glyphs, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and "Aggregate" not in plan and "parquet" not in plan.lower()


def test_codes_of_letters():
    letters, at = align._letters("a ﬁ\n½x")
    assert letters.tobytes().decode("utf-32-le") == "afi1⁄2x" and at.tolist() == [0, 2, 2, 4, 4, 4, 5]
    assert [x.tolist() for x in align._page(*(np.array([ord(c) for c in s], "<u4") for s in ("abcdefghijklm", "abcdefghXjklm")))] == [[0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12]] * 2
