"""Matches of paged documents, over breaks and on pages alone."""

from docveil.operators import pages
from docveil.operators.detect import Options

SCHEMA = "doc_id long, page_no int, text string, ocr boolean, start string"


def _found(spark, rows, **options):
    got = pages.page_matches(spark.createDataFrame(rows, SCHEMA), Options(**options))
    return sorted((r.doc_id, r.page_no, r.type, r.value, r.next_no, r.visible) for r in got.collect())


def test_a_match_over_a_break_replaces_what_pages_have(spark):
    rows = [
        (1, 1, "Pague en ES91", None, "x"),
        (1, 3, "21000418450200051332 hoy o en ana@b.es", False, "x"),
        (2, 1, "Pague en ES92", None, "x"),
        (2, 2, "21000418450200051332 hoy", False, "x"),
        (3, 1, None, None, "x"),
        (3, 2, "", True, "x"),
    ]
    got = _found(spark, rows, types=["iban", "email"], keep_visible=["ana@b.es"])
    assert got == [
        (1, 1, "iban", "ES91 21000418450200051332", 3, False),
        (1, 3, "email", "ana@b.es", None, True),
        (2, 2, "cuenta", "21000418450200051332", None, False),
    ]


def test_scanned_pages_are_read_with_more_tolerance(spark):
    text = "DNI: 1234567BZ"
    assert _found(spark, [(1, 1, text, True, ""), (2, 1, text, False, ""), (3, 1, text, None, "")], types=["dni"]) == [(1, 1, "dni", "1234567BZ", None, False)]


def test_no_pages(spark):
    assert _found(spark, [], types=["dni"]) == []


def test_the_text_around_breaks_is_searched_once(spark):
    """Of the pages' own text there is one detection in the plan, of that around breaks the stored result."""
    rows = [(1, 1, "Pague en ES91", None, "x"), (1, 2, "21000418450200051332 hoy", None, "x")]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, page_no int, text string")
    plan = pages.page_matches(df, Options(types=["iban"]))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.splitlines()) == 1


def test_the_query_searches_on_all_cores(spark, sf):
    from docveil.plans.queries import _dealt, queries

    assert queries()["page_matches"](spark, sf).count() > 0
    assert _dealt(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
