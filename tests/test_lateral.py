"""The table function and the masking function of SQL, against the detectors and masks of the DataFrame functions."""

import random

import pytest
from pyspark.sql import functions as F

from docveil import sql
from docveil.functions.mask import LABELS, masked
from docveil.operators.detect import Options, raw_matches
from docveil.operators.spans import MATCHES, exploded, resolve

PIECES = ["12345678Z", "12345678A", "12.345.678-Z", "12.345.678-A", "1234\n5678Z", "X1234567L", "x-1234567-l", "Y7654321A", "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "ES92 2100 0418 4502 0005 1332", "2100 0418 45 0200051332", "2100041845\n0200051332", "4111 1111 1111 1111", "4111111111111112", "612 345 678", "+34 612 345 678", "+44 20 7946 0958", "0034 912345678", "ana@x.es", "j.p+q@sub.example.com", "Ana López", "😀 ñ", "1234", "\n", "-", "..."]


@pytest.fixture(scope="module")
def installed(spark):
    sql.register_detection(spark)
    return spark


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    made = [(k, rng.choice([" ", ", ", "; "]).join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12)))) for k in range(150)]
    made += [(1000, None), (1001, ""), (1002, " "), (1003, "12345678Z"), (1004, "12345678Z, " * 300)]
    df = spark.createDataFrame(made, "id int, text string")
    df.createOrReplaceTempView("t_lateral")
    return df


def test_the_table_function_finds_what_the_detectors_find(installed, texts):
    cols = ["id", "type", "value", "start", "end", "confidence", "valid"]
    got = installed.sql("select d.id, m.* from t_lateral d, lateral detect_pii(d.text) m").select(*cols)
    # the scan for foreign accounts, which may also lengthen one of the country, is left out
    found = raw_matches(F.coalesce("text", F.lit("")), Options(types=sql.LATERAL_TYPES), F.expr(f"cast(array() as {MATCHES})"))
    want = exploded(texts.select("id", resolve(found).alias("matches"))).select(*cols)
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert a == b
    assert {r[1] for r in a} == set(sql.LATERAL_TYPES)


def test_it_takes_no_shuffle(installed, texts):
    plan = installed.sql("select d.id, m.* from t_lateral d, lateral detect_pii(d.text) m")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_null_and_empty_texts(installed, texts):
    got = {r.id: (r.n, r.m) for r in installed.sql("select id, size(pii_matches(text)) n, mask_pii(text) m from t_lateral where id >= 1000").collect()}
    assert got[1000][1] is None and got[1001] == (0, "") and got[1002] == (0, " ") and got[1003] == (1, "***4567**") and got[1004] == (300, "***4567**, " * 300)
    assert installed.sql("select * from t_lateral d, lateral detect_pii(d.text) m where d.id in (1000, 1001)").count() == 0


def test_the_masked_text_is_spliced_from_the_matches(installed, texts):
    rows = installed.sql("select id, text, mask_pii(text) as shown, pii_matches(text) as ms from t_lateral where text is not null").collect()
    values = sorted({(m.type, m.value) for r in rows for m in r.ms})
    shown = {(r.k, r.v): r.s for r in installed.createDataFrame(values, "k string, v string").select("k", "v", masked(F.col("k"), F.col("v")).alias("s")).collect()}
    for r in rows:
        out, at = "", 0
        for m in r.ms:
            out, at = out + r.text[at : m.start] + shown[m.type, m.value], m.end
        assert r.shown == out + r.text[at:]


def test_values_are_masked_as_by_the_function(installed):
    values = ["", "a", "ab", "abc", "abcd", " Ana  María López ", "12345678Z", "12.345.678-Z", "X1234567L", "ES91 2100 0418 4502 0005 1332", "4111 1111 1111 1111", "123", "612 345 678", "ana@x.es", "a@b", "3/4/1980", "3/4/80", "28013", "2", "1.234,50 €", "ocho euros", "Ñandú S.L.", None]
    df = installed.createDataFrame([(k, v) for k in [*LABELS, "otra", None] for v in values], "k string, v string")
    got = df.select("k", "v", F.expr("mask_value(k, v)").alias("a"), masked(F.col("k"), F.col("v")).alias("b")).collect()
    assert [r for r in got if r.a != r.b] == []


@pytest.mark.parametrize("name", ["lateral_pii", "masked_texts"])
def test_the_queries_use_all_cores(spark, sf, name):
    """A table of few bytes is one task's to read; its detection is not."""
    from docveil.plans.queries import queries

    assert queries()[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
