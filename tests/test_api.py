import datetime as dt

from pyspark.sql import functions as F

from docveil import api
from docveil.functions import report
from docveil.operators import compare as cmp
from docveil.operators.detect import Options

TEXT = "DNI 12345678Z, correo a@ejemplo.es, tel. 612 345 678"


def docs(spark):
    return spark.createDataFrame([(1, 1, TEXT), (1, 2, "nada"), (1, 3, None)], "scope_id long, doc_id long, text string")


def test_analyze(spark):
    got = {r.doc_id: r for r in api.analyze(docs(spark), show=True).collect()}
    assert got[1].total == 3 and got[1].doubtful == 0 and got[1].by_type == {"dni": 1, "email": 1, "telefono": 1} and got[2].total == 0 and got[2].by_type == {}
    assert got[1].shown == ["***4567**", "a***@e***.es", "*** *** 678"] and got[1].said == "1 DNI, 1 correo electrónico, 1 teléfono"
    assert {(r.type, r.n) for r in api.totals(docs(spark)).collect()} == {(None, 3), ("dni", 1), ("email", 1), ("telefono", 1)}


def test_redact(spark):
    for style, want in (("bar", f"DNI {'█' * 9}, correo {'█' * 12}, tel. {'█' * 11}"), ("label", "DNI [DNI], correo [CORREO], tel. [TELÉFONO]"), ("mask", "DNI ***4567**, correo a***@e***.es, tel. *** *** 678")):
        got = {r.doc_id: r for r in api.redact(docs(spark), style).collect()}
        assert got[1].redacted == want and got[1].left == 0 and got[2].redacted == "nada" and got[3].redacted is None


def test_round_trip(spark):
    out, tables = api.pseudonymize(docs(spark))
    hidden = out.select("scope_id", "doc_id", F.col("pseudonymized").alias("text"))
    got = {r.doc_id: r for r in api.restore(hidden, tables).collect()}
    assert got[1].text == "DNI [DNI_1], correo [EMAIL_1], tel. [TELEFONO_1]" and got[1].restored_text == TEXT and got[1].restored == 3


def test_compare_and_report(spark):
    pairs = spark.createDataFrame([(1, "Uno dos tres cuatro.\n\nPaga 850 euros al mes por la casa.", "Uno dos tres cuatro.\n\nPaga 950 euros al mes por la <casa>.")], "id long, a string, b string")
    out = api.compare(pairs)
    assert [c.kind for c in out.first().changes] == ["modificado"]
    s = cmp.summary(out)
    assert s.select(report.change_summary(s)).first()[0] == "1 cambio (1 modificado); 1 importante."
    arrays = out.withColumns({"a": F.split("a", "\n\n"), "b": F.split("b", "\n\n")})
    html = arrays.select(report.change_report(arrays, F.lit("x & y"))).first()[0]
    assert "x &amp; y" in html and "<del>850</del><ins>950</ins>" in html and "&lt;" in html and "850 euros → 950 euros" in html


def test_review_sheet(spark):
    rows = [(1, 1, "a.pdf", 1, "importe", f"{k},00", "media") for k in range(5)] + [(1, 1, "a.pdf", 2, "dni", "1<2", "media"), (1, 1, "a.pdf", 2, "email", "x", "alta")]
    df = spark.createDataFrame(rows, "scope_id long, doc_id long, name string, page_no int, type string, value string, confidence string")
    html = report.review_sheet(df).first().html
    assert "6 datos dudosos" in html and "5 × cantidad de dinero (0,00, 1,00…)" in html and "1&lt;2" in html and html.count("<li>") == 2
    assert "… y 1 líneas más" in report.review_sheet(df, 1).first().html


def test_texts(spark):
    df = spark.createDataFrame([("Sólo para la Inmobiliaria Ñandú",), ("x" * 40,), ("una palabra muy larga que sigue y sigue",)], "t string")
    assert [r[0] for r in df.select(report.purpose_slug(F.col("t"))).collect()] == ["la-inmobiliaria-nandu", "x" * 30, "una-palabra-muy-larga-que"]
    one = spark.createDataFrame([("Solo  para X", dt.date(2026, 9, 28), "mal 😀", "/home/ana/docs/a.pdf y /home/ana/docs2")], "t string, d date, e string, p string")
    r = one.select(report.mark_text(F.col("t"), F.col("d")), report.mark_text(F.col("e")), report.short_paths(F.col("p"), {"/home/ana/docs": "docs"}, "/home/ana"), report.report_name(F.lit("/x/uno.v1.docx"), F.lit("dos.pdf"))).first()
    assert tuple(r) == ("Solo para X · 28/09/2026", None, "docs/a.pdf y (tu carpeta de usuario)/docs2", "comparacion-uno.v1-dos")


def test_types_are_pruned(spark):
    plan = api.matches(docs(spark), Options(types=["email"]))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "@" in plan
