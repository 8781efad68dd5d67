"""Spans, entities, comparison, pages, geometry."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docveil.operators import compare as cmp
from docveil.operators import entities as ent
from docveil.operators import geometry as geo
from docveil.operators import pages
from docveil.operators.detect import Options, detect
from docveil.operators.spans import exploded, overlap_join, pattern_spans, resolve


def test_pattern_spans(spark):
    df = spark.createDataFrame([("5€6€ 7€",), ("😀 8€",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(pattern_spans(F.col("t"), "(^|[^0-9€])([0-9]€)")).collect()]
    assert [[(s.value, s.start, s.end) for s in g] for g in got[:3]] == [[("5€", 0, 2), ("7€", 5, 7)], [("8€", 2, 4)], []]


def brute_resolve(ms):
    w = {"alta": 3, "media": 2, "baja": 1}
    won, lost = [], []
    for m in sorted(ms, key=lambda m: (m[2] - m[3], -w[m[4]], m[2], m[5])):
        (lost if any(m[2] < e[3] and m[3] > e[2] for e in won) else won).append(m)
    return sorted((m[2], m[3], m[5]) for m in won)


def test_resolve(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        ms = []
        for q in range(rng.randint(0, 14)):
            s = rng.randint(0, 40)
            n = rng.randint(1, 9)
            ms.append((rng.choice(["dni", "email"]), "v" * n, s, s + n, rng.choice(["alta", "media", "baja"]), q))
        rows.append((k, ms))
    df = spark.createDataFrame([(k, [(t, v, s, e, c, True, q) for t, v, s, e, c, q in ms]) for k, ms in rows], "k long, m array<struct<type:string,value:string,start:int,end:int,confidence:string,valid:boolean,seq:int>>")
    got = {r.k: [(m.start, m.end, m.seq) for m in r.x] for r in df.select("k", resolve(F.col("m")).alias("x")).collect()}
    for k, ms in rows:
        assert got[k] == brute_resolve(ms)


def test_losing_name_keeps_its_start(spark):
    m = [("nombre", "Laura Gómez Ferrer Ronda", 0, 24, "alta", True, 1), ("direccion", "Ronda de Atocha 30, 28012 Madrid", 19, 51, "media", True, 0)]
    df = spark.createDataFrame([(m,)], "m array<struct<type:string,value:string,start:int,end:int,confidence:string,valid:boolean,seq:int>>")
    got = df.select(resolve(F.col("m"))).first()[0]
    assert [(x.type, x.value) for x in got] == [("nombre", "Laura Gómez Ferrer"), ("direccion", "Ronda de Atocha 30, 28012 Madrid")]


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_overlap_join(spark, how):
    rng = random.Random(2)
    a, b = ([(rng.randint(0, 3), k, s, s + rng.randint(1, 60)) for k in range(80) for s in [rng.randint(0, 300)]] for _ in range(2))
    schema = "doc long, n long, start int, end int"
    got = overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "doc", how, width=32).collect()
    hit = lambda x, y: x[0] == y[0] and x[2] < y[3] and x[3] > y[2]
    if how == "inner":
        assert sorted((r.n, r.n_r) for r in got) == sorted((x[1], y[1]) for x in a for y in b if hit(x, y))
    else:
        assert sorted(r.n for r in got) == sorted(x[1] for x in a if any(hit(x, y) for y in b) == (how == "left_semi"))


# ---------------------------------------------------------------- entities


def scope(spark, texts, **kw):
    docs = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "scope_id long, doc_id long, text string")
    o = Options(first_names=frozenset(["JUAN", "ANA"]), surnames=frozenset(["PEREZ", "GARCIA", "RUIZ"]), **kw)
    m = exploded(detect(docs, options=o).drop("text"))
    out, ents = ent.pseudonymize(docs, m)
    return {r.doc_id: r.pseudonymized for r in out.collect()}, ents


def test_consistent_labels(spark):
    out, ents = scope(spark, ["Don Juan Pérez García, a@b.es.", "El Sr. Pérez usa A@B.es y ana@c.es. juan pérez garcía firma", "nada"])
    assert out[0] == "Don [PERSONA_1], [EMAIL_1]." and out[2] == "nada"
    assert "[EMAIL_1]" in out[1] and "[EMAIL_2]" in out[1] and "[PERSONA_1] firma" in out[1]
    assert ents.where("base = 'PERSONA'").count() >= 1


def test_round_trip(spark):
    text = "IBAN ES91 2100 0418 4502 0005 1332 de a@b.es, DNI 12345678Z; otro: c@d.es. a@b.es"
    out, ents = scope(spark, [text])
    table = ent.mapping_json(ents).first().mapping
    df = spark.createDataFrame([(out[0], table)], "t string, j string")
    r = df.select(ent.restore(F.col("t"), ent.read_mapping(F.col("j"))).alias("r")).first().r
    assert r.text == text and r.restored == 5 and r.unknown == []


def test_restore_labels_as_people_write_them(spark):
    df = spark.createDataFrame([("[persona 1], PERSONA_10 y Persona-2; persona 3; [DNI_9] dni_9",)], "t string")
    table = F.create_map(F.lit("PERSONA_1"), F.lit("Ana"), F.lit("PERSONA_2"), F.lit("Luis"))
    r = df.select(ent.restore(F.col("t"), table).alias("r")).first().r
    assert r.text == "Ana, PERSONA_10 y Luis; persona 3; [DNI_9] dni_9" and r.restored == 2 and r.unknown == ["PERSONA_10", "DNI_9"]
    assert spark.createDataFrame([("{}",), ("x",)], "j string").select(ent.read_mapping(F.col("j")).alias("m")).collect() == [(None,), (None,)]


def test_partial_people():
    import pandas as pd

    rows = [(1, "PERSONA", k, "nombre", v, "alta", i) for i, (k, v) in enumerate([("a", "Juan Pérez"), ("b", "Juan Pérez García"), ("c", "Ana Pérez"), ("d", "Pérez")])]
    got = ent.merged(pd.DataFrame(rows, columns=["scope_id", "base", "key", "type", "value", "confidence", "first"]))
    assert got["num"].tolist() == [1, 1, 2, 3] and got["value"].tolist()[0] == "Juan Pérez García"


def test_leaks(spark):
    docs = spark.createDataFrame([(1, 1, "queda Juan Pérez aquí"), (1, 2, "queda Juanito")], "scope_id long, doc_id long, pseudonymized string")
    occ = spark.createDataFrame([(1, "Juan Pérez", "[PERSONA_1]"), (1, "Juan", "[PERSONA_2]")], "scope_id long, value string, label string")
    assert {(r.doc_id, r.label) for r in ent.leaks(docs, occ).collect()} == {(1, "[PERSONA_1]"), (1, "[PERSONA_2]")}


# ---------------------------------------------------------------- comparison

A = ["PRIMERA. Objeto. El arrendador cede la vivienda de la calle Mayor.", "SEGUNDA. Renta. La renta será de 850 euros al mes.", "TERCERA. Fianza. Se entrega una fianza de dos mensualidades.", "CUARTA. Gastos. Los gastos de comunidad son del propietario."]
B = [A[0], "SEGUNDA. Duración. El contrato dura 12 meses con prórroga tácita.", "TERCERA. Renta. La renta será de 950 euros al mes.", A[3], "QUINTA. Fianza. Se entrega una fianza de dos mensualidades."]


def test_compare(spark):
    df = spark.createDataFrame([(1, A, B), (2, A, A), (3, [], A), (4, None, None)], "pair_id long, a array<string>, b array<string>")
    got = {r.pair_id: r for r in cmp.summary(cmp.compare(df)).collect()}
    assert (got[1].total, got[1].added, got[1].removed, got[1].modified, got[1].moved) == (3, 1, 0, 1, 1)
    assert got[2].total == 0 and got[3].added == 4 and got[4].total == 0
    c = {c.kind: c for c in cmp.compare(df).where("pair_id = 1").first().changes}
    assert [tuple(i) for i in c["modificado"].important] == [("importe", "850 euros", "950 euros")]
    assert ("sensible", "", "prórroga, tácita") in [tuple(i) for i in c["anadido"].important] and c["movido"].important == []


def test_words_accept_and_reject():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (" ".join(rng.choice(["uno", "dos", "tres", "1.250,50", "€", "l'acte"]) for _ in range(rng.randint(0, 12))) for _ in range(2))
        ops = cmp.word_changes(a, b)
        assert "".join(t for o, t in ops if o <= 0) == a and "".join(t for o, t in ops if o >= 0) == b


def test_common_is_longest():
    rng = random.Random(4)
    for n in (12, 30):
        for _ in range(100):
            a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, n))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a) - 1, -1, -1):
                for j in range(len(b) - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
            assert len(cmp.common(a, b)) == best[0][0]


def test_misreadings():
    assert cmp.read_alike("12345678Z", "123456787") and not cmp.read_alike("850", "950") and cmp.read_alike("l0", "1O") and cmp.read_alike("", "·")
    assert not cmp.read_alike("casa", "coche")


def test_paragraphs():
    assert cmp.paragraphs("Uno que\nsigue.\n\nDos inde-\npendiente.") == ["Uno que sigue.", "Dos independiente."]
    assert cmp.paragraphs("a.\nb.\nc") == ["a.", "b.", "c"]
    assert cmp.except_all(["A", "a ", "b"], ["á"]) == ["a ", "b"]


# ---------------------------------------------------------------- pages


def test_assembled(spark):
    rows = [(1, 1, 1, "Fdo.:", 0.0, 100.0, 30.0, 10.0, False), (1, 1, 2, "Ana", 33.0, 100.0, 20.0, 10.0, False), (1, 1, 3, "Luis", 200.0, 100.0, 20.0, 10.0, False), (1, 1, 4, "abajo", 0.0, 80.0, 20.0, 10.0, True), (1, 1, 5, "fin", 0.0, 60.0, 20.0, 10.0, False)]
    r = pages.assembled(spark.createDataFrame(rows, "doc_id long, page_no int, item_no int, str string, x double, y double, w double, h double, eol boolean")).first()
    assert r.text == "Fdo.: Ana\tLuis\nabajo\nfin"
    assert [r.text[s.start : s.end] for s in r.spans] == ["Fdo.:", "Ana", "Luis", "abajo", "fin"]


def test_over_breaks(spark):
    rows = [(1, 1, "Cabecera\nEl DNI es 12345678\nPágina 1 de 2"), (1, 2, "Cabecera\nZ del cliente\nPágina 2 de 2"), (2, 1, "12345678"), (2, 2, "A x")]
    got = pages.over_breaks(spark.createDataFrame(rows, "doc_id long, page_no int, text string"), Options(types=["dni"])).collect()
    assert [(r.doc_id, r.page_no, r.value, r.a_start, r.b_end) for r in got] == [(1, 1, "12345678 Z", 19, 10)]


def test_fields(spark):
    df = spark.createDataFrame([("nombre_hijo", "", "Xiana"), ("casilla", "", "hola"), ("dni", "", "12345678Z"), ("cuentaIban", "", " "), ("telefonoFijo", "", "no tengo")], "name string, help string, value string")
    got = {r.name: (r.type, r.confidence) for r in pages.field_matches(df, Options()).collect()}
    assert got == {"nombre_hijo": ("nombre", "media"), "dni": ("dni", "alta"), "telefonoFijo": ("telefono", "media")}


def test_layout(spark):
    def line(p, k, t, y):
        return (1, p, k, t, 0.0, y, 300.0, 10.0, False)

    rows = [line(1, 1, "Cabecera", 800.0), line(1, 2, "Un párrafo que", 780.0), line(1, 3, "sigue inde-", 768.0), line(1, 4, "pendiente.", 756.0), line(1, 5, "Otro que pasa", 730.0), line(2, 1, "Cabecera", 800.0), line(2, 2, "de página.", 780.0), line(2, 3, "2", 20.0)]
    items = spark.createDataFrame(rows, "doc_id long, page_no int, item_no int, str string, x double, y double, w double, h double, eol boolean")
    got = [r.text for r in pages.layout_paragraphs(pages.page_lines(items)).orderBy("ord").collect()]
    assert got == ["Un párrafo que sigue independiente.", "Otro que pasa de página."]


# ---------------------------------------------------------------- geometry


def test_rects(spark):
    df = spark.createDataFrame([("a 12345678Z.", [(0, 1, (0.0, 0.0, 5.0, 10.0)), (2, 12, (10.0, 0.0, 100.0, 10.0))])], f"t string, i array<struct<start:int,end:int,rect:{geo.RECT}>>")
    r = df.select(geo.span_rects(F.col("t"), F.col("i"), F.lit(2), F.lit(11), 0.0)).first()[0]
    assert [(x.x, x.w) for x in r] == [(10.0, 100.0)]  # only a dot would be left
    r = df.select(geo.span_rects(F.col("t"), F.col("i"), F.lit(2), F.lit(6), 0.0)).first()[0]
    assert [(x.x, x.w) for x in r] == [(10.0, 45.0)]


@pytest.mark.parametrize("pixels,reason", [(0, "tapado"), (255, "invisible"), (None, None)])
def test_hidden(spark, pixels, reason):
    a = np.full((20, 40, 4), 255 if pixels is None else pixels, np.uint8)
    if pixels is None:
        a[:, ::3] = 0
    low, high, mean = geo.band(a.tobytes(), 40, 20, (2, 2, 30, 14))
    df = spark.createDataFrame([(low, high, mean)], "l double, h double, m double")
    assert df.select(geo.hidden_reason(F.col("l"), F.col("h"), F.col("m"), F.lit(10.0))).first()[0] == reason
    assert df.select(geo.hidden_reason(F.col("l"), F.col("h"), F.col("m"), F.lit(2.0))).first()[0] == "diminuto"


def test_quads(spark):
    q = [(100.0, 54.0), (0.0, 0.0), (0.0, 54.0), (100.0, 0.0)]
    df = spark.createDataFrame([(q,)], f"q {geo.QUAD}").select(geo.ordered_quad(F.col("q")).alias("q"))
    r = df.select("q", geo.quad_area(F.col("q")).alias("a"), geo.is_convex(F.col("q")).alias("c"), geo.angles(F.col("q")).alias("g"), geo.quad_score(F.col("q"), F.array(*[F.lit(1.0)] * 4), F.lit(140.0), F.lit(100.0), 100 / 54).alias("s")).first()
    assert [(p.x, p.y) for p in r.q] == [(0, 0), (100, 0), (100, 54), (0, 54)] and r.a == 5400 and r.c and [round(x) for x in r.g] == [90] * 4
    assert abs(r.s - (0.45 + 0.15 + 0.25 + 0.05 + 0.1 - 0.15)) < 1e-9
    sq = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert geo.overlap_ratio(sq, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]) == pytest.approx(0.25)
    assert geo.overlap_ratio(sq, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 6.0)]) == 0 and geo.overlap_ratio(sq, sq[::-1]) == pytest.approx(1)


def test_pixels():
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    assert all(geo.upright(geo.upright(a, o), {6: 8, 8: 6}.get(o, o)).tolist() == a.tolist() for o in range(1, 9))
    assert geo.reduced(np.full((100, 50, 3), 7, np.uint8), 10).shape == (10, 5, 3) and (geo.reduced(np.full((100, 50, 3), 7, np.uint8), 10) == 7).all()
    assert geo.blacked(np.full((4, 4, 3), 9, np.uint8), [(1, 1, 2, 2)]).sum() == 9 * 3 * 12
    assert len(np.unique(geo.pixelated(np.arange(48, dtype=np.uint8).reshape(4, 4, 3), (0, 0, 4, 4), 4).reshape(-1, 3), axis=0)) == 1
