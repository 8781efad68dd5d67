"""Detectors over freshly written texts: what is found, with which confidence, and what is not."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docveil.operators import sequential as seq
from docveil.operators.detect import TYPES, Options, detect
from docveil.operators.spans import exploded

FIRST, LAST = frozenset(["ANA", "JUAN", "MARÍA", "LUIS"]), frozenset(["PÉREZ", "GARCÍA", "RUIZ", "GIL", "LÓPEZ"])


def letter(n):
    return "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23]


def run(spark, cases, **kw):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    out = {k: [] for k in range(len(cases))}
    for r in exploded(detect(df, options=Options(first_names=FIRST, surnames=LAST, **kw))).collect():
        assert r.text[r.start : r.end] == r.value
        out[r.doc_id].append((r.type, r.value, r.confidence))
    return out


D = f"12345678{letter(12345678)}"
N = f"X1234567{letter(1234567)}"
CASES = [
    (f"Mi DNI: {D}.", ("dni", D, "alta")),
    ("DNI 12345678-A", ("dni", "12345678-A", "media")),
    (f"DNI 12.345.678-{D[-1]}", ("dni", f"12.345.678-{D[-1]}", "alta")),
    ("El pedido 12.345.678-A", None),
    (f"número 12345678-\n{D[-1]} vale", ("dni", f"12345678-\n{D[-1]}", "alta")),
    ("Total 12345678\nA la firma", None),
    (f"ref-{D}", None),
    (f"García{D}", ("dni", D, "alta")),
    (f"AB{D}", None),
    (f"NIE {N}", ("nie", N, "alta")),
    ("CIF B12345674", ("cif", "B12345674", "alta")),
    ("código B12345674", ("cif", "B12345674", "media")),
    ("IBAN ES91 2100 0418 4502 0005 1332", ("iban", "ES91 2100 0418 4502 0005 1332", "alta")),
    ("GB82 WEST 1234 5698 7654 32 CUARTA", ("iban", "GB82 WEST 1234 5698 7654 32", "alta")),
    ("cuenta 2100-0418-45-0200051332", ("cuenta", "2100-0418-45-0200051332", "media")),
    ("tarjeta 4111 1111 1111 1111", ("tarjeta", "4111 1111 1111 1111", "alta")),
    ("tarjeta 4111 1111 1111 1112", None),
    ("Tel. 612 345 678", ("telefono", "612 345 678", "alta")),
    ("serie 700 800 900 600 500", None),
    ("+44 20 7946 0958", ("telefono", "+44 20 7946 0958", "media")),
    ("escribe a ana.ruiz@ejemplo.es hoy", ("email", "ana.ruiz@ejemplo.es", "alta")),
    ("no es correo: ana@local", None),
    (f"Seguridad Social 28/12345678/{2812345678 % 97:02}", ("nss", f"28/12345678/{2812345678 % 97:02}", "alta")),
    ("afiliación 28/12345678/00", ("nss", "28/12345678/00", "media")),
    ("coche 1234 BCD", ("matricula", "1234 BCD", "alta")),
    ("coche 1234 ABC", None),
    ("matrícula M-1234-AB", ("matricula", "M-1234-AB", "baja")),
    ("28013 Madrid", ("cp", "28013", "media")),
    ("quedan 28013 unidades", None),
    ("99999 Madrid", None),
    ("nacido el 29/02/2000", ("fecha_nac", "29/02/2000", "alta")),
    ("nacido el 29/02/2001", None),
    ("firmado el 01/02/2003", None),
    ("nacida el 3 de marzo de 1980", ("fecha_nac", "3 de marzo de 1980", "alta")),
    ("paga 1.250,50 € ya", ("importe", "1.250,50 €", "alta")),
    ("seiscientos cincuenta euros (650,00 €)", ("importe", "seiscientos cincuenta euros (650,00 €)", "alta")),
    ("cincuen-\nta euros", ("importe", "cincuen-\nta euros", "alta")),
    ("Total: 1.989,99", ("importe", "1.989,99", "media")),
    ("mide 1.989,99 cm de alto", None),
    ("vive en la calle Mayor 5, 3º B, 28013 Madrid", ("direccion", "calle Mayor 5, 3º B, 28013 Madrid", "media")),
    ("Gran Vía 32 es céntrica", ("direccion", "Gran Vía 32", "media")),
    ("plaza de garaje número 27", None),
    ("calle mayor 3", ("direccion", "calle mayor 3", "media")),
    ("La mercantil Reformas Sol, S.L. firma", ("empresa", "Reformas Sol, S.L.", "alta")),
    ("el Banco Ejemplo del Sur paga", ("empresa", "Banco Ejemplo del Sur", "media")),
    ("firma Ana Ruiz López hoy", ("nombre", "Ana Ruiz López", "alta")),
    ("GARCÍA RUIZ, ANA", ("nombre", "GARCÍA RUIZ, ANA", "media")),
    ("Madrid Norte es un barrio", None),
]


def test_cases(spark):
    got = run(spark, [t for t, _ in CASES])
    for k, (t, want) in enumerate(CASES):
        if want is None:
            assert got[k] == [], (t, got[k])
        else:
            assert want in got[k], (t, got[k])


def test_scans(spark):
    wrong = f"1234567{'B'}{letter(12345678)}"  # a B read for an 8
    got = run(spark, [f"DNI {wrong}", f"\n{wrong}\n", f"texto {wrong}", "correo: ana.ruizQejemplo.es", "ver ana.ruizQejemplo.es"], ocr=True, types=["dni", "email"])
    assert ("dni", wrong, "alta") in got[0] and ("dni", wrong, "media") in got[1] and got[2] == []
    assert ("email", "ana.ruizQejemplo.es", "media") in got[3] and got[4] == []


def test_options(spark):
    assert "tarjeta" not in Options(preset="nomina").wanted() and "cif" not in Options(preset="nomina").wanted()
    assert Options(types=["dni"]).wanted() == ["dni", "nie"]
    with pytest.raises(ValueError):
        Options(types=["nada"]).wanted()
    with pytest.raises(ValueError):
        Options(preset="nada").wanted()
    text = "Llama a Independencia, 5 o inde-\npendencia o Indéxpendencia"
    got = run(spark, [text], types=["email"], terms=["Independencia 5", "INDEPENDENCIA"])
    assert {v for _, v, _ in got[0]} == {"Independencia, 5", "inde-\npendencia"}
    assert run(spark, ["xaxb"], types=["email"], terms=["xb"])[0] == []
    assert run(spark, ["xaxb"], types=["email"], terms=["xb"], partial=True)[0] == [("personalizado", "xb", "alta")]
    kept = run(spark, ["a@b.es y c@d.es"], types=["email"], keep_visible=["c@d.es"])[0]
    assert [v for _, v, _ in kept] == ["a@b.es"]
    dates = run(spark, ["firmado el 01/02/2003"], types=["fecha_nac"], all_dates=True)[0]
    assert dates == [("fecha_nac", "01/02/2003", "media")]


def test_overlaps_are_resolved(spark):
    got = run(spark, ["ES91 2100 0418 4502 0005 1332", "Don Juan Pérez García\nRonda de Atocha 30"])
    assert got[0] == [("iban", "ES91 2100 0418 4502 0005 1332", "alta")]
    assert ("nombre", "Juan Pérez García", "alta") in got[1]


def test_company_alias_and_mentions():
    t = "Zafiro Digital, S.L. (en adelante, «Zafiro») y otra. Zafiro paga. (en adelante, el Cliente)"
    found = {v for _, v, *_ in seq.companies(t)}
    assert {"Zafiro Digital, S.L.", "Zafiro"} <= found and "Cliente" not in found


def test_company_dictionary():
    t = "Compra en Almacenes La Luna del Norte ayer"
    got = seq.companies(t, frozenset(["ALMACENES LA LUNA", "ALMACENES LA LUNA DEL NORTE"]))
    assert [v for _, v, *_ in got] == ["Almacenes La Luna del Norte"]


def test_two_people():
    got = [v for _, v, *_ in seq.names("firman Juan Pérez García y María López", frozenset(map(seq.norm, FIRST)), frozenset(map(seq.norm, LAST)))]
    assert got == ["Juan Pérez García", "María López"]


def test_astral_offsets(spark):
    got = run(spark, [f"😀😀 {D} y a@b.es"], types=["dni", "email"])
    assert [v for _, v, _ in got[0]] == [D, "a@b.es"]


def test_nulls_and_empties(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [len(r.matches) for r in detect(df, options=Options(types=TYPES)).collect()] == [0, 0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([D, N, "a@b.es", "612 345 678", "28013 Madrid", "4111111111111111", "calle Mayor 3", "1.250,50 €", "Ana Ruiz", " ", "\n", ",", "x", "ñ", "😀"]), max_size=8).map("".join), min_size=1, max_size=6))
def test_offsets_and_no_overlap(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in detect(df, options=Options(first_names=FIRST, surnames=LAST)).collect():
        last = 0
        for m in r.matches:
            assert r.text[m.start : m.end] == m.value and m.start >= last
            last = m.end


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 99_999_999))
def test_iban_generated(n):
    bban = f"21000418{n % 100:02}{n * 7919 % 10**10:010}"
    check = 98 - int(bban + "142800") % 97
    assert [f[1] for f in seq.ibans(f"x ES{check:02}{bban} y")] == [f"ES{check:02}{bban}"]


def test_addresses_in_windows(monkeypatch):
    """Results don't depend on where windows are cut, and long awkward texts need no timer."""
    from docveil.operators import sequential

    text = ("Vive en la Calle Mayor, 3, 2.º B, 28013 Madrid y trabaja en Avda. de América 12. " + "nada de nada " * 30) * 6
    whole = sequential.addresses(text)
    assert len({v for _, v, *_ in whole}) >= 2
    for window in (37, 200, 100_000):
        monkeypatch.setattr(sequential, "WINDOW", window)
        assert sequential.addresses(text) == whole
    monkeypatch.undo()
    for hostile in ("calle " * 8000, "Calle de la " * 4000, "sito en Calle A, nº 1, 2º, " * 2000, "Aa Bb Cc Dd, " * 4000, "\n" * 20_000, "a" * 50_000):
        sequential.addresses(hostile)
