import pytest
from pyspark.sql import functions as F

from docveil.functions import checks, mask, text


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_folding(spark):
    assert col(spark, ["Ñandú", "él", "Çöñ", None], text.normal) == ["NANDU", "EL", "CON", None]
    assert col(spark, ["“a”–b°", "x"], text.fold_signs) == ['"a"-bº', "x"]
    assert col(spark, ["Nómina_Sept-2024.pdf"], text.file_key) == ["nomina sept 2024 pdf"]


def test_company_key(spark):
    assert col(spark, ["ACME Ibérica, S.L.", "Acme Ibérica", "Sol y Luna S.A.U.", "S.L."], text.company_key) == ["ACME IBERICA", "ACME IBERICA", "SOL Y LUNA", ""]


@pytest.mark.parametrize("raw,key", [("TERCERA. Renta. X.", "renta. x"), ("3.ª Renta. X", "renta. x"), ("1.250 euros son", "1.250 euros son"), ("a) Que esto", "que esto"), ("A la firma", "a la firma"), ("Artículo 5.º - Pago;", "pago"), ("IV. Fianza", "fianza")])
def test_paragraph_key(spark, raw, key):
    from docveil.operators.compare import key as python_key

    assert col(spark, [raw], text.paragraph_key) == [key] == [python_key(raw)]


NUMBERED = {
    "1. Uno": ("Uno", True), "1.2.3 - Dos": ("Dos", True), "12) tres": ("tres", True), "3.ª Renta": ("Renta", True), "4º. Pago": ("Pago", True), "5 º\tcinco": ("cinco", False),
    "PRIMERO.- Objeto": ("Objeto", True), "Décima segunda: plazo": ("plazo", True), "decimoquinto. fin": ("fin", True), "Vigésimo primera.- Fuero": ("Fuero", True), "tercer. x": ("x", True),
    "XIV - Anexos": ("Anexos", True), "iv) cuatro": ("cuatro", True), "xcix: alto": ("alto", True), "IIII. mal": ("IIII. mal", False), "vx. mal": ("vx. mal", False),
    "Cláusula 3: precio": ("precio", True), "CLAUSULA TERCERA.- Renta": ("Renta", True), "Art. 5. Pago": ("Pago", True), "artículo XII: doce": ("doce", True), "Anexo IV. Planos": ("Planos", True), "Sección primera - Normas": ("Normas", True), "Punto final. Nada": ("Punto final. Nada", False),
    "b) Que": ("Que", False), "ñ. Eñe": ("Eñe", False), "z: no": ("z: no", False), "a)": ("a)", False), "Renta. Pago": ("Renta. Pago", False), "1.250 euros": ("1.250 euros", True), "12 de mayo": ("12 de mayo", False), "1.": ("1.", True), "": ("", False), "   2.  sangrado": ("sangrado", True), "Segunda mano. Nada": ("Segunda mano. Nada", False),
}


def test_numbering(spark):
    """Columns and plain Python read numbers alike; what is left, and whether a clause starts."""
    from docveil.functions import numbering
    from docveil.operators.compare import without_number

    raw = list(NUMBERED)
    assert [without_number(s) for s in raw] == [w for w, _ in NUMBERED.values()]
    assert [bool(numbering.clause_mark(s)) for s in raw] == [c for _, c in NUMBERED.values()]
    assert col(spark, raw, numbering.without_number) == [w for w, _ in NUMBERED.values()]
    assert col(spark, raw, numbering.starts_clause) == [c for _, c in NUMBERED.values()]


def test_dice(spark):
    df = spark.createDataFrame([("uno dos tres dos", "dos dos cuatro uno"), ("a b", "uno")], "a string, b string")
    got = [r[0] for r in df.select(text.dice(text.dice_words(F.col("a")), text.dice_words(F.col("b")))).collect()]
    assert got == [0.75, 0.0]


def test_hint(spark):
    f = lambda c: text.hinted(c, F.length(c), ["Pº", "C.P."], 20)
    assert col(spark, ["importe ", "pº ", "c.p. ", "c.p." + "." * 20], f) == [False, True, True, False]


def test_sizes_and_dates(spark):
    assert col(spark, [500, 1024, 1536, 150 * 1024, 5 * 1024**2, 3 * 1024**3], text.readable_size, "long") == ["500 bytes", "1 KB", "1,5 KB", "150 KB", "5 MB", "3 GB"]
    assert [str(x) for x in col(spark, ["2026-09-01", "01/09/2026", "31/02/2026", "x"], text.parsed_date)] == ["2026-09-01", "2026-09-01", "None", "None"]


def test_shortened(spark):
    assert col(spark, ["uno dos tres", "uno"], lambda c: text.shortened(c, 8)) == ["uno…", "uno"]


def test_checks(spark):
    assert col(spark, ["12345678Z", "12345678A", "1234567Z", None], checks.is_dni) == [True, False, False, False]
    assert col(spark, ["X1234567L", "Y1234567X", "Z1234567R", "X1234567A"], checks.is_nie) == [True, True, True, False]
    ibans = ["ES9121000418450200051332", "DE89370400440532013000", "MT84MALT011000012345MTLCAST001S", "ES9121000418450200051333", "ES91"]
    assert col(spark, ibans, checks.is_iban) == [True, True, True, False, False]
    assert col(spark, ["21000418450200051332", "21000418460200051332", "2100"], checks.is_ccc) == [True, False, False]
    assert col(spark, ["4111 1111 1111 1111", "4111111111111112", "411"], checks.is_card) == [True, False, False]
    assert col(spark, [f"2812345678{2812345678 % 97:02}", "281234567899"], checks.nss_control) == [True, False]
    assert col(spark, ["B12345674", "B12345675", "ESB12345674", "Q2826000H"], checks.cif_control) == [True, False, True, True]


def test_fingerprint(spark):
    def slow(s):
        a, b = 0x811C9DC5, 5381
        for c in s:
            a = (a ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
            b = (b * 33 + ord(c)) & 0xFFFFFFFF
        return (a >> 16) << 32 | (a & 0xFFFF) << 16 | b & 0xFFFF

    assert col(spark, ["", "a", "ACME IBERICA"], checks.fingerprint48) == [slow(""), slow("a"), slow("ACME IBERICA")]


MASKS = [("dni", "12345678X", "***4567**"), ("nie", "X1234567L", "****4567*"), ("iban", "ES91 2100 0418 4502 0005 1332", "ES91 **** **** **** **** 1332"), ("tarjeta", "4111 1111 1111 1111", "**** **** **** 1111"), ("telefono", "612 345 678", "*** *** 678"), ("email", "ana@ejemplo.es", "a***@e***.es"), ("nombre", "Ana Ruiz", "A** R***"), ("fecha_nac", "01/02/1980", "**/**/1980"), ("cp", "28013", "28***"), ("importe", "1.250,50 €", "1.***,** €"), ("matricula", "1234 BCD", "12** **D"), ("dni", "123", "***")]


def test_masks(spark):
    df = spark.createDataFrame(MASKS, "t string, v string, want string")
    for r in df.select("*", mask.masked(F.col("t"), F.col("v")).alias("got")).collect():
        assert r.got == r.want and r.got != r.v


def test_counted(spark):
    df = spark.createDataFrame([({"dni": 2, "nombre": 7, "email": 1},)], "m map<string,int>")
    assert df.select(mask.counted(F.col("m"))).first()[0] == "7 nombres, 2 DNI, 1 correo electrónico"
