"""Files, encodings, Word documents, image metadata, streams, and the registry."""

import datetime as dt
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from docveil import adapters
from docveil.operators import compare as cmp
from docveil.operators import images
from docveil.sources import catalog, docx, texts
from docveil.streaming import jobs


def test_encodings(spark):
    cases = [("ñandú €".encode("cp1252"), "windows-1252"), ("ñandú".encode(), "utf-8"), (b"\xef\xbb\xbf" + "é".encode(), "utf-8-sig"), (b"\xff\xfe" + "é".encode("utf-16-le"), "utf-16-le"), (b"\xfe\xff" + "é".encode("utf-16-be"), "utf-16-be"), (b"", "utf-8")]
    for b, name in cases:
        t, e = texts.decode_text(b)
        assert e == name and texts.decode_text(texts.encode_text(t, e))[0] == t
    assert texts.decode_text(cases[0][0])[0] == "ñandú €"
    df = spark.createDataFrame([(b,) for b, _ in cases], "b binary").select(texts.decoded(F.col("b")).alias("d"))
    assert [r.d.encoding for r in df.collect()] == [n for _, n in cases]


# ---------------------------------------------------------------- catalogue


def files(spark, rows):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1], n, m) for p, n, m in rows], "path string, name string, bytes long, modified timestamp")


DAY = dt.datetime(2026, 1, 10)


def test_listing(spark):
    rows = [("/d/Nómina_Sept.PDF", 1, DAY), ("/d/nomina oct.docx", 2, DAY + dt.timedelta(1)), ("/d/otro.exe", 3, DAY), ("/d/foto.JPEG", 4, DAY - dt.timedelta(9))]
    f = files(spark, rows)
    assert [r.name for r in catalog.listing(f, "NOMINA").collect()] == ["nomina oct.docx", "Nómina_Sept.PDF"]
    assert [r.name for r in catalog.listing(f, since="10/01/2026").collect()] == ["nomina oct.docx", "Nómina_Sept.PDF"]
    assert [r.kind for r in catalog.listing(f, kinds=["imagen"]).collect()] == ["imagen"]


def test_expanded(spark):
    rows = [("/d/a.pdf", 1, DAY), ("/d/A.PDF", 1, DAY), ("/d/b-tachado (2).pdf", 1, DAY), ("/d/docveil/c.pdf", 1, DAY), ("/d/d.pdf", 200 << 20, DAY), ("/d/e.pdf", 1, DAY), ("/d/f.pdf", 1, DAY)]
    got = {r.path: r.status for r in catalog.expanded(files(spark, rows), limit=2).collect()}
    assert got == {"/d/A.PDF": "ok", "/d/d.pdf": "too large", "/d/e.pdf": "ok", "/d/f.pdf": "pending"}


def test_skip_done(spark):
    src = files(spark, [("/d/a.pdf", 1, DAY), ("/d/b.pdf", 1, DAY), ("/e/b.pdf", 1, DAY)])
    res = files(spark, [("/o/a-tachado.pdf", 1, DAY + dt.timedelta(1)), ("/o/a-tachado (2).pdf", 1, DAY + dt.timedelta(2)), ("/o/b-tachado.pdf", 1, DAY + dt.timedelta(1)), ("/o/a-anonimo.pdf", 1, DAY + dt.timedelta(5))])
    got = {r.path: r.done for r in catalog.skip_done(src, res).collect()}
    assert got["/d/a.pdf"] == "/o/a-tachado (2).pdf" and got["/d/b.pdf"] == "/o/b-tachado.pdf"
    got = {r.path: r.done for r in catalog.skip_done(src, res, shared_folder=True).collect()}
    assert got["/d/a.pdf"] and got["/d/b.pdf"] is None


def test_paths_and_names(spark):
    df = spark.createDataFrame([("/ok/a",), ("/ok/../x",), ("/okay/a",), ("/ok",)], "p string")
    assert [r[0] for r in df.select(catalog.within(F.col("p"), ["/ok/"])).collect()] == [True, False, False, True]
    df = spark.createDataFrame([("con.txt",), ("a:b",), ("bien.pdf",)], "p string")
    assert [r[0] for r in df.select(catalog.safe_name(F.col("p"))).collect()] == [False, False, True]
    wanted, taken = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "name string"), spark.createDataFrame([("a.pdf",), ("a (3).pdf",)], "name string")
    assert {(r.name, r.free) for r in catalog.free_names(wanted, taken).collect()} == {("a.pdf", "a (4).pdf"), ("b.pdf", "b.pdf")}


def test_scan(spark, tmp_path):
    for n in ("a.pdf", ".oculto", "~$b.docx", "sub/c.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.name for r in catalog.scan(spark, str(tmp_path)).collect()) == ["a.pdf", "c.txt"]


# ---------------------------------------------------------------- Word


def test_edits_keep_runs(spark):
    data = docx.build([[(0, "Firma Ana"), (0, " Ruiz & Cía"), (0, " hoy")], [(0, "Otro párrafo")]])
    doc = docx.read(data)
    at = doc.text.index("Ana Ruiz")
    out = docx.edited(data, [(at, at + 8, "[PERSONA_1]")])
    assert docx.body_text(out) == "Firma [PERSONA_1] & Cía hoy\nOtro párrafo"
    assert len(docx.read(out).runs) == len(doc.runs)
    df = spark.createDataFrame([(data,), (b"no",)], "b binary").select(docx.docx_text(F.col("b")).alias("d"))
    got = [r.d for r in df.collect()]
    assert got[0].text.startswith("Firma Ana Ruiz") and got[1].error == "not a Word document"


def test_tracked_changes():
    a = ["Uno dos tres cuatro cinco.", "Se va del todo esta frase.", "Queda igual siempre aquí."]
    b = ["Uno dos seis cuatro cinco.", "Queda igual siempre aquí.", "Llega una cosa muy distinta."]
    data = docx.tracked(a, b, cmp.compare_paragraphs(a, b))
    assert docx.accepted(data, True) == b and docx.accepted(data, False) == a


def test_scrubbed():
    data = docx.build([[(1, "x")]], author="Juan Pérez")
    import io
    import zipfile

    buf = io.BytesIO(data)
    with zipfile.ZipFile(buf, "a") as z:
        z.writestr("docProps/core.xml", "<cp><dc:creator>Juan Pérez</dc:creator><dc:title>Para a@b.es</dc:title></cp>")
        z.writestr("docProps/thumbnail.jpeg", b"x")
        z.writestr("word/_rels/document.xml.rels", '<r><Relationship Target="file:///C:/Users/juan/plantilla.dotx"/></r>')
    out, removed = docx.scrubbed(buf.getvalue(), lambda s: s.replace("a@b.es", "[EMAIL_1]"))
    assert removed and {"author", "thumbnail", "comment authors", "local path"} <= set(removed)
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        every = b"".join(z.read(n) for n in z.namelist()).decode()
        assert "Juan" not in every and "a@b.es" not in every and "Users" not in every and "[EMAIL_1]" in every and "docProps/thumbnail.jpeg" not in z.namelist()


# ---------------------------------------------------------------- images


def tiff(entries, gps=None, order=">"):
    mark = b"MM\0*" if order == ">" else b"II*\0"
    body, extra = b"", b""
    n = len(entries) + bool(gps)
    after = 8 + 2 + 12 * n + 4

    def put(tag, kind, count, data):
        nonlocal body, extra
        v = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", after + len(extra))
        body += struct.pack(order + "HHI", tag, kind, count) + v
        if len(data) > 4:
            extra += data

    for tag, v in sorted(entries.items()):
        put(tag, 2, len(v) + 1, v.encode() + b"\0") if isinstance(v, str) else put(tag, 3, 1, struct.pack(order + "H", v))
    if gps:
        put(0x8825, 4, 1, struct.pack(order + "I", after + len(extra)))
        base = after + len(extra)
        rat = lambda t: b"".join(struct.pack(order + "II", int(x), 1) for x in t)
        at = base + 2 + 12 * 4 + 4
        ifd = struct.pack(order + "H", 4)
        ifd += struct.pack(order + "HHI", 1, 2, 2) + gps[0].encode().ljust(4, b"\0") + struct.pack(order + "HHII", 2, 5, 3, at)
        ifd += struct.pack(order + "HHI", 3, 2, 2) + gps[2].encode().ljust(4, b"\0") + struct.pack(order + "HHII", 4, 5, 3, at + 24)
        extra += ifd + b"\0" * 4 + rat(gps[1]) + rat(gps[3])
    return mark + struct.pack(order + "I", 8) + struct.pack(order + "H", n) + body + b"\0" * 4 + extra


def jpeg(*segments, tail=b""):
    scan = b"\xff\xda\0\x08\x01\x01\0\0\x3f\0" + b"\x12\xff\0\x34\xff\xd0\x56"
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + b"".join(seg(m, d) for m, d in segments) + seg(0xDB, b"\0" * 65) + scan + b"\xff\xd9" + tail


def png(*chunks):
    c = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + c(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + b"".join(c(k, d) for k, d in chunks) + c(b"IDAT", zlib.compress(b"\0\0\0\0\0")) + c(b"IEND", b"")


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


EXIF = tiff({0x0110: "Cámara 5", 0x013B: "Ana", 0x0112: 6}, gps=("N", (40, 25, 0), "W", (3, 42, 0)))
XMP = '<x:xmpmeta><rdf:Description photoshop:City="Madrid" xmp:CreatorTool="Editor"><dc:creator><rdf:li>Luis</rdf:li></dc:creator></rdf:Description></x:xmpmeta>'.encode()
IPTC = b"".join(b"\x1c\x02" + bytes([k]) + struct.pack(">H", len(v)) + v for k, v in ((80, b"Eva"), (90, b"Lugo")))
PHOTOSHOP = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(IPTC)) + IPTC
SAMPLES = {
    "exif": jpeg((0xE1, b"Exif\0\0" + EXIF)),
    "little": jpeg((0xE1, b"Exif\0\0" + tiff({0x0110: "Otra", 0x0112: 3}, order="<"))),
    "xmp": jpeg((0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP)),
    "iptc": jpeg((0xED, PHOTOSHOP)),
    "comment": jpeg((0xFE, b"hola"), (0xE2, b"ICC_PROFILE\0xx"), (0xEE, b"Adobe123")),
    "video": jpeg(tail=b"\0\0\0\x18ftypmp42xxxx"),
    "png": png((b"eXIf", EXIF), (b"tEXt", b"Author\0Ana"), (b"tIME", struct.pack(">HBBBBB", 2024, 5, 6, 7, 8, 9)), (b"caBX", b"x"), (b"zzZz", b"q")),
    "webp": webp((b"VP8X", b"\x0c\0\0\0\0\0\0\0\0\0"), (b"VP8 ", b"abc"), (b"EXIF", EXIF), (b"XMP ", XMP)),
    "bare": jpeg(),
}
LABELS = {"exif": {"Ubicación exacta (GPS)", "Móvil o cámara", "Autor"}, "little": {"Móvil o cámara"}, "xmp": {"Lugar", "Programa", "Autor", "Datos de edición (XMP)"}, "iptc": {"Autor", "Lugar", "Datos de agencia o de edición (IPTC)"}, "comment": {"Comentario"}, "video": {"Vídeo escondido en la foto"}, "png": {"Ubicación exacta (GPS)", "Texto guardado en el PNG", "Fecha de modificación (PNG)", "Credenciales de contenido (C2PA)", "Otros datos del programa o de la cámara"}, "webp": {"Ubicación exacta (GPS)", "Autor", "Lugar"}, "bare": set()}


@pytest.mark.parametrize("name", SAMPLES)
def test_inventory_and_strip(name):
    b = SAMPLES[name]
    r = images.inventory(b)
    assert LABELS[name] <= {f[0] for f in r.fields} and r.lossless
    if "Ubicación exacta (GPS)" in LABELS[name]:
        assert r.gps == (40 + 25 / 60, -(3 + 42 / 60))
    clean = images.strip(b)
    after = images.inventory(clean)
    assert after.fields == [] and after.orientation == r.orientation and after.format == r.format and images.strip(clean) == clean
    if name == "comment":
        assert b"ICC_PROFILE" in clean and b"Adobe" in clean and b"hola" not in clean


def test_broken_images(spark):
    cut = [b[: len(b) * 2 // 3] for b in SAMPLES.values()]
    for b in [*cut, b"", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"RIFF\0\0\0\0WEBP", b"II*\0"]:
        images.inventory(b)
        images.strip(b)
    rows = [(k, v) for k, v in SAMPLES.items()] + [("cut", SAMPLES["png"][:40]), ("gif", b"GIF89a")]
    got = {r.k: r.status for r in images.stripped(spark.createDataFrame(rows, "k string, content binary")).collect()}
    assert got["exif"] == "clean" and got["bare"] == "nothing to remove" and got["cut"] == "damaged" and got["gif"] == "format"
    df = spark.createDataFrame(rows, "k string, content binary").select("k", images.format_of(F.col("content")).alias("f"), "content")
    assert all(r.f == images.file_format(bytes(r.content)) for r in df.collect())


# ---------------------------------------------------------------- streams


def test_stream_is_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from docveil.operators.detect import Options, detect

    o = Options(types=["email", "tarjeta"])
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    docs.where("doc_id % 2 = 0").write.parquet(src)
    run = lambda: jobs.run_available(detect(jobs.document_stream(spark, src, docs.schema, 1), options=o).select("doc_id", "matches"), out, cp)
    run()
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(src)
    run()
    run()  # nothing new, nothing done twice
    key = lambda r: r.doc_id
    assert sorted(spark.read.parquet(out).collect(), key=key) == sorted(detect(docs, options=o).select("doc_id", "matches").collect(), key=key)


def test_labels_with_state(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "scope_id string, base string, key string"
    for batch in ([("a", "DNI", "x"), ("a", "DNI", "y"), ("b", "DNI", "x")], [("a", "DNI", "y"), ("a", "DNI", "z"), ("a", "IBAN", "x")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        q = jobs.labelled_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", cp).trigger(once=True).start()
        assert q.awaitTermination(120)
    got = {(r.scope_id, r.base, r.key): r.num for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "DNI", "x"): 1, ("a", "DNI", "y"): 2, ("b", "DNI", "x"): 1, ("a", "DNI", "z"): 3, ("a", "IBAN", "x"): 1}


def test_windows_over_a_stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    jobs.tumbling(stream).writeStream.format("memory").queryName("t_out").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("t_out").count() == jobs.tumbling(ev).count()


# ---------------------------------------------------------------- registry


def test_adapters():
    with pytest.raises(adapters.NotAvailable):
        adapters.plugged("ocr")
    adapters.plug("ocr", object())
    assert adapters.plugged("ocr")
    with pytest.raises(ValueError):
        adapters.plug("nothing", object())


def test_registry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
    assert "counts_by_type" in e.queries()


def test_sql(spark, sf):
    from docveil import sql
    from docveil.operators.detect import Options

    sql.register(spark)
    got = spark.sql("select is_valid_dni('12345678Z') a, is_valid_dni('12345678A') b, is_valid_nie('X1234567L') c, is_valid_iban('ES91 2100 0418 4502 0005 1332') d, is_valid_iban('ES92 2100 0418 4502 0005 1332') e, is_valid_card('4111 1111 1111 1111') f, is_valid_card(null) g").first()
    assert tuple(got) == (True, False, True, True, False, True, False)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("t_docs")
    sql.matches_view(spark, "t_docs", "t_matches", options=Options(types=["email"]))
    assert spark.sql("select type, count(*) n from t_matches group by type").first().type == "email"
    assert spark.sql("select count(*) n from t_matches where masked = value or masked not like '%***@%'").first().n == 0


def test_sql_checks_are_the_functions(spark):
    from docveil import sql
    from docveil.functions import checks

    sql.register(spark)
    ccc = [f"2100 0418 {k:02d} 0200051332" for k in range(100)]
    nss = [f"28/{12345678 + 7 * n:08d}/{k:02d}" for n in range(2) for k in range(97)]
    cif = [f"{p}{form}{n:07d}{c}" for p in ("", "ES") for form in "ABQWI" for n in (5881850, 1234567) for c in "0123456789ABCDEFGHIJK"]
    odd = [None, "", "ñ", "1" * 20, "1" * 12, "A1234567", "0" * 5000]
    for name, fn, values in (("ccc", checks.is_ccc, ccc), ("nss", checks.nss_control, nss), ("cif", checks.cif_control, cif)):
        df = spark.createDataFrame([(v,) for v in values + odd], "v string")
        got = df.select(F.expr(f"is_valid_{name}(v)").alias("a"), fn(F.col("v")).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and any(r.a for r in got)
