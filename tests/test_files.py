"""The writer that never overwrites, the reader of folder trees, names resolved against a tree, and the shared folder."""

import os
import subprocess
import sys
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docveil.sources import files, texts

from .conftest import ROOT


def _rows(spark, folder, sets, content="x"):
    rows = [(f"{k:03d}", str(folder), stem, ext, f"{content} {k}".encode()) for k, stem in enumerate(sets) for ext in (".html", ".docx")]
    return spark.createDataFrame(rows, "set_id string, folder string, stem string, ext string, content binary")


def _names(folder):
    return sorted(os.listdir(folder))


def test_numbers_are_shared_and_nothing_is_overwritten(spark, tmp_path):
    out = tmp_path / "new" / "results"
    out.mkdir(parents=True)
    (out / "a (2).docx").write_text("mine")
    saved = {r["path"]: r["set_id"] for r in files.save_files(_rows(spark, out, ["a", "a", "b"]), [str(tmp_path)]).collect()}
    # number 2 is taken for one of the two, so that the second pair gets 3
    assert _names(out) == ["a (2).docx", "a (3).docx", "a (3).html", "a.docx", "a.html", "b.docx", "b.html"]
    assert (out / "a (2).docx").read_text() == "mine"
    for path, k in saved.items():
        assert open(path).read() == f"x {int(k)}"


def test_two_jobs_at_once(spark, tmp_path):
    """Both write the same names into one folder, with files of others turning up meanwhile."""
    frames = [_rows(spark, tmp_path, ["n"] * 40, c) for c in ("first", "second")]
    got, failed = [], []

    def job(df):
        try:
            # a thread of its own has no active session in the JVM until a query is planned in it
            spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
            got.extend(r["path"] for r in files.save_files(df, [str(tmp_path)]).collect())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=job, args=(f,)) for f in frames]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed, str(failed[0])[-1500:]
    assert len(set(got)) == 160 and sorted(map(os.path.basename, got)) == _names(tmp_path)
    assert sorted(open(p).read() for p in got) == sorted(f"{c} {k}" for c in ("first", "second") for k in range(40) for _ in range(2))


def test_only_committed_attempts_count(spark, tmp_path):
    """An attempt that was killed half way leaves staged files, which get no names and are removed."""
    out = tmp_path / "out"
    w = files.NewFileWriter(str(tmp_path / "report"), [str(tmp_path)])
    batch = pa.RecordBatch.from_pylist([{"set_id": "1", "folder": str(out), "stem": "a", "ext": e, "content": b"1"} for e in (".x", ".y")])

    def killed():
        yield batch
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        w.write(killed())
    assert len(_names(out)) == 2 and all(n.startswith(".docveil-") for n in _names(out))
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    assert lost.listing != kept.listing
    w.commit([kept])
    assert _names(out) == ["a.x", "a.y"] and _names(tmp_path / "report") == [".published", "part-00000.json"]


def test_failures_leave_nothing(spark, tmp_path):
    out = tmp_path / "out"
    bad = _rows(spark, out, ["a"] * 8).withColumn("stem", F.when(F.col("set_id") == "005", F.raise_error(F.lit("lost"))).otherwise(F.col("stem")))
    with pytest.raises(Exception, match="lost"):
        files.save_files(bad, [str(tmp_path)]).collect()
    assert not out.exists() or _names(out) == []
    # a number beyond the last one ends the job, and the names already given are taken back
    for k in range(2, files.MAX_COPIES + 1):
        (tmp_path / f"b ({k}).html").touch()
    (tmp_path / "b.html").touch()
    before = set(_names(tmp_path))
    with pytest.raises(Exception, match="copies"):
        files.save_files(_rows(spark, tmp_path, ["a", "b"]), [str(tmp_path)]).collect()
    assert set(_names(tmp_path)) == before


def test_only_allowed_folders(spark, tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "in2"
    inside.mkdir()
    outside.mkdir()
    (inside / "link").symlink_to(outside)
    for folder in (outside, inside / "link", inside / "link" / "new", inside / ".." / "in2"):
        with pytest.raises(Exception, match="outside the allowed"):
            files.save_files(_rows(spark, folder, ["a"]), [str(inside)]).collect()
    with pytest.raises(Exception, match="no file name"):
        files.save_files(_rows(spark, inside, ["../a"]), [str(inside)]).collect()
    assert _names(outside) == [] and _names(inside) == ["link"]


def test_texts_keep_their_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ñandú".encode("utf-16"))
    (tmp_path / "b.csv").write_bytes("ñandú".encode("cp1252"))
    (tmp_path / "docveil").mkdir()
    (tmp_path / "docveil" / "c.md").write_bytes("ñandú".encode())
    read = texts.read_texts(spark, str(tmp_path)).withColumn("text", F.upper("text"))
    saved = {os.path.basename(r["path"]): r["saved"] for r in files.save_texts(read, "anonimo", [str(tmp_path)]).collect()}
    assert saved == {"a.txt": f"{tmp_path}/docveil/a-anonimo.txt", "b.csv": f"{tmp_path}/docveil/b-anonimo.csv", "c.md": f"{tmp_path}/docveil/c-anonimo.md"}
    assert open(saved["a.txt"], "rb").read() == b"\xff\xfe" + "ÑANDÚ".encode("utf-16-le")
    assert open(saved["b.csv"], "rb").read() == b"\xef\xbb\xbf" + "ÑANDÚ".encode()
    assert open(saved["c.md"], "rb").read() == "ÑANDÚ".encode()
    again = files.save_texts(read, "anonimo", [str(tmp_path)]).collect()
    assert sorted(os.path.basename(r["saved"]) for r in again) == ["a-anonimo (2).txt", "b-anonimo (2).csv", "c-anonimo (2).md"]


# ---------------------------------------------------------------- trees


def _tree(tmp_path):
    root, other = tmp_path / "Raiz", tmp_path / "otra"
    (root / "a" / "b" / "c").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "Downloads").mkdir()
    other.mkdir()
    for name in ("z.pdf", "a/nomina.pdf", "a/b/Nomina.PDF", "a/b/c/deep.txt", ".oculto", "a/~$tmp.docx", "node_modules/n.pdf", "Downloads/d.csv", "acceso.lnk"):
        (root / name).write_text(name)
    (other / "fuera.pdf").write_text("no")
    (root / "a" / "bucle").symlink_to(root)
    (root / "a" / "fuera").symlink_to(other)
    (root / "a" / "nada").symlink_to(tmp_path / "missing")
    (root / "copia.pdf").symlink_to(root / "z.pdf")
    return root


def test_scan(spark, tmp_path):
    root = str(_tree(tmp_path))
    rows = files.scan_tree(spark, [root]).collect()
    got = sorted((r["path"].removeprefix(root), r["name"], r["level"], r["is_folder"]) for r in rows)
    want = [("", "bucle", 1, True), ("/Downloads", "Downloads", 0, True), ("/Downloads/d.csv", "d.csv", 1, False), ("/a", "a", 0, True), ("/a/b", "b", 1, True), ("/a/b/Nomina.PDF", "Nomina.PDF", 2, False), ("/a/b/c", "c", 2, True), ("/a/b/c/deep.txt", "deep.txt", 3, False), ("/a/nomina.pdf", "nomina.pdf", 1, False), ("/acceso.lnk", "acceso.lnk", 0, False), ("/z.pdf", "copia.pdf", 0, False), ("/z.pdf", "z.pdf", 0, False)]
    assert got == want and not any(r["cut"] for r in rows)
    assert next(r["bytes"] for r in rows if r["name"] == "d.csv") == len("Downloads/d.csv")


def test_budgets(spark, tmp_path):
    root = str(_tree(tmp_path))
    assert {r["level"] for r in files.scan_tree(spark, [root], depth=2).collect()} == {0, 1}
    assert {r["level"] for r in files.scan_tree(spark, [root], recursive=False).collect()} == {0}
    # the root has seven entries, hidden ones among them; those of the first folder below come next, by name
    some = files.scan_tree(spark, [root], limit=8).collect()
    assert all(r["cut"] for r in some) and sorted(r["name"] for r in some) == ["Downloads", "a", "acceso.lnk", "copia.pdf", "d.csv", "z.pdf"]
    assert files.scan_tree(spark, [str(tmp_path / "none")]).collect() == []


def test_scan_without_budget(spark, tmp_path):
    root = str(_tree(tmp_path))
    found = lambda **kw: sorted(tuple(r) for r in files.scan_tree(spark, [root], **kw).collect())
    assert found(limit=None) == found() and found(limit=None, depth=2) == found(depth=2) and found(limit=None, recursive=False) == found(recursive=False)
    many = tmp_path / "many"
    many.mkdir()
    for k in range(50_010):
        (many / str(k)).touch()
    whole = files.scan_tree(spark, [str(many)], limit=None)
    assert whole.count() == 50_010 and whole.where("cut").count() == 0


def test_resolved(spark, tmp_path):
    root = str(_tree(tmp_path))
    asked = {
        "z.pdf": ("ok", "/z.pdf"), "copia.pdf": ("ok", "/z.pdf"), "NOMINA.pdf": ("several", None), "a/nomina.pdf": ("ok", "/a/nomina.pdf"), "a\\b\\..\\nomina.pdf": ("ok", "/a/nomina.pdf"), "raiz/a/b/Nomina.PDF": ("ok", "/a/b/Nomina.PDF"),
        "Descargas/d.csv": ("ok", "/Downloads/d.csv"), "../otra/fuera.pdf": ("outside", None), f"{tmp_path}/otra/fuera.pdf": ("outside", None), "falta.pdf": ("missing", None), f"{root}/a": ("not a file", None), "a": ("not a file", None),
        f'"{root}/z.pdf"': ("ok", "/z.pdf"), "acceso.lnk": ("shortcut", None),
    }
    tree = files.scan_tree(spark, [root])
    got = {r["id"]: r for r in files.resolved(spark.createDataFrame([(a, a) for a in asked], "id string, asked string"), tree, [root]).collect()}
    for a, (status, path) in asked.items():
        assert got[a]["status"] == status, a
        assert status != "ok" or got[a]["path"] == root + path
    assert got["NOMINA.pdf"]["found"] == [f"{root}/a/b/Nomina.PDF", f"{root}/a/nomina.pdf"]
    big = files.resolved(spark.createDataFrame([(1, "z.pdf")], "id long, asked string"), tree, [root], max_bytes=2).first()
    assert big["status"] == "too large"
    folder = files.resolved(spark.createDataFrame([(1, "a/b"), (2, "z.pdf"), (3, "Descargas"), (4, "raiz")], "id long, asked string"), tree, [root], folders=True).collect()
    assert {r["id"]: (r["status"], r["path"] and r["path"].removeprefix(root)) for r in folder} == {1: ("ok", "/a/b"), 2: ("not a folder", None), 3: ("ok", "/Downloads"), 4: ("ok", "")}


def test_shared_folder_without_settings(tmp_path):
    """A plain local session in which no folder is set."""
    code = "from pyspark.sql import SparkSession; from docveil.sources.shared import stored, shared_dir\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nassert s.conf.get('spark.checkpoint.dir', None) is None\nassert stored(s.range(3), 'x').count() == 3 and shared_dir(s) == shared_dir(s); print(shared_dir(s))"
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    got = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0 and "docveil-" in got.stdout, got.stderr[-2000:]
