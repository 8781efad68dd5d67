"""Folders as tables: a reader of folder trees within budgets, names resolved against a tree, and a writer that never overwrites.

Both are data sources over folders that driver and executors share and that are mounted, as names are claimed with hard links, which
fail where a name is taken.  Executors read and write contents; the driver sees names only, one task's at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import unaccent
from .catalog import MAX_BYTES, MAX_DEPTH, MAX_ENTRIES, RESULT_FOLDER, base_of, name_of
from .shared import temporary_folder
from .texts import encoded

#: Numbers a name may get before it is given up.
MAX_COPIES = 999
#: Folders that one task of a scan reads.
FOLDERS = 64
# fixed values: system folders that are never entered, and folders that are shown under a translated name
SYSTEM_FOLDERS = frozenset(["node_modules", "$recycle.bin", "system volume information", "appdata", "library", "__pycache__"])
TRANSLATED = {"descargas": "Downloads", "documentos": "Documents", "mis documentos": "Documents", "escritorio": "Desktop", "imagenes": "Pictures", "mis imagenes": "Pictures", "musica": "Music", "videos": "Videos", "mis videos": "Videos", "peliculas": "Movies"}


def local_path(path: str) -> str:
    """A mounted folder's path without its scheme."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is no mounted folder")
    return path


def inside(path: str, roots: list[str]) -> bool:
    return any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots)


# ---------------------------------------------------------------- writer


def _listing(job: str, task: int, attempt: str) -> str:
    return f".docveil-{job}-{task:05d}-{attempt}"


@dataclass
class Staged(WriterCommitMessage):
    """One task's list of staged files."""

    task: int
    listing: str


class NewFileWriter(DataSourceArrowWriter):
    """Tasks stage contents under hidden names beside their targets; the driver gives them their names when all tasks are done.

    Of a task that was killed or repeated only the attempt that Spark commits gets names; the others' staged files are removed.
    """

    def __init__(self, report: str, roots: list[str]):
        self.report, self.roots, self.job = report, [os.path.realpath(r) for r in roots], uuid.uuid4().hex
        os.makedirs(report, exist_ok=True)

    def _checked(self, folder: str) -> str:
        """A folder's real path, made if it isn't there; what exists of it, links followed, has to lie in an allowed folder."""
        there = folder = os.path.abspath(folder)
        while not os.path.exists(there):
            there = os.path.dirname(there)
        if not inside(os.path.realpath(there), self.roots) or not (folder == there or inside(os.path.realpath(there) + folder[len(there) :], self.roots)):
            raise PermissionError(f"{folder} is outside the allowed folders")
        os.makedirs(folder, exist_ok=True)
        return os.path.realpath(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        attempt, task = uuid.uuid4().hex, TaskContext.get().partitionId() if TaskContext.get() else 0
        name = _listing(self.job, task, attempt)
        n, folders = 0, {}
        with open(f"{self.report}/{name}", "x") as listing:
            for b in iterator:
                for row in b.to_pylist():
                    folder = folders.get(row["folder"]) or folders.setdefault(row["folder"], self._checked(row["folder"]))
                    if "/" in row["stem"] + row["ext"] or "\0" in row["stem"] + row["ext"] or not row["stem"] + row["ext"]:
                        raise ValueError(f"{row['stem']}{row['ext']} is no file name")
                    hidden = f"{folder}/{name}-{n}"
                    listing.write(json.dumps({"staged": hidden, **{k: row[k] for k in ("set_id", "stem", "ext")}, "folder": folder}) + "\n")
                    listing.flush()  # what is staged is listed, so that it can be removed
                    with open(hidden, "xb") as f:
                        f.write(row["content"] or b"")
                        f.flush()
                        os.fsync(f.fileno())
                    n += 1
        return Staged(task, name)

    def _named(self, files: list[dict]) -> list[str]:
        """Give the files of a set the first number that is free for all of them."""
        for n in range(1, MAX_COPIES + 1):
            paths = [f"{f['folder']}/{f['stem']}{f' ({n})' if n > 1 else ''}{f['ext']}" for f in files]
            made = []
            try:
                for f, path in zip(files, paths, strict=True):
                    os.link(f["staged"], path)  # fails where the name is taken, even at the last moment
                    made.append(path)
                return paths
            except FileExistsError:
                for path in made:
                    os.unlink(path)
        raise FileExistsError(f"over {MAX_COPIES} copies of {files[0]['stem']}{files[0]['ext']}")

    def _listed(self, name: str) -> Iterator[dict]:
        with open(f"{self.report}/{name}") as f:
            for line in f:
                if line.endswith("\n"):  # a killed task may leave half a line, and has staged nothing for it
                    yield json.loads(line)

    def commit(self, messages: list[Staged | None]) -> None:
        published = f"{self.report}/.published"
        try:
            with open(published, "w") as done:
                for m in sorted((m for m in messages if m), key=lambda m: m.task):
                    with open(f"{self.report}/part-{m.task:05d}.json", "w") as out:
                        for _, files in groupby(self._listed(m.listing), lambda f: f["set_id"]):
                            files = list(files)
                            for f, path in zip(files, self._named(files), strict=True):
                                done.write(path + "\n")
                                out.write(json.dumps({"set_id": f["set_id"], "path": path}) + "\n")
        except BaseException:
            with open(published) as done:
                for path in done.read().splitlines():
                    os.unlink(path)
            raise
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Remove what all attempts of this job staged."""
        for name in os.listdir(self.report):
            if name.startswith(f".docveil-{self.job}-"):
                for f in self._listed(name):
                    if os.path.exists(f["staged"]):
                        os.unlink(f["staged"])
                os.unlink(f"{self.report}/{name}")


class NewFiles(DataSource):
    """``format("new_files")``: writes (set_id, folder, stem, ext, content) to new files; options report (a folder) and roots (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "new_files"

    def schema(self) -> str:
        return "set_id string, folder string, stem string, ext string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NewFileWriter:
        if overwrite:
            raise ValueError("new_files never overwrites; use mode append")
        return NewFileWriter(self.options["report"], json.loads(self.options["roots"]))


def save_files(files: DataFrame, roots: list[str]) -> DataFrame:
    """Write files (set_id, folder, stem, ext, content) and give (set_id, path) as they were named.

    Nothing is overwritten: where a name is taken, " (2)", " (3)" and so on are tried, and all files of a set get the same number.  Sets are named in
    order of set_id within a task.  If any file can't be written, none stays.
    """
    spark = files.sparkSession
    spark.dataSource.register(NewFiles)
    report = local_path(temporary_folder(spark, "saved"))
    rows = files.select(F.col("set_id").cast("string").alias("set_id"), "folder", "stem", "ext", F.col("content").cast("binary").alias("content"))
    dealt = rows.repartition("set_id").sortWithinPartitions("set_id", "stem", "ext")
    dealt.write.format("new_files").option("report", report).option("roots", json.dumps(roots)).mode("append").save()
    return spark.read.schema("set_id string, path string").json(f"file://{report}")


def output_folder(path: Column, chosen: Column | None = None) -> Column:
    """Where a result goes: the chosen folder, else the result folder beside the original, or the original's own if it is one already."""
    folder = F.regexp_replace(path, "[/\\\\][^/\\\\]*$", "")
    own = F.when(F.lower(name_of(folder)) == RESULT_FOLDER, folder).otherwise(F.concat(folder, F.lit(f"/{RESULT_FOLDER}")))
    return own if chosen is None else F.coalesce(chosen, own)


def save_texts(texts: DataFrame, suffix: str, roots: list[str], text_col: str = "text") -> DataFrame:
    """Write texts (path, text, encoding) beside their originals, in the encoding that each was read in, as ``name-suffix.ext``: (path, saved)."""
    path = F.regexp_replace("path", "^file:/+", "/")
    ext = F.regexp_extract(name_of(path), "(\\.[^.]*)$", 1)
    files = texts.select(F.col("path").alias("set_id"), output_folder(path).alias("folder"), F.concat(base_of(path), F.lit(f"-{suffix}")).alias("stem"), ext.alias("ext"), encoded(F.col(text_col), F.col("encoding")).alias("content"))
    return save_files(files, roots).select(F.col("set_id").alias("path"), F.col("path").alias("saved"))


# ---------------------------------------------------------------- reader


@dataclass
class Folders(InputPartition):
    """Folders of one level: (path, root, how many of its entries count; all if null)."""

    level: int
    folders: list[tuple[str, str, int | None]]
    cut: bool


def _entries(folder: str) -> list[os.DirEntry]:
    """A folder's entries by name; none where it can't be read."""
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _subfolders(folder: str) -> list[os.DirEntry]:
    """A folder's entries by name that are folders or links to some; none where it can't be read."""
    try:
        with os.scandir(folder) as found:
            return sorted((e for e in found if e.is_dir()), key=lambda e: e.name)
    except OSError:
        return []


def _target(entry: os.DirEntry, roots: list[str]) -> str | None:
    """An entry's real path; null if it is hidden, temporary or a link to outside the roots or to nothing."""
    if entry.name.startswith((".", "~$")):
        return None
    if not entry.is_symlink():
        return entry.path
    real = os.path.realpath(entry.path)
    return real if os.path.exists(real) and inside(real, roots) else None


class TreeReader(DataSourceReader):
    """Level by level, the driver counts entries against the budget and plans folders; tasks read what each entry is.

    Without a budget the driver keeps a folder's subfolders only.
    """

    def __init__(self, roots: list[str], depth: int, limit: int | None, recursive: bool):
        self.roots, self.depth, self.limit, self.recursive = [os.path.realpath(r) for r in roots], depth, limit, recursive

    def partitions(self) -> list[Folders]:
        plan, cut, seen, left = [], False, set(self.roots), self.limit
        level, waiting = 0, [(r, r) for r in dict.fromkeys(self.roots)]
        while waiting and not cut:
            folders, below = [], []
            for folder, root in waiting:
                entries = _entries(folder) if left is not None else _subfolders(folder) if self.recursive and level + 1 < self.depth else []
                n = None if left is None else min(len(entries), left)
                folders.append((folder, root, n))
                if n is not None:
                    left -= n
                    if n < len(entries):
                        cut = True
                        break
                for e in entries if self.recursive and level + 1 < self.depth else ():
                    real = _target(e, self.roots)
                    if real is not None and os.path.isdir(real) and e.name.lower() not in SYSTEM_FOLDERS and real not in seen:
                        seen.add(real)
                        below.append((real, root))
            plan += [Folders(level, folders[k : k + FOLDERS], False) for k in range(0, len(folders), FOLDERS)]
            level, waiting = level + 1, below
        for p in plan:
            p.cut = cut
        return plan or [Folders(0, [], False)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        for folder, root, n in partition.folders:
            rows = []
            for e in _entries(folder)[:n]:
                real = _target(e, self.roots)
                if real is None:
                    continue
                try:
                    st = os.stat(real)
                except OSError:
                    continue
                is_folder = os.path.isdir(real)
                if not (is_folder and e.name.lower() in SYSTEM_FOLDERS):
                    rows.append({"path": real, "name": e.name, "root": root, "level": partition.level, "is_folder": is_folder, "bytes": 0 if is_folder else st.st_size, "modified": int(st.st_mtime * 1_000_000), "cut": partition.cut})
            if rows:
                schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("root", pa.string()), ("level", pa.int32()), ("is_folder", pa.bool_()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("cut", pa.bool_())])
                yield pa.RecordBatch.from_pylist(rows, schema)


class FolderTree(DataSource):
    """``format("folder_tree")``; options roots (JSON), depth, limit ("none" for no budget), recursive."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "path string, name string, root string, level int, is_folder boolean, bytes long, modified timestamp, cut boolean"

    def reader(self, schema: StructType) -> TreeReader:
        o = self.options
        limit = o.get("limit", str(MAX_ENTRIES))
        return TreeReader(json.loads(o["roots"]), int(o.get("depth", MAX_DEPTH)), None if limit == "none" else int(limit), o.get("recursive", "true") == "true")


def scan_tree(spark: SparkSession, roots: list[str], depth: int = MAX_DEPTH, limit: int | None = MAX_ENTRIES, recursive: bool = True) -> DataFrame:
    """Files and folders below the roots, to a depth, folders nearer to the roots first; ``cut`` where the budget of entries ended the scan.  A null
    ``limit`` is no budget: the whole tree is read.

    Hidden and temporary entries count against the budget and are left out; links are followed if they end within the roots, and no folder is
    entered twice.
    """
    spark.dataSource.register(FolderTree)
    roots = [local_path(r) for r in roots]
    return spark.read.format("folder_tree").options(roots=json.dumps(roots), depth=str(depth), limit="none" if limit is None else str(limit), recursive=str(recursive).lower()).load()


def _normal_path(parts: Column) -> Column:
    """Segments without "." and with ".." applied, joined; null if they lead above the start."""
    step = lambda acc, p: F.when(acc.isNull() | ((p == "..") & (F.size(acc) == 0)), F.lit(None)).when(p == "..", F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    kept = F.filter(parts, lambda p: ~p.isin("", "."))
    return F.array_join(F.aggregate(kept, F.array().cast("array<string>"), step), "/")


def resolved(requests: DataFrame, tree: DataFrame, roots: list[str], folders: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Requests (id, asked) with ``status``, ``path`` and ``found``.

    A request is an absolute path, one relative to a root (or led by the root's own name, or by a folder's translated name), or a bare name that
    is looked for anywhere in the tree, whatever its case.  Status is ok, outside, missing, several (``found`` has the first ten), not a file, not a folder,
    shortcut or too large.
    """
    tops = [os.path.realpath(local_path(r)) for r in roots]
    ask = F.regexp_replace(F.trim("asked"), "^[\"'«]+|[\"'»]+$", "")
    r = requests.select("id", ask.alias("asked")).withColumn("_parts", F.split("asked", "[/\\\\]+"))
    first = F.get("_parts", F.lit(0))
    rest = F.slice("_parts", 2, F.greatest(F.size("_parts"), F.lit(1)))
    is_absolute = F.startswith("asked", F.lit("/"))
    real = F.try_element_at(F.create_map(*[F.lit(x) for kv in TRANSLATED.items() for x in kv]), F.lower(unaccent(first)))
    ways = [F.col("_parts"), F.when(real.isNotNull(), F.concat(F.array(real), rest))]
    places = [F.when(is_absolute, F.concat(F.lit("/"), _normal_path(F.col("_parts"))))]
    for top in tops:
        for way in ways:
            below = F.when(way.isNotNull() & ~is_absolute, _normal_path(way))
            places.append(F.rtrim(F.concat(F.lit(top + "/"), below), F.lit("/")))
            led = F.when(F.lower(F.get(way, F.lit(0))) == os.path.basename(top).lower(), _normal_path(F.slice(way, 2, F.greatest(F.size(way), F.lit(1)))))
            places.append(F.when(~is_absolute, F.rtrim(F.concat(F.lit(top + "/"), led), F.lit("/"))))
    r = r.withColumn("_places", F.filter(F.array_distinct(F.array(*places)), lambda p: p.isNotNull())).withColumn("_in", F.exists("_places", lambda p: F.lit(False) if not tops else _any([(p == t) | F.startswith(p, F.lit(t.rstrip("/") + "/")) for t in tops])))
    entries = tree.select("path", "is_folder", "bytes").unionByName(tree.sparkSession.createDataFrame([(t, True, 0) for t in tops], "path string, is_folder boolean, bytes long")).distinct()
    names = tree.select(F.lower("name").alias("_name"), "path", "is_folder", "bytes")
    by_place = r.where("_in").select("id", F.explode("_places").alias("path")).join(entries, "path").select("id", "path", "is_folder", "bytes")
    bare = r.where(~is_absolute & (F.size("_parts") == 1)).select("id", F.lower("asked").alias("_name")).join(names, "_name").select("id", "path", "is_folder", "bytes")
    found = by_place.unionByName(bare).distinct().groupBy("id").agg(F.collect_list(F.when(F.col("is_folder") == folders, F.struct("path", "bytes"))).alias("_good"), F.count(F.lit(1)).alias("_any"))
    out = r.join(found, "id", "left")
    n, one = F.coalesce(F.size("_good"), F.lit(0)), F.get("_good", F.lit(0))
    file_status = F.lit("ok") if folders else F.when(F.lower(one["path"]).endswith(".lnk"), "shortcut").when(one["bytes"] > max_bytes, "too large").otherwise("ok")
    none = F.when(F.col("_any") > 0, "not a folder" if folders else "not a file").when(~F.col("_in"), "outside").otherwise("missing")
    status = F.when(n > 1, "several").when(n == 1, file_status).otherwise(none)
    return out.select("id", status.alias("status"), F.when(n == 1, one["path"]).alias("path"), F.when(n > 1, F.slice(F.array_sort(F.transform("_good", lambda g: g["path"])), 1, 10)).alias("found"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
