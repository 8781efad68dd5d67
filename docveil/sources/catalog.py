"""Catalogue of files: listing, filters, expansion of a request, skipping what is done, names for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_key, parsed_date

# fixed values: kinds of files by extension, suffixes of results, and limits
KINDS = {"pdf": ["pdf"], "imagen": ["jpg", "jpeg", "png", "webp", "heic", "heif", "avif"], "word": ["docx"], "texto": ["txt", "md", "csv"]}
SUFFIXES = ["tachado", "anonimo", "protegido", "restaurado", "sin-datos"]
RESULTS = f"(?i)-(?:{'|'.join(SUFFIXES)})(?: \\([0-9]+\\))?\\.[a-z0-9]+$"
RESULT_FOLDER = "docveil"
MAX_FILES, MAX_BYTES, MAX_ENTRIES, MAX_DEPTH = 200, 100 * 1024 * 1024, 50_000, 8


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), "\\.([^.]*)$", 1))


def base_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), "\\.[^.]*$", "")


def kind_of(path: Column) -> Column:
    """pdf, imagen, word or texto by extension, null for others."""
    e = suffix_of(path)
    out = None
    for kind, ext in KINDS.items():
        out = F.when(e.isin(ext), kind) if out is None else out.when(e.isin(ext), kind)
    return out


def within(path: Column, roots: list[str]) -> Column:
    """Whether a path lies in one of the allowed folders and has no step upwards."""
    inside = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        inside = inside | (path == r) | F.startswith(path, F.lit(r + "/"))
    return inside & ~path.rlike("(?:^|/)\\.\\.(?:/|$)") & ~F.contains(path, F.lit("\u0000"))


def safe_name(name: Column) -> Column:
    """No device names, alternate streams or control characters."""
    return ~name.rlike("(?i)^(?:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\\.|$)") & ~name.rlike("[\\x00-\\x1f:]")


def scan(spark: SparkSession, folder: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, name, kind, bytes, modified) and content if wanted.  Hidden and temporary files are left out, contents are read only where selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = reader.load(folder)
    df = df.select("path", name_of(F.col("path")).alias("name"), kind_of(F.col("path")).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return df.where(~F.startswith("name", F.lit(".")) & ~F.startswith("name", F.lit("~$")))


def listing(files: DataFrame, search: str = "", kinds: list[str] | None = None, since: str | None = None, limit: int = MAX_FILES) -> DataFrame:
    """Newest first, at most ``limit``: files whose name has all words of a search, of these kinds, changed since a date."""
    df = files.withColumn("kind", kind_of(F.col("path"))).where(F.col("kind").isin(kinds or list(KINDS)))
    words = F.filter(F.split(file_key(F.lit(search)), " "), lambda w: w != "")
    df = df.where(F.forall(words, lambda w: F.contains(file_key(F.col("name")), w)))
    if since is not None:
        df = df.where(F.col("modified") >= parsed_date(F.lit(since)).cast("timestamp"))
    return df.orderBy(F.col("modified").desc(), "path").limit(limit)


def expanded(files: DataFrame, limit: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files with ``status``: ok, pending (beyond the limit, in order of path) or too large; paths that differ in case only count once, earlier
    results are left out."""
    folder = F.lower(F.regexp_extract("path", "([^/\\\\]*)[/\\\\][^/\\\\]*$", 1))
    df = files.where(~name_of(F.col("path")).rlike(RESULTS) & (folder != RESULT_FOLDER))
    key = F.lower("path")
    df = df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*files.columns), "path").alias("_f")).select("_f.*")
    fits = F.col("bytes") <= max_bytes
    # the request, not the corpus: at most a few thousand paths
    n = F.row_number().over(Window.partitionBy(fits).orderBy(F.lower("path")))
    return df.withColumn("_n", n).withColumn("status", F.when(~fits, "too large").when(F.col("_n") <= limit, "ok").otherwise("pending")).drop("_n")


def result_base(path: Column) -> Column:
    """The name a result was made from: its suffix, number and extension taken off."""
    return F.regexp_replace(name_of(path), RESULTS, "")


def skip_done(files: DataFrame, results: DataFrame, suffix: str = "tachado", shared_folder: bool = False) -> DataFrame:
    """Files with ``done``: the newest result that is no older than its file, null if there is none.

    In a result folder that several folders share, files whose names are not unique are never taken as done.
    """
    r = results.where(name_of(F.col("path")).rlike(f"(?i)-{suffix}(?: \\([0-9]+\\))?\\.[a-z0-9]+$")).select(F.lower(result_base(F.col("path"))).alias("_b"), F.col("path").alias("_p"), F.col("modified").alias("_m"))
    f = files.withColumn("_b", F.lower(base_of(F.col("path"))))
    best = f.join(r, "_b").where(F.col("_m") >= F.col("modified")).groupBy("path").agg(F.max_by("_p", F.struct("_m", "_p")).alias("done"))
    out = f.join(best, "path", "left")
    if shared_folder:
        twins = f.groupBy("_b").count().where("count > 1").select("_b", F.lit(True).alias("_twin"))
        out = out.join(twins, "_b", "left").withColumn("done", F.when(F.col("_twin").isNull(), F.col("done"))).drop("_twin")
    return out.drop("_b").select(*files.columns, "done")


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, free): wanted names, numbered " (n)" where a file of that name is there or is wanted more than once."""
    w = wanted.withColumn("_k", F.lower("name")).withColumn("_i", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("name")))
    stem = F.regexp_replace(F.lower("name"), " \\([0-9]+\\)(?=\\.[^.]*$|$)", "")
    number = F.coalesce(F.regexp_extract("name", " \\(([0-9]+)\\)(?:\\.[^.]*)?$", 1).try_cast("int"), F.lit(1))
    used = taken.groupBy(stem.alias("_k")).agg(F.max(number).alias("_used"))
    n = F.coalesce("_used", F.lit(0)) + F.col("_i")
    dot = F.regexp_extract("name", "(\\.[^.]*)$", 1)
    return w.join(used, "_k", "left").select("name", F.when(n == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", "\\.[^.]*$", ""), F.lit(" ("), n.cast("string"), F.lit(")"), dot)).alias("free"))


def warning_groups(warnings: DataFrame) -> DataFrame:
    """(warning, name, pages): page numbers of each warning and file, in order."""
    return warnings.groupBy("warning", "name").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def unsupported_reason(kind: Column, task: str) -> Column:
    """Why a file can't be used for a task (redact, strip, pseudonymize), null if it can."""
    ok = {"redact": ["pdf", "imagen", "texto"], "strip": ["imagen"], "pseudonymize": ["word", "texto"]}[task]
    return F.when(kind.isNull(), "unknown kind of file").when(~kind.isin(ok), F.concat(F.lit(f"can't {task} a file of kind "), kind))
