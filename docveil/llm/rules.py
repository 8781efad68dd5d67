"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each document's words, symbols, repeated lines and repeated five-word windows give the base rules.  Then lines are
normalised (lower case, white space squeezed) and hashed, and the distinct texts that have a line are counted per host.  Lines in more
than ``min_texts`` of them and in more than ``percent`` % of the host's texts are boilerplate: they are removed everywhere but in the
host's document with the smallest id that has them.  A document that loses over ``max_removed`` % of its words is depleted and rejected.

Counting distinct texts, not rows, keeps exact copies from making each other's lines boilerplate.  A text is read once; what
follows works on a stored table of counts and line hashes.  Line hashes spread over the keys, so a hot host is no
hot key; a hot line is pre-aggregated before its shuffle, and its rows are salted in the join with the few lines to remove.

Windows and lines are compared by 64-bit hashes of their words.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of its own; rows with a
null id or repeated ids are judged each by their own text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 5
#: A host's line is boilerplate if more distinct texts than this have it, and more than this share (per cent) of the host's texts.
MIN_TEXTS, PERCENT = 5, 5
#: Parts that rows of one line are dealt to when they meet the lines to remove.
SALT = 16
_SPACE = "[\\x20\\x09-\\x0D]+"
#: Host of rows without one; no host has this name.
_NO_HOST = "\u0000"


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda s: F.length(F.regexp_replace(s, _SPACE, "")) > 0)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, _SPACE, " "))))


def _covered(positions: Column) -> Column:
    """Words in the windows that start at these increasing positions."""
    start = F.struct(F.lit(-WINDOW).cast("int").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document with the base counts, its text's hash, and its lines as (h, n): hash and words."""
    df = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit(_NO_HOST)).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    df = df.select("*", F.filter(F.split("text", _SPACE, -1), lambda w: w != "").alias("words"), _lines(F.col("text")).alias("lines"))
    df = df.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("w"),
        F.transform("lines", lambda s: F.struct(line_hash(s).alias("h"), F.size(F.filter(F.split(s, _SPACE, -1), lambda w: w != "")).alias("n"))).alias("lines"),
    )
    at = [c for c in df.columns if c != "w"]
    window = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    df = df.select(*at, F.when(F.size("w") > WINDOW, window).alias("win"))
    # most texts repeat no window; only the others are sorted
    df = df.select(*at, F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("win"))
    df = df.select(*at, F.sort_array(F.transform(F.filter("win", lambda p, i: F.coalesce((p["h"] == F.get("win", i - 1)["h"]), F.lit(False)) | F.coalesce((p["h"] == F.get("win", i + 1)["h"]), F.lit(False))), lambda p: p["i"])).alias("win"))
    return df.select(*at, F.coalesce(_covered(F.col("win")), F.lit(0)).cast("long").alias("n_repeat_words"))


def removals(rows: DataFrame, min_texts: int, percent: int) -> DataFrame:
    """(doc_id, host, text_hash, drop): the line hashes to remove from a document, for documents with any."""
    each = rows.select("doc_id", "host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda s: s["h"]))).alias("h"))
    often = each.groupBy("host", "h").agg(F.count_distinct("text_hash").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > min_texts)
    texts = rows.groupBy("host").agg(F.count_distinct("text_hash").alias("texts"))
    # a host has at most 100 / percent times as many such lines as lines in a text
    frequent = often.join(texts, "host").where(100 * F.col("n") > percent * F.col("texts")).select("host", "h", "first")
    salted = frequent.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    hit = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALT)).cast("int")).join(salted, ["host", "h", "salt"])
    return hit.where(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("doc_id", "host", "text_hash").agg(F.collect_set("h").alias("drop"))


def judged(docs: DataFrame, min_texts: int = MIN_TEXTS, percent: int = PERCENT, max_removed: int = 70, min_words: int = 10, max_repeat: int = 20, **cols: str) -> DataFrame:
    """The measured columns, and drop, n_removed (words), base_failed and kept.  Shares are in whole per cent."""
    rows = stored(measured(docs, **cols), "rules")
    drop = removals(rows, min_texts, percent).withColumnsRenamed({"doc_id": "d", "host": "o", "text_hash": "t"})
    on = rows["doc_id"].eqNullSafe(drop["d"]) & (rows["host"] == drop["o"]) & (rows["text_hash"] == drop["t"])
    out = rows.join(drop, on, "left").drop("d", "o", "t")
    lost = F.aggregate(F.filter("lines", lambda s: F.array_contains("drop", s["h"])), F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = out.withColumn("n_removed", F.when(F.col("drop").isNull(), F.lit(0).cast("long")).otherwise(lost)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_removed") <= max_removed * F.col("n_words")))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that stay, boilerplate lines removed from their texts; all columns of the input, in order."""
    verdict = judged(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits).where("kept")
    verdict = verdict.select(F.col("doc_id").alias("_d"), F.col("host").alias("_o"), F.col("text_hash").alias("_t"), F.col("drop").alias("_drop")).distinct()
    host, text = F.coalesce(docs[host_col].cast("string"), F.lit(_NO_HOST)), F.coalesce(docs[text_col], F.lit(""))
    on = docs[id_col].cast("long").eqNullSafe(verdict["_d"]) & (host == verdict["_o"]) & (F.xxhash64(text) == verdict["_t"])
    kept = docs.join(verdict, on)
    rest = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda s: ~F.array_contains("_drop", line_hash(s))), "\n")
    text = F.when(F.col("_drop").isNull(), docs[text_col]).otherwise(rest)
    return kept.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
