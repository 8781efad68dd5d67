"""Importance resampling towards a target distribution, on sparse counts of hashed word n-grams.

A document's features are its runs of 1 to ``grams`` consecutive words, repeats counted; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo ``buckets``.  The counts are a sparse matrix of documents by buckets, written once as CSR blocks: a row of the
table is a block of documents with their ids, row pointers, bucket numbers and counts.  Its column sums, and those of the target's texts, are
the two distributions; a bucket's gain is the logarithm of their smoothed ratio, in thousandths.  The product of each block with the vector of
gains gives the documents' weights.  Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

What is collected and sent out is one number for each bucket, whatever the number of documents.  Scores are ranked by sorting over all partitions,
with the number of rows before each.

Defined results: a null or empty text has no feature and weight 0; null ids draw as the empty id and come first among ties; repeated
rows are scored, ranked and drawn each by itself; an empty table gives no rows, an empty target gains of the smoothed zero.
"""

from __future__ import annotations

import math
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, stored

GRAMS, BUCKETS = 1, 10_000
SEED, PERCENT, LEAST_WORDS = "2024", 10, 20
#: Features of a block, about: a longer document has a block of its own.
BLOCK = 500_000
#: Words whose buckets a worker remembers.
REMEMBERED = 1_000_000
# bytes 00-2F, 3A-60 and 7B-7F separate words once A-Z are lowered
_SEPARATE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())
BLOCKS = "doc_ids array<long>, n_words array<long>, n_features array<long>, pointers array<long>, columns binary, counts binary"

_known: dict[int, dict[bytes, int]] = {}


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8.  All separators are single bytes, so they can be cut there."""
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def buckets_of(words: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each feature of a text."""
    known = _known.setdefault(buckets, {})
    new = set(words).difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = set(words)
    for w in new:
        known[w] = crc32(w) % buckets
    out = [np.fromiter(map(known.__getitem__, words), np.int32, len(words))]
    for n in range(2, grams + 1):
        runs = (b" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
        out.append(np.fromiter((crc32(r) % buckets for r in runs), np.int32))
    return np.concatenate(out)


def _block(rows: list[tuple], buckets: int) -> dict:
    """One CSR block of (doc_id, words, buckets of its features)."""
    size = np.array([len(r[2]) for r in rows], np.int64)
    at = np.repeat(np.arange(len(rows), dtype=np.int64), size) * buckets + np.concatenate([r[2] for r in rows])
    cell, count = np.unique(at, return_counts=True)
    pointers = np.searchsorted(cell, np.arange(len(rows) + 1, dtype=np.int64) * buckets)
    columns = (cell % buckets).astype("<i4" if buckets > 1 << 16 else "<u2")
    wide = len(count) and count.max() >= 1 << 16
    return {"doc_ids": [r[0] for r in rows], "n_words": [r[1] for r in rows], "n_features": size.tolist(), "pointers": pointers.tolist(), "columns": columns.tobytes(), "counts": count.astype("<i8" if wide else "<u2").tobytes()}


def _arrays(block: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointers, columns, counts) of a block."""
    pointers = np.array(block["pointers"], np.int64)
    columns = np.frombuffer(block["columns"], "<i4" if buckets > 1 << 16 else "<u2")
    wide = len(block["counts"]) == 8 * len(columns)
    return pointers, columns, np.frombuffer(block["counts"], "<i8" if wide else "<u2")


def count_matrix(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """CSR blocks of the counts of documents by buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_words", "n_features", "pointers")], ("columns", pa.binary()), ("counts", pa.binary())])
        rows, held = [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                words = words_of(text.as_py())
                rows.append((doc, len(words), buckets_of(words, grams, buckets)))
                held += len(rows[-1][2]) + 20  # a document without features takes room as well
                if held >= block:
                    yield pa.RecordBatch.from_pylist([_block(rows, buckets)], schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_block(rows, buckets)], schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, BLOCKS)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features of each bucket.  Each task adds up its blocks, so that ``buckets`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for block in b.to_pylist():
                _, columns, counts = _arrays(block, buckets)
                total += np.bincount(columns, counts, buckets).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    sums = blocks.select("pointers", "columns", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: 1,000 times the logarithm of the smoothed shares' ratio, rounded down."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the product of the matrix with the gains."""
    buckets = len(gain)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for block in b.to_pylist():
            pointers, columns, counts = _arrays(block, buckets)
            sums = np.append(0, np.cumsum(counts.astype(np.int64) * gain[columns]))
            for col, v in zip(out, (block["doc_ids"], block["n_words"], block["n_features"], (sums[pointers[1:]] - sums[pointers[:-1]]).tolist()), strict=True):
                col += v
        return pa.record_batch([pa.array(v, pa.int64()) for v in out], names=["doc_id", "n_words", "n_features", "weight"])

    return map_batches(blocks, run, "doc_id long, n_words long, n_features long, weight long")


def _noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise of an id in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, drawn: Column, share: int) -> DataFrame:
    """Add ``rank``, 1 for the highest score (then the smallest doc_id), to ``share`` per cent of the rows for which ``drawn`` holds; null to the others.

    Rows are dealt by ranges of score and id and written; a row's rank is its place in its range and the number of rows before it.
    """
    # rows alike in score and id are told apart, so that many of them can be dealt over several ranges
    told = stored(scored.withColumn("_drawn", drawn).withColumn("_row", F.monotonically_increasing_id()), "scores")
    order = [F.col("score").desc(), F.col("doc_id"), F.col("_row")]
    dealt = stored(told.where("_drawn").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, sizes = 0, []
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        sizes.append((r["_part"], before))
        before += r["count"]
    place = (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).cast("long")
    starts = F.broadcast(scored.sparkSession.createDataFrame(sizes, "_part int, _before long"))  # a row a partition
    high = dealt.join(starts, "_part").withColumn("rank", F.when(place <= share * before // 100, place))
    rest = told.where("not _drawn").withColumn("rank", F.lit(None).cast("long"))
    return high.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resampled(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every document; ``percent`` of those with at least ``least`` words are drawn."""
    blocks = stored(count_matrix(docs, grams, buckets), "counts")
    s = column_sums(blocks, buckets)
    t = column_sums(count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), grams, buckets), buckets)
    scored = weights(blocks, gains(s, t)).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))
    return ranked(scored, F.col("n_words") >= least, percent).select("doc_id", "n_features", "weight", "score", "rank")
