"""Language identification with bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of its typical byte n-grams (of ``SIZES`` bytes in lower-cased text, where
everything in ASCII but letters is a space).  The filters are stored bit-sliced: slot s of a slice holds one bit for
each of eight languages, so ``HASHES`` lookups and an AND give all languages that contain an n-gram.  For
a text the hits are counted per language, the expected false positives (from each filter's fill) are taken off,
and the largest share of the n-grams decides.

Learned from a bounded sample: about ``max_docs`` texts, of at most ``max_chars`` characters each, spread
evenly over the languages.  Prediction reads every text whole.

Defined results: ``und`` with score 0 for a null text or one without a letter; ties go to the language with more
training documents, then to the smaller name; a text without any hit gets the language with most documents, at that
language's share of them; without training rows everything is ``und``; a null id counts as not held out and is
not learned from; repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, remainder

SIZES = (2, 3, 4)
HASHES = (2654435769, 2246822519)
BITS = 19
_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> list[np.ndarray]:
    """The n-grams of each size as 32-bit numbers; those with two spaces in a row are left out."""
    a = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in SIZES:
        g = np.zeros(max(0, len(a) - n + 1), np.uint32)
        for k in range(n):
            g = (g << np.uint32(8)) | a[k : len(a) - n + 1 + k]
        out.append(g * np.uint32(4) + np.uint32(n & 3) if n < 4 else g ^ np.uint32(0x9E3779B9))
    return out


def slots(g: np.ndarray, k: int) -> np.ndarray:
    return (g * np.uint32(HASHES[k])) >> np.uint32(32 - BITS)


@dataclass
class Filters:
    langs: list[str]  # by documents, most first
    docs: np.ndarray
    slices: list[list[np.ndarray]]  # for each size, a table of slots for each eight languages
    wrong: np.ndarray  # [sizes, languages] false-positive rates

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected hits of each language, and the number of n-grams."""
        total, n = np.zeros(len(self.langs)), 0
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
        for s, g in enumerate(grams(text)):
            n += len(g)
            where = [slots(g, k) for k in range(len(HASHES))]
            counts = []
            for t in self.slices[s]:
                m = t[where[0]]
                for w in where[1:]:
                    m &= t[w]
                counts.append(np.bincount(m, minlength=256) @ bits)
            c = np.concatenate(counts)[: len(self.langs)]
            total += np.maximum(0, (c - len(g) * self.wrong[s]) / (1 - self.wrong[s]))
        return total, n

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not _LETTER.search(text):
            return "und", 0.0
        h, _ = self.hits(text)
        best = int(h.argmax())
        return (self.langs[best], float(h[best] / h.sum())) if h[best] > 0 else (self.langs[0], float(self.docs[0] / self.docs.sum()))


def build(texts: list[str], langs: list[str], docs: dict[str, int], top: int = 3000, within: float = 3.0) -> Filters:
    """Filters of the n-grams that are among a language's ``top`` most frequent ones of their size and at most
    ``within`` times rarer in it than in any other."""
    names = sorted(docs, key=lambda x: (-docs[x], x))
    slices: list[list[np.ndarray]] = []
    wrong = np.zeros((len(SIZES), len(names)))
    by = {x: [grams(t) for t, y in zip(texts, langs, strict=True) if y == x] for x in names}
    for s in range(len(SIZES)):
        shares = {}
        for x in names:
            g, c = np.unique(np.concatenate([d[s] for d in by[x]] or [np.zeros(0, np.uint32)]), return_counts=True)
            shares[x] = (g, c / max(1, c.sum()), c)
        keys, inv = np.unique(np.concatenate([shares[x][0] for x in names]), return_inverse=True)
        most = np.zeros(len(keys))
        np.maximum.at(most, inv, np.concatenate([shares[x][1] for x in names]))
        tables = [np.zeros(1 << BITS, np.uint8) for _ in range(-(-len(names) // 8))]
        for k, x in enumerate(names):
            g, p, c = shares[x]
            keep = np.lexsort((g, -c))[:top]
            keep = keep[(c[keep] > 1) & (p[keep] * within >= most[np.searchsorted(keys, g[keep])])]
            for h in range(len(HASHES)):
                tables[k // 8][slots(g[keep], h)] |= np.uint8(1 << k % 8)
            wrong[s, k] = min(0.99, float(((tables[k // 8] >> (k % 8)) & 1).mean()) ** len(HASHES))
        slices.append(tables)
    return Filters(names, np.array([docs[x] for x in names], float), slices, wrong)


def train_langid(docs: DataFrame, folds: int = 5, max_docs: int = 6000, max_chars: int = 30_000) -> Filters:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").where((remainder(F.col("doc_id"), folds) != 0) & (F.length("text") <= max_chars))
    # one row a language comes to the driver
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Filters([], np.zeros(0), [], np.zeros((0, 0)))
    each = max(20, max_docs // len(counts))
    share = F.create_map(*[F.lit(v) for x, n in counts.items() for v in (x, min(1.0, each / n))])
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    got = some.select("doc_id", "text", "lang").limit(2 * each * len(counts)).toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return build([r["text"] for r in got], [r["lang"] for r in got], counts)


def predict_langid(docs: DataFrame, filters: Filters, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""

    def predict(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [filters.predict(t) for t in b["text"].to_pylist()]
        return pa.record_batch([b["doc_id"], b["held_out"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return map_batches(id_and_text(docs).withColumn("held_out", held), predict, "doc_id long, held_out boolean, lang_pred string, score double")
