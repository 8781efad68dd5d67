"""Language-model scoring with a hashed maximum-entropy model and class-factored softmax.

1.  ``encoded`` reads each text once and stores the corpus as chunks of a few megabytes: token numbers into the chunk's own
    vocabulary, that vocabulary's hashes, and how often each of its words occurs in training documents.
2.  ``totals`` adds the counts of all chunks up by word.  Only a chunk's distinct words are shuffled, not its tokens.
3.  ``learned_classes`` puts words that stand next to the same frequent words into one class.  The ``TOP`` most frequent words are classed one by
    one, all others, also those that training doesn't have, by their last three bytes.  The neighbours are counted over all training
    documents.
4.  ``train`` fits P(class | context), factored into a softmax over ``WIDE`` groups and one over the ``WIDE`` classes of the word's group.
    Their weights are found by hashing n-gram and skip features of the preceding words, into a table that grows with the vocabulary up to
    ``MOST_ROWS`` rows, so that a task can hold it.  Every training document is used: shards of chunks take AdaGrad steps by themselves from the same start, and
    each weight is averaged over the shards by how much they learned of it, in a tree of two levels.
5.  ``scores`` joins the totals back to the chunks' vocabularies and scores whole chunks in numpy:
    P(word | context) = P(group | context) * P(class | group, context) * (c + 1) / (N_class + V_class + 1), where c is the word's count
    and all words of a class that training doesn't have share one entry.

A token is a lower-cased (A-Z) run of anything but ASCII white space; each document ends with an end token.

Defined results: a null or empty text is its end token; rows with a null id count as not held out but aren't learned from; repeated
rows are learned from and scored as often as they come; without training documents N and V are 0 and all classes are alike; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, remainder, stored, words_of

#: No word has a space.
END = b" "
WIDE, ROWS = 8, 1 << 13
#: Rows of features in the largest table of weights, which has 9 MB.
MOST_ROWS = 1 << 15
CLASSES = WIDE * WIDE
#: Words with a class of their own choice, kinds of endings, and neighbours that are told apart when classes are learned.
TOP, ENDINGS, NEAR = 4096, 4096, 128
#: Neighbours that a rare word or ending is taken to have beside its own, spread as on average.
SMOOTH = 20.0
#: Rows of weights: for each feature's hash one of the groups and one for each group of its classes; then the same for the bias.
_ALL = (ROWS + 1) * (1 + WIDE)
#: Characters of text in a chunk, about; a longer text is a chunk of its own.
CHUNK = 6_000_000
#: Tokens in a step of training and in a slice of scoring.
STEP = 1 << 15
RATE = 0.1
#: Chunks that one shard learns from, about, so that a shard's time does not grow with the corpus.
SHARD = 16
_SLICES = 16
#: Squared gradients that every weight starts with.
SEEN = 0.1
_CHUNKS = "chunk_id long, doc_ids array<long>, train array<boolean>, lens array<int>, ids binary, hashes binary, words array<string>, counts array<int>"


def _pack(ids: np.ndarray) -> bytes:
    """Byte planes, as high bytes are mostly zero."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def word_hash(word: bytes) -> int:
    """20 bits of the word's hash, then 12 of the hash of its last three bytes."""
    return (zlib.crc32(word) & 0xFFFFF000) | (zlib.crc32(word[-3:]) % ENDINGS)


def word_hash_column(word: Column) -> Column:
    """word_hash of a string column."""
    data = word.cast("binary")
    return F.crc32(data).bitwiseAND(F.lit(0xFFFFF000)).bitwiseOR(F.crc32(F.substring(data, -3, 3)) % ENDINGS)


@dataclass(frozen=True)
class Classes:
    """Which class a word is in, by its hash: of the frequent words (sorted by hash) first, else of its ending."""

    top: np.ndarray
    of_top: np.ndarray
    of_ending: np.ndarray

    def units(self, h: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or after them by the ending."""
        h = h.astype(np.int64)
        ending = len(self.top) + h % ENDINGS
        if not len(self.top):
            return ending
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[at] == h, at, ending)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([self.of_top, self.of_ending])[self.units(h)]


def hashed_classes(top: np.ndarray) -> Classes:
    """Before anything is learned."""
    top = np.sort(top.astype(np.int64))
    return Classes(top, top % CLASSES, np.arange(ENDINGS) % CLASSES)


def encode_chunk(rows: list[tuple[int | None, bool, str]]) -> dict:
    """One chunk of (doc_id, train, text) rows; its vocabulary is numbered by falling frequency."""
    every: list[bytes] = []
    lens = []
    for _, _, text in rows:
        words = words_of(text)
        every += words
        every.append(END)
        lens.append(len(words) + 1)
    first = {w: k for k, w in enumerate(dict.fromkeys(every))}
    ids = np.fromiter(map(first.__getitem__, every), np.int64, len(every))
    order = np.argsort(-np.bincount(ids, minlength=len(first)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[ids]
    names = list(first)
    words = [names[k] for k in order.tolist()]
    train = np.array([r[1] for r in rows])
    counts = np.bincount(ids[np.repeat(train, lens)], minlength=len(words))
    hashes = np.fromiter(map(word_hash, words), "<u4", len(words))
    return {"doc_ids": [r[0] for r in rows], "train": train.tolist(), "lens": lens, "ids": _pack(ids), "hashes": hashes.tobytes(), "words": words, "counts": counts}


def encoded(docs: DataFrame, folds: int, held: int, chunk: int = CHUNK) -> DataFrame:
    rest = remainder(F.col("doc_id"), folds)
    rows = id_and_text(docs).select("doc_id", (F.coalesce(rest != held, F.lit(False))).alias("train"), "text")
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()))
    names = [c.split()[0] for c in _CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k, held_rows, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            c = encode_chunk(held_rows) | {"chunk_id": base + k}
            return pa.record_batch([pa.array([c[n]], t) for n, t in zip(names, kinds, strict=True)], names=names)

        for b in batches:
            # text by text, so that a batch isn't held twice
            for k_row in range(b.num_rows):
                held_rows.append(tuple(b[c][k_row].as_py() for c in ("doc_id", "train", "text")))
                size += len(held_rows[-1][2])
                if size >= chunk:
                    yield flush()
                    k, held_rows, size = k + 1, [], 0
        if held_rows:
            yield flush()

    return stored(rows.mapInArrow(run, _CHUNKS), "chunks")


def _vocabulary(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("chunk_id", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def totals(chunks: DataFrame) -> DataFrame:
    """(word, c): how often each word of the training documents occurs there."""
    return stored(_vocabulary(chunks).where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


def frequent(words: DataFrame, top: int = TOP) -> list[tuple[int, int]]:
    """(hash, count) of the most frequent words, most frequent first; words that share a hash count together."""
    got = words.groupBy(word_hash_column(F.col("word")).alias("h")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "h").limit(top)
    return [(r["h"], r["n"]) for r in got.collect()]


def class_counts(words: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""
    # a row for each frequent word or ending: a table of fixed size
    hashes = words.sparkSession.createDataFrame(pd.DataFrame({"h": classes.top}), "h long")
    h = word_hash_column(F.col("word")).alias("h")
    by = words.select(h, "c").groupBy("h").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    by = by.join(F.broadcast(hashes.withColumn("own", F.lit(True))), "h", "left")
    unit = F.when(F.col("own"), F.col("h")).otherwise(F.col("h") % ENDINGS)
    by = by.groupBy(F.coalesce("own", F.lit(False)).alias("own"), unit.alias("h")).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by.collect():
        k = int(classes.of_top[np.searchsorted(classes.top, r["h"])] if r["own"] else classes.of_ending[r["h"]])
        n[k] += r["n"]
        v[k] += r["v"]
    return n, v


def neighbours(row: dict, classes: Classes, near: np.ndarray) -> np.ndarray:
    """[units, 2 * NEAR] counts of the words before and after each training token of a chunk; near are the hashes told apart."""
    vocabulary = np.frombuffer(row["hashes"], "<u4").astype(np.int64)
    order = np.argsort(near)
    at = np.minimum(np.searchsorted(near, vocabulary, sorter=order), len(near) - 1) if len(near) else np.zeros(len(vocabulary), np.int64)
    own = order[at] if len(near) else at
    beside = np.where(near[own] == vocabulary, own, NEAR - 1) if len(near) else np.full(len(vocabulary), NEAR - 1)
    ids = _unpack(row["ids"])
    lens = np.array(row["lens"], np.int64)
    learn = np.repeat(np.array(row["train"], bool), lens)
    doc = np.repeat(np.arange(len(lens)), lens)
    pair = learn[1:] & (doc[1:] == doc[:-1])
    u, c = classes.units(vocabulary)[ids], beside[ids]
    size = (len(classes.top) + ENDINGS) * 2 * NEAR
    cells = np.concatenate([(u[1:] * 2 * NEAR + c[:-1])[pair], (u[:-1] * 2 * NEAR + NEAR + c[1:])[pair]])
    return np.bincount(cells, minlength=size).reshape(-1, 2 * NEAR)


def cluster(m: np.ndarray, rounds: int = 15) -> np.ndarray:
    """A class for each row of counts: spherical k-means on square roots of smoothed shares, from the heaviest rows on.  Classes are
    numbered along the first principal axis of their centres, so that a group has classes that are alike."""
    mass = m.sum(1)
    average = m.sum(0) / max(1.0, m.sum())
    x = np.sqrt((m + SMOOTH * average) / (mass + SMOOTH)[:, None])
    weight = (mass + 1e-9)[:, None]
    heavy = np.argsort(-mass, kind="stable")[:CLASSES]
    centres = x[heavy].copy()
    for _ in range(rounds):
        k = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, k, x * weight)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-6, total / np.maximum(size, 1e-6), centres)
    axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    rank = np.empty(CLASSES, np.int64)
    rank[np.argsort(centres @ axis, kind="stable")] = np.arange(CLASSES)
    return rank[k]


def learned_classes(chunks: DataFrame, words: DataFrame, shards: int) -> Classes:
    most = frequent(words)
    start = hashed_classes(np.array([h for h, _ in most], np.int64))
    if not most:
        return start
    near = np.array([h for h, _ in most[: NEAR - 1]], np.int64)

    def count(rows: Iterator[dict]) -> np.ndarray | None:
        total = None
        for row in rows:
            got = neighbours(row, start, near)
            total = got if total is None else total + got
        return None if total is None else total.astype(np.float32)

    m = _gathered(chunks, shards, count, lambda parts: np.sum([np.frombuffer(p, np.float32) for p in parts], axis=0))
    if m is None:
        return start
    k = cluster(np.frombuffer(m, np.float32).reshape(-1, 2 * NEAR).astype(np.float64))
    return Classes(start.top, k[: len(start.top)], k[len(start.top) :])


def _gathered(chunks: DataFrame, shards: int, fn: Callable[[Iterator[dict]], np.ndarray | None], merge: Callable[[list[bytes]], np.ndarray]) -> bytes | None:
    """An array of fixed size from each shard of chunks, cut into slices that are merged in a tree of two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = fn(row for b in batches for row in b.to_pylist())
        if got is not None:
            own = TaskContext.get().partitionId()
            for k, part in enumerate(np.array_split(got, _SLICES)):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([own], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "shard", "data"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "shard": part["shard"].iloc[:1], "data": [merge(list(part["data"])).tobytes()]})

    schema = "slice int, shard int, data binary"
    got = chunks.select("train", "lens", "ids", "hashes").coalesce(shards).mapInArrow(run, schema)
    group = F.pmod("shard", F.lit(max(1, int(shards**0.5)))).alias("group")
    got = got.groupBy("slice", group).applyInPandas(merged, schema).groupBy("slice").applyInPandas(merged, schema)
    rows = sorted(got.select("slice", "data").collect(), key=lambda r: r["slice"])
    return b"".join(bytes(r["data"]) for r in rows) if rows else None


def features(h: np.ndarray, lens: np.ndarray, size: int = ROWS) -> np.ndarray:
    """[tokens, 4] rows of weights: the last word, the last two, and the ones two and three back alone (skips).  Before a document's
    first word stands a start mark."""
    start = np.cumsum(lens) - lens
    at = np.arange(len(h)) - np.repeat(start, lens)
    prev = []
    for k in (1, 2, 3):
        p = np.full(len(h), 0x5EED0000 + k, np.uint64)
        p[k:] = np.where(at[k:] >= k, h[:-k], p[k:])
        prev.append(p)
    mix = lambda x, salt: ((x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(40)) & np.uint64(size - 1)
    return np.stack([mix(prev[0], 1), mix(prev[0] * np.uint64(31) + (prev[1] << np.uint64(17)), 2), mix(prev[1], 3), mix(prev[2], 4)], 1).astype(np.int32)


def rows_of(f: np.ndarray, target: np.ndarray, size: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """([5, 2 * tokens] rows of weights, [2 * tokens] targets): first the choices of groups, then those of classes in them."""
    full = np.concatenate([f, np.full((len(f), 1), size, f.dtype)], 1).T
    group, own = (target // WIDE).astype(f.dtype), target % WIDE
    below = (size + 1) + full * WIDE + group
    return np.concatenate([full, below], 1), np.concatenate([group, own])


def _size(w: np.ndarray) -> int:
    """Rows of a table that features are hashed to."""
    return len(w) // (1 + WIDE) - 1


def log_softmax(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """[WIDE, choices] of natural logarithms."""
    z = w[rows[0]]
    for r in rows[1:]:
        z += w[r]
    z = np.ascontiguousarray(z.T)
    z -= z.max(0)
    z -= np.log(np.exp(z).sum(0))
    return z


def log_probability(w: np.ndarray, f: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's class."""
    rows, t = rows_of(f, target, _size(w))
    z = log_softmax(w, rows)[t, np.arange(len(t))]
    return z[: len(f)] + z[len(f) :]


def descend(w: np.ndarray, seen: np.ndarray, f: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on a batch of tokens, in place."""
    rows, t = rows_of(f, target, _size(w))
    # only the rows that the batch has, together, so that they stay in the processor's cache
    there = np.zeros(len(w), bool)
    there[rows.ravel()] = True
    used = np.flatnonzero(there)
    place = np.empty(len(w), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = place[rows]
    own = w[used]
    g = np.exp(log_softmax(own, rows))
    g[t, np.arange(len(t))] -= 1
    at = rows.ravel()
    d = np.stack([np.bincount(at, np.tile(g[k], len(rows)), len(used)) for k in range(WIDE)], 1).astype(np.float32)
    total = seen[used] + d * d
    seen[used] = total
    w[used] = own - RATE * d / (np.sqrt(total) + 1e-3)


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the chunk's tokens, their numbers, documents' lengths)."""
    ids = _unpack(row["ids"])
    return np.frombuffer(row["hashes"], "<u4").astype(np.uint64)[ids], ids, np.array(row["lens"], np.int64)


def start_weights(n: np.ndarray, size: int = ROWS) -> np.ndarray:
    """Zero but for the bias: how often each group, and each class within its group, occurs."""
    w = np.zeros(((size + 1) * (1 + WIDE), WIDE), np.float32)
    by = n.reshape(WIDE, WIDE) + 1
    w[size] = np.log(by.sum(1) / by.sum())
    w[size + 1 + size * WIDE :] = np.log(by / by.sum(1, keepdims=True))
    return w


def table_size(vocabulary: float) -> int:
    """Rows for a vocabulary: a power of two from 2^13 to MOST_ROWS, at least one row for four words below that."""
    size = ROWS
    while size < MOST_ROWS and size * 4 < vocabulary:
        size *= 2
    return size


def learned(w: np.ndarray, begin: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """[rows, WIDE + 1] half-precision numbers: what a shard changed of each row of weights, and how much it learned of that row (the
    root of its mean squared gradients, 0 if it never met the row)."""
    much = np.sqrt(np.maximum((seen - np.float32(SEEN)).mean(1, keepdims=True), 0))
    return np.concatenate([w - begin, np.minimum(much, 6e4)], 1).astype(np.float16)


def averaged(parts: list[bytes]) -> np.ndarray:
    """Each row's changes, averaged by how much the shards learned of it; together they learned the root of the sum of squares."""
    change, weight = 0.0, 0.0
    for p in parts:
        x = np.frombuffer(p, np.float16).reshape(-1, WIDE + 1).astype(np.float32)
        k = x[:, WIDE:] ** 2
        change, weight = change + x[:, :WIDE] * k, weight + k
    return np.concatenate([change / np.maximum(weight, 1e-12), np.minimum(np.sqrt(weight), 6e4)], 1).astype(np.float16)


def train(chunks: DataFrame, n: np.ndarray, classes: Classes, shards: int, size: int = ROWS) -> np.ndarray:
    """The averaged weights after one pass over all training documents."""
    begin = chunks.sparkSession.sparkContext.broadcast(start_weights(n, size))

    def shard(rows: Iterator[dict]) -> np.ndarray | None:
        w = begin.value.copy()
        seen = np.full_like(w, SEEN)
        tokens = 0
        for row in rows:
            h, ids, lens = _tokens(row)
            f, learn = features(h, lens, size), np.repeat(np.array(row["train"], bool), lens)
            target = classes(np.frombuffer(row["hashes"], "<u4"))[ids]
            f, target = f[learn], target[learn]
            for at in range(0, len(f), STEP):
                descend(w, seen, f[at : at + STEP], target[at : at + STEP])
            tokens += len(f)
        return learned(w, begin.value, seen) if tokens else None

    got = _gathered(chunks, shards, shard, averaged)
    w = begin.value.copy()
    if got is not None:
        w += np.frombuffer(got, np.float16).reshape(-1, WIDE + 1)[:, :WIDE].astype(np.float32)
    return w


def score_chunk(row: dict, counts: np.ndarray, w: np.ndarray, n: np.ndarray, v: np.ndarray, classes: Classes | None = None) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of the chunk's documents; counts are by the chunk's word numbers.  Without classes words are
    classed by hash."""
    h, ids, lens = _tokens(row)
    first = np.cumsum(lens) - lens
    c = counts[ids]
    k = (h % np.uint64(CLASSES)).astype(np.int64) if classes is None else classes(np.frombuffer(row["hashes"], "<u4"))[ids]
    base = np.log10((c + 1) / (n.sum() + v.sum() + 1))
    model = np.log((c + 1) / (n + v + 1)[k])
    for at in range(0, len(h), STEP):
        # the features of a slice need the three tokens before it
        lo = max(0, at - 3)
        part = slice(at, min(len(h), at + STEP))
        model[part] += log_probability(w, _slice_features(h, first, lens, lo, part.stop, _size(w))[at - lo :], k[part])
    add = lambda x: np.add.reduceat(x, first)
    return lens, add((c > 0).astype(np.int64)), add(base), add(model) / np.log(10)


def _slice_features(h: np.ndarray, first: np.ndarray, lens: np.ndarray, lo: int, hi: int, size: int = ROWS) -> np.ndarray:
    """features() of tokens lo to hi; from the fourth on they are as in the whole chunk, and from the first if lo is 0."""
    a, b = int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi, "left"))
    bounds = np.clip(np.append(first[a:b], first[b - 1] + lens[b - 1]), lo, hi)
    return features(h[lo:hi], np.diff(bounds), size)


def scores(docs: DataFrame, folds: int = 7, held: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    chunks = encoded(docs, folds, held, chunk)
    words = totals(chunks)
    # chunks that one shard learns from are bounded, so shards grow with the corpus
    shards = -(-chunks.count() // SHARD) or 1
    classes = learned_classes(chunks, words, shards)
    n, v = class_counts(words, classes)
    model = spark.sparkContext.broadcast((train(chunks, n, classes, shards, table_size(v.sum())), n, v, classes))
    known = _vocabulary(chunks.select("chunk_id", "words", "counts")).select("chunk_id", "pos", "word").join(words, "word")
    # as many entries as the chunk has words
    known = known.groupBy("chunk_id").agg(F.collect_list(F.struct("pos", "c")).alias("known"))
    joined = chunks.select("chunk_id", "doc_ids", "train", "lens", "ids", "hashes").join(known, "chunk_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, v, classes = model.value
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b[c][k].as_py() for c in ("doc_ids", "train", "lens", "ids", "hashes")}
                counts = np.zeros(len(row["hashes"]) // 4, np.int64)
                if (got := b["known"][k]).is_valid:
                    counts[got.values.field("pos").to_numpy()] = got.values.field("c").to_numpy()
                lens, n_known, base, score = score_chunk(row, counts, w, n, v, classes)
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["train"]), pa.array(lens), pa.array(n_known), pa.array(np.full(len(lens), int(n.sum()))), pa.array(base), pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = joined.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
