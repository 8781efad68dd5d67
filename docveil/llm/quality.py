"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes become a few fixed channels each (letter case, digits, space, punctuation,
non-ASCII, a hash of the byte, and whether the byte continues a near repetition).  Learned filters run over
the whole document; their rectified outputs are max-pooled in overlapping chunks of ``2 * HOP`` bytes, the
chunks' features are averaged and max-pooled over the document, and a logistic unit combines them.

The network is fitted on the driver, on a bounded sample of labelled rows (``max_rows`` rows with texts
of at most ``max_chars`` characters, those with the smallest hashes).  Scoring reads every byte of every text,
in slices of ``SLICE`` bytes, so its memory does not grow with a text's length.

Defined results: a null or empty text is scored as one empty chunk; rows with a null id are scored, count as
not held out and are never learned from; without labelled rows every score is 0.5; repeated rows are
scored each; labels that disagree on one id count as the larger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, remainder

WIDTH, STRIDE, HOP, FILTERS = 8, 4, 128, 24
SLICE = 1 << 15
LAGS = 32
CHANNELS = 12


def _channels() -> np.ndarray:
    """[256, CHANNELS] float32; the repetition channel (6) is filled in for each byte, byte 0 is padding."""
    b = np.arange(256)
    c = np.zeros((256, CHANNELS), np.float32)
    c[:, 0] = (b >= 65) & (b <= 90)
    c[:, 1] = (b >= 97) & (b <= 122)
    c[:, 2] = (b >= 48) & (b <= 57)
    c[:, 3] = (b == 32) | ((b >= 9) & (b <= 13))
    c[:, 4] = (b > 32) & (b < 127) & ~(c[:, 0] + c[:, 1] + c[:, 2]).astype(bool)
    c[:, 5] = b >= 128
    c[:, 7] = b == 10
    for k in range(4):  # four fixed pseudo-random signs tell bytes apart
        c[:, 8 + k] = (((b * 2654435761 + k * 40503) >> (5 + 3 * k)) & 1) * 0.5 - 0.25
    c[0] = 0
    return c


_CHANNELS = _channels()


def repeated(x: np.ndarray) -> np.ndarray:
    """1 where the eight bytes up to here equal those some ``lag`` <= LAGS bytes before."""
    out = np.zeros(len(x), bool)
    for lag in range(1, LAGS + 1):
        if len(x) <= lag + 8:
            break
        eq = x[lag:] == x[:-lag]
        eq = eq[1:] & eq[:-1]
        eq = eq[2:] & eq[:-2]
        eq = eq[4:] & eq[:-4]
        out[lag + 7 :] |= eq
    return out & (x > 0)


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each padded to whole blocks of HOP; and the first block of each."""
    sizes = np.array([max(1, -(-len(t) // HOP)) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    x = np.zeros(int(sizes.sum()) * HOP, np.uint8)
    for t, at in zip(texts, first.tolist(), strict=True):
        x[at * HOP : at * HOP + len(t)] = np.frombuffer(t, np.uint8)
    return x, first


def _features(x: np.ndarray) -> np.ndarray:
    """[len(x) / STRIDE + tail, STRIDE * CHANNELS]"""
    f = _CHANNELS[x]
    f[:, 6] = repeated(x)
    f = np.concatenate([f, np.zeros((WIDTH, CHANNELS), np.float32)])
    return f.reshape(-1, STRIDE * CHANNELS)


@dataclass
class Network:
    kernel: np.ndarray  # [WIDTH / STRIDE, STRIDE * CHANNELS, FILTERS]
    bias: np.ndarray  # [FILTERS]
    top: np.ndarray  # [2 * FILTERS + 1]
    base: float

    def convolve(self, f: np.ndarray) -> np.ndarray:
        n = len(f) - WIDTH // STRIDE
        out = f[:n] @ self.kernel[0]
        for j in range(1, WIDTH // STRIDE):
            out += f[j : j + n] @ self.kernel[j]
        out += self.bias
        return np.maximum(out, 0, out=out)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        """[len(x) / HOP, FILTERS]: the filters' maxima in each block, slice by slice.  A slice also sees LAGS + 8 bytes
        before it and WIDTH bytes after it, so slicing changes nothing."""
        parts = []
        before = -(-(LAGS + 8) // STRIDE) * STRIDE
        for at in range(0, len(x), SLICE):
            lo, hi = max(0, at - before), min(len(x), at + SLICE)
            f = _features(x[lo : min(len(x), hi + WIDTH)])
            out = self.convolve(f)[(at - lo) // STRIDE : (hi - lo) // STRIDE]
            parts.append(out.reshape(-1, HOP // STRIDE, FILTERS).max(1))
        return np.concatenate(parts)

    def document(self, blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([documents, 2 * FILTERS + 1] features, [blocks, FILTERS] chunk maxima): a chunk is a block and the next one."""
        nxt = np.minimum(np.arange(1, len(blocks) + 1), np.repeat(np.append(first[1:], len(blocks)) - 1, np.diff(np.append(first, len(blocks)))))
        chunk = np.maximum(blocks, blocks[nxt])
        n = np.diff(np.append(first, len(blocks)))[:, None]
        return np.concatenate([np.add.reduceat(chunk, first) / n, np.maximum.reduceat(chunk, first), np.log(n) / 4], 1), chunk

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, first = lay_out(texts)
        z = self.document(self.blocks(x), first)[0].astype(np.float64) @ self.top + self.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Minibatch Adam on the logistic loss; None without rows."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    k = WIDTH // STRIDE
    net = Network(rng.normal(0, 0.25, (k, STRIDE * CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1), 0.0)
    mean = float(np.clip(labels.mean(), 0.02, 0.98))
    net.base = float(np.log(mean / (1 - mean)))
    net.top = rng.normal(0, 0.05, 2 * FILTERS + 1)
    names = ("kernel", "bias", "top", "base")
    mom = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, first = lay_out([texts[i] for i in rows])
            f = _features(x)
            conv = net.convolve(f)[: len(x) // STRIDE].reshape(-1, HOP // STRIDE, FILTERS)
            where = conv.argmax(1)
            blocks = np.take_along_axis(conv, where[:, None], 1)[:, 0]
            feats, chunk = net.document(blocks, first)
            p = 1 / (1 + np.exp(-np.clip(feats @ net.top + net.base, -30, 30)))
            err = (p - labels[rows]) / len(rows)
            grad = {"top": feats.T @ err + 1e-4 * net.top, "base": err.sum()}
            # back through the mean and the maximum over chunks, to the block that gave each chunk's maximum
            n = np.diff(np.append(first, len(blocks)))
            doc = np.repeat(np.arange(len(rows)), n)
            g = (err / n)[doc, None] * net.top[:FILTERS]
            is_top = chunk == feats[doc, FILTERS : 2 * FILTERS]
            ties = np.add.reduceat(is_top, first, dtype=np.float64)
            g = g + is_top * (err[doc, None] * net.top[FILTERS : 2 * FILTERS]) / ties[doc]
            last = np.append(first[1:], len(blocks)) - 1
            nxt = np.minimum(np.arange(1, len(blocks) + 1), last[doc])
            from_next = blocks[nxt] > blocks
            gb = np.where(from_next, 0, g)
            np.add.at(gb, nxt, np.where(from_next, g, 0))
            gb = (gb * (blocks > 0)).astype(np.float32)
            pos = where + (np.arange(len(blocks)) * (HOP // STRIDE))[:, None]
            gk = np.stack([np.einsum("bfc,bf->cf", f[pos + j], gb) for j in range(k)])
            grad |= {"kernel": gk + 1e-5 * net.kernel, "bias": gb.sum(0)}
            step += 1
            for name in names:
                m, v = mom[name]
                gr = np.asarray(grad[name])
                m = mom[name][0] = 0.9 * m + 0.1 * gr
                v = mom[name][1] = 0.999 * v + 0.001 * gr * gr
                lr = rate * (1 - epoch / epochs) * (5 if name in ("top", "base") else 1)
                new = getattr(net, name) - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, float(new) if name == "base" else new.astype(getattr(net, name).dtype))
    return net


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 2000, max_chars: int = 30_000) -> Network | None:
    """Fit on at most ``max_rows`` labelled rows whose remainder by ``folds`` is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(remainder(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows small rows are broadcast
    rows = id_and_text(docs).where(F.length("text") <= max_chars).join(F.broadcast(some), "doc_id").limit(2 * max_rows).select("doc_id", F.encode("text", "UTF-8").alias("b"), "quality").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["b"]))
    return fit([r["b"] for r in rows], np.array([float(r["quality"] > 0) for r in rows]))


def score_quality(docs: DataFrame, net: Network | None, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
        s = np.full(len(texts), 0.5) if net is None else net.score(texts)
        return pa.record_batch([b["doc_id"], b["held_out"], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return map_batches(id_and_text(docs).withColumn("held_out", held), score, "doc_id long, held_out boolean, score double, predicted int")
