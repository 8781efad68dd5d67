"""SimHash near-duplicates by anchor-point covering.

Blocks of 31 bits are read from a fingerprint, two from each of its 64-bit words.  Over a block, the anchors are the words of the
binary [31, 26] Hamming code, whose covering radius is 1.  If two blocks differ in at most t bits, some word lies within ceil(t / 2)
bits of both (the threshold is shared out between them), and the anchor next to that word lies within 1 + ceil(t / 2) bits of both: so
each fingerprint is replicated to all anchors within covering radius plus its share of the threshold, and compared with those at the same
anchor.  Of 2^26 anchors in a block these are at most 16 for t = 2.

``near_duplicates`` links fingerprints of one word at most ``near`` of whose 64 bits differ.  At least one of the two blocks then differs
in at most near // 2 bits (two bits of the 64 are in neither block, which loses nothing), so nothing is missed.

``alike`` links texts whose shingle sets have a Jaccard similarity of 0.8 or more.  One word only estimates that, so a fingerprint has
``WORDS`` of them and ``2 * WORDS`` blocks, with t = 2 in each: at a similarity of 0.8 a pair meets at some anchor with a probability of
0.92, at 0.85 of 0.98, at 0.9 of over 0.999.  Where ``CHECK`` or fewer bits of two other words than the block's differ, they are candidates,
and the shingle sets decide.  Of pairs of unrelated texts one in 20,000 meets at an anchor and one in 150 million holds that check, independently, so that candidates
do not run together to one component by chance however large the corpus is.  Texts with the same words are one node from the start; others are never
joined without comparing their sets.

An anchor's fingerprints are compared by absorption: a fingerprint takes up all that are near it and these are not
compared again with what is taken, so a dense group costs a few passes and yields a spanning set of links, not all pairs.
Anchors with more than ``GROUP`` fingerprints are dealt out as pairs of parts, so that no task holds more than two parts.
Where links are verified by the texts, a spanning set doesn't do: groups that fall apart are compared again, pair by pair.
Connected components come from alternating large-star and small-star steps over the links, in the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other (to ``alike`` they have no words and are one node);
repeated rows come out as often as they come in; a component's id is its smallest non-null document id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, stored, words_of

NEAR = 4
SEED = 42
BLOCK = 31
#: Words of a wide fingerprint, and how many bits of the two words checked may differ: texts that are 0.8 alike differ in more once in a thousand times.
WORDS, CHECK = 6, 32
#: How many bits of the first word may differ where the members of a group that fell apart are compared: once in a hundred times more do.
FIRST = 16
#: Fingerprints of one anchor that a task compares at most with as many others.
GROUP = 1_000_000
#: Shingles that a task compares at most with as many others, about.
PART = 100_000
_MASK = (1 << BLOCK) - 1


def _majority(h: np.ndarray) -> int:
    """The word whose bits are 1 where they are in over half of h (unsigned, 64 bits)."""
    # one byte a bit, eight of them added at once, 255 rows before a byte can overflow
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle, joined by spaces; of all words where there are fewer."""
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(data, SEED)] if words else [], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    return np.array([digest(data[s:e], SEED) for s, e in zip(start, end, strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit fingerprint, unsigned: a bit is 1 if it is set in over half of the shingles' XXH64 values."""
    h = _hashes(words_of(text), shingle)
    return _majority(h) if len(h) else 0


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits of each hash: the finishing steps of a multiply-shift generator."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(s: np.ndarray) -> list[int]:
    """``WORDS`` signed words for a set of shingle hashes; zeros for none."""
    if not len(s):
        return [0] * WORDS
    words = [_majority(s.view(np.uint64))] + [_majority(_mixed(s.view(np.uint64), k)) for k in range(1, WORDS)]
    return np.array(words, np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash): fp is the fingerprint as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
        return pa.record_batch([b["doc_id"], pa.array(fp), b["text_hash"]], names=["doc_id", "fp", "text_hash"])

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, fp long, text_hash long")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, sorted."""
    return np.unique(_hashes(words_of(text), shingle)).view(np.int64)


def signatures(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, f): node is the hash of the text's words, f the wide fingerprint."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        nodes, fs = [], []
        for t in b["text"].to_pylist():
            words = words_of(t)
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            fs.append(wide_fingerprint(np.unique(_hashes(words, shingle))))
        node = np.array(nodes, np.uint64).view(np.int64)
        return pa.record_batch([b["doc_id"], b["text_hash"], pa.array(node), pa.array(fs, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "f"])

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, node long, f array<long>")


def reach(near: int) -> int:
    """How far an anchor may be from a block: the covering radius and this side's share of the block's threshold."""
    return 1 + -(-(near // 2) // 2)


def _offsets(radius: int) -> list[list[int]]:
    """By syndrome: what to add to a block for each anchor within ``radius`` bits.  The syndrome is the sum, without carries, of
    the numbers 1 to 31 of the bits that are set; an anchor is a block with syndrome zero."""
    out: list[list[int]] = [[] for _ in range(BLOCK + 1)]
    for k in range(radius + 1):
        for at in combinations(range(1, BLOCK + 1), k):
            syndrome = mask = 0
            for i in at:
                syndrome ^= i
                mask |= 1 << (i - 1)
            out[syndrome].append(mask)
    return out


def anchors_of(half: Column, block: Column, near: int = NEAR) -> Column:
    """Array of the anchors within reach of a 31-bit block; the block's number is in the bits from 31 on."""
    parity = [sum(1 << (i - 1) for i in range(1, BLOCK + 1) if i >> k & 1) for k in range(5)]
    syndrome = sum(F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(m))) % 2, k) for k, m in enumerate(parity))
    rows = (",".join(f"{m}L" for m in row) for row in _offsets(reach(near)))
    table = F.expr(f"array({','.join(f'array({r})' for r in rows)})")
    own = half.bitwiseOR(F.shiftleft(block.cast("long"), BLOCK))
    return F.transform(F.element_at(table, syndrome.cast("int") + 1), lambda m: own.bitwiseXOR(m))


def _halves(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit(_MASK)), F.shiftright(fp, BLOCK).bitwiseAND(F.lit(_MASK))]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of words, or of rows of words."""
    n = np.bitwise_count(a ^ b)
    return n.sum(-1, dtype=np.int64) if n.ndim > 1 else n


def absorb(f: np.ndarray, near: int = NEAR, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links, by positions in f (unsigned, or rows of such), that join what is joined by differences of at most ``near`` bits: at most len(f) - 1.

    Equal labels are joined already.
    """
    links = []
    at, left = np.arange(len(f)), f

    def take(hit: np.ndarray) -> list[int]:
        nonlocal at, left
        got = at[hit].tolist()
        at, left = at[~hit], left[~hit]
        return got

    while len(left) > 1:
        todo = take(label[at] == label[at[0]]) if label is not None else take(np.arange(len(at)) == 0)
        while todo and len(left):
            x = todo.pop()
            hit = _apart(left, f[x][None]) <= near
            if not hit.any():
                continue
            if label is None:
                got = take(hit)
                links += [(x, y) for y in got]
            else:
                found, first = np.unique(label[at[hit]], return_index=True)
                links += [(x, int(y)) for y in at[hit][first]]
                got = take(np.isin(label[at], found))
            todo += got
    return links


def links_of(key: np.ndarray, f: np.ndarray, near: int = NEAR, label: np.ndarray | None = None, small: int = 12) -> np.ndarray:
    """[links, 2] of positions, in whole groups of equal keys, sorted by key.  All pairs of small groups are tried, larger ones absorbed."""
    out = [np.zeros((0, 2), np.int64)]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    group = np.repeat(size, size)
    for shift in range(1, small):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & (group[shift:] <= small)) if len(key) > shift else []
        if not len(i):
            break
        i = i[_apart(f[i], f[i + shift]) <= near]
        i = i if label is None else i[label[i] != label[i + shift]]
        out.append(np.stack([i, i + shift], 1))
    for g in np.flatnonzero(size > small):
        part = slice(first[g], first[g] + size[g])
        links = absorb(f[part], near, None if label is None else label[part])
        out.append(first[g] + np.array(links, np.int64).reshape(-1, 2))
    return np.concatenate(out)


def linked(points: DataFrame, halves: list[Column], t: int, near: int, checks: list[list[Column]] | None = None, label: str | None = None, group: int = GROUP) -> DataFrame:
    """(src, dst): links between nodes that meet at an anchor of some block and have at most ``near`` differing bits in that block's ``checks``.

    These are words of the fingerprint for each block; without them it is the node itself.

    They have the same components as all such pairs; nodes of one label are joined already, and two labels get one link.
    """
    words = [f"check{k}" for k in range(len(checks[0]))] if checks else ["node"]
    own = ["node"] + ([label] if label else [])
    carried = list(dict.fromkeys(own + words))
    each = [F.struct(half.alias("half"), *[c.alias(w) for c, w in zip(cs, words, strict=True)]) for half, cs in zip(halves, checks, strict=True)] if checks else [F.struct(half.alias("half")) for half in halves]
    blocks = points.select(*own, F.posexplode(F.array(*each)).alias("block", "_b")).select(*own, "block", "_b.*")
    dealt = blocks.select(*carried, F.explode(anchors_of(F.col("half"), F.col("block"), 2 * t)).alias("key"))
    # halves within reach of an anchor: it can hold more than ``group`` only if one of these has over a share of that many
    ball = sum(math.comb(BLOCK, k) for k in range(reach(2 * t) + 1))
    busy = blocks.groupBy("block", "half").count().where(F.col("count") > group // ball)
    if not busy.isEmpty():
        suspects = busy.select(F.explode(anchors_of(F.col("half"), F.col("block"), 2 * t)).alias("key")).distinct()
        parts = dealt.join(suspects, "key").groupBy("key").count().where(F.col("count") > group).select("key", F.ceil(F.col("count") / group).cast("int").alias("n"))
        own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64("key", F.least(i, own), F.greatest(i, own)))
        dealt = dealt.join(parts, "key", "left").select(*carried, F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(pairs)).alias("key"))
    names = ["src", "dst"] + (["ls", "ld"] if label else [])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            key, node, own, *fs = (np.concatenate(c) for c in zip(*held, strict=True))
            f = (fs[0] if len(fs) == 1 else np.stack(fs, 1)).view(np.uint64)
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last group may go on
            i = links_of(key[:cut], f[:cut], near, own[:cut] if label else None)
            # sorted by label, or by node: each two once
            i = np.where((own[i[:, :1]] > own[i[:, 1:]]), i[:, ::-1], i)
            ends = own[i]
            _, one = np.unique(ends, axis=0, return_index=True)
            cols = [node[i[one, 0]], node[i[one, 1]]] + ([ends[one, 0], ends[one, 1]] if label else [])
            for at in range(0, len(one), 10_000):
                yield pa.record_batch([pa.array(c[at : at + 10_000]) for c in cols], names=names)
            held = [[c[cut:] for c in (key, node, own, *fs)]]
            n = 0

        for b in batches:
            held.append([b[c].to_numpy() for c in ("key", "node", label or "node", *words)])
            n += b.num_rows
            if n >= 200_000:
                yield from flush(False)
        if held:
            yield from flush(True)

    parted = dealt.repartition("key").sortWithinPartitions("key", "node")
    links = parted.select("key", *carried).mapInArrow(compare, ", ".join(f"{c} long" for c in names))
    if not label:
        return links.distinct()
    return links.groupBy("ls", "ld").agg(F.min(F.struct("src", "dst")).alias("l")).select("l.src", "l.dst")


def near_links(fps: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(src, dst) for a column fp of distinct fingerprints: links that have the same components as all pairs within ``near`` bits.

    Replicas grow fast with ``near``: 2 * 16 to 5 bits, 2 * 156 to 9.
    """
    if not 0 <= near <= 9:
        raise ValueError("near is from 0 to 9 bits")
    return linked(fps.select(F.col("fp").alias("node")), _halves(F.col("node")), near // 2, near, group=group)


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of its component, for each other node that has a link."""
    edges = stored(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), name)
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(small, "u")
        edges = stored(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.withColumnRenamed("m", "v")).distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _row(text_hash: Column) -> Column:
    """Tells rows of one text apart by their ids, so that copies don't meet."""
    return F.xxhash64("doc_id", text_hash).alias("row")


def shingles_of(links: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, check, s): the shingle sets of the nodes (node, check, row) that have a link; row tells the one document to read."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes, "node")
    texts = id_and_text(docs).select("text", _row(F.xxhash64("text"))).join(ends, "row").select("node", "check", "text").dropDuplicates(["node"])

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b["node"], b["check"], pa.array([shingle_set(t, shingle) for t in b["text"].to_pylist()], pa.list_(pa.int64()))], names=["node", "check", "s"])

    return stored(map_batches(texts, sets, "node long, check long, s array<long>"), "shingles")


def verified(links: DataFrame, has: DataFrame, similarity: float) -> DataFrame:
    """Links whose shingle sets have at least this Jaccard similarity."""
    both = links.join(has.select(F.col("node").alias("src"), F.col("s").alias("a")), "src").join(has.select(F.col("node").alias("dst"), F.col("s").alias("b")), "dst")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("src", "dst")


def joining(node: np.ndarray, check: np.ndarray, label: np.ndarray, flat: np.ndarray, size: np.ndarray, near: int, similarity: float) -> list[tuple[int, int]]:
    """Links of nodes that join labels as all pairs do whose words (check) are within ``near`` bits and which have this similarity.

    ``flat`` holds the shingle sets, ``size`` members each, one after the other.  What is joined already is not compared.
    """
    number, flat = np.unique(flat, return_inverse=True)
    first = np.cumsum(size) - size
    label, bits = label.copy(), check.view(np.uint64)
    mark = np.zeros(len(number), bool)
    links = []
    for x in range(len(node) - 1):
        rest = slice(x + 1, None)
        y = x + 1 + np.flatnonzero((label[rest] != label[x]) & (np.bitwise_count(bits[rest] ^ bits[x]) <= near))
        # no two sets are more alike than the smaller is to the larger
        y = y[np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x])]
        if not len(y):
            continue
        own = flat[first[x] : first[x] + size[x]]
        mark[own] = True
        n, start = size[y], np.cumsum(size[y]) - size[y]
        at = np.repeat(first[y] - start, n) + np.arange(n.sum())
        # an empty set has no member to sum up and is like another empty one only
        common = np.bincount(np.repeat(np.arange(len(y)), n), mark[flat[at]], len(y))
        mark[own] = False
        for z in y[common >= similarity * (size[x] + n - common)].tolist():
            if label[z] != label[x]:
                links.append((int(node[x]), int(node[z])))
                label[label == label[z]] = label[x]
    return links


def unspanned(links: DataFrame, kept: DataFrame, has: DataFrame, near: int, similarity: float, part: int = PART) -> DataFrame:
    """Verified links (src, dst) that ``links`` doesn't have, as it only spans: with the ``kept`` ones, the components of all verified pairs.

    Both ends of any near pair are in one component of ``links``.  Where such a component falls into several of verified links, its
    members are compared by their sets; one of over ``part`` shingles is dealt out as pairs of parts.
    """
    within = components(links, "candidates").select("node", F.col("label").alias("h"))
    within = within.unionByName(within.select(F.col("h").alias("node"), "h").distinct())  # the smallest has no row of its own
    rows = within.join(components(kept, "verified"), "node", "left").select("node", "h", F.coalesce("label", "node").alias("label"))
    rows = stored(rows.join(has.select("node", F.size("s").cast("long").alias("size")), "node"), "unspanned")
    split = rows.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("k"), F.sum("size").alias("size"))
    # two make one pair, and that is a link
    split = split.where("a <> b and k > 2").select("h", F.greatest(F.lit(1), F.ceil(F.col("size") / part)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64("h", F.least(i, own), F.greatest(i, own)))
    dealt = rows.join(split, "h").select("node", "label", F.explode(pairs).alias("key")).join(has, "node")

    def compare(t: pa.Table) -> pa.Table:
        sets = t["s"].combine_chunks()
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        out = joining(*[t[c].to_numpy() for c in ("node", "check", "label")], sets.flatten().to_numpy(), size, near, similarity)
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"src": pa.array(both[:, 0]), "dst": pa.array(both[:, 1])})

    return dealt.groupBy("key").applyInArrow(compare, "src long, dst long").distinct()


def _with_components(by_doc: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Add (component_id, component_hash), id and text hash of the smallest document reachable, to documents with a node.

    ``nodes`` has each node's smallest document as (rep, rep_hash).
    """
    label = components(links)
    named = nodes.join(label, "node", "left").select("node", "rep", "rep_hash", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "rep_hash"))).alias("r"))
    least = least.select("label", F.col("r.rep").alias("component_id"), F.col("r.rep_hash").alias("component_hash"))
    return by_doc.join(named.join(least, "label").select("node", "component_id", "component_hash"), "node")


def _smallest() -> Column:
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("r")


def near_duplicates(docs: DataFrame, shingle: int = 4, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, component_hash) for each row: the last two are of the document with the smallest id (then hash)."""
    by_doc = stored(fingerprints(docs, shingle), "fingerprints").withColumnRenamed("fp", "node")
    nodes = by_doc.groupBy("node").agg(_smallest()).select("node", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"))
    nodes = stored(nodes, "distinct-fingerprints")
    links = near_links(nodes.select(F.col("node").alias("fp")), near, group)
    return _with_components(by_doc, nodes, links).select("doc_id", "text_hash", F.col("node").alias("fp"), "component_id", "component_hash")


def alike(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """(doc_id, text_hash, component_id, component_hash) for each row, of components of texts whose shingle sets have this Jaccard similarity."""
    read = stored(signatures(docs, shingle), "signatures")
    by_doc = read.select("doc_id", "text_hash", "node")
    nodes = read.groupBy("node").agg(_smallest(), F.min(_row(F.col("text_hash"))).alias("row"), F.first("f").alias("f"))
    nodes = stored(nodes.select("node", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), "row", "f", F.get("f", F.lit(0)).alias("check")), "nodes")
    word = [F.get("f", F.lit(k)) for k in range(WORDS)]
    halves = [h for w in word for h in _halves(w)]
    # a meeting in one word says something of that word, so two others are checked
    checks = [[word[(k + 1) % WORDS], word[(k + 2) % WORDS]] for k in range(WORDS) for _ in range(2)]
    # the nearest anchors of the first word join most of a group by few links; all anchors then join what is still apart
    close = stored(linked(nodes, halves[:2], 0, CHECK, checks[:2], group=group), "close")
    named = nodes.join(components(close, "close-components"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    links = linked(named, halves, 2, CHECK, checks, "label", group)
    links = stored(links.unionByName(close), "links")
    has = shingles_of(links, nodes.select("node", "check", "row"), docs, shingle)
    kept = stored(verified(links, has, similarity), "verified-links")
    links = kept.unionByName(unspanned(links, kept, has, FIRST, similarity))
    return _with_components(by_doc, nodes.select("node", "rep", "rep_hash"), links).drop("node")
