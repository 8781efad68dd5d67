import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docveil.llm import simhash


def slow_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  \n", "One", "a b c", "A b C d", "Él dijo ÉL: no\x0bmás\x1cya " * 9, "la la la la la la", "x " * 3000, "a b c d e f g h i"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def groups(fps, near=4):
    left, out = set(fps), {}
    while left:
        seed = min(left)
        todo, group = [seed], {seed}
        left.discard(seed)
        while todo:
            x = todo.pop()
            hit = {y for y in left if (x ^ y).bit_count() <= near}
            left -= hit
            group |= hit
            todo += hit
        for x in group:
            out[x] = frozenset(group)
    return out


def near_fps(rng, n):
    fps = []
    for _ in range(n):
        if fps and rng.random() < 0.7:
            x = rng.choice(fps)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
        else:
            x = rng.getrandbits(64)
        fps.append(x)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize("group", [simhash.GROUP, 497 * 3])  # 497 halves are within reach of an anchor
def test_every_link_is_found(spark, group):
    rng = random.Random(5)
    fps = near_fps(rng, 500)
    if group != simhash.GROUP:  # a dense group that has to be split into parts
        c = rng.getrandbits(64)
        fps = list(dict.fromkeys(fps + [c ^ (1 << a) ^ (1 << b) for a in range(33, 62) for b in range(a)] + [c ^ (x << 33) for x in range(1500)]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    label = {r.node: r.label for r in simhash.components(simhash.near_links(df, group=group)).collect()}
    want = groups(fps)
    back = dict(zip(signed, fps, strict=True))
    by = {}
    for x in signed:
        by.setdefault(label.get(x, x), set()).add(back[x])
    assert {frozenset(g) for g in by.values()} == set(want.values())


def test_two_blocks_cover_four_bits(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        pairs.append((x - (1 << 63), y - (1 << 63)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a long, b long")
    at = lambda c: F.concat(*[simhash.anchors_of(h, F.lit(k)) for k, h in enumerate(simhash._halves(F.col(c)))])
    assert df.where(F.size(F.array_intersect(at("a"), at("b"))) == 0).count() == 0
    assert df.agg(F.max(F.size(at("a")))).first()[0] <= 32


def test_nine_bits(spark):
    assert simhash.reach(4) == 2 and simhash.reach(9) == 3
    rng = random.Random(15)
    fps = []
    for _ in range(250):
        x = rng.choice(fps) if fps and rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 12)):
            x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    label = {r.node: r.label for r in simhash.components(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 9)).collect()}
    by = {}
    for x, s in zip(fps, signed, strict=True):
        by.setdefault(label.get(s, s), set()).add(x)
    assert {frozenset(g) for g in by.values()} == set(groups(fps, 9).values())
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), 10)


def test_absorb_spans(spark):
    f = np.array(near_fps(random.Random(9), 300), np.uint64)
    links = [(int(f[a]), int(f[b])) for a, b in simhash.absorb(f)]
    assert len(links) < len(f)
    parent = {int(x): int(x) for x in f}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(b)] = root(a)
    by = {}
    for x in parent:
        by.setdefault(root(x), set()).add(x)
    assert {frozenset(g) for g in by.values()} == set(groups([int(x) for x in f]).values())


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    got = simhash.components(links).collect()
    assert len(got) == 300 and {r.label for r in got} == {0}


def test_documents(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fps = {simhash.fingerprint(r.text or "") for r in rows}
    want = groups(fps)
    least = {}
    for r in rows:
        g = want[simhash.fingerprint(r.text or "")]
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(r.doc_id), least.get(want[simhash.fingerprint(r.text or "")])) for r in rows)


def alike_groups(rows, similarity=0.8):
    """Components of all pairs of this similarity, and how many pairs there are between different texts."""
    sets = {i: frozenset(simhash.shingle_set(t or "", 5).tolist()) for i, t, _, _ in rows}
    holds = {}
    for i, own in sets.items():
        for x in own:
            holds.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for i, own in sets.items():
        common = {}
        for x in own:
            for j in holds[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= similarity * (len(own) + len(sets[j]) - n):
                pairs.add((j, i))
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in sets}, pairs


def test_alike_recall_near_the_threshold(spark):
    """Of pairs of texts of which 0.8 to 0.85 are alike, at least 0.9 are joined; nothing else is."""
    rng = random.Random(21)
    from .conftest import make, words

    rows, shares = [], []
    for k in range(600):
        base = words(rng, 204, 50_000)
        cut = rng.choice([12, 13, 14, 15])  # words changed in one run: 200 shingles each, cut + 4 of them changed
        rows += [(2 * k, " ".join(base), None, None), (2 * k + 1, " ".join(base[:50] + words(rng, cut, 50_000) + base[50 + cut :]), None, None)]
        shares.append((200 - cut - 4) / (200 + cut + 4))
    assert 0.8 < min(shares) and max(shares) < 0.86
    got = {r.doc_id: r.component_id for r in simhash.alike(make(spark, rows + rows[:3])).collect()}
    want, pairs = alike_groups(rows)
    assert len(pairs) == 600 and all(got[i] in (i, want[i]) for i in got)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_alike_dense_group(spark):
    """In a group of hundreds that are near but mostly not alike, each finds its copies."""
    rng = random.Random(33)
    from .conftest import make, words

    base = words(rng, 300, 50_000)
    rows = []
    for k in range(400):
        own = list(base)
        for at in rng.sample(range(0, 300, 5), 8):  # each changes five shingles
            own[at] = f"v{k}x{at}"
        copy = list(own)
        copy[rng.randrange(300)] = f"c{k}"
        rows += [(2 * k, " ".join(own), None, None), (2 * k + 1, " ".join(copy), None, None)]
    want, pairs = alike_groups(rows)
    assert len(set(want.values())) > 300
    got = {r.doc_id: r.component_id for r in simhash.alike(make(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("size", [2, 50])
def test_equal_fingerprints_are_compared(spark, size):
    """Texts of one fingerprint, as a repeated phrase outweighs the rest, are not alike for it."""
    rng = random.Random(40)
    from .conftest import make, words

    rows = [(i, "spam spam spam spam spam " * 60 + " ".join(words(rng, 150, 50_000)), None, None) for i in range(size)]
    assert len({simhash.fingerprint(t, 5) for _, t, _, _ in rows}) == 1
    assert {r.doc_id: r.component_id for r in simhash.alike(make(spark, rows)).collect()} == {i: i for i in range(size)}


def test_alike_on_the_tables(spark, sf):
    rows = [(r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, pairs = alike_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert pairs and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    for i, c in got.items():
        assert want[i] == want[c]


def test_alike_odd(spark, odd, empty):
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.alike(odd).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 1), ("None", None), ("5", 5), ("6", 6), ("6", 6), ("7", 6), ("8", 8), ("9", 9)])
    assert simhash.alike(empty).count() == 0


def test_joining_by_parts(spark):
    """Dealt out in parts or not, what the spanning links leave is found."""
    one, two = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [11, 12, 13, 14, 15, 16, 17, 18, 19, 20]
    sets = {1: two, 2: one, 3: one, 4: [*one[1:], 30], 5: [], 6: [], 7: two}
    has = spark.createDataFrame([(k, k, s) for k, s in sets.items()], "node long, check long, s array<long>")
    links = spark.createDataFrame([(1, k) for k in range(2, 8)], "src long, dst long")
    kept = spark.createDataFrame([(1, 7)], "src long, dst long")
    for part in (simhash.PART, 10, 1):
        got = simhash.components(kept.unionByName(simhash.unspanned(links, kept, has, 9, 0.8, part))).collect()
        assert {r.node: r.label for r in got} == {7: 1, 3: 2, 4: 2, 6: 5}


def test_empty(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_unrelated_texts_are_no_candidates(spark):
    """Random fingerprints, of which 200 million pairs are no candidates of each other, and copies of some with a few bits changed are."""
    n = 20_000
    rng = np.random.default_rng(8)
    f = rng.integers(0, 1 << 64, (n, simhash.WORDS), np.uint64)
    near = f[:50].copy()
    for row in near:
        for bit in rng.choice(64 * simhash.WORDS, 20, replace=False).tolist():
            row[bit // 64] ^= np.uint64(1 << bit % 64)
    both = np.concatenate([f, near]).view(np.int64).tolist()
    rows = spark.createDataFrame(list(enumerate(both)), "node long, f array<long>")
    word = [F.get("f", F.lit(k)) for k in range(simhash.WORDS)]
    halves = [h for w in word for h in simhash._halves(w)]
    checks = [[word[(k + 1) % simhash.WORDS], word[(k + 2) % simhash.WORDS]] for k in range(simhash.WORDS) for _ in range(2)]
    links = simhash.linked(rows.repartition(8), halves, 2, simhash.CHECK, checks).collect()
    assert {(r.src, r.dst) for r in links} == {(k, n + k) for k in range(50)}
