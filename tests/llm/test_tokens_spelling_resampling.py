"""Token files, spelling variants and importance resampling against brute force."""

import hashlib
import json
import math
import random
import re
from binascii import crc32
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docveil.llm import queries, resample, spelling, tokenfiles

from .conftest import make, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def _texts(spark, sf):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


# ---------------------------------------------------------------- token files


def _told(rows):
    start, out = 0, []
    for doc, text in rows:
        ids = [*TOK.encode(text, add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query11(spark, sf):
    got = queries.op11_token_files(spark, sf).collect()
    assert [tuple(r) for r in sorted(got)] == _told(_texts(spark, sf))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBtzß'sé1÷ª \n\t_` \u0085 \x1c\x1f.,<|>日ß "), max_size=40))
@example("a  <|endoftext|> b")
@example("  x   y \n z  ")
@example("it's  they'll 12 34")
@example("<|endoftext|>")
def test_chunks_give_the_texts_ids(text):
    assert np.frombuffer(tokenfiles.encode_texts([text], PATH)[0], "<u2").tolist() == [*TOK.encode(text, add_special_tokens=False).ids, 0]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    text = "Ein  Text, der GANZ bleibt"
    assert np.frombuffer(tokenfiles.encode_texts([text], path, 7)[0], "<u2").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 7]


def test_token_files_odd_rows(spark, odd, tmp_path):
    path = str(tmp_path / "set")
    tokenfiles.write_tokens(odd, PATH, path, length=16)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0]))
    got = tokenfiles.read_tokens(spark, path).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], crc32(bytes(r["ids"]))) for r in got] == _told(rows)
    # sequences hold the same run of ids, with a mask that leaves the padding out
    flat = []
    for r in tokenfiles.read_tokens(spark, path, "sequences").orderBy("start").collect():
        assert len(r["ids"]) == len(r["mask"]) == 16 and r["mask"] == sorted(r["mask"], reverse=True)
        flat += [i for i, m in zip(r["ids"], r["mask"], strict=True) if m]
    assert flat == [i for r in got for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()]


def test_token_files_in_place(spark, sf, tmp_path):
    """The files are Arrow files of fixed-size lists; sequences and spans of ids are views of the mapped file."""
    path = str(tmp_path / "set")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfiles.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), PATH, path, length=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = tokenfiles.manifest(path)
    all_ids = [i for _, text in _texts(spark, sf) for i in [*TOK.encode(text, add_special_tokens=False).ids, 0]]
    assert told["tokens"] == len(all_ids) and len(told["files"]) > 1
    for f in told["files"]:
        with pa.ipc.open_file(f"{path}/{f['name']}.arrow") as plain:
            assert plain.schema.field("ids").type == pa.list_(pa.uint16(), 64) and plain.schema.field("mask").type == pa.list_(pa.bool_(), 64)
            assert {plain.get_batch(k).num_rows for k in range(plain.num_record_batches - 1)} <= {tokenfiles.BATCH}
        before = pa.total_allocated_bytes()
        with tokenfiles.SequenceFile(f"{path}/{f['name']}.arrow") as one:
            ids, mask = one.sequence(1)
            assert ids.tolist() == all_ids[f["start"] + 64 : f["start"] + 128] and mask.true_count == 64 and not ids.flags.owndata
            last, end = divmod(f["tokens"], 64)
            if end:
                assert one.sequence(last)[1].true_count == end
            rng = random.Random(4)
            for _ in range(50):
                at = rng.randrange(f["tokens"])
                n = rng.randrange(f["tokens"] - at + 1)
                assert one.tokens(at, n).tolist() == all_ids[f["start"] + at : f["start"] + at + n]
            assert pa.total_allocated_bytes() - before < 100_000


def test_token_files_commit(spark, empty, tmp_path):
    path = str(tmp_path / "set")
    docs = make(spark, [(i, f"text number {i}", "en", "a") for i in range(20)])
    tokenfiles.write_tokens(docs, PATH, path)
    with pytest.raises(Exception, match="manifest"):
        tokenfiles.write_tokens(docs, PATH, path)
    # what a lost task left behind is not read, and a new write removes it
    (tmp_path / "set" / "part-00000-00ff.arrow").write_bytes(b"half a file")
    assert tokenfiles.read_tokens(spark, path).count() == 20
    spark.dataSource.register(tokenfiles.TokenFiles)
    tokenfiles.encoded(docs.where("doc_id < 3"), PATH).write.format("token_files").mode("overwrite").save(path)
    assert tokenfiles.read_tokens(spark, path).count() == 3 and not (tmp_path / "set" / "part-00000-00ff.arrow").exists()
    # a task that fails leaves the set as it was
    bad = docs.selectExpr("doc_id", "if(doc_id = 17, raise_error('lost'), binary('ab')) as ids").repartition(4)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("token_files").mode("overwrite").save(path)
    assert tokenfiles.read_tokens(spark, path).count() == 3
    tokenfiles.write_tokens(empty, PATH, str(tmp_path / "none"))
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).collect() == []
    assert json.loads((tmp_path / "none" / "manifest.json").read_text())["files"] == []


# ---------------------------------------------------------------- spelling variants


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows, least=6, count=5, ratio=5, every=199):
    n: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= least and k >= count})
    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    form, out = {}, {}
    for w in n:
        near = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size[size] if _near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(near)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def test_query12(spark, sf):
    got = queries.op12_spelling_variants(spark, sf).collect()
    want = _variants(_texts(spark, sf))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(w[1] for w in want)


def test_variants_chains_and_ties(spark):
    """Forms of forms, ties, letters that repeat, insertions at both ends, accents, and words that meet in several places."""
    counts = {"abcdefg": 1000, "abcdef": 130, "abcdeg": 20, "abcceg": 3, "bcdefg": 15, "xabcdefg": 10, "abcdefgx": 10, "aaaaaa": 70, "aaaaaaa": 11, "aaaaaaaa": 2, "éabcdef": 5, "zabcdef": 5, "÷bcdefg": 4, "qwertyuiop": 3}
    rows = [(i, " ".join(w for w, n in counts.items() for _ in range(n // 10 + (i < n % 10))), "en", "a") for i in range(10)]
    got = spelling.variants(make(spark, rows), least_count=2, ratio=2).collect()
    want = _variants([(r[0], r[1]) for r in rows], count=2, ratio=2)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {w[0]: w[2] for w in want}["abcceg"] == "abcdefg"


def test_variants_random(spark):
    """Words over three letters, so that nearly all are near others; every third run loses a letter."""
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(400)), "en", "a") for i in range(30)]
    got = spelling.variants(make(spark, rows), 4, 2, 2, 3).collect()
    want = _variants([(r[0], r[1]) for r in rows], 4, 2, 2, 3)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_variants_odd(spark, odd, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert {tuple(r) for r in spelling.variants(odd, least_count=1).collect()} == _variants(rows, count=1)
    assert spelling.variants(empty).collect() == []


def test_keys():
    """Equal strings have equal keys, whatever was deleted; long words take linear time."""
    some = ["banana", "bananas", "anana", "bbanana", "é÷ö", "a"]
    word, at, first, key = spelling.keys_of(some)
    by_text = defaultdict(set)
    for w, p, k in zip(word, at, key, strict=True):
        by_text[some[w] if p < 0 else some[w][:p] + some[w][p + 1 :]].add(int(k))
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert sum(f for f, w in zip(first, word, strict=True) if w == 3) == 6
    assert len(spelling.keys_of(["ab" * 500_000])[3]) == 1_000_001


# ---------------------------------------------------------------- importance resampling


def _resampled(rows, target, percent=10, least=20, grams=1, buckets=10_000, seed="2024"):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", low)
        return len(w), [crc32(" ".join(w[i : i + g]).encode()) % buckets for g in range(1, grams + 1) for i in range(len(w) - g + 1)]

    docs = [(doc, *features(text)) for doc, text in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for text in target for b in features(text)[1])
    n_s, n_t = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)]
    scored = []
    for doc, n_words, f in docs:
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    eligible = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank: dict = defaultdict(list)
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        rank[r[:4]].append(k + 1)
    return [(*r[:4], rank[r[:4]].pop(0) if r[4] >= least and rank[r[:4]] else None) for r in scored]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_query13(spark, sf):
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, sf).collect()
    assert _sorted(got) == _sorted(_resampled(_texts(spark, sf), target))
    assert sum(r["rank"] is not None for r in got) > 10


def test_resampling_ngrams(spark):
    """Two-word features, few buckets, texts in several scripts, and scores that tie."""
    rng = random.Random(6)
    rows = [(i % 40, " ".join(words(rng, rng.randrange(0, 60), 30)) + " Été 日本 X9", "en", "a") for i in range(60)] + [(7, "same text of few words", "en", "a")] * 20
    target = ["w1z w2z w3z été", "", None]
    docs, wanted = make(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resampled(docs, wanted, grams=2, buckets=64, percent=30, least=5, seed="x")
    assert _sorted(got.collect()) == _sorted(_resampled([(r[0], r[1]) for r in rows], [t or "" for t in target], 30, 5, 2, 64, "x"))


def test_resampling_odd(spark, odd, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    target = spark.createDataFrame([("palabra corta",)], "text string")
    assert _sorted(resample.resampled(odd, target, percent=100, least=1).collect()) == _sorted(_resampled(rows, ["palabra corta"], 100, 1))
    assert resample.resampled(empty, target).collect() == []
    assert _sorted(resample.resampled(odd, empty, percent=50, least=0).collect()) == _sorted(_resampled(rows, [], 50, 0))


def test_blocks(spark, sf):
    """The matrix is written in blocks of bounded size that cover every document once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = resample.count_matrix(docs, block=4000).collect()
    assert len(blocks) > 5
    assert sorted(i for b in blocks for i in b["doc_ids"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    for b in blocks:
        pointers, columns, counts = resample._arrays(b.asDict(), resample.BUCKETS)
        sums = np.add.reduceat(np.append(counts, 0), pointers[:-1]) * (np.diff(pointers) > 0)
        assert sums.tolist() == b["n_features"] and len(columns) == pointers[-1]


def test_texts_are_split_one_at_a_time(monkeypatch):
    """Chunks of one text are held, not those of all, and what is forgotten is encoded again."""
    import tracemalloc

    texts = [" ".join(["uno", "dos,", "trés"] * 2_000)] * 100
    tokenfiles.encode_texts(texts[:1], PATH)
    tracemalloc.start()
    got = tokenfiles.encode_texts(texts, PATH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(map(len, got)) + 4_000_000
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 3)
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", " \na", "a \t b", "a\u00a0b \u00a0c", "x <|endoftext|> y", "12 34, 5.", "ñ日本 語 !? ...", "a b c d e f a b c"]
    assert [np.frombuffer(g, "<u2").tolist() for g in tokenfiles.encode_texts(odd * 2, PATH)] == [[*TOK.encode(t, add_special_tokens=False).ids, 0] for t in odd * 2]
