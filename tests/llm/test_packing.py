import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docveil.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_word_by_word_is_the_tokenizer(text):
    assert np.frombuffer(packing.encode_texts([text], PATH)[0], "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["a\x1cb c\x1fd", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|> x", "ΣΑΣ ς", "İI ı", "it's we'll ' 's word's. a.'s", "J̌ é ̈", "　a​b﻿", "ÀÉÑß!! Ö.. ªº", "a_b ''s AB##C ###", "über. Straße, Œuvre ŸÿŸ", "don’t «así»", "x²y ½ 12.5"])
def test_hard_texts(text):
    assert np.frombuffer(packing.encode_texts([text], PATH)[0], "<u4").tolist() == ids_of(text)


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    for t in ("one two three four", "five six seven", "one two eight nine ten", "three four five one"):
        assert np.frombuffer(packing.encode_texts([t], PATH)[0], "<u4").tolist() == ids_of(t)


def test_best_two_fit_fills_what_greedy_leaves():
    # greedy: 6 + 3 of 10; the 3 gives way to 2 + 2
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


def first_fit_decreasing(lengths, limit=2048):
    bins = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, left in enumerate(bins) if left >= n), None)
        if k is None:
            bins.append(limit - n)
        else:
            bins[k] -= n
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_gapless_and_few(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 2049, 300), rng.integers(1, 200, 900), np.full(500, 777)])
    seq, off = packing.place(lengths)
    for s in range(seq.max() + 1):
        m = seq == s
        o = np.argsort(off[m])
        sizes = lengths[m][o]
        assert sizes.sum() <= 2048 and (np.cumsum(sizes) - sizes == off[m][o]).all()
    assert seq.max() + 1 <= first_fit_decreasing(lengths.tolist()) + 1
    spread = rng.integers(1, 700, 3000)
    assert packing.place(spread)[0].max() + 1 <= 1.005 * -(-spread.sum() // 2048) + 1


def test_small_bins_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randint(1, 10) for _ in range(7)]

        def best(left, bins):
            if not left:
                return len(bins)
            n = [best(left[1:], bins[:k] + [b + left[0]] + bins[k + 1 :]) for k, b in enumerate(bins) if b + left[0] <= 10]
            return min([*n, best(left[1:], [*bins, left[0]]) if len(bins) < 7 else 99])

        seq, _ = packing.place(np.array(sizes), 10)
        assert seq.max() + 1 <= best(sizes, []) + 1


def test_documents(spark, odd):
    got = [r.asDict() for r in packing.pack_documents(odd, PATH, bucket=4).collect()]
    texts = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    want = []
    for doc, text in texts:
        ids = np.array(ids_of(text) + [0], "<u4")
        want += [(doc, k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, "uno dos tres " * (k * 40 + 1)) for k in range(12)], "doc_id long, text string")
    pieces = packing.tokenize_pieces(docs, PATH)
    plan = packing.pack_pieces(pieces, 12)
    whole = {r.sequence_id: r.ids for r in packing.sequences(plan).collect()}
    for r in plan.collect():
        text = "uno dos tres " * (r.doc_id * 40 + 1)
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == (ids_of(text) + [0])[r.start : r.start + r.length]


def test_sequences_of_repeated_and_null_ids(spark):
    """Nothing is lost or multiplied where ids don't tell rows apart."""
    texts = ["uno", "uno", "dos tres cuatro", "cinco " * 3000, None]
    docs = spark.createDataFrame([(i, t) for i in (7, None) for t in texts], "doc_id long, text string")
    packed = packing.pack_pieces(packing.tokenize_pieces(docs, PATH), 10)
    got = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in got) == 2 * sum(len(ids_of(t or "")) + 1 for t in texts)
    assert packed.count() == packing.tokenize_pieces(docs, PATH).count()


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World, it's\n\nfine", " leading", "UPPER lower", ""]
    tok = Tokenizer.from_file(path)
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.encode_texts(texts, path)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty(spark, empty):
    assert packing.pack_documents(empty, PATH).count() == 0
