"""WARC derivatives, decontamination and the pipeline."""

import base64
import gzip
import hashlib
import json
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from docveil.llm import decontam, warc
from docveil.llm.queries import op9_warc_derivatives, op10_benchmark_decontamination

from .conftest import make, words

PAGE = '<!DOCTYPE html><html lang="es"><head><title>Hola &amp; adiós</title><style>p{}</style><script>var a="</p>";</script></head><body><!-- no --><h1>Uno</h1><p>dos <b>tres</b>\ncuatro<br>cinco</p><a href="/x?a=1&amp;b=2">seis</a><noscript>nada</noscript></body></html>'


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, block string, record_id string")


def test_text_and_metadata():
    assert warc.plain_text(PAGE) == "Hola & adiós\nUno\ndos tres cuatro\ncinco\nseis"
    m = warc.page_metadata(PAGE)
    assert (m["title"], m["lang"], m["links"]) == ("Hola & adiós", "es", ["/x?a=1&b=2"])
    for broken in ("<p", "<script>never closed", "a < b & c", "<!-- open", "<a href=", ""):
        warc.plain_text(broken)
        warc.page_metadata(broken)
    assert warc.plain_text("a < b") == "a < b"


def test_records_are_linked(spark):
    df = pages(spark, [(1, "http://a/", PAGE, "x", "y"), (2, None, None, None, None), (None, "http://b/", "", None, None), (1, "http://a/", PAGE, "x", "y")])
    res = warc.responses(df)
    by_id = {r.record_id: r for r in res.collect()}
    out = warc.derive(res).collect()
    assert len(out) == 8
    for r in out:
        src = by_id[r.refers_to]
        assert (r.target_uri, r.date, r.http_headers, r.payload_digest) == (src.target_uri, src.date, src.http_headers, src.payload_digest)
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode() and r.content_length == len(r.block)
    conv = {r.record_id for r in out if r.record_type == "conversion"}
    assert all(json.loads(bytes(r.block).decode())["conversion"] in conv for r in out if r.record_type == "metadata")
    assert warc.derive(warc.responses(pages(spark, []))).count() == 0


def test_round_trip(spark, tmp_path):
    df = pages(spark, [(k, f"http://a/{k}", PAGE * (k + 1), None, None) for k in range(5)])
    all_ = warc.responses(df).unionByName(warc.derive(warc.responses(df)))
    warc.write_warc(all_, str(tmp_path / "w"))
    key = lambda r: (r.record_id, r.record_type)
    assert sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=key) == sorted(all_.collect(), key=key)
    # one file of all members, and one that is not compressed
    members = [warc.to_bytes(r.asDict()) for r in all_.collect()]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.warc.gz").write_bytes(b"".join(members))
    assert warc.read_warc(spark, str(tmp_path / "f"), members=False).count() == 15
    assert len(list(warc.from_bytes(b"".join(map(gzip.decompress, members))))) == 15


def test_query9(spark, sf):
    rows = op9_warc_derivatives(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert len(rows) == 2 * n and {r.record_type for r in rows} == {"metadata", "conversion"}


# ---------------------------------------------------------------- decontamination


def plain_index(items):
    """An index with BM25 weights in plain Python, and those weights."""
    cuts = [(i, words, asked, False) for i, t in items for words, asked in decontam.segments_of(t)]
    n, mean = len(cuts), sum(len(c[1]) for c in cuts) / max(1, len(cuts))
    df = Counter(w for c in cuts for w in set(c[1]))
    weights = []
    for _, words, _, _ in cuts:
        x = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w, c in Counter(words).items()}
        weights.append({w: v / sum(x.values()) for w, v in x.items()})
    return decontam.build_index(cuts, weights), cuts, weights


@pytest.mark.parametrize("at_once", [decontam.AT_ONCE, 40])
def test_retrieval_is_exhaustive(monkeypatch, at_once):
    """Pivots and block maxima skip nothing that scores the threshold."""
    monkeypatch.setattr(decontam, "AT_ONCE", at_once)
    rng = random.Random(2)
    ix, cuts, weights = plain_index([(k, " ".join(words(rng, rng.randint(8, 150), 300))) for k in range(90)])
    docs = [[]]
    for _ in range(60):
        doc = words(rng, rng.randint(1, 500), 300)
        if rng.random() < 0.7:
            at = rng.randint(0, len(doc))
            doc[at:at] = rng.choice(cuts)[1][: rng.randint(5, 100)]
        docs.append(doc)
    terms = np.array([ix.vocab.get(w, 0) for doc in docs for w in doc], np.int64)
    for threshold in (0.5, 0.35):
        got = {(d, p, s): round(x, 6) for d, p, s, x in decontam.retrieve(ix, terms, [len(d) for d in docs], threshold)}
        want = {}
        for d, doc in enumerate(docs):
            for p in range(-(-len(doc) // decontam.SEGMENT)):
                have = set(doc[p * decontam.SEGMENT : (p + 2) * decontam.SEGMENT])
                for s, w in enumerate(weights):
                    if (x := sum(v for t, v in w.items() if t in have)) >= threshold - 1e-9:
                        want[d, p, s] = round(x, 6)
        assert got == want and len(got) > 50


def test_weights_are_those_of_all_segments(spark):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, rng.randint(1, 200), 300))) for k in range(40)]
    _, cuts, weights = plain_index(items)
    cut = decontam.segments(spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string"))
    got = {(r.item_id, tuple(r.words)): {e["word"]: e["x"] for e in r.w} for r in cut.join(decontam.weighed(cut), "sid").collect()}
    assert len(got) == len(cuts)
    for (item, own, _, _), w in zip(cuts, weights, strict=True):
        assert got[item, tuple(own)] == pytest.approx(w)


def test_long_text_against_many_items():
    """Memory stays far below a gigabyte for 200,000 words against 20,000 items that share their words."""
    rng = random.Random(6)
    ix, cuts, _ = plain_index([(k, " ".join(words(rng, 40, 20_000))) for k in range(20_000)])
    doc = words(rng, 200_000, 20_000)
    doc[777:777] = cuts[55][1]
    terms = np.array([ix.vocab.get(w, 0) for w in doc], np.int64)
    tracemalloc.start()
    got = decontam.retrieve(ix, terms, [len(terms)], decontam.THRESHOLD)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {s for _, _, s, _ in got} == {55} and peak < 500e6


def test_leaks_are_found_and_others_left(spark):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, 20, 3000)) + ". " + " ".join(words(rng, 15, 3000))) for k in range(50)] + [(77, None), (78, ""), (79, "a b"), (80, " ".join(words(rng, 300, 3000)))]
    docs, leaked = [], set()
    for i in range(120):
        t = words(rng, rng.randint(0, 400), 3000)
        if i % 4 == 0:
            k = rng.choice([*range(50), 80])
            part = dict(items)[k].split()
            if i % 8 == 0:  # some words changed, other case and signs
                part = [w.upper() + "," if rng.random() < 0.5 else w for w in part]
                part[7] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = part
            leaked.add((i, k))
        docs.append((i, " ".join(t), None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(decontam.matches(make(spark, docs), bench, part=part).collect()) for part in (decontam.PART, 10)]
    assert {(r.doc_id, r.item_id) for r in rows[0]} == leaked
    assert rows[0] == rows[1]  # down to the scores
    stay = decontam.decontaminated(make(spark, docs), bench)
    assert {r.doc_id for r in stay.collect()} == {i for i in range(120) if i % 4} and stay.columns == make(spark, docs).columns


def test_decontam_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text here for all of us to read now today")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontam.matches(odd, bench).collect()) == ["6", "6", "7"]
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.matches(odd, bench.where("false")).count() == 0
    assert decontam.decontaminated(odd, bench).where("doc_id is null").count() == 1


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Who was first? Ada Lovelace"), (2, "日本の首都はどこですか。 東京です"), (3, "日本"), (4, "..")]
    texts = ["so, who was first? Ada Lovelace!", "who was it first, not Ada Lovelace", "ada lovelace who was first", "昨日、日本の首都はどこですか。東京です、と聞いた", "日の本の首都", "日本へ行く", "nothing"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(make(spark, [(i, t, None, None) for i, t in enumerate(texts)]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (3, 2), (3, 3), (5, 3)}


def test_quotations_across_cuts(spark):
    """50 words from anywhere in a long item are found."""
    rng = random.Random(12)
    for n in (65, 120, 300):
        item = words(rng, n, 5000)
        docs = [(at, " ".join(words(rng, 40, 5000) + item[at : at + 50] + words(rng, 40, 5000)), None, None) for at in range(n - 49)]
        bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        assert {r.doc_id for r in decontam.matches(make(spark, docs), bench).collect()} == set(range(n - 49))


def test_query10(spark, sf):
    rows = op10_benchmark_decontamination(spark, sf).collect()
    texts = {r.doc_id: decontam.normal_words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontam.normal_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, w in texts.items() for i, q in items.items() if len(q) >= 6 and f" {' '.join(q)} " in f" {' '.join(w)} "}
    assert whole <= {(r.doc_id, r.item_id) for r in rows}


# ---------------------------------------------------------------- pipeline


def test_stages(spark, sf, odd, empty):
    import corpus_pipeline as p

    before = spark.read.parquet(f"{sf}/documents.parquet")
    docs = before
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        if k < len(p.STAGES) - 1:
            assert out.columns == before.columns and out.dtypes == before.dtypes
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    for stage in (s for _, s in p.STAGES):
        stage(spark, odd, sf).collect()
        assert stage(spark, empty, sf).count() == 0


def test_dedup_keeps_one_of_each(spark, odd, sf):
    import corpus_pipeline as p

    kept = [r.doc_id for r in p.near_dedup(spark, odd, sf).collect()]
    assert sorted(map(str, kept)) == sorted(["1", "None", "5", "6", "8", "9"])


def test_ids_that_are_null_or_repeated(spark, sf):
    """A row is judged with its text, not by its id alone."""
    import corpus_pipeline as p

    rng = random.Random(14)
    item = words(rng, 30)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    other = " ".join(words(rng, 50, 5000))
    bad = f"{other} {' '.join(item)}"
    docs = make(spark, [(i, t, None, None) for i in (None, 5) for t in (bad, other)])
    assert [(r.doc_id, r.text) for r in decontam.decontaminated(docs, bench).orderBy("doc_id").collect()] == [(None, other), (5, other)]

    texts = [" ".join(words(rng, 60, 5000)) for _ in range(9)]
    rows = [(0, texts[0], None, None)] + [(i, t, None, None) for i in range(1, 9) for t in (texts[0], texts[i], texts[i])]
    for order in (rows, rows[::-1]):
        got = p.near_dedup(spark, make(spark, order), sf).collect()
        assert sorted((r.doc_id, r.text) for r in got) == list(enumerate(texts))


def test_run(spark, sf):
    import corpus_pipeline as p

    out = p.run(spark, sf)
    assert out.count() > 0 and out.groupBy("doc_id", "piece").count().where("count > 1").count() == 0


def test_index_of_many_words():
    """An index with over two million distinct words verifies by the segment's own."""
    segments = [(k, [f"w{k * 64 + i}" for i in range(64)], 40, False) for k in range(34_000)]
    index = decontam.build_index(segments, [{w: 1 / 64 for w in ws} for _, ws, _, _ in segments])
    assert len(index.vocab) > 1 << 21
    for s in (0, 33_999):
        assert decontam.verify(index, s, index.terms[s])[2]
        assert not decontam.verify(index, s, index.terms[17_000])[2]
