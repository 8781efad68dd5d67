"""Letters paired with glyphs, against plain code and against what was planted."""

import random
import unicodedata

from docveil.operators import align

WORDS = "El firmante acepta las condiciones del contrato fijadas en la oficina de Sevilla el día quince de marzo ante notario y testigos".split()


def _page(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(1000)) if rng.random() < 0.3 else "") for _ in range(n))


def _drawn(rng, text, lost=0.0, blanks=True):
    """Glyphs of a text with ligatures, perhaps some lost, and the place each letter was drawn from."""
    out, at = [], 0
    while at < len(text):
        c = "ﬁ" if text[at : at + 2] == "fi" else text[at]
        if not (blanks and c == " ") and rng.random() >= lost:
            out.append((c, at))
        at += 2 if c == "ﬁ" else 1
    return out


def _frames(spark, pages):
    texts = spark.createDataFrame([(k, t, "x") for k, t, _ in pages], "page long, text string, c string")
    rows = [(k, n, c, "y") for k, _, g in pages for n, c in enumerate(g)]
    random.Random(1).shuffle(rows)
    return texts, spark.createDataFrame(rows, "page long, n int, c string, text string")


def _pairs(spark, pages):
    got = {}
    for r in align.aligned(*_frames(spark, pages), ["page"]).collect():
        got.setdefault(r.page, []).append((r.at, r.n))
    return {k: sorted(v) for k, v in got.items()}


def _truth(drawn):
    return sorted((at + d, n) for n, (c, at) in enumerate(drawn) for d in range(2 if c == "ﬁ" else 1) if c != " ")


def test_ligatures_and_lost_blanks_are_paired_in_full(spark):
    rng = random.Random(3)
    made = []
    for k in range(12):
        text = _page(rng, 0 if k == 0 else rng.randrange(1, 300))
        made.append((k, text, _drawn(rng, text, blanks=k % 2 == 0)))
    got = _pairs(spark, [(k, t, [c for c, _ in d]) for k, t, d in made])
    for k, text, drawn in made:
        assert got.get(k, []) == _truth(drawn), text[:80]


def test_lost_glyphs_cost_little_around_them(spark):
    rng = random.Random(4)
    text = _page(rng, 400)
    drawn = _drawn(rng, text, lost=0.01)
    got = set(_pairs(spark, [(1, text, [c for c, _ in drawn])])[1])
    truth = set(_truth(drawn))
    assert len(got & truth) > 0.97 * len(truth) and len({a for a, _ in got}) == len(got)


def test_a_block_drawn_first_leaves_the_rest_paired(spark):
    rng = random.Random(5)
    text = _page(rng, 200)
    foot = " Página única 77 del registro mercantil"
    whole = text + foot
    body, last = _drawn(rng, text), [(c, at + len(text)) for c, at in _drawn(rng, foot)]
    got = set(_pairs(spark, [(1, whole, [c for c, _ in last + body])])[1])
    kept = {(at, n) for at, n in _truth(last + body) if at < len(text)}
    assert len(got & kept) > 0.99 * len(kept)


def test_without_ties_pairs_are_those_of_the_plain_look_ahead(spark):
    rng = random.Random(6)
    pages = [(k, "".join(rng.choice("ab c") for _ in range(rng.randrange(60))), [rng.choice(["a", "b", "c", " ", "ab"]) for _ in range(rng.randrange(60))]) for k in range(30)]
    pages.append((99, "ab" * 400, ["b"] * 50 + ["a", "b"] * 300))
    got = _pairs(spark, pages)
    for k, text, glyphs in pages:
        left = [(c, i) for i, c in enumerate(text) if c != " "]
        right = [(x, n) for n, c in enumerate(glyphs) for x in unicodedata.normalize("NFKC", c) if x != " "]
        if any(len(s) >= align.TIE for s in (left, right)) and _tied([c for c, _ in left], [c for c, _ in right]):
            continue
        want, at = set(), 0
        for c, i in left:
            for j in range(at, min(at + align.AHEAD, len(right))):
                if right[j][0] == c:
                    want.add((i, right[j][1]))
                    at = j + 1
                    break
        assert got.get(k, []) == sorted(want), k


def _tied(left, right):
    grams = [["".join(s[i : i + align.TIE]) for i in range(len(s) - align.TIE + 1)] for s in (left, right)]
    return any(grams[0].count(g) == 1 and grams[1].count(g) == 1 for g in grams[0])


def test_the_chain_is_the_heaviest(spark):
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(0, 12)
        places, weights = rng.sample(range(100), n), [rng.randrange(1, 9) for _ in range(n)]
        best = [0] * n
        for i in range(n):
            best[i] = weights[i] + max([best[j] for j in range(i) if places[j] < places[i]], default=0)
        got = align.heaviest_chain(places, weights)
        assert sum(weights[i] for i in got) == max(best, default=0)
        assert got == sorted(got) and all(places[a] < places[b] for a, b in zip(got, got[1:], strict=False))


def test_nothing_pairs_with_nothing(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "hola"), (None, "hola"), (5, "  \n")], "page long, text string")
    glyphs = spark.createDataFrame([(1, 0, "h"), (2, 0, "h"), (4, 0, "h"), (None, 0, "h"), (5, 0, " "), (3, 0, None)], "page long, n int, c string")
    assert align.aligned(texts, glyphs, ["page"]).where("page is not null").count() == 0
    assert align.aligned(texts.limit(0), glyphs.limit(0), ["page"]).count() == 0


def test_rects_of_a_span(spark):
    text = "Ana fija\nel DNI"
    drawn = _drawn(random.Random(8), text.replace("\n", " "))
    texts = spark.createDataFrame([(1, text)], "page long, text string")
    rows = [(1, n, c, (float(at % 9) * 10, 0.0 if at < 9 else 20.0, 20.0 if c == "ﬁ" else 10.0, 12.0)) for n, (c, at) in enumerate(drawn)]
    glyphs = spark.createDataFrame(rows, "page long, n int, c string, rect struct<x:double,y:double,w:double,h:double>")
    spans = spark.createDataFrame([(1, 4, 8), (1, 5, 6), (1, 4, 15), (1, 3, 4), (1, 2, 2), (2, 0, 4), (1, 4, 8)], "page long, start int, end int")
    pairs = align.aligned(texts, glyphs, ["page"])
    got = {(r.page, r.start, r.end): [tuple(x) for x in r.rects] for r in align.glyph_rects(spans, pairs, glyphs, ["page"]).collect()}
    line = (40.0, 0.0, 40.0, 12.0)
    assert got[1, 4, 8] == [line] and got[1, 5, 6] == [(40.0, 0.0, 20.0, 12.0)]  # a ligature is covered whole
    assert got[1, 4, 15] == [line, (0.0, 20.0, 20.0, 12.0), (30.0, 20.0, 30.0, 12.0)]
    assert got[1, 3, 4] == got[1, 2, 2] == got[2, 0, 4] == []


def test_letters_leave_in_batches():
    import pyarrow as pa

    texts = ["a" * 120_000, None, "", "x ﬁn", "b" * 60_000]
    out = list(align._lettered(iter([pa.RecordBatch.from_pydict({"page_id": list(range(5)), "_text": texts})])))
    assert max(b.num_rows for b in out) <= align.LETTERS + 20 and len(out) == 4
    rows = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert [r[1:] for r in rows if r[0] == 3] == [("x", 0, 0), ("f", 2, 1), ("i", 2, 2), ("n", 3, 3)]
    assert sum(r[0] == 0 for r in rows) == 120_000 and rows[-1] == (4, "b", 59_999, 59_999)
