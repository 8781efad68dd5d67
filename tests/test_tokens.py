"""Repeats and leaks by the positional index, against trying every value on every document of its scope."""

import random
import re

from docveil.operators import entities as ent


def _worth(v):
    return len(re.sub(r"\D", "", v)) >= 5 if re.fullmatch(r"\d[\d\s./-]*", v) else len(v) >= 4


def _repeats(text, taken, forms):
    out, busy = [], list(taken)
    for value, label in sorted(((v, x) for v, x in forms.items() if _worth(v)), key=lambda f: (-len(f[0]), f[0])):
        for m in re.finditer(r"(?<![^\W_])" + re.escape(value) + r"(?![^\W_])", text, re.I if re.search(r"\s", value) else 0):
            if all(m.end() <= s or m.start() >= e for s, e in busy):
                busy.append(m.span())
                out.append((m.start(), m.end(), m[0], label))
    return out


VALUES = ["Ana López", "ana lópez", "López", "LÓPEZ", "12345678Z", "12.345-6", "1234", "García-Pérez", "Pérez", "a@b.es", "José María López", "María López", "ana", "(casa)", "ñandú_1", "ñandú"]
SCHEMA = "scope_id long, doc_id long, start int, end int, value string, base string, label string, repeated boolean"


def _scopes(spark, n=40):
    rng = random.Random(11)
    docs, occ = [], []
    for doc in range(n):
        parts = [rng.choice([*VALUES, "y", "de", "XLópez", "López2", "ANA LÓPEZ", "Ana  López", "_", "Ana\nLópez", "Pérez"]) for _ in range(rng.randrange(0, 30))]
        text = "".join(p + rng.choice([" ", " ", ", ", "-", "_", ""]) for p in parts)
        docs.append((doc % 5, doc, text))
        at = 0
        for v in VALUES:
            at = text.find(v, at)
            if at < 0 or rng.random() < 0.5:
                at = max(at, 0)
                continue
            occ.append((doc % 5, doc, at, at + len(v), v, "PERSONA", f"[PERSONA_{VALUES.index(v)}]", False))
            at += len(v)
    return docs, occ, spark.createDataFrame([*docs, (9, 99, None), (9, 98, "")], "scope_id long, doc_id long, text string"), spark.createDataFrame(occ, SCHEMA)


def test_completed(spark):
    docs, occ, d, o = _scopes(spark)
    got = sorted((r.doc_id, r.start, r.end, r.value, r.label) for r in ent.completed(d, o).where("repeated").collect())
    want = []
    for scope, doc, text in docs:
        forms = {v: x for s, _, _, _, v, _, x, _ in occ if s == scope}
        want += [(doc, *r) for r in _repeats(text, [(r[2], r[3]) for r in occ if r[1] == doc], forms)]
    assert got == sorted(want) and len(want) > 100


def test_leaks_are_all_found(spark):
    docs, occ, d, o = _scopes(spark)
    got = {(r.scope_id, r.doc_id, r.label) for r in ent.leaks(d, o, text_col="text").collect()}
    want = {(s, doc, x) for s, doc, text in docs for s2, _, _, _, v, _, x, _ in occ if s == s2 and len(v) >= 4 and re.search(r"(?<![^\W_])" + re.escape(v) + r"(?![^\W_])", text)}
    assert got == want and len(want) > 50


def test_a_plan_without_scope_joins(spark):
    """Every join has the word or the document beside the scope."""
    _, _, d, o = _scopes(spark, 5)
    plan = ent.completed(d, o)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"\bJoin\b", line)]
    assert joins and all("token" in j or "doc_id" in j for j in joins)


def test_words_leave_in_batches():
    """A batch of texts is never held as words: what leaves has a bounded number of places, and all of them."""
    import pyarrow as pa

    from docveil.operators import tokens

    texts = ["uno Dos uno " * 1_000, None, "", "a1_b2 " * 30_000, "fin"] + ["tres 4 TRES"] * 40_000
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got, largest = set(), 0
    for b in tokens._worded(iter([batch])):
        rows = b.to_pylist()
        largest = max(largest, sum(len(r["at"]) for r in rows))
        got.update((r["doc_id"], r["token"], at) for r in rows for at in r["at"])
    assert got == {(k, m[0].lower(), m.start()) for k, t in enumerate(texts) for m in re.finditer(r"[^\W_]+", t or "")}
    assert largest <= tokens.PLACES
