"""The only longer form of a shorter one, against trying all pairs, and counts of confidence."""

import random

from docveil import api
from docveil.operators.entities import only_container

SCHEMA = "scope_id long, id long, tokens array<string>, note string"


def test_it_is_what_all_pairs_give(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(9)]
    make = lambda n, most, first: [(rng.randrange(4), first + k, [rng.choice(words) for _ in range(rng.randrange(most))], "x") for k in range(n)]
    short, long = make(200, 4, 0), make(60, 9, 1000)
    short += [(9, 500, ["w1"], None), (1, 501, None, None), (1, 502, [None, "w1", "w2"], None), (None, 503, ["w1"], None), (1, 504, ["nowhere"], None)]
    long += [(1, 2000, None, None), (None, 2001, ["w1"], None), (9, 2002, ["w1", "w2"], None), (9, 2002, ["w2", "w1"], None), (8, 2003, ["w1"], None), (8, 2004, ["w1"], None)]
    short += [(8, 505, ["w1"], None), (8, 505, ["w1"], None)]
    want = set()
    for scope, i, tokens, _ in short:
        own = {t for t in tokens or [] if t}
        hits = {k for s, k, held, _ in long if s == scope and s is not None and own and own <= set(held or [])}
        if len(hits) == 1:
            want.add((scope, i, hits.pop()))
    got = only_container(spark.createDataFrame(short, SCHEMA), spark.createDataFrame(long, SCHEMA)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20 and (9, 500, 2002) in want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, ["a"], "x")], SCHEMA)
    assert only_container(none, some).count() == only_container(some, none).count() == 0


def test_counts_of_confidence(spark):
    found = spark.createDataFrame([(1, "dni", "alta"), (1, "dni", "media"), (2, "dni", "alta"), (2, "email", None)], "doc_id long, type string, confidence string")
    assert sorted(map(tuple, api.confidence_of(found).collect())) == [("dni", 2, 1, 0), ("email", 0, 0, 0)]
    assert api.confidence_of(found.limit(0)).count() == 0
