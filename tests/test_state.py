"""The memo, the registry of jobs and the labels, as batches and as streams that are stopped and started again, against plain simulations."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docveil.plans import queries as plans
from docveil.streaming import state
from docveil.streaming.jobs import run_available

MINUTE = 60_000


def simulated_memo(rows, age, most):
    """rows: (scope, id, ms, entry)"""
    held, out = defaultdict(dict), set()
    for scope, i, now, entry in sorted(rows, key=lambda r: (r[2], r[1])):
        own = held[scope]
        hit = entry in own and now - own[entry] <= age
        if not hit:
            for k in [k for k, t in own.items() if now - t > age]:
                del own[k]
            while len(own) >= most:
                del own[next(iter(own))]
            own[entry] = now
        out.add((scope, i, hit, len(own)))
    return out


def simulated_registry(rows, budget, forget):
    """rows: (job, id, ms, kind, result); what is still awaited at the end is left out."""
    jobs, waits, out = {}, defaultdict(dict), set()
    for job, i, now, kind, result in sorted(rows, key=lambda r: (r[2], r[1])):
        for call, until in list(waits[job].items()):
            if until < now:
                out.add((job, call, until, "pending", None))
                del waits[job][call]
        if job in jobs and jobs[job][0] != "running" and now - jobs[job][2] > forget:
            del jobs[job]
        if kind == "call":
            if job in jobs and jobs[job][0] != "running":
                status, got, _ = jobs.pop(job)
                out.add((job, i, now, status, got))
                continue
            if job not in jobs:
                jobs[job] = ("running", None, now)
                out.add((job, i, now, "started", None))
            waits[job][i] = now + budget
        elif jobs.get(job, ("",))[0] == "running":
            if waits[job]:
                first = min(waits[job])
                out |= {(job, c, now, kind if c == first else "delivered", result if c == first else None) for c in waits[job]}
                waits[job].clear()
                del jobs[job]
            else:
                jobs[job] = (kind, result, now)
    return out


def _frame(spark, rows, columns, path=None):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=columns)).withColumn("at", F.timestamp_millis("at"))
    if path:
        df.coalesce(1).write.mode("append").parquet(path)
    return df


@pytest.fixture
def requests():
    rng = random.Random(3)
    return [(rng.choice([0, 0, 0, 1, 2]), i, rng.randrange(300) * MINUTE + rng.randrange(3) * 1000, f"e{rng.randrange(12)}") for i in range(3000)]


@pytest.fixture
def log():
    rng = random.Random(4)
    kinds = [("call", None), ("call", None), ("done", "r"), ("error", "x")]
    rows, now = [], 1_000_000
    for i in range(1500):
        now += rng.choice([0, 5_000, 20_000, 40_000, 300_000, 31 * MINUTE])
        kind, result = rng.choice(kinds)
        rows.append((rng.randrange(4), i, now, kind, result and f"{result}{i}"))
    return rows


def _got(df, ms=None):
    return [tuple(int(v.timestamp() * 1000) if c == ms else v for c, v in r.asDict().items()) for r in df.collect()]


def test_memo_batch(spark, requests):
    """A key with far more rows than an Arrow batch streams through in order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = _got(state.memo(_frame(spark, requests, ["scope_id", "id", "at", "entry"]), most=5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = simulated_memo(requests, state.MEMO_MS, 5)
    assert set(got) == want and len(got) == len(want)
    assert any(h for _, _, h, _ in want) and {n for *_, n in want} == {1, 2, 3, 4, 5}


def test_memo_stream(spark, requests, tmp_path):
    """Stopped and started again between micro-batches, the stream remembers."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    requests = sorted(requests, key=lambda r: (r[2], r[1]))
    schema = _frame(spark, requests[:1], ["scope_id", "id", "at", "entry"]).schema
    for part in (requests[:1000], requests[1000:1100], requests[1100:]):
        _frame(spark, part, ["scope_id", "id", "at", "entry"], src)
        run_available(state.memo(spark.readStream.schema(schema).parquet(src), most=5), out, check, single=True)
    got = _got(spark.read.parquet(out))
    assert set(got) == simulated_memo(requests, state.MEMO_MS, 5) and len(got) == len(requests)


def test_registry_batch(spark, log):
    got = _got(state.registry(_frame(spark, log, ["job", "id", "at", "kind", "result"])), "at")
    want = simulated_registry(log, state.BUDGET_MS, state.FORGET_MS)
    assert set(got) == want and len(got) == len(want)
    results = [r[4] for r in got if r[4]]
    assert len(results) == len(set(results)) > 50 and {r[3] for r in want} == {"started", "pending", "done", "error", "delivered"}


def test_registry_stream(spark, log, tmp_path):
    """Started again from its checkpoint, each result is delivered once; budgets end by timers."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    columns = ["job", "id", "at", "kind", "result"]
    end = [(9, 9_000_000 + k, log[-1][2] + (k + 1) * 3_600_000, "call", None) for k in range(2)]  # moves the watermark on
    schema = _frame(spark, log, columns).schema
    for part in (log[:500], log[500:510], log[510:], end[:1], end[1:]):
        _frame(spark, part + [(8, -1, part[0][2], "done", "none")], columns, src)
        run_available(state.registry(spark.readStream.schema(schema).parquet(src)), out, check)
    got = [r for r in _got(spark.read.parquet(out), "at") if r[0] < 8]
    # what is still awaited at the end of the log is pending by timer
    want = simulated_registry(log + [(j, 10**9 + j, log[-1][2] + 3_000_000, "done", "end") for j in range(4)], state.BUDGET_MS, state.FORGET_MS)
    want = {r for r in want if r[4] != "end"}
    assert set(got) == want and len(got) == len(want)


def test_queries_with_state(spark, sf):
    events = [(r.user_id, r.event_id, int(r.ts.timestamp() * 1000), f"{r.event_type}-{r.event_id % 3}") for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    got = _got(plans.memo_hits(spark, sf))
    assert set(got) == simulated_memo(events, state.MEMO_MS, state.MEMO_MAX) and len(got) == len(events)
    log = [(u, i, t, "done" if i % 2 else "call", str(i) if i % 2 else None) for u, i, t, _ in events]
    got = _got(plans.job_registry(spark, sf), "at")
    want = simulated_registry(log, state.BUDGET_MS, state.FORGET_MS)
    assert set(got) == want and len(got) == len(want)


def test_labels_batch(spark):
    rows = [("s", "PERSONA", k) for k in ("a", "b", "a", "c")] + [("s", "DNI", "a"), ("t", "PERSONA", "b"), ("t", "PERSONA", "b")]
    got = {tuple(r) for r in state.labelled(spark.createDataFrame(rows, "scope_id string, base string, key string").coalesce(1)).collect()}
    assert got == {("s", "PERSONA", "a", 1), ("s", "PERSONA", "b", 2), ("s", "PERSONA", "c", 3), ("s", "DNI", "a", 1), ("t", "PERSONA", "b", 1)}


def test_a_batch_keeps_its_state_in_memory(spark):
    keys = [2**60 + 1, 2**60 + 2, None]
    rows = spark.createDataFrame([(k, n, n, e) for k in keys for n, e in enumerate("aab")], "scope_id long, id long, t long, entry string").select("scope_id", "id", F.timestamp_seconds("t").alias("at"), "entry")
    out = state.memo(rows)
    assert "TransformWithState" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(k, n, hit, held) for k in keys for n, hit, held in ((0, False, 1), (1, True, 1), (2, False, 2))}
    log = rows.select(F.col("scope_id").cast("string").alias("job"), "id", "at", F.when(F.col("id") == 1, "done").otherwise("call").alias("kind"), F.col("entry").alias("result"))
    got = sorted((r.job or "", r.call, r.status) for r in state.registry(log).collect())
    assert got == sorted((str(k) if k else "", c, s) for k in keys for c, s in ((0, "started"), (0, "done"), (2, "started")))
