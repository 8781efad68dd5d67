"""Operators with state of their own, for streams and batches alike: a memo of bounded size and age, a registry of jobs, and labels.

State is in maps by key, so that a row reads and writes the entries that it needs, however many there are.  A batch is one run over empty
state, which for the memo and the registry is in the memory of the task, one key's at a time, as no later batch asks for it.  Rows of a key are
taken in order of time, then id: a batch is sorted beforehand and streams through; of a stream, the rows that a key has in one micro-batch are held.  Rows that come after later ones of an earlier micro-batch count as if they came with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: How long what was read is remembered, and how much of it; how long a call works, and how long a result waits to be collected.
MEMO_MS, MEMO_MAX = 30 * 60 * 1000, 300
BUDGET_MS, FORGET_MS = 40_000, 30 * 60 * 1000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Maps as state need the RocksDB store, and batches a stream manager that is awake."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    spark.streams.active  # noqa: B018


def _rows(frames: Iterator[pd.DataFrame], held: bool) -> Iterator[tuple]:
    """Rows in order of time and id; frames that come in order are not held."""
    if held:
        yield from pd.concat(list(frames)).sort_values(["at", "id"], kind="stable").itertuples(index=False)
        return
    last = None
    for f in frames:
        for r in f.itertuples(index=False):
            if last is not None and (r.at, r.id) < last:
                raise ValueError("rows of a key are not in order of time")
            last = (r.at, r.id)
            yield r


class _Value:
    """A value's state in memory."""

    def __init__(self):
        self.value = None

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None


class _Map(dict):
    """A map's state in memory."""

    containsKey, getValue, updateValue, iterator = dict.__contains__, dict.get, dict.__setitem__, dict.items  # noqa: N815

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.pop(key, None)


class _Memory:
    """State of one key of a batch: empty when its rows begin, gone when they end."""

    def getValueState(self, *_) -> _Value:  # noqa: N802
        return _Value()

    def getMapState(self, *_) -> _Map:  # noqa: N802
        return _Map()


def _in_memory(key: str, processor: StatefulProcessor, whole: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each key's rows, which come together and in order, through the processor.  ``_key`` is the key as text, as nulls turn whole numbers into others."""

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            texts, at = [None if pd.isna(t) else t for t in f["_key"]], 0
            for text, same in groupby(texts):
                n = len(list(same))
                part = f.iloc[at : at + n]
                yield text, None if text is None else int(text) if whole else part[key].iloc[0], part
                at += n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, parts in groupby(stretches(frames), lambda x: x[0]):
            first = next(parts)
            processor.init(_Memory())
            rest = (p for x in ([first], parts) for _, _, p in x)
            yield from processor.handleInputRows((first[1],), rest, None)

    return run


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str, timed: bool) -> DataFrame:
    """Rows with (key, at, id) through a processor.  ``timed`` processors get event-time timers on a stream, others state that expires."""
    rows = rows.withColumn("at", F.col("at").cast("timestamp"))
    if rows.isStreaming:
        with_state(rows.sparkSession)
        rows = rows.withWatermark("at", late) if timed else rows
        return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime" if timed else "ProcessingTime")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.withColumn("_key", F.col(key).cast("string")).repartition(n, key).sortWithinPartitions(key, "at", "id")
    return in_order.mapInPandas(_in_memory(key, processor, dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")), schema)


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


# ---------------------------------------------------------------- memo


class Memo(StatefulProcessor):
    """Entries by key and, numbered, in order of their coming: the oldest is dropped by its number."""

    def __init__(self, key: str, streaming: bool, age: int, most: int):
        self.key, self.streaming, self.age, self.most = key, streaming, age, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a stream's state of scopes that fall silent expires by itself, at the age at which it has no use any more
        ttl = self.age if self.streaming else None
        self.entries = handle.getMapState("entries", "entry string", "at long", ttl)
        self.order = handle.getMapState("order", "seq long", "entry string, at long", ttl)
        self.ends = handle.getValueState("ends", "first long, next long", ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, end = self.ends.get() if self.ends.exists() else (0, 0)
        out = []
        for r in _rows(rows, self.streaming):
            now, entry = _ms(r.at), (r.entry,)
            known = self.entries.getValue(entry) if self.entries.containsKey(entry) else None
            hit = known is not None and now - known[0] <= self.age
            if not hit:
                while first < end:  # what is too old or one too many goes, in order of coming
                    if self.order.containsKey((first,)):
                        old, at = self.order.getValue((first,))
                        if now - at <= self.age and end - first < self.most:
                            break
                        self.entries.removeKey((old,))
                        self.order.removeKey((first,))
                    first += 1
                self.entries.updateValue(entry, (now,))
                self.order.updateValue((end,), (r.entry, now))
                end += 1
            out.append((key[0], r.id, hit, end - first))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=[self.key, "id", "hit", "held"])
                out = []
        self.ends.update((first, end))
        yield pd.DataFrame(out, columns=[self.key, "id", "hit", "held"])

    def close(self) -> None:
        pass


def memo(requests: DataFrame, key: str = "scope_id", age_ms: int = MEMO_MS, most: int = MEMO_MAX) -> DataFrame:
    """(key, id, hit, held) for requests (key, id, at, entry): whether the entry was remembered when asked for, and how many are then.

    An entry is remembered for ``age_ms`` from the request that made it, at most ``most`` at once; the first to come is the first to go.  A request
    that misses makes it anew.
    """
    kind = dict(requests.dtypes)[key]
    ident = dict(requests.dtypes)["id"]
    return _run(requests.select(key, "id", "at", "entry"), key, Memo(key, requests.isStreaming, age_ms, most), f"{key} {kind}, id {ident}, hit boolean, held long", "0 seconds", False)


# ---------------------------------------------------------------- registry of jobs


class Registry(StatefulProcessor):
    """A job by key: running since, or its result and since when; and the call that waits for it."""

    COLUMNS = ("call", "at", "status", "result")

    def __init__(self, key: str, streaming: bool, budget: int, forget: int):
        self.key, self.streaming, self.budget, self.forget = key, streaming, budget, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, result string, since long")
        self.waiting = handle.getMapState("waiting", "call long", "until long")

    def _timer(self, at: int) -> None:
        if self.streaming:
            self.handle.registerTimer(at)

    def _late(self, now: int) -> list[tuple]:
        """Calls whose budget ended before ``now``: they are told that the job goes on, and wait no more."""
        ended = sorted((until[0], call[0]) for call, until in self.waiting.iterator() if until[0] < now)
        for _, call in ended:
            self.waiting.removeKey((call,))
        return [(call, until, "pending", None) for until, call in ended]

    def _forgotten(self, now: int) -> None:
        if self.job.exists() and self.job.get()[0] != "running" and now - self.job.get()[2] > self.forget:
            self.job.clear()

    def _one(self, r: tuple) -> list[tuple]:
        now = _ms(r.at)
        out = self._late(now)
        self._forgotten(now)
        job = self.job.get() if self.job.exists() else None
        if r.kind == "call":
            if job is not None and job[0] != "running":
                self.job.clear()  # delivered once
                return [*out, (r.id, now, job[0], job[1])]
            if job is None:
                self.job.update(("running", None, now))
                out.append((r.id, now, "started", None))
            self.waiting.updateValue((r.id,), (now + self.budget,))
            self._timer(now + self.budget + 1)
        elif job is not None and job[0] == "running":
            waits = sorted(call[0] for call in self.waiting.keys())
            if waits:  # the first call that waits gets the result; others are told that it was delivered
                out += [(call, now, r.kind if call == waits[0] else "delivered", r.result if call == waits[0] else None) for call in waits]
                self.waiting.clear()
                self.job.clear()
            else:
                self.job.update((r.kind, r.result, now))
                self._timer(now + self.forget + 1)
        return out

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], call, pd.Timestamp(at, unit="ms"), status, result) for call, at, status, result in out]
        return pd.DataFrame(rows, columns=[self.key, *self.COLUMNS])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for r in _rows(rows, self.streaming):
            out += self._one(r)
            if len(out) >= 10_000:
                yield self._frame(key, out)
                out = []
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = self._late(now)
        self._forgotten(now)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def registry(log: DataFrame, key: str = "job", budget_ms: int = BUDGET_MS, forget_ms: int = FORGET_MS, late: str = "10 seconds") -> DataFrame:
    """(key, call, at, status, result): what calls are told of jobs, from a log (key, id, at, kind, result) of calls and results.

    ``kind`` is call, done or error.  The first call starts the job.  A call waits for its budget: it gets the result if that comes in time,
    else "pending".  A result that nobody waits for goes to the next call; each is delivered once, and forgotten if nobody calls for it within
    ``forget_ms``.  A batch says "pending" when the key's next row comes, a stream when its watermark passes.
    """
    kind = dict(log.dtypes)[key]
    rows = log.select(key, F.col("id").cast("long").alias("id"), "at", "kind", "result")
    return _run(rows, key, Registry(key, log.isStreaming, budget_ms, forget_ms), f"{key} {kind}, call long, at timestamp, status string, result string", late, True)


# ---------------------------------------------------------------- labels


class Labels(StatefulProcessor):
    def __init__(self, key: str, streaming: bool, ttl: int):
        self.key, self.ttl = key, ttl if streaming else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nums = handle.getMapState("nums", "base string, key string", "num int", self.ttl)
        self.last = handle.getMapState("last", "base string", "num int", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out, seen = [], {}
        for f in rows:
            for r in f.itertuples(index=False):
                if (r.base, r.key) in seen:
                    continue
                if self.nums.containsKey((r.base, r.key)):
                    num = self.nums.getValue((r.base, r.key))[0]
                else:
                    num = (self.last.getValue((r.base,))[0] if self.last.containsKey((r.base,)) else 0) + 1
                    out.append((key[0], r.base, r.key, num))
                    self.last.updateValue((r.base,), (num,))
                seen[r.base, r.key] = num
                self.nums.updateValue((r.base, r.key), (num,))  # anew, so that what is in use doesn't expire
                self.last.updateValue((r.base,), (max(num, self.last.getValue((r.base,))[0] if self.last.containsKey((r.base,)) else num),))
        yield pd.DataFrame(out, columns=[self.key, "base", "key", "num"])

    def close(self) -> None:
        pass


def labelled(keys: DataFrame, scope: str = "scope_id", ttl_ms: int = FORGET_MS) -> DataFrame:
    """(scope, base, key, num): labels numbered by first appearance in each scope, over a stream or batch of (scope, base, key, …).

    On a stream a label is forgotten ``ttl_ms`` after its last row.
    """
    with_state(keys.sparkSession)
    kind = dict(keys.dtypes)[scope]
    mode = "ProcessingTime" if keys.isStreaming else "none"
    return keys.select(scope, "base", "key").groupBy(scope).transformWithStateInPandas(Labels(scope, keys.isStreaming, ttl_ms), f"{scope} {kind}, base string, key string, num int", "append", mode)
