"""Sequences, correlations and novelty on a stream: list state and event-time timers of each key.

Sequences and novelty keep the keys of a bucket in one table of state; correlations keep a list for each key.
Events are appended to a key's list as they come, and results are given at once.  Where they come in order of time, a key goes on from where
it is; an earlier event that comes later, but before the watermark, makes it go through its list again.  What the watermark has passed is
settled, and a timer of the key takes it from the list; another one ends a chain, a window or a pair that has been quiet for too long.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.exprs import span_seconds

#: The state store that list state and timers need; set for the session where a query is started (``with_timers``).
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


class with_timers:  # noqa: N801
    """Within this block, queries that are started keep their state in the store that timers need."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(_PROVIDER_KEY, None)
        self.conf.set(_PROVIDER_KEY, PROVIDER)

    def __exit__(self, *_) -> None:
        self.conf.unset(_PROVIDER_KEY) if self.before is None else self.conf.set(_PROVIDER_KEY, self.before)


def _moment(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class _Keyed(StatefulProcessor):
    """What the processors share: events of a batch in order, and one timer for each key."""

    output: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        # Rows: a frame for each key would cost more than its few events.
        new = sorted((r["t"], r["id"], r["mark"]) for r in rows)
        for r in self.take(key[0], new) if new else ():
            yield Row(**dict(zip(self.output, r, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        self.due.clear()
        self.settle(timerValues.getCurrentWatermarkInMs())
        yield from ()

    def wake(self, at: int) -> None:
        """A timer at ``at`` (milliseconds), if the key has none: it sets the next one when it is called."""
        if self.due.get() is None:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def take(self, key: str, new: list[tuple]) -> list[tuple]:
        """The results of events (time in microseconds, id, mark) of a batch."""
        raise NotImplementedError

    def settle(self, mark: int) -> None:
        """Gives up what no event at ``mark`` (milliseconds) or after it can change."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _passed(t: int, mark: int) -> bool:
    return t // 1000 + 1 < mark


def _set(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


class Correlation(_Keyed):
    """Enough conditions within a trailing window; after each result the key starts over.

    The list is appended to, and written anew when half of it has left the window.
    """

    output = ["key", "timestamp", "id", "matched"]

    def __init__(self, least: list[int], need: int, window: int):
        self.least, self.need, self.window = least, need, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "t long, mark int")

    def take(self, key, new):
        old = [(t, "", b, False) for t, b in map(tuple, self.recent.get())]
        window, counts, out, gone = deque(), [0] * len(self.least), [], 0
        for t, i, bits, fresh in sorted([*old, *((*r, True) for r in new)]):
            window.append((t, bits))
            counts = [c + (bits >> x & 1) for x, c in enumerate(counts)]
            while window[0][0] < t - self.window:
                counts = [c - (window[0][1] >> x & 1) for x, c in enumerate(counts)]
                window.popleft()
                gone += 1
            matched = sum(c >= m for c, m in zip(counts, self.least, strict=True))
            if fresh and matched >= self.need:
                out.append((key, _moment(t), i, matched))
                window.clear()
                counts = [0] * len(self.least)
        if out or 2 * gone > len(old):
            _set(self.recent, list(window))
        else:
            self.recent.appendList([(t, b) for t, _, b in new])
        if window:
            self.wake((window[-1][0] + self.window) // 1000 + 2)
        return out

    def settle(self, mark):
        left = sorted(r for r in map(tuple, self.recent.get()) if not _passed(r[0] + self.window, mark))
        _set(self.recent, left)
        if left:
            self.wake((left[-1][0] + self.window) // 1000 + 2)


class _Bucketed(StatefulProcessor):
    """What processors of a bucket of keys share: the state is one table for a bucket, read and written once a batch, and one timer.

    Calls to the state store and the set-up of a group cost far more than a key's few events; so they are paid for each bucket.
    """

    output: list[str] = []
    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", self.state)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows), ignore_index=True).sort_values(["key", "t", "id"], kind="stable", ignore_index=True)
        out, due = self.take(new)
        at = self.due.get()
        if due is not None and (at is None or due < at[0]):
            if at is not None:
                self.handle.deleteTimer(at[0])
            self.handle.registerTimer(due)
            self.due.update((due,))
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        due = self.settle(timerValues.getCurrentWatermarkInMs())
        if due is None:
            self.due.clear()
        else:
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield from ()

    def read(self) -> list[list]:
        """The columns of the table."""
        return [list(c) for c in self.table.get() or [[]] * self.state.count(",") + [[]]]

    def write(self, *columns) -> None:
        if len(columns[0]):
            self.table.update(tuple(list(c) for c in columns))
        else:
            self.table.clear()

    def take(self, new: pd.DataFrame) -> tuple[pd.DataFrame, int | None]:
        """The results of a batch's events (key, t, id, mark), in order, and when to settle (milliseconds)."""
        raise NotImplementedError

    def settle(self, mark: int) -> int | None:
        """Gives up what no event at ``mark`` (milliseconds) or after it can change; the time to settle again."""
        raise NotImplementedError

    def close(self) -> None:
        pass


_HELD, _CHAIN, _SETTLED, _LAST, _SETTLED_LAST = range(5)


class _Chains:
    """A key's state in a sequence.

    ``chain`` and ``last`` are the open chain and the time of the last event; ``settled`` and ``settled_last`` are the same before the
    events of ``held``, which may still get company.
    """

    __slots__ = ("chain", "held", "last", "settled", "settled_last")

    def __init__(self):
        self.held, self.chain, self.settled, self.last, self.settled_last = [], [], [], None, None


class Sequence(_Bucketed):
    """Chains of steps.  A row of the table is an event of a key, with its place in the key's state (``_HELD`` to ``_SETTLED_LAST``)."""

    output = ["key", "start", "end", "ids"]
    state = "key array<string>, kind array<int>, t array<long>, id array<string>, mark array<int>"

    def __init__(self, steps: int, window: int, gap: int | None):
        self.steps, self.window, self.gap = steps, window, gap

    def _load(self) -> dict[str, _Chains]:
        keys: dict[str, _Chains] = {}
        for key, kind, t, i, step in zip(*self.read(), strict=True):
            k = keys.get(key)
            if k is None:
                k = keys[key] = _Chains()
            if kind == _HELD:
                k.held.append((t, i, step))
            elif kind == _CHAIN:
                k.chain.append((t, i))
            elif kind == _SETTLED:
                k.settled.append((t, i))
            elif kind == _LAST:
                k.last = t
            else:
                k.settled_last = t
        return keys

    def _save(self, keys: dict[str, _Chains]) -> int | None:
        """Writes the table; the time when the first key is to be settled."""
        rows = []
        for key, k in keys.items():
            rows += [(key, _HELD, *r) for r in k.held]
            rows += [(key, _CHAIN, t, i, n) for n, (t, i) in enumerate(k.chain)]
            rows += [(key, _SETTLED, t, i, n) for n, (t, i) in enumerate(k.settled)]
            rows += [(key, kind, t, "", 0) for kind, t in ((_LAST, k.last), (_SETTLED_LAST, k.settled_last)) if t is not None]
        self.write(*(zip(*rows, strict=True) if rows else [[]] * 5))
        return min((self._due(k) for k in keys.values()), default=None)

    def _due(self, k: _Chains) -> int:
        if k.held:
            return k.held[-1][0] // 1000 + 1
        return (k.last + self.window) // 1000 + 2 if k.chain else k.last // 1000 + 1

    def _fold(self, rows: list[tuple], chain: list[tuple], last: int | None) -> tuple[list[tuple], int | None, list[list[tuple]], list[tuple]]:
        """(open chain, last time, completed chains, rows behind the last of them)."""
        done, rest = [], []
        for t, i, step in rows:
            if last is not None and t - last > self.window:
                chain = []
            last = t
            rest.append((t, i, step))
            if step == len(chain) and (not chain or self.gap is None or t - chain[-1][0] <= self.gap):
                chain = [*chain, (t, i)]
                if len(chain) == self.steps:
                    done.append(chain)
                    chain, rest = [], []
        return chain, last, done, rest

    def _add(self, k: _Chains, new: list[tuple]) -> list[list[tuple]]:
        """The chains that a key's new events complete."""
        chain, last, rows = k.chain, k.last, new
        if last is not None and new[0][0] <= last:
            chain, last, rows = k.settled, k.settled_last, sorted([*k.held, *new])
            k.held = rows
        else:
            k.held = [*k.held, *new]
        k.chain, k.last, done, rest = self._fold(rows, chain, last)
        if done:  # what a complete chain has used is settled
            k.settled, k.settled_last, k.held = [], done[-1][-1][0], rest
        return done

    def take(self, new):
        keys, out = self._load(), []
        for key, rows in groupby(zip(new["key"].tolist(), new["t"].tolist(), new["id"].tolist(), new["mark"].tolist(), strict=True), lambda r: r[0]):
            done = self._add(keys.setdefault(key, _Chains()), [(t, i, int(m)) for _, t, i, m in rows])
            out += [(key, _moment(c[0][0]), _moment(c[-1][0]), [i for _, i in c]) for c in done]
        return pd.DataFrame(out, columns=self.output), self._save(keys)

    def settle(self, mark):
        keys = {}
        for key, k in self._load().items():
            now = [r for r in k.held if r[0] // 1000 < mark]
            k.held = k.held[len(now) :]
            k.settled, k.settled_last, *_ = self._fold(now, k.settled, k.settled_last)
            if k.held or not (_passed(k.last, mark) if not k.settled else _passed(k.settled_last + self.window, mark)):
                keys[key] = k
        return self._save(keys)


class Novelty(_Bucketed):
    """The first event of a key, and the first after it was quiet for longer than ``forget``.  The table holds each key's last time."""

    output = ["key", "first_seen", "id"]
    state = "key array<string>, t array<long>"

    def __init__(self, forget: int):
        self.forget = forget

    def take(self, new):
        key, last = self.read()
        known = pd.Series(np.array(last, dtype="int64"), index=pd.Index(key, dtype=object))
        t, same = new["t"].to_numpy(), (new["key"] == new["key"].shift()).to_numpy()
        before = known.reindex(new["key"]).to_numpy(dtype="float64", na_value=np.nan)
        seen = ~np.isnan(before)
        before = np.where(seen, before, 0).astype("int64")
        # The time before an event is the latest of the key's events in the batch and of what is known.
        prior = np.where(same, np.where(seen, np.maximum(before, np.roll(t, 1)), np.roll(t, 1)), before)
        first = new[(~same & ~seen) | (t - prior > self.forget)]
        newest = new.groupby("key", sort=False)["t"].max()
        both = pd.concat([known, newest]).groupby(level=0, sort=False).max()
        self.write(both.index.tolist(), both.tolist())
        return pd.DataFrame({"key": first["key"], "first_seen": pd.to_datetime(first["t"], unit="us"), "id": first["id"]}), (int(both.min()) + self.forget) // 1000 + 2

    def settle(self, mark):
        left = [(k, t) for k, t in zip(*self.read(), strict=True) if not _passed(t + self.forget, mark)]
        self.write(*(zip(*left, strict=True) if left else [[], []]))
        return (min(t for _, t in left) + self.forget) // 1000 + 2 if left else None


#: Buckets of keys whose states are read and written together.
BUCKETS = 512


def _marked(sdf: DataFrame, key: str, mark: Column, keep: Column, late: str) -> DataFrame:
    marked = sdf.withWatermark("timestamp", late)
    rows = marked.select(F.col(key).alias("key"), "timestamp", F.unix_micros("timestamp").alias("t"), F.col("id").cast("string").alias("id"), mark.alias("mark"))
    return rows.where(F.col("key").isNotNull() & (F.col("key") != "") & keep)


def _keyed(sdf: DataFrame, key: str, mark: Column, keep: Column, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return _marked(sdf, key, mark, keep, late).groupBy("key").transformWithState(processor, StructType.fromDDL(schema), "append", "EventTime")


def _bucketed(sdf: DataFrame, key: str, mark: Column, keep: Column, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows = _marked(sdf, key, mark, keep, late).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(processor, StructType.fromDDL(schema), "append", "EventTime")


def stream_sequence(sdf: DataFrame, key: str, steps: list[tuple[str, Column]], window, max_gap=None, late="10 minutes") -> DataFrame:
    """(key, start, end, ids): chains of steps as ``sequence_rule`` gives them, as soon as they are complete.

    A key's state is its open chain and its step events after the watermark; a chain whose window has passed leaves it.
    """
    step = F.lit(None).cast("int")
    for i, (_, test) in reversed(list(enumerate(steps))):
        step = F.when(test, i).otherwise(step)
    processor = Sequence(len(steps), span_seconds(window) * 1_000_000, span_seconds(max_gap) * 1_000_000 if max_gap else None)
    return _bucketed(sdf, key, step, F.col("mark").isNotNull(), late, processor, "key string, start timestamp, end timestamp, ids array<string>")


def stream_correlation(sdf: DataFrame, key: str, tests: dict[str, tuple[Column, int]], window, require: str = "all", min_match: int | None = None, late="10 minutes") -> DataFrame:
    """(key, timestamp, id, matched): where enough conditions hold over the trailing window; the key starts over after each.

    A key's state is every event of the trailing window that meets a condition, however many.
    """
    need = len(tests) if require == "all" else (min_match or len(tests) - 1)
    bits = F.lit(0)
    for i, (test, _) in enumerate(tests.values()):
        bits = bits + F.when(test, 1 << i).otherwise(0)
    processor = Correlation([m for _, m in tests.values()], need, span_seconds(window) * 1_000_000)
    return _keyed(sdf, key, bits, F.col("mark") > 0, late, processor, "key string, timestamp timestamp, id string, matched int")


def stream_novelty(sdf: DataFrame, entity: str, value: str, late="10 minutes", forget="90d") -> DataFrame:
    """(key, first_seen, id): the first event of each pair of entity and value, and of its return after ``forget`` of quiet.

    A pair is given at once: an earlier event that comes in a later batch is not its first one any more.  Its state is one time, and
    goes when the pair is forgotten.
    """
    pair = sdf.withColumn("__pair", F.concat_ws(">", entity, value))
    known = F.col("mark").isNotNull()
    return _bucketed(pair, "__pair", F.when(F.col(entity).isNotNull() & F.col(value).isNotNull(), 0), known, late, Novelty(span_seconds(forget) * 1_000_000), "key string, first_seen timestamp, id string")


def sequence_states(spark: SparkSession, checkpoint: str, rule_id: str, window) -> DataFrame:
    """(rule_id, key, step, first_event, last_event, event_ids, expires_at): open chains in the state of a ``stream_sequence`` query.

    Read from the last finished batch of its checkpoint, whether the query runs or not.  ``step`` is the number of steps done.  Chains that
    the watermark has found quiet for too long are gone.
    """
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    table = spark.read.format("statestore").option("stateVarName", "table").load(checkpoint).select("value.*")
    rows = table.select(F.explode(F.arrays_zip("key", "kind", "t", "id")).alias("r")).select("r.*")
    chain = F.sort_array(F.collect_list(F.when(F.col("kind") == _CHAIN, F.struct("t", "id"))))
    out = rows.groupBy("key").agg(chain.alias("c"), F.max(F.when(F.col("kind") == _LAST, F.col("t"))).alias("last")).where(F.size("c") > 0)
    return out.select(
        F.lit(rule_id).alias("rule_id"), "key", F.size("c").alias("step"), at(F.col("c")[0]["t"]).alias("first_event"), at(F.col("last")).alias("last_event"),
        F.transform("c", lambda x: x["id"]).alias("event_ids"), at(F.col("last") + span_seconds(window) * 1_000_000).alias("expires_at"),
    )


__all__ = ["Correlation", "Novelty", "Sequence", "sequence_states", "stream_correlation", "stream_novelty", "stream_sequence", "with_timers"]
