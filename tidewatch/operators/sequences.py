"""Ordered chains of steps per key, also where one key holds most events.

The step events are dealt out in ranges of (key, time) and cut into blocks.  What a block does to a chain that comes into it depends only on
how many steps that has, and on the time of its last one against the first event that could go on.  So each block of a key that has several
is summed up for each number of steps, the summaries are composed in order, and every block is then folded for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import span_seconds
from ..scratch import saved
from .ordered import AT, PART, positioned

#: Step events of a block.
BLOCK = 8192
_CHAIN = "array<struct<t:bigint,id:string>>"


class _Fold:
    """The chain of a key, event by event.  An event of a chain whose time is unknown is None."""

    def __init__(self, steps: int, window: int, gap: int | None):
        self.steps, self.window, self.gap = steps, window, gap

    def run(self, rows: list[tuple], chain: list, last: int | None) -> tuple[list, int | None, list[list]]:
        """(open chain, time of the last event, completed chains) behind the rows (t, id, step)."""
        done = []
        for t, i, step in rows:
            if last is not None and t - last > self.window:
                chain = []
            last = t
            if step == len(chain) and (not chain or self.gap is None or chain[-1] is None or t - chain[-1][0] <= self.gap):
                chain = [*chain, (t, i)]
                if len(chain) == self.steps:
                    done.append(chain)
                    chain = []
        return chain, last, done

    def summary(self, rows: list[tuple]) -> dict:
        """What the rows do to a chain of each number of steps: when it would go on, and what is open behind them.

        A chain that doesn't go on at its first chance never does, as later events are further away: it ends with the first quiet time.
        """
        quiet = next((n for n in range(1, len(rows)) if rows[n][0] - rows[n - 1][0] > self.window), len(rows))
        out = {"first": rows[0][0], "last": rows[-1][0], "stuck": None, "on": [], "behind": [], "carried": []}
        if quiet < len(rows):
            out["stuck"] = self.run(rows[quiet:], [], None)[0]
        for s in range(self.steps):
            out["on"].append(next((t for t, _, step in rows[:quiet] if step == s), None))
            chain, _, _ = self.run(rows, [None] * s, None)
            out["behind"].append([x for x in chain if x is not None])
            out["carried"].append(None in chain)
        return out

    def compose(self, blocks: list[dict]) -> list[tuple[list, int | None]]:
        """The chain and the time of the last event before each block."""
        chain, last, out = [], None, []
        for b in blocks:
            out.append((chain, last))
            if last is not None and b["first"] - last > self.window:
                chain = []
            s, on = len(chain), b["on"][len(chain)]
            if on is not None and (not chain or self.gap is None or on - chain[-1][0] <= self.gap):
                chain = [*(chain if b["carried"][s] else []), *b["behind"][s]]
            elif b["stuck"] is not None:
                chain = b["stuck"]
            last = b["last"]
        return out


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows that follow each other and agree in ``by``."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[0][c] for c in by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_AT = pa.struct([("t", pa.int64()), ("id", pa.string())])
_IN = ("key", PART, "block")


def _pairs(chain: list) -> list[dict]:
    return [{"t": t, "id": i} for t, i in chain]


def _tuples(chain) -> list[tuple]:
    return [(x["t"], x["id"]) for x in chain]


def _summaries(fold: _Fold):
    schema = pa.schema([("key", pa.string()), (PART, pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("stuck", pa.list_(_AT)), ("on", pa.list_(pa.int64())), ("behind", pa.list_(pa.list_(_AT))), ("carried", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, _IN):
            s = fold.summary([(r["t"], r["id"], r["step"]) for r in rows])
            s["stuck"] = None if s["stuck"] is None else _pairs(s["stuck"])
            s["behind"] = [_pairs(c) for c in s["behind"]]
            yield pa.RecordBatch.from_pylist([{c: rows[0][c] for c in _IN} | s], schema)

    return run


def _entries(fold: _Fold):
    schema = pa.schema([("key", pa.string()), (PART, pa.int64()), ("block", pa.int64()), ("chain", pa.list_(_AT)), ("before", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda b: (b[PART], b["block"]))
        read = [b | {"stuck": None if b["stuck"] is None else _tuples(b["stuck"]), "behind": [_tuples(c) for c in b["behind"]]} for b in blocks]
        out = [{c: b[c] for c in _IN} | {"chain": _pairs(chain), "before": last} for b, (chain, last) in zip(blocks, fold.compose(read), strict=True)]
        return pa.Table.from_pylist(out, schema)

    return run


def _folded(fold: _Fold):
    schema = pa.schema([("key", pa.string()), (PART, pa.int64()), ("block", pa.int64()), ("done", pa.bool_()), ("last", pa.int64()), ("chain", pa.list_(_AT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, _IN):
            first = rows[0]
            entry = _tuples(first["chain"]) if first["chain"] else []
            chain, last, done = fold.run([(r["t"], r["id"], r["step"]) for r in rows], entry, first["before"])
            at = {c: first[c] for c in _IN}
            out = [at | {"done": True, "last": c[-1][0], "chain": _pairs(c)} for c in done]
            yield pa.RecordBatch.from_pylist([*out, at | {"done": False, "last": last, "chain": _pairs(chain)}], schema)

    return run


def chains(df: DataFrame, key: str, steps: list[tuple[str, Column]], window, max_gap=None, block: int = BLOCK) -> DataFrame:
    """(key, done, last, chain): completed chains, and behind each key's last event the chain that is open (it may be empty).

    An event counts as the first step that it meets.  Quiet for longer than ``window`` starts over; an event further than ``max_gap``
    from the chain's last is passed by; a complete chain is emitted and the next begins.  Events without a key are left out.
    """
    fold = _Fold(len(steps), span_seconds(window) * 1_000_000, span_seconds(max_gap) * 1_000_000 if max_gap else None)
    step = reduce(lambda a, ik: a.when(ik[1][1], ik[0]), enumerate(steps), F)
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    e = df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).cast("string").alias("key"), t.alias("t"), F.col("id").cast("string").alias("id"), step.alias("step")).where("step is not null")
    placed = positioned(e, ["key", "t", "id"]).withColumn("block", F.floor(F.col(AT) / block))
    spans = placed.groupBy("key").agg(F.min(F.struct(PART, "block")).alias("lo"), F.max(F.struct(PART, "block")).alias("hi"))
    several = placed.join(spans.where("lo < hi").select("key"), "key", "left_semi").select("key", PART, "block", "t", "id", "step")
    dealt = lambda x: x.repartition(*_IN).sortWithinPartitions(*_IN, "t", "id")
    summaries = dealt(several).mapInArrow(_summaries(fold), f"key string, {PART} long, block long, first long, last long, stuck {_CHAIN}, on array<bigint>, behind array<{_CHAIN}>, carried array<boolean>")
    entries = saved(summaries.groupBy("key").applyInArrow(_entries(fold), f"key string, {PART} long, block long, chain {_CHAIN}, before long"), "entries")
    whole = placed.select("key", PART, "block", "t", "id", "step").join(entries, list(_IN), "left")
    out = dealt(whole).mapInArrow(_folded(fold), f"key string, {PART} long, block long, done boolean, last long, chain {_CHAIN}")
    return out.join(spans.select("key", "hi"), "key").where(F.col("done") | (F.struct(PART, "block") == F.col("hi"))).select("key", "done", "last", "chain")


def _time(t: Column) -> Column:
    return F.timestamp_micros(t).cast("timestamp_ntz")


def sequence_rule(df: DataFrame, key: str, steps: list[tuple[str, Column]], window, max_gap=None, block: int = BLOCK) -> DataFrame:
    """(key, start, end, ids): completed ``chains`` of steps in order of time."""
    c = F.col("chain")
    return chains(df, key, steps, window, max_gap, block).where("done").select("key", _time(c[0]["t"]).alias("start"), _time(F.element_at(c, -1)["t"]).alias("end"), F.transform(c, lambda v: v["id"]).alias("ids"))


def pending_sequences(df: DataFrame, key: str, steps: list[tuple[str, Column]], window, now, max_gap=None, block: int = BLOCK) -> DataFrame:
    """(key, step, first_event, last_event, event_ids, expires_at): chains still open at ``now``, a time behind all events.

    ``step`` is the number of steps done; a chain is over when its key is quiet for longer than the window.
    """
    c = F.col("chain")
    length = span_seconds(window) * 1_000_000
    still = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) if not isinstance(now, Column) else F.unix_micros(now.cast("timestamp"))
    open_ = chains(df, key, steps, window, max_gap, block).where(~F.col("done") & (F.size("chain") > 0) & (F.col("last") + length >= still))
    return open_.select("key", F.size("chain").alias("step"), _time(c[0]["t"]).alias("first_event"), _time(F.col("last")).alias("last_event"), F.transform(c, lambda v: v["id"]).alias("event_ids"), _time(F.col("last") + length).alias("expires_at"))


__all__ = ["chains", "pending_sequences", "sequence_rule"]
