"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, without blank or repeated turns.

Turns are dealt out by ranges of (conversation, turn), so that a long conversation lies in many tasks, and within a task in pieces of
PIECE turns.  A conversation that one piece holds is solved there by the auction over its lattice (``auction``).  For the others, each
piece gives its costs from state to state, prices behind the pieces follow from them, every piece is then traced for itself from each
state that it may be entered in, and one pass in order takes up the traces: it holds no more than a turn and the hash so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import auction
from .scratch import Scratch

#: Turns of a piece; the auction's work in a piece grows faster than its turns.
PIECE = 64
#: Rows that a Python worker holds before it hands them on.
_OUT = 500
_SPACE = "\\x20\\x09-\\x0D"
_TURN = "conv string, turn long, role string, text string"
_PIECE = "conv string, part int, piece int, turns array<long>, roles array<string>, texts array<string>, kinds array<int>"
_AUDIT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPAIRED = "conv string, position long, edit string, turn long, role string, text string"


def _name(conv: Column) -> Column:
    """A conversation's id as text; a null one is a space, which no number is written as."""
    return F.coalesce(conv.cast("string"), F.lit(" "))


def turns(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv string, turn long, role string, text string) of the rows; a null role or text is one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(_name(F.col(conv_col)).alias("conv"), F.col("turn").cast("long").alias("turn"), *filled)


def damaged(rows: DataFrame) -> DataFrame:
    """``turns`` with the faults that crc32 of conversation and turn chooses: dropped, emptied, without stops, repeated, or the user's."""
    fault = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    left = rows.withColumn("fault", fault).where("fault != 0")
    return left.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("sequence(1, if(fault = 3, 2, 1))")).alias("copy")).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Distinct turns with how often they stand (``times``), and the kinds of the first and of the further ones (``kind``, ``again``).

    A turn is a duplicate where its role and text stood in the conversation before; equal rows are counted before anything moves.
    """
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    once = once.withColumn("name", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = once.groupBy("conv", "name").agg(F.min("at").alias("first"))
    both = once.join(first, ["conv", "name"])
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    broken = ~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z")
    sound = F.when(broken, auction.TRUNCATED).otherwise(auction.SOUND)
    repeat = F.when(blank, auction.BLANK).otherwise(auction.DUPLICATE)
    kind = F.when(blank, auction.BLANK).when(~F.col("at").eqNullSafe(F.col("first")), auction.DUPLICATE).otherwise(sound)
    return both.select("conv", "turn", "role", "text", "times", kind.alias("kind"), repeat.alias("again"))


class _Audit:
    """The columns of a conversation's audit, turn by turn."""

    schema = _AUDIT

    def __init__(self, conv: str):
        self.conv, self.kinds, self.illegal, self.cost, self.labels, self.sha, self.begun = conv, [0] * 4, 0, 0, [], hashlib.sha256(), False
        self.before, self.low, self.high, self.turns = None, None, None, 0

    def met(self, turn: int | None, role: str, kind: int) -> None:
        self.kinds[kind] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def done(self, label: str, kind: int, turn: int | None, role: str, text: str) -> Iterator[dict]:
        self.labels.append(label)
        self.cost += {"K": auction.KEEP, "R": auction.REROLE, "D": auction.DELETE, "I": auction.INSERT}[label]
        self.cost += auction.BROKEN if label in "KR" and kind == auction.TRUNCATED else 0
        if label != "D":
            self.sha.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.begun = True
        yield from ()

    def end(self) -> Iterator[dict]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        count = dict(zip(("blank", "duplicate", "truncated"), self.kinds[1:], strict=True))
        yield {"conv": self.conv, "gaps": gaps, **count, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.labels), "repaired_sha256": self.sha.hexdigest()}


class _Repaired:
    """The turns of a repaired conversation in order, with the edit that gave each."""

    schema = _REPAIRED

    def __init__(self, conv: str):
        self.conv, self.position = conv, 0

    def met(self, turn: int | None, role: str, kind: int) -> None:
        pass

    def done(self, label: str, kind: int, turn: int | None, role: str, text: str) -> Iterator[dict]:
        if label != "D":
            yield {"conv": self.conv, "position": self.position, "edit": label, "turn": turn, "role": role, "text": text}
            self.position += 1

    def end(self) -> Iterator[dict]:
        yield from ()


def _initials(roles: list[str]) -> list[str]:
    return [r[:1] for r in roles]


def _edit(out, labels: str, turn: int | None, role: str, text: str, kind: int, state: int) -> Iterator:
    """What the labels up to and with that of a turn do; ends with the state behind it."""
    for label in labels:
        if label == "I":
            yield from out.done("I", auction.SOUND, None, auction.ROLE[state], "")
        elif label == "D":
            yield from out.done("D", kind, turn, role, text)
            continue
        else:
            yield from out.done(label, kind, turn, auction.ROLE[state] if label == "R" else role, text)
        if label == "K":
            state = auction.SYSTEM if role[:1] == "s" else auction.USER if role[:1] == "u" else auction.DONE
        else:
            state = auction.NEXT[state]
    return state


def _split(labels: str, n: int) -> list[str]:
    """The labels of each turn, its inserts before its own; what follows the last turn comes last."""
    out, at = [], 0
    for _ in range(n):
        end = at
        while labels[end] == "I":
            end += 1
        out.append(labels[at : end + 1])
        at = end + 1
    return [*out, labels[at:]]


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= _OUT:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _columns(*schemas: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema(list({n: pa.field(n, kinds[k]) for s in schemas for n, k in (c.split(" ") for c in s.split(", "))}.values()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, _OUT):
            yield from batch.slice(i, _OUT).to_pylist()


def _pieces(kind: type, piece: int):
    def solved(conv: str, held: list[tuple]) -> Iterator[dict]:
        out = kind(conv)
        for turn, role, _, k in held:
            out.met(turn, role, k)
        _, labels = auction.Lattice(_initials([h[1] for h in held]), [h[3] for h in held]).trace(auction.START)
        state = auction.START
        *each, behind = _split(labels, len(held))
        for (turn, role, text, k), own in zip(held, each, strict=True):
            state = yield from _edit(out, own, turn, role, text, k, state)
        yield from _edit(out, behind, None, "", "", 0, state)
        yield from out.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def of(conv: str, number: int, held: list[tuple]) -> dict:
            turn, role, text, kinds = (list(x) for x in zip(*held, strict=True))
            return {"conv": conv, "part": part, "piece": number, "turns": turn, "roles": role, "texts": text, "kinds": kinds}

        def all_() -> Iterator[dict]:
            """Conversations that begin and end here in one piece are solved; the rest, and the first and the last one, are left open."""
            conv, number, held, first = None, 0, [], True
            for row in _rows(batches):
                if row["conv"] != conv:
                    if held and not first and not number:
                        yield from solved(conv, held)
                    elif held:
                        yield of(conv, number, held)
                    first, conv, number, held = conv is None, row["conv"], 0, []
                for i in range(row["times"]):
                    if len(held) == piece:
                        yield of(conv, number, held)
                        number, held = number + 1, []
                    held.append((row["turn"], row["role"], row["text"], row["again"] if i else row["kind"]))
            if held:
                yield of(conv, number, held)

        yield from _batches(all_(), _columns(kind.schema, _PIECE))

    return run


def _schema(kind: type) -> str:
    return ", ".join(dict.fromkeys([*kind.schema.split(", "), *_PIECE.split(", ")]))


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["conv", "part", "piece", "last"]].assign(costs=[auction.matrix(_initials(r), list(k), bool(last)) for r, k, last in zip(pdf["roles"], pdf["kinds"], pdf["last"], strict=True)])


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Prices behind each piece of a conversation: STATES * STATES numbers for PIECE turns are held."""
    pdf = pdf.sort_values(["part", "piece"], ascending=False)
    prices, out = list(auction.END), []
    for costs, last in zip(pdf["costs"], pdf["last"], strict=True):
        out.append(prices)
        prices = auction.before(list(map(int, costs)), list(auction.END) if last else prices)
    return pdf[["conv", "part", "piece"]].assign(exits=out)


def _traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        behind, labels = [], []
        for roles, kinds, last, exits in zip(pdf["roles"], pdf["kinds"], pdf["last"], pdf["exits"], strict=True):
            lattice = auction.Lattice(_initials(roles), list(kinds), tuple(map(int, exits)), bool(last))
            both = [lattice.trace(q) for q in range(auction.STATES)]
            behind.append([b for b, _ in both])
            labels.append([x for _, x in both])
        yield pdf[["conv", "part", "piece"]].assign(behind=behind, labels=labels)


def _followed(kind: type):
    """Turns in order, the first of each piece with the piece's traces: takes up the trace of the state that it is entered in."""

    def all_(rows: Iterator[dict]) -> Iterator[dict]:
        out, state, each, leave = None, auction.START, [], auction.START

        def close():
            if each:  # inserts behind the last turn
                yield from _edit(out, each.pop(), None, "", "", 0, state)
            yield from out.end()

        for row in rows:
            if out is None or row["conv"] != out.conv:
                if out is not None:
                    yield from close()
                out, leave = kind(row["conv"]), auction.START
            if row["labels"] is not None:
                state, labels, leave = leave, row["labels"][leave], row["behind"][leave]
                each = _split(labels, row["n"])[::-1]
            out.met(row["turn"], row["role"], row["kind"])
            state = yield from _edit(out, each.pop(), row["turn"], row["role"], row["text"], row["kind"], state)
        if out is not None:
            yield from close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(all_(_rows(batches)), _columns(kind.schema))

    return run


def _solve(rows: DataFrame, kind: type, scratch: Scratch, piece: int) -> DataFrame:
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # Equal beginnings stay together; whole texts would make the sampled bounds large.
    dealt = judged(rows).repartitionByRange(order[0], order[1], F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions(*order)
    done = scratch.save(dealt.select("conv", "turn", "role", "text", "times", "kind", "again").mapInArrow(_pieces(kind, piece), _schema(kind)))
    pieces = done.where("piece is not null").select(*[c.split(" ")[0] for c in _PIECE.split(", ")])
    ends = pieces.groupBy("conv").agg(F.max(F.struct("part", "piece")).alias("end"))
    short = scratch.save(pieces.join(ends, "conv").select("conv", "part", "piece", "roles", "kinds", (F.struct("part", "piece") == F.col("end")).alias("last")))
    costs = short.mapInPandas(_costs, "conv string, part int, piece int, last boolean, costs array<long>")
    exits = scratch.save(costs.groupBy("conv").applyInPandas(_exits, "conv string, part int, piece int, exits array<long>"))
    at = ["conv", "part", "piece"]
    traces = scratch.save(short.join(exits, at).mapInPandas(_traces, "conv string, part int, piece int, behind array<int>, labels array<string>"))
    turn = F.posexplode(F.arrays_zip("turns", "roles", "texts", "kinds")).alias("pos", "t")
    own = pieces.join(traces, at).select(*at, "behind", "labels", F.size("turns").alias("n"), turn)
    first = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("behind", "labels")]
    own = own.select(*at, "pos", "n", *first, F.col("t.turns").alias("turn"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"), F.col("t.kinds").alias("kind"))
    followed = own.repartition("conv").sortWithinPartitions(*at, "pos").mapInArrow(_followed(kind), kind.schema)
    return done.where("piece is null").select(followed.columns).unionByName(followed)


def repaired(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv, position, edit, turn, role, text): the turns that the cheapest edits leave of ``turns``, in order.

    ``edit`` is K (kept), R (another role) or I (inserted: no turn, no text).  A conversation of which nothing is left has no rows.
    """
    return _solve(rows, _Repaired, Scratch(rows.sparkSession, "conversations"), piece)


def audit(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``turns``."""
    return _solve(rows, _Audit, Scratch(rows.sparkSession, "conversations"), piece)


def digest(conversations: DataFrame, conv_col: str = "conv_id", piece: int = PIECE) -> DataFrame:
    """The audit of every conversation after damage, zeros where no row is left.

    Turns are in order, null ones first, those of one turn by role and text; repeated rows are turns of their own.  A null conversation
    id is one conversation, a null role or text is a space; other columns are not read, and an empty table gives an empty one.
    """
    rows = turns(conversations, conv_col)
    ids = conversations.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("conv", _name(F.col("conv_id")))
    out = ids.join(audit(damaged(rows), piece), "conv", "left").drop("conv")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.fillna(0, zero).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


__all__ = ["audit", "damaged", "digest", "judged", "repaired", "turns"]
