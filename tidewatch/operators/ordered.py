"""Rows in order over many tasks: positions, running aggregates and time windows without a key's rows, or all rows, in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved

PART, AT = "__part", "__at"


def positioned(df: DataFrame, order: list) -> DataFrame:
    """``df`` with the number of the range of ``order`` that a row lies in and its place there, counted from 0.

    Ranges are dealt out to tasks, so that equal values of ``order`` meet in one and neighbours in the same or the next.  The result is
    a written table: ranges are sampled, and a second look at them must see the same.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return saved(dealt.withColumn(PART, F.shiftright(number, 33)).withColumn(AT, number.bitwiseAND((1 << 33) - 1)), "positioned")


def _merge(fn: str, before: Column, own: Column) -> Column:
    """A running aggregate of what came before a range and of its rows so far."""
    if fn in ("count", "sum"):
        return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)
    return {"min": F.least, "max": F.greatest, "first": F.coalesce, "last": lambda b, o: F.coalesce(o, b)}[fn](before, own)


def _of(fn: str, value: Column) -> Column:
    return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "first": lambda v: F.first(v, True), "last": lambda v: F.last(v, True)}[fn](value)


#: Aggregates that ranges can be merged by.
MERGED = ("count", "sum", "min", "max", "first", "last")


def running(placed: DataFrame, columns: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Running aggregates over all rows of ``positioned``, in two levels; ``columns`` maps a name to (aggregate, value).

    Each range is aggregated, the ranges' results (one row for each task) are carried on, and each row adds those of its range so far.
    With ``before`` a row itself is left out.
    """
    spark = placed.sparkSession
    local = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    names = list(columns)
    # One row for each range, that is for each task of a shuffle: few, whatever the input.
    parts = placed.groupBy(PART).agg(*[_of_range(fn, v).alias(n) for n, (fn, v) in columns.items()]).orderBy(PART).collect()
    schema = ", ".join([f"{PART} long", *[f"{n} {placed.select(_of(fn, v).alias('x')).dtypes[0][1]}" for n, (fn, v) in columns.items()]])
    carried, so_far = [], dict.fromkeys(names)
    for row in parts:
        carried.append((row[PART], *[so_far[n] for n in names]))
        for n, (fn, _) in columns.items():
            so_far[n] = _carry(fn, so_far[n], row[n])
    offsets = spark.createDataFrame(carried, schema).withColumnsRenamed({n: f"__{n}" for n in names})
    own = placed.withColumns({n: _of(fn, v).over(local) for n, (fn, v) in columns.items()})
    both = own.join(F.broadcast(offsets), PART, "left")
    return both.withColumns({n: _merge(fn, F.col(f"__{n}"), F.col(n)) for n, (fn, _) in columns.items()}).drop(*[f"__{n}" for n in names])


def _of_range(fn: str, value: Column) -> Column:
    """The aggregate of a whole range; first and last go by place."""
    if fn in ("first", "last"):
        pick = F.min_by if fn == "first" else F.max_by
        return pick(value, F.when(value.isNotNull(), F.col(AT)))
    return _of(fn, value)


def _carry(fn: str, a, b):
    if a is None or b is None:
        return b if a is None else a
    return {"count": lambda: a + b, "sum": lambda: a + b, "min": lambda: min(a, b), "max": lambda: max(a, b), "first": lambda: a, "last": lambda: b}[fn]()


def last_rows(placed: DataFrame, columns: dict[str, tuple[str, Column]], n: int, block: int = 1 << 20) -> DataFrame:
    """Aggregates over the last ``n`` rows, the row itself among them, of ``positioned``.

    Rows are numbered and cut into blocks; the last n - 1 rows of a block are also laid before the next one.
    """
    numbered = running(placed, {"__row": ("count", F.lit(1))}).withColumn("__row", F.col("__row") - 1)
    block = max(block, n)
    own = F.floor(F.col("__row") / block)
    over = F.col("__row") % block > block - n
    dealt = numbered.withColumn("__block", F.explode(F.when(over, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("__own", F.col("__block") == own)
    w = Window.partitionBy("__block").orderBy("__row").rowsBetween(-(n - 1), 0)
    return dealt.withColumns({name: _of(fn, v).over(w) for name, (fn, v) in columns.items()}).where("__own").drop("__row", "__block", "__own")


#: A time block is so many windows long; the part of a key's rows that is laid before the next block too is one in so many.
BLOCKS = 4


def time_window(df: DataFrame, key: list[str], micros: Column, length: int, columns: dict[str, Column], blocks: int = BLOCKS) -> DataFrame:
    """Aggregates over each row's key in the ``length`` microseconds behind it, itself and rows of the same time included.

    A key is cut into time blocks of ``blocks`` windows, each with a halo: the rows of one window before it.  So a hot key is spread over
    as many tasks as its time spans blocks, and a row is shuffled twice at most.  The columns ``__block`` and ``__t`` stay.
    """
    size = blocks * length
    own = F.floor(F.col("__t") / size)
    near_end = F.pmod(F.col("__t"), F.lit(size)) >= size - length
    dealt = df.withColumn("__t", micros).withColumn("__block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("__own", F.coalesce(F.col("__block") == own, F.lit(True)))
    w = Window.partitionBy(*key, "__block").orderBy("__t").rangeBetween(-length, 0)
    return dealt.withColumns({n: c.over(w) for n, c in columns.items()}).where("__own").drop("__own")


def previous(df: DataFrame, key: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``name``: the value of ``column`` in a key's row before, of rows with ``__block``; null for the first.

    Within a block it is the row before; a block's first row takes the last value of the key's block before, and blocks are few.
    """
    inside = Window.partitionBy(*key, "__block").orderBy(*order)
    ends = df.groupBy(*key, "__block").agg(F.max_by(column, F.struct(*order)).alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(*key).orderBy("__block"))).drop("__last")
    # Keys may be null; a join on equality alone would lose their rows.
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "__block"]])
    rows = df.withColumn(name, F.lag(column).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    both = rows.alias("a").join(ends.alias("b"), on, "left")
    return both.select(*[F.col(f"a.{c}") for c in df.columns], F.when(F.col("a.__first"), F.col("b.__before")).otherwise(F.col(f"a.{name}")).alias(name))


__all__ = ["MERGED", "last_rows", "positioned", "previous", "running", "time_window"]
