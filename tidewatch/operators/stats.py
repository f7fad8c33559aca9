"""Aggregations, time charts, running statistics, sorting, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket_start, soc_severity, span_seconds
from . import ordered
from .filters import field


def aggregate(df: DataFrame, fn: str, name: str = "*") -> Column:
    """One aggregate: count, sum, avg, min, max, dc, values, list."""
    if fn == "count":
        return F.count(F.lit(1)) if name == "*" else F.count(field(df, name))
    x = field(df, name)
    if fn in ("sum", "avg"):
        x = x.try_cast("double") if dict(df.dtypes).get(name, "string") == "string" else x
    return {
        "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "dc": F.count_distinct,
        "values": lambda v: F.sort_array(F.collect_set(v)), "list": F.collect_list,
    }[fn](x)


def _named(df: DataFrame, aggs) -> list[Column]:
    """Aggregates from 'count', ('sum', 'x') or ('sum', 'x', 'alias'); named fn_field unless told otherwise."""
    out = []
    for a in aggs:
        fn, name, alias = ((a,) if isinstance(a, str) else tuple(a)) + (None,) * (3 - (1 if isinstance(a, str) else len(a)))
        out.append(aggregate(df, fn, name or "*").alias(alias or (fn if not name or name == "*" else f"{fn}_{name}")))
    return out


def stats(df: DataFrame, aggs, by: list[str] = ()) -> DataFrame:
    """Group-by with the aggregates first and the keys after them."""
    keys = [field(df, k).alias(k) for k in by]
    columns = _named(df, aggs)
    out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    return out.select(*[x for x in out.columns if x not in by], *by)


def timechart(df: DataFrame, aggs, span="60s", by: list[str] = ()) -> DataFrame:
    """_time, the aggregates and the keys for each bucket that holds anything."""
    columns = _named(df, aggs)
    out = df.groupBy(bucket_start("timestamp", span_seconds(span)).alias("_time"), *by).agg(*columns)
    return out.select("_time", *[x for x in out.columns if x != "_time" and x not in by], *by)


def eventstats(df: DataFrame, aggs, by: list[str] = ()) -> DataFrame:
    """Group aggregates on every row.

    The groups are aggregated before they are joined back, so that a hot group is not sorted into one task as a window would.
    """
    out = stats(df, aggs, by)
    if not by:
        return df.crossJoin(F.broadcast(out))  # one row
    keys = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    return df.join(out.withColumnsRenamed({k: f"__{k}" for k in by}), keys, "left").drop(*[f"__{k}" for k in by])


def streamstats(df: DataFrame, aggs, by: list[str], order: list[str], window: int = 0) -> DataFrame:
    """Running aggregates in row order; with ``window`` over the last so many rows.

    Without keys the rows are dealt out in ranges of the order, and ranges are carried on by their aggregates; only dc, values and list,
    which cannot be merged, then put all rows in order in one task.
    """
    named = []
    for a in aggs:
        fn, name, alias = ((a,) if isinstance(a, str) else tuple(a)) + (None,) * (3 - (1 if isinstance(a, str) else len(a)))
        named.append((fn, name or "*", alias or (fn if not name else f"{fn}_{name}")))
    if not by and all(fn in (*ordered.MERGED, "avg", "mean") for fn, *_ in named):
        return _in_ranges(df, named, order, window)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1) if window else Window.unboundedPreceding, 0)
    for fn, name, alias in named:
        df = df.withColumn(alias, aggregate(df, fn, name).over(w))
    return df


def _in_ranges(df: DataFrame, named: list[tuple[str, str, str]], order: list[str], window: int) -> DataFrame:
    """``streamstats`` without keys; an average is a sum and a count."""
    parts, out = {}, {}
    for fn, name, alias in named:
        x = F.lit(1) if name == "*" else field(df, name)
        if fn in ("sum", "avg", "mean"):
            x = x.try_cast("double") if dict(df.dtypes).get(name, "string") == "string" else x
        if fn in ("avg", "mean"):
            parts |= {f"{alias}__sum": ("sum", x), f"{alias}__count": ("count", x)}
            out[alias] = F.col(f"{alias}__sum") / F.nullif(F.col(f"{alias}__count"), F.lit(0))
        else:
            parts[alias] = (fn, x)
            out[alias] = F.col(alias)
    placed = ordered.positioned(df, order)
    done = ordered.last_rows(placed, parts, window) if window else ordered.running(placed, parts)
    return done.select(*df.columns, *[c.alias(a) for a, c in out.items()])


def dedup(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: a min-aggregation, so that a hot key never meets in one sort."""
    names = df.columns
    first = F.min_by(F.struct(*names), F.struct(*order)).alias("r") if all(isinstance(o, str) for o in order) else None
    if first is not None:
        return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first).select("r.*")
    return top_n_per_key(df, keys, order, 1)


def top_n_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def rolling_condition_counts(df: DataFrame, key: str, tests: dict[str, Column], window) -> DataFrame:
    """For each event, how many events of the key in the time window behind it (itself included) meet each test.

    A key's time is cut into blocks with a halo of one window, so that a hot key is spread over tasks (``ordered.time_window``).
    """
    counts = {name: F.sum(F.when(t, 1).otherwise(0)) for name, t in tests.items()}
    out = ordered.time_window(df, [key], F.unix_micros(F.col("timestamp").cast("timestamp")), span_seconds(window) * 1_000_000, counts)
    return out.drop("__block", "__t")


def sort_(df: DataFrame, *keys: str) -> DataFrame:
    """'a' up, '-b' down; text columns that hold numbers sort as numbers, before other text."""
    out = []
    for k in keys:
        x = field(df, k.lstrip("-"))
        kinds = [x.try_cast("double"), x] if dict(df.dtypes).get(k.lstrip("-"), "string") == "string" else [x]
        out += [v.desc_nulls_last() if k.startswith("-") else v.asc_nulls_last() for v in kinds]
    return df.orderBy(*out)


def head(df: DataFrame, n: int, order: list | None = None) -> DataFrame:
    return df.orderBy(*(order or [F.col("timestamp").desc(), F.col("id")])).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n of an ascending order, still ascending."""
    return df.orderBy(*[F.col(o).desc() for o in order]).limit(n).orderBy(*order)


def page(df: DataFrame, limit: int = 100, offset: int = 0, cap: int = 1000, order: list | None = None) -> tuple[DataFrame, int, bool]:
    """(rows, total, has_more)."""
    limit = min(limit or 100, cap)
    total = df.count()
    rows = df.orderBy(*(order or [F.col("timestamp").desc(), F.col("id")])).offset(offset).limit(limit)
    return rows, total, offset + limit < total


def union_edges(out: DataFrame, into: DataFrame) -> DataFrame:
    return out.unionByName(into).distinct()


def union_all_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_type").alias("type"), F.col("from_value").alias("value")).unionByName(edges.select(F.col("to_type").alias("type"), F.col("to_value").alias("value")))
    return ends.groupBy("type", "value").agg(F.count(F.lit(1)).alias("degree"))


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys with ``change`` added or removed."""
    added = after.join(before, key, "left_anti").select(*key, F.lit("added").alias("change"))
    return added.unionByName(before.join(after, key, "left_anti").select(*key, F.lit("removed").alias("change")))


def merge_capped(base: Column, more: Column, cap: int) -> Column:
    return F.slice(F.array_distinct(F.concat(F.coalesce(base, F.array()), F.coalesce(more, F.array()))), 1, cap)


def auto_bucket(seconds: float) -> int:
    """Seconds of a timeline bucket for a range of that many seconds."""
    for most, size in ((7200, 300), (43200, 900), (259200, 3600), (1209600, 21600)):
        if seconds <= most:
            return size
    return 86400


def event_timeline(df: DataFrame, bucket: int, column: str = "timestamp") -> DataFrame:
    """Events per bucket, in total and by the four severities; a bucket lies between a minute and a day."""
    soc = soc_severity("severity")
    counts = [F.count_if(soc == s).alias(s) for s in ("critical", "high", "medium", "low")]
    return df.groupBy(bucket_start(column, min(max(bucket, 60), 86400)).alias("bucket")).agg(F.count(F.lit(1)).alias("total"), *counts)


def source_counts(df: DataFrame, n: int) -> DataFrame:
    return head(df, n).groupBy("source").agg(F.count(F.lit(1)).alias("count"))


def dashboard_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_distinct(x).alias(f"{x}s") for x in ("source", "host", "severity")])


def event_stats(df: DataFrame, now: Column) -> DataFrame:
    """Long form: (kind, name, count) for the total, the last day, each severity and each source."""
    def key(kind, name):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    keys = F.array(
        key("total", F.lit("")), key("severity", F.coalesce("severity", F.lit(""))), key("source", F.coalesce("source", F.lit(""))),
        F.when(F.col("timestamp") >= now - F.expr("interval 24 hours"), key("last_24h", F.lit(""))),
    )
    return df.select(F.explode(F.array_compact(keys)).alias("k")).groupBy("k.kind", "k.name").agg(F.count(F.lit(1)).alias("count"))


def events_per_second(df: DataFrame, seconds: float) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select((F.floor(F.col("n") / seconds * 100 + 0.5) / 100).alias("eps"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    out = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), "value").limit(n)


def distinct_values(df: DataFrame, name: str, n: int) -> DataFrame:
    """Sorted distinct values; 'index' gathers source_type and the attribute of that name."""
    columns = [field(df, "source_type"), F.get_json_object("attributes", "$['index']")] if name == "index" else [field(df, name)]
    out = df.select(F.explode(F.array(*columns)).alias("value")).where("value is not null and value != ''").distinct()
    return out.orderBy("value").limit(n)


def field_catalog(df: DataFrame) -> DataFrame:
    """Names of the columns, the attributes and 'index'."""
    keys = df.select(F.explode(F.json_object_keys("attributes")).alias("name")).distinct()
    fixed = df.sparkSession.createDataFrame([(x,) for x in [*df.columns, "index"]], "name string")
    return keys.unionByName(fixed).distinct()
