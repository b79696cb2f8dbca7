"""Filters, joins, set operations and sorting as functions from DataFrame to DataFrame.

None of them collects rows. Join strategy is left to Catalyst and adaptive execution; only lists that the caller passes
in are broadcast, up to MOST_LISTED values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch
from .aggregates import average

MOST_LISTED = 100_000


# projection and filter
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def filter_on_expr(df: DataFrame, name: str, expr: Column, least) -> DataFrame:
    """Adds expr as a column and keeps the rows where it is at least `least`."""
    return df.withColumn(name, expr).filter(F.col(name) >= least)


def le_or_null(col: str, limit) -> Column:
    return F.col(col).isNull() | (F.col(col) <= limit)


def in_list(col: str, values) -> Column:
    return F.col(col).isin(list(values))


def in_range(col: str, low, high, closed: bool = True) -> Column:
    return F.col(col).between(low, high) if closed else (F.col(col) >= low) & (F.col(col) < high)


def starts_with(col: str, prefix: str, ignore_case: bool = False) -> Column:
    """Prefix match; % and _ in the prefix are plain characters."""
    return F.lower(col).startswith(prefix.lower()) if ignore_case else F.col(col).startswith(prefix)


def build_filters(**options) -> Column:
    """One condition from all options that are set (None: not set); an error if none is."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in options.items() if v is not None]
    if not parts:
        raise ValueError("give at least one filter")
    return reduce(lambda a, b: a & b, parts)


def bucket(cases: list[tuple[Column, object]], default) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def drop_sentinel(df: DataFrame, col: str, value) -> DataFrame:
    """Also drops null, as a comparison with null isn't true."""
    return df.filter(F.col(col) != value)


def any_of(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that meet any of the rules, in one scan."""
    return df.filter(reduce(lambda a, b: a | b, conditions))


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def swap_pairs(df: DataFrame, key: str) -> DataFrame:
    """Swaps keys 1 and 2, 3 and 4 and so on; a last odd key stays."""
    last = df.agg(F.max(key).alias("__last"))
    k = F.col(key)
    return df.crossJoin(F.broadcast(last)).withColumn(key, F.when(k % 2 == 0, k - 1).when(k == F.col("__last"), k).otherwise(k + 1)).drop("__last")


def coerce_numeric(df: DataFrame, col: str, kind: str = "int") -> DataFrame:
    """Casts a text column and drops what isn't a number; rows of nulls only go first."""
    return df.dropna("all").withColumn(col, F.col(col).try_cast(kind)).filter(F.col(col).isNotNull())


# joins
def inner(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on)


def having_match(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def without_match(df: DataFrame, *others: DataFrame, on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left_anti"), others, df)


def keep_in_all(df: DataFrame, others: list[DataFrame], on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left_semi"), others, df)


def in_subquery(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def restrict_to_ids(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows whose key is in a list of the caller's."""
    kind = df.schema[key].dataType.simpleString()
    keys = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {kind}").distinct()
    return df.join(F.broadcast(keys) if len(ids) <= MOST_LISTED else keys, key, "left_semi")


def left_with_zero(df: DataFrame, other: DataFrame, on, cols: list[str]) -> DataFrame:
    return df.join(other, on, "left").fillna(0, cols)


def left_filtered(df: DataFrame, other: DataFrame, on, condition: Column) -> DataFrame:
    """A left join that keeps rows without a match: the other side is filtered before."""
    return df.join(other.filter(condition), on, "left")


def left_null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Null keys match each other."""
    right = other.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in other.columns if c not in keys])
    return df.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left").drop(*[f"__{k}" for k in keys])


def join_roles(df: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], cols: list[str]) -> DataFrame:
    """Joins one dimension under several roles (role -> foreign key); its columns get the role as prefix."""
    for role, fk in roles.items():
        df = df.join(dim.select(F.col(key).alias(fk), *[F.col(c).alias(f"{role}_{c}") for c in cols]), fk, "left")
    return df


def join_dims(fact: DataFrame, dims: list[tuple[DataFrame, object]]) -> DataFrame:
    return reduce(lambda a, b: a.join(b[0], b[1]), dims, fact)


def min_children(df: DataFrame, parent: str, n: int) -> DataFrame:
    """Parents with at least n rows."""
    return df.groupBy(parent).agg(F.count("*").alias("children")).filter(F.col("children") >= n)


def retained(df: DataFrame, user: str, period: str) -> DataFrame:
    """Per period: users active in it and in the one before (period is an index without gaps)."""
    seen = df.select(user, period).distinct()
    before = seen.select(user, (F.col(period) + 1).alias(period))
    return seen.join(before, [user, period], "left_semi").groupBy(period).agg(F.count("*").alias("retained"))


def active_on(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows open on each date from the first to the last change: +1 at the start, -1 the day after the end. The running
    sum goes over dates, one row each, not over the rows themselves; rows that end before they start are left out."""
    df = df.filter(F.col(start) <= F.col(end))
    steps = df.select(F.explode(F.array(F.struct(F.col(start).alias("day"), F.lit(1).alias("step")), F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("step")))).alias("e")).select("e.*")
    per_day = steps.groupBy("day").agg(F.sum("step").alias("step"))
    return per_day.select("day", F.sum("step").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("open"))


def join_computed(df: DataFrame, other: DataFrame, keys: list[str], target: str, expr: Column) -> DataFrame:
    return df.withColumn(target, expr).join(other, [*keys, target])


def has_all(df: DataFrame, group: str, item: str, required: DataFrame) -> DataFrame:
    """Groups that have every required item (relational division); required has the one column `item`."""
    n = required.select(item).distinct().agg(F.count("*").alias("__n"))
    held = df.select(group, item).distinct().join(required.distinct(), item, "left_semi").groupBy(group).agg(F.count("*").alias("__held"))
    return held.crossJoin(F.broadcast(n)).filter("__held = __n").select(group)


def unpivot_keys(df: DataFrame, ids: list[str], cols: list[str], role: str = "role", value: str = "key") -> DataFrame:
    return df.unpivot(ids, cols, role, value)


def lookup(df: DataFrame, key: str, dictionary: DataFrame, value: str, default=None) -> DataFrame:
    """Dictionary rows (key, value); of repeated keys the smallest value counts."""
    d = dictionary.groupBy(key).agg(F.min(value).alias(value))
    out = df.join(d, key, "left")
    return out if default is None else out.fillna({value: default})


def latest_version(df: DataFrame, keys: list[str], ts: str, *ties: str) -> DataFrame:
    """The newest row of each key; `ties` order rows of one time, largest first."""
    top = F.max_by(F.struct(*df.columns), F.struct(ts, *ties)).alias("r")
    return df.groupBy(*keys).agg(top).select("r.*")


def vs_group_mean_join(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Adds each group's averages (`average`: exact and plain), to be compared by `above`."""
    return df.join(df.groupBy(key).agg(*[average(c).alias(f"avg_{c}") for c in cols]), key)


# set operations
def stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def stack_loose(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b, keys, "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


# sorting
def sort(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order)


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def keep_top_groups(df: DataFrame, group: str, measure: Column, n: int) -> DataFrame:
    """Rows of the n groups with the largest measure (ties by group)."""
    top = df.groupBy(group).agg(measure.alias("__m")).orderBy(F.desc("__m"), group).limit(n)
    return df.join(top, group, "left_semi")


def order_by_list(col: str, values: list[str]) -> Column:
    """Place in a given order; what isn't listed comes last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)), F.lit(0)), F.lit(len(values) + 1))


def retain_snapshots(df: DataFrame, ts: str, k: int) -> DataFrame:
    newest = df.select(ts).distinct().orderBy(F.desc(ts)).limit(k)
    return df.join(newest, ts, "left_semi")


def rows_at_positions(df: DataFrame, order: list[str], positions: list[int]) -> DataFrame:
    """The rows at some positions (from 1; from the end if negative) of the whole table in an order, with `position`. Rows
    are sorted by ranges and written, so that a row's position is its place in its range and the sizes of those before;
    only these sizes, one for each range, are summed in one place."""
    s = df.sparkSession
    path = scratch(s)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    rows = s.read.parquet(path).withColumns({"__range": F.shiftright("__m", 33), "__place": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__range")
    base = sizes.select("__range", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    at = rows.join(F.broadcast(base), "__range").withColumn("position", F.col("__place") + F.col("__base") + 1)
    wanted = F.array(*[F.lit(p).cast("long") if p > 0 else F.col("__all") + 1 + p for p in positions])
    return at.filter(F.array_contains(wanted, F.col("position"))).select(*df.columns, "position")
