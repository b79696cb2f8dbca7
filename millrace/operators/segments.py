"""Ordered scans of keys that one task can't hold: windows whose hot keys are split into ranges of their order.

A window sends all rows of a key to one task. Here the keys are counted first; if none has more than `rows_per_segment`
rows, the plain window is used. Each key that has more is cut into segments at places of its order, read off a sample
of its rows (a fixed share by hash, so that about 64 of them fall into a segment). A window then goes by key and segment, one
shuffle as before, and only what a scan carries over a segment's edge is exchanged between segments: the number of rows,
sums, the last and first marker, or the few rows that a frame reaches over the edge (a halo). Those tables have some rows for
each segment, so their size is that of the input divided by `rows_per_segment`.

Keys may be null (null is a key) and the order is by column names, ascending, nulls first. Rows of equal order stay in one segment, in
any order among themselves, as in a window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch

ROWS = 1_000_000
SAMPLED = 64
SEG = "seg_"


def joined(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on keys of which null equals null; the small side's keys go."""
    other = small.withColumnsRenamed({k: f"{k}__right" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__right")) for k in keys], F.lit(True))
    out = big.join(other, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"{k}__right" for k in keys])


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(bounds: Column, x: Column) -> Column:
    """How many of the sorted bounds are at most x, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(bounds, mid) <= x
        narrowed = F.when(below, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))
        return F.when(a["lo"] < a["hi"], narrowed).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step)["lo"]


@dataclass
class Segmented:
    """rows have `seg_`: 0 for the rows of keys that weren't split, else 1 and more in the order of the key's segments."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    def window(self):
        """The window of a key, or of one segment of a split key. Without keys and splits it is one window over all rows."""
        by = [*self.keys, SEG] if self.split else self.keys
        return Window.partitionBy(*by).orderBy(*self.order)

    def summary(self, aggs: dict[str, Column]) -> DataFrame:
        """A row for each segment of a split key."""
        return self.rows.filter(F.col(SEG) > 0).groupBy(*self.keys, SEG).agg(*[c.alias(n) for n, c in aggs.items()])

    def before(self, aggs: dict[str, Column], over: dict[str, Column], after: bool = False) -> DataFrame:
        """For each segment `over`, aggregates of the summaries `aggs` of all earlier (or later) segments of its key."""
        w = Window.partitionBy(*self.keys).orderBy(SEG)
        w = w.rowsBetween(1, Window.unboundedFollowing) if after else w.rowsBetween(Window.unboundedPreceding, -1)
        return self.summary(aggs).select(*self.keys, SEG, *[c.over(w).alias(n) for n, c in over.items()])

    def carry(self, df: DataFrame, table: DataFrame) -> DataFrame:
        return joined(df, _written(table), [*self.keys, SEG])


def segmented(df: DataFrame, keys: list[str], order: list[str], rows_per_segment: int = ROWS) -> Segmented:
    keys, order = list(keys), list(order)
    hot = _written(df.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > rows_per_segment).drop("n_"))
    if hot.isEmpty():
        return Segmented(df.withColumn(SEG, F.lit(0)), keys, order, False)
    place = F.struct(*order)
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    share = max(1, rows_per_segment // SAMPLED)
    some = joined(df, hot, keys, "left_semi").filter(F.pmod(F.xxhash64(*plain), F.lit(share)) == 0).select(*keys, place.alias("o_"))
    ranked = some.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy("o_"))).filter(F.col("r_") % SAMPLED == 0)
    bounds = _written(ranked.groupBy(*keys).agg(F.array_sort(F.collect_set("o_")).alias("bounds_")))
    marked = joined(df, bounds, keys)
    return Segmented(marked.withColumn(SEG, F.when(F.col("bounds_").isNull(), 0).otherwise(1 + _place(F.col("bounds_"), place))).drop("bounds_"), keys, order, True)


def numbered(s: Segmented, out: str = "n_", extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows with their number in the key (from 1), and running sums `extra` (of columns without nulls) over the key."""
    extra = extra or {}
    w = s.window()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = s.rows.withColumns({out: F.row_number().over(w)} | {n: F.sum(c).over(running) for n, c in extra.items()})
    if not s.split:
        return df
    base = s.before({"rows_": F.count("*")} | {f"{n}_sum": F.sum(c) for n, c in extra.items()}, {"rows_": F.sum("rows_")} | {f"{n}_sum": F.sum(f"{n}_sum") for n in extra})
    df = s.carry(df, base)
    done = {out: F.col(out) + F.coalesce("rows_", F.lit(0))} | {n: F.col(n) + F.coalesce(f"{n}_sum", F.lit(0)) for n in extra}
    return df.withColumns(done).drop("rows_", *[f"{n}_sum" for n in extra])


def framed(s: Segmented, exprs: dict[str, Column], rows: tuple[int, int], framed_: bool = True) -> DataFrame:
    """Windows over a frame of rows around each row (or lag and lead, with framed_=False, no further than `rows`). Segments
    of a split key are given the rows that frames reach beyond their edges, marked so that they aren't returned."""
    frame = lambda w: w.rowsBetween(*rows) if framed_ else w
    if not s.split:
        return s.rows.withColumns({n: e.over(frame(s.window())) for n, e in exprs.items()}).drop(SEG)
    before, after = max(0, -rows[0]), max(0, rows[1])
    by = Window.partitionBy(*s.keys).orderBy(SEG)
    sizes = s.summary({"rows_": F.count("*")}).withColumn("base_", F.coalesce(F.sum("rows_").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = F.collect_list(F.struct(F.col(SEG).alias("seg"), F.col("base_").alias("base"), (F.col("base_") + F.col("rows_")).alias("end")))
    halos = []
    hot = s.rows.filter(F.col(SEG) > 0)
    # every segment has a row, so frames reach over no more segments than they have rows
    for reach, later in ((before, True), (after, False)):
        if not reach:
            continue
        beside = _written(sizes.select(*s.keys, SEG, "rows_", "base_", near.over(by.rowsBetween(1, reach) if later else by.rowsBetween(-reach, -1)).alias("near_")))
        edge = Window.partitionBy(*s.keys, SEG).orderBy(*[(F.col(o).desc_nulls_last() if later else F.col(o).asc_nulls_first()) for o in s.order])
        rim = joined(hot.withColumn("edge_", F.row_number().over(edge)).filter(F.col("edge_") <= reach), beside, [*s.keys, SEG])
        at = F.col("base_") + F.when(F.lit(later), F.col("rows_") - F.col("edge_") + 1).otherwise(F.col("edge_"))
        wanted = F.filter("near_", lambda x: (x["base"] < at + reach) if later else (x["end"] + reach >= at))
        halos.append(rim.withColumn(SEG, F.explode(F.transform(wanted, lambda x: x["seg"]))).select(*s.rows.columns))
    whole = reduce(lambda a, b: a.unionByName(b), [h.withColumn("halo_", F.lit(True)) for h in halos], s.rows.withColumn("halo_", F.lit(False)))
    done = whole.withColumns({n: e.over(frame(s.window())) for n, e in exprs.items()})
    return done.filter(~F.col("halo_")).drop("halo_", SEG)


def nearest(s: Segmented, condition: Column, out: str) -> DataFrame:
    """Rows to the nearest marker before or after; each segment gets the last marker before it and the first one after it."""
    df = numbered(s).withColumn("mark_", F.when(condition, F.col("n_")))
    w = s.window()
    before, after = F.max("mark_").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("mark_").over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"before_": before, "after_": after})
    if s.split:
        marks = Segmented(df, s.keys, s.order, True)
        found = _written(marks.summary({"last_": F.max("mark_"), "first_": F.min("mark_")}))
        by = Window.partitionBy(*s.keys).orderBy(SEG)
        edges = found.select(*s.keys, SEG, F.max("last_").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier_"), F.min("first_").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("later_"))
        df = s.carry(df, edges).withColumns({"before_": F.coalesce("before_", "earlier_"), "after_": F.coalesce("after_", "later_")}).drop("earlier_", "later_")
    return df.withColumn(out, F.least(F.col("n_") - F.col("before_"), F.col("after_") - F.col("n_"))).drop("n_", "mark_", "before_", "after_", SEG)
