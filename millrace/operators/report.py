"""Time intelligence and report measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import growth as year_growth
from .aggregates import with_group_stats
from .segments import ROWS, SEG, framed, segmented


def ytd(df: DataFrame, date: str, val: str) -> DataFrame:
    """Sum from the year's first day on; the running sum goes over days, one row each, by year."""
    day = df.groupBy(F.to_date(date).alias("day")).agg(F.sum(val).alias("total"))
    return day.withColumn("ytd", F.sum("total").over(Window.partitionBy(F.year("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def vs_budget(actual: DataFrame, budget: DataFrame, on: str) -> DataFrame:
    both = actual.join(budget, on, "left")
    diff = F.col("actual") - F.col("budget")
    return both.withColumn("note", F.when(F.col("budget").isNull(), "no budget").when(diff >= 0, F.format_string("surplus %.2f", diff)).otherwise(F.format_string("deficit %.2f", -diff)))


def above_mean_label(df: DataFrame, val: str) -> DataFrame:
    mean = df.agg(F.avg(val).alias("__m"))
    return df.crossJoin(F.broadcast(mean)).withColumn("label", F.when(F.col(val) >= F.col("__m"), "above").otherwise("below")).drop("__m")


def measure(name: str) -> Column:
    """A measure on order lines by its name."""
    gross, net = F.sum("l_extendedprice"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return {"gross": gross, "net": net, "quantity": F.sum("l_quantity")}[name]


def trend(df: DataFrame, date: str, val: str) -> DataFrame:
    """By month: total, change from the month before, the mean of all months."""
    month = df.groupBy(F.date_trunc("month", date).cast("date").alias("month")).agg(F.sum(val).alias("total"))
    mean = month.agg(F.avg("total").alias("mean"))
    out = month.withColumn("previous", F.lag("total").over(Window.orderBy("month")))  # a row for each month
    return out.crossJoin(F.broadcast(mean)).withColumn("change_pct", F.round(100 * F.try_divide(F.col("total") - F.col("previous"), F.col("previous")), 2))


growth = year_growth


def returns(df: DataFrame, key: str, date: str, price: str, horizons: list[int], rows_per_segment: int = ROWS) -> DataFrame:
    """Return against the price so many rows before, and since the first one. Hot keys are split; the first price of a key is
    an aggregate that is joined back if there are any."""
    s = segmented(df, [key], [date], rows_per_segment)
    back = {f"__back_{h}": F.lag(price, h) for h in horizons}
    if s.split:
        out = with_group_stats(framed(s, back, (-max(horizons), 0), False), [key], {"__first": F.min_by(price, F.struct(date))})
    else:
        w = s.window()
        out = s.rows.withColumns({n: e.over(w) for n, e in back.items()} | {"__first": F.first(price).over(w.rowsBetween(Window.unboundedPreceding, 0))}).drop(SEG)
    out = out.withColumns({"since_first": F.try_divide(F.col(price), F.col("__first")) - 1} | {f"return_{h}": F.try_divide(F.col(price), F.col(f"__back_{h}")) - 1 for h in horizons})
    return out.drop("__first", *back)


def by_dim(df: DataFrame, dim: str, group: str, val: str | Column, n: int) -> DataFrame:
    """A sum by dimension for the n largest groups only (ties by group). Facts are summed once, by dimension and group; the
    groups are ranked on those sums. Null groups stay out."""
    both = df.filter(F.col(group).isNotNull()).groupBy(dim, group).agg(F.sum(val).alias("value"))
    top = both.groupBy(group).agg(F.sum("value").alias("__t")).orderBy(F.desc("__t"), group).limit(n).select(group)
    return both.join(F.broadcast(top) if n <= 100_000 else top, group).select(dim, group, "value")
