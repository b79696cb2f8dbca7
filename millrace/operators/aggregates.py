"""Aggregates and window functions as functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import ROWS, SEG, _written, framed, joined, nearest, numbered, segmented


def summarise(df: DataFrame, keys: list, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def totals(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def summarise_by_period(df: DataFrame, date: str, grain: str, aggs: dict[str, Column]) -> DataFrame:
    """By calendar period with its year, never by month number alone."""
    return summarise(df.withColumn("period", F.date_trunc(grain, date).cast("date")), ["period"], aggs)


def conditional_aggs(df: DataFrame, keys: list, aggs: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """name -> (condition, function, column)."""
    return df.groupBy(*keys).agg(*[getattr(F, f)(F.when(c, F.col(v))).alias(n) for n, (c, f, v) in aggs.items()])


def points(col: str, rules: dict) -> Column:
    out = F.lit(0)
    for value, p in rules.items():
        out = F.when(F.col(col) == value, p).otherwise(out)
    return F.sum(out)


def ratio(num: Column, den: Column) -> Column:
    """Null for a denominator of null or nought."""
    return F.try_divide(num, den)


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def share_of(df: DataFrame, keys: list[str], value: str, a: Column, b: Column) -> DataFrame:
    """Percent of two conditional sums, which add up to 100."""
    sa, sb = F.sum(F.when(a, F.col(value)).otherwise(0.0)), F.sum(F.when(b, F.col(value)).otherwise(0.0))
    return df.filter(a | b).groupBy(*keys).agg(F.round(100 * F.try_divide(sa, sa + sb), 2).alias("pct_a"), F.round(100 * F.try_divide(sb, sa + sb), 2).alias("pct_b"))


def groups_at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= n)


def concat_list(df: DataFrame, keys: list[str], col: str, order: str, sep: str = ", ") -> DataFrame:
    """Values of each key in the order of another column; a group must fit a row."""
    items = F.array_sort(F.collect_list(F.struct(order, F.col(col).cast("string").alias("__v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["__v"]), sep).alias("items"))


def duplicate_report(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Groups of more than one row with a message."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id")).filter("n > 1")
    return g.withColumn("message", F.format_string("%d rows share this key, first %d", "n", "first_id"))


def latest_vs_prior(df: DataFrame, key: str, order: list[str], val: str) -> DataFrame:
    """Newest value and the average of all others; with a single row that row's own value."""
    g = df.groupBy(key).agg(F.max_by(val, F.struct(*order)).alias("latest"), F.sum(val).alias("__s"), F.count("*").alias("__n"))
    prior = F.when(F.col("__n") > 1, (F.col("__s") - F.col("latest")) / (F.col("__n") - 1)).otherwise(F.col("latest"))
    return g.select(key, "latest", prior.alias("prior"))


def weighted_mean(val: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(val * weight), F.sum(F.when(val.isNotNull(), weight)))


def bags(a: DataFrame, b: DataFrame, keys: list[str], val: str) -> DataFrame:
    """How often both sides have each text of each key: keys, size (characters without trailing blanks), na, nb. Texts meet
    by 96 bits of hashes and their length, so the shuffle carries neither the texts nor a second copy of a side; null
    texts have a null size and are no common text."""
    side = lambda x, n: x.select(*keys, F.xxhash64(val).alias("__h"), F.hash(val).alias("__g"), F.length(val).alias("__l"), F.length(F.rtrim(val)).alias("size"), *[F.lit(int(n == k)).alias(k) for k in ("na", "nb")])
    return side(a, "na").union(side(b, "nb")).groupBy(*keys, "__h", "__g", "__l", "size").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def bag_overlap(a: DataFrame, b: DataFrame, keys: list[str], val: str) -> DataFrame:
    """Multiset intersection for each key that has any: shared rows and shared characters (without trailing blanks)."""
    m = F.least("na", "nb")
    shared = bags(a, b, keys, val).filter("size IS NOT NULL AND na > 0 AND nb > 0")
    return shared.groupBy(*keys).agg(F.sum(m).alias("rows"), F.sum(m * F.col("size")).alias("chars"))


def set_equals(df: DataFrame, key: str, col: str, values: list) -> DataFrame:
    """Keys whose set of values is exactly the given one."""
    g = df.groupBy(key).agg(F.countDistinct(col).alias("__n"), F.countDistinct(F.when(F.col(col).isin(values), F.col(col))).alias("__in"))
    return g.filter((F.col("__n") == len(set(values))) & (F.col("__in") == len(set(values)))).select(key)


def mean_of_totals(df: DataFrame, member: str, val: str) -> DataFrame:
    return df.groupBy(member).agg(F.sum(val).alias("t")).agg(F.avg("t").alias("mean_total"))


def pivot_agg(df: DataFrame, keys: list[str], col: str, values: list, agg: Column) -> DataFrame:
    """The values are given, so no job looks for them."""
    return df.groupBy(*keys).pivot(col, values).agg(agg)


def split_means(df: DataFrame, keys: list[str], side: str, values: list, val: str) -> DataFrame:
    """Mean of each side; rows of another side don't count as nought."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(side) == v, F.col(val))).alias(f"mean_{v}") for v in values])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, ties: str = "row") -> DataFrame:
    """The first n rows of each key (ties="row"), or all rows of the first n values (ties="dense"), with their rank."""
    rank = {"row": F.row_number, "dense": F.dense_rank}[ties]()
    return df.withColumn("rank", rank.over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def nth(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return top_n(df, keys, order, n).filter(F.col("rank") == n).drop("rank")


def nth_distinct(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n-th largest distinct value, null if there are fewer; top-k on each task, no global sort."""
    top = df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(F.desc(col)).limit(n)
    return top.agg(F.when(F.count("*") == n, F.min(col)).alias(col))


def majority(df: DataFrame, keys: list[str], val: str, priority: Column) -> DataFrame:
    """Most frequent value of each key; ties by priority, smallest first."""
    c = df.groupBy(*keys, val).agg(F.count("*").alias("n"))
    return top_n(c, keys, [F.desc("n"), priority.asc(), F.asc(val)], 1).drop("rank")


def growth(df: DataFrame, keys: list[str], period: str, val: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(period)
    prev = F.lag(val).over(w)
    return df.withColumn("previous", prev).withColumn("growth_pct", F.round(100 * F.try_divide(F.col(val) - F.col("previous"), F.col("previous")), 2))


def rolling(df: DataFrame, keys: list[str], order: list[str], val: str, n: int, rows_per_segment: int = ROWS) -> DataFrame:
    return with_windows(df, keys, order, {"rolling": F.avg(val)}, (-(n - 1), 0), rows_per_segment)


def forward_sum(df: DataFrame, keys: list[str], order: list[str], val: str, n: int, rows_per_segment: int = ROWS) -> DataFrame:
    return with_windows(df, keys, order, {"forward": F.sum(val)}, (0, n - 1), rows_per_segment)


EXACT = "decimal(28,14)"


def _exact(c: str) -> Column:
    """The value as a decimal, or null where that isn't the same value."""
    d = F.col(c).try_cast(EXACT)
    return F.when(d.cast("double") == F.col(c).cast("double"), d)


def average(c: str) -> Column:
    """An average as (exact, plain). A sum of doubles turns on the order of the rows, and a value that equals the average comes
    out above it or not; a sum of decimals doesn't. `exact` is null where a value of the group has no decimal."""
    return F.struct(F.when(F.count(_exact(c)) == F.count(c), F.avg(_exact(c))).alias("exact"), F.avg(c).alias("plain"))


def above(c: str, mean: str, margin: str = "0") -> Column:
    """c > mean + margin for a mean by `average`."""
    return F.coalesce(_exact(c) > F.col(mean)["exact"] + F.lit(margin).cast("decimal(9,8)"), F.col(c) > F.col(mean)["plain"] + F.lit(float(margin)))


def above_own_average(df: DataFrame, key: str, cols: list[str], margins: dict[str, str] | None = None) -> DataFrame:
    """Rows above their group's average (and a margin under 10) in all columns. Averages are made before anything is shuffled and joined
    back, so that no task sorts a whole group; rows with a null key stay out. Rows that equal the average aren't above it."""
    out = df.join(df.groupBy(key).agg(*[average(c).alias(f"__{c}") for c in cols]), key)
    for c in cols:
        out = out.filter(above(c, f"__{c}", (margins or {}).get(c, "0")))
    return out.select(*df.columns, *[F.col(f"__{c}.plain").alias(f"avg_{c}") for c in cols])


def with_group_stats(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Adds aggregates of each row's group (null keys are a group). They are made before anything is shuffled and joined
    back, so that no task holds a whole group."""
    return joined(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys, "inner")


def islands(df: DataFrame, keys: list[str], index: str, rows_per_segment: int = ROWS) -> DataFrame:
    """Adds `island` (the same for consecutive values of a distinct integer index) and its `length`. Neither a key nor a run
    has to fit a task: numbers go on from segment to segment, and runs are counted before they are shuffled."""
    out = numbered(segmented(df, keys, [index], rows_per_segment)).withColumn("island", F.col(index) - F.col("n_")).drop("n_", SEG)
    return with_group_stats(out, [*keys, "island"], {"length": F.count("*")})


def streaks(df: DataFrame, keys: list[str], index: str, n: int, rows_per_segment: int = ROWS) -> DataFrame:
    """Runs of at least n consecutive periods: keys, first and last period, length."""
    seen = df.select(*keys, index).distinct()
    runs = numbered(segmented(seen, keys, [index], rows_per_segment)).withColumn("island", F.col(index) - F.col("n_"))
    return runs.groupBy(*keys, "island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).filter(F.col("length") >= n).drop("island")


def runs_over(df: DataFrame, keys: list[str], index: str, condition: Column, n: int, rows_per_segment: int = ROWS) -> DataFrame:
    """Every row of each run of at least n consecutive rows that meet a condition."""
    return islands(df.filter(condition), keys, index, rows_per_segment).filter(F.col("length") >= n).drop("island")


def run_member(df: DataFrame, keys: list[str], order: list[str], flag: Column, n: int, rows_per_segment: int = ROWS) -> DataFrame:
    """Adds `member`: if the row is in a run of at least n rows, next to each other in the order, that all have the flag. A
    row's number less that of flagged rows so far is the same all over a run, and runs are counted by it."""
    on = df.withColumn("__on", F.coalesce(flag, F.lit(False)))
    s = segmented(on, keys, order, rows_per_segment)
    out = numbered(s, extra={"__flags": F.col("__on").cast("long")}).withColumn("__run", F.when(F.col("__on"), F.col("n_") - F.col("__flags"))).drop("n_", "__flags", SEG)
    long_ = out.filter("__on").groupBy(*keys, "__run").agg(F.count("*").alias("__n")).filter(F.col("__n") >= n)
    return joined(out, long_, [*keys, "__run"]).withColumn("member", F.col("__n").isNotNull() & F.col("__on")).drop("__on", "__run", "__n")


def with_windows(df: DataFrame, keys: list[str], order: list[str], exprs: dict[str, Column], rows: tuple[int, int] | None = None, rows_per_segment: int = ROWS) -> DataFrame:
    """Several measures over one window: name -> aggregate or window function. With a frame of rows, hot keys are split."""
    if rows:
        return framed(segmented(df, keys, order, rows_per_segment), exprs, rows)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({n: e.over(w) for n, e in exprs.items()})


def next_delta(df: DataFrame, keys: list[str], order: list[str], val: Column, rows_per_segment: int = ROWS) -> DataFrame:
    s = segmented(df.withColumn("__v", val), keys, order, rows_per_segment)
    return framed(s, {"__next": F.lead("__v")}, (0, 1), False).withColumn("next_delta", F.col("__next") - F.col("__v")).drop("__next", "__v")


def canonical_label(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    first = df.groupBy(group).agg(F.min_by(label, F.struct(*order)).alias("canonical"))
    return df.join(first, group)


def last_two_changed(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Keys whose two newest rows differ in a column, null-safe, all columns in one pass. Every task keeps its own two newest
    rows of a key before anything is shuffled."""
    two = top_n(df.select(*dict.fromkeys([key, *order]), *[F.col(c).alias(f"__{c}") for c in cols]), [key], [F.desc(o) for o in order], 2)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.struct(f"__{c}")))[f"__{c}"]
    both = two.groupBy(key).agg(F.count("*").alias("__n"), *[(~at(1, c).eqNullSafe(at(2, c))).alias(f"changed_{c}") for c in cols]).filter("__n = 2").drop("__n")
    return both.filter(" OR ".join(f"changed_{c}" for c in cols))


def share_of_group(df: DataFrame, keys: list[str], over: list[str], val: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.sum(val).alias("total"))
    return g.withColumn("share", F.try_divide("total", F.sum("total").over(Window.partitionBy(*over))))


def latest_pair(df: DataFrame, keys: list[str], rank: str, val: str) -> DataFrame:
    """Values of rank 1 and rank 2 of each key side by side, and their difference; a missing one counts as nought."""
    pick = lambda k: F.sum(F.when(F.col(rank) == k, F.col(val)).otherwise(0))
    return df.groupBy(*keys).agg(pick(1).alias("newest"), pick(2).alias("previous")).withColumn("change", F.col("newest") - F.col("previous"))


def newest(df: DataFrame, ts: str, k: int) -> DataFrame:
    """The k newest distinct times with their rank; the window sees k rows only."""
    top = df.select(ts).distinct().orderBy(F.desc(ts)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(ts))))


def nearest_marker(df: DataFrame, keys: list[str], order: list[str], condition: Column, rows_per_segment: int = ROWS) -> DataFrame:
    """Rows to the nearest row that meets the condition, in either direction; null where a key has none."""
    return nearest(segmented(df, keys, order, rows_per_segment), condition, "distance")


def distinct_by_levels(df: DataFrame, levels: dict[str, list[str]], col: str) -> DataFrame:
    """Exact distinct counts of an integer column for several sets of keys from one scan: level, its keys as text (null as '')
    joined by a slash, n. The finest groups' bitmaps, of 32768 neighbouring numbers each, are built in the tasks and merged
    upwards, so no row is repeated for a level and no set of values is held. Meant for dense numbers (surrogate keys): a
    bitmap costs 4 KB however few of its numbers occur. Null isn't counted."""
    finest = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    v = F.col(col).cast("long")
    base = df.filter(v.isNotNull()).groupBy(*finest, F.bitmap_bucket_number(v).alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("__m"))
    names = F.array(*[F.struct(F.lit(level).alias("level"), F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit("") if not keys else F.lit(None).cast("string")).alias("name")) for level, keys in levels.items()])
    merged = base.select(F.explode(names).alias("l"), "__b", "__m").groupBy("l.level", "l.name", "__b").agg(F.bitmap_or_agg("__m").alias("__m"))
    return merged.groupBy("level", "name").agg(F.sum(F.bitmap_count("__m")).alias("n"))


def exact_median(df: DataFrame, keys: list[str], val: str, rows_per_segment: int = ROWS) -> DataFrame:
    """keys, n, median (null values don't count). Approximate quantiles on either side of each middle are found first. Then rows
    are counted by value between them, and together below them, before they are shuffled; these counts are added up by value, hot groups by
    segments, so no group is held by a task and few of its rows are sorted. Groups whose middle isn't between the two are
    counted by value as a whole."""
    by = keys or ["__all"]
    x = df.withColumn("__all", F.lit(1)).filter(F.col(val).isNotNull()).select(*by, F.col(val).alias("__v"))
    marks = _written(x.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__v", [0.499, 0.501], 10_000).alias("__near")))
    near = joined(x, marks, by, "inner").filter(F.col("__v") <= F.col("__near")[1])
    found = _written(_middle(near.withColumn("__v", F.when(F.col("__v") >= F.col("__near")[0], F.col("__v"))), by, rows_per_segment))
    missed = joined(marks.drop("__near"), found, by, "left_anti")
    if not missed.isEmpty():
        found = found.union(_middle(joined(x, missed, by, "inner"), by, rows_per_segment))
    return found.select(*keys, "n", "median")


def _middle(rows: DataFrame, by: list[str], rows_per_segment: int) -> DataFrame:
    """by, n, median of groups with both middle ranks among their values; rows with a null value come before all values."""
    counts = _written(rows.groupBy(*by, "n", "__v").agg(F.count("*").alias("__c")))
    upto = numbered(segmented(counts, by, ["__v"], rows_per_segment), "__i", {"__upto": F.col("__c")})
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda rank: (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__c") < rank)
    ranks = F.sum(holds(first).cast("int") + holds(second).cast("int"))
    middle = upto.filter(F.col("__v").isNotNull() & (holds(first) | holds(second)))
    return middle.groupBy(*by, "n").agg(F.avg("__v").alias("median"), ranks.alias("__ranks")).filter("__ranks = 2").drop("__ranks")
