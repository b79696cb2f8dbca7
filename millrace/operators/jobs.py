"""Data jobs: snapshots, change, archive and purge, upserts, text overlap, nested documents, review sheets, quality.

A job that changes a table returns the new frames; the caller writes them to a new path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import aggregates as A


def snapshot_diff(df: DataFrame, scope: str, ts: str, val: str) -> DataFrame:
    """Newest minus previous value of each scope, where it isn't nought."""
    ranked = df.join(F.broadcast(A.newest(df, ts, 2)), ts)
    return A.latest_pair(ranked, [scope], "rank", val).filter("change <> 0")


def changed_keys(df: DataFrame, key: str, ts: str, hash_cols: list[str]) -> DataFrame:
    return A.last_two_changed(df, key, [ts], hash_cols).select(key)


def archive_rows(details: dict[str, tuple[DataFrame, dict[str, str]]], layout: list[str], reason: str, at: str) -> DataFrame:
    """Rows of several tables in one layout: name -> (frame, column of the layout -> source column)."""
    frames = []
    for name, (df, mapping) in details.items():
        cols = [F.col(mapping[c]).cast("string").alias(c) if c in mapping else F.lit(None).cast("string").alias(c) for c in layout]
        frames.append(df.select(F.lit(name).alias("table_name"), *cols, F.lit(reason).alias("reason"), F.lit(at).cast("timestamp").alias("archived_at")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def archive_and_purge(tables: dict[str, DataFrame], keys: DataFrame, on: str, rows_per_task: int = 1_000_000) -> dict[str, tuple[DataFrame, DataFrame]]:
    """name -> (rows taken out, rows that stay); both together are the table. A table of more than `rows_per_task` rows is counted and dealt
    by key to as many tasks as that takes, and the keys with it, so what a task sorts doesn't grow with the table."""
    n_keys, moved = keys.count(), {}
    for name, df in tables.items():
        n = -(-max(df.count(), n_keys) // rows_per_task)
        rows, gone = (df.repartition(n, on), keys.repartition(n, on)) if n > 1 else (df, keys)
        moved[name] = rows.join(gone, on, "left_semi"), rows.join(gone, on, "left_anti")
    return moved


def requeue(tables: dict[str, DataFrame], queue: DataFrame, keys: DataFrame, on: str, at: str) -> tuple[dict[str, tuple[DataFrame, DataFrame]], DataFrame]:
    """`archive_and_purge` for changed keys, and the queue (key, queued_at) with those of them that were in a table and aren't
    in the queue yet."""
    moved = archive_and_purge(tables, keys, on)
    gone = reduce(lambda a, b: a.union(b), [out.select(on) for out, _ in moved.values()]).distinct()
    fresh = gone.join(queue.select(on), on, "left_anti").withColumn("queued_at", F.lit(at).cast("timestamp"))
    return moved, queue.select(on, "queued_at").union(fresh)


def upsert_dictionary(target: DataFrame, df: DataFrame, key: str, val: str) -> DataFrame:
    """key, val and action (insert, update, keep); keys compare without case and blanks, repeated new keys count once."""
    fold = F.lower(F.trim(F.col(key)))
    new = df.filter(F.trim(F.col(key)) != "").groupBy(fold.alias("__k")).agg(F.min_by(F.struct(F.trim(F.col(key)).alias("k"), F.col(val).alias("v")), F.struct(key, val)).alias("new"))
    old = target.select(fold.alias("__k"), F.struct(F.col(key).alias("k"), F.col(val).alias("v")).alias("old"))
    both = old.join(new, "__k", "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNotNull() & ~F.col("old.v").eqNullSafe(F.col("new.v")), "update").otherwise("keep")
    return both.select(F.coalesce("old.k", "new.k").alias(key), F.when(action == "keep", F.col("old.v")).otherwise(F.col("new.v")).alias(val), action.alias("action"))


def load_bridge(df: DataFrame, a: str, dim_a: DataFrame, b: str, dim_b: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs (a, b) with `reason`: null for rows to load, else why not."""
    pairs = df.select(a, b).distinct()
    out = pairs.join(dim_a.select(a).distinct().withColumn("__a", F.lit(1)), a, "left").join(dim_b.select(b).distinct().withColumn("__b", F.lit(1)), b, "left").join(existing.select(a, b).distinct().withColumn("__e", F.lit(1)), [a, b], "left")
    reason = F.when(F.col("__a").isNull(), f"unknown {a}").when(F.col("__b").isNull(), f"unknown {b}").when(F.col("__e").isNotNull(), "already there")
    return out.select(a, b, reason.alias("reason"))


def reject_report(df: DataFrame, example: str, examples: int = 5) -> DataFrame:
    """Rejected rows by reason: their number, and the first `examples` distinct examples (a report of the top few). Rows are
    counted by reason and example, ranked in many parts of each reason, and a part's count and its first examples go on
    together, so no reason is ranked in one place and nothing is read twice."""
    each = df.filter("reason IS NOT NULL").groupBy("reason", example).agg(F.count("*").alias("n")).withColumn("__part", F.pmod(F.xxhash64(example), F.lit(1024)))
    rank = F.row_number().over(Window.partitionBy("reason", "__part").orderBy(F.asc_nulls_last(example)))
    few = F.collect_list(F.when(F.col("__rank") <= examples, F.col(example)))
    part = each.withColumn("__rank", rank).groupBy("reason", "__part").agg(F.sum("n").alias("n"), few.alias("__few"))
    return part.groupBy("reason").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("__few"))), 1, examples).alias("examples"))


def unify_label(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Rows whose label differs from that of the first row of their group, with the right one."""
    return A.canonical_label(df, group, order, label).filter(~F.col(label).eqNullSafe(F.col("canonical")))


def flag_duplicate_ids(df: DataFrame, group: str, text: str) -> DataFrame:
    """Adds `flagged`: of a pair the one with the shortest text, of three and more all but the shortest (ties by text)."""
    s = A.with_group_stats(df, [group], {"__n": F.count("*"), "__least": F.min(F.struct(F.length(text), F.col(text)))})
    shortest = F.struct(F.length(text), F.col(text)) == F.col("__least")
    return s.withColumn("flagged", F.when(F.col("__n") == 2, shortest).when(F.col("__n") > 2, ~shortest).otherwise(False)).drop("__n", "__least")


def purge_incomplete(items: DataFrame, details: DataFrame, key: str, stage: str, stages: list) -> tuple[DataFrame, DataFrame]:
    """Items whose stages are exactly the given ones are set back: (items with `status`, details that stay)."""
    half = A.set_equals(details, key, stage, stages)
    marked = items.join(half.withColumn("__half", F.lit(True)), key, "left").withColumn("status", F.when(F.col("__half"), "new").otherwise("done")).drop("__half")
    return marked, details.join(half, key, "left_anti")


def overlap_score(now: DataFrame, archive: DataFrame, keys: list[str], line: str) -> DataFrame:
    """For each key of `now`: rows and characters (without trailing blanks) of both sides and those they share, 0.7 times
    the share of characters and 0.3 times the share of rows of `now` that the archive has, as decimal(10,4), each share
    rounded before they are put together, and for characters and rows if there are as many now, more or fewer."""
    m, one = F.least("na", "nb"), F.when(F.col("size").isNotNull(), F.least("na", "nb")).otherwise(0)
    sums = {f"{what}_{n}": F.sum(F.col(x) * size) for what, size in (("n_rows", F.lit(1)), ("n_chars", F.coalesce("size", F.lit(0)))) for n, x in (("now", "na"), ("archive", "nb"))}
    sums |= {"n_rows_shared": F.sum(one), "n_chars_shared": F.sum(m * F.coalesce("size", F.lit(0)))}
    both = A.bags(now, archive, keys, line).groupBy(*keys).agg(*[e.cast("long").alias(n) for n, e in sums.items()]).filter("n_rows_now > 0")
    share = lambda x: F.coalesce(F.try_divide(F.col(f"{x}_shared").cast("decimal(18,4)"), F.col(f"{x}_now").cast("decimal(18,4)")), F.lit(0)).cast("decimal(10,4)")
    both = both.withColumns({"char_share": share("n_chars"), "line_share": share("n_rows")})
    score = (F.lit("0.7").cast("decimal(2,1)") * F.col("char_share") + F.lit("0.3").cast("decimal(2,1)") * F.col("line_share")).cast("decimal(10,4)")
    way = lambda x: F.when(F.col(f"{x}_now") == F.col(f"{x}_archive"), "equal").when(F.col(f"{x}_now") > F.col(f"{x}_archive"), "more now").otherwise("fewer now")
    return both.withColumns({"score": score, "char_direction": way("n_chars"), "line_direction": way("n_rows")})


def item_score(scores: DataFrame, item: str) -> DataFrame:
    """The mean score of an item's parts, weighted by their characters; null for an item without any."""
    g = scores.groupBy(item).agg(F.sum(F.col("score") * F.col("n_chars_now")).alias("s"), F.sum("n_chars_now").alias("n"))
    return g.select(item, F.round(F.try_divide(F.col("s").cast("double"), F.col("n").cast("double")), 4).alias("score"))


def route(df: DataFrame, score: str, limit: float) -> tuple[DataFrame, DataFrame]:
    """(automatic: at most the limit or unknown, manual: above it)."""
    low = F.col(score).isNull() | (F.col(score) <= limit)
    return df.filter(low), df.filter(F.col(score) > limit)


def flatten_document(df: DataFrame, key: str, doc: str, parts: list[str]) -> DataFrame:
    """A struct of maps line number -> text as rows (key, part, line, text); blank texts go, a bad number becomes 1."""

    def entries(part: str) -> Column:
        pairs = F.map_entries(F.coalesce(F.col(f"{doc}.{part}"), F.create_map().cast("map<string,string>")))
        return F.transform(pairs, lambda e: F.struct(F.lit(part).alias("part"), e["key"].alias("k"), e["value"].alias("text")))

    rows = F.flatten(F.array(*[entries(p) for p in parts]))
    out = df.select(key, F.explode(rows).alias("r")).select(key, "r.part", F.coalesce(F.col("r.k").try_cast("int"), F.lit(1)).alias("line"), "r.text")
    return out.filter(F.trim("text") != "")


def flatten_blocks(df: DataFrame, key: str, blocks: str, names: DataFrame, name_key: str, default: str) -> DataFrame:
    """An array of struct(id, speaker, lines map) as rows (key, block, speaker_id, line, text); unknown speakers get the
    default's id."""
    b = df.select(key, F.explode(blocks).alias("b")).select(key, F.col("b.id").alias("block"), F.col("b.speaker").alias("speaker"), F.explode("b.lines").alias("k", "text"))
    named = b.join(names.groupBy(F.col("name").alias("speaker")).agg(F.min(name_key).alias("speaker_id")), "speaker", "left")
    other = names.filter(F.col("name") == default).agg(F.min(name_key).alias("__d"))
    return named.crossJoin(F.broadcast(other)).select(key, "block", F.coalesce("speaker_id", "__d").alias("speaker_id"), F.coalesce(F.col("k").try_cast("int"), F.lit(1)).alias("line"), "text").filter(F.trim("text") != "")


def pick_branches(df: DataFrame, doc: str, paths: list[str]) -> DataFrame:
    return df.withColumn(doc, F.struct(*[F.col(f"{doc}.{p}").alias(p) for p in paths]))


def validate_document(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `problems`: the names of the rules a row doesn't meet (null counts as not met)."""
    return df.withColumn("problems", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])))


def review_sheet(lines: DataFrame, keys: list[str], text: str, names: DataFrame, name_on: str, archive: DataFrame | None = None) -> DataFrame:
    """Each line as `original` with its name, a blank row `approved`, and an archived text as `suggestion`."""
    named = lines.join(names, name_on, "left")
    sheet = named.select(*keys, F.lit("original").alias("status"), F.col(text).alias("text"), "name").unionByName(named.select(*keys, F.lit("approved").alias("status"), F.lit("").alias("text"), "name"))
    if archive is not None:
        old = archive.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(text).alias("__text"))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        sheet = sheet.unionByName(named.join(old, on).select(*keys, F.lit("suggestion").alias("status"), F.col("__text").alias("text"), "name"))
    return sheet


def approve(sheet: DataFrame, keys: list[str]) -> DataFrame:
    """Original and approved rows paired by key: the approved text with the original's key of text, or an `error`."""
    o = sheet.filter("status = 'original'").select(*keys, F.col("text").alias("original"))
    a = sheet.filter("status = 'approved'").select(*keys, F.col("text").alias("approved"))
    both = o.join(a, keys, "full_outer")
    error = F.when(F.col("original").isNull(), "no original").when(F.col("approved").isNull(), "no approved").when(F.trim("approved") == "", "blank")
    return both.select(*keys, "approved", F.sha2("original", 256).alias("original_key"), error.alias("error"))


def enrich(target: DataFrame, df: DataFrame, key: str | list[str], cols: list[str], order: list[str] | None = None) -> DataFrame:
    """New values for known keys (one column or several; null keys match nothing); where a row matches, its null overwrites
    too. Of rows of one key the last one by `order` counts, then by its values (`repeated_keys` reports them)."""
    keys = [key] if isinstance(key, str) else list(key)
    last = F.max_by(F.struct(*cols), F.struct(*(order or []), *cols))
    new = df.groupBy(*keys).agg(last.alias("__new"))
    out = target.join(new, keys, "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def split_upsert(target: DataFrame, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    known = target.select(key)
    return df.join(known, key, "left_anti"), df.join(known, key, "left_semi")


def fill_missing(target: DataFrame, df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    new = df.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    return target.join(new, key, "left").select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in target.columns])


def fold_to_majority(df: DataFrame, group: str, val: str, priority: Column) -> tuple[DataFrame, DataFrame]:
    """(majority of each group, the rows that differ from it)."""
    top = A.majority(df, [group], val, priority).select(group, F.col(val).alias("majority"))
    return top, df.join(top, group).filter(~F.col(val).eqNullSafe(F.col("majority"))).drop("majority")


def line_counts(df: DataFrame, roles: list[str], least: int) -> DataFrame:
    return df.unpivot([], roles, "role", "who").groupBy("role", "who").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def items_without(items: DataFrame, *details: DataFrame, on) -> DataFrame:
    return reduce(lambda a, d: a.join(d, on, "left_anti"), details, items)


def stamp_changes(old: DataFrame, new: DataFrame, key: str, cols: list[str], ts: str) -> DataFrame:
    """New rows with updated_at where a column differs from the old row or there is none."""
    o = old.select(key, *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__hit"))
    changed = F.col("__hit").isNull() | reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols])
    return new.join(o, key, "left").select(*new.columns, F.when(changed, F.lit(ts).cast("timestamp")).alias("updated_at"))


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of calls: prices (model, input_price, output_price) for a million tokens, cached input at a tenth."""
    p = usage.join(prices, "model", "left")
    d = lambda c: F.col(c).cast("decimal(18,8)")
    million, tenth = F.lit(1_000_000).cast("decimal(10,0)"), F.lit("0.1").cast("decimal(2,1)")
    fresh = (F.col("input_tokens") - F.col("cached_tokens")).cast("decimal(12,0)")
    cost = (fresh * d("input_price") + F.col("cached_tokens").cast("decimal(12,0)") * tenth * d("input_price") + F.col("output_tokens").cast("decimal(12,0)") * d("output_price")) / million
    return p.withColumn("cost", cost.cast("decimal(18,8)"))


def check(df: DataFrame, name: str, unique: list[str] = (), not_null: list[str] = (), closed: dict[str, list] | None = None, foreign: dict[str, DataFrame] | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """Violations by expectation: (table_name, expectation, n); only those with any."""
    tests = {f"{c} not null": F.col(c).isNull() for c in not_null}
    tests |= {f"{c} in list": ~F.col(c).isin(v) for c, v in (closed or {}).items()}
    tests |= {n: ~F.coalesce(r, F.lit(False)) for n, r in (rules or {}).items()}
    frames = []
    if tests:
        pairs = F.array(*[F.struct(F.lit(n).alias("expectation"), F.count_if(t).alias("n")) for n, t in tests.items()])
        frames.append(df.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*"))
    if unique:
        frames.append(df.groupBy(*unique).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{', '.join(unique)} unique").alias("expectation"), "n"))
    for c, dim in (foreign or {}).items():
        frames.append(df.filter(F.col(c).isNotNull()).join(dim.select(F.col(dim.columns[0]).alias(c)), c, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{c} known").alias("expectation"), "n"))
    return reduce(lambda a, b: a.unionByName(b), frames).filter("n > 0").select(F.lit(name).alias("table_name"), "expectation", "n")


def checked_write(df: DataFrame, path: str, name: str, not_null: list[str] = (), closed: dict[str, list] | None = None, rules: dict[str, Column] | None = None, unique: list[list[str]] = (), foreign: dict[str, DataFrame] | None = None) -> DataFrame:
    """Writes a table and returns its violations by expectation (table_name, expectation, n), only those with any. What a row
    shows by itself is counted while it is written (an Observation), so df is computed once. Keys that aren't unique
    are counted on the written keys, unknown ones by one join for each foreign table."""
    tests = {f"{c} not null": F.col(c).isNull() for c in not_null}
    tests |= {f"{c} in list": ~F.col(c).isin(v) for c, v in (closed or {}).items()}
    tests |= {n: ~F.coalesce(r, F.lit(False)) for n, r in (rules or {}).items()}
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests.values())])
    watched.write.parquet(path)
    spark = df.sparkSession
    got = seen.get
    frames = [spark.createDataFrame([(n, got[f"t{i}"]) for i, n in enumerate(tests)], "expectation string, n long")] if tests else []
    written = spark.read.schema(df.schema).parquet(path)
    for keys in unique:
        frames.append(repeated_keys(written, keys).agg(F.count("*").alias("n")).select(F.lit(f"{', '.join(keys)} unique").alias("expectation"), "n"))
    for c, dim in (foreign or {}).items():
        frames.append(written.filter(F.col(c).isNotNull()).join(dim.select(F.col(dim.columns[0]).alias(c)), c, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{c} known").alias("expectation"), "n"))
    return reduce(lambda a, b: a.unionByName(b), frames).filter("n > 0").select(F.lit(name).alias("table_name"), "expectation", "n")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def missing_cells(entities: DataFrame, dates: DataFrame, present: DataFrame, most_dates: int = 50_000) -> DataFrame:
    """The grid of entities and dates without what is present. The calendar is sent to all tasks, so it may hold
    `most_dates` rows."""
    if dates.limit(most_dates + 1).count() > most_dates:
        raise ValueError(f"a calendar of more than {most_dates} rows")
    return entities.crossJoin(F.broadcast(dates)).join(present, [*entities.columns, *dates.columns], "left_anti")


def percent_text(part: Column, whole: Column) -> Column:
    """`12,3%` for whole numbers part of whole, in whole tenths, halves up: a share as a double may lie below the half it stands for."""
    tenths = F.call_function("div", 2000 * part + whole, 2 * whole)
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit("%"))


def explode_shares(df: DataFrame, keys: list[str], col: str, none: str = "none") -> DataFrame:
    """`name 12,3%, other 4%` -> a row for each (name, pct); the marker for none and blanks give no rows."""
    items = df.filter(F.lower(F.trim(col)) != none).select(*keys, F.explode(F.split(col, r",\s+")).alias("item"))
    pattern = r"^(.*?)\s+(\d+(?:[.,]\d+)?)\s*%$"
    return items.filter(F.col("item").rlike(pattern)).select(*keys, F.regexp_extract("item", pattern, 1).alias("name"), F.replace(F.regexp_extract("item", pattern, 2), F.lit(","), F.lit(".")).cast("double").alias("pct"))


def split_cached(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose payload decodes, rows to fetch again)."""
    from ..sources.io import decode_payload

    out = decode_payload(df, payload)
    return out.filter("decoded IS NOT NULL"), out.filter("decoded IS NULL").drop("decoded")


def progress(df: DataFrame, levels: list[str], done: Column) -> DataFrame:
    """Counts at each level: level, name, n, done. Rows are counted by all levels together first, so that only groups are
    repeated for each level."""
    g = df.groupBy(*levels).agg(F.count("*").alias("n"), F.count_if(done).alias("d"))
    sets = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in levels])
    return g.select(F.explode(sets).alias("g"), "n", "d").groupBy("g.level", "g.name").agg(F.sum("n").alias("n"), F.sum("d").alias("done"))


def templatize(col: str, words: dict[str, str]) -> Column:
    """Whole words replaced by placeholders, without regard to case."""
    import re

    return reduce(lambda x, p: F.regexp_replace(x, rf"(?i)(?<![\p{{L}}\p{{N}}]){re.escape(p[0])}(?![\p{{L}}\p{{N}}])", p[1].replace("$", "\\$")), words.items(), F.col(col))


def translate(df: DataFrame, key: str, col: str, dictionary: DataFrame) -> DataFrame:
    """Parts between line ends looked up in dictionary (source, target), unknown ones kept, put together in order; a row for
    each row (key, translated), null for a null text. Only parts that are looked up are shuffled, as two hashes and their
    length, and each distinct text is translated once, so repeated rows and keys neither meet nor multiply."""
    part = F.lower(F.trim("part"))
    code = lambda x: [F.xxhash64(x).alias("__h"), F.hash(x).alias("__g"), F.length(x).alias("__l")]
    text = [F.xxhash64(col).alias("__th"), F.hash(col).alias("__tg"), F.length(col).alias("__tl")]
    known = dictionary.select(F.lower(F.trim("source")).alias("s"), "target").groupBy("s").agg(F.min("target").alias("target")).select(*code("s"), "target").filter("target IS NOT NULL")
    once = df.filter(F.col(col).isNotNull()).select(*text, F.col(col).alias("__text")).dropDuplicates(["__th", "__tg", "__tl"])
    parts = once.select("__th", "__tg", "__tl", F.posexplode(F.split("__text", "\n")).alias("at", "part")).select("__th", "__tg", "__tl", "at", *code(part))
    hits = parts.join(known, ["__h", "__g", "__l"]).groupBy("__th", "__tg", "__tl").agg(F.map_from_entries(F.collect_list(F.struct("at", "target"))).alias("__hits"))
    out = df.select(key, col, *text).join(hits, ["__th", "__tg", "__tl"], "left")
    lines = F.transform(F.split(col, "\n"), lambda x, i: F.coalesce(F.element_at("__hits", i), x))
    return out.select(key, F.when(F.col("__hits").isNull(), F.col(col)).otherwise(F.array_join(lines, "\n")).alias("translated"))


def translate_core(df: DataFrame, key: str, col: str, dictionary: DataFrame) -> DataFrame:
    """A prefix in brackets and a counter n/m around the text stay; what is between is looked up."""
    pattern = r"^(\s*(?:\[[^\]]*\]\s*)?)(.*?)(\s*(?:\d+/\d+\s*)?)$"
    core = df.select(key, *[F.regexp_extract(col, pattern, i).alias(n) for i, n in ((1, "head"), (2, "core"), (3, "tail"))])
    d = dictionary.groupBy(F.lower(F.trim("source")).alias("__s")).agg(F.min("target").alias("target"))
    return core.join(d, F.lower(F.trim("core")) == F.col("__s"), "left").select(key, F.concat("head", F.coalesce("target", "core"), "tail").alias("translated"))


def full_text(df: DataFrame, keys: list[str], order: str, parts: list[str]) -> DataFrame:
    """Rows of a key as one text in order; a row is its parts joined by a colon, null as empty."""
    line = F.concat_ws(": ", *[F.coalesce(F.col(p), F.lit("")) for p in parts])
    return A.concat_list(df.withColumn("__line", line), keys, "__line", order, "\n").withColumnRenamed("items", "full_text")
