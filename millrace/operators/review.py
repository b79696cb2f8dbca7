"""Review of texts: sheets that go out with a blank row beside each line, and come back with it filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import order_by_list

ORIGINAL, ARCHIVE, APPROVED = "original", "suggestion", "approved"
KEYS = ["item", "segment", "sub", "block", "line"]


def _number(c: str, default: float | None = None) -> Column:
    n = F.trim(F.col(c).cast("string")).try_cast("double")
    return n if default is None else F.coalesce(n, F.lit(default))


def normal_keys(df: DataFrame) -> dict[str, Column]:
    """Keys under which lines of two sheets meet: no sub-segment is '', block and line are numbers, and no line is the first.
    A missing block is -1, as no block has that number."""
    return {"__item": F.col("item"), "__segment": F.col("segment"), "__sub": F.coalesce(F.trim("sub"), F.lit("")), "__block": F.coalesce(_number("block"), F.lit(-1.0)), "__line": _number("line", 1.0)}


def melted_titles(titles: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A row (item, status, text, ...) for each title column; columns: name -> status."""
    rows = titles.unpivot(["item"], list(columns), "column", "text")
    status = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    return rows.select("item", F.lit("TITLE").alias("segment"), F.lit("").alias("sub"), F.lit(1).alias("block"), F.lit(1).alias("line"), F.element_at(status, F.col("column")).alias("status"), "text")


def build_sheet(lines: DataFrame, titles: DataFrame, title_columns: dict[str, str], segments: list[str], names: dict[str, DataFrame], archive: DataFrame | None = None, priority: list[Column] | None = None) -> DataFrame:
    """A sheet: item, segment, sub, block, line, status, text, a name for each of `names`, and segment_order.

    lines (item, segment, sub, block, line, text) are originals; each distinct place gets a blank row to approve, and with an archive
    (the same columns and what `priority` sorts by) a suggestion: of the rows of its normal keys the first by priority, then by text,
    blank if there is none. Titles are melted from the columns of one row for each item. Names (item, name) come
    from one row for each item (the least name of several). segment_order is the segment's place in `segments`, after them for others."""
    places = lines.select(*KEYS).distinct()
    blank = lambda status: places.withColumns({"status": F.lit(status), "text": F.lit("")})
    typed = lambda df: df.select(*[F.col(k) if k == "item" else F.col(k).cast("string").alias(k) for k in [*KEYS, "status", "text"]])
    rows = [typed(lines.withColumn("status", F.lit(ORIGINAL))), typed(blank(APPROVED)), typed(melted_titles(titles, title_columns))]
    if archive is not None:
        by = F.struct(*(priority or []), F.col("text"))
        best = archive.filter(F.col("text").isNotNull()).withColumns(normal_keys(archive)).groupBy(*normal_keys(archive)).agg(F.min_by("text", by).alias("__text"))
        found = places.withColumns(normal_keys(places)).join(best, list(normal_keys(places)), "left")
        rows.append(typed(found.withColumns({"status": F.lit(ARCHIVE), "text": F.coalesce("__text", F.lit(""))})))
    sheet = rows[0]
    for r in rows[1:]:
        sheet = sheet.unionByName(r)
    for name, table in names.items():
        sheet = sheet.join(table.groupBy("item").agg(F.min("name").alias(name)), "item", "left")
    return sheet.withColumn("segment_order", order_by_list("segment", segments))


def load_approved(sheet: DataFrame, names: DataFrame, name: str, done: str = "3_APPROVED") -> tuple[DataFrame, DataFrame]:
    """(rows to load, rows with errors) of a sheet that came back. Original and approved rows meet by their normal keys. A row
    to load has the approved text, a hash of the original's, the id of the approved row's name and the status `done`. `errors` lists everything
    that is wrong with a place: no or several rows of either kind, a blank text, an original without text, a name that `names` (name, id)
    lacks or has under several ids. Without a name the id is null."""
    keys = normal_keys(sheet)
    rows = sheet.filter(F.col("status").isin(ORIGINAL, APPROVED)).withColumns(keys)
    kind = lambda s, c: F.min(F.when(F.col("status") == s, F.col(c)))
    count = lambda s: F.count_if(F.col("status") == s)
    place = rows.groupBy(*keys).agg(kind(ORIGINAL, "text").alias("original"), kind(APPROVED, "text").alias("approved"), kind(APPROVED, name).alias("name"), count(ORIGINAL).alias("originals"), count(APPROVED).alias("approvals"))
    known = names.groupBy(F.lower(F.trim("name")).alias("__name")).agg(F.min("id").alias("name_id"), F.countDistinct("id").alias("ids"))
    place = place.withColumn("__name", F.lower(F.trim("name"))).join(known, "__name", "left")
    wrong = {
        "no original": F.col("originals") == 0, "repeated original": F.col("originals") > 1, "original without text": (F.col("originals") > 0) & F.col("original").isNull(),
        "no approved": F.col("approvals") == 0, "repeated approved": F.col("approvals") > 1, "blank": (F.col("approvals") > 0) & (F.coalesce(F.trim("approved"), F.lit("")) == ""),
        "unknown name": (F.col("__name") != "") & F.col("ids").isNull(), "ambiguous name": F.col("ids") > 1,
    }
    out = place.select(F.col("__item").alias("item"), F.col("__segment").alias("segment"), F.col("__sub").alias("sub"), F.nullif("__block", F.lit(-1.0)).cast("int").alias("block"), F.col("__line").cast("int").alias("line"), "approved", F.sha2("original", 256).alias("original_hash"), "name_id", F.array_compact(F.array(*[F.when(c, n) for n, c in wrong.items()])).alias("errors"))
    return out.filter(F.size("errors") == 0).drop("errors").withColumn("status", F.lit(done)), out.filter(F.size("errors") > 0).select("item", "segment", "sub", "block", "line", "errors")
