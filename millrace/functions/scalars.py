"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def date_parts(col) -> Column:
    """Struct of year, month, day_of_year, day_of_week (Sunday 0) and ISO week."""
    x = c(col)
    return F.struct(F.year(x).alias("year"), F.month(x).alias("month"), F.dayofyear(x).alias("day_of_year"), (F.dayofweek(x) - 1).alias("day_of_week"), F.weekofyear(x).alias("week"))


def week_start(col) -> Column:
    return F.date_trunc("week", c(col)).cast("date")


def week_index(col) -> Column:
    """Weeks from Monday, 29 December 1969, on; without a jump at new year."""
    return F.floor((F.datediff(week_start(col), F.lit("1970-01-01").cast("date")) + 3) / 7).cast("int")


def month_index(col) -> Column:
    return F.year(c(col)) * 12 + F.month(c(col)) - 1


def to_second(col) -> Column:
    return F.date_trunc("second", c(col))


def from_epoch(col, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(c(col)), tz)


def fmt_date(col, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(c(col), pattern)


def round_to(col, d: int) -> Column:
    return F.round(c(col), d)


def modulo(col, n: int) -> Column:
    return c(col) % n


def absolute(col) -> Column:
    return F.abs(c(col))


def to_decimal(col, p: int, s: int) -> Column:
    return c(col).cast(f"decimal({p},{s})")


def text_len(col) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(c(col)))


def label(fmt: str, *cols) -> Column:
    return F.format_string(fmt, *[c(x) for x in cols])


def before(col, delim: str) -> Column:
    return F.rtrim(F.substring_index(c(col), delim, 1))


def file_stem(col) -> Column:
    return F.regexp_replace(F.element_at(F.split(c(col), "/"), -1), r"\.[^.]*$", "")


def clean_name(col) -> Column:
    """Without bracketed text, with single blanks; empty for null."""
    bare = F.regexp_replace(c(col), r"\[[^\]\n]*\]|\([^)\n]*\)", "")
    return F.coalesce(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(""))


def min_level(col) -> Column:
    """The first two digits of what stands before a hyphen, as a number; 0 if there are none."""
    digits = F.regexp_replace(F.substring_index(c(col), "-", 1), "[^0-9]", "")
    return F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0))


def parse_money(col) -> Column:
    """1 234,50 or 1.234,50 or 1234.5, with a currency beside it, as double; null if it is none."""
    x = F.regexp_replace(c(col), r"[^0-9,.\-]", "")
    x = F.when(x.contains(","), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(x)
    return x.try_cast("double")


def squash(col) -> Column:
    return F.trim(F.regexp_replace(c(col), "[\\s ]+", " "))


def _canonical_steps(base: str) -> list[Callable[[Column], Column]]:
    """What canonical_url does, step by step: each uses what it is given more than once."""
    plain = lambda x: F.regexp_replace(F.trim(x), r"[?#].*$", "")
    absolute = lambda x: F.when(x.rlike("^[a-z]+://"), x).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(x, "^/+", "")))
    ended = lambda x: F.when(x.rlike(r"/$|/[^/]*\.[^/.]*$") & ~x.rlike(r"^[a-z]+://[^/]*$"), x).otherwise(F.concat(x, F.lit("/")))
    return [plain, absolute, ended] if base else [plain, ended]


def canonical_url(col, base: str = "") -> Column:
    """Without query and fragment, absolute, with an end slash unless the last part has a suffix."""
    return reduce(lambda x, step: step(x), _canonical_steps(base), c(col))


def canonical_urls(col, base: str = "") -> Column:
    """canonical_url of each string of an array, where no step is worked out again by the next."""
    return reduce(F.transform, _canonical_steps(base), c(col))


def replace_all(col, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), c(col))


def paragraphs(col) -> Column:
    """Parts between blank lines, without the empty ones."""
    return F.filter(F.transform(F.split(c(col), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def rejoin(col, sep: str = "\n\n") -> Column:
    return F.array_join(c(col), sep)


def split_counter(col) -> Column:
    """`text 3/8` as struct of text, done and total (null without a counter)."""
    x, pattern = c(col), r"^(.*?)\s*(\d+)/(\d+)\s*$"
    return F.struct(F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x).alias("text"), F.regexp_extract(x, pattern, 2).try_cast("int").alias("done"), F.regexp_extract(x, pattern, 3).try_cast("int").alias("total"))


def has_keyword(col, words: list[str]) -> Column:
    """If the text has one of the words, in any case; false for an empty list."""
    return reduce(lambda a, b: a | b, [F.lower(c(col)).contains(w.lower()) for w in words], F.lit(False))


def is_text(col) -> Column:
    """If there is more than blanks or a single hyphen; false for null."""
    return F.coalesce(~F.trim(c(col)).isin("", "-"), F.lit(False))


def text_key(col) -> Column:
    """A key of 16 hex digits for a text (UTF-8; null for null)."""
    return F.when(c(col).isNotNull(), F.lpad(F.lower(F.hex(F.xxhash64(c(col)))), 16, "0"))


def rolling_key(col) -> Column:
    """Two rolling 32-bit sums over the characters of the lower-cased text, as 16 hex digits; null for null and empty."""
    x = F.lower(c(col))

    def total(first: int, factor: int) -> Column:
        return F.aggregate(F.split(x, ""), F.lit(first).cast("long"), lambda h, ch: (h * factor + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))

    sums = [total(5381, 33), total(0, 65599)]  # fixed: first values and factors of the two sums
    return F.when(x != "", F.concat(*[F.lpad(F.lower(F.hex(h)), 8, "0") for h in sums]))


def split_list(col, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(c(col), sep), lambda x: F.trim(x)), lambda x: x != "")


def explode_struct(df: DataFrame, col: str) -> DataFrame:
    return df.select(*[x for x in df.columns if x != col], f"{col}.*")


def map_rows(df: DataFrame, col: str) -> DataFrame:
    """A row for each pair of a map."""
    return df.select(*[x for x in df.columns if x != col], F.explode(col).alias("key", "value"))


def map_get(col, key: str, default) -> Column:
    """The value of a key; the default where the map lacks it or is null."""
    return F.coalesce(F.try_element_at(c(col), F.lit(key)), F.lit(default))


def make_json(*cols: str) -> Column:
    """Columns as a JSON object; nulls are left out."""
    return F.to_json(F.struct(*cols))


def parse_json(col, schema: str) -> Column:
    return F.from_json(c(col), schema)


def ellipsis(col, n: int) -> Column:
    x = c(col)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def fold(col) -> Column:
    return F.lower(F.trim(c(col)))


def has_any_char(col, chars: str) -> Column:
    return F.translate(c(col), chars, "") != c(col)


def blank_to_null(col) -> Column:
    return F.nullif(F.trim(c(col)), F.lit(""))


def first_non_blank(*cols) -> Column:
    return F.coalesce(*[blank_to_null(x) for x in cols])


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """A row for each day with year, month, day and if the year is a leap year."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day")
    y = F.year("day")
    return days.select("day", y.alias("year"), F.month("day").alias("month"), ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).alias("is_leap_year"))
