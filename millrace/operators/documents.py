"""Documents as JSON text: flattened, checked and cut without a schema, by VARIANT.

A text that isn't JSON gives a null document. Branches that are missing or of another type than expected give no rows;
`problems` says which ones. All of it is expressions and lateral explodes: nothing is shuffled, and one document's parts
are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(df: DataFrame, col: str, out: str = "doc") -> DataFrame:
    return df.withColumn(out, F.try_parse_json(F.col(col)))


def path(*names: str | int) -> str:
    """A path of names and positions, whatever characters the names have (but quotes)."""
    return "$" + "".join(f"[{n}]" if isinstance(n, int) else f'["{n}"]' for n in names)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def branch(doc: Column | str, *names: str | int) -> Column:
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, path(*names), "variant")


def text_of(v: Column) -> Column:
    """The text of a scalar without blanks around it; objects and arrays as JSON; null for null."""
    whole = F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return F.when(~F.is_variant_null(v), F.btrim(whole, F.lit(" \t\r\n\f\v")))


def exploded(df: DataFrame, v: Column, name: str, value: str, want: str = "OBJECT") -> DataFrame:
    """A row for each entry of an object or an array, with its key or position; no rows for anything else."""
    rows = df.withColumn("v__", F.when(kind(v) == want, v))
    entries = df.sparkSession.tvf.variant_explode(F.col("v__").outer())
    at = "key" if want == "OBJECT" else "pos"
    return rows.lateralJoin(entries.select(F.col(at).alias(name), F.col("value").alias(value))).drop("v__")


def line_number(k: Column) -> Column:
    """A number of a line by its key; a bad one is 1."""
    return F.coalesce(F.when(F.trim(k).rlike(r"^[+-]?\d+$"), F.trim(k).try_cast("int")), F.lit(1))


def flatten(df: DataFrame, key: str, doc: str, sections: dict[str, list[str]], nested: dict[str, tuple[list[str], dict[str, str]]] | None = None) -> DataFrame:
    """A row (key, part, sub, line, text) for each line that isn't blank. sections: name of the part -> where its object of
    number -> text is; nested: the same with objects by sub-section between, of which those named are taken (name in the
    document -> name in the result)."""
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.lit(None).cast("string").alias("sub"), branch(doc, *where).alias("v")) for n, where in sections.items()], *[F.struct(F.lit(n).alias("part"), F.lit(to).alias("sub"), branch(doc, *where, s).alias("v")) for n, (where, subs) in (nested or {}).items() for s, to in subs.items()])
    rows = df.select(key, F.explode(parts).alias("p")).select(key, "p.part", "p.sub", F.col("p.v").alias("v"))
    lines = exploded(rows, F.col("v"), "k", "line_value").select(key, "part", "sub", line_number(F.col("k")).alias("line"), text_of(F.col("line_value")).alias("text"))
    return lines.filter("text <> ''")


def flatten_blocks(df: DataFrame, key: str, doc: str, where: list[str], names: DataFrame, name_key: str, default: str, fields: dict[str, str] | None = None) -> DataFrame:
    """An array of objects with id, a kind, a speaker and an object of lines as rows (key, block, kind, speaker_id, line, text).
    fields: what these are called in the document. Elements that are no objects give no rows, and a block without an id counts as
    its position; unknown and missing speakers get the default's id. names (name, key): the least key of a name."""
    f = {"id": "id", "kind": "kind", "speaker": "speaker", "lines": "lines"} | (fields or {})
    blocks = exploded(df.select(key, doc), branch(doc, *where), "at", "b", "ARRAY")
    get = lambda n: text_of(branch("b", f[n]))
    blocks = blocks.filter(kind(F.col("b")) == "OBJECT").select(key, F.coalesce(get("id").try_cast("int"), "at").alias("block"), get("kind").alias("kind"), get("speaker").alias("speaker"), branch("b", f["lines"]).alias("v"))
    rows = exploded(blocks, F.col("v"), "k", "line_value").select(key, "block", "kind", "speaker", line_number(F.col("k")).alias("line"), text_of(F.col("line_value")).alias("text")).filter("text <> ''")
    known = names.groupBy(F.col("name").alias("speaker")).agg(F.min(name_key).alias("speaker_id"))
    other = names.filter(F.col("name") == default).agg(F.min(name_key).alias("__d"))
    named = rows.join(known, "speaker", "left").crossJoin(F.broadcast(other))
    return named.select(key, "block", "kind", F.coalesce("speaker_id", "__d").alias("speaker_id"), "line", "text")


def need_object(*names: str, keys: Iterable[str] = ()) -> Column:
    """Problems of a branch (of column doc) that should be an object and have some keys; a key with a null is there."""
    v, where = _at(names)
    return F.when(~_is(v, "OBJECT"), F.array(F.lit(f"{where} (object expected)"))).otherwise(_missing(v, F.lit(where), keys))


def need_array(*names: str, keys: Iterable[str] = (), closed: dict[str, list[str]] | None = None) -> Column:
    """Problems of a branch that should be an array of objects, which have some keys, and of those some a value of a list."""
    v, where = _at(names)

    def one(e, i):
        at = F.concat(F.lit(f"{where}["), i.cast("string"), F.lit("]"))
        bad = [F.when(branch(e, k).isNotNull() & ~F.coalesce(text_of(branch(e, k)).isin(allowed), F.lit(False)), F.concat(at, F.lit(f".{k} (not in the list)"))) for k, allowed in (closed or {}).items()]
        return F.when(~_is(e, "OBJECT"), F.array(F.concat(at, F.lit(" (object expected)")))).otherwise(F.concat(_missing(e, at, keys), F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")))

    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(~_is(v, "ARRAY"), F.array(F.lit(f"{where} (list expected)"))).otherwise(F.flatten(F.transform(items, one)))


def _at(names: tuple[str, ...]) -> tuple[Column, str]:
    return (branch("doc", *names) if names else F.col("doc")), ".".join(["root", *names])


def _is(v: Column, want: str) -> Column:
    return F.coalesce(kind(v) == want, F.lit(False))


def _missing(v: Column, at: Column, keys: Iterable[str]) -> Column:
    tests = [F.when(branch(v, k).isNull(), F.concat(at, F.lit(f".{k}"))) for k in keys]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def validate(df: DataFrame, *needs: Column) -> DataFrame:
    """Adds `problems` of column doc, in the order of what is needed."""
    return df.withColumn("problems", F.flatten(F.array(*needs)))
