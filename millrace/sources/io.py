"""Sources and sinks. Schemas are always given; a sink never writes to the path it reads."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """The rows dealt to tasks of so many, for slow work on each row: a small file is one task, however long its rows take."""
    return df.repartition(max(1, -(-df.count() // rows_per_task)))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Only a local session may do without: there
    the driver is the only machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def read_csv_labeled(spark: SparkSession, path: str, schema: str, label: str = "label") -> DataFrame:
    """All CSV files below a path with the folder they are in (the part after `=` of key=value) as a column."""
    df = spark.read.option("recursiveFileLookup", True).csv(path, schema=schema, header=True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.withColumn(label, F.url_decode(F.regexp_replace(folder, "^[^=]*=", "")))


def read_partitioned(spark: SparkSession, path: str, base: str) -> DataFrame:
    return spark.read.option("basePath", base).parquet(path)


def write_dsv(df: DataFrame, path: str, sep: str = ";", decimal: str = ",") -> None:
    """Doubles are written with the given decimal sign."""
    cols = [F.replace(F.col(c).cast("string"), F.lit("."), F.lit(decimal)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, sep=sep, header=True)


def read_dsv(spark: SparkSession, path: str, schema: str, sep: str = ";", decimal: str = ",") -> DataFrame:
    kinds = spark.createDataFrame([], schema).dtypes
    raw = spark.read.csv(path, schema=", ".join(f"{c} {'string' if t in ('double', 'float') else t}" for c, t in kinds), sep=sep, header=True)
    return raw.select(*[F.replace(F.col(c), F.lit(decimal), F.lit(".")).try_cast(t).alias(c) if t in ("double", "float") else F.col(c) for c, t in kinds])


def union_tagged(spark: SparkSession, path: str, schema: str, names: DataFrame, key: str) -> DataFrame:
    """One read of many files, each row with the entity that `names` (key, ...) has for its folder."""
    return read_csv_labeled(spark, path, schema, key).join(names, key)


def read_numbered_answers(spark: SparkSession, path: str) -> DataFrame:
    """Text files with a line `n. answer` each -> file, number, answer; a number inside a line is text."""
    text = spark.read.text(path, lineSep="\n").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("file"), F.col("value").alias("line"))
    pattern = r"(?s)^(\d+)\.\s+(.*)$"
    return text.filter(F.col("line").rlike(pattern)).select("file", F.regexp_extract("line", pattern, 1).cast("int").alias("number"), F.regexp_extract("line", pattern, 2).alias("answer"))


def read_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """The selection reaches the scan (ReadSchema)."""
    return spark.read.parquet(path).select(*cols)


def append(df: DataFrame, target: str) -> None:
    df.write.mode("append").parquet(target)


def new_rows(target: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key the target lacks, one for each key."""
    return df.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def insert_ignore(spark: SparkSession, target: str, df: DataFrame, keys: list[str]) -> None:
    """Appends what is new. The rows are computed before the target grows, so a second call adds nothing."""
    append(new_rows(spark.read.parquet(target), df, keys), target)


def ensure_keys(dim: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """dim (key, name) with a new key for each name it lacks. Numbering goes by range partitions: only the number of new
    names of each is summed in one place."""
    fresh = names.select(name).filter(F.col(name).isNotNull()).distinct().join(dim.select(name), name, "left_anti")
    spread = fresh.repartitionByRange(F.col(name)).withColumn("__p", F.spark_partition_id())
    spread = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(name)))
    sizes = spread.groupBy("__p").agg(F.max("__n").alias("__size"))
    base = sizes.select("__p", F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    last = dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("__last"))
    added = spread.join(base, "__p").crossJoin(F.broadcast(last)).select((F.col("__last") + F.col("__base") + F.col("__n")).cast(dim.schema[key].dataType).alias(key), name)
    return dim.select(key, name).unionByName(added)


def write_sharded(df: DataFrame, path: str, rows_per_file: int) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).csv(path, header=True)


def _payload(df: DataFrame, col: str, out: str, fn) -> DataFrame:
    """A Python worker holds the hundred rows of a pickled batch; an Arrow batch has ten thousand, whole pages each. It isn't
    called deterministic, so that a filter on the result doesn't call it again."""
    return df.withColumn(out, F.udf(fn, "string", useArrow=False).asNondeterministic()(col))


def encode_payload(df: DataFrame, col: str, out: str = "payload") -> DataFrame:
    """Text compressed and written in base 64."""
    import base64

    return _payload(df, col, out, lambda x: None if x is None else base64.b64encode(zlib.compress(x.encode())).decode())


def decode_payload(df: DataFrame, col: str, out: str = "decoded") -> DataFrame:
    """The text again; null where the payload is broken."""
    import base64
    import binascii

    def one(x):
        try:
            return None if x is None else zlib.decompress(base64.b64decode(x, validate=True)).decode()
        except (binascii.Error, zlib.error, UnicodeDecodeError, ValueError):
            return None

    return _payload(df, col, out, one)


def dim_from_mapping(spark: SparkSession, mapping: dict, key: str) -> DataFrame:
    """{key: {attribute: value}} -> one row for each key."""
    names = sorted({n for row in mapping.values() for n in row})
    return spark.createDataFrame([(k, *[v.get(n) for n in names]) for k, v in mapping.items()], ", ".join([f"{key} string", *[f"{n} string" for n in names]])).dropDuplicates([key])
