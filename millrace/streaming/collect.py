"""Structured Streaming jobs on file streams; sinks are idempotent, so a batch that runs again adds nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.io import new_rows


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def collect_unseen(stream: DataFrame, known: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key that `known` lacks. State is bounded by the watermark; the sink's insert keeps a key that
    comes back later from being written again. Null keys are no keys."""
    fresh = stream.filter(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")
    return fresh.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def insert_into(target: str, keys: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: rows whose key the target lacks. The target has a folder for each of a fixed number of
    hashed keys' buckets (column key_bucket), and a batch reads and writes those of its own keys only."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn("key_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        batch.limit(0).write.partitionBy("key_bucket").mode("ignore").parquet(target)  # an empty table at first
        own = [r.key_bucket for r in batch.select("key_bucket").distinct().collect()]  # at most `buckets`
        known = batch.sparkSession.read.schema(batch.schema).parquet(target).filter(F.col("key_bucket").isin(own))
        fresh = new_rows(known, batch, keys)
        fresh.repartition("key_bucket").write.partitionBy("key_bucket").mode("append").parquet(target)

    return write


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles all that is there now in batches, then ends."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def route_stream(stream: DataFrame, col: str, targets: dict[str, str], keys: list[str], checkpoint: str) -> None:
    """Each type to its own target; other types are left."""
    sinks = {t: insert_into(path, keys) for t, path in targets.items()}

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        for t, sink in sinks.items():
            sink(batch.filter(F.col(col) == t), n)
        batch.unpersist()

    drain(stream, write, checkpoint)


def drain_queue(spark: SparkSession, path: str, schema, target: str, keys: list[str], checkpoint: str) -> None:
    """A folder of files as a queue: each batch goes to the target once, the checkpoint remembers which are done."""
    drain(read_stream(spark, path, schema), insert_into(target, keys), checkpoint)


def once(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink for stateful streams: the batch is computed whole, one time, before the sink reads it (a state store is
    locked by a batch that is only half read)."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.count()
        sink(batch, number)
        batch.unpersist()

    return write


PACKED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def collect_first(stream: DataFrame, known: DataFrame, key: str, order: list[str], ttl: str = "30 days") -> DataFrame:
    """The first row of each text key that `known` lacks, with all its columns as context: of the batch in which a key is
    first seen, the least one by `order` (nulls last). Keyed state in RocksDB remembers which keys were seen, until none of a key's
    rows came for `ttl` of processing time; late rows are never dropped. The sink's insert (`insert_into`) keeps a key that comes back
    after that from being written again. Null and empty keys are no keys. Each task reduces its rows to one a key before
    they are shuffled, so a hot key is a row for each task."""
    spark, ms = stream.sparkSession, 1000 * int(pd.Timedelta(ttl).total_seconds())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a drained stream never ends: its clock goes on
    columns, names = stream.schema, [f"o{i}_" for i in range(len(order))]
    packed = stream.withColumn("key_", F.col(key).cast("string")).filter(F.col("key_") != "").join(known.select(F.col(key).cast("string").alias("key_")).distinct(), "key_", "left_anti")
    packed = packed.select("key_", *[F.col(o).alias(n) for o, n in zip(order, names, strict=True)], F.to_json(F.struct(*stream.columns), PACKED).alias("row_"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _first(pa.Table.from_batches([b]), names)

    rows = packed.mapInArrow(least, packed.schema).groupBy("key_").transformWithState(_FirstSeen(names, ms), "row_ string", "Append", "ProcessingTime")
    return rows.select(F.from_json("row_", columns, PACKED).alias("r")).select("r.*")


class _FirstSeen(StatefulProcessor):
    """State: that a key was seen, with a time to live that each of its rows sets anew."""

    def __init__(self, order: list[str], ttl_ms: int):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = lambda r: (*[(r[o] is None, r[o]) for o in self.order], r["row_"])
        first = min(rows, key=place)
        new = not self.seen.exists()
        self.seen.update((True,))
        if new:
            yield Row(row_=first["row_"])

    def close(self) -> None:
        pass


def _first(t: pa.Table, names: list[str]) -> pa.RecordBatch:
    t = t.sort_by([("key_", "ascending"), *[(n, "ascending") for n in names], ("row_", "ascending")]).combine_chunks()
    keys = t["key_"].combine_chunks() if isinstance(t["key_"], pa.ChunkedArray) else t["key_"]
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)))
    kept = t.filter(pa.array(new)).combine_chunks()
    return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    """Files that are gone already are no error. Spark gives their paths as URIs."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(p))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def work_queue(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, failed: str, keys: list[str], checkpoint: str, tries: int = 3, files_per_trigger: int = 1) -> int:
    """Drains a folder of files as a queue whose items are deleted when they are done, and returns how many batches it took.

    `work` adds `error` to a batch's rows (and may change other columns): null for success. Rows that succeed go to the target, once for each key.
    Rows that fail go back into the queue, as a file of the folder `again=<batch>`, with their number of tries; after `tries`
    of them they go to the table `failed`, once for each key. Only when all three are written the batch is committed, and
    then its files are deleted (`cleanSource` for each batch after its successor began, the last batch's at the end). A batch that breaks off
    leaves its files; it runs again with the same files and the same folder, so nothing is lost or counted twice. Columns: those of schema,
    and `tries` for failed rows; `files_per_trigger` bounds a batch."""
    source = f"{schema}, tries int"
    batches, last = 0, []

    def write(batch: DataFrame, number: int) -> None:
        nonlocal batches, last
        found = [r[0] for r in batch.select("file_").distinct().collect()]  # at most files_per_trigger
        done = work(batch.drop("file_").withColumn("tries", F.coalesce("tries", F.lit(0)) + 1)).persist()
        ok, bad = done.filter("error IS NULL").drop("error", "tries"), done.filter("error IS NOT NULL")
        insert_into(target, keys)(ok, number)
        insert_into(failed, keys)(bad.filter(F.col("tries") >= tries), number)
        again = bad.filter(F.col("tries") < tries).select(*batch.drop("file_").columns)
        if not again.isEmpty():
            again.write.mode("overwrite").parquet(f"{path}/again={number}")
        done.unpersist()
        batches, last = batches + 1, found

    while True:
        before = batches
        stream = spark.readStream.schema(source).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).option("cleanSource", "delete").parquet(path)
        drain(stream.select("*", F.col("_metadata.file_path").alias("file_")), write, checkpoint)
        if batches == before:
            return batches
        _delete(spark, last)
