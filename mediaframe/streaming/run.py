"""Start a stream over files, run it to the end of what is there, and read the result back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.lineage import cut_lineage, work_dir
from mediaframe.functions.ordered import by_width, in_blocks, lag_rows, last_at


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(writer, spark: SparkSession, path: str | None = None):
    """Start a query on the RocksDB state store, which keyed state needs and which stays off the heap.

    The query keeps its own copy of the setting; the session's is put back at once.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return writer.start(path) if path else writer.start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def append_log(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Durable append sink: every micro-batch is committed once, together with its source offsets."""
    w = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return _start(w, stream.sparkSession, path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Push everything available through the stream and return the appended rows."""
    spark = stream.sparkSession
    base = work_dir(spark, "stream")
    q = append_log(stream, f"{base}/out", f"{base}/checkpoint", mode)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def complete(emitted: DataFrame, rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a drained stream has emitted, and the rows of ``rest`` (same columns) whose keys were still held back in its state."""
    return emitted.unionByName(rest.join(emitted.select(*keys), list(keys), "left_anti").select(*emitted.columns))


def first_matches(stream: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Stop the stream once n rows have been written; the surplus of the last micro-batch is cut by order.

    What has been written is counted from the files of the earlier micro-batches, so a restart or a repeated micro-batch keeps the count.
    """
    spark = stream.sparkSession
    base = work_dir(spark, "first")
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())]))
    written = lambda before: rows.parquet(f"{base}/out").where(F.col("batch") < before).count()

    def keep(batch: DataFrame, batch_id: int) -> None:
        left = n - written(batch_id)
        if left > 0:
            batch.orderBy(*order).limit(left).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    while not q.awaitTermination(1):
        if written(1 << 62) >= n:
            q.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def counter_watch(polls: DataFrame, max_polls: int = 20_000_000) -> DataFrame:
    """Online change points of counters (run, f, v), f numbering the polls of a run without gaps.

    Emits a row of kind 'change' where the value differs from the poll before, and one of kind 'timeout' when a value
    has stood for max_polls polls (a bounded wait). No keyed Python state: each micro-batch joins the last poll of every
    run, kept as a table beside the output, and runs the blocked scans, so a run with most of the polls is still spread
    out. A repeated micro-batch overwrites its own files.
    """
    spark = polls.sparkSession
    base = work_dir(spark, "watch")
    f, v = F.col("f"), F.col("v")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("run", "f", "v", F.lit(None).cast("bigint").alias("since"))
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema("run bigint, f bigint, v bigint, since bigint").parquet(f"{base}/last/batch={batch_id - 1}"))
        seen = lag_rows(in_blocks(rows, by_width("f")), ["run"], ["f"], None, {"prev": v})
        old, changed = F.col("since").isNotNull(), F.col("prev") != v
        # the poll a value has stood since: its change, or the one before the first poll of the run
        mark = F.when(old, F.col("since")).when(F.col("prev").isNull(), f - 1).when(changed, f)
        seen = cut_lineage(last_at(seen, ["run"], ["f"], None, {"stood": mark}))
        kind = F.when(changed, "change").when(f - F.col("stood") == max_polls, "timeout")
        out = seen.where(~old).select("run", "f", "v", "prev", kind.alias("kind")).where("kind is not null")
        out.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        last = seen.groupBy("run").agg(F.max("f").alias("f"), F.max_by("v", "f").alias("v"), F.max_by("stood", "f").alias("since"))
        last.write.mode("overwrite").parquet(f"{base}/last/batch={batch_id}")

    for_each_batch(polls, step, f"{base}/checkpoint").awaitTermination()
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("run", "f", "v", "prev")] + [T.StructField("kind", T.StringType())])
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)


def counter_changes(polls: DataFrame) -> DataFrame:
    """The change rows of ``counter_watch``."""
    return counter_watch(polls).where("kind = 'change'").drop("kind")


def for_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
