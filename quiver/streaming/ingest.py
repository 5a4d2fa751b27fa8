"""Streams into graphs, and windows over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quiver.sources.csv_quarantine import typed_columns
from quiver.sources.files import csv_lines, header_of, parse_csv
from quiver.workdir import materialise, scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; a single file is read as its folder's only match."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rpartition("/")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _wait(q, timeout: int | None) -> None:
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"the stream didn't end in {timeout} seconds")


def ingest(stream: DataFrame, target: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, timeout: int | None = None) -> None:
    """Append what has arrived to the table ``target``, each micro-batch once.

    A batch is written to a folder named by its number, so a batch that is
    repeated after a failure replaces what it had written.  It takes as long as
    it takes; with ``timeout`` seconds it is stopped then, and goes on from
    there the next time.
    """

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _wait(q, timeout)


def ingest_csv(spark: SparkSession, path: str, target: str, checkpoint: str, per_trigger: int = 1000, timeout: int | None = None) -> None:
    """Append CSV files that have arrived to ``target``/rows, and their bad records with the reason to ``target``/rejected.

    Files with typed headers, all alike; each is taken in once and whole, so
    quoted cells may hold line breaks.  Micro-batches replace what an earlier
    attempt of them wrote.
    """
    columns = header_of(csv_lines(spark.read, path), path)
    stream = csv_lines(spark.readStream.option("maxFilesPerTrigger", per_trigger), path)

    def write(batch: DataFrame, number: int) -> None:
        parsed = materialise(parse_csv(batch, columns), "csv-batch")
        parsed.filter("reason IS NULL").select(*typed_columns(columns, [])).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        parsed.filter("reason IS NOT NULL").select("raw", "reason", "error_at", "error_cell").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    _wait(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), timeout)


def ingest_json_lines(spark: SparkSession, path: str, schema: T.StructType, target: str, checkpoint: str, per_trigger: int = 1000, timeout: int | None = None) -> None:
    """The same for files of JSON lines; a line that isn't an object of the schema is rejected."""
    own = T.StructType([*schema.fields, T.StructField("_raw", T.StringType())])
    stream = spark.readStream.schema(own).option("maxFilesPerTrigger", per_trigger).option("columnNameOfCorruptRecord", "_raw").json(path)

    def write(batch: DataFrame, number: int) -> None:
        rows = materialise(batch, "json-batch")
        rows.filter("_raw IS NULL").drop("_raw").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        rows.filter("_raw IS NOT NULL").select(F.col("_raw").alias("raw")).write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    _wait(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), timeout)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Rows per key and window of event time; rows later than ``late`` behind the newest are dropped, windows come out once they are complete."""
    return (
        stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
        .groupBy(F.window("_at", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
    )


def run_to_table(stream: DataFrame, name: str, timeout: int | None = None) -> DataFrame:
    """Run a stream over what is there and give the rows that it has put out."""
    spark = stream.sparkSession
    target, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _wait(q, timeout)
    return spark.read.schema(stream.schema).parquet(target)
