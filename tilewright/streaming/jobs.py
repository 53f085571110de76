"""Incremental jobs on Structured Streaming.

Every micro-batch writes to a folder named by its batch id and overwrites it, so a batch
replayed after a failure gives the same table. Tables made of batches are read through
``latest``: one row per key, newest batch wins; nothing is rewritten and nothing that
arrives late is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.naming import elapsed_days
from ..operators.catalog import latest_version
from ..operators.timeline import in_sequence
from ..sources.tables import LoggedTable


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that arrived since the last run with this checkpoint, and stop."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(handle)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    return latest_version(spark.read.parquet(path), key, F.col("batch"))


def ingest_tiles(stream: DataFrame, checkpoint: str, path: str, quality: Callable[[DataFrame], DataFrame], version: str) -> None:
    """New tiles with their quality columns, upserted by tile id; of several versions in a batch the greatest stays."""
    run_batches(stream, checkpoint, lambda df, batch: write_batch(latest_version(quality(df), ["tile_id"], F.col(version)), path, batch))


def ingest_into(stream: DataFrame, checkpoint: str, table: LoggedTable, key: list[str], version: str, quality: Callable[[DataFrame], DataFrame],
                most: int = 8, keep: int = 3) -> None:
    """New tiles with their quality columns, appended to a logged table. After each batch, partitions held by more than ``most`` batches are
    rewritten as one, and files are deleted that the last ``keep`` versions of the table don't use: the number of folders stays bounded, and
    a reader of one of those versions is never disturbed. A replayed batch adds rows that ``current`` and the next rewriting drop."""

    def handle(df: DataFrame, batch: int) -> None:
        if df.isEmpty():
            return
        table.append(latest_version(quality(df), key, F.col(version)).withColumn("batch", F.lit(batch)))
        table.compact(key, F.struct(version, "batch"), most)
        table.vacuum(keep)

    run_batches(stream, checkpoint, handle)


def current(table: LoggedTable, key: list[str], version: str) -> DataFrame:
    """One row per key of a table that ``ingest_into`` fills: the greatest version, of equal ones the newest batch."""
    return latest_version(table.read(), key, F.struct(version, "batch"))


def latest_by(spark: SparkSession, path: str, key: list[str], version: str) -> DataFrame:
    """One row per key over all batches: the greatest version, of equal ones the newest batch."""
    return latest_version(spark.read.parquet(path), key, F.struct(version, "batch"))


def compare_with_predecessor(stream: DataFrame, checkpoint: str, pairs_path: str, late_path: str, state_path: str, history_path: str, site: str, when: str,
                             tie: str, indices: list[str]) -> None:
    """Each usable observation against its predecessor at the site, as it arrives.

    A batch writes its rows to the history, and to the state the last usable observation of each site it
    has rows of: other sites' state isn't touched. The state of a site is its newest row of the earlier batches,
    so a replayed batch sees what it saw at first. A row older than its site's state, or
    without a date, goes to the late table, from which pairs are recomputed. Rows of one
    site are ordered in monthly spans, so a busy site is many tasks.
    """
    columns = [site, when, tie, *indices]

    def handle(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = df.select(*columns).persist()  # read for the history, the late rows, the pairs and the state
        write_batch(rows, history_path, batch)
        fresh_rows = rows.where(F.col(when).isNotNull())
        late = rows.where(F.col(when).isNull())
        if batch > 0:
            earlier = spark.read.parquet(state_path).where(F.col("batch") < batch)
            state = latest_version(earlier.join(rows.select(site).distinct(), site, "left_semi"), [site], F.struct(when, tie)).select(*columns)
            tagged = fresh_rows.join(state.select(site, F.struct(when, tie).alias("_last")), site, "left")
            fresh = F.col("_last").isNull() | (F.struct(when, tie) > F.col("_last"))
            late = late.unionByName(tagged.where(~fresh).drop("_last"))
            fresh_rows = state.unionByName(tagged.where(fresh).drop("_last"))
        write_batch(late, late_path, batch)
        ordered = in_sequence(fresh_rows, [site], when, tie, indices)
        found = ordered.where(F.col("next_row").isNotNull()).select(
            site, F.col(tie).alias("before_id"), F.col("next_row")[tie].alias("after_id"),
            elapsed_days(F.col(when), F.col("next_row")[when]).alias("elapsed_days"),
            *[(F.col("next_row")[n] - F.col(n)).alias(f"delta_{n}") for n in indices])
        write_batch(found, pairs_path, batch)
        write_batch(latest_version(fresh_rows.select(*columns), [site], F.struct(when, tie)).select(*columns), state_path, batch)
        rows.unpersist()

    run_batches(stream, checkpoint, handle)


def compact(spark: SparkSession, path: str, key: list[str], version: list[str], upto: int) -> None:
    """Rewrite the batches 0..upto of a table read by its newest version as batch ``upto`` alone."""
    stored = spark.read.parquet(path).where(F.col("batch") <= upto)
    merged = sorted(r["batch"] for r in stored.select("batch").distinct().collect() if r["batch"] < upto)
    newest = latest_version(stored, key, F.struct(*version, "batch")).drop("batch")
    staged = f"{path}-compacted-{upto}"
    newest.write.mode("overwrite").parquet(staged)
    write_batch(spark.read.parquet(staged), path, upto)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for batch in merged:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}"), True)


def settled_pairs(found: DataFrame, late: DataFrame, history: DataFrame, site: str, when: str, tie: str, indices: list[str]) -> DataFrame:
    """Pairs of all sites: as found on arrival, or recomputed where an observation came late."""
    touched = late.select(site).distinct()
    ordered = in_sequence(history.join(touched, site, "left_semi"), [site], when, tie, indices).where(F.col("next_row").isNotNull())
    again = ordered.select(site, F.col(tie).alias("before_id"), F.col("next_row")[tie].alias("after_id"),
                           elapsed_days(F.col(when), F.col("next_row")[when]).alias("elapsed_days"),
                           *[(F.col("next_row")[n] - F.col(n)).alias(f"delta_{n}") for n in indices])
    return found.select(again.columns).join(touched, site, "left_anti").unionByName(again)


def coverage_counts(stream: DataFrame, checkpoint: str, path: str, key: list[str]) -> None:
    """Running tile count per key. Batches carry only the keys that changed."""
    counts = stream.groupBy(*key).agg(F.count(F.lit(1)).alias("tile_count"), F.max("acquisition_date").alias("last_updated"))
    run_batches(counts, checkpoint, lambda df, batch: write_batch(df, path, batch), "update")


def job_states(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Latest status per job; the first failed or done event is final."""
    final = F.col("status").isin("failed", "done")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = F.struct(final, F.when(final, -micros).otherwise(micros))
    states = stream.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.count(F.lit(1)).alias("events"))
    run_batches(states, checkpoint, lambda df, batch: write_batch(df, path, batch), "update")
