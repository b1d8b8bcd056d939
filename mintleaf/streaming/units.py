"""Review-aspect units over a stream of assertions: mergeable state in a table, late rows set aside, safe to restart.

Each micro-batch is reduced to partial units, one row for each (review, aspect) it touches: which sentiments occurred, the
first row by the order, and a count. Partials of any batches merge to the unit that all their rows together give, in any
order, so state is simply the table of partials; ``read_units`` merges them. A batch writes its own folder, named by its number,
and replaces it if the batch is run again after a failure or a restart: nothing is counted twice or lost.

Rows more than ``late_days`` older than the newest date of earlier batches are late: they change no unit, and are counted
and kept. The limit comes from the written records of earlier batches, so a batch that is run again sets the same rows aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mintleaf.functions.numbers import count_if
from mintleaf.operators.units import META, opinions, resolve
from mintleaf.schemas import SENTIMENTS

_BATCHES = "batch long, n_rows long, n_late long, newest long"


def partial_units(rows: DataFrame, order: list[str]) -> DataFrame:
    """(review_id, aspect, has_Positive ..., key, first, clause_count) of assertions; partials merge by ``merge_units``."""
    flags = [F.bool_or(F.col("sentiment") == s).alias(f"has_{s}") for s in SENTIMENTS]
    key = F.struct(*order)
    return opinions(rows).groupBy("review_id", "aspect").agg(*flags, F.min(key).alias("key"), F.min_by(F.struct(*META, "clause_text"), key).alias("first"), F.count(F.lit(1)).alias("clause_count"))


def merge_units(partials: DataFrame) -> DataFrame:
    """Partial units merged to one row for each (review, aspect), still partial."""
    flags = [F.bool_or(f"has_{s}").alias(f"has_{s}") for s in SENTIMENTS]
    return partials.groupBy("review_id", "aspect").agg(*flags, F.min("key").alias("key"), F.min_by("first", "key").alias("first"), F.sum("clause_count").alias("clause_count"))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder}/{name}") if there else None


def batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, n_rows, n_late, newest): a row for each batch; ``newest``: the newest date up to it, in microseconds since 1970."""
    found = _table(spark, folder, "batches")
    return spark.createDataFrame([], _BATCHES) if found is None else found.select("batch", "n_rows", "n_late", "newest")


def stream_units(assertions: DataFrame, folder: str, checkpoint: str, order: list[str], late_days: int = 7, **trigger) -> StreamingQuery:
    """Starts keeping the units of a stream of assertions in ``folder`` (shared by driver and executors)."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch_log(spark, folder).filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        date = F.unix_micros(F.col("Review_Date").cast("timestamp"))
        late = F.lit(False) if newest is None else F.coalesce(date < newest - late_days * 86_400_000_000, F.lit(False))
        marked = batch.withColumn("_late", late).persist()
        partial_units(marked.filter("not _late").drop("_late"), order).write.mode("overwrite").parquet(f"{folder}/units/batch={number}")
        marked.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        log = marked.agg(F.count(F.lit(1)).alias("n_rows"), count_if(F.col("_late")).alias("n_late"), F.greatest(F.max(date), F.lit(newest).cast("long")).alias("newest"))
        log.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")
        marked.unpersist()

    return assertions.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """The units of all batches so far, with the columns of ``units.review_aspect_units``."""
    merged = merge_units(_table(spark, folder, "units"))
    return merged.select(
        "review_id", "aspect", F.col("first.Restaurant").alias("Restaurant"), resolve({s: F.col(f"has_{s}") for s in SENTIMENTS}).alias("sentiment"),
        *[F.col(f"first.{c}").alias(c) for c in META[1:]], "clause_count", F.col("first.clause_text").alias("sample_clause"),
    )


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The assertions that came too late, with the number of their batch."""
    return _table(spark, folder, "late")
