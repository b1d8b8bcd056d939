"""Readers and writers of review layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mintleaf.schemas import RAW_REVIEW


def read_reviews_csv(spark: SparkSession, path: str, schema: StructType = RAW_REVIEW) -> DataFrame:
    """Headered CSV with quoted texts over several lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_verbatim_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Headered CSV of strings as they are: 'NA' stays text and an empty field is ''."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def intake(new: DataFrame, path: str, key: str, batch: str, by: list[str] | None = None) -> None:
    """Adds the rows of ``new`` whose key no other batch of the table has, as the partition ``batch`` of that name.

    The batch's partition is replaced as a whole, so an intake that is run again, after a failure or by mistake, leaves the
    table as one run does. The table's other batches aren't touched, and of them only the keys are read. Rows of one batch
    with the same key are all taken. ``by``: columns by which the batch is partitioned below.
    """
    spark = new.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.option("basePath", path).schema(StructType([*new.schema.fields, StructField("batch", StringType())])).parquet(path)
        new = new.join(known.filter(F.col("batch") != batch).select(key).distinct(), key, "left_anti").select(*new.columns)
    write_parquet(new, f"{path}/batch={batch}", by)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with explicit nulls; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nested_json(df: DataFrame, key: str) -> DataFrame:
    """(key, document): the rows of a key, in the order of their columns, as one JSON array."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("document"))


def json_labels(text: Column, default: list[str] | None = None) -> Column:
    """The array of strings in a JSON text; the default if it is null, malformed or empty."""
    found = F.from_json(text, "array<string>")
    other = F.array(*[F.lit(x) for x in default]) if default else F.array().cast("array<string>")
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(other)


def consolidate(annotated: DataFrame, inferred: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables with the given columns; what one lacks is null, and a missing confidence is 1."""
    both = annotated.unionByName(inferred, allowMissingColumns=True)
    have = [F.col(c) if c in both.columns else F.lit(None).cast("string").alias(c) for c in columns]
    out = both.select(*have)
    return out.withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(1.0))) if "confidence" in columns else out


def verification_template(assertions: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, and blank ones for a reviewer; the status is pending."""
    return assertions.select(*columns, *[F.lit("").alias(c) for c in ("reviewer", "verified_aspect", "verified_sentiment", "comment")], F.lit("pending").alias("verification_status"))
