"""Places in a global order without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.sources.state import stage

CHUNK = 1 << 16


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a number from 0 by the given order: range partitions are counted, then numbered inside."""
    parts = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__at", inside).join(before, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def prefix_sum(df: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each, by the whole number `at`; chunks are summed first."""
    rows = df.withColumn("__chunk", F.floor(F.col(at) / CHUNK))
    sums = rows.groupBy("__chunk").agg(F.sum(value).alias("__sum"))
    before = sums.select("__chunk", F.coalesce(F.sum("__sum").over(W.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(W.partitionBy("__chunk").orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__in", inside).join(before, "__chunk").withColumn(name, F.col("__before") + F.col("__in")).drop("__chunk", "__in", "__before")


def following(df: DataFrame, at: str, values: list[str], prefix: str = "next_") -> DataFrame:
    """df with the values of the row that follows by the unique number `at`, null after the last."""
    rows = df.withColumn("__chunk", F.floor(F.col(at) / CHUNK)).withColumn("__v", F.struct(*values))
    firsts = rows.groupBy("__chunk").agg(F.min_by("__v", at).alias("__first"))
    after = firsts.select("__chunk", F.lead("__first").over(W.orderBy("__chunk")).alias("__after"))
    inside = F.lead("__v").over(W.partitionBy("__chunk").orderBy(at))
    out = rows.withColumn("__in", inside).join(after, "__chunk").withColumn("__n", F.coalesce("__in", "__after"))
    return out.select(*df.columns, *[F.col(f"__n.{v}").alias(f"{prefix}{v}") for v in values])
