"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def free_names(df: DataFrame | list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes not to clash with a column of df, or with a name of the list."""
    taken, out = {c.lower() for c in (df if isinstance(df, list) else df.columns)}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def join_hot(rows: DataFrame, small: DataFrame, key: str, weight: str, share: int = 4096) -> DataFrame:
    """rows inner-joined with small (a row per key) on key; weight: about how many rows a key of small has.

    Keys that hold a `share`th of the weight or more, which are `share` at most, are joined by broadcast and
    don't meet in a task; the others are left to Spark, none of them with a larger part of the rows.
    weight is dropped.
    """
    (hot,) = free_names([*rows.columns, *small.columns], "__hot")
    total = small.agg(F.coalesce(F.sum(weight), F.lit(0))).scalar()
    marked = small.withColumn(hot, F.col(weight) * share >= total).drop(weight)
    heavy = F.broadcast(marked.filter(hot))  # `share` rows at most, as their weights add up to no more than the total
    left = rows.join(heavy, key, "left")
    met = left.filter(F.col(hot)).drop(hot)
    rest = left.filter(F.col(hot).isNull()).select(*rows.columns).join(marked.filter(~F.col(hot)).drop(hot), key)
    return met.unionByName(rest)
