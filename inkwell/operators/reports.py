"""Summaries of elements and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.schema import RANGE


def element_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("type").agg(F.count("*").alias("n"))


def diagnostic_summary(diagnostics: DataFrame, order: list[str], samples: int = 5) -> DataFrame:
    """By code, or message where there is none: how many, and samples in order, as lines from 1; the first place leads them.

    A group is cut to its first few in salted parts, before anything is gathered.
    """
    rows = diagnostics.withColumn("key", F.coalesce("code", "message"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    row = F.struct(*order, "message", "code", "file_path", (F.col("start_line") + 1).alias("line"))
    part = F.pmod(F.xxhash64("file_path"), F.lit(64))
    first = rows.select("key", part.alias("part"), row.alias("row"))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("key", "part").orderBy("row"))).filter(F.col("rank") <= samples)
    chosen = first.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("row")), 1, samples).alias("samples"))  # 64 * samples rows a key at most
    return counts.join(chosen, "key")


def by_file(diagnostics: DataFrame, order: list[str]) -> DataFrame:
    """All diagnostics of a file as one row, in order: what publishing sets for the file."""
    row = F.struct(*order, *[c for c in (*RANGE, "message", "severity", "source", "code") if c not in order])
    return diagnostics.groupBy("file_path").agg(F.array_sort(F.collect_list(row)).alias("diagnostics"))


def suspicious(elements: DataFrame, shortest: int = 5) -> DataFrame:
    """Sentences that are blank, very short, or hold a backslash or brace."""
    from inkwell.functions.text import js_trim, utf16_length

    c = F.col("content")
    return elements.filter((F.col("type") == "sentence") & ((js_trim(c) == "") | c.rlike(r"[\\{}]") | (utf16_length(c) < shortest)))


def top_suspicious(elements: DataFrame, n: int = 20) -> DataFrame:
    return suspicious(elements).orderBy("file_ord", "seq").limit(n)

