"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; of an empty text for a null doc_id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int) -> tuple[DataFrame, int]:
    """(doc_id, text, label, place), and the number of ids, of at most `bound` labelled ids that aren't held out, by a hash of the id.

    Where an id has several labels the largest counts. Only ids and labels, `bound` at most, pass through
    the driver; place numbers them from 0.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"], i) for i, r in enumerate(rows)], "__id long, label int, place int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id"), len(rows)
