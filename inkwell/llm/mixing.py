"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source gets a share of all words by its weight; a source's target stops at `cap` times its own
words, and what stands above is shared again by weight until no source is above. With the level T/W
of the sources that are not capped, each round caps those whose cap lies under their part of the
level and sets T and W anew; the level only rises, so the rounds end. All comparisons are in whole
numbers.

A source at rate r = target / words takes every document floor(r) whole times. The fractional rest
goes through the source's documents in the order of a seeded hash and takes each one more time until
the target is met; the last of them is taken in part. The order is by hash bucket first, so that the
running sums of a large source are made in thousands of tasks.

Defined results: a null text has size 0; null sources are one source, last in order; repeated rows
are documents of their own (which of them is the last in part is open, their rows are equal
otherwise; mixed() gives all of them the largest number of repetitions among them); a null doc_id hashes as an empty string; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.llm.common import WORD_CHAR, free_names, materialize, table, text_or_empty

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix"
#: Source as two columns without nulls, so that it can be a join key.
SOURCE = ("src", "src_null")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, text_hash, src, src_null, size, order, bucket), a row per document."""
    text = text_or_empty()
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("src_null"),
        F.regexp_count(text, F.lit(WORD_CHAR + "+")).cast("long").alias("size"), order.alias("order"), F.substring(order, 1, 3).alias("bucket"),
    )


def ranked_sources(rows: DataFrame) -> DataFrame:
    """(src, src_null, source_size, rank): rank from 0 by code point, null last; no global sort in one task."""
    by = [F.col("src_null"), F.col("src")]
    parts = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")).repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "mix-sources")
    # a row for each partition, as many as spark.sql.shuffle.partitions
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*by)) - 1
    return parts.withColumn("place", place).join(offsets, "part").select(*SOURCE, "source_size", (F.col("before") + F.col("place")).alias("rank"))


def water_filled(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources with target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    wide = lambda c: c.cast("decimal(19,0)")
    s = materialize(sources.select("*", wide(weight).alias("w"), wide(F.col("source_size") * cap).alias("most")), "mix-weights")
    all_words, all_weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    words, weight = Decimal(all_words), Decimal(all_weight)
    at = lambda x: F.lit(x).cast("decimal(19,0)")
    while True:
        capped = F.col("most") * at(weight) < F.col("w") * at(words)
        gone, rest = s.agg(F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0))).first()
        now = (Decimal(all_words) - Decimal(gone), Decimal(rest))
        if now == (words, weight):
            break
        words, weight = now
    level = (F.col("w") * at(words)).cast("double") / at(weight or Decimal(1)).cast("double")
    return s.withColumn("target", F.when(capped, F.col("most").cast("double")).otherwise(level)).drop("w", "most", "rank")


def taken(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with source_size, target, whole (repetitions) and extra (words of one more, 0 to size)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    sums = rows.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = sums.withColumn("before", before).drop("words").join(plan, [*SOURCE])
    inside = F.coalesce(F.sum("size").over(W.partitionBy(*SOURCE, "bucket").orderBy("order", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("inside", inside).join(buckets, [*SOURCE, "bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before") - F.col("inside")))
    return out.withColumn("extra", extra).drop("inside", "before", "budget")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, text_hash, src, src_null, size, source_size, target, whole, extra: a row per document."""
    rows = materialize(sized(docs, seed), "mix-sizes")
    return taken(rows, water_filled(ranked_sources(rows), weights, cap))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix: every document as often as it is taken, whole; the one taken in part by the nearer number."""
    reps = F.col("whole") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    plan = mix(docs, weights, cap, seed).select("doc_id", "text_hash", reps.alias("reps"))
    own, hashed, times, copy = free_names(docs, "__id", "__hash", "__reps", "__copy")
    plan = plan.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).agg(F.max("reps").cast("int").alias(times)).filter(F.col(times) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty()) == F.col(hashed))
    return docs.join(plan, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][r % 3 + 1] AS HUGEINT) AS w, 3 * size AS most, sum(size) OVER () AS total FROM s),
c AS (SELECT *, coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
      sum(w) OVER (ORDER BY CAST(most AS DOUBLE) / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
e AS (SELECT *, CAST(most * free < w * (total - filled) AS BOOLEAN) AS capped FROM c),
v AS (SELECT max(total) - coalesce(sum(most) FILTER (WHERE capped), 0) AS words, sum(w) FILTER (WHERE NOT capped) AS weight FROM e),
t AS (SELECT source, size AS source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(w * words AS DOUBLE) / CAST(weight AS DOUBLE) END AS target FROM e, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
j AS (SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(p.source_size AS BIGINT) AS source_size, target, whole,
      CAST(floor(target + 0.5) AS BIGINT) - whole * source_size - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM j
"""
