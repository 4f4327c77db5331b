"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed (XXH64), once each, and the k-grams by a rolling hash of these, the cyclic
polynomial: the next is the last one turned left by a bit, without the word that leaves and with the one
that comes. As all operations are exclusive ors, the hashes of a + b words follow from those of a and b
words, so they are made for all places at once. Of every window of w consecutive hashes the smallest is
chosen, the rightmost of equals; a position is chosen once however many windows choose it. The minimum
over w hashes is made in log2 w steps of two, over positions, so that neither hashes nor positions are
cut. Any run of w + k - 1 words that two texts share leaves at least one equal hash in both, at the
positions kept. A text of fewer than k words has the hash of all its words; one without words has an
empty fingerprint.

Likeness is the Jaccard index of the sets of hashes; two empty fingerprints are alike.

Defined results: a null text is an empty one; documents follow each other by doc_id, null ids last,
repeated ids in the order of their texts' hashes; a single document follows itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.llm.common import let, table, text_or_empty, words

#: RANGES: the least number of ranges that ids are dealt into; as many as shuffle partitions where these are more.
K, WINDOW, RANGES = 5, 16, 1024


def turned(h: Column, bits: int) -> Column:
    """h turned left."""
    bits %= 64
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def rolled(h: Column, k: int) -> Column:
    """Rolling hashes of all k-grams of word hashes h, of which there are k at least."""

    def joined(x: Column, y: Column, a: int, b: int) -> Column:
        """Of a + b words, from x of a words and y of the b that follow."""
        n = F.size(y) - a
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(a + 1), n), lambda p, q: turned(p, b).bitwiseXOR(q))

    if k == 1:
        return h
    half = let(rolled(h, k // 2), lambda x: joined(x, x, k // 2, k // 2))
    return half if k % 2 == 0 else let(half, lambda x: joined(x, h, k - 1, 1))


def kgram_hashes(w: Column, k: int = K) -> Column:
    def of(h: Column) -> Column:
        all_of_it = F.aggregate(h, F.lit(0).cast("long"), lambda x, y: turned(x, 1).bitwiseXOR(y))
        short = F.when(F.size(h) > 0, F.array(all_of_it)).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= k, rolled(h, k)).otherwise(short)

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def chosen(hashes: Column, window: int = WINDOW) -> Column:
    """STRUCT<hashes, positions> of each position that some window chooses, in order. window: a power of two."""

    def of(h: Column) -> Column:
        def least(p: Column, q: Column) -> Column:  # q is the right one
            return F.when(F.get(h, q) <= F.get(h, p), q).otherwise(p)

        def halve(step: int):
            def of(at: Column) -> Column:
                n = F.size(at)
                tail = F.zip_with(F.slice(at, F.lit(1), n - step), F.slice(at, F.lit(step + 1), n - step), least)
                return F.when(n > step, tail).otherwise(F.when(n > 0, F.array(F.aggregate(at, F.get(at, F.lit(0)), least))).otherwise(at))

            return of

        out, step = F.filter(F.sequence(F.lit(-1), F.size(h) - 1), lambda i: i >= 0), 1
        while step < window:
            out, step = let(out, halve(step)), 2 * step
        return let(F.array_distinct(out), lambda at: F.struct(F.transform(at, lambda i: F.get(h, i)).alias("hashes"), at.alias("positions")))

    return let(hashes, of)


def fingerprint(hashes: Column) -> Column:
    """The chosen hashes in order, 16 hex digits each."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def winnowed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    return let(words(text), lambda w: chosen(kgram_hashes(w, k), window))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def range_borders(docs: DataFrame, ranges: int = RANGES) -> list[int]:
    """Up to `ranges` ids, the smallest among them, that part the ids about evenly.

    Quantiles of up to 64 groups of input partitions, each of `ranges` ids, are merged here; they only
    place rows and don't touch the result.
    """
    sketch = F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 4 * ranges)
    found = docs.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("g")).agg(sketch.alias("q"), F.min("doc_id").alias("least")).collect()
    every = sorted(x for row in found for x in row["q"] or [])
    least = {row["least"] for row in found} - {None}
    return sorted({*every[:: max(1, len(found))], *([min(least)] if least else [])})


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW, ranges: int = RANGES) -> DataFrame:
    """(doc_id, text, own, next): own has what winnowed() gives; next the text of the document that follows by doc_id, and its hashes.

    The ids are dealt into ranges whose borders are ids themselves; the row at each border also goes
    to the range before it, to be the last one's next.
    """
    ranges = max(ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    borders = range_borders(docs, ranges)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    own = winnowed(F.col("text"), k, window)
    order = [F.col("after"), F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    # two values, as a struct of both would be sorted next to the text
    following = lambda f: F.struct(f(F.col("text")).alias("text"), f(F.col("own.hashes")).alias("hashes"))
    if not borders:
        rows = rows.withColumn("after", F.lit(False)).withColumn("own", own)
        one = W.partitionBy(F.lit(0)).orderBy(*order)
        return rows.select("doc_id", "text", "own", following(lambda c: F.coalesce(F.lead(c).over(one), F.first(c).over(one))).alias("next"))
    return _dealt(rows, borders, own, order, following)


def _dealt(rows: DataFrame, borders: list[int], own: Column, order: list[Column], following: Callable[[Callable[[Column], Column]], Column]) -> DataFrame:
    steps = max(1, (len(borders) - 1).bit_length())
    known = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")
    find = lambda known: F.aggregate(  # noqa: E731  the last border that is not above doc_id, by halving
        F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), F.lit(0),
        lambda at, s: F.when(F.get(known, at + F.call_function("shiftleft", F.lit(1), s)) <= F.col("doc_id"), at + F.call_function("shiftleft", F.lit(1), s)).otherwise(at),
    )
    last = len(borders) - 1
    at = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(find(known))
    placed = rows.withColumn("at", at)
    edge = F.coalesce(F.get(known, F.col("at")) == F.col("doc_id"), F.lit(False))
    here = F.struct(F.col("at").alias("range"), F.lit(False).alias("after"))
    before = F.struct(F.when(F.col("at") == 0, F.lit(last)).otherwise(F.col("at") - 1).alias("range"), F.lit(True).alias("after"))
    both = placed.select("doc_id", "text", F.explode(F.when(edge, F.array(here, before)).otherwise(F.array(here))).alias("p")).select("doc_id", "text", "p.range", "p.after")
    both = both.repartition("range").withColumn("own", own)  # only texts are shuffled
    one = W.partitionBy("range").orderBy(*order)
    return both.withColumn("next", following(lambda c: F.lead(c).over(one))).filter("NOT after").select("doc_id", "text", "own", "next")


def edited_text() -> Column:
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substr(F.col("text"), F.lit(1), F.length("text") - half), F.substr(F.coalesce("next.text", F.lit("")), F.lit(1), half))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text, edited (text), chosen and edited_chosen (STRUCT<hashes, positions>) and next_hashes."""
    rows = with_next(docs, k, window).withColumn("edited", edited_text())
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", "text", "edited", F.col("own").alias("chosen"), winnowed(F.col("edited"), k, window).alias("edited_chosen"), F.coalesce("next.hashes", none).alias("next_hashes"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents"))
    sets = [F.array_distinct(c).alias(n) for c, n in ((F.col("chosen.hashes"), "c"), (F.col("edited_chosen.hashes"), "e"), (F.col("next_hashes"), "n"))]
    near = let(F.struct(*sets), lambda s: F.struct(likeness(s["c"], s["e"]).alias("near_edited"), likeness(s["c"], s["n"]).alias("near_next")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("chosen.hashes")).alias("fingerprint"), fingerprint(F.col("edited_chosen.hashes")).alias("edited_fingerprint"),
        near.alias("near"), F.col("chosen.positions").alias("positions"),
    ).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near.near_edited", "near.near_next", "positions")
