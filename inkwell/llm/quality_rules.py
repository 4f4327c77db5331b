"""Quality rules: per-document counts and cross-document line frequency, in DataFrame functions only.

Method: every line is normalised (ASCII white space collapsed and stripped, lower case) and hashed
together with its host; the number of distinct documents of that host that hold the line is
counted; lines above the limit are removed; a document that loses too many of its words by that is
rejected. judge() tells which, keep() gives the others with their whole texts, cleaned() without the
lines. The document with the smallest doc_id that holds a line keeps it, so that of a group of copies
one keeps all of its own lines. LineLimits.copies_count=False counts the exact copies of a text as one
document, for those who leave copies to a later stage.

Defined results: a null or empty text has no words and is base_failed; a null host is a host of its
own; a document with no word in any line has nothing removed; repeated rows each get the same row;
rows that share a doc_id count as one document; a null doc_id is an id like any other but never
counts as first; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SPACES, WORD_CHAR, free_names, join_hot, let, materialize, text_or_empty, words


@dataclass(frozen=True)
class LineLimits:
    #: A line in this many different documents of a host, or more, is removed from all but the first.
    min_docs: int = 10
    #: A document that keeps a smaller share of its words is rejected.
    min_kept_share: float = 0.3
    #: Whether exact copies of a text count as documents of their own.
    copies_count: bool = True


def repeated_window_words(w: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in w.

    The windows' 64-bit hashes are sorted together with their places; those that stand next to an equal
    one are repeated. O(n log n) a document.
    """
    zero = F.lit(0).cast("long")

    def count(h: Column) -> Column:
        def marked(pairs: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i + 1) | same(i, i - 1))
            spread = F.transform(found, lambda i: let(F.get(pairs, i)["i"], lambda at: F.array(at, at + 1, at + 2)))
            return F.size(F.array_distinct(F.flatten(spread))).cast("long")

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(pairs, marked))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, let(hashes, count)).otherwise(zero)


def base_counts(text: Column, w: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(w),
    }


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def _line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(F.coalesce(host, F.lit("")), host.isNull(), normalised(line))


def profile(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row per document with its counts and, for each line with a word, its key and its words."""
    text = text_or_empty()
    out = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"), words(text).alias("w"))
    line = lambda x: F.struct(_line_key(F.col("host"), x).alias("key"), F.regexp_count(x, F.lit(WORD_CHAR + "+")).alias("n"))
    lines = F.transform(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD_CHAR)), line)
    return out.select("doc_id", F.xxhash64("text").alias("text_hash"), *[c.alias(k) for k, c in base_counts(F.col("text"), F.col("w")).items()], lines.alias("lines"))


def frequent_lines(lines: DataFrame, limits: LineLimits) -> DataFrame:
    """(key, first, rows): lines above the limit, with the first document that holds each and how many lines it is."""
    one = "doc_id" if limits.copies_count else "text_hash"
    each = lines.groupBy("key", F.col(one).alias("one")).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    counted = each.groupBy("key").agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.sum("rows").alias("rows"))
    return counted.filter(F.col("docs") >= limits.min_docs).select("key", "first", "rows")


def _profiled(docs: DataFrame, host: str, limits: LineLimits) -> tuple[DataFrame, DataFrame]:
    """The documents' counts, and (doc_id, text_hash, key, n) of the lines above the limit that a document isn't the first to hold."""
    rows = materialize(profile(docs, host), "quality-rules")
    lines = rows.select("doc_id", "text_hash", F.explode("lines").alias("l")).select("doc_id", "text_hash", F.col("l.key").alias("key"), F.col("l.n").alias("n"))
    frequent = materialize(frequent_lines(lines, limits), "quality-lines")
    return rows, join_hot(lines, frequent, "key", "rows").filter(~F.col("first").eqNullSafe(F.col("doc_id"))).drop("first")


def _judged(rows: DataFrame, hit: DataFrame, limits: LineLimits) -> DataFrame:
    # repeated rows add up; the sum over all of them is taken relative to their number
    lost = hit.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("lost"))
    times = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")).filter("times > 1")
    lost = lost.join(times, lost["doc_id"].eqNullSafe(times["doc_id"]) & (lost["text_hash"] == times["text_hash"]), "left").select(lost["doc_id"].alias("of"), lost["text_hash"].alias("hash"), (F.col("lost") / F.coalesce("times", F.lit(1))).alias("lost"))
    out = rows.drop("lines").join(lost, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, 1 - F.coalesce("lost", F.lit(0.0)) / F.col("n_words")).otherwise(1.0)
    return out.withColumn("base_failed", failed).withColumn("kept_share", share).withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= limits.min_kept_share)).drop("of", "hash", "lost")


def judge(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """doc_id, text_hash, the counts, kept_share, base_failed and kept, a row per document."""
    return _judged(*_profiled(docs, host, limits), limits)


def keep(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return _joined(docs, judge(docs, host, limits).filter("kept").select("doc_id", "text_hash").distinct())


def _joined(docs: DataFrame, good: DataFrame, *more: str) -> DataFrame:
    """docs that good (doc_id, text_hash, *more) names, with more."""
    own, hashed = free_names(docs, "__id", "__hash")
    good = good.withColumnsRenamed({"doc_id": own, "text_hash": hashed})
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty()) == F.col(hashed))
    return docs.join(good, same).drop(own, hashed) if more else docs.join(good, same, "left_semi")


def cleaned(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that the rules keep, their texts without the lines above the limit; the first document that holds a line keeps it.

    Texts that lose no line stay as they are, n_chars included; lines without a word are never removed.
    """
    rows, hit = _profiled(docs, host, limits)
    good = _judged(rows, hit, limits).filter("kept").select("doc_id", "text_hash").distinct()
    gone, own, hashed = free_names(docs, "__gone", "__id", "__hash")
    keys = hit.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).agg(F.collect_set("key").alias(gone))  # no more than a document's lines
    good = good.join(keys, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col("text_hash") == F.col(hashed)), "left").drop(own, hashed)
    out = _joined(docs, good, gone)
    # not array_contains of a null array: such rows keep their text
    left = F.array_join(F.filter(F.split(text_or_empty(), "\n", -1), lambda x: ~(x.rlike(WORD_CHAR) & F.array_contains(F.col(gone), _line_key(F.col(host), x)))), "\n")
    new = {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col(c)) for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    from inkwell.llm.common import table

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
ww AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x) OVER p || ' ' || lead(x, 2) OVER p AS g FROM ww WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY 1),
ln AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, source, text, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS k,
       len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lw GROUP BY 1),
fr AS (SELECT source, k, min(doc_id) AS first FROM lw GROUP BY 1, 2 HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 10),
lost AS (SELECT lw.doc_id, sum(n) AS lost FROM lw JOIN fr ON lw.source IS NOT DISTINCT FROM fr.source AND lw.k = fr.k AND lw.doc_id <> fr.first GROUP BY 1),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
a AS (SELECT base.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM base LEFT JOIN dl USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (CASE WHEN n_words > 0 THEN 1 - CAST(lost AS DOUBLE) / n_words ELSE 1 END) >= 0.3 AS kept
FROM b
"""
