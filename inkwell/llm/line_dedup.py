"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (key, docs), sorted by key and kept in the shared folder. Each new batch of
documents is reduced to its keys with the number of documents that hold them, merge-anti-joined
with the runs of keys already known to be frequent, and written as a run of level 0. When a level has
`fanout` runs they are merged into one of the next level, where keys that reach the limit move to the
frequent runs, which are compacted like the others. So a batch costs its own size, and every key is
rewritten once a level. Keys that are not frequent yet have to be counted on, so only unseen(), for those
who keep the first of equal lines, anti-joins all runs.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased, as
XXH64 (seed 42): two lines whose 64-bit hashes clash count as one. Lines without a key are kept.

Defined results: null and empty texts have one empty line; rows that share a doc_id count as one
document and get a row each; a null doc_id is an id like any other; an empty table gives an empty
result; extra columns pass through drop_lines and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import free_names, join_hot, materialize, table, text_or_empty

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, text_hash, keys): a hash a line, null where the line has no key."""
    for batch in batches:
        hashes, values, blank, ends = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            hashes.append(xxhash.xxh64_intdigest(raw, 42))
            keys = [line_key(x) for x in raw.split(b"\n")]
            values += [xxhash.xxh64_intdigest(k, 42) for k in keys]
            blank += [not k for k in keys]
            ends.append(len(values))
        signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(values), mask=np.array(blank, dtype=bool)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(hashes)), keys], ["doc_id", "text_hash", "keys"])


def keyed(docs: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "text").mapInArrow(_keyed, schema)


class LineRuns:
    """Runs of (key, docs), by level, and the run of keys found in min_docs documents or more."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.known: list[DataFrame] = []

    @staticmethod
    def _sorted(run: DataFrame, label: str) -> DataFrame:
        return materialize(run.repartitionByRange("key").sortWithinPartitions("key"), f"line-{label}")

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys whose key no run holds yet, frequent or not."""
        for run in [*self.known, *(r for level in self.levels for r in level)]:
            keys = keys.join(run.select("key").hint("merge"), "key", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """keys: a row (key) for each document that holds the key; a document's keys are all in one batch."""
        counts = keys.groupBy("key").agg(F.count("*").alias("docs"))
        for run in self.known:
            # an outer join and a filter: Spark moves an anti-join below the counting, where frequent keys have a row a document
            counts = counts.join(run.select("key", F.lit(True).alias("seen")).hint("merge"), "key", "left").filter("seen IS NULL").drop("seen")
        self._put(0, self._sorted(counts, "run-0"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level], f"merged-{level + 1}")
            self.levels[level] = []
            self.known.append(self._sorted(merged.filter(F.col("docs") >= self.min_docs), "known"))
            if len(self.known) > self.fanout:
                self.known = [self._sorted(self._union(self.known), "known-merged")]
            self._put(level + 1, merged.filter(F.col("docs") < self.min_docs))

    def _merge(self, runs: list[DataFrame], label: str) -> DataFrame:
        return self._sorted(self._union(runs).groupBy("key").agg(F.sum("docs").alias("docs")), label)

    def frequent(self) -> DataFrame:
        """(key, docs): keys found in min_docs documents or more, over all levels; docs as far as it was counted."""
        rest = [run for level in self.levels for run in level]
        found = [self._union(rest).groupBy("key").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= self.min_docs)] if rest else []
        return self._union([*self.known, *found]).groupBy("key").agg(F.sum("docs").alias("docs"))


def dropped_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, text_hash, dropped): positions of the lines that go, for documents that lose any."""
    rows = materialize(keyed(docs), "line-keys")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for i in range(batches):
        batch = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
        # rows that share a doc_id are one document
        held = batch.select("doc_id", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")).distinct()
        runs.add(held.select("key"))
    frequent = materialize(runs.frequent(), "line-frequent")
    lines = rows.select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "key")).filter("key IS NOT NULL")
    return join_hot(lines, frequent, "key", "docs").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def with_kept_text(docs: DataFrame, min_docs: int = 10, batches: int = 4) -> tuple[DataFrame, list[str]]:
    """docs with the number of lines, of dropped ones, and the text without those, under the three names returned."""
    own, hashed, dropped, split, n_lines, n_dropped, left = free_names(docs, "__id", "__hash", "__gone", "__lines", "n_lines", "n_dropped", "kept")
    gone = dropped_lines(docs, min_docs, batches).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed), F.col("dropped").alias(dropped))
    text = text_or_empty()
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(hashed))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))
    joined = F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n")
    out = docs.join(gone, same, "left").withColumn(split, F.split(text, "\n", -1))
    out = out.select(
        *[F.col(c) for c in docs.columns], F.size(split).cast("long").alias(n_lines), F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(dropped).isNull(), text).otherwise(joined).alias(left),
    )
    return out, [n_lines, n_dropped, left]


def drop_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4) -> DataFrame:
    """The documents, all of them, without the lines found in min_docs documents or more."""
    out, (_, n_dropped, left) = with_kept_text(docs, min_docs, batches)
    new = {"text": F.when(F.col(n_dropped) > 0, F.col(left)).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(n_dropped) > 0, F.length(left)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col(c)) for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, (n_lines, n_dropped, left) = with_kept_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", n_lines, n_dropped, F.sha2(left, 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 10),
m AS (SELECT k.*, f.k IS NOT NULL AS gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
