"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: XXH64 (seed 42) of every 3-word shingle of the lower-cased (A-Z) text; a bit is set if
over half of the shingles have it. Documents are grouped by fingerprint first; all that follows is on
different fingerprints, so copies cost nothing.

Links at Hamming distance 2 or less: the 64 bits are dealt into three partitions that keep correlated
bits together. If the thresholds of the partitions add up to 2 - 3 + 1 = 0, any fingerprint at
distance 2 or less agrees with the probing one within the threshold of some partition, whatever
thresholds each probing fingerprint chooses; -1 leaves a partition out. Each fingerprint chooses its
own by dynamic programming over the partitions, at the least sum of probes and estimated candidates.
The estimates come from histograms of half partitions over all fingerprints (at most 2^11 bins each)
and, for values that many fingerprints share, from their exact counts. Candidates are verified on all
64 bits.

A fingerprint whose cheapest choice still has over DENSE candidates lies in a dense ball. Such
fingerprints are linked without pairs: each goes to its 64 neighbours at distance 1 and to itself, and
those that meet there are within 2 of each other (and any two within 2 meet). At most 65 meet at one
place. A link between a dense and another fingerprint is found by the other's probes.

Components: alternating large-star and small-star rounds over the links, each written to the shared
folder; nothing is collected but counts.

Defined results: null and empty texts have fingerprint 0 and link like others; repeated rows get equal
rows; a component with no doc_id at all has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import free_names, join_hot, materialize, table, text_or_empty

LIMIT, PARTS, DENSE, PIECE = 2, 3, 2048, 200_000
LONG = T.LongType()


def fingerprint(text: str | None, size: int = 3) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < size else (b" ".join(x) for x in zip(*(w[i:] for i in range(size))))
    total, ones, piece = 0, np.zeros(64, dtype=np.int64), []

    def count() -> None:
        nonlocal total
        bits = np.unpackbits(np.array(piece, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(0, dtype=np.int64)
        total += len(piece)
        piece.clear()

    for s in shingles:
        piece.append(xxhash.xxh64_intdigest(s, 42))
        if len(piece) >= PIECE:
            count()
    if piece:
        count()
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), a row per document."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", LONG)]))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits i and j are both set, for all i <= j, and at i = 64 the number of rows."""
    both, rows = np.zeros((64, 64)), 0
    for batch in batches:
        x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        for at in range(0, len(x), 1 << 16):
            both += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
        rows += len(x)
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64)), pa.array(np.append(j, 64)), pa.array(np.append(both[i, j], rows).astype(np.int64))], ["i", "j", "n"])


def correlated_parts(both: np.ndarray, rows: int, parts: int = PARTS) -> list[list[int]]:
    """The 64 bits in `parts` partitions: each takes the free bit that correlates most with its own."""
    p = np.diag(both) / max(1, rows)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    close = np.abs(both / max(1, rows) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = list(range(64)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        rest = close[np.ix_(free, free)] - np.eye(len(free))
        own = [free.pop(int(np.argmax(rest.max(0))))]
        while len(own) < size:
            own.append(free.pop(int(np.argmax(close[np.ix_(own, free)].sum(0)))))
        out.append(sorted(own))
    return out


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, as one number."""
    out = np.zeros(len(fps), dtype=np.int64)
    for at, bit in enumerate(bits):
        out |= ((fps.view(np.uint64) >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return out


def key_of(part: int, value: np.ndarray) -> np.ndarray:
    return (np.int64(part) << np.int64(40)) | value


class Index:
    """The partitions and, for each half of one, the share of fingerprints at distance 0, 1, 2 of each value."""

    def __init__(self, parts: list[list[int]], near: list[list[np.ndarray]], rows: int):
        self.parts, self.near, self.rows = parts, near, rows

    @staticmethod
    def halves(bits: list[int]) -> list[list[int]]:
        return [bits[: len(bits) // 2], bits[len(bits) // 2 :]]

    @staticmethod
    def spread(counts: np.ndarray, width: int, rows: int) -> np.ndarray:
        """(3, 2^width): shares of rows at distance 0, 1 and 2 of each value."""
        at = np.arange(1 << width)
        one = sum((counts[at ^ (1 << i)] for i in range(width)), np.zeros(1 << width))
        two = sum((counts[at ^ (1 << i) ^ (1 << j)] for i, j in combinations(range(width), 2)), np.zeros(1 << width))
        return np.stack([counts, one, two]) / max(1, rows)

    def expected(self, fps: np.ndarray, part: int) -> np.ndarray:
        """(4, rows): estimated fingerprints within -1, 0, 1, 2 of each in a partition."""
        a, b = (near[:, project(fps, bits)] for near, bits in zip(self.near[part], self.halves(self.parts[part]), strict=True))
        at = [a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[0] * b[2] + a[1] * b[1] + a[2] * b[0]]
        return np.concatenate([np.zeros((1, len(fps))), np.cumsum(at, axis=0) * self.rows])

    def choose(self, fps: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) thresholds from -1 to 2 and the candidates expected. shared: exact counts, 0 if unknown."""
        m, n = len(self.parts), len(fps)
        target, low = LIMIT - m + 1, -m  # sums of thresholds run from -m
        width = target - low + LIMIT + 2
        cost, found = np.full((width, n), np.inf), np.zeros((width, n))
        cost[m + low] = 0
        back = np.zeros((m, width, n), dtype=np.int8)
        for k in range(m):
            seen = self.expected(fps, k)
            seen[1:] = np.maximum(seen[1:], shared[:, k])
            bits = len(self.parts[k])
            probes = np.array([0, 1, 1 + bits, 1 + bits + bits * (bits - 1) // 2])[:, None]
            new, new_found = np.full((width, n), np.inf), np.zeros((width, n))
            for s in range(width):
                for t in range(4):  # threshold t - 1; sums are kept as thresholds + 1
                    if s - t < 0:
                        continue
                    c = cost[s - t] + probes[t] + seen[t]
                    better = c < new[s]
                    new[s][better], back[k, s][better], new_found[s][better] = c[better], t, (found[s - t] + seen[t])[better]
            cost, found = new, new_found
        at = np.full(n, target + m)
        out = np.zeros((n, m), dtype=np.int8)
        for k in reversed(range(m)):
            t = back[k, at, np.arange(n)]
            out[:, k] = t - 1
            at = at - t
        return out, found[target + m]

    def masks(self, part: int, threshold: int) -> np.ndarray:
        """What to flip in a partition's value to reach all values within the threshold."""
        bits = len(self.parts[part])
        return np.array([sum(1 << i for i in c) for k in range(threshold + 1) for c in combinations(range(bits), k)], dtype=np.int64)


def _keys(index: Index):
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.concatenate([key_of(k, project(fps, bits)) for k, bits in enumerate(index.parts)])
            part = np.repeat(np.arange(len(index.parts), dtype=np.int32), len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(fps, len(index.parts))), pa.array(keys), pa.array(part)], ["fp", "key", "part"])

    return of


def _probes(index: Index, dense: int):
    """(fp, shared) to (kind, key, fp): kind 0 probes a partition, kind 1 is a place in a dense ball."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            counts = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(index.parts))], axis=1)
            for at in range(0, len(whole), 4096):
                fps = whole[at : at + 4096]
                chosen, found = index.choose(fps, counts[at : at + 4096])
                thick = found > dense
                keys, owners, kinds = [], [], []
                for k, bits in enumerate(index.parts):
                    for t in range(LIMIT + 1):
                        own = fps[(chosen[:, k] == t) & ~thick]
                        if len(own):
                            masks = index.masks(k, t)
                            keys.append(key_of(k, project(own, bits)[:, None] ^ masks[None, :]).ravel())
                            owners.append(np.repeat(own, len(masks)))
                            kinds.append(np.zeros(len(keys[-1]), dtype=np.int32))
                if thick.any():
                    flips = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
                    keys.append((fps[thick].view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64).ravel())
                    owners.append(np.repeat(fps[thick], 65))
                    kinds.append(np.ones(len(keys[-1]), dtype=np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, keys, owners)], ["kind", "key", "fp"])

    return of


def build_index(fps: DataFrame, parts: int = PARTS) -> Index:
    """Bit counts (2,081 rows) and half-partition histograms (2^11 bins each) come to the driver, no more."""
    pairs = fps.select("fp").mapInArrow(_bit_counts, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, rows = np.zeros((64, 64)), 0
    for i, j, n in pairs:
        if i == 64:
            rows = n
        else:
            both[i, j] = both[j, i] = n
    split = correlated_parts(both, rows, parts)
    blocks = [half for bits in split for half in Index.halves(bits)]

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << len(b), dtype=np.int64) for b in blocks]
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for total, bits in zip(totals, blocks, strict=True):
                total += np.bincount(project(fp, bits), minlength=len(total))
        at = np.concatenate([np.full(len(t), k) for k, t in enumerate(totals)])
        value, n = np.concatenate([np.arange(len(t)) for t in totals]), np.concatenate(totals)
        yield pa.RecordBatch.from_arrays([pa.array(x[n > 0]) for x in (at, value, n)], ["block", "value", "n"])

    counts = [np.zeros(1 << len(b)) for b in blocks]
    for block, value, n in fps.select("fp").mapInArrow(values, "block long, value long, n long").groupBy("block", "value").agg(F.sum("n").alias("n")).collect():
        counts[block][value] = n
    near = [[Index.spread(counts[2 * k + h], len(blocks[2 * k + h]), rows) for h in (0, 1)] for k in range(parts)]
    return Index(split, near, rows)


def links(fps: DataFrame, parts: int = PARTS, dense: int = DENSE, shared_from: int = 64) -> DataFrame:
    """(a, b): links between different fingerprints of fps (fp), enough to join every component."""
    index = build_index(fps, parts)
    keys = materialize(fps.select("fp").mapInArrow(_keys(index), "fp long, key long, part int"), "simhash-keys")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("rows")).filter(F.col("n") >= shared_from), "simhash-shared")
    per_fp = join_hot(keys, shared, "key", "rows").groupBy("fp").agg(*[F.max(F.when(F.col("part") == k, F.col("n"))).alias(f"n{k}") for k in range(parts)])
    known = fps.select("fp").join(per_fp, "fp", "left").select("fp", *[F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}") for k in range(parts)])
    probes = materialize(known.mapInArrow(_probes(index, dense), "kind int, key long, fp long"), "simhash-probes")
    met = probes.filter("kind = 0").select("key", F.col("fp").alias("a")).join(keys.select("key", F.col("fp").alias("b")), "key")
    near = met.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT)).select("a", "b")
    at = probes.filter("kind = 1")
    ball = at.join(at.groupBy("key").agg(F.min("fp").alias("b")), "key").filter("fp != b").select(F.col("fp").alias("a"), "b")
    both = near.unionByName(ball)
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b), a > b, with the smallest it can reach."""
    edges = materialize(edges, "simhash-links")
    sums = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
    state = tuple(edges.agg(*sums).first())
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, "a", "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = materialize(large, "simhash-large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = turned.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = materialize(small, "simhash-small-star")
        now = tuple(edges.agg(*sums).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), a row per document."""
    rows = materialize(fingerprints(docs), "simhash")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    nodes = materialize(components(links(fps)), "simhash-components")
    joined = nodes.join(fps, nodes["node"] == fps["fp"]).select("fp", "root", "least")
    roots = materialize(joined.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("nodes")), "simhash-roots")
    linked = join_hot(joined, roots, "root", "nodes").select(F.col("fp").alias("of"), "component")
    each = fps.join(linked, F.col("fp") == F.col("of"), "left").select("fp", F.coalesce("component", "least").alias("component_id"), "rows")
    return join_hot(rows, materialize(each, "simhash-groups"), "fp", "rows").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """A document of each component: that with the smallest doc_id, a null last, of the smallest text hash; repeated rows of it once.

    A component is known by its root fingerprint, a document by its doc_id and text hash, so that documents
    with null or repeated ids in different components all stay.
    """
    own, hashed, group = free_names(docs, "__id", "__hash", "__root")
    keyed = docs.select(F.struct("doc_id", F.xxhash64(text_or_empty()).alias("text_hash")).alias("doc_id"), "text")
    rows = fingerprints(keyed).select("fp", F.struct(F.col("doc_id.doc_id").isNull().alias("none"), F.col("doc_id.doc_id").alias("id"), F.col("doc_id.text_hash").alias("hash")).alias("doc"))
    fps = materialize(rows.groupBy("fp").agg(F.min("doc").alias("doc")), "simhash-distinct")
    nodes = materialize(components(links(fps)), "simhash-components")
    rooted = fps.join(nodes, fps["fp"] == nodes["node"], "left").select(F.coalesce("root", "fp").alias("root"), "doc")
    first = rooted.groupBy("root").agg(F.min("doc").alias("doc")).select(F.col("root").alias(group), F.col("doc.id").alias(own), F.col("doc.hash").alias(hashed))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty()) == F.col(hashed))
    return docs.join(first, same).dropDuplicates([group]).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
