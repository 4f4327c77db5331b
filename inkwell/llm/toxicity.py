"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are all lower-cased runs of letters and digits of the labelled examples; none is left out.
Examples and texts are vectors of (1 + log count) * idf * pull over these terms, scaled to length 1,
where pull is the root of the chi-square with label 1 of a term that leans to it, and `least` of any
other and at least, so that no term weighs nothing. All labelled examples are in the index.

The index holds the examples in blocks of `block` neighbours. A term that few examples hold has a list of
its blocks with the largest weight in each, and behind every block the block's postings; the terms that
over a share `dense` of the examples hold are rows of a matrix instead, as their lists would be as long.
A batch of texts is multiplied with the matrix first, which gives each example a lower bound of its
similarity. A block is left out if its best lower bound and all that its largest weights can add don't
reach the text's k-th best lower bound; the postings of the other blocks are added up. So the k nearest
are exact (ties, to nine places: the example that comes first).

The vote is the similarity-weighted share of toxic neighbours, with a fixed weight of doubt for
far ones; isotonic regression on a quarter of the sample, which is in neither terms nor examples, makes
it a probability. The neighbours that vote are the evidence.

Bounds: at most `bound` labelled ids (a documented parameter), with all words of their texts. One task
makes the index of them and writes it to the shared folder, from where every executor gets it; all
documents are scored on their whole texts, which are cut into words about CHUNK characters at a time.

Defined results: null and empty texts, and those without a word of any example, get the score of texts
without a term; repeated rows get equal rows and count as one example, different texts of an id as
several; without labels every score is 0; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import materialize, table
from inkwell.llm.labels import labelled, remainder

BOUND, LEAST, K, DOUBT, THRESHOLD = 8_192, 0.1, 15, 1.0, 0.5
BLOCK, DENSE, CHUNK, GROUP, PIECE = 64, 1 / 8, 1 << 22, 1 << 21, 1 << 22
BORDER = regex.compile(r"[^\p{L}\p{N}]")


# --- words -------------------------------------------------------------------------------------


def _chunks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, parts of texts) of about CHUNK characters together; a text is cut between words only."""
    numbers: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            cut = BORDER.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            part = text[at : cut.start()] if cut else text[at:] if at else text
            numbers.append(i)
            parts.append(part)
            at, size = at + len(part), size + len(part)
            if size >= CHUNK:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def words(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(numbers of texts, words), a row per word, in chunks."""
    for numbers, parts in _chunks(texts):
        split = pc.split_pattern_regex(pc.utf8_lower(pa.array(parts, pa.string())), r"[^\pL\pN]+")
        found = split.flatten()
        owner = np.repeat(np.array(numbers), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        real = pc.greater(pc.binary_length(found), 0)
        yield owner[real.to_numpy(zero_copy_only=False)], found.filter(real)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, rising, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.append(0, np.nonzero(keys[1:] != keys[:-1])[0] + 1)
    return keys[first], np.add.reduceat(counts[order], first)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


# --- the index ---------------------------------------------------------------------------------


class Vectors:
    """Rows of (term, weight), the terms rising in each; counted(keys, counts): key = row * terms + term."""

    def __init__(self, start: np.ndarray, at: np.ndarray, weight: np.ndarray):
        self.start, self.at, self.weight = start, at, weight

    def __len__(self) -> int:
        return len(self.start) - 1

    @classmethod
    def counted(cls, rows: int, keys: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Vectors:
        row, at = np.divmod(keys, max(1, len(idf)))
        weight = (1 + np.log(counts)) * idf[at]
        length = np.sqrt(np.bincount(row, weight * weight, rows))
        return cls(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), at, weight / length[row])


class Index:
    """Labelled examples by term. terms: their words; labels, ids: of the examples."""

    def __init__(self, terms: pa.Array, idf: np.ndarray, examples: Vectors, labels: np.ndarray, ids: np.ndarray, block: int = BLOCK, dense: float = DENSE):
        self.terms, self.idf, self.labels, self.ids, self.block = terms, idf, labels, ids, block
        n = len(examples)
        self.blocks = max(1, -(-n // block))
        row = np.repeat(np.arange(n), np.diff(examples.start))
        self.held = np.bincount(examples.at, minlength=len(idf)).astype(np.int32)
        often = np.nonzero(self.held > max(dense * n, 1))[0]
        self.place = np.full(len(idf), -1, np.int32)
        self.place[often] = np.arange(len(often))
        own = self.place[examples.at]
        self.matrix = np.zeros((len(often), self.blocks * block))
        self.matrix[own[own >= 0], row[own >= 0]] = examples.weight[own >= 0]
        at, row, weight = examples.at[own < 0], row[own < 0], examples.weight[own < 0]
        order = np.lexsort((row, at))
        at, row, weight = at[order], row[order], weight[order]
        entry = at * self.blocks + row // block
        first = np.append(0, np.nonzero(entry[1:] != entry[:-1])[0] + 1) if len(entry) else np.zeros(0, np.int64)
        self.example, self.posting = row.astype(np.int32), weight
        self.entry_block = (entry[first] % self.blocks).astype(np.int32)
        self.entry_most = np.maximum.reduceat(weight, first) if len(first) else weight
        self.entry_start = np.append(first, len(entry))
        self.term_start = np.searchsorted(entry[first] // self.blocks, np.arange(len(idf) + 1))

    def queries(self, texts: Iterable[str | None], rows: int) -> Vectors:
        """Of texts, as many as rows: words that no example has are left out."""
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for owner, found in words(texts):
            number = pc.index_in(found, value_set=self.terms)
            known = number.is_valid().to_numpy(zero_copy_only=False)
            key, n = np.unique(owner[known] * len(self.idf) + number.drop_null().to_numpy(), return_counts=True)
            keys.append(key)
            counts.append(n)
        return Vectors.counted(rows, *summed(np.concatenate(keys), np.concatenate(counts)), self.idf)

    def nearest(self, queries: Vectors, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(rows, k): the examples of highest similarity above 0, best first, and their similarities; -1 and 0 where there are fewer."""
        near, sims = np.full((len(queries), k), -1), np.zeros((len(queries), k))
        work = self.blocks * self.block + np.append(0, np.cumsum(self.held[queries.at]))[queries.start]
        at = 0
        while at < len(queries):
            end = at + 1
            while end < len(queries) and (end - at) * work[0] + work[end + 1] - work[at] <= GROUP:
                end += 1
            self._group(queries, at, end, k, near, sims)
            at = end
        return near, sims

    def _group(self, queries: Vectors, begin: int, end: int, k: int, near: np.ndarray, sims: np.ndarray) -> None:
        m, width = end - begin, self.blocks * self.block
        part = slice(queries.start[begin], queries.start[end])
        of, at, weight = np.repeat(np.arange(m), np.diff(queries.start[begin : end + 1])), queries.at[part], queries.weight[part]
        place = self.place[at]
        often = place >= 0
        wide = np.zeros((m, len(self.matrix)))
        wide[of[often], place[often]] = weight[often]
        low = wide @ self.matrix
        least = lambda x: np.partition(x, width - k, axis=1)[:, width - k, None] if width > k else np.zeros((m, 1))
        # what the largest weights of a block can add
        of, at, weight = of[~often], at[~often], weight[~often]
        sizes = self.term_start[at + 1] - self.term_start[at]
        entries, of, weight = runs(self.term_start[at], sizes), np.repeat(of, sizes), np.repeat(weight, sizes)
        cell = of * self.blocks + self.entry_block[entries]
        most = np.bincount(cell, weight * self.entry_most[entries], m * self.blocks).reshape(m, self.blocks)
        alive = low.reshape(m, self.blocks, self.block).max(2) + most >= least(low) - 1e-9
        # the postings of the blocks that are left
        kept = alive.ravel()[cell]
        entries, of, weight = entries[kept], of[kept], weight[kept]
        sizes = self.entry_start[entries + 1] - self.entry_start[entries]
        postings = runs(self.entry_start[entries], sizes)
        low += np.bincount(np.repeat(of * width, sizes) + self.example[postings], np.repeat(weight, sizes) * self.posting[postings], m * width).reshape(m, width)
        row, example = np.nonzero((low >= least(low) - 1e-9) & (low > 0))
        found = low[row, example]
        order = np.lexsort((example, -np.round(found, 9), row))
        row, example, found = row[order], example[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row]
        best = rank < k
        near[begin + row[best], rank[best]], sims[begin + row[best], rank[best]] = example[best], found[best]

    def votes(self, queries: Vectors, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """A vote for each row and its neighbours."""
        near, sims = self.nearest(queries, k)
        toxic = np.append(self.labels, 0.0)[near]  # -1 is no example
        return (sims * toxic).sum(1) / (sims.sum(1) + DOUBT), near


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and probabilities, both rising, to interpolate between: pooled adjacent violators."""
    pools: list[list[float]] = []  # labels, rows, votes
    for v, y in sorted(zip(votes.tolist(), labels.tolist())):
        pools.append([y, 1, v])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][2] / pools[-2][1] == pools[-1][2] / pools[-1][1]):
            a = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], a)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Model:
    def __init__(self, index: Index, votes: np.ndarray, chances: np.ndarray):
        self.index, self.points, self.chances = index, votes, chances

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
        """(scores, ids of the neighbours of each)."""
        votes, near = self.index.votes(self.index.queries(texts, len(texts)))
        ids = [self.index.ids[x[x >= 0]].tolist() for x in near]
        return np.interp(votes, self.points, self.chances), ids


# --- on tables ---------------------------------------------------------------------------------


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ...) to (..., word, n), a list of words a row; a text that is cut has a row for each part."""
    for batch in batches:
        texts = batch.column(0)
        empty = pa.array([[]] * batch.num_rows, pa.list_(pa.string())), pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *empty], ["hash", "doc_id", "label", "place", "word", "n"])
        for owner, found in words(x.as_py() for x in texts):
            coded = found.dictionary_encode()
            key, n = np.unique(owner * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(key, max(1, len(coded.dictionary)))
            rows, first = np.unique(row, return_index=True)
            ends = pa.array(np.append(first, len(row)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[1:]), *lists], ["hash", "doc_id", "label", "place", "word", "n"])


def weights_of(df: np.ndarray, dt: np.ndarray, total: int, toxic: int, least: float = LEAST) -> np.ndarray:
    """Of terms in df examples, dt of them toxic: idf * pull."""
    share = df * (toxic / total)
    square = (dt - share) ** 2 / share + (dt - share) ** 2 / np.maximum(df - share, 1e-9)
    return (np.log((1 + total) / (1 + df)) + 1) * np.maximum(np.where(dt > share, np.sqrt(square), 0.0), least)


def fit_counts(texts: int, text: np.ndarray, found: pa.Array, n: np.ndarray, truth: np.ndarray, ids: np.ndarray, learned: np.ndarray, least: float = LEAST) -> Model:
    """From words of texts (number of the text, word, count), and the texts' labels and ids; those not learned calibrate."""
    total, toxic = int(learned.sum()), int(truth[learned].sum())
    if not toxic:
        none = np.zeros(0)
        return Model(Index(pa.array([], pa.string()), none, Vectors(np.zeros(1, np.int64), none.astype(int), none), none, none.astype(int)), np.zeros(1), np.zeros(1))
    coded = found.dictionary_encode()
    key, n = summed(text * len(coded.dictionary) + coded.indices.to_numpy(), n)
    row, code = np.divmod(key, len(coded.dictionary))
    df = np.bincount(code[learned[row]], minlength=len(coded.dictionary))
    terms = np.nonzero(df)[0]
    number = np.full(len(df), -1)
    number[terms] = np.arange(len(terms))
    dt = np.bincount(code[learned[row] & (truth[row] > 0)], minlength=len(df))[terms]
    idf = weights_of(df[terms].astype(float), dt.astype(float), total, toxic, least)
    known = number[code] >= 0
    row, code, n = row[known], number[code[known]], n[known]

    def vectors(some: np.ndarray) -> Vectors:
        mine = some[row]
        return Vectors.counted(int(some.sum()), (np.cumsum(some) - 1)[row[mine]] * len(terms) + code[mine], n[mine], idf)

    index = Index(coded.dictionary.take(pa.array(terms)), idf, vectors(learned), truth[learned].astype(float), ids[learned])
    votes, _ = index.votes(vectors(~learned))
    # one row of doubt at either end keeps the chances inside 0 and 1
    return Model(index, *isotonic(np.append(votes, [0.0, 1.0]), np.append(truth[~learned].astype(float), [0.0, 1.0])))


def _fitted(least: float):
    """Rows of _counted, all of them in one task, to a pickled Model."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "doc_id", "label", "place", "word", "n"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
        known = pa.Table.from_batches([*batches] or [pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)])
        hashed, ids, truth, place = (known[c].to_numpy() for c in names[:4])
        order = np.lexsort((hashed, place))
        first = np.append(True, (place[order][1:] != place[order][:-1]) | (hashed[order][1:] != hashed[order][:-1]))[: len(order)]
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(first) - 1
        own = order[first]
        lists = known["word"].combine_chunks()
        text = np.repeat(number, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        counts = known["n"].combine_chunks().flatten().to_numpy()
        model = fit_counts(len(own), text, lists.flatten(), counts, truth[own], ids[own], place[own] % 4 != 3, least)
        block = pickle.dumps(model)
        for i, at in enumerate(range(0, len(block), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block[at : at + PIECE]], pa.binary())], ["i", "piece"])

    return of


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out, bound: int = BOUND, least: float = LEAST) -> str:
    """The name of a file with a pickled Model, as Spark hands it to the executors.

    A task gathers the counted words of `bound` ids, makes the Model and writes it to the shared folder; it
    doesn't pass through the driver's memory.
    """
    sample, _ = labelled(docs, labels, label, held_out, bound)
    texts = sample.select("text", F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long"), "label", "place").distinct()
    counted = texts.mapInArrow(_counted, "hash long, doc_id long, label int, place int, word array<string>, n array<long>")
    file = materialize(counted.repartition(1).mapInArrow(_fitted(least), "i int, piece binary"), "toxicity-model").inputFiles()[0]
    docs.sparkSession.sparkContext.addFile(file)
    return file.rpartition("/")[2]


#: One model a worker: (file's name, model).
_open: list = [None, None]


def model_of(name: str) -> Model:
    if _open[0] != name:
        pieces = pq.read_table(SparkFiles.get(name)).sort_by("i")["piece"]
        _open[:] = [name, pickle.loads(b"".join(x.as_py() for x in pieces))]  # noqa: S301  made by fit()
    return _open[1]


def scored(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, score, evidence), a row per document. model: as fit() names it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                scores, evidence = own.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder(5) == 0)
    return scored(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
