"""Byte-level BPE encoding and decoding with a compiled lexicon.

The words are the pieces that the tokenizer's pattern cuts a text into. Frequent words are compiled
into a minimal acyclic automaton (words in order, states with equal futures shared); its arcs carry
numbers that add up, along a word, to the word's row in a table of ids: the transducer's output. The
automaton is one file in the shared folder that Spark hands to each executor once and that all of its
workers map into memory. Words that it doesn't hold are merged exactly, lowest rank first, and kept in
a bounded memo. frequent_words() counts those of a corpus; without a list of them, as in op10, the
vocabulary's own whole words stand in, which its makers found frequent: counting costs half as much as
encoding and saves less. The lexicon changes speed, never ids.

Long texts are cut in front of white space that follows something else, where no piece can reach
across, so memory follows the ids of one text.

Defined results: a null text is an empty one, with no ids; repeated rows get equal rows; a null doc_id
passes through; an empty table gives an empty result; a special token's string becomes its id.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import materialize, shared_dir, table

#: Alternatives that can't both match at a place are reordered, the most frequent first.
WHOLE = regex.compile(r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without the characters of ODD, in which letters and digits are what `re` takes for them.
LATIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
CUT = re.compile(r"(?<=\S)\s")
LONG_TEXT, MEMO, LEXICON, SHORT = 1 << 20, 600_000, 65_536, 200
NO_PAIR = 1 << 60


def pieces(text: str) -> Iterator[list[str]]:
    find = (WHOLE if ODD.search(text) else LATIN).findall
    at = 0
    while len(text) - at > LONG_TEXT and (cut := CUT.search(text, at + LONG_TEXT)):
        yield find(text[at : cut.start()])
        at = cut.start()
    yield find(text[at:] if at else text)


class Vocabulary:
    """Merges and bytes of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.first[b[0]] = i
        self.pair: dict[int, int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pair[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.of_bytes = [self.pair.get(a << 20 | b, NO_PAIR) for a in self.first for b in self.first]
        self.words = sorted(b for i, b in self.bytes_of.items() if i not in self.special.values() and self._whole(b))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _whole(word: bytes) -> bool:
        try:
            return WHOLE.fullmatch(word.decode()) is not None
        except UnicodeDecodeError:
            return False

    def merge(self, word: bytes) -> list[int]:
        """The ids of one piece: the pair of lowest rank, leftmost first, is merged until none is left."""
        if len(word) > SHORT:
            return self._merge_long(word)
        none, get, of_bytes = NO_PAIR, self.pair.get, self.of_bytes
        ids = [self.first[b] for b in word]
        ranks = [of_bytes[a << 8 | b] for a, b in zip(word, word[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [new := least & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
        return ids


    def _merge_long(self, word: bytes) -> list[int]:
        """The same in n log n: pairs in a heap, ids in a linked list. A pair that has changed meanwhile is passed over."""
        get, n = self.pair.get, len(word)
        ids: list[int] = [self.first[b] for b in word]  # -1: merged into the one before
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found, i) for i in range(n - 1) if (found := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            found, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 20 | ids[j]) != found:
                continue
            ids[i], ids[j] = found & 0xFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (more := get(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, (more, i))
            if (h := before[i]) >= 0 and (more := get(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, (more, h))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """Sorted different words and their ids as one block: see Lexicon for its layout."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []

    def close(node: list) -> int:
        final, arcs = node[0], tuple((label, child) for label, child in node[1])
        if (state := register.get((final, arcs))) is None:
            state = register[final, arcs] = len(states)
            states.append((final, arcs))
            counts.append(final + sum(counts[child] for _, child in arcs))
        return state

    path: list[list] = [[False, []]]  # open nodes along the last word: final, arcs; the last arc of each is open
    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            state = close(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], state)
        for label in word[same:]:
            path[-1][1].append((label, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = close(path.pop())
        path[-1][1][-1] = (path[-1][1][-1][0], state)
    root = close(path[0])
    begin, labels, targets, outputs = [0], [], [], []
    for final, arcs in states:
        passed = int(final)
        for label, child in arcs:
            labels.append(label)
            targets.append(child)
            outputs.append(passed)
            passed += counts[child]
        begin.append(len(labels))
    rows = np.cumsum([0, *map(len, ids)])
    head = struct.pack("<6I", root, len(states), len(labels), len(ids), int(rows[-1]), 0)
    arrays = [np.array(begin, "<u4"), np.array(targets, "<u4"), np.array(outputs, "<u4"), rows.astype("<u4"), np.array([i for x in ids for i in x], "<u4")]
    return head + b"".join(x.tobytes() for x in arrays) + bytes(int(f) for f, _ in states) + bytes(labels)


class Lexicon:
    """The compiled automaton, read in place."""

    def __init__(self, block: mmap.mmap | bytes):
        root, states, arcs, words, ids, _ = struct.unpack_from("<6I", block)
        view, at = memoryview(block), 24
        parts = []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.begin, self.targets, self.outputs, self.rows, self._ids = parts
        self.ids = self._ids.cast("B")
        self.final, self.labels = view[at : at + states], view[at + states : at + states + arcs]
        self.root = root

    def find(self, word: bytes) -> bytes | None:
        """The word's ids, little-endian, 4 bytes each."""
        state, row = self.root, 0
        begin, labels = self.begin, self.labels
        for label in word:
            end = begin[state + 1]
            arc = bisect_left(labels, label, begin[state], end)
            if arc == end or labels[arc] != label:
                return None
            row += self.outputs[arc]
            state = self.targets[arc]
        return bytes(self.ids[4 * self.rows[row] : 4 * self.rows[row + 1]]) if self.final[state] else None


class Coder(dict):
    """Piece to ids as bytes: the lexicon's, or merged; also a memo of both, in two generations of memo / 2 pieces."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, memo: int = MEMO):
        super().__init__()
        self.vocabulary, self.lexicon, self.half, self.old = vocabulary, lexicon, memo // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.old.get(piece)) is None:
            word = piece.encode()
            found = self.lexicon.find(word) if self.lexicon else None
            if found is None:
                ids = self.vocabulary.merge(word)
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) > 64:
                return found
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        v, out = self.vocabulary, []
        parts = v.cut.split(text) if v.cut and any(s in text for s in v.special) else [text]
        for part in parts:
            if part in v.special:
                out.append(struct.pack("<I", v.special[part]))
            else:
                out += [b"".join(map(self.__getitem__, p)) for p in pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary_of(spec: str) -> Vocabulary:
    return Vocabulary(spec)


@lru_cache(maxsize=4)
def compiled(spec: str, words: tuple[bytes, ...] | None) -> bytes:
    v = vocabulary_of(spec)
    known = sorted(set(words)) if words is not None else v.words
    return compile_lexicon(known, [v.merge(w) for w in known])


def share_file(spark: SparkSession, block: bytes, name: str) -> str:
    """Put bytes into a file of the shared folder and have Spark hand it to the executors; its name there."""
    name = f"{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inkwell/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        for at in range(0, len(block), 1 << 20):
            out.write(bytearray(block[at : at + (1 << 20)]))
    finally:
        out.close()
    sc.addFile(path.toString())
    return name


#: One coder a worker: (file's name, coder).
_open: list = [None, None]


def coder_of(spec: str, name: str) -> Coder:
    if _open[0] != name:
        with open(SparkFiles.get(name), "rb") as f:
            _open[:] = [name, Coder(vocabulary_of(spec), Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))]
    return _open[1]


def frequent_words(docs: DataFrame, top: int = LEXICON) -> list[bytes]:
    """The pieces found n times or more in all texts, n (from 2 on) as small as leaves `top` of them or fewer.

    Only these and a count for each step come to the driver.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for p in pieces(text or ""):
                    found.update(p)
                if len(found) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    # numbers up to 1024 are steps of their own, larger ones go by sixteenths of a doubling
    step = F.when(F.col("n") <= 1024, F.col("n")).otherwise(864 + F.floor(16 * F.log2("n"))).cast("int")
    counts = materialize(counts.select("word", step.alias("step")), "words")
    words, least = 0, None
    for found in sorted(counts.groupBy("step").count().collect(), reverse=True):
        words += found["count"]
        if words > top:
            break
        least = found["step"]
    return sorted(r["word"].encode() for r in counts.filter(F.col("step") >= least).collect()) if least is not None else []


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, path: str, make, schema: T.StructType, words: list[bytes] | None = None) -> DataFrame:
    """A row per document of (doc_id, *make(coder, text))."""
    spark, spec = docs.sparkSession, read_tokenizer(path)
    name = share_file(spark, compiled(spec, tuple(words) if words is not None else None), "lexicon")
    shared = spark.sparkContext.broadcast(spec)  # the tokenizer's file, of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value, name)
        types = [pa.int64() if f.dataType.typeName() == "long" else pa.string() if f.dataType.typeName() == "string" else pa.list_(pa.int32()) for f in schema.fields[1:]]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = list(zip(*(make(coder, text or "") for text in part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(rows, types))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, words: list[bytes] | None = None) -> DataFrame:
    """(doc_id, ids array<int>)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return encoded(docs, path, lambda coder, text: (np.frombuffer(coder.encode(text), "<u4").astype(np.int32),), schema, words)


def digest(coder: Coder, text: str) -> tuple[int, str, str]:
    ids = coder.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()


def digests(docs: DataFrame, path: str, words: list[bytes] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return encoded(docs, path, digest, T.StructType([docs.schema["doc_id"], *more]), words)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
