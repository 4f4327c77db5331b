"""WARC archives: records with digests, revisits, segments and chunked transfer framing.

Writing: every page is a response record, or a revisit of the response with the same payload and the
smallest page_id. Blocks are HTTP messages with chunked framing; a block longer than `segment` bytes is
cut, the rest following in continuation records. Spark's text writer writes the records, with the two
line breaks that end a record as separator, so files appear whole or not at all, on any file system
Spark can write.

Reading: a file's bytes are one value (Spark allows 2 GB; written files are far smaller), inflated and
parsed piece by piece. Segments are gathered by the id of the record they begin with,
in order of their number, through a state that holds one segment at a time: total length is
verified, the chunked framing decoded, payloads digested as they pass. A revisit takes its length from
the response it names, after their digests are compared. What doesn't agree is told in `problem`.
Archives of other makers have no page_id; records that can't be read are rows of type `damaged`, and what
stands behind one whose end can't be told is left out.

Defined results: a null html is an empty payload; a null url leaves out the target; line breaks in a url
are written as %0D and %0A; rows that repeat the response's page_id and payload are responses, too; a
null page_id is never the smallest, unless all are; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.llm.common import join_hot, materialize, shared_dir, table

LEAST, SEGMENT, CHUNK, DATE, PAGE = 100, 32 * 1024, 8 * 1024, "2020-01-01T00:00:00Z", "X-Page-ID"
#: So a file holds about 128 MB at most before it is compressed.
RECORDS_A_FILE = 4096
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SCHEMA = (
    "record_id string, page_id long, record_type string, refers_to string, segment int, total_length long, declared string, "
    "payload_bytes long, payload_digest string, block binary, problem string"
)


# --- records -----------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:32]}:{copy}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[at : at + size] for at in range(0, len(payload), size))]
    return b"".join(out) + b"0\r\n\r\n"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line breaks that end it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def page_header(page_id: int | None) -> tuple[str, object]:
    """A header of this library: the page that a record was made of."""
    return PAGE, page_id


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, copy: int, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of a page; first: the page_id of the response that it revisits."""
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    own = record_id(page_id, digest, copy)
    common = [("WARC-Record-ID", own), page_header(page_id), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    kind = ("Content-Type", "application/http;msgtype=response")
    if first is not None:
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", record_id(first, digest, 0)), ("WARC-Profile", PROFILE), kind], HTTP)
        return
    block = HTTP + chunked(payload, chunk)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), *common, kind], block)
        return
    yield record([("WARC-Type", "response"), *common, kind, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        more = [("WARC-Record-ID", f"{own[:-1]}:{n}>"), page_header(page_id), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", own)]
        yield record([("WARC-Type", "continuation"), *more, ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


# --- reading -----------------------------------------------------------------------------------


class Stream:
    """Reads a file's bytes, inflating them piece by piece if they are gzip."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.source = self._pieces(data, piece)
        self.buffer = bytearray()

    @staticmethod
    def _pieces(data: bytes, piece: int) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        while data:
            z = zlib.decompressobj(31)
            out = z.decompress(data, piece)
            while out or z.unconsumed_tail:
                yield out
                out = z.decompress(z.unconsumed_tail, piece)
            data = z.unused_data if z.eof else b""

    def _more(self) -> bool:
        got = next(self.source, None)
        if got is not None:
            self.buffer += got
        return got is not None

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next mark, which is read, too; None at the end."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers by lower-case name, block, problem) of every record of a file; nothing is read behind a record whose end can't be told."""
    stream = Stream(data)
    try:
        while (head := stream.until(END)) is not None:
            lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = headers.get("content-length", "")
            if not lines[0].startswith("WARC/") or not (length.isascii() and length.isdigit()):
                yield headers, b"", f"no record begins with {lines[0][:40]!r}" if not lines[0].startswith("WARC/") else "the record tells no length"
                return
            block = stream.read(int(length))
            yield headers, block, "the record ends early" if len(block) < int(length) else None
            stream.read(len(END))
    except zlib.error as e:
        yield {}, b"", f"the file can't be inflated: {e}"


class Payload:
    """Digest and length of the payload of an HTTP message that comes in pieces."""

    def __init__(self):
        self.hash, self.length, self.seen = hashlib.sha256(), 0, 0
        self.rest, self.state, self.left, self.chunked = b"", "head", 0, False

    def _take(self, data: bytes) -> None:
        self.hash.update(data)
        self.length += len(data)

    def feed(self, data: bytes) -> None:
        self.seen += len(data)
        self.rest += data
        while True:
            if self.state == "head":
                head, mark, rest = self.rest.partition(END)
                if not mark:
                    return
                fields = [x.lower().replace(b" ", b"") for x in head.split(b"\r\n")]
                self.chunked, self.rest = b"transfer-encoding:chunked" in fields, rest
                self.state = "size" if self.chunked else "plain"
            elif self.state == "plain":
                self._take(self.rest)
                self.rest = b""
                return
            elif self.state == "size":
                line, mark, rest = self.rest.partition(b"\r\n")
                if not mark:
                    return
                self.left, self.rest = int(line.split(b";")[0], 16), rest
                self.state = "data" if self.left else "trailer"
            elif self.state == "data":
                part = self.rest[: self.left]
                self._take(part)
                self.left, self.rest = self.left - len(part), self.rest[len(part) :]
                if self.left:
                    return
                self.state = "after"
            elif self.state == "after":
                if len(self.rest) < 2:
                    return
                if self.rest[:2] != b"\r\n":
                    raise ValueError("a chunk doesn't end where its size says")
                self.rest, self.state = self.rest[2:], "size"
            elif self.state == "trailer":
                line, mark, rest = self.rest.partition(b"\r\n")
                if not mark:
                    return
                self.rest, self.state = rest, "trailer" if line else "done"
            else:
                return

    def result(self, declared: str | None) -> tuple[int | None, str | None, str | None]:
        """(bytes, digest, problem)."""
        digest = self.hash.hexdigest()
        if self.state not in ("plain", "done"):
            return None, None, "the message ends early"
        if declared and declared != digest:
            return self.length, digest, "the digest differs from the record's"
        return self.length, digest, None


def payload_of(block: bytes, declared: str | None) -> tuple[int | None, str | None, str | None]:
    message = Payload()
    try:
        message.feed(block)
    except ValueError as e:
        return None, None, str(e)
    return message.result(declared)


def _number(text: str | None, digits: int = 18) -> int | None:
    return int(text) if text is not None and re.fullmatch(f"-?[0-9]{{1,{digits}}}", text) else None


def _rows(data: bytes) -> Iterator[tuple]:
    for h, block, problem in parse(data):
        kind, own, page = h.get("warc-type"), h.get("warc-record-id"), _number(h.get(PAGE.lower()))
        digest = h.get("warc-payload-digest", "")
        declared = digest.removeprefix("sha256:") if digest.startswith("sha256:") else None
        segment = h.get("warc-segment-number")
        number = _number(segment, 9)
        if not problem and (own is None or kind is None):
            problem = "the record has no id" if kind else "the record has no type"
        if not problem and (segment is not None or kind == "continuation") and number is None:
            problem = "the segment has no number"
        if problem:
            yield own, page, "damaged", None, None, None, declared, None, None, None, problem
        elif number is not None:
            own = h.get("warc-segment-origin-id", own)
            yield own, page, "response", None, number, _number(h.get("warc-segment-total-length")), declared, None, None, block, None
        elif kind == "revisit":
            yield own, page, kind, h.get("warc-refers-to"), None, None, declared, None, None, None, None
        elif kind == "response":
            n, digest, problem = payload_of(block, declared)
            yield own, page, kind, None, None, None, declared, n, digest, None, problem


_ARROW = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()),
     ("declared", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary()), ("problem", pa.string())]
)


def _batched(rows: Iterable[tuple], size: int = 256) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), _ARROW)], schema=_ARROW)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), _ARROW)], schema=_ARROW)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            yield from _batched(_rows(content.as_py()))


def _reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (record_id, segment) to whole records. One segment is held at a time."""

    def rows() -> Iterator[tuple]:
        own, message, last, total, declared, problem, page = None, Payload(), 0, None, None, None, None

        def whole() -> tuple:
            n, digest, found = message.result(declared)
            found = problem or ("the total length differs" if total is None or total != message.seen else found)
            return own, page, "response", None, None, total, declared, *((None, None) if problem else (n, digest)), None, found

        for batch in batches:
            for i in range(batch.num_rows):
                origin, number = batch.column(0)[i].as_py(), batch.column(4)[i].as_py()
                if origin != own:
                    if own is not None:
                        yield whole()
                    own, message, last, total, declared, problem, page = origin, Payload(), 0, None, None, None, batch.column(1)[i].as_py()
                if number == last:  # a repeated segment
                    continue
                if number != last + 1:
                    problem = problem or f"segment {last + 1} is missing"
                last = number
                total = batch.column(5)[i].as_py() if total is None else total
                declared = declared or batch.column(6)[i].as_py()
                if not problem:
                    try:
                        message.feed(batch.column(9)[i].as_py())
                    except ValueError as e:
                        problem = str(e)
        if own is not None:
            yield whole()

    yield from _batched(rows())


# --- on tables ---------------------------------------------------------------------------------


def write(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Write pages (page_id, url, html) as WARC files under path."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = lambda df: df.withColumn("at", F.xxhash64("page_id", "digest"))
    sized = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least)
    first = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1 AND first IS NOT NULL")
    again = named(join_hot(sized, first, "digest", "times").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()).select("at", "first")
    rows = named(pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)))
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("at").orderBy("at")) - 1).join(again, "at", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                out = [x for r in part for x in records(r["page_id"], r["url"], r["payload"], r["digest"], r["first"], r["copy"], segment, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", "digest", F.col("first").cast("long").alias("first"), "copy")
    made.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def read(spark: SparkSession, path: str, names: str = "*.gz") -> DataFrame:
    """record_id, page_id, record_type, refers_to (page_id), payload_bytes, payload_digest, problem: a row per page's record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    found = materialize(files.select("content").mapInArrow(_read, SCHEMA), "warc-records")
    parts = found.filter("segment IS NOT NULL").repartition("record_id").sortWithinPartitions("record_id", "segment")
    columns = ["record_id", "page_id", "record_type", "refers_to", "declared", "payload_bytes", "payload_digest", "problem"]
    joined = parts.mapInArrow(_reassemble, SCHEMA).select(*columns)
    single = found.filter("segment IS NULL").select(*columns)
    responses = materialize(single.filter("record_type = 'response'").unionByName(joined), "warc-responses")
    target = responses.select(F.col("record_id").alias("of"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest")).dropDuplicates(["of"])
    revisits = single.filter("record_type = 'revisit'").withColumn("refers_to", F.coalesce("refers_to", F.lit("")))
    asked = revisits.groupBy("refers_to").agg(F.count("*").alias("times"))
    # a row per response that is asked for, also where it is missing; a response may have very many revisits
    answers = asked.join(target, F.col("refers_to") == F.col("of"), "left")
    revisits = join_hot(revisits, answers, "refers_to", "times")
    problem = F.when(F.col("of").isNull(), "the response is missing").when(~F.col("digest").eqNullSafe(F.col("declared")), "the digest differs from the response's")
    revisits = revisits.select("record_id", "page_id", "record_type", F.col("first").alias("refers_to"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), problem.alias("problem"))
    damaged = single.filter("record_type = 'damaged'")
    return responses.unionByName(damaged).withColumn("refers_to", F.lit(None).cast("long")).select(*revisits.columns).unionByName(revisits)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/inkwell/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM f
"""
