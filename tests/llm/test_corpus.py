"""The corpus operators against plain Python, on a small corpus with nulls, empty, long, repeated and tied rows."""

import gzip
import hashlib
import math
import random
import struct
import time
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm import bpe, line_dedup, mixing, quality_model, quality_rules, simhash, toxicity, url_model, warc, winnow
from inkwell.llm.common import join_hot

SPACE = " \t\n\x0b\x0c\r"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


BASE = prose(400)
TEXTS = [
    None, "", " \n\t ", "one", "two words", "a b c", "a b c a b c a b c", "Same line\nSame line\n\nsame LINE ", BASE, BASE, BASE.replace(" ", "  ", 3), BASE + " tail",
    "x" * 5000, "word " * 3000, prose(6000), "😀 ünï ² ½ <|endoftext|> 's don't\r\n\x1c end", "#a *b $c %d &e |f <g>", "no\u00a0break one\u2028two",
]
TEXTS += [prose(rng.randint(1, 300)) + "\n  Boiler Plate Line  \n" + prose(60) for _ in range(40)] + [prose(rng.randint(1, 120)) for _ in range(60)]
TEXTS += ["\n".join(["boiler plate line", "And another one", prose(3)]) for _ in range(14)]
DOCS = [(i * 3, t, ["s1", "s2", None, "s3", "ß", ""][i % 6] if i % 3 else "hot", len(t or ""), i, "k", 1.0, "x") for i, t in enumerate(TEXTS)]
DOCS += [DOCS[8], DOCS[8], (None, "null id " * 30, "s1", 1, 0, "k", 1.0, "x"), (900001, BASE, "hot", 1, 0, "k", 1.0, "x")]
COLUMNS = "doc_id long, text string, source string, n_chars long, __id long, key string, kept double, text_hash string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    labels = [(d[0], int(i % 4 != 0), int(i % 7 == 0)) for i, d in enumerate(DOCS) if d[0] is not None] + [(1, None, None), (None, 1, 1)]
    pages = [(i, f"https://www.h{i % 3}.example.com/en/{i}?a#b", ("é<p>" * (i * 997 % 70000 + 1)) if i % 4 else "same payload " * 12) for i in range(40)]
    pages += [(50, None, None), (51, "no scheme", ""), (52, "HTTP://A.Net/fr/x", "tiny"), (53, "HTTP://A.Net/fr", "tiny"), (None, "://", "same payload " * 12), (0, pages[0][1], pages[0][2])]
    spark.createDataFrame(DOCS, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.mark.parametrize("f", [quality_rules.op1, winnow.op2, mixing.op3, warc.op4, simhash.op5, line_dedup.op6, quality_model.op7, url_model.op8, toxicity.op9, bpe.op10, corpus_pipeline.run])
def test_empty_tables_give_empty_results(spark, nothing, f):
    assert f(spark, nothing).count() == 0


def test_every_corpus_query_is_registered():
    import __spark_entry__ as entry

    names = {"op1_quality_rules", "op2_winnowing", "op3_mixing", "op4_warc", "op5_simhash", "op6_line_dedup", "op7_quality", "op8_url_filter", "op9_toxicity", "op10_bpe", "pipeline"}
    assert names <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def words(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def multiset(rows):
    return Counter(map(tuple, rows))


def quality_by_hand(docs, copies_count=True):
    holders, first = {}, {}
    norm = lambda line: " ".join(words(line)).lower()
    for d in docs:
        for line in (d[1] or "").split("\n"):
            if words(line):
                k = (d[2], norm(line))
                holders.setdefault(k, set()).add(d[0] if copies_count else d[1])
                if d[0] is not None:
                    first[k] = min(first.get(k, d[0]), d[0])
    want = []
    for d in docs:
        w = words(d[1])
        grams = list(zip(w, w[1:], w[2:]))
        n = Counter(grams)
        repeated = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in (d[1] or "").split("\n") if words(x)]
        lost = sum(len(words(x)) for x in lines if len(holders[d[2], norm(x)]) >= 10 and first.get((d[2], norm(x))) != d[0])
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        share = 1 - lost / len(w) if w else 1
        want.append((d[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in d[1] or ""), len(lines) - len(set(lines)), len(repeated), failed, not failed and share >= 0.3))
    return want


def test_quality_rules(spark, corpus):
    got = quality_rules.op1(spark, corpus)
    assert multiset(got.collect()) == multiset(quality_by_hand(DOCS))
    by_text = quality_rules.judge(spark.createDataFrame(DOCS, COLUMNS), limits=quality_rules.LineLimits(copies_count=False)).select(got.columns)
    assert multiset(by_text.collect()) == multiset(quality_by_hand(DOCS, False))


def test_quality_rules_reject_what_is_only_frequent_lines(spark):
    common = "\n".join(prose(12).replace("\n", " ") for _ in range(6))
    rows = [(i, f"{common}\n{prose(3)}", "s", 0) for i in range(30)] + [(i, prose(80), "s", 0) for i in range(100, 130)] + [(i, BASE, "s", 0) for i in range(200, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kept = lambda limits: {r["doc_id"] for r in quality_rules.keep(docs, limits=limits).collect()}
    assert kept(quality_rules.LineLimits()) == {0, 200} | set(range(100, 130))
    assert kept(quality_rules.LineLimits(copies_count=False)) == {0} | set(range(100, 130)) | set(range(200, 240))


def test_frequent_lines_are_removed(spark):
    common = prose(12).replace("\n", " ")
    rows = [(i, f"{prose(60)}\n {common.upper()} \n\n{prose(3)}", "s" if i % 2 else None, 7, "x") for i in range(30)] + [(50, prose(80), "s", 7, "x"), (51, f"{common}\n" + prose(70), "t", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, __gone string")
    got = quality_rules.cleaned(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        text = rows[r["doc_id"] if r["doc_id"] < 30 else r["doc_id"] - 20][1]
        short = text.replace(f"\n {common.upper()} ", "") if 1 < r["doc_id"] < 30 else text
        assert r["text"] == short and r["n_chars"] == (len(short) if short != text else 7)
    assert got.count() == 32


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0, None) for i in range(300)], "i int, k int, __hot string")
    small = spark.createDataFrame([(k, f"v{k}", 200 if k == 0 else 1) for k in range(5)], "k int, v string, n int")
    want = {(r["i"], r["v"]) for r in rows.join(small, "k").collect()}
    for share in (1, 2, 4096):
        got = join_hot(rows, small, "k", "n", share)
        assert got.columns == ["k", "i", "__hot", "v"] and sorted((r["i"], r["v"]) for r in got.collect()) == sorted(want)


def fingerprint_by_hand(text):
    """(hashes, positions): the cyclic polynomial, rolled word by word."""
    turn = lambda x, n: (x << n | x >> (64 - n)) & (1 << 64) - 1
    words_ = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words(text)]
    grams, last = [], 0
    for i, h in enumerate(words_):
        last = turn(last, 1) ^ h
        if i >= 5:
            last ^= turn(words_[i - 5], 5)
        if i >= 4 or i == len(words_) - 1:
            grams.append(last)
    signed = [g - (1 << 64) if g >> 63 else g for g in grams]
    size = min(16, len(signed))
    chosen = sorted({min(range(i, i + size), key=lambda j: (signed[j], -j)) for i in range(len(signed) - size + 1)}) if signed else []
    return [signed[j] for j in chosen], chosen


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing(spark, corpus):
    order = sorted(DOCS, key=lambda d: (d[0] is None, d[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((d[1] or "").encode(), 42)))))
    want = []
    for i, d in enumerate(order):
        text, after = d[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, at = fingerprint_by_hand(text)
        other, following = fingerprint_by_hand(edited)[0], fingerprint_by_hand(after)[0]
        show = lambda x: "".join(f"{h & (1 << 64) - 1:016x}" for h in x)
        want.append((d[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(other), round(likeness(own, other), 9), round(likeness(own, following), 9), tuple(at)))
    got = [(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9), tuple(r[7])) for r in winnow.op2(spark, corpus).collect()]
    assert Counter(got) == Counter(want)


def test_winnowing_of_one_document_follows_itself(spark):
    row = winnow.with_next(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).first()
    assert (row["text"], row["next"]["text"]) == ("abc", "abc")


def targets_by_hand(docs):
    sizes = Counter()
    for d in docs:
        sizes[d[2]] += len(words(d[1]))
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if 3 * sizes[s] < weight[s] * rest / total]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
        rest -= sum(target[s] for s in over)
    return sizes, target | {s: weight[s] * rest / total for s in free}


def test_mixing(spark, corpus):
    got = mixing.op3(spark, corpus).collect()
    again = mixing.op3(spark, corpus).collect()
    assert Counter(got) == Counter(again)
    sizes, target = targets_by_hand(DOCS)
    source = {d[0]: d[2] for d in DOCS}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_mixed_repeats_whole_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert {r["doc_id"] for r in out.collect()} <= {d[0] for d in DOCS}


def test_warc(spark, corpus):
    pages = spark.read.parquet(f"{corpus}/pages.parquet").collect()
    first = {}
    for p in pages:
        if p["page_id"] is not None and len((p["html"] or "").encode()) >= 100:
            first[p["html"]] = min(first.get(p["html"], p["page_id"]), p["page_id"])
    want = []
    for p in pages:
        raw = (p["html"] or "").encode()
        again = first.get(p["html"], p["page_id"]) != p["page_id"]
        want.append((p["page_id"], len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[p["html"]] if again else None, None))
    assert multiset(warc.op4(spark, corpus).collect()) == multiset(want)


def test_warc_segments_and_damage():
    payload = bytes(rng.randrange(256) for _ in range(5000)) + b"\r\n\r\nWARC/1.1\r\n" * 40
    digest = hashlib.sha256(payload).hexdigest()
    made = list(warc.records(7, "http://x/", payload, digest, None, 0, segment=600, chunk=97))
    rows = sorted(warc._rows(b"\r\n\r\n".join([*made, b""])), key=lambda r: r[4])
    whole = lambda rows: next(iter(warc._reassemble(warc._batched(rows)))).to_pylist()[0]
    assert len(rows) > 5 and whole(rows)["payload_digest"] == digest and whole(rows)["problem"] is None
    assert whole(rows[:3] + rows[4:])["problem"] == "segment 4 is missing"
    assert whole(rows[:-1])["problem"] is not None
    assert whole(sorted(rows + rows, key=lambda r: r[4]))["problem"] is None
    bad = made[0].replace(digest.encode(), b"0" * 64)
    assert whole([*warc._rows(bad + b"\r\n\r\n"), *rows[1:]])["problem"] == "the digest differs from the record's"


def test_warc_of_other_makers(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    digest = hashlib.sha256(b"hello").hexdigest()
    one = lambda *h, block=body, length=None: "\r\n".join(["WARC/1.0", *h, f"Content-Length: {len(block) if length is None else length}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    kind = "WARC-Type: response"
    files = {
        "a": one("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>") + one(kind, "WARC-Record-ID: <urn:uuid:1>", "WARC-Payload-Digest: sha1:ABC")
        + one("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:2>", "WARC-Refers-To: <urn:uuid:1>", f"WARC-Payload-Digest: sha256:{digest}", block=b"")
        + one("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:3>", "WARC-Refers-To: <urn:uuid:9>", block=b"") + one("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:4>", block=b"")
        + one(kind) + one("WARC-Record-ID: <urn:uuid:5>") + one("WARC-Type: continuation", "WARC-Record-ID: <urn:uuid:6>", "WARC-Segment-Number: x")
        + one(kind, "WARC-Record-ID: <urn:uuid:7>", block=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"),
        "b": one(kind, "WARC-Record-ID: <urn:uuid:8>", length="many"), "c": one(kind, "WARC-Record-ID: <urn:uuid:9x>", length=5000), "d": b"no archive\r\n\r\n", "e": b"",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
    (tmp_path / "f.gz").write_bytes(gzip.compress(files["a"])[:10] + b"\xff" * 40)
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    got = {(r["record_id"] or "").strip("<>").removeprefix("urn:uuid:"): r for r in rows if r["record_id"]}
    assert got["1"]["payload_digest"] == got["2"]["payload_digest"] == digest and got["1"]["problem"] is got["2"]["problem"] is None
    assert got["3"]["problem"] == got["4"]["problem"] == "the response is missing" and got["7"]["problem"] and got["1"]["page_id"] is None
    assert {k for k, r in got.items() if r["record_type"] == "damaged"} == {"5", "6", "8", "9x"} and "0" not in got
    assert sorted(r["problem"][:20] for r in rows if r["record_id"] is None) == ["no record begins wit", "the file can't be in", "the record has no id"]


def groups_by_hand(docs):
    def by_hand(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [by_hand(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[find(i)] = min(least.get(find(i), d[0]), d[0])
    return [(d[0], f"{fps[i]:016x}", least.get(find(i))) for i, d in enumerate(docs)]


def test_simhash(spark, corpus):
    want = groups_by_hand(DOCS)
    assert multiset(simhash.op5(spark, corpus).collect()) == multiset(want)


@pytest.mark.parametrize("dense", [simhash.DENSE, 20])
def test_simhash_links_join_every_group(spark, dense):
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        ball = [rng.getrandbits(64)]
        for _ in range(60):
            ball.append(rng.choice(ball) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps |= set(ball)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, dense=dense, shared_from=4)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_simhash_thresholds_cover_every_pair():
    parts = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    near = [[np.ones((3, 1 << len(h))) * rng.random() for h in simhash.Index.halves(p)] for p in parts]
    fps = np.array([rng.getrandbits(63) for _ in range(200)], np.int64)
    chosen, _ = simhash.Index(parts, near, 10_000).choose(fps, np.array([[rng.choice([0, 0, 500]) for _ in parts] for _ in fps]))
    assert (chosen.sum(1) == 0).all() and chosen.min() >= -1


def lines_by_hand(docs):
    """For each document its lines and those that stay."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    held = Counter(k for _, k in {(d[0], key(x)) for d in docs for x in (d[1] or "").split("\n")} if k)
    return [((d[1] or "").split("\n"), [x for x in (d[1] or "").split("\n") if held[key(x)] < 10]) for d in docs]


def test_line_dedup(spark, corpus):
    found = zip(DOCS, lines_by_hand(DOCS))
    want = [(d[0], len(a), len(a) - len(b), hashlib.sha256("\n".join(b).encode()).hexdigest()) for d, (a, b) in found]
    assert any(w[2] for w in want)
    assert multiset(line_dedup.op6(spark, corpus).collect()) == multiset(want)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns and Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in out.collect()) == Counter(w[3] for w in want)


def test_line_runs_anti_join_and_compact(spark):
    runs, total = line_dedup.LineRuns(spark, min_docs=5, fanout=2), Counter()
    for _ in range(5):
        keys = [rng.randrange(40) for _ in range(60)]
        total.update(keys)
        runs.add(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert {r["key"] for r in runs.frequent().collect()} == {k for k, n in total.items() if n >= 5}
    fresh = spark.createDataFrame([(k,) for k in range(60)], "key long")
    assert {r["key"] for r in runs.unseen(fresh).collect()} == set(range(60)) - set(total)


def sampled(spark, tmp_path, make, label):
    rows = [make(i) for i in range(900)]
    spark.createDataFrame([(i, t, "s", len(t)) for i, (t, _) in enumerate(rows)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return [y for _, y in rows]


def quality_by_dictionary(docs, labels):
    """Training and scores in plain Python: dictionaries of z and n, one part."""
    kind = lambda b: ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    full = (1 << 64) - 1
    place = lambda h, family: ((h * 2 + 2 * family + 1) * 0x9E3779B97F4A7C15 & full) >> (64 - quality_model.BITS)

    def features(text):
        raw = (text or "").encode()
        found = [zlib.crc32(x) for x in raw.split()]
        shapes = [zlib.crc32(x[:2] + x[-3:]) for x in bytes(map(kind, raw)).split()]
        shapes = [61 if i and found[i] == found[i - 1] else x for i, x in enumerate(shapes)]
        pairs = lambda h: [(a * 0x100000001B3 + b) & full for a, b in zip(h, h[1:])]
        counts = Counter(place(h, f) for f, hs in ((1, found), (2, pairs(found)), (3, shapes), (4, pairs(shapes))) for h in hs)
        values = {p: math.log1p(n) for p, n in counts.items()}
        length = math.sqrt(sum(v * v for v in values.values()))
        return {p: float(np.float32(v / length)) for p, v in values.items()}

    signed = lambda data: (h := xxhash.xxh64_intdigest(data, 42)) - (h >> 63 << 64)
    known = sorted((i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: (signed(struct.pack("<q", i)), i))
    text, z, n = dict(docs), Counter(), Counter()
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02

    def weight(p):
        return 0.0 if abs(z[p]) <= l1 else -(z[p] - math.copysign(l1, z[p])) / ((beta + math.sqrt(n[p])) / alpha + l2)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(p) * v for p, v in x.items()) - weight("bias")))

    rows = [(features(text[i]), labels[i]) for i in known]
    for _ in range(quality_model.EPOCHS):
        for x, y in rows:
            g = chance(x) - y
            step = {p: (g * v, weight(p)) for p, v in [*x.items(), ("bias", 1.0)]}
            for p, (d, w) in step.items():
                z[p] += d - (math.sqrt(n[p] + d * d) - math.sqrt(n[p])) / alpha * w
                n[p] += d * d
    return lambda t: chance(features(t))


def test_quality_model(spark, corpus, tmp_path):
    def make(i):
        good = rng.random() < 0.7
        w = words(prose(rng.randint(40, 150)))
        return " ".join(w if good else [x.upper() + "!!" for x in w]), int(good)

    truth = sampled(spark, tmp_path, make, "quality")
    got = quality_model.op7(spark, str(tmp_path)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    score = quality_by_dictionary(list(text.items()), dict(enumerate(truth)))
    assert all(abs(r["score"] - score(text[r["doc_id"]])) < 1e-4 for r in got[::9])
    edge = quality_model.op7(spark, corpus).collect()
    assert len(edge) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in edge)


def toxicity_by_hand(docs, labels, bound=toxicity.BOUND, k=toxicity.K):
    """(score, evidence) of each text: every labelled example is compared with every text, in dictionaries."""
    signed = lambda data: (h := xxhash.xxh64_intdigest(data, 42)) - (h >> 63 << 64)
    counts = lambda t: Counter(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()))
    known = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5}
    place = {i: n for n, i in enumerate(sorted(known, key=lambda i: (signed(struct.pack("<q", i)), i))[:bound])}
    rows = sorted({(place[i], signed((t or "").encode()) if t is not None else 42, t, i) for i, t in docs if i in place}, key=lambda r: r[:2])
    learned, rest = [r for r in rows if r[0] % 4 != 3], [r for r in rows if r[0] % 4 == 3]
    total, toxic = len(learned), sum(known[r[3]] for r in learned)
    df = Counter(w for r in learned for w in counts(r[2]))
    dt = Counter(w for r in learned if known[r[3]] for w in counts(r[2]))
    weight = {}
    for w, n in df.items():
        share = n * toxic / total
        square = (dt[w] - share) ** 2 / share + (dt[w] - share) ** 2 / max(n - share, 1e-9)
        weight[w] = (math.log((1 + total) / (1 + n)) + 1) * max(math.sqrt(square) if dt[w] > share else 0, toxicity.LEAST)

    def vector(t):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in counts(t).items() if w in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    examples = [(vector(r[2]), known[r[3]], r[3]) for r in learned]

    def vote(t):
        v = vector(t)
        sims = [sum(x * e.get(w, 0) for w, x in v.items()) for e, _, _ in examples]
        best = [i for i in sorted(range(total), key=lambda i: (-round(sims[i], 9), i)) if sims[i] > 0][:k]
        return sum(sims[i] * examples[i][1] for i in best) / (sum(sims[i] for i in best) + toxicity.DOUBT), [examples[i][2] for i in best]

    points, chances = toxicity.isotonic(np.array([*(vote(r[2])[0] for r in rest), 0, 1]), np.array([*(known[r[3]] for r in rest), 0, 1], float))
    return lambda t: (float(np.interp((v := vote(t))[0], points, chances)), v[1])


def test_toxicity(spark, corpus, tmp_path):
    def make(i):
        bad = rng.random() < 0.2
        w = words(prose(rng.randint(40, 150)))
        return " ".join(w + rng.sample(["grob", "übel", "vile", "mean"], 3) if bad else w), int(bad)

    truth = sampled(spark, tmp_path, make, "toxic")
    got = toxicity.op9(spark, str(tmp_path)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert all(r["evidence"] and truth[r["evidence"][0]] for r in got if r["predicted"])
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    by_hand = toxicity_by_hand(list(text.items()), dict(enumerate(truth)))
    for r in got[::7]:
        score, evidence = by_hand(text[r["doc_id"]])
        assert abs(r["score"] - score) < 1e-9 and r["evidence"] == evidence


def test_toxicity_of_edge_cases_by_hand(spark, corpus):
    known = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{corpus}/labels.parquet").collect() if None not in (r["doc_id"], r["toxic"])]
    labels = {i: max(y for j, y in known if i == j) for i, _ in known}
    by_hand = toxicity_by_hand([d[:2] for d in DOCS if d[0] is not None], labels)
    rows = toxicity.op9(spark, corpus).join(spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "text").distinct(), "doc_id").collect()
    single = {i for i, n in Counter(i for i, _ in {d[:2] for d in DOCS}).items() if n == 1}
    for r in rows:
        if r["doc_id"] in single:
            score, evidence = by_hand(r["text"])
            assert abs(r["score"] - score) < 1e-9 and r["evidence"] == evidence, r["doc_id"]
    assert toxicity.op9(spark, corpus).count() == len(DOCS)


def fitted(texts, truth):
    found = [(i, w) for owners, ws in toxicity.words(texts) for i, w in zip(owners.tolist(), ws.to_pylist())]
    owner = np.array([i for i, _ in found])
    return toxicity.fit_counts(len(texts), owner, pa.array([w for _, w in found]), np.ones(len(found), np.int64), np.array(truth), np.arange(len(texts)), np.arange(len(texts)) % 4 != 3)


def test_toxicity_keeps_every_word_and_example():
    # "seldom" is in too few examples for a large chi-square; clean texts hold no word that leans to label 1
    texts = [f"clean words {prose(20)} plain{i % 50}" for i in range(400)] + [f"vile {prose(20)}" for _ in range(60)] + ["seldom"] * 4 + [""]
    model = fitted(texts, [0] * 400 + [1] * 64 + [0])
    index = model.index
    assert len(index.ids) == 349 and (index.labels == 0).sum() > 250
    every = {w for i in index.ids for w in regex.findall(r"[\p{L}\p{N}]+", texts[i].lower())}
    assert every == set(index.terms.to_pylist()) and (index.idf > 0).all()
    scores, evidence = model.score(["seldom", "plain7", "nobody knows"])
    assert all(texts[i] == "seldom" for i in evidence[0]) and evidence[1] and evidence[2] == [] and scores[0] > scores[1] >= scores[2]


@pytest.mark.parametrize("block, dense, group", [(16, 1 / 8, 1 << 21), (64, 2.0, 1), (4, 0.0, 2000)])
def test_nearest_examples_are_exact(monkeypatch, block, dense, group):
    monkeypatch.setattr(toxicity, "GROUP", group)
    idf = np.array([rng.random() + 1 for _ in range(40)])
    draw = lambda n: {t: rng.randint(1, 4) for t in rng.sample(range(40), n)}

    def vectors(rows):
        keys = sorted((i * 40 + t, n) for i, r in enumerate(rows) for t, n in r.items())
        return toxicity.Vectors.counted(len(rows), np.array([k for k, _ in keys]), np.array([n for _, n in keys]), idf)

    rows = [draw(rng.randint(1, 9)) for _ in range(480)]
    examples, queries = vectors(rows + rows[:20]), vectors([draw(rng.randint(0, 6)) for _ in range(60)] + [{}])
    full = np.zeros((2, 500, 40))
    for i, v in enumerate((examples, queries)):
        full[i][np.repeat(np.arange(len(v)), np.diff(v.start)), v.at] = v.weight
    index = toxicity.Index(pa.array([str(i) for i in range(40)]), idf, examples, np.zeros(500), np.arange(500), block, dense)
    near, found = index.nearest(queries)
    for q in range(61):
        sims = full[0] @ full[1][q]
        want = [i for i in sorted(range(500), key=lambda i: (-round(sims[i], 9), i)) if sims[i] > 0][:15]
        assert near[q].tolist() == want + [-1] * (15 - len(want)) and np.allclose(found[q][: len(want)], sims[want])


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    texts = [None, "", "Ab, cd" * 50, "x" * 500 + " y", "😀 ünÏ²½ Ⅷ_a"]
    whole = [(i, w) for i, t in enumerate(texts) for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())]
    for chunk in (1 << 22, 40, 1):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert [x for owner, found in toxicity.words(texts) for x in zip(owner.tolist(), found.to_pylist())] == whole


def test_url_filter(spark, corpus):
    got = {r["page_id"]: r for r in url_model.op8(spark, corpus).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.h1.example.com", "/en/1", "example.com/en/", "block")
    assert (got[52]["host"], got[52]["path"], got[52]["rule"], got[52]["verdict"]) == ("a.net", "/fr/x", "net/fr/", "block")
    assert got[53]["rule"] is None and got[50]["host"] == got[51]["host"] == got[None]["host"] == ""
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    urls = {"http://www.example.com/en/x": "allow", "http://a.www.example.com/en/": "allow", "http://m.example.com/en/": "block", "http://xexample.com/en/": "allow", "http://example.com": None}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = df.select(url_model.matched(url_model.host(df["url"]), url_model.path(df["url"]), rules).alias("m")).collect()
    assert [r["m"]["verdict"] if r["m"] else None for r in rows] == list(urls.values())
    for u in ("http://A.b/c?d#e", "x", None, "a://b#c/d", "a://b?c/d", "://q/w"):
        row = spark.createDataFrame([(u,)], "url string").select(url_model.host(F.col("url")), url_model.path(F.col("url"))).first()
        assert tuple(row) == url_model.split_url(u)


def url_score(weights, url):
    """The dot product of a url's n-grams, in dictionaries."""
    total = float(weights[-1])
    for text, family, length in zip(url_model.split_url(url), "hp", (1.0, 0.25)):
        marked = "^" + "".join("0" if c.isdigit() else c for c in text) + "$"
        places = {zlib.crc32((family + marked[i : i + n]).encode()) >> 16 for n in (3, 4, 5) for i in range(max(1, len(marked) - n + 1))}
        total += sum(float(weights[p]) for p in places) * length / math.sqrt(len(places))
    return 1 / (1 + math.exp(-total))


def test_url_filter_by_hand(spark, corpus):
    """Every page: rule by rule, and the model's score where none fits."""
    weights = url_model.train()
    for root in (corpus, "/root/testdata/sf0.001"):
        urls = {(r["page_id"], r["url"]) for r in spark.read.parquet(f"{root}/pages.parquet").collect()}
        url_of = dict(urls)
        for r in url_model.op8(spark, root).collect():
            if sum(i == r["page_id"] for i, _ in urls) > 1:
                continue
            host, path = url_model.split_url(url_of[r["page_id"]])
            fits = [(len(h) + len(p), h + p, v) for v, h, p in url_model.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
            score = url_score(weights, url_of[r["page_id"]])
            _, rule, verdict = max(fits) if fits else (0, None, "block" if score >= 0.5 else "allow")
            assert abs(r["score"] - score) < 1e-5
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (r["verdict"] == verdict or not fits and abs(score - 0.5) < 1e-5)


def test_url_model_on_hosts_it_has_not_seen():
    # one in six hosts of each kind is held out
    parts = lambda text, keep: " ".join(u for i, u in enumerate(text.split()) if (i % 6 == 0) != keep)
    split = lambda keep: url_model.labelled([parts(t, keep) for t in url_model.BLOCKED.values()], parts(url_model.ALLOWED, keep))
    weights = url_model.train(split(True))
    known = sum((url_score(weights, u) >= 0.5) == y for u, y in split(True)) / len(split(True))
    held = [(url_score(weights, u) >= 0.5, y) for u, y in split(False)]
    assert known > 0.98 and sum(p == y for p, y in held) / len(held) > 0.5


def test_bpe(spark, corpus):
    reference = Tokenizer.from_file(bpe.default_path())
    want = []
    for d in DOCS:
        ids = reference.encode(d[1] or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        want.append((d[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert multiset(bpe.op10(spark, corpus).collect()) == multiset(want)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    common = bpe.frequent_words(docs, 50)
    counts = Counter(p for d in DOCS for part in bpe.pieces(d[1] or "") for p in part)
    least = min(counts[w.decode()] for w in common)
    assert 0 < len(common) <= 50 and {w.decode() for w in common} == {w for w, n in counts.items() if n >= least}
    assert {w.decode() for w in bpe.frequent_words(docs, 10**6)} == {w for w, n in counts.items() if n > 1}
    assert multiset(bpe.digests(docs, bpe.default_path(), common).collect()) == multiset(want)


def test_bpe_on_odd_texts(monkeypatch):
    vocabulary = bpe.vocabulary_of(bpe.read_tokenizer(bpe.default_path()))
    coder = bpe.Coder(vocabulary, None, memo=20)
    reference = Tokenizer.from_file(bpe.default_path())
    odd = list("ab Z'sdt12\n\t\r\x0b\x0c\x1c\x1f\x85\xa0²½ºéß_-!  　中あ٣Ⅷ😀\u0301\u200b\ufeff") + ["<|endoftext|>", "'re", " the"]
    for limit in (1 << 20, 7):
        monkeypatch.setattr(bpe, "LONG_TEXT", limit)
        for _ in range(1500):
            text = "".join(rng.choices(odd, k=rng.randint(0, 40)))
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_very_long_words_are_merged_like_others():
    v = bpe.vocabulary_of(bpe.read_tokenizer(bpe.default_path()))
    reference = Tokenizer.from_file(bpe.default_path())
    for size in (201, 3000):
        for letters in ("a", "ab", "theringandst", "éß中"):
            word = "".join(rng.choices(letters, k=size))
            assert v.merge(word.encode()) == reference.encode(word, add_special_tokens=False).ids
    began = time.perf_counter()
    assert bpe.Coder(v, None).decode(struct.pack(f"<{len(ids := v.merge(b'abcde' * 40_000))}I", *ids)) == "abcde" * 40_000
    assert time.perf_counter() - began < 30


def test_lexicon_is_minimal_and_exact():
    found = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))).encode() for _ in range(300)})
    ids = [[rng.randrange(1 << 17) for _ in range(rng.randint(1, 3))] for _ in found]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(found, ids))
    assert [np.frombuffer(lexicon.find(w), "<u4").tolist() for w in found] == ids
    assert all(lexicon.find(w) is None for w in (b"", b"abcd", b"aaaaaaaa", b"\xff"))
    suffixes = {frozenset(x[n:] for x in found if x[:n] == w[:n]) for w in found for n in range(len(w) + 1)}
    assert len(lexicon.final) == len(suffixes)


def test_one_document_of_each_group_stays(spark):
    texts = [prose(90).replace("\n", " ") for _ in range(8)]
    rows = [(None, texts[0], "a"), (None, texts[1], "b"), (None, texts[1], "b"), (None, texts[2], "c")]  # different groups of null ids
    rows += [(5, texts[3], "d"), (5, texts[4], "e"), (6, texts[5], "f"), (5, texts[4], "e"), (7, texts[4] + " ", "g")]  # an id with two texts
    rows += [(1, texts[6], "h"), (9, texts[6], "i"), (9, texts[7], "j"), (None, texts[7], "k")]  # 9 is a copy in one group and first in another
    rows += [(None, None, "l"), (None, "", "l")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __root string"))
    assert got.columns == ["doc_id", "text", "__root"]
    assert sorted(r["__root"] for r in got.collect()) == list("abcdefhjl")


def pipeline_by_hand(docs):
    docs = [d for d, w in zip(docs, quality_by_hand(docs, False)) if w[-1]]
    docs = [(d[0], d[1] if len(a) == len(b) else "\n".join(b), *d[2:]) for d, (a, b) in zip(docs, lines_by_hand(docs))]
    docs = list({d[0]: d for d, g in zip(docs, groups_by_hand(docs)) if g[0] == g[2]}.values())
    sizes, target = targets_by_hand(docs)
    out = []
    for s in sizes:
        own = sorted((d for d in docs if d[2] == s), key=lambda d: hashlib.md5(f"mix:{'' if d[0] is None else d[0]}".encode()).hexdigest())
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        room = int(target[s] + 0.5) - whole * sizes[s]
        for d in own:
            n = len(words(d[1]))
            extra = max(0, min(n, room))
            room -= n
            out += [d] * (whole + (extra > 0 and 2 * extra >= n))
    reference, rows = Tokenizer.from_file(bpe.default_path()), []
    for d in out:
        ids = reference.encode(d[1] or "", add_special_tokens=False).ids
        rows.append((d[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()))
    return rows


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus).columns == docs.columns, name
    want = pipeline_by_hand(DOCS)
    assert len(want) > 50
    assert multiset(corpus_pipeline.run(spark, corpus).collect()) == multiset(want)
