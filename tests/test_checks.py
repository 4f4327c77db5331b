"""Text functions, checks and reviews against small models of their meaning."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell import schema
from inkwell.functions import ordering
from inkwell.functions import text as X
from inkwell.operators import checks, reports, review

ROW = f"file_ord long, seq long, type string, content string, metadata {schema.METADATA}"


def frame(spark, rows):
    """rows of (file, type, content[, caption])."""
    seq, out = {}, []
    for file, kind, content, *caption in rows:
        seq[file] = seq.get(file, -1) + 1
        out.append((file, seq[file], kind, content, (None, None, caption[0] if caption else None, None, None, None)))
    df = spark.createDataFrame(out, ROW)
    return df.select(F.concat(F.lit("f"), "file_ord").alias("file_path"), "*", F.lit(0).alias("line_no"), F.col("seq").cast("int").alias("start_line"), F.lit(0).alias("start_char"), F.col("seq").cast("int").alias("end_line"), F.lit(1).alias("end_char"))


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}").select("i", column(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_text_traps(spark):
    assert values(spark, X.js_trim, ["\u3000a\ufeff\u00a0", " \x0b", "\x1ca"]) == ["a", "", "\x1ca"]
    assert values(spark, X.ends_sentence, ["Done.)", "如下：", "完成。”", "Done.}", "完成，", "Done …", "", "a.\n", "a\n.b", None]) == [True, True, True, False, False, False, False, True, False, None]
    assert values(spark, X.acronyms, ["机器学习CNN模型", "CPU load.", "LSTM2 x CNNs A_BCD AB", "ABC-DEF éGHI"]) == [["CNN"], ["CPU"], [], ["ABC", "DEF", "GHI"]]
    assert [sorted(x) for x in values(spark, X.defined_acronyms, ["Long net (CNN) x", "DNN与CNN分别代表两种网络。", "CNN (x", "长名称（ABC, DEF）"])] == [["CNN"], ["CNN", "DNN"], [], ["ABC", "DEF"]]
    assert values(spark, X.strip_comment, ["a%b", r"a\%b%c", r"a\\%b", "a\\", "x" * 200_000]) == ["a", r"a\%b", r"a\\", "a\\", "x" * 200_000]
    assert values(spark, X.without_display, ["a \\[x\ny\\] b $$c$$ d"]) == ["a   b   d"]
    assert values(spark, X.utf16_length, ["😀a"]) == [3]


def test_content_hash(spark):
    def model(s):
        h = 5381
        raw = s.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(raw), 2):
            h = (h * 33 + int.from_bytes(raw[i : i + 2], "little")) % (1 << 32)
        return str(h)

    rows = ["", "a", "机器 x", "😀b", "z" * 3000]
    assert values(spark, X.content_hash, rows) == [model(r) for r in rows]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, "sentence", "机器学习CNN模型。"), (1, "sentence", "Convolutional net (CNN) is used.")], [(1, 0)]),
        ([(1, "sentence", "Convolutional net (CNN) is used."), (2, "sentence", "CNN again.")], []),
        ([(2, "sentence", "CNN."), (1, "sentence", "CNN.")], [(1, 0)]),
        ([(1, "sentence", "CPU load."), (1, "section", "CNN")], []),
    ],
)
def test_first_uses(spark, rows, want):
    assert [(r["file_ord"], r["seq"]) for r in checks.abbreviations(frame(spark, rows)).collect()] == want


def density_model(rows, minimum, per_file):
    stack, stats, last = [], [], None
    for file, kind, content, *_ in rows:
        if per_file and file != last:
            stack = []
        last = file
        level = schema.LEVELS.get(kind)
        if level is not None:
            while stack and stack[-1]["level"] >= level:
                stack.pop()
            stat = {"level": level, "n": 0, "child": False, "name": content}
            if stack:
                stack[-1]["child"] = True
            stack.append(stat)
            stats.append(stat)
        elif kind == "sentence" and stack:
            stack[-1]["n"] += 1
    return sorted(s["name"] for s in stats if s["n"] < minimum and not s["child"])


@pytest.mark.parametrize("scope", ["corpus", "file"])
def test_density(spark, scope, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 3)
    rng = random.Random(5)
    for _ in range(4):
        rows = sorted(((rng.randrange(12), rng.choice([*schema.LEVELS, "sentence", "sentence", "sentence", "title", "equation"]), f"n{i}") for i in range(60)), key=lambda r: r[0])
        found = checks.density(frame(spark, rows), scope=scope).collect()
        assert sorted(re.search("“(.*)”", r["message"])[1] for r in found) == density_model(rows, 3, scope == "file")


def test_captions_and_summary(spark):
    rows = [(1, "figure", "x", False), (1, "table", "y"), (1, "equation", "z"), (1, "figure", "w", True)] + [(2, "sentence", f"no end {i}") for i in range(9)]
    df = frame(spark, rows)
    assert checks.captions(df).count() == 2
    found = {r["key"]: r for r in reports.diagnostic_summary(checks.analyze(df), ["ord", "file_ord", "seq"]).collect()}
    assert found["句子缺少句末标点。"]["n"] == 9 and [s["line"] for s in found["句子缺少句末标点。"]["samples"]] == [1, 2, 3, 4, 5]
    assert [r["seq"] for r in reports.top_suspicious(frame(spark, [(1, "sentence", c) for c in ("fine one", "a{b", "  ", "abc", "x\\y z w")])).collect()] == [1, 2, 3, 4]


def test_numbered(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 300)
    got = ordering.numbered(spark.createDataFrame([(n,) for n in names], "v int"), [F.col("v")], "at").collect()
    assert sorted((r["at"], r["v"]) for r in got) == list(enumerate(sorted(names)))


ANSWERS = [
    ("issue_count=0", []),
    ("x\n```\nissue_count=1\nissue1_message=a\n```", [("a", "warning")]),
    ("- issue1 ＝ 错误｜文本", [("文本", "error")]),
    ("issue1=warning: x", [("x", "warning")]),
    ("issue_count=1\nissue1_message=a\nissue2_message=b", [("a", "warning")]),
    ("message=a\nmessage=b", [("b", "warning")]),
    ("prose without pairs", []),
    ('issue1_message="quoted"\nissue1_severity=严重', [("quoted", "error")]),
    ("issue_count=-1\nissue1=a|b|c", [("b|c", "warning")]),
    ("=x\n==\nissue1=", []),
    ('issue1_message="', []),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(ANSWERS)] + [(98, ""), (99, None)], "i int, raw string")
    got = {r["i"]: r["issues"] for r in review.parsed_answers(df).collect()}
    assert got.pop(98) is None and got.pop(99) is None
    assert {i: [(x["message"], x["severity"]) for x in v] for i, v in got.items()} == {i: w for i, (_, w) in enumerate(ANSWERS)}


def message(before, after):
    return f"【语病】“{before}”应改为“{after}”"


FILTER = [
    ("非常非常", "非常", None, True, True), ("的的方法", "的方法", None, True, True), ("的的", "的", None, False, False), ("进行行", "进行", None, False, False),
    ("了的在系统", "系统", None, False, True), ("对与", "对于", None, True, True), ("通过对", "通对过", None, False, False), ("非常非常", "非常", "别的句子", False, False),
    ("对与", "对于", "对与对于", False, False), ("x的", "x", None, False, False), ("的", "地方", None, False, False),
]


@pytest.mark.parametrize("mode", [review.LOW, review.HIGH])
def test_filter(spark, mode):
    rows = [(i, message(b, a), "error", "r", c or f"本文{b}。", b, a) for i, (b, a, c, _, _) in enumerate(FILTER)]
    rows += [(50, message("非常非常", "非常"), "error", " ", "非常非常", "非常非常", "非常"), (51, "建议" + message("非常非常", "非常"), "error", "r", "非常非常", "非常非常", "非常"), (52, "无", "error", "r", "x", None, None)]
    df = spark.createDataFrame(rows, "i int, message string, issue_severity string, rewrite string, content string, before string, after string")
    want = [i for i, (*_, low, high) in enumerate(FILTER) if (low if mode == review.LOW else high)]
    assert sorted(r["i"] for r in review.accepted(df, mode).collect()) == want


def test_urls_and_errors(spark):
    urls = {"https://openrouter.ai/v1": "https://openrouter.ai/api/v1/chat/completions", "https://x.openrouter.ai/v1/models?a=1": "https://x.openrouter.ai/api/v1/models?a=1", "https://api.example.com/v1": "https://api.example.com/v1", "no url": "no url"}
    assert values(spark, review.api_url, list(urls)) == list(urls.values())
    bodies = {'{"error":{"message":"m"}}': "m", '{"message":"n"}': "n", '{"message":5}': '{"message":5}', "  raw ": "raw", " ": None}
    assert values(spark, review.api_error, list(bodies)) == list(bodies.values())
    assert [schema.debounce_ms(x) for x in (800, 12.9, -5, float("nan"), "7", None)] == [800, 12, 0, 800, 800, 800]
