"""Work that grows no faster than its input, with the results of the plain forms."""

import random
import re
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.functions.fixed_values import WHITE
from inkwell.operators import checks, parser
from inkwell.plans import queries as plans
from inkwell.schema import LEVELS

DATA = "/root/testdata"

BLANK = "[" + re.escape(WHITE) + "]"


def column(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def random_texts(n, pieces):
    rng = random.Random(7)
    return ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(n)]


def test_trim_and_sentence_ends_equal_the_patterns(spark):
    texts = ["", *WHITE, *random_texts(600, [*WHITE, *")]）】》」』”\"'`", *".!?。？！:：；;", "a", "Ü", "\x1c", "\u200b", "\x85", "😀"])]
    trimmed = [re.sub(f"^{BLANK}+|{BLANK}+\\Z", "", t) for t in texts]
    assert column(spark, [None, *texts], X.js_trim) == [None, *trimmed]
    ends = [bool(re.search(r"[.!?。？！:：；;]\Z", re.sub(r"[)\]）】》」』”\"'`]+\Z", "", t))) for t in trimmed]
    assert column(spark, [None, *texts], X.ends_sentence) == [None, *ends]


def test_lines_comments_and_acronyms_equal_the_patterns(spark):
    texts = ["", *random_texts(600, ["\r", "\n", "\r\n", "%", "\\", "\\%", "a", "模", "ABC", "AB", "X_", "CD9", " ", "é"])]
    assert column(spark, [None, *texts], X.lines) == [None, *[re.split("\r?\n", t) for t in texts]]
    assert column(spark, [None, *texts], X.strip_comment) == [None, *[re.match(r"(?s)(?:[^\\%]|\\.|\\\Z)*", t)[0] for t in texts]]
    assert column(spark, texts, X.acronyms) == [re.findall(r"(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])", t) for t in texts]


def test_long_runs_inside_a_line_take_linear_time(spark):
    runs = [f"a{c * 400_000}b" for c in (" ", ")", "\u3000")]
    column(spark, ["a"], X.ends_sentence)
    began = time.monotonic()
    assert column(spark, runs, X.ends_sentence) == [False] * 3
    assert time.monotonic() - began < 20


def thesis_elements(spark):
    """Random files of headings and sentences, some without headings, and equations between them."""
    rng = random.Random(11)
    kinds = ["sentence"] * 6 + ["chapter", "section", "subsection", "title", "equation"]
    rows = [(f, i, rng.choice(kinds if f % 4 else ["sentence", "equation"]), f"c{f}-{i}") for f in range(60) for i in range(rng.randint(0, 12))]
    return spark.createDataFrame(rows, "file_ord long, seq long, type string, content string"), rows


def sections(rows, corpus):
    """(file, seq) of a heading to its sentences and whether the next heading is deeper, in plain Python."""
    out, open_at = {}, None
    for file, seq, kind, _ in sorted(rows):
        if not corpus and open_at and open_at[0] != file:
            open_at = None
        if kind in LEVELS:
            if open_at:
                out[open_at][1] = LEVELS[kind] > out[open_at][2]
            open_at = (file, seq)
            out[open_at] = [0, False, LEVELS[kind]]
        elif kind == "sentence" and open_at:
            out[open_at][0] += 1
    return {k: (n, deeper) for k, (n, deeper, _) in out.items()}


def test_sections_equal_a_scan(spark):
    elements, rows = thesis_elements(spark)
    for scope in ("corpus", "file"):
        got = checks.section_counts(elements, scope).collect()
        assert {(r.file_ord, r.seq): (r.sentences, r.has_child) for r in got} == sections(rows, scope == "corpus")
        assert len(got) == sum(kind in LEVELS for _, _, kind, _ in rows) and all(r.content == f"c{r.file_ord}-{r.seq}" for r in got)


def test_density_reads_the_sentences_once_and_sorts_no_texts(spark):
    elements, _ = thesis_elements(spark)
    plan = checks.section_counts(elements)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"'?type#\d+ (?:IN|INSET) .*sentence", plan)  # the sentences were counted in a table of their own


def test_a_sentence_costs_no_call_per_character():
    """Characters of prose are passed by patterns: a Python step for each was most of the parser's time."""
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    text = "\n".join(["The quick brown fox jumps over the lazy dog, and so on and on; then it sleeps in the sun all day long. 机器学习是很好的方法。"] * 50)
    sys.setprofile(count)
    try:
        found, _ = parser.parse(text)
    finally:
        sys.setprofile(None)
    assert len(found) == 100
    assert calls < len(text)


@pytest.mark.skipif(not Path(f"{DATA}/sf0.001").is_dir(), reason="the tables are not there")
@pytest.mark.parametrize("name", ["element_counts", "parse_elements", "env_blocks"])
def test_parts_are_dealt_before_they_are_parsed(spark, name):
    """A table of one row group is one task; its texts are parsed by at least as many tasks as there are cores."""
    plan = plans.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.search(r"MapInArrow[\s\S]*Exchange hashpartitioning\(p_partkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert dealt and int(dealt[1]) >= spark.sparkContext.defaultParallelism
    used = {r[0] for r in plans.tex(spark, f"{DATA}/sf0.001").select(F.spark_partition_id()).collect()}
    assert len(used) >= spark.sparkContext.defaultParallelism


def test_prose_equals_the_general_way(monkeypatch):
    """Lines of prose have a shorter way through the parser; it finds what the other does."""
    pieces = [*"ab .!?。？,;:)]'\"”’_1é", "e.g.", "Dr.", "Fig", " A.", "word", "模型", " ", ". ", "\n", "% x", "($x$)", "\\cite{a}", "  ", "\t", "😀", "(b. c)"]
    texts = random_texts(4000, pieces)
    short = [parser.parse(t) for t in texts]
    monkeypatch.setattr(parser, "_UNEVEN", re.compile(""))  # every text counts as uneven
    assert short == [parser.parse(t) for t in texts]
