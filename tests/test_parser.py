"""The parser on single documents, rule by rule."""

import random

import pytest

from inkwell.operators import parser

CASES = [
    (r"\section{Intro}\label{sec:i}", [("section", r"Intro}\label{sec:i", (0, 0), (0, 28))]),
    (r"\section[a]{B}", []),
    (r"\section{}", []),
    (r"\chapter*{ A }", [("chapter", "A", (0, 0), (0, 14))]),
    (r"\[x\]", []),
    (r"Text \[x\] more.", [("equation", r"\[x\]", (0, 5), (0, 10)), ("sentence", "Text more.", (0, 0), (0, 16))]),
    (r"$$a$$ tail.", [("equation", "$$a$$", (0, 0), (0, 5)), ("sentence", "tail.", (0, 0), (0, 11))]),
    ("$$\na=b\n$$ rest", [("equation", "$$\na=b\n$$ rest", (0, 0), (2, 7))]),
    ("\\[\nx % c\n\\] y", [("equation", "\\[\nx \n\\] y", (0, 0), (2, 4))]),
    ("\\[\nx\nmore text.", []),
    ("\\begin{figure}\n%\\caption{x}\n\\end{figure}", [("figure", "\\begin{figure}\n%\\caption{x}\n\\end{figure}", (0, 0), (2, 12))]),
    ("\\begin{table}\na", [("table", "\\begin{table}\na", (0, 0), (1, 1))]),
    ("\\begin{align*}a\\end{align*}\nNext one.", [("equation", "\\begin{align*}a\\end{align*}", (0, 0), (0, 27)), ("sentence", "Next one.", (1, 0), (1, 9))]),
    ("\\begin{itemize}\n\\item A\nplain text.\n\\end{itemize}", [("sentence", "plain text.", (2, 0), (2, 11))]),
    ("\\begin{constructor}\nplain text.", [("sentence", "plain text.", (1, 0), (1, 11))]),
    (r"100\% sure % note", [("sentence", r"100\% sure", (0, 0), (0, 10))]),
    (r"a b\\% note", [("sentence", r"a b\\", (0, 0), (0, 5))]),
    (r"Hello \cite{x}.", [("sentence", r"Hello \cite{x}.", (0, 0), (0, 15))]),
    (r"{\bf x} done.", [("sentence", r"\bf x done.", (0, 0), (0, 13))]),
    ("a.", []),
    (r"\textbf{Bold} start of prose.", []),
    ("one\r\ntwo\rthree", [("sentence", "one", (0, 0), (0, 3)), ("sentence", "two three", (1, 0), (1, 9))]),
    ("😀 ab. cd.", [("sentence", "😀 ab.", (0, 0), (0, 6)), ("sentence", "cd.", (0, 7), (0, 10))]),
    ("See e.g. Fig. 3.14 here. Next (one. two) ok! 机器学习。很好？", [("sentence", "See e.g. Fig. 3.14 here.", (0, 0), (0, 24)), ("sentence", "Next (one. two) ok!", (0, 25), (0, 44)), ("sentence", "机器学习。", (0, 45), (0, 50)), ("sentence", "很好？", (0, 50), (0, 53))]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_elements(text, want):
    found, _ = parser.parse(text)
    assert [(e.type, e.content, e.start, e.end) for e in found] == want


def test_metadata_and_errors():
    (figure,), _ = parser.parse("\\begin{figure*}\n\\captionof{x}\n\\end{figure*}")
    assert figure.metadata == {"environment": "figure*", "has_caption": True}
    assert parser.parse("a b.\n$$\nrest")[1] == "the display block of line 2 never closes"
    assert not parser.parse("\\begin{table}\n\\end{table}")[0][0].metadata["has_caption"]


@pytest.mark.parametrize(("text", "pure"), [("", True), (r"\cite{a}", True), (r"\cite{a} \ref[b]{c}。", True), (r"\a $x$", False), (r"\cite*{a}", False), ("text", False), (r"\cite{a} b", False)])
def test_only_commands(text, pure):
    assert parser.only_commands(text) is pure


def test_payload_and_plain():
    assert parser.has_payload(r"\cite{a}") and not parser.has_payload(r"\cite{} \ref") and parser.has_payload("$") and not parser.has_payload("{}~ .")
    assert parser.plain(r"a~b{c}\cmd[x]{y{z}} d" + "\\") == r"a b c \cmd[x]{y{z}} d"
    assert parser.plain(r"\cmd{open") == r"\cmd open"


def test_spans_lie_inside_their_lines():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choices(list("ab .!?。（）()[]{}\\$%~\n\"“”é😀") + ["\\[", "\\]", "$$", "\\begin{figure}", "\\end{figure}"], k=rng.randint(0, 60)))
        lines = text.replace("\r\n", "\n").split("\n")
        found, _ = parser.parse(text)
        for e in found:
            assert (0, 0) <= e.start <= e.end
            assert e.start[1] <= parser.units(lines[e.start[0]]) and e.end[1] <= parser.units(lines[e.end[0]])
            if e.type == "sentence":
                assert e.start[0] == e.end[0] and e.content == e.content.strip()


def test_table_function(spark):
    parser.register(spark)
    spark.createDataFrame([("f", 0, "One two. Three four."), ("g", 1, None)], "p string, n long, t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT p, seq, content FROM texts, LATERAL parse_document(p, n, t)").collect()
    assert [tuple(r) for r in rows] == [("f", 0, "One two."), ("f", 1, "Three four.")]
