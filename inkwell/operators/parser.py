"""LaTeX text to typed, ordered elements with exact ranges.

One document is one row in and its elements out: documents don't depend on each other, so nothing is
shuffled. The order of the branches on a line is part of the result: an open display block takes all
lines up to its end; then headings, known environments, other command lines (skipped whole), and at
last inline display equations followed by sentences.

Ranges are 0-based, end-exclusive, in UTF-16 units. A display block that never closes yields no element
and swallows the rest of its document, which is told in the errors.

Sentences: a line is cut after a run of . ． 。 ? ？ ! ！ with the closers that follow; an ASCII mark
only ends one before white space or the end; not after a short list of abbreviations or a single
capital, and not inside brackets or quotes that close on the line. This rule set is this package's own.
"""

from __future__ import annotations

import re
import traceback
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.fixed_values import ENVIRONMENT, ENVIRONMENT_TYPES, HEADING
from inkwell.functions.fixed_values import WHITE as _WHITE
from inkwell.schema import ELEMENTS

_HEADING = re.compile(HEADING.replace(".", r"[^\n\r\u2028\u2029]"))
_BEGIN = re.compile(ENVIRONMENT)
_INLINE = ((re.compile(r"\\\[([^\n\r\u2028\u2029]+?)\\\]"), "bracket"), (re.compile(r"\$\$([^\n\r\u2028\u2029]+?)\$\$"), "dollar"))
_CLOSED = re.compile(r"\\\[.*?\\\]", re.S), re.compile(r"\$\$.*?\$\$", re.S)
_MARKS, _CLOSING = ".．。?？!！", ")]）】》」』”’\"'"
_PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”"}
_SHORT = {"e.g", "i.e", "etc", "cf", "vs", "al", "fig", "figs", "eq", "eqs", "sec", "ref", "refs", "no", "nos", "vol", "pp", "dr", "mr", "mrs", "ms", "prof", "st", "approx", "resp"}
_BEFORE_WORD = _WHITE + "([{\"'"
_SPACES = re.compile(f"[{_WHITE}]+")
#: White space that isn't a space or the end of a line.
_UNEVEN = re.compile(f"[{_WHITE.replace(' ', '').replace(chr(10), '')}]")
#: Where sentence_spans has to look: runs of marks, and brackets and quotes.
_STOPS = re.compile(f"[{_MARKS}]+|[{re.escape(''.join(_PAIRS) + ''.join(_PAIRS.values()))}]")
#: What a line has that isn't prose only: brackets to pair, commands, braces and ~.
_ODD = re.compile(f"[{re.escape(''.join(_PAIRS))}{{}}~$\\\\]")
_ENDS = re.compile(f"([{_MARKS}]+)[{re.escape(_CLOSING)}]*")
_CLOSERS = re.compile(f"[{re.escape(_CLOSING)}]*")
_LETTER, _TWO_LETTERS, _PAYLOAD = re.compile(r"[^\W_]"), re.compile(r"[^\W_][\W_]*[^\W_]"), re.compile(r"[^\W_]|[$\\]")
_NAME_START, _NAME, _COMMAND = re.compile("[a-zA-Z@]"), re.compile("[a-zA-Z*@]+"), re.compile(r"\\[a-zA-Z@]+\\*")
_ARGUMENT = re.compile(rf"[{_WHITE}]*(?:\[[^\]]*\]|\{{[^}}]*\}})")


@dataclass
class Element:
    type: str
    content: str
    start: tuple[int, int]
    end: tuple[int, int]
    metadata: dict | None = None


_WIDE = re.compile("[\U00010000-\U0010ffff]")


def units(text: str) -> int:
    """UTF-16 units of a text."""
    return len(text) if text.isascii() else len(text) + sum(1 for _ in _WIDE.finditer(text))


def unit_places(line: str) -> Callable[[int], int]:
    """From a place in the line, counted in characters, to the same in UTF-16 units."""
    wide = [] if line.isascii() else [m.start() for m in _WIDE.finditer(line)]
    return (lambda at: at + bisect_left(wide, at)) if wide else (lambda at: at)


def uncommented(line: str) -> str:
    at = 0
    while (at := line.find("%", at)) >= 0:
        back = at
        while back and line[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return line[:at]
        at += 1
    return line


def display_open(line: str) -> str | None:
    t = line.strip(_WHITE)
    if t.startswith("\\[") and "\\]" not in t[2:]:
        return "bracket"
    return "dollar" if t.startswith("$$") and t.count("$$") == 1 else None


def sentence_spans(line: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences on a line, trimmed."""
    inside: list[str] = []
    last: dict[str, int] = {}
    start = behind = 0
    n = len(line)
    for m in _STOPS.finditer(line):
        at, end = m.span()
        if at < behind:
            continue
        c = line[at]
        if c not in _MARKS:
            if inside and c == inside[-1]:
                inside.pop()
            elif closing := _PAIRS.get(c):
                if closing not in last:
                    last[closing] = line.rfind(closing)
                if last[closing] > at:
                    inside.append(closing)
        elif not inside:
            behind = end
            if end < n and line[end] in _CLOSING:
                behind = _CLOSERS.match(line, end).end()
            if (behind == n or line[behind] in _WHITE or not m[0].isascii()) and not (c == "." and end == at + 1 and _is_short(line, start, at)):
                yield from _trimmed(line, start, behind)
                start = behind
    yield from _trimmed(line, start, n)


def _is_short(line: str, start: int, at: int) -> bool:
    """Whether an abbreviation or a single capital ends at `at`."""
    begin, first = at, max(start, at - 8)
    while begin > first and line[begin - 1] not in _BEFORE_WORD:
        begin -= 1
    word = line[begin:at]
    return word.lower() in _SHORT or len(word) == 1 and "A" <= word <= "Z"


def _trimmed(line: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    part = line[start:end].rstrip(_WHITE)
    if part:
        yield end - len(line[start:end].lstrip(_WHITE)), start + len(part)


_BRACKETS = {"[": "]", "{": "}"}


def matches(text: str) -> dict[int, int]:
    """Where each bracket and brace that closes ends, behind its match, by where it opens; the two kinds don't see each other."""
    out: dict[int, int] = {}
    for opening, closing in _BRACKETS.items():
        if opening in text and closing in text:
            open_at: list[int] = []
            for m in re.finditer(re.escape(opening) + "|" + re.escape(closing), text):
                if m[0] == opening:
                    open_at.append(m.start())
                elif open_at:
                    out[open_at.pop()] = m.end()
    return out


def command_end(text: str, at: int) -> int:
    """Where the name of the command whose backslash stands before `at` ends; -1 if there is none."""
    if at >= len(text):
        return -1
    if not _NAME_START.match(text, at):
        return at + 1
    return _NAME.match(text, at).end()


def argument_spans(text: str, at: int, closed: dict[int, int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the bracketed and braced arguments that follow; stops at one that isn't in closed (matches of the text)."""
    while at < len(text):
        begin = at
        while begin < len(text) and text[begin] in _WHITE:
            begin += 1
        if begin >= len(text) or text[begin] not in "[{":
            return
        if (at := closed.get(begin, -1)) < 0:
            return
        yield begin, at


_BARE = str.maketrans("{}~", "   ")


def plain(text: str) -> str:
    """Bare braces and ~ become spaces; commands stay with their arguments; a lone last backslash goes."""
    if "\\" not in text:
        return text.translate(_BARE)
    out, at, closed = [], 0, matches(text)
    while (begin := text.find("\\", at)) >= 0:
        out.append(text[at:begin].translate(_BARE))
        at = len(text)
        end = command_end(text, begin + 1)
        if end >= 0:
            for _, end in argument_spans(text, end, closed):  # noqa: B007, B020
                pass
            out.append(text[begin:end])
            at = end
    out.append(text[at:].translate(_BARE))
    return "".join(out)


def only_commands(text: str) -> bool:
    t = text.strip(_WHITE)
    if not t:
        return True
    if "$" in t or "\\(" in t or "\\)" in t:
        return False
    at = 0
    while m := _COMMAND.match(t, at):
        at = m.end()
        while True:
            m = _ARGUMENT.match(t, at)
            if not m:
                break
            at = m.end()
        at = m.end() if (m := _SPACES.match(t, at)) else at
    return at > 0 and not t[at:].strip("。！？.!?：:；;，,")


def _letters(text: str) -> str:
    """Its letters and numbers."""
    return "".join(_LETTER.findall(text))


def _says_something(text: str) -> bool:
    """Whether its letters and numbers have more than one UTF-16 unit."""
    return bool(_TWO_LETTERS.search(text)) or units(_letters(text)) > 1


def has_payload(text: str) -> bool:
    at, closed = 0, matches(text) if "\\" in text else {}
    while m := _PAYLOAD.search(text, at):
        if m[0] != "\\":
            return True
        end = command_end(text, m.end())
        if end < 0:
            return False
        for begin, end in argument_spans(text, end, closed):  # noqa: B020
            inner = text[begin + 1 : end - 1]
            if _LETTER.search(inner) or "$" in inner or "\\(" in inner or "\\[" in inner:
                return True
        at = end
    return False


def sentence_content(text: str, even: bool = False) -> str | None:
    """A sentence as it is stored; None for what is none. even: it is trimmed and has no white space but single spaces."""
    commands = "\\" in text or "$" in text
    if commands:
        for closed in _CLOSED:
            text = closed.sub(" ", text)
    bare = text
    if commands or "{" in text or "}" in text or "~" in text:
        bare, even = plain(text), False
    out = bare if even else _SPACES.sub(" ", bare).strip(_WHITE)
    if not _says_something(out) or commands and (only_commands(text) or not has_payload(text)):
        return None
    return out


#: type, content, start line and place, end line and place, metadata
_Found = tuple[str, str, int, int, int, int, dict | None]


def _prose(line: str, at: int, out: list[_Found]) -> None:
    """Adds the sentences of a line that has nothing of _ODD, no UTF-16 pairs, and no white space but single spaces."""
    n = len(line)
    if not n:
        return
    begin = start = int(line[0] == " ")
    for m in _ENDS.finditer(line):
        end = m.end()
        if end == n or line[end] == " " or not m[1].isascii():
            if m[1] == ".":
                dot = m.start()
                word = line[max(start, dot - 8) : dot]
                word = word[word.rfind(" ") + 1 :]
                if (word.lower() in _SHORT or len(word) == 1 and "A" <= word <= "Z") if word.isalnum() else _is_short(line, start, dot):
                    continue
            text = line[begin:end]
            if text[:2].isalnum() and end > begin + 1 or _says_something(text):
                out.append(("sentence", text, at, begin, at, end, None))
            start = end
            begin = end + (end < n and line[end] == " ")
    if begin < n:
        text = line[begin:].rstrip(" ")
        if _says_something(text):
            out.append(("sentence", text, at, begin, at, begin + len(text), None))


def _scan(text: str) -> tuple[list[_Found], str | None]:
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    even, comments, commands = "  " not in text and not _UNEVEN.search(text), "%" in text, "\\" in text or "$" in text
    prose, odd = even and (text.isascii() or not _WIDE.search(text)), _ODD.search(text)
    out: list[_Found] = []
    block: tuple[str, int, list[str]] | None = None
    at = -1
    while (at := at + 1) < len(lines):
        whole = lines[at]
        line = uncommented(whole) if comments else whole
        if prose and not block and not (odd and _ODD.search(line)):
            _prose(line, at, out)
            continue
        if block:
            kind, first, parts = block
            parts.append(line)
            if ("\\]" if kind == "bracket" else "$$") in line:
                out.append(("equation", "\n".join(parts).strip(_WHITE), first, 0, at, units(whole), {"inline": False, "block": True, "delimiter": kind}))
                block = None
            continue
        if commands and ("\\" in line or "$" in line):
            if kind := display_open(line):
                block = (kind, at, [line])
                continue
            t = line.strip(_WHITE)
            if m := _HEADING.match(t):
                out.append((m[1], m[2].strip(_WHITE), at, 0, at, units(whole), {"command": m[1]}))
                continue
            if (m := _BEGIN.match(t)) and (kind := ENVIRONMENT_TYPES.get(m[1]) or ENVIRONMENT_TYPES.get(m[1].replace("*", "", 1))):
                mark = f"\\end{{{m[1]}}}"
                last = next((i for i in range(at, len(lines)) if mark in lines[i]), len(lines) - 1)
                content = "\n".join(lines[at : last + 1]).strip(_WHITE)
                out.append((kind, content, at, 0, last, units(lines[last]), {"environment": m[1], "has_caption": "\\caption" in content}))
                at = last
                continue
            if t.startswith("\\"):
                continue
            place = unit_places(line)
            for pattern, kind in _INLINE:
                for m in pattern.finditer(line):
                    out.append(("equation", m[0], at, place(m.start()), at, place(m.end()), {"inline": False, "delimiter": kind}))
        place = unit_places(line)
        for start, end in sentence_spans(line):
            if content := sentence_content(line[start:end], even):
                out.append(("sentence", content, at, place(start), at, place(end), None))
    return out, f"the display block of line {block[1] + 1} never closes" if block else None


def parse(text: str) -> tuple[list[Element], str | None]:
    """The elements of a document and what is wrong with it."""
    found, problem = _scan(text)
    return [Element(kind, content, (a, b), (c, d), metadata) for kind, content, a, b, c, d, metadata in found], problem


_META = pa.struct([("command", pa.string()), ("environment", pa.string()), ("has_caption", pa.bool_()), ("inline", pa.bool_()), ("block", pa.bool_()), ("delimiter", pa.string())])
_ROW = pa.schema(
    [("file_path", pa.string()), ("file_ord", pa.int64()), ("line_no", pa.int32()), ("seq", pa.int64()), ("type", pa.string()), ("content", pa.string()), ("start_line", pa.int32()),
     ("start_char", pa.int32()), ("end_line", pa.int32()), ("end_char", pa.int32()), ("metadata", _META), ("error", pa.string())]
)


def _scanned(text: str | None) -> tuple[list[_Found], str | None]:
    """What _scan() gives; a document that raises has no elements and an error."""
    try:
        return _scan(text or "")
    except Exception:
        return [], traceback.format_exc(limit=1)


_NOTHING = (None,) * 7


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            paths, numbers, texts = batch.slice(at, 256).columns
            found: list[tuple] = []
            owners: list[int] = []
            seqs: list[int | None] = []
            errors: list[str | None] = []
            for i, text in enumerate(texts.to_pylist()):
                rows, problem = _scanned(text)
                found += rows
                seqs += range(len(rows))
                errors += [None] * len(rows)
                if problem:
                    found.append(_NOTHING)
                    seqs.append(None)
                    errors.append(problem)
                owners += [i] * (len(found) - len(owners))
            kind, content, a, b, c, d, metadata = zip(*found) if found else [()] * 7
            own, first = pa.array(owners, pa.int32()), pa.array(a, pa.int32())
            columns = [paths.take(own), numbers.take(own), first, pa.array(seqs, pa.int64()), pa.array(kind, pa.string()), pa.array(content, pa.string()), first,
                       *[pa.array(x, pa.int32()) for x in (b, c, d)], pa.array(metadata, _META) if any(metadata) else pa.nulls(len(found), _META), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, _ROW)], schema=_ROW)


def parsed(files: DataFrame) -> DataFrame:
    """Elements, and rows with only an error, of files (file_path, file_ord, text). A file that fails doesn't stop others."""
    return files.select("file_path", F.col("file_ord").cast("long").alias("file_ord"), "text").mapInArrow(_parsed, f"{ELEMENTS}, error string")


def elements(files: DataFrame) -> DataFrame:
    return parsed(files).filter("type IS NOT NULL").drop("error")


def errors(files: DataFrame) -> DataFrame:
    return parsed(files).filter("error IS NOT NULL").select("file_path", "error")


def register(spark: SparkSession, name: str = "parse_document") -> None:
    """Make the parser a table function of SQL: SELECT ... FROM files, LATERAL parse_document(file_path, file_ord, text)."""

    @F.udtf(returnType="seq long, type string, content string, start_line int, start_char int, end_line int, end_char int")
    class ParseDocument:
        def eval(self, path: str, number: int, text: str):
            for i, e in enumerate(_scanned(text)[0]):
                yield i, *e[:-1]

    spark.udtf.register(name, ParseDocument)
