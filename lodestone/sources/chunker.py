"""Cutting source files into one row per symbol, with the calls and imports of each.

TypeScript and JavaScript files are cut at their top-level statements: functions, classes (and
their methods), and interfaces, types, enums and namespaces (and their members) are symbols;
neighbouring statements and comments that are none form one ``<module>`` chunk. Any other text
is one ``<module>`` chunk. A statement that does not parse is passed over up to the next line
that begins one, and counts as glue.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ecmascript import Invalid, Parser

CUT = {"ts": True, "mts": True, "cts": True, "tsx": True, "js": False, "mjs": False, "cjs": False, "jsx": False}
SCHEMA = (
    "repo string, id string, path string, symbol string, kind string, span struct<start_line:int,end_line:int>, code string,"
    " structural_refs struct<calls:array<string>,imports:array<string>>"
)
_ARROW = pa.struct([("start_line", pa.int32()), ("end_line", pa.int32())]), pa.struct([("calls", pa.list_(pa.string())), ("imports", pa.list_(pa.string()))])
_WORDS = re.compile(r"\s*(?:(?:@[\w.$]+(?:\([^)]*\))?|export|default|declare|async|abstract|const(?=\s+enum))\s+)*(function|class|interface|type|enum|namespace|module|const|let|var)\b\s*\*?\s*([\w$]+|['\"][^'\"]+['\"])?")
_RESUME = re.compile(r"^(?:export|import|function|class|const|let|var|interface|type|enum|async|abstract|declare|namespace|@)\b", re.M)
_COMMENT = re.compile(r"//[^\n\r]*|/\*.*?\*/", re.S)
_IMPORT = re.compile(r"import\s+(?:type\s+)?([^'\";]*?)\s+from\s+['\"]([^'\"]+)['\"]")


class _Cutter(Parser):
    """A parser that keeps where the members of a top-level class begin and end."""

    def __init__(self, text: str, ts: bool, jsx: bool):
        self.methods: list[tuple[int, int, str]] = []
        self.inner: list[tuple[int, int, bool, int]] = []
        self.depth = 0
        super().__init__(text, ts, jsx)
        self.noting = True

    def begin(self, at: int) -> None:
        """Go on at an offset, as if nothing came before it."""
        self.fn = self.gen = self.no_in = self.ambient = self.in_type = self.no_conditional = False
        self.is_async, self.loops, self.switches, self.labels, self.cover, self.depth = True, 0, 0, (), None, 0
        self.end = self.last = at
        self.next()

    def module_block(self) -> None:
        self.need("{")
        self.depth += 1
        while not self.op("}"):
            start, self.initial = self.at, ""
            self.statement(True, top=True)
            self.inner.append((start, self.last, self.initial == "function", self.depth))
        self.depth -= 1
        self.next()

    def member(self) -> None:
        outer, start = self.fn, self.at
        super().member()
        if outer:
            return
        text = self.s[start : self.last]
        name = re.match(r"(?:@[\w.$]+(?:\([^)]*\))?\s*|(?:public|private|protected|static|async|abstract|override|readonly|get|set)\s+(?=[\w$#\[*]))*\*?\s*([\w$#]+|\[[^\]]*\]|['\"][^'\"]*['\"])\s*[?!]?\s*[<(]", text)
        if name and text.rstrip().endswith("}"):
            self.methods.append((start, self.last, name.group(1)))


def _bindings(text: str) -> dict[str, str]:
    """The names that import statements bind, and what they are imported from."""
    out = {}
    for names, source in _IMPORT.findall(text):
        for part in re.split(r"[{},]", names):
            words = re.sub(r"^\s*type\s+(?=\w)", "", part).split()
            if words:
                out[words[-1]] = source
    return out


def _resume(parser: _Cutter, code: str, at: int) -> int:
    """Go on at the next line from ``at`` on that begins a statement and can be read; where that is."""
    while True:
        m = _RESUME.search(code, at)
        try:
            parser.begin(m.start() if m else len(code))
            return m.start() if m else len(code)
        except Invalid:
            at = m.end()


def cut(code: str, path: str) -> list[tuple[str, str, int, int, str, list[str], list[str]]]:
    """``symbol, kind, first line, last line, code, calls, imports`` of each chunk of a file."""
    code = code.removeprefix("﻿")
    lines = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(lines, at)
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in CUT:
        whole = code.rstrip("\r\n")
        return [("<module>", "module", 1, line(max(0, len(whole) - 1)), whole, [], [])] if whole.strip() else []
    try:
        parser = _Cutter(code, CUT[ending], ending in ("tsx", "jsx"))
    except Invalid:  # not even a first token: begin with the first line that can be read
        parser = _Cutter("", CUT[ending], ending in ("tsx", "jsx"))
        parser.s = code
        _resume(parser, code, 0)
    statements: list[tuple[int, int, bool]] = []
    if parser.at and code[: parser.at].strip() and not _COMMENT.sub("", code[: parser.at]).strip() == "":
        statements.append((0, len(code[: parser.at].rstrip()), False))
    while parser.k != "eof":
        start = parser.at
        try:
            parser.initial = ""
            parser.statement(True, top=True)
            statements.append((start, parser.last, parser.initial == "function"))
        except (Invalid, RecursionError):
            again = _resume(parser, code, start + 1)
            statements.append((start, max(start + 1, len(code[:again].rstrip())), False))
    bound = _bindings(code)

    def chunk(symbol: str, kind: str, start: int, end: int, slice_lines: bool = False):
        a, b = line(start), line(max(start, end - 1))
        text = code[lines[a - 1] : lines[b] if b < len(lines) else len(code)].rstrip("\r\n") if slice_lines else code[start:end]
        inside = [n for n in parser.notes if start <= n[0] < end]
        calls = sorted({t for _, k, t in inside if k == "call"})
        imports = sorted({t for _, k, t in inside if k == "import"} | {bound[t] for _, k, t in inside if k == "name" and t in bound})
        return symbol, kind, a, b, text, calls, imports

    out, glue = [], []

    def flush() -> None:
        if glue:
            out.append(chunk("<module>", "module", glue[0][0], glue[-1][1], True))
            glue.clear()

    def comments(a: int, b: int) -> None:
        glue.extend(m.span() for m in _COMMENT.finditer(code, a, b))

    def emit(start: int, end: int, bound_function: bool, prefix: str = "", depth: int = 0) -> None:
        text = code[start:end]
        m = _WORDS.match(text)
        word, name = (m.group(1), m.group(2)) if m else (None, None)
        if word == "function" and text.endswith("}"):
            flush()
            out.append(chunk(prefix + (name or "default"), "function", start, end))
        elif word == "class":
            name = prefix + ("default" if name in (None, "extends", "implements") else name)
            flush()
            out.append(chunk(name, "class", start, end))
            out.extend(chunk(f"{name}.{method}", "method", a, b, True) for a, b, method in parser.methods if start <= a < end)
        elif word in ("interface", "type", "enum", "namespace", "module") and name:
            flush()
            name = prefix + name.strip("'\"")
            out.append(chunk(name, "other", start, end))
            if word in ("namespace", "module"):
                for a, b, bound_member, level in parser.inner:
                    if level == depth + 1 and start <= a and b <= end:
                        emit(a, b, bound_member, f"{name}.", level)
        elif word in ("const", "let", "var") and bound_function and name:
            flush()
            out.append(chunk(prefix + name, "function", start, end))
        elif re.match(r"export\s+default\s+(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>", text):
            flush()
            out.append(chunk("default", "function", start, end))
        elif text != ";" and not prefix:
            glue.append((start, end))

    last = 0
    for start, end, bound_function in statements:
        comments(last, start)
        emit(start, end, bound_function)
        last = max(last, end)
    comments(last, len(code))
    flush()
    return out


def chunked(files: DataFrame) -> DataFrame:
    """The chunks of every file with text (repo, path, code), columns of ``SCHEMA``; the file's other columns are dropped.

    Null and blank code has no chunks. Repeated rows are cut as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            rows = []
            for repo, path, code in zip(*(c.to_pylist() for c in batch.columns)):
                for symbol, kind, a, b, text, calls, imports in cut(code, path):
                    rows.append((repo, f"{path}#{symbol}@{a}-{b}", path, symbol, kind, {"start_line": a, "end_line": b}, text, {"calls": calls, "imports": imports}))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.string()] * 5 + [_ARROW[0], pa.string(), _ARROW[1]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["repo", "id", "path", "symbol", "kind", "span", "code", "structural_refs"])

    return files.filter("path is not null and code is not null").select("repo", "path", "code").mapInArrow(run, SCHEMA)


def symbols(chunks: DataFrame) -> DataFrame:
    """``repo, path, symbol, kind, start_line, end_line``: the chunks without text."""
    return chunks.select("repo", "path", "symbol", "kind", F.col("span.start_line").alias("start_line"), F.col("span.end_line").alias("end_line"))
