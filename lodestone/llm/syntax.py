"""Source files that are not valid in the language of their path.

The supported languages are ranked by how far a file's tokens speak for them, and the file is
parsed against all their grammars in that order. A file that its path's grammar accepts is valid;
of any other the first foreign grammar that accepts it tells a wrong extension, and failure of
all of them corruption (truncation, merge conflicts, damage). TypeScript with and without JSX are
two grammars: a file valid only in the other has the wrong extension. A text that nests too deeply
for a parser is decided by its brackets and end; a foreign grammar gets no credit for that.
"""

from __future__ import annotations

import ast
import io
import json
import re
import sys
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ecmascript

#: The language of each ending.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "py": "python", "json": "json"}
#: Tokens that speak for a language; what counts is their share of a file's tokens.
EVIDENCE = {
    "typescript": re.compile(r"\b(?:interface|readonly|namespace|declare|enum|private|implements)\b|: (?:string|number|unknown|any|boolean)\b|\bas\b"),
    "tsx": re.compile(r"</[A-Za-z]|/>|\bclassName\b"),
    "javascript": re.compile(r"\b(?:const|let|var|function|=>|require|module)\b|=>|;$", re.M),
    "python": re.compile(r"^\s*(?:def|class|from|import|elif|except|with|if|for)\b.*[:\w]$|\b(?:None|True|False|self)\b", re.M),
    "json": re.compile(r"\"[^\"\n]*\"\s*[:,\]}]|^\s*[\[{]"),
}
#: Python calls allowed to the recognizer, and to the second run over a text that nests deeper (at 300 bytes each).
_DEPTH, _DEEPEST = 20_000, 1_000_000
_PAIRS = {")": "(", "]": "[", "}": "{"}
_JSON = re.compile(r"""[ \t\n\r]*+(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)|(\Z))""")
_SIGN = re.compile(r"""//[^\n\r]*+|/\*.*?\*/|(/\*)|'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+"|(?<=[=(,:\[!&|?{};+])\s*/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/|([()\[\]{}`])""", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{)", re.S)
_OPEN_END = re.compile(r"(?:[=,.?&|^~!%<]|(?<!\+)\+|(?<!-)-)\s*\Z")
_MARKERS = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$)", re.M)


def path_language(path: Column) -> Column:
    """The supported language of a path's ending, or null."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.when(ending.isin(*LANGUAGES), ending))


def _no_constant(name: str):
    raise ValueError(name)


_STRICT = json.JSONDecoder(parse_constant=_no_constant, parse_int=str, parse_float=str)


def _deep_json(code: str) -> bool:
    """Whether a text of any depth is JSON, with an explicit stack."""
    stack, want, at = [], "value", 0
    while m := _JSON.match(code, at):
        at, (sign, text, plain, end) = m.end(), m.groups()
        if end is not None:
            return want == "end" and not stack
        if sign and sign in "[{" and want in ("value", "item"):
            stack.append(sign)
            want = "item" if sign == "[" else "first key"
        elif text and want in ("key", "first key"):
            want = ":"
        elif (text or plain) and want in ("value", "item"):
            want = "end"
        elif sign == ":" and want == ":":
            want = "value"
        elif sign == "," and want == "end" and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif sign and sign in "]}" and stack and stack[-1] == _PAIRS[sign] and want in ("end", "item" if sign == "]" else "first key"):
            stack.pop()
            want = "end"
        else:
            return False
    return False


def _deep_python(code: str) -> bool:
    """Whether the tokens of a text that Python's parser gives up on are well formed, its brackets close and it has an end."""
    stack, last = [], ""
    for token in tokenize.generate_tokens(io.StringIO(code).readline):
        if token.type == tokenize.OP:
            if token.string in ("(", "[", "{"):
                stack.append(token.string)
            elif token.string in _PAIRS and (not stack or stack.pop() != _PAIRS[token.string]):
                return False
        if token.string.strip():
            last = token.string
    return not stack and last not in ("+", "-", "*", "/", "%", "=", "==", ".", "~", "not", "and", "or", "in", "is", "lambda", "if", "else", ":")


def _deep_ecmascript(code: str) -> bool:
    """Whether the brackets, templates and comments of a text that nests too deeply for the recognizer close and it has an end."""
    stack, at = [], 0
    while m := _TEMPLATE.match(code, at) if stack and stack[-1] == "`" else _SIGN.search(code, at):
        at, sign = m.end(), m.group(m.lastindex) if m.lastindex else ""
        if sign == "/*":
            return False
        if sign == "`" and stack and stack[-1] == "`":
            stack.pop()
        elif sign == "${":
            stack.append("{")
        elif sign in _PAIRS:
            if not stack or stack.pop() != _PAIRS[sign]:
                return False
        elif sign:
            stack.append(sign)
    return not stack and not _OPEN_END.search(code[-1000:])


def _ecmascript(code: str, language: str) -> tuple[bool | None, bool]:
    """Whether the recognizer accepts a text (null: it nests too deeply for it), and whether elements made a difference."""
    grammar, usual = (language != "javascript", language == "tsx"), sys.getrecursionlimit()
    try:
        return ecmascript.accepted(code, *grammar)
    except RecursionError:
        pass
    try:
        sys.setrecursionlimit(max(usual, _DEEPEST))
        return ecmascript.accepted(code, *grammar)
    except RecursionError:
        return None, True
    finally:
        sys.setrecursionlimit(usual)


def _parsed(code: str, language: str) -> tuple[bool | None, bool]:
    """Whether a parser accepts a text (null: it nests too deeply for it), and whether the twin grammar may say otherwise."""
    if language not in ("json", "python"):
        return _ecmascript(code, language)
    try:
        if language == "json":
            try:
                _STRICT.decode(code)
            except RecursionError:
                return _deep_json(code), True
            return not re.match(r"[^\S \t\n\r]", code) and not re.search(r"[^\S \t\n\r]$", code), True
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(code)
            except RecursionError:  # raised after the grammar has accepted the text, while its tree is handed over
                return True, True
            except MemoryError:  # the parser's own stack
                return None, True
        return True, True
    except (ValueError, SyntaxError):
        return False, True


def _decided(code: str, language: str) -> tuple[bool, bool]:
    """As :func:`_parsed`, with a stack for what nests too deeply."""
    accepted, twin = _parsed(code, language)
    if accepted is None:
        try:
            return _deep_python(code) if language == "python" else _deep_ecmascript(code), True
        except (SyntaxError, tokenize.TokenError):
            return False, True
    return accepted, twin


def valid(code: str, language: str) -> bool:
    """Whether a text is valid; a leading byte order mark is allowed. What nests too deeply for a parser is decided with a stack."""
    return _decided(code.removeprefix("\ufeff"), language)[0]


def ranked(code: str) -> list[str]:
    """The supported languages, the likeliest by tokens first."""
    size = max(1, len(code))
    return sorted(EVIDENCE, key=lambda name: (-sum(len(m.group()) for m in EVIDENCE[name].finditer(code)) / size, name))


def accepting(code: str, language: str) -> list[str]:
    """The languages whose grammars accept a text, the likeliest by tokens first; foreign ones only if they decide it wholly."""
    bare, results, twins = code.removeprefix("\ufeff"), {}, {"typescript": "tsx", "tsx": "typescript"}
    order = ranked(bare)
    for name in order:
        if name not in results:
            yes, differs = (_decided if name == language else _parsed)(bare, name)
            results[name] = bool(yes)
            if not differs and name in twins:  # no expression begins with the only sign that the two grammars read differently
                results[twins[name]] = bool(yes)
    return [name for name in order if results[name]]


def judge(code: str | None, language: str | None) -> tuple[str, str | None]:
    """``verdict`` and the language that accepts the text: the path's own, or the likeliest foreign one."""
    if code is None or language is None:
        return "not parsed", None
    names = accepting(code, language)
    if language in names:
        return "valid", language
    if names and code.strip():
        return "wrong extension", names[0]
    return ("merge conflict" if _MARKERS.search(code) else "corrupt"), None


def judged(files: DataFrame) -> DataFrame:
    """``file_id, repo, language, verdict, found`` of every row of ``files``.

    ``language`` is that of the path (null: unsupported, verdict ``not parsed``, as for null
    code). Empty code is a valid program but no valid JSON. The stated language, size and skip
    reason are not trusted and not used. Rows are independent; repeated rows come out once each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(_DEPTH)
        for batch in batches:
            codes, languages = batch.column("code").to_pylist(), batch.column("language").to_pylist()
            verdicts = [judge(c, lang) for c, lang in zip(codes, languages)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("repo"), batch.column("language"), pa.array([v for v, _ in verdicts], pa.string()), pa.array([f for _, f in verdicts], pa.string())],
                ["file_id", "repo", "language", "verdict", "found"],
            )

    rows = files.select(F.col("file_id").cast("long"), "repo", path_language(F.col("path")).alias("language"), "code")
    return rows.mapInArrow(run, "file_id long, repo string, language string, verdict string, found string").distinct()


def invalid_rates(verdicts: DataFrame) -> DataFrame:
    """``repo, language, files, invalid, rate`` over the parsed files of :func:`judged`."""
    parsed = verdicts.filter("verdict <> 'not parsed'")
    bad = F.sum((F.col("verdict") != "valid").cast("long"))
    return parsed.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid"), F.round(bad / F.count(F.lit(1)), 6).alias("rate"))
