from __future__ import annotations

import sys

import pytest

from lodestone.llm import syntax


@pytest.mark.parametrize(
    "code,language,found",
    [("export const a = <div className='x'>hi</div>\n", "typescript", "tsx"), ("const a: number = 1\nconst x = <string>y\n", "tsx", "typescript"), ("const a = <div></span>\n", "typescript", None), ("const x: = <string>y\n", "tsx", None)],
)
def test_the_two_grammars_of_typescript_are_tried_for_each_other(code, language, found):
    assert syntax.judge(code, language) == ("wrong extension" if found else "corrupt", found)


OBJECTS = '{"a":' * 40_000
DEEP = [
    ("json", "[" * 100_000, False), ("json", "[" * 100_000 + "]" * 100_000, True), ("json", "[" * 100_000 + "]" * 99_999 + "}", False), ("json", "[" * 100_000 + "]" * 100_000 + " x", False), ("json", OBJECTS + "1" + "}" * 40_000, True),
    ("json", OBJECTS + "}" * 40_000, False), ("json", "[" * 100_000 + "1," + "]" * 100_000, False), ("json", "[" * 100_000 + "01" + "]" * 100_000, False), ("json", "[" * 100_000 + '1,{},[],"\\u00e9",{"a":-1.5e3}' + "]" * 100_000 + "\n", True), ("json", "[" * 100_000 + '"\t"' + "]" * 100_000, False),
    ("typescript", "let a = " + "[" * 30_000, False), ("typescript", "let a = " + "[" * 30_000 + "]" * 30_000, True), ("javascript", "f" + "(" * 30_000 + ")" * 29_999, False), ("python", "x = " + "not " * 9_000 + "1", True), ("python", "x = (" + "not " * 9_000 + "1", False), ("python", "x = " + "not " * 9_000, False), ("python", "x = " + "1 + " * 90_000 + "1", True), ("python", "x = " + "1 + " * 90_000, False),
]


@pytest.mark.parametrize("language,code,good", DEEP, ids=range(len(DEEP)))
def test_deep_texts_are_decided(language, code, good):
    usual = sys.getrecursionlimit()
    sys.setrecursionlimit(syntax._DEPTH)
    try:
        assert syntax.valid(code, language) is good and sys.getrecursionlimit() == syntax._DEPTH
    finally:
        sys.setrecursionlimit(usual)


@pytest.mark.parametrize("code,good", [("[" * 9 + "]" * 9, True), ("f(`a${g(`b`)}`, '(', /[(]/, 1) // (", True), ("f(`a${b`", False), ("f(])", False), ("/* (", False), ("a = [1] +", False), ("a++", True)])
def test_brackets_beyond_the_recognizer(code, good):
    assert syntax._deep_ecmascript(code) is good


@pytest.mark.parametrize("code,language,good", [
    ("a ?? b || c", "javascript", False), ("a ?? (b || c)", "javascript", True), ("a || b && c", "javascript", True), ("a && b ?? c", "javascript", False), ("let a = 08n", "javascript", False), ("let a = 10n", "javascript", True),
    ('let a = "\\u{110000}"', "javascript", False), ('let a = "\\u{10ffff}\\x41\\\\x"', "javascript", True), ('let a = "\\xg1"', "javascript", False), ("for await (const x in y) {}", "javascript", False), ("for await (const x of y) {}", "javascript", True),
    ("a: a: x", "javascript", False), ("a: b: x", "javascript", True), ("let u = a ? (b) : c => d", "typescript", True), ("let u = a ? (b): c => d : e", "typescript", True), ("let u = a ? (b, c) : d", "typescript", True), ("let u = a ? (b) : c ? (d) : e => f", "typescript", True), ("let u = a ? (b : c", "typescript", False),
])
def test_early_errors_and_conditionals(code, language, good):
    assert syntax.valid(code, language) is good


def test_every_grammar_is_asked_in_order_of_evidence():
    assert syntax.accepting("const a = [1]\n", "python") == [x for x in syntax.ranked("const a = [1]\n") if x in ("javascript", "typescript", "tsx")]
    assert syntax.accepting("[1, 2]", "json")[0] in ("json", "javascript", "python", "typescript", "tsx") and len(syntax.accepting("[1, 2]", "json")) == 5
    assert syntax.judge("x = " + "(" * 5_000, "python") == ("corrupt", None)  # a depth that a parser gives up on is no proof of another language
