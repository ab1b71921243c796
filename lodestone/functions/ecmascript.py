"""Whether a text is a syntactically valid JavaScript or TypeScript program.

A recursive-descent recognizer: it builds no tree; on request it notes calls, imports and used
names as it passes them. Names, types and other static rules are not checked. Ambiguous starts (arrow parameters, type arguments) are
tried and undone; a start that failed once is not tried again, which keeps the work linear.
"""

from __future__ import annotations

import re

_SKIP = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/)*", re.S)
_NAME = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TOKEN = re.compile(
    rf"(?P<name>#?{_NAME})"
    r"|(?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?"
    r"|(?:(?:0|[1-9]\d*(?:_\d+)*)n|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?))(?![\w$]))"
    r"|(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    r"|(?P<tmpl>`)"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r  ]|\\[^\n\r  ]|\[(?:[^\]\\\n\r  ]|\\[^\n\r  ])*\])+/[\w$]*")
#: Escapes that no string may hold.
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:[0-9a-fA-F]{1,5}|10[0-9a-fA-F]{4})\}))")
_PAREN = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*\]", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*", re.S)
#: Words that are no identifiers.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in"
    " instanceof new null return super switch this throw true try typeof var void while with".split()
)
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset(["!", "~", "+", "-", "typeof", "void", "delete"])
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor export default const in out".split())


class Invalid(Exception):
    pass


class Parser:
    """``ts``: TypeScript; ``jsx``: elements as expressions; ``module``: import, export and await at the top."""

    def __init__(self, text: str, ts: bool = False, jsx: bool = False, module: bool = True):
        self.s, self.ts, self.jsx, self.module = text, ts, jsx, module
        self.fn = self.gen = False
        self.is_async = module
        self.loops, self.switches, self.labels = 0, 0, ()
        self.untyped, self.retried = False, set()
        #: whether an expression began with ``<``, which alone the grammars with and without elements read differently
        self.angled = False
        self.no_in, self.cover, self.ambient = False, None, False
        self.failed: set[tuple] = set()
        #: (position, "call" | "import" | "name", text), kept only if ``noting``
        self.notes: list[tuple[int, str, str]] = []
        self.noting = False
        self.initial = ""
        self.pos = 2 if text.startswith("#!") else 0
        if self.pos:
            self.pos = (re.search(r"[\n\r]|$", text) or re.match("", text)).start()
        self.end = self.pos
        self.next()

    # tokens
    def next(self) -> None:
        self.last = self.end
        m = _SKIP.match(self.s, self.end)
        at = m.end()
        gap = self.s[self.end : at] if at > self.end else ""
        self.nl = "\n" in gap or "\r" in gap or " " in gap or " " in gap
        self.at = at
        t = _TOKEN.match(self.s, at)
        if t is None:
            if at < len(self.s):
                raise Invalid(at)
            self.k, self.v, self.end = "eof", "", at
            return
        self.k, self.v, self.end = t.lastgroup, t.group(), t.end()

    def save(self):
        return (self.at, self.end, self.last, self.k, self.v, self.nl, self.fn, self.gen, self.is_async, self.loops, self.switches, self.labels, self.no_in, self.cover, self.ambient, self.untyped, len(self.notes))

    def load(self, state) -> None:
        (self.at, self.end, self.last, self.k, self.v, self.nl, self.fn, self.gen, self.is_async, self.loops, self.switches, self.labels, self.no_in, self.cover, self.ambient, self.untyped, n) = state
        del self.notes[n:]

    def attempt(self, what: str, rule) -> bool:
        """Apply ``rule`` or leave everything as it was."""
        key = (what, self.at, self.no_in, self.untyped)
        if key in self.failed:
            return False
        state = self.save()
        try:
            rule()
            return True
        except Invalid:
            self.load(state)
            self.failed.add(key)
            return False

    def fail(self):
        raise Invalid(self.at)

    def op(self, v: str) -> bool:
        return self.v == v and self.k == "op"

    def word(self, v: str) -> bool:
        return self.v == v and self.k == "name"

    def eat(self, v: str) -> bool:
        if self.v == v and self.k in ("op", "name"):
            self.next()
            return True
        return False

    def need(self, v: str) -> None:
        if self.v != v or self.k not in ("op", "name"):
            self.fail()
        self.next()

    def close_angle(self) -> None:
        """A ``>`` that may be the first sign of a longer token."""
        if self.k != "op" or self.v[0] != ">":
            self.fail()
        self.end = self.at + 1
        self.next()

    def peek(self) -> tuple[str, str, bool]:
        state = self.save()
        try:
            self.next()
            return self.k, self.v, self.nl
        except Invalid:
            return "bad", "", False
        finally:
            self.load(state)

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.nl or self.k == "eof" or self.op("}")):
            self.fail()

    def ident(self) -> None:
        if self.k != "name" or self.v in RESERVED or self.v[0] == "#":
            self.fail()
        if self.v == "yield" and self.gen or self.v == "await" and self.is_async and (self.fn or self.module):
            self.fail()
        self.next()

    def any_name(self) -> None:
        if self.k != "name":
            self.fail()
        self.next()

    def note(self, kind: str, text: str | None, at: int) -> None:
        if self.noting and text:
            self.notes.append((at, kind, text))

    # statements
    def program(self) -> None:
        while self.k != "eof":
            self.statement(True, top=True)

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement(True)
        self.next()

    def body(self, is_async: bool = False, gen: bool = False) -> None:
        """A function's body."""
        kept = (self.fn, self.gen, self.is_async, self.loops, self.switches, self.labels, self.no_in, self.ambient)
        self.fn, self.gen, self.is_async, self.loops, self.switches, self.labels, self.no_in, self.ambient = True, gen, is_async, 0, 0, (), False, False
        untyped, self.untyped = self.untyped, False
        self.block()
        self.untyped = untyped
        (self.fn, self.gen, self.is_async, self.loops, self.switches, self.labels, self.no_in, self.ambient) = kept

    def expression_statement(self) -> None:
        self.expression()
        self.no_cover()
        self.semicolon()

    def no_cover(self) -> None:
        if self.cover is not None:
            self.fail()

    def parens(self) -> None:
        self.need("(")
        self.expression()
        self.no_cover()
        self.need(")")

    def loop(self) -> None:
        self.loops += 1
        self.statement(False)
        self.loops -= 1

    def statement(self, declaration: bool, top: bool = False) -> None:
        k, v = self.k, self.v
        if k == "op":
            if v == "{":
                return self.block()
            if v == ";":
                return self.next()
            if v == "@":
                self.decorators()
                if not (self.word("class") or self.word("export") or self.word("abstract")):
                    self.fail()
                return self.statement(declaration, top)
            return self.expression_statement()
        if k != "name":
            return self.expression_statement()
        rule = getattr(self, "s_" + v, None) if v in _STATEMENTS else None
        if rule:
            if v in ("class", "function", "const", "import", "export") and not declaration and not (v == "import" and self.peek()[1] in ("(", ".")):
                if not (v == "function" and not self.ts and not self.module):
                    self.fail()
            if v in ("import", "export"):
                return rule(top)
            return rule()
        if v == "let":
            kind, value, _ = self.peek()
            if value in ("[", "{") and kind == "op" or kind == "name" and value not in ("in", "instanceof", "of") and value not in RESERVED:
                if not declaration:
                    self.fail()
                return self.variables()
        if v == "using" or v == "await":
            kind, value, nl = self.peek()
            if v == "using" and kind == "name" and not nl and value not in RESERVED and value not in ("in", "of", "as", "satisfies"):
                return self.variables()
        if v == "async":
            kind, value, nl = self.peek()
            if value == "function" and not nl:
                self.next()
                return self.function(True, True)
        if self.ts and declaration and self.ts_declaration(top):
            return None
        kind, value, _ = self.peek()
        if value == ":" and kind == "op" and v not in RESERVED:
            self.ident()
            self.next()
            kept = self.labels
            if v in kept:
                self.fail()
            self.labels = (*kept, v)
            self.statement(declaration)
            self.labels = kept
            return None
        return self.expression_statement()

    def variables(self, in_for: bool = False) -> None:
        outer = self.fn
        const = self.v in ("const", "using")
        self.next()
        n = 0
        while True:
            pattern = self.op("{") or self.op("[")
            self.binding()
            n += 1
            if self.ts:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                start = self.v
                kind = self.assign()
                if n == 1 and not outer:
                    self.initial = "function" if kind == "arrow" or start == "function" or start == "async" and kind == "other" else "value"
                self.no_cover()
            elif in_for and (self.word("of") or self.word("in")) and n == 1:
                return
            elif (pattern or const) and not self.ambient:
                self.fail()
            if not self.eat(","):
                break
        if not in_for:
            self.semicolon()

    def s_var(self) -> None:
        self.variables()

    def s_const(self) -> None:
        if self.ts and self.peek()[1] == "enum":
            self.next()
            return self.enum()
        self.variables()

    def s_function(self) -> None:
        self.function(True, False)

    def s_class(self) -> None:
        self.klass(True)

    def s_enum(self) -> None:
        if not self.ts:
            self.fail()
        self.enum()

    def s_if(self) -> None:
        self.next()
        self.parens()
        self.statement(False)
        if self.eat("else"):
            self.statement(False)

    def s_while(self) -> None:
        self.next()
        self.parens()
        self.loop()

    def s_do(self) -> None:
        self.next()
        self.loop()
        self.need("while")
        self.parens()
        self.eat(";")

    def s_with(self) -> None:
        if self.module:
            self.fail()
        self.s_while()

    def s_for(self) -> None:
        self.next()
        waits = self.word("await")
        if waits:
            if not self.is_async:
                self.fail()
            self.next()
        self.need("(")
        self.no_in = True
        each = False
        if self.word("var") or self.word("const") or self.word("let") and self.peek()[0] in ("name", "op") and self.peek()[1] not in ("in", "of", ";", "=", ".", "(", ")"):
            self.variables(True)
            each = self.word("of") or self.word("in")
            if waits and not self.word("of"):
                self.fail()
        elif not self.op(";"):
            kind = self.expression()
            if self.word("of") or self.word("in"):
                if kind not in ("id", "member", "obj", "arr"):
                    self.fail()
                self.cover, each = None, True
            self.no_cover()
        self.no_in = False
        if each:
            of = self.v == "of"
            self.next()
            self.assign() if of else self.expression()
        else:
            self.need(";")
            if not self.op(";"):
                self.expression()
            self.need(";")
            if not self.op(")"):
                self.expression()
        self.no_cover()
        self.need(")")
        self.loop()

    def s_switch(self) -> None:
        self.next()
        self.parens()
        self.need("{")
        self.switches += 1
        default = False
        while not self.eat("}"):
            if self.eat("default"):
                if default:
                    self.fail()
                default = True
            else:
                self.need("case")
                self.expression()
            self.need(":")
            while not (self.word("case") or self.word("default") or self.op("}")):
                self.statement(True)
        self.switches -= 1

    def s_return(self) -> None:
        if not self.fn:
            self.fail()
        self.next()
        if not (self.nl or self.op(";") or self.op("}") or self.k == "eof"):
            self.expression()
            self.no_cover()
        self.semicolon()

    def s_throw(self) -> None:
        self.next()
        if self.nl:
            self.fail()
        self.expression_statement()

    def s_break(self) -> None:
        go = self.v
        self.next()
        if self.k == "name" and not self.nl and self.v not in RESERVED:
            if self.v not in self.labels:
                self.fail()
            self.next()
        elif not (self.loops or go == "break" and self.switches):
            self.fail()
        self.semicolon()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.next()
        self.semicolon()

    def s_try(self) -> None:
        self.next()
        self.block()
        done = False
        if self.eat("catch"):
            done = True
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            done = True
            self.block()
        if not done:
            self.fail()

    # modules
    def from_clause(self) -> None:
        self.need("from")
        self.specifier()

    def specifier(self) -> None:
        if self.k != "str":
            self.fail()
        self.note("import", self.v[1:-1], self.at)
        self.next()
        if (self.word("with") or self.word("assert")) and not self.nl and self.peek()[1] == "{":
            self.next()
            self.next()
            while not self.op("}"):
                self.any_name() if self.k == "name" else self.string()
                self.need(":")
                self.string()
                if not self.eat(","):
                    break
            self.need("}")
        self.semicolon()

    def string(self) -> None:
        if self.k != "str":
            self.fail()
        self.next()

    def named(self) -> None:
        """``{ a, b as c, type d }``."""
        self.need("{")
        while not self.op("}"):
            if self.ts and self.word("type") and self.peek()[1] not in (",", "}", "as"):
                self.next()
            self.any_name() if self.k == "name" else self.string()
            if self.eat("as"):
                self.any_name() if self.k == "name" else self.string()
            if not self.eat(","):
                break
        self.need("}")

    def s_import(self, top: bool) -> None:
        if self.peek()[1] in ("(", "."):
            return self.expression_statement()
        if not top or not self.module:
            self.fail()
        self.next()
        if self.k == "str":
            return self.specifier()
        if self.ts and self.word("type"):
            k, v, _ = self.peek()
            if v in ("{", "*") or k == "name" and v != "from" or k == "name" and v == "from" and False:
                self.next()
        if self.k == "name":
            self.ident()
            if self.ts and self.eat("="):
                if self.word("require") and self.peek()[1] == "(":
                    self.next()
                    self.next()
                    self.string()
                    self.need(")")
                else:
                    self.any_name()
                    while self.eat("."):
                        self.any_name()
                return self.semicolon()
            if not self.eat(","):
                return self.from_clause()
        if self.eat("*"):
            self.need("as")
            self.ident()
        else:
            self.named()
        return self.from_clause()

    def s_export(self, top: bool) -> None:
        if not top or not (self.module or self.ts):
            self.fail()
        self.next()
        if self.eat("default"):
            if self.word("function"):
                return self.function(True, False, True)
            if self.word("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                return self.function(True, True, True)
            if self.op("@"):
                self.decorators()
            if self.ts and self.word("abstract") and self.peek()[1] == "class":
                self.next()
            if self.word("class"):
                return self.klass(True, True)
            if self.ts and self.word("interface") and self.peek()[0] == "name":
                return self.interface()
            self.assign()
            self.no_cover()
            return self.semicolon()
        if self.ts and self.word("type") and self.peek()[1] in ("{", "*"):
            self.next()
        if self.eat("*"):
            if self.eat("as"):
                self.any_name() if self.k == "name" else self.string()
            return self.from_clause()
        if self.op("{"):
            self.named()
            if self.word("from"):
                return self.from_clause()
            return self.semicolon()
        if self.ts:
            if self.eat("="):
                self.expression()
                return self.semicolon()
            if self.word("as") and self.peek()[1] == "namespace":
                self.next()
                self.next()
                self.ident()
                return self.semicolon()
            if self.word("import"):
                return self.s_import(top)
        if self.op("@"):
            self.decorators()
        if self.v in ("var", "const", "let", "function", "class", "async", "enum") and self.k == "name":
            if self.v == "let":
                return self.variables()
            return self.statement(True)
        if self.ts and self.ts_declaration(top):
            return None
        self.fail()

    # functions and classes
    def function(self, declaration: bool, is_async: bool, nameless: bool = False) -> None:
        self.need("function")
        gen = self.eat("*")
        if self.k == "name" and not self.op("("):
            kept = self.gen, self.is_async
            if not declaration:
                self.gen, self.is_async = gen, is_async
            elif not self.fn:
                self.is_async = self.is_async and self.module
            self.ident()
            self.gen, self.is_async = kept
        elif declaration and not nameless:
            self.fail()
        self.signature(is_async, gen)
        if self.ts and declaration and not self.op("{"):
            return self.semicolon()
        self.body(is_async, gen)

    def signature(self, is_async: bool = False, gen: bool = False) -> None:
        kept = (self.fn, self.gen, self.is_async, self.no_in)
        self.fn, self.gen, self.is_async, self.no_in = True, gen, is_async, False
        if self.ts and self.op("<"):
            self.type_parameters()
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()
        (self.fn, self.gen, self.is_async, self.no_in) = kept

    def parameters(self) -> None:
        self.need("(")
        while not self.op(")"):
            if self.op("@"):
                self.decorators()
            if self.eat("..."):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                if self.eat("=") or not self.op(")") and not (self.ts and self.op(",")):
                    self.fail()
                if not self.op(")"):
                    self.next()
                    if not self.ambient or not self.op(")"):
                        self.fail()
                break
            if self.ts:
                while self.k == "name" and self.v in ("public", "private", "protected", "readonly", "override") and (self.peek()[0] == "name" or self.peek()[1] in ("{", "[")):
                    self.next()
                if self.word("this"):
                    self.next()
                else:
                    self.binding()
                self.eat("?")
                if self.eat(":"):
                    self.type()
            else:
                self.binding()
            if self.eat("="):
                self.assign()
                self.no_cover()
            if not self.eat(","):
                break
        self.need(")")

    def binding(self) -> None:
        if self.eat("["):
            while not self.op("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding()
                if not rest and self.eat("="):
                    self.assign()
                if rest or not self.eat(","):
                    break
            self.need("]")
        elif self.eat("{"):
            while not self.op("}"):
                if self.eat("..."):
                    self.ident()
                    break
                plain = self.k == "name" and self.v not in RESERVED
                self.property_name()
                if self.eat(":"):
                    self.binding()
                elif not plain:
                    self.fail()
                if self.eat("="):
                    self.assign()
                    self.no_cover()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.ident()

    def property_name(self) -> None:
        if self.eat("["):
            kept, self.no_in = self.no_in, False
            self.assign()
            self.no_in = kept
            self.need("]")
        elif self.k in ("name", "str", "num"):
            self.next()
        else:
            self.fail()

    def decorators(self) -> None:
        while self.eat("@"):
            if self.op("("):
                self.primary()
            else:
                at, name = self.at, self.v
                self.any_name()
                while self.eat("."):
                    name = self.v
                    self.any_name()
                if self.ts and self.op("<"):
                    self.attempt("args", self.type_arguments)
                if self.op("("):
                    self.note("call", name, at)
                    self.arguments()

    def klass(self, declaration: bool, nameless: bool = False) -> None:
        self.need("class")
        if self.k == "name" and self.v not in ("extends",) and not (self.ts and self.v == "implements"):
            self.ident()
        elif declaration and not nameless:
            self.fail()
        if self.ts and self.op("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.unary_postfix()
            if self.ts and self.op("<"):
                self.type_arguments()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.op("}"):
            if not self.eat(";"):
                self.member()
        self.next()

    def member(self) -> None:
        if self.op("@"):
            self.decorators()
        if self.word("static") and self.peek()[1] == "{":
            self.next()
            kept = self.labels
            self.body()
            self.labels = kept
            return
        allowed = _MODIFIERS if self.ts else ("static", "async", "accessor")
        is_async = False
        while self.k == "name" and self.v in allowed:
            k, v, nl = self.peek()
            if not (k in ("name", "str", "num") or v in ("[", "*", "{") and k == "op") or (nl and self.v not in ("static", "public", "private", "protected", "abstract", "readonly", "override")):
                break
            if v == "{" and self.v != "static":
                break
            is_async = self.v == "async"
            self.next()
        if self.ts and self.op("[") and self.attempt("index", self.index_signature):
            return
        gen = self.eat("*")
        if not gen and self.k == "name" and self.v in ("get", "set"):
            k, v, _ = self.peek()
            if k in ("name", "str", "num") or v == "[":
                self.next()
        self.property_name()
        if self.ts:
            if not self.eat("?"):
                self.eat("!")
        if self.op("(") or self.op("<") and self.ts:
            self.signature(is_async, gen)
            if self.op("{"):
                return self.body(is_async, gen)
            if self.ts:
                return self.semicolon()
            self.fail()
        if gen:
            self.fail()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            kept = (self.fn, self.gen, self.is_async, self.no_in)
            self.fn, self.gen, self.is_async, self.no_in = True, False, False, False
            self.assign()
            self.no_cover()
            (self.fn, self.gen, self.is_async, self.no_in) = kept
        self.semicolon()

    # expressions: each returns what it could be assigned to
    def expression(self) -> str:
        kind = self.assign()
        while self.eat(","):
            self.assign()
            kind = "other"
        return kind

    def assign(self) -> str:
        kept, self.cover = self.cover, None
        kind = self._assign()
        if kept is not None:
            self.cover = kept
        return kind

    def arrow(self, is_async: bool) -> None:
        """Parameters up to and with ``=>``."""
        kept = self.fn, self.is_async, self.gen
        self.fn, self.is_async, self.gen = True, is_async or (self.is_async and False), False
        if self.ts and self.op("<"):
            self.type_parameters()
        if self.op("("):
            self.parameters()
            if self.ts and not self.untyped and self.eat(":"):
                self.return_type()
        else:
            self.ident()
        (self.fn, self.is_async, self.gen) = kept
        if self.nl or not self.op("=>"):
            self.fail()
        self.next()

    def arrow_body(self, is_async: bool) -> str:
        if self.op("{"):
            self.body(is_async)
        else:
            kept = (self.fn, self.is_async, self.gen)
            self.fn, self.is_async, self.gen = True, is_async, False
            self.assign()
            self.no_cover()
            (self.fn, self.is_async, self.gen) = kept
        return "arrow"

    def _assign(self) -> str:
        k, v = self.k, self.v
        if k == "name":
            if v == "yield" and self.gen:
                self.next()
                if not self.nl and not (self.k == "op" and self.v in (")", "]", "}", ",", ";", ":") or self.k == "eof" or self.word("in") or self.word("of")):
                    self.eat("*")
                    self.assign()
                return "other"
            if v not in RESERVED:
                kind, value, nl = self.peek()
                if value == "=>" and kind == "op":
                    if self.attempt("arrow", lambda: self.arrow(False)):
                        return self.arrow_body(False)
                if v == "async" and not nl and (kind == "name" and value not in ("in", "of", "instanceof", "as", "function") or value in ("(", "<")):

                    def rule():
                        self.next()
                        self.arrow(True)

                    if self.attempt("async", rule):
                        return self.arrow_body(True)
        elif k == "op" and (v == "(" or v == "<" and self.ts):
            self.angled |= v == "<"
            if (v == "(" or not self.jsx or self.peek_generic()) and self.attempt("arrow", lambda: self.arrow(False)):
                return self.arrow_body(False)
        kind = self.conditional()
        if self.k == "op" and self.v in _ASSIGN:
            if self.v == "=":
                if kind not in ("id", "member", "obj", "arr"):
                    self.fail()
                self.cover = None
            elif kind not in ("id", "member"):
                self.fail()
            self.next()
            self.assign()
            return "other"
        return kind

    def peek_generic(self) -> bool:
        """In a file with elements, ``<T,>`` and ``<T extends U>`` begin parameters."""
        return bool(re.match(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b)", self.s[self.at : self.at + 200]))

    def branch(self) -> None:
        """The first branch of a conditional: ``(b) : c =>`` is no arrow with a type if no colon is left behind it."""
        state, start, kept = self.save(), self.at, self.untyped
        if start not in self.retried:
            try:
                self.assign()
                if self.op(":"):
                    return
            except Invalid:
                pass
            self.load(state)
            self.retried.add(start)
        self.untyped = True
        self.assign()
        self.untyped = kept

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.op("?"):
            self.next()
            kept, self.no_in = self.no_in, False
            if self.ts and self.op("("):
                self.branch()
            else:
                self.assign()
            self.no_in = kept
            self.need(":")
            self.assign()
            return "other"
        return kind

    def binary(self, least: int) -> str:
        if self.k == "name" and self.v[0] == "#":
            self.next()
            if not self.word("in"):
                self.fail()
            kind = "other"
        else:
            kind = self.unary()
        mixed = ""
        while True:
            v = self.v
            if self.ts and self.k == "name" and v in ("as", "satisfies") and not self.nl:
                if least > 8:
                    return kind
                self.next()
                if not (self.word("const") and v == "as"):
                    self.type()
                else:
                    self.next()
                kind = "member" if kind in ("id", "member") else "other"
                continue
            rank = _BINARY.get(v) if self.k in ("op", "name") else None
            if rank is None or rank <= least and not (v == "**" and rank == least) or v == "in" and self.no_in:
                return kind
            if kind == "arrow" or v == "**" and kind == "unary":
                self.fail()
            if v in ("??", "||", "&&"):
                if mixed and (v == "??") != (mixed == "??"):
                    self.fail()
                mixed = v if v == "??" or mixed != "??" else mixed
            self.next()
            right = self.binary(rank - 1 if v == "**" else rank)
            if v == "??" and right == "logic":
                self.fail()
            kind = "logic" if v in ("||", "&&") else "other"

    def unary(self) -> str:
        k, v = self.k, self.v
        self.angled |= v == "<" and k == "op"
        if k in ("op", "name") and v in _UNARY:
            self.next()
            self.unary()
            return "unary"
        if k == "op" and v in ("++", "--"):
            self.next()
            if self.unary() not in ("id", "member"):
                self.fail()
            return "other"
        if k == "name" and v == "await" and self.is_async:
            self.next()
            self.unary()
            return "other"
        if k == "op" and v == "<" and self.ts and not self.jsx:
            self.next()
            if not self.eat("const"):
                self.type()
            self.close_angle()
            self.unary()
            return "other"
        kind = self.unary_postfix()
        if self.k == "op" and self.v in ("++", "--") and not self.nl:
            if kind not in ("id", "member"):
                self.fail()
            self.next()
            return "other"
        return kind

    def arguments(self) -> None:
        self.need("(")
        kept, self.no_in = self.no_in, False
        while not self.op(")"):
            self.eat("...")
            self.assign()
            if not self.eat(","):
                break
        self.no_in = kept
        self.need(")")

    def call_types(self) -> None:
        self.type_arguments()
        if self.op("(") or self.k == "tmpl" or self.nl or self.k == "eof":
            return
        if self.k == "op" and self.v in (".", "?.", ")", "]", ":", ";", ",", "==", "===", "!=", "!==", "&&", "||", "??", "^", "&", "|", "}", "=", ">"):
            return
        self.fail()

    def unary_postfix(self) -> str:
        at, name = self.at, self.v if self.k == "name" and self.v not in RESERVED else None
        loads = self.word("import")
        kind = self.new() if self.word("new") else self.primary()
        if kind == "arrow":
            return kind
        chain = False
        if kind != "id":
            name = None
        while True:
            if self.k == "tmpl":
                if chain:
                    self.fail()
                self.template()
                kind = "other"
            elif self.k != "op":
                return kind
            elif self.v == ".":
                self.next()
                name, loads = self.v, False
                self.any_name()
                kind = "chain" if chain else "member"
            elif self.v == "?.":
                self.next()
                chain = True
                if self.op("("):
                    self.note("call", name, at)
                    self.arguments()
                elif self.eat("["):
                    self.index()
                    name = None
                elif self.ts and self.op("<"):
                    self.type_arguments()
                    self.note("call", name, at)
                    self.arguments()
                elif self.k == "tmpl":
                    self.fail()
                else:
                    name = self.v
                    self.any_name()
                kind = "chain"
            elif self.v == "[":
                self.next()
                self.index()
                name = None
                kind = "chain" if chain else "member"
            elif self.v == "(":
                if loads or kind == "id" and name == "require":
                    kind_, value, _ = self.peek()
                    if kind_ == "str":
                        self.note("import", value[1:-1], at)
                else:
                    self.note("call", name, at)
                self.arguments()
                name, loads = None, False
                kind = "call"
            elif self.v == "!" and self.ts and not self.nl:
                self.next()
            elif self.v in ("<", "<<") and self.ts and self.v == "<" and self.attempt("call", self.call_types):
                kind = "other"
            else:
                return kind

    def index(self) -> None:
        kept, self.no_in = self.no_in, False
        self.expression()
        self.no_in = kept
        self.need("]")

    def new(self) -> str:
        self.need("new")
        if self.eat("."):
            self.need("target")
            return "other"
        at, name = self.at, self.v if self.k == "name" and self.v not in RESERVED else None
        if self.word("new"):
            self.new()
        elif self.word("import"):
            self.fail()
        else:
            self.primary()
        while True:
            if self.eat("."):
                name = self.v
                self.any_name()
            elif self.eat("["):
                self.index()
                name = None
            elif self.k == "tmpl":
                self.template()
            elif self.ts and self.op("!") and not self.nl:
                self.next()
            elif self.ts and self.op("<") and self.attempt("call", self.call_types):
                pass
            else:
                break
        self.note("call", name, at)
        if self.op("("):
            self.arguments()
        return "other"

    def template(self) -> None:
        """From the opening backtick on."""
        at = self.end
        while True:
            m = _TEMPLATE.match(self.s, at)
            at = m.end()
            if self.s.startswith("`", at):
                self.end = at + 1
                return self.next()
            if not self.s.startswith("${", at):
                self.fail()
            self.end = at + 2
            self.next()
            kept, self.no_in = self.no_in, False
            self.type() if self.in_type else self.expression()
            self.no_in = kept
            if not self.op("}"):
                self.fail()
            at = self.end

    in_type = False

    def primary(self) -> str:
        k, v = self.k, self.v
        if k == "name":
            if v in ("this", "null", "true", "false"):
                self.next()
                return "other"
            if v == "function":
                self.function(False, False)
                return "other"
            if v == "class":
                self.klass(False)
                return "other"
            if v == "super":
                self.next()
                if not (self.op("(") or self.op(".") or self.op("[")):
                    self.fail()
                return "other"
            if v == "import":
                self.next()
                if self.eat("."):
                    self.any_name()
                elif not self.op("("):
                    self.fail()
                return "other"
            if v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                self.function(False, True)
                return "other"
            self.note("name", v, self.at)
            self.ident()
            return "id"
        if k in ("num", "str"):
            if k == "str" and "\\" in v and _BAD_ESCAPE.search(v):
                self.fail()
            self.next()
            return "other"
        if k == "tmpl":
            self.template()
            return "other"
        if k == "op":
            if v == "(":
                self.next()
                kept, self.no_in = self.no_in, False
                kind = self.expression()
                self.no_in = kept
                self.no_cover()
                self.need(")")
                return kind if kind in ("id", "member") else "other"
            if v == "[":
                self.next()
                kept, self.no_in = self.no_in, False
                while not self.op("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assign()
                    if not self.eat(","):
                        break
                self.no_in = kept
                self.need("]")
                return "arr"
            if v == "{":
                return self.object()
            if v in ("/", "/="):
                m = _REGEX.match(self.s, self.at)
                if not m or _PAREN.sub("", m.group()).count("(") != _PAREN.sub("", m.group()).count(")"):
                    self.fail()
                self.end = m.end()
                self.next()
                return "other"
            self.angled |= v == "<"
            if v == "<" and self.jsx:
                self.element()
                return "other"
            if v == "@":
                self.decorators()
                self.klass(False)
                return "other"
        self.fail()

    def object(self) -> str:
        self.need("{")
        kept, self.no_in = self.no_in, False
        while not self.op("}"):
            if self.eat("..."):
                self.assign()
            else:
                self.property()
            if not self.eat(","):
                break
        self.no_in = kept
        self.need("}")
        return "obj"

    def property(self) -> None:
        is_async = gen = False
        if self.k == "name" and self.v in ("async", "get", "set"):
            k, v, nl = self.peek()
            if k in ("name", "str", "num") or k == "op" and (v == "[" or v == "*" and self.v == "async"):
                accessor = self.v != "async"
                if self.v == "async" and nl:
                    self.fail()
                is_async = self.v == "async"
                self.next()
                gen = self.eat("*")
                self.property_name()
                self.signature(is_async, gen)
                return self.body(is_async, gen)
        gen = self.eat("*")
        plain = self.k == "name" and self.v not in RESERVED and self.v[0] != "#"
        self.property_name()
        if self.op("(") or self.op("<") and self.ts:
            self.signature(is_async, gen)
            return self.body(is_async, gen)
        if gen:
            self.fail()
        if self.eat(":"):
            self.assign()
            return None
        if not plain:
            self.fail()
        if self.op("="):
            at = self.at
            self.next()
            self.assign()
            self.cover = at
        return None

    # elements
    def element(self) -> None:
        """``<a b="c">text {expression}</a>``; on return the token after it is read."""
        end = self._element(self.at)
        self.end = end
        self.next()

    _TAG = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)?")

    def _element(self, at: int) -> int:
        m = self._TAG.match(self.s, at + 1)
        name, at = m.group(1), m.end()
        while True:
            at = _SKIP.match(self.s, at).end()
            if self.s.startswith("/>", at) and name:
                return at + 2
            if self.s.startswith(">", at):
                at += 1
                break
            if not name:
                raise Invalid(at)
            if self.s.startswith("{", at):
                at = self._braced(at, spread=True)
                continue
            m = re.compile(r"[A-Za-z_$][\w$:-]*").match(self.s, at)
            if not m:
                raise Invalid(at)
            at = _SKIP.match(self.s, m.end()).end()
            if self.s.startswith("=", at):
                at = _SKIP.match(self.s, at + 1).end()
                m = re.compile(r"\"[^\"]*\"|'[^']*'").match(self.s, at)
                if m:
                    at = m.end()
                elif self.s.startswith("{", at):
                    at = self._braced(at)
                elif self.s.startswith("<", at):
                    at = self._element(at)
                else:
                    raise Invalid(at)
        while True:
            m = re.compile(r"[^<{}>]*").match(self.s, at)
            at = m.end()
            if self.s.startswith("</", at):
                m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(self.s, at)
                if not m or m.group(1) != name:
                    raise Invalid(at)
                return m.end()
            if self.s.startswith("<", at):
                at = self._element(at)
            elif self.s.startswith("{", at):
                at = self._braced(at, empty=True)
            else:
                raise Invalid(at)

    def _braced(self, at: int, spread: bool = False, empty: bool = False) -> int:
        kept = self.save()
        self.end = at + 1
        self.next()
        if not (empty and self.op("}")):
            if not self.eat("...") and spread:
                self.fail()
            self.expression()
        if not self.op("}"):
            self.fail()
        end = self.end
        self.load(kept)
        return end

    # TypeScript declarations
    def ts_declaration(self, top: bool) -> bool:
        """Read a declaration that begins with a contextual word, if this is one."""
        v = self.v
        k, w, nl = self.peek()
        if nl or self.k != "name":
            return False
        if v == "interface" and k == "name":
            self.interface()
        elif v == "type" and k == "name":
            self.next()
            self.ident()
            if self.op("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif v == "abstract" and w == "class":
            self.next()
            self.klass(True)
        elif v in ("namespace", "module") and (k == "name" or k == "str" and v == "module"):
            self.next()
            if self.k == "str":
                self.next()
            else:
                self.ident()
                while self.eat("."):
                    self.any_name()
            if self.op("{"):
                self.module_block()
            else:
                self.semicolon()
        elif v == "global" and w == "{" and self.ambient:
            self.next()
            self.module_block()
        elif v == "declare" and k == "name":
            self.next()
            kept, self.ambient = self.ambient, True
            if self.word("global"):
                self.next()
                self.module_block()
            elif not self.ts_declaration(top):
                if self.v not in ("var", "let", "const", "function", "class", "enum", "async", "import"):
                    self.fail()
                self.statement(True, top)
            self.ambient = kept
        else:
            return False
        return True

    def module_block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement(True, top=True)
        self.next()

    def interface(self) -> None:
        self.need("interface")
        self.ident()
        if self.op("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.object_type()

    def enum(self) -> None:
        self.need("enum")
        self.ident()
        self.need("{")
        while not self.op("}"):
            self.property_name()
            if self.eat("="):
                self.assign()
            if not self.eat(","):
                break
        self.need("}")

    # types
    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.k == "name" and self.v in ("const", "in", "out") and self.peek()[0] == "name" and self.peek()[1] != "extends":
                self.next()
            self.ident()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.op(">"):
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def return_type(self) -> None:
        if self.word("asserts") and self.peek()[0] == "name" and not self.peek()[2]:
            self.next()
            self.any_name()
            if self.eat("is"):
                self.type()
            return
        if self.k == "name" and self.peek()[1] == "is" and not self.peek()[2]:
            self.any_name()
            self.next()
        self.type()

    def type(self) -> None:
        kept, self.in_type = self.in_type, True
        try:
            self._type()
        finally:
            self.in_type = kept

    def function_type(self) -> None:
        if self.op("<"):
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()

    def _type(self) -> None:
        if (self.op("(") or self.op("<")) and self.attempt("fn", self.function_type):
            return
        if self.word("abstract") and self.peek()[1] == "new":
            self.next()
        if self.eat("new"):
            return self.function_type()
        self.union()
        if self.word("extends") and not self.nl and not self.no_conditional:
            state = self.save()
            self.next()
            kept, self.no_conditional = self.no_conditional, True
            self.type()
            self.no_conditional = kept
            if not self.op("?"):
                return self.load(state)
            self.next()
            self.type()
            self.need(":")
            self.type()

    no_conditional = False

    def union(self) -> None:
        self.eat("|") or self.eat("&")
        self.type_operator()
        while self.eat("|") or self.eat("&"):
            self.type_operator()

    def type_operator(self) -> None:
        if self.k == "name" and self.v in ("keyof", "unique", "readonly") and (self.peek()[0] in ("name", "str", "tmpl") or self.peek()[1] in ("(", "[", "{")):
            self.next()
            return self.type_operator()
        if self.word("infer") and self.peek()[0] == "name":
            self.next()
            self.ident()
            if self.word("extends"):

                def rule():
                    self.next()
                    self.union()
                    if self.op("?") and not self.no_conditional:
                        self.fail()

                self.attempt("infer", rule)
            return None
        if (self.op("(") or self.op("<")) and self.attempt("fn", self.function_type):
            return None
        self.type_primary()
        while not self.nl and self.op("["):
            self.next()
            if not self.op("]"):
                self.type()
            self.need("]")
        return None

    def type_primary(self) -> None:
        k, v = self.k, self.v
        if k == "name":
            if v == "typeof":
                self.next()
                if self.word("import"):
                    return self.type_primary()
                self.any_name()
                while self.eat("."):
                    self.any_name()
                if self.op("<") and not self.nl:
                    self.type_arguments()
                return
            if v == "import":
                self.next()
                self.need("(")
                self.type()
                if self.eat(","):
                    self.object()
                self.need(")")
            elif v in ("void", "null", "true", "false", "this"):
                self.next()
                if v == "this" and self.word("is") and not self.nl:
                    self.next()
                    self.type()
                return
            else:
                self.ident()
            while self.eat("."):
                self.any_name()
            if self.op("<") and not self.nl:
                self.type_arguments()
        elif k in ("str", "num"):
            self.next()
        elif k == "tmpl":
            self.template()
        elif v == "-" and k == "op":
            self.next()
            if self.k != "num":
                self.fail()
            self.next()
        elif v == "(":
            self.next()
            kept, self.no_conditional = self.no_conditional, False
            self.type()
            self.no_conditional = kept
            self.need(")")
        elif v == "[":
            self.next()
            kept, self.no_conditional = self.no_conditional, False
            while not self.op("]"):
                self.eat("...")
                if self.k == "name" and (self.peek()[1] == ":" or self.peek()[1] == "?" and self.tuple_label()):
                    self.any_name()
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if not self.eat(","):
                    break
            self.no_conditional = kept
            self.need("]")
        elif v == "{":
            self.object_type()
        else:
            self.fail()

    def tuple_label(self) -> bool:
        return bool(re.match(r"[\w$]+\s*\?\s*:", self.s[self.at : self.at + 200]))

    def index_signature(self) -> None:
        self.need("[")
        self.ident()
        self.need(":")
        self.type()
        self.need("]")
        if self.eat(":"):
            self.type()
        self.member_end()

    def mapped(self) -> None:
        """The inside of ``{ readonly [K in T as U]?: V }``."""
        if self.eat("+") or self.eat("-"):
            self.need("readonly")
        elif self.word("readonly"):
            self.next()
        self.need("[")
        self.ident()
        self.need("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        if self.eat("+") or self.eat("-"):
            self.need("?")
        else:
            self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";") or self.eat(",")
        self.need("}")

    def member_end(self) -> None:
        if not (self.eat(";") or self.eat(",") or self.nl or self.op("}")):
            self.fail()

    def object_type(self) -> None:
        self.need("{")
        kept, self.no_conditional = self.no_conditional, False
        if self.v in ("[", "readonly", "+", "-") and self.attempt("mapped", self.mapped):
            self.no_conditional = kept
            return
        while not self.op("}"):
            if self.op("[") and self.attempt("index", self.index_signature):
                continue
            if self.word("new") and self.peek()[1] in ("(", "<"):
                self.next()
                self.signature()
            elif self.op("(") or self.op("<"):
                self.signature()
            else:
                while self.k == "name" and self.v in ("readonly", "get", "set") and (self.peek()[0] in ("name", "str", "num") or self.peek()[1] == "[") and not self.peek()[2]:
                    self.next()
                    if self.op("[") and self.attempt("index", self.index_signature):
                        break
                else:
                    self.property_name()
                    self.eat("?")
                    if self.op("(") or self.op("<"):
                        self.signature()
                    elif self.eat(":"):
                        self.type()
                    self.member_end()
                    continue
                continue
            self.member_end()
        self.no_conditional = kept
        self.need("}")


_STATEMENTS = frozenset(n[2:] for n in dir(Parser) if n.startswith("s_"))


def accepted(text: str, ts: bool = False, jsx: bool = False) -> tuple[bool, bool]:
    """Whether ``text`` (without byte order mark) is a program, JavaScript as module or as script; and whether ``jsx`` mattered."""
    mattered = False
    for module in (True, False):
        parser = None
        try:
            parser = Parser(text, ts, jsx, module)
            parser.program()
            return True, mattered or parser.angled
        except Invalid:
            mattered |= parser is not None and parser.angled
    return False, mattered


def valid(text: str, ts: bool = False, jsx: bool = False) -> bool:
    return accepted(text, ts, jsx)[0]
