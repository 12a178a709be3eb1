"""Go."""

from __future__ import annotations

import re

from .base import Bad, Parser, Tokens, scan

# Reserved words, and the tokens after which a line end is a semicolon.
KEYWORDS = frozenset(
    """break case chan const continue default defer else fallthrough for func go goto if import interface map package range
    return select struct switch type var""".split()
)
_ENDING = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
_ESCAPE = r"\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})"
_PATTERN = re.compile(
    rf"""(?P<space>[ \t\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<id>[^\W\d]\w*)
    |(?P<num>0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?i?(?!\w)|0[bB][01_]+i?(?!\w)|0[oO][0-7_]+i?(?!\w)|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?i?(?!\w))
    |(?P<str>`[^`]*`|"(?:[^"\\\n]|{_ESCAPE})*"|'(?:[^'\\\n]|{_ESCAPE})')
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^~!<>=:;,.(){{}}\[\]])
    |(?P<bad>/\*|["'`]|[0-9]\w*)""",
    re.X | re.S,
)


class Go(Parser):
    """A source file."""

    BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
    ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())

    def __init__(self, text: str) -> None:
        def special(kind, m, t, newline):
            if kind == "nl" or kind == "comment" and "\n" in m.group():
                if t.kind and (t.kind[-1] in ("id", "num", "str") or t.value[-1] in _ENDING):
                    t.add("op", ";", m.start(), True)
                return m.end()
            return None

        tokens = scan(text.removeprefix("﻿") + "\n", _PATTERN, KEYWORDS, Tokens(), special)
        super().__init__(tokens)
        self.level = 0  # below 0: in the head of a statement, where a brace opens its block

    def recover(self, before: int, stop: tuple[str, ...]) -> None:
        self.i = max(self.i, before + 1)
        while self.k[self.i] != "eof" and self.v[self.i] not in (";", "}", *stop):
            self.i += 1
        self.take(";")
        self.level = 0

    def file(self) -> None:
        if self.v[self.i] != "package":
            self.note(Bad("expected 'package'", self.p[self.i]))
        else:
            self.i += 1
            self.name()
            self.end()
        imports = True

        def top() -> None:
            nonlocal imports
            v = self.v[self.i]
            if v == "import":
                if not imports:
                    self.fail("imports must come first")
                self.i += 1
                self.group(self.one_import)
            elif v in ("const", "var", "type"):
                imports = False
                self.declaration()
            elif v == "func":
                imports = False
                self.function()
            else:
                self.fail(f"expected a declaration instead of {v!r}")
            self.end()

        self.many(top)

    def end(self) -> None:
        if not self.take(";") and self.v[self.i] not in (")", "}") and self.k[self.i] != "eof":
            self.fail(f"expected a line end or ';' instead of {self.v[self.i]!r}")

    def group(self, one) -> None:
        if self.take("("):
            while not self.take(")"):
                one()
                self.end()
        else:
            one()

    def one_import(self) -> None:
        if self.v[self.i] == "." or self.k[self.i] == "id":
            self.i += 1
        if self.k[self.i] != "str":
            self.fail("expected a path")
        self.i += 1

    def declaration(self) -> None:
        v = self.v[self.i]
        self.i += 1
        self.group({"const": self.const, "var": self.var, "type": self.type_declaration}[v])

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def const(self) -> None:
        self.names()
        if self.v[self.i] not in ("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def var(self) -> None:
        self.names()
        if self.v[self.i] != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def type_declaration(self) -> None:
        self.name()
        if self.v[self.i] == "[" and self.k[self.i + 1] == "id" and self.v[self.i + 2] != "]":
            self.attempt(self.type_parameters)
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        def one() -> None:
            self.names_of_group()
            self.constraint()

        self.need("[")
        self.listed(one, "]", 1)

    def names_of_group(self) -> None:
        self.name()
        while self.v[self.i] == "," and self.k[self.i + 1] == "id":
            self.i += 1
            self.name()

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def function(self) -> None:
        self.need("func")
        if self.v[self.i] == "(":
            self.parameters()
        self.name()
        if self.v[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.v[self.i] == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.v[self.i] == "(":
            self.parameters()
        elif self.v[self.i] not in ("{", ";", ")", "]", "}", ",", "=", ":=", ":", ".") and self.k[self.i] not in ("eof", "str"):
            self.type()

    def parameters(self) -> None:
        kinds: list[str] = []

        def one() -> None:
            self.take("...") or self.type()
            if self.v[self.i - 1] == "...":
                self.type()
                kinds.append("type")
            elif self.v[self.i] not in (",", ")"):
                self.take("...")
                self.type()
                kinds.append("named")
            else:
                kinds.append("type" if self.k[self.i - 1] != "id" or self.v[self.i - 2] == "." else "either")

        self.need("(")
        self.listed(one, ")")
        if "named" in kinds and ("type" in kinds or kinds[-1] == "either"):
            self.fail("named and unnamed parameters side by side")

    def type(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "id":
            self.i += 1
            if self.take("."):
                self.name()
            if self.v[self.i] == "[" and self.v[self.i + 1] != "]":
                self.attempt(lambda: (self.need("["), self.listed(self.type, "]", 1)) and None)
        elif v == "*":
            self.i += 1
            self.type()
        elif v == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.nested(self.expression)
                self.need("]")
            self.type()
        elif v == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif v == "chan" or v == "<-" and self.v[self.i + 1] == "chan":
            self.i += 1 + (v == "<-")
            self.take("<-")
            self.type()
        elif v == "func":
            self.i += 1
            self.signature()
        elif v == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif v == "struct":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                self.field()
                self.end()
        elif v == "interface":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                if self.k[self.i] == "id" and self.v[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.fail(f"expected a type instead of {v or k!r}")

    def field(self) -> None:
        if self.v[self.i] == "*" or self.k[self.i] == "id" and (self.v[self.i + 1] in (";", ".", "}") or self.k[self.i + 1] == "str"):
            self.take("*")
            self.type()
        else:
            self.names()
            self.type()
        if self.k[self.i] == "str":
            self.i += 1

    def nested(self, f):
        saved, self.level = self.level, 0
        try:
            return f()
        finally:
            self.level = saved

    # statements
    def block(self) -> None:
        self.need("{")
        self.nested(lambda: self.many(self.line, ("}",)))
        self.need("}")

    def line(self) -> None:
        self.statement()
        self.end()

    def statement(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if v == ";":
            return
        if v == "{":
            self.block()
        elif v in ("const", "var", "type"):
            self.declaration()
        elif v in ("return",):
            self.i += 1
            if self.v[self.i] not in (";", "}"):
                self.expressions()
        elif v in ("break", "continue", "goto"):
            self.i += 1
            if self.k[self.i] == "id":
                self.i += 1
        elif v == "fallthrough":
            self.i += 1
        elif v in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                self.fail(f"{v} needs a call")
        elif v == "if":
            self.if_()
        elif v == "for":
            self.i += 1
            self.head(self.for_clause)
            self.block()
        elif v == "switch":
            self.i += 1
            self.head(self.switch_clause)
            self.need("{")
            self.cases(self.expressions_or_types)
        elif v == "select":
            self.i += 1
            self.need("{")
            self.cases(self.simple)
        elif k == "id" and self.v[self.i + 1] == ":" and self.k[self.i + 1] == "op":
            self.i += 2
            if self.v[self.i] != "}":
                self.statement()
        else:
            if self.simple() == "value":
                self.fail("an expression is no statement")

    def head(self, f) -> None:
        saved, self.level = self.level, -1
        try:
            f()
        finally:
            self.level = saved

    def if_(self) -> None:
        self.need("if")

        def clause() -> None:
            if self.v[self.i] == "{":
                self.fail("expected a condition")
            if self.v[self.i] != ";":
                self.simple()
            if self.take(";"):
                self.simple()

        self.head(clause)
        self.block()
        if self.take("else"):
            if self.v[self.i] == "if":
                self.if_()
            else:
                self.block()

    def for_clause(self) -> None:
        if self.v[self.i] == "{":
            return
        if self.take("range"):
            self.expression()
            return
        if self.v[self.i] != ";":
            if self.simple(True) == "range":
                return
        if self.v[self.i] == "{":
            return
        self.need(";")
        if self.v[self.i] != ";":
            self.expression()
        self.need(";")
        if self.v[self.i] != "{":
            self.simple()

    def switch_clause(self) -> None:
        if self.v[self.i] == "{":
            return
        if self.v[self.i] != ";":
            self.simple()
        if self.take(";") and self.v[self.i] != "{":
            self.simple()

    def cases(self, one) -> None:
        while not self.take("}"):
            if self.take("case"):
                one()
            else:
                self.need("default")
            self.need(":")
            self.nested(lambda: self.many(self.line, ("case", "default", "}")))

    def expressions_or_types(self) -> None:
        while True:
            self.expression()
            if not self.take(","):
                return

    def simple(self, ranging: bool = False) -> str:
        first = self.expressions()
        v = self.v[self.i]
        if v in self.ASSIGN and self.k[self.i] == "op":
            self.i += 1
            if ranging and v in ("=", ":=") and self.take("range"):
                self.expression()
                return "range"
            if v == ":=" and first not in ("name", "names"):
                self.fail("a name must be left of ':='")
            self.expressions()
            return "assign"
        if v in ("++", "--"):
            self.i += 1
            return "assign"
        if v == "<-":
            self.i += 1
            self.expression()
            return "assign"
        return "call" if first in ("call", "receive") else "value"

    def expressions(self) -> str:
        left = self.expression()
        while self.take(","):
            right = self.expression()
            left = "names" if left in ("name", "names") and right == "name" else "list"
        return left

    def expression(self) -> str:
        return self.binary()

    def binary(self, least: int = 0) -> str:
        left = self.unary()
        while self.k[self.i] == "op":
            rank = self.BINARY.get(self.v[self.i])
            if rank is None or rank < least:
                break
            self.i += 1
            self.binary(rank + 1)
            left = "value"
        return left

    def unary(self) -> str:
        v = self.v[self.i]
        if self.k[self.i] == "op" and v in ("+", "-", "!", "^", "*", "&", "~"):
            self.i += 1
            self.unary()
            return "part" if v == "*" else "value"
        if v == "<-":
            if self.v[self.i + 1] == "chan":
                self.type()
                return self.postfix("type")
            self.i += 1
            self.unary()
            return "receive"
        return self.postfix(self.operand())

    def operand(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "id":
            self.i += 1
            return "name"
        if k in ("num", "str"):
            self.i += 1
            return "value"
        if v == "(":
            self.i += 1

            def inner() -> None:
                if self.v[self.i] in ("[", "map", "chan", "func", "struct", "interface") or not self.attempt(self.expression):
                    if not self.attempt(self.expression):
                        self.type()

            self.nested(inner)
            self.need(")")
            return "value"
        if v == "func":
            self.i += 1
            self.signature()
            if self.v[self.i] == "{":
                self.nested(self.block)
            return "value"
        if v in ("[", "map", "chan", "struct", "interface"):
            self.type()
            if self.v[self.i] == "{" and v != "interface":
                self.literal()
                return "value"
            return "type"
        self.fail(f"unexpected {v or k!r}")

    def literal(self) -> None:
        def element() -> None:
            one()
            if self.take(":"):
                one()

        def one() -> None:
            if self.v[self.i] == "{":
                self.literal()
            else:
                self.expression()

        self.need("{")
        self.nested(lambda: self.listed(element, "}"))

    def postfix(self, left: str) -> str:
        while self.k[self.i] == "op":
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    left = "value"
                else:
                    self.name()
                    left = "name." if left in ("name",) else "part"
            elif v == "[":
                self.i += 1
                self.nested(self.index)
                left = "index"
            elif v == "(":
                self.i += 1
                self.nested(lambda: self.listed(self.argument, ")"))
                left = "call"
            elif v == "{" and left in ("name", "name.", "index") and self.level >= 0:
                self.literal()
                left = "value"
            else:
                break
        return "part" if left in ("name.", "index") else left

    def index(self) -> None:
        if self.v[self.i] != ":":
            if self.v[self.i] in ("map", "chan", "func", "struct", "interface", "["):
                self.type()
            else:
                self.expression()
            while self.take(","):
                if self.v[self.i] == "]":
                    break
                self.type()
        for _ in range(2):
            if self.take(":") and self.v[self.i] not in (":", "]"):
                self.expression()
        self.need("]")

    def argument(self) -> None:
        if self.v[self.i] in ("map", "chan", "struct", "interface", "[", "func") or self.v[self.i] == "*":
            if not self.attempt(lambda: (self.expression(), self.v[self.i] in (",", ")", "..."))[1]):
                self.type()
        else:
            self.expression()
        self.take("...")
