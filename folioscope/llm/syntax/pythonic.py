"""Python 3 and Starlark."""

from __future__ import annotations

import re
import unicodedata

from .base import Bad, Parser, Tokens

# Reserved words.
PYTHON = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global if
    import in is lambda nonlocal not or pass raise return try while with yield""".split()
)
STARLARK = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global if
    import in is lambda load nonlocal not or pass raise return try while with yield""".split()
) - {"False", "None", "True", "async", "await", "load"}

_NUMBER = re.compile(r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?")
_NAME = re.compile(r"[^\W\d]\w*")
_STRING = re.compile(r"(?i)(?:[rbuf]|rb|br|rf|fr)?(?='|\")")
_OPERATOR = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:;.=!]")


def _string(text: str, i: int, prefix: str) -> tuple[int, str | None, list[tuple[int, str]]]:
    """End of the string whose quotes begin at ``i``, what is wrong with it, and the expressions in it (of f-strings)."""
    quote = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else text[i]
    long, formatted, n = len(quote) == 3, "f" in prefix, len(text)
    j, fields = i + len(quote), []
    while j < n:
        c = text[j]
        if c == "\\":
            j += 2
            continue
        if c == quote[0] and text.startswith(quote, j):
            return j + len(quote), None, fields
        if c == "\n" and not long:
            return j, "unterminated string", fields
        if c == "}" and formatted:
            if text[j + 1 : j + 2] != "}":
                return j, "single '}' in an f-string", fields
            j += 1
        if c == "{" and formatted:
            if text[j + 1 : j + 2] == "{":
                j += 2
                continue
            j, wrong = _field(text, j, quote, fields)
            if wrong:
                return j, wrong, fields
            continue
        j += 1
    return n, "unterminated string", fields


def _field(text: str, i: int, quote: str, fields: list) -> tuple[int, str | None]:
    """A replacement field that begins at ``i``."""
    depth, j, n = 0, i + 1, len(text)
    start, done = j, False
    while j < n:
        c = text[j]
        if c in "'\"":
            if not done:
                j, wrong, _ = _string(text, j, "")
                if wrong:
                    return j, wrong
                continue
            if text.startswith(quote, j):
                return j, "unterminated replacement field"
        if c == "\n" and len(quote) == 1 and done:
            return j, "unterminated replacement field"
        if not done:
            if c in "([{":
                depth += 1
            elif c in ")]" or c == "}" and depth:
                depth -= 1
            elif depth == 0 and (c == "}" or c == ":" or c == "!" and text[j + 1 : j + 2] != "="):
                body = text[start:j].rstrip()
                if body.endswith("=") and not body.endswith(("==", "!=", "<=", ">=")):
                    body = body[:-1]
                if not body.strip():
                    return j, "empty replacement field"
                fields.append((start, body))
                if c == "!":
                    if not re.match(r"![rsa]\s*[:}]", text[j:]):
                        return j, "malformed conversion"
                    j = re.compile(r"![rsa]\s*").match(text, j).end()
                    c = text[j]
                if c == "}":
                    return j + 1, None
                done = True
        elif c == "{":
            j, wrong = _field(text, j, quote, fields)
            if wrong:
                return j, wrong
            continue
        elif c == "}":
            return j + 1, None
        j += 1
    return n, "unterminated replacement field"


def tokenize(text: str, keywords: frozenset[str], formatted: bool = True) -> tuple[Tokens, list[tuple[int, str]]]:
    """Tokens with nl, indent and dedent, and the expressions inside f-strings."""
    t, n, i = Tokens(), len(text), 0
    indents, depth, fields, start = [(0, 0)], 0, [], True
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("﻿"):
        text = text[1:]
    n = len(text)
    if "\0" in text:
        t.errors.append((text.index("\0"), "a null character"))
    while True:
        if start and depth == 0:
            start = False
            j, column, other = i, 0, 0
            while j < n and text[j] in " \t\f":
                if text[j] == "\f":
                    column = other = 0
                else:
                    column = column + 1 if text[j] == " " else (column // 8 + 1) * 8
                    other += 1
                j += 1
            if j < n and text[j] in "#\n":
                end = text.find("\n", j)
                i = n if end < 0 else end + 1
                start = True
                if i >= n:
                    start = False
                continue
            if j >= n:
                i = n
                column, other = 0, 0
            else:
                i = j
            if column > indents[-1][0]:
                if other <= indents[-1][1]:
                    t.errors.append((i, "inconsistent tabs and spaces"))
                indents.append((column, other))
                t.add("indent", "", i, True)
            else:
                while len(indents) > 1 and column < indents[-1][0]:
                    indents.pop()
                    t.add("dedent", "", i, True)
                if column != indents[-1][0]:
                    t.errors.append((i, "unindent that matches no outer level"))
                    indents.append((column, other))
                elif other != indents[-1][1]:
                    t.errors.append((i, "inconsistent tabs and spaces"))
        if i >= n:
            break
        c = text[i]
        if c == "\n":
            if depth == 0:
                t.add("nl", "\n", i)
                start = True
            i += 1
        elif c in " \t\f":
            i += 1
        elif c == "#":
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif c == "\\":
            if text[i + 1 : i + 2] == "\n":
                i += 2
                if i >= n:
                    t.errors.append((i, "end of file after a line continuation"))
            else:
                t.errors.append((i, "unexpected character after a line continuation"))
                i += 1
        elif (m := _STRING.match(text, i)) and (m.end() > i or c in "'\""):
            prefix = m.group().lower()
            if not formatted and prefix not in ("", "r", "b", "rb"):
                t.errors.append((i, "unknown string prefix"))
            j, wrong, inner = _string(text, m.end(), prefix)
            if wrong:
                t.errors.append((i, wrong))
            fields.extend(inner)
            t.add("str", "b'" if "b" in prefix else "'", i)
            i = max(j, i + 1)
        elif c.isdigit() and c.isascii() or c == "." and text[i + 1 : i + 2].isdigit():
            m = _NUMBER.match(text, i)
            v = m.group()
            t.add("num", v, i)
            i = m.end()
            if re.match(r"0_?[0-9_]*[1-9][0-9_]*$", v):
                t.errors.append((i, "leading zeros in a decimal integer"))
            if (m := _NAME.match(text, i)) and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", text[i:]):
                t.errors.append((i, "invalid decimal literal"))
                i = m.end()
        elif m := _NAME.match(text, i):
            v = m.group()
            if not v.isascii():
                v = unicodedata.normalize("NFKC", v)
                if not v.isidentifier():
                    t.errors.append((i, "invalid character in a name"))
            t.add("kw" if v in keywords else "id", v, i)
            i = m.end()
        elif m := _OPERATOR.match(text, i):
            v = m.group()
            depth = depth + 1 if v in "([{" else max(0, depth - 1) if v in ")]}" else depth
            t.add("op", v, i)
            i = m.end()
        else:
            t.errors.append((i, f"invalid character {c!r}"))
            i += 1
    if depth == 0 and t.kind and t.kind[-1] not in ("nl", "dedent", "indent"):
        t.add("nl", "\n", n)
    for _ in indents[1:]:
        t.add("dedent", "", n)
    for _ in range(5):
        t.add("eof", "", n, True)
    return t, fields


class Python(Parser):
    """Python 3."""

    BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
    AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
    WORDS, FORMATTED = PYTHON, True

    def __init__(self, text: str) -> None:
        tokens, self.fields = tokenize(text, self.WORDS, self.FORMATTED)
        super().__init__(tokens)

    def file(self) -> None:
        self.many(self.statement)
        for at, body in self.fields:
            inner = type(self)("(" + body + "\n)")
            try:
                inner.i = 1
                inner.stars()
                inner.need(")")
                wrong = inner.errors or inner.k[inner.i] not in ("nl", "eof")
            except Bad:
                wrong = True
            if wrong:
                self.errors.append((at, "invalid expression in an f-string"))

    def recover(self, before: int, stop: tuple[str, ...]) -> None:
        """On to the start of the next line."""
        self.i = max(self.i, before + 1)
        while self.k[self.i] not in ("nl", "eof", "dedent", "indent"):
            self.i += 1
        while self.k[self.i] in ("nl", "indent"):
            self.i += 1

    # statements
    def statement(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "indent":
            self.fail("unexpected indent")
        if k == "dedent":
            self.i += 1
            return
        if v == "\n":
            self.i += 1
            return
        f = self.COMPOUND.get(v) if k == "kw" else None
        if v == "@":
            f = Python.decorated
        if f is None and k == "id" and v == "match" and self.attempt(self.match):
            return
        if f is not None:
            f(self)
            return
        self.simple()
        while self.take(";"):
            if self.v[self.i] == "\n":
                break
            self.simple()
        if self.k[self.i] != "eof":
            self.need("\n")

    def block(self) -> None:
        self.need(":")
        if not self.take("\n"):
            self.simple()
            while self.take(";"):
                if self.v[self.i] == "\n":
                    break
                self.simple()
            self.need("\n")
            return
        while self.take("\n"):
            pass
        if self.k[self.i] != "indent":
            self.fail("expected an indented block")
        self.i += 1
        while self.k[self.i] not in ("dedent", "eof"):
            before = self.i
            try:
                self.statement()
            except Bad as e:
                self.note(e)
                self.recover(before, ())
        if self.k[self.i] == "dedent":
            self.i += 1

    def simple(self) -> None:
        v, k = self.v[self.i], self.k[self.i]
        if k == "kw" and v in self.SIMPLE:
            self.i += 1
            self.SIMPLE[v](self)
        elif k == "id" and v == "type" and self.attempt(self.alias):
            return
        else:
            self.expression_statement()

    def expression_statement(self) -> None:
        left = self.stars()
        if self.v[self.i] in self.AUGMENTED:
            if left not in ("name", "part"):
                self.fail("cannot assign to this expression")
            self.i += 1
            self.yields()
        elif self.take(":"):
            if left not in ("name", "part", "bracketed"):
                self.fail("cannot annotate this expression")
            self.expression()
            if self.take("="):
                self.yields()
        else:
            while self.take("="):
                if left not in ("name", "part", "target", "bracketed"):
                    self.fail("cannot assign to this expression")
                left = self.yields()

    def yields(self) -> str:
        if self.v[self.i] == "yield":
            self.atom()
            return "yield"
        return self.stars()

    def alias(self) -> None:
        self.need("type")
        self.name()
        self.type_parameters()
        self.need("=")
        self.expression()

    def returns(self) -> None:
        if self.v[self.i] not in ("\n", ";") and self.k[self.i] != "eof":
            self.stars()

    def raises(self) -> None:
        if self.v[self.i] not in ("\n", ";"):
            self.expression()
            if self.take("from"):
                self.expression()

    def asserts(self) -> None:
        self.expression()
        if self.take(","):
            self.expression()

    def deletes(self) -> None:
        if self.stars() not in ("name", "part", "target", "bracketed"):
            self.fail("cannot delete this expression")

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def imports(self) -> None:
        while True:
            self.dotted()
            if self.take("as"):
                self.name()
            if not self.take(","):
                return

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def from_import(self) -> None:
        dots = False
        while self.v[self.i] in (".", "..."):
            self.i += 1
            dots = True
        if not dots or self.v[self.i] != "import":
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        one = lambda: (self.name(), self.take("as") and self.name())
        if self.take("("):
            self.listed(one, ")", 1)
        else:
            one()
            while self.take(","):
                one()

    def nothing(self) -> None:
        pass

    def condition(self) -> None:
        self.i += 1
        self.named()
        self.block()

    def if_(self) -> None:
        self.condition()
        while self.v[self.i] == "elif":
            self.condition()
        self.else_()

    def else_(self) -> None:
        if self.take("else"):
            self.block()

    def while_(self) -> None:
        self.condition()
        self.else_()

    def for_(self) -> None:
        self.i += 1
        self.targets()
        self.need("in")
        self.stars()
        self.block()
        self.else_()

    def targets(self) -> None:
        while True:
            self.take("*")
            if self.binary() not in ("name", "part", "target", "bracketed"):
                self.fail("cannot assign to this expression")
            if not self.take(",") or self.v[self.i] in ("in", "="):
                return

    def try_(self) -> None:
        self.i += 1
        self.block()
        handlers = 0
        while self.take("except"):
            handlers += 1
            self.take("*")
            if self.v[self.i] != ":":
                self.expression()
                while self.take(","):
                    self.expression()
                if self.take("as"):
                    self.name()
            self.block()
        if handlers:
            self.else_()
        if self.take("finally"):
            self.block()
        elif not handlers:
            self.fail("expected 'except' or 'finally'")

    def with_(self) -> None:
        self.i += 1

        def item() -> None:
            self.expression()
            if self.take("as"):
                self.take("*")
                self.binary()

        def enclosed() -> bool:
            self.need("(")
            self.listed(item, ")", 1)
            return self.v[self.i] == ":"

        if not (self.v[self.i] == "(" and self.attempt(enclosed)):
            item()
            while self.take(","):
                item()
        self.block()

    def def_(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expression()
        self.block()

    def type_parameters(self) -> None:
        def one() -> None:
            self.take("*") or self.take("**")
            self.name()
            if self.take(":"):
                self.expression()
            if self.take("="):
                self.expression()

        if self.take("["):
            self.listed(one, "]", 1)

    def parameters(self, close: str, annotated: bool) -> None:
        """Parameters up to ``close``, in an order that is allowed."""
        defaulted = starred = slashed = False
        names: set[str] = set()

        def one(star: bool = False) -> None:
            name = self.name()
            if name in names:
                self.fail("repeated parameter")
            names.add(name)
            if annotated and self.take(":"):
                star and self.take("*")
                self.expression()

        n = 0
        while self.v[self.i] != close:
            if self.take("**"):
                one()
                self.take(",")
                return
            if self.take("*"):
                if starred:
                    self.fail("a second '*' in parameters")
                starred = True
                if self.v[self.i] == ",":
                    if self.v[self.i + 1] in (close, "**"):
                        self.fail("named parameters must follow '*'")
                else:
                    one(True)
            elif self.v[self.i] == "/":
                if slashed or starred or not n:
                    self.fail("'/' out of place")
                slashed = True
                self.i += 1
            else:
                one()
                if self.take("="):
                    defaulted = True
                    self.expression()
                elif defaulted and not starred:
                    self.fail("a parameter without a default follows one with a default")
            n += 1
            if not self.take(","):
                return

    def class_(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.take("("):
            self.arguments()
        self.block()

    def async_(self) -> None:
        self.i += 1
        if self.v[self.i] not in ("def", "for", "with"):
            self.fail("expected 'def', 'for' or 'with'")
        self.COMPOUND[self.v[self.i]](self)

    def decorated(self) -> None:
        while self.take("@"):
            self.named()
            self.need("\n")
            while self.take("\n"):
                pass
        if self.v[self.i] not in ("def", "class", "async"):
            self.fail("expected a definition after a decorator")
        self.COMPOUND[self.v[self.i]](self)

    def match(self) -> bool | None:
        self.need("match")
        if self.v[self.i + 1] == ":=":
            self.named()
        else:
            self.stars()
        self.need(":")
        self.need("\n")
        if self.k[self.i] != "indent":
            return False
        self.i += 1
        n = 0
        while self.v[self.i] == "case":
            self.i += 1
            self.pattern(True)
            if self.take("if"):
                self.named()
            self.block()
            n += 1
        if self.k[self.i] == "dedent":
            self.i += 1
            return n > 0
        return False

    def pattern(self, top: bool = False) -> None:
        def one() -> None:
            if self.take("*"):
                self.name()
                return
            closed()
            while self.take("|"):
                closed()
            if self.take("as"):
                self.name()

        def closed() -> None:
            if self.take("("):
                self.listed(one, ")")
            elif self.take("["):
                self.listed(one, "]")
            elif self.take("{"):

                def pair() -> None:
                    if self.take("**"):
                        self.name()
                        return
                    self.binary()
                    self.need(":")
                    one()

                self.listed(pair, "}")
            elif self.k[self.i] == "id":
                self.dotted()
                if self.take("("):

                    def argument() -> None:
                        if self.k[self.i] == "id" and self.v[self.i + 1] == "=":
                            self.i += 2
                        one()

                    self.listed(argument, ")")
            else:
                self.binary(5)

        one()
        while top and self.take(","):
            if self.v[self.i] in (":", "if"):
                break
            one()

    # expressions; each returns what it is as a target: name, part, target (a tuple or list of targets), bracketed or other
    def stars(self) -> str:
        """Expressions separated by commas, perhaps starred."""
        first = self.plain()
        if self.v[self.i] != ",":
            if first == "starred":
                self.fail("a starred expression needs a list or tuple")
            return first
        fine = first in ("name", "part", "target", "bracketed", "starred")
        while self.take(","):
            if self.v[self.i] in ("\n", "=", ")", "]", "}", ":", ";", "") or self.k[self.i] == "eof" or self.v[self.i] in self.AUGMENTED:
                break
            fine &= self.plain() in ("name", "part", "target", "bracketed", "starred")
        return "target" if fine else "other"

    def plain(self) -> str:
        """Like ``starred``, where an assignment expression needs brackets."""
        if self.take("*"):
            self.binary()
            return "starred"
        return self.expression()

    def starred(self) -> str:
        if self.take("*"):
            self.binary()
            return "starred"
        return self.named()

    def named(self) -> str:
        if self.k[self.i] == "id" and self.v[self.i + 1] == ":=":
            self.i += 2
            self.expression()
            return "other"
        return self.expression()

    def expression(self) -> str:
        if self.take("lambda"):
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "other"
        left = self.either()
        if self.v[self.i] == "if":
            self.i += 1
            self.either()
            self.need("else")
            self.expression()
            return "other"
        return left

    def either(self) -> str:
        left = self.both()
        while self.take("or"):
            self.both()
            left = "other"
        return left

    def both(self) -> str:
        left = self.inverted()
        while self.take("and"):
            self.inverted()
            left = "other"
        return left

    def inverted(self) -> str:
        if self.take("not"):
            self.inverted()
            return "other"
        return self.compared()

    def compared(self) -> str:
        left = self.binary()
        while True:
            v = self.v[self.i]
            if v in ("<", ">", "==", ">=", "<=", "!=", "in") and self.k[self.i] != "str":
                self.i += 1
            elif v == "is":
                self.i += 1
                self.take("not")
            elif v == "not" and self.v[self.i + 1] == "in":
                self.i += 2
            else:
                return left
            self.binary()
            left = "other"

    def unary(self) -> str:
        if self.v[self.i] in ("+", "-", "~") and self.k[self.i] == "op":
            self.i += 1
            self.unary()
            return "other"
        awaited = self.take("await")
        left = self.primary()
        if self.take("**"):
            self.unary()
            return "other"
        return "other" if awaited else left

    def primary(self) -> str:
        left = self.atom()
        while self.k[self.i] == "op":
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                self.name()
                left = "part"
            elif v == "(":
                self.i += 1
                self.arguments()
                left = "other"
            elif v == "[":
                self.i += 1
                self.listed(self.slice, "]", 1)
                left = "part"
            else:
                break
        return left

    def slice(self) -> None:
        if self.take("*"):
            self.binary()
            return
        if self.v[self.i] != ":":
            self.named()
        for _ in range(2):
            if self.take(":") and self.v[self.i] not in (":", "]", ","):
                self.expression()

    def arguments(self) -> None:
        """Call arguments up to and including the bracket."""
        keyed = unpacked = False
        n = 0
        while not self.take(")"):
            if n:
                self.need(",")
                if self.take(")"):
                    return
            if self.take("**"):
                self.expression()
                unpacked = True
            elif self.take("*"):
                self.expression()
                if unpacked:
                    self.fail("iterable unpacking follows keyword unpacking")
            elif self.k[self.i] == "id" and self.v[self.i + 1] == "=":
                self.i += 2
                self.expression()
                keyed = True
            else:
                self.named()
                if self.v[self.i] in ("for", "async"):
                    self.comprehension()
                    if n or self.v[self.i] != ")":
                        if not (n == 0 and self.v[self.i] == "," and self.v[self.i + 1] == ")"):
                            self.fail("a generator expression needs brackets")
                elif keyed or unpacked:
                    self.fail("a positional argument follows keyword arguments")
            n += 1

    def comprehension(self) -> None:
        n = 0
        while self.v[self.i] in ("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.either()
            while self.take("if"):
                self.condition_in()
            n += 1

    def condition_in(self) -> None:
        self.either()

    def atom(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "id":
            self.i += 1
            return "name"
        if k == "num" or v in ("True", "False", "None", "..."):
            self.i += 1
            return "other"
        if k == "str":
            kinds = set()
            while self.k[self.i] == "str":
                kinds.add(self.v[self.i])
                self.i += 1
            if len(kinds) > 1:
                self.fail("bytes and text side by side")
            return "other"
        if v == "(":
            self.i += 1
            return self.round()
        if v == "[":
            self.i += 1
            return self.square()
        if v == "{":
            self.i += 1
            return self.curly()
        if v == "yield" and k == "kw":
            self.i += 1
            if self.take("from"):
                self.expression()
            elif self.v[self.i] not in ("\n", ")", "]", "}", ";", "=") and k != "eof":
                self.stars()
            return "other"
        self.fail(f"invalid syntax at {v.strip() or k!r}")

    def round(self) -> str:
        if self.take(")"):
            return "target"
        if self.v[self.i] == "yield":
            self.atom()
            self.need(")")
            return "other"
        first = self.starred()
        if self.v[self.i] in ("for", "async"):
            self.comprehension()
            self.need(")")
            return "other"
        if self.take(")"):
            if first == "starred":
                self.fail("a starred expression in brackets")
            return "bracketed" if first in ("name", "part") else first
        fine = first in ("name", "part", "target", "bracketed", "starred")
        while self.take(","):
            if self.v[self.i] == ")":
                break
            fine &= self.starred() in ("name", "part", "target", "bracketed", "starred")
        self.need(")")
        return "target" if fine else "other"

    def square(self) -> str:
        if self.take("]"):
            return "target"
        fine = self.starred() in ("name", "part", "target", "bracketed", "starred")
        if self.v[self.i] in ("for", "async"):
            self.comprehension()
            self.need("]")
            return "other"
        while self.take(","):
            if self.v[self.i] == "]":
                break
            fine &= self.starred() in ("name", "part", "target", "bracketed", "starred")
        self.need("]")
        return "target" if fine else "other"

    SETS = True

    def curly(self) -> str:
        if self.take("}"):
            return "other"
        kind = None
        while True:
            if self.take("**"):
                self.binary()
                this = "dict"
            else:
                self.starred()
                this = "dict" if self.take(":") else "set"
                if this == "set" and not self.SETS:
                    self.fail("sets are not allowed")
                if this == "dict":
                    self.expression()
            if kind not in (None, this):
                self.fail("a set and a dict in one")
            if kind is None and self.v[self.i] in ("for", "async"):
                self.comprehension()
                break
            kind = this
            if not self.take(",") or self.v[self.i] == "}":
                break
        self.need("}")
        return "other"

    SIMPLE = {
        "return": returns, "raise": raises, "assert": asserts, "del": deletes, "global": names, "nonlocal": names, "import": imports,
        "from": from_import, "pass": nothing, "break": nothing, "continue": nothing,
    }
    COMPOUND = {"if": if_, "while": while_, "for": for_, "try": try_, "with": with_, "def": def_, "class": class_, "async": async_}


class Starlark(Python):
    """Starlark; its restrictions on the top level are not applied."""

    WORDS, FORMATTED, SETS = STARLARK, False, False
    AUGMENTED = frozenset("+= -= *= /= //= %= &= |= ^= >>= <<=".split())
    BINARY = {k: v for k, v in Python.BINARY.items() if k != "@"}
    SIMPLE = {"return": Python.returns, "pass": Python.nothing, "break": Python.nothing, "continue": Python.nothing}
    COMPOUND = {"if": Python.if_, "for": Python.for_, "def": Python.def_}

    def statement(self) -> None:
        if self.v[self.i] == "@" or self.k[self.i] == "kw" and self.v[self.i] not in (*self.SIMPLE, *self.COMPOUND, "not", "lambda"):
            self.fail(f"{self.v[self.i]!r} is not allowed")
        if self.k[self.i] == "id" and self.v[self.i] in ("match", "type"):
            self.simple()
            self.need("\n")
            return
        super().statement()

    def expression_statement(self) -> None:
        left = self.stars()
        if self.v[self.i] == ":":
            self.fail("annotations are not allowed")
        if self.v[self.i] in self.AUGMENTED:
            self.i += 1
            if left not in ("name", "part"):
                self.fail("cannot assign to this expression")
            self.stars()
        elif self.take("="):
            if left not in ("name", "part", "target", "bracketed"):
                self.fail("cannot assign to this expression")
            self.stars()

    def atom(self) -> str:
        if self.v[self.i] == "yield" and self.k[self.i] == "kw":
            self.fail("'yield' is not allowed")
        return super().atom()

    def run(self) -> list[tuple[int, str]]:
        for j, v in enumerate(self.v):
            if v == ":=" and self.k[j] == "op":
                self.note(Bad("':=' is not allowed", self.p[j]))
        return super().run()

    def else_(self) -> None:
        super().else_()

    def for_(self) -> None:
        self.i += 1
        self.targets()
        self.need("in")
        self.stars()
        self.block()

    COMPOUND = {"if": Python.if_, "for": for_, "def": Python.def_}

    def compared(self) -> str:
        left = self.binary()
        n = 0
        while True:
            v = self.v[self.i]
            if v in ("<", ">", "==", ">=", "<=", "!=", "in") and self.k[self.i] != "str":
                self.i += 1
            elif v == "not" and self.v[self.i + 1] == "in":
                self.i += 2
            else:
                return left
            n += 1
            if n > 1:
                self.fail("comparisons don't chain")
            self.binary()
            left = "other"

    def unary(self) -> str:
        if self.v[self.i] in ("+", "-", "~") and self.k[self.i] == "op":
            self.i += 1
            self.unary()
            return "other"
        return self.primary()
