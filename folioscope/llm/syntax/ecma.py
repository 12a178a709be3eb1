"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from .base import Bad, Parser, Tokens, scan

# Reserved words.
KEYWORDS = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if
    import in instanceof new null return super switch this throw true try typeof var void while with""".split()
)
_PATTERN = re.compile(
    r"""(?P<space>[ \t\f\v\r\n\xa0﻿  ]+)|(?P<comment>//[^\r\n]*|/\*.*?\*/)|(?P<id>\#?[^\W\d][\w$]*|\#?\$[\w$]*|\#?\\u[\w{}$]+)
    |(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?)
    |(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')
    |(?P<op>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^~!<>=?:;,.(){}\[\]@`])
    |(?P<bad>/\*|["'])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_BEFORE_VALUE = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => == != === !== <= >= && || ?? += -= *= /= %= ** **= <<= &= |= ^= &&= ||= ??= << ... ${".split())
_WORDS_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof await yield".split())


def tokenize(text: str) -> Tokens:
    """Tokens; a template is one, and what stands in its ${} is tokenized in place as ( ... )."""
    tokens = Tokens()
    opened: list[int] = []  # depth of braces at which each open ${ } ends
    depth = [0]
    rounds: list[bool] = []  # for each open round bracket, whether it holds the condition of a statement
    condition = [False]  # whether the last one closed did

    def template(i: int, newline: bool, first: bool) -> int:
        j, n = i, len(text)
        while j < n:
            c = text[j]
            if c == "\\":
                j += 2
            elif c == "`":
                if not first:
                    tokens.add("op", ")", j)
                tokens.add("str", "`", i, newline) if first else None
                return j + 1
            elif c == "$" and text[j + 1 : j + 2] == "{":
                if first:
                    tokens.add("str", "`", i, newline)
                    tokens.add("op", "${", j)
                else:
                    tokens.add("op", ",", j)
                opened.append(depth[0])
                return j + 2
            else:
                j += 1
        tokens.errors.append((i, "unterminated template"))
        return n

    def special(kind, m, t, newline):
        v = m.group()
        if v == "`" and kind == "op":
            return template(m.end(), newline, True)
        if kind == "op" and v[0] == "/":
            last, lk = (t.value[-1], t.kind[-1]) if t.value else (";", "op")
            if lk == "op" and (last in _BEFORE_VALUE or last == ")" and condition[0]) or lk in ("kw", "id") and last in _WORDS_BEFORE_VALUE:
                r = _REGEX.match(text, m.start())
                if r is None:
                    t.errors.append((m.start(), "malformed regular expression"))
                    return None
                t.add("num", "/", m.start(), newline)
                return r.end()
        if kind == "op" and v == "(":
            before = t.value[-2:] if len(t.value) > 1 else ["", *t.value]
            word = bool(t.kind) and t.kind[-1] == "kw" and before[-1] in ("if", "while", "for", "with") and before[0] != "."
            rounds.append(word or before == ["for", "await"])
        elif kind == "op" and v == ")":
            condition[0] = bool(rounds) and rounds.pop()
        elif kind == "op" and v == "{":
            depth[0] += 1
        elif kind == "op" and v == "}":
            if opened and opened[-1] == depth[0]:
                opened.pop()
                return template(m.end(), newline, False)
            depth[0] -= 1
        elif kind == "num" and (x := re.match(r"[\w$]", text[m.end() : m.end() + 1])) and x:
            t.errors.append((m.end(), "a name right after a number"))
        return None

    text = text if not text.startswith("#!") else "//" + text[2:]
    return scan(text, _PATTERN, KEYWORDS, tokens, special)


class JavaScript(Parser):
    """JavaScript: scripts and modules alike."""

    TYPES = False
    BINARY = {
        "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
        "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
    }
    RIGHT = frozenset(("**",))
    ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())

    def __init__(self, text: str) -> None:
        super().__init__(tokenize(text))
        self.no_in = False
        self.branch = False  # inside a conditional, up to its colon
        self.in_function = False
        self.awaits = True  # at the top of a module
        self.yields = False

    def inside_function(self, parse, awaits: bool, yields: bool) -> None:
        """``parse`` a part of a function of this kind."""
        saved = self.in_function, self.awaits, self.yields, self.no_in, self.branch
        self.in_function, self.awaits, self.yields, self.no_in, self.branch = True, awaits, yields, False, False
        try:
            parse()
        finally:
            self.in_function, self.awaits, self.yields, self.no_in, self.branch = saved

    def file(self) -> None:
        self.many(self.statement)

    def end(self) -> None:
        """A semicolon, or what stands for one."""
        if self.take(";") or self.v[self.i] == "}" or self.k[self.i] == "eof" or self.n[self.i]:
            return
        self.fail(f"expected ';' instead of {self.v[self.i]!r}")

    def any_name(self) -> None:
        if self.k[self.i] not in ("id", "kw"):
            self.fail("expected a name")
        self.i += 1

    # types have no place in JavaScript
    def annotation(self) -> None:
        pass

    def generics(self) -> None:
        pass

    def declared(self, v: str) -> bool:
        return False

    # statements
    def statement(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if v == "{" and k == "op":
            self.block()
        elif v == ";":
            self.i += 1
        elif k == "kw" and v in self.STATEMENTS and not (v == "import" and self.v[self.i + 1] in ("(", ".")):
            self.STATEMENTS[v](self)
        elif v == "@" and k == "op":
            self.decorators()
            if self.v[self.i] not in ("class", "export", "abstract"):
                self.fail("expected a class after a decorator")
            self.statement()
        elif k == "id" and v == "let" and (self.k[self.i + 1] == "id" or self.v[self.i + 1] in ("[", "{")):
            self.variables()
            self.end()
        elif k == "id" and v == "async" and self.v[self.i + 1] == "function" and not self.n[self.i + 1]:
            self.i += 1
            self.function()
        elif k == "id" and self.v[self.i + 1] == ":" and self.k[self.i + 1] == "op":
            self.i += 2
            self.statement()
        elif k == "id" and self.declared(v):
            return
        else:
            self.expression()
            self.end()

    def block(self) -> None:
        self.need("{")
        self.many(self.statement, ("}",))
        self.need("}")

    def variables(self) -> None:
        const = self.v[self.i] == "const"
        self.i += 1
        self.valued = False
        while True:
            pattern = self.v[self.i] in ("{", "[")
            self.binding()
            self.take("!")
            self.annotation()
            if self.take("="):
                self.assignment()
                self.valued = True
            elif (const or pattern) and self.v[self.i] not in ("of", "in") and not self.ambient:
                self.fail("a declaration without a value")
            if not self.take(","):
                return

    ambient = valued = False

    def binding(self) -> None:
        def element() -> None:
            if self.v[self.i] == ",":
                return
            self.take("...")
            self.binding()
            if self.take("="):
                self.assignment()

        def member() -> None:
            if self.take("..."):
                self.binding()
                return
            short = self.k[self.i] == "id"
            self.key()
            if self.take(":"):
                self.binding()
            elif not short:
                self.fail("expected ':'")
            if self.take("="):
                self.assignment()

        if self.take("["):
            while self.take(","):
                pass
            self.listed(element, "]")
        elif self.take("{"):
            self.listed(member, "}")
        elif self.v[self.i] == "this" and self.TYPES:
            self.i += 1
        else:
            self.name()

    def var(self) -> None:
        if self.v[self.i] == "const" and self.v[self.i + 1] == "enum" and self.TYPES:
            self.i += 1
            self.statement()
            return
        self.variables()
        self.end()

    def if_(self) -> None:
        self.i += 1
        self.bracketed()
        self.embedded()
        if self.take("else"):
            self.embedded()

    def embedded(self, loop: bool = False) -> None:
        """A statement that may not declare anything but, outside a loop, a plain function."""
        k, v = self.k[self.i], self.v[self.i]
        declares = v in ("class", "const") or v == "function" and (loop or self.v[self.i + 1] == "*")
        if k == "kw" and declares and not (self.TYPES and v == "const" and self.v[self.i + 1] == "enum") or v == "let" and self.v[self.i + 1] == "[":
            self.fail(f"a declaration with {v!r} needs a block")
        self.statement()

    def bracketed(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if not self.take(";"):
            if self.v[self.i] in ("var", "const") or self.v[self.i] == "let" and (self.k[self.i + 1] == "id" or self.v[self.i + 1] in ("[", "{")):
                self.no_in = True
                plain = self.v[self.i] == "var"
                self.variables()
                self.no_in = False
                if self.valued and (self.v[self.i] == "of" or self.v[self.i] == "in" and not plain):
                    self.fail("a loop variable with a value")
            else:
                self.no_in = True
                self.expression()
                self.no_in = False
            if self.v[self.i] in ("of", "in"):
                self.i += 1
                self.expression()
                self.need(")")
                self.embedded(True)
                return
            self.need(";")
        if self.v[self.i] != ";":
            self.expression()
        self.need(";")
        if self.v[self.i] != ")":
            self.expression()
        self.need(")")
        self.embedded(True)

    def while_(self) -> None:
        self.i += 1
        self.bracketed()
        self.embedded(True)

    def do(self) -> None:
        self.i += 1
        self.embedded(True)
        self.need("while")
        self.bracketed()
        self.take(";")

    def jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "id" and not self.n[self.i]:
            self.i += 1
        self.end()

    def return_(self) -> None:
        if not self.in_function:
            self.note(Bad("'return' outside a function", self.p[self.i]))
        self.i += 1
        if self.v[self.i] not in (";", "}") and not self.n[self.i] and self.k[self.i] != "eof":
            self.expression()
        self.end()

    def throw(self) -> None:
        self.i += 1
        if self.n[self.i]:
            self.fail("a line end after 'throw'")
        self.expression()
        self.end()

    def try_(self) -> None:
        self.i += 1
        self.block()
        if self.take("catch"):
            if self.take("("):
                self.binding()
                self.annotation()
                self.need(")")
            self.block()
            if self.take("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def switch(self) -> None:
        self.i += 1
        self.bracketed()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            self.many(self.statement, ("case", "default", "}"))

    def with_(self) -> None:
        self.while_()

    def debugger(self) -> None:
        self.i += 1
        self.end()

    def function_statement(self) -> None:
        self.function()

    def import_(self) -> None:
        self.i += 1
        if self.TYPES and self.v[self.i] == "type" and (self.k[self.i + 1] == "id" and self.v[self.i + 1] != "from" or self.v[self.i + 1] in ("{", "*")):
            self.i += 1
        if self.k[self.i] != "str":
            if self.k[self.i] == "id":
                self.i += 1
                if self.TYPES and self.take("="):
                    self.expression()
                    self.end()
                    return
                if self.v[self.i] == ",":
                    self.i += 1
                    if self.v[self.i] not in ("{", "*"):
                        self.fail("expected imports")
            if self.take("*"):
                self.need("as")
                self.name()
            elif self.take("{"):
                self.listed(self.specifier, "}")
            self.need("from")
            if self.k[self.i] != "str":
                self.fail("expected a module")
        self.i += 1
        if self.v[self.i] in ("with", "assert") and self.v[self.i + 1] == "{":
            self.i += 1
            self.primary()
        self.end()

    def specifier(self) -> None:
        if self.TYPES and self.v[self.i] == "type" and self.v[self.i + 1] not in (",", "}", "as"):
            self.i += 1
        self.i += 1 if self.k[self.i] in ("id", "kw", "str") else self.fail("expected a name")
        if self.take("as"):
            self.i += 1

    def export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.v[self.i] in ("function", "class", "abstract", "interface", "@") or self.v[self.i] == "async" and self.v[self.i + 1] == "function":
                self.optional_name = True
                try:
                    self.statement()
                finally:
                    self.optional_name = False
            else:
                self.assignment()
                self.end()
            return
        if self.TYPES and (self.v[self.i] == "=" or self.v[self.i] == "as" and self.v[self.i + 1] == "namespace"):
            self.i += 1
            self.expression()
            self.end()
            return
        if self.TYPES and self.v[self.i] == "type" and self.v[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.any_name()
            self.need("from")
            self.i += 1 if self.k[self.i] == "str" else self.fail("expected a module")
            self.end()
        elif self.take("{"):
            self.listed(self.specifier, "}")
            if self.take("from"):
                self.i += 1 if self.k[self.i] == "str" else self.fail("expected a module")
            self.end()
        elif self.k[self.i] in ("kw", "id") or self.v[self.i] == "@":
            if self.v[self.i] not in ("var", "const", "let", "function", "class", "async", "enum", "@") and not (self.TYPES and self.v[self.i] in ("type", "interface", "abstract", "declare", "namespace", "module", "import")):
                self.fail("expected a declaration")
            self.statement()
        else:
            self.fail("expected a declaration")

    optional_name = False

    def decorators(self) -> None:
        while self.take("@"):
            if self.take("("):
                self.expression()
                self.need(")")
            else:
                self.name()
                while self.take("."):
                    self.any_name()
                if self.v[self.i] == "(":
                    self.i += 1
                    self.listed(self.argument, ")")

    def function(self) -> None:
        awaits = self.v[self.i - 1] == "async" and self.i > 0 and not self.n[self.i]
        self.need("function")
        yields = self.take("*")
        if self.k[self.i] == "id":
            self.i += 1
        elif not self.optional_name and self.v[self.i] != "(":
            self.fail("expected a name")
        self.optional_name = False
        self.inside_function(lambda: (self.signature(), self.body()), awaits, yields)

    def body(self) -> None:
        self.block()

    def signature(self) -> None:
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        self.returned()

    def returned(self) -> None:
        self.annotation()

    def parameter(self) -> None:
        self.decorators()
        while self.TYPES and self.v[self.i] in ("public", "private", "protected", "readonly", "override") and (self.k[self.i + 1] == "id" or self.v[self.i + 1] in ("{", "[")):
            self.i += 1
        self.take("...")
        self.binding()
        if self.TYPES:
            self.take("?")
        self.annotation()
        if self.take("="):
            self.assignment()

    def class_(self) -> None:
        self.need("class")
        if self.k[self.i] == "id" and self.v[self.i] != "implements":
            self.i += 1
        elif not (self.optional_name or self.inside):
            self.fail("expected a name")
        self.optional_name = False
        self.generics()
        if self.take("extends"):
            self.postfix(False)
            if self.TYPES:
                self.attempt(self.type_arguments)
        if self.TYPES and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        outer, self.constructors = self.constructors, 0
        self.many(self.member, ("}",))
        self.constructors = outer
        self.need("}")

    constructors = 0
    inside = False
    MODIFIERS = ("static", "async", "get", "set", "accessor")

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        first = self.i
        while self.v[self.i] in self.MODIFIERS and (self.v[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<") and not (self.n[self.i + 1] and self.v[self.i] not in ("static", "get", "set", "public", "private", "protected"))):
            self.i += 1
        if self.v[self.i] == "{" and self.v[self.i - 1] == "static":
            self.block()
            return
        awaits = "async" in self.v[first : self.i]
        yields = self.take("*")
        builds = self.v[self.i] == "constructor" and "static" not in self.v[first : self.i]
        if self.TYPES and self.v[self.i] == "[" and self.k[self.i + 1] == "id" and self.v[self.i + 2] == ":":
            self.type_member()
            self.end()
            return
        self.key(True)
        if self.TYPES:
            self.take("?") or self.take("!")
        if self.v[self.i] in ("(", "<"):

            def method() -> None:
                self.signature()
                if self.v[self.i] != "{" and self.TYPES:
                    self.end()
                    return
                if builds:
                    self.constructors += 1
                    if self.constructors > 1:
                        self.note(Bad("a second constructor", self.p[self.i]))
                self.body()

            self.inside_function(method, awaits, yields)
            return
        self.annotation()
        if self.take("="):
            self.assignment()
        self.end()

    def key(self, private: bool = False) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.k[self.i] in ("id", "kw", "str", "num"):
            self.i += 1
        else:
            self.fail(f"expected a key instead of {self.v[self.i]!r}")

    # expressions
    def expression(self) -> str:
        left = self.assignment()
        while self.take(","):
            self.assignment()
            left = "other"
        return left

    def assignment(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if v == "async" and k == "id" and not self.n[self.i + 1] and (self.k[self.i + 1] == "id" or self.v[self.i + 1] in ("(", "<")) and self.attempt(self.async_arrow):
            return "other"
        if k == "id" and self.v[self.i + 1] == "=>":
            self.i += 1
            self.arrow()
            return "other"
        if v in ("(", "<") and k == "op" and self.arrow_ahead():
            # In a conditional, "(b) : c => d" is an arrow function with a result type only if the colon follows it.
            typed = v == "(" and self.branch and self.v[self.closing(self.i) + 1] == ":"
            if typed:
                if self.attempt(lambda: self.arrow_head() and (self.arrow_body(), self.v[self.i] == ":")[1]):
                    return "other"
            elif self.attempt(self.arrow_head):
                self.arrow_body()
                return "other"
        if v == "yield" and k == "id" and self.yields and self.v[self.i + 1] not in self.ASSIGN and self.v[self.i + 1] not in (".", "=>"):
            self.i += 1
            self.take("*")
            if not self.n[self.i] and self.v[self.i] not in (")", "]", "}", ",", ";", ":") and self.k[self.i] != "eof":
                self.assignment()
            return "other"
        left = self.conditional()
        if self.v[self.i] in self.ASSIGN and self.k[self.i] == "op":
            if left not in ("name", "part", "pattern"):
                self.fail("cannot assign to this expression")
            self.i += 1
            self.assignment()
            return "other"
        if left == "shorthand":
            self.fail("a default outside a pattern")
        return left

    def arrow_ahead(self) -> bool:
        """Whether the bracket that opens here closes before '=>' (or, with types, ':')."""
        if self.v[self.i] == "<":
            return self.TYPES
        after = self.v[self.closing(self.i) + 1]
        return after == "=>" or self.TYPES and after == ":"

    def arrow_head(self) -> bool:
        self.signature()
        return self.v[self.i] == "=>" and not self.n[self.i]

    def async_arrow(self) -> bool:
        self.i += 1
        if self.k[self.i] == "id":
            self.i += 1
            if self.v[self.i] != "=>":
                return False
        elif not self.arrow_head():
            return False
        self.arrow(True)
        return True

    def arrow(self, awaits: bool = False) -> None:
        if self.n[self.i]:
            self.fail("a line end before '=>'")
        self.arrow_body(awaits)

    def arrow_body(self, awaits: bool = False) -> None:
        self.need("=>")
        if self.v[self.i] == "{" and self.k[self.i] == "op":
            self.inside_function(self.block, awaits, False)
        else:
            no_in, branch = self.no_in, self.branch

            def value() -> None:
                self.no_in, self.branch = no_in, branch
                self.assignment()

            self.inside_function(value, awaits, False)

    def conditional(self) -> str:
        left = self.binary()
        if self.v[self.i] == "?" and self.k[self.i] == "op":
            self.i += 1
            saved, self.no_in, self.branch = (self.no_in, self.branch), False, True
            try:
                self.assignment()
            finally:
                self.no_in, self.branch = saved
            self.need(":")
            self.assignment()
            return "other"
        return left

    def binary(self, least: int = 0) -> str:
        started = self.i
        left = self.unary()
        signed = self.k[started] == "op" and self.v[started] in ("+", "-", "!", "~") or self.k[started] == "kw" and self.v[started] in ("typeof", "void", "delete")
        mixed = ""  # the logical operator of this level, which doesn't go with ?? without brackets
        while True:
            op = self.v[self.i]
            rank = self.BINARY.get(op) if self.k[self.i] in ("op", "kw") else None
            if op == ">" and rank and self.v[self.i + 1] in (">", ">=") and self.p[self.i + 1] == self.p[self.i] + 1:
                if self.v[self.i + 1] == ">=" or self.v[self.i + 2] == ">=" and self.p[self.i + 2] == self.p[self.i] + 2:
                    if left not in ("name", "part"):
                        self.fail("cannot assign to this expression")
                    self.i += 2 + (self.v[self.i + 1] == ">")
                    self.assignment()
                    return "other"
                rank = 9
                if rank < least:
                    return left
                self.i += 2 if self.v[self.i + 2] != ">" or self.p[self.i + 2] != self.p[self.i] + 2 else 3
                self.binary(rank + 1)
                left = "other"
                continue
            if self.TYPES and self.k[self.i] == "id" and op in ("as", "satisfies") and not self.n[self.i] and least <= 8:
                self.i += 1
                if not self.take("const"):
                    self.type()
                left = "part" if op == "as" else "other"
                continue
            if rank is None or rank < least or op == "in" and self.no_in:
                return left
            if op == "**" and signed:
                self.fail("a signed value before '**' needs brackets")
            if op in ("??", "||", "&&"):
                kind = "??" if op == "??" else "logical"
                if mixed and mixed != kind:
                    self.fail("'??' beside '&&' or '||' needs brackets")
                mixed = kind
            self.i += 1
            inner = self.i
            self.binary(rank if op in self.RIGHT else rank + 1)
            if op == "??" and self.logical(inner):
                self.fail("'??' beside '&&' or '||' needs brackets")
            signed = False
            left = "other"

    def logical(self, i: int) -> bool:
        """Whether '&&' or '||' stands outside brackets in what has been parsed since ``i``."""
        while i < self.i:
            if self.k[i] == "op":
                if self.v[i] in ("(", "[", "{", "${"):
                    i = self.closing(i)
                elif self.v[i] in ("&&", "||"):
                    return True
            i += 1
        return False

    def unary(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "op" and v in ("!", "~", "+", "-") or k == "kw" and v in ("typeof", "void", "delete") or v == "await" and k == "id" and self.awaits and not self.n[self.i + 1] and (self.k[self.i + 1] in ("id", "kw", "num", "str") and self.v[self.i + 1] not in ("in", "instanceof", "of") or self.v[self.i + 1] in ("(", "[", "{", "!", "+", "-")):
            self.i += 1
            self.unary()
            return "other"
        if v in ("++", "--") and k == "op":
            self.i += 1
            if self.unary() not in ("name", "part"):
                self.fail("cannot count this expression up or down")
            return "other"
        if self.TYPES and v == "<" and k == "op":
            self.i += 1
            self.take("const") or self.type()
            self.close()
            return self.unary()
        left = self.postfix()
        if self.v[self.i] in ("++", "--") and not self.n[self.i]:
            if left not in ("name", "part"):
                self.fail("cannot count this expression up or down")
            self.i += 1
            return "other"
        return left

    def argument(self) -> None:
        self.take("...")
        saved, self.no_in = self.no_in, False
        self.assignment()
        self.no_in = saved

    def postfix(self, calls: bool = True) -> str:
        if self.take("new"):
            if self.take("."):
                self.any_name()
                left = "other"
            else:
                self.postfix(False)
                if self.TYPES:
                    self.attempt(self.type_arguments)
                if self.take("("):
                    self.listed(self.argument, ")")
                left = "other"
        else:
            left = self.primary()
        while True:
            k, v = self.k[self.i], self.v[self.i]
            if k == "str" and v == "`":
                self.i += 1
                self.holes()
                left = "other"
                continue
            if k != "op":
                return left
            if v == ".":
                self.i += 1
                self.any_name()
                left = "part"
            elif v == "?.":
                self.i += 1
                if self.take("("):
                    self.listed(self.argument, ")")
                elif self.take("["):
                    self.expression()
                    self.need("]")
                else:
                    self.any_name()
                left = "other"
            elif v == "[":
                self.i += 1
                saved, self.no_in = self.no_in, False
                self.expression()
                self.no_in = saved
                self.need("]")
                left = "part"
            elif v == "(" and calls:
                self.i += 1
                self.listed(self.argument, ")")
                left = "other"
            elif v == "!" and self.TYPES and not self.n[self.i] and self.v[self.i + 1] not in ("=", "=="):
                self.i += 1
            elif v == "<" and self.TYPES and calls and self.attempt(lambda: (self.type_arguments(), self.v[self.i] == "(")[1]):
                pass
            else:
                return left

    def holes(self) -> None:
        if self.v[self.i] == "${":
            self.i += 1
            self.listed(self.expression_item, ")", 1, trailing=False)

    def expression_item(self) -> None:
        self.assignment()

    def primary(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "id":
            if v == "async" and self.v[self.i + 1] == "function" and not self.n[self.i + 1]:
                self.i += 1
                self.optional_name = True
                self.function()
                return "other"
            self.i += 1
            return "name"
        if k == "num" or k == "kw" and v in ("this", "null", "true", "false", "super"):
            self.i += 1
            return "other"
        if k == "str":
            self.i += 1
            self.holes()
            return "other"
        if v == "(":
            self.i += 1
            saved, self.no_in = self.no_in, False
            left = self.expression()
            self.no_in = saved
            self.need(")")
            return left if left in ("name", "part") else "other"
        if v == "[":
            self.i += 1

            def element() -> None:
                while self.v[self.i] == ",":
                    self.i += 1
                if self.v[self.i] != "]":
                    self.argument()

            if self.v[self.i] != "]":
                element()
                while self.take(","):
                    if self.v[self.i] == "]":
                        break
                    element()
            self.need("]")
            return "pattern"
        if v == "{":
            self.i += 1
            kind = ["pattern"]

            def member() -> None:
                if self.take("..."):
                    self.assignment()
                    return
                first = self.i
                while self.v[self.i] in ("get", "set", "async") and self.v[self.i + 1] not in ("(", ",", ":", "}", "="):
                    self.i += 1
                awaits = "async" in self.v[first : self.i]
                starred = self.take("*")
                plain = self.k[self.i] == "id"
                self.key()
                if self.v[self.i] in ("(", "<"):
                    self.inside_function(lambda: (self.signature(), self.body()), awaits, starred)
                elif starred or self.i - first > 1 and self.v[first] in ("get", "set", "async") and self.v[first + 1] != "[" and first + 1 == self.i - 1 and self.v[self.i] != "(":
                    self.fail("expected a method")
                elif self.take(":"):
                    self.argument()
                elif not plain:
                    self.fail("expected ':'")
                elif self.take("="):
                    self.assignment()
                    kind[0] = "shorthand"

            self.listed(member, "}")
            return "pattern" if kind[0] == "pattern" or self.v[self.i] in ("=", "of", "in") else "shorthand"
        if v == "function" and k == "kw":
            self.optional_name = True
            self.function()
            return "other"
        if v in ("class", "@"):
            self.decorators()
            saved, self.inside = self.inside, True
            try:
                self.class_()
            finally:
                self.inside = saved
            return "other"
        if v == "import" and self.v[self.i + 1] in ("(", "."):
            self.i += 1
            if self.take("."):
                self.any_name()
            return "other"
        self.fail(f"unexpected {v or k!r}")

    STATEMENTS = {
        "var": var, "const": var, "if": if_, "for": for_, "while": while_, "do": do, "break": jump, "continue": jump, "return": return_,
        "throw": throw, "try": try_, "switch": switch, "with": with_, "debugger": debugger, "function": function_statement,
        "class": class_, "import": import_, "export": export,
    }


class TypeScript(JavaScript):
    """TypeScript."""

    TYPES = True
    MODIFIERS = ("static", "async", "get", "set", "accessor", "public", "private", "protected", "readonly", "abstract", "declare", "override")

    def annotation(self) -> None:
        if self.take(":"):
            self.type()

    def returned(self) -> None:
        if self.take(":"):
            if self.v[self.i] == "asserts" and self.k[self.i + 1] in ("id", "kw") and not self.n[self.i + 1]:
                self.i += 1
            if self.k[self.i] in ("id", "kw") and self.v[self.i + 1] == "is" and not self.n[self.i + 1]:
                self.i += 2
            self.type()

    def generics(self) -> None:
        def one() -> None:
            while self.v[self.i] in ("const", "in", "out") and self.k[self.i + 1] == "id":
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()

        if self.take("<"):
            one()
            while self.take(","):
                if self.v[self.i] == ">":
                    break
                one()
            self.close()

    def close(self) -> None:
        """One '>' of perhaps several that were read together."""
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.close()

    def body(self) -> None:
        if self.v[self.i] == "{":
            self.block()
        else:
            self.end()  # an overload or an ambient function

    def declared(self, v: str) -> bool:
        after, k = self.v[self.i + 1], self.k[self.i + 1]
        if self.n[self.i + 1]:
            return False
        if v == "type" and k == "id":
            self.i += 2
            self.generics()
            self.need("=")
            self.type()
            self.end()
        elif v == "interface" and k == "id":
            self.i += 2
            self.generics()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.object_type()
        elif v in ("namespace", "module") and k in ("id", "str") or v == "global" and after == "{":
            self.i += 1
            if k == "str":
                self.i += 1
            elif v != "global":
                self.name()
                while self.take("."):
                    self.name()
            self.block()
        elif v == "declare" and k in ("id", "kw"):
            self.i += 1
            saved, self.ambient = self.ambient, True
            try:
                self.statement()
            finally:
                self.ambient = saved
        elif v == "abstract" and after == "class":
            self.i += 1
            self.class_()
        else:
            return False
        return True

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")

        def one() -> None:
            self.key()
            if self.take("="):
                self.assignment()

        self.listed(one, "}")

    STATEMENTS = JavaScript.STATEMENTS | {"enum": enum}

    # types
    plain_extends = False  # in the right side of a conditional type, where another one needs brackets

    def type(self) -> None:
        saved, self.plain_extends = self.plain_extends, False
        try:
            if self.function_type_ahead():
                self.function_type()
                return
            self.union()
            if self.v[self.i] == "extends" and not self.n[self.i]:
                self.i += 1
                self.plain_extends = True
                self.union()
                self.plain_extends = False
                self.need("?")
                self.type()
                self.need(":")
                self.type()
        finally:
            self.plain_extends = saved

    def function_type_ahead(self) -> bool:
        """Whether a function or constructor type begins here: its bracket is followed by '=>'."""
        v = self.v[self.i]
        if v in ("<", "new") or v == "abstract" and self.v[self.i + 1] == "new":
            return True
        return v == "(" and self.k[self.i] == "op" and self.v[self.closing(self.i) + 1] == "=>"

    def constraint(self) -> bool:
        """What an inferred type extends, unless that begins a conditional type."""
        self.need("extends")
        self.union()
        return self.plain_extends or self.v[self.i] != "?"

    def function_type(self) -> None:
        self.take("abstract")
        self.take("new")
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        self.need("=>")
        if self.v[self.i] == "asserts" and self.k[self.i + 1] == "id":
            self.i += 1
        if self.k[self.i] in ("id", "kw") and self.v[self.i + 1] == "is":
            self.i += 2
        self.type()

    def union(self) -> None:
        self.take("|") or self.take("&")
        self.one_type()
        while self.v[self.i] in ("|", "&") and self.k[self.i] == "op":
            self.i += 1
            self.one_type()

    def one_type(self) -> None:
        while self.v[self.i] in ("keyof", "readonly", "unique", "infer") and (self.k[self.i + 1] in ("id", "kw", "str") or self.v[self.i + 1] in ("(", "[", "{")):
            self.i += 1
            if self.v[self.i - 1] == "infer" and self.k[self.i] == "id":
                self.i += 1
                if self.v[self.i] == "extends":
                    self.attempt(self.constraint)
                return
        k, v = self.k[self.i], self.v[self.i]
        if v == "(" and k == "op":
            if self.function_type_ahead():
                self.function_type()
            else:
                self.i += 1
                self.type()
                self.need(")")
        elif v == "{" and k == "op":
            self.object_type()
        elif v == "[" and k == "op":
            self.i += 1

            def element() -> None:
                self.take("...")
                if self.k[self.i] == "id" and (self.v[self.i + 1] == ":" or self.v[self.i + 1] == "?" and self.v[self.i + 2] == ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")

            self.listed(element, "]")
        elif k == "str":
            self.i += 1
            if self.take("${"):
                self.listed(self.type, ")", 1, trailing=False)
        elif k == "num" or v == "-" and self.k[self.i + 1] == "num":
            self.i += 1 + (v == "-")
        elif v == "typeof":
            self.i += 1
            self.any_name()
            while self.take("."):
                self.any_name()
            self.attempt(self.type_arguments)
        elif v == "import":
            self.i += 1
            self.need("(")
            self.type()
            self.need(")")
            while self.take("."):
                self.any_name()
            self.attempt(self.type_arguments)
        elif k == "id" or k == "kw" and v in ("this", "void", "null", "true", "false"):
            self.i += 1
            while self.take("."):
                self.any_name()
            if self.v[self.i] == "<" and not self.n[self.i]:
                self.type_arguments()
        else:
            self.fail(f"expected a type instead of {v or k!r}")
        while self.v[self.i] == "[" and not self.n[self.i]:
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.type_member()
            if not (self.take(";") or self.take(",")) and self.v[self.i] != "}" and not self.n[self.i]:
                self.fail("expected ';'")

    def type_member(self) -> None:
        if self.v[self.i] in ("+", "-"):
            self.i += 1
        while self.v[self.i] in ("readonly", "get", "set", "static") and self.v[self.i + 1] not in ("(", ":", "?", ";", ",", "}", "<"):
            self.i += 1
        if self.v[self.i] in ("(", "<"):
            self.signature()
            return
        if self.v[self.i] == "new" and self.v[self.i + 1] in ("(", "<"):
            self.i += 1
            self.signature()
            return
        if self.v[self.i] == "[":
            self.i += 1
            if self.k[self.i] == "id" and self.v[self.i + 1] in (":", "in"):
                self.i += 2
                self.type()
                if self.take("as"):
                    self.type()
            else:
                self.assignment()
            self.need("]")
            if self.v[self.i] in ("+", "-"):
                self.i += 1
        else:
            self.key()
        self.take("?")
        if self.v[self.i] in ("(", "<"):
            self.signature()
            return
        self.annotation()
