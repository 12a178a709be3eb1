"""Scala, with braces; definitions may stand at the top of a file."""

from __future__ import annotations

import re

from .base import Parser, Tokens, scan

# Reserved words.
KEYWORDS = frozenset(
    """abstract case catch class def do else extends false final finally for forSome if implicit import lazy match new null object
    override package private protected return sealed super this throw trait try true type val var while with yield""".split()
)
_ESCAPE = r"\\(?:[btnfr\"'\\s]|u+[0-9a-fA-F]{4})"
_PATTERN = re.compile(
    rf"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*)|(?P<text>[^\W\d]*\"\"\"|[^\W\d]+")|(?P<str>"(?:[^"\\\n]|{_ESCAPE})*"|'(?:[^'\\\n]|{_ESCAPE})')
    |(?P<symbol>'[^\W\d]\w*(?!'))|(?P<id>[^\W\d][\w$]*(?:(?<=\w_)[-+*/%&|^!<>=~?:\\@\#]+)?|\$[\w$]*|`[^`\n]+`)
    |(?P<num>0[xX][0-9a-fA-F_]+[lL]?(?!\w)|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9]+)?[lLfFdD]?(?!\w)|\.[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?[fFdD]?(?!\w))
    |(?P<op>[-+*/%&|^!<>=~?:\\@\#\u2190\u21d2]+|[;,.(){{}}\[\]])|(?P<bad>["'`]|[0-9]\w*)""",
    re.X | re.S,
)
_FIXED = frozenset(("=", "=>", "<-", ":", "@", "<:", ">:", "<%", "#", "\u21d2", "\u2190"))


def tokenize(text: str) -> Tokens:
    def interpolated(i: int, close: str, t: Tokens) -> int:
        while i < len(text):
            if text.startswith(close, i):
                i += len(close)
                while close == '"""' and text.startswith('"', i):
                    i += 1
                return i
            c = text[i]
            if c == "\n" and close == '"':
                break
            if c == "\\" and close == '"':
                i += 2
                continue
            if c == "$" and text[i + 1 : i + 2] == "{":
                depth, j = 0, i + 1
                while j < len(text):
                    if text[j] == "{":
                        depth += 1
                    elif text[j] == "}":
                        depth -= 1
                        if depth == 0:
                            break
                    j += 1
                i = j
            elif c == "$" and text[i + 1 : i + 2] == "$":
                i += 1
            elif c == "$" and not re.match(r"\$[\w$]", text[i:]):
                t.errors.append((i, "a '$' without a name"))
            i += 1
        t.errors.append((i, "unterminated string"))
        return i

    def special(kind, m, t, newline):
        v = m.group()
        if kind == "comment" and v == "/*":
            depth = 1
            for x in re.compile(r"/\*|\*/").finditer(text, m.end()):
                depth += 1 if x.group() == "/*" else -1
                if depth == 0:
                    if "\n" in text[m.start() : x.end()]:
                        t.broken = True
                    return_to = x.end()
                    special.newline = newline or "\n" in text[m.start() : x.end()]
                    return return_to
            t.errors.append((m.start(), "unterminated comment"))
            return len(text)
        if kind == "text":
            prefix = v.rstrip('"')
            close = v[len(prefix) :]
            t.add("str", '"', m.start(), newline)
            if prefix:
                return interpolated(m.end(), close, t)
            end = text.find('"""', m.end())
            if end < 0:
                t.errors.append((m.start(), "unterminated string"))
                return len(text)
            end += 3
            while text.startswith('"', end):
                end += 1
            return end
        if kind == "symbol":
            t.add("str", "'", m.start(), newline)
            return m.end()
        if kind == "op" and len(v) > 1 and ("//" in v or "/*" in v):
            cut = min(x for x in (v.find("//"), v.find("/*")) if x >= 0)
            if cut:
                t.add("op", v[:cut], m.start(), newline)
                return m.start() + cut
        return None

    return scan(text, _PATTERN, KEYWORDS, Tokens(), special)


class Scala(Parser):
    """A source file."""

    MODIFIERS = frozenset("abstract final sealed implicit lazy override private protected".split())
    SOFT = frozenset("inline opaque open transparent infix".split())

    def file(self) -> None:
        while self.v[self.i] == "package" and self.v[self.i + 1] != "object":
            self.i += 1
            self.qualified()
            if self.v[self.i] == "{":
                self.template_body()
            self.take(";")
        self.many(self.top)

    def __init__(self, text: str) -> None:
        super().__init__(tokenize(text))
        self.depth = 0  # in round or square brackets line ends don't count

    def end(self) -> None:
        if self.take(";") or self.v[self.i] in ("}", ")", "case") or self.k[self.i] == "eof" or self.n[self.i]:
            return
        self.fail(f"expected a line end or ';' instead of {self.v[self.i] or self.k[self.i]!r}")

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def top(self) -> None:
        if self.take(";"):
            return
        if self.v[self.i] == "import":
            self.import_()
        elif not self.definition():
            self.fail(f"expected a definition instead of {self.v[self.i] or self.k[self.i]!r}")
        self.end()

    def import_(self) -> None:
        self.need("import")
        while True:
            self.name()
            while self.take("."):
                if self.take("{"):

                    def one() -> None:
                        self.i += 1
                        if self.v[self.i] in ("=>", "as"):
                            self.i += 2

                    self.listed(one, "}")
                    break
                if self.v[self.i] in ("*", "_", "given", "this"):
                    self.i += 1
                else:
                    self.name()
            if self.v[self.i] == "as":
                self.i += 2
            if not self.take(","):
                return

    def annotations(self) -> None:
        while self.v[self.i] == "@" and self.k[self.i] == "op":
            self.i += 1
            self.simple_type()
            while self.v[self.i] == "(" and not self.n[self.i]:
                self.arguments()

    def modifiers(self) -> None:
        self.annotations()
        while self.v[self.i] in self.MODIFIERS or self.v[self.i] in self.SOFT and self.k[self.i + 1] in ("id", "kw"):
            self.i += 1
            if self.v[self.i] == "[" and self.v[self.i - 1] in ("private", "protected"):
                self.i += 2
                self.need("]")
            self.annotations()

    def definition(self) -> bool:
        start = self.i
        self.modifiers()
        v = self.v[self.i]
        if v == "case" and self.v[self.i + 1] in ("class", "object"):
            self.i += 1
            v = self.v[self.i]
        if v in ("class", "trait"):
            self.i += 1
            self.name()
            self.type_parameters()
            self.annotations()
            self.attempt(lambda: (self.modifiers(), self.v[self.i] == "(")[1])
            while self.v[self.i] == "(" and not self.n[self.i]:
                self.parameters(True)
            self.template()
        elif v == "object" or v == "package" and self.v[self.i + 1] == "object":
            self.i += 1 + (v == "package")
            self.name()
            self.template()
        elif v == "enum" and self.k[self.i + 1] == "id":
            self.i += 1
            self.name()
            self.type_parameters()
            while self.v[self.i] == "(":
                self.parameters(True)
            self.template()
        elif v == "def":
            self.def_()
        elif v in ("val", "var"):
            self.i += 1
            self.pattern()
            while self.take(","):
                self.pattern()
            typed = self.take(":")
            if typed:
                self.type()
            if self.take("="):
                if self.v[self.i] == "_" and (self.n[self.i + 1] or self.v[self.i + 1] in (";", "}")):
                    self.i += 1
                else:
                    self.expression()
            elif not typed:
                self.fail("expected '='")
        elif v == "type" and self.k[self.i + 1] == "id":
            self.i += 1
            self.name()
            self.type_parameters()
            while self.v[self.i] in ("<:", ">:"):
                self.i += 1
                self.type()
            if self.take("="):
                self.type()
        else:
            if self.i > start:
                self.fail(f"expected a definition instead of {v or self.k[self.i]!r}")
            return False
        return True

    def def_(self) -> None:
        self.need("def")
        if not self.take("this"):
            if self.k[self.i] != "id" and not (self.k[self.i] == "op" and self.v[self.i] not in _FIXED and self.v[self.i][0] not in "(){}[];,."):
                self.fail("expected a name")
            self.i += 1
        self.type_parameters()
        while self.v[self.i] == "(" and not self.n[self.i]:
            self.parameters(False)
        if self.take(":"):
            self.type()
        if self.take("="):
            self.expression()
        elif self.v[self.i] == "{" and not self.n[self.i]:
            self.block()

    def type_parameters(self) -> None:
        def one() -> None:
            self.annotations()
            if self.v[self.i] in ("+", "-"):
                self.i += 1
            self.name()
            self.type_parameters()
            while self.v[self.i] in ("<:", ">:", ":", "<%"):
                self.i += 1
                self.type()

        if self.v[self.i] == "[" and not self.n[self.i]:
            self.i += 1
            self.listed(one, "]", 1)

    def parameters(self, of_class: bool) -> None:
        def one() -> None:
            self.modifiers()
            if self.v[self.i] in ("val", "var"):
                self.i += 1
            if self.v[self.i] == "using":
                self.i += 1
            self.name()
            self.need(":")
            self.take("=>")
            self.type()
            self.take("*")
            if self.take("="):
                self.inside(self.expression)

        self.need("(")
        self.take("implicit")
        if self.v[self.i] == "using" and self.k[self.i + 1] == "id":
            self.i += 1
        self.listed(one, ")")

    def template(self) -> None:
        if self.v[self.i] == "extends" and self.take("extends"):
            self.parent()
            while self.v[self.i] in ("with", ",") or self.v[self.i] == "derives":
                self.i += 1
                self.parent()
        if self.v[self.i] == "{":
            self.template_body()

    def parent(self) -> None:
        if self.v[self.i] == "{":
            self.template_body()
            return
        self.simple_type()
        while self.v[self.i] == "(" and not self.n[self.i]:
            self.arguments()

    def template_body(self) -> None:
        self.need("{")
        saved, self.depth = self.depth, 0

        def itself() -> bool:
            self.i += 1
            if self.take(":"):
                self.infix_type()
            return self.v[self.i] == "=>"

        if (self.k[self.i] == "id" or self.v[self.i] == "this") and self.attempt(itself):
            self.i += 1
        self.many(self.member, ("}",))
        self.need("}")
        self.depth = saved

    def member(self) -> None:
        if self.take(";"):
            return
        if self.v[self.i] == "case" and self.v[self.i + 1] not in ("class", "object"):
            self.i += 1  # of an enum
            while True:
                self.name()
                self.type_parameters()
                while self.v[self.i] == "(":
                    self.parameters(True)
                self.template()
                if not self.take(","):
                    break
            self.end()
            return
        self.statement()

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.v[self.i] == "import":
            self.import_()
        elif not self.definition():
            self.expression()
        self.end()

    # types
    def type(self) -> None:
        if self.v[self.i] == "=>":
            self.i += 1
        self.infix_type()
        if self.v[self.i] in ("=>", "?=>") and not self.n[self.i]:
            self.i += 1
            self.type()

    def infix_type(self) -> None:
        self.compound_type()
        while not self.n[self.i] and (self.k[self.i] == "op" and self.v[self.i] not in _FIXED and self.v[self.i][0] not in "(){}[];,.*" or self.k[self.i] == "id") and (self.k[self.i + 1] == "id" or self.v[self.i + 1] in ("(", "{")):
            self.i += 1
            self.compound_type()

    def compound_type(self) -> None:
        if self.v[self.i] == "{":
            self.template_body()
            return
        self.annotations()
        self.simple_type()
        while self.take("with"):
            self.simple_type()
        self.annotations()
        if self.v[self.i] == "{" and not self.n[self.i] and self.v[self.i + 1] in ("def", "val", "type"):
            self.template_body()

    def simple_type(self) -> None:
        v, k = self.v[self.i], self.k[self.i]
        if v == "(":
            self.i += 1

            def one() -> None:
                self.type()
                self.take("*")

            self.listed(one, ")")
        elif v in ("?",) or k in ("num", "str"):
            self.i += 1
            while self.v[self.i] in ("<:", ">:"):
                self.i += 1
                self.type()
        elif k == "id" or v in ("this", "super"):
            self.i += 1
            while self.v[self.i - 1] == "_" and self.v[self.i] in ("<:", ">:"):
                self.i += 1
                self.type()
        else:
            self.fail(f"expected a type instead of {v or k!r}")
        while not self.n[self.i]:
            if self.v[self.i] in (".", "#"):
                self.i += 1
                self.i += 1 if self.v[self.i] in ("type", "this") or self.k[self.i] == "id" else self.fail("expected a name")
            elif self.v[self.i] == "[":
                self.i += 1
                self.listed(self.type, "]", 1)
            else:
                return

    # patterns
    def pattern(self) -> None:
        self.pattern_2()
        while self.take("|"):
            self.pattern_2()

    def pattern_2(self) -> None:
        if self.k[self.i] == "id" and self.v[self.i + 1] in ("@",):
            self.i += 2
        elif self.k[self.i] == "id" and self.v[self.i + 1] == ":" and self.typed:
            self.i += 2
            self.infix_type()
            return
        self.simple_pattern()
        while not self.n[self.i] and (self.k[self.i] == "op" and self.v[self.i] not in _FIXED and self.v[self.i] != "|" and self.v[self.i][0] not in "(){}[];,." or self.k[self.i] == "id" and self.v[self.i] != "if"):
            self.i += 1
            if self.v[self.i - 1] == "*" and self.v[self.i] == ")":
                return
            self.simple_pattern()

    typed = False

    def simple_pattern(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if v == "-" and self.k[self.i + 1] == "num":
            self.i += 2
        elif k in ("num", "str") or v in ("true", "false", "null"):
            self.i += 1
        elif v == "(":
            self.i += 1
            self.listed(self.inner_pattern, ")")
        elif k == "id" or v == "this":
            self.i += 1
            while self.take("."):
                self.i += 1
            if self.v[self.i] == "[":
                self.i += 1
                self.listed(self.type, "]")
            if self.v[self.i] == "(" and not self.n[self.i]:
                self.i += 1
                self.listed(self.inner_pattern, ")")
        else:
            self.fail(f"expected a pattern instead of {v or k!r}")

    def inner_pattern(self) -> None:
        saved, self.typed = self.typed, True
        self.pattern()
        self.typed = saved

    # expressions
    def inside(self, f):
        """``f`` in brackets, where line ends don't count."""
        saved, self.depth = self.depth, self.depth + 1
        try:
            return f()
        finally:
            self.depth = saved

    def broken(self) -> bool:
        """Whether a line end before this token ends an expression."""
        return self.n[self.i] and not self.depth

    def block(self) -> None:
        self.need("{")
        saved, self.depth = self.depth, 0
        if self.v[self.i] == "case" and self.v[self.i + 1] not in ("class", "object"):
            self.cases()
        else:
            self.many(self.block_statement, ("}",))
        self.need("}")
        self.depth = saved

    def block_statement(self) -> None:
        if self.lambda_ahead():
            self.i = self.ahead
            self.many(self.block_statement, ("}",))
            return
        self.statement()

    ahead = 0

    def lambda_ahead(self) -> bool:
        """Whether parameters and '=>' begin here; ``ahead`` is then behind the arrow."""
        j = self.i
        if self.v[j] == "implicit":
            j += 1
        if self.k[j] == "id":
            j += 1
            if self.v[j] == ":":
                i = self.i
                self.i = j + 1
                try:
                    self.infix_type()
                    j = self.i
                except Exception:  # noqa: BLE001
                    j = 0
                finally:
                    self.i = i
                if not j:
                    return False
        elif self.v[j] == "(" and self.k[j] == "op":
            depth = 0
            while self.k[j] != "eof":
                if self.k[j] == "op":
                    depth += (self.v[j] in ("(", "[", "{")) - (self.v[j] in (")", "]", "}"))
                j += 1
                if depth == 0:
                    break
        else:
            return False
        if self.v[j] in ("=>", "\u21d2", "?=>") and self.k[j] == "op":
            self.ahead = j + 1
            return True
        return False

    def cases(self) -> None:
        while self.take("case"):
            saved, self.typed = self.typed, True
            self.pattern()
            self.typed = saved
            if self.take("if"):
                self.infix()
            if self.v[self.i] not in ("=>", "\u21d2"):
                self.fail("expected '=>'")
            self.i += 1
            self.many(self.block_statement, ("case", "}")) if self.v[self.i] != "case" or self.v[self.i + 1] in ("class", "object") else None

    def expression(self) -> None:
        v, k = self.v[self.i], self.k[self.i]
        if (k == "id" or v in ("(", "implicit")) and self.lambda_ahead():
            if v == "(":
                self.check_parameters()
            self.i = self.ahead
            self.expression()
            return
        f = self.EXPRESSIONS.get(v) if k == "kw" else None
        if f is not None:
            f(self)
            if self.v[self.i] == "match" and not self.broken():
                self.match()
            return
        left = self.infix()
        v = self.v[self.i]
        if self.broken():
            return
        if v == "=" and self.k[self.i] == "op":
            if left not in ("name", "part"):
                self.fail("cannot assign to this expression")
            self.i += 1
            self.expression()
        elif v == ":" and self.k[self.i] == "op":
            self.i += 1
            if self.take("_"):
                self.need("*")
            elif self.v[self.i] == "_*":
                self.i += 1
            else:
                self.annotations() if self.v[self.i] == "@" else self.type()
        while self.v[self.i] == "match" and not self.broken():
            self.match()

    def check_parameters(self) -> None:
        """The bracket before an arrow holds parameters."""

        def one() -> None:
            self.modifiers()
            self.name()
            if self.take(":"):
                self.type()

        i = self.i
        self.need("(")
        self.listed(one, ")")
        self.i = i

    def match(self) -> None:
        self.need("match")
        self.need("{")
        saved, self.depth = self.depth, 0
        if self.v[self.i] != "case":
            self.fail("expected 'case'")
        self.cases()
        self.need("}")
        self.depth = saved

    def if_(self) -> None:
        self.i += 1
        self.need("(")
        self.inside(self.expression)
        self.need(")")
        self.expression()
        if self.v[self.i] == ";" and self.v[self.i + 1] == "else":
            self.i += 1
        if self.take("else"):
            self.expression()

    def while_(self) -> None:
        self.i += 1
        self.need("(")
        self.inside(self.expression)
        self.need(")")
        self.expression()

    def do(self) -> None:
        self.i += 1
        self.expression()
        self.take(";")
        self.need("while")
        self.need("(")
        self.inside(self.expression)
        self.need(")")

    def for_(self) -> None:
        self.i += 1
        close = ")" if self.v[self.i] == "(" else "}"
        if self.v[self.i] not in ("(", "{"):
            self.fail("expected generators")
        self.i += 1
        saved, self.depth = self.depth, 1 if close == ")" else 0
        n = 0
        while self.v[self.i] != close:
            if self.take(";"):
                continue
            if self.take("if"):
                self.infix()
                continue
            self.take("val")
            self.take("case")
            self.inner_pattern()
            if self.v[self.i] in ("<-", "\u2190"):
                self.i += 1
            elif not (n and self.take("=")):
                self.fail("expected '<-'")
            self.expression()
            n += 1
            if self.v[self.i] not in (close, ";", "if") and not self.n[self.i]:
                self.fail("expected another generator")
        if not n:
            self.fail("expected a generator")
        self.need(close)
        self.depth = saved
        self.take("yield")
        self.expression()

    def try_(self) -> None:
        self.i += 1
        self.expression()
        if self.take("catch"):
            if self.v[self.i] == "{":
                self.block()
            else:
                self.expression()
        if self.take("finally"):
            self.expression()

    def throw(self) -> None:
        self.i += 1
        self.expression()

    def return_(self) -> None:
        self.i += 1
        if not self.broken() and self.v[self.i] not in (";", "}", ")") and self.k[self.i] != "eof":
            self.expression()

    def operator_here(self) -> bool:
        k, v = self.k[self.i], self.v[self.i]
        if k == "op":
            if v in _FIXED or v[0] in "(){}[];,.":
                return False
        elif k != "id" or v == "_":
            return False
        return not self.broken()

    def infix(self) -> str:
        """Operands and operators; all operators are names, so their precedence can't make a file invalid."""
        left = self.prefix()
        while self.operator_here():
            self.i += 1
            if self.v[self.i] == "[":
                self.i += 1
                self.listed(self.type, "]")
            if self.v[self.i] in (")", "}", "]", ",", ";") or self.k[self.i] == "eof":
                if self.k[self.i - 1] == "id":
                    return "other"  # a postfix operator
                self.fail("expected an operand")
            v, k = self.v[self.i], self.k[self.i]
            if k == "kw" and v in ("if", "for", "try", "while") or (k == "id" or v == "(") and self.lambda_ahead():
                self.expression()
                return "other"
            if self.n[self.i] and self.k[self.i - 1] == "id" and not self.depth:
                return "other"
            self.prefix()
            left = "other"
        return left

    def prefix(self) -> str:
        if self.k[self.i] == "op" and self.v[self.i] in ("-", "+", "!", "~"):
            self.i += 1
            self.simple()
            return "other"
        return self.simple()

    def arguments(self) -> None:
        self.need("(")
        self.take("using") if self.k[self.i + 1] == "id" else None

        def one() -> None:
            if self.k[self.i] == "id" and self.v[self.i + 1] == "=":
                self.i += 2
            self.expression()

        self.inside(lambda: self.listed(one, ")"))

    def simple(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "id":
            self.i += 1
            left = "name"
        elif k in ("num", "str") or k == "kw" and v in ("true", "false", "null"):
            self.i += 1
            left = "other"
        elif v in ("this", "super"):
            self.i += 1
            if self.v[self.i] == "[":
                self.i += 2
                self.need("]")
            left = "other"
        elif v == "(":
            self.i += 1
            self.inside(lambda: self.listed(self.expression, ")"))
            left = "other"
        elif v == "{":
            self.block()
            left = "other"
        elif v == "new":
            self.i += 1
            if self.v[self.i] == "{":
                self.template_body()
            else:
                self.parent()
                while self.take("with"):
                    self.parent()
                if self.v[self.i] == "{" and not self.n[self.i]:
                    self.template_body()
            left = "other"
        elif k == "kw" and v in self.EXPRESSIONS:
            self.expression()
            return "other"
        else:
            self.fail(f"unexpected {v or k!r}")
        while True:
            v = self.v[self.i]
            if v == "." and self.k[self.i] == "op":
                self.i += 1
                if self.v[self.i] in ("type", "this", "super", "match"):
                    self.i += 1
                elif self.k[self.i] == "op" and self.v[self.i][0] not in "(){}[];,.":
                    self.i += 1
                else:
                    self.name()
                left = "part"
            elif self.k[self.i] != "op" or self.broken():
                return left
            elif v == "[":
                self.i += 1
                self.listed(self.type, "]", 1)
                left = "other"
            elif v == "(":
                self.arguments()
                left = "part"
            elif v == "{" and left != "block":
                self.block()
                left = "other"
            else:
                return left

    EXPRESSIONS = {"if": if_, "while": while_, "do": do, "for": for_, "try": try_, "throw": throw, "return": return_}
