"""Rust."""

from __future__ import annotations

import re

from .base import Parser, Tokens, scan

# Reserved words.
KEYWORDS = frozenset(
    """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref
    return self Self static struct super trait true type unsafe use where while""".split()
)
_ESCAPE = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\r?\n)"
_PATTERN = re.compile(
    rf"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*)|(?P<raw>[bc]?r\#*")|(?P<str>[bc]?"(?:[^"\\]|{_ESCAPE})*"|b?'(?:[^'\\\n\r\t]|{_ESCAPE})')
    |(?P<life>'[^\W\d]\w*(?!'))|(?P<id>(?:r\#)?[^\W\d]\w*)
    |(?P<num>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)
      |[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?_*[0-9][0-9_]*)?_*(?:f32|f64|[iu](?:8|16|32|64|128|size))?(?!\w))
    |(?P<op>\.\.\.|\.\.=|\.\.|=>|->|::|==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|[-+*/%&|^!<>=?:;,.(){{}}\[\]@\#$~])
    |(?P<bad>["']|[0-9]\w*)""",
    re.X | re.S,
)


def tokenize(text: str) -> Tokens:
    def special(kind, m, t, newline):
        if kind == "comment" and m.group() == "/*":
            depth, i = 1, m.end()
            for x in re.compile(r"/\*|\*/").finditer(text, i):
                depth += 1 if x.group() == "/*" else -1
                if depth == 0:
                    return x.end()
            t.errors.append((m.start(), "unterminated comment"))
            return len(text)
        if kind == "raw":
            close = '"' + "#" * m.group().count("#")
            end = text.find(close, m.end())
            t.add("str", '"', m.start(), newline)
            if end < 0:
                t.errors.append((m.start(), "unterminated raw string"))
                return len(text)
            return end + len(close)
        return None

    if text.startswith("#!") and not text.startswith("#!["):
        text = "//" + text[2:]
    return scan(text, _PATTERN, KEYWORDS, Tokens(), special)


class Rust(Parser):
    """A source file."""

    BINARY = {"=": 0, "..": 1, "..=": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "as": 11}
    ASSIGN = frozenset("+= -= *= /= %= ^= &= |= <<= >>=".split())
    DOUBLE = {"|": "||", "&": "&&", "<": "<<", ">": ">>"}

    def __init__(self, text: str) -> None:
        super().__init__(tokenize(text))
        self.plain = False  # in a condition, where a brace opens a block

    def file(self) -> None:
        while self.v[self.i] == "#" and self.v[self.i + 1] == "!":
            self.i += 2
            self.tree()
        self.many(self.item)

    # items
    def attributes(self) -> None:
        while self.v[self.i] == "#" and self.k[self.i] == "op":
            self.i += 1
            self.take("!")
            if self.v[self.i] != "[":
                self.fail("expected '['")
            self.tree()

    def tree(self) -> None:
        """One bracketed tree of tokens, as macros and attributes take it."""
        close = {"(": ")", "[": "]", "{": "}"}
        if self.v[self.i] not in close or self.k[self.i] != "op":
            self.fail("expected a bracket")
        stack = [close[self.v[self.i]]]
        self.i += 1
        while stack:
            if self.k[self.i] == "eof":
                self.fail(f"expected {stack[-1]!r}")
            if self.k[self.i] == "op":
                v = self.v[self.i]
                if v in close:
                    stack.append(close[v])
                elif v in (")", "]", "}"):
                    if v != stack.pop():
                        self.fail(f"unexpected {v!r}")
            self.i += 1

    def visibility(self) -> None:
        if self.take("pub") and self.v[self.i] == "(" and self.v[self.i + 1] in ("crate", "self", "super", "in"):
            self.i += 1
            self.take("in")
            self.path(False)
            self.need(")")

    def item(self) -> None:
        self.attributes()
        self.visibility()
        if not self.itemish():
            self.fail(f"expected an item instead of {self.v[self.i] or self.k[self.i]!r}")

    def itemish(self) -> bool:
        """An item without its attributes and visibility."""
        k, v = self.k[self.i], self.v[self.i]
        if v in ("fn", "extern", "async", "unsafe", "const") and k == "kw":
            j = self.i
            while self.v[j] in ("const", "async", "unsafe", "extern") or self.k[j] == "str":
                j += 1
            if self.v[j] == "fn":
                self.i = j
                self.function()
                return True
        if v == "unsafe" and self.v[self.i + 1] in ("impl", "trait", "extern"):
            self.i += 1
            v = self.v[self.i]
        if v == "use":
            self.i += 1
            self.tree_of_use()
            self.need(";")
        elif v == "mod":
            self.i += 1
            self.name()
            if not self.take(";"):
                self.need("{")
                self.many(self.item, ("}",))
                self.need("}")
        elif v == "struct" or v == "union" and self.k[self.i + 1] == "id":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            if self.take("("):
                self.listed(self.tuple_field, ")")
                self.where()
                self.need(";")
            elif not self.take(";"):
                self.need("{")
                self.listed(self.field, "}")
        elif v == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            self.listed(self.variant, "}")
        elif v == "impl":
            self.i += 1
            if self.v[self.i] == "<":
                self.generics()
            self.take("const")
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.members()
        elif v == "trait":
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            self.members()
        elif v == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
            self.where()
            self.need(";")
        elif v in ("const", "static") and self.v[self.i + 1] not in ("{", "|", "move"):
            self.i += 1
            self.take("mut")
            self.name() if self.v[self.i] != "_" else self.take("_")
            self.need(":")
            self.type()
            if self.take("="):
                self.expression()
            self.need(";")
        elif v == "extern":
            self.i += 1
            if self.take("crate"):
                self.i += 1
                if self.take("as"):
                    self.i += 1
                self.need(";")
            else:
                if self.k[self.i] == "str":
                    self.i += 1
                self.members(self.foreign)
        elif v == "macro_rules" and self.v[self.i + 1] == "!":
            self.i += 2
            self.name()
            brace = self.v[self.i] == "{"
            self.tree()
            brace or self.need(";")
        elif k == "id" and self.v[self.i + 1] == "!" and self.v[self.i + 2] in ("(", "{", "["):
            self.i += 2
            brace = self.v[self.i] == "{"
            self.tree()
            brace or self.need(";")
        else:
            return False
        return True

    def members(self, one=None) -> None:
        self.need("{")
        self.many(one or self.item, ("}",))
        self.need("}")

    def foreign(self) -> None:
        """An item of an extern block, which may be safe or unsafe."""
        self.attributes()
        self.visibility()
        if self.v[self.i] == "safe" and self.k[self.i] == "id" and self.v[self.i + 1] in ("fn", "static"):
            self.i += 1
        elif self.v[self.i] == "unsafe" and self.v[self.i + 1] == "static":
            self.i += 1
        if not self.itemish():
            self.fail(f"expected an item instead of {self.v[self.i] or self.k[self.i]!r}")

    def tree_of_use(self) -> None:
        self.take("::")
        if self.take("{"):
            self.listed(self.tree_of_use, "}")
        elif not self.take("*"):
            if self.k[self.i] not in ("id", "kw"):
                self.fail("expected a path")
            self.i += 1
            if self.take("::"):
                self.tree_of_use()
            elif self.take("as"):
                self.i += 1

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.name()
        if self.take("("):
            self.listed(self.tuple_field, ")")
        elif self.take("{"):
            self.listed(self.field, "}")
        if self.take("="):
            self.expression()

    def function(self) -> None:
        self.need("fn")
        self.name()
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.take("->"):
            self.type()
        self.where()
        if not self.take(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        if self.take("..."):
            return

        def receiver() -> bool:
            if self.take("&") and self.k[self.i] == "life":
                self.i += 1
            self.take("mut")
            self.need("self")
            if self.take(":"):
                self.type()
            return self.v[self.i] in (",", ")")

        if not self.attempt(receiver):
            self.pattern()
            self.need(":")
            self.type()

    def generics(self) -> None:
        def one() -> None:
            self.attributes()
            if self.k[self.i] == "life":
                self.i += 1
                if self.take(":"):
                    self.bounds()
            elif self.take("const"):
                self.name()
                self.need(":")
                self.type()
                if self.take("="):
                    self.unary()
            else:
                self.name()
                if self.take(":"):
                    self.bounds()
                if self.take("="):
                    self.type()

        if self.take("<"):
            self.listed(one, ">")

    def where(self) -> None:
        if self.take("where"):
            while self.v[self.i] not in ("{", ";", "="):
                if self.k[self.i] == "life":
                    self.i += 1
                else:
                    self.higher()
                    self.type()
                self.need(":")
                self.bounds()
                if not self.take(","):
                    return

    def higher(self) -> None:
        if self.v[self.i] == "for" and self.v[self.i + 1] == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.k[self.i] == "life":
                self.i += 1
            elif self.v[self.i] in ("{", ",", ">", "=", ";", "where", ")"):
                return
            else:
                if self.take("use"):
                    self.need("<")
                    while not self.take(">"):
                        self.i += 1 if self.k[self.i] in ("id", "life") or self.v[self.i] == "Self" else self.fail("expected a captured name")
                        if self.v[self.i] != ">":
                            self.need(",")
                    if not self.take("+"):
                        return
                    continue
                bracket = self.take("(")
                self.take("?") or self.take("~")
                self.take("const")
                self.higher()
                self.path(False)
                if bracket:
                    self.need(")")
            if not self.take("+"):
                return

    # types and paths
    def type(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if v == "&":
            self.i += 1
            if self.v[self.i] == "&":
                self.i += 1
            if self.k[self.i] == "life":
                self.i += 1
            self.take("mut")
            self.type_without_bounds()
        elif v == "*":
            self.i += 1
            if not (self.take("const") or self.take("mut")):
                self.fail("expected 'const' or 'mut'")
            self.type()
        elif v == "(":
            self.i += 1
            self.listed(self.type, ")")
        elif v == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.need("]")
        elif v in ("!", "_"):
            self.i += 1
        elif v in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif v in ("fn", "unsafe", "extern", "for"):
            self.higher()
            self.take("unsafe")
            if self.take("extern") and self.k[self.i] == "str":
                self.i += 1
            if not self.take("fn"):
                self.path(False)
                return

            def parameter() -> None:
                if self.k[self.i] == "id" and self.v[self.i + 1] == ":":
                    self.i += 2
                self.take("...") or self.type()

            self.need("(")
            self.listed(parameter, ")")
            if self.take("->"):
                self.type()
        elif k == "id" or v in ("self", "Self", "super", "crate", "::", "<"):
            self.path(False)
            if self.v[self.i] == "!" and self.v[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.tree()
        else:
            self.fail(f"expected a type instead of {v or k!r}")

    def type_without_bounds(self) -> None:
        self.type()

    def path(self, expression: bool) -> None:
        if self.take("<"):
            self.type()
            if self.take("as"):
                self.path(False)
            self.need(">")
            self.need("::")
        else:
            self.take("::")
        while True:
            if self.k[self.i] != "id" and self.v[self.i] not in ("self", "Self", "super", "crate"):
                self.fail(f"expected a name instead of {self.v[self.i] or self.k[self.i]!r}")
            self.i += 1
            if not expression and self.v[self.i] == "<" or self.v[self.i] == "::" and self.v[self.i + 1] == "<":
                self.take("::")
                self.generic_arguments()
            elif not expression and self.v[self.i] == "(" and self.v[self.i - 1] in ("Fn", "FnMut", "FnOnce"):
                self.i += 1
                self.listed(self.type, ")")
                if self.take("->"):
                    self.type()
            if not self.take("::"):
                return

    def generic_arguments(self) -> None:
        def one() -> None:
            if self.k[self.i] == "life":
                self.i += 1
            elif self.k[self.i] in ("num", "str") or self.v[self.i] in ("true", "false", "-"):
                self.take("-")
                self.i += 1
            elif self.v[self.i] == "{":
                self.block()
            else:
                self.type()
                if self.take("="):
                    self.type()
                elif self.take(":"):
                    self.bounds()

        self.need("<")
        self.listed(one, ">")

    # patterns
    def pattern(self) -> None:
        self.take("|")
        self.one_pattern()
        while self.v[self.i] == "|" and self.v[self.i + 1] != "|":
            self.i += 1
            self.one_pattern()

    def one_pattern(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if v == "&":
            self.i += 1
            self.take("&")
            self.take("mut")
            self.one_pattern()
        elif v in ("_",):
            self.i += 1
        elif v in ("..", "..="):
            self.i += 1
            if self.k[self.i] in ("num", "str") or self.v[self.i] == "-":
                self.literal()
        elif v == "(":
            self.i += 1
            self.listed(self.pattern, ")")
        elif v == "[":
            self.i += 1
            self.listed(self.pattern, "]")
        elif v in ("ref", "mut") or k == "id" and self.v[self.i + 1] == "@":
            self.take("ref")
            self.take("mut")
            self.name()
            if self.take("@"):
                self.one_pattern()
        elif k in ("num", "str") or v in ("-", "true", "false"):
            self.literal()
            if self.v[self.i] in ("..=", "..", "..."):
                self.i += 1
                if self.k[self.i] in ("num", "str") or self.v[self.i] == "-":
                    self.literal()
        elif k == "id" or v in ("self", "Self", "super", "crate", "::", "<"):
            self.path(True)
            if self.take("("):
                self.listed(self.pattern, ")")
            elif self.v[self.i] == "!" and self.v[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.tree()
            elif self.v[self.i] == "{":
                self.i += 1

                def field() -> None:
                    self.attributes()
                    if self.take(".."):
                        return
                    self.take("ref")
                    self.take("mut")
                    self.i += 1 if self.k[self.i] in ("id", "num") else self.fail("expected a field")
                    if self.take(":"):
                        self.pattern()

                self.listed(field, "}")
            elif self.v[self.i] in ("..=", ".."):
                self.i += 1
                self.literal()
        else:
            self.fail(f"expected a pattern instead of {v or k!r}")

    def literal(self) -> None:
        self.take("-")
        if self.k[self.i] in ("num", "str") or self.v[self.i] in ("true", "false"):
            self.i += 1
        else:
            self.path(True)

    # statements and expressions
    def block(self) -> None:
        saved, self.plain = self.plain, False
        self.need("{")
        while self.v[self.i] == "#" and self.v[self.i + 1] == "!":
            self.attributes()
        self.many(self.statement, ("}",))
        self.need("}")
        self.plain = saved

    BLOCKS = ("if", "match", "loop", "while", "for", "unsafe", "{")

    def statement(self) -> None:
        if self.take(";"):
            return
        self.attributes()
        v, k = self.v[self.i], self.k[self.i]
        if v == "let":
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take("else"):
                    self.block()
            self.need(";")
            return
        if v == "pub" or k == "kw" and v in ("fn", "struct", "enum", "impl", "trait", "mod", "use", "type", "static", "extern") or v in ("const", "unsafe", "async") and self.v[self.i + 1] not in ("{", "move", "|") or v == "macro_rules" and self.v[self.i + 1] == "!":
            self.item()
            return
        if k == "id" and self.v[self.i + 1] == "!" and self.v[self.i + 2] == "{" and k == "id":
            self.i += 2
            self.tree()
            if self.v[self.i] not in (".", "?"):
                return
            self.i -= 0
            self.rest_of_postfix()
        elif (v in self.BLOCKS or k == "life") and k in ("kw", "op", "life"):
            self.blocklike()
            if self.v[self.i] in (".", "?"):
                self.rest_of_postfix()
                self.rest_of_binary(0)
            else:
                return
        else:
            self.expression()
        if self.v[self.i] != "}":
            self.need(";")

    def blocklike(self) -> None:
        if self.k[self.i] == "life":
            self.i += 1
            self.need(":")
        v = self.v[self.i]
        if v == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.take("else"):
                if self.v[self.i] == "if":
                    self.blocklike()
                else:
                    self.block()
        elif v == "match":
            self.i += 1
            self.condition()
            self.need("{")
            saved, self.plain = self.plain, False
            self.attributes()
            self.many(self.arm, ("}",))
            self.need("}")
            self.plain = saved
        elif v == "loop":
            self.i += 1
            self.block()
        elif v == "while":
            self.i += 1
            self.condition()
            self.block()
        elif v == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.block()
        elif v == "unsafe":
            self.i += 1
            self.block()
        else:
            self.block()

    def condition(self) -> None:
        saved, self.plain = self.plain, True
        self.expression()
        self.plain = saved

    def arm(self) -> None:
        self.attributes()
        self.pattern()
        if self.take("if"):
            self.expression()
        self.need("=>")
        if self.v[self.i] in self.BLOCKS and self.k[self.i] in ("op", "kw"):
            brace = self.v[self.i] == "{"
            self.blocklike()
            if self.v[self.i] in (".", "?"):
                self.rest_of_postfix()
                self.rest_of_binary(0)
                brace = False
            elif self.v[self.i] not in (",", "}") and not brace:
                self.rest_of_binary(0)
            if not self.take(",") and self.v[self.i] != "}" and not brace:
                self.fail("expected ','")
            return
        self.expression()
        if not self.take(",") and self.v[self.i] != "}":
            self.fail(f"expected ',' instead of {self.v[self.i]!r}")

    def expression(self) -> None:
        self.binary(0)

    def operator(self) -> tuple[str, int]:
        """The operator that begins here, put together of single marks, and the number of its tokens."""
        v = self.v[self.i]
        if self.k[self.i] == "kw":
            return (v, 1) if v == "as" else ("", 0)
        if self.k[self.i] != "op":
            return "", 0
        after = self.v[self.i + 1] if self.p[self.i + 1] == self.p[self.i] + 1 and self.k[self.i + 1] == "op" else ""
        if v in self.DOUBLE and after == v:
            third = self.v[self.i + 2] if self.p[self.i + 2] == self.p[self.i] + 2 else ""
            if v in "<>" and third == "=":
                return v + v + "=", 3
            return self.DOUBLE[v], 2
        if v in "<>" and after in ("<=", "==") or v == ">" and after == "=":
            return (v + after, 2) if after != "=" else (">=", 2)
        return v, 1

    def binary(self, least: int = 0) -> None:
        if self.v[self.i] in ("..", "..=") and self.k[self.i] == "op":
            self.i += 1
            if self.starts():
                self.binary(2)
        else:
            self.unary()
        self.rest_of_binary(least)

    def starts(self) -> bool:
        k, v = self.k[self.i], self.v[self.i]
        return k in ("id", "num", "str") or v in ("(", "[", "-", "!", "*", "&", "self", "Self", "super", "crate", "|", "if", "match", "true", "false") or v == "{" and not self.plain

    def rest_of_binary(self, least: int) -> None:
        while True:
            op, n = self.operator()
            if op in self.ASSIGN or op in ("<<=", ">>="):
                rank = 0
            else:
                rank = self.BINARY.get(op)
            if rank is None or rank < least:
                return
            self.i += n
            if op == "as":
                self.type()
            elif rank == 1:
                if self.starts():
                    self.binary(2)
            else:
                self.binary(rank if rank == 0 else rank + 1)
            if rank == 4 and self.BINARY.get(self.operator()[0]) == 4:
                self.fail("comparisons don't chain")

    def unary(self) -> None:
        v, k = self.v[self.i], self.k[self.i]
        if k == "op" and v in ("-", "!", "*"):
            self.i += 1
            self.unary()
        elif k == "op" and v == "&":
            self.i += 1
            if self.v[self.i] == "raw" and self.v[self.i + 1] in ("const", "mut"):
                self.i += 1
                self.take("const")
            self.take("mut")
            self.unary()
        else:
            self.postfix()

    def postfix(self) -> None:
        self.primary()
        self.rest_of_postfix()

    def rest_of_postfix(self) -> None:
        while self.k[self.i] == "op":
            v = self.v[self.i]
            if v == "?":
                self.i += 1
            elif v == ".":
                self.i += 1
                if self.k[self.i] == "num" or self.take("await"):
                    self.i += self.k[self.i] == "num" and self.v[self.i - 1] == "."
                    continue
                self.name()
                if self.take("::"):
                    self.generic_arguments()
            elif v == "(":
                self.i += 1
                self.enclosed(")")
            elif v == "[":
                self.i += 1
                saved, self.plain = self.plain, False
                self.expression()
                self.plain = saved
                self.need("]")
            else:
                return

    def enclosed(self, close: str) -> None:
        saved, self.plain = self.plain, False
        self.listed(self.attributed, close)
        self.plain = saved

    def attributed(self) -> None:
        self.attributes()
        self.expression()

    def primary(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k in ("num", "str") or v in ("true", "false") and k == "kw":
            self.i += 1
        elif v == "(" and k == "op":
            self.i += 1
            self.enclosed(")")
        elif v == "[" and k == "op":
            self.i += 1
            saved, self.plain = self.plain, False
            if not self.take("]"):
                self.expression()
                if self.take(";"):
                    self.expression()
                    self.need("]")
                elif not self.take("]"):
                    self.need(",")
                    self.listed(self.expression, "]")
            self.plain = saved
        elif v == "|" or v == "move" or v in ("static", "async", "const") and self.v[self.i + 1] in ("|", "move"):
            self.closure()
        elif v in ("async", "const") and self.v[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif v in self.BLOCKS and k in ("op", "kw") or k == "life":
            self.blocklike()
        elif v in ("return", "break", "continue") and k == "kw":
            self.i += 1
            if self.k[self.i] == "life" and v != "return":
                self.i += 1
            if v != "continue" and (self.starts() or self.v[self.i] in ("move", "unsafe", "loop", "return", "break", "<", "::", "..")):
                self.expression()
        elif v == "let" and k == "kw" and self.plain:
            self.i += 1
            self.pattern()
            self.need("=")
            self.binary(4)
        elif k == "id" or v in ("self", "Self", "super", "crate", "::", "<"):
            if v == "let":
                self.fail("unexpected 'let'")
            self.path(True)
            if self.v[self.i] == "!" and self.v[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.tree()
            elif self.v[self.i] == "{" and not self.plain and self.attempt(self.structure):
                pass
        else:
            self.fail(f"expected an expression instead of {v or k!r}")

    def structure(self) -> None:
        def field() -> None:
            self.attributes()
            if self.take(".."):
                if self.v[self.i] != "}":
                    self.expression()
                return
            self.i += 1 if self.k[self.i] in ("id", "num") else self.fail("expected a field")
            if self.take(":"):
                self.expression()

        self.need("{")
        self.listed(field, "}")

    def closure(self) -> None:
        while self.v[self.i] in ("static", "async", "move", "const"):
            self.i += 1

        def parameter() -> None:
            self.attributes()
            self.one_pattern()
            if self.take(":"):
                self.type()

        self.need("|")
        self.listed(parameter, "|")
        if self.take("->"):
            self.type()
            self.block()
        else:
            self.expression()
