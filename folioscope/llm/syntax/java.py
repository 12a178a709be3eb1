"""Java 17."""

from __future__ import annotations

import re

from .base import Parser, Tokens, scan

# Reserved words.
KEYWORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally
    float for goto if implements import instanceof int interface long native new package private protected public return short
    static strictfp super switch synchronized this throw throws transient try void volatile while true false null _""".split()
)
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile".split())
_PATTERN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\r\n]*|/\*.*?\*/)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<num>0[xX][0-9a-fA-F_]+[lL]?(?![\w.])|0[bB][01_]+[lL]?(?!\w)|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[lLfFdD]?(?![\w]))
    |(?P<str>\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\.)*?\"\"\"|"(?!"")(?:[^"\\\r\n]|\\(?:[btnfrs"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))*"|""(?!")|'(?:[^'\\\r\n]|\\(?:[btnfrs"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))')
    |(?P<op>\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<=|<<|[-+*/%&|^~!<>=?:;,.(){}\[\]@])
    |(?P<bad>/\*|["']|[0-9]\w*)""",
    re.X | re.S,
)


class Java(Parser):
    """A compilation unit."""

    BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
    ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<=".split())

    def __init__(self, text: str) -> None:
        super().__init__(scan(text, _PATTERN, KEYWORDS, Tokens()))

    def file(self) -> None:
        if self.v[self.i] == "package" or self.v[self.i] == "@" and self.attempt(lambda: (self.modifiers(), self.v[self.i] == "package")[1]):
            self.need("package")
            self.qualified()
            self.need(";")
        while self.v[self.i] == "import":
            self.i += 1
            self.take("static")
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.need(";")
        self.many(self.top)

    def top(self) -> None:
        if self.take(";"):
            return
        self.modifiers()
        if not self.declaration():
            self.fail(f"expected a class or interface instead of {self.v[self.i]!r}")

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def modifiers(self) -> None:
        while True:
            v = self.v[self.i]
            if v == "@" and self.v[self.i + 1] != "interface":
                self.i += 1
                self.qualified()
                if self.take("("):
                    self.listed(self.element_value, ")", trailing=False)
            elif v in MODIFIERS and not (v == "default" and self.v[self.i + 1] in (":", "->")):
                self.i += 1
            elif v in ("sealed",) and self.k[self.i + 1] in ("id", "kw"):
                self.i += 1
            elif v == "non" and self.v[self.i + 1] == "-" and self.v[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def element_value(self) -> None:
        if self.k[self.i] == "id" and self.v[self.i + 1] == "=":
            self.i += 2
        if self.v[self.i] == "@":
            self.modifiers()
        elif self.take("{"):
            self.listed(self.element_value, "}")
        else:
            self.conditional()

    def declaration(self) -> bool:
        """A class, interface, enum, record or annotation type."""
        v = self.v[self.i]
        if v == "class":
            self.i += 1
            self.name()
            self.parameters_of_type()
            if self.take("extends"):
                self.type()
            self.supertypes("implements")
            self.supertypes("permits")
            self.class_body()
        elif v == "interface" or v == "@" and self.v[self.i + 1] == "interface":
            self.i += 1 + (v == "@")
            self.name()
            self.parameters_of_type()
            self.supertypes("extends")
            self.supertypes("permits")
            self.class_body()
        elif v == "enum":
            self.i += 1
            self.name()
            self.supertypes("implements")
            self.need("{")
            while self.v[self.i] not in (";", "}"):
                self.modifiers()
                self.name()
                if self.take("("):
                    self.listed(self.expression, ")", trailing=False)
                if self.v[self.i] == "{":
                    self.class_body()
                if not self.take(","):
                    break
            if self.take(";"):
                self.many(self.member, ("}",))
            self.need("}")
        elif v == "record" and self.k[self.i + 1] == "id" and self.v[self.i + 2] in ("(", "<"):
            self.i += 1
            self.name()
            self.parameters_of_type()
            self.need("(")
            self.listed(self.parameter, ")", trailing=False)
            self.supertypes("implements")
            self.class_body()
        else:
            return False
        return True

    def supertypes(self, word: str) -> None:
        if self.take(word):
            self.type()
            while self.take(","):
                self.type()

    def parameters_of_type(self) -> None:
        def one() -> None:
            self.modifiers()
            self.name()
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()

        if self.take("<"):
            self.listed(one, ">", 1, trailing=False)

    def class_body(self) -> None:
        self.need("{")
        self.many(self.member, ("}",))
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.v[self.i] == "{" or self.v[self.i] == "static" and self.v[self.i + 1] == "{":
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.declaration():
            return
        self.parameters_of_type()
        self.modifiers()
        if self.k[self.i] == "id" and self.v[self.i + 1] in ("(", "{"):
            self.i += 1
            if self.v[self.i] == "{":
                self.block()
                return
            self.method_rest(True)
            return
        if not self.take("void"):
            self.type()
        self.name()
        if self.v[self.i] == "(":
            self.method_rest(False)
        else:
            self.declarators()
            self.need(";")

    def method_rest(self, constructor: bool) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=False)
        self.dimensions()
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()
        if self.take("default"):
            self.element_value()
        if self.v[self.i] == "{":
            self.block()
        elif constructor:
            self.fail("expected a body")
        else:
            self.need(";")

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.modifiers()
        self.take("...")
        if not self.take("this"):
            self.name()
            if self.take("."):
                self.need("this")
        self.dimensions()

    def dimensions(self) -> None:
        while self.v[self.i] in ("[", "@") and (self.v[self.i] == "@" or self.v[self.i + 1] == "]"):
            if self.v[self.i] == "@":
                self.modifiers()
            else:
                self.i += 2

    def declarators(self) -> None:
        """What follows the first name of variables."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initial()
            if not self.take(","):
                return
            self.name()

    def initial(self) -> None:
        if self.take("{"):
            self.listed(self.initial, "}")
        else:
            self.expression()

    def type(self) -> None:
        self.modifiers()
        if self.v[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.v[self.i] == "." and (self.k[self.i + 1] == "id" or self.v[self.i + 1] == "@"):
                self.i += 1
                self.modifiers()
                self.name()
                self.type_arguments()
        self.dimensions()

    def type_arguments(self) -> None:
        def one() -> None:
            self.modifiers()
            if self.take("?"):
                if self.v[self.i] in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()

        if self.take("<"):
            self.listed(one, ">", trailing=False)

    # statements
    def block(self) -> None:
        self.need("{")
        self.many(self.statement, ("}",))
        self.need("}")

    def local(self) -> bool:
        """A local variable declaration up to its end mark, or nothing."""

        def head() -> bool:
            self.modifiers()
            self.type()
            self.name()
            return self.v[self.i] in ("=", ";", ",", ":", "[", ")")

        if self.k[self.i] != "id" and self.v[self.i] not in PRIMITIVE and self.v[self.i] not in ("final", "@"):
            return False
        if not self.attempt(head):
            return False
        if self.v[self.i] != ":":
            self.declarators()
        return True

    def statement(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if v == "{":
            self.block()
        elif v == ";":
            self.i += 1
        elif k == "kw" and v in self.STATEMENTS:
            self.STATEMENTS[v](self)
        elif k == "id" and self.v[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif k == "id" and v == "yield" and self.v[self.i + 1] not in ("=", ".", "(", "++", "--", "["):
            self.i += 1
            self.expression()
            self.need(";")
        elif (v in ("class", "interface", "enum", "abstract", "final", "static", "strictfp", "@", "record", "sealed")) and self.attempt(lambda: (self.modifiers(), self.v[self.i] in ("class", "interface", "enum") or self.v[self.i] == "record" and self.k[self.i + 1] == "id" and self.v[self.i + 2] in ("(", "<"))[1]):
            self.declaration()
        elif self.local():
            self.need(";")
        else:
            if self.expression() != "statement":
                self.fail("not a statement")
            self.need(";")

    def parenthesised(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.i += 1
        self.parenthesised()
        self.statement()
        if self.take("else"):
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.parenthesised()
        self.statement()

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.parenthesised()
        self.need(";")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        if self.v[self.i] != ";":
            if self.local():
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
            else:
                self.expression()
                while self.take(","):
                    self.expression()
        self.need(";")
        if self.v[self.i] != ";":
            self.expression()
        self.need(";")
        if self.v[self.i] != ")":
            self.expression()
            while self.take(","):
                self.expression()
        self.need(")")
        self.statement()

    def return_(self) -> None:
        self.i += 1
        if self.v[self.i] != ";":
            self.expression()
        self.need(";")

    def throw(self) -> None:
        self.i += 1
        self.expression()
        self.need(";")

    def jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "id":
            self.i += 1
        self.need(";")

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def synchronized(self) -> None:
        self.i += 1
        self.parenthesised()
        self.block()

    def try_(self) -> None:
        self.i += 1
        resources = self.take("(")
        while resources and not self.take(")"):
            if not self.local():
                self.expression()
            if not self.take(";"):
                self.need(")")
                break
        self.block()
        n = 0
        while self.take("catch"):
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
            n += 1
        if self.take("finally"):
            self.block()
        elif not n and not resources:
            self.fail("expected 'catch' or 'finally'")

    def switch(self) -> None:
        self.switch_expression()

    def switch_expression(self) -> None:
        self.need("switch")
        self.parenthesised()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                while True:
                    if not self.take("default"):
                        self.conditional()
                    if not self.take(","):
                        break
            else:
                self.need("default")
            if self.take("->"):
                if self.v[self.i] == "{":
                    self.block()
                elif self.v[self.i] == "throw":
                    self.throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                self.many(self.statement, ("case", "default", "}"))

    # expressions; "statement" marks those that can stand as a statement
    def expression(self) -> str:
        left = self.conditional()
        v = self.v[self.i]
        if v in self.ASSIGN and self.k[self.i] == "op" or v == ">" and self.shifted() and self.v[self.i + self.shifted() - 1] == ">=":
            if left not in ("name", "part"):
                self.fail("cannot assign to this expression")
            self.i += 1 if v != ">" else self.shifted()
            self.expression()
            return "statement"
        return left

    def shifted(self) -> int:
        """Tokens of '>>', '>>>', '>>=' or '>>>=' that begin here, or 0."""
        n = 1
        while n < 4 and self.v[self.i + n] in (">", ">=") and self.p[self.i + n] == self.p[self.i] + n:
            n += 1
            if self.v[self.i + n - 1] == ">=":
                break
        return n if n > 1 else 0

    def conditional(self) -> str:
        left = self.binary()
        if self.take("?"):
            self.expression()
            self.need(":")
            self.lambda_or(self.conditional)
            return "other"
        return left

    def lambda_or(self, f) -> None:
        f()

    def binary(self, least: int = 0) -> str:
        left = self.unary()
        while True:
            op = self.v[self.i]
            rank = self.BINARY.get(op) if self.k[self.i] in ("op", "kw") else None
            n = 1
            if op == ">" and (s := self.shifted()):
                if self.v[self.i + s - 1] == ">=":
                    return left
                rank, n = 8, s
            if rank is None or rank < least:
                return left
            self.i += n
            left = "other"
            if op == "instanceof":
                self.modifiers()
                self.type()
                if self.k[self.i] == "id":
                    self.i += 1
            else:
                self.binary(rank + 1)

    def unary(self) -> str:
        v = self.v[self.i]
        if self.k[self.i] == "op":
            if v in ("++", "--"):
                self.i += 1
                self.unary()
                return "statement"
            if v in ("+", "-", "!", "~"):
                self.i += 1
                self.unary()
                return "other"
            if v == "(":
                if self.lambda_ahead() and self.attempt(self.lambda_head):
                    self.lambda_body()
                    return "other"
                if self.attempt(self.cast):
                    return "other"
        if self.k[self.i] == "id" and self.v[self.i + 1] == "->":
            self.i += 1
            self.lambda_body()
            return "other"
        return self.postfix()

    def lambda_ahead(self) -> bool:
        depth, j = 0, self.i
        while self.k[j] != "eof":
            if self.v[j] == "(" and self.k[j] == "op":
                depth += 1
            elif self.v[j] == ")" and self.k[j] == "op":
                depth -= 1
                if depth == 0:
                    return self.v[j + 1] == "->"
            j += 1
        return False

    def lambda_head(self) -> bool:
        self.need("(")
        if self.k[self.i] == "id" and self.v[self.i + 1] in (",", ")"):
            self.listed(self.name, ")", trailing=False)
        else:
            self.listed(self.parameter, ")", trailing=False)
        return self.v[self.i] == "->"

    def lambda_body(self) -> None:
        self.need("->")
        if self.v[self.i] == "{":
            self.block()
        else:
            self.expression()

    def cast(self) -> bool:
        self.need("(")
        primitive = self.v[self.i] in PRIMITIVE
        self.type()
        while self.take("&"):
            self.type()
            primitive = False
        self.need(")")
        k, v = self.k[self.i], self.v[self.i]
        if primitive and self.v[self.i - 2] != "]":
            self.unary()
            return True
        if k in ("id", "num", "str") or v in ("(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or v in PRIMITIVE or v == "void":
            self.unary()
            return True
        return False

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.expression, ")", trailing=False)

    def postfix(self) -> str:
        left = self.primary()
        while True:
            v = self.v[self.i]
            if self.k[self.i] != "op":
                return left
            if v == ".":
                self.i += 1
                if self.take("new"):
                    self.creator()
                    left = "statement"
                    continue
                self.type_arguments()
                if self.v[self.i] in ("class", "this", "super"):
                    self.i += 1
                else:
                    self.name()
                left = "part"
                if self.v[self.i] == "(":
                    self.arguments()
                    left = "statement"
            elif v == "(" and self.v[self.i - 1] in ("this", "super"):
                self.arguments()
                left = "statement"
            elif v == "[":
                self.i += 1
                self.expression()
                self.need("]")
                left = "part"
            elif v in ("++", "--"):
                if left not in ("name", "part"):
                    self.fail("cannot count this expression up or down")
                self.i += 1
                left = "statement"
            elif v == "::":
                self.i += 1
                self.type_arguments()
                if not self.take("new"):
                    self.name()
                left = "other"
            else:
                return left

    def primary(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k == "id":
            if self.v[self.i + 1] in ("<", "[", ".") and self.attempt(self.reference):
                return "other"
            self.i += 1
            if self.v[self.i] == "(":
                self.arguments()
                return "statement"
            return "name"
        if k in ("num", "str") or v in ("true", "false", "null", "this", "super"):
            self.i += 1
            return "other"
        if v == "(":
            self.i += 1
            left = self.expression()
            self.need(")")
            return left if left in ("name", "part") else "other"
        if v == "new":
            self.i += 1
            self.creator()
            return "statement"
        if v in PRIMITIVE or v == "void":
            self.i += 1
            self.dimensions()
            if self.v[self.i] == "::":
                return "other"
            self.need(".")
            self.need("class")
            return "other"
        if v == "switch":
            self.switch_expression()
            return "other"
        self.fail(f"unexpected {v or k!r}")

    def reference(self) -> bool:
        """A type before '::' or '.class' that isn't a plain expression."""
        self.type()
        if self.v[self.i] == "::":
            return True
        if self.v[self.i] == "." and self.v[self.i + 1] == "class" and self.v[self.i - 1] == "]":
            self.i += 2
            return True
        return False

    def creator(self) -> None:
        self.type_arguments()
        self.modifiers()
        if self.v[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.take("."):
                self.name()
                self.type_arguments()
        if self.v[self.i] == "(":
            self.arguments()
            if self.v[self.i] == "{":
                self.class_body()
            return
        if self.v[self.i] != "[":
            self.fail("expected arguments or dimensions")
        sized = self.v[self.i + 1] != "]"
        while self.v[self.i] == "[":
            self.i += 1
            if not self.take("]"):
                self.expression()
                self.need("]")
        if not sized:
            self.need("{")
            self.listed(self.initial, "}")

    STATEMENTS = {
        "if": if_, "while": while_, "do": do, "for": for_, "return": return_, "throw": throw, "break": jump, "continue": jump,
        "assert": assert_, "synchronized": synchronized, "try": try_, "switch": switch,
    }
