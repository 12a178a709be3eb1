"""Tokens, errors and the parts that all recursive-descent parsers share."""

from __future__ import annotations

import re

class Bad(Exception):
    """A syntax error: message and position."""


class Tokens:
    """A token stream as parallel lists: kind (id, kw, num, str, op, nl, indent, dedent, eof), value, position, newline before."""

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.value: list[str] = []
        self.at: list[int] = []
        self.newline: list[bool] = []
        self.errors: list[tuple[int, str]] = []

    def add(self, kind: str, value: str, at: int, newline: bool = False) -> None:
        self.kind.append(kind)
        self.value.append(value)
        self.at.append(at)
        self.newline.append(newline)


#: A merge marker at the start of a line.
MARKER = re.compile(r"(?m)^(?:<{7}|>{7}|={7}|\|{7})(?=[ \t\r\n]|\Z)")


class Parser:
    """Recursive descent over tokens, with precedence climbing and panic-mode recovery."""

    BINARY: dict[str, int] = {}
    RIGHT: frozenset[str] = frozenset()

    def __init__(self, tokens: Tokens) -> None:
        self.k, self.v, self.p, self.n = tokens.kind, tokens.value, tokens.at, tokens.newline
        self.errors = list(tokens.errors)
        self.i = 0
        self._closing: dict[int, int] | None = None

    # single tokens
    def fail(self, what: str):
        raise Bad(what, self.p[self.i])

    def take(self, value: str) -> bool:
        if self.v[self.i] == value:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if self.v[self.i] != value:
            self.fail(f"expected {value!r} instead of {self.v[self.i] or self.k[self.i]!r}")
        self.i += 1

    def name(self) -> str:
        if self.k[self.i] != "id":
            self.fail(f"expected a name instead of {self.v[self.i] or self.k[self.i]!r}")
        self.i += 1
        return self.v[self.i - 1]

    # repetition and recovery
    def many(self, one, stop: tuple[str, ...] = ()) -> None:
        """``one`` again and again up to one of ``stop`` or the end; after an error, on from the next likely start."""
        while self.k[self.i] != "eof" and self.v[self.i] not in stop:
            before = self.i
            try:
                one()
            except Bad as e:
                self.note(e)
                self.recover(before, stop)
            else:
                if self.i == before:
                    self.note(Bad(f"unexpected {self.v[self.i] or self.k[self.i]!r}", self.p[self.i]))
                    self.i += 1

    def note(self, e: Bad) -> None:
        self.errors.append((e.args[1], e.args[0]))

    def recover(self, before: int, stop: tuple[str, ...]) -> None:
        self.i = max(self.i, before + 1) if self.k[self.i] != "eof" else self.i
        depth = 0
        while self.k[self.i] != "eof":
            v = self.v[self.i]
            if depth == 0 and (v in stop or v == ";" or self.n[self.i]):
                self.i += v == ";"
                return
            if v == "{":
                depth += 1
            elif v == "}":
                if depth == 0:
                    return
                depth -= 1
            self.i += 1

    def closing(self, i: int) -> int:
        """Where the bracket that opens at ``i`` is closed, or the end; found for all brackets in one pass."""
        if self._closing is None:
            self._closing, open_ = {}, []
            for j, (k, v) in enumerate(zip(self.k, self.v)):
                if k == "op":
                    if v in ("(", "[", "{", "${"):
                        open_.append(j)
                    elif v in (")", "]", "}") and open_:
                        self._closing[open_.pop()] = j
        return self._closing.get(i, len(self.k) - 5)

    def listed(self, one, close: str, least: int = 0, trailing: bool = True) -> int:
        """Items separated by commas up to and including ``close``."""
        n = 0
        while not self.take(close):
            if n:
                self.need(",")
                if trailing and self.take(close):
                    break
            one()
            n += 1
        if n < least:
            self.fail("expected an item")
        return n

    def attempt(self, f) -> bool:
        """Whether ``f`` parses here; if not, nothing is consumed."""
        i, e = self.i, len(self.errors)
        try:
            if f() is not False:
                return True
        except Bad:
            pass
        self.i = i
        del self.errors[e:]
        return False

    def binary(self, least: int = 0):
        """Precedence climbing over ``BINARY``."""
        left = self.unary()
        while True:
            op = self.v[self.i]
            rank = self.BINARY.get(op)
            if rank is None or rank < least or self.k[self.i] == "str":
                return left
            self.i += 1
            self.binary(rank if op in self.RIGHT else rank + 1)
            left = "binary"

    def unary(self):
        raise NotImplementedError

    def file(self) -> None:
        raise NotImplementedError

    def run(self) -> list[tuple[int, str]]:
        """All errors of a file, in order of position."""
        try:
            self.file()
        except Bad as e:
            self.note(e)
        return sorted(self.errors)


def scan(text: str, pattern: re.Pattern, keywords: frozenset[str], tokens: Tokens, special=None) -> Tokens:
    """Tokens by one pattern with the groups space, comment, id, num, str, op and bad; ``special`` may handle a match itself.

    ``special(kind, match, tokens)`` returns None, or the position to go on from.
    """
    i, newline, n = 0, True, len(text)
    match = pattern.match
    while i < n:
        m = match(text, i)
        if m is None:
            tokens.errors.append((i, f"unexpected character {text[i]!r}"))
            i += 1
            continue
        kind, value, j = m.lastgroup, m.group(), m.end()
        if special is not None:
            to = special(kind, m, tokens, newline)
            if to is not None:
                newline = False
                i = to
                continue
        if kind == "space" or kind == "comment":
            if "\n" in value or "\r" in value:
                newline = True
            i = j
            continue
        if kind == "bad":
            tokens.errors.append((i, f"unterminated or malformed {value[:12]!r}"))
            tokens.add("str", '"', i, newline)
        elif kind == "id":
            tokens.add("kw" if value in keywords else "id", value, i, newline)
        elif kind == "str":
            tokens.add("str", '"', i, newline)
        else:
            tokens.add(kind, value, i, newline)
        newline = False
        i = j
    tokens.add("eof", "", n, True)
    for _ in range(4):  # looking ahead never runs over the end
        tokens.add("eof", "", n, True)
    return tokens
