"""JSON (RFC 8259)."""

from __future__ import annotations

import re

from .base import Bad, Parser, Tokens, scan

_PATTERN = re.compile(
    r"""(?P<space>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))
    |(?P<id>[A-Za-z]+)|(?P<op>[{}\[\],:])|(?P<bad>"[^"\n]*"?)""",
    re.X,
)


class Json(Parser):
    """One JSON value."""

    def __init__(self, text: str) -> None:
        super().__init__(scan(text, _PATTERN, frozenset(("true", "false", "null")), Tokens()))

    def file(self) -> None:
        self.element()
        if self.k[self.i] != "eof":
            self.fail("more after the value")

    def element(self) -> None:
        if self.k[self.i] in ("str", "num", "kw"):
            self.i += 1
        elif self.take("["):
            self.items(self.element, "]")
        elif self.take("{"):
            self.items(self.pair, "}")
        else:
            self.fail(f"expected a value instead of {self.v[self.i] or self.k[self.i]!r}")

    def items(self, one, close: str) -> None:
        """Items up to and including ``close``; after an error, on from the next comma or from the closing bracket."""
        if self.take(close):
            return
        while True:
            try:
                one()
                if self.v[self.i] not in (",", close):
                    self.fail(f"expected ',' or {close!r} instead of {self.v[self.i] or self.k[self.i]!r}")
            except Bad as e:
                self.note(e)
                depth = 0
                while self.k[self.i] != "eof":
                    v = self.v[self.i] if self.k[self.i] == "op" else ""
                    if not depth and v in (",", "]", "}"):
                        break
                    depth += (v in ("[", "{")) - (v in ("]", "}"))
                    self.i += 1
            if not self.take(","):
                break
        if not self.take(close):
            e = Bad(f"expected {close!r} instead of {self.v[self.i] or self.k[self.i]!r}", self.p[self.i])
            if self.k[self.i] == "eof":
                raise e
            self.note(e)
            self.i += self.v[self.i] in ("]", "}")  # the wrong bracket closes as well

    def pair(self) -> None:
        if self.k[self.i] != "str":
            self.fail("expected a string as key")
        self.i += 1
        self.need(":")
        self.element()
