"""Splits query text into tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import QuerySyntaxError

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<int>0x[0-9a-fA-F]+|\d+)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`(?:[^`]|``)*`)
    |(?P<name>[^\W\d]\w*)
    |(?P<op><=|>=|<>|!=|=~|\.\.|[-+*/%^=<>(){}\[\],.:;|!$&])""",
    re.X | re.S,
)

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", "'": "'", '"': '"', "/": "/"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


def unescape(body: str) -> str:
    def one(m):
        c = m[1]
        return chr(int(c[1:], 16)) if len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, body, flags=re.S)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out
