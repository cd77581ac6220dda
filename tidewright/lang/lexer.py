"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class DialectError(ValueError):
    """The text is not of the dialect, or says what no plan can do."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, number, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      |(?P<string>'(?:[^']|'')*')
      |(?P<quoted>"[^"]+"|`[^`]+`)
      |(?P<word>[^\W\d]\w*)
      |(?P<op>->|<>|!=|<=|>=|\|\||[-+*/%=<>(),.;\[\]{}!])""",
    re.VERBOSE | re.DOTALL,
)


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise DialectError(f"unexpected {text[at]!r} at {at}")
        kind, s = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token(kind, s[1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token(kind, s[1:-1], at))
        elif kind != "space":
            out.append(Token(kind, s, at))
        at = m.end()
    return [*out, Token("end", "", at)]
