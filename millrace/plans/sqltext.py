"""A small SQL tokenizer: enough to find names, strings, comments and brackets exactly."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
      (?P<space>\s+)
    | (?P<comment>--[^\n]*|/\*.*?\*/)
    | (?P<string>[eExX]?'(?:[^']|'')*')
    | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<word>[^\W\d]\w*(?:\$\w*)?|@\w+|\$\d+|:[^\W\d]\w*(?=\W|$)(?<!::))
    | (?P<mark>::|\|\||<=>|<=|>=|<>|!=|==|->|=>|[-+*/%=<>(),.;\[\]{}?:^&|~!@\#$\\])
    | (?P<other>.)
    """,
    re.X | re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text

    @property
    def blank(self) -> bool:
        return self.kind in ("space", "comment")

    def name(self) -> str:
        """The identifier that a word or a quoted token spells."""
        if self.kind != "quoted":
            return self.text
        mark = self.text[0]
        return self.text[1:-1].replace(mark * 2, mark)


def tokenize(sql: str) -> list[Token]:
    return [Token(m.lastgroup if m.lastgroup != "other" else "mark", m[0]) for m in _TOKEN.finditer(sql)]


def text(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def solid(tokens: list[Token]) -> list[Token]:
    """Tokens without white space and comments."""
    return [t for t in tokens if not t.blank]


def closing(tokens: list[Token], at: int) -> int:
    """The index of the bracket that closes the one at ``at``; the last index if none does."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "mark":
            if tokens[i].text in "([{":
                depth += 1
            elif tokens[i].text in ")]}":
                depth -= 1
                if depth == 0:
                    return i
    return len(tokens) - 1


def opening(tokens: list[Token], at: int) -> int:
    """The index of the bracket that opens what the one at ``at`` closes."""
    depth = 0
    for i in range(at, -1, -1):
        if tokens[i].kind == "mark":
            if tokens[i].text in ")]}":
                depth += 1
            elif tokens[i].text in "([{":
                depth -= 1
                if depth == 0:
                    return i
    return 0


def split(tokens: list[Token], mark: str = ",") -> list[list[Token]]:
    """Parts of a token list between top-level marks."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "mark" and t.text in "([{":
            depth += 1
        elif t.kind == "mark" and t.text in ")]}":
            depth -= 1
        if depth == 0 and t.kind == "mark" and t.text == mark:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def following(tokens: list[Token], at: int) -> int:
    """The next index after ``at`` that isn't blank, or the length."""
    at += 1
    while at < len(tokens) and tokens[at].blank:
        at += 1
    return at


def preceding(tokens: list[Token], at: int) -> int:
    """The index before ``at`` that isn't blank, or -1."""
    at -= 1
    while at >= 0 and tokens[at].blank:
        at -= 1
    return at


def statements(sql: str) -> list[str]:
    """The statements of a text, without empty ones."""
    return [text(part).strip() for part in split(tokenize(sql), ";") if solid(part)]
