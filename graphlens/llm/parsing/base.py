"""What the parsers share: tokens by offset, errors, recovery."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from typing import NamedTuple

class Token(NamedTuple):
    kind: str  # id, num, str, p (punctuation), eof and kinds of one language
    text: str
    start: int
    end: int
    newline: bool  # a line break stands before it


@dataclass
class SyntaxFault:
    line: int
    message: str


class Fault(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class Parser:
    """Tokens are read on demand and kept by offset, so going back is cheap."""

    def __init__(self, text: str):
        self.text = text
        self.faults: list[SyntaxFault] = []
        self.n_faults = 0
        self.kept: dict[int, Token] = {}
        self._lines: list[int] | None = None
        self.guess = 0  # > 0: trying a reading, no recovery
        self.tok: Token = self.token_at(0)
        self.last_end = 0

    def lex(self, at: int) -> Token:
        raise NotImplementedError

    def token_at(self, at: int) -> Token:
        t = self.kept.get(at)
        if t is None:
            t = self.kept[at] = self.lex(at)
        return t

    def line_of(self, at: int) -> int:
        if self._lines is None:
            self._lines = [0]
            i = self.text.find("\n")
            while i >= 0:
                self._lines.append(i + 1)
                i = self.text.find("\n", i + 1)
        return bisect_right(self._lines, at)

    def next(self) -> Token:
        t = self.tok
        self.last_end = t.end
        self.tok = self.token_at(t.end)
        return t

    def peek(self) -> Token:
        return self.token_at(self.tok.end)

    def mark(self):
        return self.tok, self.last_end

    def reset(self, m) -> None:
        self.tok, self.last_end = m

    def fail(self, message: str | None = None, at: int | None = None):
        t = self.tok
        raise Fault(t.start if at is None else at, message or (f"unexpected {t.text[:20]!r}" if t.kind != "eof" else "unexpected end of file"))

    def record(self, f: Fault) -> None:
        self.n_faults += 1
        self.faults.append(SyntaxFault(self.line_of(f.at), f.message))

    def at_p(self, text: str) -> bool:
        return self.tok.kind == "p" and self.tok.text == text

    def at_word(self, text: str) -> bool:
        return self.tok.kind == "id" and self.tok.text == text

    def take_p(self, text: str) -> bool:
        if self.tok.kind == "p" and self.tok.text == text:
            self.next()
            return True
        return False

    def take_word(self, text: str) -> bool:
        if self.tok.kind == "id" and self.tok.text == text:
            self.next()
            return True
        return False

    def need_p(self, text: str) -> None:
        if not (self.tok.kind == "p" and self.tok.text == text):
            self.fail(f"expected {text!r} before {self.tok.text[:20]!r}" if self.tok.kind != "eof" else f"expected {text!r} before end of file")
        self.next()

    def need_word(self, text: str) -> None:
        if not self.take_word(text):
            self.fail(f"expected {text!r}")

    def attempt(self, parse):
        """Result of parse, or None with the position restored."""
        m = self.mark()
        self.guess += 1
        try:
            return parse() or True
        except Fault:
            self.reset(m)
            return None
        finally:
            self.guess -= 1
