"""Python, 3.10 or later: syntax that any such version accepts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from graphlens.llm.parsing.base import SyntaxFault

# Hard keywords, binary operators by strength.
_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while "
    "with yield".split())
_BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_COMPARE = frozenset("< > == >= <= !=".split())
_OPERATOR = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_NAME = re.compile(r"[^\W\d]\w*")
_NAME_REST = re.compile(r"\w*")
_NUMBER = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?")
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")
_PREFIX = re.compile(r"([rR][bBfF]?|[bB][rR]?|[fF][rR]?|[uU])?('''|\"\"\"|'|\")")
_BLANK = re.compile(r"(?:[ \t\f]|\\\r?\n)*")
_ENDS = {q: re.compile(r"(?:[^\\]|\\.)*?" + q, re.S) for q in ("'''", '"""')} | {q: re.compile(rf"(?:[^\\{q}\n]|\\.)*{q}", re.S) for q in ("'", '"')}
_ESCAPE = re.compile(r"\\(?:(N\{([^}]*)\})|(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|([xuUN])|.)", re.S)


@lru_cache(10_000)
def _named(name: str) -> bool:
    try:
        unicodedata.lookup(name)
        return True
    except (KeyError, ValueError):
        return False


class _Bad(Exception):
    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line, self.message = line, message


class Lexer:
    def __init__(self, text: str):
        self.text = text
        self.tokens: list[tuple[str, str, int]] = []
        self.faults: list[SyntaxFault] = []
        self.line = 1
        self.fields: list[tuple[list, int]] = []  # tokens of the fields of f-strings

    def fault(self, message: str, line: int | None = None) -> None:
        self.faults.append(SyntaxFault(self.line if line is None else line, message))

    def run(self) -> list[tuple[str, str, int]]:
        text, n, out = self.text, len(self.text), self.tokens
        i = 1 if text.startswith("﻿") else 0
        indents, alternatives = [0], [0]
        brackets: list[tuple[str, int]] = []
        fresh = True
        while i < n:
            if fresh and not brackets:
                col = alt = 0
                while i < n:
                    c = text[i]
                    if c == " ":
                        col, alt = col + 1, alt + 1
                    elif c == "\t":
                        col, alt = (col // 8 + 1) * 8, alt + 1
                    elif c == "\f":
                        col = alt = 0
                    elif c == "\\" and text[i + 1:i + 2] == "\n":
                        self.line += 1
                        i += 1
                    else:
                        break
                    i += 1
                if i >= n:
                    break
                if text[i] == "#":
                    i = text.find("\n", i)
                    if i < 0:
                        break
                if text[i] == "\n":
                    self.line += 1
                    i += 1
                    continue
                fresh = False
                if col > indents[-1]:
                    if alt <= alternatives[-1]:
                        self.fault("inconsistent use of tabs and spaces")
                    indents.append(col)
                    alternatives.append(alt)
                    out.append(("in", "", self.line))
                else:
                    while col < indents[-1]:
                        indents.pop()
                        alternatives.pop()
                        out.append(("de", "", self.line))
                    if col != indents[-1]:
                        self.fault("unindent matches no outer level")
                        indents.append(col)
                        alternatives.append(alt)
                        out.append(("in", "", self.line))
                    elif alt != alternatives[-1]:
                        self.fault("inconsistent use of tabs and spaces")
            m = _BLANK.match(text, i)
            if m.end() > i:
                self.line += text.count("\n", i, m.end())
                i = m.end()
                if i >= n:
                    break
            c = text[i]
            if c == "\n":
                if not brackets:
                    out.append(("nl", "", self.line))
                    fresh = True
                self.line += 1
                i += 1
                continue
            if c == "#":
                j = text.find("\n", i)
                i = n if j < 0 else j
                continue
            kind, word, end = self.token(i)
            out.append((kind, word, self.line_at))
            if kind == "op":
                if word in ("(", "[", "{"):
                    brackets.append((word, self.line))
                elif word in (")", "]", "}"):
                    if not brackets:
                        self.fault(f"unmatched {word!r}")
                    elif "([{".index(brackets[-1][0]) != ")]}".index(word):
                        self.fault(f"{word!r} does not match {brackets[-1][0]!r}")
                        brackets.pop()
                    else:
                        brackets.pop()
            i = end
        if brackets:
            self.fault(f"{brackets[-1][0]!r} was never closed", brackets[-1][1])
        if out and out[-1][0] not in ("nl", "de"):
            out.append(("nl", "", self.line))
        out += [("de", "", self.line)] * (len(indents) - 1)
        out.append(("end", "", self.line))
        return out

    def token(self, i: int) -> tuple[str, str, int]:
        """(kind, text, end) of the token at i; line counting goes on over it, line_at is where it starts."""
        text = self.text
        self.line_at = self.line
        c = text[i]
        if c in "rRbBfFuU'\"":
            m = _PREFIX.match(text, i)
            if m:
                return self.string(i, (m.group(1) or "").lower(), m.group(2), m.end())
        if c.isdigit() and c.isascii() or c == "." and text[i + 1:i + 2].isdigit():
            m = _NUMBER.match(text, i)
            end = m.end()
            word = m.group()
            if re.match(r"0(?:_?0)*_?[1-9]", word) and not re.search(r"[.eEjJxXoObB]", word):
                self.fault("leading zeros in a number")
            nxt = text[end:end + 1]
            if nxt and (nxt.isalnum() or nxt == "_") and not _AFTER_NUMBER.match(text, end):
                self.fault("invalid number")
                end = re.compile(r"\w*").match(text, end).end()
            return "num", word, end
        if c.isalpha() or c == "_" or c > "\x7f":
            m = _NAME.match(text, i)
            if m:
                w = m.group()
                end = m.end()
                while text[end:end + 1] > "\x7f" and (w + text[end]).isidentifier():  # marks that \w does not know
                    more = _NAME_REST.match(text, end + 1).end()
                    w, end = text[i:more], more
                if w.isascii() or w.isidentifier():
                    return "name", w, end
                j = next(k for k in range(1, len(w) + 1) if not w[:k].isidentifier())
                if j > 1:
                    return "name", w[:j - 1], i + j - 1
            self.fault(f"invalid character {c!r}")
            return "bad", c, i + 1
        m = _OPERATOR.match(text, i)
        if m:
            return "op", m.group(), m.end()
        self.fault("unexpected character after line continuation" if c == "\\" else f"invalid character {c!r}")
        return "bad", c, i + 1

    def string(self, start: int, prefix: str, quote: str, at: int) -> tuple[str, str, int]:
        text = self.text
        if "f" in prefix:
            begin = self.line
            try:
                end = self.f_string(at, quote, "r" in prefix, False)
            except _Bad as b:
                self.fault(b.message, b.line)
                m = _ENDS[quote].match(text, at)
                end = m.end() if m else (text.find("\n", at) if len(quote) == 1 and text.find("\n", at) >= 0 else len(text))
                self.line = begin + text.count("\n", start, end)
            self.line_at = begin
            return "str", "f", end
        m = _ENDS[quote].match(text, at)
        if not m:
            self.fault("unterminated string")
            end = text.find("\n", at) if len(quote) == 1 else len(text)
            end = len(text) if end < 0 else end
            self.line_at = self.line
            self.line += text.count("\n", start, end)
            return "str", "b" if "b" in prefix else "s", end
        body = text[at:m.end() - len(quote)]
        if "b" in prefix and not body.isascii():
            self.fault("bytes must be ASCII")
        if "\\" in body and "r" not in prefix:
            self.escapes(body, "b" in prefix)
        self.line_at = self.line
        self.line += body.count("\n")
        return "str", "b" if "b" in prefix else "s", m.end()

    def escapes(self, body: str, is_bytes: bool) -> None:
        for m in _ESCAPE.finditer(body):
            if m.group(1):
                if not is_bytes and not _named(m.group(2)):
                    self.fault("unknown Unicode name")
            elif m.group(4) and (m.group(4) == "x" or not is_bytes):
                self.fault("truncated escape")

    def f_string(self, at: int, quote: str, raw: bool, spec: bool) -> int:
        """End of an f-string's body (or of a format specification, at its closing brace)."""
        text, n, i = self.text, len(self.text), at
        literal = i
        while i < n:
            c = text[i]
            if not spec and text.startswith(quote, i):
                if not raw:
                    self.escapes(text[literal:i], False)
                return i + len(quote)
            if spec and c == "}":
                return i
            if c == "\\" and not (raw and text[i + 1:i + 2] in "{}"):
                if not raw and text.startswith("\\N{", i):
                    j = text.find("}", i)
                    if j < 0:
                        raise _Bad(self.line, "unterminated escape")
                    i = j + 1
                    continue
                if text[i + 1:i + 2] == "\n":
                    self.line += 1
                i += 1 if text[i + 1:i + 2] in ("{", "}") else 2
                continue
            if c == "\n":
                if len(quote) == 1:
                    raise _Bad(self.line, "unterminated string")
                self.line += 1
            elif spec and text.startswith(quote, i):
                raise _Bad(self.line, "expected '}' in an f-string")
            elif c == "{":
                if text[i + 1:i + 2] == "{" and not spec:
                    i += 2
                    continue
                if not raw:
                    self.escapes(text[literal:i], False)
                i = self.field(i + 1, quote, raw)
                literal = i
                continue
            elif c == "}":
                if text[i + 1:i + 2] != "}":
                    raise _Bad(self.line, "single '}' in an f-string")
                i += 1
            i += 1
        raise _Bad(self.line, "unterminated string")

    def field(self, i: int, quote: str, raw: bool) -> int:
        text, n = self.text, len(self.text)
        depth, tokens, begin = 0, [], self.line
        while True:
            while i < n and text[i] in " \t\f\n":
                self.line += text[i] == "\n"
                i += 1
            if i >= n:
                raise _Bad(begin, "expected '}' in an f-string")
            c = text[i]
            if c == "#":
                j = text.find("\n", i)
                if j < 0 or len(quote) == 1:
                    raise _Bad(begin, "expected '}' in an f-string")
                i = j
                continue
            if depth == 0 and c in "}:!" and not text.startswith("!=", i):
                break
            if depth == 0 and c == "=" and text[i + 1:i + 2] != "=" and re.compile(r"=\s*[!:}]").match(text, i):
                i += 1
                continue
            kind, word, end = self.token(i)
            if kind == "op":
                if word in ("(", "[", "{"):
                    depth += 1
                elif word in (")", "]", "}"):
                    if depth == 0:
                        raise _Bad(self.line, f"unmatched {word!r} in an f-string")
                    depth -= 1
            tokens.append((kind, word, self.line_at))
            i = end
        if not tokens:
            raise _Bad(begin, "empty field in an f-string")
        self.fields.append((tokens + [("nl", "", self.line), ("end", "", self.line)], begin))
        if text[i] == "!":
            m = re.compile(r"![rsa]\s*(?=[:}])").match(text, i)
            if not m:
                raise _Bad(begin, "invalid conversion in an f-string")
            i = m.end()
        if text[i] == ":":
            i = self.f_string(i + 1, quote, raw, True)
        return i + 1


class Python:
    """Judges one text; faults has every error by line."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.faults: list[SyntaxFault] = []
        self.n_faults = 0

    def program(self) -> None:
        lexer = Lexer(self.text)
        if "\0" in self.text:
            lexer.fault("null byte")
        tokens = lexer.run()
        faults = lexer.faults
        body = _Grammar(tokens)
        body.file()
        faults += body.faults
        for part, _ in lexer.fields:
            g = _Grammar(part)
            g.field()
            faults += g.faults
        self.faults = sorted(faults, key=lambda f: f.line)
        self.n_faults = len(self.faults)


class _Grammar:
    def __init__(self, tokens: list[tuple[str, str, int]]):
        self.tokens, self.i = tokens, 0
        self.faults: list[SyntaxFault] = []
        self.kind, self.word, self.line = tokens[0]

    # ---- tokens

    def go(self, i: int) -> None:
        self.i = i
        self.kind, self.word, self.line = self.tokens[i]

    def next(self) -> str:
        w = self.word
        if self.kind != "end":
            self.go(self.i + 1)
        return w

    def at(self, op: str) -> bool:
        return self.kind == "op" and self.word == op

    def at_word(self, w: str) -> bool:
        return self.kind == "name" and self.word == w

    def take(self, op: str) -> bool:
        if self.kind == "op" and self.word == op:
            self.next()
            return True
        return False

    def take_word(self, w: str) -> bool:
        if self.kind == "name" and self.word == w:
            self.next()
            return True
        return False

    def fail(self, message: str | None = None):
        what = {"nl": "end of line", "in": "indent", "de": "unindent", "end": "end of file"}.get(self.kind, repr(self.word[:20]))
        raise _Bad(self.line, message or f"unexpected {what}")

    def need(self, op: str) -> None:
        if not self.take(op):
            self.fail(f"expected {op!r}")

    def need_word(self, w: str) -> None:
        if not self.take_word(w):
            self.fail(f"expected {w!r}")

    def name(self) -> str:
        if self.kind != "name" or self.word in _KEYWORDS:
            self.fail("expected a name" if self.kind != "name" else None)
        return self.next()

    def ahead(self, k: int = 1) -> tuple[str, str]:
        t = self.tokens[min(self.i + k, len(self.tokens) - 1)]
        return t[0], t[1]

    # ---- statements

    def file(self) -> None:
        while self.kind != "end":
            self.guarded()

    def field(self) -> None:
        try:
            if self.at_word("yield"):
                self.yield_()
            else:
                self.star_list()
            if self.kind != "nl":
                self.fail()
        except _Bad as b:
            self.faults.append(SyntaxFault(b.line, "in an f-string: " + b.message))

    def guarded(self) -> None:
        begin = self.i
        try:
            self.statement()
        except _Bad as b:
            self.faults.append(SyntaxFault(b.line, b.message))
            if self.kind in ("in", "de") and self.i == begin:
                self.next()
                return
            depth = 0
            while self.kind != "end":  # to the end of the line, and past a block that follows it
                k = self.kind
                if k == "de" and depth == 0:
                    if self.i == begin:
                        self.next()
                    return
                self.next()
                depth += (k == "in") - (k == "de")
                if (k == "nl" or k == "de") and depth == 0 and self.kind != "in":
                    return

    def statement(self) -> None:
        if self.kind == "nl":
            self.next()
            return
        if self.kind == "name":
            f = _COMPOUND.get(self.word)
            if f:
                return f(self)
            if self.word == "match" and self.match():
                return None
        elif self.kind == "op" and self.word == "@":
            return self.decorated()
        elif self.kind in ("in", "de"):
            self.fail("unexpected indent" if self.kind == "in" else None)
        return self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if self.take(";"):
                if self.kind != "nl":
                    continue
            break
        if self.kind != "nl":
            self.fail()
        self.next()

    def simple(self) -> None:
        if self.kind == "name":
            f = _SIMPLE.get(self.word)
            if f:
                return f(self)
            if self.word == "type" and self.ahead()[0] == "name" and self.ahead()[1] not in _KEYWORDS and self.ahead(2) in (("op", "="), ("op", "[")):
                self.next()
                self.name()
                self.type_parameters()
                self.need("=")
                self.expression()
                return None
        return self.assignment()

    def block(self) -> None:
        self.need(":")
        if self.kind != "nl":
            if self.kind == "name" and self.word in _COMPOUND or self.at("@"):
                self.fail()
            return self.simple_line()
        self.next()
        if self.kind != "in":
            self.fail("expected an indented block")
        self.next()
        while self.kind not in ("de", "end"):
            self.guarded()
        if self.kind == "de":
            self.next()
        return None

    def assignment(self) -> None:
        first = self.star_list() if not self.at_word("yield") else self.yield_()
        if self.kind != "op":
            return
        if self.word == ":":
            self.next()
            inner = first[1] if isinstance(first, tuple) and first[0] == "paren" else first
            if inner not in ("name", "attr", "sub"):
                self.fail("only single targets can be annotated")
            self.expression()
            if self.take("="):
                self.yield_() if self.at_word("yield") else self.star_list()
            return
        if self.word in _AUGMENTED:
            inner = first[1] if isinstance(first, tuple) and first[0] == "paren" else first
            if inner not in ("name", "attr", "sub"):
                self.fail("invalid target of augmented assignment")
            self.next()
            self.yield_() if self.at_word("yield") else self.star_list()
            return
        while self.word == "=" and self.kind == "op":
            self.target(first)
            self.next()
            first = self.yield_() if self.at_word("yield") else self.star_list()

    def target(self, node, starred: bool = False) -> None:
        if node in ("name", "attr", "sub"):
            return
        if isinstance(node, tuple):
            if node[0] == "paren":
                return self.target(node[1])
            if node[0] == "star":
                return self.target(node[1])
            if node[0] in ("tuple", "list"):
                for x in node[1]:
                    self.target(x)
                return None
        return self.fail("cannot assign to this expression")

    def s_return(self) -> None:
        self.next()
        if self.kind != "nl" and not self.at(";"):
            self.star_list()

    def s_raise(self) -> None:
        self.next()
        if self.kind != "nl" and not self.at(";"):
            self.expression()
            if self.take_word("from"):
                self.expression()

    def s_word(self) -> None:
        self.next()

    def s_del(self) -> None:
        self.next()
        if self.kind == "nl":
            self.fail()
        node = self.star_list()
        self.deleted(node)

    def deleted(self, node) -> None:
        if node in ("name", "attr", "sub"):
            return
        if isinstance(node, tuple) and node[0] == "paren":
            return self.deleted(node[1])
        if isinstance(node, tuple) and node[0] in ("tuple", "list"):
            for x in node[1]:
                self.deleted(x)
            return None
        return self.fail("cannot delete this expression")

    def s_assert(self) -> None:
        self.next()
        self.expression()
        if self.take(","):
            self.expression()

    def s_names(self) -> None:
        self.next()
        self.name()
        while self.take(","):
            self.name()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def s_import(self) -> None:
        self.next()
        while True:
            self.dotted()
            if self.take_word("as"):
                self.name()
            if not self.take(","):
                break

    def s_from(self) -> None:
        self.next()
        dots = False
        while self.at(".") or self.at("..."):
            self.next()
            dots = True
        if not (dots and self.at_word("import")):
            self.dotted()
        self.need_word("import")
        if self.take("*"):
            return
        paren = self.take("(")
        while True:
            self.name()
            if self.take_word("as"):
                self.name()
            if not self.take(","):
                break
            if paren and self.at(")"):
                break
        if paren:
            self.need(")")

    def s_yield(self) -> None:
        self.assignment()

    def decorated(self) -> None:
        while self.take("@"):
            self.named()
            if self.kind != "nl":
                self.fail()
            self.next()
        if self.at_word("def") or self.at_word("class") or self.at_word("async") and self.ahead()[1] == "def":
            self.statement()
        else:
            self.fail("expected a function or class after decorators")

    def c_async(self) -> None:
        self.next()
        if self.kind == "name" and self.word in ("def", "with", "for"):
            _COMPOUND[self.word](self)
        else:
            self.fail()

    def type_parameters(self) -> None:
        if not self.take("["):
            return
        while True:
            if not (self.take("*") or self.take("**")):
                pass
            self.name()
            if self.take(":"):
                self.expression()
            if self.take("="):
                self.star_item()
            if not self.take(",") or self.at("]"):
                break
        self.need("]")

    def c_def(self) -> None:
        self.next()
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.star_list()
        self.block()

    def parameters(self, close: str, typed: bool) -> None:
        defaults = star = named_needed = False
        seen = slash = False
        while not self.at(close):
            if self.take("/"):
                if slash or star or not seen:
                    self.fail("misplaced /")
                slash = True
            elif self.take("**"):
                self.name()
                if typed and self.take(":"):
                    self.expression()
                self.take(",")
                if named_needed:
                    self.fail("named parameters must follow bare *")
                if not self.at(close):
                    self.fail("parameters after **")
                return
            elif self.take("*"):
                if star:
                    self.fail("* may appear only once")
                star = True
                if self.kind == "name":
                    self.name()
                    if typed and self.take(":"):
                        self.star_item()
                else:
                    named_needed = True
            else:
                self.name()
                seen, named_needed = True, False
                if typed and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    defaults = True
                elif defaults and not star:
                    self.fail("parameter without a default after one with a default")
            if not self.at(close):
                if not self.at(","):
                    self.fail()
                self.next()
        if named_needed:
            self.fail("named parameters must follow bare *")

    def c_class(self) -> None:
        self.next()
        self.name()
        self.type_parameters()
        if self.take("("):
            self.arguments(")")
        self.block()

    def c_if(self) -> None:
        self.next()
        self.named()
        self.block()
        while self.take_word("elif"):
            self.named()
            self.block()
        if self.take_word("else"):
            self.block()

    def c_while(self) -> None:
        self.next()
        self.named()
        self.block()
        if self.take_word("else"):
            self.block()

    def c_for(self) -> None:
        self.next()
        self.target(self.target_list())
        self.need_word("in")
        self.star_list()
        self.block()
        if self.take_word("else"):
            self.block()

    def target_list(self):
        items = [self.star_target()]
        comma = False
        while self.take(","):
            comma = True
            if self.at_word("in"):
                break
            items.append(self.star_target())
        return ("tuple", items) if comma else items[0]

    def star_target(self):
        if self.take("*"):
            return ("star", self.binary(0))
        return self.binary(0)

    def c_with(self) -> None:
        self.next()
        if self.at("("):
            m = self.i
            try:
                self.next()
                while True:
                    self.expression()
                    if self.take_word("as"):
                        self.target(self.star_target())
                    if not self.take(",") or self.at(")"):
                        break
                self.need(")")
                if not self.at(":"):
                    self.fail()
                return self.block()
            except _Bad:
                if self.i > m and self.tokens[self.i - 1][1] == ":":
                    raise
                bad_at = self.i
                self.go(m)
                if any(t[0] == "nl" for t in self.tokens[m:bad_at]):
                    raise
        while True:
            self.expression()
            if self.take_word("as"):
                self.target(self.star_target())
            if not self.take(","):
                break
        return self.block()

    def c_try(self) -> None:
        self.next()
        self.block()
        handlers = final = bare = star = 0
        while self.take_word("except"):
            if bare:
                self.fail("default except must be last")
            starred = self.take("*")
            if handlers and bool(star) != starred:
                self.fail("except and except* cannot be mixed")
            star, handlers = int(starred), handlers + 1
            if self.at(":"):
                bare = 1
                if starred:
                    self.fail("expected an exception type")
            else:
                self.expression()
                if self.take_word("as"):
                    self.name()
            self.block()
        if handlers and self.take_word("else"):
            self.block()
        if self.take_word("finally"):
            final = 1
            self.block()
        if not (handlers or final):
            self.fail("expected except or finally")

    # ---- match

    def match(self) -> bool:
        m = self.i
        k, w = self.ahead()
        if k == "op" and w in ("=", ".", ",", ")", ":", "]", "}") or k == "nl" or k == "op" and (w in _AUGMENTED or w in _COMPARE or w == ":="):
            return False
        try:
            self.next()
            self.subject()
            if not (self.at(":") and self.ahead()[0] == "nl" and self.ahead(2)[0] == "in" and self.ahead(3) == ("name", "case")):
                raise _Bad(self.line, "")
        except _Bad:
            self.go(m)
            return False
        self.next()
        self.next()
        self.next()
        while self.kind not in ("de", "end"):
            if not self.take_word("case"):
                self.fail("expected case")
            self.open_pattern()
            if self.take_word("if"):
                self.named()
            self.block()
        if self.kind == "de":
            self.next()
        return True

    def subject(self) -> None:
        self.star_named()
        while self.take(","):
            if self.at(":"):
                break
            self.star_named()

    def star_named(self) -> None:
        if self.take("*"):
            self.binary(0)
        else:
            self.named()

    def open_pattern(self) -> None:
        self.maybe_star()
        while self.take(","):
            if self.at(":") or self.at_word("if"):
                break
            self.maybe_star()

    def maybe_star(self) -> None:
        if self.take("*"):
            self.name()
        else:
            self.as_pattern()

    def as_pattern(self) -> None:
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take_word("as"):
            if self.name() == "_":
                self.fail("cannot use '_' as a target")

    def closed_pattern(self) -> None:
        if self.kind == "num" or self.at("-"):
            self.take("-")
            if self.kind != "num":
                self.fail()
            self.next()
            if self.at("+") or self.at("-"):
                self.next()
                if self.kind != "num" or self.word[-1] not in "jJ":
                    self.fail()
                self.next()
        elif self.kind == "str":
            self.strings()
        elif self.kind == "name":
            if self.word in ("None", "True", "False"):
                self.next()
                return
            self.name()
            while self.take("."):
                self.name()
            if self.take("("):
                keywords = False
                while not self.take(")"):
                    if self.kind == "name" and self.ahead() == ("op", "="):
                        self.name()
                        self.next()
                        keywords = True
                    elif keywords:
                        self.fail("positional pattern after keyword pattern")
                    self.as_pattern()
                    if not self.at(")"):
                        self.need(",")
        elif self.at("(") or self.at("["):
            close = ")" if self.next() == "(" else "]"
            while not self.take(close):
                self.maybe_star()
                if not self.at(close):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("**"):
                    self.name()
                else:
                    if self.kind == "name" and self.word not in _KEYWORDS and self.ahead() != ("op", "."):
                        self.fail("mapping keys must be literals or attributes")
                    self.closed_pattern()
                    self.need(":")
                    self.as_pattern()
                if not self.at("}"):
                    self.need(",")
        else:
            self.fail("expected a pattern")

    # ---- expressions (the result says what may be assigned)

    def starts(self) -> bool:
        if self.kind in ("num", "str"):
            return True
        if self.kind == "name":
            return self.word not in _KEYWORDS or self.word in ("None", "True", "False", "not", "lambda", "await", "yield")
        return self.kind == "op" and self.word in ("(", "[", "{", "-", "+", "~", "...", "*")

    def star_list(self):
        items = [self.star_item()]
        comma = False
        while self.take(","):
            comma = True
            if not self.starts() or self.at_word("yield"):
                break
            items.append(self.star_item())
        return ("tuple", items) if comma else items[0]

    def star_item(self):
        if self.take("*"):
            return ("star", self.binary(0))
        return self.expression()

    def yield_(self):
        self.need_word("yield")
        if self.take_word("from"):
            self.expression()
        elif self.starts():
            self.star_list()
        return "other"

    def named(self):
        if self.kind == "name" and self.ahead() == ("op", ":="):
            self.name()
            self.next()
            self.expression()
            return "other"
        node = self.expression()
        if self.at(":="):
            self.fail("invalid target of :=")
        return node

    def expression(self):
        if self.at_word("lambda"):
            self.next()
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "other"
        node = self.disjunction()
        if self.at_word("if"):
            self.next()
            self.disjunction()
            self.need_word("else")
            self.expression()
            return "other"
        return node

    def disjunction(self):
        node = self.inversion()
        while self.kind == "name" and self.word in ("or", "and"):
            self.next()
            self.inversion()
            node = "other"
        return node

    def inversion(self):
        if self.at_word("not"):
            while self.take_word("not"):
                pass
            self.comparison()
            return "other"
        return self.comparison()

    def comparison(self):
        node = self.binary(0)
        while True:
            if self.kind == "op" and self.word in _COMPARE or self.at_word("in"):
                self.next()
            elif self.at_word("is"):
                self.next()
                self.take_word("not")
            elif self.at_word("not") and self.ahead() == ("name", "in"):
                self.next()
                self.next()
            else:
                return node
            self.binary(0)
            node = "other"

    def binary(self, least: int):
        node = self.unary()
        while self.kind == "op":
            power = _BINARY.get(self.word)
            if power is None or power <= least:
                break
            self.next()
            self.binary(power)
            node = "other"
        return node

    def unary(self):
        if self.kind == "op" and self.word in ("-", "+", "~"):
            while self.kind == "op" and self.word in ("-", "+", "~"):
                self.next()
            self.unary()
            return "other"
        node = self.awaited()
        if self.take("**"):
            self.unary()
            return "other"
        return node

    def awaited(self):
        if self.take_word("await"):
            self.primary()
            return "other"
        return self.primary()

    def primary(self):
        node = self.atom()
        while self.kind == "op":
            if self.word == ".":
                self.next()
                self.name()
                node = "attr"
            elif self.word == "(":
                self.next()
                self.arguments(")")
                node = "other"
            elif self.word == "[":
                self.next()
                self.slices()
                node = "sub"
            else:
                break
        return node

    def slices(self) -> None:
        if self.at("]"):
            self.fail()
        while not self.take("]"):
            if self.take("*"):
                self.binary(0)
            else:
                if not self.at(":"):
                    self.named()
                if self.take(":"):
                    if not (self.at(":") or self.at(",") or self.at("]")):
                        self.expression()
                    if self.take(":") and not (self.at(",") or self.at("]")):
                        self.expression()
            if not self.at("]"):
                self.need(",")

    def arguments(self, close: str) -> None:
        keywords = unpacked = False
        n = 0
        while not self.take(close):
            if self.take("**"):
                self.expression()
                keywords = unpacked = True
            elif self.take("*"):
                if unpacked:
                    self.fail("iterable unpacking after keyword unpacking")
                self.expression()
            elif self.kind == "name" and self.ahead() == ("op", "="):
                self.name()
                self.next()
                self.expression()
                keywords = True
            else:
                if keywords:
                    self.named()
                    self.fail("positional argument after keyword argument")
                self.named()
                if self.at_word("for") or self.at_word("async"):
                    self.comprehension()
                    if n or not self.at(close):
                        if not (n == 0 and self.at(",") and self.ahead() == ("op", close)) or True:
                            self.fail("a generator among arguments needs parentheses")
                elif self.at("="):
                    self.fail("expected a name before '='")
            n += 1
            if not self.at(close):
                self.need(",")

    def comprehension(self) -> None:
        while self.at_word("for") or self.at_word("async") and self.ahead() == ("name", "for"):
            self.take_word("async")
            self.next()
            self.target(self.target_list())
            self.need_word("in")
            self.disjunction()
            while self.take_word("if"):
                self.condition()
        if self.at_word("async"):
            self.fail()

    def condition(self) -> None:
        if self.kind == "name" and self.ahead() == ("op", ":="):
            self.fail()
        self.disjunction()

    def strings(self) -> None:
        kinds = set()
        while self.kind == "str":
            kinds.add(self.word == "b")
            self.next()
        if len(kinds) > 1:
            self.fail("cannot mix bytes and text")

    def atom(self):
        k, w = self.kind, self.word
        if k == "name":
            if w in ("None", "True", "False"):
                self.next()
                return "const"
            if w in _KEYWORDS:
                self.fail()
            self.next()
            return "name"
        if k == "num":
            self.next()
            return "const"
        if k == "str":
            self.strings()
            return "const"
        if k == "op":
            if w == "...":
                self.next()
                return "const"
            if w == "(":
                return self.parenthesised()
            if w == "[":
                self.next()
                items = self.items("]")
                return ("list", items) if items is not None else "other"
            if w == "{":
                return self.braces()
        return self.fail()

    def items(self, close: str):
        """Items up to the closing bracket; None for a comprehension."""
        items = []
        while not self.take(close):
            if self.take("*"):
                items.append(("star", self.binary(0)))
            else:
                items.append(self.named())
            if (self.at_word("for") or self.at_word("async")) and len(items) == 1:
                if isinstance(items[0], tuple) and items[0][0] == "star":
                    self.fail("unpacking in a comprehension")
                self.comprehension()
                self.need(close)
                return None
            if not self.at(close):
                if not self.at(","):
                    self.fail()
                self.next()
        return items

    def parenthesised(self):
        self.next()
        if self.at_word("yield"):
            self.yield_()
            self.need(")")
            return "other"
        begin = self.i
        items = self.items(")")
        if items is None:
            return "other"
        comma = self.tokens[self.i - 2][1] == "," and self.tokens[self.i - 2][0] == "op"
        if len(items) == 1 and not comma and self.i > begin:
            if isinstance(items[0], tuple) and items[0][0] == "star":
                self.fail("cannot use a starred expression here")
            return ("paren", items[0])
        return ("tuple", items)

    def braces(self):
        self.next()
        first = True
        kind = None
        while not self.take("}"):
            if self.take("**"):
                if kind == "set":
                    self.fail()
                kind = "dict"
                self.binary(0)
            elif self.take("*"):
                if kind == "dict":
                    self.fail()
                kind = "set"
                self.binary(0)
            else:
                self.named() if kind != "dict" else self.expression()
                if self.at(":") and kind != "set":
                    self.next()
                    kind = "dict"
                    self.expression()
                elif kind == "dict":
                    self.fail("expected ':'")
                else:
                    kind = "set"
                if first and (self.at_word("for") or self.at_word("async")):
                    self.comprehension()
                    self.need("}")
                    return "other"
            first = False
            if not self.at("}"):
                self.need(",")
        return "other"


_COMPOUND = {
    "def": _Grammar.c_def, "class": _Grammar.c_class, "if": _Grammar.c_if, "while": _Grammar.c_while, "for": _Grammar.c_for, "with": _Grammar.c_with, "try": _Grammar.c_try,
    "async": _Grammar.c_async}
_SIMPLE = {
    "return": _Grammar.s_return, "raise": _Grammar.s_raise, "pass": _Grammar.s_word, "break": _Grammar.s_word, "continue": _Grammar.s_word, "del": _Grammar.s_del,
    "assert": _Grammar.s_assert, "global": _Grammar.s_names, "nonlocal": _Grammar.s_names, "import": _Grammar.s_import, "from": _Grammar.s_from, "yield": _Grammar.s_yield}
