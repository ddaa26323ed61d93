"""Rust, edition 2021."""

from __future__ import annotations

import re

from graphlens.llm.parsing.base import Fault, Parser, Token

_GAP = re.compile(r"(?:\s|//[^\n]*)*")
_ID = re.compile(r"r#[^\W\d]\w*|[^\W\d]\w*")
_LIFETIME = re.compile(r"'(?:r#)?[^\W\d]\w*(?!')")
_CHAR = re.compile(r"b?'(?:[^'\\\n\r\t]|\\(?:[nrt0'\"\\]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'")
_STRING = re.compile(r'[bc]?"(?:[^"\\]|\\.)*"', re.S)
_BAD_ESCAPE = re.compile(r'(?<!\\)(?:\\\\)*\\(?![\\nrt0\'"\n]|\r\n|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\})')
_RAW = re.compile(r'[bc]?r(#*)".*?"\1', re.S)
_RAW_START = re.compile(r'[bc]?r#*"')
_NUMBER = re.compile(
    r"(?:0x_*[0-9a-fA-F][0-9a-fA-F_]*|0o_*[0-7][0-7_]*|0b_*[01][01_]*|\d[\d_]*(?:\.\d[\d_]*|\.(?![._]|[^\W\d]))?(?:[eE][+-]?_*\d[\d_]*)?)([^\W\d]\w*)?")
_PUNCT = re.compile(r"<<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[-+*/%^!&|=<>@.,;:#$?~(){}\[\]]")
# Words that are no identifiers, suffixes of numbers, operators by strength.
_KEYWORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use "
    "where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split())
_SUFFIXES = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split())
_PATH_WORDS = frozenset("self Self super crate".split())
_BINARY = {
    "||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
_ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_ITEM_WORDS = frozenset("use mod fn struct enum trait impl static type pub extern macro_rules".split())


class Rust(Parser):
    def __init__(self, text: str):
        self.no_struct = False
        super().__init__(text)

    def lex(self, at: int) -> Token:
        text = self.text
        if at == 0:
            if text.startswith("﻿"):
                at = 1
            if text.startswith("#!", at) and not re.match(r"#!\s*\[", text[at:]):
                at = len(text) if text.find("\n", at) < 0 else text.find("\n", at)
        i = at
        while True:
            i = _GAP.match(text, i).end()
            if not text.startswith("/*", i):
                break
            depth, j = 1, i + 2
            while depth:
                a, b = text.find("/*", j), text.find("*/", j)
                if b < 0:
                    return Token("bad", "unterminated comment", i, len(text), False)
                if 0 <= a < b:
                    depth, j = depth + 1, a + 2
                else:
                    depth, j = depth - 1, b + 2
            i = j
        nl = "\n" in text[at:i]
        if i >= len(text):
            return Token("eof", "", i, i, nl)
        c = text[i]
        if c in 'bcr"':
            if _RAW_START.match(text, i):
                m = _RAW.match(text, i)
                return Token("str", m.group(), i, m.end(), nl) if m else Token("bad", "unterminated raw string", i, len(text), nl)
            m = _STRING.match(text, i)
            if m:
                if _BAD_ESCAPE.search(m.group()):
                    return Token("bad", "unknown escape", i, m.end(), nl)
                return Token("str", m.group(), i, m.end(), nl)
            if c == '"' or text[i + 1:i + 2] == '"':
                return Token("bad", "unterminated string", i, len(text), nl)
        if c == "'" or c == "b" and text[i + 1:i + 2] == "'":
            m = _CHAR.match(text, i)
            if m:
                return Token("char", m.group(), i, m.end(), nl)
            m = _LIFETIME.match(text, i)
            if m:
                return Token("life", m.group(), i, m.end(), nl)
            return Token("bad", "unterminated character", i, i + 1, nl)
        if c.isalpha() or c == "_" or c > "\x7f":
            m = _ID.match(text, i)
            if m:
                if text[m.end():m.end() + 1] == '"':
                    return Token("bad", "unknown prefix", i, m.end(), nl)
                return Token("p" if m.group() == "_" else "id", m.group(), i, m.end(), nl)
            return Token("bad", c, i, i + 1, nl)
        if c.isdigit():
            m = _NUMBER.match(text, i)
            if not m or m.group(1) and m.group(1) not in _SUFFIXES:
                return Token("bad", "invalid number", i, m.end() if m else i + 1, nl)
            return Token("num", m.group(), i, m.end(), nl)
        m = _PUNCT.match(text, i)
        if m:
            return Token("p", m.group(), i, m.end(), nl)
        return Token("bad", c, i, i + 1, nl)

    def take_first(self, first: str) -> bool:
        """Take one character, also from a longer operator."""
        t = self.tok
        if t.kind != "p" or not t.text.startswith(first):
            return False
        if len(t.text) == len(first):
            self.next()
        else:
            at = t.start + len(first)
            m = _PUNCT.match(self.text, at)
            self.last_end = at
            self.tok = Token("p", m.group() if m.end() <= t.end else t.text[len(first):], at, min(m.end(), t.end), False)
        return True

    def need_first(self, first: str) -> None:
        if not self.take_first(first):
            self.fail(f"expected {first!r}")

    def name(self) -> str:
        t = self.tok
        if t.kind != "id" or t.text in _KEYWORDS:
            self.fail(f"expected a name, found {t.text[:20]!r}")
        self.next()
        return t.text

    # ---- items

    def program(self) -> None:
        self.inner_attributes()
        while self.tok.kind != "eof":
            self.guarded(self.item)

    def guarded(self, parse) -> None:
        begin, no_struct = self.tok.start, self.no_struct
        try:
            parse()
        except Fault as f:
            if self.guess:
                raise
            self.record(f)
            self.no_struct = no_struct
            depth, moved = 0, self.tok.start > begin
            while self.tok.kind != "eof":
                t = self.tok
                if t.kind == "p":
                    if t.text in _CLOSE:
                        depth += 1
                    elif t.text in ")]}":
                        if depth == 0 and t.text == "}" and moved:
                            return
                        depth = max(0, depth - 1)
                    elif t.text == ";" and depth == 0:
                        self.next()
                        return
                elif depth == 0 and moved and t.newline and t.kind == "id" and (t.text in _ITEM_WORDS or t.text in ("let", "for", "while", "if", "match")):
                    return
                self.next()
                moved = True

    def inner_attributes(self) -> None:
        while self.at_p("#") and self.peek().text == "!":
            self.next()
            self.next()
            self.tree()

    def attributes(self) -> None:
        while self.at_p("#"):
            self.next()
            self.take_p("!")
            if not self.at_p("["):
                self.fail("expected '[' after '#'")
            self.tree()

    def tree(self) -> None:
        """A delimited token tree."""
        stack = []
        while True:
            t = self.tok
            if t.kind == "eof" or t.kind == "bad":
                self.fail("unclosed delimiter" if t.kind == "eof" else t.text)
            if t.kind == "p":
                if t.text in _CLOSE:
                    stack.append(_CLOSE[t.text])
                elif t.text in (")", "]", "}"):
                    if not stack or stack.pop() != t.text:
                        self.fail("mismatched delimiter")
            self.next()
            if not stack:
                return

    def visibility(self) -> None:
        if self.take_word("pub") and self.at_p("(") and self.peek().text in ("crate", "self", "super", "in"):
            if self.peek().text == "in" or self.token_at(self.peek().end).text == ")":
                self.tree()

    def item(self) -> None:
        self.attributes()
        self.visibility()
        if not self.item_rest():
            self.fail()

    def item_rest(self, associated: bool = False) -> bool:
        t = self.tok
        if t.kind != "id":
            if t.kind == "p" and t.text == "::":
                return self.macro_item()
            return False
        w, p = t.text, self.peek()
        if w == "use":
            self.next()
            self.use_tree()
            self.need_p(";")
        elif w == "mod" or w == "unsafe" and p.text == "mod":
            self.take_word("unsafe")
            self.next()
            self.name()
            if not self.take_p(";"):
                self.need_p("{")
                self.inner_attributes()
                self.items_until_close()
        elif w in ("fn", "async", "extern", "unsafe", "const") and self.function_ahead():
            while not self.at_word("fn"):
                self.next()
            self.function(associated)
        elif w == "struct" or w == "union" and p.kind == "id" and p.text not in _KEYWORDS:
            self.struct()
        elif w == "enum":
            self.enum()
        elif w == "trait" or w in ("unsafe", "auto") and p.text in ("trait", "auto"):
            while not self.take_word("trait"):
                self.next()
            self.trait()
        elif w == "impl" or w == "unsafe" and p.text == "impl":
            self.take_word("unsafe")
            self.impl()
        elif w == "type":
            self.next()
            self.name()
            self.generics()
            if self.take_p(":"):
                self.bounds()
            self.where()
            if self.take_p("="):
                self.type()
            self.where()
            self.need_p(";")
        elif w == "const" and (p.kind == "id" and p.text != "unsafe" and p.text != "async" or p.text == "_") or w == "static":
            self.next()
            if w == "static":
                self.take_word("mut")
            if not self.take_p("_"):
                self.name()
            self.need_p(":")
            self.type()
            if self.take_p("="):
                self.expression()
            self.need_p(";")
        elif w == "extern" or w == "unsafe" and p.text == "extern":
            self.take_word("unsafe")
            self.next()
            if self.take_word("crate"):
                if not self.take_word("self"):
                    self.name()
                if self.take_word("as") and not self.take_p("_"):
                    self.name()
                self.need_p(";")
            else:
                if self.tok.kind == "str":
                    self.next()
                self.need_p("{")
                self.items_until_close()
        elif w == "macro_rules" and p.text == "!":
            self.next()
            self.next()
            self.name()
            brace = self.at_p("{")
            self.tree()
            if not brace:
                self.need_p(";")
        else:
            return self.macro_item()
        return True

    def function_ahead(self) -> bool:
        t = self.tok
        for _ in range(6):
            if t.kind == "id" and t.text == "fn":
                return True
            if not (t.kind == "id" and t.text in ("const", "async", "unsafe", "extern") or t.kind == "str"):
                return False
            t = self.token_at(t.end)
        return False

    def macro_item(self) -> bool:
        m = self.mark()
        self.take_p("::")
        while self.tok.kind == "id" and (self.tok.text not in _KEYWORDS or self.tok.text in _PATH_WORDS):
            self.next()
            if not self.take_p("::"):
                break
        if not self.at_p("!") or self.tok.start == m[0].start:
            self.reset(m)
            return False
        self.next()
        if self.tok.kind == "id":
            self.name()
        if not (self.tok.kind == "p" and self.tok.text in _CLOSE):
            self.fail()
        brace = self.at_p("{")
        self.tree()
        if not brace:
            self.need_p(";")
        return True

    def items_until_close(self, associated: bool = False) -> None:
        while not self.take_p("}"):
            if self.tok.kind == "eof":
                self.fail("expected '}' before end of file")
            self.guarded(self.associated if associated else self.item)

    def associated(self) -> None:
        self.attributes()
        self.visibility()
        if self.at_word("default") and self.peek().kind == "id":
            self.next()
        if not self.item_rest(True):
            self.fail()

    def use_tree(self) -> None:
        self.take_p("::")
        if self.take_p("*"):
            return
        if self.take_p("{"):
            while not self.take_p("}"):
                self.use_tree()
                if not self.at_p("}"):
                    self.need_p(",")
            return
        if self.tok.kind == "id" and self.tok.text in _PATH_WORDS:
            self.next()
        else:
            self.name()
        if self.take_p("::"):
            self.use_tree()
        elif self.take_word("as") and not self.take_p("_"):
            self.name()

    def function(self, associated: bool) -> None:
        self.need_word("fn")
        self.name()
        self.generics()
        self.need_p("(")
        first = True
        while not self.take_p(")"):
            self.attributes()
            if self.take_p("..."):
                pass
            elif not (first and self.receiver()):
                self.pattern_one()
                self.need_p(":")
                if not self.take_p("..."):
                    self.type()
            first = False
            if not self.at_p(")"):
                self.need_p(",")
        if self.take_p("->"):
            self.type()
        self.where()
        if not self.take_p(";"):
            self.block(True)

    def receiver(self) -> bool:
        m = self.mark()
        if self.take_first("&") and self.tok.kind == "life":
            self.next()
        self.take_word("mut")
        if self.take_word("self") and not self.at_p("::"):
            if self.take_p(":"):
                self.type()
            return True
        self.reset(m)
        return False

    def struct(self) -> None:
        self.next()
        self.name()
        self.generics()
        self.where()
        if self.at_p("("):
            self.tuple_fields()
            self.where()
            self.need_p(";")
        elif self.at_p("{"):
            self.record_fields()
        else:
            self.need_p(";")

    def tuple_fields(self) -> None:
        self.need_p("(")
        while not self.take_p(")"):
            self.attributes()
            self.visibility()
            self.type()
            if not self.at_p(")"):
                self.need_p(",")

    def record_fields(self) -> None:
        self.need_p("{")
        while not self.take_p("}"):
            self.attributes()
            self.visibility()
            self.name()
            self.need_p(":")
            self.type()
            if not self.at_p("}"):
                self.need_p(",")

    def enum(self) -> None:
        self.next()
        self.name()
        self.generics()
        self.where()
        self.need_p("{")
        while not self.take_p("}"):
            self.attributes()
            self.visibility()
            self.name()
            if self.at_p("("):
                self.tuple_fields()
            elif self.at_p("{"):
                self.record_fields()
            if self.take_p("="):
                self.expression()
            if not self.at_p("}"):
                self.need_p(",")

    def trait(self) -> None:
        self.name()
        self.generics()
        if self.take_p(":") and not (self.at_p("{") or self.at_word("where")):
            self.bounds()
        if self.take_p("="):
            self.bounds()
            self.where()
            return self.need_p(";")
        self.where()
        self.need_p("{")
        self.inner_attributes()
        return self.items_until_close(True)

    def impl(self) -> None:
        self.next()
        if self.tok.kind == "p" and self.tok.text == "<" and (self.peek().kind in ("life", "id") and self.peek().text not in _PATH_WORDS or self.peek().text in (">", "#")):
            if not self.attempt(self.generics):
                self.fail()
        self.take_word("const")
        self.take_p("!")
        self.type()
        if self.take_word("for"):
            self.type()
        self.where()
        self.need_p("{")
        self.inner_attributes()
        self.items_until_close(True)

    # ---- generics and types

    def generics(self) -> None:
        if not (self.tok.kind == "p" and self.tok.text.startswith("<") and self.tok.text in ("<", "<<", "<=")):
            return
        self.need_first("<")
        while not self.take_first(">"):
            self.attributes()
            if self.tok.kind == "life":
                self.next()
                if self.take_p(":"):
                    while self.tok.kind == "life":
                        self.next()
                        if not self.take_p("+"):
                            break
            elif self.take_word("const"):
                self.name()
                self.need_p(":")
                self.type()
                if self.take_p("="):
                    self.const_argument()
            else:
                self.name()
                if self.take_p(":") and not (self.tok.kind == "p" and self.tok.text[0] in ",>="):
                    self.bounds()
                if self.take_p("="):
                    self.type()
            if not (self.tok.kind == "p" and self.tok.text.startswith(">")):
                self.need_p(",")

    def const_argument(self) -> None:
        if self.at_p("{"):
            self.block()
        else:
            self.take_p("-")
            if self.tok.kind in ("num", "str", "char") or self.tok.kind == "id":
                self.next()
            else:
                self.fail()

    def where(self) -> None:
        if not self.take_word("where"):
            return
        while not (self.tok.kind == "p" and self.tok.text in ("{", ";", "=") or self.tok.kind == "eof"):
            if self.tok.kind == "life":
                self.next()
            else:
                self.for_lifetimes()
                self.type()
            self.need_p(":")
            if not (self.tok.kind == "p" and self.tok.text in (",", "{", ";", "=")):
                self.bounds()
            if not self.take_p(","):
                break

    def for_lifetimes(self) -> None:
        if self.take_word("for"):
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.tok.kind == "life":
                self.next()
            else:
                paren = self.take_p("(")
                self.take_p("?") or self.take_p("~") and self.need_word("const")
                self.take_word("async")
                self.for_lifetimes()
                if self.at_word("use") and self.peek().text == "<":
                    self.next()
                    self.generic_arguments()
                else:
                    self.type_path()
                if paren:
                    self.need_p(")")
            if not self.take_first("+"):
                break
            if self.tok.kind == "p" and self.tok.text[0] in ">,={;)]":
                break

    def type(self, plus: bool = True) -> None:
        t = self.tok
        if t.kind == "p":
            if t.text == "(":
                self.next()
                while not self.take_p(")"):
                    self.type()
                    if not self.at_p(")"):
                        self.need_p(",")
                if plus and self.at_p("+"):
                    self.next()
                    self.bounds()
            elif t.text in ("!", "_"):
                self.next()
            elif t.text == "*":
                self.next()
                if not (self.take_word("const") or self.take_word("mut")):
                    self.fail("expected const or mut")
                self.type(False)
            elif t.text in ("&", "&&"):
                self.next()
                if self.tok.kind == "life":
                    self.next()
                self.take_word("mut")
                self.type(False)
            elif t.text == "[":
                self.next()
                self.type()
                if self.take_p(";"):
                    self.expression()
                self.need_p("]")
            elif t.text in ("<", "<<", "::"):
                self.type_path()
            else:
                self.fail("expected a type")
        elif t.kind == "life":
            self.bounds()
        elif t.kind == "id":
            if t.text == "for":
                self.for_lifetimes()
                return self.type(plus)
            if t.text in ("impl", "dyn") and not (t.text == "dyn" and self.peek().text in ("::", ",", ">", ")", ";")):
                self.next()
                if plus:
                    self.bounds()
                else:
                    self.take_p("?")
                    self.for_lifetimes()
                    if self.tok.kind == "life":
                        self.next()
                    elif self.at_p("("):
                        self.next()
                        self.bounds()
                        self.need_p(")")
                    else:
                        self.type_path()
            elif t.text in ("fn", "unsafe", "extern"):
                while not self.take_word("fn"):
                    if not (self.take_word("unsafe") or self.take_word("extern") or self.tok.kind == "str"):
                        self.fail()
                    if self.tok.kind == "str":
                        self.next()
                self.need_p("(")
                while not self.take_p(")"):
                    self.attributes()
                    if not self.take_p("..."):
                        if (self.tok.kind == "id" and self.tok.text not in _KEYWORDS or self.tok.text == "_") and self.peek().text == ":":
                            self.next()
                            self.next()
                        self.type()
                    if not self.at_p(")"):
                        self.need_p(",")
                if self.take_p("->"):
                    self.type(False)
            else:
                self.type_path()
                if self.at_p("!"):
                    self.next()
                    self.tree()
                elif plus and self.at_p("+") and False:
                    self.bounds()
        else:
            self.fail("expected a type")
        return None

    def type_path(self) -> None:
        if self.tok.kind == "p" and self.tok.text in ("<", "<<"):
            self.qualified()
        else:
            self.take_p("::")
            self.segment(True)
        while self.at_p("::"):
            self.next()
            if self.tok.kind == "p" and self.tok.text in ("<", "<<"):
                self.generic_arguments()
            else:
                self.segment(True)

    def qualified(self) -> None:
        self.need_first("<")
        self.type()
        if self.take_word("as"):
            self.type_path()
        self.need_first(">")
        self.need_p("::")
        self.segment(True)

    def segment(self, in_type: bool) -> None:
        t = self.tok
        if t.kind != "id" or t.text in _KEYWORDS and t.text not in _PATH_WORDS:
            self.fail(f"unexpected {t.text[:20]!r}" if t.kind != "eof" else "unexpected end of file")
        self.next()
        if in_type:
            if self.tok.kind == "p" and self.tok.text in ("<", "<<", "<="):
                self.generic_arguments()
            elif self.at_p("("):
                self.next()
                while not self.take_p(")"):
                    self.type()
                    if not self.at_p(")"):
                        self.need_p(",")
                if self.take_p("->"):
                    self.type(False)

    def generic_arguments(self) -> None:
        self.need_first("<")
        while not self.take_first(">"):
            t = self.tok
            if t.kind == "life":
                self.next()
            elif t.kind in ("num", "str", "char") or t.kind == "p" and t.text in ("-", "{") or t.kind == "id" and t.text in ("true", "false"):
                self.const_argument()
            elif t.kind == "id" and self.peek().text in ("=", ":", "=="):
                self.next()
                self.named_argument()
            else:
                named = t.kind == "id" and self.peek().text == "<"
                self.type()
                if named and self.tok.kind == "p" and self.tok.text in ("=", ":"):
                    self.named_argument()
            if not (self.tok.kind == "p" and self.tok.text.startswith(">")):
                self.need_p(",")

    def named_argument(self) -> None:
        """What follows a name, which may have arguments of its own: = Type or : bounds."""
        if self.take_p(":"):
            self.bounds()
        else:
            self.need_p("=")
            self.type()

    # ---- patterns

    def pattern(self) -> None:
        self.take_first("|")
        self.pattern_one()
        while self.at_p("|"):
            self.next()
            self.pattern_one()

    def range_end(self) -> bool:
        t = self.tok
        if t.kind in ("num", "char", "str") or t.kind == "p" and t.text == "-" or t.kind == "id" and t.text not in _KEYWORDS or t.kind == "id" and t.text in _PATH_WORDS:
            self.take_p("-")
            if self.tok.kind == "id":
                self.expr_path()
            elif self.tok.kind in ("num", "char", "str"):
                self.next()
            else:
                self.fail("expected a pattern")
            return True
        return False

    def pattern_one(self) -> None:
        t = self.tok
        if t.kind in ("num", "str", "char") or t.kind == "p" and t.text == "-" or t.kind == "id" and t.text in ("true", "false"):
            self.take_p("-")
            if self.tok.kind not in ("num", "str", "char", "id"):
                self.fail("expected a pattern")
            self.next()
            if self.tok.kind == "p" and self.tok.text in ("..=", "...", ".."):
                closed = self.next().text != ".."
                if not self.range_end() and closed:
                    self.fail("expected the end of a range")
            return
        if t.kind == "p":
            if t.text == "_":
                self.next()
            elif t.text in ("..", "..="):
                self.next()
                self.range_end()
            elif t.text in ("&", "&&"):
                self.next()
                self.take_word("mut")
                self.pattern_one()
            elif t.text in ("(", "["):
                self.next()
                close = _CLOSE[t.text]
                while not self.take_p(close):
                    self.attributes()
                    self.pattern()
                    if not self.at_p(close):
                        self.need_p(",")
            elif t.text in ("<", "<<", "::"):
                self.expr_path()
                self.pattern_tail()
            else:
                self.fail("expected a pattern")
            return
        if t.kind != "id":
            self.fail("expected a pattern")
        if t.text in ("ref", "mut"):
            self.take_word("ref")
            self.take_word("mut")
            self.name()
            if self.take_p("@"):
                self.pattern_one()
            return
        if t.text == "box":
            self.next()
            self.pattern_one()
            return
        if t.text == "const" and self.peek().text == "{":
            self.next()
            self.block()
            return
        p = self.peek()
        if t.text not in _KEYWORDS and not (p.kind == "p" and p.text in ("::", "(", "{", "!", "..=", "...", "..")):
            self.next()
            if self.take_p("@"):
                self.pattern_one()
            return
        self.expr_path()
        self.pattern_tail()

    def pattern_tail(self) -> None:
        if self.take_p("("):
            while not self.take_p(")"):
                self.attributes()
                self.pattern()
                if not self.at_p(")"):
                    self.need_p(",")
        elif self.take_p("{"):
            while not self.take_p("}"):
                self.attributes()
                if self.take_p(".."):
                    if not self.at_p("}"):
                        self.fail()
                    continue
                if self.tok.kind == "num":
                    self.next()
                    self.need_p(":")
                    self.pattern()
                else:
                    plain = not (self.take_word("ref") | self.take_word("mut"))
                    self.take_word("mut")
                    self.name()
                    if plain and self.take_p(":"):
                        self.pattern()
                    elif self.take_p("@"):
                        self.pattern_one()
                if not self.at_p("}"):
                    self.need_p(",")
        elif self.take_p("!"):
            self.tree()
        elif self.tok.kind == "p" and self.tok.text in ("..=", "...", ".."):
            self.next()
            self.range_end()

    # ---- statements

    def block(self, body: bool = False) -> None:
        self.need_p("{")
        was, self.no_struct = self.no_struct, False
        self.inner_attributes()
        while not self.at_p("}"):
            if self.tok.kind == "eof":
                self.fail("expected '}' before end of file")
            self.guarded(self.statement)
        self.no_struct = was
        self.next()

    def statement(self) -> None:
        if self.take_p(";"):
            return
        self.attributes()
        t, p = self.tok, self.peek()
        if t.kind == "id":
            if t.text == "let":
                return self.let()
            block_like = t.text in ("unsafe", "async", "const") and (p.text in ("{", "move", "|", "||") or t.text == "async" and p.text == "move")
            if t.text in ("use", "mod", "fn", "struct", "enum", "trait", "impl", "type", "static", "pub", "extern", "macro_rules") or (
                    t.text in ("unsafe", "async", "const", "union", "auto") and not block_like and p.kind == "id" or t.text == "const" and p.text == "_"):
                m = self.mark()
                self.visibility()
                if self.item_rest():
                    return None
                self.reset(m)
        begin = self.tok
        block = self.expression_statement()
        if self.take_p(";"):
            return None
        if self.at_p("}") or block:
            return None
        return self.fail(f"expected ';' before {self.tok.text[:20]!r}" if self.tok.kind != "eof" else "unexpected end of file") or begin

    def let(self) -> None:
        self.next()
        self.pattern()
        if self.take_p(":"):
            self.type()
        if self.take_p("="):
            self.expression()
            if self.take_word("else"):
                self.block()
        self.need_p(";")

    def expression_statement(self) -> bool:
        """True if no semicolon has to follow."""
        t = self.tok
        if t.kind == "p" and t.text == "{" or t.kind == "id" and t.text in ("if", "match", "while", "for", "loop", "unsafe") or t.kind == "life" and self.peek().text == ":" or (
                t.kind == "id" and t.text in ("async", "const") and self.peek().text == "{"):
            self.block_expression()
            if self.tok.kind == "p" and self.tok.text in (".", "?") :
                self.postfix()
                self.binary_from(0)
                self.assign_tail()
                return False
            return True
        m = self.mark()
        if t.kind == "id" and (t.text not in _KEYWORDS or t.text in _PATH_WORDS) or t.kind == "p" and t.text == "::":
            # a macro with braces stands alone
            self.take_p("::")
            while self.tok.kind == "id" and (self.tok.text not in _KEYWORDS or self.tok.text in _PATH_WORDS):
                self.next()
                if not self.take_p("::"):
                    break
            if self.at_p("!") and self.peek().text == "{":
                self.next()
                self.tree()
                if not (self.tok.kind == "p" and self.tok.text in (".", "?")):
                    return True
            self.reset(m)
        self.expression()
        return False

    # ---- expressions

    def expression(self) -> None:
        self.range_expression()
        self.assign_tail()

    def assign_tail(self) -> None:
        if self.tok.kind == "p" and self.tok.text in _ASSIGN:
            self.next()
            self.expression()

    def starts_operand(self) -> bool:
        t = self.tok
        if t.kind == "p":
            return t.text in ("(", "[", "-", "!", "*", "&", "&&", "|", "||", "<", "::", "_") or t.text == "{" and not self.no_struct
        return t.kind in ("num", "str", "char", "life") or t.kind == "id" and t.text not in ("else", "as", "in", "where")

    def range_expression(self) -> None:
        if self.tok.kind == "p" and self.tok.text in ("..", "..="):
            self.next()
            if self.starts_operand():
                self.binary(2)
            return
        self.binary(2)
        if self.tok.kind == "p" and self.tok.text in ("..", "..="):
            closed = self.next().text == "..="
            if self.starts_operand():
                self.binary(2)
            elif closed:
                self.fail("expected the end of a range")

    def binary(self, least: int) -> None:
        self.unary()
        self.binary_from(least)

    def binary_from(self, least: int) -> None:
        while True:
            t = self.tok
            if t.kind == "id" and t.text == "as":
                self.next()
                self.type(False)
                continue
            power = _BINARY.get(t.text) if t.kind == "p" else None
            if power is None or power <= least:
                return
            self.next()
            self.binary(power)
            if power == 5 and self.tok.kind == "p" and _BINARY.get(self.tok.text) == 5:
                self.fail("comparisons cannot be chained")

    def unary(self) -> None:
        t = self.tok
        if t.kind == "p":
            if t.text in ("-", "!", "*"):
                self.next()
                return self.unary()
            if t.text in ("&", "&&"):
                self.next()
                if self.at_word("raw") and self.peek().text in ("const", "mut"):
                    self.next()
                    self.next()
                else:
                    self.take_word("mut")
                return self.unary()
            if t.text in ("|", "||"):
                return self.closure()
        elif t.kind == "id":
            if t.text == "let":
                self.next()
                self.pattern()
                self.need_p("=")
                was, self.no_struct = self.no_struct, True
                self.binary(4)
                self.no_struct = was
                return None
            if t.text in ("move", "static") or t.text == "async" and self.peek().text in ("|", "||", "move") and not (self.peek().text == "move" and self.token_at(self.peek().end).text == "{"):
                return self.closure()
            if t.text in ("return", "break"):
                self.next()
                if t.text == "break" and self.tok.kind == "life":
                    self.next()
                if self.starts_operand() or self.tok.kind == "p" and self.tok.text in ("..", "..="):
                    self.expression()
                return None
            if t.text == "continue":
                self.next()
                if self.tok.kind == "life":
                    self.next()
                return None
        self.primary()
        return self.postfix()

    def closure(self) -> None:
        while self.take_word("static") or self.take_word("async") or self.take_word("move"):
            pass
        if not self.take_p("||"):
            self.need_p("|")
            while not self.take_p("|"):
                self.attributes()
                self.pattern_one()
                if self.take_p(":"):
                    self.type()
                if not self.at_p("|"):
                    self.need_p(",")
        if self.take_p("->"):
            self.type(False)
            self.block()
        else:
            self.expression()

    def postfix(self) -> None:
        while self.tok.kind == "p":
            t = self.tok.text
            if t == "?":
                self.next()
            elif t == "(":
                self.list_(")")
            elif t == "[":
                self.next()
                was, self.no_struct = self.no_struct, False
                self.expression()
                self.no_struct = was
                self.need_p("]")
            elif t == ".":
                self.next()
                if self.tok.kind == "num":
                    if not re.fullmatch(r"\d+(?:\.\d*)?", self.tok.text):
                        self.fail()
                    self.next()
                elif self.take_word("await"):
                    pass
                else:
                    self.name()
                    if self.at_p("::"):
                        self.next()
                        self.generic_arguments()
                        if not self.at_p("("):
                            self.fail()
            else:
                return

    def list_(self, close: str) -> None:
        self.next()
        was, self.no_struct = self.no_struct, False
        while not self.take_p(close):
            self.attributes()
            self.expression()
            if not self.at_p(close):
                self.need_p(",")
        self.no_struct = was

    def expr_path(self) -> None:
        if self.tok.kind == "p" and self.tok.text in ("<", "<<"):
            self.qualified()
        else:
            self.take_p("::")
            self.segment(False)
        while self.at_p("::"):
            self.next()
            if self.tok.kind == "p" and self.tok.text in ("<", "<<"):
                self.generic_arguments()
            else:
                self.segment(False)

    def primary(self) -> None:
        t = self.tok
        if t.kind in ("num", "str", "char"):
            self.next()
            return None
        if t.kind == "life":
            return self.block_expression()
        if t.kind == "p":
            if t.text == "(":
                return self.list_(")")
            if t.text == "[":
                self.next()
                was, self.no_struct = self.no_struct, False
                if not self.take_p("]"):
                    self.expression()
                    if self.take_p(";"):
                        self.expression()
                        self.need_p("]")
                    else:
                        while not self.take_p("]"):
                            self.need_p(",")
                            if not self.at_p("]"):
                                self.expression()
                self.no_struct = was
                return None
            if t.text == "{":
                return self.block()
            if t.text == "_":
                self.next()
                return None
            if t.text not in ("<", "<<", "::"):
                self.fail()
        elif t.kind == "id":
            if t.text in ("if", "match", "while", "for", "loop", "unsafe", "async", "const"):
                return self.block_expression()
            if t.text in ("true", "false"):
                self.next()
                return None
        else:
            self.fail(t.text if t.kind == "bad" else None)
        self.expr_path()
        if self.at_p("!") and self.peek().text in _CLOSE:
            self.next()
            return self.tree()
        if self.at_p("{") and not self.no_struct:
            return self.record_literal()
        return None

    def record_literal(self) -> None:
        self.need_p("{")
        was, self.no_struct = self.no_struct, False
        while not self.take_p("}"):
            self.attributes()
            if self.take_p(".."):
                if not self.at_p("}"):
                    self.expression()
                self.need_p("}")
                break
            if self.tok.kind == "num":
                self.next()
                self.need_p(":")
                self.expression()
            else:
                self.name()
                if self.take_p(":"):
                    self.expression()
            if not self.at_p("}"):
                self.need_p(",")
        self.no_struct = was

    def head(self) -> None:
        was, self.no_struct = self.no_struct, True
        self.expression()
        self.no_struct = was

    def block_expression(self) -> None:
        if self.tok.kind == "life":
            self.next()
            self.need_p(":")
        t = self.tok
        if t.kind == "p" and t.text == "{":
            return self.block()
        word = t.text if t.kind == "id" else ""
        self.next()
        if word == "if":
            self.head()
            self.block()
            if self.take_word("else"):
                if self.at_word("if"):
                    self.block_expression()
                else:
                    self.block()
        elif word == "while":
            self.head()
            self.block()
        elif word in ("loop", "unsafe", "const"):
            self.block()
        elif word == "async":
            self.take_word("move")
            self.block()
        elif word == "for":
            self.pattern()
            self.need_word("in")
            self.head()
            self.block()
        elif word == "match":
            self.head()
            self.need_p("{")
            was, self.no_struct = self.no_struct, False
            self.inner_attributes()
            while not self.take_p("}"):
                self.attributes()
                self.pattern()
                if self.take_word("if"):
                    self.expression()
                self.need_p("=>")
                block = self.at_p("{") or self.tok.kind == "id" and self.tok.text in ("if", "match", "while", "for", "loop", "unsafe")
                braces = self.at_p("{")
                self.attributes()
                if block:
                    done = self.expression_statement()
                    if done and not braces and self.tok.kind == "p" and not (self.tok.text in (",", "}")) and (self.tok.text in _BINARY):
                        self.binary_from(0)
                    if not done and not self.at_p("}"):
                        self.need_p(",")
                    else:
                        self.take_p(",")
                else:
                    self.expression()
                    if not self.at_p("}"):
                        self.need_p(",")
            self.no_struct = was
        else:
            self.fail(None, t.start)
        return None
