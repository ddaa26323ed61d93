"""JavaScript (module or script) and TypeScript."""

from __future__ import annotations

import re

from graphlens.llm.parsing.base import Fault, Parser, Token

_SPACE = re.compile(r"(?:[\s﻿ᖋ]|//[^\n\r  ]*|/\*.*?\*/)*", re.S)
_WORD = re.compile(r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(
    r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|"
    r"(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?n?")
_STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*'", re.S)
_PUNCT = re.compile(
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([\w$]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
# Words that are no identifiers, binary operators by strength.
_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch "
    "this throw true try typeof var void while with".split())
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODIFIERS = frozenset("public private protected readonly abstract static override declare accessor".split())
_STARTS_AFTER_GENERICS = frozenset("( ) ] } : ; , . ?. == === != !== && || ?? ^ & | `".split())


class Ecma(Parser):
    def __init__(self, text: str, typed: bool = False, module: bool = True):
        self.typed, self.module = typed, module
        self.in_function = self.in_async = self.in_generator = False
        self.loops = self.switches = 0
        self.labels: list[str] = []
        self.no_in = False
        self.ambient = False
        self.no_conditional = 0
        self.no_arrow: set[int] = set()
        super().__init__(text)

    # ---- tokens

    def lex(self, at: int) -> Token:
        text = self.text
        if at == 0 and text.startswith("#!"):
            at = len(text) if text.find("\n") < 0 else text.find("\n")
        m = _SPACE.match(text, at)
        i = m.end()
        gap = text[at:i]
        nl = "\n" in gap or "\r" in gap or " " in gap or " " in gap
        if i >= len(text):
            return Token("eof", "", i, i, nl)
        c = text[i]
        if c.isalpha() or c in "_$\\" or c > "\x7f":
            m = _WORD.match(text, i)
            if m:
                return Token("id", m.group(), i, m.end(), nl)
            return Token("bad", c, i, i + 1, nl)
        if c.isdigit() or c == "." and text[i + 1:i + 2].isdigit():
            m = _NUMBER.match(text, i)
            end = m.end()
            if _WORD.match(text, end) or text[end:end + 1].isdigit() or text[end - 1:end] == "_" or (re.match(r"0\d", m.group()) and self.module):
                return Token("bad", text[i:end + 1], i, end + 1, nl)
            return Token("num", m.group(), i, end, nl)
        if c in "\"'":
            m = _STRING.match(text, i)
            if m:
                return Token("str", m.group(), i, m.end(), nl)
            end = re.compile(r"[\n\r]|$").search(text, i).start()
            return Token("bad", "unterminated string", i, max(end, i + 1), nl)
        if c == "`":
            return Token("tpl", "`", i, i + 1, nl)
        if c == "#":
            m = _WORD.match(text, i + 1)
            return Token("priv", m.group(), i, m.end(), nl) if m else Token("bad", "#", i, i + 1, nl)
        if c == "/" and text.startswith("/*", i):
            return Token("bad", "unterminated comment", i, len(text), nl)
        m = _PUNCT.match(text, i)
        if m:
            return Token("p", m.group(), i, m.end(), nl)
        return Token("bad", c, i, i + 1, nl)

    def split_p(self, first: str) -> None:
        """Take the first character of a longer operator (as in >> closing two lists)."""
        t = self.tok
        if t.kind == "p" and t.text.startswith(first):
            if t.text == first:
                self.next()
            else:
                self.last_end = t.start + 1
                rest = t.text[1:]
                m = _PUNCT.match(self.text, t.start + 1)
                self.tok = Token("p", m.group() if m else rest, t.start + 1, m.end() if m else t.end, False)
        else:
            self.fail(f"expected {first!r}")

    def template(self) -> None:
        at = self.tok.end
        while True:
            m = _TEMPLATE.match(self.text, at)
            if not m:
                self.fail("unterminated template literal")
            if m.group(1) == "`":
                self.last_end = m.end()
                self.tok = self.token_at(m.end())
                return
            self.last_end = m.end()
            self.tok = self.token_at(m.end())
            self.expression()
            if not self.at_p("}"):
                self.fail("expected '}' in template literal")
            at = self.tok.end

    def regex(self) -> None:
        m = _REGEX.match(self.text, self.tok.start)
        if not m or re.search(r"[^dgimsuvy]|(.).*\1", m.group(1)):
            self.fail("invalid regular expression")
        self.last_end = m.end()
        self.tok = self.token_at(m.end())

    # ---- helpers

    def semicolon(self) -> None:
        t = self.tok
        if t.kind == "p" and t.text == ";":
            self.next()
        elif not (t.newline or t.kind == "eof" or t.kind == "p" and t.text == "}"):
            self.fail()

    def binding_name(self) -> str:
        t = self.tok
        if t.kind != "id" or t.text in _RESERVED or (t.text == "await" and (self.in_async or self.module and not self.typed)) or (
                t.text == "yield" and (self.in_generator or self.module)):
            self.fail()
        self.next()
        return t.text

    def name(self) -> str:
        if self.tok.kind != "id":
            self.fail("expected a name")
        return self.next().text

    def binding(self) -> bool:
        """A binding target; True for a pattern."""
        if self.take_p("["):
            while not self.take_p("]"):
                if self.take_p(","):
                    continue
                if self.take_p("..."):
                    self.binding()
                else:
                    self.binding()
                    if self.take_p("="):
                        self.assignment()
                if not self.at_p("]"):
                    self.need_p(",")
            return True
        if self.take_p("{"):
            while not self.take_p("}"):
                if self.take_p("..."):
                    self.binding()
                else:
                    short = self.tok.kind == "id" and self.tok.text not in _RESERVED
                    self.property_name()
                    if self.take_p(":"):
                        self.binding()
                    elif not short:
                        self.fail()
                    if self.take_p("="):
                        self.assignment()
                if not self.at_p("}"):
                    self.need_p(",")
            return True
        self.binding_name()
        return False

    def property_name(self) -> None:
        t = self.tok
        if t.kind in ("id", "num", "str", "priv"):
            self.next()
        elif self.take_p("["):
            with_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = with_in
            self.need_p("]")
        else:
            self.fail()

    # ---- statements

    def program(self) -> None:
        while self.tok.kind != "eof":
            self.guarded(self.statement, True)

    def guarded(self, parse, *args) -> None:
        """One statement; on an error skip to where the next may start."""
        begin = self.tok.start
        state = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, list(self.labels), self.no_in, self.ambient, self.no_conditional)
        try:
            if args:
                parse(*args)
            else:
                parse()  # a plain call takes no C stack, however deep
        except Fault as f:
            if self.guess:
                raise
            self.record(f)
            (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in, self.ambient, self.no_conditional) = state
            self.recover(begin)

    def recover(self, begin: int) -> None:
        depth = 0
        moved = self.tok.start > begin
        while self.tok.kind != "eof":
            t = self.tok
            if t.kind == "tpl":
                m = _TEMPLATE.match(self.text, t.end)
                self.tok = self.token_at(m.end() if m else len(self.text))
                moved = True
                continue
            if t.kind == "p":
                if t.text in "([{":
                    depth += 1
                elif t.text in ")]}":
                    if depth == 0 and t.text == "}" and moved:
                        return
                    depth = max(0, depth - 1)
                elif t.text == ";" and depth == 0:
                    self.next()
                    return
            elif depth == 0 and moved and t.newline and t.kind == "id" and t.text in ("function", "class", "const", "let", "var", "if", "for", "while", "return", "import", "export", "try", "switch"):
                return
            self.next()
            moved = True

    def block(self) -> None:
        self.need_p("{")
        while not self.at_p("}"):
            if self.tok.kind == "eof":
                self.fail("expected '}' before end of file")
            self.guarded(self.statement)
        self.next()

    def paren(self) -> None:
        self.need_p("(")
        self.expression()
        self.need_p(")")

    def body(self) -> None:
        """The statement of an if or loop: no declaration."""
        if self.tok.kind == "id" and (self.tok.text in ("const", "class", "import", "export") or self.tok.text == "let" and self.peek().kind == "id" and not self.peek().newline):
            self.fail("a declaration cannot be a body")
        self.statement()

    def loop_body(self) -> None:
        self.loops += 1
        self.body()
        self.loops -= 1

    def statement(self, top: bool = False) -> None:
        t = self.tok
        if t.kind == "p":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.next()
                return None
            if t.text == "@":
                return self.decorated(top)
        if t.kind == "id":
            known = _STATEMENTS.get(t.text)
            if known and known(self, top) is not NotImplemented:
                return None
            if self.typed and t.text in _TYPED_STATEMENTS and self.typed_statement(top):
                return None
            if self.peek().kind == "p" and self.peek().text == ":" and t.text not in _RESERVED:
                label = self.binding_name()
                self.next()
                self.labels.append(label)
                self.statement()
                self.labels.pop()
                return None
        self.expression()
        self.semicolon()
        return None

    def decorated(self, top: bool) -> None:
        self.decorators()
        if self.at_word("export"):
            self.export(top)
        elif self.typed and self.at_word("abstract"):
            self.next()
            self.class_(True)
        else:
            self.class_(True)

    def decorators(self) -> None:
        while self.take_p("@"):
            if self.at_p("("):
                self.paren()
            else:
                self.name()
                while self.take_p("."):
                    self.name()
                if self.typed and self.at_p("<"):
                    self.type_arguments()
                if self.at_p("("):
                    self.arguments()

    def variables(self, kind: str, in_for: bool = False) -> bool:
        """Declarations; True if one of them lacks a value it needs."""
        lacking = False
        while True:
            pattern = self.binding()
            if self.typed:
                self.take_p("!")
                if self.take_p(":"):
                    self.type()
            if self.take_p("="):
                self.assignment()
            elif (pattern or kind == "const") and not self.ambient:
                lacking = True
            if not self.take_p(","):
                break
        if lacking and not in_for:
            self.fail("missing initializer")
        return lacking

    def s_var(self, top: bool):
        kind = self.tok.text
        if kind == "const" and self.typed and self.peek().text == "enum":
            self.next()
            return self.enum()
        if kind == "let":
            p = self.peek()
            if not (p.kind == "id" and p.text not in ("in", "instanceof", "of") or p.kind == "id" and p.text == "of" or p.kind == "p" and p.text in "[{"):
                return NotImplemented
        self.next()
        self.variables(kind)
        self.semicolon()

    def s_function(self, top: bool):
        self.function(True)

    def s_async(self, top: bool):
        p = self.peek()
        if p.kind == "id" and p.text == "function" and not p.newline:
            self.function(True)
        else:
            return NotImplemented

    def s_class(self, top: bool):
        self.class_(True)

    def s_if(self, top: bool):
        self.next()
        self.paren()
        self.body()
        if self.take_word("else"):
            self.body()

    def s_for(self, top: bool):
        self.next()
        if self.at_word("await"):
            if not (self.in_async or not self.in_function and self.module):
                self.fail()
            self.next()
        self.need_p("(")
        lacking = False
        if not self.at_p(";"):
            self.no_in = True
            t = self.tok
            if t.kind == "id" and (t.text in ("var", "const") or t.text == "let" and self.peek().kind != "p" or t.text == "let" and self.peek().text in "[{"):
                self.next()
                lacking = self.variables(t.text, True)
            else:
                self.expression()
            self.no_in = False
            if self.take_word("of"):
                self.assignment()
                self.need_p(")")
                return self.loop_body()
            if self.take_word("in"):
                self.expression()
                self.need_p(")")
                return self.loop_body()
            if lacking:
                self.fail("missing initializer")
        self.need_p(";")
        if not self.at_p(";"):
            self.expression()
        self.need_p(";")
        if not self.at_p(")"):
            self.expression()
        self.need_p(")")
        return self.loop_body()

    def s_while(self, top: bool):
        self.next()
        self.paren()
        self.loop_body()

    def s_do(self, top: bool):
        self.next()
        self.loop_body()
        self.need_word("while")
        self.paren()
        self.take_p(";")

    def s_return(self, top: bool):
        if not self.in_function and (self.module or self.typed):
            self.fail("return outside a function")
        self.next()
        t = self.tok
        if not (t.newline or t.kind == "eof" or t.kind == "p" and t.text in (";", "}")):
            self.expression()
        self.semicolon()

    def s_jump(self, top: bool):
        word = self.next().text
        if self.tok.kind == "id" and not self.tok.newline and self.tok.text not in _RESERVED:
            if self.name() not in self.labels:
                self.fail("unknown label")
        elif not self.loops and not (word == "break" and self.switches):
            self.fail(f"{word} outside a loop")
        self.semicolon()

    def s_throw(self, top: bool):
        self.next()
        if self.tok.newline:
            self.fail("line break after throw")
        self.expression()
        self.semicolon()

    def s_try(self, top: bool):
        self.next()
        self.block()
        done = False
        if self.take_word("catch"):
            done = True
            if self.take_p("("):
                self.binding()
                if self.typed and self.take_p(":"):
                    self.type()
                self.need_p(")")
            self.block()
        if self.take_word("finally"):
            done = True
            self.block()
        if not done:
            self.fail("expected catch or finally")

    def s_switch(self, top: bool):
        self.next()
        self.paren()
        self.need_p("{")
        self.switches += 1
        defaults = 0
        while not self.take_p("}"):
            if self.take_word("default"):
                defaults += 1
                if defaults > 1:
                    self.fail("more than one default")
            else:
                self.need_word("case")
                self.expression()
            self.need_p(":")
            while not (self.at_p("}") or self.at_word("case") or self.at_word("default")):
                if self.tok.kind == "eof":
                    self.fail()
                self.guarded(self.statement)
        self.switches -= 1

    def s_with(self, top: bool):
        if self.module:
            self.fail("with in strict code")
        self.next()
        self.paren()
        self.body()

    def s_debugger(self, top: bool):
        self.next()
        self.semicolon()

    def s_import(self, top: bool):
        p = self.peek()
        if p.kind == "p" and p.text in ("(", "."):
            return NotImplemented
        if not top or not (self.module or self.typed):
            self.fail("import outside a module")
        self.next()
        if self.tok.kind == "str":
            self.next()
        else:
            if self.typed and self.at_word("type") and (self.peek().kind == "p" and self.peek().text in "{*" or self.peek().kind == "id" and self.peek().text != "from"):
                self.next()
            if self.tok.kind == "id":
                self.binding_name()
                if self.typed and self.take_p("="):
                    if self.at_word("require") and self.peek().text == "(":
                        self.next()
                        self.paren()
                    else:
                        self.entity()
                    return self.semicolon()
                if not self.at_word("from"):
                    self.need_p(",")
                    if not (self.at_p("{") or self.at_p("*")):
                        self.fail()
            if self.take_p("*"):
                self.need_word("as")
                self.binding_name()
            elif self.at_p("{"):
                self.specifiers()
            self.need_word("from")
            if self.tok.kind != "str":
                self.fail("expected a module name")
            self.next()
        self.import_attributes()
        return self.semicolon()

    def import_attributes(self) -> None:
        if self.at_word("with") or self.at_word("assert") and not self.tok.newline:
            self.next()
            self.object_()

    def specifiers(self) -> None:
        self.need_p("{")
        while not self.take_p("}"):
            if self.typed and self.at_word("type") and self.peek().kind in ("id", "str") and self.peek().text != "as":
                self.next()
            if self.tok.kind == "str":
                self.next()
            else:
                self.name()
            if self.take_word("as"):
                if self.tok.kind == "str":
                    self.next()
                else:
                    self.name()
            if not self.at_p("}"):
                self.need_p(",")

    def export(self, top: bool):
        if not (top or self.ambient) or not (self.module or self.typed):
            self.fail("export outside a module")
        self.next()
        if self.take_word("default"):
            if self.at_word("function") or self.at_word("async") and self.peek().text == "function" and not self.peek().newline:
                self.function(False)
            elif self.at_word("class"):
                self.class_(False)
            elif self.at_p("@"):
                self.decorators()
                self.class_(False)
            elif self.typed and self.at_word("abstract") and self.peek().text == "class":
                self.next()
                self.class_(False)
            elif self.typed and self.at_word("interface") and self.peek().kind == "id":
                self.typed_statement(False)
            else:
                self.assignment()
                self.semicolon()
            return None
        if self.typed:
            if self.take_p("="):
                self.expression()
                return self.semicolon()
            if self.at_word("as"):
                self.next()
                self.need_word("namespace")
                self.name()
                return self.semicolon()
            if self.at_word("import"):
                return self.s_import(True)
            if self.at_word("type") and self.peek().kind == "p" and self.peek().text in "{*":
                self.next()
        if self.take_p("*"):
            if self.take_word("as"):
                if self.tok.kind == "str":
                    self.next()
                else:
                    self.name()
            self.need_word("from")
            if self.tok.kind != "str":
                self.fail()
            self.next()
            self.import_attributes()
            return self.semicolon()
        if self.at_p("{"):
            self.specifiers()
            if self.take_word("from"):
                if self.tok.kind != "str":
                    self.fail()
                self.next()
                self.import_attributes()
            return self.semicolon()
        t = self.tok
        if t.kind == "p" and t.text == "@":
            return self.decorated(False)
        if t.kind == "id" and (t.text in ("var", "let", "const", "function", "class") or t.text == "async" and self.peek().text == "function"):
            return self.statement(top)
        if self.typed and t.kind == "id" and t.text in _TYPED_STATEMENTS and self.typed_statement(top):
            return None
        return self.fail()

    # ---- functions and classes

    def function(self, named: bool) -> None:
        is_async = self.take_word("async")
        self.need_word("function")
        star = self.take_p("*")
        if self.tok.kind == "id":
            self.name() if self.tok.text not in _RESERVED else self.fail()
        elif named:
            self.fail("expected a name")
        self.callable(is_async, star, declared=named)

    def callable(self, is_async: bool, star: bool, declared: bool = False, expression: bool = False) -> None:
        """Type parameters, parameters, result type and body."""
        saved = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in, self.ambient)
        was_ambient = self.ambient
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in = True, is_async, star, 0, 0, [], False
        if self.typed and self.at_p("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.take_p(":"):
            self.result_type()
        if self.at_p("{"):
            self.ambient = False
            self.block()
        elif self.typed and (declared or was_ambient):
            self.restore(saved)
            self.semicolon()
            return
        else:
            self.fail("expected '{'")
        self.restore(saved)

    def restore(self, saved) -> None:
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in, self.ambient = saved

    def parameters(self) -> None:
        self.need_p("(")
        while not self.take_p(")"):
            if self.at_p("@"):
                self.decorators()
            if self.typed:
                while self.tok.kind == "id" and self.tok.text in _MODIFIERS and self.peek().kind == "id" or self.tok.kind == "id" and self.tok.text in _MODIFIERS and self.peek().text in ("{", "["):
                    self.next()
            rest = self.take_p("...")
            if self.typed and self.at_word("this"):
                self.next()
            else:
                self.binding()
            if self.typed:
                self.take_p("?")
                if self.take_p(":"):
                    self.type()
            if not rest and self.take_p("="):
                self.assignment()
            if rest and not self.at_p(")"):
                if not (self.ambient and self.take_p(",")):
                    self.fail("rest parameter must be last")
            if not self.at_p(")"):
                self.need_p(",")

    def class_(self, named: bool) -> None:
        self.need_word("class")
        if self.tok.kind == "id" and self.tok.text not in ("extends", "implements") or self.at_word("implements") and self.peek().text in ("{", "extends"):
            self.binding_name()
        elif named:
            self.fail("expected a class name")
        if self.typed and self.at_p("<"):
            self.type_parameters()
        if self.take_word("extends"):
            self.left_side()
            if self.typed and self.at_p("<"):
                self.type_arguments()
        if self.typed and self.take_word("implements"):
            self.type()
            while self.take_p(","):
                self.type()
        self.need_p("{")
        while not self.take_p("}"):
            if self.tok.kind == "eof":
                self.fail("expected '}' before end of file")
            if not self.take_p(";"):
                self.guarded(self.member)

    def member(self) -> None:
        if self.at_p("@"):
            self.decorators()
        is_async = star = accessor = abstract = False
        while self.tok.kind == "id":
            t, p = self.tok, self.peek()
            plain = p.kind == "p" and p.text in ("(", "=", ";", "}", ":", "?", "!", "<", ",") or p.kind == "eof"
            if plain:
                break
            if t.text == "static" and p.text == "{":
                self.next()
                saved = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in, self.ambient)
                self.block()
                self.restore(saved)
                return
            if t.text in ("get", "set") and (not p.newline or p.kind == "id") and not (p.kind == "p" and p.text == "*"):
                self.next()
                accessor = True
            elif t.text == "async" and not p.newline:
                self.next()
                is_async = True
            elif t.text in ("static", "accessor") or self.typed and t.text in _MODIFIERS and not p.newline:
                abstract |= t.text in ("abstract", "declare")
                self.next()
            else:
                break
        if self.take_p("*"):
            star = True
        if self.typed and self.at_p("[") and self.index_signature():
            self.semicolon()
            return
        self.property_name()
        if self.typed:
            self.take_p("?") or self.take_p("!")
        if self.at_p("(") or self.typed and self.at_p("<"):
            self.callable(is_async, star, declared=True)
            return
        if is_async or star or accessor:
            self.fail()
        if self.typed and self.take_p(":"):
            self.type()
        if self.take_p("="):
            saved = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in, self.ambient)
            self.in_async = self.in_generator = False
            self.assignment()
            self.restore(saved)
        self.semicolon()

    # ---- expressions

    def expression(self) -> None:
        self.assignment()
        while self.take_p(","):
            self.assignment()

    def assignment(self) -> None:
        t = self.tok
        if t.kind == "id":
            if t.text == "yield" and (self.in_generator or self.module):
                return self.yield_()
            p = self.peek()
            if t.text == "async" and not p.newline and (p.kind == "id" and p.text != "function" or p.kind == "p" and p.text in ("(", "<")) and self.arrow(True):
                return None
            if p.kind == "p" and p.text == "=>" and t.text not in _RESERVED:
                self.arrow(False) or self.fail()
                return None
        elif t.kind == "p" and (t.text == "(" or t.text == "<" and self.typed) and self.maybe_arrow() and self.arrow(False):
            return None
        begin = self.tok
        target = self.conditional()
        o = self.tok
        if o.kind == "p" and o.text in _ASSIGN:
            if not target or target == "pattern" and o.text != "=":
                self.fail("invalid assignment target", begin.start)
            self.next()
            self.assignment()
        return None

    def yield_(self) -> None:
        if not self.in_generator:
            self.fail("yield outside a generator")
        self.next()
        if self.tok.newline:
            return
        if self.take_p("*"):
            self.assignment()
        elif not (self.tok.kind == "eof" or self.tok.kind == "p" and self.tok.text in (")", "]", "}", ",", ";", ":")):
            self.assignment()

    def maybe_arrow(self) -> bool:
        """Cheap look past the closing parenthesis, where that is certain."""
        if self.typed:
            return True
        depth, t = 0, self.tok
        if self.peek().kind == "p" and self.peek().text == "(":
            return False  # no parameter starts with one
        for _ in range(4000):
            if t.kind == "p":
                if t.text in ("(", "[", "{"):
                    depth += 1
                elif t.text in (")", "]", "}"):
                    depth -= 1
                    if depth == 0:
                        n = self.token_at(t.end)
                        return n.kind == "p" and n.text == "=>"
                elif t.text in ("/", "/="):
                    return True
            elif t.kind in ("tpl", "eof", "bad"):
                return True
            t = self.token_at(t.end)
        return True

    def arrow(self, is_async: bool) -> bool:
        m = self.mark()
        if self.tok.start in self.no_arrow:  # tried before: keeps nested readings linear
            return False
        saved = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in, self.ambient)

        def head():
            if is_async:
                self.next()
            if self.tok.kind == "id":
                self.binding_name()
            else:
                if self.typed and self.at_p("<"):
                    self.type_parameters()
                self.parameters()
                if self.typed and self.take_p(":"):
                    self.no_conditional += 1
                    try:
                        self.result_type()
                    finally:
                        self.no_conditional -= 1
            if not self.at_p("=>") or self.tok.newline:
                self.fail()
            self.next()

        no_conditional, self.no_conditional = self.no_conditional, 0
        ok = self.attempt(head)
        self.no_conditional = no_conditional
        if not ok:
            self.reset(m)
            self.no_arrow.add(self.tok.start)
            return False
        self.in_function, self.in_async, self.in_generator = True, is_async, False
        if self.at_p("{"):
            self.loops, self.switches, self.labels, self.no_in = 0, 0, [], False
            self.block()
        else:
            self.assignment()
        self.restore(saved)
        return True

    def conditional(self):
        target = self.binary(0)
        if self.at_p("?"):
            self.next()
            with_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = with_in
            self.need_p(":")
            self.assignment()
            return False
        return target

    def binary(self, least: int):
        if self.tok.kind == "priv" and self.peek().text == "in":
            self.next()
            target = False
        else:
            unary_minus = self.tok.kind == "p" and self.tok.text in ("+", "-", "!", "~") or self.tok.kind == "id" and self.tok.text in ("typeof", "void", "delete")
            target = self.unary()
            if unary_minus and self.at_p("**"):
                self.fail("unary operand of ** needs parentheses")
        while True:
            t = self.tok
            if t.kind == "p" or t.kind == "id" and t.text in ("in", "instanceof"):
                power = _BINARY.get(t.text)
                if power is None or power <= least or t.text == "in" and self.no_in:
                    break
                self.next()
                self.binary(power - 1 if t.text == "**" else power)
                target = False
            elif self.typed and t.kind == "id" and t.text in ("as", "satisfies") and not t.newline:
                self.next()
                if not self.take_word("const"):
                    self.type()
            else:
                break
        return target

    def unary(self):
        t = self.tok
        if t.kind == "p":
            if t.text in ("+", "-", "!", "~"):
                self.next()
                self.unary()
                return False
            if t.text in ("++", "--"):
                self.next()
                if not self.unary():
                    self.fail("invalid operand of ++ or --", t.end)
                return False
            if t.text == "<" and self.typed:
                self.next()
                if not self.take_word("const"):
                    self.type()
                self.split_p(">")
                self.unary()
                return False
        elif t.kind == "id":
            if t.text in ("typeof", "void", "delete"):
                self.next()
                self.unary()
                return False
            if t.text == "await":
                if self.in_async or self.module and not self.in_function:
                    self.next()
                    self.unary()
                    return False
                if self.module:
                    self.fail("await outside an async function")
        target = self.left_side()
        if self.tok.kind == "p" and self.tok.text in ("++", "--") and not self.tok.newline:
            if not target or target == "pattern":
                self.fail("invalid operand of ++ or --")
            self.next()
            return False
        return target

    def arguments(self) -> None:
        self.need_p("(")
        with_in, self.no_in = self.no_in, False
        while not self.take_p(")"):
            self.take_p("...")
            self.assignment()
            if not self.at_p(")"):
                self.need_p(",")
        self.no_in = with_in

    def left_side(self):
        t = self.tok
        if t.kind == "id" and t.text == "new":
            target = self.new()
        elif t.kind == "id" and t.text == "super":
            self.next()
            if not (self.tok.kind == "p" and self.tok.text in ("(", ".", "[")):
                self.fail()
            target = True
        elif t.kind == "id" and t.text == "import":
            self.next()
            if self.take_p("."):
                self.name()
                target = False
            else:
                if not self.at_p("("):
                    self.fail()
                target = False
        else:
            target = self.primary()
        return self.tail(target, True)

    def tail(self, target, calls: bool):
        optional = False
        while True:
            t = self.tok
            if t.kind == "tpl":
                if optional:
                    self.fail()
                self.template()
                target = False
                continue
            if t.kind != "p":
                return target
            if t.text == ".":
                self.next()
                if self.tok.kind not in ("id", "priv"):
                    self.fail("expected a name")
                self.next()
                target = not optional
            elif t.text == "?.":
                if not calls:
                    return target
                self.next()
                optional = True
                if self.at_p("("):
                    self.arguments()
                elif self.at_p("["):
                    self.index()
                elif self.tok.kind in ("id", "priv"):
                    self.next()
                elif self.typed and self.at_p("<"):
                    self.type_arguments()
                    self.arguments()
                elif self.tok.kind != "tpl":
                    self.fail()
                target = False
            elif t.text == "[":
                self.index()
                target = not optional
            elif t.text == "(" and calls:
                self.arguments()
                target = False
            elif t.text == "!" and self.typed and not t.newline:
                self.next()
            elif t.text in ("<", "<<") and self.typed and self.attempt(self.call_types):
                pass
            else:
                return target

    def call_types(self) -> None:
        self.type_arguments()
        t = self.tok
        if not (t.kind in ("tpl", "eof") or t.newline or t.kind == "p" and t.text in _STARTS_AFTER_GENERICS):
            self.fail()

    def index(self) -> None:
        self.need_p("[")
        with_in, self.no_in = self.no_in, False
        self.expression()
        self.no_in = with_in
        self.need_p("]")

    def new(self):
        self.next()
        if self.take_p("."):
            self.need_word("target")
            return False
        if self.at_word("new"):
            self.new()
        elif self.at_word("import"):
            self.fail()
        elif self.at_word("super"):
            self.next()
        else:
            self.primary()
        self.tail(False, False)
        if self.at_p("("):
            self.arguments()
        return False

    def primary(self):
        t = self.tok
        if t.kind == "id":
            if t.text == "function" or t.text == "async" and self.peek().text == "function" and not self.peek().newline:
                self.function(False)
                return False
            if t.text == "class":
                self.class_(False)
                return False
            if t.text in ("this", "null", "true", "false"):
                self.next()
                return False
            if t.text in _RESERVED:
                self.fail()
            self.next()
            return True
        if t.kind in ("num", "str"):
            self.next()
            return False
        if t.kind == "tpl":
            self.template()
            return False
        if t.kind == "p":
            if t.text == "(":
                self.next()
                with_in, self.no_in = self.no_in, False
                if self.typed:
                    no_conditional, self.no_conditional = self.no_conditional, 0
                target = self.parenthesised()
                if self.typed:
                    self.no_conditional = no_conditional
                self.no_in = with_in
                self.need_p(")")
                return target
            if t.text == "[":
                self.next()
                with_in, self.no_in = self.no_in, False
                while not self.take_p("]"):
                    if self.take_p(","):
                        continue
                    self.take_p("...")
                    self.assignment()
                    if not self.at_p("]"):
                        self.need_p(",")
                self.no_in = with_in
                return "pattern"
            if t.text == "{":
                self.object_()
                return "pattern"
            if t.text in ("/", "/="):
                self.regex()
                return False
            if t.text == "@":
                self.decorators()
                self.class_(False)
                return False
        return self.fail(t.text if t.kind == "bad" and len(t.text) > 2 else None)

    def parenthesised(self):
        begin = self.tok
        self.assignment()
        simple = self.last_end == begin.end and begin.kind == "id" or begin.kind in ("id", "p")
        while self.take_p(","):
            self.assignment()
            simple = False
        return bool(simple)

    def object_(self) -> None:
        self.need_p("{")
        with_in, self.no_in = self.no_in, False
        while not self.take_p("}"):
            if self.take_p("..."):
                self.assignment()
            else:
                self.entry()
            if not self.at_p("}"):
                self.need_p(",")
        self.no_in = with_in

    def entry(self) -> None:
        t, p = self.tok, self.peek()
        is_async = star = accessor = False
        ends = p.kind == "p" and p.text in ("(", ":", ",", "}", "=", "<")
        if t.kind == "id" and t.text in ("get", "set") and not ends:
            self.next()
            accessor = True
        elif t.kind == "id" and t.text == "async" and not ends and not p.newline:
            self.next()
            is_async = True
        if self.take_p("*"):
            star = True
        short = self.tok
        self.property_name()
        if self.at_p("(") or self.typed and self.at_p("<"):
            return self.callable(is_async, star)
        if is_async or star or accessor:
            self.fail()
        if self.take_p(":"):
            self.assignment()
        else:
            if short.kind != "id" or short.text in _RESERVED:
                self.fail()
            if self.take_p("="):  # only as a pattern
                self.assignment()
        return None

    # ---- types

    def type_parameters(self) -> None:
        self.need_p("<")
        while True:
            while self.tok.kind == "id" and self.tok.text in ("const", "in", "out") and self.peek().kind == "id":
                self.next()
            self.binding_name()
            if self.take_word("extends"):
                self.type()
            if self.take_p("="):
                self.type()
            if not self.take_p(",") or self.tok.text.startswith(">"):
                break
        self.split_p(">")

    def type_arguments(self) -> None:
        self.split_p("<")
        while True:
            self.type()
            if not self.take_p(","):
                break
        self.split_p(">")

    def entity(self) -> None:
        self.name()
        while self.take_p("."):
            self.name()

    def result_type(self) -> None:
        if self.at_word("asserts") and self.peek().kind == "id" and not self.peek().newline and self.peek().text != "is":
            self.next()
            self.next()
            if self.take_word("is"):
                self.type()
            return
        if self.tok.kind == "id" and self.peek().kind == "id" and self.peek().text == "is" and not self.peek().newline:
            self.next()
            self.next()
        self.type()

    def type(self) -> None:
        if self.function_type():
            return
        self.union_type()
        if not self.no_conditional and self.at_word("extends") and not self.tok.newline:
            self.next()
            self.no_conditional += 1
            try:
                self.function_type() or self.union_type()
            finally:
                self.no_conditional -= 1
            self.need_p("?")
            self.type()
            self.need_p(":")
            self.type()

    def function_type(self) -> bool:
        m = self.mark()
        if self.at_word("abstract") and self.peek().text == "new":
            self.next()
        if self.at_word("new"):
            self.next()
        elif not (self.at_p("(") or self.at_p("<")):
            self.reset(m)
            return False

        def head():
            if self.at_p("<"):
                self.type_parameters()
            was, self.ambient = self.ambient, True
            try:
                self.parameters()
            finally:
                self.ambient = was
            self.need_p("=>")

        if self.attempt(head):
            self.result_type()
            return True
        self.reset(m)
        return False

    def union_type(self) -> None:
        self.take_p("|") or self.take_p("&")
        self.operand_type()
        while self.take_p("|") or self.take_p("&"):
            self.function_type() or self.operand_type()

    def operand_type(self) -> None:
        while self.tok.kind == "id" and self.tok.text in ("keyof", "unique", "readonly", "infer") and (self.peek().kind in ("id", "str", "num", "tpl") or self.peek().kind == "p" and self.peek().text in ("{", "[", "(")):
            infer = self.tok.text == "infer"
            self.next()
            if infer:
                self.name()
                m = self.mark()
                if self.take_word("extends"):
                    self.no_conditional += 1
                    ok = self.attempt(lambda: self.type() or (self.at_p("?") and self.fail()))
                    self.no_conditional -= 1
                    if not ok:
                        self.reset(m)
                return
        self.atom_type()
        while not self.tok.newline:
            if self.at_p("["):
                self.next()
                if not self.take_p("]"):
                    self.type()
                    self.need_p("]")
            else:
                break

    def atom_type(self) -> None:
        t = self.tok
        if t.kind == "id":
            if t.text == "typeof":
                self.next()
                if self.at_word("import"):
                    return self.import_type()
                self.entity()
                if self.at_p("<") and not self.tok.newline:
                    self.type_arguments()
                return None
            if t.text == "import":
                return self.import_type()
            if t.text in _RESERVED and t.text not in ("void", "null", "this", "true", "false"):
                self.fail()
            if t.text == "asserts" and self.peek().kind == "id":
                return self.result_type()
            self.entity()
            if self.tok.kind == "p" and self.tok.text in ("<", "<<") and not self.tok.newline:
                self.type_arguments()
            return None
        if t.kind in ("num", "str"):
            self.next()
            return None
        if t.kind == "tpl":
            return self.template_type()
        if t.kind == "p":
            if t.text == "-" and self.peek().kind == "num":
                self.next()
                self.next()
                return None
            if t.text == "(":
                self.next()
                no_conditional, self.no_conditional = self.no_conditional, 0
                self.type()
                self.no_conditional = no_conditional
                return self.need_p(")")
            if t.text == "[":
                return self.tuple_type()
            if t.text == "{":
                if not self.attempt(self.mapped_type):
                    self.members()
                return None
        return self.fail("expected a type")

    def import_type(self) -> None:
        self.next()
        self.need_p("(")
        self.type()
        if self.take_p(","):
            self.object_()
        self.need_p(")")
        while self.take_p("."):
            self.name()
        if self.at_p("<"):
            self.type_arguments()

    def template_type(self) -> None:
        at = self.tok.end
        while True:
            m = _TEMPLATE.match(self.text, at)
            if not m:
                self.fail("unterminated template literal")
            self.last_end = m.end()
            self.tok = self.token_at(m.end())
            if m.group(1) == "`":
                return
            self.type()
            if not self.at_p("}"):
                self.fail()
            at = self.tok.end

    def tuple_type(self) -> None:
        self.need_p("[")
        while not self.take_p("]"):
            self.take_p("...")
            if self.tok.kind == "id" and (self.peek().text == ":" or self.peek().text == "?" and self.token_at(self.peek().end).text == ":"):
                self.next()
                self.take_p("?")
                self.need_p(":")
            self.type()
            self.take_p("?")
            if not self.at_p("]"):
                self.need_p(",")

    def mapped_type(self) -> None:
        self.need_p("{")
        if self.tok.kind == "p" and self.tok.text in "+-":
            self.next()
        self.take_word("readonly")
        self.need_p("[")
        self.name()
        self.need_word("in")
        self.type()
        if self.take_word("as"):
            self.type()
        self.need_p("]")
        if self.tok.kind == "p" and self.tok.text in ("+", "-"):
            self.next()
        self.take_p("?")
        if self.take_p(":"):
            self.type()
        self.take_p(";") or self.take_p(",")
        self.need_p("}")

    def index_signature(self) -> bool:
        def head():
            self.need_p("[")
            self.name()
            self.need_p(":")
            self.type()
            self.need_p("]")

        if not self.attempt(head):
            return False
        if self.take_p(":"):
            self.type()
        return True

    def members(self) -> None:
        """The body of an interface or an object type."""
        self.need_p("{")
        while not self.take_p("}"):
            if self.tok.kind == "eof":
                self.fail("expected '}' before end of file")
            self.type_member()
            if not (self.take_p(";") or self.take_p(",") or self.at_p("}") or self.tok.newline):
                self.fail()

    def signature(self) -> None:
        if self.at_p("<"):
            self.type_parameters()
        was, self.ambient = self.ambient, True
        try:
            self.parameters()
        finally:
            self.ambient = was
        if self.take_p(":"):
            self.result_type()

    def type_member(self) -> None:
        while self.tok.kind == "id" and self.tok.text in ("readonly", "get", "set") and (self.peek().kind in ("id", "str", "num") or self.peek().text == "["):
            self.next()
        if self.at_p("(") or self.at_p("<"):
            return self.signature()
        if self.at_word("new") and self.peek().text in ("(", "<"):
            self.next()
            return self.signature()
        if self.at_p("[") and self.index_signature():
            return None
        self.property_name()
        self.take_p("?")
        if self.at_p("(") or self.at_p("<"):
            return self.signature()
        if self.take_p(":"):
            self.type()
        return None

    def enum(self) -> None:
        self.need_word("enum")
        self.binding_name()
        self.need_p("{")
        while not self.take_p("}"):
            self.property_name()
            if self.take_p("="):
                self.assignment()
            if not self.at_p("}"):
                self.need_p(",")

    def typed_statement(self, top: bool) -> bool:
        t, p = self.tok, self.peek()
        if t.text == "enum":
            self.enum()
            return True
        if p.newline and t.text not in ("declare", "abstract") or p.kind not in ("id", "str") and not (t.text == "global" and p.text == "{"):
            return False
        if t.text == "interface":
            self.next()
            self.binding_name()
            if self.at_p("<"):
                self.type_parameters()
            if self.take_word("extends"):
                self.type()
                while self.take_p(","):
                    self.type()
            self.members()
            return True
        if t.text == "type":
            self.next()
            self.binding_name()
            if self.at_p("<"):
                self.type_parameters()
            self.need_p("=")
            self.type()
            self.semicolon()
            return True
        if t.text == "abstract" and p.text == "class":
            self.next()
            self.class_(True)
            return True
        if t.text in ("namespace", "module", "global"):
            self.next()
            if t.text != "global":
                if self.tok.kind == "str":
                    self.next()
                else:
                    self.entity()
            if self.at_p("{"):
                was, self.ambient = self.ambient, self.ambient
                self.need_p("{")
                while not self.take_p("}"):
                    if self.tok.kind == "eof":
                        self.fail("expected '}' before end of file")
                    self.guarded(self.statement, True)
                self.ambient = was
            else:
                self.semicolon()
            return True
        if t.text == "declare" and p.kind == "id" and p.text in ("var", "let", "const", "function", "class", "abstract", "enum", "namespace", "module", "global", "interface", "type", "async"):
            self.next()
            was, self.ambient = self.ambient, True
            self.statement(top)
            self.ambient = was
            return True
        return False


_TYPED_STATEMENTS = frozenset("interface type abstract namespace module declare global enum".split())
_STATEMENTS = {
    "var": Ecma.s_var, "let": Ecma.s_var, "const": Ecma.s_var, "function": Ecma.s_function, "async": Ecma.s_async, "class": Ecma.s_class, "if": Ecma.s_if, "for": Ecma.s_for,
    "while": Ecma.s_while, "do": Ecma.s_do, "return": Ecma.s_return, "break": Ecma.s_jump, "continue": Ecma.s_jump, "throw": Ecma.s_throw, "try": Ecma.s_try,
    "switch": Ecma.s_switch, "with": Ecma.s_with, "debugger": Ecma.s_debugger, "import": Ecma.s_import, "export": Ecma.export,
}
