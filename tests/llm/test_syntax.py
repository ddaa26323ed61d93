"""Parsers on valid and invalid texts; Python against the interpreter's own parser."""

import ast
import inspect
import json
import random
import textwrap
import warnings

import pytest

from graphlens.llm.parsing.python import Python
from graphlens.llm.syntax import acceptance, check_syntax, faults_of

VALID = {
    "js": ["", "a?.b?.[c]?.(d) ?? e", "x/2/3; r=/[/]x/g.test(y)", "label: for(;;){ continue label }", "class A{#x=1;static{this.y}get z(){return 1} async *w(){} 'q'(){} [k]=1}", "`a${`b${c}`}d`",
           "import x,{y as z} from 'q'; export default class{}; export * as ns from 'm'", "a\n++b", "await x", "({a,b:c,...d}=e)", "async (x) => { await x }", "if(a)b\nelse c", "/* } */ // {\nf('{')"],
    "cjs": ["const a = require('a'); module.exports = {a}", "with (a) { b }"],
    "ts": ["const f = <T,>(x: T): T => x;", "type X<T> = T extends (infer U)[] ? U : never; type Y = { readonly [K in keyof T as `a${K}`]-?: T[K] };", "enum E { A = 1, B = 'x' }", "a < b || c > d; f<T>(x)",
           "abstract class Q<T> extends R<T> implements S { private x = 1; constructor(private a: string) { super(); } foo(a: string): void; foo(a: any) {} }", "let v = x as const; let w = <any>y; let z = a!.b!;",
           "declare module 'foo' { export function bar(x: number): void; }", "import e = require('f'); export = g;", "interface A<T> extends B<T> { [k: string]: unknown; new (x: number): A<T>; y?(): void }"],
    "rs": ["", "fn main() { let x: Vec<Vec<i32>> = Vec::new(); if x.len() < 3 && a > b { foo::<Vec<u8>>(1)?; } }", "#![allow(x)]\nuse a::{b, c::*, self};\nenum E { A = 1, B(u8), C { x: i32 } }",
           "fn f() { let r = r#\"a\"b\"#; let c = '\\u{1F600}'; let l: &'static str = \"a\"; /* a /* b */ c */ }", "macro_rules! m { ($x:expr) => { $x + 1 }; }", "trait T { fn a(&self) where Self: Sized; }",
           "fn f() { match x { Some(1..=5) | None if y => {} A { x, .. } => 3, [a, .., b] => (), _ => unsafe { x } } }"],
    "py": ["", "x: int = 1\n", "def f(a, /, b, *, c=1, **k): ...", "match x:\n  case [1, *_] | {'a': b} if c: pass\n", "f'{x!r:>{w}} {{}} {d[\"a\"]}'", "with (a as b, c): pass", "if 1:\n\tx\n", "async def f():\n  await x\n",
           "try:\n  pass\nexcept* E:\n  pass\n", "print((yield))", "x = (y := 1)", "lambda *a, b=1: a"]}
INVALID = {
    "js": ["a b", "let x = ;", "function (){}", "if (a {", "const x;", "}", "'abc", "`abc", "1=2", "import {a from 'b'", "try {}", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "{\n  \"a\": 1,\n  \"b\": 2\n}", "id,name\n1,a b"],
    "cjs": ["import a from 'a'"], "mjs": ["with (a) {}"], "ts": ["let x: = 1", "interface A { x: }", "type X", "enum { A }", "function f(x: ) {}"],
    "rs": ["fn f( {}", "fn f() { let x = ; }", "let x = 1;", "fn f() { a b }", "fn f() { \"abc }", "def f():", "fn f(x) {}", "fn f() {", "<<<<<<< HEAD", "{\"a\": 1}", "fn f() { let c = 'ab'; }"],
    "py": ["x = ", "def f(", "if x\n  y", " x", "print 'a'", "f(a b)", "1 = x", "x = 'abc", "f'{'", "<<<<<<< HEAD", "const x = 1;", "f(a=1, b)", "def f(a=1, b): pass", "for x y: pass", "class A:\npass"]}


@pytest.mark.parametrize("ext", VALID)
def test_valid(ext):
    for text in VALID[ext]:
        assert faults_of(text, ext) == (0, []), text


@pytest.mark.parametrize("ext", INVALID)
def test_invalid(ext):
    for text in INVALID[ext]:
        n, faults = faults_of(text, ext)
        assert n and faults and all(f.line >= 1 for f in faults), text


def test_recovery_reports_all():
    n, faults = faults_of("function f() { a b; }\nlet x = 1;\nfunction g() {\n  c d;\n}\n", "js")
    assert [f.line for f in faults] == [1, 4]
    assert [f.line for f in faults_of("x = = 1\ny = 2\nz z\n", "py")[1]] == [1, 3]


def accepted(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError):
            return False


def test_python_against_the_interpreter():
    r = random.Random(3)
    sources = [inspect.getsource(m) for m in (json, json.decoder, textwrap, random, inspect)]
    for source in sources:
        p = Python(source)
        p.program()
        assert not p.faults
    for _ in range(600):
        lines = r.choice(sources).split("\n")
        a = r.randrange(len(lines))
        text = "\n".join(lines[a:a + 40])
        k = r.randrange(len(text) + 1)
        text = r.choice([text[:k], text[:k] + text[k + 1:], text[:k] + r.choice(list("()[]{}:,.=*'\"\\ \n@#1a") + [" in ", " if ", " for ", "lambda "]) + text[k:]])
        p = Python(text)
        p.program()
        assert bool(p.faults) != accepted(text), text


def test_deep_nesting_and_long_texts():
    assert faults_of("x = " + "[" * 300 + "]" * 300, "js") == (0, [])
    assert faults_of("let a = 1;\n" * 20_000, "ts") == (0, [])
    assert faults_of("f(" * 2000, "rs")[0] > 0


def test_frames(spark):
    files = spark.createDataFrame([(1, "r/a.py", "x"), (1, "r/a.py", "y"), (2, "r/b.rs", "x"), (3, "r/c.txt", "x"), (4, "q/d.js", "x"), (5, "q/e.JS", "x"), (6, None, "x"), (7, "noext", "x")], "id long, path string, content string")
    texts = spark.createDataFrame([(1, "x = 1"), (2, "fn f( {}"), (3, "x"), (4, None), (5, ""), (6, "x"), (7, "x"), (8, "x")], "file_id long, content string")
    v = check_syntax(files, texts)
    assert {r.file_id: r.valid for r in v.collect()} == {1: True, 2: False, 3: None, 5: True, 7: None}
    bad = v.where("not valid").first()
    assert bad.first_line == 1 and bad.errors[0].line == 1 and bad.n_errors >= 1
    assert {(r.repository, r.language): (r.n_files, r.n_invalid, r.invalid_rate) for r in acceptance(v).collect()} == {
        ("r", "python"): (1, 0, 0.0), ("r", "rust"): (1, 1, 1.0), ("q", "javascript"): (1, 0, 0.0)}
    assert check_syntax(files.limit(0), texts).collect() == [] == check_syntax(files, texts.limit(0)).collect()


DEEP = 20_000


@pytest.mark.parametrize("ext, text, valid", [
    ("js", "x = " + "(" * DEEP + "1" + ")" * DEEP + ";", True), ("js", "[" * 3 * DEEP, False), ("js", "{" * DEEP + "}" * DEEP, True), ("ts", "let x = " + "[" * DEEP + "]" * DEEP + ";", True),
    ("rs", "fn a() { let x = " + "(" * DEEP + "1" + ")" * DEEP + "; }", True), ("rs", "type A = " + "Vec<" * DEEP + "u8" + ">" * DEEP + ";", True), ("rs", "type A = " + "Vec<" * 40 + "u8" + ">" * 39 + ";", False),
    ("rs", "fn a(x: B<Item<u8> = u8>, y: C<T: Copy>) {}", True), ("py", "x = " + "not " * DEEP + "1", True)])
def test_deep_nesting_gets_a_verdict(ext, text, valid):
    n, _ = faults_of(text, ext)
    assert (n == 0) == valid


@pytest.mark.parametrize("ext, line", [("js", "let = ;\n"), ("rs", "fn 1() {}\n"), ("py", "x = = 1\n")])
def test_all_errors_are_stored(ext, line):
    n, faults = faults_of(line * 1500, ext)
    assert n == len(faults) == 1500 and [f.line for f in faults] == list(range(1, 1501))
