import ast
import json
import random
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import validity
from folioscope.llm.validity import errors

warnings.simplefilter("ignore")

GOOD = {
    "python": ["", "# c\n", "x = 1\n", "def f(a, /, b=1, *, c, **d) -> int:\n    return a if b else c\n", "async def g():\n    async with a as b, c:\n        await d\n    return [x async for x in y]\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': 1, **k} | C(x=2): pass\n", "print(f'{x!r:>{w}} {{}} {y=}')\n", "with (open(a) as f, g() as h):\n    pass\n", "try:\n  a\nexcept* E as e:\n  b\nfinally:\n  c\n", "type A[T] = list[T]\nmatch = 1\nx: int = 3\na, *b = c\n", '"""\n<<<<<<< x\n=======\n"""\n', "class A(B, metaclass=C):\n    x = lambda *a, k=1: (yield)\n"],
    "starlark": ["load('//a:b.bzl', 'c')\ndef f(a, b = None):\n    for i in range(3):\n        if not a:\n            fail('x')\n    return [x for x in b if x != 1]\n", "x = 'a' % (1, 2) if y else {'k': 1}\n"],
    "java": ["", "package a.b;\nimport static c.D.*;\n@X(a = 1, b = {2, 3}) public final class A<T extends B & C> extends D<T> implements E {\n int[] x = {1, 2}, y[];\n static { }\n A() { this(1); }\n <R> R m(final int a, String... b) throws E {\n  List<Map<String, int[]>> l = new ArrayList<>(5);\n  for (int i = 0, j = 1; i < 3; i++, j--) { continue; }\n  for (var q : l) x[0] += (int) q >>> 2;\n  Runnable r = () -> { }; F f = (a1, b1) -> a1 < b1; G g = A::new; H h = int[]::new;\n  switch (a) { case 1: case 2: break; default: }\n  int k = switch (a) { case 1, 2 -> 3; default -> { yield 4; } };\n  try (var z = o(); z) { } catch (A | B e) { } finally { }\n  if (o instanceof String s && !s.isEmpty()) return null; else throw new E() { int q; };\n  label: do { break label; } while (true);\n  return (R) (Object) \"\"\"\n   text \\\"\"\" \"\"\";\n }\n enum F { A(1) { }, B; int z; }\n record P(int x, int y) { P { } }\n sealed interface S permits T1 { default void d() { } }\n @interface Q { int v() default 1; }\n}\n"],
    "javascript": ["", "#!/usr/bin/env node\nimport a, { b as c } from 'm'\nexport default class { #p = 1; static async *g() { yield* x } get y() { return this.#p } }\n", "const { a, b: [c = 1, ...d], ...e } = f, g = async (x) => await x, h = y => ({ y })\nlabel: for (const [k, v] of Object.entries(o)) { if (k in v) continue label }\nlet r = /[/\\]]+/g.test(s) ? `a${`b${1}`}` : a ?? b?.[c]?.(d)\ni++\n++j\nvar z = a / b / c\n({ a, b } = c)\ndo x(); while (y)\nswitch (a) { case 1: default: break }\nnew Foo\nif (a) b; else c\n", "/* ======= x\n<<<<<<< */\nfoo()\n"],
    "typescript": ["type A<T = string> = { readonly [k in keyof T]?: T[k] } | (new (...a: any[]) => void) | `x${string}`;\ninterface I extends J<K> { (a: number): string; m?<T>(this: X, b?: T): asserts b is T; readonly [k: string]: any }\nenum E { A = 1, B }\nabstract class C<T> extends D<T> implements I { constructor(private readonly a: number, b?: string) { super() }\n declare x: number; static y!: string; abstract z(): void; get w(): T { return this.q! as unknown as T } }\nfunction f<T extends object>(a: T, ...r: T[]): a is T;\nfunction f(a: any) { return <any>a }\nconst g = async <T,>(x: T): Promise<T[]> => [x]\nlet t: [a: string, b?: number] = ['x'], u = v satisfies W\nexport type { A }\ndeclare module 'm' { export const q: number }\nnamespace N.M { }\nconst h = a < b && c > (d)\nfor (let i: number = 0; i < 3; i++) { }\n"],
    "go": ["package p\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\t~int | string\n\tM(a int, b ...string) (x int, err error)\n}\n\nconst (\n\ta = iota\n\tb\n)\n\nvar f func(int) <-chan []map[string]*T[int, string]\n\nfunc (t *T[K, V]) F(x, y int) (int, error) {\n\tif v, ok := m[\"a\"]; !ok {\n\t\treturn 0, nil\n\t} else if v > 1 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range ch {\n\t}\n\tfor k, v := range (T{1, 2}).A {\n\t\tgo func() { c <- k }()\n\t}\n\tswitch x := y.(type) {\n\tcase nil, int:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\t}\n\tx, y = []int{1: 2, 3}[0], struct{}{}.z\n\tdefer close(c)\nout:\n\tfor {\n\t\tbreak out\n\t}\n\treturn min[int](1, 2), err\n}\n"],
    "rust": ["", "#![allow(x)]\nuse a::{b, c::*, self as d};\npub(crate) struct S<'a, T: Clone + 'a = u8, const N: usize = 3>(pub &'a T, [u8; N]) where T: Fn(u8) -> u8;\nenum E { A { x: u8 }, B(u8) = 3, }\nimpl<'a, T> Tr for S<'a, T> { const X: u8 = 1; type Y = Vec<Vec<u8>>; fn f(&mut self, (a, b): (u8, u8)) -> impl Iterator<Item = u8> + '_ {\n let x = if a > b { 1 } else { 2 } as u64;\n let Some(y) = z else { return };\n match x { 0..=9 | 11 if a == b => {} E::A { x, .. } => 1, ref q @ _ => q.await?, }\n for i in (0..n).rev() { v[i] <<= 2; }\n let c = move |a: u8, _| -> u8 { a }; let d = |x| x * 2; let e = || 1;\n while let Some(x) = it.next::<u8>() { 'l: loop { break 'l } }\n println!(\"{}\", x); let s = r#\"a\"b\"#; let t = b'\\''; let l = '{';\n if x == (S { a: 1, ..d }) && !y {}\n unsafe { *p = &mut **q } ; a.0.1 + 1.max(2)\n} }\n/* a /* b */ */\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nextern \"C\" { fn g(...); }\ntrait Q: R { fn h(self: Box<Self>); }\nasync fn k() {}\n"],
    "scala": ["package a.b\nimport c.{D, E => F, _}\nsealed abstract class A[+T <: B](val x: Int = 1)(implicit y: C) extends D(x) with E { self =>\n  private[this] lazy val (p, q) = (1, 2)\n  var z: Int = _\n  def f[X: Ord](a: => X, b: Int*): Either[X, (Int) => Int] = a match {\n    case Some(y @ (_: Int)) if y > 1 => { println(s\"a ${b.map(_ + 1)} $$\") }\n    case x :: xs | Nil => for { i <- 1 to 3; if i > 1; j = i } yield i -> j\n    case _ =>\n  }\n  def g = try { h } catch { case e: Exception => null } finally i\n  val k = xs.map { case (a, b) => a + b }.filter(_ > 0)\n  if (a) b else c\n  while (x < 3) x += 1\n  new T { def q = \"\"\"x\"y\"\"\" }\n}\ncase object O\ntrait T { type X = Int; def m(): Unit }\n"],
    "json": ["1", " [1, -0.5e+3, \"\\u00e9\", null, {\"a\": {}}] "],
}
BAD = {
    "python": ["x =\n", "def f(:\n  pass\n", "if x:\npass\n", "print 'a'\n", "a = 01\n", "f(a=1, b)\n", "x = (1,\n", "'abc\n", "<<<<<<< HEAD\nx = 1\n", "  x = 1\n", "f() = 1\n", "for x in y\n  pass\n", "f'{x'\n", "def f(a, a): pass\n", "a b\n", "x = “a”\n"],
    "starlark": ["class A: pass\n", "while x: pass\n", "import a\n", "def f(:\n", "x = f'a'\n"],
    "java": ["int x;", "class A { int f() { return 1 } }", "class A { void f() { int x = ; } }", "class A {", "class A { void f( { } }", "class A { String s = \"a; }", "class A { void f() { 1 + 2; } }", "class A {\n<<<<<<< HEAD\n}"],
    "javascript": ["let x = ;", "function (", "class A { f() { }", "a b", "x = `a${", "if (a { }", "const a;", "<<<<<<< x\n", "async f(a) { }", "let a = 1 +", "const x: number = 1"],
    "typescript": ["let x: = 1", "type A = ", "class A { f(a: number: string) {} }", "interface I { a: ; }", ">>>>>>> x"],
    "go": ["", "func f() {}", "package p\nfunc f() {\n\tx := \n}\n", "package p\nfunc f() {", "package p\nx := 1\n", "package p\nfunc f(a int b) {}\n", "package p\n=======\n"],
    "rust": ["fn f() { let = 1; }", "fn f() {", "struct S { a u8 }", "let x = 1;", "fn f() { match x { 1 > 2 } }", "fn f() { a b }", "fn f( { }"],
    "scala": ["class A {", "def f(x Int) = 1", "object O { val x = }", "class A { def f(: Int) = 1 }", "object O { x match { y => 1 } }", "println(1)", "object O {\n=======\n}"],
    "json": ["", "{", "[1,]", "{'a': 1}", "{\"a\": 01}", "// c\n1", "NaN", "1 2"],
}


@pytest.mark.parametrize("name, code", [(n, c) for n, cs in GOOD.items() for c in cs])
def test_good(name, code):
    assert errors(name, code) == []


@pytest.mark.parametrize("name, code", [(n, c) for n, cs in BAD.items() for c in cs])
def test_bad(name, code):
    assert errors(name, code)


def test_recovery():
    found = errors("java", "class A {\n void f() { int x = ; }\n void g() { y z w; }\n void h() { }\n}\n")
    assert [e[0] for e in found][:1] == [2] and {e[0] for e in found} >= {2, 3}
    assert len(errors("javascript", "let a = ;\nlet b = 1;\nlet c = ;\n")) == 2


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_python_against_ast(seed):
    rng = random.Random(seed)
    code = rng.choice(GOOD["python"])
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(len(code) + 1)
        code = code[:a] + rng.choice(["", "(", ")", ":", " ", "\n", "'", "=", ",", "x", "1", "{", "}"]) + code[a + rng.choice([0, 1, 3]) :]
    try:
        ast.parse(code)
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    assert (errors("python", code) == []) == valid, code


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)), st.integers(0, 200), st.booleans())
def test_json_against_library(value, at, cut):
    text = json.dumps(value)
    if cut and text:
        text = text[: at % len(text)] + text[at % len(text) + 1 :]
    try:
        json.loads(text, parse_constant=lambda c: 1 / 0)
        valid = True
    except (ValueError, ZeroDivisionError):
        valid = False
    assert (errors("json", text) == []) == valid


def test_hostile():
    for name in validity.GRAMMARS:
        for code in ("(" * 30000, "{" * 5000, "a" * 100000, '"' * 9999, "-" * 20000 + "1", "\0", "\\"):
            errors(name, code)


def test_blocks(spark):
    kind = "code_id long, repo string, language string, code string, valid int"
    data = [(1, "r", "PY", "x = 1", 0), (1, "r", "PY", "x = 1", 0), (2, "r", "Python3", "x =", 0), (3, None, "yaml", "x", 0), (4, "r", None, "x", 0), (5, "r", "go", None, 0), (6, None, "GOLANG", "", 0), (None, "r", "py", "x =", 0)]
    got = {r.code_id: (r.lang, r.valid, r.first_line) for r in validity.checked(spark.createDataFrame(data, kind)).collect()}
    assert got == {1: ("python", True, None), 2: ("python", False, 1), 6: ("go", False, 1)}
    claims = spark.createDataFrame([(2, "valid"), (2, "valid"), (1, None)], "code_id long, status string")
    rates = {(r.repo, r.lang): (r.n_blocks, r.n_invalid, r.invalid_rate, r.n_claimed_valid) for r in validity.rates(spark.createDataFrame(data, kind), claims).collect()}
    assert rates == {("r", "python"): (2, 1, 0.5, 1), (None, "go"): (1, 1, 1.0, 0)}
    assert validity.checked(spark.createDataFrame([], kind)).count() == 0


VALID = {
    "javascript": [
        'if (a) /re/.test(b);',
        'for (const x of y) /re/.test(x);',
        'while(a) /b/.exec(c)',
        'x ||= /a/;',
        'x &&= /a/g',
        'a = b / c / d',
        '(a) / b / c',
        'f(a) / 2 / 3',
        'async function f(){ await y; for await (const x of y) {} }',
        'const f = async () => await y',
        'await x',
        'function* g(){ yield 1; const x = yield* h() }',
        'class A { constructor(){} static constructor(){} async m(){ await x } *g(){ yield 1 } get a(){return 1} }',
        'a ? (b) : c',
        'a ?? (b || c)',
        '(a && b) ?? c',
        '(-1) ** 2',
        '2 ** -1',
        'for (var x = 1 in y) ;',
        'for (let x of y) {}',
        'if (a) function f() {}',
        'var yield_ = 1; var await_ = 2',
        'x = {async *g(){ yield await y }, get b(){return 1}, async f(){await z}}',
        'a || b && c',
        'a ?? b ?? c',
        'x = a ? b : c => d',
        '`${a / b}` / 2',
        'if (a) {} /re/.test(b)',
        'a => { return 1 }',
        '(a, b) => a / b',
        'x = async (a) => { await a }; return_ = 1',
        "(" * 5000 + "1" + ")" * 5000,
        "[" * 5000 + "]" * 5000,
        'label: for (;;) { break label }',
        'let y = (function(){ return 1 })()',
        'export default async function () { await 1 }',
        'new Foo(function(){ return 1 })',
        'class A { x = () => { return 1 } }',
        'do x++; while (x < 5) y',
        'let x = a ? (b, c) : d',
    ],
    "typescript": [
        'type A<T> = T extends infer U extends string ? U : never',
        'const x = a ? (b) : c => d',
        'const x = a ? (b): c => d : e',
        'type F = (a: string) => void',
        'type G = ((a: number) => void) | null',
        'type X = ((((((((((((((((((((((((((((((string))))))))))))))))))))))))))))))',
        'type B<T> = T extends (infer U)[] ? U : never',
        'class A { constructor(a: string); constructor(a: any) { } }',
        'const f = (x: number): string => "a"',
        'function f(this: Foo, x?: number): asserts x is number {}',
        'type A = T extends (infer U extends number ? U : never) ? 1 : 2',
        'abstract class A { abstract m(): void }',
        'declare function f(): void; enum E { A = 1 }',
        'type C = new (...args: any[]) => object',
        'let a = x as unknown as (y: string) => void',
        'const f = <T,>(x: T) => x',
        'type P = { [K in keyof T]?: T[K] }',
    ],
    "scala": [
        'trait X { self: Q => def f = 1 }',
        'class A { this: B with C => val x = 1 }',
        'trait X { self => def f = self }',
        'object A { val f: Int => Int = x => x + 1 }',
        'trait A { self: B[C] => }',
    ],
    "rust": [
        'unsafe extern "C" { safe fn f(); pub unsafe fn g(); safe static X: i32; }',
        'fn f<T>() -> impl Sized + use<T> { 1 }',
        "fn f<'a, T>(x: &'a T) -> impl Sized + use<'a, T> { x }",
        'extern "C" { fn f(); }',
    ],
    "go": [
        'package p\nfunc f(a, b int, c string) {}',
        'package p\nfunc f(int, string) {}',
        'package p\nfunc f(a int, b ...string) (x, y int) { return }',
        'package p\nfunc f(a, b pkg.T) {}',
    ],
    "starlark": [
        'x = {}',
        'x = {"a": 1, "b": lambda y: y}',
        'x = {k: v for k, v in y}',
        'x = [1, 2]',
        'f(a = {1: 2})',
    ],
    "json": [
        '{"a": [1, 2, {"b": null}]}',
        '[]',
        '1',
        "[" * 5000 + "]" * 5000,
    ],
    "python": [
        "x = " + "(" * 3000 + "1" + ")" * 3000,
        'x = {1, 2}',
        'y = (z := 1)',
        'def f():\n    x = yield 1\n',
    ],
}

INVALID = {
    "javascript": [
        '-1 ** 2',
        'a ?? b || c',
        'a || b ?? c',
        'a && b ?? c',
        'a ?? b && c',
        'for (let x = 1 of y) {}',
        'return 1',
        'function f() { await y }',
        'if (a) function* f() {}',
        'class A { constructor(){} constructor(){} }',
        'const f = () => await y',
        'function f() { yield 1 }',
        'x = a /',
        'if (a) /re',
        'for (let x = 1 in y) {}',
        'while (a) class B {}',
    ],
    "typescript": [
        'type A = T extends infer U extends',
        'return 1',
        'const x = a ? (b) : ',
    ],
    "go": [
        'package p\nfunc f(a int, string) {}',
    ],
    "starlark": [
        'x = yield 1',
        'x = {1, 2}',
        '(y := 1)',
        'def f():\n    yield 1\n',
    ],
    "json": [
        '{"a": }',
        '[1 2]',
        '[1,]',
        '{"a":1,}',
        '{a:1}',
        '[1}',
        '',
    ],
}


def test_valid_forms():
    for name, codes in VALID.items():
        for code in codes:
            assert errors(name, code) == [], (name, code[:80])


def test_invalid_forms():
    for name, codes in INVALID.items():
        for code in codes:
            assert errors(name, code), (name, code)


def test_assignment_expressions_need_brackets():
    for code in ("x := x\n", "y = x := 1\n", "a, b := 1, 2\n", "for x in y := z: pass\n", "[i for i in y if z := i]\n", "def f():\n  return x := 1\n"):
        assert errors("python", code), code
    for code in ("(x := 1)\n", "f(x := 1)\n", "x[y := 1]\n", "while x := f(): pass\n", "[y := i for i in x]\n", "match x := 1:\n  case 1: pass\n", "[i for i in y if (z := i)]\n", "{x := 1}\n"):
        assert errors("python", code) == [], code


def test_all_errors_are_stored():
    assert len(errors("json", "[" + ",".join(["x"] * 500) + "]")) == 500
    assert len(errors("java", "class A {\n" + "int = 1;\n" * 500 + "}")) == 500
    assert len(errors("json", '{"a": 1, "b" 2, "c": [1, }, ], "d": q}')) > 1


def test_depth_is_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(validity, "NESTING", 2000)
    assert errors("javascript", "(" * 5000 + "1" + ")" * 5000) == [(1, 1, validity.UNDECIDED)]


def test_causes(spark):
    rows = [(1, "r", "json", "[1, x, y]"), (1, "r", "json", "[1, x, y]"), (2, "r", "json", "[1]"), (3, "r", "json", None), (None, "r", "json", "["), (4, "r", None, "[")]
    df = spark.createDataFrame(rows, "code_id long, repo string, language string, code string")
    got = sorted(tuple(r) for r in validity.causes(df).select("code_id", "error_no", "line", "column").collect())
    assert got == [(1, 1, 1, 5), (1, 2, 1, 8)]
    assert validity.causes(df.limit(0)).count() == 0
