import random

import pytest

from stratalode.llm import goparse, jsparse
from stratalode.llm import parsecheck as pc

GOOD = {
    "javascript": [
        "", "#!/usr/bin/env node\nlet a = 1\n", "a = b / c / d; x = /re[/]x/g.test(y)", "const {a, b: {c = 2}, ...r} = f(`x${a ? `y${b}` : {}}z`)", "export default class extends A { static #p = 1; get x() { return this.#p } static { f() } async *g() { yield* h() } }",
        "for await (const x of y) if (x) continue; else break", "label: for (;;) { break label }", "import a, {b as c, default as d} from 'm'; import * as n from \"k\"; export * as q from 'z'; import('x').then(() => {})", "const f = async ({a}, [b], ...c) => ({...a, [b]: c, get z() { return 1 }, async *w() {}})", "x = a ?? b?.c?.[d]?.(e) ** 2; new Foo; new a.b.C(1)",
        "try { f() } catch { g() } finally { h() }", "switch (a) { case 1: case 2: b(); default: c() }", "let a = 1\nlet b = a\n++b", "var x = function* () {}, y = class {}", "if (a) b; else if (c) d; else { e }", "do x++; while (x < 5) y()", "a = 0x1F + 0b11 + 1_000n + .5e-3; b = 'it\\'s' + \"q\\\n\"", "while (i --> 0);", "await x; throw new Error(`${e}`)", "({a, b} = c); [a, b] = [b, a]", "void function (e, t) { if (a) b; else c }(this, {});", "!function(){}(); (() => {})()", "x\n/y/g\nz", "const re = /(?<a>[^\\/]+)\\/u/u, d = a++ / 2",
        "if (a) /x{/.test(b); while (c) /[}/]/g.exec(d)", "const n = { a: 1 } / 2; const m = 4 / n", "for (const k in o); for (const [a] of b) {}",
        "const of = 1, async = 2, get = 3; async(of); type = get",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D<T> { readonly a?: string; [k: string]: any; m<U>(x: U, ...r: T[]): void; new (x: number): A; (y: string): y is 'z' }", "type M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U[] : never }; type F = (a: number) => asserts a is 1", "enum E { A = 1, B = A << 2, 'c' } const enum G { X }", "abstract class A<T> extends B<T> implements C, D { private readonly x!: number = 1; constructor(public a: string, private b?: number) { super() } abstract f(): void; static get z(): number { return 1 } }",
        "const f = <T,>(x: T): T => x; const g = async (a: A<B<C>>): Promise<void> => { await h<number>(a as unknown as X) }", "declare const q: number; declare namespace N { const z: 1 }", "declare module 'x' { export function f(a: string): void }\ndeclare global { interface Window { a: 1 } }", "export type { A } from './a'; import type B from 'b'; import { type C, D } from 'c'", "let x = y!.z! as const; let u = v satisfies W; for (const a of <any[]>b) {}", "function f(this: Foo, a?: number): a is 3;\nfunction f() {}", "namespace A.B { export const c = 1 }", "export abstract class Q {}\nexport default interface Z {}", "const a = b < c && d > e; f(a < b, c > d)", "let t: [a: string, b?: number, ...rest: boolean[]] = x; let q: typeof import('a').b", "@dec() class A { @prop({ a: 1 }) b: string; @m() c() {} }", "type L = `a${string}b` | 'c' | -1; let g = a ? (b) : c => d; let o = { a<T>(x: T) { return x } }",
        "export const v: Record<string, number> = { a: 1 };",
    ],
    "go": [
        "package a\n", "// c\npackage a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\nfunc (s *T[K, V]) F(a, b int, c ...string) (n int, err error) {\n\tfor i, v := range x {\n\t\tif v, ok := m[v]; !ok || v == (T{1}) {\n\t\t\tcontinue\n\t\t}\n\t}\n\treturn\n}\n", "package a\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tpkg.F\n\tG map[string][]chan<- int\n}\ntype I interface {\n\t~int | string\n\tM(x int) error\n\tfmt.Stringer\n}\n", "package a\nvar x = map[string]struct{ A int }{\"a\": {1}, \"b\": {A: 2}}\nconst (\n\tA = iota\n\tB\n)\n",
        "package a\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, []string:\n\t\tgo g(x)\n\tdefault:\n\t\tdefer func() { recover() }()\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\tcase d <- 1:\n\t}\n\tL:\n\tfor ; ; {\n\t\tbreak L\n\t}\n}\n", "package a\nfunc Map[T, U any](s []T, f func(T) U) []U { return nil }\nvar _ = Map[int, string](nil, func(i int) string { return `raw\n{` })\ntype P[T any] struct{ x T }\ntype Arr [N]int\n", "package a\nvar r = 'x' + '\\'' + '\\u1234'\nvar f = 0x1p-2 + 1_000i\nfunc g() (a.B, error) { x.y[1:2:3] = &T{}; i++; p, q = q, p; return }",
    ],
    "python": ["", "def f(x: int = 1, /, *, y) -> None:\n    return {**x, 'a': [i async for i in y]}\n", "x = f'{a[\"b\"]!r:>{w}} {{'\n", "match x:\n    case {'a': [1, *_]}: pass\n", 's = """it\'s\n(({{"""\n', "\ufeffx = 1\n", "class A[T]: pass\ntype B = int\n"],
}
BAD = {
    "javascript": ["const a = ;", "f(", "}", "let x = 'abc\n'", "a b", "if a { }", "function (", "<<<<<<< HEAD\nlet a = 1\n=======\nlet a = 2\n>>>>>>> x", "def f():\n    pass\n", "const x: number = 1", "interface A { a: string }", "{ \"a\": { \"b\": 1 } }", "let s = “x”", "const {a} ;", "import x from ;", "return 1", "class { f() }", "const a; const b = 1", "if (a) /x{/.test(b", "x = `abc", "/* open", "a = (1, 2]", "1 = 2", "for (let i = 0; i < 3) {}", "@@ -1,2 +3 @@\n a\n", "<html></html>", "const = 3", "let a = {b: 1, c 2}", "try { f() }", "new"],
    "typescript": ["let x: = 1", "interface A { a string }", "package a\n\nfunc f() {}\n", "type = ", "const x: number;", "enum { A }", "const f = (a: string => 1", "function f(a: number) { return a", "import { a } frm 'b'"],
    "go": ["", "func f() {}", "package a\nfunc f( {}\n", "package a\nvar x = 'ab'\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nvar s = \"open\n", "package a\nfunc f() { x := }\n", "package a\nx := 1\n", "package a\ntype T struct {\n\tA int,\n}\n", "package a\nvar m = map[string]int{\n\t\"a\": 1\n}\n", "package a\nfunc f() {\n", "package a\nfunc f()\n{\n}\n", "package a\nimport \"x\"\n<<<<<<< HEAD\n", "package a\nvar x = `raw\n", "export const a = 1;\n", "package a\nfunc f() { return 1 + }\n", "package a\nfunc f() { for i := 0; i < 3 { } }\n"],
    "python": ["def f(:\n", "x = 'a\n", "if x\n    y\n", "  x = 1\n y = 2\n", "print 'a'\n", "f(1\n", "x = \u201ca\u201d\n", "package a\n\nfunc f() {}\n", '"""open\n', "a = 1 +\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_and_invalid(language):
    wrong = [t for t in GOOD[language] if not pc.is_valid(language, t)] + [t for t in BAD[language] if pc.is_valid(language, t)]
    assert wrong == []


@pytest.mark.parametrize("language", GOOD)
@pytest.mark.parametrize("size", [1, 7, 40])
def test_verdict_does_not_depend_on_chunks(language, size):
    texts = GOOD[language] + BAD[language] + ["\n".join(t for t in GOOD[language] if "import" not in t and "package" not in t and "export" not in t)]
    assert [pc.is_valid(language, t, size=size) for t in texts] == [pc.is_valid(language, t) for t in texts]


def test_combine_is_associative():
    r = random.Random(0)
    text = "\n".join(["a = `x", "${b}", "`; /* {", "*/ f({", "})"] * 3)
    parts = pc.chunks(text, 6)
    sums = [pc.summarise("javascript", p, k == 0) for k, p in enumerate(parts)]
    left = sums[0]
    for s in sums[1:]:
        left = pc.combine(left, s)
    for _ in range(5):
        todo = list(sums)
        while len(todo) > 1:
            i = r.randrange(len(todo) - 1)
            todo[i : i + 2] = [pc.combine(todo[i], todo[i + 1])]
        assert todo[0] == left


def test_brackets_join():
    assert pc.join_brackets(([")"], ["("]), ([")", "]"], ["{"])) == ([")", "]"], ["{"])
    assert pc.join_brackets(([], ["("]), (["]"], [])) is None and pc.brackets(["(", "]"]) is None


def test_deep_nesting_is_not_flagged():
    assert pc.is_valid("javascript", "(" * 5000 + "1" + ")" * 5000)


DOCS = "id bigint, path string, stamp string, body string, valid string, language int"


def test_rows(spark, rows):
    big = "const a = [\n" + "  `x ${f({})}`,\n" * 3000 + "];\n"
    docs = [
        (1, "r/a.py", "2:1", "x = (\n", "c", 0), (2, "r/a.py", "1:1", "x = 1\n", "c", 0), (3, "r/b.py", "1:1", "x = (\n", "", 0), (4, "r/b.py", "2:1", "x = 1\n", "", 0),
        (5, "r/n.js", "1:1", None, "", 0), (6, None, "1:1", "(", "", 0), (7, "r/x.md", "1:1", "(", "", 0), (8, "r/big.js", "1:1", big, "", 0), (9, "r/bigbad.js", "1:1", big + "}", "", 0), (9, "r/bigbad.js", "1:1", big + "}", "", 0),
        (10, "r/e.go", "1:1", "", "", 0), (11, "r/e.ts", None, "", "", 0), (12, "py", "1:1", "(", "", 0), (13, "r/gone.js", "1:1", "(", "", 0), (14, "r/gone.js", "2:1", None, "", 0),
    ]
    df = spark.createDataFrame(docs, DOCS)
    assert [r.path for r in pc.broken_paths(df).orderBy("path").collect()] == ["r/a.py", "r/bigbad.js", "r/e.go"]
    assert pc.broken_paths(df.limit(0)).count() == 0
    files = spark.createDataFrame([("r/a.py", "h", "parsed"), ("r/a.py", "old", "x"), ("r/b.py", "h", None)], "path string, sha256 string, status string")
    withdigest = df.selectExpr("*", "'h' as content_digest")
    got = [tuple(r) for r in pc.broken_rates(withdigest, files).collect()]
    assert got == [("r", "python", 2, 1, 0.5, 1)]


def test_statement_cuts_are_sound():
    for t in GOOD["javascript"]:
        _, k = jsparse.lex(t)
        assert [x for s in jsparse.statements(k) for x in s] == k
    for t in GOOD["go"]:
        _, k = goparse.lex(t)
        assert [x for s in goparse.statements(k) for x in s] == k
