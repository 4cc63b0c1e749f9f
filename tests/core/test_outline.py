"""The reader of source files on forms that are easily misread, each with the places that a full parser gives."""

import cProfile
import random
import time

import pytest

from factloom.sources import names, outline
from factloom.sources.tokens import Tokens


def of(kind, text, jsx=True):
    return [n for n in outline.nodes(text, jsx) if n["kind"] == kind]


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("let a: any;", 1), ("function f(): any { return {} }", 1), ("type X<T> = T extends any ? 1 : any", 2), ("const a = b as any", 1), ("let m: Map<string, any> = x", 1), ("let m: Map<any, Foo<any>>", 2),
        ("let t: [any, string]", 1), ("type A = any", 1), ("type A = (any | string)[]", 1), ("function f<T = any>(x: T) {}", 1), ("let f: (x: any) => any", 2), ("let u: string | any", 1), ("let a: any[] = []", 1),
        ("interface I { a: any; b?: any }", 2), ("class K { x: any = 1; m(y: any): any { } }", 3), ("let p: Promise<any>\nlet q: any\n", 2), ("isAny(x): x is any", 1),
        ("const o = { any: 1 }", 0), ("f(any)", 0), ("const any = 1", 0), ("x = any + 1", 0), ("a.any", 0), ("any()", 0), ("// any\n/* : any */ const s = ': any'", 0), ("`: any`", 0), ("`${x as any}`", 1), ("const r = /: any/", 0),
        ("const t = <p>so: any</p>", 0), ("import { any } from 'x'", 0), ("if (i < any) {}", 0),
    ],
)
def test_any(text, count):
    assert len(of("any", text)) == count


@pytest.mark.parametrize(
    ("text", "places"),
    [
        ("const a = b as string;", [(10, 22)]), ("x = { a: 1 } as const", [(4, 22)]), ("b! as T", [(1, 8)]), ("f(x as unknown as T)", [(3, 15), (3, 20)]), ("(a.b[0] as any).c", [(2, 12)]), ("a.as(b)", []), ("`${y as Z}`", [(4, 9)]),
        ("const p = <p>same as before</p>", []), ("import { a as b } from 'x'", []), ("import * as x from 'y'", []), ("export { a as b }", []), ("import d, { a as b } from 'x'; z as Q", [(31, 38)]), ("const s = 'x as y' // a as b", []), ("let v = foo(1).bar as Baz", [(8, 26)]),
    ],
)
def test_as(text, places):
    got = [(n["start_column"], n["end"] + 1) for n in of("as", text)]
    assert [a for a, _ in got] == [a for a, _ in places]


@pytest.mark.parametrize(
    ("text", "chains"),
    [
        ("foo(1, 'bar');", ["foo"]), ("myObj.method.call(null, a)", ["myObj|method|call"]), ("new Foo(1)", []), ("new Foo(1).bar()", ["new Foo(1)|bar"]), ("const f = async (x) => x", []), ("const f = (x): number => g(x)", ["g"]),
        ("interface I { foo(x): void; bar?(): any }", []), ("const o = { a, b(x) { return c(x) }, get d() { return 1 }, async e() {} }", ["c"]), ("class K { constructor() { super() } m(a) { return this.f(1) }\n static n(): void {}\n get x() { return y() } }", ["super", "this|f", "y"]),
        ("p().then(cb)", ["p()|then", "p"]), ("a?.b?.(1)", ["a|b"]), ("a!.b(2)", ["a!|b"]), ("a['x'](3)", ["a['x']"]), ("f<T, U>(x)", ["f"]), ("if (a) { b() } else while (c) d()", ["b", "d"]), ("for (const x of y()) {}", ["y"]),
        ("`${f(1)} and ${g(`${h(2)}`)}`", ["f", "g", "h"]), ("const r = x.replace(/[\"'`(]/g, y)", ["x|replace"]), ("const t = <p>a(b) // c {d(1)}</p>; e()", ["d", "e"]), ("function f(a) {} function* g() {} async function h() {}", []),
        ("useEffect(() => { run() }, [])", ["useEffect", "run"]), ("import('x')", []), ("a = b\n(c)", ["b"]), ("await f()", ["f"]), ("!f()", ["f"]), ("typeof f()", ["f"]), ("x.catch(e)", ["x|catch"]), ("f()()", ["f()", "f"]),
        ("try { a() } catch (e) { b(e) }", ["a", "b"]), ("a = i < n(1)", ["n"]),
    ],
)
def test_calls(text, chains):
    got = sorted(n["more"]["chain"].replace("\x1f", "|") for n in of("call", text))
    assert got == sorted(chains)


def test_declarators_and_tags():
    assert [(n["name"], n["more"]["source"]) for n in of("variable", "let a = i<n, b = 2, c = d.e, f = g<A, B>(1), h = 1")] == [("a", ""), ("b", ""), ("c", "d.e"), ("f", ""), ("h", "")]
    tags = of("jsx", "const x = <A.B c={<D e='f' />} {...g} h>text < {i}</A.B>")
    assert [(n["name"], n["more"]["attributes"], n["more"]["spread"]) for n in tags] == [("A.B", "c,h", "g"), ("D", "e", "")]
    assert not of("jsx", "const a = <T>(x: T) => x; const b = <Foo>y; if (a < b) {}", jsx=False)


def test_blanks_keep_places():
    for text in ("a = 'b' // c\n`x${y}z` + /re/g", "<p>text {a} more</p>", "", "'open", "`open ${", "/* open"):
        for strings in (True, False):
            code = Tokens(text).blanked(strings)
            assert len(code) == len(text) and code.count("\n") == text.count("\n")
    assert Tokens("import a from 'b' // c").blanked(strings=False) == "import a from 'b'     "


def test_reading_is_linear():
    """1 MB of ordinary code, deep nesting, long chains and long lines."""
    unit = "export const v%d = (a: number): any => { return f(a as T, { x: [1, 2] }) }\ninterface I%d { a: string; b?: Foo<Bar> }\n"
    for text in ("".join(unit % (i, i) for i in range(9000)), "a(" * 30000 + ")" * 30000, "x" + ".a()" * 2000, "[" * 50000, "const a = " + "1 + " * 200000 + "1", "<A>" * 20000, "`${" * 20000, "a<" * 50000, "let x: any\n" * 50000):
        started = time.time()
        found = outline.nodes(text)
        assert time.time() - started < 12 and sum(len(n["text"]) for n in found) < 3 * len(text) + 5_000_000


def test_random_texts_do_not_crash():
    rng = random.Random(3)
    parts = ["a", "(", ")", "{", "}", "[", "]", "<", ">", "=", "=>", " as ", ": any", "`", "${", "'", '"', "/", "//", "\n", ";", ",", "const ", "function ", "class ", "interface ", "import ", "export ", "type ", "new ", "return ", ".", "?.", "!", "<p>", "</p>", "/>", "case "]
    for _ in range(3000):
        outline.nodes("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))))


def test_readers_take_few_steps_for_a_file():
    """Calls made while a file is read: 1,680 and 1,280 while every token took several calls and every letter of a statement a step."""
    lines = [f'import {{ v{i}, T{i} }} from "@/b{i}/p{i}"' for i in range(2)] + ["import { x } from 'pkg-4'", "export const v3 = 4", "export interface T3 {", "  m0: T0", "  m1: T1", "}", "export function f3(x: any) {", "  return v3 as number", "}", "const y3 = x", "const text = 'y as any'"]
    text = "\n".join(lines)

    def calls(read) -> int:
        profile = cProfile.Profile()
        profile.runcall(read, text, False)
        return sum(x.callcount for x in profile.getstats())

    assert len(outline.nodes(text, False)) == 13
    assert calls(outline.nodes) < 1200
    assert calls(names.Names) < 1050
