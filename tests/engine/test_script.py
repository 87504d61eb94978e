"""Tokens of scripts, what is read off them, and structural patterns, against expectations made by hand or by rule."""

import random
import re
import time

import pytest

from quarryline import code_queries
from quarryline.functions import pattern as patterns
from quarryline.functions import script
from quarryline.operators import link, parse, search

CODE = """#!/usr/bin/env node
import d, {a as b, type T, c} from "./x";
import * as ns from 'y';
import type {Q} from "./q";
import "side";
export * from "./all"; export {u as v, w} from "./re";
const re = /[/"'`]\\/(/g, q = a / b / c;
// function no() {}
/* class No {} */
export async function f<T extends {a: number}>(a: string, b = {x: 1}): Promise<{ok: boolean}> {
  if (a) /}/.test(a);
  return g(`x ${h(a, `${i(1)}`)} }`) ;
}
function over(a: string): void;
function local() { return class Inner extends Base {} }
export const arrow = async (x: number): Promise<void> => {
  await this.a.b(x)
    .then(y => z(y))
    .catch(() => {});
}, second = x => x +
  1, third = 3
export default class Foo<T> extends mixin({a: 1}) implements Bar {
  x = make()
  y = 1
  constructor(private z: number) { super(z); this.#p(); a!.b(); }
  async method<T>(a: T): Promise<void> { foo<T>(a); new Thing(x).go(); o["k"](); o[k](); p?.q?.(1) }
  get v() { return super.v() }
  static s = () => { return 1 }
}
const obj = { m() { return n() }, async k() {}, f: function () { inner() }, g: (a) => b(a) };
interface I { foo(a: number): void; bar: () => void }
type Fn = { call(x: number): string };
let t: (a: number) => void = function named(a) { }
export { local };
const el = cond ? 1 : 2
var iife = function () { }()
import("lazy").then(x => x)
label: for (const a of b) { if (x) continue; }
"""
MARKUP = """export function App() {
  const x = <div className="a>b" onClick={() => go({a: 1})}>don't {items.map(i => <Item key={i}/>)} <></> it's</div>;
  return (
    <p>hello {name(1)} function no() </p>
  );
}
function Other() { return a < b && c > d }
const generic = <T,>(x: T) => x;
"""


def test_symbols():
    code = script.lex(CODE, False)
    assert script.symbols(code) == [["f", "FUNCTION", 10, 13, True], ["local", "FUNCTION", 15, 15, True], ["Inner", "CLASS", 15, 15, False], ["arrow", "FUNCTION", 16, 20, True], ["second", "FUNCTION", 20, 21, True], ["Foo", "CLASS", 22, 29, True], ["t", "FUNCTION", 33, 33, False]]
    assert script.imports(code, False) == [("./x", ["a", "T", "c"]), ("y", []), ("./q", ["Q"]), ("side", []), ("./all", ["*"]), ("./re", ["v", "w"])]
    assert script.calls(code, False) == [
        ("test", 11), ("g", 12), ("h", 12), ("i", 12), ("catch", 17), ("then", 17), ("a.b", 17), ("z", 18), ("mixin", 22), ("make", 23), ("super", 25), ("b", 25), ("foo", 26), ("go", 26), ("o.", 26), ("o.k", 26), ("p.q", 26), ("super.v", 27), ("n", 30), ("inner", 30), ("b", 30), ("then", 37),
    ]


def test_plain_scripts():
    code = script.lex("const a = require('./a'), b = new Foo(); class X extends Y { m() { super.m(); super(1) } }\nexport default function () { a.go() }\nvar c = async function* (x) { x() };", True)
    assert script.imports(code, True) == [("./a", ["*"])] and script.calls(code, True) == [("m", 1), ("a.go", 2), ("x", 3)]
    assert script.symbols(code) == [["X", "CLASS", 1, 1, False], ["anonymous", "FUNCTION", 2, 2, True], ["c", "FUNCTION", 3, 3, False]]


def test_markup():
    code = script.lex(MARKUP, True)
    assert script.symbols(code) == [["App", "FUNCTION", 1, 6, True], ["Other", "FUNCTION", 7, 7, False], ["generic", "FUNCTION", 8, 8, False]]
    assert script.calls(code, True) == [("go", 2), ("items.map", 2), ("name", 4)]


@pytest.mark.parametrize("broken", ["a(", '"x', "`${a", "/* x", "a)}", "let x = 'don't'", "/re", "<a>"])
def test_broken_scripts_are_told(broken):
    with pytest.raises(script.NotLexed):
        script.lex(broken, True)


@pytest.mark.parametrize("source", ["a" + ".b()" * 20_000, "(" * 50_000 + ")" * 50_000, "x<" * 20_000, "f(" * 5000 + ")" * 5000, "`${" * 5000 + "}`" * 5000, "const a=1," * 20_000 + "b=2", "if(x)" * 20_000, "export {" + "a," * 20_000 + "}", "function " * 20_000, "class " * 20_000, "interface A " * 10_000, "type A = " * 5000, "(a)=>" * 10_000, "a\n" * 30_000, "", "\n\n"], ids=lambda s: s[:10])
def test_cost_grows_with_length(source):
    began = time.perf_counter()
    code = script.lex(source, False)
    script.symbols(code), script.imports(code, False), script.calls(code, False)
    assert time.perf_counter() - began < 20


def test_random_scripts(spark):
    """Scripts put together from declarations of known extent, with brackets and keywords in strings, comments, templates and regular expressions between them."""
    r = random.Random(2)
    noise = ["// }} function no() {", "/* class No { */", 's = "function no() {";', "t = `a ${g0('}')} ) }`;", "u = /[}(]\\/{/g;", "v = w / 2 / x;", "if (a) { b = {c: [1, 2]} }", "while (k) g0(k);", "x = {m() { return 1 }}", "y = (z) => ({z})"]
    files, expected, called = [], [], []
    for n in range(40):
        out, symbols = [], []
        said = lambda depth, out=out: out.extend("  " * depth + r.choice(noise) for _ in range(r.randint(0, 14)))

        def declare(depth, n=n, out=out, symbols=symbols, said=said):
            name, kind, exported = f"d{len(symbols)}", r.choice(["function", "class", "arrow", "var"]), depth == 0 and r.random() < 0.4
            at = len(symbols)
            symbols.append(None)
            first = len(out) + 1
            head = {"function": f"function {name}(a, {{b}} = {{}}) {{", "class": f"class {name} extends B {{ m(a) {{", "arrow": f"const {name} = async (a: {{x: number}}): Promise<void> => {{", "var": f"var {name} = function (a) {{"}[kind]
            out.append("  " * depth + ("export " if exported else "") + head)
            said(depth + 1)
            if depth < 3 and r.random() < 0.6:
                declare(depth + 1)
            if r.random() < 0.5:
                out.append(f"  h{n}.call{at}(a,\n    b)")
                called.append((f"f{n}.ts", f"h{n}.call{at}", len(out)))
                out.extend(out.pop().split("\n"))
            said(depth + 1)
            out.append("  " * depth + ("}}" if kind == "class" else "}"))
            symbols[at] = (f"f{n}.ts", name, "CLASS" if kind == "class" else "FUNCTION", first, len(out), exported)

        for _ in range(r.randint(1, 4)):
            said(0)
            declare(0)
        files.append((f"f{n}.ts", "\n".join(out)))
        expected += symbols
    df = spark.createDataFrame(files, "file_path string, content string")
    told = parse.symbols(df)
    assert sorted((x.file_path, x.name, x.kind, x.start_line, x.end_line, x.is_exported) for x in told.collect()) == sorted(expected)
    assert sorted((x.file_path, x.callee, x.line) for x in parse.calls(df).collect() if x.callee.startswith("h")) == sorted(called)
    inner = lambda path, line: max((s[3], -s[4], s[1]) for s in expected if s[0] == path and s[3] <= line <= s[4])
    spans = {(s[0], s[1]): s for s in expected}
    for c in link.callers(parse.calls(df), told).where("callee LIKE 'h%'").collect():
        s = spans[(c.file_path, c.src.partition("#")[2])]
        assert s[3] <= c.line <= s[4] and inner(c.file_path, c.line)


def test_scripts_that_are_no_code(spark):
    """What can't be lexed is read by line patterns, null and empty files hold nothing."""
    rows = [("a.ts", "export function f() {\n  return 'don't }\n"), ("b.ts", None), ("c.js", ""), ("d.py", "def g(a):\n  return h(a)\n"), ("e.ts", "import x from 'y'\nconst k = (\n")]
    df = spark.createDataFrame(rows, "file_path string, content string")
    assert sorted((r.symbol_id, r.start_line) for r in parse.symbols(df).collect()) == [("a.ts#f", 1), ("d.py#g", 1)]
    assert [(r.file_path, r.specifier) for r in parse.imports(df).collect()] == [("e.ts", "y")]
    assert {r.callee for r in parse.calls(df).collect()} >= {"h"}
    assert parse.symbols(df.limit(0)).count() == parse.calls(df.limit(0)).count() == 0


def test_callers_of_documents_lexed_once(spark, tmp_path):
    """The query reads what lexing told from a table, however often it needs it; odd characters keep their places, equal names and missing texts too."""
    texts = ["".join(map(chr, range(1, 128))) + "é名\U0001f468\u200d\u2028Ⅳª٣ſ\ufeff\nif (x) {\n", None, "", "\n\n", "`${ \r\n'\" */ f(a)"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = {r.file_path: r.content for r in code_queries.scripts(spark, str(tmp_path)).collect()}
    assert {p: c.split("\n")[2:-8] for p, c in held.items()} == {f"src/d{k}.ts": ["  // " + x for x in re.sub(r"""[^a-zA-Z0-9 {(`'"/\n]""", "_", t or "").split("\n")] for k, t in enumerate(texts)}
    told = code_queries.parsed_callers(spark, str(tmp_path))
    expected = []
    for k, t in enumerate(texts):
        f, n = f"src/d{k}.ts", (t or "").count("\n") + 1
        expected += [(f, f"g{k % 5}", n + 3, f"{f}#f{k}"), (f, "h", n + 3, f"{f}#f{k}"), (f, "n.p", n + 5, f"{f}#z"), (f, "super.s", n + 7, f"{f}#C{k % 3}"), (f, "pair", n + 8, f), (f, "pair", n + 9, f)]
    assert sorted(map(tuple, told.collect())) == sorted(expected)
    assert "MapInArrow" not in told._jdf.queryExecution().executedPlan().toString()


# Patterns -----------------------------------------------------------------------------------------------------------

PLACES = """f(a, a);
f(a, b); // f(c, c)
f(
  x.y(1),
  x . y ( 1 ) );
const s = "f(d, d)", t = `f(e, e) ${f(g, g)}`;
function f(a, a) {}
q.f(a, a);
console.log("x", f(f(1, 1), f(1, 1)));
x = y + 1;
this.a.b.c(2)
if (k) { total = total + 1 }
class A { f(a, a) { return f(z[0], z[0]) } }
async function go() { await fetch(u, {m: 'GET'}) }
"""


@pytest.mark.parametrize(
    ("pattern", "lines"),
    [
        ("f($A, $A)", [1, 3, 6, 9, 9, 9, 13]), ("f($A, $B)", [1, 2, 3, 6, 9, 9, 9, 13]), ("$A = $A + 1", [12]), ("console.log($$$ARGS)", [9]), ("$X.c($...)", [11]), ("fetch($U, $_)", [14]), ('fetch($U, {m: "GET"})', [14]),
        ("if ($C) { $$$B }", [12]), ("await $E", [14]), ("f($A, $...)", [1, 2, 3, 6, 9, 9, 9, 13]), ("f(a, a)", [1]), ("f()", []), ("$X = y + 1;", [10]),
    ],
)
def test_patterns(pattern, lines):
    assert [m[1] for m in patterns.matches(script.lex(PLACES, False), patterns.compiled(pattern))] == lines


def test_pattern_captures():
    (one,) = patterns.matches(script.lex("g(1);\nx.y.f(a + b,\n [c, d], e)", False), patterns.compiled("$X.f($A, $$$REST)"))
    assert one == (6, 2, 3, "x.y.f(a + b,\n [c, d], e)", {"X": "x.y", "A": "a + b", "REST": "[c, d], e"})
    for bad in ("$A", "$...", "", "f("):
        with pytest.raises(script.NotLexed):
            patterns.compiled(bad)


def test_patterns_against_brute_force():
    """Random calls with equal and unequal arguments; arguments are told apart by what they were made of."""
    r = random.Random(6)
    argument = lambda depth: r.choice(["a", "b", "1", "a.b", "a + 1", "'x, y'", "[1, 2]", "g(a, b)"]) if depth > 1 or r.random() < 0.6 else call(depth + 1)
    equal = []
    space = lambda: r.choice(["", " ", "\n ", "/* f(a, a) */", "// f(b, b)\n"])

    def call(depth):
        one = argument(depth)
        other = one if r.random() < 0.5 else argument(depth)
        if "".join(one.split()) == "".join(other.split()) or one == other:
            equal.append(1)
        return f"f({one}, {other})"

    for _ in range(200):
        equal.clear()
        inner = [call(0) for _ in range(4)]
        if any(c.count("f(") > 1 for c in inner):  # arguments that are calls are written twice when they are equal
            continue
        text = "".join(f"{space()}{c.replace(', ', ',' + space()) if chr(39) not in c and '[' not in c and 'g(' not in c else c};{space()}" for c in inner)
        assert len(patterns.matches(script.lex(text, False), patterns.compiled("f($A, $A)"))) == len(equal), text


def test_structural_search(spark):
    files = spark.createDataFrame([("a.ts", PLACES), ("b.ts", "f(a, a"), ("c.py", "f(a, a)\n# x\n"), ("d.ts", None), ("e.jsx", "const x = <p>f(a, a) {f(b,\n b)}</p>")], "file_path string, content string")
    told = search.structural(files, "f($A, $A)").collect()
    assert sorted((r.file_path, r.start_line, r.end_line, r.captures["A"]) for r in told) == [("a.ts", 1, 1, "a"), ("a.ts", 3, 5, "x.y(1)"), ("a.ts", 6, 6, "g"), ("a.ts", 9, 9, "1"), ("a.ts", 9, 9, "1"), ("a.ts", 9, 9, "f(1, 1)"), ("a.ts", 13, 13, "z[0]"), ("e.jsx", 1, 2, "b")]
    from quarryline.operators import chunks

    windows = chunks.chunks(files.where("content IS NOT NULL"))
    found = search.search(windows, search.terms(windows), "", pattern="f($A, $A)", files=files, limit=50).collect()
    assert sorted((r.file_path, r.start_line) for r in found) == [("a.ts", 1), ("a.ts", 3), ("a.ts", 6), ("a.ts", 9), ("a.ts", 9), ("a.ts", 9), ("a.ts", 13), ("c.py", 1), ("e.jsx", 1)]
    best = search.search(windows, search.terms(windows), "total", pattern="$A = $A + 1", files=files).collect()
    assert [(r.file_path, r.start_line, r.content) for r in best] == [("a.ts", 12, "total = total + 1")]
