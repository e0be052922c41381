import ast
import random
import sys

import pytest

from arbor.llm.parsing import invalid_files, parse_report, rates
from arbor.llm.syntax.check import decode, language, syntax_errors

VALID = {
    "python": ["", "\ufeffx = 1\n", "async def f(*, a: int = 1, **k) -> x:\n    async with a as b, c: pass\n    return [y async for y in z if y]\n", "match x:\n    case {'a': 1 as b, **r} | [1, *_]:\n        pass\n    case _:\n        pass\nmatch = case = 1\nprint(match)\n",
               "if x:\n\ty = (1,\n  2)\nelse: pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    pass\nfinally:\n    pass\n", "@a.b(c)\nclass A(B, metaclass=M): x: int = 1; y = lambda *a, b=1: (yield)\n", "f'{a!r:>{w}} {{}}' 'x'\nx = a if b else c\n*a, b = c\nprint(*a, **b, c=1)\nx[1:2, ::3] = y\n",
               "def f[T](x): return x\ntype X = int\n", "x = 0xFF + 1_000 + 1e5j + .5\n", "f'{x['a']}'\n"],
    "c": ["", "int main(void) { return 0; }", "typedef int (*cb)(void *, size_t);\nenum { A, B = 2, };\nstatic const char *a[] = { \"x\" \"y\", [3] = \"z\" };", "#if A\nint f() {\n#else\nint f(int x) {\n#endif\n  return (foo_t *)x->y[1] ? sizeof(int) : (char)~1;\n}\n", "void f(x) int x; { for (int i = 0; i < 3; i++) do { x--; } while (x); switch (x) { case 1: break; default: goto end; } end: ; }", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(int a, ...);\n#ifdef __cplusplus\n}\n#endif\n", "struct s { int a : 3; union { int b; }; } x = { .a = 1 };", "__BEGIN\nextern int f(const char *a) __THROW __nonnull((1));\nEXPORT(int) g(FILE *x);\nint WINAPI h(void) { if (a) b; if (a) b; else c; }\n"],
    "java": ["package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<G<H>> implements I { int[] a = new int[]{1, 2}, b; C() throws E { this(1); } <U> List<U> f(final U... x) { for (var y : x) { if (y instanceof String s && s.isEmpty()) continue; } return a -> b.c(D::new); } }",
             "enum A implements B { X(1) { int f() { return 1; } }, Y; int z; }\ninterface I { default int f() { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }\nrecord P(int a, String b) { P { } }", "class A { static { x >>>= 2; int y = a < b ? c : d >> 1; try (var r = f()) { } catch (E | F e) { } finally { } synchronized (this) { } L: while (true) break L; } }", 'class A { String s = """\n  text "quoted"\n  """; char c = \'\\u0041\'; }'],
    "javascript": ["", "#!/usr/bin/env node\nconst {a, b: [c = 1], ...d} = e\nlet f = async ({x}) => { await x }\nclass A extends B { #p = 1; static async *g() { yield* 1 } get x() { return this.#p } }", "a = b\n++c\nfor (const [k, v] of Object.entries(x)) if (k in v) continue; else break", "x = /[/]\\//g.test(y) / 2; t`a${`b${c}`}d`; a?.b?.[c]?.(d) ?? 1 ** 2", "do x++; while (x < 3) label: for (;;) { break label }\nswitch (x) { case 1: default: }\nvar async = 1, of = 2, get = {get a() { return 1 }, set b(v) {}, async c() {}, *d() {}, [e]: 1}", "!function(){var a={b:!0};return a}()", "try { throw 1 } catch { } finally { }\nnew Foo\nnew a.b(c).d", "x = a?.5:1", "if (a) b;\nif (a) b; else c;\nwhile (x) if (a) b;\nwhile (x) if (a) b; else c;"],
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K, V]) f(a int, b ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v.(int) > 1 {\n\t\treturn v, nil\n\t} else if x := (T{1, 2}); x.a == 1 {\n\t}\n\tfor i := range b {\n\t\tgo func() { c <- i }()\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\tdefault:\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t\tbreak\n\t}\n\treturn\n}\n", "package a\nvar m = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\t~int | string\n\tF(x int) error\n}\n"],
}
INVALID = {
    "python": ["def f(:\n", "if x\n    y\n", "print 'a'\n", "x = (1,\n", "  x = 1\n", "if x:\ny\n", "'abc\n", "<<<<<<< HEAD\nx\n", "else:\n    x\n", "try:\n    x\ny\n", "1 = x\n", "f(a=1, b)\n", "x = 1abc\n", "@a\nx = 1\n", "return x y\n", "if a:\n    b\n  c\n", '"""abc\n', "x = 5 +\n", "class A\n    pass\n", "for x in y: z\n  w\n"],
    "c": ["int f( {", "int f() { return 1", "int f() { a = ; }", "package a\nimport \"b\"", "int f() { if (a === 3) {} }", "class A { public: int x; };", "int f() { x = \"abc; }", "int a = 3", "=======\n", "# a comment\nx", "}", "int f() { else x(); }"],
    "java": ["class A {", "class A { int f( { } }", "class A { void f() { a b c; } }", "const a = 1;", "int main() { }", "class A { void f() { a; } }", "class A { } }", "class A { void f() { try { } } }", "package a\nclass A {}", "import java.util.List;\ndef f(): pass"],
    "javascript": ["const a;", "let a = ;", "function f( {", "import a from 'b'", "export const a = 1", "int a = 3;", "return 1", "x = 'abc", "a b", "}", "{", "<div></div>", "`abc", "class A { x y }", "for (;;", "1 = 2", "if (a { }"],
    "go": ["", "func f() {}", "package a\nfunc f() { x := }", "package a\nimport \"b\"\nfunc f() {", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}", "package a;\nclass A {}", "package a\nx := 1", "package a\nfunc f() { a b }", "package a\nvar x = \"abc\n"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid(lang):
    for text in VALID[lang]:
        assert syntax_errors(lang, text) == [], text


@pytest.mark.parametrize("lang", sorted(INVALID))
def test_invalid(lang):
    for text in INVALID[lang]:
        assert syntax_errors(lang, text), text


def test_python_agrees_with_the_standard_parser():
    import glob
    import os
    import warnings

    warnings.simplefilter("ignore")
    rng = random.Random(3)
    paths = sorted(glob.glob(os.path.dirname(ast.__file__) + "/*.py"))
    for path in rng.sample(paths, 60):
        with open(path, "rb") as f:
            text = decode(f.read())[:20_000]
        lines = text.split("\n")
        for _ in range(3):
            at = rng.randrange(len(text))
            change = rng.choice((text, text[:at], text[:at] + text[at + 1:], text[:at] + rng.choice("()[]{}:,\"'=+ \n") + text[at:], "\n".join(lines[:at % len(lines)] + lines[at % len(lines) + 1:])))
            try:
                ast.parse(change)
                valid = True
            except (SyntaxError, ValueError):
                valid = False
            assert (not syntax_errors("python", change)) == valid, (path, at)


def test_all_errors_and_first_line():
    found = syntax_errors("c", "int f() {\n  a = ;\n  b = 1;\n  c = ];\n}\nint g( {\n")
    assert [n for n, _ in found][:2] == [2, 4] and len(found) >= 3
    assert syntax_errors("go", "package a\n\nfunc f() {\n\tx := )\n}\n")[0][0] == 4
    assert syntax_errors("javascript", "a\nb\nc d\n")[0][0] == 3 and syntax_errors("python", "a\n\nb c\n")[0][0] == 3


def test_languages():
    assert [language(p) for p in ("a/b.py", "x.H", "a.tsx", ".py", "Makefile", None, "a.rs")] == ["python", "c", "javascript", None, None, None, None]


def test_tables(spark, rows):
    data = [("r/a.py", b"x = 1\n", "r"), ("r/b.py", b"x = (\n", "r"), ("r/b.py", b"x = (\n", "r"), ("r/n.py", None, "r"), ("r/e.py", b"", "r"), ("r/x.md", b"(", "r"), (None, b"x", "r"), ("q/a.c", b"int f( {", None), ("q/long.js", b"a = 1;\n" * 50_000, "q"), ("q/deep.js", b"(" * 3000, "q"), ("q/latin.c", b"/* \xe9 */ int a;", "q")]
    files = spark.createDataFrame([(p, c, r, "python") for p, c, r in data], "path string, content binary, repo string, lang string")
    assert rows(invalid_files(files)) == [("q/a.c",), ("q/deep.js",), ("r/b.py",)]
    assert ("r", "python", 3, 1, 0.333333) in rows(rates(files)) and (None, "c", 1, 1, 1.0) in rows(rates(files))
    report = {r.path: r for r in parse_report(files).collect()}
    assert report["r/b.py"].n_errors == 1 and report["q/a.c"].first_line == 1 and report["q/long.js"].accepted
    assert rows(invalid_files(files.limit(0))) == []


def test_every_branch_of_c_is_read():
    guard = "#ifndef A_H\n#define A_H\n%s\n#endif\n"
    valid = [guard % "#ifdef A\nint f(int a) {\n#elif B\nint f(long a) {\n#else\nint f(void) {\n#endif\nreturn 1; }", guard % "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#if defined(__cplusplus)\n}\n#endif",
             "#if 0\nit doesn't ( compile\n#endif\nint x;", "#ifndef __cplusplus\ntypedef int b;\n#else\nclass A { public: A(); };\n#endif\n", "void f(void) {\n#if A\nif (x) {\n#else\n#endif\ny();\n#if A\n}\n#endif\n}\n"]
    invalid = [("#ifndef A_H\n#define A_H\nint f(void);\n", 1), ("int a;\n#if 0\nint b = ;\n", 2), ("int a;\n#ifdef __cplusplus\nint b;\n", 2), (guard % "#if A\nint a;\n#else\nint a = ;\n#endif", 6), (guard % "#if A\nint a;\n#elif B\nint b;\n#else\nint c = (1\n#endif\n;", 10),
               ("#if 0\n<<<<<<< HEAD\n#endif\nint x;", 2), ("#ifdef __cplusplus\nf(a];\n#endif\nint x;", 2), ("int a;\n#endif\n", 2), ("#if A\n#else\n#else\n#endif\n", 3), ("#if 1\nint a;\n#else\n=======\n#endif\n", 4)]
    for text in valid:
        assert syntax_errors("c", text) == [], text
    for text, line in invalid:
        assert [n for n, _ in syntax_errors("c", text)][:1] == [line], (text, syntax_errors("c", text))


def test_holes_of_strings_are_parsed():
    deep = "x"
    for _ in range(6):
        deep = "`a${{b: {c: " + deep + "}}}d`"
    for text in ["x = " + deep, "`${a}${function () { return {b: `}`} }()}` / 2", "t`${a in b}` + `\\${` + `$` + `$${1}`", "`a\n${\nb\n}\n`\nc"]:
        assert syntax_errors("javascript", text) == [], text
    for text in ["`${a +}`", "`${}`", "`${a`", "`${a b}`", "`${`${a +}`}`", "`${a} b", "`${{a}`"]:
        assert syntax_errors("javascript", text), text
    valid = ["f'{x!r:>{w}.{p}}' f\"{y=}{y = !s}\" '{'", "f'{a[\"b\"]:%Y-%m}' + rf'\\d{x}{{}}'", "f'''{\n  x\n}\n{y:{z}}'''\nz = 1", "f'{f\"{f'{1 + 1}'}\"}'", "f'{(lambda x: x)(1)} {*a, b} \\N{EM DASH} {x:=5} {a != b} {d[1:2]}'", "f'{ {1: 2}[1] }'", "def f():\n    return f'{(yield)}'", "f'{x}' 'y' f''", "f'{x,}{(yield)}'"]
    invalid = ["f'{x +}'", "f'{}'", "f\"{x\"", "f'{x!z}'", "f'}'", "f'{(x}'", "f'{a b}'", "f'{f\"{x +}\"}'", "f'{x:{y +}}'", "f'''{x\n'''\n", "f'{x = y}'"]
    for text in valid + invalid:
        try:
            ast.parse(text)
            ok = True
        except SyntaxError:
            ok = False
        assert ok == (text in valid) == (not syntax_errors("python", text)), (text, ok, syntax_errors("python", text))


def test_memory_of_shapes_knows_line_ends():
    for valid, invalid in (("throw ee;", "throw\nee;"), ("xx++;", "xx\n++;"), ("if (aa) bb\nelse cc;", "if (aa) bb else cc;")):
        for text in (valid, invalid, valid, invalid):
            assert bool(syntax_errors("javascript", text)) == (text == invalid), text


def test_deep_nesting_is_valid():
    n = 20_000
    for lang, text in (
        ("javascript", f"x = {'(' * n}1{')' * n};\n"), ("c", f"int x = {'(' * n}1{')' * n};\n"), ("java", f"class A {{ int x = {'(' * n}1{')' * n}; }}\n"),
        ("go", f"package p\n\nvar x = {'(' * n}1{')' * n}\n"), ("javascript", "{" * n + "}" * n), ("javascript", "if (a) " * n + "b();\n"),
    ):
        assert syntax_errors(lang, text) == [], (lang, text[:20])
        assert syntax_errors(lang, text[:-3])


def test_broken_files_are_found(spark):
    from arbor.llm.parsing import BROKEN, broken

    files = spark.createDataFrame([("a.py", b"def f(x):\n    return x\n"), ("a.c", b"int f(int x) {\n  return x;\n}\n")], "path string, content binary")
    got = {r.path: r.accepted for r in parse_report(broken(files).selectExpr("path", "content", "'r' as repo")).collect()}
    assert len(got) == 2 * len(BROKEN) and {p for p, ok in got.items() if ok} == {"whole/a.py", "whole/a.c"}
