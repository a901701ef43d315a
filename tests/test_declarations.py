"""The lexer and the declarations of source files, by hand."""

import pytest

from corpusloom.functions import lexer as L
from corpusloom.operators import declarations as D

JAVA = """package a;
import java.util.List;
/* class Not { } */
@RestController
@RequestMapping("/x{id}")
public class A extends b.Base<T> implements I, J<K, V> {
  private String s = "}{"; // }
  @Override
  public List<String> find(String a, Map<K, V> m) throws E {
    if (a != null && m.isEmpty()) { for (int i = 0; i < 3; i++) { helper(i); } }
    return null;
  }
  class Inner { void go() { other.run(); } }
}
interface I extends X, Y { }
"""
TS = """import x from './y';
export class C extends D implements E {
  private a = `t ${ f({a: 1}) } }`;
  async run(a, b = g(1)): Promise<void> {
    if (a) { return a / 2 / b; }
    const r = /[{]"/.test(a);
  }
}
interface E { n: number }
export const go = async (z) => { while (z) { z--; } };
const one = y => y + 1;
function* gen() { yield "}" }
"""
PY = '''import os, sys as s
from a.b import c
class A(B, metaclass=M):
    """doc { def no(): """
    @app.route("/x")
    def f(self, a: int = (1, 2), *args) -> str:
        if a and self.g():
            for x in [1,
2]:
                h(x)
        return "# }"

    # comment
    async def g(self):
        def inner():
            pass
        return inner()  # end
x = 1
def top(): return 1
'''
FILES = [("A.java", JAVA, "java"), ("c.ts", TS, "typescript"), ("a.py", PY, "python"), ("n", None, "java"), ("o", "class X { }", "go"), ("e", "", "python"), ("u", "class U { void f() { if (a) {", "java")]


def kinds(text, language):
    return "".join(".cs"[k] for k in L.kinds(text, language))


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("java", 'a "b\\"c" // d', "..ssssss.cccc"), ("java", "'x' /* \" */ y", "sss.ccccccc.."), ("java", '"open\nx', "sssss.."), ("java", '"""a"b\n"""c', "ssssssssss."[:10] + "."),
        ("javascript", "`a${b + `c`}d` e", "ssss....sss.ss"[:4] + "....sss" + "sss" + ".."), ("javascript", "`${ {a: 1} }`", "sss........ss"), ("javascript", "a / b / c", "........."), ("javascript", "x = /a'/g;", "....sssss."), ("javascript", "/* open", "ccccccc"),
        ("python", "x = '# no' # yes", "....ssssss.ccccc"), ("python", "'''a\n'b'\n''' c", "ssssssssssss.."), ("python", "", ""),
    ],
)
def test_kinds(language, text, want):
    assert kinds(text, language) == want


def test_cleaned(spark):
    df = spark.createDataFrame([("x", t, lang) for _, t, lang in FILES], "z string, t string, lang string")
    got = [r["t"] for r in D.cleaned(df, "t", "lang").collect()]
    assert '"}{";' in got[0] and "//" not in got[0] and "class Not" not in got[0] and got[0].count("\n") == JAVA.strip().count("\n") - 1
    assert '"# }"' in got[2] and "comment" not in got[2] and "doc" not in got[2] and "return inner()\nx = 1" in got[2]
    assert got[1] == TS.strip() and got[3:6] == [None, "class X { }", ""]
    assert L.without_comments("url = 'http://x' // y\n/* a\nb */\nz", "javascript") == "url = 'http://x'\nz"


def test_declarations(spark):
    df = spark.createDataFrame(FILES, "f string, t string, lang string")
    got = D.declarations(df, "f", "t", "lang")
    rows = {(r["f"], r["kind"], r["name"]): r for r in got.collect()}
    short = {k: (r["parent"], r["level"], r["start_line"], r["end_line"], r["complexity"], r["own_complexity"], r["cognitive"]) for k, r in rows.items()}
    assert short == {
        ("A.java", "class", "A"): (None, 0, 6, 14, 4, 1, 0), ("A.java", "method", "find"): ("A", 1, 9, 12, 4, 4, 4), ("A.java", "class", "Inner"): ("A", 1, 13, 13, 1, 1, 0),
        ("A.java", "method", "go"): ("Inner", 2, 13, 13, 1, 1, 0), ("A.java", "interface", "I"): (None, 0, 15, 15, 1, 1, 0),
        ("c.ts", "class", "C"): (None, 0, 2, 8, 2, 1, 0), ("c.ts", "method", "run"): ("C", 1, 4, 7, 2, 2, 1), ("c.ts", "interface", "E"): (None, 0, 9, 9, 1, 1, 0),
        ("c.ts", "function", "go"): (None, 0, 10, 10, 2, 2, 1), ("c.ts", "function", "one"): (None, 0, 11, 11, 1, 1, 0), ("c.ts", "function", "gen"): (None, 0, 12, 12, 1, 1, 0),
        ("a.py", "class", "A"): (None, 0, 3, 17, 4, 1, 0), ("a.py", "method", "f"): ("A", 1, 6, 11, 4, 4, 4), ("a.py", "method", "g"): ("A", 1, 14, 17, 1, 1, 0),
        ("a.py", "function", "inner"): ("g", 2, 15, 16, 1, 1, 0), ("a.py", "function", "top"): (None, 0, 19, 19, 1, 1, 0),
        ("u", "class", "U"): (None, 0, 1, 1, 2, 1, 0), ("u", "method", "f"): ("U", 1, 1, 1, 2, 2, 1),
    }
    find = rows["A.java", "method", "find"]
    assert find["parameters"] == ["String a", "Map<K, V> m"] and find["result"] == "List<String>" and find["annotations"] == ["Override"] and find["calls"] == ["helper", "isEmpty"]
    assert rows["A.java", "class", "A"]["annotations"] == ["RestController", "RequestMapping"] and rows["A.java", "class", "A"]["implements"] == ["I", "J<K, V>"]
    assert rows["a.py", "class", "A"]["extends"] == ["B"] and rows["a.py", "method", "f"]["annotations"] == ["app.route"] and rows["a.py", "method", "f"]["parameters"] == ["self", "a: int = (1, 2)", "*args"]
    assert JAVA[find["begin"] : find["end"]].startswith("public List") and JAVA[find["begin"] : find["end"]].endswith("return null;\n  }")
    edges = {(r["f"], r["source"], r["target"], r["relation"]) for r in D.relationships(got, "f").collect()}
    assert edges == {
        ("A.java", "A", "Base", "extends"), ("A.java", "A", "I", "implements"), ("A.java", "A", "J", "implements"), ("A.java", "I", "X", "extends"), ("A.java", "I", "Y", "extends"), ("A.java", "go", "run", "calls"),
        ("c.ts", "C", "D", "extends"), ("c.ts", "C", "E", "implements"), ("c.ts", "run", "g", "calls"), ("a.py", "A", "B", "extends"), ("a.py", "f", "g", "calls"), ("a.py", "g", "inner", "calls"),
    }
    modules = {(r["f"], r["module"]) for r in D.imports(df, "f", "t", "lang").collect()}
    assert modules == {("A.java", "java.util.List"), ("c.ts", "./y"), ("a.py", "os"), ("a.py", "sys"), ("a.py", "a.b")}


def test_measures(spark):
    df = spark.createDataFrame([("a", "int f(int a) { if (a > 1 && b) { return a + 1; } } // if", "java"), ("b", "", "python"), ("c", None, "java")], "f string, t string, lang string")
    got = {r["f"]: r for r in D.file_measures(df, "f", "t", "lang").collect()}
    # operators > && +; operands int f int a a b a (if and return are words of the language)
    a = got["a"]
    assert (a["cyclomatic"], a["deepest"], a["vocabulary"], a["length"], a["difficulty"], a["comment_chars"]) == (3, 2, 7, 10, 3 / 2 * 7 / 4, 5)
    assert a["effort"] == a["difficulty"] * 10 and set(got) == {"a", "b"} and got["b"]["cyclomatic"] == 1


def test_long_files():
    text = "class A { int f() { return 1; } }\n" * 3000
    rows = D.file_declarations(text, "java")
    assert len(rows) == 6000 and rows[-1][3:6] == (1, 3000, 3000)
