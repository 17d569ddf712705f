"""Imports and declarations of files of many shapes, and that reading takes time in proportion to a file."""

import time

import pytest
from lodestone.operators import imports, structure
from lodestone.operators.lexer import python_imports, script_imports
from pyspark.sql import functions as F

SCRIPTS = {
    "const a = ['lib/*.js']; const k = require('./kept'); const b = 'test/**/*.js';": ["./kept"],
    "import q from './yes' // import z from './comment'\nconst s = \"import q from './no'\"; x.require('no'); require.resolve('n'); import('./dyn'); export * from './n'": ["./yes"],
    "import type { A, B as C } from \"./t\";\nimport d, * as e from './e';import './side';import f = require('./f');": ["./t", "./e", "./side", "./f"],
    "const t = `${require('./in')} ${`a${b}`} import x from './no'`; const r = /[/'\"]require('no')/.test(a / b); /* import './x' */ require(\"./last\")": ["./in", "./last"],
    "if (a / b) { c = d / e } require('./div')": ["./div"],
    "import './open\nrequire('./next')": ["./next"],
    "import x from '': require(''); require(y + './tail')": ["./tail"],
    "/* never closed require('./no')": [],
}
MARKUP = {
    "export default function A() { return (<div className='x' a={require('./img')}>Don't {cond ? 'a' : \"it's\"} <B/> // import './no'\n</div>); }\nconst z = require('./after');": ["./img", "./after"],
    "const f = <T,>(a: T) => a; const z = require('./a'); const g = <T extends {}>(x: T) => x; if (a < b) { require('./b') } type H = <T>(x: T) => void; require('./c')": ["./a", "./b", "./c"],
    "const a = <><p title=\"'\">it's</p>{/* ' */}</>; require('./a')": ["./a"],
}
PYTHON = {
    "foo(); import q\nimport os, a.b as c, d": ["q", "os", "a.b", "d"],
    "from . import z\nfrom .m import (a,\n  b)\nfrom.n import k\nfrom .. .o import k": [".", ".m", ".n", "...o"],
    "s = 'import no'\nt = '''\nimport no2\n'''\nu = f\"{x['import n']}\"\nif x: import y\ntry:\n    from ..k.l import m\nexcept: pass\n# import gone": ["y", "..k.l"],
    "import u\\\n, v\nraise E from x\ndef g():\n  yield from y\nimported = 3\nfrom a.b import c # import z": ["u", "v", "a.b"],
    "x = [\nimport broken\nfrom a import b": ["broken", "a"],
    "'it''s'; import a; \"\"\"open\nimport no": ["a"],
    "d = {'a': import_x, 'b': 1}\nclass A: import b\nlambda x: from_y": ["b"],
}


def test_imports_of_all_shapes():
    for t, want in SCRIPTS.items():
        assert script_imports(t) == want, t
    for t, want in MARKUP.items():
        assert script_imports(t, True) == want, t
    for t, want in PYTHON.items():
        assert python_imports(t) == want, t


SHAPES = """import x from 'y'
export function h<T extends { a: number }>(x: Array<T>): Map<string, { b: T }> {
  return x
}
function k(a = f(1), { b } = { b: 2 }) { return 1 }
const r = /[{]/, t = `a ${`{${b}`} {`;
function after() {}
@Injectable({ scope: '{' })
export class S<T> extends B<T>(mix()) implements I<T>, J {
  n: number = 1
  private readonly m: Map<string, () => void> = new Map()
  handler = async (e) => {
    function inner() { return 1 }
  }
  #p = 1;
  static { init() }
  constructor(@Inject() private a: string = g(), readonly q?: T) { super() }
  @Get(':id')
  async get<K>(k: K): Promise<{ a: K }> { if (k) { return x } }
  static async *gen() { yield 1 }
  [Symbol.iterator]() { return 1 }
  get value(): string { return 'x' }
  #secret() { }
  over(a: string): void;
  over(a: any): void { }
  last() {}
}
export abstract class Abs { abstract f(): void; go() { } }
class Empty<T> { a: string; b = { c: 1 } }
const o = { run(a) { return 1 }, async go() { }, x: 1 }
const fe = function named() { return 1 }
declare function d(a: string): void;
export default async function main() { if (a) { b(c) } }
"""


def test_declarations_of_all_shapes():
    method = lambda n, *at: ("method", f"S.{n}", *at)
    assert structure.of_script(SHAPES, False) == [
        ("function", "h", 2, 4), ("function", "k", 5, 5), ("function", "after", 7, 7), method("inner", 13, 13), method("constructor", 17, 17), method("get", 19, 19), method("gen", 20, 20),
        method("[Symbol.iterator]", 21, 21), method("value", 22, 22), method("#secret", 23, 23), method("over", 25, 25), method("last", 26, 26), ("method", "Abs.go", 28, 28), ("class", "Empty", 29, 29),
        ("function", "run", 30, 30), ("function", "go", 30, 30), ("function", "main", 33, 33),
    ]
    jsx = "export function App({ a }) {\n  const s = a < 3 && b > 2\n  return <div onClick={() => { f('}') }}>Don't {s ? <b>it's</b> : null} {\"{\"}</div>\n}\nfunction B() { return <><App a=\"{\" /></> }\n"
    assert structure.of_script(jsx) == [("function", "App", 1, 4), ("function", "B", 5, 5)]
    py = "if x:\n    def f():\n        pass\nelse:\n    class A:\n        class B:\n            y = 1\n        @d\n        def m(self): pass\nclass C:\n    class D: pass\ntry:\n    pass\nexcept E:\n    async def h(): pass"
    assert structure.of_python(py) == [("function", "f", 2, 3), ("class", "B", 6, 7), ("method", "A.m", 8, 9), ("class", "C", 10, 11), ("function", "h", 15, 15)]
    for broken in ("function f() {", "}", "class A { m( }", "( ]"):
        with pytest.raises(ValueError, match="brackets"):
            structure.of_script(broken)


RUNS = ["#", "class a ", "function a ", "function a(): ", "/* ", "'", "\\'", "`${", "<a ", "/ [", "import ", "require(", "{", "function a<", "class a<b ", "class A { m() {} } ", "import 'a' ", "{a(b): ", "from ", '"""', "import a\n"]


@pytest.mark.parametrize("unit", RUNS)
def test_long_runs_take_linear_time(unit):
    def read(n):
        text, start = unit * (n // len(unit)), time.process_time()
        script_imports(text, True)
        python_imports(text)
        try:
            structure.of_script(text)
        except (ValueError, RecursionError):
            pass
        return time.process_time() - start

    read(1_000)
    few, many = read(30_000), read(240_000)
    assert many < 8 * 4 * max(few, 0.02), (few, many)


def test_files_keep_the_order_of_imports(spark):
    x = spark.createDataFrame([("r", "a.py", "from b import c\nimport d\nfrom e import f"), ("r", "b.tsx", "const a = <p>it's</p>; require('./x'); import y from './y'"), ("r", "c.py", ""), ("r", "d.ts", "}")], "repository_id string, path string, content string")
    got = imports.specifiers(x).orderBy("path", "ordinal").select("path", "specifier").collect()
    assert [tuple(r) for r in got] == [("a.py", "b"), ("a.py", "d"), ("a.py", "e"), ("b.tsx", "./x"), ("b.tsx", "./y")]
    assert structure.chunks(x).filter(F.col("path") == "d.ts").select("kind").first()[0] == "window"
