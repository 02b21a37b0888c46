import time

from chunkspark.chunkers import CHUNKERS
from chunkspark.operators.chunk import parse_assets, wrap_chunks
from chunkspark.operators.graph import group_ids


def chunks(language, source):
    return CHUNKERS.get(language)(source)


def brief(language, source):
    return [(c.type, c.name, c.start_line, c.end_line) for c in chunks(language, source)]


PYTHON = '''import os

@deco(1)
@other
def f(x):
    y = 1
    "a docstring, late"
    return y

class C(Base):
    """Of C."""
    def m(self): pass

async def g(): ...
x = lambda: 0
if x:
    def hidden(): pass
'''


def test_python():
    assert brief("python", PYTHON) == [("function", "f", 2, 7), ("class", "C", 9, 11), ("function", "g", 13, 13)]
    f, c, _ = chunks("python", PYTHON)
    assert f.docstring == '"a docstring, late"' and c.docstring == '"""Of C."""' and f.content.startswith("@deco(1)") and f.content.endswith("return y")
    assert chunks("python", "def f(:\n") == [] and chunks("python", "é = 1\ndef ü(): return 'é'\n")[0].content == "def ü(): return 'é'"


CPP = '''#include <a>
#define M(x) { x
/// Adds.
/** Two. */
int add(int a, int b) { return a + "}"[0]; }

namespace n { namespace m {
// A box.
template <typename T, int N>
class Box : public Base<T> {
 public:
  void method() {}
};
struct API_EXPORT P { int x; };
enum class E { A };
void declared(int);
}}
void n::Q::run() const noexcept { if (x) { y(); } }
static const int table[] = { 1, 2 };
Q::Q() : a(1), b{2} { }
bool operator==(const P& a, const P& b) { return true; }
'''


def test_cpp():
    found = chunks("cpp", CPP)
    assert [(c.type, c.name) for c in found] == [("function", "add"), ("class", "Box"), ("class", "P"), ("function", "n::Q::run"), ("function", "Q::Q"), ("function", "operator==")]
    box = found[1]
    assert box.metadata.is_template and box.metadata.namespace == "n::m" and box.docstring == "A box."
    assert box.content.startswith("template <typename T") and box.start_line == 9 and box.end_line == 12
    assert found[0].docstring == "Adds.\nTwo."
    assert [c.name for c in chunks("cpp", "int ok() { return 1; }\nclass { broken")] == ["ok"]


TS = '''/** Doc of A. */
export class A<T> { m() { return `}${"{"}`; } }
interface I { a: string }
export type U = { a: 1 } | "b";
// plain
export async function go(x: number): Promise<void> { if (x) { y() } }
export default function () { return 1 }
const a = 1; const b = 2;
let { c, d } = z
export const arrow = async (x) => {
  return /[{"]/.test(x)
}
var old = 1;
abstract class Hidden {}
namespace N.M { export class Inner {} }
'''


def test_typescript():
    found = chunks("typescript", TS)
    assert [(c.type, c.name) for c in found] == [
        ("class", "A"), ("interface", "I"), ("type", "U"), ("function", "go"), ("function", "anonymous_function_6_15"),
        ("const", "a"), ("const", "b"), ("const", "{ c, d }"), ("const", "arrow"), ("class", "Inner"),
    ]
    assert found[0].docstring == "Doc of A." and found[0].metadata.language_specific == {"is_generic": "true"}
    assert found[3].docstring is None and found[-1].metadata.namespace == "N.M" and found[8].end_line == 11
    assert [c.name for c in chunks("typescript", "class Good {}\nclass Bad {")] == ["Good", "Bad"]


def test_typescript_below_other_constructs():
    source = """abstract class A { m() { const no = 1; } abstract n(): void; p = { q() { return 1 } }; get z(): number { return 2 } }
if (x) { const y = 1 } else { function f() {} }
describe("a", () => { let inner = 2; class K {} });
for (let i = 0; i < 3; i++) { const body = i; }
for (const e of list) { run(e) }
var o = { m() {}, k: function () { const deep = 3; } };
switch (x) { case 1: { const c = 4 } }
export default { data() { return {} } };
"""
    assert brief("typescript", source) == [
        ("function", "anonymous_function_0_19", 0, 0), ("function", "anonymous_function_0_67", 0, 0), ("function", "anonymous_function_0_87", 0, 0),
        ("const", "y", 1, 1), ("function", "f", 1, 1), ("const", "inner", 2, 2), ("class", "K", 2, 2), ("const", "i", 3, 3), ("const", "body", 3, 3),
        ("function", "anonymous_function_5_10", 5, 5), ("const", "deep", 5, 5), ("const", "c", 6, 6), ("function", "anonymous_function_7_17", 7, 7),
    ]


def test_cpp_below_other_constructs():
    source = """union U { struct P { int x; }; int y; };
class Ahead;
template <class T> class Later;
auto f = [](int a) { struct Local { int z; }; return a; };
extern "C" { struct Q { }; int g(void) { return 1; } }
enum class E { A };
struct stat buffer;
"""
    assert [(c.type, c.name) for c in chunks("cpp", source)] == [("class", "P"), ("class", "Ahead"), ("class", "Later"), ("class", "Local"), ("class", "Q"), ("function", "g"), ("class", "stat")]
    assert chunks("cpp", source)[1].content == "class Ahead" and chunks("cpp", source)[2].content == "template <class T> class Later;"


CS = '''using System;
namespace A.B {
    /// <summary>Does.</summary>
    // more
    [Attr("}")]
    public abstract partial class C<T> : D where T : new() {
        string s = @"a ""} b"; string t = $"{x}";
        class Nested {}
    }
    public interface I { int P { get; } }
    internal record R(int X, int Y);
    public struct S { public class InStruct {} }
    enum E { A, B }
}
record struct Q { }
'''


def test_csharp():
    found = chunks("csharp", CS)
    assert [(c.type, c.name) for c in found] == [("class", "C"), ("interface", "I"), ("class", "R"), ("class", "InStruct"), ("class", "Q")]
    c = found[0]
    assert c.docstring == "/// <summary>Does.</summary>\n// more" and c.metadata.namespace == "A.B"
    assert c.metadata.is_abstract and c.metadata.visibility == "public" and c.metadata.language_specific == {"kind": "class", "partial": "true"}
    assert found[2].content == "internal record R(int X, int Y);" and found[3].metadata.namespace == "A.B" and found[4].metadata.namespace is None


UNITY = '''%YAML 1.1
%TAG !u! tag:unity3d.com,2011:
--- !u!1 &1
GameObject:
  m_Name: thing
--- !u!114 &2
MonoBehaviour:
  m_Name: flow
  _data:
    _json: '{"graph": {"elements": [
      {"$type": "Unit", "$id": "1", "position": {"x": 1, "y": 1}},
      {"$type": "Unit", "$id": "2", "position": {"x": 50, "y": 1}},
      {"$type": "Unit", "$id": "3"},
      {"$type": "ControlConnection", "sourceUnit": {"$ref": "1"}, "destinationUnit": {"$ref": "2"}},
      {"$type": "ControlConnection", "sourceUnit": {"$ref": "1"}, "destinationUnit": {"$ref": "9"}}]}}'
--- !u!114 &3
MonoBehaviour:
  _data: {_json: not json}
--- !u!114 &4
MonoBehaviour:
'''


def test_unity():
    found = chunks("unity_asset", UNITY)
    assert [(c.name, c.start_line, c.end_line) for c in found] == [("", 0, 1), ("", 1, 2), ("", 2, 3)]
    assert found[0].content.count("$type") == 3 and '"$id": "3"' in found[1].content and '"$ref": "9"' in found[2].content
    assert chunks("unity_asset", "a: [1") == []


def test_unity_boxes():
    """Boxes are elements of their group, given by borders or by a corner and a size; an empty one stands alone."""
    import json

    elements = [
        {"$type": "Unit", "$id": "1", "position": {"x": 1, "y": 1}}, {"$type": "Unit", "$id": "2", "position": {"x": 9, "y": 9}},
        {"$type": "Bolt.GraphGroup", "guid": "g", "position": {"xMin": 0, "yMin": 0, "xMax": 9, "yMax": 9}},
        {"$type": "Bolt.GraphGroup", "guid": "h", "position": {"x": 50, "y": 50, "width": 5, "height": 5}},
        {"$type": "Unit", "$id": "2", "position": {"x": 5, "y": 5}, "later": True},
    ]
    text = json.dumps({"graph": {"elements": elements}})
    found = chunks("unity_asset", f"--- !u!114 &1\nMonoBehaviour:\n  _data:\n    _json: '{text}'\n".replace("--- !u!", "%TAG !u! tag:unity3d.com,2011:\n--- !u!", 1))
    assert [json.loads(c.content) for c in found] == [[elements[0], elements[4], elements[2]], [elements[3]]]


def test_boxes_are_not_transitive():
    nodes = [{"id": str(i), "x": float(i), "y": 0.0} for i in (1, 2, 3)]

    def box(a, b):
        return {"x_min": a, "x_max": b, "y_min": 0.0, "y_max": 0.0}

    assert group_ids(nodes, [box(2, 3), box(1, 2)], []) == [0, 0, 1]
    assert group_ids(nodes, [box(1, 2), box(2, 3)], []) == [0, 0, 0]
    assert group_ids(nodes, [box(2, 3), box(1, 2)], [], transitive=True) == [0, 0, 0]
    assert group_ids(nodes, [box(2, 3)], [{"start_id": "3", "end_id": "1"}, {"start_id": "1", "end_id": "8"}]) == [0, 0, 0]


def test_chunk_rows_and_ids(spark):
    rows = [("a.ts", "d", "/r/a.ts", "typescript", TS), ("bad.py", "d", "/r/bad.py", "python", "def ("), ("b.py", "d", "/r/b.py", "python", PYTHON)]
    assets = spark.createDataFrame(rows, "id string, domain_id string, file_path string, language string, source string")
    parsed = parse_assets(assets)
    found = {r.id for r in wrap_chunks(parsed).collect()}
    assert {"a.ts:7-7#5", "a.ts:7-7#6", "b.py:2-7", "b.py:9-11"} <= found and len(found) == 13


def timed(language, source):
    start = time.perf_counter()
    found = CHUNKERS.get(language)(source)
    return found, time.perf_counter() - start


def test_cpp_in_linear_time():
    lines = "".join(f"static std::vector<int> values_{i} = {{}};\n".replace(" = {}", "") for i in range(6))
    found, seconds = timed("cpp", f"/// About the globals\n{lines}int prototype(int first);\nint run(int x) {{ return x; }}\n")
    assert [c.name for c in found] == ["run"] and seconds < 1
    many = "".join(f"/// Says what part {i} does\nint part_{i}(int x) {{\n    int y = x; // twice\n    return y + {i};\n}}\n" for i in range(10_000))
    found, seconds = timed("cpp", many)
    assert len(many) > 900_000 and len(found) == 10_000 and found[77].docstring == "Says what part 77 does" and seconds < 8
    globals_ = "// first\n" + "int a = 1;\n" * 20_000 + "int last(int x) { return x; }\n"
    found, seconds = timed("cpp", globals_)
    assert found[-1].name == "last" and found[-1].docstring == "first" and seconds < 5
    deep, seconds = timed("cpp", "namespace a {\n" * 3000 + "int f() { return 1; }\n" + "}\n" * 3000)
    assert [c.name for c in deep] == ["f"] and deep[0].metadata.namespace.count("::") == 2999 and seconds < 5


def test_few_files_at_a_time():
    """Sources and chunks that a task holds don't grow with the batches that Spark sends; a long file is one slice, a null one gives no chunk."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from chunkspark.operators import chunk
    from chunkspark.schema import CODE_CHUNK

    sources = [f"class A{i} {{ }} class B{i} {{ }}" for i in range(3000)]
    sources[7], sources[1500] = None, "class Long { /* " + "x" * 3_000_000 + " */ } " + " ".join(f"class L{i} {{ }}" for i in range(2500))
    n = len(sources)
    batch = pa.record_batch([pa.array(list(map(str, range(n)))), pa.array(["d"] * n), pa.array(["p"] * n), pa.array(["csharp"] * n), pa.array(sources)], names=["id", "domain_id", "file_path", "language", "source"])
    kind = to_arrow_schema(CODE_CHUNK).append(pa.field("domain_id", pa.string()))
    slices = list(chunk._few(batch))
    assert [x for s in slices for x in s.column("id").to_pylist()] == list(map(str, range(n)))
    assert all(s.num_rows <= 256 for s in slices) and [s.num_rows for s in slices if len(s.column("source")[0].as_py() or "") > 1 << 20] == [1]
    out = list(chunk.parsed(iter([batch]), kind))
    assert max(b.num_rows for b in out) <= 1024
    names = [x for b in out for x in b.column("name").to_pylist()]
    assert names == [x for i in range(n) if i != 7 for x in ((f"A{i}", f"B{i}") if i != 1500 else ("Long", *(f"L{j}" for j in range(2500))))]
