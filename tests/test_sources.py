import fnmatch

import pytest
from pyspark.sql import functions as F

from chunkspark.config import PathPatterns
from chunkspark.sources.domains import Registry, discover_domains, domains_frame, last_wins
from chunkspark.sources.files import GIT, list_files, parseable, scan_files
from chunkspark.sources.paths import ignored, language_of, small_enough, wanted

PATHS = ["foo.py", "./foo.py", "a/b.py", "a/tests/b.py", "tests/b.py", "venv/x.py", "a/venv/x/y.ts", "a/b\nc.py", "/r/a.CPP", "x.[a].py"]


def column(spark, f, paths=PATHS):
    return [r[1] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", f(F.col("p"))).orderBy("i").collect()]


@pytest.mark.parametrize("globs", [(["**/*"], ["**/tests/**"]), (["*.py"], []), (["**/*.py", "x.?a?.*"], ["*venv*"]), ([], []), (["[!f]*"], ["*[.]CPP"])])
def test_patterns_equal_fnmatch(spark, globs):
    include, exclude = globs
    want = [not any(fnmatch.fnmatchcase(p, g) for g in exclude) and any(fnmatch.fnmatchcase(p, g) for g in include) for p in PATHS]
    assert column(spark, lambda p: wanted(p, PathPatterns(include, exclude))) == want


def test_routing_and_sizes(spark):
    paths = ["a.py", "a.PY", "a.hpp", "a.HPP", "a.tsx", "b.Cs", "x.meta", "x.META", "none", ".py", "d.py/f"]
    assert column(spark, language_of, paths) == ["python", None, "cpp", "cpp", "typescript", "csharp", "unity_asset", None, None, None, None]
    rows = spark.createDataFrame([("python", 1_000_000), ("python", 1_000_001), ("csharp", 10**9), ("unity_asset", 10_000_000)], "l string, n long")
    assert [r[0] for r in rows.select(small_enough(F.col("l"), F.col("n"))).collect()] == [True, False, True, True]


def test_ignore_rules(spark):
    paths = ["a.log", "x/a.log", "build/o", "x/build/o", "keep.log", "doc/a.txt", "x/doc/a.txt", "src/q/deep/z.tmp"]
    rules = ["*.log", "!keep.log", "build/", "/doc", "# note", "", "src/**/z.tmp"]
    assert column(spark, lambda p: ignored(p, rules), paths) == [True, True, True, True, False, True, False, True]


def test_ignored_folders_stay_ignored(spark):
    paths = ["build/keep.txt", "a/b1.o", "a/b7.o", "a/x[1].o", "sub/own.log", "own.log", "sub/deep/own.log", "a/!odd", "sub/kept.o"]
    rules = ["build/", "!build/keep.txt", "b[0-4].o", "x\\[1].o", "\\!odd", ("sub", "*.log"), ("sub/deep", "!own.log"), "*.o~", ("sub", "/kept.*"), ("sub", "!kept.o")]
    assert column(spark, lambda p: ignored(p, rules), paths) == [True, True, False, True, True, False, False, True, False]


def test_gitignore_files(spark, tmp_path):
    for name, text in {".git/HEAD": "ref", ".gitignore": "*.log\nout/\n", "sub/.gitignore": "!keep.log\n/only\n", "a.log": "1", "sub/keep.log": "1", "sub/only": "1", "sub/x/only": "1", "out/a.py": "1", "b.py": "1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    found = scan_files(spark, str(tmp_path), "d", PathPatterns(exclude=["*/.git/*"]), GIT)
    assert sorted(r.id for r in found.collect()) == ["b.py", "sub/keep.log", "sub/x/only"]
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.py": b"def f(): pass\n", "sub/b.ts": b"const x = 1;\n", "sub/bad.py": b"\xff\xfe", "venv/c.py": b"x", "big.cs": b"//" + b"x" * 10, "skip.log": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_scan(spark, tree):
    import zlib

    patterns = PathPatterns(exclude=["*/venv/*"])
    found = {r.id: r for r in scan_files(spark, str(tree), "d", patterns, ["*.log"]).collect()}
    assert set(found) == {"a.py", "sub/b.ts", "sub/bad.py", "big.cs"}
    assert found["a.py"].asset_hash == str(zlib.crc32(b"def f(): pass\n")) and found["sub/b.ts"].name == "b.ts"
    assert {r.id: r.language for r in parseable(scan_files(spark, str(tree), "d", patterns, contents=True)).collect()} == {"a.py": "python", "sub/b.ts": "typescript", "big.cs": "csharp"}


def test_domains(spark, tmp_path):
    text = "domain_type: codebase\nenabled: {}\ndomain_data: {{id: {}, name: {}, meta: {{k: 1}}}}\nsearch_config: {{top_k: 4, other: 1}}\n"
    for name, enabled, i, label in (("a", "true", "x", "first"), ("b", "true", "x", "second"), ("c", "false", "y", "off"), ("d", "true", "z", "zed")):
        (tmp_path / f"{name}.yaml").write_text(text.format(enabled, i, label))
    found = discover_domains(str(tmp_path))
    assert {k: v.name for k, v in found.items()} == {"x": "second", "z": "zed"} and found["x"].search.top_k == 4
    assert domains_frame(spark, found).count() == 2
    (tmp_path / "e.yaml").write_text("enabled: true\n")
    with pytest.raises(ValueError, match="e.yaml"):
        discover_domains(str(tmp_path))


def test_registry_and_last_wins(spark):
    r = Registry("thing")
    r.register("a")(1)
    assert r.get("a") == 1
    with pytest.raises(KeyError, match="known: a"):
        r.get("b")
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("l", 1, "z")], "k string, o int, v string")
    assert {tuple(x) for x in last_wins(rows, ["k"], "o").collect()} == {("k", 2, "y"), ("l", 1, "z")}


def test_thousands_of_ignore_rules(spark):
    rules = [f"gen{i}/" for i in range(3000)] + [("a", f"*.x{i}") for i in range(3000)] + [("a/b", "!keep.x7"), "!gen5/"]
    paths = ["gen1/f", "x/gen2999/f", "gen5/f", "gen3000/f", "a/q.x7", "a/b/keep.x7", "a/b/other.x7", "b/q.x7", None]
    assert column(spark, lambda p: ignored(p, rules), paths) == [True, True, False, False, True, False, True, False, None]
