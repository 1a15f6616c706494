import subprocess

from pyspark.sql import functions as F

from heddle.sources import gitlog, layout, source_text
from heddle.streaming import live


def test_history_text(spark, tmp_path):
    text = "__C__s1\x1fann\x1f100\x1ffeat: a\x1cb\r\n\na.py\n b.py\n\n__C__s2\x1fbob\x1f\x1ffix\n__C__s3\x1f\n"
    (tmp_path / "log").write_text(text)
    rows = {r["sha"]: r for r in gitlog.read_history(spark, str(tmp_path / "log")).collect()}
    assert (rows["s1"]["author"], rows["s1"]["epoch"], rows["s1"]["subject"], rows["s1"]["files"]) == ("ann", 100, "feat: a\x1cb", ["a.py", " b.py"])
    assert rows["s2"]["epoch"] == 0 and rows["s2"]["files"] == [] and rows["s3"]["author"] == ""


def test_git_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "a.py")
    git("commit", "-qm", "fix: first")
    spark.dataSource.register(gitlog.GitHistory)
    rows = spark.read.format("git_history").option("repo", str(tmp_path)).load().collect()
    assert [(r["author"], r["subject"], r["files"]) for r in rows] == [("n", "fix: first", ["a.py"])]
    assert gitlog.commit_files(spark.createDataFrame(rows)).count() == 1


def files(spark, **bodies):
    return spark.createDataFrame([(k.replace("__", "/") + ".py", v) for k, v in bodies.items()], "file string, body string")


def test_imports_resolve_to_files(spark):
    tree = files(spark, app__main="import os\nfrom app import util\nfrom .model import Thing\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from app.late import X\n", app__util="", app__model="class Thing: pass", app__late="import app.util", bad="def (")
    specs = source_text.import_specs(tree)
    edges = {tuple(r) for r in source_text.import_edges(source_text.resolve(specs, tree)).collect()}
    assert {("app/main.py", "app/util.py", "runtime"), ("app/main.py", "app/model.py", "runtime"), ("app/main.py", "app/late.py", "type"), ("app/late.py", "app/util.py", "runtime")} <= edges
    assert "os" in {r["package"] for r in source_text.external_packages(source_text.resolve(specs, tree)).collect()}


TREE = ["src/user/__init__.py", "src/user/model.py", "src/user/repository.py", "src/core/db.py", "web/shared/api/index.ts", "web/pages/home.tsx", "web/pages/foo.service.ts", "b/util.ts", "a/x.ts"]


def test_specs_lead_to_files(spark):
    want = {
        ("src/x.py", "src.user"): "src/user/__init__.py", ("src/user/repository.py", "src.user.model"): "src/user/model.py", ("src/user/repository.py", ".model"): "src/user/model.py",
        ("src/user/repository.py", "..core.db"): "src/core/db.py", ("src/user/model.py", "."): "src/user/__init__.py", ("web/pages/home.tsx", "../shared/api"): "web/shared/api/index.ts",
        ("web/pages/home.tsx", "@/shared/api"): "web/shared/api/index.ts", ("web/pages/home.tsx", "./foo.service"): "web/pages/foo.service.ts", ("a/x.ts", "../b/util"): "b/util.ts", ("a/x.ts", "./../a/./../b//util"): "b/util.ts",
        ("x.py", "user.model"): "src/user/model.py", ("x.py", "fastapi"): None, ("x.py", "react"): None, ("x.py", "@tanstack/react-query"): None, ("x.py", ""): None, ("x.py", None): None, ("x.py", "../../../b/util"): None,
    }
    specs = spark.createDataFrame([(*k, "runtime") for k in want], "file string, spec string, kind string")
    got = source_text.resolve(specs, spark.createDataFrame([(f,) for f in TREE], "file string"), ("src", "web")).collect()
    assert {(r["file"], r["spec"]): r["target"] for r in got} == want and len(got) == len(want)


def test_metrics_count_each_function_alone(spark):
    body = "def a(x):\n    if x:\n        for y in x:\n            pass\n    def b(z):\n        return 1 if z else 2\n    return b\n"
    rows = {r["file"]: r for r in source_text.file_metrics(files(spark, m=body, bad="def (")).collect()}
    assert (rows["m.py"]["cyclomatic_total"], rows["m.py"]["cyclomatic_max"], rows["m.py"]["worst_line"], rows["m.py"]["max_nesting"], rows["m.py"]["functions"]) == (4, 3, 1, 2, 2)
    assert rows["bad.py"]["loc"] is None


JS = """import type { A } from './a';
import b, { c } from "./b";
// if (x) { while (1) {} }
function first(x) {
  if (x && x.y) { for (const z of x) { log("if {", z); } }
  return x ? 1 : 2;
}
class K {
  method(a) { switch (a) { case 1: return 1; case 2: return 2; } }
}
const short = (q) => q + 1;
"""


def test_languages_with_braces(spark):
    files = spark.createDataFrame([("m.ts", JS), ("m.go", "package m\nfunc F(x int) int {\n\tif x > 1 {\n\t\treturn 1\n\t}\n\treturn 2\n}\n"), ("M.java", "class M { int f(int a) { while (a > 0) { a--; } return a; } }"), ("x.txt", "if")], "file string, body string")
    rows = {r["file"]: (r["cyclomatic_total"], r["cyclomatic_max"], r["worst_line"], r["max_nesting"], r["functions"], r["backend"]) for r in source_text.file_metrics(files).collect()}
    assert rows == {"m.ts": (7, 5, 4, 2, 3, "regex"), "m.go": (2, 2, 2, 1, 1, "regex"), "M.java": (2, 2, 1, 1, 1, "regex")}
    specs = {(r["file"], r["spec"], r["kind"]) for r in source_text.import_specs(files).collect()}
    assert specs == {("m.ts", "./a", "type"), ("m.ts", "./b", "runtime")}
    toks = [r["tok"] for r in source_text.token_rows(files.where("file = 'M.java'")).orderBy("pos").collect()]
    assert toks[:9] == ["class", "ID", "{", "int", "ID", "(", "int", "ID", ")"]
    renamed = JS.replace("first", "second").replace("x", "yy")
    both = spark.createDataFrame([("a.js", JS), ("b.js", renamed)], "file string, body string")
    assert len({tuple(r["tokens"]) for r in source_text.token_arrays(both).collect()}) == 1


def test_tokens_and_tree(spark, tmp_path):
    assert [x[0] for x in source_text.python_tokens("a = 1  # note\n")] == ["ID", "=", "LIT"]
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".hid").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1")
    (tmp_path / ".hid" / "b.py").write_text("x = 1")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "pkg" / "__init__.py").write_bytes(b"y = '\xff'")
    (tmp_path / "pkg" / "node_modules").mkdir()
    (tmp_path / "pkg" / "node_modules" / "d.js").write_text("x")
    (tmp_path / "Makefile").write_text("all:")
    read = lambda f: sorted((r["file"], r["body"]) for r in f(spark, str(tmp_path)).collect())
    assert read(source_text.read_tree) == [("pkg/__init__.py", "y = '\ufffd'"), ("pkg/a.py", "x = 1")]
    assert read(source_text.read_texts) == [("Makefile", "all:"), ("c.txt", "x")]
    (tmp_path / "none").mkdir()
    assert source_text.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_package_roots(spark):
    paths = spark.createDataFrame([(f"src/a{i}.py",) for i in range(6)] + [("doc/x.py",)] * 3 + [("setup.py",)], "path string")
    assert layout.package_roots(paths, "path") == ["src"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("hit P1\nhit P2 hit P1\nnothing\n")
    q = live.live_marker_counts(spark.readStream.text(str(tmp_path / "in")), "value", r"hit (P\d+)\b").writeStream.outputMode("complete").format("memory").queryName("markers").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("markers").collect()} == {("P1", 2), ("P2", 1)}
    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 01:00:00"), ("u", "2024-01-01 02:00:01"), ("u", "2024-01-02 00:00:00")], "k string, s string").select("k", F.col("s").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "ev"))
    q = live.live_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")), "k", "ts", "1 hour", "10 minutes").writeStream.outputMode("append").format("memory").queryName("sess").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["events"] for r in spark.table("sess").collect()) == [1, 2]
