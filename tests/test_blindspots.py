from pyspark.sql import functions as F

from heddle.operators import blindspots, slices


def corpus(spark, files):
    return spark.createDataFrame(list(files.items()), "file string, body string")


def test_reasons_to_doubt(spark):
    files = corpus(spark, {
        "a.py": "__all__ = ['exported',\n 'other']\n@route\ndef decorated(): pass\nx = 'quoted'\n", "pkg/__init__.py": "from a import thing\n", "r.py": "getattr(x, 'y')\ndef reflected(): pass\n",
        "b.py": "call(`nothing`, \"quoted_too\")\n", "conf.yaml": "handler: mentioned\n", "dead.py": "def dead(): pass\n", "code.js": "dead()\n",
    })
    names = [("a.py", 1, "function", "exported"), ("a.py", 3, "function", "decorated"), ("a.py", 9, "function", "quoted"), ("pkg/__init__.py", 1, "import", "thing"), ("r.py", 2, "function", "reflected"), ("b.py", 1, "method", "quoted_too"), ("b.py", 1, "function", "mentioned"), ("dead.py", 1, "function", "dead"), ("gone.py", 5, "function", "")]
    got = {(r["name"], r["reason"]) for r in blindspots.blind_spots(spark.createDataFrame(names, "file string, line int, kind string, name string"), files).collect()}
    assert got == {
        ("exported", "exported_in_all"), ("exported", "string_reference"), ("decorated", "decorator_registration"), ("quoted", "string_reference"), ("quoted", "exported_in_all"), ("thing", "reexport"), ("reflected", "reflection_in_module"),
        ("quoted_too", "framework_hook_possible"), ("quoted_too", "string_reference"), ("mentioned", "non_python_reference"),
    }


def test_orphans(spark):
    files = corpus(spark, {
        "app/main.py": "import app.used\nfrom .near import f\nfrom app import listed, more  # not_this\nif __name__ == '__main__':\n    pass\n", "app/used.py": "", "app/near.py": "", "app/listed.py": "", "app/more.py": "", "app/not_this.py": "",
        "app/orphan.py": "import app.orphan\nx = 1\ny = 2\n", "app/named.py": "", "app/plugins.py": "load('app.named')\n", "app/mentioned.py": "", "run.sh": "python -m app.mentioned\n", "app/script.py": "print(1)\n", "app/edge.py": "",
        "tests/test_x.py": "", "app/migrations/m.py": "", "app/__init__.py": "",
    })
    got = {r["file"]: (r["size_lines"], r["instrumentable"], r["blind_spots"]) for r in blindspots.orphan_modules(files, spark.createDataFrame([("x.py", "app/edge.py")], "src string, dst string")).collect()}
    assert got.pop("app/plugins.py")[2] == ["standalone_script"] and got.pop("app/not_this.py")[2] == []
    assert got == {"app/orphan.py": (3, True, []), "app/named.py": (1, True, ["string_reference"]), "app/mentioned.py": (1, True, ["non_python_reference"]), "app/script.py": (1, False, ["standalone_script"])}


def test_slice_of_a_finding(spark):
    findings = spark.createDataFrame([("F1", "h[file=src/a/x.py].edits; c[file=src/b/y.py].n; h[file=src/a/x.py].n"), ("F2", "none")], "id string, source string")
    files = slices.finding_files(findings)
    assert [(r["place"], r["file"]) for r in files.orderBy("place").collect()] == [(0, "src/a/x.py"), (1, "src/b/y.py")]
    hot = spark.createDataFrame([("src/b/y.py", 3), ("src/a/x.py", 5), ("z.py", 9)], "file string, edits int")
    pairs = spark.createDataFrame([("src/a/x.py", "z.py", 5, 0.5), ("q.py", "src/a/x.py", 9, 0.9), ("q.py", "z.py", 9, 1.0)], "a string, b string, shared int, degree double")
    edges = spark.createDataFrame([("src/a/x.py", "z.py"), ("src/b/y.py", "src/a/x.py"), ("w.py", "src/b/y.py")], "src string, dst string")
    crossings = spark.createDataFrame([("a + c", 4), ("c + d", 9)], "crossing string, n int")
    parts = slices.rows_of(files, hot, "hotspots").unionByName(slices.pairs_of(files, pairs)).unionByName(slices.neighbours_of(files, edges, hot)).unionByName(slices.crossings_of(files, crossings, ("src",)))
    rows = lambda df, name: [r["row"] for r in df.where(F.col("relation") == name).orderBy("place").collect()]
    assert rows(parts, "hotspots") == ['{"file":"src/a/x.py","edits":5}', '{"file":"src/b/y.py","edits":3}']
    assert [r[:14] for r in rows(parts, "temporal_coupling")] == ['{"a":"q.py","b', '{"a":"src/a/x.'] and rows(parts, "neighbors") == ['{"node":"z.py"}', '{"node":"w.py"}'] and rows(parts, "top_crossings") == ['{"crossing":"a + c","n":4}']
    order = ("hotspots", "top_crossings", "neighbors", "temporal_coupling")
    kept = slices.fitted(parts, order, 120).collect()
    assert {r["relation"] for r in kept} == {"hotspots", "top_crossings", "neighbors"} and sum(len(r["row"]) + 2 for r in kept) <= 120
    assert {(r["relation"], r["dropped"]) for r in slices.fitted(parts, order).collect()} == {(o, 0) for o in order}


def test_report_relations(spark):
    items = spark.createDataFrame([("F1", "t1", "accepted", [], "ok"), ("F2", "t2", "rejected", ["r1", "r2"], "ok"), ("F3", "t3", None, None, "cold")], "id string, title string, status string, trial_reasons array<string>, payback string")
    refs = spark.createDataFrame([("F1", "L1", "dropped", "no cost"), ("F2", "L2", "survives", "x")], "finding_id string, lens string, verdict string, reason string")
    assert {tuple(r) for r in slices.removed(items, refs).collect()} == {("F1", "t1", "L1: no cost"), ("F2", "t2", "r1; r2"), ("F3", "t3", "payback: cold")}
    checks = spark.createDataFrame([("history", False, "coupling,rework"), ("tests", True, "churn")], "check string, passed boolean, blocks string")
    gaps = slices.report_gaps(checks, spark.createDataFrame([("git", True), ("ruff", False)], "name string, available boolean"), spark.createDataFrame([("young",)], "reason string"))
    assert {r["text"] for r in gaps.collect()} == {"history", "blocked: coupling", "blocked: rework", "missing: ruff", "young"}
