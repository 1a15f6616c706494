import json

import pytest
from pyspark.sql import functions as F

from heddle.functions.columns import is_fix, layer_of, path_class
from heddle.operators import hotspots, lint, lookups, timelines
from heddle.operators.cooccur import cooccurrence
from heddle.operators.graph import with_edge, without_edge
from heddle.sources import findings, gitlog, synthetic

NOW = 1_700_000_000


def exploded(commits):
    return gitlog.commit_files(commits).withColumn("fix", is_fix("subject")).withColumn("layer", layer_of("file", ("src",), 1)).where(path_class("file") == "code")


def test_pain_and_extension(spark):
    plan = [("a", "feat: x", ["src/app/wire.py"])] * 28 + [("b", "fix: x", ["src/app/wire.py"])] * 2 + [("a", "feat: y", ["src/pay/pay.py"])] * 11 + [("b", "fix: y", ["src/pay/pay.py"])] * 9
    rows = exploded(synthetic.history(spark, plan, NOW))
    sizes = rows.select(F.col("file").alias("item")).distinct().withColumn("size", F.lit(100))
    spots = hotspots.hotspots(rows, "sha", "file", rows.where("fix").select(F.col("sha").alias("group")), sizes)
    assert {r["item"] for r in hotspots.painful(spots).collect()} == {"src/pay/pay.py"}
    assert "src/app/wire.py" in {r["item"] for r in hotspots.extension_points(spots, 60).collect()}


def test_coupled_with_and_without_import(spark):
    plan = [("a", "feat: x", ["src/a/one.py", "src/a/two.py"])] * 8 + [("a", "feat: y", ["src/b/left.py", "src/c/right.py"])] * 8
    pairs = cooccurrence(exploded(synthetic.history(spark, plan, NOW)), "sha", "file")
    edges = spark.createDataFrame([("src/a/one.py", "src/a/two.py")], "src string, dst string")
    assert [r["a"] for r in with_edge(pairs, edges).collect()] == ["src/a/one.py"] and [r["a"] for r in without_edge(pairs, edges).collect()] == ["src/b/left.py"]


def test_rework_of_a_fragile_file(spark):
    plan = [x for i in range(12) for x in (("a", "feat: x", ["src/fragile.py"]), ("a", "fix: x", ["src/fragile.py"]), ("a", "feat: z", ["src/solid.py"]))]
    rows = exploded(synthetic.history(spark, plan, NOW))
    got = {r["file"]: r for r in timelines.rework(rows, "file", "epoch", F.col("fix"), 14 * timelines.DAY).collect()}
    assert got["src/fragile.py"]["rate"] >= 0.9 and got["src/fragile.py"]["rate_low"] >= 0.6 and got["src/solid.py"]["rate"] == 0.0


def test_lookups_and_snapshot(spark):
    plan = [("ann", "feat: x", ["src/a/x.py", "src/b/y.py"])] * 6 + [("bob", "revert: x", ["src/a/x.py"])]
    rows = exploded(synthetic.history(spark, plan, NOW, filler=0))
    assert lookups.revisions(rows, "src/a/x.py").first()["revisions"] == 8 and lookups.reverts(rows).first()["reverts"] == 1
    assert tuple(lookups.together(rows, "src/a/", "src/b/").first()) == (6, 8, 7) and {r["author"] for r in lookups.authors(rows, "src/b").collect()} == {"maker", "ann"}
    edges = spark.createDataFrame([("x", "y"), ("y", "x")], "src string, dst string")
    one = lookups.snapshot("r1", rows, edges).first()
    assert (one["run"], one["files"], one["commits"], one["cycles"], one["cycle_members"], one["coupling_pairs"]) == ("r1", 2, 9, 1, 2, 1) and abs(one["containment"] - 3 / 9) < 1e-9


def test_lint(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"filename": "a.py", "code": "SIM102"}, {"filename": "a.py", "code": "E501"}, {"filename": "a.py", "code": "X1"}, {"filename": "b.py", "code": "PERF401"}]))
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"path": "a.py", "check_id": "slow", "extra": {"metadata": {"category": "performance"}}}, {"path": "a.py", "check_id": "x", "extra": {"metadata": {"category": "security"}}}]}))
    files = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "file string")
    each = lint.counts(lint.read_findings(spark, str(tmp_path / "r.json")), files)
    assert {tuple(r) for r in each.collect()} == {("a.py", 1, 1, 0), ("b.py", 0, 0, 1), ("c.py", 0, 0, 0)}
    ranked = {r["file"]: r for r in lint.with_ranks(each, files.limit(1)).collect()}
    assert ranked["a.py"]["simplicity_pct"] == 100 and ranked["c.py"]["simplicity_pct"] == 67
    assert lint.read_performance(spark, str(tmp_path / "s.json")).count() == 1


def test_findings_files(spark, tmp_path):
    path, row = str(tmp_path / "f"), [("F1", "R1", 'a "quoted", title', "m.x[file=b.py]; m.y[file=a.py]", "8", "finding", "git, graph")]
    new = spark.createDataFrame(row, "id string, risk string, title string, source string, priority string, ceiling string, axes string")
    findings.append_csv(new, path)
    assert findings.read_csv(spark, path).first()["title"] == 'a "quoted", title'
    for bad in (new, new.withColumn("id", F.lit("F2")).withColumn("title", F.lit(" ")), new.withColumn("id", F.lit("F3")).withColumn("ceiling", F.lit("odd"))):
        with pytest.raises(ValueError):
            findings.append_csv(bad, path, {"ceiling": ("finding", "verdict")})
    none = spark.createDataFrame([], "finding_id string, lens string, verdict string, reason string, mode string")
    doc = findings.document(findings.read_csv(spark, path), none)
    assert doc.first()["files"] == ["a.py", "b.py"] and doc.first()["axes"] == ["git", "graph"] and doc.first()["refutations"] == []
    problems = spark.createDataFrame([], "id string, problem string")
    findings.export(doc, problems, {"type": "object", "required": ["id"]}, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["id"] == "F1"
    with pytest.raises(ValueError):
        findings.export(doc, problems, {"type": "object", "required": ["missing"]}, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        findings.export(doc, spark.createDataFrame([("F1", "x")], "id string, problem string"), None, str(tmp_path / "out"))
    assert "a \"quoted\", title" in findings.markdown(findings.read_csv(spark, path).select("id", "title"), "T")
    findings.write_csv(new, str(tmp_path / "g"))
    assert findings.read_csv(spark, str(tmp_path / "g")).count() == 1
