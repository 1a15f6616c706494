import pytest
from pyspark.sql import functions as F

from heddle.functions.documents import at_path, canonical, fnv1a, fnv1a64, schema_problems, value_at
from heddle.operators import ledger, prune


def snaps(spark, base=(0.7, 0.2), now=(0.7, 0.2)):
    return spark.createDataFrame([("base", *base), ("now", *now)] if base else [("now", *now)], "run string, containment double, rework double")


def members(spark, *rows):
    return spark.createDataFrame(list(rows) or [("none", "cycle", "x")], "run string, kind string, member string")


@pytest.mark.parametrize(
    ("base", "now", "rows", "status"),
    [
        ((0.7, 0.2), (0.7, 0.2), [], "OK"), ((0.7, 0.2), (0.66, 0.2), [], "REGRESSION"), ((0.7, 0.2), (0.68, 0.24), [], "OK"), ((0.7, 0.2), (0.7, 0.26), [], "REGRESSION"), (None, (0.7, 0.2), [], "NO_BASELINE"),
        ((0.7, 0.2), (0.7, 0.2), [("now", "cycle", "a")], "REGRESSION"), ((0.7, 0.2), (0.7, 0.2), [("base", "painful", "a"), ("now", "painful", "a")], "OK"), ((0.7, 0.2), (0.7, 0.2), [("base", "unstable", "a")], "OK"),
    ],
)
def test_gate(spark, base, now, rows, status):
    assert ledger.gate(snaps(spark, base, now), members(spark, *rows), "base", "now").first()["status"] == status


def test_set_changes(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "m string") for xs in ("ab", "bc"))
    assert {tuple(r) for r in ledger.set_changes(a, b, "m").collect()} == {("a", "new"), ("c", "healed")}


FIELDS = ("risk", "title", "symptom", "source", "cost_pain", "remedy", "remedy_cost", "gain", "gain_metric", "gain_target", "refutation", "confidence", "priority")


def finding(name, **own):
    return (name, *({k: "x" for k in FIELDS} | {"source": "m.x", "gain_metric": "manual", "confidence": "finding", "priority": "3"} | own).values())


REFUTATION = "finding_id string, lens string, verdict string, reason string, mode string"


def test_selfcheck(spark):
    rows = [
        finding("F1", source="m.x; m.y"), finding("F2", title=" ", source="m.z", priority="9", confidence="verdict", gain_metric="nope"), finding("F3", priority="2", confidence="verdict"),
        finding("F4", priority="high"), finding("F5", priority="7"), finding("F6", priority="7", remedy=None), finding("F7", confidence="verdict"),
    ]
    findings = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("id", *FIELDS)))
    lenses = [("F3", "L1 cost", "parallel"), ("F3", "L1", "parallel"), ("F5", "L1", None), ("F6", "L2", "sequential"), ("F7", "L1", "sequential"), ("F7", "L3", "sequential")]
    refutations = spark.createDataFrame([(f, lens, "confirmed", "", mode) for f, lens, mode in lenses], REFUTATION)
    got = {tuple(r) for r in ledger.selfcheck(findings, refutations, spark.createDataFrame([("files",)], "metric string"), spark.createDataFrame([("m.x",), ("m.y",)], "source string")).collect()}
    assert got == {("F2", "blank title"), ("F2", "unresolved m.z"), ("F2", "unknown metric nope"), ("F2", "not refuted"), ("F3", "verdict of one lens"), ("F5", "undeclared mode"), ("F6", "blank remedy"), ("F7", "verdict without a parallel lens")}
    assert tuple(ledger.run_mode(findings, refutations).first()) == ("mixed", 1, 3)
    assert tuple(ledger.run_mode(findings, refutations.where("false")).first()) == ("none", 0, 0)


def test_deltas(spark):
    rows = spark.createDataFrame([("base", 0.7, 10), ("now", 0.65, None)], "run string, containment_ratio double, files int")
    assert [tuple(r) for r in ledger.gate_deltas(rows, "base", "now", ("containment_ratio", "files")).collect()] == [("containment_ratio", 0.7, 0.65, -0.05), ("files", 10.0, None, None)]


def test_refutation_mode(spark):
    rows = spark.createDataFrame([("F1", "L1", "", "", "parallel"), ("F1", "L2", "", "", "sequential"), ("F2", "L1", "", "", "parallel")], REFUTATION)
    assert {tuple(r) for r in ledger.refutation_mode(rows).collect()} == {("F1", "mixed", "finding"), ("F2", "parallel", "verdict")}


def test_append_guards(spark):
    new = spark.createDataFrame([("F1", "confirmed"), ("F2", "odd"), ("F3", None), ("F3", "refuted")], "id string, verdict string")
    got = {tuple(r) for r in ledger.rejected_rows(new, spark.createDataFrame([("F1",)], "id string"), {"verdict": ledger.VERDICTS}).collect()}
    assert got == {("F1", "repeated id"), ("F3", "repeated id"), ("F2", "verdict: odd")}


def test_gains(spark):
    rows = spark.createDataFrame([("F1", "done", "pairs", "3,5", "down"), ("F2", "закрыта", "files", "10", "up"), ("F3", "open", "files", "1", "up")], "id string, status string, gain_metric string, gain_target string, gain_direction string")
    got = {r["id"]: r["reached"] for r in ledger.verify_gains(rows, spark.createDataFrame([("pairs", 3.0), ("files", 9.0)], "metric string, value double")).collect()}
    assert got == {"F1": True, "F2": False}


def test_sarif(spark):
    import json

    rows = spark.createDataFrame([("F1", "R1", "first", "9", ["a.py"]), ("F2", "R1", "second", "5", []), ("F3", "R2", "third", "2", ["b.py", "c.py"])], "id string, risk string, title string, priority string, files array<string>")
    run = json.loads(ledger.sarif(rows).first()["sarif"])["runs"][0]
    assert [(r["id"], r["shortDescription"]["text"]) for r in run["tool"]["driver"]["rules"]] == [("R1", "first"), ("R2", "third")]
    assert [r["level"] for r in run["results"]] == ["error", "warning", "note"] and len(run["results"][2]["locations"]) == 2


def test_trial_verdicts(spark):
    checks = spark.createDataFrame([("a", "t", "pass", True), ("b", "t", "fail", True), ("c", "l", "pass", False), ("d", "t", "unverified", True)], "variant string, name string, status string, is_test boolean")
    trials = spark.createDataFrame([(v, False, "reached", "ok", False) for v in "abcd"] + [("e", True, "reached", "ok", False)], "variant string, empty_diff boolean, gain string, payback string, partial boolean")
    assert {tuple(r) for r in ledger.trial_verdicts(checks, trials).collect()} == {("a", "accepted"), ("b", "rejected"), ("c", "unverified"), ("d", "unverified"), ("e", "rejected")}


def test_plan(spark):
    findings = spark.createDataFrame([("F1", 9), ("F2", 4)], "id string, priority int")
    decisions = spark.createDataFrame([("F1", "go", None, "v2", "too_costly", "v1"), ("F3", "go", "ok", "v3", "cold", "v4")], "id string, decision string, trial_payback string, trial_variant string, lead_payback string, lead_variant string")
    got = {r["id"]: (r["included"], r["payback"], r["variant"]) for r in ledger.plan_items(findings, decisions).collect()}
    assert got == {"F1": (False, "too_costly", "v2"), "F2": (False, None, None), "F3": (True, "ok", "v3")}
    assert ledger.after_dependencies(["a", "b", "c"], {"a": {"c"}}) == ["b", "c", "a"] and ledger.after_dependencies(["a", "b"], {"a": {"b"}, "b": {"a"}})


def test_budget_drops_from_the_tail(spark):
    rows = spark.createDataFrame([("k", i, "x" * 40) for i in range(5)], "k string, i int, s string")
    got = ledger.within_budget(rows, "k", [F.col("i")], "s", 100).collect()
    assert [(r["i"], r["dropped"]) for r in got] == [(0, 3), (1, 3)]


def test_calibration_and_expectations(spark):
    facts = spark.createDataFrame([(59, 0, 0, 10, 5, 3, "ok")], "commits int, tests int, regex_files int, files int, edges int, pairs int, control string")
    checks = ledger.calibration(facts)
    assert {r["check"] for r in checks.where("not passed").collect()} == {"history", "tests"} and {r[0] for r in ledger.blocked(checks).collect()} == {"coupling", "rework", "churn"}
    assert ledger.expect(facts, {"min_commits": 50, "eq_control": "ok"}).count() == 0 and ledger.expect(facts, {"max_pairs": 1}).count() == 1
    with pytest.raises(ValueError):
        ledger.expect(facts, {"min_nothing": 1})


def test_prune(spark):
    lines = spark.createDataFrame([("a/b.py:12: unused function 'foo' (60% confidence, 4 lines)",), ("noise",), ("c.py:3: unreachable code after 'return' (100% confidence)",)], "value string")
    assert [(r["file"], r["line"], r["kind"], r["name"], r["confidence"], r["size_lines"]) for r in prune.parse_report(lines).collect()] == [("a/b.py", 12, "function", "foo", 60, 4), ("c.py", 3, "code", "", 100, None)]
    cands = spark.createDataFrame([("b", 2, "g", True), ("a", 1, "f", False), ("a", 9, "h", False)], "file string, line int, name string, instrumentable boolean")
    blind = spark.createDataFrame([("g", "quoted"), ("h", "reflection")], "name string, reason string")
    assert {(r["id"], r["name"], r["status"]) for r in prune.statuses(cands, blind).collect()} == {("P1", "f", "provable"), ("P2", "h", "manual"), ("P3", "g", "suspected")}
    state = spark.createDataFrame([("P1", "instrumented"), ("P2", "instrumented"), ("P3", "manual")], "id string, status string")
    hits = spark.createDataFrame([("P1", 3)], "id string, hits long")
    assert {(r["id"], r["status"]) for r in prune.observed(state, hits, 20).collect()} == {("P1", "alive"), ("P2", "never_fired"), ("P3", "manual")}
    assert {r["status"] for r in prune.observed(state, hits, 19).collect()} == {"alive", "instrumented", "manual"}


def test_documents(spark):
    df = spark.createDataFrame([([("a.py", 3), ("b.py", 5)],)], "rows array<struct<file:string,n:int>>").select(F.struct("rows").alias("m"))
    assert df.select(at_path("m", "rows[file=b.py].n")).first()[0] == 5 and df.select(at_path("m", "rows[0].file")).first()[0] == "a.py" and df.select(at_path("m", "rows[7].n")).first()[0] is None
    assert value_at({"a": [{"k": "x", "v": 1}]}, 'a[k=x]["v"]') == 1
    with pytest.raises(KeyError):
        value_at({"a": []}, "a[0]")
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"$ref": "#/$defs/n"}}, "$defs": {"n": {"type": "integer", "minimum": 1}}}
    assert schema_problems({"n": 1}, schema) == [] and schema_problems({"n": 0}, schema) == ["$.n: under 1"] and schema_problems({}, schema) == ["$: lacks n"]
    assert fnv1a64("") == "cbf29ce484222325" and fnv1a64("a") == "af63dc4c8601ec8c" and canonical({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'
    assert [r[0] for r in spark.createDataFrame([("a",), (None,)], "s string").select(fnv1a("s")).collect()] == ["af63dc4c8601ec8c", None]
