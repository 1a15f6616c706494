from heddle.plans.measure import measure
from heddle.sources.synthetic import write_repository


def test_a_repository_is_measured(spark, tmp_path):
    start = {"src/pay/__init__.py": "", "src/pay/a.py": "from src.pay import b\n", "src/pay/b.py": "import src.pay.a\n", "src/user/c.py": "import os\nimport src.pay.b\n", "tests/test_a.py": "import src.pay.a\n", "README.md": "x\n"}
    commits = [("ann", "feat: start", start)]
    commits += [("bob" if i % 2 else "ann", "fix: it" if i % 4 == 1 else "feat: more", {"src/pay/a.py": f"from src.pay import b\nx = {i}\n", "src/pay/b.py": f"import src.pay.a\ny = {i}\n"}) for i in range(12)]
    commits += [("ann", "feat: c", {"src/user/c.py": f"import os\nimport src.pay.b\nz = {i}\n"}) for i in range(9)]
    write_repository(str(tmp_path), commits)
    row = measure(spark, str(tmp_path)).first()
    s, b = row["structure"], row["behaviour"]
    assert (s["files"], s["runtime_cycles"], s["cycle_members"]) == (5, 1, ["src/pay/a.py", "src/pay/b.py"]) and s["edges"] == 5 and [r["package"] for r in s["external"]] == ["os"]
    assert b["commits_with_code"] == 22 and [(r["a"], r["b"], r["shared"]) for r in b["temporal_coupling"]] == [("src/pay/a.py", "src/pay/b.py", 13)]
    assert [r["item"] for r in b["knowledge_risk"]] == ["src/user/c.py"] and b["rework_rate"] > 0.5 and b["traffic"]["test"] == 1
    assert {c["check"] for c in row["calibration"]["checks"] if not c["passed"]} == {"history"} and row["ceiling"] == "finding"


def test_an_empty_repository_is_measured(spark, tmp_path):
    write_repository(str(tmp_path), [("ann", "docs", {"notes.txt": "x\n"})])
    row = measure(spark, str(tmp_path)).first()
    assert row["structure"]["files"] == 0 and row["behaviour"]["commits_with_code"] == 0 and row["ceiling"] == "finding"
