import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from heddle.plans import history, records

QUERIES, SQL = history.QUERIES | records.QUERIES, history.SQL | records.SQL

DATA = Path("/root/testdata/sf0.001")


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"a", "b", "shared", "solo_a", "solo_b", "degree"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = QUERIES[name](spark, str(DATA))
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _norm(df.collect(), df.columns) == _norm(want.fetchall(), columns)


def test_works_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    subprocess.run(["cp", "-r", str(root / "heddle"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "heddle" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k[:2] == 'op' and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split()[-1] == "False" and int(out.stdout.split()[-2]) > 40, out.stderr


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_cycles_of_a_graph_that_grows(spark):
    nodes, after, before = set(), {}, {}
    for r in records._steps(spark, str(DATA)).collect():
        nodes |= {r["src"], r["dst"]}
        after.setdefault(r["src"], []).append(r["dst"])
        before.setdefault(r["dst"], []).append(r["src"])

    def reached(start, edges):
        seen, todo = {start}, [start]
        while todo:
            new = [x for x in edges.get(todo.pop(), []) if x not in seen]
            seen.update(new)
            todo += new
        return seen

    want, left = {}, set(nodes)
    while left:
        one = min(left)
        component = reached(one, after) & reached(one, before)
        left -= component
        if len(component) > 1:
            want |= dict.fromkeys(component, min(component))
    assert {r["node"]: r["cycle"] for r in records.part_cycles(spark, str(DATA)).collect()} == want and len(want) > 50
