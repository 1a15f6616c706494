import math

from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.functions.params import Params
from heddle.operators.ranks import with_percentile


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'array<int>' if isinstance(v, list) else 'long'}" for k, v in values.items())).select(column).first()[0]


def test_wilson_prefers_much_evidence(spark):
    few, many = one(spark, C.wilson_lower("k", "n"), k=5, n=5), one(spark, C.wilson_lower("k", "n"), k=55, n=67)
    assert few < many < 55 / 67
    p, n, z = 55 / 67, 67, 1.96
    assert math.isclose(many, (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))
    assert one(spark, C.wilson_lower("k", "n"), k=0, n=0) == 0


def test_floor_quantile(spark):
    for q, want in ((0.9, 10), (0.0, 1), (0.5, 6), (1.0, 10)):
        assert one(spark, C.floor_quantile("v", q), v=list(range(10, 0, -1))) == want
    assert one(spark, C.floor_quantile("v", 0.5), v=[]) is None


def test_half_even(spark):
    assert [one(spark, C.half_even("v"), v=x) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_subjects(spark):
    fixes = {"fix: a": True, " HotFix b": True, "ИСПРАВил": True, "fixture: c": True, "feat: fix": False, "prefix": False}
    for s, want in fixes.items():
        assert one(spark, C.is_fix("s"), s=s) is want, s
    assert one(spark, C.is_revert("s"), s="Откат x") is True


def test_path_class_order(spark):
    cases = {"a/node_modules/x.py": "noise", "rebuild/x.py": "noise", "a/readme.md": "noise", "a/x_pb2.py": "generated", "migrations/1.py": "generated", "latest.py": "test", "tests/x.py": "test", "a/Tests/x.py": "test", "a/x.py": "code"}
    for path, want in cases.items():
        assert one(spark, C.path_class("p"), p=path) == want, path


def test_layers(spark):
    for path, roots, depth, want in (("src/a/b.py", ("src",), 1, "a"), ("src/src/a/b/c.py", ("src",), 2, "a/b"), ("b.py", (), 1, "b.py"), ("", (), 1, "?"), ("./a//b.py", (), 1, "a"), ("src/b.py", ("src",), 1, "b.py"), ("a/src/b.py", ("src",), 2, "a/src")):
        assert one(spark, C.layer_of("p", roots, depth), p=path) == want, path


def test_extension(spark):
    for path, want in (("a/b.py", ".py"), (".bashrc", ""), ("a.b/c", ""), ("a/x.tar.gz", ".gz"), ("..a.b", ".b")):
        assert one(spark, C.extension("p"), p=path) == want, path


def test_rule_tables(spark):
    assert [one(spark, C.pain("s", "e"), s=s, e=e) for s, e in ((0.1, 99), (0.2, 7), (0.2, 8), (0.35, 8), (0.36, 7), (0.36, 8))] == [1, 1, 2, 2, 2, 3]
    assert [one(spark, C.spread("f", "c"), f=f, c=c) for f, c in ((3, 1), (4, 0), (11, 0), (0, 2), (0, 5))] == [1, 2, 3, 2, 3]
    assert [one(spark, C.band("v", 0.75, 0.5, False), v=v) for v in (0.4, 0.6, 0.8)] == ["red", "yellow", "green"]
    assert [one(spark, C.sarif_level("p"), p=p) for p in (9, 8, 6, 4)] == ["error", "error", "warning", "note"]
    assert [one(spark, C.payback_verdict("q"), q=q) for q in (2.0, 4.0, 4.01)] == ["ok", "ok", "too_costly"]
    assert one(spark, C.quarter_bucket("a", 10.0), a=5) == 3 and one(spark, C.quarter_bucket("a", 10.0), a=500) == 0 and one(spark, C.quarter_bucket("a", 10.0), a=-3) == 3


def test_gain_direction(spark):
    for a, t, d, want in ((5.0, 4.0, "up", True), (5.0, 4.0, "down", False), (3.97, 4.0, "", True), (3.9, 4.0, "", False)):
        assert one(spark, C.gain_reached("a", "t", "d"), a=a, t=t, d=d) is want


def test_percentile_counts_ties_as_below(spark):
    rows = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 3.0, None]], "v double")
    got = {r["v"]: r["p"] for r in with_percentile(rows, "v", "p").collect()}
    assert got == {1.0: 25, 2.0: 75, 3.0: 100, None: None}
    window = {r["v"]: r["p"] for r in rows.select("v", C.percentile_rank("v").alias("p")).collect()}
    assert window == got


def test_percentile_matches_sorting_at_size(spark):
    rows = spark.range(5000).select((F.col("id") * F.col("id") % 997).cast("double").alias("v"))
    values = [r["v"] for r in rows.collect()]
    got = {r["v"]: r["p"] for r in with_percentile(rows, "v", "p").collect()}
    for v in list(got)[::50]:
        assert abs(got[v] - 100 * sum(x <= v for x in values) / 5000) <= 0.5


def test_params():
    assert Params.parse("coupling_min_shared: 7 # more\ncoupling_min_degree: 0.5\n") == Params(coupling_min_shared=7, coupling_min_degree=0.5)
    try:
        Params.parse("nonsense: 1")
    except ValueError:
        return
    raise AssertionError
