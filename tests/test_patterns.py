from pyspark.sql import functions as F

from heddle.operators import patterns as P


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "a string, b string, degree double")


def test_seams_and_holes(spark):
    coupled = pairs(spark, ("x", "y", 0.9), ("x", "z", 0.9), ("y", "z", 0.2))
    layers = spark.createDataFrame([("x", "ui"), ("y", "db"), ("z", "ui")], "node string, layer string")
    rules = spark.createDataFrame([("db", "ui", False)], "src_layer string, dst_layer string, allowed boolean")
    none, cycle = spark.createDataFrame([], "node string, cycle string"), spark.createDataFrame([("x", "x"), ("y", "x")], "node string, cycle string")
    assert [tuple(r) for r in P.nominal_seams(coupled, layers, rules, none, 0.5).collect()] == [("x", "y", 0.9)]
    assert P.nominal_seams(coupled, layers, rules, cycle, 0.5).count() == 0
    edges = spark.createDataFrame([("y", "x")], "src string, dst string")
    assert {(r["a"], r["b"]) for r in P.perimeter_holes(coupled, layers, rules, edges).collect()} == {("y", "z")}
    assert {(r["a"], r["b"]) for r in P.dead_links(cycle, coupled.where("degree > 2")).collect()} == {("x", "y")} and P.dead_links(cycle, coupled).count() == 0


def test_intent_and_history(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    hot = spark.createDataFrame([("b",)], "node string")
    assert [tuple(r) for r in P.intent_drift(edges, edges, hot).collect()] == [("a", "b")]
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert [tuple(r) for r in P.phantoms(nodes, hot).collect()] == [("a",)]
    assert [tuple(r) for r in P.blind_spots(nodes, spark.createDataFrame([("b", 9)], "node string, edits long"), 5).collect()] == [("a", 0)]
    one = P.available(spark.createDataFrame([("s1",), ("s1",)], "sha string"), 60).first()
    assert (one["commits"], one["available"], one["reason"]) == (1, False, "only 1 of 60 commits")
    files = spark.createDataFrame([("p/__init__.py",), ("q/__init__.py",), ("p/x.py",)], "file string")
    assert [tuple(r) for r in P.barrels(files, spark.createDataFrame([("p/__init__.py", "p/x.py"), ("p/x.py", "q")], "src string, dst string")).collect()] == [("p/__init__.py",)]


def test_colours(spark):
    row = spark.createDataFrame([(21, 1, 0.5, 0.8, 7, False, 5, 0.9)], "c int, n int, d double, k double, s int, i boolean, f int, o double")
    got = row.select(P.r1_complexity("c", "n"), P.r2_coupling("d", "k"), P.r3_copies("s"), P.r5_structure("i", "f"), P.r6_owner("o")).first()
    assert list(got) == ["red", "yellow", "yellow", "yellow", "red"]
    levels = P.read_levels(spark.createDataFrame([("a", 20), ("b", 80)], "file string, covered long"), spark.createDataFrame([("a", 100), ("b", 100), ("c", 10)], "file string, lines long"))
    assert {r["file"]: r["share"] for r in levels.select("file", F.col("share")).collect()} == {"a": 0.0, "b": 0.8, "c": 0.0}
