import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.operators import clones, cooccur, graph, timelines

DAY = 86_400


def commits(spark, *groups):
    return spark.createDataFrame([(g, f) for g, files in enumerate(groups) for f in files] or [(None, None)], "sha long, file string")


def pairs(df):
    return {(r["a"], r["b"]): (r["shared"], r["degree"]) for r in df.collect()}


def test_four_shared_edits_are_noise(spark):
    assert pairs(cooccur.cooccurrence(commits(spark, *[["a", "b"]] * 4), "sha", "file")) == {}
    assert pairs(cooccur.cooccurrence(commits(spark, *[["a", "b"]] * 6), "sha", "file")) == {("a", "b"): (6, 1.0)}


def test_degree_is_that_of_the_rarer_file(spark):
    rows = cooccur.cooccurrence(commits(spark, *[["a", "b"]] * 6, *[["b"]] * 30), "sha", "file").collect()
    assert [(r["degree"], r["solo_b"]) for r in rows] == [(1.0, 36)]


def test_mega_commits_and_repeats_do_not_count(spark):
    big = [f"f{i}" for i in range(30)]
    assert pairs(cooccur.cooccurrence(commits(spark, *[big] * 9), "sha", "file")) == {}
    assert pairs(cooccur.cooccurrence(commits(spark, *[["a", "a", "b"]] * 5), "sha", "file")) == {("a", "b"): (5, 1.0)}


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(3)
    groups = [[f"f{rng.randrange(12)}" for _ in range(rng.randrange(1, 6))] for _ in range(120)]
    want, solo = {}, {}
    for g in groups:
        for f in set(g):
            solo[f] = solo.get(f, 0) + 1
        for p in itertools.combinations(sorted(set(g)), 2):
            want[p] = want.get(p, 0) + 1
    want = {p: (n, n / min(solo[p[0]], solo[p[1]])) for p, n in want.items() if n >= 3 and n / min(solo[p[0]], solo[p[1]]) >= 0.1}
    assert pairs(cooccur.cooccurrence(commits(spark, *groups), "sha", "file", 25, 3, 0.1)) == want


def test_containment_and_crossings(spark):
    rows = spark.createDataFrame([(i, f, f) for i in range(10) for f in (["domain", "api"] if i < 4 else ["domain"])], "sha long, file string, layer string")
    layers = cooccur.group_layers(rows, "sha", "file", "layer")
    assert cooccur.containment(layers).first().asDict() == {"inside": 6, "across": 4, "ratio": 0.6}
    assert [(r["crossing"], r["n"], r["share"]) for r in cooccur.crossings(layers).collect()] == [("api + domain", 4, 1.0)]


def test_concentration_is_strict(spark):
    rows = spark.createDataFrame([("a", "x")] * 17 + [("a", "y")] * 3 + [("b", "x")] * 18 + [("b", "y")] * 2 + [("c", "x")] * 7, "file string, author string")
    assert [(r["item"], r["owner"], r["owner_share"]) for r in cooccur.concentration(rows, "file", "author").collect()] == [("b", "x", 0.9)]


def test_touch_cost(spark):
    rows = spark.createDataFrame([(6, "w")] * 5 + [(1, "n")] * 5, "width int, layer string")
    got = {r["layer"]: (r["groups"], r["median_width"], r["quantile_width"]) for r in cooccur.touch_cost(rows, "width", "layer").collect()}
    assert got == {None: (10, 3.5, 6), "w": (5, 6.0, 6), "n": (5, 1.0, 1)}


def timeline(spark, *events):
    return spark.createDataFrame([(k, int(d * DAY), i, fix) for i, (k, d, fix) in enumerate(events)], "file string, at long, n int, fix boolean")


def test_episodes_join_at_the_exact_gap(spark):
    rows = timeline(spark, ("a", 0, False), ("a", 2, False), ("a", 20, False), ("b", 0, False), ("b", 3, False))
    got = sorted((r["file"], r["events"]) for r in timelines.episodes(rows, "file", "at", "n", 3 * DAY).collect())
    assert got == [("a", 1), ("a", 2), ("b", 2)]
    assert timelines.episodes(rows, None, "at", "n", 3 * DAY).count() == 2


@pytest.mark.parametrize(("after", "rate"), [(2, 1.0), (14, 1.0), (30, 0.0), (0, 0.0), (-1, 0.0)])
def test_rework_window_is_open_below_and_closed_above(spark, after, rate):
    rows = timeline(spark, *[e for i in range(6) for e in (("a", 100 * i, False), ("a", 100 * i + after, True))])
    row = timelines.rework(rows, "file", "at", F.col("fix"), 14 * DAY).first()
    assert row["rate"] == rate and (row["median_delay"] == after * DAY if rate else row["median_delay"] is None)


def test_rework_total_row(spark):
    rows = timeline(spark, ("a", 0, False), ("a", 1, True), ("b", 0, False))
    got = {r["file"]: (r["changes"], r["reworked"]) for r in timelines.rework_with_total(rows, "file", "at", F.col("fix"), 14 * DAY).collect()}
    assert got == {"a": (1, 1), "b": (1, 0), None: (2, 1)}


def test_covered_ranges(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 4), ("a", 6, 8), ("a", 20, 20), ("b", 9, 1)], "k string, lo long, hi long")
    assert [(r["k"], r["islands"], r["covered"]) for r in timelines.covered(rows, "k", "lo", "hi").collect()] == [("a", 2, 9)]


def edges(spark, *es):
    return spark.createDataFrame(list(es) or [(None, None)], "src string, dst string")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cycle"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def test_cycles(spark):
    assert found(graph.cycles(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y")))) == [["a", "b", "c"], ["d", "e"]]
    assert found(graph.cycles(edges(spark, ("a", "b"), ("b", "c"), ("a", "a")))) == []


def test_cycles_against_brute_force(spark):
    rng = random.Random(7)
    es = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(48)]
    reach = {a: {a} for e in es for a in e}
    for _ in reach:
        for a, b in es:
            for r in reach.values():
                if a in r:
                    r.add(b)
    want = sorted({tuple(sorted(b for b in reach if b in reach[a] and a in reach[b])) for a in reach})
    assert found(graph.cycles(edges(spark, *es))) == [list(w) for w in want if len(w) > 1]


def test_lists_of_neighbours_cut_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 4)
    rows = edges(spark, *[("hub", f"n{i}") for i in range(20)], *[(f"n{i}", "hub") for i in range(20)], ("hub", "end"))
    lists = graph._lists(rows, "src", "dst").collect()
    assert sorted(x for r in lists if r["node"] == "hub" for x in r["others"]) == sorted(["end", *[f"n{i}" for i in range(20)]])
    assert max(len(r["others"]) for r in lists) < 20 and sum(len(r["others"]) for r in lists) == 41
    assert found(graph.cycles(rows)) == [sorted(["hub", *[f"n{i}" for i in range(20)]])]


def test_type_only_cycles_keep_set_equality(spark):
    runtime = edges(spark, ("a", "b"), ("b", "a"))
    full = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "p"))
    got = {}
    for r in graph.type_only_cycles(runtime, full).collect():
        got.setdefault(r["cycle"], []).append(r["node"])
    got = sorted(sorted(x) for x in got.values())
    assert got == [["a", "b", "c"], ["p", "q"]]


def test_barrels_expand_one_hop(spark):
    e = edges(spark, ("app", "init"), ("init", "x"), ("init", "y"), ("x", "app"), ("y", "z"))
    got = {(r["src"], r["dst"]) for r in graph.through_barrels(e, spark.createDataFrame([("init",), ("z",)], "node string")).collect()}
    assert got == {("app", "init"), ("init", "x"), ("init", "y"), ("x", "app"), ("y", "z"), ("app", "x"), ("app", "y")}


def test_coupled_with_and_without_edge(spark):
    p = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    e = edges(spark, ("b", "a"))
    assert [tuple(r) for r in graph.with_edge(p, e).collect()] == [("a", "b")] and [tuple(r) for r in graph.without_edge(p, e).collect()] == [("c", "d")]


def test_weak_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long")
    got = {}
    for r in graph.weak_components(links).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert got == {0: set(range(10)), 10: set(range(10, 21))}


def test_clones_find_the_copy_and_not_the_look_alike(spark):
    body = [f"t{i}" for i in range(30)]
    rows = [("one", body), ("copy", ["x", *body[:25]]), ("other", [f"u{i}" for i in range(30)]), ("short", body[:5])]
    owned = clones.windows(spark.createDataFrame(rows, "f string, w array<string>"), "f", "w", 10)
    assert [(r["a"], r["b"], r["shared"]) for r in clones.clone_pairs(owned).collect()] == [("copy", "one", 16)]
    assert clones.clone_pairs(owned, most=1).count() == 0 and clones.skipped_windows(owned, 1).first()[0] == 16
    assert {r["node"]: r["size"] for r in clones.clone_groups(clones.clone_pairs(owned)).collect()} == {"one": 2, "copy": 2}


def test_empty_inputs(spark):
    none = commits(spark).where("false")
    assert cooccur.cooccurrence(none, "sha", "file").count() == 0
    assert graph.weak_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.cycles(edges(spark).where("false")).count() == 0


def test_all_windows_are_shuffled_once(spark):
    rows = spark.range(8).select(F.col("id").alias("f"), F.array(*[F.lit(f"t{i}") for i in range(12)]).alias("w"))
    for found in (clones.clone_pairs(clones.windows(rows, "f", "w", 4)), clones.skipped_windows(clones.windows(rows, "f", "w", 4))):
        plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange") <= 2 and "Scan ExistingRDD" not in plan  # the other has pairs or sums; nothing was saved before


def test_clones_against_brute_force(monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([*range(30), None]), [rng.choice("ab") for _ in range(rng.randrange(30))]) for _ in range(80)]  # owners that repeat, one unknown
    sets = {}
    for owner, w in rows:
        for at in range(len(w) - 4):
            sets.setdefault(tuple(w[at : at + 5]), set()).add(owner)
    words = {c: hash(("word", c)) for c in "ab"}
    batches = [pa.RecordBatch.from_pydict({"owner": pa.array([o for o, _ in part], "int64"), "w": pa.array([[words[c] for c in w] for _, w in part], pa.list_(pa.int64())), "window": [5] * len(part)}) for i in range(0, 80, 7) if (part := [r for r in rows[i : i + 7] if len(r[1]) >= 5])]
    monkeypatch.setattr(clones, "PAIRS_AT_ONCE", 50)
    for at_once in (60, 1_000_000):
        monkeypatch.setattr(clones, "AT_ONCE", at_once)
        for most in (1, 6, 16, 30, 50):
            dealt = sorted((r for b in clones._packed(iter(batches), 6, most) for r in b.to_pylist()), key=lambda r: r["bucket"])
            dealt = [pa.RecordBatch.from_pylist(dealt[i : i + 5], pa.schema({"bucket": pa.int32(), "h": pa.list_(pa.int64()), "owner": pa.list_(pa.int64())})) for i in range(0, len(dealt), 5)]
            got, want = {}, {}
            for b in clones._pairs(iter(dealt), most):
                for r in b.to_pylist():
                    got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + r["shared"]
            for owners in sets.values():
                for a, b in itertools.combinations(sorted(owners - {None}), 2) if len(owners) <= most else ():
                    want[a, b] = want.get((a, b), 0) + 1
            assert got == want and sum(b["skipped"][0].as_py() for b in clones._skipped(iter(dealt), most)) == sum(len(o) > most for o in sets.values())
            assert sum(len(h) for b in dealt for h in b["h"].to_pylist()) <= len(sets) * (most + 1) or at_once == 60


def test_rows_a_task_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from heddle.operators import saving
    from heddle.plans import history

    for name, copies in (("one", 1), ("four", 4)):
        spark.range(10_000 * copies).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey")).coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        spark.range(9).select(F.col("id").alias("o_orderkey"), F.lit("x").alias("o_orderpriority"), F.current_timestamp().alias("o_orderdate")).write.parquet(str(tmp_path / name / "orders.parquet"))
    one, four = (saving.pieces(spark.read.parquet(str(tmp_path / x / "lineitem.parquet")), 0.01) for x in ("one", "four"))
    assert one > 1 and 3 * one <= four <= 5 * one
    monkeypatch.setattr(history, "pieces", lambda df: 13)
    monkeypatch.setattr(cooccur, "pieces", lambda df: 17)
    plan = lambda df: df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert ", 13), REPARTITION_BY_NUM" in plan(history._painful(spark, str(tmp_path / "one")))
    rows = spark.range(40).select((F.col("id") % 3).alias("g"), "id", F.lit("a").alias("layer")).unionByName(spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 2, "b")], "g long, id long, layer string"))
    layers = cooccur.group_layers(rows, "g", "id", "layer", 2)  # three groups are too large
    assert plan(layers).count(", 17), REPARTITION_BY_NUM") == 2 and [tuple(r) for r in layers.collect()] == [(7, ["a", "b"])]
