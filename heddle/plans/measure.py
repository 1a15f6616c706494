"""A repository measured in one call: history, tree, graph, behaviour and calibration as one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.functions.params import DAY, DEFAULTS
from heddle.operators import clones as CL
from heddle.operators import cooccur as CO
from heddle.operators import graph as G
from heddle.operators import hotspots as H
from heddle.operators import ledger as L
from heddle.operators import timelines as T
from heddle.operators.ranks import beside, exact_median
from heddle.operators.saving import release, saved
from heddle.sources import gitlog, source_text
from heddle.sources.layout import package_roots


def _head(df: DataFrame, name: str, k: int, *order) -> DataFrame:
    """One row: the first k rows as a list, and how many there are."""
    df = saved(df)
    first = H.top(df, k, *order).agg(F.collect_list(F.struct(*df.columns)).alias(name))  # at most k rows
    return beside(first, df.agg(F.count("*").alias(f"{name}_total")))


def measure(spark: SparkSession, repo: str, layer_depth: int = 1, branch_control: str = "ok") -> DataFrame:
    """One row: snapshot, structure, behaviour, calibration. repo: a working copy that git can read.

    Lists are heads with their totals beside them; whoever needs whole relations takes the operators.
    """
    spark.dataSource.register(gitlog.GitHistory)
    commits = saved(spark.read.format("git_history").option("repo", repo).load())
    tree = saved(source_text.read_tree(spark, repo))
    roots = tuple(package_roots(tree, "file"))

    rows = gitlog.commit_files(commits).withColumn("class", C.path_class("file"))
    traffic = saved(rows.groupBy("class").agg(F.count("*").alias("edits")))
    code = rows.where("class = 'code'").select("sha", "author", "epoch", "subject", "file", C.layer_of("file", roots, layer_depth).alias("layer"), C.is_fix("subject").alias("fix"))
    code = saved(code)

    resolved = saved(source_text.resolve(source_text.import_specs(tree), tree, roots))
    every = source_text.import_edges(resolved)
    edges = saved(every.where("kind = 'runtime'").select("src", "dst").distinct())
    sizes = saved(tree.where(C.path_class("file") == "code").select(F.col("file").alias("item"), F.size(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("size")))
    metrics = source_text.file_metrics(tree)
    rings = saved(G.cycles(edges))

    structure = beside(
        tree.agg(F.count("*").alias("files")), edges.agg(F.count("*").alias("edges")), source_text.type_edge_total(resolved), rings.agg(F.countDistinct("cycle").alias("runtime_cycles"), F.array_sort(F.collect_set("node")).alias("cycle_members")),
        _head(G.hubs(edges), "hubs", 25, F.desc("total"), "node"), _head(metrics.where("loc is not null"), "complex_files", 25, F.desc("cyclomatic_max"), "file"), _head(source_text.external_packages(resolved), "external", 25, F.desc("n"), "package"),
    )
    release(spark)

    fixes = code.where("fix").select(F.col("sha").alias("group"))
    pairs = saved(CO.cooccurrence(code, "sha", "file"))
    widths = code.groupBy("sha").agg(F.countDistinct("file").alias("w"))
    seen = saved(T.next_within(code, "file", "epoch", F.col("fix"), DEFAULTS.rework_window_days * DAY).where("not fix").select((F.col("next_at") - F.col("epoch")).alias("delay")))
    episodes = T.episode_totals(T.episodes(code.select("file", "epoch", "sha"), "file", "epoch", "sha", DEFAULTS.episode_gap_days * DAY))
    layers = CO.group_layers(code, "sha", "file", "layer")
    behaviour = beside(
        code.agg(F.countDistinct("sha").alias("commits_with_code")), traffic.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "edits")))).alias("traffic")), _head(pairs, "temporal_coupling", 40, F.desc("degree"), F.desc("shared"), "a", "b"),
        CO.containment(layers).select(F.col("ratio").alias("containment_ratio")), _head(H.hotspots(code, "sha", "file", fixes, sizes), "hotspots", 25, F.desc("score"), "item"), _head(CO.concentration(code, "file", "author"), "knowledge_risk", 20, F.desc("edits"), "item"),
        CO.touch_cost(widths, "w").select(F.col("quantile_width").alias("touch_cost_p90"), "median_width"), episodes.select(F.col("multi_share").alias("episodes_multi_share"), F.col("median_multi_span")),
        seen.agg(C.ratio(F.count("delay"), F.count("*")).alias("rework_rate")), exact_median(seen, "delay", "fix_latency_median"),
        _head(T.unstable(T.rework(code, "file", "epoch", F.col("fix"), DEFAULTS.rework_window_days * DAY), "file"), "unstable", 20, F.desc("rate_low"), F.desc("changes"), "file"),
    )
    release(spark)

    owned = CL.windows(source_text.token_arrays(tree), "file", "tokens")
    copies = _head(CL.clone_pairs(owned), "clones", 40, F.desc("shared"), "a", "b")
    structure, behaviour, copies = saved(structure), saved(behaviour), saved(copies)
    regex = source_text.import_specs(tree).where("backend = 'regex'").agg(F.countDistinct("file").alias("regex_files"))
    tests = traffic.agg(F.coalesce(F.sum(F.when(F.col("class") == "test", F.col("edits"))), F.lit(0)).alias("tests"))
    facts = beside(behaviour.select(F.col("commits_with_code").alias("commits"), F.col("temporal_coupling_total").alias("pairs")), tests, regex, structure.select("files", "edges")).withColumn("control", F.lit(branch_control))
    checks = saved(L.calibration(facts))
    judged = checks.agg(F.collect_list(F.struct("check", "passed", "blocks")).alias("checks"), F.min("passed").alias("passed"))  # a row a rule
    nested = [df.select(F.struct(*df.columns).alias(name)) for name, df in (("structure", structure), ("behaviour", behaviour), ("copies", copies), ("calibration", judged))]
    return beside(*nested).withColumn("ceiling", F.when(F.col("calibration.passed"), "verdict").otherwise("finding"))
