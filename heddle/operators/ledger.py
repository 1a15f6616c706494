"""Findings and runs: snapshots, gates, self-checks, verdicts, plans, budgets. Whole relations, never truncated lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import gain_reached, hash_order, lens_key, lower_ceiling, ratio, sarif_level
from heddle.functions.params import DEFAULTS

REQUIRED = ("id", "title", "risk", "symptom", "source", "cost_pain", "remedy", "remedy_cost", "gain", "gain_metric", "gain_target", "refutation", "confidence")
MEASURES = ("containment_ratio", "runtime_cycles", "coupling_pairs", "edges", "files", "rework_rate", "touch_cost_p90", "fix_latency_median_days")
MODES, VERDICTS = ("parallel", "sequential"), ("confirmed", "refuted", "weakened")


# -- gates --------------------------------------------------------------------------------------


def set_changes(now: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """(key, change) with change new or healed; equal members are left out."""
    a, b = now.select(key).distinct(), base.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("new")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("healed")))


def gate(snapshots: DataFrame, members: DataFrame, base: str, now: str, containment_drop: float = DEFAULTS.gate_containment_drop, rework_rise: float = DEFAULTS.gate_rework_rise, max_new_cycles: int = 0) -> DataFrame:
    """One row: status OK, REGRESSION or NO_BASELINE, deltas and counts of new members.

    snapshots: (run, containment, rework), one row a run; members: (run, kind, member), kind cycle,
    painful or unstable.
    """
    runs = snapshots.where(F.col("run").isin(base, now)).groupBy().agg(
        *[F.max(F.when(F.col("run") == r, F.col(c))).alias(f"{c}_{k}") for c in ("containment", "rework") for k, r in (("base", base), ("now", now))], F.count(F.when(F.col("run") == base, 1)).alias("has_base")
    )
    side = lambda r: members.where(F.col("run") == r).select("kind", "member").distinct()
    fresh = side(now).join(side(base), ["kind", "member"], "left_anti")
    counts = fresh.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"new_{k}") for k in ("cycle", "painful", "unstable")])
    one = runs.withColumn("one", F.lit(1)).join(counts.withColumn("one", F.lit(1)), "one").drop("one")
    one = one.withColumn("containment_delta", F.col("containment_now") - F.col("containment_base")).withColumn("rework_delta", F.col("rework_now") - F.col("rework_base"))
    worse = [F.col("new_cycle") > max_new_cycles, F.col("new_painful") > 0, F.col("new_unstable") > 0, F.col("containment_delta") < containment_drop, F.col("rework_delta") > rework_rise]
    bad = F.lit(False)
    for w in worse:
        bad = bad | F.coalesce(w, F.lit(False))
    status = F.when(F.col("has_base") == 0, "NO_BASELINE").when(bad, "REGRESSION").otherwise("OK")
    return one.select(status.alias("status"), "containment_delta", "rework_delta", "new_cycle", "new_painful", "new_unstable")


def gate_deltas(snapshots: DataFrame, base: str, now: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(measure, base, now, delta) of every measure of two runs, four decimal places; null where a run lacks it. snapshots: (run, *measures)."""
    side = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c).cast("double")))
    one = snapshots.where(F.col("run").isin(base, now)).agg(*[side(r, m).alias(f"{m}_{k}") for m in measures for k, r in (("base", base), ("now", now))])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_base").alias("base"), F.col(f"{m}_now").alias("now")) for m in measures])
    return one.select(F.explode(rows).alias("r")).select("r.*", F.bround(F.col("r.now") - F.col("r.base"), 4).alias("delta"))


# -- findings -----------------------------------------------------------------------------------


def with_refutations(findings: DataFrame, refutations: DataFrame) -> DataFrame:
    """findings with their refutations nested, by lens; an empty list where there is none."""
    fields = ["lens", "verdict", "reason", "mode"]
    nested = refutations.groupBy(F.col("finding_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("refutations"))
    empty = F.expr("cast(array() as array<struct<lens:string,verdict:string,reason:string,mode:string>>)")
    return findings.join(nested, "id", "left").withColumn("refutations", F.coalesce("refutations", empty))


def refutation_mode(refutations: DataFrame) -> DataFrame:
    """(finding_id, mode, cap): parallel, sequential or mixed; only parallel may reach a verdict."""
    modes = refutations.groupBy("finding_id").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    mode = F.when(F.size("modes") == 0, "none").when(F.size("modes") > 1, "mixed").otherwise(F.col("modes")[0])
    return modes.select("finding_id", mode.alias("mode"), F.when(mode == "parallel", "verdict").otherwise("finding").alias("cap"))


def selfcheck(findings: DataFrame, refutations: DataFrame, metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, problem) for every rule that a finding breaks. metrics: (metric); sources: (source) that resolve."""
    blank = [findings.where(F.trim(F.coalesce(c, F.lit(""))) == "").select("id", F.lit(f"blank {c}").alias("problem")) for c in REQUIRED]
    each = findings.select("id", F.explode(F.transform(F.split("source", ";"), lambda x: F.trim(x))).alias("source")).where("source <> ''")
    unresolved = each.join(sources, "source", "left_anti").select("id", F.concat(F.lit("unresolved "), "source").alias("problem"))
    gains = findings.where("coalesce(gain_metric, 'manual') <> 'manual'").join(metrics.select(F.col("metric").alias("gain_metric")), "gain_metric", "left_anti").select("id", F.concat(F.lit("unknown metric "), "gain_metric").alias("problem"))
    mode = F.coalesce("mode", F.lit(""))
    seen = refutations.groupBy("finding_id").agg(F.countDistinct(lens_key("lens")).alias("lenses"), F.count(F.when(mode == "parallel", 1)).alias("parallel"), F.count(F.when(mode == "", 1)).alias("undeclared"), F.count("*").alias("n"))
    judged = findings.join(seen.withColumnRenamed("finding_id", "id"), "id", "left").na.fill(0, ["lenses", "parallel", "undeclared", "n"])
    verdict = F.coalesce(F.col("confidence") == "verdict", F.lit(False))
    asked = judged.where((F.coalesce(F.expr("try_cast(priority as int)"), F.lit(0)) >= 6) | verdict)
    need = asked.where("n = 0").select("id", F.lit("not refuted").alias("problem"))
    rules = ((F.col("undeclared") > 0, "undeclared mode"), (verdict & (F.col("parallel") == 0), "verdict without a parallel lens"), (verdict & (F.col("lenses") < 2), "verdict of one lens"))
    weak = asked.where("n > 0").select("id", F.explode(F.filter(F.array(*[F.when(r, F.lit(text)) for r, text in rules]), lambda x: x.isNotNull())).alias("problem"))
    out = blank[0]
    for more in [*blank[1:], unresolved, gains, need, weak]:
        out = out.unionByName(more)
    return out


def run_mode(findings: DataFrame, refutations: DataFrame) -> DataFrame:
    """One row for a whole run: mode (none, parallel, sequential, undeclared or mixed), refutations without a mode, and findings asked for refutation that no parallel lens saw."""
    mode = F.coalesce("mode", F.lit(""))
    kinds = refutations.agg(F.collect_set(F.when(mode.isin(*MODES), mode)).alias("modes"), F.count(F.when(mode == "", 1)).alias("undeclared"), F.count("*").alias("n"))  # at most MODES
    level = F.when(F.col("n") == 0, "none").when(F.size("modes") > 1, "mixed").when(F.size("modes") == 0, "undeclared").otherwise(F.col("modes")[0])
    seen = refutations.where(mode == "parallel").select(F.col("finding_id").alias("id")).distinct()
    any_lens = refutations.select(F.col("finding_id").alias("id")).distinct()
    asked = findings.where((F.coalesce(F.expr("try_cast(priority as int)"), F.lit(0)) >= 6) | F.coalesce(F.col("confidence") == "verdict", F.lit(False))).select("id")
    alone = asked.join(any_lens, "id", "left_semi").join(seen, "id", "left_anti").agg(F.count("*").alias("sequential_findings"))
    return kinds.select(level.alias("mode"), "undeclared", F.lit(1).alias("one")).join(alone.withColumn("one", F.lit(1)), "one").drop("one")


def rejected_rows(rows: DataFrame, known: DataFrame, enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, problem) of rows to append that repeat an id or have a value outside its enumeration."""
    repeated = rows.join(known.select("id"), "id", "left_semi").unionByName(rows.join(rows.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi")).select("id", F.lit("repeated id").alias("problem")).distinct()
    for name, values in enums.items():
        repeated = repeated.unionByName(rows.where(F.col(name).isNotNull() & ~F.col(name).isin(*values)).select("id", F.concat(F.lit(f"{name}: "), name).alias("problem")))
    return repeated


def verify_gains(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Of findings that are done: actual value, and whether the gain is reached. metrics: (metric, value)."""
    done = findings.where(F.lower("status").isin("done", "fixed", "закрыта"))
    joined = done.join(metrics.toDF("gain_metric", "actual"), "gain_metric", "left")
    target = F.regexp_replace("gain_target", ",", ".").cast("double")
    return joined.select("id", "gain_metric", "actual", gain_reached("actual", target, "gain_direction").alias("reached"))


def measured_gains(rows: DataFrame) -> DataFrame:
    """(id, direction, reached) of (id, before, after, target, direction), all text: numbers may have a decimal comma, anything else is
    unknown (booleans too), and a missing direction is the way from before to target."""
    number = lambda c: F.regexp_replace(F.trim(F.col(c)), ",", ".").try_cast("double")
    before, target = number("before"), number("target")
    way = F.when(F.col("direction").isin("up", "down"), F.col("direction")).when(target < before, "down").when(target >= before, "up")
    each = rows.select("id", way.alias("direction"), number("after").alias("actual"), target.alias("target"))
    return each.select("id", "direction", gain_reached("actual", "target", "direction").alias("reached"))


def sarif(findings: DataFrame) -> DataFrame:
    """One row, column `sarif`: a SARIF 2.1.0 document of findings (id, risk, title, priority, files). A sink: its rules and results are lists."""
    rules = findings.groupBy("risk").agg(F.min_by("title", "id").alias("title")).select(F.struct(F.col("risk").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription")).alias("r"))
    place = lambda f: F.struct(F.struct(F.struct(f.alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    result = F.struct(F.col("risk").alias("ruleId"), sarif_level(F.coalesce(F.expr("try_cast(priority as int)"), F.lit(0))).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.transform("files", place).alias("locations"))
    lists = rules.agg(F.array_sort(F.collect_list("r")).alias("rules")).withColumn("one", F.lit(1)).join(findings.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", result.alias("r")))), lambda x: x["r"]).alias("results")).withColumn("one", F.lit(1)), "one")
    run = F.struct(F.struct(F.struct(F.lit("heddle").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return lists.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


# -- trials, plans, budgets ---------------------------------------------------------------------


def trial_verdicts(checks: DataFrame, trials: DataFrame) -> DataFrame:
    """(variant, verdict): rejected, unverified or accepted. checks: (variant, name, status, is_test); trials: (variant, empty_diff, gain, payback, partial)."""
    by = checks.groupBy("variant").agg(F.count(F.when(F.col("status") == "fail", 1)).alias("fails"), F.count(F.when(F.col("status") == "unverified", 1)).alias("open"), F.count(F.when(F.col("is_test"), 1)).alias("tests"))
    each = trials.join(by, "variant", "left").na.fill(0, ["fails", "open", "tests"])
    missed = (F.col("gain") == "missed") & ~F.coalesce("partial", F.lit(False))
    verdict = F.when((F.col("fails") > 0) | F.col("empty_diff") | missed | (F.col("payback") != "ok"), "rejected").when((F.col("open") > 0) | (F.col("gain") == "unverified") | (F.col("tests") == 0), "unverified").otherwise("accepted")
    return each.select("variant", verdict.alias("verdict"))


def critic_outcomes(verdicts: DataFrame, least: int = 2) -> DataFrame:
    """(item, outcome) from (item, critic, verdict): fail with too few critics, stop if any drops it, else go."""
    by = verdicts.groupBy("item").agg(F.countDistinct("critic").alias("critics"), F.count(F.when(F.col("verdict") == "dropped", 1)).alias("dropped"))
    return by.select("item", F.when(F.col("critics") < least, "fail").when(F.col("dropped") > 0, "stop").otherwise("go").alias("outcome"))


def plan_items(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Full join of findings and decisions (both by id): included or not, and the fact over the forecast."""
    own = findings.select("id", F.lit(True).alias("found"), "priority")
    both = own.join(decisions, "id", "full_outer")
    payback = F.coalesce("trial_payback", "lead_payback")
    out = F.when(F.col("decision").isNull() | (F.col("decision") == "rejected"), False).when(F.col("trial_payback").isNull() & F.coalesce(F.col("lead_payback").isin("too_costly", "cold"), F.lit(False)), False).otherwise(True)
    return both.select("id", F.coalesce("found", F.lit(False)).alias("found"), "priority", payback.alias("payback"), F.coalesce("trial_variant", "lead_variant").alias("variant"), out.alias("included"))


def plan_order(items: DataFrame, stage: str, risk: str, priority: str, key: str) -> DataFrame:
    """items with their place by stage, risk, then falling priority. The plan of one repository: bounded by its findings."""
    order = Window.orderBy(stage, risk, F.col(priority).desc(), key)
    return items.withColumn("place", F.row_number().over(order))


def plan_phases(items: DataFrame, key: str, phases: str, place: str) -> DataFrame:
    """One row per phase with a running number over all items."""
    each = items.select(key, place, F.posexplode_outer(phases).alias("phase", "text"))
    return each.withColumn("number", F.row_number().over(Window.orderBy(place, "phase")))


def after_dependencies(order: list[str], needs: dict[str, set[str]]) -> list[str]:
    """order, each item moved behind the last of those it needs; at most len(order) passes. For one plan, on the driver."""
    out = list(order)
    for _ in out:
        moved = False
        for item in list(out):
            last = max((out.index(n) for n in needs.get(item, ()) if n in out), default=-1)
            if last > out.index(item):
                out.remove(item)
                out.insert(last, item)
                moved = True
        if not moved:
            break
    return out


def within_budget(rows: DataFrame, key: str, order: list[Column], text: str, budget: int = DEFAULTS.slice_budget_bytes) -> DataFrame:
    """rows per key, in order, as long as their bytes add up to at most budget; and how many of the key were dropped."""
    run = Window.partitionBy(key).orderBy(*order)
    upto = rows.withColumn("bytes", F.octet_length(text)).withColumn("upto", F.sum("bytes").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    kept = upto.withColumn("dropped", F.count(F.when(F.col("upto") > budget, 1)).over(Window.partitionBy(key)))
    return kept.where(F.col("upto") <= budget).drop("bytes")


def fingerprint_gate(now: DataFrame, base: DataFrame) -> DataFrame:
    """(id, problem) where two sets of (id, digest) differ: missing, added or changed."""
    both = base.select("id", F.col("digest").alias("d0")).join(now.select("id", F.col("digest").alias("d1")), "id", "full_outer")
    problem = F.when(F.col("d1").isNull(), "missing").when(F.col("d0").isNull(), "added").otherwise("changed")
    return both.where(~F.col("d0").eqNullSafe(F.col("d1"))).select("id", problem.alias("problem"))


# -- calibration and evaluation -----------------------------------------------------------------


def calibration(facts: DataFrame) -> DataFrame:
    """(check, passed, blocks) from one row: commits, tests, regex_files, files, edges, pairs, control."""
    rules = [
        ("history", F.col("commits") >= DEFAULTS.min_commits, "coupling,rework"), ("tests", F.col("tests") > 0, "churn"), ("backend", F.col("regex_files") == 0, "complexity"),
        ("edges", F.col("edges") >= 0.3 * F.col("files"), "graph"), ("pairs", F.col("pairs") <= 0.5 * F.col("commits"), "coupling"), ("control", F.col("control") == "ok", "clones"),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), F.lit(b).alias("blocks")) for n, p, b in rules])
    return facts.select(F.explode(each).alias("c")).select("c.*")


def blocked(checks: DataFrame) -> DataFrame:
    """(metric): what failing checks block, each once."""
    return checks.where(~F.col("passed")).select(F.explode(F.split("blocks", ",")).alias("metric")).distinct()


def ceiling(a: Column | str, reasons: Column) -> Column:
    """The ceiling, lowered to finding where a reason holds."""
    return F.when(reasons, lower_ceiling(a, F.lit("finding"))).otherwise(F.col(a) if isinstance(a, str) else a)


def confusion(rows: DataFrame, expected: str, predicted: str, *by: str) -> DataFrame:
    """Per key: n, recall of expected rows and share of false positives among the others."""
    e, p = F.col(expected), F.col(predicted)
    return rows.where(e.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), ratio(F.count(F.when(e & p, 1)), F.count(F.when(e, 1))).alias("recall"), ratio(F.count(F.when(~e & p, 1)), F.count(F.when(~e, 1))).alias("false_positives")
    )


def control_recall(base: DataFrame, control: DataFrame, most: float = 0.25) -> DataFrame:
    """One row: the control's recall over ids that both have, and whether it stays low enough. Both: (id, hit)."""
    both = control.join(base.select("id"), "id", "left_semi")
    return both.agg(F.avg(F.col("hit").cast("double")).alias("recall")).withColumn("passed", F.col("recall") <= most)


def changed(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key) whose value differs between two runs."""
    return base.join(other.select(key, F.col(value).alias("__other")), key).where(~F.col(value).eqNullSafe(F.col("__other"))).select(key)


def shuffled(rows: DataFrame, seed: str, key: str) -> DataFrame:
    """rows with a fixed pseudo-random place for each seed."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(seed).orderBy(hash_order(seed, key), key)))


def expect(df: DataFrame, spec: dict) -> DataFrame:
    """(expectation, got) for every named expectation that df's only row doesn't meet; unknown names are errors.

    Names: min_<column>, max_<column>, eq_<column>, has_<column> and lacks_<column> (of an array).
    """
    out = []
    for name, value in spec.items():
        kind, _, column = name.partition("_")
        c = F.col(column)
        holds = {"min": lambda c=c, v=value: c >= v, "max": lambda c=c, v=value: c <= v, "eq": lambda c=c, v=value: c == F.lit(v), "has": lambda c=c, v=value: F.array_contains(c, v), "lacks": lambda c=c, v=value: ~F.array_contains(c, v)}.get(kind)
        if holds is None or column not in df.columns:
            raise ValueError(f"unknown expectation: {name}")
        out.append(F.struct(F.lit(f"{name}={json.dumps(value)}").alias("expectation"), F.coalesce(holds(), F.lit(False)).alias("ok"), c.cast("string").alias("got")))
    return df.select(F.explode(F.array(*out)).alias("e")).where("not e.ok").select("e.expectation", "e.got")
