"""Records, findings and runs bound to the star-schema tables, and the same questions in SQL.

A finding is a part, what refutes it are its order lines; a variant is a supplier, its checks are its order lines;
a commit is an order. Literal tables stand in only where an operator reads a language.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.functions.documents import at_path
from heddle.operators import clones as CL
from heddle.operators import graph as G
from heddle.operators import hotspots as H
from heddle.operators import ledger as L
from heddle.operators import lint
from heddle.operators import lookups as LK
from heddle.operators import patterns as PT
from heddle.operators import prune as P
from heddle.plans import history as B
from heddle.sources import gitlog, source_text
from heddle.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}
t, us = B.t, B.us


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- sources ------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT 'p/' || l_partkey || '.py')) AS files FROM lineitem GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS sha, 'c' || o_custkey AS author, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE epoch(o_orderdate)::BIGINT END AS epoch,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: ' ELSE 'feat: ' END || o_orderpriority AS subject, coalesce(array_to_string(files, '|'), '') AS files FROM orders LEFT JOIN f ON k = o_orderkey""")
def history_records(spark, d):
    """Orders written as history text and parsed again."""
    files = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p/"), "l_partkey", F.lit(".py")))).alias("files"))
    when = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.floor(us("o_orderdate") / 1_000_000).cast("string"))
    subject = F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "fix: ").otherwise("feat: "), "o_orderpriority")
    head = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), "o_custkey"), when, subject)
    text = t(spark, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat_ws("\n", head, F.lit("\r"), F.array_join("files", "\r\n")).alias("value"))
    return gitlog.parse_records(text).withColumn("files", F.array_join("files", "|"))


@query("""SELECT 'src/' || p_brand || '.py' AS file, p_size AS line, CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'code' ELSE 'import' END AS kind,
    CASE p_partkey % 3 WHEN 1 THEN '' ELSE p_type END AS name, (60 + p_partkey % 41)::INT AS confidence, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size_lines FROM part WHERE p_partkey % 5 <> 0""")
def dead_code_report(spark, d):
    """Parts written as lines of a dead-code report, every fifth as noise, and parsed again."""
    kind = F.element_at(F.array(F.lit("unused function"), F.lit("unreachable code after 'return'"), F.lit("unused import")), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 3 == 1, "").otherwise(F.concat(F.lit(" '"), "p_type", F.lit("'")))
    lines = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", "), "p_size", F.when(F.col("p_size") == 1, " line").otherwise(" lines"))).otherwise("")
    text = F.concat(F.lit("src/"), "p_brand", F.lit(".py:"), "p_size", F.lit(": "), kind, name, F.lit(" ("), (60 + F.col("p_partkey") % 41).cast("string"), F.lit("% confidence"), lines, F.lit(")"))
    return P.parse_report(t(spark, d, "part").select(F.when(F.col("p_partkey") % 5 == 0, "no finding here").otherwise(text).alias("value")))


_TREE = ["src/user/__init__.py", "src/user/model.py", "src/user/repository.py", "src/core/db.py", "web/shared/api/index.ts", "web/pages/home.tsx", "web/pages/foo.service.ts", "b/util.ts", "a/x.ts"]
_SPECS = [
    ("src/x.py", "src.user"), ("src/user/repository.py", "src.user.model"), ("src/user/repository.py", ".model"), ("src/user/repository.py", "..core.db"), ("web/pages/home.tsx", "../shared/api"), ("web/pages/home.tsx", "@/shared/api"),
    ("web/pages/home.tsx", "./foo.service"), ("a/x.ts", "../b/util"), ("src/x.py", "fastapi"), ("web/pages/home.tsx", "react"), ("web/pages/home.tsx", "@tanstack/react-query"), ("src/core/db.py", "core.db"),
]


@query("""SELECT * FROM (VALUES ('src/x.py', 'src/user/__init__.py', 'runtime'), ('src/user/repository.py', 'src/user/model.py', 'runtime'), ('src/user/repository.py', 'src/core/db.py', 'runtime'),
    ('web/pages/home.tsx', 'web/shared/api/index.ts', 'runtime'), ('web/pages/home.tsx', 'web/pages/foo.service.ts', 'runtime'), ('a/x.ts', 'b/util.ts', 'runtime')) e(src, dst, kind)""")
def import_edges(spark, d):
    """Imports of a literal tree resolved to files; the answers are written out by hand."""
    files = spark.createDataFrame([(f,) for f in _TREE], "file string")
    specs = spark.createDataFrame([(*x, "runtime") for x in _SPECS], "file string, spec string, kind string")
    return source_text.import_edges(source_text.resolve(specs, files, ("src", "web")))


_HOST = "regexp_extract(url, '^[^:]*://([^/?#]*)', 1)"


@query(f"WITH p AS (SELECT page_id, '@' || {_HOST} || '/x' AS spec FROM pages) SELECT regexp_extract(spec, '^@?([^/.:]+)', 1) AS package, count(*) AS n FROM p WHERE page_id % 3 <> 0 GROUP BY 1")
def external_packages(spark, d):
    spec = F.concat(F.lit("@"), F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.lit("/x"))
    rows = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("file"), spec.alias("spec"), F.when(F.col("page_id") % 3 == 0, "here").alias("target"))
    return source_text.external_packages(rows)


@query("""SELECT CASE l_linenumber % 3 WHEN 0 THEN 'ast' WHEN 1 THEN 'regex' ELSE 'none' END AS backend, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY 1""")
def backend_counts(spark, d):
    backend = F.element_at(F.array(F.lit("ast"), F.lit("regex"), F.lit("none")), F.col("l_linenumber") % 3 + 1)
    return source_text.backend_counts(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), backend.alias("backend")))


@query("SELECT count(*) AS type_edges FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0")
def type_edge_total(spark, d):
    rows = t(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "type").otherwise("runtime").alias("kind"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("target"))
    return source_text.type_edge_total(rows)


_PATH = "regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, parse_filename(path) AS base, CASE WHEN contains(path, '/') THEN path[:-(length(parse_filename(path)) + 2)] ELSE '' END AS dir,
    coalesce(regexp_extract(parse_filename(path), '^\\.*[^.].*?(\\.[^.]*)$', 1), '') AS ext, path AS normal FROM p""")
def path_parts(spark, d):
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1)
    rows = t(spark, d, "pages").select("page_id", path.alias("path"))
    messy = F.concat(F.lit("./a/../"), F.replace(F.col("path"), F.lit("/"), F.lit("/.//")))
    kept = F.when(F.col("path").endswith("/"), F.concat(source_text.normalized(messy), F.lit("/"))).otherwise(source_text.normalized(messy))
    return rows.select("page_id", C.basename("path").alias("base"), C.dirname("path").alias("dir"), C.extension("path").alias("ext"), kept.alias("normal"))


@query("""SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day FROM orders""")
def utc_dates(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.utc_date(F.floor(us("o_orderdate") / 1_000_000)).alias("day"))


@query("""WITH g AS (SELECT l_orderkey, list({'file': 'f' || l_linenumber, 'n': l_partkey} ORDER BY l_linenumber, l_partkey) AS r FROM lineitem GROUP BY 1)
    SELECT l_orderkey, r[1].n AS first, list_filter(r, lambda x: x.file = 'f3')[1].n AS third, r[6].file AS sixth FROM g""")
def document_paths(spark, d):
    """Path expressions over nested documents."""
    each = t(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat(F.lit("f"), "l_linenumber").alias("file"), F.col("l_partkey").alias("n")).alias("r"))
    docs = each.groupBy("l_orderkey").agg(F.struct(F.array_sort(F.collect_list("r")).alias("rows")).alias("m"))
    return docs.select("l_orderkey", at_path("m", "rows[0].n").alias("first"), at_path("m", "rows[file=f3].n").alias("third"), at_path("m", 'rows[5]["file"]').alias("sixth"))


@query("""SELECT l_orderkey, l_linenumber, 'a' || l_partkey || '.py|b.py' AS files, CASE l_linenumber % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'price of change' ELSE 'l5' END AS lens FROM lineitem""")
def sources_and_lenses(spark, d):
    """Files that path expressions name, and the keys of lenses written in several ways."""
    source = F.concat(F.lit("h[file=a"), "l_partkey", F.lit(".py].edits; c[file=b.py].n; h[file=a"), "l_partkey", F.lit(".py].fixes"))
    lens = F.element_at(F.array(F.lit(" L1 cost"), F.lit(" Price of change "), F.lit("L5")), F.col("l_linenumber") % 3 + 1)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(C.source_files(source), "|").alias("files"), C.lens_key(lens).alias("lens"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 4 = 1 THEN 'open-plan' WHEN o_orderkey % 4 = 2 THEN 'none' ELSE '__unparsed__:no idea ' || o_orderkey END AS answer FROM orders""")
def answers(spark, d):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    said = F.when(k % 4 == 0, F.concat(F.lit(' "'), status, F.lit('".\nbecause'))).when(k % 4 == 1, F.concat(F.lit("I pick open-plan, not "), status)).when(k % 4 == 2, "`None`").otherwise(F.concat(F.lit("No idea "), k))
    return t(spark, d, "orders").select("o_orderkey", C.normalized_answer(said, ("f", "o", "p", "open-plan", "none")).alias("answer"))


# -- findings -----------------------------------------------------------------------------------

_LENS = "CASE l_linenumber % 3 WHEN 0 THEN 'L1 cost' WHEN 1 THEN 'L1' ELSE 'L3' END"
_MODE = "CASE WHEN l_quantity > 47 THEN NULL WHEN l_linestatus = 'O' THEN 'parallel' ELSE 'sequential' END"
_REFS = f"refs AS (SELECT l_partkey AS finding_id, {_LENS} AS lens, {_MODE} AS mode, l_returnflag AS verdict FROM lineitem WHERE l_partkey % 4 <> 0 AND l_quantity > 35)"


def _refutations(spark, d):
    lens = F.element_at(F.array(F.lit("L1 cost"), F.lit("L1"), F.lit("L3")), F.col("l_linenumber") % 3 + 1)
    mode = F.when(F.col("l_quantity") > 47, None).when(F.col("l_linestatus") == "O", "parallel").otherwise("sequential")
    rows = t(spark, d, "lineitem").where("l_partkey % 4 <> 0 and l_quantity > 35")
    return rows.select(F.col("l_partkey").alias("finding_id"), lens.alias("lens"), F.col("l_returnflag").alias("verdict"), F.lit("").alias("reason"), mode.alias("mode"))


@query(f"""WITH {_REFS}, n AS (SELECT finding_id, list_sort(list(lens || ':' || verdict)) AS r FROM refs GROUP BY 1)
    SELECT p_partkey AS id, coalesce(array_to_string(r, ','), '') AS refutations FROM part LEFT JOIN n ON finding_id = p_partkey""")
def findings_with_refutations(spark, d):
    nested = L.with_refutations(t(spark, d, "part").select(F.col("p_partkey").alias("id")), _refutations(spark, d))
    return nested.select("id", F.array_join(F.array_sort(F.transform("refutations", lambda r: F.concat_ws(":", r["lens"], r["verdict"]))), ",").alias("refutations"))


@query(f"""WITH {_REFS}, m AS (SELECT finding_id, list_sort(list(DISTINCT mode) FILTER (mode IS NOT NULL)) AS modes FROM refs GROUP BY 1)
    SELECT finding_id, CASE WHEN coalesce(len(modes), 0) = 0 THEN 'none' WHEN len(modes) > 1 THEN 'mixed' ELSE modes[1] END AS mode, CASE WHEN len(modes) = 1 AND modes[1] = 'parallel' THEN 'verdict' ELSE 'finding' END AS cap FROM m""")
def refutation_modes(spark, d):
    return L.refutation_mode(_refutations(spark, d))


_BLANK = {"title": "p_partkey % 11 = 0", "remedy": "p_partkey % 13 = 0"}
_FINDINGS = """f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'high' ELSE (p_size % 10)::VARCHAR END AS priority, CASE WHEN p_partkey % 5 = 0 THEN 'verdict' ELSE 'finding' END AS confidence,
    p_partkey % 11 = 0 AS no_title, p_partkey % 13 = 0 AS no_remedy, p_brand AS b, p_partkey % 2 = 0 AS manual FROM part),
asked AS (SELECT * FROM f WHERE confidence = 'verdict' OR coalesce(try_cast(priority AS INT), 0) >= 6),
seen AS (SELECT finding_id, count(DISTINCT CASE WHEN lens[1:2] = 'L1' THEN 'L1' ELSE lens END) AS lenses, count(*) FILTER (mode = 'parallel') AS parallel, count(*) FILTER (mode IS NULL) AS undeclared FROM refs GROUP BY 1)"""


def _findings(spark, d):
    blank = lambda rule, value: F.when(F.expr(rule), F.lit(" ")).otherwise(F.lit(value))
    k = F.col("p_partkey")
    plain = {c: F.lit("x") for c in L.REQUIRED if c not in ("id", "title", "remedy", "source", "gain_metric", "confidence")}
    own = {"title": blank(_BLANK["title"], "t"), "remedy": blank(_BLANK["remedy"], "r"), "source": F.concat(F.lit("m.x; "), "p_brand"), "gain_metric": F.when(k % 2 == 0, "manual").otherwise(F.col("p_brand"))}
    own |= {"confidence": F.when(k % 5 == 0, "verdict").otherwise("finding"), "priority": F.when(k % 3 == 0, "high").otherwise((F.col("p_size") % 10).cast("string"))}
    return t(spark, d, "part").select(k.cast("string").alias("id"), *[c.alias(n) for n, c in (plain | own).items()])


@query(f"""WITH {_REFS}, {_FINDINGS} SELECT id::VARCHAR AS id, 'blank title' AS problem FROM f WHERE no_title UNION ALL SELECT id::VARCHAR, 'blank remedy' FROM f WHERE no_remedy
    UNION ALL SELECT id::VARCHAR, 'unresolved ' || b FROM f WHERE b LIKE '%3' UNION ALL SELECT id::VARCHAR, 'unknown metric ' || b FROM f WHERE NOT manual AND b LIKE '%2'
    UNION ALL SELECT id::VARCHAR, 'not refuted' FROM asked WHERE id NOT IN (SELECT finding_id FROM refs)
    UNION ALL SELECT id::VARCHAR, 'undeclared mode' FROM asked JOIN seen ON finding_id = id WHERE undeclared > 0
    UNION ALL SELECT id::VARCHAR, 'verdict without a parallel lens' FROM asked JOIN seen ON finding_id = id WHERE confidence = 'verdict' AND parallel = 0
    UNION ALL SELECT id::VARCHAR, 'verdict of one lens' FROM asked JOIN seen ON finding_id = id WHERE confidence = 'verdict' AND lenses < 2""")
def selfcheck(spark, d):
    brands = t(spark, d, "part").select("p_brand").distinct()
    sources = brands.where("p_brand not like '%3'").toDF("source").unionByName(spark.createDataFrame([("m.x",)], "source string"))
    return L.selfcheck(_findings(spark, d), _refutations(spark, d).withColumn("finding_id", F.col("finding_id").cast("string")), brands.where("p_brand not like '%2'").toDF("metric"), sources)


@query(f"""WITH {_REFS}, {_FINDINGS} SELECT CASE WHEN count(*) = 0 THEN 'none' WHEN count(DISTINCT mode) > 1 THEN 'mixed' WHEN count(DISTINCT mode) = 0 THEN 'undeclared' ELSE max(mode) END AS mode, count(*) FILTER (mode IS NULL) AS undeclared,
    (SELECT count(*) FROM asked JOIN seen ON finding_id = id WHERE parallel = 0) AS sequential_findings FROM refs""")
def run_mode(spark, d):
    return L.run_mode(_findings(spark, d), _refutations(spark, d).withColumn("finding_id", F.col("finding_id").cast("string")))


_SNAP = """s AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'base' ELSE 'now' END AS run, count(*) AS files, count(DISTINCT o_custkey) AS edges, count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE / count(*) AS rework_rate,
    count(*) FILTER (o_orderpriority < '3')::DOUBLE / count(*) AS containment_ratio FROM orders GROUP BY 1),
l AS (SELECT unnest(['containment_ratio', 'edges', 'files', 'rework_rate', 'touch_cost_p90']) AS measure, unnest([containment_ratio, edges, files, rework_rate, NULL])::DOUBLE AS v, run FROM s)"""


@query(f"WITH {_SNAP} SELECT measure, max(v) FILTER (run = 'base') AS base, max(v) FILTER (run = 'now') AS now, round_even(max(v) FILTER (run = 'now') - max(v) FILTER (run = 'base'), 4) AS delta FROM l GROUP BY measure")
def gate_deltas(spark, d):
    share = lambda rule: C.ratio(F.count(F.when(rule, 1)), F.count("*"))
    run = F.when(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz"), "base").otherwise("now")
    p = F.col("o_orderpriority")
    snaps = t(spark, d, "orders").groupBy(run.alias("run")).agg(F.count("*").alias("files"), F.countDistinct("o_custkey").alias("edges"), share(p == "1-URGENT").alias("rework_rate"), share(p < "3").alias("containment_ratio"))
    return L.gate_deltas(snaps.withColumn("touch_cost_p90", F.lit(None).cast("double")), "base", "now", ("containment_ratio", "edges", "files", "rework_rate", "touch_cost_p90"))


@query("""WITH m AS (SELECT p_brand, count(*)::DOUBLE AS actual FROM part WHERE p_brand NOT LIKE '%4' GROUP BY 1),
    f AS (SELECT p_partkey AS id, p_brand AS gain_metric, p_size + 0.5 AS target, CASE p_partkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS dir FROM part WHERE p_partkey % 4 <> 1)
    SELECT id, gain_metric, actual, CASE dir WHEN 'up' THEN actual >= target WHEN 'down' THEN actual <= target ELSE abs(actual - target) <= 0.01 * abs(target) OR actual >= target END AS reached FROM f LEFT JOIN m ON p_brand = gain_metric""")
def verified_gains(spark, d):
    k = F.col("p_partkey")
    status = F.element_at(F.array(F.lit("done"), F.lit("open"), F.lit("FIXED"), F.lit("закрыта")), (k % 4 + 1).cast("int"))
    rows = t(spark, d, "part").select(k.alias("id"), status.alias("status"), F.col("p_brand").alias("gain_metric"), F.concat("p_size", F.lit(",5")).alias("gain_target"), F.when(k % 3 == 0, "up").when(k % 3 == 1, "down").alias("gain_direction"))
    metrics = t(spark, d, "part").where("p_brand not like '%4'").groupBy("p_brand").agg(F.count("*").cast("double").alias("v"))
    return L.verify_gains(rows, metrics)


@query("""WITH r AS (SELECT c_custkey // 2 AS id, c_mktsegment AS seg FROM customer), twice AS (SELECT id FROM r GROUP BY id HAVING count(*) > 1)
    SELECT DISTINCT id, 'repeated id' AS problem FROM r WHERE id IN (SELECT s_suppkey FROM supplier) OR id IN (FROM twice)
    UNION ALL SELECT id, 'seg: ' || seg FROM r WHERE seg NOT IN ('BUILDING', 'MACHINERY')""")
def rejected_rows(spark, d):
    rows = t(spark, d, "customer").select(F.floor(F.col("c_custkey") / 2).alias("id"), F.col("c_mktsegment").alias("seg"))
    return L.rejected_rows(rows, t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), {"seg": ("BUILDING", "MACHINERY")})


@query("""WITH b AS (SELECT l_partkey AS k, list_sort(list(DISTINCT l_returnflag)) AS r FROM lineitem WHERE l_quantity > 46 GROUP BY 1)
    SELECT 'P' || row_number() OVER (ORDER BY p_brand, p_size, p_partkey) AS id, p_partkey AS name, CASE WHEN k IS NULL THEN 'provable' WHEN p_partkey % 2 = 0 THEN 'suspected' ELSE 'manual' END AS status, coalesce(array_to_string(r, ','), '') AS blind_spots
    FROM part LEFT JOIN b ON k = p_partkey""")
def dead_code_statuses(spark, d):
    cands = t(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("name"), (F.col("p_partkey") % 2 == 0).alias("instrumentable"))
    blind = t(spark, d, "lineitem").where("l_quantity > 46").select(F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("reason"))
    return P.statuses(cands, blind).select("id", "name", "status", F.array_join("blind_spots", ",").alias("blind_spots"))


@query("""WITH c AS (SELECT l_suppkey AS v, count(*) FILTER (l_quantity = 50 AND l_tax > 0.07) AS fails, count(*) FILTER (l_quantity = 49 AND l_tax > 0.06) AS open, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS tests FROM lineitem GROUP BY 1)
    SELECT s_suppkey AS variant, CASE WHEN coalesce(fails, 0) > 0 OR s_suppkey % 17 = 0 OR (s_nationkey = 3 AND s_suppkey % 2 = 1) OR s_acctbal < -800 THEN 'rejected' WHEN coalesce(open, 0) > 0 OR s_nationkey = 4 OR coalesce(tests, 0) = 0 THEN 'unverified' ELSE 'accepted' END AS verdict
    FROM supplier LEFT JOIN c ON v = s_suppkey""")
def trial_verdicts(spark, d):
    q = F.col("l_quantity")
    status = F.when((q == 50) & (F.col("l_tax") > 0.07), "fail").when((q == 49) & (F.col("l_tax") > 0.06), "unverified").otherwise("pass")
    checks = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("variant"), F.lit("c").alias("name"), status.alias("status"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("is_test"))
    gain = F.when(F.col("s_nationkey") == 3, "missed").when(F.col("s_nationkey") == 4, "unverified").otherwise("reached")
    trials = t(spark, d, "supplier").select(F.col("s_suppkey").alias("variant"), (F.col("s_suppkey") % 17 == 0).alias("empty_diff"), gain.alias("gain"), F.when(F.col("s_acctbal") < -800, "cold").otherwise("ok").alias("payback"), (F.col("s_suppkey") % 2 == 0).alias("partial"))
    return L.trial_verdicts(checks, trials)


@query("""WITH o AS (SELECT o_custkey AS id, CASE max(o_orderkey) % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'go' END AS decision, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'ok' END AS trial, CASE WHEN count(*) > 12 THEN 'too_costly' ELSE 'ok' END AS lead FROM orders GROUP BY 1),
    f AS (SELECT c_custkey AS id, c_nationkey AS priority FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(f.id, o.id) AS id, f.id IS NOT NULL AS found, priority, coalesce(trial, lead) AS payback, CASE WHEN o.id IS NOT NULL THEN CASE WHEN trial IS NULL THEN 'lead' ELSE 'trial' END END AS variant,
        NOT (decision IS NULL OR decision = 'rejected' OR (trial IS NULL AND lead = 'too_costly')) AS included FROM f FULL JOIN o ON f.id = o.id""")
def plan_items(spark, d):
    by = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("m"), F.min("o_orderkey").alias("k"), F.count("*").alias("n"))
    trial = F.when(F.col("k") % 2 == 0, "ok")
    decisions = by.select("id", F.when(F.col("m") % 3 == 0, "rejected").when(F.col("m") % 3 == 1, "go").alias("decision"), trial.alias("trial_payback"), F.when(trial.isNotNull(), "trial").alias("trial_variant"), F.when(F.col("n") > 12, "too_costly").otherwise("ok").alias("lead_payback"), F.lit("lead").alias("lead_variant"))
    return L.plan_items(t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("priority")), decisions)


@query("""WITH p AS (SELECT n_nationkey, n_regionkey * 100 + n_nationkey AS place, string_split(n_name, 'A') AS parts FROM nation), e AS (SELECT n_nationkey, place, generate_subscripts(parts, 1) - 1 AS phase, unnest(parts) AS text FROM p)
    SELECT n_nationkey, phase::INT AS phase, text, row_number() OVER (ORDER BY place, phase) AS number FROM e""")
def plan_phases(spark, d):
    items = t(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("place"), F.split("n_name", "A").alias("parts"))
    return L.plan_phases(items, "n_nationkey", "parts", "place").select("n_nationkey", "phase", "text", F.col("number").cast("long").alias("number"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 11 = 0 THEN 'added' ELSE 'changed' END AS problem FROM customer
    WHERE c_custkey % 77 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_acctbal < 0)""")
def fingerprints(spark, d):
    c = t(spark, d, "customer").where("c_custkey % 77 <> 0")
    digest = F.sha2(F.concat_ws("|", "c_name", F.col("c_acctbal").cast("string")), 256)
    base, now = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("id"), digest.alias("digest")), c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "other").otherwise(digest).alias("digest"))
    return L.fingerprint_gate(now, base)


@query("""WITH c AS (SELECT count(*) AS orders, count(DISTINCT o_orderpriority) AS kinds FROM orders) SELECT 'min_orders=' || 10000000000 AS expectation, orders::VARCHAR AS got FROM c WHERE orders < 10000000000
    UNION ALL SELECT 'eq_kinds=4', kinds::VARCHAR FROM c WHERE kinds <> 4 UNION ALL SELECT 'max_kinds=9', kinds::VARCHAR FROM c WHERE kinds > 9""")
def missed_expectations(spark, d):
    one = t(spark, d, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_orderpriority").alias("kinds"))
    return L.expect(one, {"min_orders": 10_000_000_000, "eq_kinds": 4, "max_kinds": 9})


@query("""WITH v AS (SELECT l_suppkey AS item, count(DISTINCT l_linenumber) AS critics, count(*) FILTER (l_quantity = 50 AND l_discount > 0.09) AS dropped FROM lineitem GROUP BY 1)
    SELECT item, CASE WHEN critics < 2 THEN 'fail' WHEN dropped > 0 THEN 'stop' ELSE 'go' END AS outcome FROM v""")
def critic_outcomes(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("critic"), F.when((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.09), "dropped").otherwise("survives").alias("verdict"))
    return L.critic_outcomes(rows)


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity AS before, l_quantity + l_linenumber - 4 AS target, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity + (l_partkey % 7) - 3.5 END AS after,
        CASE l_suppkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS told FROM lineitem),
    d AS (SELECT *, coalesce(told, CASE WHEN target < before THEN 'down' ELSE 'up' END) AS direction FROM n)
    SELECT l_orderkey || ':' || l_linenumber AS id, direction, CASE direction WHEN 'up' THEN after >= target ELSE after <= target END AS reached FROM d""")
def measured_gains(spark, d):
    """Numbers written with a decimal comma, and every fifth one a boolean."""
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.", ",")
    q, k = F.col("l_quantity"), F.col("l_partkey")
    after = F.when(k % 5 == 0, "true").otherwise(text(q + k % 7 - 3.5))
    told = F.when(F.col("l_suppkey") % 3 == 0, "up").when(F.col("l_suppkey") % 3 == 1, "down")
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return L.measured_gains(t(spark, d, "lineitem").select(key.alias("id"), text(q).alias("before"), after.alias("after"), text(q + F.col("l_linenumber") - 4).alias("target"), told.alias("direction")))


@query("""SELECT p_partkey, CASE WHEN p_size > 20 OR p_size % 7 > 5 THEN 'red' WHEN p_size > 10 OR p_size % 7 > 3 THEN 'yellow' ELSE 'green' END AS r1,
    CASE WHEN p_size / 50.0 > 0.7 OR 1 - p_size / 60.0 < 0.5 THEN 'red' WHEN p_size / 50.0 >= 0.45 OR 1 - p_size / 60.0 <= 0.75 THEN 'yellow' ELSE 'green' END AS r2, CASE WHEN p_size % 13 >= 10 THEN 'red' WHEN p_size % 13 >= 5 THEN 'yellow' ELSE 'green' END AS r3,
    CASE WHEN p_size % 11 = 0 OR p_size % 9 > 7 THEN 'red' WHEN p_size % 9 >= 4 THEN 'yellow' ELSE 'green' END AS r5, CASE WHEN p_size / 50.0 > 0.85 THEN 'red' WHEN p_size / 50.0 >= 0.6 THEN 'yellow' ELSE 'green' END AS r6 FROM part""")
def risk_rules(spark, d):
    n = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", PT.r1_complexity(n, n % 7).alias("r1"), PT.r2_coupling(n / 50, 1 - n / 60).alias("r2"), PT.r3_copies(n % 13).alias("r3"), PT.r5_structure(n % 11 == 0, n % 9).alias("r5"), PT.r6_owner(n / 50).alias("r6"))


@query("""WITH c AS (SELECT l_partkey AS file, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
    SELECT p_partkey AS file, CASE WHEN coalesce(n, 0)::DOUBLE / p_size < 0.3 THEN 0.0::DOUBLE ELSE least(1.0, n::DOUBLE / p_size) END AS share FROM part LEFT JOIN c ON file = p_partkey""")
def read_levels(spark, d):
    covered = t(spark, d, "lineitem").where("l_quantity > 20").groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").alias("covered"))
    return PT.read_levels(covered, t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("lines")))


@query("""WITH f AS (SELECT p_partkey, 'd' || p_size || CASE p_partkey % 4 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '/index.ts' ELSE '/m.py' END AS file FROM part)
    SELECT DISTINCT file AS node FROM f WHERE p_partkey % 4 < 2 AND file IN (SELECT file FROM f JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 45)""")
def barrel_files(spark, d):
    name = F.when(F.col("p_partkey") % 4 == 0, "/__init__.py").when(F.col("p_partkey") % 4 == 1, "/index.ts").otherwise("/m.py")
    files = t(spark, d, "part").select("p_partkey", F.concat(F.lit("d"), "p_size", name).alias("file"))
    edges = files.join(t(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("file").alias("src"), F.col("l_suppkey").alias("dst"))
    return PT.barrels(files.select("file").distinct(), edges)


# -- linters ------------------------------------------------------------------------------------

_LINT = """f AS (SELECT l_suppkey AS file, CASE l_linenumber % 4 WHEN 0 THEN 'simplicity' WHEN 1 THEN 'width' WHEN 2 THEN 'perf' END AS g FROM lineitem WHERE l_quantity > 20),
c AS (SELECT s_suppkey AS file, count(*) FILTER (g = 'simplicity') AS simplicity, count(*) FILTER (g = 'width') AS width, count(*) FILTER (g = 'perf') AS perf FROM supplier LEFT JOIN f ON file = s_suppkey GROUP BY 1)"""


@query(f"""WITH {_LINT} SELECT *, round_even(100 * cume_dist() OVER (ORDER BY simplicity), 0)::BIGINT AS simplicity_pct, round_even(100 * cume_dist() OVER (ORDER BY width), 0)::BIGINT AS width_pct,
    round_even(100 * cume_dist() OVER (ORDER BY perf), 0)::BIGINT AS perf_pct, file IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000) AS hot FROM c""")
def lint_ranks(spark, d):
    code = F.element_at(F.array(F.lit("SIM102"), F.lit("E501"), F.lit("C416"), F.lit("X9")), F.col("l_linenumber") % 4 + 1)
    findings = t(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_suppkey").alias("file"), code.alias("code"))
    files = t(spark, d, "supplier").select(F.col("s_suppkey").alias("file"))
    return lint.with_ranks(lint.counts(findings, files), t(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("file")))


# -- look-ups and heads -------------------------------------------------------------------------


def _history(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("author"), F.floor(us("o_orderdate") / 1_000_000).alias("epoch"), F.when(F.col("o_orderpriority") == "1-URGENT", "Revert x").otherwise("feat: x").alias("subject"))
    lines = t(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey") % 7, F.lit("/"), "l_partkey").alias("file")).distinct()
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("sha"), "author", "epoch", "subject", "file")


_HISTORY = "h AS (SELECT DISTINCT o_orderkey AS sha, o_custkey AS author, epoch(o_orderdate)::BIGINT AS epoch, o_orderpriority = '1-URGENT' AS revert, 's' || l_suppkey % 7 || '/' || l_partkey AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(f"WITH {_HISTORY} SELECT file, count(DISTINCT sha) AS reverts FROM h WHERE revert GROUP BY file ORDER BY reverts DESC, file LIMIT 10")
def reverts_top(spark, d):
    return H.top(LK.reverts(_history(spark, d)), 10, F.desc("reverts"), "file")


@query(f"WITH {_HISTORY} SELECT author, count(DISTINCT sha) AS commits FROM h WHERE starts_with(file, 's3/') GROUP BY author")
def authors_below(spark, d):
    return LK.authors(_history(spark, d), "s3/")


@query(f"WITH {_HISTORY}, g AS (SELECT sha, bool_or(starts_with(file, 's1/')) AS a, bool_or(starts_with(file, 's2/')) AS b FROM h GROUP BY sha) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a) AS one, count(*) FILTER (b) AS other FROM g")
def changed_together(spark, d):
    return LK.together(_history(spark, d), "s1/", "s2/")


@query(f"WITH {_HISTORY} SELECT file, count(DISTINCT sha) AS revisions, count(DISTINCT author) AS authors, min(epoch) AS first, max(epoch) AS last FROM h WHERE file IN ('s1/8', 's2/16', 's3/3', 's4/4', 's5/12') GROUP BY file")
def revisions(spark, d):
    return LK.revisions(_history(spark, d), "s1/8", "s2/16", "s3/3", "s4/4", "s5/12")


@query(f"WITH {_HISTORY} SELECT count(DISTINCT sha) AS commits, count(DISTINCT sha) >= 100000000 AS available, 'only ' || count(DISTINCT sha) || ' of 100000000 commits' AS reason FROM h")
def history_available(spark, d):
    return PT.available(_history(spark, d), 100_000_000)


@query(f"SELECT DISTINCT string_split({_PATH}, '/')[1] AS root FROM pages WHERE contains({_PATH}, '/') ORDER BY root LIMIT 6")
def structure_roots(spark, d):
    return source_text.structure_roots(t(spark, d, "pages").select(F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1).alias("file")))


@query(B.SQL["marker_ids"])
def live_markers(spark, d):
    """The conversations as a stream that ends: all of it is read, and the counts of the last batch are the result.

    The path is a pattern, as the stream reader takes a plain one for a folder.
    """
    rows, name = t(spark, d, "conversations"), f"markers_{uuid.uuid4().hex}"
    counts = live.live_marker_counts(spark.readStream.schema(rows.schema).parquet(f"{d}/conversations.parque[t]"), "text", r"\b(th\w\w)\b")
    root = spark.conf.get("spark.checkpoint.dir", None)
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    stream = (writer.option("checkpointLocation", f"{root.rstrip('/')}/heddle-{name}") if root else writer).start()
    stream.awaitTermination()
    return spark.table(name)


@query(f"SELECT * FROM ({B.SQL['concentration']}) ORDER BY edits DESC, item LIMIT 20")
def concentration_top(spark, d):
    return H.top(B.concentration(spark, d), 20, F.desc("edits"), "item")


@query(f"SELECT * FROM ({B.SQL['slowest_users']}) ORDER BY median_span DESC NULLS LAST, episodes DESC, user_id LIMIT 20")
def slowest_top(spark, d):
    return H.top(B.slowest_users(spark, d), 20, F.desc_nulls_last("median_span"), F.desc("episodes"), "user_id")


@query(f"SELECT * FROM ({B.SQL['unstable_users']}) ORDER BY rate_low DESC, changes DESC, user_id LIMIT 20")
def unstable_top(spark, d):
    return H.top(B.unstable_users(spark, d), 20, F.desc("rate_low"), F.desc("changes"), "user_id")


@query(f"SELECT user_id, changes, rate_low FROM ({B.SQL['rework']}) WHERE rate_low >= 0.1 AND changes >= 10")
def unstable_items(spark, d):
    return B.rework(spark, d).where("rate_low >= 0.1 and changes >= 10").select("user_id", "changes", "rate_low")


@query(f"SELECT * FROM ({B.SQL['crossings']}) ORDER BY n DESC, crossing LIMIT 12")
def crossings_top(spark, d):
    return H.top(B.crossings(spark, d), 12, F.desc("n"), "crossing")


@query(f"SELECT * FROM ({SQL['external_packages']}) ORDER BY n DESC, package LIMIT 25")
def external_top(spark, d):
    return H.top(external_packages(spark, d), 25, F.desc("n"), "package")


@query(f"SELECT * FROM ({B.SQL['clone_pairs']}) ORDER BY shared DESC, a, b LIMIT 40")
def clone_pairs_top(spark, d):
    return H.top(CL.clone_pairs(B._windows(spark, d)), 40, F.desc("shared"), "a", "b")


# -- a graph that grows -------------------------------------------------------------------------

_STEPS = """w AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
steps AS (SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst FROM w x JOIN w y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey),
sd AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM steps UNION ALL SELECT dst, 1, 0 FROM steps) GROUP BY node)"""


def _steps(spark, d):
    """From each part to the part of the order's next line: as many edges as lines, and no cap on a node."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return G.edges_of(rows.join(after, ["l_orderkey", "l_linenumber"]), "l_partkey", "dst")


@query(f"WITH {_STEPS} SELECT * FROM sd")
def part_degrees(spark, d):
    return G.degrees(_steps(spark, d))


@query(f"WITH {_STEPS} SELECT *, fan_in + fan_out AS total, round_even(100 * cume_dist() OVER (ORDER BY fan_in), 0)::BIGINT AS fan_in_pct FROM sd")
def part_hubs(spark, d):
    return G.hubs(_steps(spark, d))


@query()
def part_cycles(spark, d):
    """Recursive SQL is too slow here; tests compare with a depth-first search."""
    return G.cycles(_steps(spark, d))
