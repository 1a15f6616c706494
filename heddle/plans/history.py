"""The operators bound to the star-schema tables, and the same questions in SQL.

Group is an order, item a part or supplier, layer a region, fix an urgent order or an error event,
the graph that of customer nations and their two main supplier nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.functions.documents import at_path
from heddle.operators import clones as CL
from heddle.operators import cooccur as CO
from heddle.operators import graph as G
from heddle.operators import hotspots as H
from heddle.operators import ledger as L
from heddle.operators import patterns as PT
from heddle.operators import prune as P
from heddle.operators import timelines as T
from heddle.operators.ranks import with_percentile
from heddle.operators.saving import maybe_broadcast, pieces

QUERIES: dict = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
NOW = 904_608_000  # 1998-09-01


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def us(column: str):
    """Microseconds since the epoch of a local timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(`{column}` as timestamp_ntz))")


# -- items that change together -----------------------------------------------------------------

_PAIRS = """
d AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem),
m AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY g) <= 8),
s AS (SELECT i, count(*) AS n FROM m GROUP BY i),
pairs AS (SELECT a, b, shared, x.n AS solo_a, y.n AS solo_b, shared::DOUBLE / least(x.n, y.n) AS degree
    FROM (SELECT p.i AS a, q.i AS b, count(*) AS shared FROM m p JOIN m q ON p.g = q.g AND p.i < q.i GROUP BY 1, 2 HAVING count(*) >= 5)
    JOIN s x ON x.i = a JOIN s y ON y.i = b WHERE shared::DOUBLE / least(x.n, y.n) >= 0.045)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def cooccurrence(spark, d):
    return CO.cooccurrence(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 8, 5, 0.045)


@query(f"WITH {_PAIRS} SELECT a, b, degree, round_even(100 * cume_dist() OVER (ORDER BY degree), 0)::BIGINT AS degree_pct FROM pairs")
def cooccurrence_percentile(spark, d):
    return with_percentile(cooccurrence(spark, d), "degree", "degree_pct").select("a", "b", "degree", "degree_pct")


@query(f"WITH {_PAIRS} SELECT a, b, shared, degree FROM pairs ORDER BY degree DESC, shared DESC, a, b LIMIT 40")
def cooccurrence_top(spark, d):
    return H.top(cooccurrence(spark, d), 40, F.desc("degree"), F.desc("shared"), "a", "b").select("a", "b", "shared", "degree")


@query("""SELECT l_suppkey, list(l_orderkey ORDER BY o_orderdate DESC, l_orderkey) AS examples FROM (
    SELECT * FROM (SELECT DISTINCT l_suppkey, l_orderkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY o_orderdate DESC, l_orderkey) <= 5) GROUP BY l_suppkey""")
def newest_examples(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey")).distinct().join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return CO.examples(rows, "l_suppkey", "l_orderkey", "o_orderdate", 5)


_LAYERS = """
d AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i, r_name AS layer FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY g) <= 8),
layers AS (SELECT g, list_sort(list_distinct(list(layer))) AS l FROM m GROUP BY g)"""


def _supplier_layers(spark, d):
    places = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    return t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(maybe_broadcast(places, places.count()), "l_suppkey")


def _group_layers(spark, d):
    return CO.group_layers(_supplier_layers(spark, d), "l_orderkey", "l_suppkey", "r_name", 8)


@query(f"WITH {_LAYERS} SELECT count(*) FILTER (len(l) = 1) AS inside, count(*) FILTER (len(l) > 1) AS across, count(*) FILTER (len(l) = 1)::DOUBLE / count(*) AS ratio FROM layers")
def containment(spark, d):
    return CO.containment(_group_layers(spark, d))


@query(f"WITH {_LAYERS} SELECT array_to_string(l, ' + ') AS crossing, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM layers WHERE len(l) > 1 GROUP BY 1")
def crossings(spark, d):
    return CO.crossings(_group_layers(spark, d))


@query("""WITH c AS (SELECT user_id AS item, event_type AS actor, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT item, sum(n) AS edits, max(n) AS most, count(*) AS actors FROM c GROUP BY item)
    SELECT item, edits::BIGINT AS edits, min(actor) AS owner, any_value(most)::DOUBLE / edits AS owner_share, any_value(actors) AS actors
    FROM c JOIN r USING (item) WHERE n = most AND edits >= 8 AND most::DOUBLE / edits > 0.3 GROUP BY item, edits""")
def concentration(spark, d):
    return CO.concentration(t(spark, d, "events"), "user_id", "event_type", 8, 0.30)


@query("""WITH w AS (SELECT l_orderkey, r_name AS layer, count(DISTINCT l_suppkey) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
    b AS (SELECT layer, w FROM w UNION ALL SELECT NULL, w FROM w)
    SELECT layer, count(*) AS groups, median(w)::DOUBLE AS median_width, list_sort(list(w))[least(count(*), floor(0.9 * count(*))::BIGINT + 1)] AS quantile_width FROM b GROUP BY layer""")
def touch_cost(spark, d):
    widths = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("w"))
    places = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(places, F.col("o_custkey") == F.col("c_custkey"))
    return CO.touch_cost(widths.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "w", "r_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS edits, grouping(l_linestatus)::INT AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def churn_profile(spark, d):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return t(spark, d, "lineitem").groupingSets([[f, s], [f], []], f, s).agg(F.count("*").alias("edits"), F.grouping("l_linestatus").cast("int").alias("level"))


# -- hotspots -----------------------------------------------------------------------------------

_SPOTS = """
d AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem),
e AS (SELECT i, count(*) AS edits FROM (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY g) <= 6) GROUP BY i),
f AS (SELECT i, count(*) AS fixes FROM d JOIN orders ON o_orderkey = g WHERE o_orderpriority = '1-URGENT' GROUP BY i),
spots0 AS (SELECT p_partkey AS item, p_size AS size, edits, coalesce(fixes, 0) AS fixes, coalesce(fixes, 0)::DOUBLE / edits AS fix_share, edits * p_size AS score FROM part JOIN e ON e.i = p_partkey LEFT JOIN f ON f.i = p_partkey),
spots AS (SELECT *, round_even(100 * cume_dist() OVER (ORDER BY score), 0)::BIGINT AS score_pct FROM spots0)"""


def _spots(spark, d):
    fixes = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("group"))
    return H.hotspots(t(spark, d, "lineitem"), "l_orderkey", "l_partkey", fixes, t(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("size")), 6)


@query(f"WITH {_SPOTS} SELECT * FROM spots")
def hotspots(spark, d):
    return _spots(spark, d)


@query(f"WITH {_SPOTS} SELECT * FROM spots ORDER BY score DESC, item LIMIT 25")
def hotspots_top(spark, d):
    return H.top(_spots(spark, d), 25, F.desc("score"), "item")


@query(f"WITH {_SPOTS} SELECT item, edits, fix_share FROM spots WHERE fix_share >= 0.25 AND edits >= 10")
def painful_items(spark, d):
    return H.painful(_spots(spark, d)).select("item", "edits", "fix_share")


@query(f"WITH {_SPOTS} SELECT item, score_pct, fix_share FROM spots WHERE score_pct >= 80 AND fix_share < 0.15")
def extension_points(spark, d):
    return H.extension_points(_spots(spark, d)).select("item", "score_pct", "fix_share")


@query("""WITH e AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS edits FROM lineitem GROUP BY 1)
    SELECT p_partkey AS item, p_size AS size, coalesce(edits, 0) AS edits FROM part LEFT JOIN e ON item = p_partkey WHERE p_size >= 40 AND coalesce(edits, 0) < 25""")
def refactor_when_touched(spark, d):
    edits = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct("l_orderkey").alias("edits"))
    return H.when_touched(t(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("size")), edits, 40, 25).select("item", "size", "edits")


_REACH = "reach AS (SELECT l_partkey AS item, count(DISTINCT l_suppkey) AS fan_in, count(DISTINCT l_linenumber) AS coupled FROM lineitem GROUP BY 1)"
_PAIN = "CASE WHEN fix_share < 0.15 THEN 1 WHEN fix_share <= 0.35 THEN CASE WHEN edits < 8 THEN 1 ELSE 2 END WHEN edits < 8 THEN 2 ELSE 3 END"
_SPREAD = "greatest(CASE WHEN coalesce(fan_in, 0) <= 3 THEN 1 WHEN fan_in <= 10 THEN 2 ELSE 3 END, CASE WHEN coalesce(coupled, 0) <= 1 THEN 1 WHEN coupled <= 4 THEN 2 ELSE 3 END)"


@query(f"WITH {_SPOTS}, {_REACH} SELECT item, {_PAIN} AS pain, {_SPREAD} AS spread, {_PAIN} * {_SPREAD} AS priority FROM spots LEFT JOIN reach USING (item)")
def priorities(spark, d):
    reach = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct("l_suppkey").alias("fan_in"), F.countDistinct("l_linenumber").alias("coupled"))
    return H.priorities(_spots(spark, d), reach)


@query(f"""WITH {_SPOTS} SELECT item, CASE WHEN size > 40 THEN 'red' WHEN size >= 20 THEN 'yellow' ELSE 'green' END AS r1,
    CASE WHEN score_pct >= 95 THEN 'red' WHEN score_pct >= 80 THEN 'yellow' ELSE 'green' END AS r2,
    CASE WHEN size > 40 THEN 3 WHEN size >= 20 THEN 2 ELSE 1 END AS r1_pain,
    CASE (size > 40)::INT + (score_pct >= 80)::INT + (fix_share >= 0.25)::INT WHEN 0 THEN 'none' WHEN 1 THEN 'hypothesis' WHEN 2 THEN 'finding' ELSE 'verdict' END AS admitted FROM spots""")
def risk_bands(spark, d):
    r1 = C.band("size", 20, 40)
    r2 = F.when(F.col("score_pct") >= 95, "red").when(F.col("score_pct") >= 80, "yellow").otherwise("green")
    return _spots(spark, d).select("item", r1.alias("r1"), r2.alias("r2"), C.pain_of_band(r1).alias("r1_pain"), C.admission(F.col("size") > 40, F.col("score_pct") >= 80, F.col("fix_share") >= 0.25).alias("admitted"))


# -- time lines ---------------------------------------------------------------------------------

_EPISODES = f"""
c AS (SELECT user_id, epoch_us(ts) AS tick, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER o <= {6 * HOUR} THEN 0 ELSE 1 END AS cut FROM events WINDOW o AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM c),
episodes AS (SELECT user_id, episode::BIGINT AS episode, min(tick) AS first, max(tick) AS last, count(*) AS events FROM n GROUP BY 1, 2)"""


def _events(spark, d):
    return t(spark, d, "events").select("user_id", "event_id", "event_type", us("ts").alias("at"))


def _episodes(spark, d):
    return T.episodes(_events(spark, d), "user_id", "at", "event_id", 6 * HOUR)


@query(f"WITH {_EPISODES} SELECT * FROM episodes")
def sessions(spark, d):
    return _episodes(spark, d)


@query(f"""WITH {_EPISODES} SELECT count(*) AS episodes, sum(events)::BIGINT AS events, avg(events) AS mean_events, median(events)::DOUBLE AS median_events,
    count(*) FILTER (events > 1)::DOUBLE / count(*) AS multi_share, median(last - first) FILTER (events > 1)::DOUBLE AS median_multi_span FROM episodes""")
def session_totals(spark, d):
    return T.episode_totals(_episodes(spark, d))


@query(f"WITH {_EPISODES} SELECT user_id, count(*) AS episodes, median(last - first)::DOUBLE AS median_span, median(events)::DOUBLE AS median_events FROM episodes GROUP BY user_id HAVING count(*) >= 3")
def slowest_users(spark, d):
    return T.slowest(_episodes(spark, d), "user_id")


_WILSON = "CASE WHEN {n} > 0 THEN greatest(0.0, (({k}::DOUBLE / {n}) + 1.96 * 1.96 / (2 * {n}) - 1.96 * sqrt((({k}::DOUBLE / {n}) * (1 - ({k}::DOUBLE / {n})) + 1.96 * 1.96 / (4 * {n})) / {n})) / (1 + 1.96 * 1.96 / {n})) ELSE 0 END"
_W = _WILSON.format(k="reworked", n="changes")
_SEEN = f"""
e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS tick FROM events),
seen AS (SELECT x.user_id, x.event_id, x.tick, (SELECT min(f.tick) FROM e f WHERE f.user_id = x.user_id AND f.event_type = 'error' AND f.tick > x.tick AND f.tick <= x.tick + {12 * HOUR}) AS next_at FROM e x WHERE x.event_type <> 'error'),
r AS (SELECT user_id, count(*) AS changes, count(next_at) AS reworked, median(next_at - tick)::DOUBLE AS median_delay, count(next_at)::DOUBLE / count(*) AS rate FROM seen GROUP BY user_id)"""


@query(f"WITH {_SEEN} SELECT user_id, event_id, next_at FROM seen")
def next_error(spark, d):
    seen = T.next_within(_events(spark, d), "user_id", "at", F.col("event_type") == "error", 12 * HOUR)
    return seen.where("event_type <> 'error'").select("user_id", "event_id", "next_at")


@query(f"WITH {_SEEN} SELECT user_id, changes, reworked, median_delay, rate, {_W} AS rate_low FROM r")
def rework(spark, d):
    return T.rework(_events(spark, d), "user_id", "at", F.col("event_type") == "error", 12 * HOUR)


@query(f"""WITH {_SEEN}, g AS (SELECT user_id, count(*) AS changes, count(next_at) AS reworked, median(next_at - tick)::DOUBLE AS median_delay, count(next_at)::DOUBLE / count(*) AS rate FROM seen GROUP BY GROUPING SETS ((user_id), ()))
    SELECT user_id, changes, reworked, median_delay, rate, {_W} AS rate_low FROM g""")
def rework_with_total(spark, d):
    return T.rework_with_total(_events(spark, d), "user_id", "at", F.col("event_type") == "error", 12 * HOUR)


@query(f"WITH {_SEEN}, l AS (SELECT *, {_W} AS rate_low FROM r WHERE changes >= 5) SELECT user_id, changes, reworked, rate, rate_low, round_even(100 * cume_dist() OVER (ORDER BY rate_low), 0)::BIGINT AS rate_low_pct FROM l")
def unstable_users(spark, d):
    return T.unstable(rework(spark, d), "user_id")


@query(f"""WITH e AS (SELECT (3 - least(3, floor(greatest(0, {NOW} - epoch(o_orderdate)) / (91.25 * 86400))))::INT AS bucket FROM orders)
    SELECT q.bucket::INT AS bucket, count(e.bucket) AS edits FROM range(4) q(bucket) LEFT JOIN e ON e.bucket = q.bucket GROUP BY 1""")
def edits_by_quarter(spark, d):
    rows = t(spark, d, "orders").select(F.floor(us("o_orderdate") / 1_000_000).alias("at"))
    return T.edits_by_quarter(rows, "at", NOW, 91.25 * 86_400)


_PAYBACK = f"""
e AS (SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT AS tick, o_orderpriority = '1-URGENT' AS fix FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND epoch(o_orderdate) > {NOW} - 365 * 86400 AND epoch(o_orderdate) <= {NOW}),
c AS (SELECT *, CASE WHEN tick - lag(tick) OVER (ORDER BY tick, k) <= 3 * 86400 THEN 0 ELSE 1 END AS cut FROM e),
n AS (SELECT *, sum(cut) OVER (ORDER BY tick, k) AS episode FROM c),
w AS (SELECT episode, count(DISTINCT l_partkey) AS width FROM n JOIN lineitem ON l_orderkey = k GROUP BY episode HAVING bool_or(fix))"""


@query(f"""WITH {_PAYBACK}, p AS (SELECT count(*) AS fix_episodes, count(*) / (365 / 91.25) AS episodes_per_quarter, median(width)::DOUBLE AS median_width FROM w),
    q AS (SELECT *, episodes_per_quarter * coalesce(median_width, 0) AS pain FROM p)
    SELECT *, CASE WHEN pain > 0 THEN 100.0 / pain END AS quarters, CASE WHEN NOT pain > 0 THEN 'cold' WHEN 100.0 / pain <= 4 THEN 'ok' ELSE 'too_costly' END AS verdict FROM q""")
def payback(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", F.floor(us("o_orderdate") / 1_000_000).alias("at"), "o_orderpriority")
    touches = orders.join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    each = T.pain_per_quarter(touches, "l_partkey", F.col("o_orderpriority") == "1-URGENT", NOW)
    quarters = F.when(F.col("pain") > 0, F.lit(100.0) / F.col("pain"))
    return each.withColumn("quarters", quarters).withColumn("verdict", C.payback_verdict("quarters"))


@query("""WITH r AS (SELECT l_suppkey AS k, l_linenumber * 10 + l_partkey % 50 AS a, l_linenumber * 10 + l_partkey % 50 + l_quantity::BIGINT % 7 AS b FROM lineitem),
    p AS (SELECT k, unnest(range(a, b + 1)) AS x FROM r), u AS (SELECT DISTINCT k, x FROM p),
    i AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS island FROM u)
    SELECT k, count(DISTINCT island) AS islands, count(*) AS covered FROM i GROUP BY k""")
def interval_union(spark, d):
    first = F.col("l_linenumber") * 10 + F.col("l_partkey") % 50
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), first.alias("a"), (first + F.col("l_quantity").cast("long") % 7).alias("b"))
    return T.covered(rows, "k", "a", "b")


# -- graph --------------------------------------------------------------------------------------

_EDGES = """
w AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
edges AS (SELECT DISTINCT src, dst FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 2) WHERE src <> dst),
deg AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)"""
_CYCLES = f"""{_EDGES},
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT reach.a, edges.dst FROM reach JOIN edges ON edges.src = reach.b),
scc AS (SELECT x.a AS node, min(least(x.a, y.a)) AS cycle FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""


def _weights(spark, d):
    nations = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(nations, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))


def _edges(spark, d):
    top = _weights(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("r <= 2")
    return G.saved(G.edges_of(top, "src", "dst"))


@query(f"WITH {_EDGES} SELECT * FROM deg")
def degrees(spark, d):
    return G.degrees(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT *, fan_in + fan_out AS total, round_even(100 * cume_dist() OVER (ORDER BY fan_in), 0)::BIGINT AS fan_in_pct FROM deg")
def hubs(spark, d):
    return G.hubs(_edges(spark, d))


@query(f"WITH RECURSIVE {_CYCLES} SELECT node, cycle FROM scc")
def cycles(spark, d):
    return G.cycles(_edges(spark, d))


_FULL = "full_edges AS (SELECT src, dst FROM edges UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey < 5 UNION SELECT (n_nationkey + 1) % 25, n_nationkey FROM nation WHERE n_nationkey < 5)"


@query(f"""WITH RECURSIVE {_CYCLES}, {_FULL},
    reach2 AS (SELECT src AS a, dst AS b FROM full_edges UNION SELECT reach2.a, f.dst FROM reach2 JOIN full_edges f ON f.src = reach2.b),
    scc2 AS (SELECT x.a AS node, min(least(x.a, y.a)) AS cycle FROM reach2 x JOIN reach2 y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
    m1 AS (SELECT list_sort(list(node)) AS members FROM scc GROUP BY cycle), m2 AS (SELECT cycle, list_sort(list(node)) AS members FROM scc2 GROUP BY cycle)
    SELECT node, cycle FROM scc2 WHERE cycle IN (SELECT cycle FROM m2 WHERE members NOT IN (SELECT members FROM m1))""")
def type_only_cycles(spark, d):
    edges = _edges(spark, d)
    k = F.col("n_nationkey")
    extra = t(spark, d, "nation").where("n_nationkey < 5").select(k.alias("src"), ((k + 1) % 25).alias("dst"))
    return G.type_only_cycles(edges, edges.unionByName(G.symmetric(extra)))


_BARRELS = "barrels AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey IN (SELECT src FROM edges))"


@query(f"""WITH {_EDGES}, {_BARRELS} SELECT src, dst FROM edges UNION
    SELECT e.src, o.dst FROM edges e JOIN barrels b ON b.node = e.dst JOIN edges o ON o.src = b.node WHERE e.src <> o.dst""")
def barrel_expand(spark, d):
    return G.through_barrels(_edges(spark, d), t(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("node")))


_NATION_PAIRS = """
np AS (SELECT DISTINCT l_orderkey AS g, s_nationkey AS i FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
nm AS (SELECT * FROM np QUALIFY count(*) OVER (PARTITION BY g) <= 8),
ns AS (SELECT i, count(*) AS n FROM nm GROUP BY i),
coupled AS (SELECT a, b, shared, shared::DOUBLE / least(x.n, y.n) AS degree FROM (SELECT p.i AS a, q.i AS b, count(*) AS shared FROM nm p JOIN nm q ON p.g = q.g AND p.i < q.i GROUP BY 1, 2 HAVING count(*) >= 5)
    JOIN ns x ON x.i = a JOIN ns y ON y.i = b WHERE shared::DOUBLE / least(x.n, y.n) >= 0.12)"""


def _nation_pairs(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return CO.cooccurrence(rows, "l_orderkey", "s_nationkey", 8, 5, 0.12)


@query(f"WITH {_EDGES}, {_NATION_PAIRS} SELECT a, b, degree FROM coupled WHERE EXISTS (SELECT 1 FROM edges WHERE (src = a AND dst = b) OR (src = b AND dst = a))")
def coupled_with_edge(spark, d):
    return G.with_edge(_nation_pairs(spark, d), _edges(spark, d)).select("a", "b", "degree")


@query(f"WITH {_EDGES}, {_NATION_PAIRS} SELECT a, b, degree FROM coupled WHERE NOT EXISTS (SELECT 1 FROM edges WHERE (src = a AND dst = b) OR (src = b AND dst = a))")
def hidden_links(spark, d):
    return G.without_edge(_nation_pairs(spark, d), _edges(spark, d)).select("a", "b", "degree")


@query(f"WITH RECURSIVE {_CYCLES}, {_NATION_PAIRS} SELECT x.node AS a, y.node AS b FROM scc x JOIN scc y ON x.cycle = y.cycle AND x.node < y.node WHERE NOT EXISTS (SELECT 1 FROM coupled WHERE a = x.node AND b = y.node AND degree >= 0.33)")
def dead_links(spark, d):
    return PT.dead_links(G.cycles(_edges(spark, d)), _nation_pairs(spark, d).where("degree >= 0.33"))


@query(f"""WITH {_EDGES}, own AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey < 3)
    SELECT dst AS node, 'out' AS direction FROM edges WHERE src IN (FROM own) AND dst NOT IN (FROM own) UNION SELECT src, 'in' FROM edges WHERE dst IN (FROM own) AND src NOT IN (FROM own)""")
def neighbours(spark, d):
    return G.neighbours(_edges(spark, d), t(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("node")))


@query(f"""WITH {_EDGES}, o AS (SELECT dst AS node, sum(n) AS edits, max(n) AS most FROM w GROUP BY dst)
    SELECT node, fan_in, most::DOUBLE / edits AS owner_share FROM o JOIN deg USING (node) WHERE fan_in >= 2 AND most::DOUBLE / edits > 0.055 AND edits >= 8""")
def bus_factor_hubs(spark, d):
    owned = _weights(spark, d).groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("edits"), F.max("n").alias("most")).withColumn("owner_share", C.ratio("most", "edits"))
    return owned.join(G.degrees(_edges(spark, d)), "node").where("fan_in >= 2 and owner_share > 0.055 and edits >= 8").select("node", "fan_in", "owner_share")


@query("SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_size < 40")
def orphans(spark, d):
    nodes = t(spark, d, "part").select(F.col("p_partkey").alias("node"))
    edges = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return P.orphans(nodes, edges, t(spark, d, "part").where("p_size >= 40").select(F.col("p_partkey").alias("node")))


# -- clones -------------------------------------------------------------------------------------

_WINDOWS = """
tok AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents),
win AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k+7], ' '))) AS h FROM tok),
own AS (SELECT h, count(*) AS owners FROM win GROUP BY h),
few AS (SELECT win.* FROM win JOIN own USING (h) WHERE owners BETWEEN 2 AND 50),
copies AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM few x JOIN few y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _windows(spark, d):
    return CL.windows(t(spark, d, "documents").select("doc_id", F.split(F.lower("text"), r"\s+").alias("w")), "doc_id", "w", 8)


@query(f"WITH {_WINDOWS} SELECT * FROM copies")
def clone_pairs(spark, d):
    return CL.clone_pairs(_windows(spark, d))


@query(f"WITH {_WINDOWS} SELECT count(*) AS skipped FROM own WHERE owners > 50")
def clone_windows_skipped(spark, d):
    return CL.skipped_windows(_windows(spark, d))


@query(f"""WITH RECURSIVE {_WINDOWS}, two AS (SELECT a, b FROM copies UNION SELECT b, a FROM copies),
    near AS (SELECT a AS node, b AS other FROM two UNION SELECT near.node, two.b FROM near JOIN two ON two.a = near.other),
    lab AS (SELECT node, least(node, min(other)) AS component FROM near GROUP BY node)
    SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM lab""")
def clone_groups(spark, d):
    return CL.clone_groups(CL.clone_pairs(_windows(spark, d)))


# -- runs and findings --------------------------------------------------------------------------

_RUNS = """
side AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'base' ELSE 'now' END AS run, o_orderkey, o_orderpriority FROM orders),
lines AS (SELECT DISTINCT run, o_orderkey, o_orderpriority, l_partkey FROM side JOIN lineitem ON l_orderkey = o_orderkey),
painful AS (SELECT run, l_partkey AS member FROM lines GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (o_orderpriority = '1-URGENT') >= 0.25 * count(*))"""


def _painful(spark, d):
    run = F.when(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz"), "base").otherwise("now")
    touched = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    touched = touched.repartition(pieces(touched), "o_orderkey").distinct()  # all columns of either side stay, so both can be distinct before they meet
    lines = touched.join(t(spark, d, "orders").select(run.alias("run"), "o_orderkey", "o_orderpriority").distinct(), "o_orderkey")
    each = lines.groupBy("run", F.col("l_partkey").alias("member")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("k"))
    return each.where("n >= 10 and k >= 0.25 * n").select("run", "member")


@query(f"WITH {_RUNS}, p AS (SELECT * FROM painful) SELECT member, 'new' AS change FROM p WHERE run = 'now' AND member NOT IN (SELECT member FROM p WHERE run = 'base') UNION ALL SELECT member, 'healed' FROM p WHERE run = 'base' AND member NOT IN (SELECT member FROM p WHERE run = 'now')")
def gate_changes(spark, d):
    p = G.saved(_painful(spark, d))
    return L.set_changes(p.where("run = 'now'"), p.where("run = 'base'"), "member")


_RATES = "rates AS (SELECT run, count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE / count(*) AS rework, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH'))::DOUBLE / count(*) AS containment FROM side GROUP BY run)"


@query(f"""WITH {_RUNS}, {_RATES}, f AS (SELECT count(*) AS new_painful FROM painful WHERE run = 'now' AND member NOT IN (SELECT member FROM painful WHERE run = 'base')),
    x AS (SELECT n.containment - b.containment AS containment_delta, n.rework - b.rework AS rework_delta FROM rates n, rates b WHERE n.run = 'now' AND b.run = 'base')
    SELECT CASE WHEN new_painful > 0 OR containment_delta < -0.03 OR rework_delta > 0.05 THEN 'REGRESSION' ELSE 'OK' END AS status, containment_delta, rework_delta, 0::BIGINT AS new_cycle, new_painful, 0::BIGINT AS new_unstable FROM x, f""")
def gate(spark, d):
    run = F.when(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz"), "base").otherwise("now")
    share = lambda *p: C.ratio(F.count(F.when(F.col("o_orderpriority").isin(*p), 1)), F.count("*"))
    snaps = t(spark, d, "orders").groupBy(run.alias("run")).agg(share("1-URGENT", "2-HIGH").alias("containment"), share("1-URGENT").alias("rework"))
    return L.gate(snaps, G.saved(_painful(spark, d)).select("run", F.lit("painful").alias("kind"), F.col("member").cast("string").alias("member")), "base", "now")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND n_chars > 1000)::DOUBLE / nullif(count(*) FILTER (quality = 1), 0) AS recall,
    count(*) FILTER (quality = 0 AND n_chars > 1000)::DOUBLE / nullif(count(*) FILTER (quality = 0), 0) AS false_positives FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL GROUP BY lang""")
def confusion(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("e"), (F.col("n_chars") > 1000).alias("p"))
    return L.confusion(rows, "e", "p", "lang")


@query("SELECT avg((toxic = 1)::INT::DOUBLE) AS recall, avg((toxic = 1)::INT::DOUBLE) <= 0.25 AS passed FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def control_recall(spark, d):
    return L.control_recall(t(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")), t(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("hit")))


@query("SELECT doc_id FROM labels WHERE quality IS DISTINCT FROM (1 - toxic)")
def changed_labels(spark, d):
    labels = t(spark, d, "labels")
    return L.changed(labels, labels.select("doc_id", (1 - F.col("toxic")).alias("quality")), "doc_id", "quality")


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_mktsegment || ':' || c_custkey), c_custkey) AS place FROM customer")
def shuffled_customers(spark, d):
    return L.shuffled(t(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey").select("c_mktsegment", "c_custkey", F.col("place").cast("long").alias("place"))


@query("""WITH u AS (SELECT conv_id, turn, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM conversations)
    SELECT conv_id, turn, upto, (SELECT count(*) FROM u v WHERE v.conv_id = u.conv_id AND v.upto > 600) AS dropped FROM u WHERE upto <= 600""")
def slice_budget(spark, d):
    return L.within_budget(t(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", [F.col("turn")], "text", 600).select("conv_id", "turn", "upto", "dropped")


@query("""SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey % 3, length(n_name) DESC, n_nationkey) AS place FROM nation""")
def plan_order(spark, d):
    items = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") % 3).alias("risk"), F.length("n_name").alias("priority"))
    return L.plan_order(items, "n_regionkey", "risk", "priority", "n_nationkey").select("n_nationkey", "n_name", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT (SELECT count(*) FROM orders) AS commits, (SELECT count(*) FROM part WHERE p_size < 5) AS tests, 0 AS regex_files, (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM nation) AS edges, (SELECT count(*) FROM supplier) AS pairs)
    SELECT unnest(['history', 'tests', 'backend', 'edges', 'pairs', 'control']) AS "check", unnest([commits >= 60, tests > 0, regex_files = 0, edges >= 0.3 * files, pairs <= 0.5 * commits, true]) AS passed,
    unnest(['coupling,rework', 'churn', 'complexity', 'graph', 'coupling', 'clones']) AS blocks FROM f""")
def calibration(spark, d):
    count = lambda name, where=None: (t(spark, d, name).where(where) if where else t(spark, d, name)).agg(F.count("*").alias("v"))
    facts = None
    for name, df in (("commits", count("orders")), ("tests", count("part", "p_size < 5")), ("files", count("part")), ("edges", count("nation")), ("pairs", count("supplier"))):
        df = df.select(F.lit(1).alias("one"), F.col("v").alias(name))
        facts = df if facts is None else facts.join(df, "one")
    return L.calibration(facts.withColumn("regex_files", F.lit(0)).withColumn("control", F.lit("ok")))


# -- texts --------------------------------------------------------------------------------------


@query("SELECT lang, coalesce(sum((length(text) - length(replace(text, 'the', ''))) // 3), 0)::BIGINT AS hits, count(*) FILTER (contains(text, 'the')) AS texts FROM documents GROUP BY lang")
def log_markers(spark, d):
    return P.marker_totals(t(spark, d, "documents"), "text", "the", "lang")


@query(r"SELECT id, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, '\b(th\w\w)\b', 1)) AS id FROM conversations) GROUP BY id")
def marker_ids(spark, d):
    return P.marker_counts(t(spark, d, "conversations"), "text", r"\b(th\w\w)\b")


@query("""WITH n AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT unnest(['the', 'and', 'of', 'absent'])),
    w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\w+')) AS name FROM documents) SELECT name, count(doc_id) AS texts FROM n LEFT JOIN w USING (name) GROUP BY name""")
def mentions(spark, d):
    names = t(spark, d, "nation").select(F.lower("n_name").alias("name")).unionByName(spark.createDataFrame([(x,) for x in ("the", "and", "of", "absent")], "name string"))
    return P.mentions(names, t(spark, d, "documents"), "doc_id", "text")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_path(spark, d):
    return t(spark, d, "events").select("event_id", at_path(F.from_json("props", "k bigint"), "k").alias("k"))


_PATH = "regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), s AS (SELECT page_id, path, lower(path) AS low FROM p)
    SELECT page_id, path, CASE WHEN NOT (ends_with(path, '.html') OR ends_with(path, '/')) THEN 'noise' WHEN contains(path, '7') THEN 'generated' WHEN contains(low, 'es/') THEN 'test' ELSE 'code' END AS class FROM s""")
def page_classes(spark, d):
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1)
    return t(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", "path", C.path_class("path", (".html", "/"), ("node_modules/", "vendor/"), ("7", "_pb2."), ("es/", "tests/")).alias("class"))


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM pages), q AS (SELECT page_id, CASE WHEN parts[1] = 'en' THEN parts[2:] ELSE parts END AS parts FROM p)
    SELECT CASE len(parts) WHEN 0 THEN '?' ELSE parts[1] END AS layer, count(*) AS pages FROM q GROUP BY 1""")
def page_layers(spark, d):
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1)
    return t(spark, d, "pages").groupBy(C.layer_of(path, ("en",), 1).alias("layer")).agg(F.count("*").alias("pages"))


@query(f"""WITH p AS (SELECT string_split({_PATH}, '/')[1] AS first FROM pages WHERE contains({_PATH}, '/'))
    SELECT first, count(*)::DOUBLE / (SELECT count(*) FROM p) AS share FROM p GROUP BY first HAVING count(*)::DOUBLE / (SELECT count(*) FROM p) > 0.25""")
def root_guess(spark, d):
    from heddle.sources.layout import root_shares

    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1)
    return root_shares(t(spark, d, "pages").select(path.alias("path")), "path").where("share > 0.25").select("first", "share")


@query("""SELECT c_custkey, printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT) AS digest FROM customer""")
def digests(spark, d):
    from heddle.functions.documents import fnv1a

    return t(spark, d, "customer").select("c_custkey", fnv1a("c_name").alias("digest"))


# -- disagreements ------------------------------------------------------------------------------

_INTENT = """
places AS (SELECT n_nationkey AS node, n_regionkey AS layer FROM nation),
rules AS (SELECT a.r_regionkey AS s, b.r_regionkey AS t FROM region a, region b WHERE (a.r_regionkey + b.r_regionkey) % 2 = 1)"""


def _intent(spark, d):
    places = t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("layer"))
    region = t(spark, d, "region").select("r_regionkey")
    other = region.withColumnRenamed("r_regionkey", "dst_layer")
    rules = region.join(other, (F.col("r_regionkey") + F.col("dst_layer")) % 2 == 1).select(F.col("r_regionkey").alias("src_layer"), "dst_layer", F.lit(False).alias("allowed"))
    return places, rules


@query(f"""WITH RECURSIVE {_CYCLES}, {_NATION_PAIRS}, {_INTENT} SELECT a, b, degree FROM coupled JOIN places x ON x.node = a JOIN places y ON y.node = b
    WHERE EXISTS (SELECT 1 FROM rules WHERE s = x.layer AND t = y.layer) AND NOT EXISTS (SELECT 1 FROM scc p JOIN scc q ON p.cycle = q.cycle WHERE p.node = a AND q.node = b)""")
def nominal_seams(spark, d):
    places, rules = _intent(spark, d)
    return PT.nominal_seams(_nation_pairs(spark, d), places, rules, G.cycles(_edges(spark, d)), 0.12)


@query(f"""WITH {_EDGES}, {_NATION_PAIRS}, {_INTENT} SELECT a, b, degree FROM coupled JOIN places x ON x.node = a JOIN places y ON y.node = b
    WHERE EXISTS (SELECT 1 FROM rules WHERE s = x.layer AND t = y.layer) AND NOT EXISTS (SELECT 1 FROM edges WHERE (src = a AND dst = b) OR (src = b AND dst = a))""")
def perimeter_holes(spark, d):
    places, rules = _intent(spark, d)
    return PT.perimeter_holes(_nation_pairs(spark, d), places, rules, _edges(spark, d))


@query("SELECT DISTINCT l_partkey + 50 AS node FROM lineitem WHERE l_partkey + 50 NOT IN (SELECT p_partkey FROM part)")
def phantoms(spark, d):
    return PT.phantoms(t(spark, d, "lineitem").select((F.col("l_partkey") + 50).alias("node")), t(spark, d, "part").select(F.col("p_partkey").alias("node")))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE (src + dst) % 2 = 0 AND dst IN (SELECT node FROM deg WHERE fan_in >= 2)")
def intent_drift(spark, d):
    edges = _edges(spark, d)
    return PT.intent_drift(edges.where("(src + dst) % 2 = 0"), edges, G.degrees(edges).where("fan_in >= 2"))


@query("SELECT p_partkey AS node, count(DISTINCT l_orderkey) AS edits FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) < 22")
def blind_spots(spark, d):
    edits = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.countDistinct("l_orderkey").alias("edits"))
    return PT.blind_spots(t(spark, d, "part").select(F.col("p_partkey").alias("node")), edits, 22)
