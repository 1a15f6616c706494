import datetime as dt
from pathlib import Path

import duckdb
import pytest

from heddle.plans import history

NOW, DATA = dt.datetime(1998, 9, 1), Path("/root/testdata")


def tables(spark, folder, orders, lines):
    """orders: (key, custkey, priority, days before NOW); lines: (orderkey, partkey)."""
    rows = [(k, c, p, NOW - dt.timedelta(days=days)) for k, c, p, days in orders]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_payback_takes_every_customer(spark, tmp_path):
    orders = [(k, k, "1-URGENT", 10 * k) for k in range(1, 21)] + [(40, 3, "1-URGENT", 400)]
    got = history.payback(spark, tables(spark, tmp_path, orders, [(k, p) for k, *_ in orders for p in range(3)])).first()
    assert got["fix_episodes"] == 20 and got["median_width"] == 3 and abs(got["pain"] - 15) < 1e-9 and got["verdict"] == "too_costly"


def test_payback_forms_episodes_over_all_orders(spark, tmp_path):
    fix, other = "1-URGENT", "5-LOW"
    orders = [(1, 1, fix, 100), (2, 2, other, 97), (3, 3, fix, 94), (4, 4, other, 50), (5, 5, fix, 20), (6, 6, other, 16)]
    lines = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (4, 9), (5, 1), (5, 1), (6, 7)]
    got = history.payback(spark, tables(spark, tmp_path, orders, lines)).first()
    assert (got["fix_episodes"], got["median_width"]) == (2, 2.5) and abs(got["pain"] - 1.25) < 1e-9


WHOLE = f"""WITH e AS (SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT AS tick, o_orderpriority = '1-URGENT' AS fix FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND epoch(o_orderdate) > {history.NOW} - 365 * 86400 AND epoch(o_orderdate) <= {history.NOW}),
    c AS (SELECT *, CASE WHEN tick - lag(tick) OVER (ORDER BY tick, k) <= 3 * 86400 THEN 0 ELSE 1 END AS cut FROM e),
    n AS (SELECT *, sum(cut) OVER (ORDER BY tick, k) AS episode FROM c),
    w AS (SELECT episode, count(DISTINCT l_partkey) AS width FROM n JOIN lineitem ON l_orderkey = k GROUP BY episode HAVING bool_or(fix))
    SELECT count(*), median(width)::DOUBLE FROM w"""


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_payback_against_the_whole_definition_in_sql(spark, size):
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{DATA}/{size}/{name}.parquet'")
    got = history.payback(spark, str(DATA / size)).first()
    assert (got["fix_episodes"], got["median_width"]) == con.execute(WHOLE).fetchone()
