"""Reports are checked by their pairs: each pair once as it should be, and once with each fault that a report has in it."""

import duckdb
import pytest

from duoscope.operators import checker
from duoscope.plans import QUERIES, SQL
from duoscope.sources import scratch

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """300 orders, of which 200 are open, of four parts; every tenth open one has a single name."""
    at = tmp_path_factory.mktemp("orders")
    flags = [("A", "F"), ("R", "O"), ("N", "F"), ("N", "O"), ("R", "F")]
    lines = [(k, n, (k * 7 + n * (k % 3 + 1)) % 4, *flags[(k // 3 + n * k) % 5]) for k in range(300) for n in range(1 if k % 30 == 1 else 2 + k % 3)]
    tables = {
        "orders": spark.createDataFrame([(k, "F" if k % 3 == 0 else "O") for k in range(300)], "o_orderkey long, o_orderstatus string"),
        "part": spark.createDataFrame([(i, n, "SMALL", "B", 1) for i, n in enumerate(("hot bolt", "blue ring", "old plate", "hot ring"))], "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        "lineitem": spark.createDataFrame(lines, LINES),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def wanted(folder, name):
    con = duckdb.connect()
    for t in ("orders", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(SQL[name]).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["claim_codes", "claim_statistics"])
def test_texts_checked_follow_the_pairs_and_not_the_reports(spark, folder, name, monkeypatch):
    texts, check = [], checker.check
    monkeypatch.setattr(checker, "check", lambda e: texts.append(e.reports.count()) or check(e))
    rows = sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=repr)
    scratch.release()
    assert rows == wanted(folder, name)
    assert texts[0] == 6 and sum(texts) < 100


def test_claims_for_a_judge_are_read_once_a_pair(spark, folder, monkeypatch):
    texts, read = [], checker.read
    monkeypatch.setattr(checker, "read", lambda e: texts.append(e.reports.count()) or read(e))
    rows = sorted(map(tuple, QUERIES["judge_claims"](spark, folder).collect()), key=repr)
    scratch.release()
    assert rows and rows == wanted(folder, "judge_claims")
    assert texts == [6]
