"""Numbers in claims are given as they are written."""

import duckdb

from duoscope.plans import QUERIES, SQL


def test_numbers_with_leading_zeros_and_long_ones_equal_the_sql(spark, tmp_path):
    long = "9" * 25
    rows = [(13, "a 007bcdef"), (27, "b 0,012 + 0012 more here and not shown; 000 co-reports"), (8, f"{long} reports and co-reports: {long}; 05 reports 1,000 reports"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(SQL["claim_numbers"]).fetchall())
    got = sorted(map(tuple, QUERIES["claim_numbers"](spark, str(tmp_path)).collect()))
    assert got == want
    assert {r[0]: r[3].split(",")[0] for r in got if r[0] == 13} == {13: "007"} and long in {r[0]: r for r in got}[8][2]
