"""Evidence for prompts: made from the texts of pairs as from whole items, and equal to its SQL without a second shuffle of requests."""

import duckdb
from pyspark.sql import functions as F

from duoscope.operators import pairs, report
from duoscope.plans import QUERIES, SQL
from duoscope.plans.reports import pair_texts, shown_of

DATA = "/root/testdata/sf0.001"


def test_from_texts_of_pairs_as_from_items(spark):
    recs = spark.createDataFrame([("a", "b", "bleeding", 3, "CURATED", "Major"), ("a", "b", "nausea", 1, "CURATED", "Unknown"), *[("a", "c", f"e{i}", i, "SIGNAL", "Unknown") for i in range(5)], ("a", "b", "rash", 2, "SIGNAL", "Unknown")], "a string, b string, event string, reports long, source string, severity string")
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["a"]), (4, ["z"])], "request long, names array<string>")
    names = sets.select("request", F.explode("names").alias("name"))
    effects = names.where("name <> 'z'").withColumn("effects", F.concat(F.lit("effects of "), "name"))
    whole = report.evidence_block(report.gather(names, shown_of(pairs.of_names(sets), recs)), effects)
    told = pair_texts(recs, report.evidence_lines).join(pairs.of_names(sets), ["a", "b"], "right")
    told = told.select("request", "a", "b", F.coalesce("section", F.lit(6)).alias("section"), F.coalesce("text", F.concat(F.lit("- "), "a", F.lit(" + "), "b")).alias("text"))
    got = dict(report.evidence_of_pairs(sets.select("request"), told, effects).collect())
    assert got == dict(whole.collect()) and len(got) == 4
    assert got[4] == "=== CURATED RECORDS ===\n(none)" and "a + c: 3 more not shown" in got[1]


def test_requests_are_not_shuffled_again_and_rows_equal_sql(spark):
    done = QUERIES["evidence_block"](spark, DATA)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") and "hashpartitioning(request" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(request" in line and "REPARTITION_BY_NUM" not in line]
    db = duckdb.connect()
    for name in ("lineitem", "part", "orders", "supplier"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    assert sorted(map(tuple, done.collect())) == sorted(db.execute(SQL["evidence_block"]).fetchall())
