"""Claims for the judge, its answers, and exact samples against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from duoscope.operators import checker, judge, stats

TEXT = """# Interaction report
## Summary
alpha may raise bleeding with beta [SRC:A1]. Three names checked.
## Major findings
- **alpha + beta**: severity Major; bleeding [SRC:A1] [SRC:A9]
- **alpha + beta**: severity Major; bleeding
## Statistical reporting signals (not graded)
- **alpha + gamma**: nausea, PRR 3.5, 12 co-reports [SIG:S8]
- **alpha + gamma**: +2 more not shown [SIG:S1]
Disclaimer: alpha raises bleeding [SRC:A1]."""


def test_claims_with_their_records(spark):
    make = lambda rows, kinds: spark.createDataFrame([(1, *r) for r in rows], "report long, " + kinds)
    records = [("SRC", "A1", "interaction", "alpha", "beta", "bleeding", "Major", None, None, None), ("SIG", "S1", "signal", "alpha", "gamma", "nausea", None, 3.5, 12, "")]
    e = checker.bundle(
        spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "report long, text string"),
        make(records, "source string, record_id string, kind string, a string, b string, event string, severity string, prr double, reports long, mechanism string"),
        make([(n, n) for n in ("alpha", "beta", "gamma")], "alias string, name string"), make([("alpha", "beta")], "a string, b string"),
        make([("beta", "gamma")], "a string, b string"), make([("x",)], "query string"), make([("alpha", "gamma", 2)], "a string, b string, n long"),
    )
    rows = judge.extract_claims(checker.read(e), e).orderBy("line", "place").collect()
    assert [(r.claim_id, r.citations, [x.citation for x in r.records], r.missing) for r in rows] == [
        ("1:L3", ["[SRC:A1]"], ["[SRC:A1]"], []),
        ("1:L5", ["[SRC:A1]", "[SRC:A9]"], ["[SRC:A1]"], ["[SRC:A9]"]),
        ("1:L8", ["[SIG:S8]"], [], ["[SIG:S8]"]),
    ]
    seen = rows[0].records[0]
    assert (seen.source, seen.kind, seen.names, seen.event, seen.severity, seen.mechanism) == ("SRC", "interaction", ["alpha", "beta"], "bleeding", "Major", None)


def test_answers(spark):
    claims = spark.createDataFrame([("a", ["r"], []), ("b", [], ["[X:1]"]), ("c", ["r"], ["[X:1]", "[X:2]"]), ("d", ["r"], ["[X:1]"]), ("e", ["r"], []), ("f", ["r"], [])], "claim_id string, records array<string>, missing array<string>")
    said = json.dumps({"verdict": " Supported", "rationale": "yes"})
    answers = spark.createDataFrame([("a", "so " + said), ("b", said), ("c", said), ("d", '{"verdict": "contradicted"}'), ("e", "z" * 300)], "claim_id string, answer string")
    assert {r.claim_id: tuple(r)[1:] for r in judge.settle(claims, answers).collect()} == {
        "a": ("supported", "yes", True), "b": ("unsupported", "cites no record in the evidence: [X:1]", False), "c": ("unsupported", "yes (also cites [X:1], [X:2], which is not in the evidence)", True),
        "d": ("contradicted", "", True), "e": ("invalid", "z" * 200, True), "f": ("invalid", "", True),
    }


def by_hand(keys, seed, k):
    return sorted(keys, key=lambda x: (hashlib.md5(f"{seed}|{x}".encode()).hexdigest(), x))[:k]


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_samples(spark, parts):
    rows = [(i, None if i % 10 == 9 else "big" if i % 10 else f"g{i % 3}") for i in range(3000)] + [(-1, "one")]
    df = spark.createDataFrame(rows, "id long, g string").repartition(parts)
    groups = {g: [i for i, x in rows if x == g] for g in {g for _, g in rows}}
    got = {}
    for r in stats.exact_sample(df, ["id"], "s", ["g"], fraction=0.25).orderBy("place").collect():
        got.setdefault(r.g, []).append((r.place, r.id))
    assert got == {g: list(enumerate(by_hand(ids, "s", max(1, round(0.25 * len(ids)))), 1)) for g, ids in groups.items()}
    every = [i for i, _ in rows]
    assert [r.id for r in stats.exact_sample(df, ["id"], "t", n=100).orderBy("place").collect()] == by_hand(every, "t", 100)
    assert stats.exact_sample(df, ["id"], "t", ["g"], n=2500).count() == 3001 and stats.exact_sample(df.where("id > 9999"), ["id"], "t", fraction=0.5).count() == 0
    same = spark.createDataFrame([(1, "x")] * 10, "id long, g string")
    assert sorted(r.place for r in stats.exact_sample(same, ["id"], "t", fraction=0.25).collect()) == [1, 2]
    with pytest.raises(ValueError):
        stats.exact_sample(df, ["id"], "t")


def test_blind_audit(spark):
    claims = spark.createDataFrame([(f"c{i}", f"text {i}", [(i,)]) for i in range(50)], "claim_id string, text string, records array<struct<n:long>>")
    judged = claims.select("claim_id", F.when(F.col("claim_id").endswith("0"), "invalid").otherwise("supported").alias("verdict"))
    audit, key = judge.blind(claims, judged, "7")
    rows, keys = audit.collect(), {r.audit_id: r for r in key.collect()}
    assert sorted(r.audit_id for r in rows) == [f"A{i:03d}" for i in range(1, 10)] and set(audit.columns) == {"audit_id", "claim", "cited_records", "human_verdict", "human_notes"}
    for r in rows:
        assert keys[r.audit_id].judge_verdict == "supported" and r.claim == "text " + keys[r.audit_id].claim_id[1:] and r.cited_records == f'[{{"n":{keys[r.audit_id].claim_id[1:]}}}]'
