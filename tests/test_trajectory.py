"""Logs of steps: appending, folding, the path that is due, invariants one breach at a time, and percentiles."""

import pytest
from pyspark.sql import functions as F

from duoscope.operators import trajectory as tr

LOG = "run int, seq int, node string, status string, ms double, outcome string"


def test_steps_are_written_once(spark):
    log = spark.createDataFrame([(1, 1, "a", "ok", 1.0, None), (1, 2, "b", "ok", 2.0, None)], LOG)
    more = spark.createDataFrame([(1, 2, "c", "ok", 9.0, None), (1, 3, "d", "ok", 1.0, None), (1, 3, "d", "ok", 1.0, None), (2, 2, "a", "ok", None, None)], LOG)
    done = tr.appended(log, more)
    got = {r.run: r for r in tr.folded(done).collect()}
    assert got[1].nodes == ["a", "b", "d"] and got[1].timed and got[1].whole and got[1].total_ms == 4.0
    assert got[2].nodes == ["a"] and not got[2].timed and not got[2].whole
    assert tr.folded(log.limit(0)).collect() == []


def path_by_hand(outcomes, eligible, asks, visits, most):
    if not eligible:
        return ["normalize", "plan", "template", "finalize"], "deterministic_insufficient_input"
    path = ["normalize", "plan", "retrieve"] + ["faers"] * visits
    if asks:
        for i, o in enumerate(outcomes[:most]):
            path += ["generate_llm", "validate"] if o in ("pass", "fail") else ["generate_llm"]
            if o == "pass":
                return [*path, "finalize"], "llm_retry" if i else "llm"
            if o == "err_nt":
                break
    return [*path, "template", "finalize"], "deterministic_fallback" if asks else "deterministic"


def test_paths_that_are_due(spark):
    from itertools import product

    kinds = ("pass", "fail", "err_t", "err_nt")
    cases = [(list(o), e, a, v, m) for n in range(4) for o in product(kinds, repeat=n) for e, a, v in product((True, False), repeat=3) for m in (1, 3)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, o array<string>, e boolean, a boolean, v boolean, m int")
    got = df.select("id", tr.due(*[F.col(c) for c in "oeavm"]).alias("d")).collect()
    assert all((r.d.path, r.d.source) == path_by_hand(*cases[r.id]) for r in got)


GOOD = {
    "runs": [("r", "llm_retry", "d2", "base", True, 1, 3, 2, 2, "{}", True)], "steps": [("normalize", None), ("plan", None), ("retrieve", None), ("faers", None), ("generate_llm", "fail"), ("validate", None), ("generate_llm", "pass"), ("validate", None), ("finalize", None)],
    "names": ["A", "b", "c"], "planned": [("a", "b"), ("a", "c"), ("b", "c")], "retrieved": [("a", "b", True), ("a", "c", True), ("b", "c", False)], "drafts": [("d1", False), ("d2", True)], "findings": [], "ms": 1.0,
}
RUN = ("r", "llm_retry", "d2", "base", True, 1, 3, 2, 2, "{}", True)


def changed(**k):
    names = ["run", "source", "report", "baseline", "faers_enabled", "faers_calls", "max_attempts", "attempts", "calls", "state", "looked_up"]
    return [tuple(k.get(n, v) for n, v in zip(names, RUN))]


BREACHES = [
    ({}, set()), ({"steps": GOOD["steps"][:-1]}, {"ends_at_finalize"}), ({"planned": [("a", "b"), ("a", "c")], "retrieved": GOOD["retrieved"][:1] + [("a", "c", False)]}, {"plan_complete"}), ({"planned": [("a", "b"), ("a", "c"), ("c", "b")], "retrieved": [("a", "b", True), ("a", "c", True), ("c", "b", False)]}, {"plan_complete"}),
    ({"retrieved": [*GOOD["retrieved"], ("a", "b", False)]}, {"partition_holds"}), ({"retrieved": GOOD["retrieved"][1:]}, {"partition_holds"}), ({"runs": changed(faers_calls=0)}, {"faers_only_when_needed"}), ({"steps": GOOD["steps"][:3] + GOOD["steps"][4:]}, {"faers_only_when_needed"}),
    ({"runs": changed(attempts=4)}, {"llm_attempts_within_budget"}), ({"steps": [(n, "err_nt" if o == "fail" else o) for n, o in GOOD["steps"]]}, {"non_transient_never_retried"}), ({"runs": changed(report="d1")}, {"no_unvalidated_llm_text"}), ({"runs": changed(report="else")}, {"no_unvalidated_llm_text"}),
    ({"runs": changed(source="deterministic_fallback", report="d1")}, {"no_unvalidated_llm_text", "exhausted_fallback_matches_deterministic"}), ({"runs": changed(source="deterministic_fallback", report="base")}, set()), ({"findings": ["X"]}, {"final_report_valid"}), ({"ms": None}, {"every_node_timed"}),
    ({"ms": -1.0}, {"every_node_timed"}), ({"runs": changed(state="{'a'")}, {"state_json_serializable"}), ({"runs": changed(looked_up=False)}, {"partition_holds"}), ({"steps": []}, {"ends_at_finalize", "every_node_timed", "faers_only_when_needed"}),
]


def test_each_breach_breaks_its_invariant(spark):
    tables = {k: [] for k in ("runs", "steps", "names", "planned", "retrieved", "drafts", "findings")}
    for i, (change, _) in enumerate(BREACHES):
        case = {**GOOD, **change}
        run = f"r{i:02}"
        tables["runs"] += [(run, *r[1:]) for r in case["runs"]]
        tables["steps"] += [(run, k + 1, n, "ok", case["ms"], o) for k, (n, o) in enumerate(case["steps"])]
        for name in ("names", "findings"):
            tables[name] += [(run, x) for x in case[name]]
        for name in ("planned", "retrieved", "drafts"):
            tables[name] += [(run, *x) for x in case[name]]
    kinds = {
        "runs": "run string, source string, report string, baseline string, faers_enabled boolean, faers_calls int, max_attempts int, attempts int, calls int, state string, looked_up boolean", "steps": LOG.replace("run int", "run string"), "names": "run string, name string",
        "planned": "run string, a string, b string", "retrieved": "run string, a string, b string, has_records boolean", "drafts": "run string, text string, valid boolean", "findings": "run string, code string",
    }
    t = {k: spark.createDataFrame(v, kinds[k]) for k, v in tables.items()}
    checked = tr.invariants(*[t[k] for k in tables])
    got = {r.run: {n for n in tr.INVARIANTS if not r[n]} for r in checked.collect()}
    assert got == {f"r{i:02}": want for i, (_, want) in enumerate(BREACHES)}
    rates = {r.invariant: (r.runs, r.passed) for r in tr.pass_rates(checked).collect()}
    assert rates["state_json_serializable"] == (len(BREACHES), len(BREACHES) - 1) and len(rates) == 11


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_percentiles_by_nearest_rank(spark, n):
    import random

    rng = random.Random(n)
    rows = [(rng.choice("ab"), float(rng.randint(0, 9))) for _ in range(n)] + [("a", None), ("c", None)]
    got = {r.node: (r.n, r.p50, r.p95) for r in tr.node_percentiles(spark.createDataFrame(rows, "node string, ms double"), ["node"]).collect()}
    for node in ("a", "b", None):
        vs = sorted(v for k, v in rows if v is not None and node in (None, k))
        if vs:
            assert got.pop(node) == (len(vs), *(vs[min(len(vs) - 1, int(round(q * (len(vs) - 1))))] for q in (0.5, 0.95)))
    assert not got
