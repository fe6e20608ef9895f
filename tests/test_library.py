"""Signals, pairs, statistics, names, readers and the limiter against hand-computed values and plain Python."""

import lzma
import random
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from duoscope.functions import signals, text
from duoscope.operators import names, pairs, report, stats
from duoscope.sources import provenance, readers
from duoscope.streaming import limiter


def test_signal(spark):
    row = (10000, 1000, 500, 100, 200, 40, 30, 20)
    cols = "total long, n_a long, n_b long, n_ab long, n_e long, n_ae long, n_be long, n_abe long"
    good, bad, zero = signals.assess(spark.createDataFrame([row, (10000, 1000, 500, 100, 400, 200, 30, 20), (100, 10, 10, 5, 5, 5, 5, 5)], cols)).collect()
    assert (good.n11, good.n10, good.n01, good.n00) == (20, 80, 180, 9720)
    assert [round(x, 4) for x in (good.prr, good.ror, good.ror_low, good.ror_high)] == [11.0, 13.5, 8.093, 22.5195] and round(good.chi2, 3) == 157.828
    assert good.surfaced and good.reasons == "" and bad.reasons == "explained_by_a" and zero.prr is None and zero.ror is None
    with pytest.raises(Exception, match="contradict"):
        signals.assess(spark.createDataFrame([(100, 10, 10, 5, 5, 5, 5, 6)], cols)).collect()


def test_text(spark):
    df = spark.createDataFrame([("celebyx", "celebrex"), ("hydroxalazine", "hydroxyzine"), ("", ""), ("a\U0001f600b", "ab"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(text.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 1) if x is not None else None for x in got] == [80.0, 83.3, 100.0, 80.0, None]
    folded = df.select(text.fold(F.lit(" Haemorrhage – Gastrooesophageal\n oedema "))).first()[0]
    assert folded == "hemorrhage - gastroesophageal edema"


def test_pairs(spark):
    rows = spark.createDataFrame([("b", "a", 1, 2), ("a", "b", 3, 4), ("a", "a", 5, 6), (None, "x", 7, 8)], "a string, b string, x int, y int")
    assert sorted(map(tuple, pairs.orient(rows, "a", "b", (("x", "y"),)).collect())) == [("a", "b", 2, 1), ("a", "b", 3, 4)]
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "a"), (2, "a"), (3, None)], "request int, name string")
    plan = pairs.plan(asked)
    assert sorted(map(tuple, plan.collect())) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]
    done = {r.request: (r.n_expected, r.n_pairs, r.complete) for r in pairs.completeness(asked, plan).collect()}
    assert done == {1: (3, 3, True), 2: (0, 0, True), 3: (0, 0, True)}
    records = spark.createDataFrame([("a", "b", f"e{i}", "S" if i else "C", i) for i in range(5)], "a string, b string, event string, source string, n int")
    shown = pairs.select_records(pairs.lookup(plan, records), F.col("source") == "S", [F.desc("n")]).collect()
    assert sorted((r.event, r.hidden) for r in shown) == [("e0", 1), ("e2", 1), ("e3", 1), ("e4", 1)]
    assert pairs.best_rows(records, ["a", "b"], [*pairs.falling("n")]).first().event == "e4"
    assert pairs.plan(asked.where("false")).count() == 0


def test_statistics(spark):
    labels = ["Minor", "Moderate", "Major"]
    df = spark.createDataFrame([("Minor", "Minor"), ("Minor", "Moderate"), ("Major", "Major"), ("Moderate", "Minor"), (None, "Major")], "t string, p string")
    got = stats.agreement(stats.confusion(df, "t", "p", labels), labels).first()
    assert (got.n, got.accuracy, round(got.macro_f1, 6)) == (4, 0.5, 0.5)
    po, pe = 0.5 + 0.5 * 0.5, sum((1 - abs(i - j) / 2) * a * b for i, a in enumerate((0.5, 0.25, 0.25)) for j, b in enumerate((0.5, 0.25, 0.25)))
    assert abs(got.kappa_linear - (po - pe) / (1 - pe)) < 1e-12
    xy = spark.createDataFrame([("g", 1, 10), ("g", 2, 10), ("g", 2, 30), ("g", 3, 40), ("one", 1, 1), ("flat", 1, 1), ("flat", 1, 2)], "g string, x int, y int")
    rho = {r.g: r.rho for r in stats.spearman(xy, ["g"], "x", "y").collect()}
    assert abs(rho["g"] - 0.8333333333) < 1e-9 and rho["one"] is None and rho["flat"] is None
    values = spark.createDataFrame([("g", float(i)) for i in range(4)], "g string, v double")
    assert tuple(stats.nearest_rank(values, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()) == ("g", 4, 2.0, 3.0)
    assert pairs.degree(spark.createDataFrame([], "a string, b string")).count() == 0


def test_names(spark):
    vocabulary = spark.createDataFrame([(n, n) for n in ("aspirin", "celebrex", "insulin glargine", "insulin lispro", "hydroxyzine", "hydralazine")], "alias string, canonical string")
    asked = spark.createDataFrame([(" Aspirin ",), ("celebrx",), ("insulin",), ("hydroxalazine",), ("qqqq",), ("duo",), ("",), (None,)], "query string")
    got = {r.query: (r.method, r.canonical) for r in names.resolve(asked, vocabulary, spark.createDataFrame([("duo",)], "name string"), vocabulary).collect()}
    assert got == {"aspirin": ("exact", "aspirin"), "celebrx": ("fuzzy", "celebrex"), "insulin": ("family", None), "hydroxalazine": ("ambiguous", None), "qqqq": ("unresolved", None), "duo": ("combination", None), "": ("unresolved", None)}


def test_fuzzy_candidates_equal_brute_force(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    made = sorted({"".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(80)} | {"".join(rng.choice("abcdefg ") for _ in range(rng.randint(50, 90))) for _ in range(6)})
    asked = sorted({w[:i] + c + w[i + 1 :] for w in made for i, c in [(rng.randrange(len(w)), rng.choice(["", "a", "xy"]))]} | {""})
    queries, known = spark.createDataFrame([(w,) for w in [*asked, None]], "query string"), spark.createDataFrame([(w,) for w in made], "name string")
    for floor in (75.0, 50.0):
        got = {(r.query, r.name): r.score for r in names.fuzzy_candidates(queries, known, floor).collect()}
        want = {(a, b): 200 * common(a, b) / (len(a) + len(b)) for a in asked for b in made if a}
        assert got == {k: v for k, v in want.items() if v >= floor}
    assert names.fuzzy_candidates(queries, known.limit(0)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "ts.csv").write_text("drug_1_rxnorn_id,drug_1_concept_name,drug_2_rxnorm_id,drug_2_concept_name,condition_meddra_id,condition_concept_name,A,PRR,mean_reporting_frequency\n" + "\n".join(
        ["1,Aa,2,Bb,9,Rash,6,3.0,0.1", "2,Bb,1,Aa,9,Rash,7,4.0,0.1", "1,Aa,2,Bb,8,Pain,9,1.0,", "1,Aa,2,Bb,7,Ache,2,5.0,", "1,Aa,2,Bb,6,Death,9,5.0,", "5,Zz,2,Bb,9,Rash,9,5.0,", "1,Aa,1,Aa,9,Rash,9,5.0,", "1,Aa,2,Bb,4,Itch,x,bad,"]))
    raw = readers.delimited(spark, str(tmp_path / "ts.csv"))
    by_name = spark.createDataFrame([("aa", "aa"), ("bb", "bb")], "key string, canonical string")
    by_id = spark.createDataFrame([("1", "aa")], "key string, canonical string")
    kept, rejects = readers.statistical(raw, by_name, by_id, ["death"])
    row = kept.collect()
    assert [(r.drug_a_name, r.drug_b_name, r.drug_a_rxcui, r.prr, r.reports, r.severity) for r in row] == [("aa", "bb", "1", 4.0, 7, "Moderate")] and row[0].record_id.startswith("TS-")
    assert {r.reason: r.n for r in rejects.collect()} == {"prr": 2, "min_reports": 1, "administrative": 1, "unmatched": 1, "self_pair": 1, "duplicate": 1, "kept": 1}
    (tmp_path / "c.csv").write_text("DDInterID_A,Drug_A,DDInterID_B,Drug_B,Level\nD2, B ,D1,A,Major\nD1,A,D2,B,Major\nD1,A,D3,C,odd\n")
    assert sorted((r.drug_a_name, r.drug_b_name, r.severity) for r in readers.curated(readers.delimited(spark, str(tmp_path / "c.csv"))).collect()) == [("a", "b", "Major"), ("a", "c", "Unknown")]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("Products.txt", "A\tB\n1\t\"caf\xe9\n2\t\n".encode("latin-1"))
    assert [tuple(r) for r in readers.fields(readers.archived(spark, str(tmp_path / "p.zip"), "Products.txt", "latin-1"), "\t").collect()] == [("1", '"café'), ("2", "")]
    with lzma.open(tmp_path / "x.csv.xz", "wt") as f:
        f.write("a,b\n1,2\n")
    assert [tuple(r) for r in readers.fields(readers.archived(spark, str(tmp_path / "x.csv.xz")), ",").collect()] == [("1", "2")]
    (tmp_path / "T.RRF").write_text("1||x|\n2|y||\n")
    assert [tuple(r) for r in readers.rrf(spark, str(tmp_path / "T.RRF"), ["a", "b", "c"]).collect()] == [("1", "", "x"), ("2", "y", "")]


def test_vocabulary(spark):
    concepts = [("1", "IN", "Aa"), ("2", "IN", "Bb"), ("3", "BN", "Brand"), ("4", "MIN", "Aa / Bb"), ("5", "BN", "Twice"), ("6", "BN", "Twice")]
    made = spark.createDataFrame([(i, "ENG", "RXNORM", t, "", s, "N") for i, t, s in concepts], "RXCUI string, LAT string, SAB string, TTY string, CODE string, STR string, SUPPRESS string")
    rel = spark.createDataFrame([(a, b, "part_of", "RXNORM") for a, b in (("3", "1"), ("4", "1"), ("4", "2"), ("5", "1"), ("6", "2"))], "RXCUI1 string, RXCUI2 string, RELA string, SAB string")
    aliases, combos = readers.vocabulary(made, rel)
    assert {(r.name_lower, r.generic_name) for r in aliases.collect()} == {("aa", "aa"), ("bb", "bb"), ("brand", "aa")}
    assert [tuple(r) for r in combos.collect()] == [("aa / bb", "aa + bb")]


def test_provenance_and_report(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"1")
    actual = provenance.hashes(spark, [str(tmp_path / "d")])
    listed = spark.createDataFrame([("d/x.bin", "0"), ("d/gone", "1")], "name string, sha256 string")
    assert {r.name: r.status for r in provenance.verify(listed, actual).collect()} == {"d/x.bin": "changed", "d/gone": "missing"}
    one = report.finalize(F.lit("text"))
    twice = spark.range(1).select(one.alias("x"), report.finalize(one).alias("y"), report.strip_section(F.lit("## A\nx\ny\n## B\nz"), "## A").alias("s")).first()
    assert twice.x == twice.y and twice.x.endswith(report.DISCLAIMER) and twice.s == "## B\nz"


def test_limiter(spark):
    rng = random.Random(3)
    hits = [(i, rng.choice("abc"), float(rng.randint(0, 300))) for i in range(200)] + [(900, None, 1.0), (901, "a", None)]
    got = {r.i: r.allowed for r in limiter.admit(spark.createDataFrame(hits, "i int, key string, at double"), 3, 60.0).collect()}
    held, expected = {}, {900: False, 901: False}
    for i, k, at in sorted((h for h in hits if h[1] and h[2] is not None), key=lambda h: (h[1], h[2], h[0])):
        expected[i] = limiter.step(held.setdefault(k, deque()), at, 3, 60.0)[0]
    assert got == expected
