"""Both ingests over small files of all sources."""

import lzma
import zipfile

import pytest

from duoscope.sources import ingest
from duoscope.sources import vocabulary as voc


def test_sample(spark, tmp_path):
    (tmp_path / "drug_vocabulary.csv").write_text("name_lower,generic_name,rxcui\nbrand,aa,1\nbb,bb,2\n")
    (tmp_path / "interactions.csv").write_text("record_id,drug_a_name,drug_b_name,drug_a_rxcui,drug_b_rxcui,prr,source\nT1,bb,Brand,2,1,3.5,TWOSIDES\n")
    (tmp_path / "ddinter.csv").write_text("record_id,drug_a_name,drug_b_name,mechanism,source\nD1,aa,zz,,DDInter\n")
    (tmp_path / "side_effects.csv").write_text("record_id,drug_name,side_effect_name,source\nS1,BRAND,rash,SIDER\n")
    report = {(r.table, r.source): r.n for r in ingest.ingest_sample(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert report == {("drug_vocabulary", "all"): 3, ("interactions", "TWOSIDES"): 1, ("interactions", "DDInter"): 1, ("side_effects", "SIDER"): 1, ("issues", "interactions"): 1}
    rows = {r.record_id: (r.drug_a_name, r.drug_b_name, r.drug_a_rxcui, r.prr) for r in spark.read.parquet(str(tmp_path / "out/interactions.parquet")).collect()}
    assert rows == {"T1": ("aa", "bb", "1", "3.5"), "D1": ("aa", "zz", None, None)}
    with pytest.raises(FileNotFoundError):
        ingest.ingest_sample(spark, str(tmp_path / "none"), str(tmp_path / "out2"))


def rrf(columns, rows):
    return "".join("|".join([*(r.get(c, "") for c in columns)]) + "|\n" for r in rows)


def test_full(spark, tmp_path):
    for d in ("rxnorm/rrf", "ddinter", "twosides", "sider"):
        (tmp_path / d).mkdir(parents=True)
    concept = {"LAT": "ENG", "SAB": "RXNORM", "SUPPRESS": "N"}
    (tmp_path / "rxnorm/rrf/RXNCONSO.RRF").write_text(rrf(ingest.CONCEPTS, [{**concept, "RXCUI": i, "TTY": t, "STR": s} for i, t, s in (("1", "IN", "Aa"), ("2", "IN", "Bb"), ("3", "BN", "Brand"), ("4", "MIN", "Aa / Bb"))]))
    (tmp_path / "rxnorm/rrf/RXNREL.RRF").write_text(rrf(ingest.RELATIONS, [{"RXCUI1": x, "RXCUI2": y, "RELA": "part_of", "SAB": "RXNORM"} for x, y in (("3", "1"), ("4", "1"), ("4", "2"))]))
    (tmp_path / "ddinter/x.csv").write_text("DDInterID_A,Drug_A,DDInterID_B,Drug_B,Level\nD2,Bb,D1,Brand,Major\nD1,Brand,D3,Strange,Minor\nD1,Aa,D2,Bb,Major\nD4,Aa,D1,Brand,Minor\n")
    with lzma.open(tmp_path / "twosides/TWOSIDES.csv.xz", "wt") as f:
        f.write("drug_1_rxnorn_id,drug_1_concept_name,drug_2_rxnorm_id,drug_2_concept_name,condition_meddra_id,condition_concept_name,A,PRR,mean_reporting_frequency\n2,Bb,1,Aa,9,Rash,7,4.0,0.1\n2,Bb,8,Zz,9,Rash,7,4.0,0.1\n")
    (tmp_path / "sider/meddra_all_se.tsv").write_text("C1\tS1\tx\tPT\tU1\tRash\nC1\tS1\tx\tLLT\tU2\tItch\nC2\tS2\tx\tPT\tU1\tRash\n")
    (tmp_path / "sider/drug_names.tsv").write_text("S1\tzz\nS1\tBrand\n")
    changes = spark.createDataFrame([("old name", "bb"), ("lost", "nothing")], "alias string, canonical string")
    report = {(r.table, r.source): r.n for r in ingest.ingest_full(spark, str(tmp_path), str(tmp_path / "out"), research=True, overrides=changes).collect()}
    assert report == {("drug_vocabulary", "all"): 4, ("combination_products", "all"): 1, ("interactions", "DDInter"): 1, ("interactions", "TWOSIDES"): 1, ("side_effects", "SIDER"): 1}
    table = lambda name: spark.read.parquet(str(tmp_path / f"out/{name}.parquet"))
    assert {(r.drug_a_name, r.drug_b_name, r.severity, r.reports) for r in table("interactions").collect()} == {("aa", "bb", "Major", None), ("aa", "bb", "Moderate", 7)}
    assert {tuple(r) for r in table("unmatched_curated").collect()} == {("strange", 1)} and {tuple(r) for r in table("unmatched_statistical").collect()} == {("zz", 1)}
    assert [(r.drug_name, r.side_effect_name) for r in table("side_effects").collect()] == [("aa", "rash")] and [tuple(r) for r in table("unmatched_side_effects").collect()] == [("(no name)", 1)]
    assert {r.name_lower for r in table("drug_vocabulary").collect()} == {"aa", "bb", "brand", "old name"}


def named(listed, target, kind=None):
    return {"name_lower": listed, "generic_name": target, "rxcui": f"R-{target}", "drugbank_id": None, "kind": kind or "RXNORM:IN"}


VOCABULARY = "name_lower string, generic_name string, rxcui string, drugbank_id string, kind string"


def brands_by_hand(products, alias, combos):
    """Outcomes of brands by plain loops."""
    sets, unmapped, out = {}, set(), {}
    for name, listed in products:
        parts = [p.strip().lower() for p in (listed or "").split(";") if p.strip()]
        got = [alias.get(p) for p in parts]
        if not parts or None in got:
            unmapped.add(name.strip().lower())
        else:
            sets.setdefault(name.strip().lower(), set()).add(tuple(sorted(set(got))))
    for n in {*sets, *unmapped}:
        mine = sets.get(n, set())
        if not mine:
            out[n] = "unmapped"
        elif n in unmapped or len(mine) > 1:
            out[n] = "ambiguous"
        elif n in alias or n in combos:
            (only,) = mine
            out[n] = "known" if " + ".join(only) in (combos.get(n), alias.get(n) if len(only) == 1 else None) else "collision"
        else:
            out[n] = "alias" if len(next(iter(mine))) == 1 else "combination"
    return out


def test_brands_against_loops(spark):
    vocabulary = [named("aa", "aa"), named("bb", "bb"), named("aa salt", "aa"), named("brand a", "aa"), named("brand b", "bb")]
    combos = [("duo", "aa + bb"), ("trio", "aa + cc")]
    products = [
        ("New ", "AA"), ("new", "aa salt"), ("new", "AA;aa salt"), ("two", "bb; aa"), ("two", "aa;bb;;"), ("mixed", "aa"), ("mixed", "bb"), ("half", "aa"), ("half", "zz"), ("half", "aa;zz"), ("none", "zz"), ("none", "zz"), ("empty", ""), ("null", None),
        ("brand a", "aa"), ("brand b", "aa"), ("brand a ", "AA SALT"), ("duo", "bb;aa"), ("trio", "aa;bb"), ("aa", "aa;bb"), ("duo ", "aa;bb"), ("  ", "aa"),
    ]
    aliases, combined = spark.createDataFrame(vocabulary, VOCABULARY), spark.createDataFrame(combos, "name_lower string, ingredients string")
    found = voc.brand_outcomes(spark.createDataFrame(products, "drug_name string, active_ingredient string"), aliases, combined).cache()
    alias = {v["name_lower"]: v["generic_name"] for v in vocabulary}
    assert {r.name: r.outcome for r in found.collect()} == brands_by_hand([p for p in products if p[0].strip()], alias, dict(combos))
    merged = voc.merge_brands(aliases, combined, found)
    new = {r.name_lower: (r.generic_name, r.rxcui, r.kind) for r in merged.aliases.collect() if r.name_lower not in alias}
    assert new == {"new": ("aa", "R-aa", voc.BRAND)} and {tuple(r) for r in merged.combinations.collect()} == {*combos, ("two", "aa + bb")}
    assert {tuple(r) for r in merged.review.collect()} == {
        ("mixed", "ambiguous", "aa | bb", ""), ("half", "ambiguous", "aa | (unmapped)", ""), ("brand b", "collision", "aa", "bb"), ("trio", "collision", "aa + bb", "combination: aa + cc"), ("aa", "collision", "aa + bb", "aa"),
    }
    none = voc.brand_outcomes(spark.createDataFrame([], "drug_name string, active_ingredient string"), aliases, combined)
    assert none.count() == 0


def test_reviewed_names_and_synonyms(spark, tmp_path):
    aliases = spark.createDataFrame([named("aa", "aa"), named("bb", "bb"), named("old", "bb"), named("mark", "aa", voc.BRAND), named("optic", "aa", voc.BRAND)], VOCABULARY)
    listed = voc.pairs_of(spark, {"old": "aa", "inn": "aa", "lost": "nothing", "salted": "old"})
    more, missing = voc.add_reviewed(aliases, listed)
    rows = {r.name_lower: (r.generic_name, r.rxcui, r.kind) for r in more.collect()}
    assert rows["old"] == ("bb", "R-bb", "RXNORM:IN") and rows["inn"] == ("aa", "R-aa", "REVIEWED_ALIAS") and rows["salted"][0] == "bb" and [r[0] for r in missing.collect()] == ["lost"]
    moved, missing = voc.redirect(aliases, voc.pairs_of(spark, {"optic": "bb", "x": "old"}), "FIX")
    rows = {r.name_lower: (r.generic_name, r.kind) for r in moved.collect()}
    assert rows["optic"] == ("bb", "FIX") and len(rows) == 5 and [r[0] for r in missing.collect()] == ["x"]
    sources, missing = voc.for_sources(moved, voc.pairs_of(spark, {"mark": "aa", "y": "zz"}))
    rows = {r.name_lower: (r.generic_name, r.kind) for r in sources.collect()}
    assert rows["mark"] == ("aa", "REVIEWED_SOURCE_ALIAS") and rows["optic"][0] == "bb" and [r[0] for r in missing.collect()] == ["y"]
    (tmp_path / "s.csv").write_text('DrugBank ID,Common name,CAS,UNII,Synonyms\nD1,Aa,,U1,"First | bb"\nD2,Second,, U1,First |Third\nD3,Zz,,U9,q\nD4,,,U1,\nD5,"Two\nlines",,U1,\n')
    entries = voc.synonym_file(spark, str(tmp_path / "s.csv"))
    merged, outcomes = voc.merge_synonyms(aliases, entries, spark.createDataFrame([("U1", "aa")], "unii string, canonical string"))
    new = {r.name_lower: (r.generic_name, r.drugbank_id, r.kind) for r in merged.collect() if r.kind == "DRUGBANK"}
    assert new == {"first": ("aa", "D1", "DRUGBANK"), "second": ("aa", "D2", "DRUGBANK"), "third": ("aa", "D2", "DRUGBANK"), "two\nlines": ("aa", "D5", "DRUGBANK")}
    assert {tuple(r) for r in outcomes.collect()} == {("added", 4), ("known", 2), ("conflict", 1), ("unlinked", 1)}


def test_coverage(spark):
    said = spark.createDataFrame([("a", "A", 0), ("b", None, 2), ("c", None, 5), ("d", None, 2)], "name string, canonical string, n bigint")
    (row,) = voc.coverage(said, 10, 4, shown=2).collect()
    assert (row.distinct_names, row.matched_names, row.name_match_rate, row.rows_in, row.rows_kept, row.row_retention, row.unmatched_names) == (4, 1, 0.25, 10, 4, 0.4, 3)
    assert [tuple(x) for x in row.top_unmatched] == [("c", 5), ("b", 2)]
    (row,) = voc.coverage(said.where("false"), 0, 0).collect()
    assert row.distinct_names == 0 and row.name_match_rate is None and row.row_retention is None and row.top_unmatched == []


def test_full_with_brands_salts_and_synonyms(spark, tmp_path):
    for d in ("rxnorm", "drugsatfda", "ddinter", "twosides", "sider"):
        (tmp_path / d).mkdir()
    concept = {"LAT": "ENG", "SAB": "RXNORM", "SUPPRESS": "N"}
    atoms = [("1", "IN", "Lithium carbonate"), ("2", "IN", "Lithium citrate"), ("3", "IN", "Albuterol"), ("4", "IN", "Perflutren"), ("5", "IN", "Albumin human"), ("6", "PIN", "Albuterol sulfate"), ("7", "IN", "Ogenin")]
    rows = [{**concept, "RXCUI": i, "TTY": t, "STR": s} for i, t, s in atoms] + [{**concept, "SAB": "MTHSPL", "TTY": "SU", "RXCUI": "3", "STR": "ALBUTEROL", "CODE": "U3"}]
    with zipfile.ZipFile(tmp_path / "rxnorm/release.zip", "w") as z:
        z.writestr("release/rrf/RXNCONSO.RRF", rrf(ingest.CONCEPTS, rows))
        z.writestr("release/rrf/RXNREL.RRF", rrf(ingest.RELATIONS, [{"RXCUI1": "6", "RXCUI2": "3", "RELA": "has_form", "SAB": "RXNORM"}]))
    with zipfile.ZipFile(tmp_path / "drugsatfda/files.zip", "w") as z:
        z.writestr("Products.txt", "ApplNo\tProductNo\tDrugName\tActiveIngredient\n1\t1\tOptison\tALBUMIN HUMAN\n2\t1\tVentil\xe9\talbuterol sulfate\n3\t1\tBoth\talbuterol;perflutren\n4\t1\tHalf\talbuterol;zz\n".encode("latin-1"))
        z.writestr("Other.txt", "x\n")
    (tmp_path / "syn.csv").write_text("DrugBank ID,Common name,UNII,Synonyms\nD1,Albuterol,U3,Proventyl\n")
    (tmp_path / "ddinter/x.csv").write_text("DDInterID_A,Drug_A,DDInterID_B,Drug_B,Level\nA,Salbutamol,B,Lithium citrate,Major\nA,Salbutamol,C,Ventil\xe9,Minor\nB,Lithium citrate,D,Lithium carbonate,Minor\nA,Proventyl,E,Optison,Moderate\n", encoding="utf-8")
    (tmp_path / "twosides/TWOSIDES.csv").write_text("drug_1_rxnorn_id,drug_1_concept_name,drug_2_rxnorm_id,drug_2_concept_name,condition_meddra_id,condition_concept_name,A,PRR,mean_reporting_frequency\n6,what,4,Perflutren,9,Rash,7,4.0,0.1\n6,what,44,Weak,9,Rash,7,1.0,0.1\n6,what,44,Strange,9,Rash,7,3.0,0.1\n")
    report = ingest.ingest_full(spark, str(tmp_path), str(tmp_path / "out"), research=True, synonyms=str(tmp_path / "syn.csv"))
    assert {(r.table, r.source): r.n for r in report.collect()} == {("drug_vocabulary", "all"): 12, ("combination_products", "all"): 1, ("interactions", "DDInter"): 2, ("interactions", "TWOSIDES"): 1}
    table = lambda name: spark.read.parquet(str(tmp_path / f"out/{name}.parquet"))
    users, sources = ({r.name_lower: (r.generic_name, r.kind) for r in table(t).collect()} for t in ("drug_vocabulary", "source_vocabulary"))
    assert users["optison"] == ("perflutren", "REVIEWED_BRAND_OVERRIDE") and users["ventil\xe9"] == ("albuterol", voc.BRAND) and "ventil\xe9" not in sources
    assert sources["optison"] == ("perflutren", "REVIEWED_SOURCE_ALIAS") and sources["lithium citrate"][0] == "lithium" and users["lithium"] == ("lithium", "SALT_GROUP") and users["salbutamol"] == ("albuterol", "REVIEWED_ALIAS") and users["proventyl"] == ("albuterol", "DRUGBANK")
    assert {(r.drug_a_name, r.drug_b_name, r.source) for r in table("interactions").collect()} == {("albuterol", "lithium", "DDInter"), ("albuterol", "perflutren", "DDInter"), ("albuterol", "perflutren", "TWOSIDES")}
    measures = {r.measure: r.n for r in table("vocabulary_report").collect()}
    assert measures["brands_alias"] == 2 and measures["brands_combination"] == 1 and measures["brands_unmapped"] == 1 and measures["synonyms_added"] == 1 and measures["user_only_aliases"] == 1 and measures["overrides_missing_target"] == 0 and measures["reviewed_aliases_missing_target"] == 20
    covered = {r.source: r for r in table("coverage").collect()}
    assert (covered["ddinter"].distinct_names, covered["ddinter"].matched_names, covered["ddinter"].rows_in, covered["ddinter"].rows_kept, [tuple(x) for x in covered["ddinter"].top_unmatched]) == (6, 5, 4, 2, [("ventil\xe9", 1)])
    assert (covered["twosides"].distinct_names, covered["twosides"].unmatched_names, covered["twosides"].rows_in, [tuple(x) for x in covered["twosides"].top_unmatched]) == (3, 1, 3, [("strange", 1)])
