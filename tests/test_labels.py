"""Label evidence, tables in two forms, bridges, modes, audits and maps on rows out of the ordinary."""

import pytest
from pyspark.sql import functions as F

from duoscope.functions import labels as lb
from duoscope.functions.text import age_days, override, request_url
from duoscope.operators import labels, names, stats
from duoscope.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_classes_and_snippets(spark):
    said = [("contraindications", "Anything."), ("warnings", "Is CONTRAINDICATED."), ("warnings", "Do not use with x."), ("warnings", "Titrate slowly."), ("warnings", "Seen with x."), (None, None)]
    got = spark.createDataFrame(said, "s string, t string").select(lb.label_class(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["contraindicated", "contraindicated", "avoid_or_not_recommended", "monitor_or_adjust", "mentioned_without_guidance", "mentioned_without_guidance"]
    text = "a" * 100 + " Warfarin " + "b" * 100
    got = spark.createDataFrame([(text,), ("warfarin",)], "t string").select(lb.snippet(F.col("t"), F.lit("warfarin"), 20)).collect()
    assert [r[0] for r in got] == ["…" + "a" * 9 + " Warfarin " + "b" * 9 + "…", "warfarin"]


def test_label_choice_and_strongest_class(spark):
    df = spark.createDataFrame([("d", "ANDA1", "2025", "a"), ("d", "NDA1", "2020", "b"), ("d", "NDA2", "2021", "c"), ("e", None, None, "x")], "drug string, app string, eff string, id string")
    assert rows(labels.choose_label(df, ["drug"], "app", "eff", "id")) == [("d", "c", True), ("e", "x", False)]
    found = spark.createDataFrame([("p", "monitor_or_adjust"), ("p", "avoid_or_not_recommended"), ("q", "not_mentioned")], "pair string, class string")
    assert rows(labels.strongest(found, ["pair"], "class")) == [("p", "avoid_or_not_recommended"), ("q", "not_mentioned")]
    assert rows(labels.strongest(found.limit(0), ["pair"], "class")) == []


def test_tables_in_two_forms(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "é")], "id string, name string")
    path = f"{tmp_path}/deep/one.parquet"
    assert not tables.table_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    assert tables.write_table(df, f"{tmp_path}/deep/one.csv").endswith(".csv")
    assert tables.table_exists(spark, path) and rows(tables.read_table(spark, path)) == rows(df)
    tables.write_table(df.limit(1), path)
    assert tables.read_table(spark, path).count() == 1
    assert tables.first_match(spark, f"{tmp_path}/deep", "two*", "one*").endswith("one.csv")
    assert tables.first_match(spark, f"{tmp_path}/deep", "no*") is None


def test_bridge_outcomes(spark):
    entries = spark.createDataFrame([(1, "U1 ", ["A", " b ", ""]), (2, "U2", ["b", "known"]), (3, None, ["c"]), (4, "U9", None)], "key long, unii string, names array<string>")
    links = spark.createDataFrame([("U1", "x"), ("U2", "y")], "unii string, canonical string")
    aliases = spark.createDataFrame([("known", "z"), ("a", "x")], "alias string, canonical string")
    want = [("3", None, "unlinked"), ("4", None, "unlinked"), ("a", "x", "known"), ("b", "x", "added"), ("b", "y", "conflict"), ("known", "y", "conflict")]
    assert rows(names.unii_bridge(entries, links, aliases)) == want


def test_mode_audit_and_runs(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("h", "c"), ("h", "c")], "k string, v string")
    assert rows(stats.mode(df, ["k"], "v")) == [("g", "a", 1), ("h", "c", 2)]
    answers = spark.createDataFrame([(1, "Yes "), (2, None), (3, "what"), (9, "yes")], "id long, human string")
    key = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "no")], "id long, judge string")
    assert [(r.id, r.kind) for r in stats.unblind(answers, key, ["yes", "no"]).orderBy("id").collect()] == [(1, "scored"), (2, "blank"), (3, "invalid"), (9, "invalid")]
    runs = spark.createDataFrame([("s", 0, None, "draft"), ("t", 2, False, "retry"), ("t", 1, True, "draft")], "k string, drafts int, first_passed boolean, source string")
    assert rows(stats.run_summary(runs, ["k"])) == [("s", 1, 0, None, None, None), ("t", 2, 2, 0.5, 1.0, 0.0)]


def test_addresses_maps_and_ages(spark):
    df = spark.createDataFrame([("a b&c", {"x": "1", "y": "2"}, {"y": "3"}, "2024-01-31"), (None, None, None, "soon")], "q string, m map<string,string>, o map<string,string>, d string")
    got = df.select(request_url("u", {"search": F.col("q"), "n": F.lit(1)}), override(F.col("m"), F.col("o")), age_days(F.col("d"), F.lit("2024-03-01").cast("date"))).collect()
    assert [tuple(r) for r in got] == [("u?search=a+b%26c&n=1", {"x": "1", "y": "3"}, 30), ("u?n=1", {}, None)]


def test_clauses_end_at_the_nearest_boundary():
    text = "First. Avoid x; give Drug with care. Then more"
    at = text.index("Drug")
    assert labels.clause(text, at, at + 4) == "give Drug with care"
    for said, want in [("see (7.2) use Drug [SEE here. there] now", "use Drug"), ("Drug", "Drug"), ("a" * 300 + " Drug " + "b" * 300, "a" * 249 + " Drug " + "b" * 249)]:
        at = said.index("Drug")
        assert labels.clause(said, at, at + 4) == want
    table = "Clinical Impact: x. Intervention: Reduce dose. Examples: one, Drug, two. End"
    at = table.index("Drug")
    assert labels.clause(table, at, at + 4) == "Intervention: Reduce dose. … Examples: one, Drug, two"
    table = "Intervention: Reduce dose. Examples: one. Clinical impact: more; Drug. End"
    at = table.index("Drug")
    assert labels.clause(table, at, at + 4) == "Drug"


def test_mentions_equal_a_pattern_for_each_name(spark):
    import random
    import re

    rng = random.Random(3)
    own = {"n1": ["alpha", "alpha beta", "beta-x", "abc"], "n2": ["beta", "alphab"], "n3": ["gamma", "alpha"]}
    parts = ["alpha", "beta", "beta-x", "gamma", "abc", "alphab", ",", ".", "-", "x1"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "-"]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", "ALPHA Beta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    known = spark.createDataFrame([(a, n) for n, x in own.items() for a in x] + [("short", None)], "alias string, name string")
    want = set()
    for i, t in enumerate(texts):
        for n, x in own.items():
            long = sorted((a for a in x if len(a) >= 4), key=len, reverse=True)
            for m in re.finditer(r"(?<![a-z0-9-])(" + "|".join(map(re.escape, long)) + r")(?![a-z0-9-])", (t or "").lower()):
                want.add((i, n, m.group(1), m.start(), m.end()))
    for block in (1, 1000):
        got = {tuple(r)[:5] for r in labels.mentions(df, known, ["id"], block=block).collect()}
        assert got == want and len(want) > 100


def test_labels_are_chosen_searched_and_settle_pairs(spark):
    said = [
        ("d", 0, "s0", "1", "2025", "ANDA1", "", ["D"], {"warnings": "Avoid eeee."}), ("d", 1, "s1", "1", "2020", "NDA1", "", [" d "], {"warnings": "Seen with eeee. Monitor.", "drug_interactions": "Monitor eeee; avoid eeee!"}),
        ("d", 2, "s2", "1", "2020", "NDA2", "", ["d"], {"warnings": "x"}), ("d", 3, "s3", "1", "2030", "NDA3", "", ["d", "e"], {"warnings": "x"}), ("d", 4, "s4", "1", "2030", "NDA3", "", ["d"], {"other": "x"}),
        ("eeee", 0, "t0", "1", None, None, None, ["e-salt"], {"contraindications": "With ffff."}), ("gggg", 0, "u0", "1", None, None, None, ["unknown"], {"warnings": "x"}), ("ffff", 0, "v", "1", None, None, None, ["ffff"], {"warnings": ""}), ("hhhh", 0, "w", "1", None, None, None, ["hhhh"], {"warnings": "Nothing, but eeee."}),
    ]
    found = spark.createDataFrame(said, "drug string, place int, set_id string, version string, effective string, application string, brand string, generics array<string>, sections map<string,string>")
    vocabulary = spark.createDataFrame([("d", "d"), ("e-salt", "eeee"), ("eeee", "eeee"), ("ffff", "ffff"), ("hhhh", "hhhh")], "alias string, name string")
    chosen = labels.choose_labels(found, vocabulary)
    assert rows(chosen.select("drug", "set_id")) == [("d", "s1"), ("eeee", "t0"), ("hhhh", "w")]
    matches = labels.find_matches(labels.section_rows(chosen, ["drug"]), vocabulary, ["drug", "section", "place"])
    pairs = spark.createDataFrame([("d", "eeee", "interaction"), ("d", "ffff", "none"), ("eeee", "ffff", "none"), ("d", "hhhh", "none"), ("d", "hhhh", "interaction"), ("eeee", "hhhh", "interaction"), ("ffff", "gggg", "interaction")], "a string, b string, expected string")
    told = labels.pair_evidence(pairs, chosen, matches)
    got = told.select("a", "b", "expected", "class", labels.decide(*[F.col(c) for c in ("expected", "class", "a", "b", "label_a", "label_b")]).alias("d")).select("a", "b", "class", "d.*")
    assert rows(got) == sorted([
        ("d", "eeee", "avoid_or_not_recommended", "interaction", "label: avoid / not recommended"), ("d", "ffff", "not_mentioned", "unclear", "no single-ingredient label found for ffff"),
        ("eeee", "ffff", "contraindicated", "unclear", "no single-ingredient label found for ffff"), ("d", "hhhh", "not_mentioned", "none_weak", "not mentioned in either label (weak evidence of no interaction)"),
        ("d", "hhhh", "not_mentioned", "unclear", "neither label names the other drug (it may be covered only by a class)"), ("eeee", "hhhh", "mentioned_without_guidance", "unclear", "named in a label, but without guidance the heuristic recognises"),
        ("ffff", "gggg", "not_mentioned", "unclear", "no single-ingredient label found for ffff, gggg"),
    ], key=repr)
    assert rows(told.where("b = 'eeee'").select("best.section", "best.alias", "best.snippet", "matches")) == [("drug_interactions", "eeee", "avoid eeee!", 2)]
    empty = labels.find_matches(labels.section_rows(chosen.limit(0), ["drug"]), vocabulary.limit(0), ["drug", "section", "place"])
    assert rows(empty) == []
