"""Queries on label evidence, alias bridges, runs and audits.

Documents stand for product labels: each is the label of one part, and names two others, in wording that follows from its
key, in the middle of its own text. Parts have two aliases, the longer of which holds the shorter one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.text import age_days, clean, override, rate, request_url
from ..operators import labels as op
from ..operators import names, stats
from .registry import Tables, query

#: What a label says around a name; some of it belongs to another clause.
SAYS = (
    ("Avoid ", " in all patients"), ("Exposure to ", " was similar in both groups"), ("Monitor closely when ", " is given"), ("Use with ", " is contraindicated"),
    ("Reduce the dose by half; ", " was seen once. Avoid light"), ("Intervention: avoid use. Examples: ", " and others"), ("Adjust the dosage (7.2) ", " [see Warnings, avoid] monitor"),
)
PARTS = 200


def labelled(t: Tables):
    """doc_id, drug, the two names it mentions (one, two), and its sections as a map."""
    d = F.col("doc_id")
    name = {n: t.part.select(F.col("p_partkey").alias(f"k_{n}"), F.col("p_name").alias(n), F.lower("p_brand").alias(f"brand_{n}")) for n in ("drug", "one", "two")}
    keys = {"drug": F.pmod(d, F.lit(PARTS)), "one": F.pmod(d * 7 + 3, F.lit(PARTS)), "two": F.pmod(d * 11 + 5, F.lit(PARTS))}
    rows = t.documents.select("doc_id", "text")
    for n, key in keys.items():
        rows = rows.join(F.broadcast(name[n].where(F.col(f"k_{n}") < PARTS)), key == F.col(f"k_{n}"))
    form = lambda n, k: F.when(k % 3 == 0, F.initcap(n)).when(k % 3 == 1, F.concat(n, F.lit(" "), f"brand_{n}")).otherwise(F.concat(F.lit("non-"), n))
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in SAYS])
    told = lambda n, k: F.concat(F.lit(" "), F.get(around, F.pmod(k, F.lit(len(SAYS))).cast("int"))["x"], form(n, k), F.get(around, F.pmod(k, F.lit(len(SAYS))).cast("int"))["y"], F.lit(". "))
    half = (F.char_length("text") / 2).cast("int")
    section = lambda k: F.get(F.array(*map(F.lit, lb.SECTIONS)), F.pmod(k, F.lit(len(lb.SECTIONS))).cast("int"))
    first = F.concat(F.substring("text", F.lit(1), half), told("one", d), F.expr("substring(text, int(char_length(text) / 2) + 1)"))
    second = F.concat(F.substring("text", F.lit(1), half), told("one", d + 1), told("two", F.floor(d / 3)))
    return rows.select("doc_id", "drug", "one", "two", F.create_map(section(d), first, section(d + 2), second).alias("sections"))


def aliases(t: Tables):
    both = F.array(F.col("p_name"), F.concat("p_name", F.lit(" "), F.lower("p_brand")))
    return t.part.select(F.explode(both).alias("alias"), F.col("p_name").alias("name"))


def matched(t: Tables):
    sections = op.section_rows(labelled(t), ["doc_id", "drug"])
    return op.find_matches(sections, aliases(t), ["doc_id", "drug", "section", "place"])


# The oracle's own patterns: wording of each class, and what ends a clause.
AVOID = r"\b(avoid\w*|not recommended|should not be (used|taken|given|administered|co-?administered|combined)|do not (use|take|administer|co-?administer|combine|prescribe)|must not)\b"
MONITOR = (
    r"\b((monitor|adjust|limit|caution|consider|titrat|separate|interrupt|discontinu|suspend)\w*|reduc\w* (the )?(dose|dosage)|(decreas|reduc)\w* by \d|dose (reduction|adjustment)|lower (the )?(dose|dosage)|do not exceed\b"
    r"|closely\b|ask a doctor\b|ask a pharmacist\b|reserve\b|hours (before|after)\b)"
)
END = r"(?:[.;•]\s|\(\s*\d+(?:\.\d+)*\s*\)|\[see [^\]]*\])"
KEYS = ("boxed_warning", "contraindications", "warnings_and_cautions", "warnings", "precautions", "drug_interactions")
CLASS_LIST = "['contraindicated', 'avoid_or_not_recommended', 'monitor_or_adjust', 'mentioned_without_guidance', 'not_mentioned']"
SIDES = ", ".join(f"{{'x': '{x}', 'y': '{y}'}}" for x, y in SAYS)
FORM = "CASE WHEN {k} % 3 = 0 THEN list_aggregate(list_transform(string_split({n}, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') WHEN {k} % 3 = 1 THEN {n} || ' ' || brand_{n} ELSE 'non-' || {n} END"
TOLD = f"' ' || s[{{k}} % {len(SAYS)} + 1].x || {FORM} || s[{{k}} % {len(SAYS)} + 1].y || '. '"
LABELLED = f"""s AS (SELECT [{SIDES}] AS s),
labelled AS (SELECT doc_id, d.p_name AS drug, o.p_name AS one, w.p_name AS two, lower(o.p_brand) AS brand_one, lower(w.p_brand) AS brand_two, text, length(text) // 2 AS half
  FROM documents JOIN part d ON d.p_partkey = doc_id % {PARTS} JOIN part o ON o.p_partkey = (doc_id * 7 + 3) % {PARTS} JOIN part w ON w.p_partkey = (doc_id * 11 + 5) % {PARTS}),
sections AS (SELECT doc_id, drug, one, two, CAST(doc_id % 6 AS INT) AS place, text[:half] || {TOLD.format(k='doc_id', n='one')} || text[half + 1:] AS text FROM labelled, s
  UNION ALL SELECT doc_id, drug, one, two, CAST((doc_id + 2) % 6 AS INT), text[:half] || {TOLD.format(k='(doc_id + 1)', n='one')} || {TOLD.format(k='(doc_id // 3)', n='two')} FROM labelled, s)"""
MATCHED = f"""{LABELLED},
names AS (SELECT DISTINCT p_name AS name FROM part), al AS (SELECT DISTINCT p_name AS name, unnest([p_name, p_name || ' ' || lower(p_brand)]) AS alias FROM part),
cand AS (SELECT doc_id, drug, place, text, lower(text) AS low, name, string_split(lower(text), name) AS pieces FROM sections JOIN names ON contains(lower(text), name)),
pos AS (SELECT * EXCLUDE (pieces, i), CAST(list_sum(list_transform(pieces[:i], lambda p: length(p))) + (i - 1) * length(name) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM cand)),
hit AS (SELECT doc_id, drug, place, text, name, start, max_by(alias, length(alias)) AS alias FROM pos JOIN al USING (name)
  WHERE low[start + 1:start + length(alias)] = alias AND NOT regexp_matches(low[start:start], '[a-z0-9-]') AND NOT regexp_matches(low[start + length(alias) + 1:start + length(alias) + 1], '[a-z0-9-]') GROUP BY ALL),
cut AS (SELECT *, regexp_replace(text[greatest(start - 250, 0) + 1:start], '(?is)^.*{END}', '') || text[start + 1:start + length(alias)] || regexp_replace(text[start + length(alias) + 1:start + length(alias) + 250], '(?is){END}.*$', '') AS said,
  text[greatest(start - 3000, 0) + 1:start] AS back FROM hit),
tab AS (SELECT *, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS bare, regexp_extract(lower(back), '(?s)^(.*)examples', 1) AS head, regexp_extract(lower(back), '(?s)^.*examples(.*)$', 1) AS since FROM cut),
ctx AS (SELECT *, CASE WHEN contains(lower(back), 'examples') AND NOT contains(since, 'clinical impact') AND contains(head, 'intervention')
  THEN regexp_replace(back[length(regexp_extract(head, '(?s)^(.*)intervention', 1)) + 1:length(head)], '^\\s+|\\s+$', '', 'g') || ' … ' || bare ELSE bare END AS c FROM tab),
cls AS (SELECT *, CASE WHEN place = 1 OR contains(lower(c), 'contraindicat') THEN 1 WHEN regexp_matches(lower(c), '{AVOID}') THEN 2 WHEN regexp_matches(lower(c), '{MONITOR}') THEN 3 ELSE 4 END AS k FROM ctx),
best AS (SELECT doc_id, drug, place, name, alias, c, k, instr(lower(c), alias) - 1 AS i, length(c) AS n FROM cls QUALIFY row_number() OVER (PARTITION BY doc_id, place, name ORDER BY k, start) = 1),
matches AS (SELECT doc_id, drug, place, {list(KEYS)}[place + 1] AS section, name, alias, {CLASS_LIST}[k] AS class, k,
  CASE WHEN i > 120 THEN '…' ELSE '' END || regexp_replace(c[greatest(0, i - 120) + 1:least(n, i + length(alias) + 120)], '^\\s+|\\s+$', '', 'g') || CASE WHEN i + length(alias) + 120 < n THEN '…' ELSE '' END AS snippet FROM best)"""


@query(f"WITH {MATCHED} SELECT doc_id, section, name, alias, class, snippet FROM matches")
def label_classes(t):
    """What each section of each label says about each name in it: alias, class and snippet."""
    return matched(t).select("doc_id", "section", "name", "alias", "class", "snippet")


@query(f"WITH {MATCHED} SELECT doc_id, {CLASS_LIST}[min(k)] AS class FROM matches GROUP BY doc_id")
def strongest_class(t):
    return op.strongest(matched(t), ["doc_id"], "class")


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS nda FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1
""")
def label_choice(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "NDA1").otherwise("ANDA1").alias("application"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("effective"))
    return op.choose_label(rows, ["o_custkey"], "application", "effective", "o_orderkey")


PAIRED = f"""pairs AS (SELECT least(drug, x) AS a, greatest(drug, x) AS b, min(CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE 'interaction' END) AS expected FROM (SELECT doc_id, drug, unnest([one, two]) AS x FROM labelled) WHERE drug <> x GROUP BY 1, 2),
chosen AS (SELECT drug, doc_id FROM labelled WHERE doc_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY drug ORDER BY doc_id % 3 = 0 DESC, lpad(CAST(doc_id * 7919 % 100000000 AS VARCHAR), 8, '0') DESC, doc_id) = 1),
own AS (SELECT m.* FROM matches m JOIN chosen USING (doc_id)),
dirs AS (SELECT a, b, 0 AS side, a AS drug, b AS name FROM pairs UNION ALL SELECT a, b, 1, b, a FROM pairs),
top AS (SELECT a, b, class, k, drug AS said_by, section, alias, snippet, count(*) OVER (PARTITION BY a, b) AS matches FROM dirs JOIN own USING (drug, name) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k, side, place) = 1),
ev AS (SELECT pairs.*, coalesce(class, 'not_mentioned') AS class, coalesce(k, 5) AS k, said_by, section, alias, snippet, coalesce(matches, 0) AS matches, a IN (SELECT drug FROM chosen) AS label_a, b IN (SELECT drug FROM chosen) AS label_b FROM pairs LEFT JOIN top USING (a, b)),
written AS (SELECT *, ['contraindicated', 'avoid / not recommended', 'monitor / adjust', 'mentioned without guidance', 'not mentioned'][k] AS w, 'no single-ingredient label found for ' || concat_ws(', ', CASE WHEN NOT label_a THEN a END, CASE WHEN NOT label_b THEN b END) AS lacking, label_a AND label_b AS found_both FROM ev)"""


def decided(t: Tables):
    """Pairs that a label mentions, with the evidence of the labels chosen for both names. Every fourth document stands for a
    control, and every ninth has two ingredients."""
    d = F.col("doc_id")
    all_of = labelled(t)
    x = F.explode(F.array("one", "two")).alias("x")
    pairs = all_of.select("doc_id", "drug", x).where("drug <> x").groupBy(F.least("drug", "x").alias("a"), F.greatest("drug", "x").alias("b")).agg(F.min(F.when(d % 4 == 0, "none").otherwise("interaction")).alias("expected"))
    found = all_of.select("drug", d.alias("place"), F.concat(F.lit("L"), d).alias("set_id"), F.lit("1").alias("version"), F.lpad((d * 7919 % 100_000_000).cast("string"), 8, "0").alias("effective"), F.when(d % 3 == 0, "NDA1").otherwise("ANDA1").alias("application"), F.lit("").alias("brand"), F.when(d % 9 == 0, F.array(F.upper("drug"), F.lit("X"))).otherwise(F.array(F.upper("drug"))).alias("generics"), "sections")
    labels = op.choose_labels(found, aliases(t))
    matches = op.find_matches(op.section_rows(labels, ["drug", "set_id"]), aliases(t), ["drug", "set_id", "section", "place"])
    told = op.pair_evidence(pairs, labels, matches)
    return told.withColumn("decided", op.decide(F.col("expected"), F.col("class"), F.col("a"), F.col("b"), F.col("label_a"), F.col("label_b")))


@query(f"""
WITH {MATCHED}, {PAIRED}
SELECT a, b, expected, class, said_by, section, alias, snippet, CAST(matches AS BIGINT) AS matches, label_a, label_b,
  CASE WHEN expected = 'interaction' THEN CASE WHEN k <= 3 THEN 'interaction' ELSE 'unclear' END WHEN found_both AND k = 5 THEN 'none_weak' ELSE 'unclear' END AS reference,
  CASE WHEN expected = 'interaction' THEN CASE WHEN k <= 3 THEN 'label: ' || w WHEN k = 4 THEN 'named in a label, but without guidance the heuristic recognises' WHEN NOT found_both THEN lacking ELSE 'neither label names the other drug (it may be covered only by a class)' END
    WHEN NOT found_both THEN lacking WHEN k = 5 THEN 'not mentioned in either label (weak evidence of no interaction)' ELSE 'negative control, but a label says: ' || w END AS reason FROM written
""")
def label_evidence(t):
    """What the labels of both names settle about a pair, with the wording it rests on."""
    return decided(t).select("a", "b", "expected", "class", F.col("best.drug").alias("said_by"), "best.section", "best.alias", "best.snippet", "matches", "label_a", "label_b", "decided.reference", "decided.reason")


GRADED = "CASE length(a || b) % 4 WHEN 0 THEN 'Major' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Minor' END"


@query(f"""
WITH {MATCHED}, {PAIRED}, g AS (SELECT w AS class, {GRADED} AS grade, CASE WHEN k <= 2 THEN 'Major' WHEN k = 3 THEN 'Moderate' END AS stands FROM written),
a AS (SELECT round(count(*) FILTER (stands = grade) / count(*)::DOUBLE, 4) AS agreement, count(*) FILTER (list_position(['Minor', 'Moderate', 'Major'], grade) < list_position(['Minor', 'Moderate', 'Major'], stands)) AS lower_than_label FROM g WHERE stands IS NOT NULL AND grade IS NOT NULL)
SELECT class, coalesce(grade, 'no graded record') AS grade, count(*) AS n, any_value(agreement) AS agreement, any_value(lower_than_label) AS lower_than_label FROM g, a GROUP BY ALL
""")
def label_agreement(t):
    """Classes of the pairs against grades, which follow from the lengths of the names."""
    k = F.char_length(F.concat("a", "b")) % 4
    return op.class_grid(decided(t).withColumn("grade", F.when(k == 0, "Major").when(k == 1, "Moderate").when(k == 2, "Minor")), "class", "grade")


@query("""
WITH e AS (SELECT p_partkey AS key, 'U' || (p_partkey % 50) AS unii, unnest([lower(p_name), lower(p_brand), lower(p_type)]) AS alias FROM part),
l AS (SELECT 'U' || s_suppkey AS unii, lower(s_name) AS canonical FROM supplier WHERE s_suppkey % 2 = 0),
n AS (SELECT DISTINCT key, canonical, alias FROM e JOIN l USING (unii)),
k AS (SELECT lower(p_name) AS alias, min(lower(s_name)) AS had FROM part JOIN supplier ON s_suppkey = p_partkey % 50 WHERE p_size < 20 GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY key, canonical) AS r, first_value(canonical) OVER (PARTITION BY alias ORDER BY key, canonical) AS winner FROM n)
SELECT outcome, count(*) AS n, count(DISTINCT alias) AS aliases FROM (
  SELECT alias, CASE WHEN had IS NOT NULL THEN CASE WHEN had = canonical THEN 'known' ELSE 'conflict' END WHEN r = 1 THEN 'added' WHEN winner = canonical THEN 'known' ELSE 'conflict' END AS outcome FROM r LEFT JOIN k USING (alias)
  UNION ALL SELECT CAST(key AS VARCHAR), 'unlinked' FROM e LEFT JOIN l USING (unii) WHERE canonical IS NULL GROUP BY key) GROUP BY outcome
""")
def unii_bridge(t):
    entries = t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("U"), (F.col("p_partkey") % 50).cast("string")).alias("unii"), F.array(F.lower("p_name"), F.lower("p_brand"), F.lower("p_type")).alias("names"))
    links = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("unii"), F.lower("s_name").alias("canonical"))
    known = t.part.where("p_size < 20").join(t.supplier, F.col("s_suppkey") == F.col("p_partkey") % 50).groupBy(clean(F.col("p_name")).alias("alias")).agg(F.min(F.lower("s_name")).alias("canonical"))
    return names.unii_bridge(entries, links, known).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("alias").alias("aliases"))


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def commonest_grade(t):
    return stats.mode(t.orders.select("o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority")


@query("""
WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'supported' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'partial' ELSE 'maybe' END AS human FROM orders),
k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'supported' ELSE 'unsupported' END AS judge FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT *, CASE WHEN human = '' THEN 'blank' WHEN human = 'maybe' OR judge IS NULL THEN 'invalid' ELSE 'scored' END AS kind FROM a LEFT JOIN k USING (id))
SELECT kind, count(*) AS n, CASE WHEN kind = 'scored' THEN round(count(*) FILTER (human = judge) / count(*)::DOUBLE, 4) END AS agreement FROM j GROUP BY kind
""")
def audit_unblinding(t):
    k = F.col("o_orderkey")
    human = F.when(k % 5 == 0, " ").when(k % 5 == 1, "Supported").when(k % 5 == 2, "unsupported ").when(k % 5 == 3, "partial").otherwise("maybe")
    key = t.orders.where(k % 7 != 0).select(k.alias("id"), F.when(k % 2 == 0, "supported").otherwise("unsupported").alias("judge"))
    rows = stats.unblind(t.orders.select(k.alias("id"), human.alias("human")), key, ["supported", "partial", "unsupported"])
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.when(F.col("kind") == "scored", rate(F.count_if(F.col("human") == F.col("judge")), F.count(F.lit(1)))).alias("agreement"))


@query("""
WITH r AS (SELECT o_orderpriority, o_orderkey % 4 AS drafts, o_orderkey % 3 > 0 AS ok, CASE WHEN o_orderkey % 5 = 0 THEN 'fallback' WHEN o_orderkey % 5 < 3 THEN 'retry' ELSE 'draft' END AS source FROM orders)
SELECT o_orderpriority, count(*) AS cases, count(*) FILTER (drafts > 0) AS eligible, round(count(*) FILTER (drafts > 0 AND ok) / count(*) FILTER (drafts > 0)::DOUBLE, 4) AS first_pass_rate,
  round(count(*) FILTER (drafts > 0 AND NOT ok AND source = 'retry') / count(*) FILTER (drafts > 0 AND NOT ok)::DOUBLE, 4) AS recovery_rate, round(count(*) FILTER (drafts > 0 AND source = 'fallback') / count(*) FILTER (drafts > 0)::DOUBLE, 4) AS fallback_rate FROM r GROUP BY 1
""")
def run_summary(t):
    k = F.col("o_orderkey")
    runs = t.orders.select("o_orderpriority", (k % 4).alias("drafts"), (k % 3 > 0).alias("first_passed"), F.when(k % 5 == 0, "fallback").when(k % 5 < 3, "retry").otherwise("draft").alias("source"))
    return stats.run_summary(runs, ["o_orderpriority"])


@query("SELECT p_partkey, 'https://example.org/counts?search=' || replace(url_encode(p_name || ' \"x\"'), '%20', '+') || CASE WHEN p_size > 10 THEN '&limit=' || p_size ELSE '' END AS url FROM part")
def request_urls(t):
    return t.part.select("p_partkey", request_url("https://example.org/counts", {"search": F.concat("p_name", F.lit(' "x"')), "limit": F.when(F.col("p_size") > 10, F.col("p_size"))}).alias("url"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 20 THEN 'over' ELSE 'base' END AS brand, p_type AS kind, CASE WHEN p_size > 20 THEN 2 ELSE 1 END::BIGINT AS n_later,
  CASE WHEN p_size % 2 = 0 THEN CAST(DATE '2024-03-01' - (DATE '2024-01-01' + CAST(p_size AS INT)) AS BIGINT) ELSE -1 END AS age FROM part
""")
def profile_overrides(t):
    base = F.create_map(F.lit("brand"), F.lit("base"), F.lit("kind"), F.col("p_type"))
    over = F.when(F.col("p_size") > 20, F.create_map(F.lit("brand"), F.lit("over"), F.lit("new"), F.lit("x")))
    rows = t.part.select("p_partkey", "p_size", override(base, over).alias("m"))
    stamp = F.when(F.col("p_size") % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string")).otherwise("unknown")
    return rows.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["kind"].alias("kind"), (F.size("m") - 1).cast("bigint").alias("n_later"), F.coalesce(age_days(stamp, F.lit("2024-03-01").cast("date")), F.lit(-1)).cast("bigint").alias("age"))
