"""Queries on names: cleaning, validation, aliases, resolution. Parts stand for products, part names for canonical names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import clean, fold, input_problem, phrase, split_input, squeeze, tier
from ..operators import names as op
from .registry import Tables, query


def aliases(t: Tables):
    """Brand and part number for each part but those of size 7, which makes unmatched names."""
    return t.part.where("p_size <> 7").select(F.lower(F.concat("p_brand", F.lit("#"), "p_partkey")).alias("alias"), clean(F.col("p_name")).alias("canonical"))


ALIASES = "aliases AS (SELECT lower(p_brand || '#' || p_partkey) AS alias, lower(trim(p_name)) AS canonical FROM part WHERE p_size <> 7)"


@query("SELECT c_custkey, lower(trim(c_name)) AS cleaned, regexp_replace(lower(trim(c_name)) || '   x', ' {2,}', ' ', 'g') AS squeezed FROM customer")
def clean_names(t):
    return t.customer.select("c_custkey", clean(F.concat(F.lit(" \t"), "c_name", F.lit("\n "))).alias("cleaned"), squeeze(F.concat(clean(F.col("c_name")), F.lit("   x"))).alias("squeezed"))


@query("""
SELECT doc_id, line, length(head) AS n, CASE WHEN regexp_matches(head, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'control' WHEN bare = '' THEN 'empty' WHEN length(bare) > 150 THEN 'too_long'
  WHEN NOT regexp_matches(bare, '^[\\p{L}\\p{N} .,''()+/%#-]+$') THEN 'charset' END AS problem, n_parts
FROM (SELECT doc_id, line, head, regexp_replace(trim(head), ' {2,}', ' ', 'g') AS bare, CAST(len(list_filter(string_split(head, ','), lambda x: trim(x) <> '')) AS BIGINT) AS n_parts
  FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS head FROM documents))
""")
def input_validation(t):
    docs = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "head"))
    return docs.select("doc_id", (F.col("line") + 1).cast("bigint").alias("line"), F.char_length("head").cast("bigint").alias("n"), input_problem(F.col("head")).alias("problem"), F.size(split_input(F.col("head"))).cast("bigint").alias("n_parts"))


@query(f"""
WITH {ALIASES} SELECT l_orderkey, l_linenumber, coalesce(canonical, k) AS name
FROM (SELECT l_orderkey, l_linenumber, lower(p_brand || '#' || p_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) LEFT JOIN aliases ON k = alias
""")
def alias_left_join(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.concat("p_brand", F.lit("#"), "p_partkey").alias("raw"))
    return op.map_or_keep(lines, "raw", op.dimension(aliases(t)), "name").drop("raw")


@query("""
SELECT p_partkey, coalesce(i.c, n.c) AS canonical FROM part
LEFT JOIN (SELECT p_partkey AS k, lower(p_name) AS c FROM part WHERE p_size <= 16) i ON p_partkey = i.k
LEFT JOIN (SELECT lower(p_type) AS k, min(lower(p_brand)) AS c FROM part WHERE p_size > 25 GROUP BY 1) n ON lower(trim(p_type)) = n.k
""")
def priority_lookup(t):
    by_id = t.part.where("p_size <= 16").select(F.col("p_partkey").alias("key"), F.lower("p_name").alias("canonical"))
    by_name = t.part.where("p_size > 25").groupBy(F.lower("p_type").alias("key")).agg(F.min(F.lower("p_brand")).alias("canonical"))
    return op.priority_lookup(t.part, "p_partkey", "p_type", by_id, by_name, "canonical").select("p_partkey", "canonical")


@query(f"""
WITH {ALIASES} SELECT alias, canonical FROM aliases
UNION ALL SELECT canonical, canonical FROM (SELECT DISTINCT canonical FROM aliases) d WHERE NOT EXISTS (SELECT 1 FROM aliases a WHERE a.alias = d.canonical)
""")
def self_alias_anti(t):
    return op.with_self_aliases(aliases(t))


@query("""
WITH a AS (SELECT lower(p_name) AS alias, CASE WHEN p_size > 25 THEN lower(p_name) ELSE lower(p_brand) END AS canonical,
    row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part WHERE p_size <> 5),
n AS (SELECT DISTINCT 'part' AS "table", 'p_name' AS "column", lower(p_name) AS name FROM part)
SELECT "table", "column", name, canonical AS target FROM n LEFT JOIN (SELECT * FROM a WHERE r = 1) ON name = alias WHERE name IS DISTINCT FROM canonical
""")
def join_integrity(t):
    mapped = t.part.where("p_size <> 5").select("p_partkey", F.lower("p_name").alias("alias"), F.when(F.col("p_size") > 25, F.lower("p_name")).otherwise(F.lower("p_brand")).alias("canonical"))
    mapped = op.first_wins(mapped, ["alias"], "p_partkey").select("alias", "canonical")
    names = t.part.select(F.lit("part").alias("table"), F.lit("p_name").alias("column"), F.lower("p_name").alias("name"))
    return op.integrity_issues(names, mapped)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_returnflag = 'R')")
def semi_filter(t):
    wanted = t.lineitem.where("l_quantity > 45 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus <> 'P'").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("""
SELECT p_brand AS source, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS targets FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size < 10 AND r_regionkey < 2 GROUP BY 1
""")
def hop_closure(t):
    nation = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("target"))
    small = t.part.where("p_size < 10").select("p_partkey", F.col("p_brand").alias("source"))
    relations = t.lineitem.select("l_partkey", "l_suppkey").distinct().join(op.dimension(small), F.col("l_partkey") == F.col("p_partkey")).join(op.dimension(nation), F.col("l_suppkey") == F.col("s_suppkey")).select("source", "target")
    targets = t.nation.join(t.region.where("r_regionkey < 2"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("target"))
    return op.hop(relations, small.select("source"), targets).select("source", F.concat_ws(",", "targets").alias("targets"))


@query("""
WITH v AS (SELECT DISTINCT lower(p_type) AS ingredient, lower(p_type) AS canonical FROM part WHERE p_size > 16 UNION SELECT DISTINCT lower(p_brand), lower(p_brand) FROM part WHERE p_size = 11),
x AS (SELECT lower(p_brand) AS brand, p_size AS product, lower(p_type) AS ingredient FROM part WHERE p_size < 4 UNION SELECT lower(p_brand), p_size, lower(p_brand) || p_size FROM part WHERE p_size = 2),
p AS (SELECT brand, product, bool_and(canonical IS NOT NULL) AS whole, coalesce(string_agg(DISTINCT canonical, ' + ' ORDER BY canonical), '') AS t, count(DISTINCT canonical) AS n FROM x LEFT JOIN v USING (ingredient) GROUP BY ALL),
b AS (SELECT brand, count(DISTINCT t) FILTER (WHERE whole) AS tuples, min(t) FILTER (WHERE whole) AS i, max(n) FILTER (WHERE whole) AS n FROM p GROUP BY brand)
SELECT brand, CASE WHEN brand IN (SELECT canonical FROM v) THEN 'known' WHEN tuples = 0 THEN 'unmapped' WHEN tuples > 1 THEN 'ambiguous' WHEN n > 1 THEN 'combination' ELSE 'alias' END AS outcome,
  CASE WHEN tuples = 1 THEN i END AS ingredients FROM b
""")
def brand_classification(t):
    low = lambda c: F.lower(c)
    vocabulary = t.part.where("p_size > 16").select(low("p_type").alias("ingredient"), low("p_type").alias("canonical")).union(t.part.where("p_size = 11").select(low("p_brand"), low("p_brand"))).distinct()
    parts = t.part.where("p_size < 4").select(low("p_brand").alias("brand"), F.col("p_size").alias("product"), low("p_type").alias("ingredient"))
    extra = t.part.where("p_size = 2").select(low("p_brand"), F.col("p_size"), F.concat(low("p_brand"), F.col("p_size")))
    return op.classify_brands(parts.union(extra).distinct(), vocabulary)


@query("""
WITH base AS (SELECT n_nationkey AS k, n_name AS v FROM nation), c AS (SELECT n_nationkey AS k, 'new ' || n_name AS v, n_regionkey AS r FROM nation WHERE n_regionkey >= 3 UNION ALL SELECT 100 + n_nationkey, 'added', n_regionkey + 3 FROM nation),
ok AS (SELECT k, v FROM c WHERE r IN (SELECT r_regionkey FROM region))
SELECT CAST(k AS BIGINT) AS k, v FROM base WHERE k NOT IN (SELECT k FROM ok) UNION ALL SELECT CAST(k AS BIGINT), v FROM ok
""")
def override_upsert(t):
    base = t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("v"))
    changed = t.nation.where("n_regionkey >= 3").selectExpr("CAST(n_nationkey AS bigint) AS k", "concat('new ', n_name) AS v", "n_regionkey AS r_regionkey")
    added = t.nation.selectExpr("CAST(100 + n_nationkey AS bigint) AS k", "'added' AS v", "n_regionkey + 3 AS r_regionkey")
    return op.upsert(base, changed.union(added), "k", t.region.select("r_regionkey"), "r_regionkey")


@query(f"WITH {ALIASES} SELECT canonical, string_agg(alias, ',' ORDER BY alias) AS aliases, count(*) AS n FROM aliases GROUP BY canonical")
def reverse_aliases(t):
    return aliases(t).groupBy("canonical").agg(F.concat_ws(",", F.sort_array(F.collect_list("alias"))).alias("aliases"), F.count(F.lit(1)).alias("n"))


#: Queries made from names: as they are, a letter gone, two letters swapped by others, the first word, and a stranger.
ASKED = """
names AS (SELECT DISTINCT lower(p_name) AS canonical FROM part),
asked AS (SELECT canonical AS query FROM names UNION SELECT substr(canonical, 1, 3) || substr(canonical, 5) FROM names UNION SELECT substr(canonical, 1, 2) || 'qx' || substr(canonical, 5) FROM names
  UNION SELECT string_split(canonical, ' ')[1] FROM names UNION SELECT 'zzzzzz' UNION SELECT 'combo ' || substr(canonical, 1, 2) FROM names)
"""
LCS = """
score AS (SELECT query, canonical, 200.0 * lcs / (length(query) + length(canonical)) AS score FROM (
  SELECT query, canonical, list_reduce(list_concat([list_transform(range(0, length(canonical) + 1), lambda x: 0)], list_transform(string_split(query, ''), lambda ch: [ascii(ch)])),
    lambda acc, ch: list_reduce(list_concat([[0]], list_transform(range(1, length(canonical) + 1), lambda i: [i])),
      lambda row, i: list_concat(row, [CASE WHEN ascii(canonical[i[1]]) = ch[1] THEN acc[i[1]] + 1 ELSE greatest(acc[i[1] + 1], row[i[1]]) END])))[-1] AS lcs
  FROM q, names WHERE 2.0 * least(length(query), length(canonical)) >= 0.75 * (length(query) + length(canonical))) WHERE 200.0 * lcs / (length(query) + length(canonical)) >= 75),
ranked AS (SELECT query, canonical, score, row_number() OVER w AS r, lead(score) OVER w AS rival, max(score) OVER (PARTITION BY query) AS best FROM score WINDOW w AS (PARTITION BY query ORDER BY score DESC, canonical)),
f AS (SELECT query, max(best) AS best, coalesce(bool_or(r = 1 AND rival >= 75 AND best - rival < 10), false) AS near, max(canonical) FILTER (WHERE r = 1) AS top,
  string_agg(canonical, ' / ' ORDER BY r) FILTER (WHERE r <= 4 AND best - score < 10) AS closest FROM ranked GROUP BY query)
"""


def asked(t: Tables):
    names = t.part.select(F.lower("p_name").alias("n")).distinct()
    forms = ["n", "concat(substr(n, 1, 3), substr(n, 5))", "concat(substr(n, 1, 2), 'qx', substr(n, 5))", "split(n, ' ')[0]", "'zzzzzz'", "concat('combo ', substr(n, 1, 2))"]
    return names.select(F.explode(F.expr(f"array({', '.join(forms)})")).alias("query")).distinct()


@query(f"""
WITH {ASKED}, q AS (SELECT query FROM asked), {LCS}
SELECT query, CASE WHEN best >= 85 AND NOT near THEN 'fuzzy' WHEN near THEN 'ambiguous' ELSE 'unresolved' END AS method, CASE WHEN best >= 85 AND NOT near THEN top END AS canonical,
  round(best, 6) AS best, CASE WHEN near THEN closest END AS closest FROM f
""")
def fuzzy_resolve(t):
    names = t.part.select(F.lower("p_name").alias("name")).distinct()
    near = op.fuzzy_candidates(asked(t), names).withColumn("canonical", F.col("name"))
    return op.fuzzy_decision(near).withColumn("best", F.round("best", 6))


@query(f"""
WITH {ASKED}, combos AS (SELECT DISTINCT 'combo ' || substr(canonical, 1, 2) AS name FROM names),
fam AS (SELECT query FROM asked, names WHERE length(query) >= 4 AND NOT contains(query, ' ') AND starts_with(canonical, query) AND NOT regexp_matches(substr(canonical, length(query) + 1, 1), '[a-zA-Z0-9]') GROUP BY query HAVING count(*) >= 2),
q AS (SELECT query FROM asked WHERE query NOT IN (SELECT canonical FROM names) AND query NOT IN (SELECT name FROM combos) AND query NOT IN (SELECT query FROM fam)), {LCS}
SELECT a.query, CASE WHEN n.canonical IS NOT NULL THEN 'exact' WHEN c.name IS NOT NULL THEN 'combination' WHEN fam.query IS NOT NULL THEN 'family'
  WHEN best >= 85 AND NOT near THEN 'fuzzy' WHEN near THEN 'ambiguous' ELSE 'unresolved' END AS method, CASE WHEN n.canonical IS NOT NULL THEN n.canonical WHEN best >= 85 AND NOT near THEN top END AS canonical
FROM asked a LEFT JOIN names n ON a.query = n.canonical LEFT JOIN combos c ON a.query = c.name LEFT JOIN fam ON a.query = fam.query LEFT JOIN f ON a.query = f.query
""")
def exact_cascade(t):
    names = t.part.select(F.lower("p_name").alias("alias"), F.lower("p_name").alias("canonical")).distinct()
    combos = names.select(F.concat(F.lit("combo "), F.substring("canonical", 1, 2)).alias("name")).distinct()
    return op.resolve(asked(t), names, combos, names)


@query("""
WITH names AS (SELECT DISTINCT lower(p_name) AS name FROM part), q AS (SELECT DISTINCT string_split(name, ' ')[1] AS query FROM names)
SELECT query, count(*) AS n, string_agg(name, ' / ' ORDER BY length(name), name) AS names FROM q, names
WHERE length(query) >= 4 AND starts_with(name, query) AND NOT regexp_matches(substr(name, length(query) + 1, 1), '[a-zA-Z0-9]') GROUP BY query HAVING count(*) >= 2
""")
def family_prefix(t):
    names = t.part.select(F.lower("p_name").alias("name")).distinct()
    found = op.family(names.select(F.split("name", " ")[0].alias("query")).distinct(), names)
    ranked = F.transform(F.sort_array(F.collect_list(F.struct(F.char_length("name").alias("k"), "name"))), lambda x: x["name"])
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" / ", ranked).alias("names")).where("n >= 2")


@query("""
WITH r AS (SELECT n_nationkey, n_name, n_regionkey, 'NAT-' || substr(sha1(chr(31) || n_name || chr(31) || n_nationkey || chr(31) || n_regionkey), 1, 10) AS i FROM nation),
d AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE n_regionkey = 1)
SELECT n_nationkey, n_name, n_regionkey, CASE WHEN k = 1 THEN i ELSE i || '-' || k END AS record_id FROM (SELECT *, row_number() OVER (PARTITION BY i) AS k FROM d)
""")
def content_ids(t):
    return ids.content_ids(t.nation.select("n_nationkey", "n_name", "n_regionkey").union(t.nation.where("n_regionkey = 1").select("n_nationkey", "n_name", "n_regionkey")), "NAT")


@query("SELECT p_partkey, lower(trim(p_brand)) || ':' || p_partkey AS citation, upper(trim(p_brand)) IN ('BRAND#11', 'BRAND#22', 'BRAND#33') AS statistical FROM part")
def citation_keys(t):
    statistical = F.upper(F.trim("p_brand")).isin("BRAND#11", "BRAND#22", "BRAND#33")
    return t.part.select("p_partkey", ids.citation_key(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("citation"), statistical.alias("statistical"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL THEN 'Unknown' WHEN s >= 10 THEN 'Major' WHEN s >= 4 THEN 'Moderate' ELSE 'Minor' END AS tier,
  CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag ELSE 'Unknown' END AS grade FROM (SELECT *, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity / 3.0 END AS s FROM lineitem)
""")
def score_tiers(t):
    score = F.when(F.col("l_quantity") <= 45, F.col("l_quantity") / 3.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", tier(score).alias("tier"), F.when(F.col("l_returnflag").isin("R", "A"), F.col("l_returnflag")).otherwise("Unknown").alias("grade"))


@query("""
SELECT doc_id, length(t) AS n, md5(t) AS folded FROM (SELECT doc_id, regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(lower(text), 'haem', 'hem'), 'aemia', 'emia'), 'paediatr', 'pediatr'), 'normalised', 'normalized'), '–', '-'), '—', '-'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)
""")
def norm_text(t):
    folded = fold(F.col("text"))
    return t.documents.select("doc_id", F.char_length(folded).cast("bigint").alias("n"), F.md5(folded).alias("folded"))


@query("""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)
SELECT doc_id, regexp_matches(t, '(^|[^a-z0-9])mit license([^a-z0-9]|$)') AS licence, regexp_matches(t, '(^|[^a-z0-9])that the([^a-z0-9]|$)') AS common, regexp_matches(t, '(^|[^a-z0-9])idiot([^a-z0-9]|$)') AS insult FROM d
""")
def phrase_hits(t):
    folded = t.documents.select("doc_id", fold(F.col("text")).alias("t"))
    return folded.select("doc_id", phrase(F.col("t"), "mit license").alias("licence"), phrase(F.col("t"), "that the").alias("common"), phrase(F.col("t"), "idiot").alias("insult"))
