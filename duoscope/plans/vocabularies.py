"""Queries on vocabularies made of several. Part names stand for ingredients, brand and number for their aliases, orders for products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean
from ..sources import readers, vocabulary
from ..sources.scratch import kept
from .registry import Tables, query

WORDS = """
words AS (SELECT lower(p_brand || '#' || p_partkey) AS n, lower(trim(p_name)) AS c FROM part WHERE p_size <> 7 UNION SELECT lower(trim(p_name)), lower(trim(p_name)) FROM part WHERE p_size <> 7),
lines AS (SELECT l_orderkey AS k, lower(trim(p_name)) AS c, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE p_brand || '#' || p_partkey END AS part FROM lineitem JOIN part ON l_partkey = p_partkey),
products AS (SELECT lower(trim(CASE WHEN k % 5 = 0 THEN min(c) ELSE 'M' || k END)) AS name, string_agg(part, ';' ORDER BY part) AS listed FROM lines WHERE k % 2 = 0 GROUP BY k UNION SELECT lower('M' || k), part FROM lines WHERE k % 2 = 1),
combos AS (SELECT lower('M' || k) AS n, CASE WHEN k % 12 = 2 THEN 'other + thing' ELSE string_agg(DISTINCT c, ' + ' ORDER BY c) END AS ingredients FROM lines WHERE k % 6 = 2 AND k % 5 <> 0 GROUP BY k),
each AS (SELECT DISTINCT name, listed, trim(unnest(string_split(lower(listed), ';'))) AS part FROM products),
product AS (SELECT name, listed, bool_and(c IS NOT NULL) AS whole, list_sort(list(DISTINCT c) FILTER (WHERE c IS NOT NULL)) AS s FROM each LEFT JOIN words ON part = n GROUP BY ALL),
brand AS (SELECT name, coalesce(list_sort(list(DISTINCT s) FILTER (WHERE whole)), []) AS sets, count(*) FILTER (WHERE NOT whole) AS unmapped FROM product GROUP BY name),
met AS (SELECT name, sets, unmapped, w.c AS one, x.ingredients AS several, array_to_string(sets[1], ' + ') AS said FROM brand LEFT JOIN words w ON name = w.n LEFT JOIN combos x ON name = x.n),
told AS (SELECT name, sets, unmapped, one, several, said, CASE WHEN len(sets) = 0 THEN 'unmapped' WHEN unmapped > 0 OR len(sets) > 1 THEN 'ambiguous'
  WHEN one IS NOT NULL OR several IS NOT NULL THEN CASE WHEN (len(sets[1]) = 1 AND one = said) IS TRUE OR (several = said) IS TRUE THEN 'known' ELSE 'collision' END WHEN len(sets[1]) = 1 THEN 'alias' ELSE 'combination' END AS outcome FROM met)
"""


def words(t: Tables):
    """Part names, and brand and number as their aliases; parts of size 7 are unknown."""
    known = t.part.where("p_size <> 7")
    name = clean(F.col("p_name")).alias("generic_name")
    ident = F.lit("IN").alias("kind")
    return vocabulary.whole(known.select(F.lower(F.concat("p_brand", F.lit("#"), "p_partkey")).alias("name_lower"), name, ident).union(known.select(clean(F.col("p_name")), name, ident).distinct()))


def order_lines(t: Tables):
    part = t.part.select("p_partkey", clean(F.col("p_name")).alias("c"), "p_name", F.concat("p_brand", F.lit("#"), "p_partkey").alias("code"))
    return t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("k", "c", F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.col("code")).alias("part"))


def outcomes(t: Tables):
    """Brands out of orders: one product of all lines, or a product for each line; some go under the name of an ingredient."""
    lines, k = order_lines(t), F.col("k")
    code = F.concat(F.lit("M"), k)
    whole = lines.where(k % 2 == 0).groupBy("k").agg(F.when(k % 5 == 0, F.min("c")).otherwise(code).alias("drug_name"), F.concat_ws(";", F.collect_list("part")).alias("active_ingredient")).drop("k")
    combos = lines.where((k % 6 == 2) & (k % 5 != 0)).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("c")), " + ").alias("i"))
    combos = combos.select(F.lower(code).alias("name_lower"), F.when(k % 12 == 2, "other + thing").otherwise(F.col("i")).alias("ingredients"))
    return vocabulary.brand_outcomes(whole.union(lines.where(k % 2 == 1).select(code, "part")), words(t), combos), combos


@query(f"WITH {WORDS} SELECT name, outcome, CAST(unmapped AS BIGINT) AS unmapped, array_to_string(list_transform(sets, lambda s: array_to_string(s, ' + ')), ' | ') AS offered FROM told")
def brand_outcomes(t):
    found, _ = outcomes(t)
    return found.select("name", "outcome", "unmapped", F.array_join(F.transform("sets", lambda s: F.array_join(s, " + ")), " | ").alias("offered"))


@query(f"""
WITH {WORDS} SELECT 'alias' AS "table", name, said AS value, '' AS vocabulary FROM told WHERE outcome = 'alias' UNION ALL SELECT 'combination', name, said, '' FROM told WHERE outcome = 'combination'
UNION ALL SELECT outcome, name, array_to_string(list_concat(list_transform(sets, lambda s: array_to_string(s, ' + ')), CASE WHEN unmapped > 0 THEN ['(unmapped)'] ELSE [] END), ' | '),
  coalesce(one, CASE WHEN outcome = 'collision' THEN 'combination: ' || several ELSE several END, '') FROM told WHERE outcome IN ('ambiguous', 'collision')
""")
def brand_merge(t):
    """What the brands add to the vocabulary, and what is left to a person."""
    found, combos = outcomes(t)
    aliases = words(t)
    merged = vocabulary.merge_brands(aliases, combos, kept(found, "brands"))
    new = merged.aliases.where(F.col("kind") == vocabulary.BRAND).select(F.lit("alias").alias("table"), F.col("name_lower").alias("name"), F.col("generic_name").alias("value"), F.lit("").alias("vocabulary"))
    more = merged.combinations.join(combos, ["name_lower", "ingredients"], "left_anti").select(F.lit("combination"), "name_lower", "ingredients", F.lit(""))
    return new.union(more).union(merged.review.select("issue", "name", "offered", "vocabulary"))


@query("""
WITH p AS (SELECT p_partkey, lower(trim(p_name)) AS c, lower(p_brand || '#' || p_partkey) AS code, p_size, min(CASE WHEN p_size <> 7 THEN lower(trim(p_name)) END) OVER (PARTITION BY p_brand) AS least FROM part),
v AS (SELECT code AS n, c, CASE WHEN p_size < 20 THEN 'brand' ELSE 'IN' END AS kind FROM p WHERE p_size <> 7 UNION SELECT c, c, 'IN' FROM p WHERE p_size <> 7),
r AS (SELECT code AS n, CASE WHEN p_partkey % 40 = 0 THEN 'no such thing' ELSE least END AS target FROM p WHERE p_partkey % 20 = 0),
ok AS (SELECT n, target FROM r WHERE target IN (SELECT n FROM v WHERE n = c AND kind <> 'brand'))
SELECT n AS name, c AS canonical, kind FROM v WHERE kind <> 'brand' AND n NOT IN (SELECT n FROM ok) UNION ALL SELECT n, target, 'reviewed' FROM ok UNION ALL SELECT n, NULL, 'missing' FROM r WHERE n NOT IN (SELECT n FROM ok)
""")
def source_vocabulary(t):
    """Names by which source tables are read: aliases of parts under size 20 are brands, of which only reviewed ones count."""
    known = t.part.where("p_size <> 7")
    name, code = clean(F.col("p_name")), F.lower(F.concat("p_brand", F.lit("#"), "p_partkey"))
    kind = F.when(F.col("p_size") < 20, vocabulary.BRAND).otherwise("IN").alias("kind")
    aliases = vocabulary.whole(known.select(code.alias("name_lower"), name.alias("generic_name"), kind).union(known.select(name, name, F.lit("IN")).distinct()))
    least = known.groupBy("p_brand").agg(F.min(name).alias("least"))
    listed = t.part.where("p_partkey % 20 = 0").join(least, "p_brand", "left").select(code.alias("name_lower"), F.when(F.col("p_partkey") % 40 == 0, "no such thing").otherwise(F.col("least")).alias("target"))
    table, missing = vocabulary.for_sources(aliases, listed)
    label = F.when(F.col("kind") == "REVIEWED_SOURCE_ALIAS", "reviewed").otherwise(F.col("kind")).alias("kind")
    return table.select(F.col("name_lower").alias("name"), F.col("generic_name").alias("canonical"), label).union(missing.select("name_lower", F.lit(None).cast("string"), F.lit("missing")))


@query("""
WITH a AS (SELECT lower(p_brand || '#' || p_partkey) AS n FROM part WHERE p_size NOT IN (7, 8)),
r AS (SELECT lower(p_brand || '#' || p_partkey) AS x, CASE WHEN l_linenumber % 3 > 0 THEN lower(s_name) END AS y FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
s AS (SELECT x AS name FROM r UNION ALL SELECT y FROM r WHERE y IS NOT NULL), u AS (SELECT name, count(*) AS n FROM s WHERE name NOT IN (SELECT n FROM a) GROUP BY 1),
top AS (SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS top FROM (SELECT * FROM u ORDER BY n DESC, name LIMIT 15))
SELECT (SELECT count(DISTINCT name) FROM s) AS distinct_names, (SELECT count(DISTINCT name) FROM s) - (SELECT count(*) FROM u) AS matched_names, (SELECT count(*) FROM u) AS unmatched_names,
  round(1.0 - (SELECT count(*) FROM u) / (SELECT count(DISTINCT name) FROM s)::DOUBLE, 4) AS name_match_rate, (SELECT count(*) FROM r) AS rows_in, (SELECT count(*) FROM r WHERE x IN (SELECT n FROM a)) AS rows_kept,
  round((SELECT count(*) FROM r WHERE x IN (SELECT n FROM a)) / (SELECT count(*) FROM r)::DOUBLE, 4) AS row_retention, (SELECT top FROM top) AS top_unmatched
""")
def name_coverage(t):
    """How well the names of a table of two sides are known; one side is null now and then."""
    part = t.part.select("p_partkey", F.concat("p_brand", F.lit("#"), "p_partkey").alias("x"), F.when(~F.col("p_size").isin(7, 8), F.col("p_name")).alias("cx"))
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select("x", "cx", F.when(F.col("l_linenumber") % 3 > 0, F.col("s_name")).alias("y"), F.lit(None).cast("string").alias("cy"))
    said = kept(readers.said_names(rows, (("x", "cx"), ("y", "cy"))), "said")
    done = vocabulary.coverage(said, rows.count(), rows.where("cx IS NOT NULL").count())
    return done.withColumn("top_unmatched", F.array_join(F.transform("top_unmatched", lambda s: F.concat(s["name"], F.lit(":"), s["rows_affected"].cast("string"))), ","))
