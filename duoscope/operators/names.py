"""Names and their canonical forms: maps with defaults, aliases, integrity, upserts, classification, resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, grams, indel_ratio

#: Rows of a dimension that is sent to all executors; a larger one is joined by a shuffle.
SMALL = 200_000


def dimension(df: DataFrame) -> DataFrame:
    """df for a join, broadcast where its counted size allows it."""
    return F.broadcast(df) if df.count() <= SMALL else df


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def first_wins(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key in an order that has no ties of different rows."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def map_or_keep(df: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """The canonical form of a name by aliases (alias, canonical), else the cleaned name itself."""
    return df.withColumn("_k", clean(F.col(name))).join(aliases.select(F.col("alias").alias("_k"), F.col("canonical").alias("_c")), "_k", "left").withColumn(out, F.coalesce("_c", "_k")).drop("_k", "_c")


def priority_lookup(df: DataFrame, ident: str, name: str, by_id: DataFrame, by_name: DataFrame, out: str) -> DataFrame:
    """The canonical form by id (key, canonical), else by name, else null."""
    first = by_id.select(F.col("key").alias("_i"), F.col("canonical").alias("_ci"))
    second = by_name.select(F.col("key").alias("_n"), F.col("canonical").alias("_cn"))
    found = df.join(first, F.col(ident) == F.col("_i"), "left").join(second, clean(F.col(name)) == F.col("_n"), "left")
    return found.withColumn(out, F.coalesce("_ci", "_cn")).drop("_i", "_ci", "_n", "_cn")


def with_self_aliases(aliases: DataFrame) -> DataFrame:
    """aliases (alias, canonical) and one row for each canonical name that is no alias yet."""
    missing = aliases.select(F.col("canonical").alias("alias")).distinct().join(aliases.select("alias"), "alias", "left_anti")
    return aliases.select("alias", "canonical").unionByName(missing.withColumn("canonical", F.col("alias")))


def integrity_issues(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct names (table, column, name) that don't map to themselves, with what they map to (null: nothing)."""
    found = names.distinct().join(aliases.select(F.col("alias").alias("name"), F.col("canonical").alias("target")), "name", "left")
    return found.where(~F.col("name").eqNullSafe(F.col("target"))).select("table", "column", "name", "target")


def upsert(base: DataFrame, changes: DataFrame, key: str, valid: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """base with the rows of changes in place of those with their key; with valid only changes whose target is in it."""
    if valid is not None:
        changes = changes.join(valid, target, "left_semi")
    return base.join(changes.select(key), key, "left_anti").unionByName(changes.select(base.columns))


def hop(relations: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source the sorted set of targets one relation away. relations: (source, target)."""
    kept = relations.join(sources, "source", "left_semi").join(targets, "target", "left_semi")
    return kept.groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def classify_brands(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """An outcome for each brand of parts (brand, product, ingredient), all of a product's ingredients or nothing.

    vocabulary: (ingredient, canonical). unmapped: no product has all its ingredients mapped; alias: one tuple of one
    ingredient; combination: one tuple of several; ambiguous: several tuples; known: the brand is a canonical name.
    """
    mapped = parts.join(vocabulary, "ingredient", "left")
    products = mapped.groupBy("brand", "product").agg(F.every(F.col("canonical").isNotNull()).alias("whole"), F.concat_ws(" + ", F.sort_array(F.collect_set("canonical"))).alias("tuple"), F.countDistinct("canonical").alias("n"))
    whole = F.col("whole")
    brands = products.groupBy("brand").agg(F.countDistinct(F.when(whole, F.col("tuple"))).alias("tuples"), F.min(F.when(whole, F.col("tuple"))).alias("ingredients"), F.max(F.when(whole, F.col("n"))).alias("n"))
    known = vocabulary.select(F.col("canonical").alias("brand")).distinct().withColumn("known", F.lit(True))
    outcome = F.when(F.col("known"), "known").when(F.col("tuples") == 0, "unmapped").when(F.col("tuples") > 1, "ambiguous").when(F.col("n") > 1, "combination").otherwise("alias")
    return brands.join(known, "brand", "left").select("brand", outcome.alias("outcome"), F.when(F.col("tuples") == 1, F.col("ingredients")).alias("ingredients"))


def family(queries: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """Names (name) that begin with a one-word query (query) of `least` characters or more, then no letter or digit.

    A name is joined under each of its own beginnings that ends before such a place, so the join is on equality.
    """
    heads = F.filter(F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.when(~F.coalesce(F.substring("name", i + 1, F.lit(1)).rlike("[a-zA-Z0-9]"), F.lit(False)), F.substring("name", F.lit(1), i))), lambda x: x.isNotNull() & (F.char_length(x) >= least))
    spread = names.where(F.char_length("name") > 0).select("name", F.explode(heads).alias("query"))
    return queries.where((F.char_length("query") >= least) & ~F.col("query").contains(" ")).join(spread, "query")


def rare_first(df: DataFrame, key: str, q: int, share: float, seen: DataFrame) -> DataFrame:
    """key, its length _n, its parts _all by how rare they are in seen (part, n), and those of them that must meet, _head.

    A text of n characters and any partner that the bound allows have at least `least` parts in common, so one of them is
    among the first size - least + 1 of each, in any order that both sides follow.
    """
    n, total = F.char_length(key), F.char_length(key) * (1 + share)
    need = F.ceil(total * (share / (1 + share)) - 1e-9) if q == 1 else F.ceil(total * (3 * share / (1 + share) - 1) - 1e-9) + 1
    parts = df.select(key, F.explode(grams(F.col(key), q)).alias("part")).join(seen, "part", "left")
    sorted_parts = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part"))), lambda x: x["part"])
    return parts.groupBy(key).agg(sorted_parts.alias("_all")).select(key, n.alias("_n"), "_all", F.slice("_all", 1, F.greatest(F.size("_all") - F.greatest(need, F.lit(1)) + 1, F.lit(1)).cast("int")).alias("_head"))


def fuzzy_candidates(queries: DataFrame, names: DataFrame, floor: float = 75.0, salts: int = 8) -> DataFrame:
    """Pairs of query and name (both distinct) with an indel ratio of floor or more; empty and null texts have none.

    The ratio asks for `need` common characters of m and n in all, so at most m + n - 2 need go or come. Each of them
    breaks two pairs of neighbours of the text it is in, and one of the other: with the ends counted as characters 3 need
    - m - n + 1 pairs stay, one at least from a floor of 200 / 3 on (below it single characters are used, of which need
    stay). Texts meet on their rarest parts only, each pair on the first part they share; lengths and the number of common
    parts are tested before anything is scored. Frequent parts are salted, so none is one task.
    """
    share = floor / (200.0 - floor)
    q = 2 if floor * 3 >= 200 else 1
    names, queries = names.select("name").where("name <> ''"), queries.select("query").where("query <> ''")
    seen = dimension(names.select(F.explode(grams(F.col("name"), q)).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    x, y = (rare_first(df, key, q, share, seen).withColumnsRenamed({c: f"{c}_{key}" for c in ("_n", "_all", "_head")}) for df, key in ((queries, "query"), (names, "name")))
    x = x.withColumn("_part", F.explode("_head_query")).withColumn("_salt", F.pmod(F.xxhash64("query"), F.lit(salts)).cast("int"))
    y = y.withColumn("_part", F.explode("_head_name")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    total = F.col("_n_query") + F.col("_n_name")
    need = F.ceil(total * (floor / 200.0) - 1e-9)
    near = (F.least("_n_query", "_n_name") >= need) & (F.array_intersect("_head_query", "_head_name")[0] == F.col("_part"))
    enough = F.size(F.array_intersect("_all_query", "_all_name")) >= (need if q == 1 else 3 * need - total + 1)
    both = x.join(y, ["_part", "_salt"]).where(near & enough).select("query", "name")
    return both.withColumn("score", indel_ratio(F.col("query"), F.col("name"))).where(F.col("score") >= floor)


def fuzzy_decision(candidates: DataFrame, accept: float = 85.0, floor: float = 75.0, margin: float = 10.0, shown: int = 4) -> DataFrame:
    """The best canonical name of each query, or why there is none. candidates: (query, name, canonical, score).

    fuzzy: the best name scores accept or more and no other name of floor or more is within the margin; ambiguous:
    such another stands close; unresolved else. closest: up to `shown` names within the margin of an ambiguous best one.
    """
    by = candidates.groupBy("query", "canonical").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "canonical")
    ranked = by.withColumn("r", F.row_number().over(order)).withColumn("rival", F.lead("score").over(order)).withColumn("best", F.max("score").over(Window.partitionBy("query")))
    close = F.coalesce((F.col("rival") >= floor) & (F.col("best") - F.col("rival") < margin), F.lit(False))
    near = F.when((F.col("r") <= shown) & (F.col("best") - F.col("score") < margin), F.struct("r", "canonical"))
    done = ranked.groupBy("query").agg(F.max("best").alias("best"), F.max(F.when(F.col("r") == 1, close)).alias("close"), F.max(F.when(F.col("r") == 1, F.col("canonical"))).alias("top"), F.concat_ws(" / ", F.transform(F.sort_array(F.collect_list(near)), lambda x: x.canonical)).alias("closest"))
    sure = (F.col("best") >= accept) & ~F.col("close")
    return done.select("query", F.when(sure, "fuzzy").when(F.col("close"), "ambiguous").otherwise("unresolved").alias("method"), F.when(sure, F.col("top")).alias("canonical"), "best", F.when(~sure & F.col("close"), F.col("closest")).alias("closest"))


def resolve(queries: DataFrame, aliases: DataFrame, combinations: DataFrame, targets: DataFrame) -> DataFrame:
    """Each distinct query's method and canonical name: exact, then combination, family, fuzzy, else unresolved.

    queries: (query); aliases: (alias, canonical); combinations: (name); targets: aliases worth a spelling match.
    Queries that an earlier rule settles don't reach the later ones.
    """
    asked = queries.select(clean(F.col("query")).alias("query")).distinct()
    exact = asked.join(aliases.withColumnRenamed("alias", "query"), "query").select("query", F.lit("exact").alias("method"), "canonical")
    rest = asked.join(exact, "query", "left_anti").where("query <> ''")
    combined = rest.join(combinations.select(F.col("name").alias("query")), "query", "left_semi").select("query", F.lit("combination").alias("method"), F.lit(None).cast("string").alias("canonical"))
    rest = rest.join(combined, "query", "left_anti")
    kin = family(rest, aliases.select(F.col("canonical").alias("name")).distinct()).groupBy("query").count().where("count >= 2")
    kin = kin.select("query", F.lit("family").alias("method"), F.lit(None).cast("string").alias("canonical"))
    rest = rest.join(kin, "query", "left_anti")
    near = fuzzy_candidates(rest, targets.select(F.col("alias").alias("name")).distinct()).join(targets.select(F.col("alias").alias("name"), "canonical"), "name")
    fuzzy = fuzzy_decision(near).select("query", "method", "canonical")
    none = asked.join(reduce(DataFrame.unionByName, [exact, combined, kin, fuzzy]).select("query"), "query", "left_anti").select("query", F.lit("unresolved").alias("method"), F.lit(None).cast("string").alias("canonical"))
    return reduce(DataFrame.unionByName, [exact, combined, kin, fuzzy, none])


def any_of(conditions: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds, else null."""
    return F.coalesce(*[F.when(c, name) for c, name in conditions])


def unii_bridge(entries: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names of entries (key, unii, names: array) as aliases of the canonical name that their UNII leads to.

    Columns alias, canonical, outcome: added, conflict (the alias is known and points elsewhere), known (to the same), or
    unlinked (one row an entry without a link, its key as alias). A known alias always wins; of two entries that give one
    new alias, that with the smaller key is added and the other is known or a conflict.
    """
    linked = entries.join(links.select(F.col("unii").alias("u"), "canonical"), F.trim("unii") == F.col("u"), "left").drop("u")
    named = linked.where("canonical IS NOT NULL").select("key", "canonical", F.explode("names").alias("alias")).withColumn("alias", F.lower(F.trim("alias"))).where("alias <> ''")
    first = named.groupBy("alias").agg(F.min_by("canonical", F.struct("key", "canonical")).alias("winner"), F.min(F.struct("key", "canonical")).alias("one"))
    known = aliases.select(F.col("alias").alias("k"), F.col("canonical").alias("had"))
    rows = named.distinct().join(first, "alias").join(known, F.col("alias") == F.col("k"), "left")
    is_first = (F.col("one.key") == F.col("key")) & (F.col("one.canonical") == F.col("canonical"))
    outcome = F.when(F.col("had").isNotNull(), F.when(F.col("had") == F.col("canonical"), "known").otherwise("conflict")).when(is_first, "added")
    rows = rows.select("alias", "canonical", outcome.when(F.col("winner") == F.col("canonical"), "known").otherwise("conflict").alias("outcome"))
    return rows.unionByName(linked.where("canonical IS NULL").select(F.col("key").cast("string").alias("alias"), F.lit(None).cast("string").alias("canonical"), F.lit("unlinked").alias("outcome")))
