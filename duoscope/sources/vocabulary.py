"""One vocabulary out of several: synonyms and brand names join a terminology, reviewed names correct it, and it is told apart what
a user may type from what a source table may say.

Vocabularies have name_lower (cleaned, one row each), generic_name, rxcui, drugbank_id and kind. What is there already wins over
what joins later, but for reviewed names. Whatever is not applied is in a review table or counted by its outcome.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import names
from . import archives, readers

#: Columns of a vocabulary, in order.
COLUMNS = ("name_lower", "generic_name", "rxcui", "drugbank_id", "kind")
#: Kind of the names that only users' input may be read by.
BRAND = "DRUGSATFDA:BRAND"

# Reviewed names. Salts that the terminology keeps apart and the sources don't; names that sources use for one of
# the terminology; brands by which source tables may be read; what a brand means whatever its products list.
SALTS = {
    "lithium carbonate": "lithium",
    "lithium citrate": "lithium",
}
REVIEWED = {
    "salbutamol": "albuterol",
    "levosalbutamol": "levalbuterol",
    "valaciclovir": "valacyclovir",
    "norethisterone": "norethindrone",
    "etacrynic acid": "ethacrynic acid",
    "ursodeoxycholic acid": "ursodiol",
    "isoprenaline": "isoproterenol",
    "orciprenaline": "metaproterenol",
    "mepyramine": "pyrilamine",
    "calcipotriol": "calcipotriene",
    "cromoglicic acid": "cromolyn",
    "phylloquinone": "phytonadione",
    "somatotropin": "somatropin",
    "nicotinamide": "niacinamide",
    "clofedanol": "chlophedianol",
    "leuprorelin": "leuprolide",
    "deprenyl": "selegiline",
    "vitamin d3": "cholecalciferol",
    "ethinylestradiol": "ethinyl estradiol",
    "ferrous sulfate anhydrous": "ferrous sulfate",
    "tetraferric tricitrate decahydrate": "ferric citrate",
}
SOURCE_BRANDS = {
    "8-mop": "methoxsalen",
    "implanon": "etonogestrel",
    "ogen": "estropipate",
    "zoledronic": "zoledronic acid",
    "esterified estrogens": "estrogens, esterified (usp)",
    "optison": "perflutren",
}
BRAND_OVERRIDES = {"optison": "perflutren"}


class Merged(NamedTuple):
    """A vocabulary after brands joined it: aliases, combinations (name_lower, ingredients), the outcome of every brand, and
    what a person has to look at (name, issue, offered, vocabulary)."""

    aliases: DataFrame
    combinations: DataFrame
    outcomes: DataFrame
    review: DataFrame


def pairs_of(spark: SparkSession, listed: dict[str, str]) -> DataFrame:
    """(name_lower, target) of a reviewed list."""
    return spark.createDataFrame(sorted(listed.items()), "name_lower string, target string")


def whole(df: DataFrame) -> DataFrame:
    """df with the columns of a vocabulary, null where it lacks one."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def own_rows(aliases: DataFrame) -> DataFrame:
    """target, rxcui and drugbank_id of the names that stand for themselves."""
    return aliases.where("name_lower = generic_name").select(F.col("name_lower").alias("target"), "rxcui", "drugbank_id")


def add_reviewed(aliases: DataFrame, reviewed: DataFrame, kind: str = "REVIEWED_ALIAS") -> tuple[DataFrame, DataFrame]:
    """aliases with the reviewed names (name_lower, target) that they lack, each for what its target stands for; and the
    reviewed names whose target no vocabulary knows."""
    hit = aliases.select(F.col("name_lower").alias("target"), "generic_name", "rxcui", "drugbank_id")
    new = reviewed.join(hit, "target").join(aliases.select("name_lower"), "name_lower", "left_anti")
    return aliases.unionByName(whole(new.withColumn("kind", F.lit(kind)))), reviewed.join(hit, "target", "left_anti").select("name_lower")


def redirect(aliases: DataFrame, reviewed: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """aliases with the reviewed names (name_lower, target) in place of what those names stood for; and the reviewed names
    whose target does not stand for itself, which are not applied."""
    rows = own_rows(aliases)
    changes = reviewed.join(rows, "target").select("name_lower", F.col("target").alias("generic_name"), "rxcui", "drugbank_id", F.lit(kind).alias("kind"))
    return names.upsert(aliases, changes, "name_lower"), reviewed.join(rows, "target", "left_anti").select("name_lower")


def synonym_file(spark: SparkSession, path: str) -> DataFrame:
    """drugbank_id, unii and names (its common name, then its synonyms) of a quoted file of synonyms. Columns that the file
    lacks are empty; a value over several lines is read whole."""
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    text = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    parts = readers.synonyms(raw, "Synonyms") if "Synonyms" in raw.columns else F.array().cast("array<string>")
    common = F.filter(F.array(clean(text("Common name"))), lambda x: x.isNotNull() & (x != ""))
    return raw.select(text("DrugBank ID").alias("drugbank_id"), text("UNII").alias("unii"), F.array_distinct(F.concat(common, parts)).alias("names"))


def unii_links(concepts: DataFrame, leads: DataFrame) -> DataFrame:
    """(unii, canonical) of the substance codes whose concept leads to a single ingredient. leads: (RXCUI, parts). A code of
    several concepts has what the largest concept leads to."""
    coded = concepts.where("LAT = 'ENG' AND SUPPRESS NOT IN ('Y', 'O') AND SAB = 'MTHSPL' AND TTY = 'SU' AND CODE <> ''").select("RXCUI", F.col("CODE").alias("unii"))
    return coded.join(leads.where("size(parts) = 1"), "RXCUI").groupBy("unii").agg(F.max_by(F.col("parts")[0], "RXCUI").alias("canonical"))


def merge_synonyms(aliases: DataFrame, entries: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """aliases with the new names of entries (drugbank_id, unii, names), and outcome and n: added, conflict, known, unlinked.
    Of entries that give the same new name the one with the smallest id counts."""
    found = names.unii_bridge(entries.withColumnRenamed("drugbank_id", "key"), links, aliases.select(F.col("name_lower").alias("alias"), F.col("generic_name").alias("canonical")))
    giver = entries.join(links, F.trim(entries["unii"]) == links["unii"], "left_semi").select("drugbank_id", F.explode("names").alias("name_lower")).groupBy("name_lower").agg(F.min("drugbank_id").alias("drugbank_id"))
    added = found.where("outcome = 'added'").select(F.col("alias").alias("name_lower"), F.col("canonical").alias("generic_name"), F.lit("DRUGBANK").alias("kind"))
    return aliases.unionByName(whole(added.join(giver, "name_lower", "left"))), found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def products_file(spark: SparkSession, path: str, member: str = "Products.txt") -> DataFrame:
    """drug_name and active_ingredient of the products in a zip, or in a text file of the same form; rows without a name go."""
    columns = ["DrugName", "ActiveIngredient"]
    table = readers.fields(archives.lines(spark, path, member, "latin-1"), "\t") if path.endswith(".zip") else readers.delimited(spark, path, "\t", quoted=False, encoding="ISO-8859-1")
    return table.select(*[F.coalesce(F.trim(c), F.lit("")).alias(n) for c, n in zip(columns, ("drug_name", "active_ingredient"))]).where("drug_name <> ''")


def brand_outcomes(products: DataFrame, aliases: DataFrame, combinations: DataFrame) -> DataFrame:
    """name, outcome, sets (the sets of ingredients it was given, sorted), unmapped (products with an unknown ingredient) and
    had (what the vocabulary says) of each brand of products (drug_name, active_ingredient).

    unmapped: no product has known ingredients only. ambiguous: some have, some don't, or they differ. known: the vocabulary
    says the same. collision: it says something else. Else alias (one ingredient) or combination (several). A product has all
    its ingredients, which semicolons separate, or none; one without ingredients is unmapped. Products that say the same count
    once, so a brand of many products is a few rows before it is grouped.
    """
    listed = products.select(clean(F.col("drug_name")).alias("name"), F.col("active_ingredient").alias("listed")).where("name <> ''").distinct()
    parts = F.filter(F.transform(F.split(F.coalesce("listed", F.lit("")), ";"), clean), lambda x: x != "")
    each = listed.select("name", "listed", F.explode_outer(parts).alias("part"))
    mapped = each.join(names.dimension(aliases.select(F.col("name_lower").alias("part"), F.col("generic_name").alias("canonical"))), "part", "left")
    product = mapped.groupBy("name", "listed").agg(F.every(F.col("canonical").isNotNull()).alias("whole"), F.array_sort(F.collect_set("canonical")).alias("set"))
    brand = product.groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("set")))).alias("sets"), F.count_if(~F.col("whole")).alias("unmapped"))
    one = aliases.select(F.col("name_lower").alias("name"), F.col("generic_name").alias("_one"))
    several = combinations.select(F.col("name_lower").alias("name"), F.col("ingredients").alias("_several"))
    met = brand.join(one, "name", "left").join(several, "name", "left")
    said = F.array_join(F.col("sets")[0], " + ")
    same = F.coalesce((F.size(F.col("sets")[0]) == 1) & (F.col("_one") == said), F.lit(False)) | F.coalesce(F.col("_several") == said, F.lit(False))
    outcome = (
        F.when(F.size("sets") == 0, "unmapped").when((F.col("unmapped") > 0) | (F.size("sets") > 1), "ambiguous")
        .when(F.col("_one").isNotNull() | F.col("_several").isNotNull(), F.when(same, "known").otherwise("collision"))
        .when(F.size(F.col("sets")[0]) == 1, "alias").otherwise("combination")
    )
    had = F.when(F.col("_one").isNotNull(), F.col("_one")).when(F.col("_several").isNotNull(), F.when(outcome == "collision", F.concat(F.lit("combination: "), "_several")).otherwise(F.col("_several")))
    return met.select("name", outcome.alias("outcome"), "sets", "unmapped", had.alias("had"))


def brand_review(outcomes: DataFrame) -> DataFrame:
    """name, issue, offered and vocabulary (empty: unknown) of the brands that were not applied because they collide or are ambiguous."""
    offered = F.array_join(F.concat(F.transform("sets", lambda s: F.array_join(s, " + ")), F.when(F.col("unmapped") > 0, F.array(F.lit("(unmapped)"))).otherwise(F.array().cast("array<string>"))), " | ")
    return outcomes.where("outcome IN ('ambiguous', 'collision')").select("name", F.col("outcome").alias("issue"), offered.alias("offered"), F.coalesce("had", F.lit("")).alias("vocabulary"))


def merge_brands(aliases: DataFrame, combinations: DataFrame, outcomes: DataFrame) -> Merged:
    """A vocabulary with the brands that brand_outcomes() found to be new and clear. outcomes is read four times: write it first."""
    said = outcomes.select("outcome", F.col("name").alias("name_lower"), F.array_join(F.col("sets")[0], " + ").alias("target"))
    new = said.where("outcome = 'alias'").join(own_rows(aliases), "target", "left").select("name_lower", F.col("target").alias("generic_name"), "rxcui", "drugbank_id", F.lit(BRAND).alias("kind"))
    more = said.where("outcome = 'combination'").select("name_lower", F.col("target").alias("ingredients"))
    return Merged(aliases.unionByName(new), combinations.select("name_lower", "ingredients").unionByName(more), outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), brand_review(outcomes))


def for_sources(aliases: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary that source tables are read by: all but the brands, and the reviewed (name_lower, target) in place of what
    their names stood for; and the reviewed names whose target is missing. A new list of brands so never changes what data says."""
    return redirect(aliases.where(F.col("kind").isNull() | (F.col("kind") != BRAND)), reviewed, "REVIEWED_SOURCE_ALIAS")


def coverage(said: DataFrame, rows_in: int, rows_kept: int, shown: int = 15) -> DataFrame:
    """One row on how well a source's names are known. said: (name, canonical, n), one row a name: null where it is unknown, and n
    rows that it is in. distinct, matched and unmatched names, their rate; rows read and kept, their rate; and the `shown`
    unknown names in most rows (ties by name). Rates are null where there is nothing to divide by."""
    unknown = said.where("canonical IS NULL")
    top = unknown.select(F.struct((-F.col("n")).alias("m"), F.col("name")).alias("k")).orderBy("k").limit(shown).agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.struct(k["name"].alias("name"), (-k["m"]).alias("rows_affected"))).alias("top_unmatched"))
    share = lambda x, y: F.when(y > 0, F.round(x / y, 4))
    rows_in, rows_kept = F.lit(rows_in).cast("bigint"), F.lit(rows_kept).cast("bigint")
    total, known = F.count(F.lit(1)), F.count("canonical")
    counted = said.agg(total.alias("distinct_names"), known.alias("matched_names"), share(known, total).alias("name_match_rate"), rows_in.alias("rows_in"), rows_kept.alias("rows_kept"), share(rows_kept, rows_in).alias("row_retention"), (total - known).alias("unmatched_names"))
    return counted.crossJoin(top)  # one row each
