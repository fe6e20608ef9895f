"""Ingest as one job: raw files of a folder, or the clean tables of a sample, become the canonical tables of a build.

Every table is written out and read again before the next one needs it, so a lost executor repeats one step only. Missing
optional files leave their part out; no vocabulary is an error of the full ingest. The result is a report of rows by table
and source, with the names that no vocabulary knows beside the tables (unmatched_*).
"""

from __future__ import annotations

import datetime
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import names, pairs
from ..operators.stats import union_all
from . import archives, provenance, readers
from . import vocabulary as voc
from .tables import _there as table_there
from .tables import first_match, read_table, table_exists, write_table

# Fields of the published files, in order.
CONCEPTS = ["RXCUI", "LAT", "TS", "LUI", "STT", "SUI", "ISPREF", "RXAUI", "SAUI", "SCUI", "SDUI", "SAB", "TTY", "CODE", "STR", "SRL", "SUPPRESS", "CVF"]
RELATIONS = ["RXCUI1", "RXAUI1", "STYPE1", "REL", "RXCUI2", "RXAUI2", "STYPE2", "RELA", "RUI", "SRUI", "SAB", "SL", "DIR", "RG", "SUPPRESS", "CVF"]
EFFECTS = ["flat", "stitch", "label_cui", "kind", "cui", "term"]
#: Where the products with brand names are.
PRODUCTS = ("drugsatfda/*.zip", "drugsatfda/Products.txt")
#: Columns that belong to one side of a pair.
SIDES = (("drug_a_rxcui", "drug_b_rxcui"),)


def kept(spark: SparkSession, df: DataFrame, out: str, table: str) -> DataFrame:
    return read_table(spark, write_table(df, f"{out}/{table}.parquet"))


def row_place() -> Column:
    """Where a row of a file stands: later rows are greater. For tables just read from text files."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())


def alias_table(vocabulary: DataFrame) -> DataFrame:
    """(alias, canonical), one row an alias, with each canonical name as an alias of itself."""
    one = vocabulary.select(clean(F.col("name_lower")).alias("alias"), clean(F.col("generic_name")).alias("canonical")).where("alias <> '' AND canonical <> ''")
    return names.with_self_aliases(one.groupBy("alias").agg(F.min("canonical").alias("canonical")))


def with_itself(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary with a row for each canonical name that it has no row for."""
    generic = vocabulary.where("generic_name IS NOT NULL").select(F.col("generic_name").alias("name_lower")).distinct()
    missing = generic.join(vocabulary.select("name_lower"), "name_lower", "left_anti").withColumn("generic_name", F.col("name_lower"))
    return vocabulary.unionByName(missing, allowMissingColumns=True)


def checked(spark: SparkSession, tables: dict[str, DataFrame], aliases: DataFrame, out: str) -> DataFrame:
    """The report of a build, written beside it: rows by table and source, and names that are not canonical (issues)."""
    columns = {"interactions": ("drug_a_name", "drug_b_name"), "side_effects": ("drug_name",)}
    used = [tables[t].select(F.lit(t).alias("table"), F.lit(c).alias("column"), F.col(c).alias("name")) for t, cs in columns.items() if t in tables for c in cs]
    report = provenance.stamp(tables)
    if used:
        issues = names.integrity_issues(union_all(used), aliases)
        report = report.unionByName(issues.groupBy(F.lit("issues").alias("table"), F.col("table").alias("source")).agg(F.count(F.lit(1)).alias("n")).select("table", "source", "n"))
    return kept(spark, report, out, "report")


def ingest_sample(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Tables of a folder that have canonical columns already (drug_vocabulary, interactions, ddinter, side_effects).

    The two tables of interactions are united by name of column; names become canonical where the vocabulary knows them,
    and pairs are turned so that the smaller name comes first.
    """
    there = {t: read_table(spark, f"{folder}/{t}.csv") for t in ("drug_vocabulary", "interactions", "ddinter", "side_effects") if table_exists(spark, f"{folder}/{t}.csv")}
    tables: dict[str, DataFrame] = {}
    aliases = spark.createDataFrame([], "alias string, canonical string")
    if "drug_vocabulary" in there:
        tables["drug_vocabulary"] = kept(spark, with_itself(there["drug_vocabulary"]), out, "drug_vocabulary")
        aliases = names.dimension(alias_table(tables["drug_vocabulary"]))
    found = [there[t] for t in ("interactions", "ddinter") if t in there]
    if found:
        rows = union_all(found)
        for side in ("drug_a_name", "drug_b_name"):
            rows = names.map_or_keep(rows, side, aliases, side)
        sides = tuple(p for p in SIDES if set(p) <= set(rows.columns))
        tables["interactions"] = kept(spark, pairs.orient(rows, "drug_a_name", "drug_b_name", sides), out, "interactions")
    if "side_effects" in there:
        tables["side_effects"] = kept(spark, names.map_or_keep(there["side_effects"], "drug_name", aliases, "drug_name"), out, "side_effects")
    if not tables:
        raise FileNotFoundError(f"no table of a sample in {folder}")
    report = checked(spark, tables, aliases, out)
    provenance.write(spark, out, report, "sample")
    return report


def said_of(spark: SparkSession, raw: str) -> dict[str, dict]:
    """What MANIFEST.json says of each source (title, version, license, homepage, files); nothing where there is none."""
    if not table_there(spark, f"{raw}/MANIFEST.json"):
        return {}
    return json.loads(spark.read.text(f"{raw}/MANIFEST.json", wholetext=True).first()["value"])


def terminology(spark: SparkSession, raw: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations of rxnorm/*.zip, else of rxnorm/rrf."""
    packed = first_match(spark, raw, "rxnorm/*.zip")
    if packed:
        lines = {f: archives.lines(spark, packed, rf"(.*/)?{f}\.RRF") for f in ("RXNCONSO", "RXNREL")}
        return tuple(readers.fields(lines[f], "|", [*columns, "_end"]).drop("_end") for f, columns in (("RXNCONSO", CONCEPTS), ("RXNREL", RELATIONS)))
    concepts, relations = (first_match(spark, raw, f"rxnorm/rrf/{f}.RRF") for f in ("RXNCONSO", "RXNREL"))
    if not concepts or not relations:
        raise FileNotFoundError(f"no vocabulary in {raw}/rxnorm")
    return readers.rrf(spark, concepts, CONCEPTS), readers.rrf(spark, relations, RELATIONS)


class Vocabularies(NamedTuple):
    """What names stand for: in users' input, in source tables, by id; and the names of combinations."""

    users: DataFrame
    sources: DataFrame
    by_id: DataFrame
    combinations: DataFrame


def vocabularies(spark: SparkSession, raw: str, out: str, synonyms: str | None, overrides: DataFrame | None) -> Vocabularies:
    """Writes drug_vocabulary (users), source_vocabulary, combination_products, brand_review and vocabulary_report (measure, n)."""
    concepts, relations = terminology(spark, raw)
    made, combinations = readers.vocabulary(concepts, relations, voc.SALTS)
    led, _ = readers.leads(concepts, relations, voc.SALTS)
    led = kept(spark, led, out, "concept_leads")
    reviewed = [(name, voc.pairs_of(spark, listed)) for name, listed in (("reviewed_aliases", voc.REVIEWED), ("reviewed_source_brands", voc.SOURCE_BRANDS))]
    aliases, lost = voc.add_reviewed(kept(spark, voc.whole(made), out, "terminology"), reviewed[0][1])
    missing = {"reviewed_aliases": lost}
    counts = []
    measured = lambda df, prefix: df.select(F.concat(F.lit(prefix), F.col("outcome")).alias("measure"), "n")
    if synonyms:
        aliases, outcomes = voc.merge_synonyms(aliases, voc.synonym_file(spark, synonyms), voc.unii_links(concepts, led))
        counts.append(measured(outcomes, "synonyms_"))
    aliases = with_itself(aliases)
    products = first_match(spark, raw, *PRODUCTS)
    if products:
        aliases = kept(spark, aliases, out, "vocabulary_before_brands")
        outcomes = kept(spark, voc.brand_outcomes(voc.products_file(spark, products), aliases, combinations), out, "brand_outcomes")
        aliases, combinations, brands, review = voc.merge_brands(aliases, combinations, outcomes)
        kept(spark, review, out, "brand_review")
        counts.append(measured(brands, "brands_"))
    changes = voc.pairs_of(spark, voc.BRAND_OVERRIDES) if overrides is None else overrides.select(F.col("alias").alias("name_lower"), F.col("canonical").alias("target"))
    aliases, missing["overrides"] = voc.redirect(aliases, changes, "REVIEWED_BRAND_OVERRIDE")
    users = kept(spark, aliases, out, "drug_vocabulary")
    sources, missing["reviewed_source_brands"] = voc.for_sources(users, reviewed[1][1])
    sources = kept(spark, sources, out, "source_vocabulary")
    combined = kept(spark, combinations, out, "combination_products")
    only = users.join(sources.select("name_lower"), "name_lower", "left_anti")
    for name, df in {"rows": users, "source_rows": sources, "combination_products": combined, "user_only_aliases": only, **{f"{k}_missing_target": df for k, df in missing.items()}}.items():
        counts.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n"))
    kept(spark, union_all(counts), out, "vocabulary_report")
    return Vocabularies(users, sources, led.where("size(parts) = 1").select(F.col("RXCUI").alias("key"), F.col("parts")[0].alias("canonical")), combined)


def ingest_full(spark: SparkSession, raw: str, out: str, research: bool = False, excluded: tuple[str, ...] = (), overrides: DataFrame | None = None, synonyms: str | None = None) -> DataFrame:
    """The whole build: vocabulary, curated and (for research) statistical interactions, side effects, and the report.

    raw holds rxnorm/*.zip or rxnorm/rrf/RXNCONSO.RRF and RXNREL.RRF, drugsatfda/*.zip or Products.txt, ddinter/*.csv,
    twosides/TWOSIDES.csv (xz, gz or plain), and sider/meddra_all_se.tsv.gz with sider/drug_names.tsv; synonyms is a file of
    names with UNII codes. overrides (alias, canonical; unless given, the reviewed ones) replace aliases of users where their
    target is a canonical name; excluded are events that are no effects. Source tables are read by source_vocabulary, which
    has no brands but reviewed ones. Rows whose names are unknown on a side are left out, and their names counted in
    unmatched_curated, unmatched_statistical and unmatched_side_effects; coverage has one row a source: names and their match
    rate, rows and their retention, and the unknown names in most rows.
    """
    vocabulary = vocabularies(spark, raw, out, synonyms, overrides)
    tables = {"drug_vocabulary": vocabulary.users, "combination_products": vocabulary.combinations}
    aliases = names.dimension(alias_table(vocabulary.sources))
    by_name, by_id = aliases.withColumnRenamed("alias", "key"), vocabulary.by_id
    covered = []
    used = ["rxnorm", *["drugbank"] * bool(synonyms), *["drugsatfda"] * bool(first_match(spark, raw, *PRODUCTS)), *["ddinter"] * bool(first_match(spark, raw, "ddinter/*.csv")), "sider", *["twosides"] * research]
    interactions = []
    if first_match(spark, raw, "ddinter/*.csv"):
        rows = kept(spark, readers.canonical(readers.curated(readers.delimited(spark, f"{raw}/ddinter/*.csv")), by_name), out, "curated_rows")
        kept(spark, readers.unmatched_sides(rows), out, "unmatched_curated")
        known = rows.where("a IS NOT NULL AND b IS NOT NULL").drop("drug_a_name", "drug_b_name").withColumnsRenamed({"a": "drug_a_name", "b": "drug_b_name"})
        best = kept(spark, pairs.best_rows(pairs.orient(known, "drug_a_name", "drug_b_name"), ["drug_a_name", "drug_b_name", "severity"], [F.col("record_id")]), out, "curated")
        interactions.append(best)
        covered.append(("ddinter", readers.said_names(rows), rows.count(), best.count()))
    if research:
        path = first_match(spark, raw, "twosides/TWOSIDES.csv.xz", "twosides/TWOSIDES.csv.gz", "twosides/TWOSIDES.csv")
        if not path:
            raise FileNotFoundError(f"research needs the statistical file in {raw}/twosides")
        table = readers.fields(archives.lines(spark, path), ",") if path.endswith(".xz") else readers.delimited(spark, path)
        rows, rejects = readers.statistical(table, by_name, by_id, list(excluded))
        rows = kept(spark, rows, out, "statistical")
        interactions.append(rows)
        kept(spark, rejects, out, "rejects_statistical")
        said = kept(spark, readers.said_names(readers.canonical(readers.above(table, list(excluded)), by_name, by_id)), out, "names_statistical")
        kept(spark, said.where("n > 0").select("name", F.col("n").alias("rows_affected")).orderBy(F.desc("rows_affected"), "name"), out, "unmatched_statistical")
        covered.append(("twosides", said, table.count(), rows.count()))
    if interactions:
        both = union_all(interactions)
        empty = [F.lit(None).cast("string").alias(c) for c in readers.INTERACTIONS if c not in both.columns]
        tables["interactions"] = kept(spark, both.select("*", *empty).select(*readers.INTERACTIONS), out, "interactions")
    effects, known = first_match(spark, raw, "sider/meddra_all_se.tsv.gz", "sider/meddra_all_se.tsv"), first_match(spark, raw, "sider/drug_names.tsv")
    if effects and known:
        called = readers.delimited(spark, known, "\t", ["stitch", "drug_name"], quoted=False).select("*", row_place().alias("place"))
        rows = readers.side_effects(readers.delimited(spark, effects, "\t", EFFECTS, quoted=False), called)
        rows = kept(spark, rows.join(aliases.withColumnRenamed("alias", "drug_name"), "drug_name", "left"), out, "side_effect_rows")
        said, rows_in = readers.said_names(rows.withColumn("drug_name", F.coalesce("drug_name", F.lit("(no name)"))), (("drug_name", "canonical"),)), rows.count()
        lost = rows.where("canonical IS NULL").groupBy(F.coalesce("drug_name", F.lit("(no name)")).alias("name")).agg(F.count(F.lit(1)).alias("rows_affected"))
        kept(spark, lost, out, "unmatched_side_effects")
        rows = rows.where("canonical IS NOT NULL").select(F.col("canonical").alias("drug_name"), "side_effect_name", "umls_cui", "source", "record_id")
        tables["side_effects"] = kept(spark, pairs.best_rows(rows, ["drug_name", "side_effect_name"], [F.col("record_id")]), out, "side_effects")
        covered.append(("sider", said, rows_in, tables["side_effects"].count()))
    sources = {k: said_of(spark, raw).get(k, {}) for k in used}
    if covered:
        found = kept(spark, union_all([voc.coverage(said, n, left).withColumn("source", F.lit(source)) for source, said, n, left in covered]), out, "coverage")
        for r in found.collect():
            sources[r.source] |= {k: v for k, v in r.asDict(recursive=True).items() if k != "source"}
    report = checked(spark, tables, aliases, out)
    version = sources["rxnorm"].get("version")
    provenance.write(spark, out, report, "full", profile="research" if research else "public", sources=sources, source_order=used, vocabulary_version=version, not_for_redistribution=research, built_at=datetime.date.today().isoformat())
    return report
