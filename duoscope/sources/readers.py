"""Readers of raw files and the steps that make canonical tables of them. All columns are read as text; ids stay text."""

from __future__ import annotations

import io
import lzma
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import content_ids, digest
from ..functions.text import clean, number, tier
from ..operators import names, pairs

#: Columns of interactions, in order.
INTERACTIONS = ("drug_a_name", "drug_b_name", "drug_a_rxcui", "drug_b_rxcui", "condition_id", "condition_name", "severity", "mechanism", "prr", "reports", "frequency", "source", "record_id")
# Headers of the statistical file (one is misspelt in the published file) and of the curated ones.
STATISTICAL = {
    "drug_1_rxnorn_id": "drug_a_rxcui", "drug_1_rxnorm_id": "drug_a_rxcui", "drug_1_concept_name": "drug_a_name", "drug_2_rxnorm_id": "drug_b_rxcui", "drug_2_concept_name": "drug_b_name",
    "condition_meddra_id": "condition_id", "condition_concept_name": "condition_name", "PRR": "prr", "A": "reports", "mean_reporting_frequency": "frequency",
}
CURATED = {"DDInterID_A": "id_a", "Drug_A": "drug_a_name", "DDInterID_B": "id_b", "Drug_B": "drug_b_name", "Level": "severity", "Mechanism": "mechanism"}


def tolerant(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a map that df has, under their new names; the others are left out."""
    return df.select([F.col(f"`{c}`").alias(columns[c]) for c in df.columns if c in columns])


def delimited(spark: SparkSession, paths: str | list[str], sep: str = ",", columns: list[str] | None = None, quoted: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A text table; with columns, the files have no header. Empty values are null; gz is read as it is."""
    options = {"sep": sep, "header": str(columns is None).lower(), "encoding": encoding, "quote": '"' if quoted else "", "escape": '"' if quoted else "\\", "multiLine": "false"}
    reader = spark.read.options(**options)
    return (reader if columns is None else reader.schema(", ".join(f"`{c}` string" for c in columns))).csv(paths)


def rrf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of fields that a bar ends, without header or quotes; empty fields are empty texts."""
    made = delimited(spark, path, "|", [*columns, "_end"], quoted=False).drop("_end")
    return made.select([F.coalesce(c, F.lit("")).alias(c) for c in columns])


def archived(spark: SparkSession, path: str, member: str = ".*", encoding: str = "utf-8") -> DataFrame:
    """line and value of the text in zip and xz files: one task a file, one batch of lines at a time.

    Such files can't be split and are read as one value, so one over 2 GB is an error; unpack it first.
    """
    kind = "file string, line bigint, value string"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for df in batches:
            for name, content in zip(df["path"], df["content"]):
                if name.endswith(".zip"):
                    z = zipfile.ZipFile(io.BytesIO(content))
                    streams = [z.open(n) for n in sorted(z.namelist()) if re.fullmatch(member, n)]
                else:
                    streams = [lzma.open(io.BytesIO(content))]
                for stream in streams:
                    held, at = [], 0
                    for text in io.TextIOWrapper(stream, encoding=encoding, newline="\n"):
                        held.append(text.rstrip("\r\n"))
                        if len(held) == 10_000:
                            yield pd.DataFrame({"file": name, "line": range(at, at + len(held)), "value": held})
                            at, held = at + len(held), []
                    if held:
                        yield pd.DataFrame({"file": name, "line": range(at, at + len(held)), "value": held})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, kind)


def fields(lines: DataFrame, sep: str, columns: list[str] | None = None) -> DataFrame:
    """Columns of lines (file, line or offset, value) without quoting; without columns, each file's first line names them (they must agree)."""
    if columns is None:
        first = F.col("offset" if "offset" in lines.columns else "line") == 0
        columns = lines.where(first).orderBy("file").first()["value"].split(sep)
        lines = lines.where(~first)
    parts = F.split("value", "\\Q" + sep + "\\E", -1)
    return lines.select([F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def canonical(df: DataFrame, by_name: DataFrame, by_id: DataFrame | None = None) -> DataFrame:
    """df with a and b: canonical names of both sides, by id first, else by cleaned name; null where neither is known.
    by_name and by_id: (key, canonical), one row a key."""
    for side in ("a", "b"):
        ids = by_id if by_id is not None and f"drug_{side}_rxcui" in df.columns else by_name.where("false")
        ident = f"drug_{side}_rxcui" if f"drug_{side}_rxcui" in df.columns else f"drug_{side}_name"
        df = names.priority_lookup(df, ident, f"drug_{side}_name", names.dimension(ids), names.dimension(by_name), side)
    return df


def said_names(df: DataFrame, sides: tuple[tuple[str, str], ...] = (("drug_a_name", "a"), ("drug_b_name", "b"))) -> DataFrame:
    """(name, canonical, n): each cleaned name of the sides (its column, that of its canonical name). canonical is null where a row
    has none for the name, and n then counts those rows, one for each side; else n is 0. Null names count as none."""
    side = F.explode(F.array(*[F.struct(F.when(F.col(x).isNotNull(), clean(F.col(x))).alias("name"), F.col(y).alias("canonical")) for x, y in sides]))
    each = df.select(side.alias("s")).select("s.*").where("name IS NOT NULL").groupBy("name").agg(F.max("canonical").alias("canonical"), F.count_if(F.col("canonical").isNull()).alias("n"))
    return each.withColumn("canonical", F.when(F.col("n") == 0, F.col("canonical")))


def unmatched_sides(df: DataFrame) -> DataFrame:
    """name and rows_affected of the names that no canonical name was found for; a row counts once for each side."""
    return said_names(df).where("n > 0").select("name", F.col("n").alias("rows_affected")).orderBy(F.desc("rows_affected"), "name")


def above(raw: DataFrame, excluded: list[str], least_prr: float = 2.0, least_reports: int = 5) -> DataFrame:
    """The rows of a raw statistical table that its thresholds and excluded events let pass, under the names of interactions."""
    rows = tolerant(raw, STATISTICAL)
    score, n = F.coalesce(number(F.col("prr")), F.lit(0.0)), F.coalesce(number(F.col("reports")), F.lit(0.0)).cast("bigint")
    return rows.where((score >= least_prr) & (n >= least_reports) & ~F.coalesce(clean(F.col("condition_name")).isin(excluded), F.lit(False)))


def statistical(raw: DataFrame, by_name: DataFrame, by_id: DataFrame, excluded: list[str], least_prr: float = 2.0, least_reports: int = 5, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Interactions of a raw statistical table, and reason and n of the rows that each rule refused.

    Per pair and event the row with the highest score stays, ties by reports, then by the raw row; then the k best events.
    Record ids hash the raw row's identity alone, so no threshold changes them.
    """
    rows = tolerant(raw, STATISTICAL)
    text = lambda c: F.coalesce(F.col(c), F.lit("nan"))  # noqa: E731  what the raw identity holds for a missing value
    score, n = F.coalesce(number(F.col("prr")), F.lit(0.0)), F.coalesce(number(F.col("reports")), F.lit(0.0)).cast("bigint")
    rows = rows.withColumns({"prr": score, "reports": n, "frequency": number(F.col("frequency")), "condition_name": clean(F.col("condition_name"))})
    rows = canonical(rows, by_name, by_id)
    rules = [("prr", F.col("prr") < least_prr), ("min_reports", F.col("reports") < least_reports), ("administrative", F.col("condition_name").isin(excluded)), ("unmatched", F.col("a").isNull() | F.col("b").isNull()), ("self_pair", F.col("a") == F.col("b"))]
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rejects = pairs.reject_counts(rows.withColumns({"_a": low, "_b": high}), rules, ["_a", "_b"], "condition_id", k)
    kept = pairs.charge(rows, rules).where("reason IS NULL").drop("reason")
    kept = kept.withColumn("_raw", F.concat_ws("|", *[text(c).cast("string") if c != "prr" else F.col("prr").cast("string") for c in ("drug_a_rxcui", "drug_b_rxcui", "condition_id")], F.col("prr").cast("string"), F.col("reports").cast("string")))
    turned = pairs.orient(kept, "a", "b", (("drug_a_rxcui", "drug_b_rxcui"),)).drop("drug_a_name", "drug_b_name").withColumnsRenamed({"a": "drug_a_name", "b": "drug_b_name"})
    order = [*pairs.falling("prr"), *pairs.falling("reports"), F.col("_raw"), F.col("frequency")]
    best = pairs.best_rows(turned, ["drug_a_name", "drug_b_name", "condition_id"], order)
    top = pairs.top_rows(best, ["drug_a_name", "drug_b_name"], [F.desc("prr"), F.desc("reports"), F.col("_raw")], k).drop("position")
    nth = F.row_number().over(Window.partitionBy("_raw").orderBy("drug_a_name", "drug_b_name", "condition_id"))
    ident = F.concat(F.lit("TS-"), digest([F.col("_raw")]), F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""))
    done = top.withColumns({"record_id": ident, "severity": tier(F.col("prr")), "source": F.lit("TWOSIDES"), "mechanism": F.lit(None).cast("string")})
    return done.select(*INTERACTIONS), rejects


def curated(raw: DataFrame) -> DataFrame:
    """One row for each pair of ids and grade of raw curated tables, oriented by id; a grade that is none is Unknown."""
    rows = tolerant(raw, CURATED)
    if "mechanism" not in rows.columns:
        rows = rows.withColumn("mechanism", F.lit(None).cast("string"))
    swap = F.col("id_a") > F.col("id_b")
    both = (("id_a", "id_b"), ("drug_a_name", "drug_b_name"))
    moved = {x: F.when(swap, F.col(y)).otherwise(F.col(x)) for x, y in both} | {y: F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in both}
    rows = rows.withColumns(moved).withColumns({c: clean(F.col(c)) for c in ("drug_a_name", "drug_b_name")})
    grade = F.trim("severity")
    rows = rows.withColumns({"severity": F.when(grade.isin("Major", "Moderate", "Minor"), grade).otherwise("Unknown"), "condition_name": F.lower(F.coalesce("mechanism", F.lit("interaction"))), "source": F.lit("DDInter")})
    one = pairs.best_rows(rows, ["id_a", "id_b", "severity"], [F.col("drug_a_name"), F.col("drug_b_name"), F.col("condition_name")])
    return content_ids(one, "DDI")


def side_effects(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Preferred terms of raw side effects, one row for each compound and term. raw: the six columns of the published
    file with stitch, kind, cui and term among them; known: (stitch, drug_name). Of equal ids the last row counts where
    known has a column place that tells which is last, else the largest name."""
    terms = raw.where("kind = 'PT'").select("stitch", clean(F.col("term")).alias("side_effect_name"), F.col("cui").alias("umls_cui"))
    one = pairs.best_rows(terms, ["stitch", "side_effect_name"], [F.col("umls_cui")])
    called = clean(F.col("drug_name"))
    named = known.groupBy("stitch").agg((F.max_by(called, F.col("place")) if "place" in known.columns else F.max(called)).alias("drug_name"))
    return content_ids(one.join(named, "stitch", "left").withColumn("source", F.lit("SIDER")), "SIDER")


def synonyms(raw: DataFrame, column: str) -> Column:
    """A list that bars separate, cleaned, blank ones left out; null is an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(raw[column], F.lit("")), r"\|"), clean), lambda x: x != "")


def leads(concepts: DataFrame, relations: DataFrame, salts: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(RXCUI, parts): the sorted names of the ingredients that each concept leads to in one step, an ingredient to itself; and
    the ingredients themselves (target, called, generic). salts: names of ingredients that go under another name."""
    live = concepts.where("LAT = 'ENG' AND SUPPRESS NOT IN ('Y', 'O') AND SAB = 'RXNORM' AND TTY = 'IN'")
    ingredient = live.groupBy(F.col("RXCUI").alias("target")).agg(F.max(clean(F.col("STR"))).alias("called")).withColumn("generic", F.col("called"))
    if salts:
        ingredient = ingredient.replace(salts, subset=["generic"])
    steps = relations.where("SAB = 'RXNORM' AND RELA IN ('has_form', 'has_tradename', 'part_of')").select(F.col("RXCUI1").alias("RXCUI"), F.col("RXCUI2").alias("target"))
    own = ingredient.select(F.col("target").alias("RXCUI"), "target")
    found = steps.join(own.select("RXCUI"), "RXCUI", "left_anti").unionByName(own).join(ingredient, "target")
    return found.groupBy("RXCUI").agg(F.sort_array(F.collect_set("generic")).alias("parts")), ingredient


def vocabulary(concepts: DataFrame, relations: DataFrame, salts: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Aliases (name_lower, generic_name, rxcui, kind) and combinations (name_lower, ingredients) of a terminology.

    concepts: RXCUI, LAT, SAB, TTY, CODE, STR, SUPPRESS; relations: RXCUI1, RXCUI2, RELA, SAB. A name stands for the set of
    ingredients that its concept leads to in one step; one that stands for several sets is left out. Ingredients in salts go
    under the name given there, with that name's own id where it is an ingredient, else the smallest of theirs.
    """
    live = concepts.where("LAT = 'ENG' AND SUPPRESS NOT IN ('Y', 'O') AND SAB IN ('RXNORM', 'MTHSPL')")
    led, ingredient = leads(concepts, relations, salts)
    atoms = live.where("(SAB = 'RXNORM' AND TTY IN ('IN', 'PIN', 'BN', 'MIN', 'SY', 'TMSY')) OR (SAB = 'MTHSPL' AND TTY = 'SU')").join(led, "RXCUI")
    named = atoms.groupBy(clean(F.col("STR")).alias("name_lower")).agg(F.collect_set("parts").alias("sets"), F.min(F.concat_ws(":", "SAB", "TTY")).alias("kind")).where(F.size("sets") == 1).withColumn("parts", F.col("sets")[0])
    itself_called = F.col("called") == F.col("generic")
    ids = ingredient.groupBy(F.col("generic").alias("generic_name")).agg(F.coalesce(F.min(F.when(itself_called, F.col("target"))), F.min("target")).alias("rxcui"), F.some(itself_called).alias("_own"))
    one = named.where(F.size("parts") == 1).select("name_lower", F.col("parts")[0].alias("generic_name"), "kind").join(ids.drop("_own"), "generic_name", "left")
    itself = ids.select(F.col("generic_name").alias("name_lower"), "generic_name", F.when(F.col("_own"), "RXNORM:IN").otherwise("SALT_GROUP").alias("kind"), "rxcui")
    aliases = one.join(itself.select("name_lower"), "name_lower", "left_anti").select(itself.columns).unionByName(itself).select("name_lower", "generic_name", "rxcui", "kind")
    return aliases, named.where(F.size("parts") > 1).select("name_lower", F.array_join("parts", " + ").alias("ingredients"))
