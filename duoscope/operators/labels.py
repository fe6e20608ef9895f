"""Evidence from labels: which label counts, who is named in its sections and in what words, the strongest class of a
pair, what that settles, and how classes and grades agree.

Names are found by an automaton over all aliases, which reads a text once whatever their number. It is sent to the tasks
in blocks of a bounded number of aliases; more aliases are more blocks, each a pass over the sections.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import BOUNDARY, GRADE, SECTIONS, WRITTEN, label_class, lookup, snippet, strength
from ..functions.text import rate

#: Aliases of a block, and the characters around a mention that a clause is sought in.
BLOCK, WINDOW = 100_000, 250
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789-")
CLAUSE_END = re.compile(BOUNDARY, re.IGNORECASE)


def choose_label(labels: DataFrame, by: list[str], application: str, effective: str, value: str) -> DataFrame:
    """One label of each group: one of a new drug application before others, then the newest, then the largest value.
    A partial maximum, so a group of many labels is no burden; a null date counts as the oldest."""
    order = F.struct(F.coalesce(F.col(application).startswith("NDA"), F.lit(False)).alias("nda"), F.coalesce(F.col(effective), F.lit("")).alias("at"), F.col(value).alias("value"))
    return labels.groupBy(*by).agg(F.max(order).alias("best")).select(*by, F.col("best.value").alias(value), "best.nda")


def strongest(matches: DataFrame, by: list[str], name: str) -> DataFrame:
    """The strongest class of each group."""
    return matches.groupBy(*by).agg(F.min_by(F.col(name), strength(F.col(name))).alias(name))


def class_grid(rows: DataFrame, name: str, grade: str) -> DataFrame:
    """How often each class meets each grade, and over all rows the share of agreeing ones and how many grades are lower."""
    rank = F.create_map(*[F.lit(x) for pair in {"Minor": 1, "Moderate": 2, "Major": 3}.items() for x in pair])
    stands = lookup(GRADE, F.col(name))
    both = stands.isNotNull() & F.col(grade).isNotNull()
    cells = rows.groupBy(lookup(WRITTEN, F.col(name)).alias("class"), F.coalesce(F.col(grade), F.lit("no graded record")).alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("mapped"), F.count_if(both & (stands == F.col(grade))).alias("agree"), F.count_if(both & (rank[F.col(grade)] < rank[stands])).alias("lower"))
    total = cells.agg(F.sum("mapped").alias("m"), F.sum("agree").alias("a"), F.sum("lower").alias("l"))
    return cells.crossJoin(F.broadcast(total)).select("class", "grade", "n", rate(F.col("a"), F.col("m")).alias("agreement"), F.col("l").alias("lower_than_label"))


def choose_labels(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The label that speaks for each product: of a single ingredient whose name leads to the product, with some section
    that is read; a new drug application before others, then the newest, then the first found.

    found: drug, place (order of the search), set_id, version, effective, application, brand, generics (names of the
    ingredients), sections (map of texts); vocabulary: alias, name."""
    told = F.map_filter("sections", lambda k, v: k.isin(*SECTIONS) & v.isNotNull() & (v != ""))
    rows = found.where(F.size("generics") == 1).withColumns({"_told": told, "_generic": F.trim(F.lower(F.col("generics")[0]))}).where(F.size("_told") > 0)
    own = rows.join(vocabulary.select(F.col("alias").alias("_generic"), F.col("name").alias("drug")).distinct(), ["_generic", "drug"], "left_semi")
    order = F.struct(F.coalesce(F.col("application").startswith("NDA"), F.lit(False)), F.coalesce("effective", F.lit("")), -F.col("place"))
    kept = F.struct("set_id", "version", "effective", "application", "brand", F.col("_told").alias("sections"))
    return own.groupBy("drug").agg(F.max_by(kept, order).alias("l")).select("drug", "l.*")


def section_rows(labels: DataFrame, keep: list[str], sections: str = "sections") -> DataFrame:
    """One row for each section that is read: the columns keep, section, place (its order) and text."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(SECTIONS) for x in (k, i)])
    return labels.select(*keep, F.explode(sections).alias("section", "text")).withColumn("place", order[F.col("section")]).where("place IS NOT NULL")


def clause(text: str, start: int, end: int) -> str:
    """The words around a mention up to the nearest clause end on each side. In a table whose row gives an intervention
    before its examples, a mention among the examples has that intervention in front."""
    left = CLAUSE_END.split(text[max(0, start - WINDOW) : start])[-1]
    right = CLAUSE_END.split(text[end : end + WINDOW], maxsplit=1)[0]
    said = (left + text[start:end] + right).strip()
    before = text[max(0, start - 3000) : start]
    row, examples, since = before.lower().rpartition("examples")
    if examples and "clinical impact" not in since:
        at = row.rfind("intervention")
        if at >= 0:
            return f"{before[at : len(row)].strip()} … {said}"
    return said


def named_in(low: str, automaton: ahocorasick.Automaton) -> list[tuple[str, str, int, int]]:
    """name, alias, start and end of each mention in a lower-case text. A mention is a whole word; of one name's aliases
    the leftmost counts, of those the longest, and none that overlaps the one before."""
    by: dict[str, list[tuple[int, int, str]]] = {}
    for last, (alias, names) in automaton.iter(low):
        start, end = last + 1 - len(alias), last + 1
        if (start and low[start - 1] in WORD) or (end < len(low) and low[end] in WORD):
            continue
        for name in names:
            by.setdefault(name, []).append((start, -end, alias))
    found = []
    for name, places in by.items():
        free = 0
        for start, end, alias in sorted(places):
            if start >= free:
                found.append((name, alias, start, -end))
                free = -end
    return found


def mentions(sections: DataFrame, aliases: DataFrame, keep: list[str], least: int = 4, block: int = BLOCK) -> DataFrame:
    """name, alias, start, end and clause of every mention in the rows' text, with the columns keep.

    aliases: alias, name; those shorter than `least` name nobody. Null text mentions nobody."""
    usable = aliases.select(F.lower("alias").alias("alias"), "name").where((F.char_length("alias") >= least) & F.col("name").isNotNull()).distinct()
    n = usable.count()
    blocks = max(1, -(-n // block))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sections.select(*keep).schema), "name string, alias string, start int, end int, clause string"])
    made = None
    for i in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i).groupBy("alias").agg(F.collect_list("name").alias("names")).collect()
        shared = sections.sparkSession.sparkContext.broadcast([(r["alias"], r["names"]) for r in rows])

        def find(batches, shared=shared):
            automaton = ahocorasick.Automaton()
            for alias, names in shared.value:
                automaton.add_word(alias, (alias, names))
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                index, out = [], []
                for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for name, alias, start, end in named_in(text.lower(), automaton) if text else ():
                        index.append(k)
                        out.append((name, alias, start, end, clause(text, start, end)))
                at = pa.array(index, pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))] if out else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *columns], names=[*batch.schema.names[:-1], "name", "alias", "start", "end", "clause"])

        part = sections.select(*keep, "text").mapInArrow(find, schema)
        made = part if made is None else made.unionAll(part)
    return made


def find_matches(sections: DataFrame, aliases: DataFrame, keep: list[str], width: int = 240, block: int = BLOCK) -> DataFrame:
    """What each section says about each name that it mentions: the first mention of the strongest class, with its alias and
    a snippet. sections: the columns keep (which tell the sections apart, section among them) and text."""
    found = mentions(sections, aliases, keep, block=block).withColumn("class", label_class(F.col("section"), F.col("clause")))
    best = F.min_by(F.struct("alias", "clause", "class"), F.struct(strength(F.col("class")), "start"))
    rows = found.groupBy(*keep, "name").agg(best.alias("m"))
    return rows.select(*keep, "name", "m.alias", snippet(F.col("m.clause"), F.col("m.alias"), width).alias("snippet"), "m.class")


def pair_evidence(pairs: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the strongest class that either label gives the other name (not_mentioned where none does),
    the label, section, alias and snippet it comes from, the number of matches, and whether each label was found.

    labels: drug; matches: drug (of the label), place, section, name, alias, snippet, class. Equal classes: a's label
    before b's, then the order of sections."""
    sides = pairs.select("a", "b").distinct()
    both = sides.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("drug"), F.col("b").alias("name")).unionAll(sides.select("a", "b", F.lit(1), "b", "a"))
    named = both.join(matches, ["drug", "name"])
    best = F.min_by(F.struct("drug", "section", "alias", "snippet", "class"), F.struct(strength(F.col("class")), "side", "place"))
    per = named.groupBy("a", "b").agg(best.alias("best"), F.count(F.lit(1)).alias("matches"))
    known = labels.select("drug").distinct()
    out = pairs.join(per, ["a", "b"], "left")
    for side in ("a", "b"):
        out = out.join(known.select(F.col("drug").alias(side), F.lit(True).alias(f"label_{side}")), side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", F.lit(False)))
    return out.withColumns({"class": F.coalesce("best.class", F.lit("not_mentioned")), "matches": F.coalesce("matches", F.lit(0).cast("bigint"))})


def decide(expected: Column, name: Column, a: Column, b: Column, label_a: Column, label_b: Column) -> Column:
    """struct<reference, reason>: whether labels settle what a pair was expected to be.

    An expected interaction is settled by guidance alone; a control, weakly, by two labels that are both silent. Whatever
    is neither is unclear, and the reason says why."""
    written = lookup(WRITTEN, name)
    lacking = F.concat(F.lit("no single-ingredient label found for "), F.concat_ws(", ", F.when(~label_a, a), F.when(~label_b, b)))
    both, guided = label_a & label_b, strength(name) <= strength(F.lit("monitor_or_adjust"))
    say = lambda reference, reason: F.struct(F.lit(reference).alias("reference"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    # The wording of the reasons.
    positive = (
        F.when(guided, say("interaction", F.concat(F.lit("label: "), written)))
        .when(name == "mentioned_without_guidance", say("unclear", "named in a label, but without guidance the heuristic recognises"))
        .when(~both, say("unclear", lacking))
        .otherwise(say("unclear", "neither label names the other drug (it may be covered only by a class)"))
    )
    control = F.when(~both, say("unclear", lacking)).when(name == "not_mentioned", say("none_weak", "not mentioned in either label (weak evidence of no interaction)")).otherwise(say("unclear", F.concat(F.lit("negative control, but a label says: "), written)))
    return F.when(expected == "interaction", positive).otherwise(control)
