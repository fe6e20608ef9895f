"""Language identification by Bayesian evidence fusion.

The posterior of each language combines
- the likelihood of the text's byte trigrams (letters in lower case, all else a space), tempered so that a long text
  counts as at most a fixed number of independent trigrams;
- the declared language, through how often texts of each language carry each declaration;
- the address suffix, through how often texts of each language come from each suffix;
- the prior of the host, smoothed towards that of its domain, and that towards all rows.
The last three come from one table of counts by host, domain, suffix, declaration and best language of the text, an
aggregation over all rows that is summed before its shuffle.

The trigram model is fitted on a sample of rows with a declaration: about `sample` distinct texts for each language at most,
chosen by a hash of the text, whole texts. Every declared language is told apart; each takes 256 KB of the model in a process. A
declaration counts by its language alone: en, EN and en-US are all en.

A row without any letter, or whose best posterior is below `least`, is not kept; with no declared language anywhere
there is nothing to choose from, language and posterior are null and no row is kept. Null evidence says nothing; nulls
in the text count as empty. Ties go to the language that sorts first. Repeated rows count as often as they stand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, same_rows, slices, tmp_name, utf8

BUCKETS = 1 << 16
#: Values (hosts, declarations, suffixes) whose table is sent to all executors, for up to ten languages (some 100 bytes
#: each), and fewer for more; a larger table is joined by a shuffle.
HOSTS = 50_000
LETTERS = np.full(256, 32, np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that begins at each byte, and whether it lies in one row and holds a letter."""
    n = len(buf)
    if n < 3:
        return np.zeros(n, np.int32), np.zeros(n, bool)
    m = LETTERS[buf].astype(np.uint32)
    h = m[:-2] * np.uint32(0x9E3779B1) + m[1:-1] * np.uint32(0x85EBCA77) + m[2:] * np.uint32(0xC2B2AE3D)
    bucket = np.zeros(n, np.int32)
    bucket[:-2] = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    good = np.zeros(n, bool)
    good[:-2] = (m[:-2] != 32) | (m[1:-1] != 32) | (m[2:] != 32)
    for back in (1, 2):
        ends = offs[1:] - back
        good[ends[ends >= 0]] = False
    return bucket, good


def small(table: DataFrame, size: int) -> DataFrame:
    """table, marked for broadcast if its rows, with a number for each language, are few."""
    return F.broadcast(table) if table.count() * max(10, size) <= HOSTS * 10 else table


def share_of(sample: int, count: int) -> int:
    """The bound below which hashes of 62 bits fall for some sample of count rows; whole numbers, so it is right at any count."""
    return min(1 << 62, max(1, (sample << 62) // count))


def model(rows: DataFrame, sample: int) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and the log-probability of each bucket in each of them."""
    counts = {r[0]: r[1] for r in rows.where(F.col("declared").isNotNull()).groupBy("declared").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[F.lit(x) for n in names for x in (n, share_of(sample, counts[n]))])
    # chosen by what the text is, then each distinct text once: copies are no reason for a larger or a lopsided sample
    picked = rows.where(F.col("declared").isin(names) & (F.shiftrightunsigned(F.xxhash64("text"), 2) < share[F.col("declared")]))
    picked = picked.select("declared", "text").dropDuplicates()

    def count(batches):
        for batch in batches:
            if not len(batch):
                continue
            buf, offs = utf8(batch.column(1))
            bucket, good = trigrams(buf, offs)
            number = {n: i for i, n in enumerate(names)}
            row = np.repeat(np.array([number[n] for n in batch.column(0).to_pylist()], np.int64), np.diff(offs))
            sums = np.bincount(row[good] * BUCKETS + bucket[good], minlength=1)
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(sums[hit], pa.int64())], names=["cell", "n"])

    table = picked.select("declared", "text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = table.sort_by("cell")
    cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
    grid = np.empty((len(names), BUCKETS), np.float32)
    at = np.searchsorted(cell, np.arange(len(names) + 1) * BUCKETS)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
        row = np.full(BUCKETS, 0.05)
        row[cell[a:b] - k * BUCKETS] += n[a:b]
        grid[k] = np.log(row / row.sum())
    return names, grid


def likelihood_column(spark, grid: np.ndarray, text: Column, strength: int) -> Column:
    """n (trigrams) and loglik (one for each language, tempered) of each text."""
    shared = spark.sparkContext.broadcast(grid)

    @arrow_udf("struct<n:bigint,loglik:array<double>>")
    def score(texts: pa.Array) -> pa.Array:
        table = shared.value
        buf, offs = utf8(texts)
        n, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(table)))
        for a, b in slices(offs):
            part, at = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            bucket, good = trigrams(part, at)
            n[a:b] = np.diff(np.concatenate([[0], np.cumsum(good)])[at])
            for k, row in enumerate(table):
                sums[a:b, k] = np.diff(np.concatenate([[0.0], np.cumsum(np.where(good, row[bucket], 0), dtype=np.float64)])[at])
        sums /= (1 + n / strength)[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(table), pa.int32()), pa.array(sums.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], names=["n", "loglik"])

    # evaluated once, also where a filter reads it
    return score.asNondeterministic()(text)


def argmax(values: Column, names: list[str]) -> Column:
    """The name at the first greatest place of an array."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(values, F.array_max(values)).cast("int"))


def identify(
    df: DataFrame, text: Column, declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None,
    sample: int = 2000, strength: int = 64, least: float = 0.5, out: str = "language",
) -> DataFrame:
    """df and a struct column out: lang, posterior, text_lang (by the text alone), trigrams (long), keep (boolean)."""
    none = F.lit(None).cast("string")
    if declared is not None:
        declared = F.nullif(F.lower(F.regexp_replace(F.trim(declared.cast("string")), "[-_].*", "")), F.lit(""))
    evidence = {"declared": declared, "host": host, "domain": domain, "suffix": suffix}
    slim = df.select(F.coalesce(text, F.lit("")).alias("text"), *[(none if c is None else c.cast("string")).alias(k) for k, c in evidence.items()])
    names, grid = model(slim, sample)
    kind = "struct<lang:string,posterior:double,text_lang:string,trigrams:bigint,keep:boolean>"
    if not names:
        return same_rows(df, out, lambda: F.from_json(F.lit('{"keep":false}'), kind))
    spark, size = df.sparkSession, len(names)
    guess = slim.select(*evidence, likelihood_column(spark, grid, F.col("text"), strength).alias("s")).where("s.n > 0")
    seen = guess.groupBy(*evidence, argmax(F.col("s.loglik"), names).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    seen = Scratch(spark, "langid").keep(seen, "counts")

    def by(*keys: str) -> DataFrame:
        """Counts of each language for each key, as arrays in the order of names."""
        return seen.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("double") for x in names]).alias("c"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    whole = by().collect()[0]["c"]
    prior = [(x + 1) / (sum(whole) + size) for x in whole]

    scratch = Scratch(spark, "langid")
    totals = F.array(*map(F.lit, whole))

    def likelihoods(name: str, value: str, out: str) -> tuple[DataFrame, Column]:
        """log P(value | language) for every value that a text with letters has, as out; and that of a value none has."""
        counts = scratch.keep(by(name).where(F.col(name).isNotNull()), name)
        n = counts.count()
        known = counts.select(F.col(name).alias(value), F.zip_with("c", totals, lambda c, w: F.ln((c + 1) / (w + n + 1))).alias(out))
        return small(known, size), F.array(*[F.lit(math.log(1 / (w + n + 1))) for w in whole])

    hosts = by("domain", "host").where("host IS NOT NULL")
    domains = by("domain").where("domain IS NOT NULL").select("domain", F.col("c").alias("d"))
    base = F.array(*map(F.lit, prior))
    smooth = lambda c, p, w: F.zip_with(c, p, lambda x, q: (x + w * q) / (total(c) + w))
    parent = F.when(F.col("d").isNull(), base).otherwise(smooth(F.col("d"), base, 20.0))
    table = hosts.join(domains, "domain", "left").groupBy("host").agg(F.first(F.transform(smooth(F.col("c"), parent, 10.0), F.ln)).alias("host_prior"))
    table = small(scratch.keep(table.withColumnRenamed("host", "host_key"), "hosts"), size)
    key, score, ready = tmp_name(df, "_host"), tmp_name(df, "_score"), tmp_name(df, "_prior")
    # the key and the evidence are taken from df's own rows before the join adds columns
    rows = df.withColumn(key, F.struct(*[(none if c is None else c.cast("string")).alias(k) for k, c in evidence.items()])).withColumn(score, likelihood_column(spark, grid, text, strength))
    table = table.withColumnsRenamed({"host_prior": ready, "host_key": key + "_key"})
    rows = rows.join(table, F.col(f"{key}.host") == F.col(key + "_key"), "left")

    zero, parts, extra = F.array(*[F.lit(0.0)] * size), [], []
    for name in ("declared", "suffix"):
        if evidence[name] is not None:
            value, found = tmp_name(df, f"_{name}_value"), tmp_name(df, f"_{name}_found")
            known, unseen = likelihoods(name, value, found)
            rows = rows.join(known, F.col(f"{key}.{name}") == F.col(value), "left")
            parts.append(F.when(F.col(f"{key}.{name}").isNull(), zero).otherwise(F.coalesce(F.col(found), unseen)))
            extra += [value, found]

    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joint = plus(F.col(f"{score}.loglik"), F.coalesce(F.col(ready), F.array(*[F.lit(math.log(p)) for p in prior])))
    for part in parts:
        joint = plus(joint, part)
    made = tmp_name(df, "_joint")
    rows = rows.withColumn(made, joint)
    best = F.array_max(F.col(made))
    posterior = 1.0 / F.aggregate(F.transform(made, lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    n = F.col(f"{score}.n")
    done = F.struct(argmax(F.col(made), names).alias("lang"), posterior.alias("posterior"), F.when(n > 0, argmax(F.col(f"{score}.loglik"), names)).alias("text_lang"), n.alias("trigrams"), ((n > 0) & (posterior >= least)).alias("keep"))
    return same_rows(rows, out, lambda: done).drop(key, key + "_key", score, ready, made, *extra)
