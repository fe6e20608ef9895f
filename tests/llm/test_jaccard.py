"""The Jaccard join against brute force: groups of near copies, shared passages, and rows out of the ordinary."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from duoscope.llm import jaccard


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, k, percent):
    sets, parent = [shingles(t, k) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and 100 * len(sets[i] & sets[j]) >= percent * union:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {docs[i][0]: (len(sets[i]), docs[root(i)][0]) for i in range(len(docs))}


def documents(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(15)]
    docs = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w) + (" " + rng.choice(shared) if rng.random() < 0.4 else "")))
    return docs + [(420, None), (421, ""), (422, " \n"), (423, "one two"), (424, "one two"), (425, "ONE two"), (426, "two one")]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_same_as_brute_force(spark, seed, k, percent):
    docs = documents(seed)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, component_id int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, k=k, percent=percent).collect()}
    assert got == brute(docs, k, percent)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (4, "other words stand here now"), (None, text), (5, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.keep_one(df, jaccard.near_duplicates(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, text), (4, "other words stand here now"), (None, text), (5, None), (6, None)], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = jaccard.near_duplicates(df)
    assert found.collect() == [] and jaccard.keep_one(df, found).collect() == []


def test_unrelated_texts_of_one_id_and_copies_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " more"), (None, c), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(df)
    assert len({r.component_key for r in found.collect()}) == 3
    kept = jaccard.keep_one(df, found).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(5, b), (3, a + " more"), (None, c)], key=repr)


def test_sets_whose_names_are_the_same(spark, monkeypatch):
    """Names of two bits in the first turn and of a few in the next ones: unrelated sets stay apart."""
    whole = jaccard.set_name
    monkeypatch.setattr(jaccard, "set_name", lambda turn: F.pmod(whole(turn), F.lit(4 if turn == 0 else 1000)) + 1000 * turn)
    docs = documents(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    found = jaccard.near_duplicates(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(docs, 4, 85)
    kept = jaccard.keep_one(df, found)
    assert {r.doc_id for r in kept.collect()} == {c for n, c in brute(docs, 4, 85).values() if n} | {420, 421, 422}


def test_pairs_of_a_group_of_near_copies_grow_with_its_documents(spark, monkeypatch):
    """Copies with one to three words changed, of which many pairs link and many just do not."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    made, whole = [], jaccard.Join.check
    monkeypatch.setattr(jaccard.Join, "check", lambda self, pairs, texts: (made.append(pairs.count()), whole(self, pairs, texts))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == brute(docs, 4, 85)
    assert sum(made) < 10 * len(docs)


def test_steps_leave_no_shuffle_files(spark):
    """Those of a step are deleted as it ends, not when the driver's memory is collected."""
    files = lambda: {f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if f.endswith(".data")}
    scratch, before = jaccard.Scratch(spark, "test"), files()
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    scratch.keep(rows, "rows")
    end = time.monotonic() + 10  # the files go in the background
    while files() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not files() - before
    scratch.drop()


def test_only_texts_of_sets_in_a_pair_are_dealt(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"w{i // 2} b c d e") for i in range(20)], "sid long, text string")
    pairs = spark.createDataFrame([(1, 0), (3, 2), (5, 1)], "a long, b long")
    join = jaccard.Join(spark, texts, 4, 85)
    assert sorted(r.sid for r in join.paired(pairs, texts).collect()) == [0, 1, 2, 3, 5]
    links = sorted(map(tuple, join.check(pairs, texts).collect()))
    monkeypatch.setattr(jaccard, "SMALL", 0)  # too many to be broadcast
    assert join.paired(pairs, texts).count() == 20
    assert links == sorted(map(tuple, join.check(pairs, texts).collect())) == [(1, 0), (3, 2)]
    join.scratch.drop()


def test_long_sets_that_cannot_link_are_not_compared_by_their_texts(spark, monkeypatch):
    """Unrelated long texts that share a passage: their sets fill the bitmap of one width. Copies around a power of two link still."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, " ".join(f"x{rng.randrange(10**9)}" for _ in range(4000)) + " " + passage) for i in range(12)]
    for i, n in enumerate((1040, 2060, 4110)):
        words = [f"y{rng.randrange(10**9)}" for _ in range(n)]
        docs += [(100 + 2 * i, " ".join(words)), (101 + 2 * i, " ".join(words[: n * 9 // 10]))]
    compared, whole = [], jaccard.Join.paired

    def paired(self, pairs, rows):
        if "text" in rows.columns:
            compared.extend(map(tuple, pairs.collect()))
        return whole(self, pairs, rows)

    monkeypatch.setattr(jaccard.Join, "paired", paired)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == brute(docs, 4, 85)
    assert len(compared) <= 6  # three pairs link; before, those of the twelve others came along
