"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from duoscope.llm import suffixes


def brute(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(docs, raw):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def documents(seed):
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice("abcdeé \n") for _ in range(n))

    shared = [some(rng.randint(30, 120)) for _ in range(6)]
    docs = []
    for i in range(100):
        parts = [rng.choice([some(rng.randint(0, 50)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 8))]
        docs.append((i, "".join(parts)))
    return docs + [(200, None), (201, ""), (202, "ab" * 200), (203, "x" * 300), (204, docs[5][1]), (5, docs[5][1]), (5, docs[6][1]), (None, docs[7][1])]


@pytest.mark.parametrize(("seed", "length", "k", "hot"), [(1, 40, 12, 20_000), (2, 40, 30, 3)])
def test_same_as_brute_force(spark, seed, length, k, hot):
    docs = documents(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string").repartition(5)
    rows = suffixes.remove_repeats(df, k=k, length=length, batches=3, hot=hot).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows]
    assert sorted(got, key=repr) == brute(docs, length)


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), batches=2).collect() == []


def test_digest_columns(spark, tmp_path):
    from duoscope.llm.queries import op2_suffix_dedup

    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    rows = [(1, "x" + long), (2, long + "y"), (3, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_dedup(spark, str(tmp_path)).collect()}
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("x", "y", "short")}
    assert got == {1: (501, 500, 1, digest["x"]), 2: (501, 500, 1, digest["y"]), 3: (5, 0, 0, digest["short"])}


def test_has_passage_equals_brute_force(spark):
    docs = documents(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = suffixes.remove_repeats(df, k=24, length=80, batches=2, passage=40).collect()
    want = sorted((doc, n, gone > 0) for doc, n, gone, _, _ in brute(docs, 40) if doc is not None)
    assert sorted((r.doc_id, r.n_bytes, r.has_passage) for r in rows if r.doc_id is not None) == want
    assert {(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in rows} == {x[:3] for x in brute(docs, 80)}


def test_a_batch_goes_into_stored_levels(spark, tmp_path):
    """Each insertion opens the family anew; its matches are the grams that the batches so far hold twice."""
    rng, seen, root = random.Random(4), Counter(), f"{tmp_path}/family"
    for n in range(1, 6):
        batch = [(rng.randint(0, 40), rng.randint(0, 3)) for _ in range(12)]
        before, new = set(seen), Counter(g for g, _ in batch)
        family = suffixes.Family(spark, root)
        got = {r.gram for r in family.insert(spark.createDataFrame(batch, "gram long, context long")).collect()}
        assert got == {g for g, c in new.items() if c > 1 or g in before}
        seen.update(new)
        assert sorted(suffixes.Family(spark, root).levels) == [i for i in range(4) if n >> i & 1]
    levels = suffixes.Family(spark, root)
    held = Counter()
    for rank in levels.levels:
        rows = levels.level(rank).collect()
        held.update({r.gram: 0 for r in rows})
        for r in rows:
            held[r.gram] += r.n
    assert held == seen


def test_family_stopped_while_a_list_is_written(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "family")
    family = suffixes.Family(spark, root)
    for n in range(2):
        family.insert(spark.createDataFrame([(n, n), (7, n)], "gram long, context long"))
    before = suffixes.Family(spark, root).levels
    assert before

    def stop(spark, path, text):
        (tmp_path / "family" / (path.rsplit("/", 1)[1] + ".half")).write_text(text[:3])
        raise OSError("stopped")

    monkeypatch.setattr(suffixes, "write_new", stop)
    with pytest.raises(OSError):
        family.insert(spark.createDataFrame([(9, 9)], "gram long, context long"))
    monkeypatch.undo()
    again = suffixes.Family(spark, root)
    assert again.levels == before
    late = suffixes.Family(spark, root)
    assert {r.gram for r in again.insert(spark.createDataFrame([(7, 5), (9, 9)], "gram long, context long")).collect()} == {7}
    with pytest.raises(FileExistsError):
        late.insert(spark.createDataFrame([(1, 1)], "gram long, context long"))


def test_fingerprints_tell_thue_morse_strings_apart():
    import numpy as np

    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for size in (400, 512, 1024, 4096):
        a = np.array([97 + b for b in bits[:size]], np.uint8)
        b = np.array([98 - b for b in bits[:size]], np.uint8)
        x, y = (int(suffixes.prints(suffixes.prefix_sums(z), np.array([0]), np.array([size]))[0]) for z in (a, b))
        assert bin(x ^ y).count("1") > 10
