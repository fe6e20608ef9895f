"""Chunk deduplication: cuts against a byte-by-byte rolling hash, resistance to shifts, and which copy stays."""

import random

import numpy as np

from duoscope.llm import chunks


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_equals_the_rolling_form():
    raw = bytes(random.Random(1).randrange(256) for _ in range(300))
    h, want = 0, []
    for b in raw:
        h = (h * 2 + int(chunks.GEAR[b])) % 2**32
        want.append(h)
    assert chunks.gear(np.frombuffer(raw, np.uint8)).tolist() == want


def test_cuts_keep_their_bounds():
    for places, size in (([], 0), ([], 5), ([10, 20, 45, 300], 1000), (list(range(1000)), 1000)):
        ends = chunks.cuts(places, size, 32, 128)
        sizes = np.diff([0, *ends]).tolist()
        assert sum(sizes) == size and all(s <= 128 for s in sizes) and all(s >= 32 for s in sizes[:-1])


def test_shared_passages_are_found_after_insertions(spark):
    rng = random.Random(4)
    passage, own = prose(rng, 70), [prose(rng, 120) for _ in range(6)]
    docs = [(i, own[i]) for i in range(3)] + [(3 + i, own[3 + i][: 50 * i] + passage + own[3 + i][50 * i :]) for i in range(3)]
    docs += [(9, own[0]), (10, None), (11, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, start string")
    got = {r.doc_id: r for r in chunks.repeats(df).collect()}
    assert {3, 4, 5, 9} <= set(got) and got[3].n_removed == 0 and got[3].n_repeated > 100
    for doc in (4, 5):
        assert got[doc].n_removed > len(passage) / 2 and got[doc].sources == [3]
    assert got[9].n_removed == len(own[0].encode()) and got[9].sources == [0]
    assert not {1, 2, 10, 11} & {d for d, r in got.items() if r.n_repeated}
    left = df.join(chunks.repeats(df).select("doc_id", "removed"), "doc_id", "left")
    texts = {r.doc_id: r.t for r in left.select("doc_id", chunks.cut_text(left.text, left.removed).alias("t")).collect()}
    assert texts[9] == "" and texts[1] == own[1] and texts[10] is None


def test_repeated_rows_without_id_and_empty_table(spark):
    rng = random.Random(5)
    text = prose(rng, 80)
    df = spark.createDataFrame([(None, text), (7, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in chunks.repeats(df).collect()} == {7: 0, None: len(text)}
    assert chunks.repeats(df.limit(0)).collect() == []


def test_passages_of_51_words_are_covered_to_the_byte_wherever_they_stand(spark):
    rng = random.Random(6)
    docs, passages = [], []
    for i in range(150):
        passages.append(" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 6))) for _ in range(51)))
        for k in range(2):
            docs.append((2 * i + k, f"{prose(rng, rng.randint(0, 60))}{2 * k}{passages[i]}{2 * k + 1}{prose(rng, rng.randint(0, 60))}"))
    got = {r.doc_id: r for r in chunks.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, p in enumerate(passages):
        first, second = got[2 * i], got[2 * i + 1]
        at = docs[2 * i + 1][1].index(p)
        assert first.n_repeated == len(p) and first.n_removed == 0
        assert [(s.start, s.end) for s in second.removed] == [(at, at + len(p))] and second.sources == [2 * i]


def test_a_seed_is_carried_on_like_the_occurrence_that_goes_furthest(spark):
    rng = random.Random(8)
    passage = prose(rng, 60)
    # the smallest id shares only the middle of the passage with the others
    docs = [(1, "#" + passage[110:260] + "#" + prose(rng, 20)), (2, prose(rng, 30) + "2" + passage + "3"), (3, prose(rng, 20) + "4" + passage + "5"), (None, "6" + passage + "7")]
    got = {r.doc_id: r for r in chunks.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[None].n_removed == len(passage)
    assert got[2].n_repeated == got[3].n_repeated == got[3].n_removed == len(passage)


def test_rows_that_share_an_id_keep_what_is_theirs_alone(spark):
    rng = random.Random(9)
    shared, unique, other = prose(rng, 100), prose(rng, 100), prose(rng, 90)
    rows = [(1, shared), (5, shared), (5, unique), (5, None), (5, other), (None, other), (None, unique[:0]), (6, other), (6, other)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    left = chunks.results(df, chunks.repeats(df))
    got = sorted(((r.doc_id, r.text, r.t) for r in left.select("doc_id", "text", chunks.cut_text(left.text, left.found.removed).alias("t")).collect()), key=str)
    want = sorted([(1, shared, shared), (5, shared, ""), (5, unique, unique), (5, None, None), (5, other, other), (None, other, ""), (None, "", ""), (6, other, ""), (6, other, "")], key=str)
    assert got == want


def removed_by_hand(texts, least=128):
    """Bytes of each text, in order of ids, in runs of at least so many that an earlier text holds: what whole copies come to."""
    return {i: len(t) if any(t == u for _, u in texts[:k]) else 0 for k, (i, t) in enumerate(texts)}


def test_query_columns_and_long_texts(spark, tmp_path):
    rng = random.Random(10)
    base = [prose(rng, n) for n in (30, 300, 9000)]
    texts = [(i, base[i % 3]) for i in range(9)] + [(20, prose(rng, 50))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from duoscope.llm import queries

    got = {r.doc_id: r for r in queries.op4_chunk_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.n_removed for i, r in got.items()} == removed_by_hand(texts)
    assert all(got[i].n_bytes == len(t) and got[i].is_repeat == (got[i].n_removed > 0) for i, t in texts)
    assert got[20].n_repeated == 0 and got[20].sources == [] and got[8].sources == [2] and got[0].n_repeated == len(base[0])
