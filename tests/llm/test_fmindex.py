"""The FM-index and decontamination against direct search."""

import random
import re

import numpy as np
import pyarrow as pa

from duoscope.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window):
    owners, out = {}, []
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[k : k + n]), set()).add(i)
    for t in texts:
        w = words(t)
        hit, seen = [False] * len(w), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    seen |= owners[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        out.append((len(w), sum(hit), sorted(seen)))
    return out


def cases(rng):
    vocabulary = ["a", "b", "c", "dé", "E", "zz"][: rng.randint(1, 6)] + ["q0", "q1"]

    def some(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))

    items = [(str(i), some(rng.choice([0, 1, 2, 3, 5, 8]))) for i in range(rng.randint(0, 6))]
    return items, [rng.choice([None, "", some(rng.randint(0, 60))]) for _ in range(rng.randint(1, 30))]


def test_scan_equals_direct_search():
    rng = random.Random(5)
    for _ in range(80):
        items, texts = cases(rng)
        p = fmindex.Phrases([i for i, _ in items], [t for _, t in items], 4)
        f = fmindex.scan(pa.array(texts, pa.string()), p)
        got = [(int(f["n_words"][r]), int((f["last"] - f["first"])[f["row"] == r].sum()), sorted(p.items[j] for j in f["item"][f["item_row"] == r])) for r in range(len(texts))]
        assert got == brute(texts, items, 4)


def test_index_finds_all_places():
    rng = np.random.default_rng(2)
    s = np.append(rng.integers(0, 4, 200), 0)
    index = fmindex.Index(s, 3)
    for size in (1, 2, 5):
        rows = rng.integers(1, 4, (20, size))
        low, high = index.search(rows, np.full(20, size))
        for row, a, b in zip(rows, low, high):
            want = [i for i in range(len(s) - size) if (s[i : i + size] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_blocks_of_phrases_agree(spark, monkeypatch):
    rng = random.Random(9)
    items, texts = cases(rng)
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(6))) for i in range(6)]
    texts = [" ".join(rng.choice("abcd") for _ in range(60)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _hits0 int")
    bench = spark.createDataFrame([*items, (None, "a b c")], "item_id string, text string")

    def run():
        rows = fmindex.contamination(docs, bench, window=4).orderBy("doc_id").collect()
        return [(r.hits.n_words, sum(s["last"] - s["first"] for s in r.hits.spans), list(r.hits["items"])) for r in rows]

    whole = run()
    expected = [(n, hit, [i for i in ids if i != "?"]) for n, hit, ids in brute(texts, [*items, ("?", "a b c")], 4)]
    assert whole == expected
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 20)
    assert run() == whole
    empty = fmindex.contamination(docs, bench.limit(0)).collect()
    assert all(not r.hits.spans and not r.hits["items"] for r in empty) and len(empty) == len(texts)
    assert fmindex.contamination(docs.limit(0), bench).collect() == []


def test_cut(spark):
    bench = spark.createDataFrame([(1, "Two three, fôur")], "item_id long, text string")
    docs = spark.createDataFrame([("é one two THREE fôur five",), ("none here",), (None,)], "text string")
    found = fmindex.contamination(docs, bench)
    assert [r[0] for r in found.select(fmindex.cut(found.text, found.hits.spans)).collect()] == ["é one \n five", "none here", None]
