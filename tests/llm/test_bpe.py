"""Encoding against the tiktoken library, and the round trip."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from duoscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(None, PATH), special_tokens={})


def texts(n):
    rng = random.Random(1)
    parts = ["a", "b", "the", "ab", " ", "  ", "\n", "é", "漢", "0", "1", "!!", "'s", "aa", "​", "😀", "ing", "-", "=", "\x1c", "\xa0", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(n)] + [None, "", "a" * 5000, " " * 777, "=-" * 999]


def test_ids_equal_the_library(library):
    rows = texts(1500)
    ids, n = bpe.Encoder(bpe.read_ranks(None, PATH), public_tokenizers.PATTERN).encode(pa.array(rows))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or ""), t


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 5)
    encoder = bpe.Encoder(bpe.read_ranks(None, PATH), public_tokenizers.PATTERN)
    for t in texts(20):
        assert encoder.encode(pa.array([t], pa.string()))[0].tolist() == library.encode_ordinary(t or "")


def test_merges_whose_products_rank_lower():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"ab": 301, b"aba": 299, b"ca": 298, b"abab": 400}
    encoder = bpe.Encoder(ranks, r"\S+|\s+")
    other = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks={**ranks, **{b"\x00" * (i - 255): i for i in range(256, 401) if i not in ranks.values()}}, special_tokens={})
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert encoder.encode(pa.array([t]))[0].tolist() == other.encode_ordinary(t)


def test_round_trip_in_spark(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    enc = bpe.encode(df, PATH, public_tokenizers.PATTERN, out="enc").select("doc_id", "text", "enc.*")
    for r in bpe.decode(enc, PATH).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert r.n_tokens * 4 == len(r.ids) and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN, out="enc").collect() == []
