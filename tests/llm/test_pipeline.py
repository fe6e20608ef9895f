"""The pipeline: each stage's decisions on planted cases, the columns of its results, and an empty corpus."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from duoscope.llm import bpe


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "ing", "and", "sh", "re", "on", "ti"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(7)
    path = str(tmp_path_factory.mktemp("sf"))
    item = prose(rng, 20)
    clean = [prose(rng, 60) for _ in range(8)]
    rows = [(i, t, "en", f"src{i % 2}") for i, t in enumerate(clean)]
    rows += [(20, clean[0], "en", "src0"), (21, clean[1] + " tail", "en", "src0"), (22, clean[2][:50] + " " + item + " " + prose(rng, 50), "en", "src1"), (23, item, "en", "src1"), (24, prose(rng, 60) + " mail a.b@c.org now", "en", "src1"), (25, "1234 5678", "en", "src1"), (26, None, None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item, clean, {r[0]: r[1] for r in rows}


def test_run_equals_its_stages_by_hand(spark, tables):
    path, item, clean, texts = tables
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert sorted(got) == [*range(8), 22, 24]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i in range(8):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(clean[i]) and got[i].round_trip
    said = library.decode(np.frombuffer(got[22].ids, "<u4").tolist())
    assert said == texts[22].replace(item, "\n")
    assert library.decode(np.frombuffer(got[24].ids, "<u4").tolist()) == texts[24].replace("a.b@c.org", "<EMAIL>")


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for _, work in corpus_pipeline.STAGES[:-1]:
        assert work(spark, docs, tables[0]).dtypes == docs.dtypes


def test_empty_corpus(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, docs, tables[0]).collect() == []


def test_runs_after_release_and_at_the_same_time(spark, tables):
    from threading import Thread

    from duoscope.llm import common

    first = sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, tables[0]).collect())
    common.release()
    got = []
    threads = [Thread(target=lambda: got.append(sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, tables[0]).collect()))) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [first, first]
