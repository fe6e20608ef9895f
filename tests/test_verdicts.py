"""Verdicts out of prose against Python's own reading of the same braces."""

import json
import re

from pyspark.sql import functions as F

from duoscope.functions.text import verdict_in


def by_hand(text):
    found = re.search(r"\{.*\}", text or "", re.S)
    try:
        said = json.loads(found.group()) if found else {}
    except ValueError:
        return None
    verdict = str(said.get("verdict", "")).strip().lower()
    return (verdict, str(said.get("rationale", "")).strip()) if verdict in ("yes", "no") else None


def test_verdicts_in_prose(spark):
    texts = [None, "", "none", 'a {"verdict": " YES "} b', '{"verdict": "no", "rationale": " a } b "}', '{"verdict": "yes"} and {"verdict": "no"}', '{"verdict": yes}', '{"verdict": "yes"}, {"verdict": "no"}', '{"x": {"verdict": "yes"}}', '{"verdict": 1}', 'x\n{"a": [1, {"b": 2}],\n"verdict": "No"}\n', "{}", '{"verdict": "yes"']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", verdict_in(F.col("t"), ("yes", "no")).alias("v"))
    assert {r.id: tuple(r.v) if r.v else None for r in df.collect()} == {i: by_hand(t) for i, t in enumerate(texts)}
