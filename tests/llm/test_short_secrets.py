"""op7_secret_scan and the pipeline's masks: unlabelled keys of fewer than 20 characters."""

import random

import pytest

from vectorloom.llm import secrets

WORDS = "information international the government of understanding and communication was considered in administration while responsibility remained".split()


@pytest.mark.parametrize("key", ["x7Kq2Vb9Rt4Zm6Wp", "Gh3kT8vQ1zYb5Nw7Js"])
def test_short_random_key(spark, key):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(40)]
    docs.append((99, f"please keep {key} safe"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(d).where("n_random > 0").collect()}
    assert found == {99: f"random:12:{12 + len(key)}"}
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(d).collect()}
    assert masked[99] == "please keep [secret] safe" and masked[0] == docs[0][1]
