"""op3_lm_score keeps the pairs and triples seen once."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vectorloom.llm import ngram_lm as lm
from vectorloom.llm import queries

END = "\0end"


def code(x):
    return float(lm._CODES[lm.encode(np.array([x]))[0]])


def scores(docs):
    """(score, n-grams seen once that a text uses) by id, from plain counts."""
    docs = [(i, t.split() + [END]) for i, t in docs]
    train = [w for i, w in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(x for w in train for x in w)
    two = Counter(p for w in train for p in zip([END, *w], w, strict=False))
    three = Counter(t for w in train for t in zip([END, *w[:-1]], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    part2 = {p: code((c - lm.DISCOUNT) / one[p[0]]) for p, c in two.items()}
    part3 = {t: code((c - lm.DISCOUNT) / two[t[:2]]) for t, c in three.items()}
    used2, used3 = Counter(), Counter()
    for p, a in part2.items():
        used2[p[0]] += a
    for t, a in part3.items():
        used3[t[:2]] += a

    def p(u, w, x):
        out = (one[x] + 1) / (n + v + 1)
        if w in one:
            out = part2.get((w, x), 0) + code(max(0.0, 1 - used2[w])) * out
        if u is not None and (u, w) in two:
            out = part3.get((u, w, x), 0) + code(max(0.0, 1 - used3[(u, w)])) * out
        return out

    for u, w in list(two)[:20]:
        assert sum(p(u, w, x) for x in one) <= 1 + 1e-9
    out = {}
    for i, w in docs:
        before = [END, *w[:-1]]
        out[i] = sum(math.log10(p(None if k == 0 else before[k - 1], before[k], x)) for k, x in enumerate(w))
    return out, sum(c == 1 for c in two.values())


def test_pairs_and_triples_seen_once_count(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice([f"w{k}" for k in range(40)]) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, once = scores(docs)
    assert once > 100
    got = {r.doc_id: r.score for r in queries.op3_lm_score(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, rel=1e-9)
