import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vectorloom.llm import elias_fano as ef
from vectorloom.llm import ngram_lm as lm
from vectorloom.llm import suffix_dedup as sd

from .test_words_and_sketches import words


@pytest.mark.parametrize(("universe", "n"), [(1, 0), (5, 3), (1000, 500), (1 << 40, 3000), (100, 5000), (1 << 63, 4000), (1 << 50, 1)])
def test_elias_fano(tmp_path, universe, n):
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    path = str(tmp_path / "x")
    ef.write_arrays(path, ef.EliasFano.build(v, universe, "a."))
    e = ef.EliasFano(ef.map_arrays(path), "a.")
    assert (e[np.arange(n)] == v).all()
    x = np.concatenate((rng.integers(0, universe, 2000, dtype=np.uint64), v[:500], np.array([universe - 1, 0], np.uint64)))
    assert (e.successor(x) == np.searchsorted(v, x)).all()


def brute_scores(docs):
    end = "\0end"
    docs = [(i, words(t) + [end]) for i, t in docs]
    train = [w for i, w in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(x for w in train for x in w)
    n, v = sum(one.values()), len(one)
    code = lambda x: float(lm._CODES[lm.encode(np.array([x]))[0]])
    two = Counter(p for w in train for p in zip([end, *w], w, strict=False))
    alpha2 = {p: code((c - 0.75) / one[p[0]]) for p, c in two.items()}
    triples = Counter(t for w in train for t in zip([end, *w[:-1]], w, w[1:], strict=False))
    alpha3 = {t: code((c - 0.75) / two[t[:2]]) for t, c in triples.items()}
    mass2, mass3 = Counter(), Counter()
    for p, a in alpha2.items():
        mass2[p[0]] += a
    for t, a in alpha3.items():
        mass3[t[:2]] += a
    left = lambda x: code(max(0.0, 1 - x))

    def p(u, w, x):
        out = (one[x] + 1) / (n + v + 1)
        if w in one:
            out = alpha2.get((w, x), 0) + left(mass2[w]) * out
        if u is not None and (u, w) in two:
            out = alpha3.get((u, w, x), 0) + left(mass3[(u, w)]) * out
        return out

    rows = {}
    for i, w in docs:
        score = sum(math.log10(p(None if k == 0 else w[k - 2] if k > 1 else end, w[k - 1] if k else end, x)) for k, x in enumerate(w))
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        rows[i] = (len(w), sum(x in one for x in w), n, base, score)
    # each context's distribution stays within 1
    for u, w in list(two)[:20]:
        assert sum(p(u, w, x) for x in one) <= 1 + 1e-9
    return rows


@pytest.mark.parametrize(("shard_bytes", "hot", "slice_bytes"), [(300, 1 << 20, 1 << 22), (1 << 25, 1 << 20, 1 << 22), (300, 30, 500), (1 << 25, 7, 200)])
def test_scores(spark, monkeypatch, shard_bytes, hot, slice_bytes):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm, "HOT_TOKENS", hot)
    monkeypatch.setattr(lm, "SLICE_BYTES", slice_bytes)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "The", "of", "and", "a"] + [f"w{k}" for k in range(60)]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs += [(None, "the of the"), (1000, None), (1001, "")]
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, score double")
    want = brute_scores(docs)
    for r in lm.lm_scores(d).collect():
        a, b = want[r.doc_id], (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_scores_of_nothing(spark):
    ddl = "doc_id long, text string"
    assert lm.lm_scores(spark.createDataFrame([], ddl)).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.lm_scores(spark.createDataFrame([(held, "a b")], ddl)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("bucket_bytes", "flush", "sort", "hot"), [(1 << 25, 400_000, 2_000_000, 4096), (2000, 20, 5, 4096), (2000, 20, 5, 2), (1 << 25, 400_000, 2_000_000, 2)])
def test_repeats(spark, monkeypatch, bucket_bytes, flush, sort, hot):
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(sd, "FLUSH_ROWS", flush)
    monkeypatch.setattr(sd, "SORT_STRETCHES", sort)
    monkeypatch.setattr(sd, "HOT", hot)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    passages = [text(rng.randint(60, 400)) for _ in range(6)]
    rows = [(i, "".join(rng.choice((text(rng.randint(0, 150)), rng.choice(passages))) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, "a" * 350), (101, "ab" * 400), (102, "q" * 100), (103, "q" * 100), (104, "q" * 99), (105, None), (106, ""), (-3, "a" * 220), (None, passages[0] * 3), (107, rows[5][1]), (108, text(99) + passages[1])]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_bytes int").repartition(5)
    want = brute_removed(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(d).collect()}
    assert got == want


def test_one_hot_passage(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, f"{word()} {word()} {passage} {word()}") for i in range(300)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == brute_removed(rows)


def test_repeats_of_odd_rows(spark):
    ddl = "doc_id long, text string"
    assert sd.remove_repeats(spark.createDataFrame([], ddl)).count() == 0
    t = "".join(random.Random(8).choices("abcdefghij", k=150))
    rows = sd.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t)], ddl)).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0, 0, 150]
