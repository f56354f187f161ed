import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vectorloom.llm import fingerprint as fp
from vectorloom.llm import text as tx

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


TEXTS = ["Hello  wOrld foo bar", "", None, "one", "a b", "hello world foo\tx\n", " lead", "trail ", "x" * 200_000, "q " + "y" * 70_000 + " Z", "É é x  ", "a b c d e f g " * 9000]


def test_words_of_any_length():
    hashes, first, start, end = tx.word_hashes(pa.array(TEXTS))
    assert np.diff(first).tolist() == [len(words(t)) for t in TEXTS]
    known = {}
    for t, a, b in zip(TEXTS, first[:-1], first[1:], strict=True):
        for w, h in zip(words(t), hashes[a:b], strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    for n in (1, 2, 3, 5):
        got, at = tx.all_shingles(hashes, first, n)
        assert [len(np.unique(got[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)] == [len(shingle_set(t, n)) for t in TEXTS]
        for i in range(len(TEXTS)):
            assert (tx.shingles(hashes[first[i] : first[i + 1]], n) == got[at[i] : at[i + 1]]).all()


def test_slices_and_empty_arrays():
    a = pa.array(TEXTS).slice(3, 3)
    assert np.diff(tx.word_hashes(a)[1]).tolist() == [1, 2, 4]
    assert len(tx.word_hashes(pa.array([], pa.string()))[0]) == 0


def test_sketch_estimates():
    rng = random.Random(1)
    a = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    s, t = fp.sketch(a), fp.sketch(np.concatenate((a[2500:], [np.uint64(rng.getrandbits(64)) for _ in range(2500)])))
    assert abs(fp.distinct_count(s) / 5000 - 1) < 0.3
    assert abs(fp.resemblance(s, t) - 1 / 3) < 0.15 and abs(fp.containment(s, t) - 0.5) < 0.2
    # parts merge to the sketch of the whole; repeats change nothing
    assert (fp.merge(fp.sketch(a[:1000]), fp.sketch(a[1000:])) == s).all() and (fp.sketch(np.tile(a, 3)) == s).all()
    assert (fp.from_text(fp.to_text(s)) == s).all()
    few = np.unique(a[:40])
    assert fp.distinct_count(fp.sketch(few)) == 40 and fp.resemblance(fp.sketch(few), fp.sketch(few[:20])) == 0.5
    none = few[:0]
    assert fp.resemblance(none, none) == 1.0 and fp.resemblance(none, few) == 0.0 and fp.containment(none, few) == 1.0


def test_many_repeats_keep_the_sketch_whole():
    few = np.arange(1, 200, dtype=np.uint64)
    assert (fp.sketch(np.repeat(few, 50)) == few[: fp.K]).all()


@pytest.mark.parametrize(("bytes_", "quantiles", "broadcast"), [(50, 4096, 1000), (300, 4096, 1000), (1 << 24, 4096, 1000), (50, 3, 0)])
def test_neighbours(spark, monkeypatch, bytes_, quantiles, broadcast):
    monkeypatch.setattr(fp, "RANGE_BYTES", bytes_)
    monkeypatch.setattr(fp, "QUANTILES", quantiles)
    monkeypatch.setattr(fp, "BROADCAST_RANGES", broadcast)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefg") * 2 for _ in range(rng.randint(0, 30)))) for i in range(0, 60, 2)]
    rows += [(None, "no id"), (7, None), (9, ""), (8, "same id two"), (8, "ünïcode é"), (8, "same id two")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, fingerprint string")
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want = []
    for i, (k, t) in enumerate(order):
        following, cut = order[(i + 1) % len(order)][1], len(t) // 3
        e = t[: len(t) - cut] + following[:cut]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        part = lambda a, b: len(a & b) / len(a) if a else 1.0
        a, b, c = (shingle_set(x, 5) for x in (t, e, following))
        near = like(a, b), like(a, c), len(a), part(a, b), part(a, c)
        want.append((str(k), len(t), hashlib.sha256(e.encode()).hexdigest(), *(round(x, 9) for x in near)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), r.n_shingles, round(r.in_edited, 9), round(r.in_next, 9)) for r in fp.neighbour_fingerprints(d).collect()]
    assert sorted(got) == sorted(want)


def test_neighbours_of_few(spark):
    ddl = "doc_id long, text string"
    assert fp.neighbour_fingerprints(spark.createDataFrame([], ddl)).count() == 0
    one = fp.neighbour_fingerprints(spark.createDataFrame([(1, "abcdef")], ddl)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = fp.fingerprints(spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, None)], ddl)).orderBy("doc_id").collect()
    assert rows[0].fingerprint == rows[1].fingerprint and rows[2].fingerprint == "" and rows[2].n_shingles == 0
