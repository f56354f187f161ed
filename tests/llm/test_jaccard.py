import random

import numpy as np
import pytest

from vectorloom.llm import jaccard_join as jj
from vectorloom.llm.components import components
from vectorloom.llm.id_filter import IdFilter

from .test_words_and_sketches import shingle_set


def brute(rows, n, threshold):
    sets = [(k, shingle_set(t, n)) for k, t in rows]
    comp = {k: k for k, _ in sets if k is not None}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {k: (len(x), root(k)) for k, x in sets if k is not None}


def corpus(seed, groups, size, longest):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, longest))]
        if rng.random() < 0.5:
            base[:0] = passage
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "threshold", "longest", "seed"), [(3, 90, 120, 1), (5, 80, 120, 2), (3, 90, 14, 3), (2, 60, 40, 4)])
def test_against_all_pairs(spark, n, threshold, longest, seed):
    rows = corpus(seed, 60, 12, longest) + [(100_000, None), (100_001, ""), (100_002, " \t"), (100_003, "one two"), (100_004, "ONE  two"), (-7, "one two")]
    d = spark.createDataFrame([(k, t, 9, 9) for k, t in rows], "doc_id long, text string, n_shingles int, rep int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(d, n, threshold).collect()}
    assert got == brute(rows, n, threshold)


def test_one_dense_group(spark):
    """Near copies of one text at all distances around the threshold: the second index settles them."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for k in range(250):
        w = list(base)
        for _ in range(k % 12):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(d, 3, 90).collect()}
    assert got == brute(rows, 3, 90)


def test_odd_rows(spark):
    ddl = "doc_id long, text string"
    assert jj.jaccard_components(spark.createDataFrame([], ddl)).count() == 0
    d = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A b c d"), (None, "alone here now")], ddl)
    got = sorted(((r.doc_id, r.component_id, r.copies) for r in jj.jaccard_components(d).collect()), key=str)
    assert got == [(4, 4, 4), (4, 4, 4), (9, 4, 4), (None, 4, 4), (None, None, 1)]
    kept = jj.keep_one_of_each(d.selectExpr("doc_id", "text", "1 AS n"), 3, 90)
    assert kept.columns == ["doc_id", "text", "n"] and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "None", "None"]


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(3)
    import itertools

    for _ in range(60):
        m = int(rng.integers(1, 6))
        exact = rng.integers(0, 9, m).astype(float)
        near = exact + rng.integers(0, 9, m)
        need = int(rng.integers(1, 2 * m + 1))
        cost = lambda c, exact=exact, near=near: sum((0, exact[i], near[i])[x] for i, x in enumerate(c))
        best = min(cost(c) for c in itertools.product(range(3), repeat=m) if sum(c) >= need)
        got = jj.allocate(need, exact, near)
        assert got.sum() >= need and cost(got) == best


@pytest.mark.parametrize("num", [60, 80, 90])
def test_bands_hold_every_linked_pair(num):
    plan = jj.Plan(num)
    bands = jj.Bander(plan)
    for a in range(1, 400):
        spaces = {s for s, _, _ in bands.spaces(a)}
        for b in range(a, plan.top(a) + 1):
            own, last, _ = bands.spaces(b)[0]
            assert own in spaces
            h = plan.difference(a + b)
            assert h < plan.need(a, last) <= plan.needed(last)
            m, deletions = plan.allocation(last)
            assert m + deletions >= plan.needed(last)


def test_components_and_filter(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.comp for r in components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    ids = spark.range(0, 1000, 3).toDF("gone")
    rows = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text").unionByName(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in IdFilter(ids).without(rows, "doc_id").collect()) == sorted([str(i) for i in range(1000) if i % 3] + ["None"])


def test_components_over_many_tasks(spark, monkeypatch):
    """More links than a task holds: rounds go on until none is left."""
    import vectorloom.llm.components as cc

    monkeypatch.setattr(cc, "TASK_LINKS", 150)
    rng = random.Random(2)
    ids = list(range(600))
    rng.shuffle(ids)
    links = list(zip(ids[:500], ids[1:500], strict=False)) + [(i, j) for i, j in zip(ids[500:], ids[501:], strict=False) if rng.random() < 0.7]
    want = dict(zip(*(x.tolist() for x in cc.smallest_reached(*(np.array(x) for x in zip(*links, strict=True)))), strict=True))
    assert len(set(want.values())) > 5 and [want[i] for i in ids[:500]] == [min(ids[:500])] * 500
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_lone_elements_of_differences_are_not_joined(spark, monkeypatch):
    """Differences of 30 sets with 20 elements of their own each and 2 shared ones: 60 rows are ranked, not 660."""
    rows = [(0, r, r, 400, 22, False, [-1, -2, *range(100 * r, 100 * r + 20)]) for r in range(1, 31)]
    differences = spark.createDataFrame(rows, "ref long, rep long, comp long, n long, a long, linked boolean, u array<long>")
    plans, real = [], jj.cut
    monkeypatch.setattr(jj, "cut", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    pairs = jj._apart(differences, jj.Plan(90))
    assert pairs.count() == 30 * 29 // 2
    assert not any("LeftOuter" in p for p in plans)


def test_components_in_more_tasks_than_asked_for(spark, monkeypatch):
    """Links that one task could hold are dealt over 7: a chain is still one component, and each id has one row."""
    kind = type(spark.range(1))
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n, *by: real(df, max(n, 7), *by) if isinstance(n, int) else real(df, n, *by))
    ids = list(range(200))
    random.Random(4).shuffle(ids)
    links = list(zip(ids, ids[1:], strict=False)) + [(300, 301)]
    got = sorted(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == [(i, 0) for i in range(200)] + [(300, 300), (301, 300)]
