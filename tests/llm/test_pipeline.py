from pyspark.sql import functions as F

import corpus_pipeline
from vectorloom.llm import decontam, quality, secrets

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, done = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).toArrow())
        done.append((before, docs))
        assert i == 4 or docs.columns == names
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    before, after = done[0]
    assert set(text(after)) == {r.doc_id for r in quality.quality_scores(before, labels).collect() if r.predicted}
    before, after = done[1]
    comps = brute(sorted(text(before).items()), 5, 80)
    assert set(text(after)) == {k for k, (_, c) in comps.items() if k == c}
    before, after = done[2]
    leaked = {r.doc_id for r in decontam.contaminated(before, bench).collect()}
    assert set(text(after)) == set(text(before)) - leaked
    items = [r.text for r in bench.collect()]
    assert leaked == {k for k, t in text(before).items() if any(x in t for x in items)}
    before, after = done[3]
    assert set(text(after)) == set(text(before))
    assert all(r.n_chars == len(r.text) for r in after.collect()) and secrets.scan_secrets(after).selectExpr("sum(n_assign + n_access + n_hex) AS n").first().n == 0
    before, after = done[4]
    assert {r.doc_id for r in after.collect()} == set(text(before)) and all(0 <= r.taken <= 3 * r.size for r in after.collect())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r.taken for r in rows) <= sum(r.size for r in rows)


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows and empty tables go through all stages; nothing clean is lost."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    kept = docs.limit(40)
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "a text of a few words here", None, None, 26), (10**9, None, "en", "s", None), (10**9 + 1, "", None, "s", 0)], docs.schema)
    odd = kept.unionByName(kept.limit(3)).unionByName(nulls).withColumns({n: F.lit(n) for n in ("_slot", "gone", "base", "cands")})
    for table, path in ((odd, "odd"), (odd.limit(0), "none")):
        out = spark.createDataFrame(table.toArrow(), table.schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = spark.createDataFrame(stage(spark, out, str(tmp_path)).toArrow())
            assert i == 4 or out.columns == table.columns
        assert (out.count() > 0) == (path == "odd")
