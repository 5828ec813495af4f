"""The pipeline's stages on a small table."""

import uuid

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns = docs.columns
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            assert kept.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            break
        assert kept.columns == columns and 0 < kept.count() <= before
        if name == "quality classifier":
            ids = {r.doc_id for r in kept.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in ids for i in good) >= 0.97 * len(good) and sum(i in ids for i, q in labels.items() if q == 0) <= 2
        if name == "near-duplicates":
            assert kept.select(F.lower("text")).distinct().count() == kept.count()
        docs, before = kept, kept.count()
    assert corpus_pipeline.run(spark, sf).count() == kept.count()


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, Predicted int, kept boolean, row long, `a.b` string"
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "some plain words that are just long enough to be a text of their own, nothing more."), (4, "x" * 100_000)]
    for k, rows in enumerate((rows, [])):
        spark.createDataFrame([(i, t, None, None, None, 0.25, 7, True, 5, "dot") for i, t in rows], schema).write.parquet(str(tmp_path / f"in{k}"))
        docs = spark.read.parquet(str(tmp_path / f"in{k}"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
                assert {(r.score, r.Predicted, r.row, r["a.b"]) for r in out.collect()} <= {(0.25, 7, 5, "dot")}
            else:
                assert out.select("doc_id", "start").distinct().count() <= out.count()
        near = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, sf)
        assert near.count() == (4 if rows else 0)


def test_run_gives_each_stage_files(spark, monkeypatch):
    """A stage's rows do not change when the next reads them twice."""
    def drawn(spark, docs, sf):
        return docs.select("doc_id", F.udf(lambda: uuid.uuid4().hex).asNondeterministic()().alias("drawn"))

    def twice(spark, docs, sf):
        return docs.join(docs.select("drawn").withColumn("again", F.lit(True)), "drawn")

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("drawn", drawn), ("twice", twice)])
    assert corpus_pipeline.run(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_run_equals_stages_one_by_one_without_broadcasts(spark, tmp_path):
    sf, key = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").distinct().collect())
        assert ids(corpus_pipeline.run(spark, sf)) == ids(docs)
    finally:
        spark.conf.set(key, before)
