import corpus_pipeline
from textloom.llm import decontaminate


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert decontaminate.overlaps(clean, bench).count() == 0
    assert docs.count() - clean.count() == decontaminate.overlaps(docs, bench).select("doc_id").distinct().count()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_run_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows, clashing column names, then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, ids string"
    rows = [(1, "some plain words of one text", "en", "s", 1, "r", "f", "i"), (1, "some plain words of one text", "en", "s", 1, "r", "f", "i"), (2, None, None, None, None, None, None, None), (3, "", "", "", 0, "", "", ""), (None, "no id here", None, None, None, None, None, None), (4, "一 二 三\u00a0\n" * 3000, "zh", "s", 9, "", "", "")]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/a/{name}.parquet")
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/b/{name}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "4", "None"]
    assert {r.doc_id: r.n_tokens for r in out}[2] == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
