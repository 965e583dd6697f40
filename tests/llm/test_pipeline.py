import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    words = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join(words[(i * k) % 80] + str(i % 7) for k in range(1, 50)), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "", "fr", None, 0), (103, "only line here\n" * 3 + "another", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"o{k}"))
        docs = spark.read.parquet(str(tmp_path / f"o{k}"))
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] == len(rows)
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert 100 not in kept and {101, 102, 103} <= kept
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert text[103] == "only line here\nanother"
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_run_writes_every_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0


def test_stages_keep_repeated_rows_and_take_empty_tables(spark, tmp_path):
    rows = [(1, "some words stand here alone", "en", "s", 27), (1, "some words stand here alone", "en", "s", 27), (1, "other text of the same id", "en", "s", 25), (None, "no id at all here", "en", None, 17), (2, None, None, "s", None)]
    docs = spark.createDataFrame([(*r, 7, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int, key int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = [r for r in out.collect() if r.doc_id == 1 and r.text and r.text.startswith("some")]
        if name != "mixing":
            assert len(got) == 2, name
        assert len(got) % 2 == 0, name
        if name != "mixing":
            assert [r.text for r in out.collect() if r.doc_id is None] == ["no id at all here"], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
