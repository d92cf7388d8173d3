import corpus_pipeline
from tests.llm.fixtures import corpus, frame

ITEM = "an item of the benchmark that somebody copied into a document word for word without saying so"


def test_stages_and_result(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None] + [(6000, f"before it\n{ITEM}\nafter it all goes on for a while", "en", "s", 0), (6001, "123 456 !!", "en", "s", 0)]
    words = [f"word{i}" for i in range(80)]
    rows += [(6100 + i, " ".join([*words[:40], f"edit{i}", *words[40:]]), "en", "s", 0) for i in range(3)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in docs.collect()})
    language, lines, near, clean = seen
    assert 6001 not in language and language == lines and near <= lines - {6101, 6102} and 6100 in near and clean <= near
    assert 6000 in near and 6000 not in clean and near - clean == {6000}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    by_piece = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert by_piece(packed) == by_piece(whole)
    assert {r["doc_id"] for r in whole.collect()} == clean
