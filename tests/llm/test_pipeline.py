import corpus_pipeline
from semindex.llm import toxicity

from . import fixtures as fx


def test_stages(spark, tmp_path):
    rows = fx.corpus()
    item = rows[7][1]
    documents = fx.documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    for name, frame in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    lexicon = toxicity.fit([(rows[i][1], 0) for i in range(10)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            kept = [r for r in kept if lexicon.score(r[1]) < toxicity.THRESHOLD]
        elif name == "exact_dedup":
            first = {}
            for r in sorted(kept):
                first.setdefault((r[1] or "").encode().lower(), r)
            kept = list(first.values())
        elif name == "near_dedup":
            classes = fx.near_classes(kept)
            kept = [r for r in kept if classes[r[0]] == r[0]]
        else:
            gone = fx.overlap_docs(kept, [(0, item)])
            kept = [r for r in kept if r[0] not in gone]
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept), name
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in final.collect()) == sorted(r[0] for r in kept)
