"""The pipeline's stages in order, on planted tables."""

import hashlib

import corpus_pipeline
from cadence.llm import decontamination, lines, neardup, toxicity
from tests.llm import corpus
from tests.llm.test_lines import every_passage
from tests.llm.test_neardup import brute
from tests.llm.test_packing import ids_of


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows = corpus.documents(7)
    item = "seven of the quick lions sat near that old river bank today"
    rows += [(500 + k, f"{rows[k][1]} grobnik plemfart zudwick", "en", "s", 0) for k in range(20)]
    rows += [(700, f"{rows[1][1]} and also this: {item} which was read", "en", "s", 0)]
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, int(r[0] in range(500, 520))) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    before = spark_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(out := str(tmp_path / name))
        after = spark.read.parquet(out)
        kept = {r["doc_id"] for r in after.collect()}
        if name == "toxicity":
            scored = toxicity.classified(spark, before, spark.read.parquet(str(tmp_path / "labels.parquet")))
            assert kept == {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] or "" for r in after.collect()}
            want = every_passage(sorted((r["doc_id"], r["text"]) for r in before.collect()), lines.Passages())
            for doc, (_, removed, digest) in want.items():
                assert digest == hashlib.sha256(texts.get(doc, "").encode()).hexdigest() and (doc in texts or removed), doc
        if name == "near_dedup":
            want = brute([tuple(r) for r in before.collect()], neardup.Similarity())
            assert kept == {k for k, v in want.items() if v[2]}
        if name == "decontamination":
            assert decontamination.report(spark, after, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).filter("n_hit > 0").count() == 0
        before = after
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {r["doc_id"]: len(ids_of(r["text"])) for r in before.collect()}
    assert {k: sum(r["length"] for r in packed if r["doc_id"] == k) for k in want} == want and {r["doc_id"] for r in packed} == set(want)
