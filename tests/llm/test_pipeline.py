"""The pipeline, stage by stage against what it should have kept."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tests.llm.test_text_ops import brute_components
from wardline.llm import latent, near, quality
from wardline.llm.contract import tokenizer_path


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        before = kept.cache()
        kept = stage(spark, before, sf)
        assert kept.columns == columns, name
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()} and ids
        if name == "quality classifier":
            model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {r["doc_id"] for r in quality.score(before, model).where("predicted = 1").collect()}
        if name == "n-gram Jaccard join":
            want = brute_components({r["doc_id"]: r["text"] for r in before.collect()}, 5, 80)
            assert ids == {i for i, (_, c) in want.items() if c == i}
        if name == "benchmark decontamination":
            assert latent.search(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        kept = kept.cache()
    out = cp.run(spark, sf)
    assert out.count() == kept.count() == out.where("n_tokens = size(ids)").count()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in out.collect())


def test_stages_on_odd_inputs(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    long = "lorem ipsum dolor sit " * 20_000
    rows = [(i, t, None, None, None) for i, t in enumerate([None, "", " \n ", long, long, "one word", "one word"])] + [(6, "one word", None, None, None), (None, "no id", "en", "s", 5), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, schema).withColumn("label", F.lit("x")).withColumn("n", F.lit(0))
    for docs in (odd, odd.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        last = cp.STAGES[-1][1](spark, docs, sf)
        assert last.count() == docs.count() == last.where("n_tokens = size(ids)").count()
