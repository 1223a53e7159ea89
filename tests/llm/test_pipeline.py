"""Each stage against a plain version of its decision on its own input."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from eventlake.llm import bpe, decontaminate, queries, quality
from tests.llm.test_jaccard import brute_kept


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").withColumn("extra", F.lit(1))
    labels = queries.table(spark, sf_dir, "labels")
    model = queries.quality_model(docs, labels)
    items = [(r.item_id, decontaminate.normalize(r.text)) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    block = decontaminate.Block([i for i in items if i[1]], decontaminate.RATE)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, sf_dir)
        got = {r.doc_id: r for r in after.collect()}
        if name == "quality":
            want = {i for i, r in before.items() if quality._judge(model, [r.text or ""], queries.GOOD_GRADE)[1][0] >= queries.GOOD_PROBABILITY}
        elif name == "near_copies":
            want = set(map(int, brute_kept([(i, r.text) for i, r in before.items()])))
        elif name == "decontaminate":
            want = {i for i, r in before.items() if not block.search(decontaminate.normalize(r.text))}
        else:
            codec = bpe.codec(f"{queries.TOKENIZERS}/word_bpe_49k.json")
            want = set(before)
            for i, r in got.items():
                ids = codec.encode(before[i].text or "").tolist()
                assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert set(got) == want and want
        assert name == "bpe" or after.columns == docs.columns
        docs = after
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert run == {i: r.ids_sha256 for i, r in got.items()}


def test_clean_documents_stay(spark):
    """Of labelled documents the stage drops the bad and the toxic ones and keeps the good ones."""
    folder = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, folder).select("doc_id").collect()}
    good = [r.doc_id in kept for r in labels.where("quality = 1 and toxic = 0").collect()]
    bad = [r.doc_id in kept for r in labels.where("quality = 0 or toxic = 1").collect()]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", None, "s", 5), (4, "some words that stand here", "en", "s", 26), (5, "some words that stand here", "en", "s", 26), (6, "long " * 50000, "en", "s", 1)]
    for name, kept in (("full", 5), ("none", 0)):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows if kept else [], schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() == kept
