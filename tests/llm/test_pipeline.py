"""The pipeline's stages have their effect, and run() is the stages in turn."""

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from contentlake.llm.common import Scratch

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    assert docs.select("text").distinct().count() == counts[-1]
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    kept = docs.join(spark.createDataFrame(labels), "doc_id").groupBy("quality").count().toPandas().set_index("quality")["count"]
    assert kept.get(1, 0) > 3 * kept.get(0, 0)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {r[0] for r in whole.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
