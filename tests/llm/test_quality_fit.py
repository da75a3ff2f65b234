"""The ranker is fitted on all labelled documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from causalith.llm import quality


def test_values_at_places_of_all_rows(spark):
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=3000) ** 3, rng.integers(0, 4, 3000), np.full(3000, 0.1), np.exp(9 * rng.normal(size=3000))], 1)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(5)
    places = [0, 299, 1500, 2998, 2999]
    assert (quality._places(df, quality._matrix, places) == np.sort(x, 0)[places].T).all()


def test_every_labelled_document_takes_part(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAIRS", 100)
    rows = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 9 > 0).cast("int").alias("quality"), F.array(F.col("id").cast("double")).alias("x")).repartition(3)
    for flip in (False, True):
        some = rows.withColumn("quality", 1 - F.col("quality")) if flip else rows
        pairs = quality._pairs(some, *((100, 800) if flip else (800, 100))).toPandas()
        good = {r["doc_id"] for r in some.filter("quality = 1").collect()}
        assert {int(v[0]) for v in pairs.g} == good and {int(v[0]) for v in pairs.b} == set(range(900)) - good


def test_more_documents_than_the_former_bound(spark):
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert quality.labelled_features(docs, labels).count() == n
    d = pa.record_batch({"x": pa.array([[1.0], [2.0]])})
    assert quality._matrix(d).tolist() == [[1.0], [2.0]]
