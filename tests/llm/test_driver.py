"""What must not run on the driver."""

import os

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import toxicity


def test_toxicity_learns_in_a_task(spark, monkeypatch):
    texts = [f"you are {'awful vile' if k % 3 == 0 else 'kind good'} number {k}" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    plain = toxicity.train([(np.unique(toxicity.slots(t.encode())).astype(np.int32), int(k % 3 == 0)) for k, t in enumerate(texts)])

    train, driver = toxicity.train, os.getpid()

    def elsewhere(*args):
        assert os.getpid() != driver
        return train(*args)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    at, w, bias = toxicity.fit(docs, labels)
    assert at.tolist() == plain[0].tolist() and w.tolist() == plain[1].tolist() and bias == plain[2]
