"""Training reads chosen texts whole."""

import random

from kspec.llm import toxicity


def test_training_reads_all_words(spark):
    """The word that tells the toxic texts is the one with the greatest key of 5,000 different ones."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(5000)}, key=lambda w: toxicity.feature_key(w.encode()))
    *fill, sign = words
    rows = [(i, " ".join(fill + ([sign] if i < 20 else []))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, held_out_fold=None)
    assert model.weights.get(sign.encode(), 0) > 0
