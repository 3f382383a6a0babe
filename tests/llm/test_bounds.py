"""Bounds on what reaches the driver, and gradients against plain loops."""

from vellum.llm import op9_toxic


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(op9_toxic, "SAMPLE_BYTES", 1000)
    docs = spark.createDataFrame([(i, "x" * 90 if i else "y" * 100_000) for i in range(200)] + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    texts, y, rate = op9_toxic.sample(docs, labels, "toxic", 150)
    for label in (0, 1):
        own = [t for t, k in zip(texts, y) if k == label]
        assert 0 < len(own) and sum(len(t or "") for t in own) <= 1000
    assert 0.3 < rate < 0.7
    again = op9_toxic.sample(docs.orderBy("text"), labels, "toxic", 150)
    assert again[0] == texts
