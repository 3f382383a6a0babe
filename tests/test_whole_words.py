"""Scores by all policy words, texts cut at the default size only."""

import hashlib
import re

from vellum import catalog
from vellum.plans import documents as d


def score(text):
    low = text.lower()
    if not re.search(d.QUICK, low):
        return 0.0
    times = {w: low.count(w) for w in d.INDICATORS}
    hits = {p: [m[0] for m in re.finditer(p, low)] for p in d.PHRASES}
    found = sum(n > 0 for n in times.values()) + 2 * sum(map(len, hits.values()))
    chars = sum(n * len(w) for w, n in times.items()) + sum(len(x) for h in hits.values() for x in h)
    return round(min(10, found * chars / len(text) * 100), 6)


def test_scores_by_all_words(spark, tmp_path):
    rest = d.v.LEGAL_INDICATORS[20:]
    text = " ".join(f"{w} zq zq zq zq zq zq zq zq zq zq zq zq zq zq zq" for w in rest)
    texts = [text, " ".join(["zq " * 2000, rest[-1], "rights"]), "zq" * 80_000]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    q, at = catalog.queries(), str(tmp_path)
    found = dict(q["txt9_content_score_all"](spark, at).collect())
    assert abs(found[0] - score(texts[0])) < 1e-5 and abs(found[1] - score(texts[1])) < 1e-5 and found[0] > 0
    assert dict(q["prd10_admission_reason_all"](spark, at).collect())[0] is None
    capped = texts[2][: 150_000 - 13] + "\n\n[truncated]"
    assert dict(q["txt12_cap_all"](spark, at).collect()) == {i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate([*texts[:2], capped])}


def test_url_scores_by_all_keywords(spark, tmp_path):
    late = [k for k, x in list(d.v.URL_KEYWORDS.items())[8:] if x > 0][:10]
    spark.createDataFrame([(i, f"http://h.org/{k}") for i, k in enumerate(late)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = dict(catalog.queries()["url5_url_scores_all"](spark, str(tmp_path)).collect())
    assert all(found[i] > 0 for i in range(len(late)))


def test_counts_of_words(spark):
    from pyspark.sql import functions as F

    from vellum.operators import ingest

    words = ("data", "data protection", "dat", "aba", "term", "terms", "x.y")
    text = "data protection of data, dat ababa terms term x.y xzy dataprotection"
    row = spark.createDataFrame([(text,)], "t string").select(*ingest.occurrences(F.col("t"), words)).first()
    assert tuple(row) == (sum(w in text for w in words), sum(text.count(w) * len(w) for w in words))
