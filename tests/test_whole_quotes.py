"""Every document gets a row of the tolerant quotes, whatever its white space."""

from vellum import catalog


def test_tolerant_quotes_of_all_documents(spark, tmp_path):
    texts = {1: "a b c d\ne f g h i j", 2: "a b c d  e f g h i j", 3: "one two", 4: None, 5: "", 6: "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", 7: "a b c last"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["start"], r["end"], r["verified"]) for r in catalog.queries()["txt7_tolerant_quotes_all"](spark, str(tmp_path)).collect()}
    none = (None, None, False)
    assert found == {1: (6, 19, True), 2: (6, 16, True), 3: none, 4: none, 5: none, 6: (9, 26, True), 7: (6, 10, True)}


def test_many_quotes_meet_in_a_join(spark, monkeypatch):
    from vellum.operators import quotes

    docs = spark.createDataFrame([(i, f"start of text {i} has some more words that follow here") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"of text {i} has some more words") for i in range(0, 30, 3)], "item_id long, quote string")
    rows = lambda: sorted(map(tuple, quotes.contained(docs, asked).select("doc_id", "item_id", "start_char").collect()))
    few = rows()
    monkeypatch.setattr(quotes, "FIT", 0)
    assert rows() == few
    monkeypatch.setattr(quotes, "MOST_KEYS", 2)
    assert rows() == few == [(i, i, 6) for i in range(0, 30, 3)]
    assert quotes.contained(docs, asked.limit(0)).count() == 0


def test_automaton_and_joins_agree(spark, monkeypatch):
    import random

    from vellum.operators import quotes

    rng = random.Random(9)
    words = ["a", "bé", "c", "dd", "e", "\n", "ab"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    docs = spark.createDataFrame([(i, line(rng.randint(0, 60))) for i in range(60)] + [(99, None), (98, "")], "doc_id long, text string")
    asked = [(i, line(rng.randint(1, 9))) for i in range(80)] + [(200, ""), (201, None), (202, "a"), (203, "a"), (204, "x" * 9)]
    df = spark.createDataFrame(asked, "item_id long, quote string")
    rows = lambda: sorted(tuple(r) for r in quotes.contained(docs, df).collect())
    one = rows()
    assert one == sorted((d, i, t.index(q), t.index(q) + len(q)) for d, t in docs.collect() if t is not None for i, q in asked if q is not None and q in t)
    monkeypatch.setattr(quotes, "FIT", 0)
    assert rows() == one
