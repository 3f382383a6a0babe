"""Items out of chunks: retries, checks, and what is given up."""

import json

from vellum.operators import items


def test_answers_are_checked():
    assert items.checked('[{"value": "v", "quote": "QUOTE"}]', "a quote here") == [{"value": "v", "quote": "QUOTE"}]
    for bad in ("", "null", "{}", "[1]", '[{"value": " ", "quote": "a"}]', '[{"value": "v"}]', '[{"value": "v", "quote": "not there"}]'):
        assert items.checked(bad, "a quote here") is None


def test_retries(spark):
    asked = []

    def provider(chunk, cluster, attempt):
        asked.append((cluster, attempt))
        if cluster == "far":
            raise OSError("gone")
        return "nonsense" if attempt < 3 else json.dumps([{"value": " x ", "quote": chunk}])

    assert list(items.answers("text", provider, ("slow", "far"))) == [("slow", 0, "x", "text", 3), ("far", 0, None, None, 3)]
    assert asked == [(c, n) for c in ("slow", "far") for n in (1, 2, 3)]
    assert list(items.answers(None, provider, ("slow",))) == list(items.answers("", provider, ("slow",))) == []
    df = spark.createDataFrame([(1, "abcdefgh word"), (2, None), (3, ""), (4, "x" * 200_001 + " Word")], "id long, line string")
    found = items.extract(df, "line", items.OfflineProvider({"f": ("word", "abc")}), ("f",))
    assert sorted((r["id"], r["value"], r["quote"]) for r in found.collect()) == [(1, "abc", "abc"), (1, "word", "word"), (4, "word", "Word")]
    assert found.columns == ["id", "line", "field", "place", "value", "quote", "attempts"]
    assert items.extract(df.limit(0), "line", items.OfflineProvider({"f": ()}), ("f",)).count() == 0
