"""The pipeline's stages on rows that ids do not tell apart, and near copies between 0.80 and 0.85."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from vellum.llm import op4_dedup, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(tag, n):
    return [f"{tag}{i}" for i in range(n)]


def similarity(a, b):
    flat, starts = shingles.shingle_sets([a.encode(), b.encode()])
    x, y = set(flat[: starts[1]].tolist()), set(flat[starts[1] :].tolist())
    return len(x & y) / len(x | y)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def test_stage_links_at_080(spark):
    pairs = []
    for k in range(200):  # one changed word takes 5 of 50 shingles away: 45 / 55 = 0.818
        w = words(f"p{k}x", 54)
        pairs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:20], "other", *w[21:]]))]
    assert all(0.80 <= similarity(a[1], b[1]) < 0.85 for a, b in zip(pairs[::2], pairs[1::2]))
    found = [r["doc_id"] for r in c.near_duplicates(spark, table(spark, pairs), "").collect()]
    assert sorted(found) == list(range(0, 400, 2))


def test_bands_follow_the_threshold():
    assert (op4_dedup.band_rows(85), op4_dedup.band_rows(80)) == (8, 6)
    for percent in range(50, 100):
        r = op4_dedup.band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (256 // r) <= op4_dedup.MISS


def test_rows_without_or_with_shared_ids_stay(spark):
    a, b, d, e = (" ".join(words(x, 30)) for x in "abde")
    rows = [(None, a), (None, b), (7, d), (7, e), (7, e), (None, e), (9, ""), (9, ""), (None, None), (None, None)]
    kept = c.near_duplicates(spark, table(spark, rows), "")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(None, a), (None, b), (7, d), (7, e), (9, ""), (None, None), (None, None)]))


def test_mixing_takes_rows_without_or_with_shared_ids(spark):
    rows = [(None, "x"), (None, " ".join(words("b", 40))), (7, " ".join(words("d", 40))), (7, " ".join(words("e", 40))), *((i, " ".join(words(f"r{i}x", 40))) for i in range(40))]
    docs = table(spark, rows)
    found = {}
    for r in c.mixing(spark, docs, "").collect():
        found[r["text"]] = found.get(r["text"], 0) + 1
    assert set(found) == {t for _, t in rows} and set(found.values()) == {1, 2}  # 1.5 passes of one source


LONG = "many words " * 30_000
EDGES = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (4, "one two"), (None, "no id here"), (5, LONG), (6, "mail a.b@c.de now"), (6, "another text of six")]


def run_stage(spark, stage, rows):
    """The stage's rows for a table with columns of clashing names."""
    docs = table(spark, rows).withColumns({x: F.lit("q") for x in ("row", "id", "size", "taken", "copies", "score", "component_id", "ids", "spans", "key")})
    out = dict(c.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    if stage != "token_ids":
        assert out.columns == list(c.COLUMNS)
    return sorted((str(r["doc_id"]), str(r["text"]) if stage != "token_ids" else str(r["n_tokens"])) for r in out.collect())


@pytest.mark.parametrize("stage", [name for name, _ in c.STAGES])
def test_stages_on_empty_tables(spark, stage):
    assert run_stage(spark, stage, []) == []


def test_toxicity_keeps_clean_edges(spark):
    assert run_stage(spark, "toxicity", EDGES) == sorted((str(i), str(t)) for i, t in EDGES)


def test_near_duplicates_of_edges(spark):
    rows = [(i, t) for i, t in EDGES if (i, t) != (4, "one two")] + [(4, "one two")]
    assert run_stage(spark, "near_duplicates", EDGES) == sorted((str(i), str(t)) for i, t in rows)


def test_personal_data_of_edges(spark):
    want = [(i, "mail <EMAIL> now" if t and "@" in t else t) for i, t in EDGES]
    assert run_stage(spark, "personal_data", EDGES) == sorted((str(i), str(t)) for i, t in want)


def test_mixing_of_edges(spark):
    found = run_stage(spark, "mixing", EDGES)
    assert {x for x in found} <= {(str(i), str(t)) for i, t in EDGES if t and t.strip()}
    assert all(found.count(x) <= 4 for x in found) and sum(len(t.split()) for _, t in found) <= 2 * 60_014


def test_token_ids_of_edges(spark):
    found = run_stage(spark, "token_ids", EDGES)
    assert len(found) == len(EDGES) and ("1", "0") in found and ("2", "0") in found
    empty = c.token_ids(spark, table(spark, [(1, None)]), "").first()
    assert empty["ids_sha256"] == empty["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
