"""Spans of chunks against the same rules on lists of strings."""

import random
import re

from pyspark.sql import functions as F

from vellum.operators import chunks


def plain(text, size, overlap):
    """Parts packed as strings, long ones cut."""
    heads = [m.start() for m in re.finditer(r"(?m)^#{1,6}\s+.*", text)]
    if heads:
        edges = [0, *heads, len(text)]
        parts, glue = [text[a:b] for a, b in zip(edges, edges[1:])], ""
    else:
        parts, glue = re.split(r"\n{2,}", text), "\n\n"
    packed = [""]
    for part in parts:
        longer = packed[-1] + glue + part if packed[-1] else part
        packed[-1:] = [longer] if len(longer) <= size or not packed[-1] else [packed[-1], part]
    out = []
    for p in filter(None, packed):
        while len(p) > size:
            places = [p[:size].rfind(s) + len(s) for s in chunks.ENDS if p[:size].rfind(s) > size // 3]
            at = places[0] if places else size
            out.append(p[:at])
            p = p[max(1, at - overlap) :]
        out.append(p)
    return out


def test_spans_match_strings(spark):
    rng = random.Random(8)
    bits = ["word ", "a", "\n", "\n\n", "\n\n\n", ". ", "? ", ";\n", "# Head\n", "## \n\n", "#no", "longword" * 3, ".\n"]
    for with_heads in (True, False):
        for _ in range(600):
            text = "".join(rng.choice([b for b in bits if with_heads or "#" not in b]) for _ in range(rng.randint(1, 60)))
            if not re.search(r"(?m)^#{1,6}\s+", text):
                text = re.sub(r"\n{2,}", "\n\n", text)
            size = rng.randint(8, 60)
            overlap = rng.randint(0, size // 2)
            assert [text[a:b] for a, b in chunks.spans(text, size, overlap)] == plain(text, size, overlap), (text, size, overlap)


def test_spread(spark):
    rows = [(1, None), (2, ""), (3, "one\n\n\n\ntwo"), (4, "# a\n" + "x " * 6000 + "\n# b\nend"), (5, "\n\nlate")]
    found = {}
    for r in chunks.spread(spark.createDataFrame(rows, "id long, text string"), "id", "text").orderBy("id", "seq").collect():
        found.setdefault(r["id"], []).append((r["begin"], r["chunk"]))
    assert set(found) == {3, 4, 5} and found[3] == [(0, "one\n\ntwo")] and found[5] == [(2, "late")]
    assert all(len(c) <= 8000 for _, c in found[4])
    assert found[4][-1][1] == "# b\nend" and found[4][1][0] == found[4][0][0] + len(found[4][0][1]) - 800
    assert chunks.spread(spark.createDataFrame(rows[:0], "id long, text string"), "id", "text").select(F.col("chunk")).count() == 0


def test_spans_of_a_batch_hold_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "", *(f"# Head {i}\n" + "word. " * 4000 for i in range(200))])
    tracemalloc.start()
    found = chunks.placed_spans(texts, 8000, 800)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [[{"begin": a, "end": b} for a, b in chunks.spans(t, 8000, 800)] if t else [] for t in texts.to_pylist()]
    assert most < 1 << 20 < texts.nbytes
