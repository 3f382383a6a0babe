"""Credentials that happen to hold no digit."""

import math
import random
import re

from vellum.llm import op10_secrets as op


def test_credentials_without_digits_are_scored():
    formats, rng = op.train(), random.Random(5)
    for pattern in ("g\\lpat-s{20}", "\\s\\k_\\liv\\e_m{24}", "m{32}", "AKIAb{16}"):
        made = [re.sub("[0-9]", lambda _: rng.choice("GHJKQRTWXYZ"), op.spell(pattern, rng)) for _ in range(60)]
        texts = [f"use {s} here" for s in made]
        found = op.added_spans(texts, [[] for _ in texts], formats)
        assert sum(x == [(4, 4 + len(s), "format")] for x, s in zip(found, made)) > 54


def test_plain_runs_are_rejected():
    words = ["internationalization", "Datenschutzgrundverordnung", "state-of-the-art-thing", "LIMITATIONOFLIABILITY", "LAAITIONELLEELLE", "/usr/share/local/thing", "-" * 40, "=" * 30, "_" * 25, "responsibilities/obligations"]
    assert op.added_spans(words, [[] for _ in words], op.train()) == [[] for _ in words]


def test_merged_automata_generalise():
    """Probabilities of a state sum to one, and strings not seen in training are likelier than in the unmerged tree."""
    rng = random.Random(2)
    pattern = "\\s\\k-m{24}"
    seen = [op.symbols(op.spell(pattern, rng)) for _ in range(60)]
    fresh = [op.symbols(op.spell(pattern, rng)) for _ in range(60)]
    tree, merged = op.Automaton(seen), op.Automaton(seen).merge()
    assert len(merged.red) < len(tree.next) / 4
    for q in merged.red:
        assert merged.total(q) == 0 or abs(merged.ends[q] + sum(merged.count[q].values()) - merged.total(q)) == 0
    assert merged.ends and sum(merged.ends[q] for q in merged.red) == len(seen)

    def like(a, s):
        at, total = 0, 0.0
        for c in s:
            n = a.total(at) or 1
            total += math.log(max(a.count[at].get(c, 0) / n, op.FLOOR))
            at = a.next[at].get(c, 0)
        return total

    assert sum(like(merged, s) for s in fresh) > sum(like(tree, s) for s in fresh)


def test_base_spans_are_scored_and_stay(spark):
    text = "token = goodmorningworld and token: x9Kq2LmZ8vBn4RtY7wQe1UiP3oAs5DfG6hJk0XcV"
    row = op.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [x["kind"] for x in row["found"]] == ["assign", "assign"] and row["base"] == row["spans"]
    assert row["found"][0]["score"] < op.THRESHOLD < row["found"][1]["score"]
