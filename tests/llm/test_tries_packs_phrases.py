"""Operators 11 to 13 against brute force, and on edges."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import op6_wavelet, op11_tries, op12_curve, op13_phrases

EXTRA = ("id", "key", "n", "path", "row", "lang_code", "phrase", "rank", "score", "pieces")


# --- radix trees ---------------------------------------------------------------------------------------------------


def kinds(node, out):
    out.add(node.kind)
    for child in node.children():
        kinds(child, out)
    return out


def test_radix_tree_holds_prefixes_and_grows():
    rng = random.Random(3)
    keys = [bytes(rng.choices(range(256), k=2)) + bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(6000)] + [b"", b"a", b"ab", b"abcdef"]
    keys += [b"ab" + bytes([i]) for i in range(30)] + [b"q" + bytes([i]) for i in range(10)]
    tree, want = op11_tries.RadixTree(), defaultdict(list)
    for i, key in enumerate(keys):
        tree.add(key, i)
        want[key].append(i)
    assert all(tree.get(k) == v for k, v in want.items())
    assert tree.get(b"abz") == [] and tree.get(b"abcdefg") == [] and tree.get(b"abcd") == []
    assert kinds(tree.root, set()) == {4, 16, 48, 256}

    def walk(node, above):
        key = above + node.path
        for n in node.ends or []:
            yield key, n
        for child in node.children():
            yield from walk(child, key)

    assert [k for k, _ in walk(tree.root, b"")] == sorted(keys)


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32], role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for key, own in members.items():
        under = [k for k in members if k[: len(key)] == key]
        leaves = sum(not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in members) for k in under)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(key))))
        children = sum(len(k) == len(key) + 1 for k in under)
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def tries_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in EXTRA})
    return sorted(str(tuple(r[c] for c in op11_tries.COLUMNS)) for r in op11_tries.trie(op11_tries.shared_starts(op11_tries.turns(df))).collect())


@pytest.mark.parametrize("shard", [1, 150, 1 << 20])  # a tree for each key, for a few, for a partition
def test_trie_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(op11_tries, "SHARD", shard)
    rng = random.Random(7)
    rows = [(None, 1, "user", "lost"), (10, None, None, None), (10, None, "user", ""), (-3, 1, "user", "negativ"), (-5, 2, "a", "ü")]
    for c in range(60):
        for t in range(rng.randint(1, 10)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "hi", "é", "one two"]) if t else "hello"))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)] + [(100, 0, "user", "same 0")] * 2
    assert tries_of(spark, rows) == brute_trie(rows)


def test_trie_edges(spark):
    assert tries_of(spark, []) == []
    long = [(1, t, "user", "x" * 100_000) for t in range(3)] + [(2, t, "user", "x" * 100_000) for t in range(700)]
    assert tries_of(spark, long[:6]) == brute_trie(long[:6])
    found = op11_tries.trie(op11_tries.shared_starts(op11_tries.turns(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))))
    h = zlib.crc32(b"2") % 9  # conversation 0 is absent, so the first h turns go
    assert found.agg(F.max("depth")).first()[0] == max(700 - h, 3)


def test_ends_are_hashed_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(op11_tries, "SHARD", 40)
    monkeypatch.setattr(op11_tries, "PIECE", 3)
    rows = [(c, 0, "user", "a") for c in range(1000, 1090)]
    assert tries_of(spark, rows) == brute_trie(rows)


# --- packing -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = op12_curve.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


TEXTS = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "Other WORDS, é! " * 3000), (None, "no id"), (5, "x" * 9000), (6, " \t\n "), (7, "<|endoftext|> a")]


def packed(spark, rows, length=64, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})
    return op12_curve.pack(docs, length, **options)


def test_pack_keeps_every_id(spark, monkeypatch):
    monkeypatch.setattr(op12_curve, "PART", 500)
    monkeypatch.setattr(op12_curve, "LONG", 1000)
    sequences = packed(spark, TEXTS)
    tokenizer = op6_wavelet.tokenizer(op6_wavelet.default_tokenizer())
    want = Counter()
    for doc, text in TEXTS:
        want[doc, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    rows, got = sequences.collect(), defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == 64 or r["n_tokens"].bit_count() == 1 and r["n_tokens"] < 64
        ids, at = np.frombuffer(r["ids"], "<u4"), 0
        for p in r["pieces"]:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
            got[p["doc_id"]].append((p["start"], ids[p["offset"] : at].tolist(), p["doc_tokens"]))
        assert at == len(ids) == r["n_tokens"]
    for doc in {d for d, _ in want}:
        own = [ids for (d, ids), n in want.items() if d == doc for _ in range(n)]
        assert Counter((i, x) for ids in own for i, x in enumerate(ids)) == Counter((s + i, x) for s, ids, _ in got[doc] for i, x in enumerate(ids))
        assert {n for _, _, n in got[doc]} == {len(ids) for ids in own}
    crc = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in op12_curve.pieces_of(sequences).collect()}
    assert crc == {(r["sequence_id"], p["offset"]): zlib.crc32(r["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])]) for r in rows for p in r["pieces"]}
    assert packed(spark, []).count() == 0


def test_long_texts_are_encoded_as_whole():
    encode = op6_wavelet.Encoder(op6_wavelet.default_tokenizer(), 2)
    text = "Some words, (and) marks! é\n" * 80_000
    assert len(text) > 2 * op12_curve.LONG
    assert np.array_equal(op12_curve.encoded(pa.array([text]), encode)[0], encode(pa.array([text]))[0])


def test_plain_words_go_to_the_model_alone(monkeypatch):
    words = ["the", "straße", "étéîäëïöüÿ", "xqzzt", "aaaaaaaaaaaaaaaaa"]
    library = op6_wavelet.tokenizer(op6_wavelet.default_tokenizer())
    want = [library.encode(w, add_special_tokens=False).ids for w in words]

    class Texts:
        def encode_batch_fast(self, texts, **_):
            raise AssertionError(texts)

    encode = op6_wavelet.Encoder(op6_wavelet.default_tokenizer(), 2)
    monkeypatch.setattr(op6_wavelet, "tokenizer", lambda path: Texts())
    assert [np.frombuffer(x, np.uint32).tolist() for x in encode.learn(words)] == want
    with pytest.raises(AssertionError, match="don't"):
        encode.learn(["don't"])
    monkeypatch.undo()
    encode.spelled = None  # as where the model alone gives other ids
    assert [np.frombuffer(x, np.uint32).tolist() for x in encode.learn(["other", "words"])] == [library.encode(w, add_special_tokens=False).ids for w in ("other", "words")]


def test_buckets_are_the_hash_of_ids():
    ids = np.array([0, 1, 2, 49_407, 70_000], np.uint32)
    own = (op12_curve.shingles.mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(56)).astype(np.int64)
    assert (op12_curve.buckets(1 << 17)[ids] == own).all()
    assert op12_curve.vectors(ids[:0], np.array([0])).shape == (1, op12_curve.DIMS)


def test_neighbours_are_alike(spark):
    rng = random.Random(1)
    topics = [[f"{a}{b}" for b in "abcdefghij"] for a in ("sun", "moon", "tree", "rock", "fish", "bird")]
    rows = [(i, " ".join(rng.choices(topics[i % 6], k=40))) for i in range(300)]
    order = [p["doc_id"] for r in packed(spark, rows, 256).orderBy("sequence_id").collect() for p in r["pieces"]]
    alike = sum(a % 6 == b % 6 for a, b in zip(order, order[1:])) / (len(order) - 1)
    assert alike > 0.6  # a sixth by chance


# --- phrases -------------------------------------------------------------------------------------------------------


def brute_phrases(rows, longest=3, least=10, share=50, top=2000):
    import re

    f, out = defaultdict(Counter), []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= share * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((int(Fraction(1_000_000 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["the", "É", "x\x01y", "UP"]
    rows = [(rng.choice(["en", "en", "de", None, "und", "a b"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\x0b"]) for _ in range(60))) for _ in range(80)]
    return rows + [("en", "good old days " * 30), ("en", None), ("de", ""), ("de", " .,\t"), ("en", "the only " * 40)] * 2


def collected(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in EXTRA})
    return sorted(tuple(r) for r in op13_phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("buffer,hot,longest", [(16 << 20, 512, 3), (300, 3, 3), (700, 10**9, 4), (16 << 20, 512, 2)])
def test_phrases_match_brute_force(spark, monkeypatch, buffer, hot, longest):
    monkeypatch.setattr(op13_phrases, "BUFFER", buffer)
    monkeypatch.setattr(op13_phrases, "HOT", hot if hot < 10**9 else 512)
    rows = phrase_rows()
    assert collected(spark, rows, longest=longest) == brute_phrases(rows, longest)
    assert collected(spark, rows, longest=longest, least=3, top=5) == brute_phrases(rows, longest, 3, top=5)


def test_phrase_sums_over_small_batches():
    rows = phrase_rows()
    docs = pa.array([r[0] or "und" for r in rows]), pa.array([r[1] or "" for r in rows])
    whole = op13_phrases.lead_windows(*docs, 3)
    once, often = op13_phrases.Prefixes(3, 10, []), op13_phrases.Prefixes(3, 10, [])
    one = [once(whole), once(None)]
    many = [often(whole.slice(i, 1)) for i in range(whole.num_rows)] + [often(None)]

    def summed(batches):
        out = Counter()
        for b in batches:
            for r in b.to_pylist():
                out[r["lang"], r["w1"], r["w2"], r["w3"]] += r["n"]
        return out

    assert summed(one) == summed(many)


def test_windows_are_handed_back_in_parts():
    rows = phrase_rows()
    docs = pa.array([r[0] or "und" for r in rows]), pa.array([r[1] or "" for r in rows])
    parts = list(op13_phrases.window_batches(*docs, 3, 100))
    assert len(parts) > 10 and max(b.num_rows for b in parts) <= 100
    whole = op13_phrases.lead_windows(*docs, 3)
    assert [r for b in parts for r in b.to_pylist()] == whole.to_pylist()


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 200, 1, 1).select(F.lit("en").alias("lang"), F.repeat(F.lit("some words "), 1000).alias("text"))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    with op13_phrases.common.small_batches(spark, 100_000):
        assert max(r["n"] for r in sizes.collect()) < 200_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_windows_grow_with_the_documents():
    docs = [pa.array(["en"] * 50), pa.array([" ".join(f"d{i}w{j}" for j in range(40)) for i in range(50)])]
    again = [pa.array(["en"] * 250), pa.array([" ".join(f"d{i}w{j}" for j in range(40)) for i in range(250)])]
    assert [op13_phrases.lead_windows(*x, 3).num_rows for x in (docs, again)] == [2000, 10_000]


def test_phrases_exact_and_empty(spark):
    assert collected(spark, []) == []
    assert collected(spark, [("en", "?!"), (None, None)]) == []
    big = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    a, left, right = 3_000_000_000_000_007, 3_000_000_000_000_011, 7_777_777_777_777_777
    assert spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(big).first()[0] == 10**6 * a * a // (left * right)
