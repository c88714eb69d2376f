import random
from collections import Counter

import numpy as np
import pytest

from tamis.functions.words import words
from tamis.llm import neardup
from tamis.llm.neardup import frequency_levels, least_matches, record_nodes, similar_nodes, similar_records
from tamis.llm.shingles import pair_sets, word_hashes
from tamis.session import materialize


def _pairs(rows, t):
    sets = {}
    for k, a, b in rows:
        wa, wb = words(a), words(b)
        sets[k] = set(zip(wa, wa[1:], strict=False)) | set(zip(wb, wb[1:], strict=False))
    keys = sorted(sets)
    return {(x, y) for i, x in enumerate(keys) for y in keys[i + 1 :] if sets[x] | sets[y] and len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y]) - 1e-9}


def _rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for _ in range(n // 4)]
    out = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((k, " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])))
    return [*out, (n, None, None), (n + 1, "one", ""), (n + 2, out[0][1], out[0][2]), (n + 3, "É" * 5000 + " x y", "z")]


@pytest.mark.parametrize(("seed", "t"), [(1, 0.65), (2, 0.8), (3, 0.5)])
def test_pairs_by_brute_force(spark, seed, t):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "k bigint, a string, b string")
    assert {tuple(r) for r in similar_records(df, "k", ["a", "b"], t).collect()} == _pairs(rows, t)


def test_hot_lists_are_spread(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    rows = _rows(4)
    df = spark.createDataFrame(rows, "k bigint, a string, b string")
    assert {tuple(r) for r in similar_records(df, "k", ["a", "b"], 0.65).collect()} == _pairs(rows, 0.65)


@pytest.mark.parametrize("bits", [16, 20])
def test_full_sketches_and_trees_lose_nothing(spark, monkeypatch, bits):
    """With few counters every one holds collisions and all word pairs seem hot; the exact counts keep lists whole and apart."""
    monkeypatch.setattr(neardup, "BLOCK_BITS", 2)
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "FAN", 2)
    rows = _rows(6, 160)
    df = spark.createDataFrame(rows, "k bigint, a string, b string").repartition(9)
    nodes = materialize(record_nodes(df, "k", ["a", "b"]).repartition(9), "nodes")
    want = {(x["a"], x["b"]) for x in similar_nodes(df, nodes, "k", ["a", "b"], 0.65).collect()}
    assert {(x["a"], x["b"]) for x in similar_nodes(df, nodes, "k", ["a", "b"], 0.65, bits=bits - 14).collect()} == want and len(want) > 20
    if bits == 16:  # hashes of two bytes: most word pairs agree with others
        monkeypatch.setattr(neardup, "KEPT", 2)
        coarse = materialize(record_nodes(df, "k", ["a", "b"]), "coarse")
        assert {(x["a"], x["b"]) for x in similar_nodes(df, coarse, "k", ["a", "b"], 0.65, bits=8).collect()} == want
        monkeypatch.setattr(neardup, "KEPT", 5)
    levels = frequency_levels(nodes, bits)
    pairs = pair_sets([[r[1] for r in rows], [r[2] for r in rows]])
    sets = {i: set(pairs[0][pairs[1] == i].tolist()) for i in range(len(rows))}
    counts = Counter(p >> (64 - bits) for s in {frozenset(s) for s in sets.values()} for p in s)
    assert all((levels[p] <= 1) == (n <= 1) or levels[p] > 1 for p, n in counts.items()) and (levels > 0).sum() == len(counts)


def test_copies_are_one_node(spark):
    rows = [(i, "the same few words here", "select x from y") for i in range(300)] + [(1000, "the same few words there", "select x from y")]
    df = spark.createDataFrame(rows, "k bigint, a string, b string")
    nodes = record_nodes(df, "k", ["a", "b"])
    assert nodes.select("id").distinct().count() == 2 and similar_nodes(df, nodes, "k", ["a", "b"], 0.5).count() == 1


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 0), (2, "a b c d", "y", 0)], "id bigint, sig string, b string, rec int")
    assert [tuple(r) for r in similar_records(df, "id", ["sig", "b"], 0.5).collect()] == [(1, 2)]


def test_empty(spark):
    assert similar_records(spark.createDataFrame([], "k bigint, a string, b string"), "k", ["a", "b"], 0.65).count() == 0


def test_hashes_follow_words():
    texts = ["Été à l'eau", None, "", "a1 b2\na1\1b2", "x" * 9000]
    h, text = word_hashes(texts)
    flat = [w for t in texts for w in words(t)]
    assert len(h) == len(flat) and [list(text).count(i) for i in range(len(texts))] == [len(words(t)) for t in texts]
    by = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    pairs, record, sizes = pair_sets([["a b a b", "", None], ["c", "d e", ""]])
    assert sizes.tolist() == [2, 1, 0] and record.tolist() == [0, 0, 1] and len(np.unique(pairs)) == 3


def test_pruning_is_cautious():
    least = least_matches(0.65)
    assert all(a <= b for a, b in zip(least, least[1:], strict=False)) and 15 < least[-1] < 30
