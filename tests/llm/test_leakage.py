import random

import numpy as np
import pytest

from tamis.functions.words import words
from tamis.llm import leakage
from tamis.llm.leakage import _packed, leaked_passages


def _runs(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _case(seed):
    rng = random.Random(seed)
    vocabulary = [f"m{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(3, 40)), say(rng.randrange(0, 30))) for i in range(12)] + [(50, None, "")]
    docs = []
    for d in range(60):
        t = say(rng.randrange(0, 60))
        if d % 3 == 0:
            w = words(items[d % 12][1])
            a = rng.randrange(0, max(1, len(w) - 5))
            t += ". " + ", ".join(w[a : a + rng.randrange(4, 20)]).upper() + " " + say(5)
        docs.append((d, t))
    return [*docs, (100, None), (101, ""), (102, docs[0][1]), (103, docs[0][1] * 400)], items


@pytest.mark.parametrize(("seed", "least", "shard"), [(1, 10, 1_000_000), (2, 4, 1_000_000), (3, 5, 40)])
def test_pairs_by_brute_force(spark, monkeypatch, seed, least, shard):
    monkeypatch.setattr(leakage, "SHARD_WORDS", shard)
    docs, items = _case(seed)
    want = {(d, i) for d, t in docs for i, a, b in items if _runs(t, least) & (_runs(a, least) | _runs(b, least))}
    got = leaked_passages(spark.createDataFrame(docs, "k bigint, t string"), "k", "t", spark.createDataFrame(items, "i bigint, a string, b string"), "i", ["a", "b"], least).collect()
    assert {(r["doc"], r["item"]) for r in got} == want and want
    text, item = dict(docs), {i: {"a": a, "b": b} for i, a, b in items}
    for r in got:
        d, t = words(text[r["doc"]]), words(item[r["item"]][r["field"]])
        n = r["words"]
        assert d[r["doc_word"] : r["doc_word"] + n] == t[r["item_word"] : r["item_word"] + n]
        assert not _runs(text[r["doc"]], n + 1) & _runs(item[r["item"]][r["field"]], n + 1)


def test_blocks_of_items_and_nothing(spark, monkeypatch):
    docs, items = _case(4)
    d, i = spark.createDataFrame(docs, "k bigint, t string"), spark.createDataFrame(items, "i bigint, a string, b string")
    whole = {tuple(r) for r in leaked_passages(d, "k", "t", i, "i", ["a", "b"], 4).collect()}
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 20)
    assert {tuple(r) for r in leaked_passages(d, "k", "t", i, "i", ["a", "b"], 4).collect()} == whole
    assert leaked_passages(d.limit(0), "k", "t", i, "i", ["a", "b"]).count() == 0
    assert leaked_passages(d, "k", "t", i.limit(0), "i", ["a", "b"]).count() == 0


def test_keys_of_large_vocabularies_do_not_overlap():
    """Word numbers of any width keep suffixes apart: keys are equal only where all words are."""
    for top in (3, (1 << 21) + 5, (1 << 31) + 7):
        bits = top.bit_length()
        words = np.array([1, top, 0, top - 1, 1, top, 0, top - 1, top, 1, 0, 0, 2, 3, 1], np.int64)
        starts = np.arange(6)
        keys = np.stack(_packed(words, starts, 10, bits), axis=1)
        want = [tuple(words[s : s + 10]) for s in starts]
        assert all((keys[i].tolist() == keys[j].tolist()) == (want[i] == want[j]) and (tuple(keys[i]) < tuple(keys[j])) == (want[i] < want[j]) for i in range(6) for j in range(6))
