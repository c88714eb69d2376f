import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm.packing import TOKENIZER, best_fit, encoder, improve, pack, packed


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_everything_once(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.choice([0, 1, 30, 48, 52, 70]) if seed % 2 else rng.randrange(1, 101) for _ in range(300)])
    bins = pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sizes[b].sum() <= 100 for b in bins)
    assert len(bins) <= len(best_fit(sizes[sizes > 0], 100)) and len(bins) >= -(-sizes.sum() // 100)


def test_search_empties_bins():
    # best fit leaves three bins where two are enough
    sizes = np.array([6, 5, 5, 4, 0])[:4]
    start = [[0], [1, 3], [2]]
    better = improve(start, sizes, 10)
    assert len(better) == 2
    fills = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
    assert fills(better) >= fills(start) and start == [[0], [1, 3], [2]]


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_pieces_and_rounds(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("mot" for _ in range(rng.randrange(1, 60)))) for i in range(400)] + [(500, None), (501, ""), (502, "mot " * 950)]
    df = spark.createDataFrame(rows, "k bigint, t string").withColumn("piece", F.lit(1))
    got = packed(df, "k", "t", 128, block=64)
    bins = got.groupBy("bin_id").agg(F.sum("tokens").alias("n")).collect()
    total = sum(len(encoder(TOKENIZER).encode_ordinary(t)) for _, t in rows if t)
    assert sum(r["n"] for r in bins) == total and max(r["n"] for r in bins) <= 128 and len(bins) <= 1.05 * -(-total // 128) + 1
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r["key"], []).append((r["piece"], r["first_token"], r["tokens"]))
    assert len(pieces) == 403 and all(len(p) == 1 for k, p in pieces.items() if k != 502)
    split = sorted(pieces[502])
    assert [p for p, *_ in split] == list(range(len(split))) and all(n == 128 for *_, n in split[:-1])
    assert packed(df.limit(0), "k", "t", 128).count() == 0
