import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm.truncation import _LEFT, _NAMES, ORDERS, _ends, _final_hashes, _prefix_sums, _window_hashes, context_counts, copied_texts, cut_texts, shown, statement_end, stripped

SAY = ["Le score passe de {n} à {n} points quand le schéma est raccourci.", "La méthode retenue compare les résultats sans tenir compte de l'ordre.", "Parmi les {n} prédictions, {n} ne commencent pas par une instruction de lecture.", "Le quota de {n} exemples par base laisse de côté les niveaux rares.", "Les doublons ont été retirés en gardant la ligne la plus récente."]
END = ["", "", "", "\n\nTotal : {n}", "\n\n- {n} lignes gardées\n- table vérifiée", "\n\nCordialement,\nle pôle Dupont", "\n\nSELECT a FROM t WHERE b > {n};", " Et ainsi de suite...", "\n\n[fin]"]


def _texts(n, seed=1):
    rng = random.Random(seed)
    make = lambda: (" ".join(rng.choice(SAY) for _ in range(rng.randrange(3, 12))) + rng.choice(END)).replace("{n}", str(rng.randrange(1, 9999)))
    out, cut = [], set()
    for i in range(n):
        t, source = make(), rng.choice(["a", "b", None])
        if rng.random() < 0.15:
            t = t[: rng.randrange(30, len(t) - 25)]
            while t[-1] in ".\n":
                t = t[:-1]
            t += rng.choice(["", "", "...", " [...]", "�", "</p>", "\n"])
            cut.add(i)
        out.append((i, t, source, rng.choice(["fr", "FR", None]), None))
    return out, cut


COLUMNS = "k bigint, t string, s string, l string, b bigint"


def test_held_out_accuracy(spark):
    rows, cut = _texts(1500)
    got = {r["k"] for r in cut_texts(spark.createDataFrame(rows, COLUMNS), "k", "t", "s", "l", "b").where("cut").collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.05 * len(cut)


def test_odd_rows(spark):
    rows, _ = _texts(300, 2)
    rows += [(1000, None, None, None, None), (1001, "", "a", "fr", 5), (1002, "  \n", "a", "fr", 5), (1003, (SAY[1] + " ") * 30_000 + SAY[1], "a", "fr", None), (1004, rows[0][1], "a", "fr", None)]
    got = {r["k"]: r["cut"] for r in cut_texts(spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS cut", "2 AS lang"), "k", "t", "s", "l", "b").collect()}
    assert len(got) == 305 and not any(got[k] for k in (1000, 1001, 1002, 1003))
    assert cut_texts(spark.createDataFrame([], COLUMNS), "k", "t", "s", "l", "b").count() == 0


def test_marks_and_statements():
    assert [stripped(t) for t in ("a b...", "a b [...]", "a b…\n", "a b</p>", "a�", "a &am", "a b")] == ["a b", "a b", "a b", "a b", "a", "a", "a b"]
    assert shown("le lot ABC-123 de Paul Martin, 45") == "le lot k de n, 0"
    assert statement_end("x\n\nSELECT a FROM t WHERE b = 'c") == "open" and statement_end("x\n\nSELECT a FROM t;") == "closed" and statement_end("x\n\nSELECT a FROM t WHERE b = 1") == "whole"
    assert statement_end("```sql\nSELECT a FROM t\n```") == "closed" and statement_end("```sql\nSELECT a FROM t") == "open" and statement_end("On lit.") == ""


@pytest.mark.parametrize("n", [2, 7])
def test_windows_name_what_they_hold(n):
    buf = np.frombuffer(b"abcabcabdabcx" * 3, np.uint8)
    h = _window_hashes(_prefix_sums(buf), np.arange(len(buf)), n)
    by = {}
    for i in range(n - 1, len(buf)):
        assert by.setdefault(bytes(buf[i - n + 1 : i + 1]), h[i]) == h[i]
    assert len(set(by.values())) == len(by)


def test_counts_are_exact_and_only_copies_are_copies(spark):
    # different texts whose 23-bit checksums are the same, and one copy
    places = defaultdict(list)
    for i in range(20_000):
        places[zlib.crc32((t := f"{SAY[i % 5]} Reste {'abcdefghij'[i % 7]}{i} cas. Fin du lot {'klmnopqrst'[i % 9]}.").encode()) >> 9].append(t)
    texts = [t for same in places.values() if len(same) > 1 for t in same]
    assert len(texts) > 20
    texts.append(texts[0])
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert copied_texts(df, "text").count() == 1
    told = df.withColumn("copied", F.col("text") == texts[0])
    contexts = told.mapInArrow(_ends, "copied boolean, statement string, " + ", ".join(f"{c} bigint" for c in _NAMES)).select(*_NAMES).distinct()
    got = {(r["o"], r["h"]): (r["n"], r["b"]) for r in context_counts(told, contexts).collect()}
    n, b = Counter(), Counter()
    for t in texts:
        seen = "\2" * max(ORDERS) + shown(t)
        last = len(seen) - (t == texts[0])
        for i in range(max(ORDERS), last):
            end = i + 1 == len(seen) or (seen[i] in ".!?" and seen[i + 1] == " ")
            for o, k in enumerate(ORDERS):
                n[o, seen[i + 1 - k : i + 1]] += 1
                b[o, seen[i + 1 - k : i + 1]] += end
    for t in texts:
        for o, h in enumerate(_final_hashes([t])):
            context = ("\2" * max(ORDERS) + shown(t))[-ORDERS[o] :]
            assert got.get((o, int(h.view(np.int64)[0])), (0, 0)) == (n[o, context], b[o, context])


def test_what_is_left_is_told_by_the_last_characters():
    ends = ["", ".", "...", "....", "…", "[…]", "[...", " [", " [.", " [..", "\n", "\u00a0", "<p", "</p>", "<br>", "&", "&amp", "&amp;", "&x1", "\\", "\\u", "\\u00e", "\ufffd", "]", "a[", "1", ";", "> ", "…]", " .", "<é"]
    rng = random.Random(4)
    for _ in range(4000):
        text = "mot" + "".join(rng.choice(ends + ["a", " b", "Z9"]) for _ in range(rng.randrange(5)))
        slow = text
        while slow and (m := _LEFT.search(slow, max(0, len(slow) - 200))):
            slow = slow[: m.start()]
        assert stripped(text) == slow, text
