import numpy as np
import pytest

from tamis.llm.clauses import clauses, unwrap, without_comments
from tamis.llm.crf import ChainField, Sequences
from tamis.llm.defects import broken_pairs
from tamis.llm.statements import open_state

SCHEMA = "CREATE TABLE bateau (\n id INTEGER,\n nom TEXT,\n tonnage INTEGER\n);\n\nCREATE TABLE port (\n port_id INTEGER,\n ville TEXT\n);"
QUESTION = "Donne le nom des bateaux dont le tonnage dépasse 5000 et dont le port est Brest ?"


def _whole(n):
    """Statements of several forms with their questions, as a table holds them."""
    ends = ["", ";", " AND id IN (SELECT port_id FROM port WHERE ville LIKE 'B{i}%' AND port_id {o} {i})", " GROUP BY nom ORDER BY tonnage DESC LIMIT {i}", " AND tonnage BETWEEN {i} AND {j}", " EXCEPT SELECT nom FROM bateau WHERE id IN ({i}, 7)"]
    for i in range(n):
        end = ends[i % 6].format(i=i, j=2 * i, o=">=<"[i % 3])
        if i % 5 == 0:
            yield f"Quelle ville a le port {i} ?", f"SELECT ville FROM port WHERE port_id = {i}", SCHEMA
        elif i % 5 == 1:
            yield f"Les bateaux du port Brest{i} au-delà de {5000 + i} ?", f"SELECT T1.nom FROM bateau AS T1 JOIN port AS T2 ON T1.id = T2.port_id WHERE T2.ville = 'Brest{i}' AND T1.tonnage > {5000 + i}", SCHEMA
        else:
            yield f"Donne le nom des bateaux dont le tonnage dépasse {5000 + i} et le nom est Le Fier{i} ?", f"SELECT nom FROM bateau WHERE tonnage > {5000 + i} AND nom = 'Le Fier{i}'{end}", SCHEMA


@pytest.fixture(scope="module")
def tagged(spark):
    whole = [(i, *x) for i, x in enumerate(_whole(180))]
    odd = {
        200: ("", "empty"), 201: (None, "empty"), 202: ("```sql\n```", "empty"), 203: ("-- TODO", "empty"), 204: (" ; ", "empty"), 205: ("N/A", "empty"), 206: ("{}", "empty"),
        210: ("Désolé, je ne peux pas écrire cette requête.", "refusal"), 211: ("/* I cannot help with that request */ SELECT NULL", "refusal"), 212: ("SELECT 'Lo siento, no puedo responder.'", "refusal"), 213: ('{"error": "Sorry, I must decline."}', "refusal"),
        220: (QUESTION, "copy"), 221: ("-- " + QUESTION, "copy"), 222: (QUESTION.upper(), "copy"),
        230: ("You would take the rows of bateau whose tonnage is above 5000 and then show the nom.", "language"), 231: ('df_bateau[(df_bateau["tonnage"] > 5000)][["nom"]]', "language"), 232: ("SELECCIONAR nom DE bateau DONDE tonnage > 5000", "language"),
        240: ("SELECT nom FROM bateau WHERE tonnage >", "truncated"), 241: ("SELECT nom FROM bateau WHERE ton", "truncated"), 242: ("```sql\nSELECT nom FROM bateau WHERE nom IN ('a', 'b", "truncated"), 243: ("SELECT nom FROM bateau WHERE nom = 'x' AND ton [...]", "truncated"),
        250: ("```sql\nSELECT nom FROM bateau WHERE tonnage > 5000\n```", None), 251: ("/* cannot use an index */ SELECT nom FROM bateau WHERE tonnage > 5000", None), 252: ("SELECT ville FROM port WHERE port_id = 3", None),
    }
    asked = {252: "Quelle ville a le port 3 ?"}
    rows = whole + [(k, asked.get(k, QUESTION), s, SCHEMA) for k, (s, _) in odd.items()] + [(300, None, "SELECT ville FROM port WHERE port_id = 1", None), (301, None, None, None), (302, QUESTION, "SELECT nom FROM bateau WHERE nom IN (" + ", ".join(f"'{i}'" for i in range(20000)) + ")", SCHEMA)]
    df = spark.createDataFrame(rows, "k bigint, q string, r string, s string").selectExpr("*", "1 AS defect")
    return {r["k"]: r["defect"] for r in broken_pairs(df, "k", "q", "r", "s").collect()}, {k: d for k, (_, d) in odd.items()}


def test_defects_by_hand(tagged):
    got, want = tagged
    assert {k: got.get(k) for k in want} == want
    assert not [k for k in got if k < 200]
    assert got.get(300) is None and got.get(301) == "empty" and got.get(302) is None


# Wording that no part of the training text holds; the records are others too.
HELD_OUT = [
    ("refusal", ["Veuillez m'excuser, je n'ai pas l'autorisation de consulter ces lignes.", "Non, je ne le ferai pas : ce registre est secret.", "I'm sorry Dave, I cannot do that for you.", "We regret that we are not permitted to disclose this.", "No puedo responder a esa petición.", "Ich kann das leider nicht schreiben.", "/* I won't do it without permission. */ SELECT NULL", "SELECT 'Je ne peux pas faire cela'", '{"message": "This cannot be answered, sorry"}', "Je suis désolé mais il n'est pas possible de répondre."]),
    ("language", ["Prends chaque ligne de bateau, compare tonnage avec 5000 et donne nom.", "From bateau keep tonnage greater than 5000, then read nom of each.", "Nimm bateau, vergleiche tonnage mit 5000, gib nom zurück.", "bateau.where(bateau.tonnage > 5000).select('nom').toPandas()", "db.bateau.find({tonnage: {$gt: 5000}}, {nom: 1})", "MATCH (b:bateau) WHERE b.tonnage > 5000 RETURN b.nom", "SELECCIONAR nom DE bateau DONDE tonnage > 5000", "WÄHLE nom AUS bateau WO tonnage > 5000 UND nom = 'Ana'", "bateau |> filter(tonnage > 5000) |> pull(nom)", "[b.nom for b in bateau if b.tonnage > 5000]"]),
    ("empty", ["--", "n/d", "(à écrire)", "```\n```", "<sql></sql>", "None."]),
    ("truncated", ["SELECT nom FROM bateau WHERE tonnage > 5000 AND nom LIKE", "SELECT nom FROM bateau WHERE tonnage BETWEEN 5000", "SELECT nom FROM bateau JOIN port ON port.port_id", "SELECT nom FROM bateau WHERE id IN (SELECT port_id FROM port WHERE ville = 'Brest'", "SELECT nom, ton", "SELECT nom FROM bateau WHERE nom = 'Br", "SELECT count(*) FROM bateau WHERE tonnage > 5000 GROUP BY", "SELECT nom FROM bateau WHERE tonnage > 50"]),
    ("copy", [QUESTION.lower(), f"Voici la question : {QUESTION}", f"-- {QUESTION}\n", f"SELECT '{QUESTION}'"]),
    (None, ["SELECT nom FROM bateau WHERE tonnage > 5000 AND nom LIKE '%a'", "SELECT b.nom FROM bateau AS b JOIN port AS p ON b.id = p.port_id WHERE p.ville = 'Brest' AND b.tonnage > 5000", "select max(tonnage) from bateau where tonnage > 5000 group by nom order by nom desc limit 3;", "SELECT nom FROM bateau WHERE tonnage BETWEEN 5000 AND 6000", "/* Je ne peux pas garantir l'ordre */ SELECT nom FROM bateau WHERE tonnage > 5000", "SELECT nom FROM bateau WHERE id IN (SELECT port_id FROM port WHERE ville = 'Brest' AND port_id > 5000)"]),
]


def test_wording_held_out(spark):
    whole = [(1000 + i, *x) for i, x in enumerate(_whole(240))]
    texts = [(w, t) for w, ts in HELD_OUT for t in ts]
    df = spark.createDataFrame(whole + [(i, QUESTION, t, SCHEMA) for i, (_, t) in enumerate(texts)], "k bigint, q string, r string, s string")
    got = {r["k"]: r["defect"] for r in broken_pairs(df, "k", "q", "r", "s").collect()}
    right = [got.get(i) == w for i, (w, _) in enumerate(texts)]
    assert sum(right) >= 0.85 * len(texts), [(w, got.get(i), t) for i, (w, t) in enumerate(texts) if got.get(i) != w]
    assert not [i for i, (w, _) in enumerate(texts) if w is None and got.get(i)]  # no whole statement is called broken
    assert len([k for k in got if k >= 1000]) <= 2


def test_nothing(spark):
    assert broken_pairs(spark.createDataFrame([], "k bigint, q string, r string, s string"), "k", "q", "r", "s").count() == 0


@pytest.mark.parametrize(
    ("sql", "state"),
    [
        ("SELECT a FROM t WHERE x = 1", "whole"), ("SELECT a FROM t WHERE x BETWEEN 1 AND 2)", "whole"), ("SELECT a FROM t WHERE x BETWEEN 1", "dangling"), ("SELECT a FROM t WHERE x = 'it''s'", "whole"), ("SELECT a FROM t WHERE x = 'it", "quote"),
        ("SELECT a FROM t WHERE x IN (1, 2", "paren"), ("SELECT a FROM t WHERE", "dangling"), ("SELECT a FROM t WHERE x", "nopredicate"), ("SELECT a", "nofrom"), ("SELECT a FROM t JOIN u", "nojoin"), ("SELECT a FROM t LIMIT 5;", "whole"), ("SELECT a FROM t ...", "ellipsis"), ("", "whole"),
    ],
)
def test_open_state(sql, state):
    assert open_state(sql, frozenset(), frozenset()) == state


def test_unwrap():
    assert unwrap("```sql\nSELECT 1\n```") == "SELECT 1" and unwrap('"SELECT 1"') == "SELECT 1" and unwrap(None) == "" and unwrap('{"sql": "SELECT 1"}') == "SELECT 1"
    assert [c[2] for c in clauses("SELECT a -- note\nFROM t", "q", "")] == [False, True, True] and clauses("--- ;", "q", "") == []
    assert without_comments("SELECT '--x' FROM t -- y") == ("SELECT '--x' FROM t  ", [" y"])


def test_ends_of_statements():
    """The features of an end see literals, parentheses and what the question asked."""
    last = lambda sql, q="": set(clauses(sql, q, SCHEMA)[-1][0])
    assert {"last=s", "part=where|I = s"} <= last("SELECT nom FROM bateau WHERE nom = 'Le F")
    assert {"last=N<", "lack=all|where|N<"} <= last("SELECT nom FROM bateau WHERE tonnage > 50", "plus de 5000 ?")
    assert {"last=N=", "lack=0|where|N="} <= last("SELECT nom FROM bateau WHERE tonnage > 5000", "plus de 5000 ?")
    assert {"last=P", "open=1"} <= last("SELECT nom FROM bateau WHERE id IN (SELECT por")
    assert "part=where|I between N and N=" in last("SELECT nom FROM bateau WHERE tonnage BETWEEN 1 AND 2") and "last=N" in last("SELECT nom FROM bateau LIMIT 5", "50 ?")


def test_field_learns_and_its_gradient_is_right():
    rng = np.random.default_rng(1)
    seqs, labels = [], []
    for _ in range(60):
        tags = [0]
        for _ in range(rng.integers(1, 6)):
            tags.append(int(rng.integers(0, 2)) if tags[-1] == 0 else 0)
        seqs.append([[t] if rng.random() < 0.9 else [2] for t in tags])
        labels += tags
    s = Sequences(seqs)
    field = ChainField(3, 2).fit(s, np.array(labels), np.ones(len(seqs)), rounds=150)
    assert (field.tag(s) == np.array(labels)).mean() > 0.95
    single, moves = field._marginals(s, np.ones(len(seqs)))
    assert np.allclose(single[s.mask].sum(axis=1), 1) and np.isclose(moves.sum(), s.mask[:, 1:].sum())
