import random

import pytest

from sheaf.operators import linking, taxonomy

KB = "entity_id string, name string, type string, aliases array<string>, attributes map<string,string>"
ROWS = [
    ("t1", "Manchester United", "TEAM", ["Man Utd", "Red Devils"], {"city": "Manchester"}), ("p1", "John Smith", "PERSON.PLAYER", None, {"team": "Manchester United"}),
    ("p2", "John Smith", "PERSON.PLAYER", [], {"team": "Leeds"}), ("m1", "Alex Fergusson", "PERSON.MANAGER", ["Sir Alex"], None),
]


def ask(spark, rows):
    return spark.createDataFrame(rows, "mention_id long, text string, type string, context string")


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_candidates(spark, threshold):
    kb = spark.createDataFrame(ROWS, KB)
    got = linking.candidates(ask(spark, [(1, "manchester united!", "TEAM", ""), (2, "Man Utd", "TEAM", ""), (3, "Manchester Unite", "TEAM", ""), (4, "John Smith", "PERSON", ""), (5, "Man Utd", "PERSON", ""), (6, "Alex Ferguson", None, ""), (7, None, None, ""), (8, "John Smith", "PERSON.MANAGER", "")]), kb, threshold)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.mention_id, []).append((r.entity_id, round(r.score, 3), r.rank))
    assert rows[1] == [("t1", 1.0, 1)] and rows[2] == [("t1", 0.9, 1)] and rows[3] == [("t1", round(0.8 * 16 / 17 + 0.2, 3), 1)]
    assert sorted(rows[4]) == [("p1", 1.0, 1), ("p2", 1.0, 2)] and 5 not in rows and rows[6][0] == ("m1", round(1 - 1 / 14, 3), 1) and 7 not in rows and 8 not in rows


def test_fuzzy_candidates_against_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 7)))
    names, texts = [word() for _ in range(60)], [word() for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    def score(a, b):
        if a in b or b in a:
            return 0.8 * min(len(a), len(b)) / max(len(a), len(b)) + 0.2
        return 1 - distance(a, b) / max(len(a), len(b))

    kb = spark.createDataFrame([(f"{i:02d}", n, "T", None, None) for i, n in enumerate(names)], KB)
    got = {(x.mention_id, x.entity_id) for x in linking.candidates(ask(spark, [(i, t, "T", "") for i, t in enumerate(texts)]), kb, 0.7, 100).collect()}
    want = {(i, f"{k:02d}") for i, t in enumerate(texts) for k, n in enumerate(names) if (t == n if t in names else score(t, n) >= 0.7)}
    assert got == want


def test_context_decides_between_equal_names(spark):
    kb = spark.createDataFrame(ROWS, KB)
    mentions = ask(spark, [(1, "John Smith", "PERSON", "John Smith scored for Leeds, and Leeds won"), (2, "Sir Alex", "PERSON", ""), (3, "Nobody", "PERSON", "")])
    links = linking.link(mentions, kb, threshold=0.8)
    assert sorted((r.mention_id, r.entity_id, r.linked_by) for r in links.collect()) == [(1, "p2", "context"), (2, "m1", "only")]
    assert [r.mention_id for r in linking.unlinked(mentions, links).collect()] == [3]
    new = linking.suggest(linking.unlinked(mentions, links), kb, "football")
    assert [tuple(r) for r in new.collect()] == [("football_person_1", "Nobody", "PERSON")]


def test_taxonomy_file_round_trip_and_keywords(spark, tmp_path):
    import json

    tree = [{"id": "s", "name": "Sport", "keywords": ["Match"], "children": [{"id": "f", "name": "Football \"cup\"", "keywords": ["Goal", "Kick"], "children": []}, {"name": "Chess", "children": []}]}, {"id": "e", "name": "Empty"}]
    (tmp_path / "t.json").write_text(json.dumps({"root_nodes": tree}))
    topics = taxonomy.load(spark, str(tmp_path / "t.json"))
    assert sorted(tuple(r) for r in taxonomy.paths(topics).collect()) == [("e", 0, "Empty"), ("f", 1, 'Sport > Football "cup"'), ("s", 0, "Sport"), ("s/Chess", 1, "Sport > Chess")]
    back = {r.topic_id: json.loads(r.tree) for r in taxonomy.nested(topics).collect()}
    assert back["s"]["children"][0] == {"id": "f", "name": 'Football "cup"', "keywords": ["Goal", "Kick"], "children": []} and [c["name"] for c in back["s"]["children"]] == ['Football "cup"', "Chess"]
    assert {r.keyword for r in taxonomy.domain_keywords(topics, {"Sport": ["Derby"]}).collect()} == {"match", "sport", "goal", "kick", "football", '"cup"', "derby"}
    scores = spark.createDataFrame([(1, "s", 0.1), (1, "f", 0.9), (1, "s/Chess", 0.2), (1, "e", 0.3)], "doc_id long, topic_id string, score double")
    assert sorted(tuple(r) for r in taxonomy.hierarchical(scores, topics).collect()) == [(1, "e", 0, 0.3), (1, "f", 1, 0.9), (1, "s", 0, 0.1)]
