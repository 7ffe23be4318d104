import itertools
import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import claims, crawl, graph

EDGES = "source_id long, target_id long, relationship_type string, confidence double"
NODES = "node_id long, node_type string, name string, domain string, confidence double"


def world(spark, seed=1, n=14, m=22):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n), r.choice("xyz")) for _ in range(m)}
    edges = [(a, b, t, round(r.random(), 2)) for a, b, t in sorted(pairs) if a != b]
    return edges, spark.createDataFrame(edges, EDGES)


def simple_paths(edges, start, length):
    out, level = [], [[start]]
    for _ in range(length):
        level = [p + [y] for p in level for a, b, _, _ in edges for x, y in ((a, b), (b, a)) if x == p[-1] and y not in p]
        out += level
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_against_enumeration(spark, seed):
    edges, df = world(spark, seed)
    every = simple_paths(edges, 0, 3)
    got = graph.all_paths(df, 0, max_length=3).collect()
    assert sorted(r.path for r in got) == sorted(every)
    assert all(len(r.types) == len(r.directions) == len(r.path) - 1 for r in got)
    end = every[-1][-1]
    assert sorted(r.path for r in graph.all_paths(df, 0, end, 3).collect()) == sorted(p for p in every if p[-1] == end)
    best = {}
    for p in sorted(simple_paths(edges, 0, 4), key=lambda p: (len(p), p)):
        best.setdefault(p[-1], p)
    assert {r.target: r.path for r in graph.shortest_paths(df, 0, 4).collect()} == best
    assert [r.node_id for r in graph.find_path(df, 0, end, 4).orderBy("step").collect()] == best[end]
    assert graph.find_path(df, 0, 999).count() == 0


def test_paths_keep_the_confidence_and_type_asked_for(spark):
    edges, df = world(spark)
    some = [e for e in edges if e[3] >= 0.5 and e[2] == "x"]
    assert sorted(r.path for r in graph.all_paths(df, 0, max_length=2, types=["x"], min_confidence=0.5).collect()) == sorted(simple_paths(some, 0, 2))


def test_subgraph_is_the_nearest_nodes_and_their_edges(spark):
    edges, df = world(spark)
    nodes = spark.createDataFrame([(i, "entity", f"n{i}", "d", 1.0) for i in range(14)], NODES)
    depth = {0: 0}
    for p in simple_paths(edges, 0, 2):
        depth[p[-1]] = min(depth.get(p[-1], 9), len(p) - 1)
    near = sorted(depth, key=lambda n: (depth[n], n))[:5]
    inside, between = graph.subgraph(nodes, df, 0, max_depth=2, max_nodes=5)
    assert sorted((r.node_id, r.depth) for r in inside.collect()) == sorted((n, depth[n]) for n in near)
    assert sorted((r.source_id, r.target_id, r.relationship_type) for r in between.collect()) == sorted(e[:3] for e in edges if e[0] in near and e[1] in near)


def test_hierarchy_ends_in_circles(spark):
    df = spark.createDataFrame([(2, 1, "part_of", 1.0), (3, 2, "part_of", 1.0), (1, 3, "part_of", 1.0), (4, 2, "other", 1.0)], EDGES)
    assert sorted((r.node_id, r.parent, r.depth) for r in graph.hierarchy(df, 1, ["part_of"], 9).collect() if r.depth) == [(2, 1, 1), (3, 2, 2)]


def test_neighbors_fill_the_limit_with_incoming(spark):
    df = spark.createDataFrame([(1, 2, "a", 1.0), (1, 3, "b", 1.0), (4, 1, "a", 1.0), (5, 1, "a", 1.0)], EDGES)
    assert [(r.node_id, r.direction) for r in graph.neighbors(df, 1, limit=3).collect()] == [(2, "outgoing"), (3, "outgoing"), (4, "incoming")]
    assert [r.node_id for r in graph.neighbors(df, 1, types=["b"]).collect()] == [3]


def test_upserts_updates_and_deletions(spark):
    nodes = spark.createDataFrame([(1, "entity", "Ann  Lee", "d", 0.5), (2, "entity", "Bob", "d", 0.6), (3, "concept", "Bob", "e", 0.7)], NODES)
    edges = spark.createDataFrame([(1, 2, "knows", 1.0), (2, 3, "is", 1.0)], EDGES)
    new = spark.createDataFrame([("ANN LEE", "d"), ("Cid", "d"), ("cid ", "d"), (" ", "d"), ("Ann Lee", "e")], "name string, domain string")
    assert sorted((r.canonical, r.domain) for r in graph.upsert_nodes(nodes, new).collect()) == [("ann lee", "e"), ("cid", "d")]
    more = spark.createDataFrame([(1, 2, "knows", 0.1), (1, 3, "knows", 0.2), (1, 3, "knows", 0.3), (1, 9, "knows", 0.4)], EDGES)
    assert [(r.source_id, r.target_id) for r in graph.upsert_edges(nodes, edges, more).collect()] == [(1, 3)]
    rows = spark.createDataFrame([(1, {"a": "1", "b": "2"}, 0.5), (2, None, None)], "node_id long, attributes map<string,string>, confidence double")
    change = spark.createDataFrame([(1, {"b": "3", "c": "4"}, None), (2, {"d": "5"}, 0.9)], rows.schema)
    assert sorted((r.node_id, dict(r.attributes), r.confidence) for r in graph.update_rows(rows, change, ["node_id"]).collect()) == [(1, {"a": "1", "b": "3", "c": "4"}, 0.5), (2, {"d": "5"}, 0.9)]
    left, kept = graph.delete_nodes(nodes, edges, spark.createDataFrame([(3,)], "node_id long"))
    assert left.count() == 2 and [(r.source_id, r.target_id) for r in kept.collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        graph.delete_domain(nodes, edges, "d")
    assert [r.node_id for r in graph.delete_domain(nodes, edges, "d", confirmed=True)[0].collect()] == [3]
    assert [(r.source_id, r.target_id) for r in graph.merge_nodes(edges, ["source_id", "target_id"], 1, 2).orderBy("target_id").collect()] == [(1, 1), (1, 3)]


def test_contradictions_against_all_pairs(spark):
    r = random.Random(3)
    texts = ["The club will win the cup this year", "The club will lose the cup this year", "it is false that Ann left", "Ann left", "Short win", "short lose", "They confirm the deal of the year", "they deny the deal of the year"]
    rows = [(i, r.randrange(3), r.choice(["factual", "opinion"]), r.choice([-1.0, 0.0, 0.5, 1.0]), r.choice(texts), r.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "claim_id long, entity_id long, claim_type string, sentiment double, content string, confidence double")

    def why(x, y):
        a, b = x[4].lower(), y[4].lower()
        if abs(x[3] - y[3]) > 1:
            return "sentiment_conflict"
        if any(m in a for m in claims.NEGATIONS) and b in a or any(m in b for m in claims.NEGATIONS) and a in b:
            return "direct_negation"
        common = set(a.split()) & set(b.split())
        if x[2] == y[2] == "factual" and len(a) > 20 and len(b) > 20 and len(common) > 0.5 * min(len(set(a.split())), len(set(b.split()))):
            if any(p in a and q in b or q in a and p in b for p, q in claims.OPPOSED):
                return "factual_conflict"
        return None

    same = lambda x: (x[1], x[2], x[3], x[4].lower())
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if x[1] == y[1] and same(x) != same(y) and (k := why(x, y)):
            want[k] = want.get(k, 0) + 1
    of = claims.classes(df)
    got = {r.kind: r.n for r in claims.conflicts(of).groupBy("kind").agg(F.sum("n_pairs").alias("n")).collect()}
    assert got == want and set(got) == {"sentiment_conflict", "direct_negation", "factual_conflict"}
    assert claims.members(df, of).count() == 60
    record = claims.records(claims.conflicts(of), of).collect()
    p = {r.class_id: r.confidence for r in of.collect()}
    assert all(p[r.primary_id] >= p[r.contra_id] for r in record)


def test_crawl_follows_links_level_by_level(spark):
    page = lambda *to: "<html><body><article><h1>T</h1><p>" + "word " * 400 + "".join(f'<a href="{t}">more about research</a>' for t in to) + "</p></article></body></html>"
    rows = [("https://a.b/", page("x", "/y#f", "https://c.d/")), ("https://a.b/x", page("../z", "")), ("https://a.b/y", page("/")), ("https://a.b/z", page("/w")), ("https://c.d/", page())]
    got = crawl.bfs(spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([("https://a.b/",)], "url string"), max_depth=2, extended=0)
    assert sorted((r.url, r.depth) for r in got.collect()) == [("https://a.b/", 0), ("https://a.b/x", 1), ("https://a.b/y", 1)]
