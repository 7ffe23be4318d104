import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sheaf.operators import topics
from sheaf.sources import jsonl, web


@pytest.fixture()
def site():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, time.monotonic()))
            if self.path == "/gone":
                self.send_error(404)
            elif self.path == "/flaky" and sum(p == "/flaky" for p, _ in asked) < 3:
                self.send_error(503)
            else:
                body = "<h1>é</h1>".encode("latin-1")
                self.send_response(200)
                self.send_header("Content-Type", "text/html; charset=latin-1")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_fetch_pauses_between_requests_of_a_host_and_tries_again(spark, site):
    root, asked = site
    urls = spark.createDataFrame([(root + p,) for p in ("/a", "/a", "/gone", "/flaky")] + [("http://127.0.0.1:1/x",), ("mailto:a@b",)], "url string")
    got = {r.url.removeprefix(root): r for r in web.fetch(urls, timeout=5, retries=2, delay=0.2, pause=0.01).collect()}
    assert got.keys() == {"/a", "/gone", "/flaky", "http://127.0.0.1:1/x"}
    assert (got["/a"].status, got["/a"].html, got["/a"].content_type, got["/a"].error) == (200, "<h1>é</h1>", "text/html", None)
    assert got["/gone"].status == 404 and got["/gone"].html is None and got["/flaky"].status == 200
    assert got["http://127.0.0.1:1/x"].status is None and got["http://127.0.0.1:1/x"].error
    assert sum(p == "/gone" for p, _ in asked) == 1 and sum(p == "/flaky" for p, _ in asked) == 3
    first = {p: t for p, t in reversed(asked)}
    times = sorted(first.values())
    assert all(b - a >= 0.19 for a, b in zip(times, times[1:]))


def test_lists_keep_the_first_place(spark):
    lists = {"news": ["https://a.b", "https://c.d"], "tech": ["https://c.d", " https://e.f "]}
    assert [tuple(r) for r in web.combined(spark, lists, ["tech", "news", "none"]).collect()] == [(0, "https://c.d", "tech"), (1, "https://e.f", "tech"), (2, "https://a.b", "news")]
    assert web.combined(spark, {}).count() == 0


def test_records_graphs_and_knowledge_bases_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a\x00é\nb", {"k": "v"}), ("", {})], "text string, meta map<string,string>")
    jsonl.write_records(rows, f"{tmp_path}/r")
    assert sorted((r.text, r.meta) for r in jsonl.read_records(spark, f"{tmp_path}/r").collect()) == [("", {}), ("aé\nb", {"k": "v"})]
    nodes = spark.createDataFrame([(1, "entity", "A", "d", 0.9), (2, "entity", "B", "d", 0.8), (3, "event", "C", "d", 0.9), (4, "entity", "D", "d", 0.1)], "node_id long, node_type string, name string, domain string, confidence double")
    edges = spark.createDataFrame([(1, 2, "x"), (1, 3, "x"), (2, 4, "x")], "source_id long, target_id long, type string")
    jsonl.write_graph(nodes, edges, f"{tmp_path}/g", ["entity"], 0.5, "d")
    assert sorted(r.name for r in spark.read.json(f"{tmp_path}/g/nodes").collect()) == ["A", "B"]
    assert [(r.source_id, r.target_id) for r in spark.read.json(f"{tmp_path}/g/edges").collect()] == [(1, 2)]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 1, "name": "A"}, {"id": 2, "name": "B"}], "edges": [{"source_id": 1, "target_id": 2}, {"source_id": 1, "target_id": 9}]}))
    n, e = jsonl.read_graph(spark, f"{tmp_path}/g.json")
    assert n.count() == 2 and [(r.source_id, r.target_id) for r in e.collect()] == [(1, 2)]
    (tmp_path / "kb.json").write_text(json.dumps([{"id": "x", "name": "N", "aliases": ["M"], "attributes": {"a": "b"}}]))
    assert jsonl.read_kb(spark, f"{tmp_path}/kb.json").first().aliases == ["M"]


def test_cross_validation(spark):
    rows = [(i, ("goal match keeper " if i % 3 else "stock market bank ") * 3 + str(i), int(i % 3 > 0)) for i in range(90)]
    got = topics.cross_validated(spark.createDataFrame(rows, "doc_id long, text string, label int"), folds=3)
    assert got["folds"] == 3 and got["mean"] == got["min"] == got["max"] == 1.0 and got["std"] == 0.0
