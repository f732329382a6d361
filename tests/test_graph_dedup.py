import datetime as dt
import random

from siftspark.operators import dedup, graph


def test_components_chain_hub_and_empty(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    hub = [("hub", f"x{i}") for i in range(50)]
    e = spark.createDataFrame(chain + hub + [("s", "s"), ("a", None), ("hub", "x1")], "src string, dst string")
    got = {r.id: r.component for r in graph.connected_components(e).collect()}
    assert len(got) == 61 + 51
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert {v for k, v in got.items() if k[0] in "xh"} == {"hub"}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_components_by_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {x.id: x.component for x in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == want


def test_pagerank_sums_to_one_with_dangling(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "zz")], "src string, dst string")
    pr = {r.id: r.pr for r in graph.pagerank(n, e).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-9 and abs(pr["a"] - pr["b"]) < 1e-9 and pr["c"] < pr["a"]


def test_near_duplicates_window_and_lineage(spark):
    base = " ".join(f"w{i}" for i in range(60))
    t = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", base, t(0)), ("b", base + " extra", t(5)), ("c", base + " extra more", t(100)), ("d", "", t(0)), ("e", None, t(0)), ("f", base, None), ("g", "other words here now", t(1))]
    df = spark.createDataFrame(rows, "doc_id string, body string, date timestamp")
    members, links = dedup.near_classes(df, date_col="date")
    got = {(r.doc_a, r.doc_b) for r in dedup.representative_pairs(members, links).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got == {(r.doc_a, r.doc_b) for r in dedup.representative_pairs(*dedup.near_classes(df, date_col="date", lsh=False)).collect()}
    root = {r.doc_id: r.dup_of for r in dedup.clusters(df, dedup.near_in_time(members, links)).collect()}
    assert root == {"a": None, "b": "a", "c": "a", "f": "a", "d": None, "e": None, "g": None}


def test_near_in_time_connects_what_all_pairs_connect(spark):
    r = random.Random(8)
    rows = [(f"d{i:02d}", r.choice([None, *range(0, 400, 7)]), r.randint(0, 5)) for i in range(60)]
    links = [(a, b, 0.9) for a in range(6) for b in range(a + 1, 6) if r.random() < 0.4]
    m = spark.createDataFrame([(i, None if h is None else dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), c) for i, h, c in rows], "id string, at timestamp, cls long")
    got = {x.id: x.component for x in graph.connected_components(dedup.near_in_time(m, spark.createDataFrame(links, "a long, b long, similarity double")), "doc_a", "doc_b").collect()}
    linked = {(a, b) for a, b, _ in links} | {(b, a) for a, b, _ in links} | {(a, a) for a in range(6)}
    edges = [(x, y) for x, h, c in rows for y, k, e in rows if x < y and (c, e) in linked and (h is None or k is None or abs(h - k) <= 24)]
    want = {x.id: x.component for x in graph.connected_components(spark.createDataFrame(edges, "doc_a string, doc_b string"), "doc_a", "doc_b").collect()}
    assert got == want
