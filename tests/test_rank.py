import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siftspark.operators import index, match, rank, speedups


@pytest.fixture(scope="module")
def idx(spark):
    rows = [
        ("d1", "पुल टूटा", "नदी का पुल बारिश में टूटा और सड़क बंद", dt.datetime(2026, 1, 5)),
        ("d2", "बारिश", "बारिश से सड़क पर पानी और पुल सुरक्षित", dt.datetime(2026, 1, 4)),
        ("d3", "खेल", "टीम ने मैच जीता", dt.datetime(2026, 1, 1)),
        ("d3", "copy", "later row of the same id", dt.datetime(2026, 1, 1)),
        ("d4", None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, headline string, body string, date timestamp").withColumn("n", F.monotonically_increasing_id())
    return index.build(df, order="n")


def q(spark, *texts):
    return rank.exact_query(spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, query string"))


def ids(df):
    return sorted((r.qid, r.doc_id) for r in df.collect())


def test_first_row_of_an_id_wins_and_nulls_are_empty(idx):
    assert idx.docs.count() == 4
    assert {r.doc_id for r in idx.stats.collect()} == {"d1", "d2", "d3"}


def test_postings(idx):
    r = idx.post.where("term = 'पुल' and doc_id = 'd1' and zone = 'body'").first()
    assert (r.tf, r.positions) == (1, [2])
    t = {x.term: (x.df, x.cf) for x in idx.terms.collect()}
    assert t["पुल"] == (2, 3) and t["मैच"] == (1, 1)


def test_boolean_phrase_proximity(spark, idx):
    w = match.query_words(spark.createDataFrame([("a", "पुल सड़क"), ("b", "का पुल"), ("c", "")], "qid string, query string"))
    assert ids(match.and_search(idx.post, w)) == [("a", "d1"), ("a", "d2"), ("b", "d1")]
    assert ids(match.phrase_search(idx.post, w)) == [("b", "d1")]
    assert ids(match.proximity_search(idx.post, w, 6)) == [("a", "d1"), ("a", "d2"), ("b", "d1")]
    assert ids(match.proximity_search(idx.post, w, 1)) == [("b", "d1")]
    with pytest.raises(ValueError):
        match.proximity_search(idx.post, w, -1)
    with pytest.raises(ValueError):
        match.and_search(idx.post, w, "title")


def test_smallest_window_by_brute_force(spark):
    import itertools
    import random

    r = random.Random(1)
    rows, want = [], {}
    for d in range(40):
        body = [r.choice("abcd") for _ in range(r.randint(1, 12))]
        rows.append((str(d), "", " ".join(body)))
        pos = {t: [i for i, x in enumerate(body) if x == t] for t in "abc" if t in body}
        if pos:
            span = min(max(c) - min(c) + 1 for c in itertools.product(*pos.values())) if len(pos) > 1 else None
            want[str(d)] = (len(pos), span)
    post = index.postings(index.tokens(spark.createDataFrame(rows, "doc_id string, headline string, body string")))
    words = spark.createDataFrame([("q", t) for t in "abc"], "qid string, term string")
    assert {x.doc_id: (x.matched, x.span) for x in match.smallest_window(post, words).collect()} == want


def test_textbook_cosine(spark):
    # lecture example: N = 1,000,000; auto, car and insurance in the document with tf 1, 1, 2; query best car insurance
    w = {t: (1 + math.log10(tf)) for t, tf in {"auto": 1, "car": 1, "insurance": 2}.items()}
    n = math.sqrt(sum(v * v for v in w.values()))
    idf = {"best": math.log10(1e6 / 5e4), "car": 2.0, "insurance": 3.0}
    qn = math.sqrt(sum(v * v for v in idf.values()))
    assert sum(idf[t] / qn * w.get(t, 0) / n for t in idf) == pytest.approx(0.8, abs=0.01)


def test_bm25_by_hand(spark):
    rows = [("a", "", "x x x y"), ("b", "", "x y y y"), ("c", "", "z z z z")]
    i = index.build(spark.createDataFrame(rows, "doc_id string, headline string, body string"))
    got = {r.doc_id: r.score for r in rank.bm25(q(spark, "x"), i).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert got["a"] == pytest.approx(idf * 3 * 2.2 / (3 + 1.2), abs=1e-12)
    assert set(got) == {"a", "b"}


def test_cascade_prefers_strict_stages_and_stops(spark, idx):
    e = q(spark, "पुल बारिश")
    s = rank.bm25(e, idx)
    assert [(x.doc_id, x.stage) for x in rank.cascade(e, idx, s, k=1).collect()] == [("d1", 0)]
    assert [(x.doc_id, x.stage) for x in rank.cascade(e, idx, s, k=5).orderBy("rank").collect()] == [("d1", 0), ("d2", 2)]


def test_rrf_formula(spark):
    a = spark.createDataFrame([("q", "x", 2.0), ("q", "y", 1.0)], "qid string, doc_id string, score double")
    b = spark.createDataFrame([("q", "y", 9.0)], "qid string, doc_id string, score double")
    got = {r.doc_id: r.score for r in rank.rrf([a, b]).collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["x"] == pytest.approx(1 / 61)


def test_full_budgets_equal_the_exact_ranking(spark, idx):
    e = q(spark, "पुल सड़क बारिश")
    exact = [(r.doc_id, round(r.score, 9)) for r in match.top(rank.cosine(e, idx), 10).orderBy("rank").collect()]
    for got in (
        speedups.champion_search(e, idx, speedups.champions(idx, 100)), speedups.impact_search(e, idx, speedups.impact_postings(idx), max_docs=None),
        speedups.tier_search(e, idx, 10), speedups.cluster_search(e, idx, speedups.assign(idx, speedups.leaders(idx)), 10, 99),
    ):
        assert [(r.doc_id, round(r.score, 9)) for r in got.orderBy("rank").collect()] == exact


def test_intent(spark):
    f = lambda s: spark.createDataFrame([(s,)], "q string").select(rank.date_intent(F.col("q"))).first()[0]
    assert f("kal ka mausam") == "tomorrow"
    assert f("कल का नतीजा") == "yesterday"
    assert f("match tomorrow") == "tomorrow"
    assert f("kal") == "yesterday"
    assert f("मौसम") is None


def test_collapse_demote_mmr(spark, idx):
    ranked = spark.createDataFrame([("q", "d1", 3.0, 1), ("q", "d2", 2.0, 2), ("q", "d3", 1.0, 3)], "qid string, doc_id string, score double, rank int")
    c = spark.createDataFrame([("d1", 1, "a"), ("d2", 1, "b")], "doc_id string, cluster int, source string")
    r = rank.collapse(ranked, c).orderBy("rank").collect()
    assert [(x.doc_id, x.also_in) for x in r] == [("d1", ["b"]), ("d3", [])]
    kinds = spark.createDataFrame([("d1", "listing")], "doc_id string, page_type string")
    assert [x.doc_id for x in rank.demote(ranked, kinds).orderBy("rank").collect()] == ["d2", "d3", "d1"]
    assert [x.doc_id for x in rank.mmr(ranked, idx.post, lam=1.0).orderBy("rank").collect()] == ["d1", "d2", "d3"]


def test_save_and_load(spark, idx, tmp_path):
    idx.save(str(tmp_path))
    assert index.Index.load(spark, str(tmp_path), "none").post.count() == idx.post.count()
    with pytest.raises(ValueError):
        index.Index.load(spark, str(tmp_path), "other")


def test_search_query_checks_mode_and_zone(spark, idx):
    qs = spark.createDataFrame([("a", "पुल")], "qid string, query string")
    assert match.search_query(idx, qs).count() >= 0
    for kw in ({"mode": "other"}, {"mode": "light"}, {"zone": "both"}):
        with pytest.raises(ValueError):
            match.search_query(idx, qs, **kw)


def test_cells_hold_every_row(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(900, None)]
    e = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    q = e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    exact = {(x.qid, x.doc_id) for x in rank.dense_search(q, e, 5).collect()}
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x}
    want = {(a, b) for a in v if a % 20 == 0 for b in sorted((b for b in v if b != a), key=lambda b: -float(v[a] @ v[b]))[:5]}
    assert exact == want
    c = rank.vector_cells(e, 10)
    assert {(x.qid, x.doc_id) for x in rank.cell_search(q, e, c, 5, probes=10).collect()} == want
    assert rank.dense_search(q.limit(0), e, 5).count() == 0 and rank.cell_search(q, e.limit(0), c, 5).count() == 0
