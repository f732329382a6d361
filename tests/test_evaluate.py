import pytest
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.operators import evaluate, rewrite


def run_of(spark, ranks, qid="q"):
    return [(qid, f"d{i}", i, 1) for i in ranks]


def test_textbook_average_precision(spark):
    rel = run_of(spark, [1, 3, 6, 9, 10], "q1") + run_of(spark, [2, 5, 7], "q2")
    qrels = spark.createDataFrame([(q, d, g) for q, d, _, g in rel], "qid string, doc_id string, grade int")
    run = spark.createDataFrame([(q, f"d{i}", i) for q in ("q1", "q2") for i in range(1, 11)], "qid string, doc_id string, rank int")
    ap = {r.qid: r.ap for r in evaluate.per_query(run, qrels).collect()}
    assert ap["q1"] == pytest.approx(0.62, abs=0.005) and ap["q2"] == pytest.approx(0.44, abs=0.005)
    p = [r.precision for r in evaluate.interpolated(run, qrels).orderBy("level").collect()]
    assert p == sorted(p, reverse=True)


def test_unjudged_queries_are_left_out_and_missing_ones_are_zero(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d1", 0)], "qid string, doc_id string, grade int")
    run = spark.createDataFrame([("q2", "d1", 1)], "qid string, doc_id string, rank int")
    assert [(r.qid, r.ap) for r in evaluate.per_query(run, qrels).collect()] == [("q1", 0.0)]


def test_significance(spark):
    same = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.2, 0.2)], "qid string, a double, b double")
    assert evaluate.paired_t(same).first().p == 1.0
    better = spark.createDataFrame([(str(i), 0.5 + 0.01 * i, 0.3) for i in range(10)], "qid string, a double, b double")
    assert evaluate.paired_t(better).first().p < 0.001
    assert evaluate.randomization(better, 500).first().p < 0.02
    # t = 2.0 with 10 degrees of freedom: p = 0.0734
    x = spark.createDataFrame([(2.0, 10.0)], "t double, n double").select(evaluate.t_two_sided("t", "n")).first()[0]
    assert x == pytest.approx(0.0734, abs=2e-4)


def test_kendall_and_overlap(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 3), ("r", "x", 1)], "qid string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "z", 1), ("q", "y", 2), ("q", "x", 3)], "qid string, doc_id string, rank int")
    assert {r.qid: r.tau for r in evaluate.kendall(a, b).collect()} == {"q": -1.0, "r": None}
    assert {r.qid: r.overlap for r in evaluate.overlap(a, b, 3).collect()} == {"q": 1.0, "r": 0.0}


def test_judgments(spark):
    old = spark.createDataFrame([("n", "d", 1)], "need string, doc_id string, grade int")
    new = spark.createDataFrame([("n", "d", 2), ("n", "e", 0)], "need string, doc_id string, grade int")
    assert {(r.doc_id, r.grade) for r in evaluate.save_judgments(old, new).collect()} == {("d", 2), ("e", 0)}
    with pytest.raises(Exception, match="grade must be"):
        evaluate.save_judgments(old, new.withColumn("grade", F.lit(5))).collect()


def test_learning_separates(spark):
    rows = [(f"q{n}", f"n{n}", f"d{i}", float(i), 1 if i > 4 else 0) for n in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "qid string, need string, doc_id string, f double, grade int")
    got = evaluate.learn_to_rank(df, ["f"], steps=200).collect()
    for n in range(3):
        best = max((r for r in got if r.qid == f"q{n}"), key=lambda r: r.score)
        assert best.grade == 1


def test_translate_longest_phrase(spark):
    q = spark.createDataFrame([("q", i, w, 1.0, "exact") for i, w in enumerate("prime minister of india".split())], "qid string, idx int, term string, weight double, source string")
    d = spark.createDataFrame([("prime minister", "प्रधानमंत्री", 1.0), ("prime", "मुख्य", 1.0), ("india", "भारत", 1.0)], "phrase string, term string, weight double")
    langs = spark.createDataFrame([(w, 0.9) for w in "prime minister of india".split()], "word string, en double")
    got = {(r.idx, r.term, r.source) for r in rewrite.translate(q, d, langs, ("of",)).collect()}
    assert got == {(0, "prime", "exact"), (0, "प्रधानमंत्री", "xling"), (3, "india", "exact"), (3, "भारत", "xling")}


def test_viterbi_joint_best(spark):
    lattice = spark.createDataFrame([("q", 0, "A", 0.6), ("q", 0, "B", 0.4), ("q", 1, "X", 0.6), ("q", 1, "Y", 0.4)], "qid string, pos int, term string, weight double")
    cooc = spark.createDataFrame([("B", "Y", 50)], "a string, b string, cooc int")
    assert [r.term for r in rewrite.viterbi(lattice, cooc).orderBy("pos").collect()] == ["B", "Y"]
    assert [r.term for r in rewrite.viterbi(lattice, cooc.limit(0)).orderBy("pos").collect()] == ["A", "X"]


def test_learnt_costs_by_hand(spark):
    import math

    pairs = spark.createDataFrame([("ab", "ab"), ("ab", "cb"), (None, "x")], "canonical string, human string")
    got = {(r.src, r.dst): r for r in rewrite.learn_costs(pairs, 1).collect()}
    # operations a-a, b-b, a-c, b-b: three targets and one for the unseen
    assert set(got) == {("a", "a"), ("a", "c"), ("b", "b")}
    assert abs(got["a", "c"].cost + math.log(2 / 6)) < 1e-12 and abs(got["b", "b"].cost + math.log(3 / 6)) < 1e-12
    assert abs(got["a", "a"].unseen + math.log(1 / 6)) < 1e-12


def test_stem_classes_and_auto_stems(spark):
    rows = [(i, w) for i, w in enumerate(["लड़का"] * 6 + ["लड़के"] * 5 + ["लड़कों"] * 3 + ["पानी"] * 4)]
    words = spark.createDataFrame(rows, "doc_id int, word string")
    c = rewrite.stem_candidates(words, X.light_stem(F.col("word"))).collect()
    assert all(x.verdict in ("STRONG", "GOOD", "REVIEW", "REJECT") for x in c) and any(x.forms == 3 and x.freq == 14 for x in c)
    classes, pairs = rewrite.stem_collisions(words, X.light_stem(F.col("word")))
    assert [x.verdict for x in classes.collect()] == ["SAFE"] and pairs.count() == 3
    assert rewrite.auto_stems(words.limit(0)).count() == 0
    assert {x.stem_form for x in rewrite.auto_stems(words).collect()} <= {"लड़का"}
