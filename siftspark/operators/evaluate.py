"""Evaluation of runs (qid, doc_id, rank[, score]) against judgments (qid, doc_id, grade)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with grade (0 if not judged) and rel (grade 1 or more), of queries that have something relevant, with their number of relevant documents."""
    total = qrels.where("grade >= 1").groupBy("qid").agg(F.countDistinct("doc_id").alias("relevant"))
    q = qrels.groupBy("qid", "doc_id").agg(F.max("grade").alias("grade"))
    return run.join(q, ["qid", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))).withColumn("rel", (F.col("grade") >= 1).cast("int")).join(total, "qid")


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, p, r, f1, ap, dcg, ndcg): P and R at k (P divides by k however few are returned), AP over all relevant, nDCG at k.

    Queries with nothing relevant are left out; relevant queries without results get zeros.
    """
    x = judged(run, qrels).withColumn("hits", F.sum("rel").over(W.partitionBy("qid").orderBy("rank")))
    gain = lambda g, r: g / F.log2(r + 1)
    m = x.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    total = qrels.where("grade >= 1").groupBy("qid").agg(F.countDistinct("doc_id").alias("relevant"))
    best = qrels.groupBy("qid", "doc_id").agg(F.max("grade").alias("grade")).withColumn("i", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "doc_id"))).where(F.col("i") <= k).groupBy("qid").agg(F.sum(gain(F.col("grade"), F.col("i"))).alias("ideal"))
    z = total.join(best, "qid").join(m, "qid", "left").na.fill(0, ["hits", "precisions", "dcg"])
    p, r = F.col("hits") / k, F.col("hits") / F.col("relevant")
    return z.select("qid", p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (F.col("precisions") / F.col("relevant")).alias("ap"), "dcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def means(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean of each metric, over all or by groups (with GROUPING SETS over the groups and all)."""
    agg = [F.avg(c).alias(c if c != "ap" else "map") for c in ("p", "r", "f1", "ap", "ndcg")]
    return (metrics.rollup(*by) if by else metrics.groupBy()).agg(*agg, F.count("*").alias("queries"))


def pr_points(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, rank, recall, precision) at each relevant document."""
    x = judged(run, qrels).withColumn("hits", F.sum("rel").over(W.partitionBy("qid").orderBy("rank")))
    return x.where("rel = 1").select("qid", "rank", (F.col("hits") / F.col("relevant")).alias("recall"), (F.col("hits") / F.col("rank")).alias("precision"))


def interpolated(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(level, precision): eleven-point interpolated precision, averaged over queries with something relevant."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10)
    p = pr_points(run, qrels).groupBy("qid").agg(F.collect_list(F.struct("recall", "precision")).alias("points"))
    total = qrels.where("grade >= 1").select("qid").distinct()
    x = total.join(p, "qid", "left").select("qid", "points", F.explode(levels).alias("level"))
    at = F.coalesce(F.array_max(F.transform(F.filter("points", lambda s: s["recall"] >= F.col("level") - 1e-12), lambda s: s["precision"])), F.lit(0.0))
    return x.groupBy("level").agg(F.avg(at).alias("precision"))


def pool(runs: DataFrame, k: int = 10, need: Column | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """(need, doc_id): the union of the top k of all runs per need. A query's need is its ``mapping`` (qid, need), else the part before "_"."""
    x = runs.where(F.col("rank") <= k)
    default = F.substring_index("qid", "_", 1) if need is None else need
    if mapping is not None:
        x = x.join(mapping.withColumnRenamed("need", "__n"), "qid", "left")
        default = F.coalesce("__n", default)
    return x.select(default.alias("need"), "doc_id").distinct()


def merge_pools(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, and rows of ``new`` whose (need, doc_id) is not there yet."""
    return old.unionByName(new.join(old.select("need", "doc_id"), ["need", "doc_id"], "left_anti"), allowMissingColumns=True)


def merge_judgments(*sets: DataFrame) -> DataFrame:
    """(need, doc_id, grade): the highest grade of all annotators."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy("need", "doc_id").agg(F.max("grade").alias("grade"))


def save_judgments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (need, doc_id, grade); grades other than 0, 1, 2 are an error when rows are read."""
    checked = new.withColumn("grade", F.when(F.col("grade").isin(0, 1, 2), F.col("grade")).otherwise(F.raise_error(F.concat(F.lit("grade must be 0, 1 or 2: "), F.col("grade").cast("string"))).cast("int")))
    both = old.withColumn("__new", F.lit(0)).unionByName(checked.withColumn("__new", F.lit(1)))
    return both.withColumn("__i", F.row_number().over(W.partitionBy("need", "doc_id").orderBy(F.desc("__new"), F.desc("grade")))).where("__i = 1").drop("__i", "__new")


def progress(pool_: DataFrame, judgments: DataFrame) -> DataFrame:
    """(need, judged, total)."""
    j = judgments.select("need", "doc_id").distinct().withColumn("hit", F.lit(1))
    return pool_.join(j, ["need", "doc_id"], "left").groupBy("need").agg(F.count("hit").alias("judged"), F.count("*").alias("total"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(qid, overlap): shared documents of the two top k over k."""
    x = a.where(F.col("rank") <= k).select("qid", "doc_id").join(b.where(F.col("rank") <= k).select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("c"))
    every = a.select("qid").union(b.select("qid")).distinct()
    return every.join(x, "qid", "left").select("qid", (F.coalesce("c", F.lit(0)) / k).alias("overlap"))


def cross_form(run: DataFrame, forms: DataFrame, k: int = 10, reference: str = "hindi") -> DataFrame:
    """(form, overlap, queries): mean share of the k best that a query has in common with the ``reference`` form of its need; forms: (qid, form, need). Needs whose reference finds nothing are left out."""
    x = run.where(F.col("rank") <= k).select("qid", "doc_id").join(forms, "qid")
    ref = x.where(F.col("form") == reference).select("need", F.col("qid").alias("ref"), "doc_id")
    pairs = x.where(F.col("form") != reference).select("qid", "form", "need").distinct().join(ref.select("need", "ref").distinct(), "need")
    same = x.join(ref, ["need", "doc_id"]).groupBy("qid", "ref").agg(F.count("*").alias("c"))
    return pairs.join(same, ["qid", "ref"], "left").groupBy("form").agg(F.avg(F.coalesce("c", F.lit(0)) / k).alias("overlap"), F.count("*").alias("queries"))


def kendall(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, tau): rank correlation over shared documents; null for fewer than two. Result lists are bounded by their k."""
    s = a.select("qid", "doc_id", F.col("rank").alias("ra")).join(b.select("qid", "doc_id", F.col("rank").alias("rb")), ["qid", "doc_id"])
    l = s.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("l"))
    n = F.size("l")
    sign = F.aggregate("l", F.lit(0).cast("long"), lambda acc, x: acc + F.size(F.filter("l", lambda y: (y["ra"] > x["ra"]) & (y["rb"] > x["rb"]))) - F.size(F.filter("l", lambda y: (y["ra"] > x["ra"]) & (y["rb"] < x["rb"]))))
    every = a.select("qid").union(b.select("qid")).distinct()
    return every.join(l.select("qid", F.when(n >= 2, sign / (n * (n - 1) / 2)).alias("tau")), "qid", "left")


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / d
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else 0.0 if math.isinf(x) else _incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df)], dtype="float64")


def paired_t(pairs: DataFrame) -> DataFrame:
    """One row (n, mean_diff, t, p) for (qid, a, b): paired two-sided t-test over shared queries; equal pairs give t 0 and p 1."""
    s = pairs.where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b")).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("mean_diff") == 0, 0.0).when(F.coalesce("sd", F.lit(0.0)) == 0, F.lit(float("inf")) * F.signum("mean_diff")).otherwise(F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    x = s.withColumn("t", t)
    return x.select("n", "mean_diff", "t", F.when(F.col("t") == 0, 1.0).otherwise(t_two_sided("t", (F.col("n") - 1).cast("double"))).alias("p"))


def randomization(pairs: DataFrame, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """One row (n, mean_diff, p): share of sign flips at least as extreme, (hits + 1) / (rounds + 1). Signs are bits of the MD5 of (seed, round, query), so rounds are spread over tasks and any engine repeats them."""
    d = pairs.where("a is not null and b is not null").select("qid", (F.col("a") - F.col("b")).alias("d"))
    real = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"))
    flips = d.select("qid", "d", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    digit = F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("qid").cast("string")).cast("binary")), F.lit(1))
    sign = F.when(digit.isin(*"02468ace"), 1.0).otherwise(-1.0)
    sums = flips.groupBy("round").agg(F.avg(sign * F.col("d")).alias("m")).join(F.broadcast(real))
    hits = sums.agg(F.sum((F.abs("m") >= F.abs("mean_diff") - 1e-12).cast("int")).alias("hits"), F.first("n").alias("n"), F.first("mean_diff").alias("mean_diff"))
    return hits.select("n", "mean_diff", ((F.col("hits") + 1) / (rounds + 1)).alias("p"))


def wins(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(wins, losses, ties) of a against b over (qid, a, b)."""
    d = F.col("a") - F.col("b")
    return pairs.agg(F.sum((d > tolerance).cast("int")).alias("wins"), F.sum((d < -tolerance).cast("int")).alias("losses"), F.sum((F.abs(d) <= tolerance).cast("int")).alias("ties"))


def matcher_quality(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(accuracy, mrr, n) of ranked candidates (query, candidate, rank) for truth (query, target)."""
    best = truth.join(ranked.where(F.col("rank") <= k), (truth["query"] == ranked["query"]) & (truth["target"] == ranked["candidate"]), "left").groupBy(truth["query"], truth["target"]).agg(F.min("rank").alias("rank"))
    return best.agg(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def rubric_grade(headline: Column, body: Column, core: Column, focus: Column) -> Column:
    """2 if the headline holds a core term and headline or body a focus term, 1 if headline or body holds a core term, else 0. core, focus: arrays."""
    text = F.concat_ws(" ", headline, body)
    has = lambda c, ts: F.coalesce(F.exists(ts, lambda t: F.contains(c, t)), F.lit(False))
    return F.when(has(headline, core) & (has(text, focus) | (F.size(focus) == 0)), 2).when(has(text, core), 1).otherwise(0)


def learn_to_rank(rows: DataFrame, features: list[str], rate: float = 0.1, steps: int = 2000, l2: float = 0.01) -> DataFrame:
    """(qid, need, doc_id, grade, score): logistic ranking, each need scored by weights learnt on all other needs.

    Training rows are judged results (bounded by needs times depth). Features
    are standardised, classes balanced; one task per left-out need.
    """
    needs = rows.agg(F.collect_set("need").alias("needs"))  # one row: the needs of a judged collection
    kinds = dict(rows.dtypes)
    cols = ["qid", "need", "doc_id", "grade", *features]
    every = rows.select(*cols).join(F.broadcast(needs)).withColumn("out", F.explode("needs")).drop("needs")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf["out"].iloc[0]
        x = pdf[features].to_numpy(dtype=float)
        train = ((pdf["need"] != out) & pdf["grade"].notna()).to_numpy()
        held = (pdf["need"] == out).to_numpy()
        w, b = np.zeros(len(features)), 0.0
        mean, sd = (x[train].mean(0), x[train].std(0)) if train.any() else (0.0, 1.0)
        sd = np.where(np.asarray(sd) == 0, 1.0, sd)
        z = (x - mean) / sd
        y = (pdf["grade"].fillna(0).to_numpy() >= 1).astype(float)
        if train.any() and 0 < y[train].sum() < train.sum():
            zt, yt = z[train], y[train]
            weight = np.where(yt == 1, len(yt) / (2 * yt.sum()), len(yt) / (2 * (len(yt) - yt.sum())))
            for _ in range(steps):
                err = (1 / (1 + np.exp(-(zt @ w + b))) - yt) * weight
                w -= rate * (zt.T @ err / len(yt) + l2 * w)
                b -= rate * err.mean()
        res = pdf.loc[held, ["qid", "need", "doc_id", "grade"]].copy()
        res["score"] = z[held] @ w + b
        return res

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("qid", "need", "doc_id", "grade")) + ", score double"
    return every.groupBy("out").applyInPandas(fold, schema)
