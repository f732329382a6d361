"""Inexact top-k: index elimination, champion lists, recency tiers, cluster pruning, impact order. Each returns (qid, doc_id, score, rank)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions.web import micros
from siftspark.operators.index import Index
from siftspark.operators.match import small, top
from siftspark.operators.rank import query_vector
from siftspark.session import cut


def weights(index: Index, words: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, w): lnc weight of each term in each document, zones summed; of the terms in ``words`` (term) only, if given."""
    post = index.post if words is None else index.post.join(small(words.select("term").distinct()), "term", "left_semi")
    tf = post.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    return tf.join(index.stats.select("doc_id", "norm"), "doc_id").select("term", "doc_id", ((1 + F.log10("tf")) / F.col("norm")).alias("w"))


def _score(list_: DataFrame, v: DataFrame) -> DataFrame:
    return list_.join(small(v.withColumnRenamed("w", "q")), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))


def index_elimination(q: DataFrame, index: Index, k: int = 10, **kw) -> DataFrame:
    return top(elimination_scores(q, index, k, **kw), k)


def elimination_scores(q: DataFrame, index: Index, k: int = 10, min_idf: float = 0.3, share: float = 0.75) -> DataFrame:
    """Only terms of idf ``min_idf`` or more (else the rarest one); a document needs ``share`` of them if there are three or more, fewer one by one while fewer than k documents have them."""
    v = query_vector(q, index).join(index.terms.select("term", "idf"), "term")
    rarest = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("idf"), "term"))
    good = F.sum((F.col("idf") >= min_idf).cast("int")).over(W.partitionBy("qid"))
    v = v.withColumns({"r": rarest, "good": good}).where((F.col("idf") >= min_idf) | ((F.col("good") == 0) & (F.col("r") == 1)))
    need = v.groupBy("qid").agg(F.count("*").alias("n")).withColumn("need", F.when(F.col("n") >= 3, F.ceil(share * F.col("n"))).otherwise(1))
    x = weights(index, v).join(small(v.select("qid", "term", F.col("w").alias("q"))), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"), F.count("*").alias("m"))
    counts = x.groupBy("qid", "m").agg(F.count("*").alias("c"))
    more = F.sum("c").over(W.partitionBy("qid").orderBy(F.desc("m")))
    level = counts.withColumn("have", more).join(small(need), "qid").groupBy("qid").agg(F.max(F.when((F.col("have") >= k) & (F.col("m") <= F.col("need")), F.col("m"))).alias("reach"), F.max("need").alias("need"), F.max(F.when(F.col("m") >= F.col("need"), F.col("have"))).alias("at_need"))
    level = level.select("qid", F.when(F.col("at_need") >= k, F.col("need")).otherwise(F.coalesce("reach", F.lit(1))).alias("least"))
    return x.join(small(level), "qid").where("m >= least").select("qid", "doc_id", "score")


def champions(index: Index, r: int = 50, static: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, w): the r documents of each term with the largest weight (plus static score); to be written once, or made for the terms of a batch of queries (``words``)."""
    w = weights(index, words)
    order = F.round("w", 9)
    if static is not None:
        w = w.join(static, "doc_id")
        order = F.round(F.col("w") + F.col("g"), 9)
    ranked = w.withColumn("r", F.row_number().over(W.partitionBy("term").orderBy(order.desc(), F.desc("doc_id"))))
    return ranked.where(F.col("r") <= r).select("term", "doc_id", "w")


def champion_search(q: DataFrame, index: Index, champs: DataFrame, k: int = 10) -> DataFrame:
    """Scores documents that are champions of a query term (over all terms); queries with fewer than k of them use full postings."""
    return top(champion_scores(q, index, champs, k), k)


def champion_scores(q: DataFrame, index: Index, champs: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, score) of the documents that ``champion_search`` scores; the postings of others are dropped before they are scored."""
    v = query_vector(q, index)
    cand = champs.join(small(v.select("qid", "term")), "term").select("qid", "doc_id").distinct()
    few = cand.groupBy("qid").agg(F.count("*").alias("c"))
    short = v.select("qid").distinct().join(few, "qid", "left").where(F.coalesce("c", F.lit(0)) < k).select("qid")
    w = weights(index, v)
    by_list = w.join(small(v.withColumnRenamed("w", "q")), "term").join(cand, ["qid", "doc_id"], "left_semi").join(small(short), "qid", "left_anti").groupBy("qid", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    return by_list.unionByName(_score(w, v.join(small(short), "qid", "left_semi")))


def tier(date: Column, now: Column) -> Column:
    """1: up to two days old, 2: up to seven, 3: older or without a date."""
    age = (micros(now) - micros(date)) / F.lit(86400e6)
    return F.when(date.isNull(), 3).when(age <= 2, 1).when(age <= 7, 2).otherwise(3)


def tier_search(q: DataFrame, index: Index, k: int = 10, **kw) -> DataFrame:
    return top(tier_scores(q, index, k, **kw), k)


def tier_scores(q: DataFrame, index: Index, k: int = 10, date_col: str = "date") -> DataFrame:
    """Recency tiers are opened one after the other until k documents are found."""
    now = index.docs.agg(F.max(date_col).alias("now"))
    tiers = index.docs.join(F.broadcast(now)).select("doc_id", tier(F.col(date_col), F.col("now")).alias("tier"))
    v = query_vector(q, index)
    x = _score(weights(index, v), v).join(tiers, "doc_id")
    counts = x.groupBy("qid", "tier").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("qid").orderBy("tier").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = counts.withColumn("before", before).where(F.col("before") < k).select("qid", "tier")
    return x.join(small(open_), ["qid", "tier"]).select("qid", "doc_id", "score")


def leaders(index: Index, count: int | None = None) -> DataFrame:
    """(leader): about sqrt(N) documents, those with the smallest MD5 of their id (a sample that any engine repeats)."""
    n = count or max(1, round(index.docs.count() ** 0.5))
    return index.docs.select(F.col("doc_id").alias("leader")).orderBy(F.md5(F.col("leader").cast("string").cast("binary"))).limit(n)


#: Terms of all leaders that are sent to every task (about 50 MB); more are joined.
LEADER_TERMS = 4_000_000


def assign(index: Index, lead: DataFrame) -> DataFrame:
    """(doc_id, leader): the leader with the largest cosine (ties: smallest id); a document that shares no term with any leader follows the smallest.

    The vectors of the leaders, about the root of the number of documents, are
    sent to the tasks while they have at most LEADER_TERMS terms, and a document
    is compared where its vector is; no row per (document, leader) is made.
    Beyond that bound the sums are joined and added up.
    """
    w = weights(index)
    lw = cut(w.join(small(lead), w.doc_id == lead.leader).select("term", "leader", F.col("w").alias("lw")))
    kind = dict(lead.dtypes)["leader"]
    if lw.count() <= LEADER_TERMS:
        names = [r.leader for r in lead.orderBy("leader").toLocalIterator()]
        at = {x: i for i, x in enumerate(names)}
        lists: dict = {}
        for r in lw.orderBy("term", "leader").toLocalIterator():
            lists.setdefault(r.term, ([], []))
            lists[r.term][0].append(at[r.leader])
            lists[r.term][1].append(r.lw)
        shared = index.docs.sparkSession.sparkContext.broadcast((names, {t: (np.array(i), np.array(x)) for t, (i, x) in lists.items()}))

        def nearest(batches):
            names, lists = shared.value
            for pdf in batches:
                out = []
                for terms, ws in zip(pdf["terms"], pdf["ws"]):
                    total = np.zeros(len(names))
                    for t, x in zip(terms, ws):
                        if t in lists:
                            total[lists[t][0]] += x * lists[t][1]
                    out.append(names[int(np.argmax(np.round(total, 9)))] if len(names) else None)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "leader": out})

        vectors = w.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
        best = vectors.mapInPandas(nearest, f"doc_id {dict(index.docs.dtypes)['doc_id']}, leader {kind}")
    else:
        sims = w.join(lw, "term").groupBy("doc_id", "leader").agg(F.round(F.sum(F.col("w") * F.col("lw")), 9).alias("s"))
        best = sims.groupBy("doc_id").agg(F.min(F.struct(-F.col("s"), F.col("leader"))).alias("b")).select("doc_id", F.col("b.leader").alias("leader"))
    rest = index.docs.select("doc_id").join(best, "doc_id", "left_anti").join(F.broadcast(lead.agg(F.min("leader").alias("leader"))))
    return best.unionByName(rest)


def cluster_search(q: DataFrame, index: Index, followers: DataFrame, k: int = 10, b: int = 1) -> DataFrame:
    """The b clusters nearest to the query, and further ones until k documents are found."""
    return top(cluster_scores(q, index, followers, k, b), k)


def cluster_scores(q: DataFrame, index: Index, followers: DataFrame, k: int = 10, b: int = 1) -> DataFrame:
    """(qid, doc_id, score) of the documents that ``cluster_search`` scores.

    A leader's place counts leaders that share a term with the query, and the
    leaders of documents that do; all others have nothing to score.
    """
    v = query_vector(q, index)
    w = weights(index, v)
    lead = followers.select("leader").distinct()
    near = _score(w.join(lead, w.doc_id == lead.leader, "left_semi"), v).withColumnRenamed("doc_id", "leader")
    x = _score(w, v).join(followers, "doc_id")
    counts = x.groupBy("qid", "leader").agg(F.count("*").alias("c"))
    every = counts.join(near, ["qid", "leader"], "full").withColumns({"c": F.coalesce("c", F.lit(0)), "s": F.round(F.coalesce("score", F.lit(0.0)), 9)})
    by = W.partitionBy("qid").orderBy(F.desc("s"), "leader")
    before = F.coalesce(F.sum("c").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = every.withColumns({"place": F.row_number().over(by), "before": before}).where((F.col("place") <= b) | (F.col("before") < k)).select("qid", "leader")
    return x.join(small(open_), ["qid", "leader"]).select("qid", "doc_id", "score")


def impact_postings(index: Index, depth: int = 50, salts: int = 32, words: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, w, r, top_w): postings with their place by falling weight, to ``depth``; null beyond. To be written once.

    Places are found among the best ``depth`` of each of ``salts`` parts of a
    term, so that the list of a term in a third of all documents is no one
    task's sort.
    """
    w = weights(index, words).withColumns({"k": F.round("w", 9), "part": F.pmod(F.xxhash64("doc_id"), F.lit(salts))})
    first = w.withColumn("p", F.row_number().over(W.partitionBy("term", "part").orderBy(F.desc("k"), "doc_id")))
    head = first.where(F.col("p") <= depth).withColumn("r", F.row_number().over(W.partitionBy("term").orderBy(F.desc("k"), "doc_id"))).where(F.col("r") <= depth).select("term", "doc_id", "r")
    best = w.groupBy("term").agg(F.max("w").alias("top_w"))
    return w.select("term", "doc_id", "w").join(head, ["term", "doc_id"], "left").join(best, "term")


def impact_search(q: DataFrame, index: Index, ordered: DataFrame, k: int = 10, max_docs: int | None = 50, min_share: float = 0.0) -> DataFrame:
    """Reads each term's list only to ``max_docs`` places and weights of ``min_share`` of its largest."""
    return top(impact_scores(q, index, ordered, max_docs, min_share), k)


def impact_scores(q: DataFrame, index: Index, ordered: DataFrame, max_docs: int | None = 50, min_share: float = 0.0) -> DataFrame:
    """(qid, doc_id, score) of the documents that ``impact_search`` scores."""
    kept = ordered.where(F.col("w") >= min_share * F.col("top_w"))
    if max_docs:
        kept = kept.where(F.col("r") <= max_docs)
    return _score(kept.select("term", "doc_id", "w"), query_vector(q, index))


def speedup_report(exact: DataFrame, runs: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """(method, scored, overlap, queries): mean share of the documents with a query term that a method scores, and of the exact top k that it keeps.

    ``exact`` and the values of ``runs`` are scored documents (qid, doc_id,
    score), not cut. Queries without exact result are left out.
    """
    best = top(exact, k)
    size = exact.groupBy("qid").agg(F.count("*").alias("all")).join(best.groupBy("qid").agg(F.count("*").alias("n")), "qid")
    out = None
    for name, run in runs.items():
        same = best.select("qid", "doc_id").join(top(run, k).select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("m"))
        done = run.groupBy("qid").agg(F.count("*").alias("s"))
        share = lambda c, n: F.avg(F.coalesce(F.col(c), F.lit(0)) / n)
        row = size.join(same, "qid", "left").join(done, "qid", "left").agg(share("s", F.col("all")).alias("scored"), share("m", F.least(F.col("n"), F.lit(k))).alias("overlap"), F.count("*").alias("queries"))
        row = row.select(F.lit(name).alias("method"), "scored", "overlap", "queries")
        out = row if out is None else out.unionByName(row)
    return out
