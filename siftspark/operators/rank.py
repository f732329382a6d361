"""Rankers over batches of queries: cosine tf-idf, BM25, net score, fusion, cascade, and the rewriting and re-ranking around them.

``q`` is (qid, idx, term, weight, source) with one row per expansion; statistics
come from the whole index, filters apply to scored documents before top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions.web import recency
from siftspark.operators.index import Index
from siftspark.operators.match import and_search, hits, phrase_search, query_words, small, smallest_window, top

ZONE_WEIGHTS = {"headline": 0.7, "body": 0.3}
NET_WEIGHTS = {"zone": 0.2, "prox": 0.1, "recency": 0.1}
STAGES = ("phrase", "subphrase", "all_exact", "all_variants", "any")


def exact_query(queries: DataFrame, mode: str = "none") -> DataFrame:
    """Every word stands for itself with weight 1."""
    return query_words(queries, mode).withColumns({"weight": F.lit(1.0), "source": F.lit("exact")})


def query_tf(q: DataFrame) -> DataFrame:
    """(qid, term, qtf): weights of equal terms added up."""
    return q.groupBy("qid", "term").agg(F.sum("weight").alias("qtf"))


def query_vector(q: DataFrame, index: Index, idf: bool = True) -> DataFrame:
    """(qid, term, w): ltc weights, unit length over terms that are in the index; ``idf=False`` gives lnc."""
    t = small(query_tf(q)).join(index.terms.select("term", "idf"), "term")
    raw = F.when(F.col("qtf") >= 1, 1 + F.log10("qtf")).otherwise(F.col("qtf")) * (F.col("idf") if idf else F.lit(1.0))
    v = t.select("qid", "term", raw.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("qid")))
    return v.withColumn("w", F.when(norm > 0, F.col("w") / norm).otherwise(0.0))


def cosine(q: DataFrame, index: Index, idf: bool = True) -> DataFrame:
    """(qid, doc_id, score): lnc.ltc (lnc.lnc) of every document with a query term."""
    v = query_vector(q, index, idf)
    tf = index.post.join(small(v), "term").groupBy("qid", "doc_id", "term", "w").agg(F.sum("tf").alias("tf"))
    dots = tf.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * (1 + F.log10("tf"))).alias("dot"))
    return dots.join(index.stats, "doc_id").select("qid", "doc_id", (F.col("dot") / F.col("norm")).alias("score"))


def bm25(q: DataFrame, index: Index, k1: float = 1.2, b: float = 0.75, headline_boost: float = 1.0) -> DataFrame:
    """(qid, doc_id, score): BM25 with natural logs; ``headline_boost`` multiplies a headline's tf."""
    t = small(query_tf(q)).join(index.terms.select("term", "df"), "term")
    avg = index.stats.agg(F.sum("len").alias("total")).join(index.n).select((F.col("total") / F.col("n")).alias("avgdl"), "n")
    boost = F.when(F.col("zone") == "headline", headline_boost).otherwise(1.0) * F.col("tf")
    tf = index.post.join(small(t), "term").groupBy("qid", "doc_id", "term", "qtf", "df").agg(F.sum(boost).alias("tf"))
    x = tf.join(index.stats.select("doc_id", "len"), "doc_id").join(F.broadcast(avg))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return x.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def net_score(q: DataFrame, index: Index, static: DataFrame | None = None, date_col: str = "date", weights: dict = NET_WEIGHTS) -> DataFrame:
    """(qid, doc_id, score, cosine, zone_score, prox, g): cosine plus weighted zone, proximity and recency (or static) scores.

    Proximity is the larger zone's number of matched terms over the smaller
    zone's window, so it may exceed 1 when they are different zones.
    """
    words = query_vector(q, index).select("qid", "term").distinct()
    n = words.groupBy("qid").agg(F.count("*").alias("n"))
    win = smallest_window(index.post, words)
    zone = F.sum(F.when(F.col("zone") == "headline", F.lit(ZONE_WEIGHTS["headline"])).otherwise(F.lit(ZONE_WEIGHTS["body"])) * F.col("matched") / F.col("n"))
    z = win.join(small(n), "qid").groupBy("qid", "doc_id").agg(zone.alias("zone_score"), F.max("matched").alias("matched"), F.min("span").alias("span"))
    if static is None:
        now = index.docs.agg(F.max(date_col).alias("now"))
        static = index.docs.join(F.broadcast(now)).select("doc_id", recency(F.col(date_col), F.col("now")).alias("g"))
    x = cosine(q, index).withColumnRenamed("score", "cosine").join(z, ["qid", "doc_id"]).join(static, "doc_id")
    prox = F.when(F.col("span").isNotNull(), F.col("matched") / F.col("span")).otherwise(0.0)
    return x.select("qid", "doc_id", (F.col("cosine") + weights["zone"] * F.col("zone_score") + weights["prox"] * prox + weights["recency"] * F.col("g")).alias("score"), "cosine", "zone_score", prox.alias("prox"), "g")


def rrf(runs: list[DataFrame], k: int = 10, depth: int = 50, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of scored lists (qid, doc_id, score), each cut at ``depth``; equal sums by doc_id ascending."""
    ranked = [top(r, max(depth, k)).select("qid", "doc_id", "rank") for r in runs]
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    return top(every.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 12).alias("score")), k, last_first=False)


def cascade(q: DataFrame, index: Index, scored: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, score, stage, rank): the strictest stage that finds a document decides its place.

    Stages: the whole phrase (two words or more), a sub-phrase of two adjacent
    words (three or more), all words as typed, all words by any variant, any
    word. Looser stages open only while fewer than k documents are found. Terms
    of source 'prf' take no part in strict stages.
    """
    strict = q.where("source <> 'prf'")
    exact = strict.where("source = 'exact'")
    size = strict.groupBy("qid").agg(F.countDistinct("idx").alias("words"))
    long2, long3 = size.where("words >= 2").select("qid"), size.where("words >= 3").select("qid")
    pairs = strict.select(F.concat_ws("#", "qid", "idx").alias("pid"), "qid", F.lit(0).alias("i"), "term", "idx").unionByName(strict.select(F.concat_ws("#", "qid", F.col("idx") - 1).alias("pid"), "qid", F.lit(1).alias("i"), "term", "idx"))
    full = pairs.groupBy("pid").agg(F.countDistinct("i").alias("c")).where("c = 2").select("pid")
    sub = pairs.join(small(full), "pid").join(small(long3), "qid")
    names = sub.select("pid", "qid").distinct()
    by_sub = phrase_search(index.post, sub.select(F.col("pid").alias("qid"), F.col("i").alias("idx"), "term").distinct()).withColumnRenamed("qid", "pid").join(small(names), "pid").select("qid", "doc_id")
    stages = [
        phrase_search(index.post, strict.join(small(long2), "qid").select("qid", "idx", "term").distinct()),
        by_sub,
        and_search(index.post, exact.select("qid", "idx", "term").distinct()),
        and_search(index.post, strict.select("qid", "idx", "term").distinct()),
        scored.select("qid", "doc_id"),
    ]
    found = stages[0].withColumn("stage", F.lit(0))
    for i, s in enumerate(stages[1:], 1):
        found = found.unionByName(s.withColumn("stage", F.lit(i)))
    best = found.groupBy("qid", "doc_id").agg(F.min("stage").alias("stage")).join(scored.select("qid", "doc_id", "score"), ["qid", "doc_id"])
    counts = best.groupBy("qid", "stage").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("qid").orderBy("stage").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = counts.withColumn("before", before).where(F.col("before") < k).select("qid", "stage")
    order = W.partitionBy("qid").orderBy("stage", F.desc(F.round("score", 9)), "doc_id")
    return best.join(small(open_), ["qid", "stage"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def static_score(docs: DataFrame, pagerank: DataFrame, date_col: str = "date", dup_col: str = "dup_of") -> DataFrame:
    """(doc_id, g): .5 recency + .3 PageRank over its maximum + .2 for an original, a document that some copy names in ``dup_col``."""
    firsts = docs.select(F.col(dup_col).alias("doc_id")).where("doc_id is not null").distinct().withColumn("original", F.lit(1.0))
    tops = docs.agg(F.max(date_col).alias("now")).join(pagerank.agg(F.max("pr").alias("top")))
    x = docs.join(pagerank.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(F.broadcast(tops)).join(firsts, "doc_id", "left")
    pr = F.when(F.col("top") > 0, F.coalesce(F.col("pr"), F.lit(0.0)) / F.col("top")).otherwise(0.0)
    return x.select("doc_id", (0.5 * recency(F.col(date_col), F.col("now")) + 0.3 * pr + 0.2 * F.coalesce("original", F.lit(0.0))).alias("g"))


# Words that give the direction of "kal", and the endings of the Hindi future.
KAL_WORDS = ("कल", "kal", "kl")
DIRECTION = {"tomorrow": "tomorrow", "yesterday": "yesterday"}
FUTURE_CUES = ("होगा", "होगी", "होंगे", "रहेगा", "रहेगी", "रहेंगे", "करेंगे", "करेगा", "करेगी", "आएगा", "जाएगा", "hoga", "hogi", "rahega", "rahegi", "karenge", "अलर्ट", "चेतावनी", "पूर्वानुमान", "संभावना", "alert", "forecast", "warning", "will", "मौसम", "बारिश", "तापमान", "mausam", "mosam", "barish", "baarish", "weather", "rain")
PAST_CUES = ("हुआ", "हुई", "हुए", "था", "थी", "थे", "गया", "गई", "गए", "लिया", "किया", "hua", "hui", "tha", "thi", "gaya", "नतीजा", "नतीजे", "result", "results", "score", "won", "lost")
FUTURE_ENDINGS = "(ेगा|ेगी|ेंगे|ेगे)$"


def _count(words: Column, test) -> Column:
    return F.size(F.filter(words, test))


def date_intent(query: Column) -> Column:
    """'tomorrow', 'yesterday' or null: an English word decides, else "kal" with the cues around it (a tie means yesterday)."""
    w = F.split(F.lower(F.trim(query)), r"(?U)\s+")
    english = F.get(F.filter(w, lambda x: x.isin(*DIRECTION)), F.lit(0))
    future, past = _count(w, lambda x: x.isin(*FUTURE_CUES)), _count(w, lambda x: x.isin(*PAST_CUES))
    return F.when(english.isNotNull(), english).when(_count(w, lambda x: x.isin(*KAL_WORDS)) == 0, None).when(future > past, "tomorrow").otherwise("yesterday")


def is_future(text: Column) -> Column:
    """The text has more future than past cues."""
    w = F.transform(F.split(text, r"(?U)\s+"), lambda x: F.regexp_replace(x, "^[।.,]+|[।.,]+$", ""))
    return _count(w, lambda x: x.isin(*FUTURE_CUES) | x.rlike(FUTURE_ENDINGS)) > _count(w, lambda x: x.isin(*PAST_CUES))


def kal_boost(intent: Column, date: Column, today: Column, text: Column) -> Column:
    """Boost in 0 to 1 of an article for a date intent; 0 without a date."""
    old = F.datediff(today, date)
    fresh = F.when(is_future(text), F.when(old == 0, 1.0).otherwise(0.6)).otherwise(0.2)
    return F.when(date.isNull() | intent.isNull(), 0.0).when(intent == "yesterday", F.when(old == 1, 1.0).when(old == 0, 0.3).otherwise(0.0)).otherwise(F.when(old <= 1, fresh).otherwise(0.0))


def apply_kal(ranked: DataFrame, queries: DataFrame, docs: DataFrame, weight: float = 0.5, date_col: str = "date") -> DataFrame:
    """Re-ranks (qid, doc_id, score, stage) of queries (qid, query) with a date intent, within stages; others keep their order."""
    today = docs.agg(F.max(F.to_date(date_col)).alias("today"))
    x = ranked.join(small(queries.select("qid", date_intent(F.col("query")).alias("intent"))), "qid").join(docs.select("doc_id", F.to_date(date_col).alias("day"), F.concat_ws(" ", "headline", "body").alias("text")), "doc_id").join(F.broadcast(today))
    x = x.withColumn("score", F.col("score") * (1 + weight * kal_boost(F.col("intent"), F.col("day"), F.col("today"), F.col("text"))))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("stage", F.desc(F.round("score", 9)), "doc_id"))).select("qid", "doc_id", "score", "stage", "rank")


def demote(ranked: DataFrame, page_types: DataFrame, factor: float = 0.3) -> DataFrame:
    """Non-articles get ``factor`` of their score and stand after all articles of the query; page_types: (doc_id, page_type)."""
    x = ranked.join(page_types, "doc_id", "left").withColumn("low", (F.coalesce("page_type", F.lit("article")) != "article").cast("int"))
    x = x.withColumn("score", F.when(F.col("low") == 1, F.col("score") * factor).otherwise(F.col("score")))
    stage = [F.col("stage")] if "stage" in ranked.columns else []
    return x.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("low", *stage, F.desc("score"), "doc_id"))).drop("low", "page_type")


def collapse(ranked: DataFrame, clusters: DataFrame, k: int = 10) -> DataFrame:
    """One result per duplicate cluster, the best ranked; also_in: sorted sources of all other members in the corpus.

    clusters: (doc_id, cluster, source); a document without a row is its own cluster.
    """
    x = ranked.join(clusters.select("doc_id", "cluster"), "doc_id", "left").withColumn("cluster", F.coalesce(F.col("cluster").cast("string"), F.col("doc_id").cast("string")))
    best = x.withColumn("__i", F.row_number().over(W.partitionBy("qid", "cluster").orderBy("rank"))).where("__i = 1").drop("__i")
    others = best.select("qid", "doc_id", "cluster").join(clusters.select(F.col("cluster").cast("string").alias("cluster"), F.col("doc_id").alias("other"), "source"), "cluster").where("other <> doc_id")
    also = others.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_set("source")).alias("also_in"))
    out = best.join(also, ["qid", "doc_id"], "left").withColumn("also_in", F.coalesce("also_in", F.array().cast("array<string>")))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k).drop("cluster")


def minmax(c: Column, *by: str) -> Column:
    """Scaled to 0 to 1 within the group; 1 if all are equal."""
    w = W.partitionBy(*by)
    return F.when(F.max(c).over(w) == F.min(c).over(w), 1.0).otherwise((c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)))


def dense_rerank(ranked: DataFrame, sims: DataFrame, alpha: float = 0.5, depth: int = 50) -> DataFrame:
    """(1 - alpha) first + alpha dense, both min-max scaled over the first ``depth`` ranks, within stages; the tail keeps its order."""
    x = ranked.join(sims, ["qid", "doc_id"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    head = x.where(F.col("rank") <= depth)
    mixed = head.withColumn("mixed", (1 - alpha) * minmax(F.col("score"), "qid") + alpha * minmax(F.col("sim"), "qid"))
    tail = x.where(F.col("rank") > depth).withColumn("mixed", F.lit(None).cast("double"))
    stage = [F.col("stage")] if "stage" in ranked.columns else []
    order = W.partitionBy("qid").orderBy(F.col("mixed").isNull(), *stage, F.desc(F.round("mixed", 9)), F.when(F.col("mixed").isNull(), F.col("rank")), "doc_id")
    return mixed.unionByName(tail).withColumn("rank", F.row_number().over(order))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Bytes of query vectors that a task holds at a time, and rows of the sample that an index of vectors is fitted on.
BLOCK_BYTES, FIT_ROWS = 64 << 20, 20_000


def _unit(rows):
    import numpy as np

    v = np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 1))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _best(s, own, k: int):
    """Indices of the k largest values of a row, ties to the smaller id; all values equal to the k-th are sorted, no others."""
    import numpy as np

    if len(s) > k:
        i = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    else:
        i = np.arange(len(s))
    return i[np.lexsort((own[i], -s[i]))][:k]


def dense_search(queries: DataFrame, docs: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, doc_id, sim, rank): the k nearest of ``docs`` (doc_id, vec) by cosine for each of ``queries`` (qid, vec), without the row of the same id. Exact.

    A set of queries against all rows: queries go in blocks of at most
    ``block_bytes`` of vectors, which is what a task holds; a task keeps its k
    best per query over all its rows, so what is shuffled does not grow with
    them. Ties to nine digits go to the smaller id. Null vectors match nothing.
    """
    import numpy as np
    import pandas as pd

    queries, docs = queries.where("vec is not null and qid is not null"), docs.where("vec is not null and doc_id is not null")
    n, width = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    blocks = max(1, -(-n * 8 * (width or 1) // block_bytes))
    kinds = dict(queries.dtypes)["qid"], dict(docs.dtypes)["doc_id"]
    out = None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).select("qid", "vec").toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((rows["qid"].to_numpy(), _unit(rows["vec"].to_numpy())))

        def best(batches, shared=shared):
            ids, qm = shared.value
            kept: list = [None] * len(ids)
            for pdf in batches:
                v, own = _unit(pdf["vec"].to_numpy()), pdf["doc_id"].to_numpy()
                for a in range(0, len(ids), 256):
                    s = np.round(qm[a : a + 256] @ v.T, 9)
                    s[ids[a : a + 256][:, None] == own[None, :]] = -9
                    for j in range(s.shape[0]):
                        at = _best(s[j], own, k)
                        x, o = s[j][at], own[at]
                        if kept[a + j] is not None:
                            x, o = np.r_[kept[a + j][0], x], np.r_[kept[a + j][1], o]
                            at = _best(x, o, k)
                            x, o = x[at], o[at]
                        kept[a + j] = x, o
            for q, got in zip(ids, kept):
                if got is not None:
                    ok = got[0] > -2
                    yield pd.DataFrame({"qid": np.repeat(q, ok.sum()), "doc_id": got[1][ok], "sim": got[0][ok]})

        part = docs.select("doc_id", "vec").mapInPandas(best, f"qid {kinds[0]}, doc_id {kinds[1]}, sim double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "doc_id"))).where(F.col("rank") <= k)


def vector_cells(docs: DataFrame, cells: int = 64, rounds: int = 8, seed: int = 7):
    """Unit centroids (numpy) of ``cells`` cells: spherical k-means on the FIT_ROWS rows with the smallest hashes of their ids at most, a bounded sample; every row is indexed."""
    import numpy as np

    docs = docs.where("vec is not null and doc_id is not null")
    share = int((1 << 62) * min(1.0, 2 * FIT_ROWS / max(1, docs.count()) + 1e-12))
    rows = docs.select(F.xxhash64("doc_id").bitwiseAND((1 << 62) - 1).alias("h"), "vec").where(F.col("h") <= share).orderBy("h").limit(FIT_ROWS).collect()
    v = _unit([r.vec for r in rows])
    c = v[np.random.default_rng(seed).permutation(len(v))[: min(cells, len(v))]]
    for _ in range(rounds if len(v) else 0):
        at = np.argmax(v @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, v)
        c = np.where(np.bincount(at, minlength=len(c))[:, None] > 0, total, c)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def cell_search(queries: DataFrame, docs: DataFrame, centroids, k: int = 10, probes: int = 32, salts: int = 8) -> DataFrame:
    """(qid, doc_id, sim, rank): ``dense_search`` among the rows of the ``probes`` cells nearest to a query only.

    Rows and queries meet by (cell, part): a cell of a third of all rows is cut
    into ``salts`` parts by a hash of the id, each of which gives its k best.
    """
    import numpy as np
    import pandas as pd

    shared = docs.sparkSession.sparkContext.broadcast(centroids)

    def nearest(count: int, name: str):
        def run(batches):
            for pdf in batches:
                s = _unit(pdf["vec"].to_numpy()) @ shared.value.T
                yield pdf.assign(cells=list(np.argsort(-s, axis=1, kind="stable")[:, :count].astype(np.int32)))[[name, "vec", "cells"]]

        return run

    kinds = dict(queries.dtypes)["qid"], dict(docs.dtypes)["doc_id"], dict(docs.dtypes)["vec"]
    d = docs.where("vec is not null and doc_id is not null").select("doc_id", "vec").mapInPandas(nearest(1, "doc_id"), f"doc_id {kinds[1]}, vec {kinds[2]}, cells array<int>")
    d = d.select("doc_id", "vec", F.col("cells")[0].alias("cell"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("part"))
    q = queries.where("vec is not null and qid is not null").select("qid", "vec").mapInPandas(nearest(probes, "qid"), f"qid {kinds[0]}, vec {kinds[2]}, cells array<int>")
    q = q.select("qid", "vec", F.explode("cells").alias("cell")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": left["qid"].iloc[:0], "doc_id": right["doc_id"].iloc[:0], "sim": np.zeros(0)})
        ids, own = left["qid"].to_numpy(), right["doc_id"].to_numpy()
        s = np.round(_unit(left["vec"].to_numpy()) @ _unit(right["vec"].to_numpy()).T, 9)
        s[ids[:, None] == own[None, :]] = -9
        at = [_best(x, own, k) for x in s]
        out = pd.DataFrame({"qid": np.repeat(ids, [len(x) for x in at]), "doc_id": own[np.concatenate(at)], "sim": np.concatenate([x[i] for x, i in zip(s, at)])})
        return out[out["sim"] > -2]

    x = q.groupBy("cell", "part").cogroup(d.groupBy("cell", "part")).applyInPandas(score, f"qid {kinds[0]}, doc_id {kinds[1]}, sim double")
    return x.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "doc_id"))).where(F.col("rank") <= k)


def text_vectors(post: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, term, w): unit log-tf vectors of the documents in ``ids`` (doc_id)."""
    tf = post.join(small(ids.distinct()), "doc_id").groupBy("doc_id", "term").agg((1 + F.log10(F.sum("tf"))).alias("w"))
    return tf.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id"))))


def mmr(ranked: DataFrame, post: DataFrame, lam: float = 0.7, k: int = 10) -> DataFrame:
    """Maximal marginal relevance within (qid, stage): picks the largest lam * relevance - (1 - lam) * similarity to what is picked; the first of equals wins.

    A group is a result list, bounded by the ranker's k.
    """
    import numpy as np
    import pandas as pd

    v = text_vectors(post, ranked.select("doc_id"))
    lists = v.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    if "stage" not in ranked.columns:
        ranked = ranked.withColumn("stage", F.lit(0))
    x = ranked.select("qid", "stage", "rank", "doc_id", "score").join(lists, "doc_id", "left")
    kinds = dict(x.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        vec = [dict(zip(t, w)) if t is not None else {} for t, w in zip(pdf["terms"], pdf["ws"])]
        s = pdf["score"].to_numpy(dtype=float)
        rel = np.ones(len(s)) if s.max() == s.min() else (s - s.min()) / (s.max() - s.min())
        left, picked, worst = list(range(len(s))), [], np.zeros(len(s))
        while left and len(picked) < k:
            best = max(left, key=lambda i: (round(lam * rel[i] - (1 - lam) * worst[i], 12), -i))
            left.remove(best)
            picked.append(best)
            for i in left:
                a, b = vec[best], vec[i]
                if len(a) > len(b):
                    a, b = b, a
                worst[i] = max(worst[i], sum(w * b[t] for t, w in a.items() if t in b))
        out = pdf.loc[picked, ["qid", "stage", "doc_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return x.groupBy("qid", "stage").applyInPandas(pick, f"qid {kinds['qid']}, stage int, doc_id {kinds['doc_id']}, score double, rank int")


def rocchio(q: DataFrame, relevant: DataFrame, other: DataFrame | None, index: Index, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15, k: int = 5) -> DataFrame:
    """(qid, term, w): the k best new terms of the moved query; weights of zero or less are clipped. relevant, other: (qid, doc_id)."""
    tfidf = lambda ids: index.post.join(small(ids), "doc_id").groupBy("qid", "doc_id", "term").agg(F.sum("tf").alias("tf")).join(index.terms.select("term", "idf"), "term").withColumn("w", (1 + F.log10("tf")) * F.col("idf"))
    mean = lambda ids, f: tfidf(ids).groupBy("qid", "term").agg(F.sum("w").alias("s")).join(small(ids.groupBy("qid").agg(F.countDistinct("doc_id").alias("c"))), "qid").select("qid", "term", (f * F.col("s") / F.col("c")).alias("w"))
    own = query_vector(q, index).select("qid", "term", (alpha * F.col("w")).alias("w"))
    every = own.unionByName(mean(relevant, beta))
    if other is not None:
        every = every.unionByName(mean(other, -gamma))
    moved = every.groupBy("qid", "term").agg(F.sum("w").alias("w")).where("w > 0").join(small(q.select("qid", "term").distinct()), ["qid", "term"], "left_anti")
    return moved.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("w", 9)), "term"))).where(F.col("rank") <= k)


def feedback(q: DataFrame, index: Index, scored: DataFrame, page_types: DataFrame | None = None, first: int = 30, docs: int = 5, terms: int = 5) -> DataFrame:
    """``q`` with pseudo-relevance terms (source 'prf') from the best articles of a first pass."""
    ranked = top(scored, first)
    if page_types is not None:
        ranked = demote(ranked, page_types)
    new = rocchio(q, ranked.where(F.col("rank") <= docs).select("qid", "doc_id"), None, index, k=terms)
    last = q.groupBy("qid").agg(F.max("idx").alias("last"))
    best = F.max("w").over(W.partitionBy("qid"))
    return q.unionByName(new.join(small(last), "qid").select("qid", (F.col("last") + F.col("rank")).alias("idx"), "term", (F.col("w") / best).alias("weight"), F.lit("prf").alias("source")))


def difficulty(q: DataFrame, index: Index, ranked: DataFrame, strong: float = 0.3, depth: int = 10, lam: float = 0.6, threshold: float = 1.0) -> DataFrame:
    """(qid, specificity, scope, clarity, low_confidence): largest idf of a word's commonest strong spelling, share of documents touched, divergence in bits of the results' language from the collection's."""
    known = q.where(F.col("weight") >= strong).join(index.terms.select("term", "df", "idf"), "term")
    spec = known.groupBy("qid", "idx").agg(F.min("idf").alias("i")).groupBy("qid").agg(F.max("i").alias("specificity"))
    touched = hits(index.post, q.select("qid", "idx", "term")).select("qid", "doc_id").distinct().groupBy("qid").agg(F.count("*").alias("m")).join(F.broadcast(index.n)).select("qid", (F.col("m") / F.col("n")).alias("scope"))
    head = ranked.where(F.col("rank") <= depth).select("qid", "doc_id", "score")
    share = head.withColumn("p", F.when(F.sum("score").over(W.partitionBy("qid")) > 0, F.col("score") / F.sum("score").over(W.partitionBy("qid"))).otherwise(1.0 / F.count("*").over(W.partitionBy("qid"))))
    tf = index.post.join(small(share), "doc_id").groupBy("qid", "doc_id", "p", "term").agg(F.sum("tf").alias("tf")).join(index.stats.select("doc_id", "len"), "doc_id")
    total = index.stats.agg(F.sum("len").alias("total"))
    model = tf.groupBy("qid", "term").agg(F.sum(F.col("p") * F.col("tf") / F.col("len")).alias("d")).join(index.terms.select("term", "cf"), "term").join(F.broadcast(total))
    coll = F.greatest(F.col("cf"), F.lit(1)) / F.col("total")
    mixed = lam * F.col("d") + (1 - lam) * coll
    clar = model.groupBy("qid").agg(F.sum(mixed * F.log2(mixed / coll)).alias("clarity"))
    out = q.select("qid").distinct().join(spec, "qid", "left").join(touched, "qid", "left").join(clar, "qid", "left")
    fill = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("qid", fill("specificity").alias("specificity"), fill("scope").alias("scope"), fill("clarity").alias("clarity"), (fill("specificity") < threshold).alias("low_confidence"))


def explain_query(q: DataFrame, index: Index) -> DataFrame:
    """(qid, term, qtf, df, idf, weight) of a query's terms; df 0 and nulls for terms that are not in the index."""
    x = query_tf(q).join(index.terms.select("term", "df", "idf"), "term", "left")
    return x.join(query_vector(q, index).withColumnRenamed("w", "weight"), ["qid", "term"], "left").select("qid", "term", "qtf", F.coalesce("df", F.lit(0)).alias("df"), "idf", "weight")


def _matched(index: Index, ranked: DataFrame, words: DataFrame) -> DataFrame:
    """Results (qid, doc_id, rank) with each term of ``words`` (qid, term, ..) that they hold, and its tf."""
    post = index.post.join(small(words.select("term").distinct()), "term", "left_semi").join(small(ranked.select("doc_id").distinct()), "doc_id", "left_semi")
    return ranked.select("qid", "doc_id", "rank").join(post.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")), "doc_id").join(words, ["qid", "term"]).join(index.stats, "doc_id")


def explain_bm25(q: DataFrame, index: Index, ranked: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, rank, doc_id, term, tf, df, idf, part): what each term gives to the score of each result."""
    t = query_tf(q).join(index.terms.select("term", "df"), "term")
    avg = index.stats.agg(F.sum("len").alias("total")).join(index.n).select((F.col("total") / F.col("n")).alias("avgdl"), "n")
    x = _matched(index, ranked, t).join(F.broadcast(avg)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return x.select("qid", "rank", "doc_id", "term", "tf", "df", "idf", part.alias("part"))


def explain_cosine(q: DataFrame, index: Index, ranked: DataFrame) -> DataFrame:
    """(qid, rank, doc_id, term, tf, weight, part): what each term gives to the cosine of each result."""
    x = _matched(index, ranked, query_vector(q, index))
    return x.select("qid", "rank", "doc_id", "term", "tf", F.col("w").alias("weight"), (F.col("w") * (1 + F.log10("tf")) / F.col("norm")).alias("part"))


def explain_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """(qid, stage, docs, fresh, so_far) of stages (qid, doc_id) from the strictest on: their documents, those that no stricter one has, and all up to them."""
    every = None
    for i, (name, x) in enumerate(stages.items()):
        row = x.select("qid", "doc_id", F.lit(i).alias("i"), F.lit(name).alias("stage"))
        every = row if every is None else every.unionByName(row)
    first = every.groupBy("qid", "doc_id").agg(F.min("i").alias("i")).groupBy("qid", "i").agg(F.count("*").alias("fresh"))
    x = every.groupBy("qid", "i", "stage").agg(F.count("*").alias("docs")).join(first, ["qid", "i"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    return x.select("qid", "stage", "docs", "fresh", F.sum("fresh").over(W.partitionBy("qid").orderBy("i")).alias("so_far"))
