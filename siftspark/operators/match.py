"""Boolean, phrase and proximity matching as relational division; filters on articles.

Every function takes a batch of queries: a DataFrame (qid, idx, term) with one
row per term of a query, or several alternatives per idx. It is the small side,
and is broadcast only if its estimated size is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.session import is_small


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint if the size is known to be small."""
    return F.broadcast(df) if is_small(df) else df


def query_words(queries: DataFrame, mode: str = "none") -> DataFrame:
    """(qid, idx, term) of queries (qid, query)."""
    return queries.select("qid", F.posexplode(X.analyze(F.col("query"), mode)).alias("idx", "term"))


def _zone(post: DataFrame, zone: str | None) -> DataFrame:
    if zone not in (None, "headline", "body"):
        raise ValueError(f"unknown zone {zone!r}")
    return post if zone is None else post.where(F.col("zone") == zone)


def hits(post: DataFrame, q: DataFrame, zone: str | None = None) -> DataFrame:
    """Postings of the queries' terms: (qid, idx, term, zone, doc_id, tf, positions)."""
    return _zone(post, zone).join(small(q), "term")


def and_search(post: DataFrame, q: DataFrame, zone: str | None = None, at_least: Column | None = None) -> DataFrame:
    """(qid, doc_id) of documents that hold every term (each idx by one of its alternatives), or ``at_least`` many of the n terms; a query without terms finds nothing."""
    need = q.groupBy("qid").agg(F.countDistinct("idx").alias("n"))
    got = hits(post, q, zone).groupBy("qid", "doc_id").agg(F.countDistinct("idx").alias("m")).join(small(need), "qid")
    return got.where(F.col("m") >= (F.col("n") if at_least is None else at_least)).select("qid", "doc_id")


def search_query(index, queries: DataFrame, mode: str | None = None, zone: str = "body") -> DataFrame:
    """(qid, doc_id) of ``and_search`` in one zone for queries (qid, query), analysed in the index's mode; an unknown mode or zone, or a mode other than the index's, is an error."""
    mode = index.mode if mode is None else mode
    if mode not in X.MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(X.MODES)}")
    if mode != index.mode:
        raise ValueError(f"mode {mode!r} of the query is not mode {index.mode!r} of the index")
    if zone not in ("headline", "body"):
        raise ValueError(f"unknown zone {zone!r}")
    return and_search(index.post, query_words(queries, mode), zone)


def phrase_search(post: DataFrame, q: DataFrame, zone: str | None = None) -> DataFrame:
    """(qid, doc_id) of documents with the terms side by side, in order, in one zone; a term may recur in a phrase."""
    need = q.groupBy("qid").agg(F.countDistinct("idx").alias("n"))
    at = hits(post, q, zone).select("qid", "doc_id", "zone", "idx", F.explode("positions").alias("pos"))
    full = at.groupBy("qid", "doc_id", "zone", (F.col("pos") - F.col("idx")).alias("start")).agg(F.countDistinct("idx").alias("m"))
    return full.join(small(need), "qid").where("m = n").select("qid", "doc_id").distinct()


def proximity_search(post: DataFrame, q: DataFrame, distance: int, zone: str | None = None) -> DataFrame:
    """(qid, doc_id) where some position of the first term has every other term within ``distance`` positions, in one zone."""
    if distance < 0:
        raise ValueError("distance must not be negative")
    need = q.groupBy("qid").agg(F.countDistinct("idx").alias("n"))
    h = hits(post, q, zone)
    anchor = h.where("idx = 0").select("qid", "doc_id", "zone", F.explode("positions").alias("a"))
    others = h.where("idx > 0").select("qid", "doc_id", "zone", "idx", "positions")
    near = anchor.join(others, ["qid", "doc_id", "zone"], "left").withColumn("ok", F.exists("positions", lambda p: F.abs(p - F.col("a")) <= distance))
    full = near.groupBy("qid", "doc_id", "zone", "a").agg(F.count_distinct(F.when(F.col("ok"), F.col("idx"))).alias("m")).join(small(need), "qid")
    return full.where("m = n - 1").select("qid", "doc_id").distinct()


def smallest_window(post: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, doc_id, zone, matched, span): terms of the query that stand in a zone, and the tightest span of positions that covers them; null span for fewer than two.

    One pass over a zone's occurrences in order, which carries the last place of
    each term and the best span so far.
    """
    at = hits(post, q.select("qid", "term").distinct()).select("qid", "doc_id", "zone", "term", "positions")
    # a zone's terms are numbered by their place in its list; the list is bounded by the query's words
    run = at.groupBy("qid", "doc_id", "zone").agg(F.collect_list(F.struct("term", "positions")).alias("ts"))
    events = F.array_sort(F.flatten(F.transform("ts", lambda t, i: F.transform(t["positions"], lambda p: F.struct(p.cast("int").alias("pos"), i.cast("int").alias("no"))))))
    run = run.select("qid", "doc_id", "zone", F.size("ts").cast("long").alias("matched"), events.alias("e"))
    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(none, F.col("matched").cast("int")).alias("last"), none.alias("best"))

    def step(acc, x):
        last = F.transform(acc["last"], lambda v, i: F.when(i == x["no"], x["pos"]).otherwise(v))
        full = X.bind(last, lambda l: F.struct(l.alias("last"), F.when(F.exists(l, lambda v: v.isNull()), none).otherwise(x["pos"] - F.array_min(l) + 1).alias("span")))
        return X.bind(full, lambda y: F.struct(y["last"].alias("last"), F.least(acc["best"], y["span"]).alias("best")))

    best = F.aggregate("e", start, step)["best"]
    return run.select("qid", "doc_id", "zone", "matched", F.when(F.col("matched") >= 2, best).cast("long").alias("span"))


def field_filter(docs: DataFrame, sources: list[str] | None = None, sections: list[str] | None = None, states: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, date_col: str = "date") -> DataFrame:
    """Rows that meet every given restriction; a null date fails any bound; bounds are days and inclusive."""
    for col, values in (("source", sources), ("section", sections), ("state", states)):
        if values:
            docs = docs.where(F.col(col).isin(*values))
    if date_from:
        docs = docs.where(F.col(date_col) >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        docs = docs.where(F.col(date_col) < F.to_timestamp(F.lit(date_to)) + F.expr("INTERVAL 1 DAY"))
    return docs


def field_values(docs: DataFrame, col: str) -> DataFrame:
    """Distinct non-empty values, sorted."""
    return docs.select(F.col(col).alias("value")).where("value is not null and value <> ''").distinct().orderBy("value")


def top(df: DataFrame, k: int, score: str = "score", last_first: bool = True, by: str = "qid") -> DataFrame:
    """The k best of each query with their rank from 1. Scores equal to nine digits: larger doc_id first (``last_first``), or smaller."""
    order = [F.desc(F.round(score, 9)), F.desc("doc_id") if last_first else F.asc("doc_id")]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
