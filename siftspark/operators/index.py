"""The zoned positional index as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.session import cut, is_small

ZONES = ("headline", "body")


#: Repeated ids that are sent to every task (16 MB); more are joined.
REPEATED = 1_000_000


def first_of_each(docs: DataFrame, id_col: str = "doc_id", order: str | None = None) -> DataFrame:
    """One row per id: the first by ``order`` (all columns break ties), so that repeated rows count once. Null ids are dropped.

    Only rows of ids that occur several times are shuffled; the others stay
    where they are read.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    several = cut(docs.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__c")).where("__c > 1").select("__id"))
    if (many := several.count()) == 0:
        return docs
    ids = F.broadcast(several) if many <= REPEATED else several
    keys = [F.col(order)] if order else []
    rest = [F.xxhash64(*[F.col(c) for c in docs.columns])]
    same = docs[id_col] == F.col("__id")
    repeated = docs.join(ids, same, "left_semi").withColumn("__rn", F.row_number().over(W.partitionBy(id_col).orderBy(*keys, *rest))).where("__rn = 1").drop("__rn")
    return docs.join(ids, same, "left_anti").unionByName(repeated)


def as_articles(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as articles: the first line is the headline, the rest the body; null text gives empty zones."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumns({"headline": F.substring_index(t, "\n", 1), "body": F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise("")})


def tokens(docs: DataFrame, mode: str = "none", auto: Column | None = None, compose: bool = True) -> DataFrame:
    """(doc_id, zone, pos, term): positions from 0 in each zone; null zones have no tokens."""
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), F.col(z).alias("text")) for z in ZONES])
    rows = docs.select("doc_id", F.explode(zones).alias("z")).select("doc_id", "z.zone", F.posexplode(X.tokenize(X.normalize(F.col("z.text"), compose))).alias("pos", "word"))
    return rows.select("doc_id", "zone", "pos", X.stem(F.col("word"), mode, auto).alias("term"))


def postings(toks: DataFrame) -> DataFrame:
    """(term, zone, doc_id, tf, positions): positions sorted."""
    return toks.groupBy("term", "zone", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def doc_stats(post: DataFrame) -> DataFrame:
    """(doc_id, len, norm): tokens of a document, and the length of its log-tf vector over both zones."""
    tf = post.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("len"), F.sqrt(F.sum(F.pow(1 + F.log10("tf"), 2))).alias("norm"))


def term_stats(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, cf, idf): documents over both zones, occurrences, log10(N / df)."""
    by_doc = post.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    t = by_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return t.join(F.broadcast(n_docs)).withColumn("idf", F.log10(F.col("n") / F.col("df"))).drop("n")


def skip_positions(n: int) -> dict[int, int]:
    """Skip pointers of a list of n postings, every floor(sqrt n); kept for reports, joins need none."""
    step = int(n**0.5)
    return {i: i + step for i in range(0, n - step, step)} if step > 1 else {}


@dataclass
class Index:
    """docs, postings, term statistics, document statistics and N (one row) of one mode."""

    mode: str
    docs: DataFrame
    post: DataFrame
    terms: DataFrame
    stats: DataFrame
    n: DataFrame

    def save(self, path: str) -> None:
        """Parquet under path/mode=...; postings in ranges of (term, document) and sorted, so that a term's row groups are found by their statistics and a term of a third of all documents is spread over many files."""
        for name in ("docs", "terms", "stats", "n"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}/mode={self.mode}")
        self.post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "zone", "doc_id").write.mode("overwrite").parquet(f"{path}/post/mode={self.mode}")

    @staticmethod
    def load(spark: SparkSession, path: str, mode: str) -> "Index":
        if mode not in X.MODES:
            raise ValueError(f"unknown mode {mode!r}")
        read = lambda name: spark.read.parquet(f"{path}/{name}/mode={mode}")
        return Index(mode, read("docs"), read("post"), read("terms"), read("stats"), read("n"))


def restrict(index: Index, words: DataFrame) -> Index:
    """The index with the postings and statistics of the terms in ``words`` (term) only, written once: all rankers and stages of a batch of queries read these."""
    w = words.select("term").distinct()
    w = F.broadcast(w) if is_small(w) else w
    return replace(index, post=cut(index.post.join(w, "term", "left_semi")), terms=cut(index.terms.join(w, "term", "left_semi")))


def build(docs: DataFrame, mode: str = "none", auto: Column | None = None, order: str | None = None, compose: bool = True, keep: bool = False) -> Index:
    """Index of ``docs`` (doc_id, headline, body, ...); the first row of a repeated id wins.

    With ``keep`` the postings are written once to the shared folder, so that
    texts are not read again for every use of the index.
    """
    if mode not in X.MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(X.MODES)}")
    docs = first_of_each(docs, order=order)
    post = postings(tokens(docs, mode, auto, compose))
    post = cut(post) if keep else post
    n = docs.agg(F.count("*").alias("n"))
    return Index(mode, docs, post, term_stats(post, n), doc_stats(post), n)


def build_all(docs: DataFrame, modes: tuple[str, ...] = ("none", "light", "aggr"), **kw) -> dict[str, Index]:
    return {m: build(docs, m, **kw) for m in modes}
