"""Near-duplicate clustering of articles: MinHash bands, exact hashes, a time window, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.functions.web import micros
from siftspark.operators.graph import connected_components
from siftspark.session import cut


def hashed_shingles(text: Column, n: int = 4) -> Column:
    """Distinct n-word shingles as sorted 64-bit hashes, a fifth of their letters in size."""
    return F.array_sort(F.transform(X.shingles(text, n), lambda x: F.xxhash64(x)))


def members_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body", date_col: str | None = None, n: int = 4) -> DataFrame:
    """(id, at, cls, shingles, crc): one row per document that has a word, with its n-word shingles as 64-bit hashes, sorted, and as the 31-bit hashes of MinHash; cls is the hash of the set. The one pass over the texts."""
    at = F.col(date_col) if date_col else F.lit(None).cast("timestamp")
    w = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), at.alias("at"), X.shingles(F.col(text_col), n).alias("w")).where(F.size("w") > 0)
    crc = F.transform("w", lambda x: F.crc32(x.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    x = w.select("id", "at", F.array_sort(F.transform("w", lambda x: F.xxhash64(x))).alias("shingles"), crc.alias("crc"))
    return cut(x.select("id", "at", F.xxhash64("shingles").alias("cls"), "shingles", "crc"))


def signatures(members: DataFrame) -> DataFrame:
    """(cls, shingles, sig): one row per distinct shingle set of ``members_of``; the minima of a set are taken at once, over its array."""
    import numpy as np
    import pyarrow as pa

    ab = np.array(X.minhash_coefficients(), dtype=np.int64)

    def run(batches):
        for b in batches:
            crc = b.column("crc")
            off = crc.offsets.to_numpy()
            h = crc.values.to_numpy().astype(np.int64)[off[0] : off[-1]]
            start = (off - off[0])[:-1]
            sig = np.empty((len(crc), len(ab)), dtype=np.int64)
            for j, (x, y) in enumerate(ab.tolist()):
                sig[:, j] = np.minimum.reduceat((h * x + y) % 2147483647, start)
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("shingles"), pa.ListArray.from_arrays(pa.array(np.arange(len(crc) + 1, dtype=np.int32) * len(ab)), pa.array(sig.reshape(-1)))], ["cls", "shingles", "sig"])

    return members.select("cls", "shingles", "crc").dropDuplicates(["cls"]).mapInArrow(run, "cls long, shingles array<long>, sig array<long>")


def band_pairs(sigs: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """(a, b), a < b: classes with an equal band. Exact copies are one class, so a bucket holds different sets only."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(F.col("sig"), i * rows + 1, F.lit(rows))))
    e = sigs.select("cls", F.explode(keys).alias("key"))
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls"))).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def verified_pairs(sigs: DataFrame, pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold."""
    s = sigs.select("cls", "shingles")
    x = pairs.join(s.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(s.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    return x.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def within(a: Column, b: Column, hours: float) -> Column:
    """At most ``hours`` apart; an unknown time passes."""
    return a.isNull() | b.isNull() | (F.abs(micros(a) - micros(b)) <= int(hours * 3600e6))


def candidates(sigs: DataFrame, lsh: bool = True) -> DataFrame:
    """(a, b), a < b: classes with an equal band, or without ``lsh`` all classes with a common shingle."""
    if lsh:
        return band_pairs(sigs.select("cls", "sig"))
    e = sigs.select("cls", F.explode("shingles").alias("s"))
    return e.alias("a").join(e.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.cls") < F.col("b.cls"))).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body", date_col: str | None = None, threshold: float = 0.7, lsh: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, at, cls) of every document with a word, and (a, b, similarity) of different classes at or above the threshold.

    Equal sets are one class, so a group of copies of any size costs its rows only.
    """
    m = members_of(docs, id_col, text_col, date_col)
    sigs = cut(signatures(m))
    return m.select("id", "at", "cls").distinct(), cut(verified_pairs(sigs, candidates(sigs, lsh), threshold))


def representative_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b, similarity), doc_a < doc_b: the links as pairs of the smallest ids of their classes."""
    name = members.groupBy("cls").agg(F.min("id").alias("id"))
    x = links.join(name.select(F.col("cls").alias("a"), F.col("id").alias("ia")), "a").join(name.select(F.col("cls").alias("b"), F.col("id").alias("ib")), "b")
    return x.select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b"), "similarity")


def near_in_time(members: DataFrame, links: DataFrame, hours: float = 24.0) -> DataFrame:
    """(doc_a, doc_b): edges that connect just the documents that pairs of equal or linked classes at most ``hours`` apart (unknown times pass) connect.

    Within a class, documents in order of time are tied to their neighbours, and
    those without time to the class's first document. Across a link, a document
    is tied to the nearest one of the other class on either side in time: others
    in reach of it are tied to that one through neighbours or documents between.
    No group is expanded into all its pairs.
    """
    m = members.select("id", F.col("at").cast("timestamp").alias("at"), "cls")
    gap = int(hours * 3600e6)
    t = micros(F.col("at"))
    by = W.partitionBy("cls").orderBy("t", "id")
    m = m.withColumn("t", t)
    timed = m.where("t is not null")
    chain = timed.withColumns({"p": F.lag("id").over(by), "pt": F.lag("t").over(by)}).where(F.col("p").isNotNull() & (F.col("t") - F.col("pt") <= gap)).select("id", F.col("p").alias("other"))
    least = m.groupBy("cls").agg(F.min("id").alias("first"))
    # a document without time passes with every member of its class, and of linked classes
    free = m.where("t is null")
    one = free.groupBy("cls").agg(F.min("id").alias("free"))
    inner = m.join(one, "cls").select("id", F.col("free").alias("other"))
    both = links.select("a", "b").union(links.select("b", "a")).toDF("cls", "to")
    outer = m.join(both, "cls").join(one.withColumnRenamed("cls", "to"), "to").select("id", F.col("free").alias("other"))
    # times of both classes of a link in one order: the last one of the other class before each document
    pair = links.select(F.struct("a", "b").alias("link"), F.explode(F.array("a", "b")).alias("cls"))
    x = timed.join(pair, "cls").select("link", "cls", "id", "t")
    run = W.partitionBy("link").orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1)
    side = F.col("cls") == F.col("link.a")
    seen = lambda own: F.last(F.when(own, F.struct("t", "id")), ignorenulls=True).over(run)
    x = x.withColumn("o", F.when(side, seen(~side)).otherwise(seen(side))).where(F.col("o").isNotNull() & (F.col("t") - F.col("o.t") <= gap)).select("id", F.col("o.id").alias("other"))
    every = chain.unionByName(inner).unionByName(outer).unionByName(x).where("id <> other")
    return every.select(F.least("id", "other").alias("doc_a"), F.greatest("id", "other").alias("doc_b")).distinct()


def clusters(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", date_col: str = "date") -> DataFrame:
    """(doc_id, dup_of): each member of a cluster names its root, the earliest by date (unknown dates last), then by id; the root and single documents have null."""
    comp = connected_components(pairs, "doc_a", "doc_b")
    d = docs.groupBy(F.col(id_col).alias("id")).agg(F.min(date_col).alias("at"))
    m = comp.join(d, "id")
    root = m.groupBy("component").agg(F.min(F.struct(F.col("at").isNull(), F.col("at"), F.col("id"))).alias("r")).select("component", F.col("r.id").alias("root"))
    named = m.join(root, "component").select("id", F.when(F.col("id") != F.col("root"), F.col("root")).alias("dup_of"))
    return d.select("id").join(named, "id", "left").select(F.col("id").alias(id_col), "dup_of")


def report(docs: DataFrame, lineage: DataFrame) -> DataFrame:
    """(documents, clusters, duplicates)."""
    return lineage.agg(F.count("*").alias("documents"), F.countDistinct("dup_of").alias("clusters"), F.count("dup_of").alias("duplicates"))
