"""Problem 7: deduplicating new batches against all history.

Texts are cut into content-defined chunks (rolling hash over words); a
persistent table of chunks and their records gives what a delivery shares with
each record, and coverage decides. ``seen_before`` finds all deliveries similar
to an earlier record: what the shared chunks prove is decided by them alone,
and only deliveries that they leave open are checked exactly (filters of
``neardup``, then the full sets). ``accept_batch`` judges a batch by the share
of its bytes in known chunks and appends what it accepts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import neardup, text
from siftspark.llm.base import merge_counts
from siftspark.session import checkpoint_dir, cut

#: Words on both sides among which a chunk's last word has the smallest rolling hash; chunks have about 2 * RADIUS + 1 words.
RADIUS = 3

#: Records of a chunk beyond which it proves nothing: pairs that share only such chunks are left to the exact check.
COMMON = 64


class ChunkTable:
    """The persistent table of chunks (or prefix shingles) and their records: appended generation by generation, never rewritten."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"

    def append(self, chunks: DataFrame, generation: int) -> None:
        chunks.write.mode("overwrite").parquet(f"{self.path}/generation={generation}")

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/generation=*")


def seen_before(history: DataFrame, batches: DataFrame, text_col: str, order: list[str], k: int = 5, t: float = 0.8, table: ChunkTable | None = None) -> DataFrame:
    """The deliveries of ``batches`` whose text is the same as, or similar (t on k-word shingles) to, one of ``history`` or of an earlier delivery.

    Returns the distinct ``order`` columns (batch, sequence). Null and wordless
    texts are no case; repeated rows name the same delivery; a delivery is
    never its own earlier copy. Deliveries are compared by text only.
    """
    spark = batches.sparkSession
    b, s = order
    place = F.col(b).cast("long") * F.lit(1 << 32) + F.col(s).cast("long")
    # an id of each row: its place in the order, or below zero for the history
    h = history.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), (-1 - F.abs(F.xxhash64(text_col) % (1 << 62))).alias("id"))
    n = batches.where(F.col(text_col).isNotNull() & F.col(b).isNotNull() & F.col(s).isNotNull()).select(F.col(text_col).alias("text"), place.alias("id"))
    both = h.union(n)

    def chunks(w, o, keep, new):
        """Of each text that is new to the task its chunks, and how many shingles start in each for the first time."""
        value, _, doc, start = w.chunks(RADIUS, k - 1)
        first = np.zeros(len(w.h) + 1, dtype=np.int64)
        first[w.first[w.first >= 0]] = 1
        news = np.diff(np.cumsum(np.r_[0, first])[np.r_[start, len(w.h)]])
        n = np.searchsorted(doc, keep, "right") - np.searchsorted(doc, keep)
        off = np.r_[0, np.cumsum(np.where(new[keep], n, 0))].astype(np.int32)
        rows = np.flatnonzero(np.repeat(new[keep], n))
        return [pa.ListArray.from_arrays(pa.array(off), pa.array(x[rows])) for x in (value.view(np.int64), np.minimum(news, 32767).astype(np.int16))]

    rows, counts = neardup.classes(both, k, chunks, ", chunk array<long>, news array<short>")
    table = table or ChunkTable(spark)
    each = rows.where(F.size("chunk") > 0).select("cls", "n", "chunk", "news", "id")
    table.append(each.where("id < 0").drop("id"), 0)
    table.append(each.where("id >= 0").drop("id"), 1)
    members = rows.select("id", "cls").distinct()
    # a set of the history and of a delivery may go by either row: its deliveries are found by the history anyway
    at = cut(members.select("cls", F.greatest("id", F.lit(-1)).alias("at")).distinct())
    by_chunks = cut(proven(table.read(), t))
    open_ = at.where("at >= 0").join(found(at, by_chunks), "at", "left_anti").select("cls").distinct()
    sketch = spark.sparkContext.broadcast(counts)
    # a class of the history decides its deliveries, so only deliveries are open; others are read for the tokens of open ones only
    open_ = cut(open_)
    marks = neardup.hash_flags(open_, "cls")
    # by one bitmap, each class of a delivery is either fresh, with all tokens of its prefixes, or read with the history
    fresh = cut(neardup.prefix_rows(n, k, t, sketch, only=marks))
    flags = neardup.hash_flags(fresh, "tok")
    rest = neardup.prefix_rows(h, k, t, sketch, flags).union(neardup.prefix_rows(n, k, t, sketch, flags, but=marks))
    posts = fresh.withColumn("fresh", F.lit(True)).union(rest.withColumn("fresh", F.lit(False)))
    links = neardup.verified(both, members, neardup.candidates(posts, t, fresh="fresh"), k, t)
    out = found(at, by_chunks.union(links))
    return out.select(F.shiftright("at", 32).cast("int").alias(b), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias(s))


def proven(table: DataFrame, t: float) -> DataFrame:
    """(a, b): different classes, a of a delivery (generation over 0), whose shared chunks prove a similarity of t or more; table: (cls, n, chunk, news, generation).

    Shingles that start in a shared chunk are in both sets, and those counted
    for it start nowhere before; so their sum is at most what the sets have in
    common. A record reads out only chunks that a delivery may have and that, by
    a count sketch, at most COMMON records have; the sketch errs towards more,
    so less is proven, never more, and no hot chunk is shuffled.
    """
    some = lambda x: text.mix(x.view(text.U), 41)
    flat = lambda b: b.column("chunk").flatten().to_numpy(zero_copy_only=False)
    total = table.agg(F.sum(F.size("chunk"))).first()[0] or 0
    size = neardup.cells_for(4 * total, neardup.FLAGS)
    cell = lambda x: (some(x) % text.U(size)).astype(np.int64)
    fresh = table.where("generation > 0").select("chunk")
    sketches = [merge_counts(x, lambda b: cell(flat(b)), size) for x in (table.select("chunk"), fresh)]
    use = table.sparkSession.sparkContext.broadcast((sketches[0] > 1) & (sketches[0] <= COMMON) & (sketches[1] > 0))

    def read(batches):
        for b in batches:
            lists = b.column("chunk")
            x = flat(b)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            i = np.flatnonzero(use.value[cell(x)]) if len(x) else np.zeros(0, dtype=np.int64)
            at = pa.array(row[i])
            yield pa.RecordBatch.from_arrays([pa.array(x[i]), b.column("cls").take(at), b.column("n").take(at), b.column("news").flatten().take(pa.array(i)), b.column("fresh").take(at)], ["chunk", "cls", "n", "news", "fresh"])

    one = table.select("cls", "n", "chunk", "news", (F.col("generation") > 0).alias("fresh")).mapInArrow(read, "chunk long, cls long, n int, news short, fresh boolean")
    # a text may be in several tasks; of a chunk that recurs in a text only the first one has shingles that are new
    one = one.repartition("chunk").groupBy("chunk", "cls").agg(F.first("n").alias("n"), F.max("news").cast("int").alias("news"), F.max("fresh").alias("fresh"))
    a, b = one.where("fresh").alias("a"), one.alias("b")
    both = a.join(b, (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.cls") != F.col("b.cls")))
    sums = both.groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.sum("a.news").alias("x"), F.sum("b.news").alias("y"))
    common = F.greatest("x", "y")
    return sums.where(common >= F.lit(t) * (F.col("na") + F.col("nb") - common) - F.lit(1e-9)).select("a", "b")


def found(at: DataFrame, links: DataFrame) -> DataFrame:
    """(at): deliveries (cls, at) with a record of their class, or of a linked one, before them."""
    first = at.groupBy("cls").agg(F.min("at").alias("first"))
    near = links.select("a", "b").union(links.select("b", "a")).toDF("cls", "other")
    near = near.join(first.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.min("first").alias("near"))
    return at.where("at >= 0").join(first, "cls").join(near, "cls", "left").where("first < at or near < at").select("at").distinct()


def all_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, cls, bytes, total): every chunk of each distinct text of ``docs`` (text), once for each task that holds the text."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, w, v, o, cls in neardup.sets_of(batch, "text", 4):
                new = neardup.unseen(cls, w.per_doc > 0, seen)
                h, size, d, _ = w.chunks(RADIUS)
                total = np.bincount(d, weights=size, minlength=len(cls)).astype(np.int64)
                ok = new[d]
                h, size, d = h[ok], size[ok], d[ok]
                # a repeated chunk of one text counts once, with its bytes added up
                key = np.lexsort((h, d))
                h, size, d = h[key], size[key], d[key]
                if len(h):
                    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
                    h, size, d = h[start], np.add.reduceat(size, start), d[start]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls[d].view(np.int64)), pa.array(size.astype(np.int32)), pa.array(total[d].astype(np.int32))], ["chunk", "cls", "bytes", "total"])

    return docs.select("text").mapInArrow(run, "chunk long, cls long, bytes int, total int")


def accept_batches(history: DataFrame, batches: DataFrame, history_id: str, text_col: str, order: list[str], covered: float = 0.8) -> DataFrame:
    """(batch, seq, share, accepted) of all deliveries: ``accept_batch`` for the history, then for one batch after the other.

    A batch reads its own rows and the chunk table, no text of the history or of
    an earlier batch. Null batch numbers or places take no part.
    """
    b, s = order
    table = ChunkTable(batches.sparkSession)
    cut(accept_batch(table, history.select(history_id, text_col), history_id, text_col, 0, covered))
    rows = batches.where(F.col(b).isNotNull() & F.col(s).isNotNull())
    out = None
    for i, r in enumerate(rows.select(b).distinct().orderBy(b).collect(), 1):
        one = cut(accept_batch(table, rows.where(F.col(b) == r[0]).select(s, text_col), s, text_col, i, covered).withColumn(b, F.lit(r[0])))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.select(b, s, F.lit(0.0).alias("share"), F.lit(False).alias("accepted"))
    return out.select(b, s, "share", "accepted")


def accept_batch(table: ChunkTable, batch: DataFrame, id_col: str, text_col: str, generation: int, covered: float = 0.8) -> DataFrame:
    """(id, share, accepted) for one batch, judged by the chunk table alone; appends the chunks of what is accepted.

    share: bytes of a text in chunks that the table knows. A text is accepted if
    that is less than ``covered``; of equal texts within the batch the smallest
    id only. Null and wordless texts have share 0 and are not accepted. The
    table is joined by distinct chunks, so a chunk of a third of all records
    costs one row. No text of the history is read.
    """
    docs = batch.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = docs.where("id is not null and text is not null")

    def member(batches):
        for b in batches:
            ids = b.column("id")
            for at, w, _, _, cls in neardup.sets_of(b, "text", 4):
                keep = np.flatnonzero(w.per_doc > 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep + at)), pa.array(cls[keep].view(np.int64))], ["id", "cls"])

    rows = cut(some.mapInArrow(member, f"id {dict(docs.dtypes)['id']}, cls long").distinct())
    fresh = cut(all_chunks(some).dropDuplicates(["chunk", "cls"]))
    if generation > 0:
        known = fresh.join(table.read().select("chunk").distinct(), "chunk", "left_semi").groupBy("cls").agg(F.sum("bytes").alias("known"))
    else:
        known = fresh.limit(0).groupBy("cls").agg(F.sum("bytes").alias("known"))
    share = fresh.groupBy("cls").agg(F.max("total").alias("total")).join(known, "cls", "left").select("cls", (F.coalesce("known", F.lit(0)) / F.col("total")).alias("share"))
    share = cut(share)
    table.append(fresh.join(share.where(F.col("share") < covered).select("cls"), "cls", "left_semi"), generation)
    first = rows.groupBy("cls").agg(F.min("id").alias("first"))
    judged = rows.join(share, "cls").join(first, "cls").select("id", "share", ((F.col("share") < covered) & (F.col("id") == F.col("first"))).alias("accepted"))
    return docs.select("id").distinct().join(judged, "id", "left").select(F.col("id").alias(id_col), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
