"""Problem 6: near-duplicate records with small edits.

Exact similarity join by multiple global orders. A pair of sets with Jaccard
similarity t or more shares a token among the first n - ceil(t*n) + 1 tokens of
both sets under ANY total order of the tokens. Here two orders are used (both
rare tokens first, by counts over the whole corpus, with different breaking of
ties); a pair is a candidate only if it passes the filter of each, with the
length filter and the positional bound of the first. Candidates are verified on
the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import text
from siftspark.llm.base import long_list, merge_counts, rows_and_counts
from siftspark.operators.graph import connected_components
from siftspark.session import cut

#: Cells of each of the two rows of the corpus-wide count sketch, and of the candidate bitmap: the power of two over 16 (8) for each document (class), between these bounds. At one byte a cell, 16 and 8 MB are the most that is ever broadcast.
CELLS = 1 << 21, 1 << 23
FLAGS = 1 << 20, 1 << 23


def cells_for(n: int, bounds: tuple[int, int]) -> int:
    return min(max(1 << max(0, n - 1).bit_length(), bounds[0]), bounds[1])


def sets_of(batch: pa.RecordBatch, column: str, k: int):
    """(first row, Words, values, offsets, ids) for the texts of a batch, block by block."""
    texts = [text.skeleton(s) or "" for s in batch.column(column).to_pylist()]
    for at, block in text.blocks(texts):
        w = text.Words(block)
        v, o = w.shingles(k)
        yield at, w, v, o, text.set_ids(v, o)


def cells(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each token in a count sketch of two rows of ``size``."""
    return (text.mix(v, 21) % text.U(size)).astype(np.int64), size + (text.mix(v, 22) % text.U(size)).astype(np.int64)


def unseen(cls: np.ndarray, some: np.ndarray, seen: set) -> np.ndarray:
    """Which sets are not empty and new to the task; adds them to ``seen``."""
    new = np.zeros(len(cls), dtype=bool)
    for j, x in enumerate(cls.tolist()):
        if some[j] and x not in seen:
            seen.add(x)
            new[j] = True
    return new


def classes(docs: DataFrame, k: int, more=None, fields: str = "") -> tuple[DataFrame, np.ndarray]:
    """Members (id, cls, n) of ``docs`` (id, text), n being the size of the set, and the count sketch (count-min, two rows) of the tokens of all sets.

    One pass over the texts. Equal texts within a task count once in the sketch.
    ``more(words, offsets, keep)`` gives further columns ``fields``.
    """
    size = cells_for(16 * docs.count(), CELLS)

    def one(batch, seen):
        ids = batch.column("id")
        for at, w, v, o, cls in sets_of(batch, "text", k):
            some = w.per_doc > 0
            new = unseen(cls, some, seen)
            keep = np.flatnonzero(some)
            fresh = v[np.repeat(new, np.diff(o))]
            yield [ids.take(pa.array(keep + at)), pa.array(cls[keep].view(np.int64)), pa.array(np.diff(o)[keep].astype(np.int32)), *(more(w, o, keep, new) if more else [])], np.concatenate(cells(fresh, size))

    return rows_and_counts(docs, one, f"id {dict(docs.dtypes)['id']}, cls long, n int" + fields, 2 * size)


def count_of(sketch: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Code of an upper bound of the number of sets with each token (exact if 1)."""
    a, b = cells(v, len(sketch) // 2)
    return np.minimum(sketch[a], sketch[b])


def order_key(counts: np.ndarray, v: np.ndarray, order: int) -> np.ndarray:
    """Sort key of each token in one of the two global orders; smaller is earlier."""
    if order == 0:
        return (counts.astype(text.U) << text.U(48)) | (text.mix(v, 31) >> text.U(16))
    level = np.where(counts < 128, np.log2(counts.astype(np.float64) + 1), 7 + (counts.astype(np.float64) - 128) / 5).astype(text.U)
    return (level << text.U(56)) | (text.mix(v, 32) >> text.U(8))


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    """Tokens of a set of n that must hold a common one."""
    return (n - np.ceil(t * n - 1e-9) + 1).astype(np.int64)


def positions(doc: np.ndarray, key: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Rank of each token within its set under the key."""
    order = text.sort_within(doc, key)
    rank = np.empty(len(doc), dtype=np.int64)
    rank[order] = np.arange(len(doc)) - o[:-1][doc[order]]
    return rank


def prefixes(v: np.ndarray, o: np.ndarray, sketch: np.ndarray, t: float):
    """(token index, set, rank in order 0, rank in order 1, sizes) of the tokens that are in a prefix and can have a partner; rank -1: not in that prefix."""
    n = np.diff(o)
    doc = np.repeat(np.arange(len(n)), n)
    counts = count_of(sketch, v)
    limit = prefix_length(n, t)[doc]
    p0 = positions(doc, order_key(counts, v, 0), o)
    p1 = positions(doc, order_key(counts, v, 1), o)
    in0, in1 = p0 < limit, p1 < limit
    i = np.flatnonzero((in0 | in1) & (counts > 1))
    return i, doc[i], np.where(in0[i], p0[i], -1), np.where(in1[i], p1[i], -1), n


def hash_flags(rows: DataFrame, column: str):
    """Broadcast bitmap of bounded size of the hashes in ``column``; false hits cost time but change nothing."""
    size = cells_for(8 * rows.count(), FLAGS)
    return rows.sparkSession.sparkContext.broadcast(merge_counts(rows.select(column), lambda b: flag_cells(b.column(column).to_numpy(), size), size) > 0)


def flag_cells(tok: np.ndarray, size: int) -> np.ndarray:
    return (text.mix(tok.view(text.U), 51) % text.U(size)).astype(np.int64)


def prefix_rows(docs: DataFrame, k: int, t: float, sketch, flags=None, only=None, but=None) -> DataFrame:
    """(tok, cls, n, p, q) of each distinct text of ``docs`` (text): the shingles in the prefix of its set under either global order, and their ranks.

    With bitmaps of ``hash_flags``: only the tokens in ``flags``, only the
    classes in ``only``, only the classes that are not in ``but``.
    """
    hit = lambda bitmap, x: bitmap.value[flag_cells(x, len(bitmap.value))]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, w, v, o, cls in sets_of(batch, "text", k):
                some = w.per_doc > 0
                if only is not None:
                    some &= hit(only, cls)
                if but is not None:
                    some &= ~hit(but, cls)
                new = unseen(cls, some, seen)
                n = np.diff(o)
                v, cls, o = v[np.repeat(new, n)], cls[new], np.r_[0, np.cumsum(n[new])]
                i, d, p, q, n = prefixes(v, o, sketch.value, t)
                if flags is not None:
                    ok = hit(flags, v[i])
                    i, d, p, q = i[ok], d[ok], p[ok], q[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[i].view(np.int64)), pa.array(cls[d].view(np.int64)), pa.array(n[d].astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32))],
                    ["tok", "cls", "n", "p", "q"],
                )

    return docs.select("text").mapInArrow(run, "tok long, cls long, n int, p int, q int")


def near_pairs(df: DataFrame, id_col: str, column: str, k: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of near-duplicate classes.

    members: (id, cls), each id with a text of at least one word, cls being one
    id per distinct shingle set. links: (a, b) with a < b, pairs of different
    classes of similarity t or more. Null, blank and wordless texts have no
    class. Exact copies are collapsed into their class before any join, so a
    group of copies of any size costs its rows only.
    """
    docs = df.where(F.col(column).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(column).alias("text"))
    members, counts = classes(docs, k)
    members = members.select("id", "cls")
    sketch = df.sparkSession.sparkContext.broadcast(counts)

    posts = prefix_rows(docs, k, t, sketch)
    members = members.distinct()
    return members, verified(docs, members, candidates(posts, t), k, t)


def candidates(posts: DataFrame, t: float, depth: int = 4, fresh: str | None = None) -> DataFrame:
    """(a, b), a < b: classes that pass the prefix filter of both orders; with ``fresh``, a column of truth values, only pairs of which a is fresh, and a < b if both are.

    Two sets with ``need`` common tokens have e + 1 of them among the first
    n - need + 1 + e tokens of each, for any e for which that is within the
    prefixes. e is at most ``depth``: hits beyond that rank are dropped at once,
    and fewer hits than e + 1 drop the pair.
    """
    # one shuffle, by the token alone; a class may come from several tasks, and is fresh if it is so in one
    posts = posts.repartition("tok")
    if fresh:
        posts = posts.groupBy("tok", "cls").agg(*[F.first(c).alias(c) for c in ("n", "p", "q")], F.max(fresh).alias(fresh))
    else:
        posts = posts.dropDuplicates(["tok", "cls"])
    a, b = (posts.where(fresh) if fresh else posts).alias("a"), posts.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    need = F.ceil(t / (1 + t) * (na + nb) - F.lit(1e-9))
    length = lambda n: n - F.ceil(t * n - F.lit(1e-9)) + 1
    extra = F.greatest(F.lit(0), F.least(F.lit(depth), length(na) - 1 - (na - need), length(nb) - 1 - (nb - need)))
    sized = (na >= t * nb - F.lit(1e-9)) & (nb >= t * na - F.lit(1e-9))
    hit = lambda c: (F.col(f"a.{c}") >= 0) & (F.col(f"b.{c}") >= 0) & (F.col(f"a.{c}") <= na - need + extra) & (F.col(f"b.{c}") <= nb - need + extra)
    once = F.col("a.cls") < F.col("b.cls")
    if fresh:
        once |= ~F.col(f"b.{fresh}") & (F.col("a.cls") != F.col("b.cls"))
    pairs = a.join(b, (F.col("a.tok") == F.col("b.tok")) & once & sized & (hit("p") | hit("q")))
    rows = pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), extra.cast("int").alias("extra"), hit("p").cast("int").alias("x"), hit("q").cast("int").alias("y"))
    return rows.groupBy("a", "b", "extra").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x > extra and y > extra").select("a", "b")


def verified(docs: DataFrame, members: DataFrame, cand: DataFrame, k: int, t: float) -> DataFrame:
    """Candidate pairs whose sets have similarity t or more.

    Only texts of one member of each candidate class are made into sets again;
    they are known by a bitmap of bounded size over hashes of their ids, whose
    false hits cost time but change nothing.
    """
    cand = cut(cand)
    each = cand.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    size = cells_for(8 * each.count(), FLAGS)
    one = members.join(each, "cls").groupBy("cls").agg(F.min("id").alias("id")).select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("i"))
    flags = docs.sparkSession.sparkContext.broadcast(merge_counts(one, lambda b: b.column("i").to_numpy(), size))

    def tokens(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = np.flatnonzero(flags.value[batch.column("i").to_numpy()] > 0)
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            for _, w, v, o, cls in sets_of(batch, "text", k):
                new = np.flatnonzero(unseen(cls, w.per_doc > 0, seen))
                yield pa.RecordBatch.from_arrays([pa.array(cls[new].view(np.int64)), long_list(v, o).take(pa.array(new))], ["cls", "toks"])

    marked = docs.select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("i"), "text")
    sets = marked.mapInArrow(tokens, "cls long, toks array<long>")
    both = cand.join(sets.select(F.col("cls").alias("a"), F.col("toks").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("toks").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(common >= F.lit(t) * (F.size("ta") + F.size("tb") - common) - F.lit(1e-9)).select("a", "b").distinct()


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair of ids of one class or of linked classes."""
    m = members
    x = links.join(m.select(F.col("cls").alias("a"), F.col("id").alias("ia")), "a").join(m.select(F.col("cls").alias("b"), F.col("id").alias("ib")), "b")
    across = x.where("ia <> ib").select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b"))
    several = m.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").select("cls")
    m2 = m.join(several, "cls", "left_semi")
    within = m2.alias("x").join(m2.alias("y"), (F.col("x.cls") == F.col("y.cls")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("doc_a"), F.col("y.id").alias("doc_b"))
    return across.union(within).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id, cls, n_links): one row per id; the group is named by its smallest id, n_links counts linked classes."""
    links = cut(links)
    comp = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    m = members.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = m.groupBy("component").agg(F.min("id").alias("group_id"))
    return m.join(named, "component").join(degree, "cls", "left").select("id", "group_id", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))
