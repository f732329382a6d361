"""Problem 9: filling fixed-capacity containers with items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed in one task; larger tables are cut into so many more tasks, each of which leaves at most a bin or two unfilled.
SHARD = 40_000

#: Production limits of a container, as functions of its capacity: documents, and attention cost (the sum of squared lengths) as a share of the squared capacity.
DOCS_PER_TOKEN, COST_SHARE = 1 / 128, 0.9


def pack(sizes: np.ndarray, capacity: int, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """Bin number of each item, all of 1 to ``capacity`` tokens; best fit in falling order of size.

    A bin has residual tokens, documents and attention cost (the sum of squared
    lengths). All open bins with room in all three are weighed, and the one with
    the smallest weighted residual norm after placing is taken; only if there is
    none, a bin is opened. An item that alone exceeds the cost has its own bin.
    Without limits documents and cost follow from the tokens and never bind.
    Ties go to the oldest bin, equal sizes keep the given order.
    """
    max_docs = max_docs or capacity
    max_cost = max_cost or float(capacity) * capacity
    wt, wd, wc = weights
    out = np.empty(len(sizes), dtype=np.int64)
    room, docs, cost, name = np.empty(0), np.empty(0), np.empty(0), np.empty(0, dtype=np.int64)
    used = bins = 0  # bins that are open, and all
    for step, i in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        s = float(sizes[i])
        if used == len(room):
            room, docs, cost, name = (np.concatenate([x[:used], np.empty(max(64, used), dtype=x.dtype)]) for x in (room, docs, cost, name))
        fits = np.flatnonzero((room[:used] >= s) & (cost[:used] <= max_cost - s * s))
        if len(fits):
            norm = wt * ((room[fits] - s) / capacity) ** 2 + wd * (1 - (docs[fits] + 1) / max_docs) ** 2 + wc * (1 - (cost[fits] + s * s) / max_cost) ** 2
            b = fits[np.argmin(norm)]
        else:
            b = used
            room[b], docs[b], cost[b], name[b] = capacity, 0, 0, bins
            used += 1
            bins += 1
        room[b] -= s
        docs[b] += 1
        cost[b] += s * s
        if docs[b] >= max_docs:
            room[b] = 0
        out[i] = name[b]
        if step % 256 == 255:  # full bins leave the list
            keep = np.flatnonzero(room[:used] > 0)
            room, docs, cost, name = room[keep], docs[keep], cost[keep], name[keep]
            used = len(keep)
    return out


def fill(items: DataFrame, capacity: int, container_id: int, id_col: str = "doc_id", **kw) -> DataFrame:
    """(container_id, bin, doc_id, piece, start, tokens) for items (id, tokens).

    An item over the capacity is split into full pieces and a rest; others stay
    whole. Items without tokens (null or empty texts) need no container and give
    no row. ``bin`` is unique within the container's rows. Shards are chosen by
    a hash of the id, so that every shard has the same mix of sizes.
    """
    total = items.count()
    shards = max(1, -(-total // SHARD))
    size = F.col("tokens")
    pieces = F.sequence(F.lit(0), F.ceil(size / capacity).cast("int") - 1)
    rows = items.where(size > 0).select(F.col(id_col).alias("doc_id"), size, F.explode(F.when(size > 0, pieces)).alias("piece"))
    rows = rows.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), size - F.col("piece").cast("long") * capacity).alias("tokens"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    kind = dict(items.dtypes)[id_col]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        b = pack(pdf["tokens"].to_numpy(), capacity, **kw)
        return pd.DataFrame({"container_id": np.int32(container_id), "bin": b * shards + key[0], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "tokens": pdf["tokens"]})

    return rows.groupBy("shard").applyInPandas(run, f"container_id int, bin long, doc_id {kind}, piece int, start long, tokens long")


def fill_all(docs: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_token: float = DOCS_PER_TOKEN, cost_share: float = COST_SHARE, **kw) -> DataFrame:
    """``fill`` for each row of ``containers`` (container_id, tokenizer, capacity), a table of settings.

    A container holds at most ``docs_per_token`` times its capacity in documents (one at least), and
    documents whose squared lengths add up to ``cost_share`` of its squared capacity, or one document.
    """
    from siftspark.llm.bpe import token_counts
    from siftspark.session import cut

    settings = containers.distinct().orderBy("container_id").collect()
    sizes = {t: cut(token_counts(docs, id_col, text_col, t)) for t in sorted({r.tokenizer for r in settings})}
    out = None
    for r in settings:
        one = fill(sizes[r.tokenizer], r.capacity, r.container_id, id_col, max_docs=max(1, int(docs_per_token * r.capacity)), max_cost=cost_share * float(r.capacity) ** 2, **kw)
        out = one if out is None else out.union(one)
    return out
