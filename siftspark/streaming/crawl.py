"""Crawl-side logic on event time: Structured Streaming operators and their batch twins.

The batch twin of an operator (``ewma``, ``polite_schedule``, ``seen_once``) gives,
over all rows, what the stream gives after the last one; late rows beyond the
watermark are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftspark.functions import web as Wb
from siftspark.session import cut

HOST_DELAY, LAMBDA, MIN_POLL, MAX_POLL, BACKOFF_CAP = 8.0, 0.3, 1800.0, 21600.0, 64.0
# Share of each front queue.
QUEUE_SHARES = {"Q0": 0.60, "Q1": 0.25, "Q2": 0.10, "Q3": 0.05}


def seen_once(urls: DataFrame, url_col: str = "url", watermark: str | None = None, ts_col: str = "ts") -> DataFrame:
    """New urls in normal form, without those to skip; works on streams and tables. With a watermark, state is kept for that long only."""
    x = urls.withColumn(url_col, Wb.url_normalize(F.col(url_col))).where((F.col(url_col) != "") & ~Wb.should_skip(F.col(url_col)))
    return x.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([url_col]) if watermark else x.dropDuplicates([url_col])


def frontier_order(requests: DataFrame) -> DataFrame:
    """(.., place): strict order of the front queues (tier, seq)."""
    return requests.withColumn("place", F.row_number().over(W.partitionBy("host").orderBy("tier", "seq")))


def biased_queue(key: Column, seed: int = 0) -> Column:
    """A queue drawn with QUEUE_SHARES by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    out, total = F, 0.0
    col = None
    for name, share in QUEUE_SHARES.items():
        total += share
        col = F.when(u < total, name) if col is None else col.when(u < total, name)
    return col.otherwise("Q3")


def polite_schedule(requests: DataFrame, delay: float = HOST_DELAY, host: str = "host", at: str = "arrive", order: str = "seq", width: float = 3600.0) -> DataFrame:
    """Each request's start: not before its arrival, and ``delay`` after the host's last. Closed form: delay * i + max over j <= i of (arrival_j - delay * j).

    A host's requests are cut into spans of ``width`` seconds of arrival, which
    are summed up and then carried on from one to the next, so that a host of a
    third of all rows is spread over as many tasks as it has spans.
    """
    x = requests.withColumn("__b", F.floor(F.col(at) / width))
    by = W.partitionBy(host, "__b").orderBy(at, order)
    x = x.withColumn("__i", F.row_number().over(by) - 1).withColumn("__m", F.col(at) - delay * F.col("__i"))
    spans = x.groupBy(host, "__b").agg(F.count("*").alias("__n"), F.max("__m").alias("__top"))
    before = W.partitionBy(host).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__in", F.max(F.col("__top") - delay * F.col("__off")).over(before)).drop("__n", "__top")
    x = x.withColumn("__m", F.max("__m").over(by.rowsBetween(W.unboundedPreceding, 0))).join(spans, [host, "__b"])
    start = delay * (F.col("__off") + F.col("__i")) + F.greatest(F.col("__in"), F.col("__m") - delay * F.col("__off"))
    return x.withColumn("start", start).drop("__b", "__i", "__m", "__off", "__in")


def ewma(polls: DataFrame, key: str = "source", at: str = "ts", count: str = "delta_n", lam: float = LAMBDA, width: float = 604_800.0) -> DataFrame:
    """(key, at, rate, interval): change rate per hour, lam * observed + (1 - lam) * before; the first poll gives 1.0. Polls of one moment count in order of their numbers.

    rate = a + b * (rate before) is composed over spans of ``width`` seconds; a
    task holds one span of one key, and the spans' ends are carried on by key.
    """
    kind = dict(polls.dtypes)[at]
    x = polls.select(F.col(key).alias("k"), F.col(at).alias("at"), F.col(count).cast("double").alias("n")).withColumn("b", F.floor(F.col("at") / width).cast("long"))
    spans = x.groupBy("k", "b").agg(F.max("at").alias("last"))
    spans = spans.withColumn("prev", F.lag("last").over(W.partitionBy("k").orderBy("b"))).drop("last")
    spans = spans.select(F.col("k").alias("sk"), F.col("b").alias("sb"), "prev")
    x = x.join(spans, F.col("k").eqNullSafe(F.col("sk")) & (F.col("b") == F.col("sb"))).select("k", "b", "at", "n", "prev")
    order = W.partitionBy("k", "b").orderBy("at", "n")
    gone = (F.col("at") - F.coalesce(F.lag("at").over(order), F.col("prev"))) / 3600.0
    x = x.withColumns({"a": F.when(gone.isNull(), 1.0).otherwise(lam * F.col("n") / F.greatest(gone, F.lit(1e-9))), "keep": F.when(gone.isNull(), 0.0).otherwise(1 - lam)})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "n"], kind="stable")
        rate, rest, rates, rests = 0.0, 1.0, [], []
        for a, keep in zip(pdf["a"].tolist(), pdf["keep"].tolist()):
            rate, rest = a + keep * rate, keep * rest
            rates.append(rate), rests.append(rest)
        return pdf.assign(rate=rates, rest=rests)[["k", "b", "at", "rate", "rest"]]

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        now, into = 0.0, []
        for rate, rest in zip(pdf["rate"].tolist(), pdf["rest"].tolist()):
            into.append(now)
            now = rate + rest * now
        return pdf.assign(into=into)[["k", "b", "into"]]

    kk = dict(x.dtypes)["k"]
    inner = cut(x.groupBy("k", "b").applyInPandas(scan, f"k {kk}, b long, at {kind}, rate double, rest double"))
    # the last row of a span; of equal moments the one in which least of the rate before is left
    ends = inner.groupBy("k", "b").agg(F.max(F.struct(F.col("at"), -F.col("rest"), F.col("rate"))).alias("e")).select("k", "b", F.col("e.rate").alias("rate"), (-F.col("e.col2")).alias("rest"))
    into = ends.groupBy("k").applyInPandas(carry, f"k {kk}, b long, into double").select(F.col("k").alias("sk"), F.col("b").alias("sb"), "into")
    rate = F.col("rate") + F.col("rest") * F.col("into")
    out = inner.join(into, F.col("k").eqNullSafe(F.col("sk")) & (F.col("b") == F.col("sb"))).select(F.col("k").alias(key), F.col("at").alias(at), rate.alias("rate"))
    return out.withColumn("interval", poll_interval(F.col("rate")))


def poll_interval(rate: Column, k: float = 1800.0, floor: float = 0.0833) -> Column:
    """Seconds to the next poll: k over the rate, between MIN_POLL and MAX_POLL."""
    return F.greatest(F.lit(MIN_POLL), F.least(F.lit(MAX_POLL), k / F.greatest(rate, F.lit(floor))))


def burst_scores(events: DataFrame, key: str = "category", ts: str = "ts") -> DataFrame:
    """Events with c1, c6 (counts of the trailing hour and six hours, ends included), score c1 / (c6 / 6 + 1) and tier Q0 above 2, else Q1. Null and "general" keys are left out.

    Counts are differences of running counts at the event, an hour and six hours
    before it. Running counts are made within (key, hour) and carried over the
    hours of a key, so a key of a third of all rows is spread over its hours.
    """
    hour = 3_600_000_000
    cols = events.columns
    x = events.where(F.col(key).isNotNull() & (F.col(key) != "general") & F.col(ts).isNotNull()).withColumn("__s", Wb.micros(F.col(ts)))
    points = F.array(*[F.struct((F.col("__s") - F.lit(back)).alias("at"), F.lit(int(back == 0)).alias("one"), F.lit(name).alias("what")) for back, name in ((0, "n"), (hour, "h1"), (6 * hour, "h6"))])
    x = x.withColumn("__p", F.explode(points)).select(*cols, "__p.*").withColumn("b", F.floor(F.col("at") / hour))
    by = W.partitionBy(key, "b").orderBy("at")
    x = x.withColumns({"upto": F.sum("one").over(by.rangeBetween(W.unboundedPreceding, 0)), "below": F.coalesce(F.sum("one").over(by.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))})
    hours = x.groupBy(key, "b").agg(F.sum("one").alias("c"))
    hours = hours.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy(key).orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    x = x.join(hours, [key, "b"]).withColumn("v", F.col("before") + F.when(F.col("what") == "n", F.col("upto")).otherwise(F.col("below")))
    at = lambda name: F.max(F.when(F.col("what") == name, F.col("v")))
    g = x.groupBy(*cols).agg(F.sum("one").alias("__times"), at("n").alias("__n"), (at("n") - at("h1")).alias("c1"), (at("n") - at("h6")).alias("c6"))
    g = g.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).drop("__times", "__n")  # repeated rows
    score = F.col("c1") / (F.col("c6") / 6 + 1)
    return g.withColumns({"score": score, "tier": F.when(score > 2, "Q0").otherwise("Q1")})


def burst_stream(events: DataFrame, key: str = "category", ts: str = "ts", late: str = "10 minutes", slide: str = "10 minutes") -> DataFrame:
    """Counts by key of the six hours and the last hour before the end of each ``slide``: coarser than ``burst_scores``, which counts at each event. Works on streams (rows later than ``late`` are dropped) and tables."""
    x = events.where(F.col(key).isNotNull() & (F.col(key) != "general")).withWatermark(ts, late)
    w = F.window(ts, "6 hours", slide)
    g = x.groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("c6"), F.sum((F.col(ts) >= F.col("w.end") - F.expr("INTERVAL 1 HOUR")).cast("int")).alias("c1"))
    return g.select(key, F.col("w.end").alias("at"), "c1", "c6", (F.col("c1") / (F.col("c6") / 6 + 1)).alias("score"))


def _ewma_state(lam: float):
    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, last = state.get if state.exists else (None, None)
        rows = []
        for x in pd.concat(list(pdfs)).sort_values("ts").itertuples():
            rate = 1.0 if rate is None else lam * x.delta_n / max((x.ts - last) / 3600.0, 1e-9) + (1 - lam) * rate
            last = x.ts
            rows.append((key[0], last, rate, max(MIN_POLL, min(MAX_POLL, 1800.0 / max(rate, 0.0833)))))
        if rate is not None:
            state.update((rate, last))
        yield pd.DataFrame(rows, columns=["source", "ts", "rate", "interval"])

    return update


def ewma_stream(polls: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """Streaming ``ewma`` over (source string, ts double, delta_n): one small state per source."""
    return polls.select("source", F.col("ts").cast("double").alias("ts"), F.col("delta_n").cast("double").alias("delta_n")).groupBy("source").applyInPandasWithState(_ewma_state(lam), "source string, ts double, rate double, interval double", "rate double, last double", "append", GroupStateTimeout.NoTimeout)


def polite_stream(requests: DataFrame, delay: float = HOST_DELAY) -> DataFrame:
    """Streaming ``polite_schedule`` over (host string, url string, arrive double): the state is the host's last start."""

    def update(key, pdfs, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = []
        for x in pd.concat(list(pdfs)).sort_values(["arrive", "url"]).itertuples():
            last = x.arrive if last is None else max(x.arrive, last + delay)
            rows.append((key[0], x.url, x.arrive, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["host", "url", "arrive", "start"])

    return requests.select("host", "url", F.col("arrive").cast("double").alias("arrive")).groupBy("host").applyInPandasWithState(update, "host string, url string, arrive double, start double", "last double", "append", GroupStateTimeout.NoTimeout)


def host_backoff(responses: DataFrame, first: float = 2.0, cap: float = BACKOFF_CAP, width: int = 4096) -> DataFrame:
    """(host, seq, status, wait, shut): seconds to wait after each response (host, seq, status): doubled by each 429 up to ``cap``, none after a 200; a 403 or captcha shuts the host for good.

    Closed form: the run of 429 since the last 200. A host's responses are cut
    into spans of ``width`` sequence numbers, and runs are carried on from one
    span to the next.
    """
    captcha = F.coalesce(F.col("captcha"), F.lit(False)) if "captcha" in responses.columns else F.lit(False)
    x = responses.select("host", "seq", "status", F.floor(F.col("seq") / width).alias("b"), ((F.col("status") == 403) | captcha).cast("int").alias("bad"), (F.col("status") == 200).cast("int").alias("ok"), (F.col("status") == 429).cast("int").alias("full"))
    by = W.partitionBy("host", "b").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"g": F.sum("ok").over(by), "shut": F.max("bad").over(by)})
    x = x.withColumn("run", F.sum("full").over(W.partitionBy("host", "b", "g").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    ends = x.groupBy("host", "b").agg(F.max("ok").alias("ok"), F.max("bad").alias("bad"), F.max(F.struct("seq", "run")).alias("e")).withColumn("tail", F.col("e.run"))
    order = W.partitionBy("host").orderBy("b")
    ends = ends.withColumn("g", F.sum("ok").over(order)).withColumn("r", F.sum("tail").over(W.partitionBy("host", "g").orderBy("b")))
    ends = ends.select("host", "b", F.coalesce(F.lag("r").over(order), F.lit(0)).alias("into"), F.coalesce(F.max("bad").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("was"))
    x = x.join(ends, ["host", "b"])
    run = F.col("run") + F.when(F.col("g") == 0, F.col("into")).otherwise(0)
    wait = F.when(F.col("status") == 429, F.least(F.lit(cap), first * F.pow(F.lit(2.0), run - 1))).otherwise(0.0)
    return x.select("host", "seq", "status", wait.alias("wait"), (F.greatest("shut", "was") == 1).alias("shut"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def take_first(stream: DataFrame, path: str, limit: int, checkpoint: str, id_col: str = "doc_id"):
    """Starts a sink that writes rows to parquet until ``limit`` are there.

    Every epoch has its own folder, which is overwritten if the epoch is run
    again, and counts what all other epochs hold: a restart neither writes a
    row twice nor goes beyond the limit. A read error ends the stream.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        have = spark.read.option("basePath", path).parquet(path).where(F.col("epoch") != epoch).count() if _exists(spark, path) else 0
        if have < limit:
            batch.orderBy(id_col).limit(limit - have).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def harvest_links(pages: DataFrame, path: str, checkpoint: str, links_col: str = "links"):
    """Starts a sink that writes urls found in pages, in normal form, as new requests of tier Q2; every epoch has its own folder, overwritten if it is run again."""

    def write(batch: DataFrame, epoch: int) -> None:
        new = seen_once(batch.select(F.explode(links_col).alias("url")))
        new.withColumn("tier", F.lit("Q2")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route(events: DataFrame, bursting: DataFrame, key: str = "category") -> DataFrame:
    """Tier of each event: Q0 if its key bursts (key, score above 2), else Q1; stream-static."""
    hot = bursting.where("score > 2").select(key).distinct().withColumn("hot", F.lit(True))
    return events.join(hot, key, "left").withColumn("tier", F.when(F.col("hot"), "Q0").otherwise("Q1")).drop("hot")
