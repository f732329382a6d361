"""Problem 3: the best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators.graph import connected_components
from siftspark.session import cut

# Words and signs that stand for "no value".
NO_VALUE = ["na", "n/a", "n.a.", "n.a", "n / a", "none", "null", "nil", "nan", "undefined", "unknown", "not available", "not known", "not specified", "not given", "not set", "unspecified", "missing", "no data", "no value", "no title", "untitled", "no headline", "empty", "blank", "default", "tbd", "tba", "tbc", "to be decided", "to be announced", "-none-", "(none)", "(null)", "(blank)", "[none]", "<null>", "pata nahin", "pata nahi", "agyat", "uplabdh nahin", "uplabdh nahi", "अज्ञात", "उपलब्ध नहीं", "अनुपलब्ध", "पता नहीं", "कोई नहीं", "लागू नहीं", "नहीं", "शून्य", "रिक्त", "खाली", "ख़ाली", "मालूम नहीं", "ज्ञात नहीं", "निल", "शीर्षक नहीं", "बिना शीर्षक", "अनिर्दिष्ट", "दर्ज नहीं"]


def is_value(c: Column) -> Column:
    """Not null, not blank, not only signs, not a word for "no value"."""
    s = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return c.isNotNull() & s.rlike(r"[\p{L}\p{N}]") & ~s.isin(NO_VALUE) & ~F.regexp_replace(s, r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "").isin(NO_VALUE)


def instant(c: Column, zone: str = "+05:30") -> Column:
    """Microseconds of an ISO date string; without offset it is in ``zone``; null if it can't be read."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?$")
    full = F.when(s.rlike(r"\d{2}:\d{2}.*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2})$"), s).when(s.rlike(r"[T ]\d{2}:\d{2}"), F.concat(s, F.lit(zone))).otherwise(F.concat(s, F.lit("T00:00:00"), F.lit(zone)))
    return F.when(iso, F.unix_micros(full.try_cast("timestamp")))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", dup_col: str = "dup_of") -> DataFrame:
    """(id, group_id): ids joined directly or over several steps by ``dup_col``, groups of two or more; an id that is not in the table joins nothing."""
    links = df.where(F.col(dup_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("src"), F.col(dup_col).alias("dst")).where("src <> dst").distinct()
    known = df.select(F.col(id_col).alias("dst"))
    comp = connected_components(links.join(known, "dst", "left_semi").select("src", "dst"))
    return comp.select("id", F.col("component").alias("group_id"))


def claims(df: DataFrame, groups: DataFrame, fields: list[str], id_col: str = "doc_id", source_col: str = "source", date_col: str = "date") -> DataFrame:
    """(group_id, field, doc_id, value, source, at): one row per usable value of a grouped record."""
    own = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), instant(F.col(date_col)).alias("at"), *[F.col(f).alias(f"f_{f}") for f in fields])
    rows = own.join(groups, "id").select("group_id", F.col("id").alias("doc_id"), "source", "at", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f_{f}").cast("string").alias("value")) for f in fields])).alias("x"))
    return rows.select("group_id", "x.field", "doc_id", "x.value", "source", "at").where(is_value(F.col("value")))


#: Tier of sources that are null or not listed.
LOWEST = -(1 << 62)


def reliabilities(c: DataFrame, trust: DataFrame | None, ranked: bool) -> DataFrame:
    """(source, tier, w) of the sources in the claims ``c``: the start of ``truth``."""
    sources = c.select(F.coalesce("source", F.lit("")).alias("source")).distinct()
    if trust is None:
        return sources.select("source", F.lit(0).cast("long").alias("tier"), F.lit(0.5).alias("w"))
    x = sources.join(trust.where("source is not null").groupBy("source").agg(F.max("trust").cast("long").alias("trust")), "source", "left")
    if ranked:
        return x.select("source", F.coalesce("trust", F.lit(LOWEST)).alias("tier"), F.lit(0.5).alias("w"))
    top = trust.agg(F.max("trust").alias("top"))
    return x.join(F.broadcast(top)).select("source", F.lit(0).cast("long").alias("tier"), F.coalesce(F.col("trust") / F.col("top"), F.lit(0.1)).cast("double").alias("w"))


def _support(votes: DataFrame, w: DataFrame) -> DataFrame:
    """(group_id, field, value, tier, s): the highest tier of a value's sources, and the sum of their reliabilities in it; in each task first, then by value."""
    part = votes.join(w, "source").groupBy("group_id", "field", "value", "tier").agg(F.sum("w").alias("s"))
    return part.groupBy("group_id", "field", "value").agg(F.max(F.struct("tier", "s")).alias("k")).select("group_id", "field", "value", "k.tier", "k.s")


def truth(c: DataFrame, trust: DataFrame | None = None, rounds: int = 20, tolerance: float = 1e-4, ranked: bool = False) -> DataFrame:
    """(group_id, field, value, tier, support): iterative truth discovery; one row per group and field, the value with the highest support.

    Source reliabilities and weighted value votes are estimated in turn until no
    reliability moves by more than ``tolerance``: a value's support is the sum
    of its sources' reliabilities; a source's reliability is the smoothed mean
    share of support that its values hold in their groups. ``trust`` gives the
    starting reliabilities. With ``ranked`` it gives tiers instead: reliabilities
    are B ** tier * w for a B beyond all bounds, of which only the leading term
    is kept, so one source of a higher tier outweighs any number below it, and w
    is estimated within its tier. Ties go to the smallest value. Votes of one
    source for one value in one group count once; claims without source count as
    one nameless source.
    """
    votes = cut(c.select("group_id", "field", "value", F.coalesce("source", F.lit("")).alias("source")).distinct())
    w = cut(reliabilities(c, trust, ranked))
    for _ in range(rounds):
        support = _support(votes, w)
        total = support.groupBy("group_id", "field", "tier").agg(F.sum("s").alias("all")).groupBy("group_id", "field").agg(F.max(F.struct("tier", "all")).alias("k"))
        share = support.join(total, ["group_id", "field"]).select("group_id", "field", "value", F.when(F.col("tier") == F.col("k.tier"), F.col("s") / F.col("k.all")).otherwise(0.0).alias("share"))
        mean = votes.join(share, ["group_id", "field", "value"]).groupBy("source").agg(((F.sum("share") + 1.0) / (F.count("*") + 2.0)).alias("w2"))
        new = cut(w.join(mean, "source"))
        moved = new.agg(F.max(F.abs(F.col("w") - F.col("w2")))).first()[0]
        w = new.select("source", "tier", F.col("w2").alias("w"))
        if moved is None or moved <= tolerance:
            break
    best = _support(votes, w).groupBy("group_id", "field").agg(F.min(F.struct(-F.col("tier"), -F.round("s", 9), F.col("value"))).alias("k"))
    return best.select("group_id", "field", F.col("k.value").alias("value"), (-F.col("k.col1")).alias("tier"), (-F.col("k.col2")).alias("support"))


def survivors(c: DataFrame, trust: DataFrame, rounds: int = 20) -> DataFrame:
    """(group_id, field, doc_id, value): ``truth`` with the trusts as tiers, and of the claims in the tier that carries it the latest (without a readable date earliest), then the smallest id.

    ``min`` of a struct is aggregated in each task before the shuffle: a group
    with a third of all records is no hot spot.
    """
    found = truth(c, trust, rounds, ranked=True).select("group_id", "field", "tier")
    tier = reliabilities(c, trust, True).select("source", "tier")
    own = c.withColumn("source", F.coalesce("source", F.lit(""))).join(tier, "source").join(found, ["group_id", "field", "tier"], "left_semi")
    best = own.groupBy("group_id", "field").agg(F.min(F.struct(-F.coalesce(F.col("at"), F.lit(LOWEST)), F.col("doc_id"), F.col("value"))).alias("k"))
    return best.select("group_id", "field", F.col("k.doc_id").alias("doc_id"), F.col("k.value").alias("value"))
