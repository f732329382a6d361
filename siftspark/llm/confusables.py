"""Problem 2: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.base import hash128, skeleton


def one_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the columns brought to one form by which equality means looking the same.

    Null stays null; blank becomes the empty text; whole texts are processed, so
    very long ones need no special case. Rows are neither added nor dropped.
    """
    return df.withColumns({c: skeleton(F.col(c)) for c in cols})


def look_alikes(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(doc_a, doc_b, field): different ids, doc_a < doc_b, whose field looks the same but isn't the same string.

    Repeated rows count once; null and blank values match nothing. The texts are
    shuffled as hashes only. A skeleton shared by many equal strings is reduced
    to its distinct strings first, and only skeletons with two or more strings
    are joined; the join's rows are exactly the result (and its mirror image).
    """
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("id", "x.field", "x.value").where("id is not null and value is not null")
    form = long.withColumn("form", skeleton("value")).where(r"form rlike '\\S'")
    k1, k2 = hash128(F.col("field"), F.col("form"))
    rows = form.select("id", "field", k1.alias("k1"), k2.alias("k2"), F.xxhash64("value").alias("v1"), F.xxhash64(F.lit(3), "value").alias("v2")).distinct()
    several = rows.groupBy("k1", "k2").agg(F.min(F.struct("v1", "v2")).alias("lo"), F.max(F.struct("v1", "v2")).alias("hi")).where("lo <> hi").select("k1", "k2")
    rows = rows.join(several, ["k1", "k2"], "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2"))
    other = (F.col("a.v1") != F.col("b.v1")) | (F.col("a.v2") != F.col("b.v2"))
    return a.join(b, same & other & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("doc_a"), F.col("b.id").alias("doc_b"), F.col("a.field")).distinct()
