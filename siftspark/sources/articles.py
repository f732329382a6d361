"""Readers and writers of articles, runs, judgments, queries, names and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
ARTICLE = T.StructType(
    [T.StructField(n, _S) for n in ("doc_id", "url", "source", "section", "state", "city", "date", "headline", "body")]
    + [T.StructField("keywords", T.ArrayType(_S)), T.StructField("agency_flag", T.BooleanType()), T.StructField("content_hash", _S), T.StructField("dup_of", _S), T.StructField("links", T.ArrayType(_S))]
)
REQUIRED = ("doc_id", "headline", "body")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of text files, numbered from 1 in each file.

    A file is read whole by one task (its lines need their order); many files
    are read by many tasks.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("pos", "value"))
    return lines.select("file", (F.col("pos") + 1).alias("line_no"), "value")


def read_articles(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Articles of JSON lines with file, line_no, error.

    Blank lines are skipped. A line that is no JSON object, or lacks a required
    field as a string, has an error that names its line; in strict mode reading
    such a line fails, otherwise the row stays for quarantine.
    """
    rows = numbered_lines(spark, path).where("trim(value) <> ''")
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    field = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    error = F.when(v.isNull(), "not valid JSON").when(~kind.startswith("OBJECT"), "not an object")
    for n in REQUIRED:
        error = error.when(F.coalesce(field(n), F.lit("")) != "STRING", f"field {n} is missing or no string")
    error = F.when(error.isNotNull(), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), error))
    rows = rows.withColumn("error", F.when(error.isNotNull(), F.raise_error(error).cast("string")) if strict else error)
    parsed = rows.withColumn("a", F.from_json("value", ARTICLE))
    return parsed.select("a.*", "file", "line_no", "error")


def write_articles(docs: DataFrame, path: str) -> None:
    """JSON lines, one object per article."""
    docs.select(*[c for c in ARTICLE.fieldNames() if c in docs.columns]).write.mode("overwrite").json(path)


def check_article(docs: DataFrame) -> DataFrame:
    """Rows with ``reasons``: what breaks the article contract; an empty array if nothing does."""
    need = [F.when(F.col(c).isNull(), f"{c} is null") for c in ("doc_id", "url", "source", "headline", "body", "date")]
    more = [
        F.when(~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+05:30$"), "date is not in the form of IST"),
        F.when(~F.col("content_hash").rlike("^[0-9a-f]{32}$"), "content_hash is no MD5"),
        F.when(F.col("keywords").isNull(), "keywords is null"),
        F.when(F.col("links").isNull(), "links is null"),
        F.when(F.trim("body") == "", "body is empty"),
    ]
    more += [F.lit(f"field {c} is not allowed") for c in docs.columns if c.lower() in ("author", "authors", "byline", "reporter")]
    return docs.withColumn("reasons", F.filter(F.array(*need, *more), lambda x: x.isNotNull()))


def format_run(run: DataFrame, name: str) -> DataFrame:
    """(value): lines "qid Q0 doc rank score name" of a run (qid, doc_id, rank, score)."""
    return run.select(F.format_string("%s Q0 %s %d %.6f %s", F.col("qid").cast("string"), F.col("doc_id").cast("string"), F.col("rank").cast("int"), F.col("score").cast("double"), F.lit(name)).alias("value"))


def write_run(run: DataFrame, path: str, name: str) -> None:
    format_run(run.orderBy("qid", "rank"), name).write.mode("overwrite").text(path)


def parse_run(lines: DataFrame) -> DataFrame:
    """(qid, doc_id, rank, score, run) of run lines; others are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(p) == 6).select(p[0].alias("qid"), p[2].alias("doc_id"), p[3].try_cast("int").alias("rank"), p[4].try_cast("double").alias("score"), p[5].alias("run")).where("rank is not null")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return parse_run(spark.read.text(path))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(need, doc_id, grade) of lines "need 0 doc grade"; the last line of a file about a document wins."""
    p = F.split(F.trim("value"), r"\s+")
    x = numbered_lines(spark, path).where(F.size(p) == 4).select("file", "line_no", p[0].alias("need"), p[2].alias("doc_id"), p[3].try_cast("int").alias("grade"))
    return x.withColumn("i", F.row_number().over(W.partitionBy("file", "need", "doc_id").orderBy(F.desc("line_no")))).where("i = 1").select("need", "doc_id", "grade")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, need_id, form, query) of tab-separated lines, or of such lines between ```tsv fences in markdown; a header line is skipped."""
    x = numbered_lines(spark, path)
    by = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("value").rlike("^\\s*```")
    opens = F.sum(F.col("value").rlike("^\\s*```tsv").cast("int")).over(by)
    closes = F.sum((fence & ~F.col("value").rlike("^\\s*```tsv")).cast("int")).over(by)
    any_fence = F.max(fence).over(W.partitionBy("file"))
    p = F.split("value", "\t")
    inside = x.withColumns({"open": (opens > closes) | ~any_fence, "fence": fence}).where("open and not fence").where(F.size(p) == 4)
    return inside.select(F.trim(p[0]).alias("qid"), F.trim(p[1]).alias("need_id"), F.trim(p[2]).alias("form"), F.trim(p[3]).alias("query")).where("qid <> 'qid'")


def read_pairs(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated lines as the named string columns; '#' lines are comments."""
    return spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(", ".join(f"{n} string" for n in names)).csv(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, variants): a name and its spellings, separated by commas."""
    return read_pairs(spark, path, ["canonical", "v"]).select("canonical", F.filter(F.transform(F.split("v", ","), F.trim), lambda x: x != "").alias("variants"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, n_words, term, weight) of lines "english <tab> hi[:w]|hi[:w]"; weights of a phrase add up to 1, missing ones count 1 before."""
    d = read_pairs(spark, path, ["english", "options"]).where("english is not null and options is not null")
    o = d.select(F.lower(F.trim("english")).alias("phrase"), F.explode(F.split("options", r"\|")).alias("o"))
    x = o.select("phrase", F.trim(F.substring_index("o", ":", 1)).alias("term"), F.coalesce(F.when(F.contains("o", F.lit(":")), F.substring_index("o", ":", -1)).otherwise(F.lit("1")).try_cast("double"), F.lit(1.0)).alias("w")).where("term <> ''")
    total = F.sum("w").over(W.partitionBy("phrase"))
    return x.select("phrase", F.size(F.split("phrase", r"\s+")).alias("n_words"), "term", (F.col("w") / total).alias("weight"))


def crawl_report(docs: DataFrame, columns: list[str], limit: int | None = 15) -> DataFrame:
    """(column, value, n, share): counts and shares of each value of each column in one pass of grouping sets; null counts as a value."""
    x = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in columns]).groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"))
    name = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    x = x.select(name.alias("column"), F.coalesce(*[F.col(c) for c in columns]).alias("value"), "n")
    by = W.partitionBy("column")
    x = x.withColumns({"share": F.col("n") / F.sum("n").over(by), "i": F.row_number().over(by.orderBy(F.desc("n"), "value"))})
    return (x.where(F.col("i") <= limit) if limit else x).drop("i")
