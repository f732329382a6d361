"""The pN_ queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.session import ship, table

FIELDS = ["headline", "section", "state", "city"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.wrapper import boilerplate

    pages = boilerplate(table(spark, d, "page_texts"), table(spark, d, "sources"))
    return pages.select("doc_id", F.explode("lines").alias("line_no")).distinct()


def p1_main(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.wrapper import boilerplate

    pages = boilerplate(table(spark, d, "page_texts"), table(spark, d, "sources"))
    return pages.select("doc_id", F.col("headline_main").alias("headline"), F.col("body_main").alias("body")).distinct()


def p1_wrappers(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.wrapper import expressions

    return expressions(table(spark, d, "page_texts"), table(spark, d, "sources"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.confusables import look_alikes

    return look_alikes(table(spark, d, "articles"), "doc_id", ["headline", "body"])


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.confusables import one_form

    return one_form(table(spark, d, "articles").select("doc_id", "headline", "body"), ["headline", "body"]).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm import survivor
    from siftspark.session import cut

    a = table(spark, d, "articles")
    c = cut(survivor.claims(a, survivor.duplicate_groups(a), FIELDS))
    return survivor.survivors(c, table(spark, d, "sources")).select("group_id", "field", "doc_id")


def p3_truth(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm import survivor

    a = table(spark, d, "articles")
    c = survivor.claims(a, survivor.duplicate_groups(a), FIELDS)
    return survivor.truth(c, table(spark, d, "sources"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.site_lines import repeated_lines

    return repeated_lines(table(spark, d, "articles"), min_docs=8)


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm import neardup
    from siftspark.llm.site_lines import without_repeated_lines

    a = table(spark, d, "articles").select("doc_id", "source", "date", "body")
    near = neardup.groups(*neardup.near_pairs(a, "doc_id", "body", k=5, t=0.8)).select("id", F.col("group_id").alias("cluster"))
    return without_repeated_lines(a, min_docs=8, min_clusters=8, min_dates=2, date_col="date", clusters=near).select("doc_id", "body").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.residue import residue

    return residue(table(spark, d, "fetched")).select("doc_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.residue import residue

    f = table(spark, d, "fetched")
    return f.join(residue(f), "doc_id", "left_anti").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm import neardup

    return neardup.all_pairs(*neardup.near_pairs(table(spark, d, "articles"), "doc_id", "body", k=4, t=0.7))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm import neardup

    return neardup.groups(*neardup.near_pairs(table(spark, d, "articles"), "doc_id", "body", k=4, t=0.7))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.history import seen_before

    return seen_before(table(spark, d, "articles"), table(spark, d, "incoming"), "body", ["batch_no", "seq"], k=4, t=0.7)


def p7_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Batches judged one after the other by the chunk table alone, which starts with the articles; what is accepted is appended."""
    from siftspark.llm.history import accept_batches

    return accept_batches(table(spark, d, "articles"), table(spark, d, "incoming"), "doc_id", "body", ["batch_no", "seq"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.bpe import encode_column

    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_bins(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm.packing import fill_all

    return fill_all(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p9_use(spark: SparkSession, d: str) -> DataFrame:
    bins = p9_bins(spark, d).groupBy("container_id", "bin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("cost"))
    c = table(spark, d, "container_sizes").select("container_id", "capacity").distinct()
    use = bins.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("docs").alias("most_docs"), F.max("cost").alias("most_cost"))
    return use.join(c, "container_id").withColumn("used", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm import pii

    docs = table(spark, d, "documents")
    model = pii.train_on(docs, table(spark, d, "names"))
    return pii.find(docs, model).select("doc_id", "line_no", "kind").distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    from siftspark.llm import pii

    docs = table(spark, d, "documents")
    return pii.mask(docs, pii.train_on(docs, table(spark, d, "names")))


def _ready(f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict:
    return {k: _ready(v) for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


P4_SQL = r"""
with a as (select distinct doc_id, source, body from articles where source is not null and body is not null and doc_id is not null),
p as (select doc_id, source, string_split(body, chr(10)) as ls from a),
l as (select doc_id, source, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as n from p),
k as (select doc_id, source, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9०-९]+', '0', 'g'), '^[^\p{L}\p{M}\p{Nd}]+', ''), '[^\p{L}\p{M}\p{Nd}]+$', ''), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}]+', '', 'g') as key from l),
c as (select source, key from k where key <> '' group by source, key having count(distinct doc_id) >= 8)
select distinct k.doc_id as doc_id, cast(k.n as integer) as line_no from k join c on k.source = c.source and k.key = c.key
"""

def _p3_sql() -> str:
    from siftspark.llm.survivor import NO_VALUE

    words = ", ".join("'" + x.replace("'", "''") + "'" for x in NO_VALUE)
    space = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+"
    strip = lambda c: f"regexp_replace({c}, '^{space}|{space}$', '', 'g')"
    date = strip("date")
    zone = r"(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2})"
    return rf"""
with recursive e0 as (select distinct a.doc_id as u, a.dup_of as v from articles a where a.dup_of is not null and a.doc_id <> a.dup_of and a.dup_of in (select doc_id from articles)),
e as (select u, v from e0 union select v, u from e0),
r(s, n) as (select distinct u, u from e union select r.s, e.v from r join e on r.n = e.u),
g as (select s as doc_id, min(n) as group_id from r group by s),
t as (select source, max(trust) as trust from sources group by source),
a as (select distinct g.group_id, x.doc_id, x.source, {date} as date, x.headline, x.section, x.state, x.city from articles x join g on g.doc_id = x.doc_id),
b as (select *, case when regexp_matches(date, '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?\s*{zone}?)?$') then epoch_us(try_cast(case when regexp_matches(date, '\d{{2}}:\d{{2}}.*{zone}$') then date when regexp_matches(date, '[T ]\d{{2}}:\d{{2}}') then date || '+05:30' else date || 'T00:00:00+05:30' end as timestamptz)) end as moment from a),
f as (select group_id, doc_id, source, moment, 'headline' as field, headline as value from b union all select group_id, doc_id, source, moment, 'section', section from b union all select group_id, doc_id, source, moment, 'state', state from b union all select group_id, doc_id, source, moment, 'city', city from b),
n as (select *, {strip('lower(value)')} as low from f where value is not null),
ok as (select * from n where regexp_matches(low, '[\p{{L}}\p{{N}}]') and low not in ({words}) and regexp_replace(low, '^[^\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+$', '', 'g') not in ({words})),
w as (select ok.group_id, ok.field, ok.doc_id, row_number() over (partition by ok.group_id, ok.field order by coalesce(t.trust, -1000000) desc, coalesce(ok.moment, -9000000000000000) desc, ok.doc_id) as rn from ok left join t on ok.source = t.source)
select group_id, field, doc_id from w where rn = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _p3_sql(), "p4_found": P4_SQL}
