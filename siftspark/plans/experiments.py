"""Registered queries that compare systems and explain results, and functions on rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.functions import web as Wb
from siftspark.operators import evaluate, index, match, rank, rewrite
from siftspark.plans.catalogue import _BM, _FEEDBACK, _RANKED, QUERIES, WITH, idx, q_exact, qs, r6, register, with_sql
from siftspark.sources import articles, web

FORMS = {"q1": "hindi", "q2": "english", "q3": "hindi", "q4": "hinglish", "q5": "english", "q6": "hindi", "q7": "english"}
NEEDS = {"q1": "n1", "q2": "n2", "q3": "n2", "q4": "n3", "q5": "n4", "q6": "n5", "q7": "n5"}
MODES = ("none", "light", "aggr")
_FORM_SQL = "(values " + ", ".join(f"('{k}', '{v}', '{NEEDS[k]}')" for k, v in FORMS.items()) + ") fm(qid, form, need)"
# judgments that no index mode favours: how many of a query's words a text holds as they are typed
_GRADES = f"gr as (select qid, doc_id, case when m = n then 2 else 1 end as grade from (select qid, doc_id, len(list_filter(string_split(lower(query), ' '), lambda w: contains(lower(coalesce(text, '')), w))) as m, len(string_split(query, ' ')) as n from qt, documents) where m * 2 >= n), rel as (select qid, count(*) as relevant from gr group by qid)"


def forms(spark) -> DataFrame:
    return spark.createDataFrame([(k, v, NEEDS[k]) for k, v in FORMS.items()], "qid string, form string, need string")


def grades(spark, d) -> DataFrame:
    """(qid, doc_id, grade): 2 for texts with all words of a query, 1 for half of them; the queries are a handful and sent to the texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    q = qs(spark).select("qid", F.split(F.lower("query"), " ").alias("ws")).groupBy().agg(F.collect_list(F.struct("qid", "ws")).alias("qs"))
    hit = F.filter(F.transform("qs", lambda x: F.struct(x["qid"].alias("qid"), F.size(F.filter(x["ws"], lambda w: F.contains(F.col("t"), w))).alias("m"), F.size(x["ws"]).alias("n"))), lambda y: y["m"] * 2 >= y["n"])
    x = docs.join(F.broadcast(q)).select("doc_id", F.explode(hit).alias("h"))
    return x.select("h.qid", "doc_id", F.when(F.col("h.m") == F.col("h.n"), 2).otherwise(1).alias("grade"))


def run_of(scored: DataFrame, k: int = 30) -> DataFrame:
    return match.top(scored, k).select("qid", "doc_id", "rank")


def grid(spark, d) -> dict[tuple[str, str], DataFrame]:
    """Metrics of each query by (mode, ranker)."""
    rel = grades(spark, d)
    out = {}
    for m in MODES:
        q = rank.exact_query(qs(spark), m)
        i = index.restrict(idx(spark, d, m, keep=True), q)
        for name, scored in (("lnc", rank.cosine(q, i)), ("bm25", rank.bm25(q, i))):
            out[m, name] = evaluate.per_query(run_of(scored), rel)
    return out


def _run_sql(score: str) -> str:
    """Metrics pq (qid, p, r, ap, ndcg) of the 30 best by a score table."""
    return (
        f", run as (select qid, doc_id, rank from ({_RANKED.format(score)}) where rank <= 30), {_GRADES}, "
        "j as (select run.qid, rank, coalesce(grade, 0) as grade, (grade is not null)::int as isrel, sum((grade is not null)::int) over (partition by run.qid order by rank) as hits from run left join gr on gr.qid = run.qid and gr.doc_id = run.doc_id), "
        "best as (select qid, grade, row_number() over (partition by qid order by grade desc, doc_id) as i from gr qualify i <= 10), ideal as (select qid, sum(grade / log2(i + 1)) as ideal from best group by qid), "
        "pq as (select rel.qid, coalesce(sum(case when rank <= 10 then isrel else 0 end), 0) / 10 as p, coalesce(sum(case when rank <= 10 then isrel else 0 end), 0) / any_value(relevant) as r, coalesce(sum(case when isrel = 1 then hits / rank else 0 end), 0) / any_value(relevant) as ap, coalesce(sum(case when rank <= 10 then grade / log2(rank + 1) else 0 end), 0) / any_value(ideal) as ndcg from rel join ideal on ideal.qid = rel.qid left join j on j.qid = rel.qid group by rel.qid)"
    )


def _grid_sql() -> str:
    return " union all ".join(f"select '{m}' as mode, '{r}' as ranker, * from ({with_sql(QUERIES, m)}{_run_sql(s)} select * from pq)" for m in MODES for r, s in (("lnc", "lnc"), ("bm25", "bm")))


_MEANS = "round(avg(p), 6) as p, round(avg(r), 6) as r, round(avg(ap), 6) as map, round(avg(ndcg), 6) as ndcg, count(*) as queries"


def _means(x: DataFrame, *by: str) -> DataFrame:
    return r6(evaluate.means(x, *by).drop("f1"), "p", "r", "map", "ndcg")


@register("experiment_grid", f"with g as ({_grid_sql()}), f as (select g.*, form from g join {_FORM_SQL} on fm.qid = g.qid) select mode, ranker, coalesce(form, 'all') as form, {_MEANS} from f group by grouping sets ((mode, ranker, form), (mode, ranker))")
def experiment_grid(spark, d):
    """Every stemming mode with every ranker, over all queries and by form of query."""
    out = None
    for (m, r), x in grid(spark, d).items():
        row = _means(x.join(forms(spark), "qid"), "form").select(F.lit(m).alias("mode"), F.lit(r).alias("ranker"), F.coalesce("form", F.lit("all")).alias("form"), "p", "r", "map", "ndcg", "queries")
        out = row if out is None else out.unionByName(row)
    return out


@register("stemming_wins", f"with g as ({_grid_sql()}), b as (select * from g where ranker = 'bm25') select x.mode, count(*) filter (where x.ap - y.ap > 1e-9) as wins, count(*) filter (where x.ap - y.ap < -1e-9) as losses, count(*) filter (where abs(x.ap - y.ap) <= 1e-9) as ties from b x join b y on y.mode = 'none' and x.mode <> 'none' and x.qid = y.qid group by x.mode")
def stemming_wins(spark, d):
    """Queries on which a stemming mode is better or worse than none, by BM25."""
    g = grid(spark, d)
    out = None
    for m in MODES[1:]:
        pairs = g[m, "bm25"].select("qid", F.col("ap").alias("a")).join(g["none", "bm25"].select("qid", F.col("ap").alias("b")), "qid")
        row = evaluate.wins(pairs).select(F.lit(m).alias("mode"), "wins", "losses", "ties")
        out = row if out is None else out.unionByName(row)
    return out


@register("significance", f"with g as ({_grid_sql()}), s as (select *, mode || ' ' || ranker as system from g), p as (select x.system, y.system as baseline, x.ap as a, y.ap as b from s x join s y on x.qid = y.qid and ((x.system = 'none bm25' and y.system = 'none lnc') or (x.ranker = 'bm25' and x.mode <> 'none' and y.system = 'none bm25'))) select system, baseline, count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(case when avg(a - b) = 0 then 0 else avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) end, 6) as t from p group by system, baseline")
def significance(spark, d):
    """Paired t of BM25 against the cosine, and of each stemming mode against none."""
    g = grid(spark, d)
    out = None
    for a, b in [(("none", "bm25"), ("none", "lnc"))] + [((m, "bm25"), ("none", "bm25")) for m in MODES[1:]]:
        pairs = g[a].select("qid", F.col("ap").alias("a")).join(g[b].select("qid", F.col("ap").alias("b")), "qid")
        means = pairs.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
        row = evaluate.paired_t(pairs).join(means).select(F.lit(" ".join(a)).alias("system"), F.lit(" ".join(b)).alias("baseline"), "n", "mean_a", "mean_b", "t")
        out = row if out is None else out.unionByName(row)
    return r6(out, "mean_a", "mean_b", "t")


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_NO_IDF = ", u0 as (select qid, qtf.term, 1 + log10(qtf) as w from qtf join terms on qtf.term = terms.term), u as (select qid, term, w / sqrt(sum(w * w) over (partition by qid)) as w from u0), l2 as (select qid, tf.doc_id, sum(w * (1 + log10(tf))) / any_value(norm) as score from u join tf on u.term = tf.term join stats on stats.doc_id = tf.doc_id group by qid, tf.doc_id)"
_NO_STOP = f", s0 as (select qid, qtf.term, (1 + log10(qtf)) * idf as w from qtf join terms on qtf.term = terms.term where qtf.term not in ({_STOP})), s1 as (select qid, term, w / sqrt(sum(w * w) over (partition by qid)) as w from s0), l3 as (select qid, tf.doc_id, sum(w * (1 + log10(tf))) / any_value(norm) as score from s1 join tf on s1.term = tf.term join stats on stats.doc_id = tf.doc_id group by qid, tf.doc_id)"


@register("idf_ablation", " union all ".join(f"select '{name}' as setup, {_MEANS} from ({WITH}{part}{_run_sql(score)} select * from pq)" for name, part, score in (("idf", "", "lnc"), ("no idf", _NO_IDF, "l2"), ("stop words removed", _NO_STOP, "l3"))))
def idf_ablation(spark, d):
    """What idf and stop words do to the cosine."""
    q = q_exact(spark)
    i = index.restrict(idx(spark, d, keep=True), q)
    rel = grades(spark, d)
    runs = {"idf": rank.cosine(q, i), "no idf": rank.cosine(q, i, idf=False), "stop words removed": rank.cosine(q.where(~X.is_stopword(F.col("term"))), i)}
    out = None
    for name, scored in runs.items():
        row = _means(evaluate.per_query(run_of(scored), rel)).withColumn("setup", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


DICTIONARY = [("canal", "नहर", 1.0), ("cleaning", "सफ़ाई", 1.0), ("bus", "बस", 1.0), ("stand", "अड्डा", 1.0), ("flood", "बाढ़", 1.0), ("relief", "राहत", 1.0), ("camp", "शिविर", 1.0)]
_DICT_SQL = "(values " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in DICTIONARY) + ") dc(phrase, tr, weight)"
_TRANSLATED = f", tq as (select qid, term, sum(qtf) as qtf from (select qid, term, 1.0 as qtf from q union all select qid, nfc_normalize(tr), 0.9 * weight from q join {_DICT_SQL} on dc.phrase = q.term) group by qid, term), bt as ({_BM.format('tq')})"


@register("rewriting_effects", " union all ".join(f"select '{name}' as setup, {_MEANS} from ({WITH}{part}{_run_sql(score)} select pq.* from pq join {_FORM_SQL} on fm.qid = pq.qid where form = 'english')" for name, part, score in (("as typed", "", "bm"), ("feedback", _FEEDBACK, "fb"), ("translation", _TRANSLATED, "bt"))))
def rewriting_effects(spark, d):
    """English queries as typed, with pseudo-relevance feedback, and with dictionary translation."""
    i, q = idx(spark, d, keep=True), q_exact(spark)
    rel = grades(spark, d).join(forms(spark).where("form = 'english'").select("qid"), "qid", "left_semi")
    dic = spark.createDataFrame(DICTIONARY, "phrase string, term string, weight double").withColumn("term", X.normalize(F.col("term")))
    langs = q.select(F.col("term").alias("word")).distinct().withColumn("en", F.when(X.script(F.col("word")) == "roman", 0.9).otherwise(0.0))
    runs = {"as typed": rank.bm25(q, i), "feedback": rank.bm25(rank.feedback(q, i, rank.bm25(q, i)), i), "translation": rank.bm25(rewrite.translate(q, dic, langs), i)}
    out = None
    for name, scored in runs.items():
        row = _means(evaluate.per_query(run_of(scored), rel)).withColumn("setup", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@register("cross_form_agreement", WITH + f", t as (select r.qid, doc_id, form, need from ({_RANKED.format('bm')}) r join {_FORM_SQL} on fm.qid = r.qid where rank <= 10), p as (select a.form, a.qid, count(b.doc_id) / 10 as o from (select distinct qid, form, need from t) a join (select distinct qid, need from t where form = 'hindi') h on h.need = a.need and a.form <> 'hindi' left join (select x.qid, y.qid as ref, x.doc_id from t x join t y on x.doc_id = y.doc_id) b on b.qid = a.qid and b.ref = h.qid group by a.form, a.qid, h.qid) select form, round(avg(o), 6) as overlap, count(*) as queries from p group by form")
def cross_form_agreement(spark, d):
    """Mean overlap of the ten best with those of the Hindi query of the same need, by form."""
    q = q_exact(spark)
    top = match.top(rank.bm25(q, idx(spark, d, keep=True)), 10)
    return r6(evaluate.cross_form(top, forms(spark)), "overlap")


# ------------------------------------------------------------------ explanations


@register("explain_bm25", WITH + f", r as (select * from ({_RANKED.format('bm')}) where rank <= 5) select r.qid, rank, r.doc_id, tf.term, tf, df, round(ln(1 + ((select n from nn) - df + 0.5) / (df + 0.5)), 6) as idf, round(qtf * ln(1 + ((select n from nn) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select a from avgdl))), 6) as part from r join qtf on qtf.qid = r.qid join tf on tf.doc_id = r.doc_id and tf.term = qtf.term join terms on terms.term = tf.term join stats on stats.doc_id = r.doc_id")
def explain_bm25(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    return r6(rank.explain_bm25(q, i, match.top(rank.bm25(q, i), 5)), "idf", "part").withColumn("rank", F.col("rank").cast("long"))


@register("explain_cosine", WITH + f", r as (select * from ({_RANKED.format('lnc')}) where rank <= 5) select r.qid, rank, r.doc_id, tf.term, tf, round(qv.w, 6) as weight, round(qv.w * (1 + log10(tf)) / norm, 6) as part from r join qv on qv.qid = r.qid join tf on tf.doc_id = r.doc_id and tf.term = qv.term join stats on stats.doc_id = r.doc_id")
def explain_cosine(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    return r6(rank.explain_cosine(q, i, match.top(rank.cosine(q, i), 5)), "weight", "part").withColumn("rank", F.col("rank").cast("long"))


@register("explain_query", WITH + " select qtf.qid, qtf.term, qtf, coalesce(df, 0) as df, round(idf, 6) as idf, round(qv.w, 6) as weight from qtf left join terms on terms.term = qtf.term left join qv on qv.qid = qtf.qid and qv.term = qtf.term")
def explain_query(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    return r6(rank.explain_query(q, i), "idf", "weight")


@register("explain_stages", WITH + ", n as (select qid, count(distinct idx) as n from q group by qid), ph as (select distinct q.qid, tok.doc_id from q join tok on q.term = tok.term join n on n.qid = q.qid where n.n >= 2 group by q.qid, tok.doc_id, zone, pos - idx, n.n having count(distinct idx) = n.n), al as (select q.qid, tf.doc_id from q join tf on q.term = tf.term join n on n.qid = q.qid group by q.qid, tf.doc_id, n.n having count(distinct idx) = n.n), an as (select distinct q.qid, tf.doc_id from q join tf on q.term = tf.term), st as (select qid, 'phrase' as stage, 0 as i, doc_id from ph union all select qid, 'all_exact', 2, doc_id from al union all select qid, 'any', 4, doc_id from an), fi as (select qid, doc_id, min(i) as i from st group by qid, doc_id), c as (select qid, stage, i, count(*) as docs from st group by all), f as (select qid, i, count(*) as fresh from fi group by qid, i) select c.qid, stage, docs, coalesce(fresh, 0) as fresh, sum(coalesce(fresh, 0)) over (partition by c.qid order by c.i)::bigint as so_far from c left join f on f.qid = c.qid and f.i = c.i")
def explain_stages(spark, d):
    """Documents of each stage of the parser, how many are new, and how many there are so far."""
    q = q_exact(spark)
    post = index.restrict(idx(spark, d, keep=True), q).post
    w = q.select("qid", "idx", "term")
    several = w.groupBy("qid").agg(F.countDistinct("idx").alias("n")).where("n >= 2").select("qid")
    return rank.explain_stages({"phrase": match.phrase_search(post, w.join(several, "qid")), "all_exact": match.and_search(post, w), "any": match.hits(post, w).select("qid", "doc_id").distinct()})


@register("search_headlines", with_sql(QUERIES, "light") + ", n as (select qid, count(distinct idx) as n from q group by qid) select q.qid, tok.doc_id from q join tok on q.term = tok.term and zone = 'headline' join n on n.qid = q.qid group by q.qid, tok.doc_id, n.n having count(distinct idx) = n.n")
def search_headlines(spark, d):
    """Checked search of one zone with the light stemmer."""
    return match.search_query(idx(spark, d, "light", keep=True), qs(spark), "light", "headline")


# ------------------------------------------------------------------ functions on rows of their own


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


ROBOTS = [("a.example", "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: otherbot\nDisallow: /", 200), ("b.example", "User-agent: siftbot\nDisallow:\n\nUser-agent: *\nDisallow: /", 200), ("c.example", "", 403), ("d.example", "", 404), ("e.example", "User-agent: *\nDisallow: /*.pdf$\nDisallow: /x*y", 200)]
_FETCH = [("a.example", "https://a.example/news", True), ("a.example", "https://a.example/private/x", False), ("a.example", "https://a.example/private/open/1", True), ("b.example", "https://b.example/any", True), ("c.example", "https://c.example/", False), ("d.example", "https://d.example/x", True), ("e.example", "https://e.example/f.pdf", False), ("e.example", "https://e.example/f.pdf?a", True), ("e.example", "https://e.example/xaby/z", False)]


@register("robots_allowed", _values(_FETCH, "host, url, allowed"))
def robots_allowed(spark, d):
    files = spark.createDataFrame(ROBOTS, "host string, content string, status int")
    urls = spark.createDataFrame([x[:2] for x in _FETCH], "host string, url string")
    return web.can_fetch(urls, web.robots_rules(files, "siftbot")).select("host", "url", "allowed")


_PAGES = [("<title>Just a moment...</title>", True), ("<html><article>px-captcha explained</article></html>", False), ("<p>plain</p>", False), ("<div id='px-captcha'></div>", True), (None, False)]


@register("captcha_pages", _values(_PAGES, "html, captcha"))
def captcha_pages(spark, d):
    return spark.createDataFrame([x[:1] for x in _PAGES], "html string").select("html", Wb.is_captcha(F.col("html")).alias("captcha"))


_STATES, _CITIES = {"uttar-bhumi": "uttar-bhumi", "delhi": "delhi", "sagar-tat": "sagar-tat"}, {"leegarh": "uttar-bhumi", "sapur": "sagar-tat", "new-delhi": "delhi"}
_SECTIONS = {"sports": "sports", "business": "business", "khel": "sports", "state": "state"}
_PLACES = [("https://x.example/uttar-bhumi/leegarh/news-1.html", "uttar-bhumi", "leegarh", "general"), ("https://x.example/sports/sapur-wins-2.html", "sagar-tat", "sapur", "sports"), ("https://x.example/new-delhi/khel/a", "delhi", "new-delhi", "sports"), ("https://x.example/delhi/a", "delhi", "delhi", "general"), ("https://x.example/a/b-leegarh-city-c", "uttar-bhumi", "leegarh", "general"), ("https://x.example/", None, None, "general")]


@register("url_places", _values(_PLACES, "url, state, city, section"))
def url_places(spark, d):
    u = F.col("url")
    return spark.createDataFrame([x[:1] for x in _PLACES], "url string").select("url", Wb.location(u, _STATES, _CITIES).alias("l"), Wb.section(u, _SECTIONS).alias("section")).select("url", "l.state", "l.city", "section")


_DATES = [("2026-03-01T10:00:00+05:30", "2026-03-01T10:00:00+05:30"), ("2026-03-01T04:30:00Z", "2026-03-01T10:00:00+05:30"), ("2026-03-01T10:00:00", "2026-03-01T10:00:00+05:30"), ("2026-03-01 10:00:00", "2026-03-01T10:00:00+05:30"), ("01-03-2026 10:00", "2026-03-01T10:00:00+05:30"), ("1 Mar 2026, 10:00 AM", "2026-03-01T10:00:00+05:30"), ("March 1, 2026 10:00 AM", "2026-03-01T10:00:00+05:30"), ("2026-03-01", "2026-03-01T00:00:00+05:30"), ("abhi-abhi", None), ("", None), (None, None)]


@register("page_dates", _values(_DATES, "given, ist"))
def page_dates(spark, d):
    return spark.createDataFrame([x[:1] for x in _DATES], "given string").select("given", Wb.ist_string(Wb.parse_date(F.col("given"))).alias("ist"))


@register("bilingual_headlines", r"with h as (select distinct doc_id, headline, regexp_matches(headline, '^.*\S\s-\s[A-Za-z].*$') and regexp_matches(headline, '[\x{0900}-\x{097F}]') as has from page_texts where doc_id is not null) select doc_id, case when has then regexp_extract(headline, '^(.*?)\s-\s([A-Za-z].*)$', 1) end as hindi, case when has then regexp_extract(headline, '^(.*?)\s-\s([A-Za-z].*)$', 2) end as english from h")
def bilingual_headlines(spark, d):
    h = spark.read.parquet(f"{d}/page_texts.parquet").where("doc_id is not null").select("doc_id", "headline").distinct()
    return h.select("doc_id", X.bilingual_parts(F.col("headline")).alias("b")).select("doc_id", "b.hindi", "b.english")


_COSTS = [("a", "b", 0.25), ("b", "", 0.5), ("z", "y", 2.0)]


@register("cost_matrix", "with l as (select unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) as c) select a.c as src, b.c as dst, case when a.c = b.c then 0.0 when a.c = 'a' and b.c = 'b' then 0.25 when a.c = 'z' and b.c = 'y' then 2.0 else 1.0 end as cost from l a, l b")
def cost_matrix(spark, d):
    return rewrite.cost_matrix(spark.createDataFrame(_COSTS, "src string, dst string, cost double"))


@register("source_keys", "select distinct url, coalesce(nullif(list_extract(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.'), -2), ''), 'unknown') as key from articles where url is not null")
def source_keys(spark, d):
    return spark.read.parquet(f"{d}/articles.parquet").where("url is not null").select("url", Wb.source_key(F.col("url")).alias("key")).distinct()


@register("pools_merged", WITH + ", a as (select distinct qid as need, doc_id from (" + _RANKED.format("bm") + ") where rank <= 10), b as (select distinct qid as need, doc_id from (" + _RANKED.format("lnc") + ") where rank <= 10) select need, doc_id, 'old' as part from a union all select need, doc_id, 'new' from b where not exists (select 1 from a where a.need = b.need and a.doc_id = b.doc_id)")
def pools_merged(spark, d):
    q = q_exact(spark)
    i = index.restrict(idx(spark, d, keep=True), q)
    one = lambda s, part: evaluate.pool(match.top(s, 10).select("qid", "doc_id", "rank"), 10).withColumn("part", F.lit(part))
    return evaluate.merge_pools(one(rank.bm25(q, i), "old"), one(rank.cosine(q, i), "new"))


@register("crawl_report_all", "with c as (select 'source' as \"column\", coalesce(source, '(none)') as value from articles union all select 'section', coalesce(section, '(none)') from articles union all select 'state', coalesce(state, '(none)') from articles union all select 'city', coalesce(city, '(none)') from articles union all select 'agency_flag', coalesce(agency_flag::varchar, '(none)') from articles union all select 'day', coalesce(left(date, 10), '(none)') from articles) select \"column\", value, count(*) as n, round(count(*) / sum(count(*)) over (partition by \"column\"), 6) as share from c group by 1, 2")
def crawl_report_all(spark, d):
    a = spark.read.parquet(f"{d}/articles.parquet").withColumn("day", F.left("date", F.lit(10)))
    return r6(articles.crawl_report(a, ["source", "section", "state", "city", "agency_flag", "day"], limit=None), "share")
