"""Registered queries on the driver's tables, each with its SQL twin where SQL can express it.

Every query runs over whole tables. ``documents`` are read as articles (first
line: headline); result columns have the same names in both languages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.functions import web as Wb
from siftspark.operators import dedup, evaluate, graph, index, match, rank, rewrite, speedups
from siftspark.session import checkpoint_dir, ship, table
from siftspark.sources import articles
from siftspark.streaming import crawl

QUERIES = [("q1", "मंडी समिति के अध्यक्ष"), ("q2", "canal cleaning"), ("q3", "नहर की सफ़ाई"), ("q4", "zila aspatal ki team"), ("q5", "bus stand extension"), ("q6", "बाढ़ राहत शिविर"), ("q7", "flood relief camp")]
_REG: dict = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        _REG[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


# ------------------------------------------------------------------ shared parts
def docs(spark: SparkSession, d: str) -> DataFrame:
    return index.as_articles(table(spark, d, "documents")).select("doc_id", "headline", "body", F.col("published_at").alias("date"), "source", "section", "lang", "text")


_SAVED: dict = {}


def idx(spark: SparkSession, d: str, mode: str = "none", keep: bool = False) -> index.Index:
    """The index of the documents, built for this query alone, or with ``keep`` saved once in a session and read by every query after."""
    if not keep:
        return index.build(docs(spark, d), mode)
    key = (spark.sparkContext.applicationId, d, mode)
    if key not in _SAVED:
        path = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        index.build(docs(spark, d), mode).save(path)
        _SAVED[key] = path
    return index.Index.load(spark, _SAVED[key], mode)


def qs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "qid string, query string")


def q_exact(spark: SparkSession) -> DataFrame:
    return rank.exact_query(qs(spark))


def arts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct articles with their date as a timestamp."""
    return table(spark, d, "articles").withColumn("day", Wb.parse_date(F.col("date"))).distinct()


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_CLEAN = "replace(replace(replace(lower(nfc_normalize({})), chr(8204), ''), chr(8205), ''), 'हिंदी', 'हिन्दी')"
_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{Nd}}]+')"
def light_sql(e: str) -> str:
    return "case " + " ".join(f"when length({e}) >= {least} and regexp_matches({e}, '({'|'.join(x.split())})$') then left({e}, length({e}) - {n})" for n, (least, x) in X.LIGHT_SUFFIXES.items()) + f" else {e} end"


def aggressive_sql(e: str) -> str:
    by = {n: [x for x in X.AGGRESSIVE_SUFFIXES.split() if len(x) == n] for n in range(5, 0, -1)}
    return "case " + " ".join(f"when length({e}) >= {n + 2} and regexp_matches({e}, '({'|'.join(xs)})$') then left({e}, length({e}) - {n})" for n, xs in by.items() if xs) + f" else {e} end"


def with_sql(queries: list = QUERIES, mode: str = "none") -> str:
    """The shared parts of the twins: documents, tokens, statistics, queries, cosine and BM25 scores."""
    form = {"none": "{}", "light": light_sql("{}"), "aggr": aggressive_sql("{}")}[mode]
    return (
        "with d as (select doc_id, split_part(coalesce(text, ''), chr(10), 1) as headline, case when contains(coalesce(text, ''), chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end as body, published_at as date, source, section, lang, text from documents), "
        "z as (select doc_id, 'headline' as zone, headline as t from d union all select doc_id, 'body', body from d), "
        "w as (select doc_id, zone, " + _WORDS.format(_CLEAN.format("t")) + " as ws from z), "
        "tok0 as (select doc_id, zone, unnest(range(len(ws))) as pos, unnest(ws) as term from w), tok as (select doc_id, zone, pos, " + form.replace("{}", "term") + " as term from tok0), "
        "tf as (select term, doc_id, count(*) as tf from tok group by term, doc_id), "
        "nn as (select count(*) as n from d), "
        "terms as (select term, count(*) as df, cast(sum(tf) as bigint) as cf, log10((select n from nn) / count(*)) as idf from tf group by term), "
        "stats as (select doc_id, cast(sum(tf) as bigint) as len, sqrt(sum(pow(1 + log10(tf), 2))) as norm from tf group by doc_id), "
        "qt as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in queries) + ") v(qid, query)), "
        "qw as (select qid, " + _WORDS.format(_CLEAN.format("query")) + " as ws from qt), "
        "q0 as (select qid, unnest(range(len(ws))) as idx, unnest(ws) as term from qw), q as (select qid, idx, " + form.replace("{}", "term") + " as term from q0), "
        "qtf as (select qid, term, cast(count(*) as double) as qtf from q group by qid, term), "
        "qv0 as (select qid, qtf.term, (1 + log10(qtf)) * idf as w from qtf join terms on qtf.term = terms.term), "
        "qv as (select qid, term, w / sqrt(sum(w * w) over (partition by qid)) as w from qv0), "
        "lnc as (select qid, tf.doc_id, sum(w * (1 + log10(tf))) / any_value(norm) as score from qv join tf on qv.term = tf.term join stats on stats.doc_id = tf.doc_id group by qid, tf.doc_id), "
        "avgdl as (select sum(len) / (select n from nn) as a from stats), "
        "bm as (select qid, tf.doc_id, sum(qtf * ln(1 + ((select n from nn) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select a from avgdl)))) as score from qtf join terms on terms.term = qtf.term join tf on tf.term = qtf.term join stats on stats.doc_id = tf.doc_id group by qid, tf.doc_id) "
    )


WITH = with_sql()
_TOP = "select qid, doc_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from {} qualify rank <= 10"

# ------------------------------------------------------------------ text and index


@register("tok_counts", WITH + "select doc_id, zone, count(*) as n, count(distinct term) as terms from tok group by doc_id, zone")
def tok_counts(spark, d):
    t = index.tokens(docs(spark, d))
    return t.groupBy("doc_id", "zone", "term").agg(F.count("*").alias("c")).groupBy("doc_id", "zone").agg(F.sum("c").alias("n"), F.count("*").alias("terms"))


@register("postings", WITH + "select term, zone, doc_id, count(*) as tf, array_to_string(list(pos order by pos), ' ') as positions from tok group by term, zone, doc_id")
def postings(spark, d):
    return idx(spark, d).post.withColumn("positions", F.concat_ws(" ", F.col("positions").cast("array<string>")))


@register("index_saved", WITH + "select count(*) as postings, count(distinct term) as terms, sum(tf)::bigint as words from (select term, zone, doc_id, count(*) as tf from tok group by term, zone, doc_id)")
def index_saved(spark, d):
    """Builds and saves the index that the queries after it read; its postings counted."""
    return idx(spark, d, keep=True).post.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("words"))


@register("term_stats", WITH + "select term, df, cf, round(idf, 6) as idf from terms")
def term_stats(spark, d):
    return r6(idx(spark, d).terms, "idf")


@register("doc_stats", WITH + "select doc_id, len, round(norm, 6) as norm from stats")
def doc_stats(spark, d):
    return r6(idx(spark, d).stats, "norm")


@register("zipf_fit", WITH + "select round(regr_slope(log10(cf), log10(r)), 6) as slope, round(regr_intercept(log10(cf), log10(r)), 6) as intercept from (select cf, row_number() over (order by cf desc, term) as r from terms)")
def zipf_fit(spark, d):
    # ranks over all terms: equal frequencies are counted first, so that no task sorts the whole vocabulary
    t = idx(spark, d).terms
    by = t.groupBy("cf").agg(F.count("*").alias("c"))
    r = by.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy(F.desc("cf")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    e = r.select("cf", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("c"))).alias("r")).select(F.log10("cf").alias("y"), F.log10("r").alias("x"))
    return e.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@register("df_histogram", WITH + "select cast(floor(10.0 * df / (select n from nn)) as bigint) as tenth, count(*) as terms, count(case when df >= 0.9 * (select n from nn) then 1 end) as stop_candidates from terms group by 1")
def df_histogram(spark, d):
    i = idx(spark, d)
    t = i.terms.join(F.broadcast(i.n))
    return t.groupBy(F.floor(10.0 * F.col("df") / F.col("n")).cast("long").alias("tenth")).agg(F.count("*").alias("terms"), F.count(F.when(F.col("df") >= 0.9 * F.col("n"), 1)).alias("stop_candidates"))


@register("top_terms", WITH + "select term, cf from terms order by cf desc, term limit 50")
def top_terms(spark, d):
    return idx(spark, d).terms.select("term", "cf").orderBy(F.desc("cf"), "term").limit(50)


@register("first_of_repeated", "select count(distinct doc_id) as docs, count(*) as rows from articles where doc_id is not null")
def first_of_repeated(spark, d):
    a = table(spark, d, "articles")
    return index.first_of_each(a).agg(F.count("*").alias("docs")).join(a.where("doc_id is not null").agg(F.count("*").alias("rows")))


@register("normalized_text", "select doc_id, md5(trim(regexp_replace(" + _CLEAN.format("text") + r", '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+', ' ', 'g'))) as h from documents where text is not null")
def normalized_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("h"))


def _stem_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOPWORDS)
    return WITH + f"select term, {light_sql('term')} as light, {aggressive_sql('term')} as aggr, term in ({stop}) as stopword from terms"


@register("stems", _stem_sql())
def stems(spark, d):
    t = idx(spark, d).terms.select("term")
    return t.select("term", X.light_stem(F.col("term")).alias("light"), X.aggressive_stem(F.col("term")).alias("aggr"), X.is_stopword(F.col("term")).alias("stopword"))


def runs_sql(e: str, letters: str) -> str:
    """Runs of one letter as one."""
    for k in letters:
        e = f"regexp_replace({e}, '{k}+', '{k}', 'g')"
    return e


def code_sql(c: str) -> str:
    roman = f"lower({c})"
    for u, g in X.ROMAN_UNITS.items():
        roman = f"replace({roman}, '{u}', '{g}')"
    roman = f"regexp_replace(translate({roman}, '{X.ROMAN_LETTERS[0]}', '{X.ROMAN_LETTERS[1]}'), '[^1-9]', '', 'g')"
    deva = f"regexp_replace(regexp_replace(replace({c}, chr(2364), ''), '[ंँ]([पफबभम])', 'म\\1', 'g'), '[ंँ]', 'न', 'g')"
    deva = f"regexp_replace(translate({deva}, '{X.DEVANAGARI_CLASSES[0]}', '{X.DEVANAGARI_CLASSES[1]}'), '[^1-9]', '', 'g')"
    return runs_sql(f"case when regexp_matches({c}, '[\\x{{0900}}-\\x{{097F}}]') then {deva} else {roman} end", "123456789")


def soundex_sql(e: str) -> str:
    letters = f"regexp_replace(lower({e}), '[^a-z]', '', 'g')"
    codes = runs_sql(f"translate({letters}, '{X.SOUNDEX_LETTERS[0]}', '{X.SOUNDEX_LETTERS[1]}')", "0123456")
    return f"case when {letters} = '' then '' else concat(upper(left({letters}, 1)), rpad(left(replace(substr({codes}, 2), '0', ''), 3), 3, '0')) end"


def roman_sql(c: str) -> str:
    """Latin spelling of a Devanagari word: every consonant gets a mark, which a vowel sign, a virama or the end takes away and anything else turns into a."""
    e = f"nfc_normalize({c})"
    for whole, parts in (("ऩ", "ऩ"), ("ऱ", "ऱ"), ("ऴ", "ऴ")):
        e = f"replace({e}, '{whole}', '{parts}')"
    e = f"regexp_replace(regexp_replace({e}, '[ंँ]([पफबभम])', 'm\\1', 'g'), '[ंँ]', 'n', 'g')"
    for k, v in X.NUKTA.items():
        e = f"replace({e}, '{k}' || chr(2364), '{v}~')"
    for k, v in X.CONSONANTS.items():
        e = f"replace({e}, '{k}', '{v}~')"
    e = f"replace({e}, '~' || chr(2364), '~')"
    for k, v in X.SIGNS.items():
        e = f"replace(replace({e}, '~{k}', '{v}'), '{k}', '{v}')"
    e = f"replace(replace(regexp_replace({e}, '~$', ''), '~' || chr(2381), ''), chr(2381), '')"
    for k, v in X.VOWELS.items():
        e = f"replace({e}, '{k}', '{v}')"
    return f"replace(replace(translate(replace({e}, '~', 'a'), '०१२३४५६७८९', '0123456789'), 'ः', 'h'), chr(2364), '')"


@register("soundex_codes", WITH + f", b as (select n_name as name from nation union select c_name from customer union select p_name from part union select term from terms where not regexp_matches(term, '[\\x{{0900}}-\\x{{097F}}]')) select name, {soundex_sql('name')} as code from b")
def soundex_codes(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "customer").select("c_name")).union(table(spark, d, "part").select("p_name"))
    words = idx(spark, d, keep=True).terms.where(X.script(F.col("term")) == "roman").select("term")
    return names.union(words).distinct().select("name", X.soundex(F.col("name")).alias("code"))


@register("consonant_codes", WITH + f"select term, {code_sql('term')} as code from terms")
def consonant_codes(spark, d):
    return idx(spark, d).terms.select("term", X.consonant_code(F.col("term")).alias("code"))


@register("script_counts", WITH + r"select case when regexp_matches(term, '[\x{0900}-\x{097F}]') then 'devanagari' else 'roman' end as script, count(*) as terms, cast(sum(cf) as bigint) as cf from terms group by 1")
def script_counts(spark, d):
    return idx(spark, d).terms.groupBy(X.script(F.col("term")).alias("script")).agg(F.count("*").alias("terms"), F.sum("cf").alias("cf"))


_ENGLISH = "en_n as (select count(*) filter (where lower(lang) = 'en') as en, count(*) filter (where lower(lang) = 'hi-latn') as hl from documents), en_w as (select tf.term as word, count(*) filter (where lower(lang) = 'en') as en, count(*) filter (where lower(lang) = 'hi-latn') as hl from tf join documents on documents.doc_id = tf.doc_id where regexp_matches(tf.term, '^[a-z]+$') group by tf.term), english as (select word from en_w, en_n where en_w.en >= 3 and en_w.en / greatest(en_n.en, 1) >= 2 * en_w.hl / greatest(en_n.hl, 1))"
_AMBIGUOUS = ", ".join(f"'{w}'" for w in X.AMBIGUOUS)


def english_words(spark, d) -> DataFrame:
    """(word): Roman words of three or more English documents that stand in at least twice the share of English documents as of romanised Hindi ones."""
    return rewrite.english_lexicon(idx(spark, d, keep=True).post, table(spark, d, "documents").select("doc_id", "lang"))


def languages(spark, d, words: DataFrame) -> DataFrame:
    """(word, hi, hinglish, en) of words (word)."""
    return rewrite.classify_words(words, english_words(spark, d))


_EN = f"case when regexp_matches({{w}}, '[\\x{{{{0900}}}}-\\x{{{{097F}}}}]') then 0.0 when lower({{w}}) in ({_AMBIGUOUS}) then 0.5 when lower({{w}}) in (select word from english) then 0.9 else 0.1 end"


@register("language_weights", WITH + f", {_ENGLISH} select term as word, case when regexp_matches(term, '[\\x{{0900}}-\\x{{097F}}]') then 1.0 else 0.0 end as hi, case when regexp_matches(term, '[\\x{{0900}}-\\x{{097F}}]') then 0.0 when term in ({_AMBIGUOUS}) then 0.5 when term in (select word from english) then 0.1 else 0.9 end as hinglish, {_EN.format(w='term')} as en from terms")
def language_weights(spark, d):
    return languages(spark, d, idx(spark, d, keep=True).terms.select(F.col("term").alias("word")))


@register("romanized_terms", WITH + f"select term, {roman_sql('term')} as latin, {code_sql('term')} as code from terms where regexp_matches(term, '[\\x{{0900}}-\\x{{097F}}]')")
def romanized_terms(spark, d):
    return idx(spark, d).terms.where(X.script(F.col("term")) == "devanagari").select("term", X.romanize("term").alias("latin"), X.consonant_code(F.col("term")).alias("code"))


@register("name_distances", "with n as (select distinct canonical, unnest(variants) as v from names), p as (select a.v as a, b.v as b from n a join n b on a.canonical = b.canonical and a.v < b.v) select distinct a, b, cast(levenshtein(a, b) as integer) as dist, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as similarity from p")
def name_distances(spark, d):
    n = table(spark, d, "names").select("canonical", F.explode("variants").alias("v")).distinct()
    p = n.alias("a").join(n.alias("b"), (F.col("a.canonical") == F.col("b.canonical")) & (F.col("a.v") < F.col("b.v"))).select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).distinct()
    return p.select("a", "b", F.levenshtein("a", "b").alias("dist"), F.round(X.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@register("content_hashes", r"select distinct doc_id, content_hash = md5(trim(regexp_replace(coalesce(body, ''), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+', ' ', 'g'))) as right_hash from articles")
def content_hashes(spark, d):
    return table(spark, d, "articles").select("doc_id", (F.col("content_hash") == X.content_hash(F.col("body"))).alias("right_hash")).distinct()


# ------------------------------------------------------------------ matching


@register("and_match", WITH + ", n as (select qid, count(distinct idx) as n from q group by qid) select q.qid, tf.doc_id from q join tf on q.term = tf.term join n on n.qid = q.qid group by q.qid, tf.doc_id, n.n having count(distinct idx) = n.n")
def and_match(spark, d):
    return match.and_search(idx(spark, d, keep=True).post, match.query_words(qs(spark)))


@register("and_match_headline", WITH + ", n as (select qid, count(distinct idx) as n from q group by qid) select q.qid, tok.doc_id from q join tok on q.term = tok.term and zone = 'headline' join n on n.qid = q.qid group by q.qid, tok.doc_id, n.n having count(distinct idx) = n.n")
def and_match_headline(spark, d):
    return match.and_search(idx(spark, d, keep=True).post, match.query_words(qs(spark)), "headline")


@register("soft_and", WITH + ", n as (select qid, ceil(0.75 * count(distinct idx)) as n from q group by qid) select q.qid, tf.doc_id from q join tf on q.term = tf.term join n on n.qid = q.qid group by q.qid, tf.doc_id, n.n having count(distinct idx) >= n.n")
def soft_and(spark, d):
    return match.and_search(idx(spark, d, keep=True).post, match.query_words(qs(spark)), at_least=F.ceil(0.75 * F.col("n")))


@register("phrase_match", WITH + ", n as (select qid, count(distinct idx) as n from q group by qid) select distinct q.qid, tok.doc_id from q join tok on q.term = tok.term join n on n.qid = q.qid group by q.qid, tok.doc_id, zone, pos - idx, n.n having count(distinct idx) = n.n")
def phrase_match(spark, d):
    return match.phrase_search(idx(spark, d, keep=True).post, match.query_words(qs(spark)))


@register("proximity_match", WITH + ", n as (select qid, count(distinct idx) as n from q group by qid), h as (select q.qid, idx, doc_id, zone, pos from q join tok on q.term = tok.term) select distinct a.qid, a.doc_id from h a join h b on a.qid = b.qid and a.doc_id = b.doc_id and a.zone = b.zone and a.idx = 0 and b.idx > 0 and abs(a.pos - b.pos) <= 6 join n on n.qid = a.qid group by a.qid, a.doc_id, a.zone, a.pos, n.n having count(distinct b.idx) = n.n - 1")
def proximity_match(spark, d):
    return match.proximity_search(idx(spark, d, keep=True).post, match.query_words(qs(spark)), 6)


@register("smallest_window", WITH + ", h as (select distinct q.qid, tok.term, doc_id, zone, pos from q join tok on q.term = tok.term), m as (select qid, doc_id, zone, count(distinct term) as matched from h group by qid, doc_id, zone), l as (select r.qid, r.doc_id, r.zone, r.pos, t.term, max(t.pos) as last from h r join h t on r.qid = t.qid and r.doc_id = t.doc_id and r.zone = t.zone and t.pos <= r.pos group by all), s as (select qid, doc_id, zone, pos, pos - min(last) + 1 as span, count(*) as c from l group by qid, doc_id, zone, pos) select m.qid, m.doc_id, m.zone, m.matched, min(case when matched >= 2 and s.c = matched then span end) as span from m join s on m.qid = s.qid and m.doc_id = s.doc_id and m.zone = s.zone group by m.qid, m.doc_id, m.zone, m.matched")
def smallest_window(spark, d):
    return match.smallest_window(idx(spark, d, keep=True).post, match.query_words(qs(spark)).select("qid", "term").distinct())


@register("field_filter", "select doc_id, source, section from documents where source is not null and section in ('sports', 'state', 'national') and published_at >= timestamp '2026-03-01' and published_at < timestamp '2026-07-01'")
def field_filter(spark, d):
    return match.field_filter(docs(spark, d), sections=["sports", "state", "national"], date_from="2026-03-01", date_to="2026-06-30").where("source is not null").select("doc_id", "source", "section")


@register("distinct_values", "select distinct section as value from documents where section is not null and section <> ''")
def distinct_values(spark, d):
    return match.field_values(docs(spark, d), "section")


# ------------------------------------------------------------------ ranking


@register("bm25_top10", WITH + _TOP.format("bm"))
def bm25_top10(spark, d):
    return r6(match.top(rank.bm25(q_exact(spark), idx(spark, d, keep=True)), 10), "score").withColumn("rank", F.col("rank").cast("long"))


@register("bm25_headline_boost", WITH + ", hb as (select term, doc_id, sum(case when zone = 'headline' then 3.0 else 1.0 end) as tf from tok group by term, doc_id), b3 as (select qid, hb.doc_id, sum(qtf * ln(1 + ((select n from nn) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select a from avgdl)))) as score from qtf join terms on terms.term = qtf.term join hb on hb.term = qtf.term join stats on stats.doc_id = hb.doc_id group by qid, hb.doc_id) " + _TOP.format("b3"))
def bm25_headline_boost(spark, d):
    return r6(match.top(rank.bm25(q_exact(spark), idx(spark, d, keep=True), headline_boost=3.0), 10), "score").withColumn("rank", F.col("rank").cast("long"))


@register("lnc_ltc_top10", WITH + _TOP.format("lnc"))
def lnc_ltc_top10(spark, d):
    return r6(match.top(rank.cosine(q_exact(spark), idx(spark, d, keep=True)), 10), "score").withColumn("rank", F.col("rank").cast("long"))


@register("lnc_lnc_top10", WITH + ", u0 as (select qid, qtf.term, 1 + log10(qtf) as w from qtf join terms on qtf.term = terms.term), u as (select qid, term, w / sqrt(sum(w * w) over (partition by qid)) as w from u0), l2 as (select qid, tf.doc_id, sum(w * (1 + log10(tf))) / any_value(norm) as score from u join tf on u.term = tf.term join stats on stats.doc_id = tf.doc_id group by qid, tf.doc_id) " + _TOP.format("l2"))
def lnc_lnc_top10(spark, d):
    return r6(match.top(rank.cosine(q_exact(spark), idx(spark, d, keep=True), idf=False), 10), "score").withColumn("rank", F.col("rank").cast("long"))


_NET = (
    WITH + ", h as (select distinct qv.qid, tok.term, doc_id, zone, pos from qv join tok on qv.term = tok.term), m as (select qid, doc_id, zone, count(distinct term) as matched from h group by qid, doc_id, zone), "
    "l as (select r.qid, r.doc_id, r.zone, r.pos, t.term, max(t.pos) as last from h r join h t on r.qid = t.qid and r.doc_id = t.doc_id and r.zone = t.zone and t.pos <= r.pos group by all), s as (select qid, doc_id, zone, pos, pos - min(last) + 1 as span, count(*) as c from l group by qid, doc_id, zone, pos), "
    "v as (select m.qid, m.doc_id, m.zone, m.matched, min(case when matched >= 2 and s.c = matched then span end) as span from m join s on m.qid = s.qid and m.doc_id = s.doc_id and m.zone = s.zone group by m.qid, m.doc_id, m.zone, m.matched), "
    "nq as (select qid, count(*) as n from qv group by qid), "
    "zs as (select v.qid, v.doc_id, sum(case when zone = 'headline' then 0.7 else 0.3 end * matched / nq.n) as zone_score, max(matched) as matched, min(span) as span from v join nq on v.qid = nq.qid group by v.qid, v.doc_id), "
    "mx as (select max(date) as now from d), g as (select doc_id, coalesce(exp(-greatest((epoch_us((select now from mx)) - epoch_us(date)) / 86400e6, 0) / 7.0), 0) as g from d), "
    "net as (select lnc.qid, lnc.doc_id, lnc.score + 0.2 * zone_score + 0.1 * coalesce(matched / span, 0) + 0.1 * g as score from lnc join zs on lnc.qid = zs.qid and lnc.doc_id = zs.doc_id join g on g.doc_id = lnc.doc_id) "
)


@register("net_score_top10", _NET + _TOP.format("net"))
def net_score_top10(spark, d):
    q = q_exact(spark)
    return r6(match.top(rank.net_score(q, index.restrict(idx(spark, d, keep=True), q)).select("qid", "doc_id", "score"), 10), "score").withColumn("rank", F.col("rank").cast("long"))


@register("rrf_top10", _NET + ", r as (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from lnc qualify rank <= 50 union all select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from bm qualify rank <= 50 union all select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from net qualify rank <= 50), f as (select qid, doc_id, round(sum(1.0 / (60 + rank)), 12) as score from r group by qid, doc_id) select qid, doc_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from f qualify rank <= 10")
def rrf_top10(spark, d):
    q = q_exact(spark)
    i = index.restrict(idx(spark, d, keep=True), q)
    runs = [rank.cosine(q, i), rank.bm25(q, i), rank.net_score(q, i).select("qid", "doc_id", "score")]
    return r6(rank.rrf(runs, 10), "score").withColumn("rank", F.col("rank").cast("long"))


_CASCADE = (
    WITH + ", n as (select qid, count(distinct idx) as n from q group by qid), "
    "ph as (select distinct q.qid, tok.doc_id from q join tok on q.term = tok.term join n on n.qid = q.qid where n.n >= 2 group by q.qid, tok.doc_id, zone, pos - idx, n.n having count(distinct idx) = n.n), "
    "sp as (select distinct a.qid, ta.doc_id from q a join q b on a.qid = b.qid and b.idx = a.idx + 1 join n on n.qid = a.qid and n.n >= 3 join tok ta on ta.term = a.term join tok tb on tb.term = b.term and tb.doc_id = ta.doc_id and tb.zone = ta.zone and tb.pos = ta.pos + 1), "
    "al as (select q.qid, tf.doc_id from q join tf on q.term = tf.term join n on n.qid = q.qid group by q.qid, tf.doc_id, n.n having count(distinct idx) = n.n), "
    "st as (select qid, doc_id, min(stage) as stage from (select qid, doc_id, 0 as stage from ph union all select qid, doc_id, 1 from sp union all select qid, doc_id, 2 from al union all select qid, doc_id, 4 from bm) group by qid, doc_id), "
    "x as (select st.qid, st.doc_id, st.stage, bm.score from st join bm on st.qid = bm.qid and st.doc_id = bm.doc_id), c as (select qid, stage, count(*) as c from x group by qid, stage), o as (select qid, stage, coalesce(sum(c) over (partition by qid order by stage rows between unbounded preceding and 1 preceding), 0) as before from c) "
    "select x.qid, x.doc_id, x.stage, round(score, 6) as score, row_number() over (partition by x.qid order by x.stage, round(score, 9) desc, x.doc_id) as rank from x join o on x.qid = o.qid and x.stage = o.stage where before < 10 qualify rank <= 10"
)


@register("cascade_top10", _CASCADE)
def cascade_top10(spark, d):
    q = q_exact(spark)
    i = index.restrict(idx(spark, d, keep=True), q)
    return r6(rank.cascade(q, i, rank.bm25(q, i), 10), "score").select("qid", "doc_id", "stage", "score", F.col("rank").cast("long").alias("rank"))


# ------------------------------------------------------------------ inexact top-k
_W = WITH + ", tw as (select tf.term, tf.doc_id, (1 + log10(tf)) / norm as w from tf join stats on stats.doc_id = tf.doc_id) "


@register("champion_lists", _W + "select term, doc_id, round(w, 6) as w from (select *, row_number() over (partition by term order by round(w, 9) desc, doc_id desc) as r from tw) where r <= 10")
def champion_lists(spark, d):
    return r6(speedups.champions(idx(spark, d, keep=True), 10), "w")


_CHAMP = _W + ", ch as (select term, doc_id from (select *, row_number() over (partition by term order by round(w, 9) desc, doc_id desc) as r from tw) where r <= 10), ca as (select distinct qid, doc_id from ch join qv on qv.term = ch.term), few as (select qid from (select distinct qid from qv) x where (select count(*) from ca where ca.qid = x.qid) < 10), ft as (select qv.qid, tw.doc_id, sum(qv.w * tw.w) as score from qv join tw on qv.term = tw.term group by qv.qid, tw.doc_id), k as (select ft.* from ft where qid in (select qid from few) or exists (select 1 from ca where ca.qid = ft.qid and ca.doc_id = ft.doc_id)) "


@register("champion_search", _CHAMP + _TOP.format("k"))
def champion_search(spark, d):
    q = q_exact(spark)
    i = index.restrict(idx(spark, d, keep=True), q)
    return r6(speedups.champion_search(q, i, speedups.champions(i, 10)), "score").withColumn("rank", F.col("rank").cast("long"))


_IMPACT = _W + ", o as (select *, row_number() over (partition by term order by round(w, 9) desc, doc_id) as r, max(w) over (partition by term) as top_w from tw), k as (select qv.qid, o.doc_id, sum(qv.w * o.w) as score from qv join o on qv.term = o.term where r <= 50 and o.w >= 0.5 * top_w group by qv.qid, o.doc_id) "


@register("impact_search", _IMPACT + _TOP.format("k"))
def impact_search(spark, d):
    q = q_exact(spark)
    i = index.restrict(idx(spark, d, keep=True), q)
    return r6(speedups.impact_search(q, i, speedups.impact_postings(i), 10, 50, 0.5), "score").withColumn("rank", F.col("rank").cast("long"))


_TIER = _W + ", mx as (select max(date) as now from d), ti as (select doc_id, case when date is null then 3 when (epoch_us((select now from mx)) - epoch_us(date)) / 86400e6 <= 2 then 1 when (epoch_us((select now from mx)) - epoch_us(date)) / 86400e6 <= 7 then 2 else 3 end as tier from d), x as (select qv.qid, tw.doc_id, tier, sum(qv.w * tw.w) as score from qv join tw on qv.term = tw.term join ti on ti.doc_id = tw.doc_id group by qv.qid, tw.doc_id, tier), c as (select qid, tier, count(*) as c from x group by qid, tier), o as (select qid, tier, coalesce(sum(c) over (partition by qid order by tier rows between unbounded preceding and 1 preceding), 0) as before from c), k as (select x.* from x join o on x.qid = o.qid and x.tier = o.tier where before < 10) "


@register("tier_search", _TIER + _TOP.format("k"))
def tier_search(spark, d):
    return r6(speedups.tier_search(q_exact(spark), idx(spark, d, keep=True)), "score").withColumn("rank", F.col("rank").cast("long"))


_ELIM = _W + ", vi as (select qv.qid, qv.term, qv.w, idf, row_number() over (partition by qid order by idf desc, qv.term) as r, sum(case when idf >= 0.3 then 1 else 0 end) over (partition by qid) as good from qv join terms on terms.term = qv.term), v as (select * from vi where idf >= 0.3 or (good = 0 and r = 1)), ne as (select qid, case when count(*) >= 3 then cast(ceil(0.75 * count(*)) as bigint) else 1 end as need from v group by qid), x as (select v.qid, tw.doc_id, sum(v.w * tw.w) as score, count(*) as m from v join tw on v.term = tw.term group by v.qid, tw.doc_id), h as (select a.qid, lv.m as lv, count(*) as have from (select distinct qid, m from x) lv join x a on a.qid = lv.qid and a.m >= lv.m group by a.qid, lv.m), le as (select ne.qid, case when (select count(*) from x where x.qid = ne.qid and x.m >= ne.need) >= 10 then ne.need else coalesce((select max(lv) from h where h.qid = ne.qid and h.have >= 10 and h.lv <= ne.need), 1) end as least from ne), k as (select x.qid, x.doc_id, x.score from x join le on x.qid = le.qid where x.m >= le.least) "


@register("index_elimination", _ELIM + _TOP.format("k"))
def index_elimination(spark, d):
    return r6(speedups.index_elimination(q_exact(spark), idx(spark, d, keep=True)), "score").withColumn("rank", F.col("rank").cast("long"))


_CLUSTER = _W + ", le as (select doc_id as leader from d order by md5(doc_id::varchar) limit (select round(sqrt(n))::bigint from nn)), si as (select tw.doc_id, l.doc_id as leader, round(sum(tw.w * l.w), 9) as s from tw join tw l on l.term = tw.term join le on le.leader = l.doc_id group by tw.doc_id, l.doc_id), fo as (select d.doc_id, coalesce(arg_min(leader, (-s, leader)), (select min(leader) from le)) as leader from d left join si on si.doc_id = d.doc_id group by d.doc_id), ft as (select qv.qid, tw.doc_id, sum(qv.w * tw.w) as score from qv join tw on qv.term = tw.term group by qv.qid, tw.doc_id), x as (select ft.*, leader from ft join fo on fo.doc_id = ft.doc_id), ne as (select qid, doc_id as leader, round(score, 9) as s from ft where doc_id in (select leader from le)), co as (select qid, leader, count(*) as c from x group by qid, leader), al as (select coalesce(co.qid, ne.qid) as qid, coalesce(co.leader, ne.leader) as leader, coalesce(c, 0) as c, coalesce(s, 0) as s from co full join ne on co.qid = ne.qid and co.leader = ne.leader), op as (select qid, leader from (select qid, leader, row_number() over (partition by qid order by s desc, leader) as place, coalesce(sum(c) over (partition by qid order by s desc, leader rows between unbounded preceding and 1 preceding), 0) as before from al) where place <= 3 or before < 10), k as (select x.qid, doc_id, score from x join op on op.qid = x.qid and op.leader = x.leader) "


@register("cluster_search", _CLUSTER + _TOP.format("k"))
def cluster_search(spark, d):
    q = q_exact(spark)
    i = idx(spark, d, keep=True)
    return r6(speedups.cluster_search(q, i, speedups.assign(i, speedups.leaders(i)), 10, 3), "score").withColumn("rank", F.col("rank").cast("long"))


def _speedup_sql() -> str:
    best = "select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from {} qualify rank <= 10"
    rows = []
    for name, part in (("elimination", _ELIM), ("champions", _CHAMP), ("tiers", _TIER), ("impact", _IMPACT), ("clusters", _CLUSTER)):
        rows.append(f"select '{name}' as method, * from ({part}, ex as ({best.format('lnc')}), ru as ({best.format('k')}), n as (select lnc.qid, count(*) as al from lnc group by lnc.qid), e as (select qid, count(*) as n from ex group by qid), m as (select ex.qid, count(*) as m from ex join ru on ru.qid = ex.qid and ru.doc_id = ex.doc_id group by ex.qid), s as (select qid, count(*) as s from k group by qid) select round(avg(coalesce(s, 0) / al), 6) as scored, round(avg(coalesce(m, 0) / least(e.n, 10)), 6) as overlap, count(*) as queries from n join e on e.qid = n.qid left join m on m.qid = n.qid left join s on s.qid = n.qid)")
    return " union all ".join(rows)


@register("speedup_report", _speedup_sql())
def speedup_report(spark, d):
    """Share of candidates scored, and of the exact ten best kept, of each way to search."""
    q, whole = q_exact(spark), idx(spark, d, keep=True)
    i = index.restrict(whole, q)
    runs = {
        "elimination": speedups.elimination_scores(q, i), "champions": speedups.champion_scores(q, i, speedups.champions(i, 10)), "tiers": speedups.tier_scores(q, i),
        "impact": speedups.impact_scores(q, i, speedups.impact_postings(i), 50, 0.5), "clusters": speedups.cluster_scores(q, i, speedups.assign(whole, speedups.leaders(whole)), 10, 3),
    }
    return r6(speedups.speedup_report(rank.cosine(q, i), runs), "scored", "overlap")


# ------------------------------------------------------------------ graph and duplicates
_EDGES = "e as (select distinct a.doc_id as src, l.dst from (select doc_id, unnest(links) as dst from articles) l join articles a on a.doc_id = l.doc_id where l.dst <> a.doc_id and l.dst in (select doc_id from articles))"


@register("known_links", f"with {_EDGES} select src, dst from e")
def known_links(spark, d):
    return graph.known_links(table(spark, d, "articles"))


def _pagerank_sql(rounds: int) -> str:
    s = f"with {_EDGES}, v as (select distinct doc_id as id from articles where doc_id is not null), k as (select count(*) as n from v), o as (select src, count(*) as c from e group by src), p0 as (select id, 1.0::double / (select n from k) as pr from v)"
    for i in range(rounds):
        s += f", f{i} as (select dst as id, sum(pr / c) as flow from e join p{i} on p{i}.id = e.src join o on o.src = e.src group by dst), l{i} as (select coalesce(sum(pr), 0) as lost from p{i} where id not in (select src from o)), p{i + 1} as (select v.id, 0.15::double / (select n from k) + 0.85 * (coalesce(flow, 0) + (select lost from l{i}) / (select n from k)) as pr from v left join f{i} on f{i}.id = v.id)"
    return s + f" select id, round(pr, 9) as pr from p{rounds}"


def moment_sql(c: str) -> str:
    """SQL of the microseconds of an ISO date string, without offset in IST."""
    s = f"trim({c})"
    return f"case when regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}.*)?$') then epoch_us(try_cast(case when regexp_matches({s}, '[0-9]{{2}}:[0-9]{{2}}.*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then {s} when length({s}) > 10 then {s} || '+05:30' else {s} || ' 00:00:00+05:30' end as timestamptz)) end"


@register("pagerank_5", _pagerank_sql(5))
def pagerank_5(spark, d):
    a = table(spark, d, "articles")
    return graph.pagerank(a.where("doc_id is not null").select(F.col("doc_id").alias("id")), graph.known_links(a), rounds=5).withColumn("pr", F.round("pr", 9))


@register("static_score", _pagerank_sql(10).replace(" select id, round(pr, 9) as pr from p10", f", mo as (select doc_id, any_value({moment_sql('date')}) as at from articles where doc_id is not null group by doc_id), firsts as (select distinct dup_of as doc_id from articles where dup_of is not null) select mo.doc_id, round(0.5 * coalesce(exp(-greatest(((select max(mo.at) from mo) - mo.at) / 86400e6, 0) / 7.0), 0) + 0.3 * pr / (select max(pr) from p10) + 0.2 * (firsts.doc_id is not null)::int, 6) as g from mo join p10 on p10.id = mo.doc_id left join firsts on firsts.doc_id = mo.doc_id"))
def static_score(spark, d):
    a = index.first_of_each(arts(spark, d))
    pr = graph.pagerank(a.select(F.col("doc_id").alias("id")), graph.known_links(a), rounds=10)
    return r6(rank.static_score(a, pr, "day"), "g")


_SH = r"list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end)"
_WS = r"'[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+'"


@register("exact_duplicates", "select md5(coalesce(text, '')) as h, count(*) as n, min(doc_id) as first from documents where text is not null group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_SETS = f"a as (select distinct doc_id, body from articles where body is not null and doc_id is not null), x as (select doc_id, list_filter(string_split_regex(body, {_WS}), lambda y: y <> '') as w from a), s as (select doc_id, {_SH} as sh from x), k as (select doc_id, sh, md5(array_to_string(list_sort(sh), chr(10))) as cls from s where len(sh) > 0), rep as (select cls, min(doc_id) as id, any_value(sh) as sh from k group by cls), t as (select id, len(sh) as n, unnest(sh) as g from rep), f as (select g from t group by g having count(*) > 1), c as (select a.id as doc_a, b.id as doc_b, a.n as na, b.n as nb, count(*) as c from t a join f on f.g = a.g join t b on a.g = b.g and a.id < b.id group by all), near as (select doc_a, doc_b, c / (na + nb - c) as similarity from c where c / (na + nb - c) >= 0.7)"


@register("near_duplicate_pairs", f"with {_SETS} select doc_a, doc_b, round(similarity, 6) as similarity from near")
def near_duplicate_pairs(spark, d):
    return r6(dedup.representative_pairs(*dedup.near_classes(table(spark, d, "articles"))), "similarity")


@register("near_duplicate_members", f"with {_SETS} select distinct k.doc_id, rep.id as representative from k join rep on k.cls = rep.cls")
def near_duplicate_members(spark, d):
    m = dedup.members_of(table(spark, d, "articles"))
    name = m.groupBy("cls").agg(F.min("id").alias("representative"))
    return m.select(F.col("id").alias("doc_id"), "cls").distinct().join(name, "cls").select("doc_id", "representative")


@register("duplicate_lineage", f"with recursive {_SETS}, mo as (select doc_id, min({moment_sql('date')}) as at from articles where doc_id is not null group by doc_id), m as (select distinct k.doc_id, k.cls, rep.id as rep, mo.at from k join rep on k.cls = rep.cls join mo on mo.doc_id = k.doc_id), l as (select doc_a, doc_b from near union select doc_b, doc_a from near union select rep, rep from m), e as (select distinct x.doc_id as u, y.doc_id as v from m x join l on l.doc_a = x.rep join m y on y.rep = l.doc_b where x.doc_id <> y.doc_id and (x.at is null or y.at is null or abs(x.at - y.at) <= 86400000000)), r(s, n) as (select distinct u, u from e union select r.s, e.v from r join e on r.n = e.u), g as (select s as doc_id, min(n) as grp from r group by s), root as (select grp, doc_id as root from (select g.grp, g.doc_id, row_number() over (partition by g.grp order by mo.at is null, mo.at, g.doc_id) as i from g join mo on mo.doc_id = g.doc_id) where i = 1) select mo.doc_id, case when root.root <> mo.doc_id then root.root end as dup_of from mo left join g on g.doc_id = mo.doc_id left join root on root.grp = g.grp")
def duplicate_lineage(spark, d):
    a = arts(spark, d)
    return dedup.clusters(a.where("doc_id is not null"), dedup.near_in_time(*dedup.near_classes(a, date_col="day")), date_col="day")


@register("duplicates_in_time", f"with {_SETS}, mo as (select doc_id, min({moment_sql('date')}) as at from articles where doc_id is not null group by doc_id) select doc_a, doc_b, x.at is not null and y.at is not null and abs(x.at - y.at) <= 86400000000 as within_a_day, x.at is null or y.at is null as unknown from near join mo x on x.doc_id = doc_a join mo y on y.doc_id = doc_b")
def duplicates_in_time(spark, d):
    a = arts(spark, d)
    p = dedup.representative_pairs(*dedup.near_classes(a))
    at = a.where("doc_id is not null").groupBy("doc_id").agg(F.min("day").alias("at"))
    x = p.join(at.select(F.col("doc_id").alias("doc_a"), F.col("at").alias("ta")), "doc_a").join(at.select(F.col("doc_id").alias("doc_b"), F.col("at").alias("tb")), "doc_b")
    unknown = F.col("ta").isNull() | F.col("tb").isNull()
    return x.select("doc_a", "doc_b", (~unknown & dedup.within(F.col("ta"), F.col("tb"), 24.0)).alias("within_a_day"), unknown.alias("unknown"))


# ------------------------------------------------------------------ web


_KEY = "replace(lower(nfc_normalize(coalesce({}, ''))), chr(2364), '')"
_PATH = r"trim(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/')"


@register("page_types", f"with f as (select distinct doc_id, headline, url, {_KEY.format('headline')} as h, {_PATH} as p from fetched) select distinct doc_id, case when regexp_matches(h, '{Wb.HOROSCOPE_WORDS}') then 'horoscope' when regexp_matches(coalesce(headline, ''), '\\s-\\s[a-z]') then 'article' when regexp_matches(h, '{Wb.LISTING_WORDS}') or (url is not null and (p = '' or contains('/' || p || '/', '/live/') or (not regexp_matches(p, '[0-9]') and len(string_split(list_last(string_split(p, '/')), '-')) <= 3 and len(string_split(p, '/')) <= 3))) then 'listing' else 'article' end as page_type from f")
def page_types(spark, d):
    return table(spark, d, "fetched").select("doc_id", Wb.page_type(F.col("headline"), F.col("url")).alias("page_type")).distinct()


@register("url_hosts", r"select distinct url, source, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, regexp_matches(lower(url), '/rashifal|/astrology|/horoscope|/dharm|/photo-gallery|/photos|/videos|/video|/web-stories|/visual-stories|/live-updates|/cricket-scorecard|/games|/entertainment/web-series|bbc\.com|news18\.com|ndtv\.com|ndtv\.in') as skip, coalesce(source, 'none') || concat('_', case when regexp_matches(url, '[-_/]\d{5,12}(\.html|\.cms|/|$)') then regexp_extract(url, '[-_/](\d{5,12})(\.html|\.cms|/|$)', 1) else left(md5(url), 8) end) as id from articles where url is not null")
def url_hosts(spark, d):
    a = table(spark, d, "articles").where("url is not null")
    return a.select("url", "source", Wb.host(F.col("url")).alias("host"), Wb.should_skip(F.col("url")).alias("skip"), Wb.doc_id_of(F.col("url"), F.coalesce("source", F.lit("none"))).alias("id")).distinct()


def url_sql(u: str) -> str:
    """SQL of the normal form of a url."""
    s = f"trim({u})"
    take = lambda i: f"coalesce(regexp_extract({s}, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', {i}), '')"
    scheme = f"case when {take(1)} = '' then 'https' else lower({take(1)}) end"
    host = f"case when {scheme} = 'http' then regexp_replace(lower({take(2)}), ':80$', '') when {scheme} = 'https' then regexp_replace(lower({take(2)}), ':443$', '') else lower({take(2)}) end"
    path = f"regexp_replace(regexp_replace(regexp_replace({take(3)}, ';[^/]*$', ''), '^/amp(/|$)', '/'), '/amp/?$', '')"
    path = f"case when length({path}) > 1 then regexp_replace({path}, '/$', '') else {path} end"
    pairs = f"list_filter(string_split({take(4)}, '&'), lambda x: regexp_matches(x, '^[^=]+=.+') and not starts_with(x, 'utm_') and split_part(x, '=', 1) not in ('fbclid', 'ref', 'amp', 'amp_js_v'))"
    coded = f"list_transform({pairs}, lambda x: url_encode(url_decode(split_part(x, '=', 1))) || '=' || url_encode(url_decode(regexp_replace(x, '^[^=]*=', ''))))"
    query = f"array_to_string({coded}, '&')"
    return f"case when coalesce({s}, '') = '' then '' else {scheme} || '://' || {host} || {path} || case when {query} = '' then '' else '?' || {query} end end"


@register("url_normal", f"with u as (select distinct url from (select url from fetched union all select url from page_texts union all select url from articles union all select url from incoming) x) select url, {url_sql('url')} as normal from u where url is not null")
def url_normal(spark, d):
    u = table(spark, d, "fetched").select("url")
    for t in ("page_texts", "articles", "incoming"):
        u = u.union(table(spark, d, t).select("url"))
    return u.where("url is not null").distinct().select("url", Wb.url_normalize(F.col("url")).alias("normal"))


@register("article_checks", "with x as (select unnest(list_filter([case when doc_id is null then 'doc_id is null' end, case when url is null then 'url is null' end, case when source is null then 'source is null' end, case when headline is null then 'headline is null' end, case when body is null then 'body is null' end, case when date is null then 'date is null' end, case when not regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\\+05:30$') then 'date is not in the form of IST' end, case when not regexp_matches(content_hash, '^[0-9a-f]{32}$') then 'content_hash is no MD5' end, case when keywords is null then 'keywords is null' end, case when links is null then 'links is null' end, case when trim(body, ' ') = '' then 'body is empty' end], lambda y: y is not null)) as reason from articles) select reason, count(*) as n from x group by reason")
def article_checks(spark, d):
    x = articles.check_article(table(spark, d, "articles"))
    return x.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("corpus_report", "with c as (select 'source' as \"column\", coalesce(source, '(none)') as value from articles union all select 'section', coalesce(section, '(none)') from articles union all select 'state', coalesce(state, '(none)') from articles) select \"column\", value, count(*) as n, round(count(*) / sum(count(*)) over (partition by \"column\"), 6) as share from c group by 1, 2 qualify row_number() over (partition by \"column\" order by count(*) desc, value) <= 15")
def corpus_report(spark, d):
    return r6(articles.crawl_report(table(spark, d, "articles"), ["source", "section", "state"]), "share")


@register("agency_stories", "select distinct doc_id, coalesce(contains(body, 'पीटीआई') or contains(body, 'भाषा') or contains(body, 'वार्ता') or contains(body, 'ANI') or contains(body, 'PTI') or contains(body, 'Univarta') or contains(body, 'Bhasha'), false) as agency from articles")
def agency_stories(spark, d):
    return table(spark, d, "articles").select("doc_id", Wb.is_agency(F.col("body")).alias("agency")).distinct()


# ------------------------------------------------------------------ re-ranking and dense


@register("demoted_top10", WITH + f", k as (select doc_id, case when regexp_matches({_KEY.format('headline')}, '{Wb.HOROSCOPE_WORDS}') then 1 when regexp_matches(headline, '\\s-\\s[a-z]') then 0 when regexp_matches({_KEY.format('headline')}, '{Wb.LISTING_WORDS}') then 1 else 0 end as low from d), r as (select qid, doc_id, score from bm qualify row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) <= 30), x as (select qid, r.doc_id, low, case when low = 1 then 0.3 * score else score end as score from r join k on k.doc_id = r.doc_id) select qid, doc_id, round(score, 6) as score, row_number() over (partition by qid order by low, round(score, 9) desc, doc_id) as rank from x")
def demoted_top10(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    kinds = i.docs.select("doc_id", Wb.page_type(F.col("headline"), F.lit(None).cast("string")).alias("page_type"))
    return r6(rank.demote(match.top(rank.bm25(q, i), 30), kinds), "score").withColumn("rank", F.col("rank").cast("long"))


@register("collapsed_top10", WITH + ", c as (select doc_id, min(doc_id) over (partition by md5(coalesce(text, ''))) as cluster, source from d), r as (select qid, bm.doc_id, cluster, row_number() over (partition by qid order by round(score, 9) desc, bm.doc_id desc) as rank from bm join c on c.doc_id = bm.doc_id qualify rank <= 30), b as (select qid, doc_id, cluster, rank from r qualify row_number() over (partition by qid, cluster order by rank) = 1), o as (select b.qid, b.doc_id, array_to_string(list_sort(list(distinct c.source)), ' ') as also_in from b join c on c.cluster = b.cluster and c.doc_id <> b.doc_id where c.source is not null group by b.qid, b.doc_id) select b.qid, b.doc_id, row_number() over (partition by b.qid order by rank) as rank, coalesce(also_in, '') as also_in from b left join o on o.qid = b.qid and o.doc_id = b.doc_id qualify row_number() over (partition by b.qid order by rank) <= 10")
def collapsed_top10(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    h = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    c = i.docs.join(i.docs.groupBy(h.alias("h")).agg(F.min("doc_id").alias("cluster")), F.col("h") == h).select("doc_id", "cluster", "source")
    x = rank.collapse(match.top(rank.bm25(q, i), 30), c, 10)
    return x.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.concat_ws(" ", "also_in").alias("also_in"))


_RANKED = "select qid, doc_id, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from {}"
_MOVED = ", r5 as (select * from (" + _RANKED.format("bm") + ") where rank <= 5), tfi as (select qid, r5.doc_id, tf.term, (1 + log10(tf)) * idf as w from r5 join tf on tf.doc_id = r5.doc_id join terms on terms.term = tf.term), cn as (select qid, count(*) as c from r5 group by qid), mv as (select qid, term, sum(w) as w from (select qid, term, w from qv union all select tfi.qid, term, 0.75 * sum(w) / any_value(c) from tfi join cn on cn.qid = tfi.qid group by tfi.qid, term) group by qid, term), ro as (select qid, term, w, row_number() over (partition by qid order by round(w, 9) desc, term) as rank from mv where w > 0 and not exists (select 1 from q where q.qid = mv.qid and q.term = mv.term) qualify rank <= 5)"
_BM = "select q_.qid, tf.doc_id, sum(qtf * ln(1 + ((select n from nn) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select a from avgdl)))) as score from {} q_ join terms on terms.term = q_.term join tf on tf.term = q_.term join stats on stats.doc_id = tf.doc_id group by q_.qid, tf.doc_id"
_FEEDBACK = _MOVED + ", fq as (select qid, term, sum(qtf) as qtf from (select qid, term, qtf from qtf union all select qid, term, w / max(w) over (partition by qid) from ro) group by qid, term), fb as (" + _BM.format("fq") + ")"


def _mmr_sql(k: int = 5, lam: float = 0.7) -> str:
    out = WITH + ", r as (select * from (" + _RANKED.format("bm") + ") where rank <= 30), rl as (select r.*, case when max(score) over (partition by qid) = min(score) over (partition by qid) then 1.0 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end as rel from r), v as (select tf.doc_id, term, (1 + log10(tf)) / norm as w from tf join stats on stats.doc_id = tf.doc_id where tf.doc_id in (select doc_id from r)), sims as (select a.doc_id as a, b.doc_id as b, sum(a.w * b.w) as s from v a join v b on a.term = b.term and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id), p0 as (select qid, doc_id, 0 as rank from r where false)"
    for i in range(1, k + 1):
        out += f", w{i} as (select rl.qid, rl.doc_id, max(coalesce(s, 0)) as worst from rl join p{i - 1} on p{i - 1}.qid = rl.qid left join sims on a = rl.doc_id and b = p{i - 1}.doc_id group by rl.qid, rl.doc_id), p{i} as (select * from p{i - 1} union all select qid, doc_id, {i} from (select rl.qid, rl.doc_id, row_number() over (partition by rl.qid order by round({lam} * rel - {1 - lam} * greatest(coalesce(worst, 0), 0), 12) desc, rl.rank) as i from rl left join w{i} on w{i}.qid = rl.qid and w{i}.doc_id = rl.doc_id where not exists (select 1 from p{i - 1} p where p.qid = rl.qid and p.doc_id = rl.doc_id)) where i = 1)"
    return out + f" select r.qid, r.doc_id, round(score, 6) as score, p{k}.rank from p{k} join r on r.qid = p{k}.qid and r.doc_id = p{k}.doc_id"


@register("diversified_top5", _mmr_sql())
def diversified_top5(spark, d):
    q = q_exact(spark)
    i = idx(spark, d, keep=True)
    return r6(rank.mmr(match.top(rank.bm25(q, i), 30), i.post, k=5), "score").select("qid", "doc_id", "score", "rank")


@register("rocchio_terms", WITH + _MOVED + " select qid, term, round(w, 6) as w, rank from ro")
def rocchio_terms(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    rel = match.top(rank.bm25(q, i), 5).select("qid", "doc_id")
    return r6(rank.rocchio(q, rel, None, i), "w").select("qid", "term", "w", "rank")


@register("feedback_bm25", WITH + _FEEDBACK + _TOP.format("fb").replace("select qid", " select qid", 1))
def feedback_bm25(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    return r6(match.top(rank.bm25(rank.feedback(q, i, rank.bm25(q, i)), i), 10), "score")


_KAL_QUERIES = [("k1", "kal barish hogi"), ("k2", "कल का नतीजा"), ("k3", "bus stand yesterday"), ("k4", "canal cleaning")]


def _kal_sql() -> str:
    some = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    n = lambda w, xs: f"len(list_filter({w}, lambda x: x in {some(xs)}))"
    qw = "string_split_regex(lower(trim(query)), '\\s+')"
    dw = f"list_transform(string_split_regex(headline || ' ' || body, {_WS}), lambda x: regexp_replace(x, '^[।.,]+|[।.,]+$', '', 'g'))"
    future = f"len(list_filter(ws, lambda x: x in {some(rank.FUTURE_CUES)} or regexp_matches(x, '{rank.FUTURE_ENDINGS}')))"
    return (
        with_sql(_KAL_QUERIES) + f", ki as (select qid, case when {n(qw, rank.DIRECTION)} > 0 then list_filter({qw}, lambda x: x in {some(rank.DIRECTION)})[1] when {n(qw, rank.KAL_WORDS)} = 0 then null when {n(qw, rank.FUTURE_CUES)} > {n(qw, rank.PAST_CUES)} then 'tomorrow' else 'yesterday' end as intent from qt), "
        f"dw as (select doc_id, date::date as day, {dw} as ws from d), dd as (select doc_id, day, date_diff('day', day, (select max(day) from dw)) as old, {future} > {n('ws', rank.PAST_CUES)} as future from dw), "
        "r as (select * from (" + _RANKED.format("bm") + ") where rank <= 10), x as (select r.qid, r.doc_id, score * (1 + 0.5 * case when day is null or intent is null then 0.0 when intent = 'yesterday' then case old when 1 then 1.0 when 0 then 0.3 else 0.0 end when old <= 1 then case when future then case when old = 0 then 1.0 else 0.6 end else 0.2 end else 0.0 end) as score from r join ki on ki.qid = r.qid join dd on dd.doc_id = r.doc_id) "
        "select qid, doc_id, round(score, 6) as score, 0 as stage, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from x"
    )


@register("date_intent", _kal_sql())
def date_intent(spark, d):
    i = idx(spark, d, keep=True)
    q = spark.createDataFrame(_KAL_QUERIES, "qid string, query string")
    e = rank.exact_query(q)
    return r6(rank.apply_kal(match.top(rank.bm25(e, i), 10).withColumn("stage", F.lit(0)), q, i.docs), "score")


@register("query_difficulty", WITH + ", sp as (select qid, max(i) as specificity from (select qid, idx, min(idf) as i from q join terms on terms.term = q.term group by qid, idx) group by qid), sc as (select q.qid, count(distinct doc_id) / (select n from nn) as scope from q join tf on tf.term = q.term group by q.qid), hd as (select qid, doc_id, score from bm qualify row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) <= 10), sh as (select qid, doc_id, score / sum(score) over (partition by qid) as p from hd), mo as (select qid, tf.term, sum(p * tf / len) as dd from sh join tf on tf.doc_id = sh.doc_id join stats on stats.doc_id = sh.doc_id group by qid, tf.term), co as (select qid, dd, greatest(cf, 1) / (select sum(cf) from terms) as c from mo join terms on terms.term = mo.term), cl as (select qid, sum((0.6 * dd + 0.4 * c) * log2((0.6 * dd + 0.4 * c) / c)) as clarity from co group by qid) select qt.qid, round(coalesce(specificity, 0), 6) as specificity, round(coalesce(scope, 0), 6) as scope, round(coalesce(clarity, 0), 6) as clarity, coalesce(specificity, 0) < 1.0 as low_confidence from qt left join sp on sp.qid = qt.qid left join sc on sc.qid = qt.qid left join cl on cl.qid = qt.qid")
def query_difficulty(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    return r6(rank.difficulty(q, i, match.top(rank.bm25(q, i), 10)), "specificity", "scope", "clarity")


@register("dense_top10", "with q as (select vec_id as qid, embedding as qe from embeddings where vec_id % 20 = 0), s as (select qid, e.vec_id as doc_id, round(list_cosine_similarity(cast(qe as double[]), cast(e.embedding as double[])), 9) as sim from q join embeddings e on e.vec_id <> qid) select qid, doc_id, round(sim, 6) as sim, row_number() over (partition by qid order by sim desc, doc_id) as rank from s qualify rank <= 10")
def dense_top10(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    x = rank.dense_search(e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), e, 10)
    return x.select("qid", "doc_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@register("dense_cells_top10", None)
def dense_cells_top10(spark, d):
    """The same search through an index of cells; its recall is measured by ``dense_recall``."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    x = rank.cell_search(e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), e, rank.vector_cells(e), 10)
    return x.select("qid", "doc_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@register("dense_recall", None)
def dense_recall(spark, d):
    """(recall, queries): share of the exact ten nearest that the index of cells finds."""
    a, b = dense_top10(spark, d).select("qid", "doc_id"), dense_cells_top10(spark, d).select("qid", "doc_id").withColumn("hit", F.lit(1))
    return a.join(b, ["qid", "doc_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"), F.countDistinct("qid").alias("queries"))


@register("dense_reranked", WITH + ", fr as (select * from (" + "select qid, doc_id, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from bm" + ") where rank <= 30), em as (select vec_id, embedding from embeddings), qe as (select qid, doc_id as top from fr where rank = 1), si as (select fr.qid, fr.doc_id, fr.rank, fr.score, coalesce(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 0) as sim from fr join qe on qe.qid = fr.qid left join em a on a.vec_id = qe.top left join em b on b.vec_id = fr.doc_id), mm as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as x, case when max(sim) over w = min(sim) over w then 1.0 else (sim - min(sim) over w) / (max(sim) over w - min(sim) over w) end as y from si window w as (partition by qid)) select qid, doc_id, round(0.5 * x + 0.5 * y, 6) as mixed, row_number() over (partition by qid order by round(0.5 * x + 0.5 * y, 9) desc, doc_id) as rank from mm")
def dense_reranked(spark, d):
    """BM25's thirty best, mixed with their vectors' likeness to that of the first."""
    q = q_exact(spark)
    first = match.top(rank.bm25(q, idx(spark, d, keep=True)), 30)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    top = first.where("rank = 1").join(e, "doc_id").select("qid", F.col("vec").alias("top"))
    sims = first.select("qid", "doc_id").join(e, "doc_id").join(top, "qid").select("qid", "doc_id", rank.vector_cosine(F.col("top"), F.col("vec")).alias("sim"))
    return r6(rank.dense_rerank(first, sims), "mixed").select("qid", "doc_id", "mixed", F.col("rank").cast("long").alias("rank"))


# ------------------------------------------------------------------ evaluation: runs of the queries, judged by a rule over the documents
_JUDGE = ", gr as (select q.qid, tok.doc_id, case when count(distinct idx) = any_value(n.n) then 2 when count(distinct idx) * 2 >= any_value(n.n) then 1 else 0 end as grade from q join tok on q.term = tok.term join (select qid, count(distinct idx) as n from q group by qid) n on n.qid = q.qid group by q.qid, tok.doc_id), rel as (select qid, count(*) as relevant from gr where grade >= 1 group by qid), run as (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from bm qualify rank <= 30), j as (select run.*, coalesce(grade, 0) as grade, case when grade >= 1 then 1 else 0 end as isrel, sum(case when grade >= 1 then 1 else 0 end) over (partition by run.qid order by rank) as hits from run left join gr on gr.qid = run.qid and gr.doc_id = run.doc_id)"


def _qrels(i: index.Index, q: DataFrame) -> DataFrame:
    n = q.groupBy("qid").agg(F.countDistinct("idx").alias("n"))
    m = match.hits(i.post, q.select("qid", "idx", "term")).groupBy("qid", "doc_id").agg(F.countDistinct("idx").alias("m")).join(F.broadcast(n), "qid")
    return m.select("qid", "doc_id", F.when(F.col("m") == F.col("n"), 2).when(F.col("m") * 2 >= F.col("n"), 1).otherwise(0).alias("grade"))


def _run(spark, d, k: int = 30):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    return match.top(rank.bm25(q, i), k).select("qid", "doc_id", "rank"), _qrels(i, q)


_IDEAL = ", best as (select qid, grade, row_number() over (partition by qid order by grade desc, doc_id) as i from gr qualify i <= 10), ideal as (select qid, sum(grade / log2(i + 1)) as ideal from best group by qid), pq as (select rel.qid, coalesce(sum(case when rank <= 10 then isrel else 0 end), 0) / 10 as p, coalesce(sum(case when rank <= 10 then isrel else 0 end), 0) / any_value(relevant) as r, coalesce(sum(case when isrel = 1 then hits / rank else 0 end), 0) / any_value(relevant) as ap, coalesce(sum(case when rank <= 10 then grade / log2(rank + 1) else 0 end), 0) / any_value(ideal) as ndcg from rel join ideal on ideal.qid = rel.qid left join j on j.qid = rel.qid group by rel.qid)"


@register("metrics_per_query", WITH + _JUDGE + _IDEAL + " select qid, round(p, 6) as p, round(r, 6) as r, round(ap, 6) as ap, round(ndcg, 6) as ndcg from pq")
def metrics_per_query(spark, d):
    return r6(evaluate.per_query(*_run(spark, d)).select("qid", "p", "r", "ap", "ndcg"), "p", "r", "ap", "ndcg")


@register("metrics_mean", WITH + _JUDGE + _IDEAL + " select round(avg(p), 6) as p, round(avg(r), 6) as r, round(avg(ap), 6) as map, round(avg(ndcg), 6) as ndcg, count(*) as queries from pq")
def metrics_mean(spark, d):
    return r6(evaluate.means(evaluate.per_query(*_run(spark, d))).drop("f1"), "p", "r", "map", "ndcg")


@register("interp11", WITH + _JUDGE + ", pt as (select j.qid, hits / relevant as recall, hits / rank as precision from j join rel on rel.qid = j.qid where isrel = 1), lv as (select unnest(range(11)) / 10 as level), x as (select rel.qid, level, coalesce((select max(precision) from pt where pt.qid = rel.qid and recall >= level - 1e-12), 0) as precision from rel cross join lv) select level, round(avg(precision), 6) as precision from x group by level")
def interp11(spark, d):
    return r6(evaluate.interpolated(*_run(spark, d)), "precision")


@register("pool_topk", WITH + "select distinct qid as need, doc_id from (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from bm union all select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from lnc) where rank <= 10")
def pool_topk(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    runs = match.top(rank.bm25(q, i), 10).select("qid", "doc_id", "rank").union(match.top(rank.cosine(q, i), 10).select("qid", "doc_id", "rank"))
    return evaluate.pool(runs, 10)


_TWO = ", ra as (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from bm qualify rank <= 10), rb as (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from lnc qualify rank <= 10), sh as (select ra.qid, ra.doc_id, ra.rank as a, rb.rank as b from ra join rb on ra.qid = rb.qid and ra.doc_id = rb.doc_id), qq as (select qid from ra union select qid from rb)"


@register("kendall_overlap", WITH + _TWO + ", t as (select x.qid, sum(sign(y.a - x.a) * sign(y.b - x.b)) / count(*) as tau from sh x join sh y on x.qid = y.qid and x.a < y.a group by x.qid), o as (select qid, count(*) as c from sh group by qid) select qq.qid, round(t.tau, 6) as tau, round(coalesce(o.c, 0) / 10, 6) as overlap from qq left join t on t.qid = qq.qid left join o on o.qid = qq.qid")
def kendall_overlap(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    a, b = match.top(rank.bm25(q, i), 10), match.top(rank.cosine(q, i), 10)
    return r6(evaluate.kendall(a, b).join(evaluate.overlap(a, b), "qid"), "tau", "overlap")


_APS = ", gr as (select q.qid, tok.doc_id, case when count(distinct idx) = any_value(n.n) then 2 when count(distinct idx) * 2 >= any_value(n.n) then 1 else 0 end as grade from q join tok on q.term = tok.term join (select qid, count(distinct idx) as n from q group by qid) n on n.qid = q.qid group by q.qid, tok.doc_id), rel as (select qid, count(*) as relevant from gr where grade >= 1 group by qid), u0 as (select qid, qtf.term, 1 + log10(qtf) as w from qtf join terms on qtf.term = terms.term), u as (select qid, term, w / sqrt(sum(w * w) over (partition by qid)) as w from u0), l2 as (select qid, tf.doc_id, sum(w * (1 + log10(tf))) / any_value(norm) as score from u join tf on u.term = tf.term join stats on stats.doc_id = tf.doc_id group by qid, tf.doc_id), rr as (select 'a' as run, * from (" + _RANKED.format("bm") + ") where rank <= 30 union all select 'b', * from (" + _RANKED.format("l2") + ") where rank <= 30), jj as (select run, rr.qid, rank, case when grade >= 1 then 1 else 0 end as isrel, sum(case when grade >= 1 then 1 else 0 end) over (partition by run, rr.qid order by rank) as hits from rr left join gr on gr.qid = rr.qid and gr.doc_id = rr.doc_id), ap as (select run, rel.qid, sum(case when isrel = 1 then hits / rank else 0 end) / any_value(relevant) as ap from rel join jj on jj.qid = rel.qid group by run, rel.qid), df as (select a.qid, a.ap - b.ap as d from ap a join ap b on a.qid = b.qid and a.run = 'a' and b.run = 'b')"


@register("paired_t", WITH + _APS + ", st as (select count(*) as n, avg(d) as mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t from df), th as (select *, n - 1 as v, atan(abs(t) / sqrt(n - 1)) as th from st), se as (select case when v % 2 = 0 then sin(th) * (select sum(coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / (2 * i))), 1) * pow(cos(th), 2 * j)) from range(0, v // 2) x(j)) else 2 / pi() * (th + case when v > 1 then sin(th) * cos(th) * (select sum(coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i) / (2 * i + 1))), 1) * pow(cos(th), 2 * j)) from range(0, (v - 1) // 2) x(j)) else 0 end) end as inside, n, mean_diff, t from th) select n, round(mean_diff, 6) as mean_diff, round(t, 6) as t, round(1 - inside, 6) as p from se")
def paired_t(spark, d):
    """Student's t with p by the continued fraction; the twin takes the finite series for whole degrees of freedom."""
    return r6(evaluate.paired_t(_two_aps(spark, d)), "mean_diff", "t", "p")


def _two_aps(spark, d) -> DataFrame:
    i, q = idx(spark, d, keep=True), q_exact(spark)
    rel = _qrels(i, q)
    one = lambda s, n: evaluate.per_query(match.top(s, 30).select("qid", "doc_id", "rank"), rel).select("qid", F.col("ap").alias(n))
    return one(rank.bm25(q, i), "a").join(one(rank.cosine(q, i, idf=False), "b"), "qid")


@register("randomization_test", WITH + _APS + ", fl as (select r.round, avg(case when left(md5('0|' || r.round || '|' || qid), 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e') then d else -d end) as m from df, (select unnest(range(1, 2001)) as round) r group by r.round) select (select count(*) from df) as n, round((select avg(d) from df), 6) as mean_diff, round((count(*) filter (where abs(m) >= abs((select avg(d) from df)) - 1e-12) + 1) / 2001, 6) as p from fl")
def randomization_test(spark, d):
    return r6(evaluate.randomization(_two_aps(spark, d), 2000), "mean_diff", "p")


@register("learned_ranking", None)
def learned_ranking(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    rows = match.top(rank.bm25(q, i), 30).select("qid", "doc_id", F.col("score").alias("bm25")).join(rank.cosine(q, i).withColumnRenamed("score", "cosine"), ["qid", "doc_id"], "left").na.fill(0.0).join(_qrels(i, q), ["qid", "doc_id"], "left").withColumn("need", F.col("qid"))
    return r6(evaluate.learn_to_rank(rows, ["bm25", "cosine"], steps=300), "score")


# ------------------------------------------------------------------ rewriting


def _vocab(spark, d) -> DataFrame:
    return rewrite.vocabulary(idx(spark, d, keep=True).terms.select("term", "df"))


def _voc_sql(terms: str = "terms") -> str:
    canon = f"case when regexp_matches(term, '[\\x{{0900}}-\\x{{097F}}]') then {roman_sql('term')} else lower(term) end"
    return f"vo0 as (select term, df, {canon} as canon from {terms}), vo as (select *, {code_sql('term')} as code, {soundex_sql('canon')} as soundex from vo0)"


def _grams_sql(e: str) -> str:
    s = f"('$' || {e} || '$')"
    return f"list_distinct(case when length({s}) <= 2 then [{s}] else list_transform(range(1, length({s})), lambda i: substr({s}, i, 2)) end)"


def _candidates_sql(words: str, pool: int = 50) -> str:
    """Candidates (word, term) of ``words`` (word, low) among vo: by bigrams and by sound."""
    return (
        f"wd as (select word, low, {code_sql('word')} as code, {soundex_sql('word')} as soundex from {words}), vg as (select term, unnest({_grams_sql('canon')}) as gram from vo), vn as (select term, count(*) as n from vg group by term), wg as (select word, unnest({_grams_sql('low')}) as gram from wd), wn as (select word, count(*) as n from wg group by word), "
        f"c0 as (select wg.word, vg.term, count(*) as c from wg join vg on vg.gram = wg.gram group by wg.word, vg.term qualify row_number() over (partition by wg.word order by count(*) desc, vg.term) <= {max(5 * pool, 200)}), c1 as (select c0.word, c0.term, row_number() over (partition by c0.word order by c / (wn.n + vn.n - c) desc, c0.term) as i from c0 join vn on vn.term = c0.term join wn on wn.word = c0.word), "
        f"ca as (select word, term from c1 where i <= {pool} union select wd.word, vo.term from wd join vo on wd.code = vo.code and wd.code <> '' union select wd.word, vo.term from wd join vo on wd.soundex = vo.soundex and wd.soundex <> '')"
    )


def _variants_sql(words: str) -> str:
    """Spelling variants va (word, term, weight) of ``words`` (word, low, en)."""
    return (
        _voc_sql() + ", " + _candidates_sql(words) + f", v0 as (select ca.word, ca.term, round(levenshtein(wd.low, vo.canon) - case when vo.code = wd.code then 4.0 else 0.0 end - 1.5 * ln(1 + df), 9) as score from ca join wd on wd.word = ca.word join vo on vo.term = ca.term join {words} e on e.word = ca.word where regexp_matches(ca.term, '[\\x{{0900}}-\\x{{097F}}]') and levenshtein(wd.low, vo.canon) <= case when e.en >= 0.6 then 0.35 * length(wd.low) else 0.4 * length(wd.low) + 1 end), "
        "v1 as (select * from v0 qualify row_number() over (partition by word order by score, term) <= 5), va as (select word, term, round(exp(-(score - min(score) over (partition by word))) / sum(exp(-(score - (select min(score) from v1 y where y.word = v1.word)))) over (partition by word), 4) as weight from v1)"
    )


_WORDS_5 = ["nahar", "aspataal", "school", "bijlee", "samiti"]


@register("kgram_candidates", WITH + r", tm as (select term, concat('$', term, '$') as s from terms where regexp_matches(term, '^[a-z]+$')), g as (select distinct term, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) as gram from tm), n as (select term, count(*) as n from g group by term), wd as (select unnest(['nahr', 'safaii', 'aspatl', 'bussstand', 'kheton']) as word), ws as (select word, concat('$', word, '$') as s from wd), wg as (select distinct word, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) as gram from ws), wn as (select word, count(*) as n from wg group by word), c as (select wg.word, g.term, count(*) as c from wg join g on g.gram = wg.gram group by wg.word, g.term qualify row_number() over (partition by wg.word order by count(*) desc, g.term) <= 250), j as (select c.word, c.term, c.c / (wn.n + n.n - c.c) as jaccard from c join n on n.term = c.term join wn on wn.word = c.word) select word, term, round(jaccard, 6) as jaccard, row_number() over (partition by word order by jaccard desc, term) as rank from j qualify rank <= 50")
def kgram_candidates(spark, d):
    v = idx(spark, d, keep=True).terms.where(F.col("term").rlike("^[a-z]+$")).select("term", X.kgrams(F.col("term")).alias("grams"))
    w = spark.createDataFrame([(x,) for x in ("nahr", "safaii", "aspatl", "bussstand", "kheton")], "word string").withColumn("grams", X.kgrams(F.col("word")))
    return r6(rewrite.kgram_candidates(w, v), "jaccard").withColumn("rank", F.col("rank").cast("long"))


@register("spelling_variants", WITH + f", {_ENGLISH}, w5 as (select word, word as low, {_EN.format(w='word')} as en from (select unnest({_WORDS_5}) as word)), {_variants_sql('w5')} select word, term, weight from va")
def spelling_variants(spark, d):
    w = spark.createDataFrame([(x,) for x in _WORDS_5], "word string")
    return rewrite.weighted_variants(languages(spark, d, w).select("word", "en"), _vocab(spark, d))


def _names(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, d, "names").select("canonical", F.explode("variants").alias("v")).distinct()
    return n, rewrite.vocabulary(n.select(F.col("canonical").alias("term"), F.lit(1).alias("df")).distinct()), n.select(F.col("v").alias("query"), F.col("canonical").alias("target"))


@register("name_matching", f"with nm as (select distinct canonical, unnest(variants) as v from names), tn as (select distinct canonical as term, 1 as df from nm), {_voc_sql('tn')}, ws as (select distinct v as word, lower(v) as low from nm), {_candidates_sql('ws')}, mt as (select unnest(['levenshtein', 'soundex', 'code']) as matcher), dd as (select matcher, ca.word, ca.term, case matcher when 'levenshtein' then 0.0 when 'soundex' then (vo.soundex <> wd.soundex)::int else (vo.code <> wd.code)::int end + levenshtein(wd.low, canon) / 100 as dist from ca join wd on wd.word = ca.word join vo on vo.term = ca.term, mt), rk as (select *, row_number() over (partition by matcher, word order by round(dist, 9), term) as rank from dd qualify rank <= 10), re as (select matcher, nm.v, nm.canonical, (select min(rank) from rk where rk.matcher = mt.matcher and rk.word = nm.v and rk.term = nm.canonical) as rank from nm, mt) select matcher, round(avg(case when rank = 1 then 1.0 else 0.0 end), 6) as accuracy, round(avg(coalesce(1 / rank, 0.0)), 6) as mrr, count(*) as n from re group by matcher")
def name_matching(spark, d):
    n, vocab, truth = _names(spark, d)
    out = None
    for m in ("levenshtein", "soundex", "code"):
        got = rewrite.match_words(n.select(F.col("v").alias("word")), vocab, m).select(F.col("word").alias("query"), F.col("term").alias("candidate"), "rank")
        row = r6(evaluate.matcher_quality(got, truth), "accuracy", "mrr").withColumn("matcher", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out


def _learned(spark, d) -> DataFrame:
    return rewrite.learn_costs(table(spark, d, "names").select(X.romanize("canonical").alias("canonical"), F.explode("variants").alias("human")))


@register("name_matching_learned", None)
def name_matching_learned(spark, d):
    """The same measure with edit costs learnt from the names."""
    n, vocab, truth = _names(spark, d)
    rows = _learned(spark, d).collect()
    got = rewrite.match_words(n.select(F.col("v").alias("word")), vocab, "learned", {(r.src, r.dst): r.cost for r in rows}, unseen=rows[0].unseen if rows else 1.0)
    return r6(evaluate.matcher_quality(got.select(F.col("word").alias("query"), F.col("term").alias("candidate"), "rank"), truth), "accuracy", "mrr")


@register("edit_costs", None)
def edit_costs(spark, d):
    return r6(_learned(spark, d), "cost", "unseen")


@register("dice_dictionary", "with h as (select distinct doc_id, regexp_extract(headline, '^(.*?)\\s-\\s([A-Za-z].*)$', 1) as hindi, regexp_extract(headline, '^(.*?)\\s-\\s([A-Za-z].*)$', 2) as english from page_texts where regexp_matches(headline, '^.*\\S\\s-\\s[A-Za-z].*$') and regexp_matches(headline, '[\\x{0900}-\\x{097F}]')), n as (select count(*) as n from h), " + f"e0 as (select doc_id, unnest(list_distinct({_WORDS.format('lower(english)')})) as w from h), h0 as (select doc_id, unnest(list_distinct({_WORDS.format('lower(hindi)')})) as w from h), " + "e1 as (select w, count(*) as c from e0 group by w having count(*) <= greatest(0.05 * (select n from n), 1)), h1 as (select w, count(*) as c from h0 group by w having count(*) <= greatest(0.05 * (select n from n), 1)), p as (select e0.w as english, h0.w as hindi, any_value(e1.c) as ec, any_value(h1.c) as hc, count(*) as pairs from e0 join e1 on e1.w = e0.w join h0 on h0.doc_id = e0.doc_id join h1 on h1.w = h0.w group by e0.w, h0.w), x as (select *, 2 * pairs / (ec + hc) as dice from p where 2 * pairs / (ec + hc) >= 0.5) select english, hindi, pairs, round(dice, 6) as dice from x qualify row_number() over (partition by english order by round(dice, 9) desc, pairs desc, hindi) = 1")
def dice_dictionary(spark, d):
    x = table(spark, d, "page_texts").select("doc_id", X.bilingual_parts(F.col("headline")).alias("b")).select("doc_id", "b.*")
    return r6(rewrite.mine_dictionary(x, min_pairs=1), "dice")


def deva_sql(e: str) -> str:
    """Devanagari letters as single bytes, so that the twin's edit distance counts letters."""
    return "translate(" + e + ", '" + "".join(map(chr, range(0x900, 0x97F))) + "', '" + "".join(map(chr, range(1, 128))).replace("'", "''") + "')"


def likeness_sql(a: str, b: str) -> str:
    return f"(1 - levenshtein({deva_sql(a)}, {deva_sql(b)}) / greatest(length({a}), length({b})))"


_FORMS = f"fo as (select {light_sql('term')} as stem, term as word, count(*) as freq from tok where length(term) >= 3 and not regexp_matches(term, '^\\p{{Nd}}+$') group by term), f1 as (select * from fo where stem <> word), sz as (select stem, sum(freq)::bigint as freq, count(*) as forms from f1 group by stem having sum(freq) >= 5 and count(*) >= 2 and min(freq) >= 2), f2 as (select f1.* from f1 join sz on sz.stem = f1.stem), dw as (select distinct tf.doc_id, f2.stem, f2.word from tf join f2 on f2.word = tf.term), dn as (select word, count(*) as docs from dw group by word), bo as (select a.word as a, b.word as b, count(*) as common from dw a join dw b on a.doc_id = b.doc_id and a.stem = b.stem and a.word < b.word group by a.word, b.word), pr as (select x.stem, x.word as a, y.word as b, coalesce(common, 0) / (dx.docs + dy.docs - coalesce(common, 0)) as share, {likeness_sql('x.word', 'y.word')} as s from f2 x join f2 y on x.stem = y.stem and x.word < y.word join dn dx on dx.word = x.word join dn dy on dy.word = y.word left join bo on bo.a = x.word and bo.b = y.word), g as (select stem, round(avg(s), 9) as s, round(min(s), 9) as l, round(max(share), 9) as c from pr group by stem), cl as (select sz.*, s, l, c, case when s >= 0.65 and l >= 0.50 and c <= 0.10 then 'STRONG' when s >= 0.55 and l >= 0.40 and c <= 0.20 then 'GOOD' when s >= 0.45 and c <= 0.30 then 'REVIEW' else 'REJECT' end as verdict from sz join g on g.stem = sz.stem)"


def _related_sql(base: str, form: str) -> str:
    q = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    ends = [f"(suffix({base}, 'ा') and starts_with({form}, left({base}, length({base}) - 1)) and substr({form}, length({base})) in {q(rewrite.A_FORMS)})", f"(suffix({base}, 'ी') and starts_with({form}, left({base}, length({base}) - 1)) and substr({form}, length({base})) in {q(rewrite.I_FORMS)})"]
    ends += [f"(suffix({form}, '{x}') and {base} in (left({form}, length({form}) - {len(x)}), left({form}, length({form}) - {len(x)}) || 'ा', left({form}, length({form}) - {len(x)}) || 'ी'))" for x in rewrite.PLURALS]
    ends.append(f"(length({base}) >= 3 and starts_with({form}, {base}) and substr({form}, length({base}) + 1) in {q(rewrite.VERBALS)})")
    dist = f"levenshtein({deva_sql(base)}, {deva_sql(form)})"
    same = lambda n: f"(length({base}) >= {n} and left({base}, {n}) = left({form}, {n}))"
    close = f"(length({base}) >= 4 and length({form}) >= 4 and ({same(3)} and {dist} <= 2 or {same(4)} and {dist} <= 3 or {dist} <= 2 and {dist} / greatest(length({base}), length({form})) <= 0.30))"
    return "(" + " or ".join([*ends, close]) + ")"


def _auto_sql() -> str:
    score = f"round(least(freq, 5000) / 5000.0 + case when suffix(word, 'ा') then 3.0 when suffix(word, 'ी') then 1.5 else 0.0 end - case when regexp_matches(word, '({'|'.join(rewrite.OBLIQUE)})$') then 2.0 else 0.0 end - length(word) * 0.03, 9)"
    return (
        WITH + f", {_FORMS}, li as (select f2.*, row_number() over (partition by f2.stem order by f2.freq desc, word) as i from f2 join cl on cl.stem = f2.stem where verdict = 'STRONG' and s >= 0.67 and c <= 0.25 qualify i <= 10), "
        f"sa as (select distinct x.stem from li x join li y on x.stem = y.stem and x.i < y.i where {_related_sql('x.word', 'y.word')}), ca as (select stem, word as stem_form from (select stem, word, row_number() over (partition by stem order by {score} desc, freq desc, word) as b from li where stem in (select stem from sa)) where b = 1) "
        f"select word, stem_form from li join ca on ca.stem = li.stem where word <> stem_form and {_related_sql('stem_form', 'word')}"
    )


def _words(spark, d) -> DataFrame:
    return index.tokens(docs(spark, d)).select("doc_id", F.col("term").alias("word"))


@register("stem_classes", WITH + f", {_FORMS} select stem, freq, forms, round(s, 6) as similarity, round(l, 6) as least_similarity, round(c, 6) as collision, verdict from cl")
def stem_classes(spark, d):
    return r6(rewrite.stem_candidates(_words(spark, d), X.light_stem(F.col("word"))), "similarity", "least_similarity", "collision")


_COLLIDE = f"d1 as (select distinct doc_id, term as word, {light_sql('term')} as stem from tf where length(term) >= 2 and not regexp_matches(term, '^\\p{{Nd}}+$')), d2 as (select * from d1 where stem <> word), fr as (select stem, word, count(*) as docs from d2 group by stem, word), bg as (select stem from fr group by stem having sum(docs) >= 5), ff as (select * from fr where docs >= 2 and stem in (select stem from bg)), d3 as (select d2.* from d2 join ff on ff.word = d2.word), bo as (select a.word as a, b.word as b, count(*) as common from d3 a join d3 b on a.doc_id = b.doc_id and a.stem = b.stem and a.word < b.word group by a.word, b.word), pr as (select x.stem, x.word as form_a, y.word as form_b, coalesce(common, 0) as common, coalesce(common, 0) / least(x.docs, y.docs) as rate from ff x join ff y on x.stem = y.stem and x.word < y.word left join bo on bo.a = x.word and bo.b = y.word)"


@register("stem_collisions", WITH + f", {_COLLIDE}, cd as (select stem, count(distinct doc_id) as class_docs, count(distinct word) as forms from d3 group by stem), c as (select stem, max(rate) as collision, sum(common)::bigint as overlap from pr group by stem) select cd.stem, forms, class_docs, round(collision, 6) as collision, overlap, case when collision = 0 then 'SAFE' when round(collision, 9) <= 0.10 then 'LIKELY_SAFE' when round(collision, 9) <= 0.30 then 'REVIEW' else 'UNSAFE' end as verdict from cd join c on c.stem = cd.stem")
def stem_collisions(spark, d):
    return r6(rewrite.stem_collisions(_words(spark, d), X.light_stem(F.col("word")))[0], "collision")


@register("stem_collision_pairs", WITH + f", {_COLLIDE} select stem, form_a, form_b, common, round(rate, 6) as rate from pr")
def stem_collision_pairs(spark, d):
    return r6(rewrite.stem_collisions(_words(spark, d), X.light_stem(F.col("word")))[1], "rate")


@register("auto_stems", _auto_sql())
def auto_stems(spark, d):
    return rewrite.auto_stems(_words(spark, d))


@register("snippets", WITH + f", qs as (select qid, list(distinct term) as terms from q group by qid), r as (select * from (" + _RANKED.format("bm") + f") where rank <= 5), b as (select r.qid, r.doc_id, terms, body, list_filter(string_split(regexp_replace(body, '([।.!?])[\\s\\x{{000B}}]+', '\\1' || chr(1), 'g'), chr(1)), lambda y: list_bool_or(list_transform(terms, lambda t: contains(lower(y), t)))) as hit from r join d on d.doc_id = r.doc_id join qs on qs.qid = r.qid) select qid, doc_id, case when len(hit) > 0 then hit[1] else array_to_string(string_split_regex(trim(body, ' '), {_WS})[1:28], ' ') end as snippet from b")
def snippets(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    t = q.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    return match.top(rank.bm25(q, i), 5).join(i.docs.select("doc_id", "body"), "doc_id").join(F.broadcast(t), "qid").select("qid", "doc_id", X.snippet(F.col("body"), F.col("terms")).alias("snippet"))


@register("recency", "select doc_id, round(coalesce(exp(-greatest((epoch_us((select max(published_at) from documents)) - epoch_us(published_at)) / 86400e6, 0) / 7.0), 0), 6) as g from documents")
def recency(spark, d):
    x = table(spark, d, "documents")
    return x.join(F.broadcast(x.agg(F.max("published_at").alias("now")))).select("doc_id", F.round(Wb.recency(F.col("published_at"), F.col("now")), 6).alias("g"))


@register("crawl_utility", "select distinct url, headline, section, round(greatest(0.0, least(1.0, 0.5 + case when section in ('national', 'state', 'weather', 'politics') then 0.2 when section in ('lifestyle', 'entertainment') then -0.1 else 0.0 end + case when len(list_filter(string_split_regex(coalesce(headline, ''), " + _WS + "), lambda x: x <> '')) >= 4 then 0.1 else 0.0 end)), 6) as utility from articles")
def crawl_utility(spark, d):
    return table(spark, d, "articles").select("url", "headline", "section", F.round(Wb.utility(F.col("headline"), F.col("section")), 6).alias("utility")).distinct()


@register("rubric_grades", "with x as (select doc_id, split_part(coalesce(text, ''), chr(10), 1) as h, coalesce(text, '') as t from documents) select doc_id, cast(case when (contains(h, 'पुल') or contains(h, 'bridge')) and (contains(t, 'मरम्मत') or contains(t, 'repair')) then 2 when contains(t, 'पुल') or contains(t, 'bridge') then 1 else 0 end as integer) as grade from x")
def rubric_grades(spark, d):
    words = lambda *w: F.array(*map(F.lit, w))
    return docs(spark, d).select("doc_id", evaluate.rubric_grade(F.col("headline"), F.col("body"), words("पुल", "bridge"), words("मरम्मत", "repair")).cast("int").alias("grade"))


@register("result_sets", WITH + ", n as (select qid, count(distinct idx) as n from q group by qid), al as (select q.qid, tf.doc_id from q join tf on q.term = tf.term join n on n.qid = q.qid group by q.qid, tf.doc_id, n.n having count(distinct idx) = n.n), an as (select distinct q.qid, tf.doc_id from q join tf on q.term = tf.term) select 'all' as kind, qid, count(*) as docs from al group by qid union all select 'any', qid, count(*) from an group by qid union all select 'any_not_all', qid, count(*) from (select * from an except select * from al) group by qid")
def result_sets(spark, d):
    i, w = idx(spark, d, keep=True), match.query_words(qs(spark))
    every, some = match.and_search(i.post, w), match.hits(i.post, w).select("qid", "doc_id").distinct()
    count = lambda x, kind: x.groupBy("qid").agg(F.count("*").alias("docs")).select(F.lit(kind).alias("kind"), "qid", "docs")
    return count(every, "all").union(count(some, "any")).union(count(some.exceptAll(every), "any_not_all"))


@register("merged_judgments", "select need, doc_id, max(grade) as grade from (select section as need, doc_id, 1 as grade from documents where section is not null and doc_id % 2 = 0 union all select section, doc_id, 2 from documents where section is not null and doc_id % 3 = 0) group by need, doc_id")
def merged_judgments(spark, d):
    x = table(spark, d, "documents").where("section is not null")
    one = lambda m, g: x.where(F.col("doc_id") % m == 0).select(F.col("section").alias("need"), "doc_id", F.lit(g).alias("grade"))  # noqa: E731 - two annotators
    return evaluate.merge_judgments(one(2, 1), one(3, 2))


@register("judging_progress", WITH + ", p as (select distinct qid as need, doc_id from (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from bm) where rank <= 20), j as (select q.qid as need, tok.doc_id from q join tok on q.term = tok.term where zone = 'headline' group by q.qid, tok.doc_id) select p.need, count(j.doc_id) as judged, count(*) as total from p left join j on j.need = p.need and j.doc_id = p.doc_id group by p.need")
def judging_progress(spark, d):
    i, q = idx(spark, d, keep=True), q_exact(spark)
    done = match.hits(i.post, q.select("qid", "idx", "term"), "headline").select(F.col("qid").alias("need"), "doc_id").distinct()
    return evaluate.progress(evaluate.pool(match.top(rank.bm25(q, i), 20), 20), done)


_EXPANDED = [("h1", "nahar safai"), ("h2", "mandi samiti"), ("h3", "canal bridge")]


def _expanded(spark, d) -> DataFrame:
    """Variants of the words of the Roman queries, weighed by the language of each word."""
    q = rank.exact_query(spark.createDataFrame(_EXPANDED, "qid string, query string"))
    words = languages(spark, d, q.select(F.col("term").alias("word"))).select("word", "en")
    return q, rewrite.weighted_variants(words, _vocab(spark, d))


_EXPANDED_SQL = with_sql(_EXPANDED) + f", {_ENGLISH}, w5 as (select distinct term as word, term as low, {_EN.format(w='term')} as en from q), {_variants_sql('w5')}"


@register("expanded_bm25", _EXPANDED_SQL + ", ex as (select qid, idx, term, max(weight) as weight from (select qid, idx, term, 1.0 as weight from q union all select q.qid, q.idx, va.term, va.weight from q join va on va.word = q.term where length(q.term) >= 2 and not regexp_matches(q.term, '[0-9]') and va.weight >= 0.05) group by qid, idx, term), eq as (select qid, term, sum(weight) as qtf from ex group by qid, term), eb as (" + _BM.format("eq") + ") " + _TOP.format("eb"))
def expanded_bm25(spark, d):
    q, variants = _expanded(spark, d)
    full = rewrite.index_query(rewrite.expand(q, variants), "none")
    return r6(match.top(rank.bm25(full, idx(spark, d, keep=True)), 10), "score").withColumn("rank", F.col("rank").cast("long"))


@register("translated_query", "select * from (values ('t1', 0, 'school', 1.0, 'exact'), ('t1', 0, 'स्कूल', 0.54, 'xling'), ('t1', 0, 'भवन', 0.36, 'xling'), ('t1', 4, 'city', 1.0, 'exact'), ('t2', 0, 'canal', 1.0, 'exact'), ('t2', 0, 'नहर', 0.9, 'xling'), ('t2', 1, 'water', 1.0, 'exact'), ('t2', 1, 'पानी', 0.9, 'xling')) v(qid, idx, term, weight, source)")
def translated_query(spark, d):
    q = rank.exact_query(spark.createDataFrame([("t1", "school building in the city"), ("t2", "canal water")], "qid string, query string"))
    dic = spark.createDataFrame([("school building", "स्कूल", 0.6), ("school building", "भवन", 0.4), ("canal", "नहर", 1.0), ("water", "पानी", 1.0)], "phrase string, term string, weight double")
    langs = q.select(F.col("term").alias("word")).distinct().withColumn("en", F.lit(0.9))
    return r6(rewrite.translate(q, dic, langs, ("in", "the")), "weight")


@register("lsh_candidates", None)
def lsh_candidates(spark, d):
    return dedup.candidates(dedup.signatures(dedup.members_of(table(spark, d, "articles"))))


@register("corrected_queries", _EXPANDED_SQL + ", la as (select q.qid, q.idx as pos, va.term, va.weight from q join va on va.word = q.term where va.weight > 0), co as (select a.term as a, b.term as b, count(*) as c from (select distinct la.qid, la.pos, la.term, tf.doc_id from la join tf on tf.term = la.term) a join (select distinct la.qid, la.pos, la.term, tf.doc_id from la join tf on tf.term = la.term) b on a.qid = b.qid and b.pos = a.pos + 1 and a.doc_id = b.doc_id group by a.qid, a.pos, a.term, b.term), cx as (select a, b, max(c) as c from co group by a, b), pt as (select x.qid, x.term as t0, y.term as t1, ln(x.weight) + ln(y.weight) + ln(1 + coalesce(cx.c, 0)) as s from la x join la y on x.qid = y.qid and x.pos = 0 and y.pos = 1 left join cx on cx.a = x.term and cx.b = y.term), be as (select * from pt qualify row_number() over (partition by qid order by round(s, 9) desc) = 1), si as (select qid, pos, term from la where qid not in (select qid from be) qualify row_number() over (partition by qid, pos order by weight desc, term) = 1) select qid, 0 as pos, t0 as term from be union all select qid, 1, t1 from be union all select qid, pos, term from si")
def corrected_queries(spark, d):
    """The variants of a query's words that go best together, by the documents that hold both."""
    q, variants = _expanded(spark, d)
    lattice = q.select("qid", F.col("idx").alias("pos"), F.col("term").alias("word")).join(variants, "word").select("qid", "pos", "term", "weight")
    post = index.restrict(idx(spark, d, keep=True), lattice.select("term")).post.select("term", "doc_id").distinct()
    at = lattice.select("qid", "pos", "term").join(post, "term")
    a, b = at.select("qid", "pos", F.col("term").alias("a"), "doc_id"), at.select("qid", (F.col("pos") - 1).alias("pos"), F.col("term").alias("b"), "doc_id")
    cooc = a.join(b, ["qid", "pos", "doc_id"]).groupBy("qid", "pos", "a", "b").agg(F.count("*").alias("cooc")).groupBy("a", "b").agg(F.max("cooc").alias("cooc"))
    return rewrite.viterbi(lattice, cooc)


# ------------------------------------------------------------------ streaming twins on events


@register("stream_counts", "select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2")
def stream_counts(spark, d):
    """The hourly counts of a stream over the table, run to its end; each trigger overwrites the whole small result."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(_folder_of(spark, d, "events", root))
    x = stream.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour").groupBy("event_type", F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")
    q = x.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _folder_of(spark, d: str, name: str, root: str) -> str:
    """A folder that a file stream may read: the table itself if it is a folder, else a copy in the shared folder."""
    path = f"{d}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path
    spark.read.parquet(path).write.parquet(f"{root}/{name}")
    return f"{root}/{name}"


@register("burst_score", "with x as (select event_id, event_type as category, ts, count(*) over (partition by event_type order by ts range between interval 1 hour preceding and current row) as c1, count(*) over (partition by event_type order by ts range between interval 6 hour preceding and current row) as c6 from events where event_type is not null and event_type <> 'general') select event_id, c1, c6, round(c1 / (c6 / 6 + 1), 6) as score, case when c1 / (c6 / 6 + 1) > 2 then 'Q0' else 'Q1' end as tier from x")
def burst_score(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("category"), "ts")
    return r6(crawl.burst_scores(e), "score").select("event_id", "c1", "c6", "score", "tier")


@register("politeness_schedule", "with x as (select event_id, user_id, epoch_us(ts) / 1e6 as a, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events) select event_id, round(8.0 * i + max(a - 8.0 * i) over (partition by user_id order by a, event_id rows between unbounded preceding and current row), 3) as start from x")
def politeness_schedule(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("host"), (Wb.micros(F.col("ts")) / 1e6).alias("arrive"), F.col("event_id").alias("seq"))
    return crawl.polite_schedule(e).select("event_id", F.round("start", 3).alias("start"))


@register("ewma_rate", "with recursive h as (select event_type as k, date_trunc('hour', ts) as t, count(*) as n from events group by 1, 2), s as (select k, epoch(t)::double as t, n::double as n, row_number() over (partition by k order by t) as i from h), r as (select k, t, 1.0::double as rate, i from s where i = 1 union all select s.k, s.t, 0.3 * s.n / ((s.t - r.t) / 3600.0) + 0.7 * r.rate, s.i from r join s on s.k = r.k and s.i = r.i + 1) select k as source, cast(t as bigint) as ts, round(rate, 6) as rate, round(greatest(1800.0, least(21600.0, 1800.0 / greatest(rate, 0.0833))), 3) as interval from r")
def ewma_rate(spark, d):
    h = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("ts")).agg(F.count("*").alias("delta_n"))
    return crawl.ewma(h).select("source", "ts", F.round("rate", 6).alias("rate"), F.round("interval", 3).alias("interval"))


@register("seen_urls", f"select distinct url from (select {url_sql('url')} as url from fetched where url is not null) u where url <> '' and not regexp_matches(lower(url), '{'|'.join(x.replace('.', '[.]') for x in (*Wb.SKIP_DOMAINS, *Wb.SKIP_PATTERNS))}')")
def seen_urls(spark, d):
    return crawl.seen_once(table(spark, d, "fetched").where("url is not null").select("url"))


@register("hourly_counts", "select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def hourly_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select("event_type", F.col("w.start").alias("hour"), "n", "value")


@register("sessions_30m", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as s from events), y as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from x) select user_id, min(ts) as first, count(*) as n from y group by user_id, g")
def sessions_30m(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first"), "n")


@register("host_backoff", "with e as (select user_id as host, event_id as seq, case when event_id % 5 = 0 then 200 when event_id % 97 = 1 then 403 else 429 end as status from events), g as (select *, sum((status = 200)::int) over (partition by host order by seq) as g, max((status = 403)::int) over (partition by host order by seq) as bad from e), r as (select *, sum((status = 429)::int) over (partition by host, g order by seq) as run from g) select host, seq, status, case when status = 429 then least(64.0, 2.0 * pow(2, run - 1)) else 0.0 end as wait, bad = 1 as shut from r")
def host_backoff(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, 200).when(F.pmod(F.col("event_id"), F.lit(97)) == 1, 403).otherwise(429).alias("status"))
    return crawl.host_backoff(e, width=512)


def _ready(f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict:
    from siftspark.plans import experiments  # noqa: F401 - registers its queries

    return {k: _ready(f) for k, f in _REG.items()}


def oracle_sql() -> dict[str, str]:
    from siftspark.plans import experiments  # noqa: F401

    return dict(_SQL)
