"""Query rewriting: spelling-tolerant expansion, translation, dictionary mining, edit costs, stem classes, context correction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.operators.match import small
from siftspark.session import cut


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, df, canon, code, soundex, grams) of a term table (term, df)."""
    canon = F.when(X.script(F.col("term")) == "devanagari", X.romanize("term")).otherwise(F.lower("term"))
    v = terms.select("term", "df", canon.alias("canon"))
    return v.withColumns({"code": X.consonant_code(F.col("term")), "soundex": X.soundex(F.col("canon")), "grams": X.kgrams(F.col("canon"))})


def english_lexicon(post: DataFrame, langs: DataFrame, least: int = 3, times: float = 2.0) -> DataFrame:
    """(word): Roman words of ``least`` or more English documents that stand in at least ``times`` the share of English documents as of romanised Hindi ones. langs: (doc_id, lang)."""
    en, latin = F.lower("lang") == "en", F.lower("lang") == "hi-latn"
    count = lambda c: F.count(F.when(c, 1))
    n = langs.agg(count(en).alias("n_en"), count(latin).alias("n_latin"))
    w = post.where(F.col("term").rlike("^[a-z]+$")).select("term", "doc_id").distinct().join(langs, "doc_id").groupBy(F.col("term").alias("word")).agg(count(en).alias("en"), count(latin).alias("latin"))
    share = lambda c, total: F.col(c) / F.greatest(F.col(total), F.lit(1))
    return w.join(F.broadcast(n)).where((F.col("en") >= least) & (share("en", "n_en") >= times * share("latin", "n_latin"))).select("word")


def classify_words(words: DataFrame, english: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(word, hi, hinglish, en): language weights of words; english, protected: lexicons (word). Words in both count as romanised Hindi."""
    w = words.select("word").distinct().withColumn("low", F.lower("word"))
    x = w.join(english.select(F.col("word").alias("low")).distinct().withColumn("e", F.lit(True)), "low", "left")
    if protected is not None:
        x = x.join(protected.select(F.col("word").alias("low")).distinct().withColumn("p", F.lit(True)), "low", "left").withColumn("e", F.col("e") & F.col("p").isNull())
    deva, odd = X.script(F.col("word")) == "devanagari", F.col("low").isin(*X.AMBIGUOUS)
    pick = lambda a, b, c, d: F.when(deva, a).when(odd, b).when(F.coalesce("e", F.lit(False)), c).otherwise(d)
    return x.select("word", pick(1.0, 0.0, 0.0, 0.0).alias("hi"), pick(0.0, 0.5, 0.1, 0.9).alias("hinglish"), pick(0.0, 0.5, 0.9, 0.1).alias("en"))


def kgram_candidates(words: DataFrame, vocab: DataFrame, limit: int = 50) -> DataFrame:
    """(word, term, jaccard, rank): terms that share bigrams with a word (word, grams), best Jaccard first.

    The max(5 * limit, 200) terms with most shared bigrams are compared.
    """
    g = vocab.select("term", F.size("grams").alias("nt"), F.explode("grams").alias("gram"))
    w = words.select("word", F.size("grams").alias("nw"), F.explode("grams").alias("gram"))
    c = g.join(small(w), "gram").groupBy("word", "term", "nw", "nt").agg(F.count("*").alias("c"))
    most = c.withColumn("i", F.row_number().over(W.partitionBy("word").orderBy(F.desc("c"), "term"))).where(F.col("i") <= max(5 * limit, 200))
    j = most.select("word", "term", (F.col("c") / (F.col("nw") + F.col("nt") - F.col("c"))).alias("jaccard"))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("word").orderBy(F.desc("jaccard"), "term"))).where(F.col("rank") <= limit)


def phonetic_candidates(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, term): the same consonant code or the same Soundex; words: (word, code, soundex)."""
    by = lambda c: vocab.where(F.col(c) != "").select("term", c).join(small(words.where(F.col(c) != "").select("word", c)), c).select("word", "term")
    return by("code").union(by("soundex")).distinct()


def softmax(score: Column, temperature: float, *by: str) -> Column:
    """Weights that add up to 1 within the group; lower scores weigh more. All rows of a group are few (its k best)."""
    l = F.collect_list(score).over(W.partitionBy(*by))
    low = F.array_min(l)
    return F.exp(-(score - low) / temperature) / F.aggregate(l, F.lit(0.0), lambda s, x: s + F.exp(-(x - low) / temperature))


def weighted_variants(words: DataFrame, vocab: DataFrame, costs: dict | None = None, k: int = 5, df_weight: float = 1.5, code_bonus: float = 4.0, temperature: float = 1.0, pool: int = 50, unseen: float = 1.0) -> DataFrame:
    """(word, term, weight): Devanagari spellings of Roman words.

    Candidates by bigrams and sound pass a gate on plain edit distance (.35 of
    the length if the word is English by .6 or more, else .4 of it plus 1); the
    score is the learned distance less ``code_bonus`` for the same code and
    ``df_weight`` * ln(1 + df); the k best get softmax weights. words: (word, en).
    """
    w = words.select("word", "en", F.lower("word").alias("canon")).withColumns({"code": X.consonant_code(F.col("word")), "soundex": X.soundex(F.col("word")), "grams": X.kgrams(F.lower("word"))})
    cand = kgram_candidates(w, vocab, pool).select("word", "term").union(phonetic_candidates(w, vocab)).distinct()
    x = cand.join(small(w.select("word", "en", F.col("canon").alias("wc"), F.col("code").alias("wcode"))), "word").join(vocab.select("term", "df", "canon", "code"), "term").where(X.script(F.col("term")) == "devanagari")
    n = F.char_length("wc")
    x = x.where(F.levenshtein("wc", "canon") <= F.when(F.col("en") >= 0.6, 0.35 * n).otherwise(0.4 * n + 1))
    x = x.withColumn("dist", X.weighted_distance(costs, unseen)("wc", "canon") if costs else F.levenshtein("wc", "canon").cast("double"))
    score = F.col("dist") - F.when(F.col("code") == F.col("wcode"), code_bonus).otherwise(0.0) - df_weight * F.log(1 + F.col("df"))
    x = x.withColumn("score", F.round(score, 9)).withColumn("r", F.row_number().over(W.partitionBy("word").orderBy("score", "term"))).where(F.col("r") <= k)
    return x.select("word", "term", F.round(softmax(F.col("score"), temperature, "word"), 4).alias("weight"))


def match_words(words: DataFrame, vocab: DataFrame, matcher: str, costs: dict | None = None, k: int = 10, unseen: float = 1.0) -> DataFrame:
    """(word, term, rank) by 'levenshtein', 'soundex', 'code' or 'learned': an equal key first, then edit distance, then the term."""
    if matcher not in ("levenshtein", "soundex", "code", "learned"):
        raise ValueError(f"unknown matcher {matcher!r}")
    w = words.select("word").distinct().withColumns({"code": X.consonant_code(F.col("word")), "soundex": X.soundex(F.col("word")), "grams": X.kgrams(F.lower("word"))})
    cand = kgram_candidates(w, vocab, 50).select("word", "term").union(phonetic_candidates(w, vocab)).distinct()
    x = cand.join(small(w.select("word", F.col("code").alias("wcode"), F.col("soundex").alias("wsound"))), "word").join(vocab.select("term", "canon", "code", "soundex"), "term")
    lev = F.levenshtein(F.lower("word"), F.col("canon")).cast("double")
    key = {"levenshtein": F.lit(0.0), "soundex": (F.col("soundex") != F.col("wsound")).cast("double"), "code": (F.col("code") != F.col("wcode")).cast("double"), "learned": F.lit(0.0)}[matcher]
    dist = X.weighted_distance(costs, unseen)(F.lower("word"), F.col("canon")) if matcher == "learned" and costs else lev
    return x.withColumn("d", key + dist / 100).withColumn("rank", F.row_number().over(W.partitionBy("word").orderBy("d", "term"))).where(F.col("rank") <= k).select("word", "term", "rank")


def expand(q: DataFrame, variants: DataFrame, aliases: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """``q`` with variants (word, term, weight) of its words as source 'phonetic'; words of one letter or with digits stay alone, no term comes twice for a word; aliases (word, term) in the vocabulary get weight 1."""
    w = q.where("source = 'exact'").where((F.char_length("term") >= 2) & ~F.col("term").rlike(r"\d")).select("qid", "idx", F.col("term").alias("word"))
    new = w.join(variants, "word").select("qid", "idx", "term", F.col("weight").cast("double").alias("weight"), F.lit("phonetic").alias("source"))
    if aliases is not None:
        known = aliases if vocab is None else aliases.join(vocab.select("term"), "term", "left_semi")
        new = new.unionByName(w.join(known, "word").select("qid", "idx", "term", F.lit(1.0).alias("weight"), F.lit("phonetic").alias("source")))
    every = q.unionByName(new)
    order = W.partitionBy("qid", "idx", "term").orderBy((F.col("source") != "exact").cast("int"), F.desc("weight"))
    return every.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")


def index_query(q: DataFrame, mode: str, forms: DataFrame | None = None, min_phonetic: float = 0.05) -> DataFrame:
    """Terms as the index has them: weak phonetic variants dropped, stemmed, the largest weight per term kept; forms (lower, term) adds the index's spellings of an ASCII term."""
    x = q.where((F.col("source") != "phonetic") | (F.col("weight") >= min_phonetic)).withColumn("term", X.stem(F.col("term"), mode))
    if forms is not None:
        x = x.unionByName(x.join(small(forms.withColumnRenamed("term", "form")), F.lower("term") == F.col("lower")).select("qid", "idx", F.col("form").alias("term"), "weight", "source"))
    best = F.max_by(F.struct("weight", "source"), F.struct("weight", F.when(F.col("source") == "exact", 1).otherwise(0)))
    return x.groupBy("qid", "idx", "term").agg(best.alias("b")).select("qid", "idx", "term", "b.weight", "b.source")


def translate(q: DataFrame, dictionary: DataFrame, langs: DataFrame, stopwords: tuple[str, ...] = (), longest: int = 4) -> DataFrame:
    """Translations of Roman words by a dictionary (phrase, term, weight), longest phrase first, left to right.

    langs: (word, en). A phrase's translations stand at its first word with
    source 'xling', weighted by its mean English probability; its other words
    are dropped, and so are untranslated stop words of English probability .5
    or more. One task per query; a query is a handful of words.
    """
    words = q.where("source = 'exact'").select("qid", "idx", F.col("term").alias("word")).join(small(langs), "word", "left").withColumn("en", F.coalesce("en", F.lit(0.0)))
    spans = words.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "en"))).alias("ws"))
    parts = F.flatten(F.transform("ws", lambda x, i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(x["idx"].alias("idx"), n.alias("n"), F.concat_ws(" ", F.transform(F.slice(F.col("ws"), i + 1, n), lambda y: y["word"])).alias("phrase"), F.aggregate(F.slice(F.col("ws"), i + 1, n), F.lit(0.0), lambda s, y: s + y["en"]).alias("en"), F.forall(F.slice(F.col("ws"), i + 1, n), lambda y: y["en"] > 0).alias("roman"), (F.size(F.slice(F.col("ws"), i + 1, n)) == n).alias("whole")))))
    each = spans.select("qid", F.explode(parts).alias("p")).select("qid", "p.*").where("roman and whole")
    known = each.join(small(dictionary.select("phrase").distinct()), "phrase", "left_semi")
    lists = known.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("idx", (-F.col("n")).alias("m"), "n", "phrase", "en"))).alias("l"))
    start = F.struct(F.lit(-1).alias("until"), F.array().cast("array<struct<idx:int,n:int,phrase:string,en:double>>").alias("got"))
    pick = F.aggregate("l", start, lambda acc, x: F.when(x["idx"] > acc["until"], F.struct((x["idx"] + x["n"] - 1).alias("until"), F.concat(acc["got"], F.array(F.struct(x["idx"].cast("int").alias("idx"), x["n"].cast("int").alias("n"), x["phrase"].alias("phrase"), x["en"].cast("double").alias("en")))).alias("got"))).otherwise(acc))
    used = lists.select("qid", F.explode(pick["got"]).alias("g")).select("qid", "g.*")
    new = used.join(small(dictionary), "phrase").select("qid", "idx", "term", (F.col("weight") * F.col("en") / F.col("n")).alias("weight"), F.lit("xling").alias("source"))
    covered = used.select("qid", "idx", "n", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("n") - 1)).alias("i")).select("qid", F.col("i").alias("idx"), (F.col("i") > F.col("idx")).alias("inner"))
    x = q.join(covered, ["qid", "idx"], "left").join(small(langs.withColumnRenamed("word", "term")), "term", "left")
    stop = F.col("term").isin(*stopwords) & (F.coalesce("en", F.lit(0.0)) >= 0.5) & F.col("inner").isNull() if stopwords else F.lit(False)
    kept = x.where(~F.coalesce("inner", F.lit(False)) & ~stop).select("qid", "idx", "term", "weight", "source")
    return kept.unionByName(new)


def mine_dictionary(pairs: DataFrame, id_col: str = "doc_id", min_pairs: int = 3, min_dice: float = 0.5, common: float = 0.05) -> DataFrame:
    """(english, hindi, pairs, dice): word pairs of aligned headlines (id, hindi, english) by Dice's coefficient; words in more than ``common`` of the pairs are left out; the best Hindi word per English word."""
    p = pairs.where("hindi is not null and english is not null").select(F.col(id_col).alias("pid"), "hindi", "english").dropDuplicates(["pid"])
    words = lambda c: F.array_distinct(X.tokenize(F.lower(F.col(c))))
    total = p.agg(F.count("*").alias("total"))
    side = lambda c: p.select("pid", F.explode(words(c)).alias(c))
    e, h = side("english"), side("hindi")
    keep = lambda s, c: s.groupBy(c).agg(F.count("*").alias(f"n_{c}")).join(F.broadcast(total)).where((F.col(f"n_{c}") >= min_pairs) & (F.col(f"n_{c}") <= F.greatest(common * F.col("total"), F.lit(min_pairs)))).drop("total")
    e, h = e.join(keep(e, "english"), "english"), h.join(keep(h, "hindi"), "hindi")
    both = e.join(h, "pid").groupBy("english", "hindi", "n_english", "n_hindi").agg(F.count("*").alias("pairs"))
    d = both.withColumn("dice", 2 * F.col("pairs") / (F.col("n_english") + F.col("n_hindi"))).where((F.col("pairs") >= min_pairs) & (F.col("dice") >= min_dice))
    best = d.groupBy("english").agg(F.min(F.struct(F.round(-F.col("dice"), 9), -F.col("pairs"), F.col("hindi"))).alias("k"), F.max("dice").alias("dice"))
    return best.select("english", F.col("k.hindi").alias("hindi"), (-F.col("k.col2")).alias("pairs"), "dice")


def learn_costs(pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """(src, dst, cost, unseen): edit costs from pairs (canonical, human) by rounds of aligning, counting and estimating.

    All aligned letters count, equal ones too: the cost of src to dst is
    -ln((c + 1) / (n + V)), n being the operations of src and V the number of
    different targets plus one. ``unseen``, the same in all rows, is the cost of
    any other edit, one pseudo-count against the most frequent source. Pairs are
    aligned on the executors; only the table of letter pairs, bounded by the
    alphabets, travels between rounds.
    """
    costs, unseen, out = {}, 1.0, None
    for _ in range(rounds):
        def ops(batches, costs=dict(costs), unseen=unseen):
            for pdf in batches:
                rows = [op for a, b in zip(pdf["canonical"], pdf["human"]) if a is not None and b is not None for op in X.align(a, b, costs, unseen)[1]]
                yield pd.DataFrame(rows, columns=["src", "dst"])

        counts = pairs.select("canonical", "human").mapInPandas(ops, "src string, dst string").groupBy("src", "dst").agg(F.count("*").alias("c"))
        by_src = counts.groupBy("src").agg(F.sum("c").alias("n"))
        vocab = counts.agg((F.countDistinct("dst") + 1).alias("v"))
        most = by_src.agg(F.max("n").alias("most"))
        x = counts.join(F.broadcast(by_src), "src").join(F.broadcast(vocab)).join(F.broadcast(most))
        out = cut(x.select("src", "dst", (-F.log((F.col("c") + 1) / (F.col("n") + F.col("v")))).alias("cost"), F.log(F.col("most") + F.col("v")).alias("unseen")))
        rows = list(out.toLocalIterator())
        costs, unseen = {(r.src, r.dst): r.cost for r in rows}, rows[0].unseen if rows else 1.0
    return out


def cost_matrix(costs: DataFrame, default: float = 1.0) -> DataFrame:
    """(src, dst, cost) of every pair of the 26 letters; 0 on the diagonal."""
    spark = costs.sparkSession
    letters = spark.range(26).select(F.chr(F.col("id") + 97).alias("src"))
    costs = costs.select("src", "dst", "cost")
    grid = letters.select("src", F.explode(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.chr(i + 97))).alias("dst"))
    return grid.join(costs, ["src", "dst"], "left").select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.coalesce("cost", F.lit(default))).alias("cost"))


# Endings of inflected forms (by the ending of their base), of plurals and oblique cases, of verbs, and of forms that are no base.
A_FORMS, I_FORMS = ("े", "ों", "ें"), ("ियाँ", "ियों", "याँ", "यों")
PLURALS = ("ों", "ें", "ओं", "एं", "याँ", "यों", "ियों", "ियाँ", "ाओं", "ाएं", "ाएँ")
VERBALS = ("ना", "ने", "नी", "ता", "ती", "ते", "कर", "के", "गा", "गी", "गे")
OBLIQUE = ("ों", "ें", "ओं", "एं", "याँ", "यों", "ियों", "ाओं", "ाएं", "ाएँ")


def surface_forms(words: DataFrame, stem: Column, least: int = 3) -> DataFrame:
    """(stem, word, freq): forms (doc_id, word: one row per occurrence) of ``least`` characters or more that are no numbers and differ from their stem."""
    w = words.where((F.char_length("word") >= least) & ~F.col("word").rlike(r"^\p{Nd}+$")).withColumn("stem", stem).where("word <> stem")
    return w.groupBy("stem", "word").agg(F.count("*").alias("freq"))


def _form_pairs(forms: DataFrame, words: DataFrame, count: str) -> DataFrame:
    """(stem, form_a, form_b, a, b, docs_a, docs_b, common): pairs of forms of one stem in order of letters, their counts, documents and common documents."""
    dd = words.select("doc_id", "word").distinct().join(forms.select("stem", "word"), "word")
    df = dd.groupBy("stem", "word").agg(F.count("*").alias("docs"))
    f = forms.join(df, ["stem", "word"])
    side = lambda x: f.select("stem", F.col("word").alias(f"form_{x}"), F.col(count).alias(x), F.col("docs").alias(f"docs_{x}"))
    pairs = side("a").join(side("b"), "stem").where("form_a < form_b")
    by = lambda x: dd.select("stem", "doc_id", F.col("word").alias(f"form_{x}"))
    both = by("a").join(by("b"), ["stem", "doc_id"]).where("form_a < form_b").groupBy("stem", "form_a", "form_b").agg(F.count("*").alias("common"))
    return pairs.join(both, ["stem", "form_a", "form_b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))


def stem_candidates(words: DataFrame, stem: Column, min_class: int = 5, min_form: int = 2) -> DataFrame:
    """(stem, freq, forms, similarity, least_similarity, collision, verdict): classes of surface forms graded STRONG, GOOD, REVIEW or REJECT.

    A class needs ``min_class`` occurrences and two forms; one form of fewer than
    ``min_form`` leaves it out. Graded by the mean and the smallest likeness of
    its forms and the largest share of documents that two of them have in common.
    """
    forms = surface_forms(words, stem)
    size = forms.groupBy("stem").agg(F.sum("freq").alias("freq"), F.count("*").alias("forms"), F.min("freq").alias("least"))
    size = size.where((F.col("freq") >= min_class) & (F.col("forms") >= 2) & (F.col("least") >= min_form))
    pairs = _form_pairs(forms.join(size.select("stem"), "stem", "left_semi"), words, "freq").withColumn("s", X.edit_similarity(F.col("form_a"), F.col("form_b")))
    share = F.col("common") / (F.col("docs_a") + F.col("docs_b") - F.col("common"))
    g = pairs.groupBy("stem").agg(F.avg("s").alias("similarity"), F.min("s").alias("least_similarity"), F.max(share).alias("collision"))
    s, l, c = F.round("similarity", 9), F.round("least_similarity", 9), F.round("collision", 9)
    verdict = F.when((s >= 0.65) & (l >= 0.50) & (c <= 0.10), "STRONG").when((s >= 0.55) & (l >= 0.40) & (c <= 0.20), "GOOD").when((s >= 0.45) & (c <= 0.30), "REVIEW").otherwise("REJECT")
    return size.drop("least").join(g, "stem").withColumn("verdict", verdict)


def stem_collisions(words: DataFrame, stem: Column, min_class: int = 5, min_form: int = 2) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs) of the collision report.

    classes: (stem, forms, class_docs, collision, overlap, verdict), SAFE,
    LIKELY_SAFE, REVIEW or UNSAFE by the largest share of the rarer form's
    documents that also hold the other form. pairs: (stem, form_a, form_b, both,
    rate). A class needs ``min_class`` (form, document) pairs; forms in fewer than
    ``min_form`` documents are left out.
    """
    d = words.select("doc_id", "word").distinct()
    forms = surface_forms(d, stem, 2)
    big = forms.groupBy("stem").agg(F.sum("freq").alias("c")).where(F.col("c") >= min_class)
    forms = forms.join(big.select("stem"), "stem", "left_semi").where(F.col("freq") >= min_form)
    pairs = _form_pairs(forms, d, "freq").select("stem", "form_a", "form_b", "common", (F.col("common") / F.least("docs_a", "docs_b")).alias("rate"))
    docs = d.join(forms.select("stem", "word"), "word").groupBy("stem").agg(F.countDistinct("doc_id").alias("class_docs"), F.countDistinct("word").alias("forms"))
    c = pairs.groupBy("stem").agg(F.max("rate").alias("collision"), F.sum("common").alias("overlap"))
    k = F.round("collision", 9)
    verdict = F.when(k == 0, "SAFE").when(k <= 0.10, "LIKELY_SAFE").when(k <= 0.30, "REVIEW").otherwise("UNSAFE")
    return docs.join(c, "stem").select("stem", "forms", "class_docs", "collision", "overlap", verdict.alias("verdict")), pairs


def related(base: Column, form: Column) -> Column:
    """Whether two forms of one light stem are plausible forms of one word: an inflection of the base, or few edits beside a common beginning."""
    ends = lambda c, n: F.left(c, F.char_length(c) - n)
    one_of = lambda c, xs: F.array_contains(F.array(*xs), c)
    inflected = base.endswith("ा") & one_of(form, [F.concat(ends(base, 1), F.lit(x)) for x in A_FORMS]) | base.endswith("ी") & one_of(form, [F.concat(ends(base, 1), F.lit(x)) for x in I_FORMS])
    for x in PLURALS:
        root = ends(form, len(x))
        inflected = inflected | form.endswith(x) & ((root == base) | (F.concat(root, F.lit("ा")) == base) | (F.concat(root, F.lit("ी")) == base))
    inflected = inflected | (F.char_length(base) >= 3) & one_of(form, [F.concat(base, F.lit(x)) for x in VERBALS])
    dist, prefix = F.levenshtein(base, form), X.common_prefix(base, form)
    longest = F.greatest(F.char_length(base), F.char_length(form))
    close = (prefix >= 3) & (dist <= 2) | (prefix >= 4) & (dist <= 3) | (dist <= 2) & (dist / longest <= 0.30)
    return (base == form) | (X.light_stem(base) == X.light_stem(form)) & (inflected | (F.char_length(base) >= 4) & (F.char_length(form) >= 4) & close)


def base_score(form: Column, freq: Column) -> Column:
    """How much a form looks like the base of its class: by its ending, its frequency (to 5,000) and its length."""
    ending = F.when(form.endswith("ा"), 3.0).when(form.endswith("ी"), 1.5).otherwise(0.0) - F.when(form.rlike("(" + "|".join(OBLIQUE) + ")$"), 2.0).otherwise(0.0)
    return F.least(freq, F.lit(5000)) / 5000.0 + ending - F.char_length(form) * 0.03


def auto_stems(words: DataFrame, min_similarity: float = 0.67, max_collision: float = 0.25, listed: int = 10) -> DataFrame:
    """(word, stem_form): forms of safe STRONG classes to the canonical form of their class.

    A class is safe if its ``listed`` most frequent forms have the class's light
    stem, are similar enough, and some two of them are related. The canonical
    form is the one with the best ``base_score`` (ties: frequency, letters); only
    forms related to it follow it. Two stems have no form in common, so no form
    gets two canonical ones.
    """
    stem = X.light_stem(F.col("word"))
    ok = stem_candidates(words, stem).where((F.col("verdict") == "STRONG") & (F.round("similarity", 9) >= min_similarity) & (F.round("collision", 9) <= max_collision)).select("stem")
    forms = surface_forms(words, stem).join(ok, "stem", "left_semi")
    forms = forms.withColumn("i", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("freq"), "word"))).where(F.col("i") <= listed)
    a, b = forms.select("stem", F.col("word").alias("x"), F.col("freq").alias("fx"), F.col("i").alias("ix")), forms.select("stem", F.col("word").alias("y"), F.col("i").alias("iy"))
    safe = a.join(b, "stem").where("ix < iy").where(related(F.col("x"), F.col("y"))).select("stem").distinct()
    best = F.row_number().over(W.partitionBy("stem").orderBy(F.desc(F.round(base_score(F.col("word"), F.col("freq")), 9)), F.desc("freq"), "word"))
    canon = forms.withColumn("b", best).where("b = 1").join(safe, "stem", "left_semi").select("stem", F.col("word").alias("stem_form"))
    return forms.join(canon, "stem").where("word <> stem_form").where(related(F.col("stem_form"), F.col("word"))).select("word", "stem_form")


def viterbi(lattice: DataFrame, cooc: DataFrame, lam: float = 1.0) -> DataFrame:
    """(qid, pos, term): the joint best variants of a query's words.

    lattice: (qid, pos, term, weight); cooc: (a, b, cooc). A path scores
    ln(weight) plus lam * ln(1 + cooc) of neighbours; the first maximum wins.
    One task per query; pairs are joined before, so a task holds its own only.
    """
    kind = dict(lattice.dtypes)["qid"]
    nxt = lattice.select("qid", (F.col("pos") - 1).alias("pos"), F.col("term").alias("b")).distinct()
    pairs = lattice.select("qid", "pos", F.col("term").alias("a")).join(nxt, ["qid", "pos"]).join(cooc, ["a", "b"]).groupBy("qid").agg(F.collect_list(F.struct("pos", "a", "b", F.col("cooc").cast("double").alias("c"))).alias("pairs"))
    rows = lattice.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("weight")).alias("m"), "term"))).alias("nodes")).join(pairs, "qid", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                c = {(p["pos"], p["a"], p["b"]): p["c"] for p in (r.pairs if r.pairs is not None else [])}
                steps: dict = {}
                for n in r.nodes:
                    steps.setdefault(n["pos"], []).append((n["term"], -n["m"]))
                best, back, last = {}, [], None
                for pos in sorted(steps):
                    now, via = {}, {}
                    for term, weight in steps[pos]:
                        base = math.log(weight) if weight > 0 else -1e9
                        if not best:
                            now[term], via[term] = base, None
                        else:
                            prev = max(best, key=lambda a: best[a] + lam * math.log1p(c.get((last, a, term), 0.0)))
                            now[term], via[term] = base + best[prev] + lam * math.log1p(c.get((last, prev, term), 0.0)), prev
                    back.append((pos, via))
                    best, last = now, pos
                term = max(best, key=best.get) if best else None
                for pos, via in reversed(back):
                    out.append((r.qid, pos, term))
                    term = via[term]
            yield pd.DataFrame(out, columns=["qid", "pos", "term"])

    return rows.mapInPandas(run, f"qid {kind}, pos int, term string")
