"""Text functions as native column expressions; Python only where no built-in exists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("none", "light", "aggr", "auto")
WORD = r"[\p{L}\p{M}\p{Nd}]+"

# Inflectional suffixes of the published light stemmer of Ramanathan and Rao (2003),
# as suffix length: (least length of the word, suffixes).
LIGHT_SUFFIXES = {
    5: (7, "ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां"),
    4: (6, "ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां"),
    3: (5, "ाकर ाइए ाईं ाया ेगी ेगा ोगी ोगे ाने ाना ाते ाती ाता तीं ाओं ाएं ुओं ुएं ुआं"),
    2: (4, "कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें"),
    1: (3, "ो े ू ु ी ि ा"),
}
# Suffixes of the aggressive stemmer.
AGGRESSIVE_SUFFIXES = "ाइयाँ ाइयों ाइयां ाओंगी ाओंगे ाएंगी ाएंगे ियाँ ियों ियां ाऊंगी ाऊंगा ाएगी ाएगा ाइए ाइया ाती ाते ाता ाने ाना ाकर ायी ाये ाया ाइ ाई ाए ाओ ाऊ िया िये ियो ीं ों ें ाँ ां ा ि ी ु ू े ै ो"
# Stop words.
STOPWORDS = ("के", "में", "है", "की", "से", "को", "कर", "और", "पर", "का", "हैं", "रह", "हो", "ने", "भी")
# Words that are both English and romanised Hindi.
AMBIGUOUS = ("main", "to", "hi", "is", "me", "us", "do", "he", "the", "or")
# Letter classes of the lecture's Soundex; 0 separates.
SOUNDEX_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "01230120022455012623010202")
# Consonant classes of the script-agnostic code.
ROMAN_UNITS = {"chh": "2", "ch": "2", "sh": "8", "kh": "1", "gh": "1", "th": "3", "dh": "3", "ph": "9", "bh": "9", "jh": "2", "rh": "6"}
ROMAN_LETTERS = ("kqgxcjyztdnmrlshpbvwf", "111122223345678899999")
DEVANAGARI_CLASSES = ("कखगघचछजझयटठडढतथदधङञणनमरलळसशषहपफबभव", "1111222223333333344445677888899999")


def nfc(c: Column) -> Column:
    """Canonical composition, by the ICU library that ships with Spark; null stays null."""
    return F.when(c.rlike(r"[^\x00-\x{2FF}]|[\x{300}-\x{36F}]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))).otherwise(c)


def normalize(c: Column, compose: bool = True) -> Column:
    """NFC, lower case, no joiners, one spelling of Hindi, single blanks. Empty for white space only; null stays null."""
    s = F.translate(F.lower(nfc(c) if compose else c), "‌‍", "")
    s = F.replace(s, F.lit("हिंदी"), F.lit("हिन्दी"))
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def tokenize(c: Column) -> Column:
    """Runs of letters, marks and decimal digits; empty array for empty text, null for null."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def is_stopword(c: Column) -> Column:
    return c.isin(*STOPWORDS)


def light_stem(c: Column) -> Column:
    """Strips the longest suffix whose length condition the word meets."""
    out = None
    for n, (least, suffixes) in LIGHT_SUFFIXES.items():
        hit = (F.char_length(c) >= least) & c.rlike("(" + "|".join(suffixes.split()) + ")$")
        cut = F.left(c, F.char_length(c) - n)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def aggressive_stem(c: Column) -> Column:
    """Strips the longest suffix that leaves two characters or more."""
    out = None
    for n in range(5, 0, -1):
        some = [x for x in AGGRESSIVE_SUFFIXES.split() if len(x) == n]
        if some:
            hit = (F.char_length(c) >= n + 2) & c.rlike("(" + "|".join(some) + ")$")
            cut = F.left(c, F.char_length(c) - n)
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def stem(c: Column, mode: str, auto: Column | None = None) -> Column:
    """Term of a word in a mode; ``auto`` is a map column from word to canonical form. Unknown modes are an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "light":
        return light_stem(c)
    if mode == "aggr":
        return aggressive_stem(c)
    return F.coalesce(F.try_element_at(auto, c), c) if mode == "auto" and auto is not None else c


def analyze(c: Column, mode: str = "none", auto: Column | None = None) -> Column:
    """Terms of a text in order of position."""
    return F.transform(tokenize(normalize(c)), lambda w: stem(w, mode, auto))


def script(c: Column) -> Column:
    return F.when(c.rlike(r"[\x{0900}-\x{097F}]"), "devanagari").otherwise("roman")


def language_weights(c: Column, english: Column, protected: Column) -> Column:
    """struct(hi, hinglish, en) of a word; ``english``, ``protected``: arrays of words (the lexicons are parameters)."""
    w = F.lower(c)
    weights = lambda hi, hing, en: F.struct(F.lit(hi).alias("hi"), F.lit(hing).alias("hinglish"), F.lit(en).alias("en"))
    return (
        F.when(script(c) == "devanagari", weights(1.0, 0.0, 0.0))
        .when(w.isin(*AMBIGUOUS), weights(0.0, 0.5, 0.5))
        .when(F.array_contains(protected, w), weights(0.0, 0.9, 0.1))
        .when(F.array_contains(english, w), weights(0.0, 0.1, 0.9))
        .otherwise(weights(0.0, 0.9, 0.1))
    )


def soundex(c: Column) -> Column:
    """The lecture's Soundex: h, w, y and vowels separate equal codes. Empty if there is no ASCII letter."""
    s = F.regexp_replace(F.lower(c), "[^a-z]", "")
    codes = F.regexp_replace(F.translate(s, *SOUNDEX_LETTERS), r"(.)\1+", "$1")
    rest = F.replace(F.substring(codes, 2, 1000), F.lit("0"), F.lit(""))
    return F.when(s == "", "").otherwise(F.concat(F.upper(F.left(s, F.lit(1))), F.rpad(F.left(rest, F.lit(3)), 3, "0")))


def consonant_code(c: Column) -> Column:
    """Script-agnostic consonant classes 1 to 9, vowels dropped, runs collapsed; nuktas are ignored, an anusvara is 5 before a labial, else 4."""
    roman = F.lower(c)
    for unit, digit in ROMAN_UNITS.items():
        roman = F.replace(roman, F.lit(unit), F.lit(digit))
    roman = F.regexp_replace(F.translate(roman, *ROMAN_LETTERS), "[^1-9]", "")
    deva = F.regexp_replace(c, "़", "")
    deva = F.regexp_replace(F.regexp_replace(deva, "[ंँ](?=[पफबभम])", "म"), "[ंँ]", "न")
    deva = F.regexp_replace(F.translate(deva, *DEVANAGARI_CLASSES), "[^1-9]", "")
    return F.regexp_replace(F.when(script(c) == "devanagari", deva).otherwise(roman), r"(.)\1+", "$1")


def kgrams(c: Column, k: int = 2) -> Column:
    """Distinct k-grams of the word between two $ marks; the whole marked word if it is no longer than k."""
    marked = F.concat(F.lit("$"), c, F.lit("$"))
    parts = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))
    return bind(marked, lambda s: F.when(F.char_length(s) <= k, F.array(s)).otherwise(parts(s)))


def bind(c: Column, f) -> Column:
    """``f`` of a column that is computed once, however often ``f`` uses it within lambdas."""
    return F.transform(F.array(c), f)[0]


def shingles(c: Column, n: int = 4) -> Column:
    """Distinct n-word shingles (white-space words); a shorter text is one shingle, a wordless one has none, null gives none."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), " "), lambda x: x != "")
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n)))))
    return bind(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.concat_ws(" ", w))).otherwise(runs(w)))


def content_hash(c: Column) -> Column:
    """MD5 of the text with white space collapsed."""
    return F.md5(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")).cast("binary"))


def minhash_coefficients(count: int = 64, seed: int = 42, prime: int = 2147483647) -> list[tuple[int, int]]:
    """(a, b) of each hash function, from Python's seeded generator."""
    import random

    r = random.Random(seed)
    return [(r.randint(1, prime - 1), r.randint(0, prime - 1)) for _ in range(count)]


def minhash(sets: Column, count: int = 64, seed: int = 42, prime: int = 2147483647) -> Column:
    """Signature of an array of shingles; zeros for an empty one."""
    h = F.transform(sets, lambda s: F.crc32(s.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)))
    one = lambda a, b: F.array_min(F.transform(h, lambda x: (x * F.lit(a) + F.lit(b)) % F.lit(prime)))
    each = [one(a, b) for a, b in minhash_coefficients(count, seed, prime)]
    return F.when(F.size(sets) == 0, F.array_repeat(F.lit(0).cast("long"), count)).otherwise(F.array(*each))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty words."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    least = F.least(F.char_length(a), F.char_length(b))
    return F.when(least == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


# Romanisation of Devanagari.
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऍ": "e", "ऑ": "o", "ऎ": "e", "ऒ": "o"}
SIGNS = {"ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॅ": "e", "ॉ": "o", "ॆ": "e", "ॊ": "o"}
CONSONANTS = {"क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "ळ": "l", "श": "sh", "ष": "sh", "स": "s", "ह": "h"}
NUKTA = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f", "य": "y"}
_UNITS = re.compile("([क-हळ]़?)|([अ-ऌऍ-औ])|([ा-ौॅॆॊ])|([०-९])|(.)", re.S)


def romanize_word(word: str) -> str:
    """Latin spelling of a Devanagari word: inherent a, homorganic nasal, final a dropped."""
    import unicodedata

    word = unicodedata.normalize("NFD", word)
    out, inherent = [], False
    for m in _UNITS.finditer(word):
        cons, vowel, sign, digit, other = m.groups()
        if sign:
            out.append(SIGNS.get(sign, ""))
            inherent = False
            continue
        if other == "्":
            inherent = False
            continue
        if inherent:
            out.append("a")
            inherent = False
        if cons:
            out.append(NUKTA.get(cons[0], CONSONANTS.get(cons[0], "")) if len(cons) > 1 else CONSONANTS.get(cons, ""))
            inherent = True
        elif vowel:
            out.append(VOWELS.get(vowel, ""))
        elif digit:
            out.append(str("०१२३४५६७८९".index(digit)))
        elif other in "ंँ":
            out.append("m" if word[m.end() : m.end() + 1] in tuple("पफबभम") else "n")
        elif other == "ः":
            out.append("h")
        elif other != "़":
            out.append(other)
    return "".join(out)


@F.pandas_udf(T.StringType())
def romanize(s: pd.Series) -> pd.Series:
    """Column form of romanize_word; null stays null."""
    return s.map(romanize_word, na_action="ignore")


def align(a: str, b: str, costs: dict | None = None, default: float = 1.0) -> tuple[float, list[tuple[str, str]]]:
    """(cost, operations) of the cheapest edit of ``a`` into ``b``.

    Operations are pairs (from, to), '' for nothing. Equal letters are free, a
    pair in ``costs`` has its cost, others ``default``. At equal cost a
    substitution goes before a deletion, a deletion before an insertion.
    """
    price = (lambda x, y: 0.0 if x == y else costs.get((x, y), default)) if costs else (lambda x, y: 0.0 if x == y else default)
    rows = [[0.0]]
    for y in b:
        rows[0].append(rows[0][-1] + price("", y))
    for i, x in enumerate(a, 1):
        row = [rows[i - 1][0] + price(x, "")]
        for j, y in enumerate(b, 1):
            row.append(min(rows[i - 1][j - 1] + price(x, y), rows[i - 1][j] + price(x, ""), row[j - 1] + price("", y)))
        rows.append(row)
    i, j, ops = len(a), len(b), []
    while i or j:
        if i and j and abs(rows[i][j] - rows[i - 1][j - 1] - price(a[i - 1], b[j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            ops.append((a[i], b[j]))
        elif i and abs(rows[i][j] - rows[i - 1][j] - price(a[i - 1], "")) < 1e-9:
            i -= 1
            ops.append((a[i], ""))
        else:
            j -= 1
            ops.append(("", b[j]))
    return rows[-1][-1], ops[::-1]


def weighted_distance(costs: dict, default: float = 1.0):
    """A pandas UDF (a, b) -> cost of the cheapest edit under a small table of costs."""

    @F.pandas_udf(T.DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else align(x, y, costs, default)[0] for x, y in zip(a, b)], dtype="float64")

    return distance


def snippet(text: Column, terms: Column, words: int = 28) -> Column:
    """The first sentence that holds a term (lower case), else the first words."""
    sentences = F.split(text, r"(?<=[।.!?])\s+")
    hit = F.filter(sentences, lambda s: F.exists(terms, lambda t: F.contains(F.lower(s), t)))
    return F.when(F.size(hit) > 0, hit[0]).otherwise(F.concat_ws(" ", F.slice(F.split(F.trim(text), r"(?U)\s+"), 1, words)))


def highlight(text: Column, terms: list[str], before: str = "**", after: str = "**") -> Column:
    """Whole words of ``terms`` between marks, whatever their case."""
    alternatives = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{Nd}}])({alternatives})(?![\p{{L}}\p{{M}}\p{{Nd}}])", f"{before}$1{after}") if terms else text


def headline_key(c: Column) -> Column:
    """NFC without nuktas, lower case."""
    return F.replace(F.lower(nfc(c)), F.lit("़"), F.lit(""))


def bilingual_parts(c: Column) -> Column:
    """struct(hindi, english) of a headline "hindi - english"; nulls if there is no Latin tail."""
    has = c.rlike(r"^.*\S\s-\s[A-Za-z].*$") & c.rlike(r"[\x{0900}-\x{097F}]")
    return F.struct(F.when(has, F.regexp_extract(c, r"^(.*?)\s-\s([A-Za-z].*)$", 1)).alias("hindi"), F.when(has, F.regexp_extract(c, r"^(.*?)\s-\s([A-Za-z].*)$", 2)).alias("english"))
