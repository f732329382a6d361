import pytest
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.functions import web as Wb


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, X.normalize(F.col("a")), a="  हिंदी‌  ABC x ") == "हिन्दी abc x"
    assert one(spark, X.normalize(F.col("a")), a="é") == "é"
    assert one(spark, X.normalize(F.col("a")), a=" \t") == ""
    assert one(spark, X.normalize(F.lit(None).cast("string"))) is None


def test_tokenize(spark):
    assert one(spark, X.tokenize(F.col("a")), a="आज का-मौसम, Delhi_2 १२!") == ["आज", "का", "मौसम", "Delhi", "2", "१२"]
    assert one(spark, X.tokenize(F.col("a")), a="") == []


def test_stems(spark):
    assert one(spark, X.light_stem(F.col("a")), a="लड़कियों") == "लड़क"
    assert one(spark, X.light_stem(F.col("a")), a="का") == "का"
    assert one(spark, X.aggressive_stem(F.col("a")), a="बोलो") == "बोल"
    with pytest.raises(ValueError):
        X.stem(F.col("a"), "yass")


@pytest.mark.parametrize("word, code", [("Ashcraft", "A226"), ("Hermann", "H655"), ("Rubin", "R150"), ("Lee", "L000"), ("123", "")])
def test_soundex(spark, word, code):
    assert one(spark, X.soundex(F.col("a")), a=word) == code


@pytest.mark.parametrize("a, b", [("भूकंप", "bhukamp"), ("हिंदी", "hindi"), ("पत्ता", "patta")])
def test_consonant_code_is_the_same_in_both_scripts(spark, a, b):
    assert one(spark, X.consonant_code(F.col("a")), a=a) == one(spark, X.consonant_code(F.col("a")), a=b)


def test_kgrams_and_shingles(spark):
    assert sorted(one(spark, X.kgrams(F.col("a")), a="kal")) == ["$k", "al", "ka", "l$"]
    assert one(spark, X.shingles(F.col("a")), a="a b  c d e") == ["a b c d", "b c d e"]
    assert one(spark, X.shingles(F.col("a")), a="a b") == ["a b"]
    assert one(spark, X.shingles(F.col("a")), a=" ") == []


def test_minhash_by_hand(spark):
    import zlib

    words = ["a b c d", "b c d e"]
    got = one(spark, X.minhash(F.array(*map(F.lit, words))))
    want = [min((a * (zlib.crc32(w.encode()) & 0x7FFFFFFF) + b) % 2147483647 for w in words) for a, b in X.minhash_coefficients()]
    assert got == want


def test_align():
    cost, ops = X.align("kal", "kaal")
    assert cost == 1 and ops.count(("", "a")) == 1
    assert X.align("ab", "ba", {("a", "b"): 0.1, ("b", "a"): 0.1})[0] == pytest.approx(0.2)


def test_romanize():
    assert X.romanize_word("हिंदी") == "hindii"
    assert X.romanize_word("ज़मीन") == "zamiin"
    assert X.romanize_word("भूकंप") == "bhuukamp"


@pytest.mark.parametrize(
    "raw, normal",
    [
        ("HTTP://WWW.X.com:80/amp/a/?utm_source=1&q=a%20b&q=2&ref=z#f", "http://www.x.com/a?q=a+b"),
        ("https://x.in:443/story/amp", "https://x.in/story"),
        ("https://x.in/a;p?b=", "https://x.in/a"),
        ("", ""),
    ],
)
def test_url_normalize(spark, raw, normal):
    assert one(spark, Wb.url_normalize(F.col("a")), a=raw) == normal


def test_doc_id_and_skip(spark):
    assert one(spark, Wb.doc_id_of(F.col("a"), F.lit("s")), a="https://x.in/rain-123456.html") == "s_123456"
    assert len(one(spark, Wb.doc_id_of(F.col("a"), F.lit("s")), a="https://x.in/rain")) == 10
    assert one(spark, Wb.should_skip(F.col("a")), a="https://x.in/Rashifal/x")


@pytest.mark.parametrize("raw, ist", [("2026-03-18 19:22:07", "2026-03-18T19:22:07+05:30"), ("18 Mar 2026, 07:22 PM", "2026-03-18T19:22:00+05:30"), ("2026-05-02T20:02:55Z", "2026-05-03T01:32:55+05:30"), ("soon", None), ("0000-00-00", None)])
def test_parse_date(spark, raw, ist):
    assert one(spark, Wb.ist_string(Wb.parse_date(F.col("a"))), a=raw) == ist


def test_location(spark):
    states, cities = {"up": "uttar-pradesh", "delhi": "delhi"}, {"lucknow": "uttar-pradesh", "agra": "uttar-pradesh"}
    at = lambda u: tuple(one(spark, Wb.location(F.col("a"), states, cities), a=u))
    assert at("https://x.in/delhi/new-delhi-city-rain-1.html") == ("delhi", "new-delhi")
    assert at("https://x.in/lucknow-weather-12") == ("uttar-pradesh", "lucknow")
    assert at("https://x.in/news") == (None, None)


def test_page_type(spark):
    kind = lambda h, u=None: one(spark, Wb.page_type(F.col("h"), F.col("u")), h=h, u=u or "https://x.in/a/b/some-long-story-here-123456.html")
    assert kind("आज का राशिफल") == "horoscope"
    assert kind("Breaking News") == "listing"
    assert kind("पुल टूटा - bridge breaks in news today") == "article"
    assert kind("पुल", "https://x.in/city/agra") == "listing"
