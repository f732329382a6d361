import json

import pytest
from pyspark.sql import functions as F

from siftspark.sources import articles, web
from siftspark.streaming import crawl


def test_articles_errors_name_their_line(spark, tmp_path):
    good = {"doc_id": "a", "headline": "h", "body": "b", "keywords": ["x"]}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(good), "", "{bad", "[1]", json.dumps({"doc_id": "c", "headline": 3, "body": "b"})]))
    rows = articles.read_articles(spark, str(tmp_path / "a.jsonl"), strict=False).orderBy("line_no").collect()
    assert [(r.line_no, r.error) for r in rows] == [(1, None), (3, "line 3: not valid JSON"), (4, "line 4: not an object"), (5, "line 5: field headline is missing or no string")]
    assert rows[0].keywords == ["x"]
    with pytest.raises(Exception, match="line 3"):
        articles.read_articles(spark, str(tmp_path / "a.jsonl")).select("doc_id", "error").collect()


def test_runs_judgments_queries(spark, tmp_path):
    run = spark.createDataFrame([("q1", "d1", 1, 2.5)], "qid string, doc_id string, rank int, score double")
    articles.write_run(run, str(tmp_path / "run"), "bm25")
    assert [tuple(r) for r in articles.read_run(spark, str(tmp_path / "run")).collect()] == [("q1", "d1", 1, 2.5, "bm25")]
    (tmp_path / "q.txt").write_text("n1 0 d1 1\nn1 0 d1 2\nn1 0 d2 0\n")
    assert {(r.doc_id, r.grade) for r in articles.read_judgments(spark, str(tmp_path / "q.txt")).collect()} == {("d1", 2), ("d2", 0)}
    (tmp_path / "q.md").write_text("text\n```tsv\nqid\tneed_id\tform\tquery\nq1\tn1\thindi\tपुल\n```\nx\ty\tz\tw\n")
    assert [r.qid for r in articles.read_queries(spark, str(tmp_path / "q.md")).collect()] == ["q1"]
    (tmp_path / "d.tsv").write_text("Rain\tबारिश:3|वर्षा\n")
    assert {(r.term, r.weight) for r in articles.read_dictionary(spark, str(tmp_path / "d.tsv")).collect()} == {("बारिश", 0.75), ("वर्षा", 0.25)}


def test_robots(spark):
    txt = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: badbot\nDisallow: /\nSitemap: https://x.in/s.xml"
    files = spark.createDataFrame([("x.in", txt, 200), ("y.in", "", 403), ("z.in", "", 500)], "host string, content string, status int")
    urls = spark.createDataFrame([("x.in", "https://x.in/private/a"), ("x.in", "https://x.in/private/open/b"), ("x.in", "https://x.in/a.pdf"), ("x.in", "https://x.in/a.pdf?x"), ("y.in", "https://y.in/"), ("z.in", "https://z.in/")], "host string, url string")
    ok = {r.url: r.allowed for r in web.can_fetch(urls, web.robots_rules(files, "MyBot")).collect()}
    assert ok == {"https://x.in/private/a": False, "https://x.in/private/open/b": True, "https://x.in/a.pdf": False, "https://x.in/a.pdf?x": True, "https://y.in/": False, "https://z.in/": True}
    assert not any(r.allowed for r in web.can_fetch(urls.where("host = 'x.in'"), web.robots_rules(files, "badbot")).collect())
    assert web.robots_sitemaps(files).first().sitemap == "https://x.in/s.xml"


def test_sitemaps(spark):
    xml = "<urlset><url><loc>https://x.in/a?b=1&amp;c</loc><lastmod>2026-01-01</lastmod><news:news><news:title><![CDATA[T & U]]></news:title></news:news><priority>0.5</priority></url><url><loc>https://x.in/cut</loc><lastm"
    rows = web.sitemap_entries(spark.createDataFrame([(xml,), ("<sitemapindex><sitemap><loc>https://x.in/s-2024.xml</loc></sitemap></sitemapindex>",), ("no xml",)], "xml string")).orderBy("url").collect()
    assert [(r.url, r.is_index, r.is_news, r.title, r.priority) for r in rows] == [("https://x.in/a?b=1&c", False, True, "T & U", 0.5), ("https://x.in/cut", False, False, None, None), ("https://x.in/s-2024.xml", True, False, None, None)]


def test_extract():
    body = "This is the long body of the article that is given in JSON-LD, with more than eighty characters in it."
    ld = json.dumps({"@graph": [{"@type": "WebPage"}, {"@type": "NewsArticle", "headline": "H", "articleBody": body, "keywords": "a, b"}]})
    a = web.extract(f'<html><head><script type="application/ld+json">{ld}</script></head><body><p>short</p></body></html>')
    assert (a["headline"], a["body"], a["keywords"], a["tier"]) == ("H", body, ["a", "b"], "json-ld")
    p = "A paragraph of the story that is long enough to be kept."
    dom = web.extract(f"<h1>Title</h1><nav><p>{'menu ' * 10}</p></nav><div class='share'><p>{'share ' * 9}</p></div><div><p>{p}</p><p>{p}</p><p>By Someone Or Other, a reporter</p></div><a href='/x'>y</a>")
    assert (dom["headline"], dom["body"], dom["links"]) == ("Title", p, ["/x"])
    assert web.extract("<p>x</p>") is None and web.extract(None) is None and web.extract("<<<") is None


def test_polite_schedule_equals_simulation(spark):
    import random

    r = random.Random(2)
    rows, want = [], {}
    for h in "ab":
        at, last = 0.0, None
        for i in range(30):
            at += r.random() * 12
            last = at if last is None else max(at, last + 8)
            rows.append((h, i, at))
            want[h, i] = last
    got = crawl.polite_schedule(spark.createDataFrame(rows, "host string, seq int, arrive double")).collect()
    assert all(abs(x.start - want[x.host, x.seq]) < 1e-6 for x in got)


def test_burst_by_hand(spark):
    rows = [("c", i * 60) for i in range(5)] + [("c", 5 * 3600 + i * 60) for i in range(11)] + [("general", 0), (None, 0)]
    df = spark.createDataFrame(rows, "category string, s long").withColumn("ts", F.timestamp_seconds("s"))
    last = crawl.burst_scores(df).orderBy(F.desc("ts")).first()
    assert (last.c1, last.c6, last.tier) == (11, 16, "Q0") and abs(last.score - 11 / (16 / 6 + 1)) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", float(i * 3600), float(i % 4)) for i in range(8)]
    df = spark.createDataFrame(rows, "source string, ts double, delta_n double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    s = crawl.ewma_stream(stream).writeStream.format("memory").queryName("ewma").outputMode("append").trigger(availableNow=True).start()
    s.awaitTermination()
    got = sorted((r.ts, round(r.rate, 9)) for r in spark.sql("select * from ewma").collect())
    want = sorted((r.ts, round(r.rate, 9)) for r in crawl.ewma(df).collect())
    assert got == want


def test_take_first_stops_at_the_limit(spark, tmp_path):
    spark.range(50).select(F.col("id").cast("string").alias("doc_id")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    crawl.take_first(stream, str(tmp_path / "out"), 20, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_backoff(spark):
    rows = [("h", 0, 429), ("h", 1, 429), ("h", 2, 200), ("h", 3, 429), ("h", 4, 403), ("h", 5, 200)]
    got = crawl.host_backoff(spark.createDataFrame(rows, "host string, seq int, status int")).orderBy("seq").collect()
    assert [(r.wait, r.shut) for r in got] == [(2.0, False), (4.0, False), (0.0, False), (2.0, False), (0.0, True), (0.0, True)]


def test_hot_keys_cut_into_spans(spark):
    import random

    r = random.Random(6)
    at, rows = 0.0, []
    for i in range(400):
        at += r.choice([0.0, 30.0, 900.0])
        rows.append(("hot", at, float(r.randint(0, 9)), i, r.choice([200, 429, 429, 403 if i > 380 else 429])))
    df = spark.createDataFrame(rows, "source string, ts double, delta_n double, seq int, status int")
    a, b = ({(x.ts, round(x.rate, 9)) for x in crawl.ewma(df.dropDuplicates(["ts"]), width=w).collect()} for w in (500.0, 1e9))
    assert a == b
    h = df.withColumnsRenamed({"source": "host", "ts": "arrive"})
    a, b = ({(x.seq, round(x.start, 6)) for x in crawl.polite_schedule(h, width=w).collect()} for w in (60.0, 1e9))
    assert a == b
    a, b = ({tuple(x) for x in crawl.host_backoff(h, width=w).collect()} for w in (7, 1 << 30))
    assert a == b
    e = df.select(F.lit("k").alias("category"), F.timestamp_seconds("ts").alias("ts"))
    got = sorted((x.ts, x.c1, x.c6) for x in crawl.burst_scores(e).collect())
    t = sorted(x[1] for x in rows)
    want = [(sum(s - 3600 <= y <= s for y in t), sum(s - 21600 <= y <= s for y in t)) for s in t]
    assert [x[1:] for x in got] == want


def test_epochs_are_not_written_twice(spark, tmp_path):
    spark.range(30).select(F.col("id").cast("string").alias("doc_id")).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda cp: crawl.take_first(spark.readStream.schema("doc_id string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), 40, str(tmp_path / cp)).awaitTermination()
    run("a")
    run("b")  # a lost checkpoint: the same epoch again
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
