"""Web sources: robots files, sitemaps, pages."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, pattern, allow, len, regex) that hold for ``agent`` in robots files (host, content[, status]).

    Groups are as in RFC 9309: user-agent lines in a row share the rules that
    follow. A group is the agent's if one name contains the other, else the
    groups of * hold. An empty Disallow allows all. Status 401 or 403 disallows
    all, other errors allow all.
    """
    status = F.col("status") if "status" in files.columns else F.lit(200)
    lines = files.withColumn("st", status).where("st between 200 and 299").select("host", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\r?\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").rlike("^[A-Za-z-]+\\s*:"))
    x = lines.select("host", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("k"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("v")).where("k in ('user-agent', 'allow', 'disallow')")
    by = W.partitionBy("host").orderBy("n")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(by), F.lit("")) != "user-agent")
    x = x.withColumn("s", starts.cast("int")).withColumn("g", F.sum("s").over(by))
    a = F.lower(F.lit(agent))
    names = x.where("k = 'user-agent'").select("host", "g", F.lower("v").alias("ua"))
    named = names.withColumn("own", (F.col("ua") != "*") & (F.col("ua") != "") & (F.contains(a, F.col("ua")) | F.contains(F.col("ua"), a)))
    has = named.groupBy("host").agg(F.max("own").alias("has"))
    groups = named.join(has, "host").where("(has and own) or (not has and ua = '*')").select("host", "g").distinct()
    r = x.where("k <> 'user-agent'").join(groups, ["host", "g"]).select("host", F.when(F.col("v") == "", "/").otherwise(F.col("v")).alias("pattern"), ((F.col("k") == "allow") | (F.col("v") == "")).alias("allow"))
    shut = files.withColumn("st", status).where("st in (401, 403)").select("host", F.lit("/").alias("pattern"), F.lit(False).alias("allow"))
    r = r.unionByName(shut).distinct()
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([.\\+?^\[\](){}|])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), F.when(F.col("pattern").endswith("$"), quoted).otherwise(F.regexp_replace(quoted, r"\$", r"\\$")))
    return r.select("host", "pattern", "allow", F.char_length("pattern").alias("len"), regex.alias("regex"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(host, sitemap) lines of robots files."""
    return files.select("host", F.explode(F.regexp_extract_all("content", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))).alias("sitemap")).distinct()


def can_fetch(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, url) with allowed: the longest matching pattern decides, a tie allows, no match allows."""
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    u = urls.select("host", "url").distinct().withColumn("p", F.when(path == "", "/").otherwise(path))
    best = u.join(rules, "host").where(F.rlike("p", F.col("regex"))).groupBy("host", "url").agg(F.max_by("allow", F.struct("len", "allow")).alias("allow"))
    return urls.join(best, ["host", "url"], "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """Entries of sitemaps (xml): (url, is_index, lastmod, publication_date, title, keywords, publication_name, language, changefreq, priority, is_news).

    Namespaces are ignored. Blocks are taken by pattern, so a malformed or cut
    file gives the entries that are whole, and the last <loc> of a cut one.
    """
    xml = F.regexp_replace(F.regexp_replace("xml", r"<(/?)[A-Za-z0-9_]+:", "<$1"), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    x = files.select(xml.alias("x"))
    blocks = x.select(F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<(?:url|sitemap)(?:\s[^>]*)?>(?:(?!<(?:url|sitemap)[\s>]).)*"), F.lit(0))).alias("b"))
    tag = lambda n: F.nullif(F.trim(F.regexp_extract("b", rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1)), F.lit(""))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    out = blocks.select(
        plain(tag("loc")).alias("url"), F.col("b").rlike("^<sitemap").alias("is_index"), tag("lastmod").alias("lastmod"), tag("publication_date").alias("publication_date"), plain(tag("title")).alias("title"),
        plain(tag("keywords")).alias("keywords"), plain(tag("name")).alias("publication_name"), tag("language").alias("language"), tag("changefreq").alias("changefreq"), tag("priority").try_cast("double").alias("priority"), F.col("b").rlike("<news[\\s>]").alias("is_news"),
    )
    return out.where("url is not null")


def is_archive(url: Column) -> Column:
    """An archive sitemap: a year or the word archive in its url."""
    return F.lower(url).rlike(r"archive|(?:19|20)\d{2}")


# Classes and ids of blocks that are no article text, and words that open bylines.
_SKIP_TAGS = {"script", "style", "nav", "footer", "aside", "header", "form", "noscript", "iframe", "figure", "button", "select"}
_SKIP_NAMES = re.compile(r"related|share|social|comment|advert|promo|newsletter|breadcrumb|byline|author|subscribe|footer|sidebar|recommend", re.I)
_BYLINE = re.compile(r"^\s*(?:by\s+[A-Z]|reported by|edited by|written by|लेखक\s*:|रिपोर्ट\s*:|संवाददाता\s*[:,]|द्वारा\s)", re.I)
_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


class Page(HTMLParser):
    """Collects what the extractor needs of a page in one pass: meta tags, JSON-LD, headings, text blocks, links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.ld: list[str] = []
        self.h1: list[str] = []
        self.title = ""
        self.paragraphs: list[str] = []
        self.divs: list[str] = []
        self.hrefs: list[str] = []
        self.stack: list[list] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if name and name not in self.meta:
                self.meta[name] = a.get("content", "")
        if tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
        if tag in _VOID:
            return
        ld = tag == "script" and "ld+json" in a.get("type", "")
        off = tag in _SKIP_TAGS and not ld or bool(_SKIP_NAMES.search(a.get("class", "") + " " + a.get("id", "")))
        if self.stack and tag in ("div", "section", "article", "p", "ul", "table"):
            for f in self.stack:
                f[4] = False  # holds a block, so it is no leaf
        self.stack.append([tag, [], off, ld, True])
        self.skip += off

    def handle_endtag(self, tag):
        if not any(f[0] == tag for f in self.stack):
            return
        while self.stack:
            name, parts, off, ld, leaf = self.stack.pop()
            self.skip -= off
            text = re.sub(r"\s+", " ", "".join(parts)).strip()
            if ld:
                self.ld.append("".join(parts))
            elif name == "title":
                self.title = self.title or text
            elif not self.skip and not off:
                if name == "h1" and text:
                    self.h1.append(text)
                elif name == "p" and len(text) >= 20:
                    self.paragraphs.append(text)
                elif name == "div" and leaf and len(text) >= 25:
                    self.divs.append(text)
            if self.stack and name in ("a", "span", "b", "i", "em", "strong", "u", "font", "mark", "small"):
                self.stack[-1][1].append("".join(parts))
            if name == tag:
                break

    def handle_data(self, data):
        if self.stack:
            self.stack[-1][1].append(data)


def _articles_of(value):
    """Article objects anywhere in a JSON-LD value."""
    if isinstance(value, list):
        for v in value:
            yield from _articles_of(v)
    elif isinstance(value, dict):
        kind = value.get("@type")
        if {"NewsArticle", "Article", "BlogPosting"} & set(kind if isinstance(kind, list) else [kind]):
            yield value
        yield from _articles_of(value.get("@graph", []))


def _text(v) -> str:
    if isinstance(v, list):
        return ", ".join(_text(x) for x in v if x)
    return str(v.get("name", "")) if isinstance(v, dict) else "" if v is None else str(v)


def extract(html: str | None) -> dict | None:
    """headline, body, date, section, keywords, links, tier of a page; None if there is no headline or fewer than 40 characters of body.

    JSON-LD goes first, then meta tags (never a description as body), then the
    page's own text: paragraphs, or leaf blocks if there are none; bylines and
    repeated blocks are left out.
    """
    if not html:
        return None
    p = Page()
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError):
        pass
    for f in list(p.stack):
        p.handle_endtag(f[0])
    own = {}
    for raw in p.ld:
        try:
            own = next(_articles_of(json.loads(raw, strict=False)), own)
        except ValueError:
            continue
    seen, blocks = set(), []
    for b in p.paragraphs or p.divs:
        if b not in seen and not _BYLINE.match(b):
            seen.add(b)
            blocks.append(b)
    body, tier = re.sub(r"<[^>]+>", " ", _text(own.get("articleBody"))).strip(), "json-ld"
    if len(body) < 80:
        dom = "\n".join(blocks)
        if len(dom) > len(body):
            body, tier = dom, "dom" if not own and "og:title" not in p.meta else "meta" if not own else "json-ld"
    headline = _text(own.get("headline")) or p.meta.get("og:title", "") or (p.h1[0] if p.h1 else "") or p.title
    if len(body) < 40 or not headline.strip():
        return None
    keywords = own.get("keywords") or p.meta.get("keywords", "") or p.meta.get("news_keywords", "")
    words = keywords if isinstance(keywords, list) else str(keywords).split(",")
    links = list(dict.fromkeys(p.hrefs))
    return {
        "headline": headline.strip(), "body": body, "date": _text(own.get("datePublished")) or p.meta.get("article:published_time") or None,
        "section": _text(own.get("articleSection")) or p.meta.get("article:section") or None, "keywords": [str(w).strip() for w in words if str(w).strip()], "links": links, "tier": tier,
    }


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the extracted fields; pages without an article are dropped."""
    fields = "headline string, body string, date string, section string, keywords array<string>, links array<string>, tier string"
    keep = [c for c in pages.columns if c not in ("headline", "body", "date", "section", "keywords", "links", "tier", html_col)]
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes if c in keep)

    def run(batches):
        for pdf in batches:
            got = [extract(h) for h in pdf[html_col]]
            ok = [g is not None for g in got]
            out = pdf.loc[ok, keep].reset_index(drop=True)
            for n in names:
                out[n] = [g[n] for g in got if g is not None]
            yield out[keep + names]

    return pages.select(*keep, html_col).mapInPandas(run, f"{kinds}, {fields}" if keep else fields)
