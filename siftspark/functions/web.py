"""Functions on urls, dates of pages and crawl-time features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("fbclid", "ref", "amp_js_v", "amp")
# Url parts of pages that are no articles.
SKIP_PATTERNS = ("/rashifal", "/astrology", "/horoscope", "/dharm", "/photo-gallery", "/photos", "/videos", "/video", "/web-stories", "/visual-stories", "/live-updates", "/cricket-scorecard", "/games", "/entertainment/web-series")
SKIP_DOMAINS = ("bbc.com", "news18.com", "ndtv.com", "ndtv.in")
# Names of wire agencies.
AGENCIES = ("पीटीआई", "भाषा", "वार्ता", "ANI", "PTI", "Univarta", "Bhasha")
# Marks of bot challenges.
CAPTCHA = ("cf-challenge-running", "challenge-platform", "cf-browser-verification", "captcha-delivery.com", "px-captcha", "distil_r_captcha", "attention required! | cloudflare", "<title>just a moment...</title>")
# Date formats of pages, tried in this order after ISO 8601.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "d MMM yyyy, h:mm a", "d MMM yyyy h:mm a", "MMMM d, yyyy h:mm a", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")


def url_parts(c: Column) -> dict[str, Column]:
    s = F.trim(c)
    take = lambda i: F.regexp_extract(s, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i)
    return {"scheme": F.lower(take(1)), "host": F.lower(take(2)), "path": F.regexp_replace(take(3), ";[^/]*$", ""), "query": take(4)}


def url_normalize(c: Column) -> Column:
    """One form of a url: lower-case scheme and host, no default port, no tracking parameters, no AMP path, no trailing slash, no fragment. Empty for null or blank."""
    p = url_parts(c)
    scheme = F.when(p["scheme"] == "", "https").otherwise(p["scheme"])
    host = F.when(scheme == "http", F.regexp_replace(p["host"], ":80$", "")).when(scheme == "https", F.regexp_replace(p["host"], ":443$", "")).otherwise(p["host"])
    path = F.regexp_replace(F.regexp_replace(p["path"], "^/amp(/|$)", "/"), "/amp/?$", "")
    path = F.when((F.char_length(path) > 1) & path.endswith("/"), F.left(path, F.char_length(path) - 1)).otherwise(path)
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x.rlike("^[^=]+=.+") & ~x.startswith("utm_") & ~F.substring_index(x, "=", 1).isin(*TRACKING))
    first = F.filter(pairs, lambda x, i: F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: F.substring_index(y, "=", 1) == F.substring_index(x, "=", 1))) == 0)
    clean = F.transform(first, lambda x: F.concat(F.url_encode(F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1))), F.lit("="), F.url_encode(F.coalesce(F.try_url_decode(F.regexp_replace(x, "^[^=]*=", "")), F.regexp_replace(x, "^[^=]*=", "")))))
    query = F.concat_ws("&", clean)
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def host(c: Column) -> Column:
    return url_parts(c)["host"]


def source_key(c: Column, known: dict[str, str] | None = None) -> Column:
    """Source of a url: by the table of known domains (equal, then contained), else the host's second label from the right; 'unknown' without url."""
    h = host(c)
    out = F.when(F.coalesce(c, F.lit("")) == "", "unknown")
    for domain, key in (known or {}).items():
        out = out.when(h == domain, key)
    for domain, key in (known or {}).items():
        out = out.when(F.contains(h, F.lit(domain)), key)
    labels = F.split(h, "[.]")
    return out.otherwise(F.when(F.size(labels) >= 2, F.element_at(labels, F.greatest(F.size(labels) - 1, F.lit(1)))).otherwise(h))


def doc_id_of(url: Column, source: Column) -> Column:
    """source_number if the url's path has a number of 5 to 12 digits at the usual place, else source_hash."""
    n = F.regexp_extract(url, r"[-_/](\d{5,12})(?:\.html|\.cms|/|$)", 1)
    return F.concat(source, F.lit("_"), F.when(n != "", n).otherwise(F.left(F.md5(url.cast("binary")), F.lit(8))))


def should_skip(c: Column, patterns: tuple[str, ...] = SKIP_PATTERNS, domains: tuple[str, ...] = SKIP_DOMAINS) -> Column:
    s = F.lower(c)
    out = F.lit(False)
    for p in (*domains, *patterns):
        out = out | F.contains(s, F.lit(p))
    return out


def is_agency(c: Column) -> Column:
    out = F.lit(False)
    for a in AGENCIES:
        out = out | F.contains(c, F.lit(a))
    return F.coalesce(out, F.lit(False))


def is_captcha(html: Column) -> Column:
    """A bot challenge: a mark in the first 5000 characters of a page without article markup."""
    sample = F.lower(F.substring(html, 1, 5000))
    hit = F.lit(False)
    for m in CAPTCHA:
        hit = hit | F.contains(sample, F.lit(m))
    article = F.contains(html, F.lit("schema.org")) & (F.contains(html, F.lit("NewsArticle")) | F.contains(html, F.lit("BlogPosting"))) | F.contains(html, F.lit("<article"))
    return F.coalesce(~article & hit, F.lit(False))


def is_listing_url(c: Column) -> Column:
    """No path, a live page, or a short path without digits whose last part has at most three words."""
    path = F.regexp_replace(url_parts(c)["path"], "^/+|/+$", "")
    parts = F.split(path, "/")
    return (path == "") | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/live/")) | (~path.rlike(r"\d") & (F.size(F.split(F.element_at(parts, -1), "-")) <= 3) & (F.size(parts) <= 3))


# Words of headlines by which pages are classed (nuktas dropped).
LISTING_WORDS = "सबसे ताजा खबर|ताजा समाचार|मुख्य और ताजा|samachar|news in hindi|hindi news|latest news|news today|today live|live updates|breaking news|ब्रेकिंग न्यूज|news, |न्यूज\\)"
HOROSCOPE_WORDS = "राशिफल|rashifal|horoscope|panchang|पंचांग"


def page_type(headline: Column, url: Column) -> Column:
    """'horoscope', 'listing' or 'article'; a Latin tail after " - " marks an article."""
    from siftspark.functions.text import headline_key

    h = headline_key(F.coalesce(headline, F.lit("")))
    return (
        F.when(h.rlike(HOROSCOPE_WORDS), "horoscope")
        .when(F.coalesce(headline, F.lit("")).rlike(r"\s-\s[a-z]"), "article")
        .when(h.rlike(LISTING_WORDS) | F.coalesce(is_listing_url(url), F.lit(False)), "listing")
        .otherwise("article")
    )


def parse_date(c: Column, zone: str = "+05:30") -> Column:
    """Timestamp of a page's date: ISO 8601 (without offset it is in ``zone``), then DATE_FORMATS; null if none fits."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), s).when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.concat(s, F.lit(zone))).when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00"), F.lit(zone)))
    tries = [iso.try_cast("timestamp")]
    for f in DATE_FORMATS:
        # the other formats need the session's parser; their local time is moved from the session zone to ``zone``
        tries.append(F.try_to_timestamp(F.concat(s, F.lit(" "), F.lit(zone)), F.lit(f + " xxx")))
    return F.coalesce(*tries)


def ist_string(ts: Column) -> Column:
    """Timestamp as an ISO string with the offset +05:30; for a session in UTC."""
    return F.date_format(ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss'+05:30'")


def location(url: Column, states: dict[str, str], cities: dict[str, str]) -> Column:
    """struct(state, city) named in a url's path.

    ``states``: slug to state; ``cities``: city to state (both parameters). A
    compound "new-delhi" goes first, then a part before "-city-", then whole
    parts of the path, then their words; a city gives its state.
    """
    path = F.regexp_replace(F.lower(url_parts(url)["path"]), r"\.[a-z0-9]+$", "")
    city_list, state_map, city_map = F.array(*map(F.lit, cities)), F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), F.create_map(*[F.lit(x) for kv in cities.items() for x in kv])
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: F.trim(x) != ""), lambda x: F.replace(x, F.lit("_"), F.lit("-")))
    words = F.filter(F.split(F.concat_ws("-", parts), "-"), lambda x: x != "")
    is_city = lambda x: F.array_contains(city_list, x)
    is_state = lambda x: F.map_contains_key(state_map, x)
    first = lambda xs, f: F.get(F.filter(xs, f), F.lit(0))
    delhi = path.rlike("new[-_]delhi")
    before = F.replace(F.regexp_extract(path, "/([a-z-]+)-city-", 1), F.lit("_"), F.lit("-"))
    city = F.coalesce(F.when(delhi, F.lit("new-delhi")), F.when(is_city(before), before), first(parts, lambda x: is_city(x) & ~is_state(x)), first(words, is_city))
    state = F.coalesce(F.when(delhi, F.lit("delhi")), F.element_at(state_map, first(parts, is_state)), F.element_at(state_map, first(words, lambda x: is_state(x) & ~is_city(x))))
    state = F.coalesce(state, F.element_at(city_map, city))
    return F.struct(state.alias("state"), F.when((state == "delhi") & city.isNull(), "delhi").otherwise(city).alias("city"))


def section(url: Column, mapping: dict[str, str], given: Column | None = None) -> Column:
    """Section by the given name (a key contained in it), else by the first word of the path that is a key, else 'general'."""
    keys = F.array(*map(F.lit, mapping))
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    words = F.filter(F.split(F.lower(url_parts(url)["path"]), "[/_-]"), lambda w: F.array_contains(keys, w))
    by_url = F.element_at(m, F.get(words, F.lit(0)))
    if given is None:
        return F.coalesce(by_url, F.lit("general"))
    hit = F.get(F.filter(keys, lambda k: F.contains(F.lower(F.trim(given)), k)), F.lit(0))
    return F.coalesce(F.element_at(m, hit), by_url, F.lit("general"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, of a timestamp with or without time zone (then in the session's)."""
    return F.unix_micros(ts.cast("timestamp"))


def recency(ts: Column, now: Column, tau_days: float = 7.0) -> Column:
    """exp(-age / tau), age in days and not below zero; 0 without a time."""
    age = (micros(now) - micros(ts)) / F.lit(86400e6)
    return F.coalesce(F.exp(-F.greatest(age, F.lit(0.0)) / tau_days), F.lit(0.0))


def utility(title: Column, section_: Column) -> Column:
    """Crawl-time utility of a url in 0 to 1."""
    s = F.lit(0.5) + F.when(section_.isin("national", "state", "weather", "politics"), 0.2).when(section_.isin("lifestyle", "entertainment"), -0.1).otherwise(0.0)
    n = F.size(F.filter(F.split(F.coalesce(title, F.lit("")), r"(?U)\s+"), lambda x: x != ""))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s + F.when(n >= 4, 0.1).otherwise(0.0)))
