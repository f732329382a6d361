"""Problem 1: page boilerplate mixed with main content.

Pages are streams of lines. Lines that recur over pages are constants of a
template, the others fill slots (prose, list item, title). Per host a
union-free expression is inferred: streams are aligned one after the other with
the wrapper so far; a mismatch makes nodes optional, runs of one slot become a
repeated group. Every node counts how often it stood inside the main prose and
how often outside. Constants that stand inside only are subheads of stories;
constants that also stand outside are furniture wherever they are found.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.session import cut

#: Pages aligned in one task; hosts of any size are cut into blocks of about so many, whose wrappers are merged by FAN.
BLOCK = 256
FAN = 32
#: Pages on which a line is a constant, share of its places inside the prose from which a constant is a subhead, places from which that share is trusted.
RECURS, INSIDE, TRUSTED = 3, 0.975, 12
PROSE, ITEM, TITLE = SLOTS = "P", "L", "T"
_DIGITS = re.compile(r"[0-9०-९]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"(?<=[।.?!])[\"'”’)\]]*\s+")
_END = re.compile(r"[।.?!][\"'”’)\]]*$")
_NUMBERED = re.compile(r"^\W{0,2}\d{1,3}[.)]\s")
_ITEM = re.compile(r"^(?:[\W_]{1,3}\s?|\(?[0-9०-९a-z]{1,3}[.):]\s*)?[^\W\d_][^:–—|]{0,40}?\s?[:–—-]\s*[\d०-९][\d०-९.,/%\s]*(?:[^\W\d_]{1,12}\.?)?$")
_BARS = {"/", "|", "»", "›", ">", "•", "·", "-", "–", "//"}
_MARKED = re.compile(r"^[^\w]*[^:|»–—-]{2,24}\s*(?:[:|»]|\s[–—-])\s")
# Words of prompts, advertisements and notices; used only for constants seen too seldom for their places to tell.
_PROMPT = re.compile(r"subscri|follow|newsletter|sign in|log in|comment|share|tweet|advert|sponsor|copy link|download|app\b|alert|letter|cookie|accept|reject|agree|read more|rights reserved|more from|^ok$|^- ?ad ?-$|फ़ॉलो|फॉलो|न्यूज़लेटर|ईमेल डालें|शेयर|टिप्पणी|विज्ञापन के बाद|^विज्ञापन$|प्रायोजित|डाउनलोड|लॉग इन|स्वीकार|सहमत|सर्वाधिकार|°", re.I)


def host_of(url: str | None, source: str | None) -> str:
    """Host without www. or m.; without url the source; else empty."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://([^/?#]+)", url or "")
    return re.sub(r"^(?:www|m|amp)\.", "", m[1].lower()) if m else (source or "")


def site_pattern(host: str, title: str | None) -> re.Pattern | None:
    """Finds the names of a site: its title, and the host's first label with blanks anywhere."""
    label = host.split(".")[0]
    parts = [r"\s?".join(map(re.escape, label))] if len(label) >= 4 else []
    if title and title.strip():
        parts.append(re.escape(title.strip().lower()))
    return re.compile("|".join(sorted(parts, key=len, reverse=True)), re.I) if parts else None


def key_of(line: str, site: re.Pattern | None) -> str:
    """A line without case, runs of digits and the site's names."""
    s = _DIGITS.sub("0", _SPACE.sub(" ", line.strip().lower()))
    return site.sub("§", s) if site else s


def shape(line: str) -> str:
    """The slot that a line fills if it is no constant."""
    words = line.split()
    if _ITEM.match(line) and len(words) <= 8:
        return ITEM
    if _END.search(line) and len(words) >= 4 and not _NUMBERED.match(line):
        return PROSE
    if len(words) >= 24 and not _MARKED.match(line) and sum(w in _BARS for w in words) < 3:
        return PROSE
    return TITLE


def hash_of(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def segments(headline: str) -> list[str]:
    """Parts of a headline between separators."""
    return [x for x in re.split(r"\s*[|»«›·•]\s*|\s+[-–—]+\s+|\s*::\s*|:\s+|,\s+", headline) if x.strip()]


class Wrapper:
    """A union-free expression: nodes [token, pages, inside, optional, repeated] in order."""

    def __init__(self):
        self.nodes: list[list] = []
        self.pages = 0

    def add(self, tokens: list, inside: list, counts: list | None = None, pages: int = 1) -> None:
        """Align a stream (or the nodes of another wrapper) with the expression."""
        run, ins, cnt, rep = [], [], [], []
        for i, t in enumerate(tokens):
            if run and t == run[-1] and t in SLOTS:
                rep[-1] = True
                cnt[-1] += counts[i] if counts else 1
                ins[-1] += inside[i]
            else:
                run.append(t)
                ins.append(int(inside[i]))
                cnt.append(counts[i] if counts else 1)
                rep.append(False)
        keep = self._common([n[0] for n in self.nodes], run)
        matched, at, where = {i for i, _ in keep}, {n[0]: n for n in self.nodes}, dict((j, i) for i, j in keep)
        for i, n in enumerate(self.nodes):
            if i not in matched:
                n[3] = True
        out, last = [], 0
        for j, t in enumerate(run):
            if j in where:
                i = where[j]
                out += self.nodes[last:i]
                n = self.nodes[i]
                n[1] += cnt[j]
                n[2] += ins[j]
                n[4] |= rep[j]
                out.append(n)
                last = i + 1
            elif t in at and t not in SLOTS:  # a block that moved: its node stays where it is and is optional
                n = at[t]
                n[1] += cnt[j]
                n[2] += ins[j]
                n[3] = True
            elif t in SLOTS and out and out[-1][0] == t:
                out[-1][1] += cnt[j]
                out[-1][2] += ins[j]
                out[-1][4] = True
            elif t in SLOTS and sum(n[0] == t for n in out) + sum(n[0] == t for n in self.nodes[last:]) >= 8:
                n = next(n for n in [*out, *self.nodes[last:]] if n[0] == t)
                n[1] += cnt[j]
                n[2] += ins[j]
            else:
                node = [t, cnt[j], ins[j], self.pages > 0, rep[j]]
                at[t] = node
                out.append(node)
        out += self.nodes[last:]
        self.nodes = self._merged(out)
        self.pages += pages

    @staticmethod
    def _merged(nodes: list[list]) -> list[list]:
        """One node per constant, adjacent equal slots as one repeated group."""
        seen, out = {}, []
        for n in nodes:
            if out and out[-1][0] == n[0]:
                o = out[-1]
                o[1], o[2], o[3], o[4] = o[1] + n[1], o[2] + n[2], o[3] and n[3], True
            elif n[0] in seen and n[0] not in SLOTS:
                o = seen[n[0]]
                o[1], o[2], o[3] = o[1] + n[1], o[2] + n[2], True
            else:
                seen[n[0]] = n
                out.append(n)
        return out

    @staticmethod
    def _common(a: list, b: list) -> list[tuple[int, int]]:
        """Index pairs of an order-keeping match: constants, which stand once in ``a``, along their longest rising run; slots in order between them."""
        where = {t: i for i, t in enumerate(a) if t not in SLOTS}
        ends, last, before = [], [], {}
        for j, t in enumerate(b):
            if t in where:
                i = where[t]
                k = bisect_left(ends, i)
                if k == len(ends):
                    ends.append(i), last.append(j)
                else:
                    ends[k], last[k] = i, j
                before[j] = last[k - 1] if k else None
        run, j = [], last[-1] if last else None
        while j is not None:
            run.append((where[b[j]], j))
            j = before[j]
        out, i, j = [], 0, 0
        for x, y in [*run[::-1], (len(a), len(b))]:
            for n in range(j, y):
                if b[n] in SLOTS:
                    at = next((m for m in range(i, x) if a[m] == b[n]), None)
                    if at is not None:
                        out.append((at, n))
                        i = at + 1
            if x < len(a):
                out.append((x, y))
            i, j = x + 1, y + 1
        return out


def page_lines(df: DataFrame) -> DataFrame:
    """(doc_id, host, title, headline, body) to one row per page with its lines' keys: constants are counted over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"keys": [], "part": [], "shapes": [], "segs": []}
            for host, title, headline, body in zip(*(b.column(c).to_pylist() for c in ("host", "title", "headline", "body"))):
                site = site_pattern(host, title)
                keys, parts, shapes = [], [], []
                for line in (body or "").split("\n"):
                    line = unicodedata.normalize("NFC", line).strip()
                    if not line:
                        keys.append(0), parts.append([]), shapes.append("")
                        continue
                    k = key_of(line, site)
                    keys.append(hash_of(k))
                    s = shape(line)
                    shapes.append(s)
                    parts.append([hash_of(x) for x in _STOP.split(k)] if s == PROSE else [])
                out["keys"].append(keys), out["part"].append(parts), out["shapes"].append(shapes)
                out["segs"].append([hash_of("|" + x.strip().lower()) for x in segments(headline or "")])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("page", "doc_id", "host", "title", "headline", "body")), pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["part"], pa.list_(pa.list_(pa.int64()))), pa.array(out["shapes"], pa.list_(pa.string())), pa.array(out["segs"], pa.list_(pa.int64()))],
                ["page", "doc_id", "host", "title", "headline", "body", "keys", "part", "shapes", "segs"],
            )

    return df.mapInArrow(run, "page long, doc_id string, host string, title string, headline string, body string, keys array<long>, part array<array<long>>, shapes array<string>, segs array<long>")


def constants(pages: DataFrame) -> DataFrame:
    """(key): lines that stand on RECURS or more pages; lines of prose, and their sentences, that stand beside so many stories.

    A page's story is named by its rarest line of prose, so the pages of a story
    that is syndicated or fetched again count once.
    """
    zipped = F.filter(F.arrays_zip("keys", "shapes"), lambda x: x["keys"] != 0)
    prose = F.transform(F.filter(zipped, lambda x: x["shapes"] == PROSE), lambda x: x["keys"])
    other = F.transform(F.filter(zipped, lambda x: x["shapes"] != PROSE), lambda x: x["keys"])
    rows = lambda x: pages.select("page", F.explode(F.array_distinct(x)).alias("key"))
    counts = rows(prose).groupBy("key").agg(F.count("*").alias("n"))
    story = rows(prose).join(counts, "key").groupBy("page").agg(F.min(F.struct("n", "key")).alias("story"))
    beside = rows(F.concat(prose, F.flatten("part"))).join(story, "page").groupBy("key").agg(F.countDistinct("story").alias("n"))
    return rows(other).groupBy("key").agg(F.count("*").alias("n")).union(beside).where(F.col("n") >= RECURS).select("key").distinct()


def streams(pages: DataFrame, const: DataFrame) -> DataFrame:
    """Pages with known: the constants among their keys and sentences."""
    both = F.array_distinct(F.concat(F.filter("keys", lambda k: k != 0), F.flatten("part")))
    hits = pages.select("page", F.explode(both).alias("key")).join(const, "key").groupBy("page").agg(F.collect_list("key").alias("known"))
    return pages.join(hits, "page", "left")


def tokens_of(keys: list, parts: list, shapes: list, known: set) -> tuple[list, list[bool]]:
    """The token of each line (None if blank) and whether it lies inside the main prose."""
    out = []
    for k, p, s in zip(keys, parts, shapes):
        if not s:
            out.append(None)
        elif k in known or len(p) and all(x in known for x in p):
            out.append(int(k))
        else:
            out.append(s)
    prose = [i for i, t in enumerate(out) if t == PROSE]
    return out, [bool(prose) and prose[0] < i < prose[-1] for i in range(len(out))]


def infer(pages: DataFrame, merge: bool = False) -> DataFrame:
    """(host, block, pages, tokens, n, inside, optional, repeated): the wrapper of each block of pages of a host; with ``merge`` they are merged until each host has one.

    A block is one task's work, so a host of a third of all pages is spread. The
    counts of a host's nodes are the same merged or not.
    """
    size = pages.groupBy("host").agg(F.count("*").alias("size"))
    blocks = pages.join(size, "host").withColumn("block", F.pmod(F.xxhash64("page"), F.ceil(F.col("size") / BLOCK).cast("long")))
    schema = "host string, block long, pages long, tokens array<string>, n array<long>, inside array<long>, optional array<boolean>, repeated array<boolean>"

    def row(host: str, block: int, w: Wrapper) -> pd.DataFrame:
        cols = list(zip(*w.nodes)) or [()] * 5
        return pd.DataFrame([{"host": host, "block": block, "pages": w.pages, "tokens": [str(x) for x in cols[0]], "n": list(cols[1]), "inside": list(cols[2]), "optional": list(cols[3]), "repeated": list(cols[4])}])

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w = Wrapper()
        for r in pdf.sort_values("page").itertuples():
            tok, ins = tokens_of(r.keys, r.part, r.shapes, set(r.known) if r.known is not None else set())
            some = [i for i, t in enumerate(tok) if t is not None]
            w.add([tok[i] for i in some], [ins[i] for i in some])
        return row(key[0], key[1], w)

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w = Wrapper()
        for r in pdf.sort_values("block").itertuples():
            w.add([t if t in SLOTS else int(t) for t in r.tokens], list(r.inside), list(r.n), r.pages)
        return row(key[0], key[1], w)

    out = cut(blocks.select("host", "block", "page", "keys", "part", "shapes", "known").groupBy("host", "block").applyInPandas(build, schema))
    if not merge:
        return out
    most = out.agg(F.max("block")).first()[0] or 0
    while most > 0:
        out = cut(out.withColumn("to", F.floor(F.col("block") / FAN)).groupBy("host", "to").applyInPandas(join, schema))
        most //= FAN
    return out


def verdicts(wrappers: DataFrame) -> DataFrame:
    """(host, key, n, inside): places of each constant by which a page of the host is judged.

    They are those of the host's own wrapper where it has TRUSTED places or more, most of them outside the
    prose: it is furniture there. Else they are those of all hosts but the ones where it is such furniture.
    """
    nodes = wrappers.select("host", F.explode(F.arrays_zip("tokens", "n", "inside")).alias("x")).where("x.tokens not in ('P', 'L', 'T')")
    own = nodes.groupBy("host", F.col("x.tokens").cast("long").alias("key")).agg(F.sum("x.n").alias("own_n"), F.sum("x.inside").alias("own_inside"))
    own = own.withColumn("out", (F.col("own_n") >= TRUSTED) & (F.col("own_inside") * 2 < F.col("own_n")))
    rest = own.where("not out").groupBy("key").agg(F.sum("own_n").alias("n"), F.sum("own_inside").alias("inside"))
    both = own.join(rest, "key", "left")
    pick = lambda c: F.when(F.col("out"), F.col(f"own_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("host", "key", pick("n"), pick("inside"))


def site_names(pages: DataFrame) -> DataFrame:
    """(seg, host): parts of headlines that recur on one host and stand on no other."""
    s = pages.select("host", "page", F.explode(F.array_distinct("segs")).alias("seg"))
    return s.groupBy("seg").agg(F.min("host").alias("host"), F.max("host").alias("other"), F.count("*").alias("n")).where((F.col("host") == F.col("other")) & (F.col("n") >= 4)).select("seg", "host")


def judge(line_text: list[str], keys, parts, shapes, known: set, places: dict) -> list[bool]:
    """For each line whether it is part of the story; blank lines count as part of it."""
    tok, inside = tokens_of(keys, parts, shapes, known)
    story = [True] * len(tok)
    prose = [i for i, t in enumerate(tok) if t == PROSE]
    if not prose:  # a page without prose slots: its constants that are prose, else its longest title
        own = [i for i, t in enumerate(tok) if t is not None and shapes[i] == PROSE and places.get(keys[i], (0, 0))[1] * 2 >= places.get(keys[i], (1, 0))[0]]
        return [t is None or i in own for i, t in enumerate(tok)]
    for i, t in enumerate(tok):
        if t is None or t == PROSE:
            continue
        if isinstance(t, int):
            n, ins = places.get(t, (0, 0))
            story[i] = inside[i] and ins >= INSIDE * n and (n >= TRUSTED or not _PROMPT.search(line_text[i]))
        else:
            story[i] = t == ITEM
    # list items and subheads belong to the story only where prose is near: within it, or joined to its end
    last = prose[-1]
    for i in range(len(tok)):
        if tok[i] == ITEM and not prose[0] < i < last:
            between = range(last + 1, i) if i > last else range(i + 1, prose[0])
            story[i] = all(tok[j] in (None, ITEM) for j in between)
    return story


def prepared(df: DataFrame, sites: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pages, known): distinct pages with the keys of their lines, and which of these are constants."""
    base = df.select("doc_id", "url", "source", "headline", "body").where("doc_id is not null").distinct()
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), r"^(www|m|amp)\.", "")
    base = base.withColumn("host", F.coalesce(F.nullif(host, F.lit("")), F.col("source"), F.lit("")))
    if sites is not None:
        t = sites.select(F.regexp_replace(F.lower("host"), r"^(www|m|amp)\.", "").alias("host"), "title").groupBy("host").agg(F.max("title").alias("title"))
        base = base.join(t, "host", "left")
    else:
        base = base.withColumn("title", F.lit(None).cast("string"))
    base = base.withColumn("page", F.xxhash64("doc_id", "url", "headline", "body"))
    pages = cut(page_lines(base.select("page", "doc_id", "host", "title", "headline", "body")))
    known = streams(pages, cut(constants(pages)))
    known = cut(known.select("page", "host", "keys", "part", "shapes", "known"))
    return pages, known


def expressions(df: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(host, pages, expression): the union-free expression of each host: constants by their hash, slots, ? for optional and + for repeated nodes."""
    node = lambda x: F.concat(x["tokens"], F.when(x["optional"], "?").otherwise(""), F.when(x["repeated"], "+").otherwise(""))
    w = infer(prepared(df, sites)[1], merge=True)
    return w.select("host", "pages", F.concat_ws(" ", F.transform(F.arrays_zip("tokens", "optional", "repeated"), node)).alias("expression"))


def boilerplate(df: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """One row per distinct page: (doc_id, headline, body, lines, body_main, headline_main).

    lines: numbers (from 1, blank lines count) of non-blank lines that are not
    the story's own, with 0 if the headline holds a site's name beside the
    title. Null bodies have no lines; a null headline is no case. ``sites``
    (host, title) names sites; without a row a site is known by its host only.
    """
    pages, known = prepared(df, sites)
    places = verdicts(infer(known))
    hit = known.select("page", "host", F.explode("keys").alias("key")).where("key <> 0").distinct().join(places, ["host", "key"]).groupBy("page").agg(F.collect_list(F.struct("key", "n", "inside")).alias("places"))
    named = pages.select("page", "host", F.explode("segs").alias("seg")).join(site_names(pages), ["seg", "host"], "left_semi").select("page").distinct().withColumn("named", F.lit(True))
    full = pages.join(known.select("page", "known"), "page").join(hit, "page", "left").join(named, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("host", "title", "headline", "body", "keys", "part", "shapes", "known", "places", "named")}
            lines, mains, heads = [], [], []
            for i in range(b.num_rows):
                text = (cols["body"][i] or "").split("\n")
                where = {p["key"]: (p["n"], p["inside"]) for p in cols["places"][i] or []}
                story = judge(text, cols["keys"][i], cols["part"][i], cols["shapes"][i], set(cols["known"][i] or []), where) if cols["body"][i] is not None else []
                out = [j + 1 for j, ok in enumerate(story) if not ok]
                h = cols["headline"][i]
                site = site_pattern(cols["host"][i], cols["title"][i])
                parts = segments(h or "")
                own = [p for p in parts if not (site and site.search(p))]
                if h and len(parts) > 1 and (len(own) < len(parts) or cols["named"][i]):
                    out = [0, *out]
                lines.append(out)
                mains.append(None if cols["body"][i] is None else "\n".join(x for x, ok in zip(text, story) if ok))
                heads.append(max(own, key=len) if out[:1] == [0] and own else h)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("headline"), b.column("body"), pa.array(lines, pa.list_(pa.int32())), pa.array(mains, pa.string()), pa.array(heads, pa.string())], ["doc_id", "headline", "body", "lines", "body_main", "headline_main"])

    return full.mapInArrow(run, "doc_id string, headline string, body string, lines array<int>, body_main string, headline_main string")
