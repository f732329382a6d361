"""Problem 5: template residue and error-page text.

Normalised lines are counted by host; lines that recur over a large share of a
host's records are its furniture and are subtracted; a record is excluded if
what is left, or its url, holds evidence. Evidence is judged sentence by
sentence: news that reports about an error message, quotes it or describes it
in a sentence of its own is no evidence.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.llm.base import hash128
from siftspark.llm.site_lines import line_key
from siftspark.session import cut

#: Hashes of furniture lines that are sent to every task (16 MB); more are joined by host.
FURNITURE = 2_000_000

_NAME = r"[A-Za-zऀ-ॿ_][\w.\-]*(?:\s[\w.\-]+){0,2}"
# the ways in which templates mark a slot
_SLOT = re.compile(
    rf"\{{\{{[^{{}}]{{0,60}}\}}\}}|\{{%[^%]{{0,80}}%\}}|\$\{{[^{{}}]{{0,60}}\}}|\{{\d{{1,2}}\}}|\{{[a-z_][\w.]{{0,30}}\}}|<%[^%]{{0,60}}%>|<<\s*{_NAME}\s*>>|\[\[\s*{_NAME}\s*\]\]"
    rf"|&lt;\s*/?{_NAME}\s*&gt;|<[a-z_][\w.\-]{{0,30}}>|%[A-Za-z_][\w.]{{1,40}}%|__[A-Za-z][\w.]{{0,40}}?__|@[A-Za-z_][\w.]{{1,40}}@|#[A-Za-z_][\w.]{{1,40}}#(?!\w)|\[[\w.\s]{{1,40}}? goes here\]|\[(?:कैप्शन|शीर्षक|यहाँ [^\]]{{1,40}})\]|\[(?:insert|your|add|caption|headline|title|name|date|city|photo|image|text)\b[^\]]{{0,40}}\]",
    re.I,
)
_URL_SLOT = re.compile(r"\{|\}|%7B|%7D|\$\(|<|>|%3C|%3E|\[|\]|%5B|%5D|__[A-Za-z]\w*?__|%[A-Za-z_]{3,}%|/:[a-z]|@[a-z]+@|/(?:undefined|null|nan|none|slug|title|object%20object)(?=[/\-.?#]|$)|[-=](?:undefined|null|nan)(?=[/\-.?#&]|$)|\[object|#\w+#", re.I)
_WORD = re.compile(r"[\wऀ-ॿ]+", re.U)
_NUMBERS = re.compile(r"[0-9०-९].*[।.?!]\W*$")
_SENTENCE = re.compile(r"(?<=[।.!?…])\s+|\n|\s+\|\s+")
# Words of the usual filler, and of everyday English, by which filler is told from a sentence about filler.
_FILLER = re.compile(r"\b(?:lorem|ipsum)\b", re.I)
_ENGLISH = {"the", "an", "of", "on", "for", "with", "was", "were", "is", "are", "said", "prints", "print", "printed", "and", "that", "this", "to", "from", "by", "at", "as", "its", "be", "has", "had", "have", "not", "about", "words", "text", "her", "his", "their"}
_KEYS = re.compile(r"^(?:(?:asdf|qwer|qwerty|zxcv|xxx+|abc|test|blah|foo|bar|aaa+|hjkl|dummy|sample|नमूना|पाठ|text|टेस्ट)[\s,.]*)+$", re.I)
_OUTPUT = re.compile(
    r"\[object Object\]|\bnull\s*\|\s*undefined|\bundefined\s*\|\s*|^(?:undefined|null|NaN)(?:[\s,|]+(?:undefined|null|NaN))*$|\{\s*\"(?:status|error|code|message)\"|\bfunction\s+\w*\([^)]*\)\s*\{|=>\s*\{|\breturn null\b|\bTraceback\b.*(?:line|failed|recent)|\bWarning:\s*\w+\(|\bFatal error:|\bNotice:\s|\bUncaught\b|errno\s*\d|\bstack trace\b|\bwidget:\w+|\bStory body missing\b|\bException\b.*\bat line\b|\bSegmentation fault\b|\bSQLSTATE|\bsyntax error\b.*\bline\b|\bfailed to (?:load|open|render)\b|\binclude\(|\bconsole\.log\b|<\?php|\bdocument\.write|\bConnection to database lost|\bdatabase (?:error|connection)\b",
    re.I,
)
_ERROR = re.compile(
    r"^(?:error\s*)?[1-5]\d\d\s*[-:–]?\s*(?:not found|bad gateway|forbidden|internal server error|service unavailable|gateway time-?out|unauthori[sz]ed|too many requests|error)|\bpage (?:not found|cannot be displayed|can't be found|you (?:requested|are looking for))|\b(?:page|story|article|content|file|url)\b.{0,30}\b(?:could not|couldn't|can ?not|can't) be (?:located|found|loaded|displayed)|\bcan(?:no|')t seem to find|\bno content available|\bcontent (?:is )?(?:un|not )available|\baccess (?:is |was )?denied|\btoo many requests|\bsomething went wrong|\berror\s*#?\d{2,}\s*[:!.-]|\bunder maintenance|\b(?:be )?back at \d|\btry again (?:later|in|after)|^slow down\W*$|^oops\W*|^loading\W*$|\bno longer available|\bhas been (?:removed|deleted)|\bbad gateway\b|\bservice unavailable\b|\bserver error\b|\brequest (?:timed out|blocked)|\bsession (?:has )?expired|\bcould not load\b|\bgateway time-?out"
    r"|\bpage nahi[nm]? mil|\bserver mein (?:dikkat|kharabi)|\bhome par wapas|\bthodi der baad|पेज नहीं मिला|पृष्ठ नहीं मिला|हटा दी गई है|सर्वर में (?:दिक्कत|समस्या|ख़राबी|खराबी)|रखरखाव के (?:लिए|कारण) बंद|सामग्री उपलब्ध नहीं|(?:थोड़ी|कुछ) देर (?:बाद|में) (?:फिर |दोबारा |पुनः )?(?:से )?(?:कोशिश|प्रयास)|त्रुटि\s*\d|कुछ गड़बड़ (?:हुई|हो गई)|पहुँच (?:अस्वीकृत|निषिद्ध)|अनुरोध पूरा नहीं",
    re.I,
)
_SCRIPT = re.compile(
    r"\b(?:enable|turn on|activate|allow|switch on)\b.{0,20}\b(?:java ?script|js|scripts?|cookies)\b|\bjava ?script (?:is|must be|has been|needs to be) (?:disabled|enabled|off|turned|required|blocked)|\b(?:requires?|needs?|best with|works? with) (?:java ?script|scripts?)|\bscripts? (?:are|is) (?:blocked|off|disabled|required)|\bnoscript\b|\bscript (?:on|chalu|chaalu) kar|\bbrowser is (?:not supported|out ?dated|too old)|^update it to see|\bunsupported browser|\b(?:verify|confirm|prove|check).{0,20}\b(?:you are|you're) (?:not a robot|human|a human)|\bnot a robot\b|\bchecking your browser|\bcaptcha\b|\bhuman verification|\bunusual traffic|जावास्क्रिप्ट चालू करें|जावास्क्रिप्ट (?:बंद|ज़रूरी|आवश्यक|सक्षम करें)|स्क्रिप्ट (?:बंद|चालू करें|ज़रूरी|रोकी|रुकी)|रोबोट नहीं (?:हैं|हूँ)|मानव होने|ब्राउज़र (?:समर्थित नहीं|पुराना|अपडेट करें)|\brobot nahi",
    re.I,
)
_FILL = re.compile(
    r"\bplaceholder\b|\btype your (?:story|text|headline)|\breplace (?:before|this)\b|\bdummy text\b|\bsample text\b|\bTK TK\b|\b(?:headline|text|copy|story|photo|caption) to come\b|\binsert (?:text|headline|story|copy|photo) here|\byour (?:text|headline|story) here|\bheadline here\b|\btext goes here|\bcoming soon\b|\bstory (?:text )?here\b|अपना पाठ लिखें|यहाँ (?:चित्र|शीर्षक|पाठ|ख़बर|खबर|फोटो|फ़ोटो) आए|शीर्षक यहाँ|(?:ख़बर|खबर|पाठ) (?:यहाँ|बाद में) (?:जोड़ी|लिखी|डाली|आए)|नमूना पाठ|yahan (?:text|khabar|photo) (?:aayeg|likhe|dal)",
    re.I,
)
# a sentence that tells of something, in words of the three languages
_TELLS = re.compile(
    r"\b(?:said|says|told|asked|saw|admitted|reported|printed|prints|learn(?:ed|t)|showed|shows|caused|complained|explained|taught|wrote|alleged|officials|students|applicants|residents|training|workshop|court|police|according to)\b|\b(?:bataya|kaha|bole|mana|dikha|dikhta|chhap\w*|seekha|jaana|poocha|shikayat)\b|(?:^|\s)(?:कहा|बताया|बोले|माना|जाना|सीखा|दिखता|दिखा|छपा|छप|छापे|छपे|पूछा|सिखाया|समझाया|रहा|रही|रहे|गया|गए|गई|लिखा)(?=[\s,।'’\"]|$)",
    re.I,
)
_QUOTED = re.compile(r"(?:^|[\s(])['‘\"“«][^'’\"”»]{2,60}['’\"”»]")


# a sentence that speaks to the reader of the page
_ASKS = re.compile(r"\b(?:you|your|please|sorry|kripya|aap)\b|(?:^|\s)(?:आप|आपके|आपका|कृपया|क्षमा|माफ़|माफ)(?=\s)", re.I)


# In lower case, one part of every way to match the patterns above; a sentence with none of them matches none.
MARKS = (
    "{", "<", "%", "[", "&lt;", "__", "@", "#", "lorem", "ipsum", "undefined", "null", "nan", "function", "=>", "traceback", "warning:", "fatal error", "notice:", "uncaught", "errno", "stack trace", "widget:", "story body missing", "exception", "segmentation", "sqlstate", "syntax error", "failed to", "include(", "console.log", "document.write", "connection to database", "database",
    "not found", "bad gateway", "forbidden", "server error", "service unavailable", "gateway time", "unauthori", "too many requests", "error", "cannot be", "can't be", "can not be", "could not be", "couldn't be", "page you", "cannot seem", "can't seem", "cano", "no content", "content available", "content is available", "content unavailable", "content is unavailable", "content not", "content is not", "denied", "something went wrong", "maintenance", "back at", "try again", "slow down", "oops", "loading", "no longer available", "been removed", "been deleted", "timed out", "request blocked", "expired", "could not load",
    "nahi mil", "nahin mil", "nahim mil", "server mein", "home par wapas", "thodi der", "नहीं मिला", "हटा दी गई", "सर्वर में", "रखरखाव", "सामग्री उपलब्ध", "देर बाद", "देर में", "त्रुटि", "कुछ गड़बड़", "पहुँच", "अनुरोध पूरा",
    "script", "cookies", "js", "noscript", "browser", "update it to see", "human", "robot", "captcha", "unusual traffic", "जावास्क्रिप्ट", "स्क्रिप्ट", "रोबोट", "मानव होने", "ब्राउज़र",
    "placeholder", "type your", "replace before", "replace this", "dummy text", "sample text", "tk tk", "to come", "insert text", "insert headline", "insert story", "insert copy", "insert photo", "your text", "your headline", "your story", "headline here", "text goes here", "coming soon", "story here", "story text here", "अपना पाठ", "यहाँ", "शीर्षक", "नमूना पाठ", "जोड़ी", "लिखी", "डाली", "आए", "yahan",
)


@lru_cache(1)
def _marks():
    import ahocorasick

    a = ahocorasick.Automaton()
    for m in MARKS:
        a.add_word(m, True)
    a.make_automaton()
    return a


def marked(s: str) -> bool:
    """Whether a text holds one of MARKS, in one pass."""
    return next(_marks().iter(s.lower()), None) is not None


def evidence(sentence: str) -> str | None:
    """Kind of evidence (template, filler, output, error, script) that a sentence is no news; None if there is none.

    A sentence that tells of something, or quotes it, is news about such things,
    however long it is; one that speaks to the reader is not.
    """
    s = sentence.strip()
    if not s:
        return None
    words = _WORD.findall(s)
    if len(words) >= 3 and (len({w.lower() for w in words}) * 3 <= len(words) or _KEYS.match(s)):
        return "filler"
    if not marked(s):
        return None
    tells = len(words) >= 6 and (bool(_QUOTED.search(s)) or bool(_TELLS.search(s)) and not _ASKS.search(s))
    slots = _SLOT.findall(s)
    if slots:
        left = len(_WORD.findall(_SLOT.sub(" ", s)))
        if not (tells and left >= 6) and left <= 4 + 4 * len(slots):
            return "template"
    if _FILLER.search(s):
        plain = sum(w.lower() in _ENGLISH for w in words)
        if plain <= len(words) // 8:
            return "filler"
    if _OUTPUT.search(s) and not tells:
        return "output"
    if tells or _QUOTED.search(s):
        return None
    for kind, pattern in (("error", _ERROR), ("script", _SCRIPT), ("filler", _FILL)):
        if pattern.search(s):
            return kind
    return None


def text_evidence(text: str | None) -> str | None:
    """The first evidence in a text; null and empty texts have none."""
    for s in _SENTENCE.split(text or ""):
        kind = evidence(s)
        if kind:
            return kind
    return None


line_evidence = lru_cache(1 << 14)(text_evidence)


def split_evidence(rest: str | None, taken: str | None) -> str | None:
    """Evidence in what is left of a body, or in the furniture taken from it if that evidence has more words than what is left.

    Sentences with numbers are told from furniture by their numbers only, so those taken without evidence count as left.
    """
    kind = text_evidence(rest)
    if kind or not taken:
        return kind
    held, left = [], len(_WORD.findall(rest or ""))
    for x in taken.split("\n"):
        if k := line_evidence(x):
            held.append((k, x))
        elif _NUMBERS.search(x) and len(words := _WORD.findall(x)) >= 4:
            left += len(words)
    return held[0][0] if held and (not left or sum(len(_WORD.findall(x)) for _, x in held) > left) else None


@F.pandas_udf(T.StringType())
def body_evidence(rest: pd.Series, taken: pd.Series) -> pd.Series:
    return pd.Series([split_evidence(r, t) for r, t in zip(rest.where(rest.notna(), None), taken.where(taken.notna(), None))], dtype=object)


@F.pandas_udf(T.BooleanType())
def unfilled_url(s: pd.Series) -> pd.Series:
    return s.map(lambda u: bool(_URL_SLOT.search(re.sub(r"^[a-z]+://", "", u, flags=re.I))), na_action="ignore")


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "body", url_col: str = "url", min_share: float = 0.2, min_docs: int = 20) -> DataFrame:
    """(id, kind): records that hold template residue, filler, error or script notices, or a url with an unfilled part (kind 'url').

    A line is a host's furniture if it stands in at least ``min_docs`` and
    ``min_share`` of the host's distinct records; furniture is subtracted before
    the rest is judged. Where no word is left, or the furniture that holds
    evidence has more words than what is left, the furniture is the body and the
    record is judged whole. Records without a readable host are judged whole. Null
    texts have no evidence; a repeated row counts once; each id comes once.
    Counting is over hashes of (host, line): a host with a third of all rows is
    spread over all tasks.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), r"^(www|m|amp)\.", "")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.nullif(host, F.lit("")).alias("host"), F.col(url_col).alias("url"), F.col(text_col).alias("text"))
    sizes = rows.where("host is not null").select("host", "id").distinct().groupBy("host").agg(F.count("*").alias("size"))
    lines = rows.where("host is not null and text is not null").select("id", "host", F.explode(F.split("text", "\n")).alias("line")).withColumn("key", line_key(F.col("line"))).where("key <> ''")
    k1, k2 = hash128(F.col("host"), F.col("key"))
    counts = lines.select("host", k1.alias("k1"), k2.alias("k2"), F.xxhash64("id").alias("id")).distinct().groupBy("host", "k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    common = cut(counts.join(sizes, "host").where(F.col("n") >= min_share * F.col("size")).groupBy("host").agg(F.collect_set("k1").alias("common")))
    # at most 1 / min_share lines recur on a host per line of a record; texts are not shuffled unless the hosts have very many of them
    held = common.agg(F.sum(F.size("common") + 4)).first()[0] or 0
    common = F.broadcast(common) if held <= FURNITURE else common
    common_line = lambda x: F.array_contains(F.col("common"), F.xxhash64(F.col("host"), line_key(x)))
    kept = F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda x: ~common_line(x)))
    taken = F.concat_ws("\n", F.filter(F.split("text", "\n"), common_line))
    left = rows.join(common, "host", "left").withColumn("rest", F.when(F.col("common").isNull(), F.col("text")).otherwise(kept)).withColumn("taken", F.when(F.col("common").isNotNull(), taken))
    kind = F.when(unfilled_url("url"), F.lit("url")).otherwise(body_evidence("rest", "taken"))
    return left.select("id", kind.alias("kind")).where("kind is not null").groupBy("id").agg(F.min("kind").alias("kind")).withColumnRenamed("id", id_col)
