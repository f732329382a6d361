"""Driver-free text kernels shared by the operators of this subpackage.

``skeleton`` brings text that looks the same to one form; ``WordHasher`` turns
a batch of texts into word hashes, shingle sets and content-defined chunks with
numpy only, without a Python object per word.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Letters of other scripts that look like Latin letters, by the
# public confusables data of Unicode TR39 (prototype on the right).
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ь": "b",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "г": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "‘": "'", "’": "'", "′": "'", "“": '"', "”": '"', "…": "...", "॥": "।।", "∶": ":", "⁄": "/", "∕": "/", "٫": ",", "‚": ",", "․": ".", "ǃ": "!", "；": ";",
}
# Devanagari letter sequences drawn exactly like one letter (same source).
DRAWN_ALIKE = {"अा": "आ", "अॉ": "ऑ", "अो": "ओ", "अौ": "औ", "आॅ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "एॅ": "ऍ", "अॅ": "ॲ", "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ"}


def _prototypes() -> dict[int, str]:
    """Character to prototype: the fixed table, and by rule wide, narrow and font forms, ligatures, invisible characters."""
    out = {}
    for cp in [*range(0xA0, 0x3400), *range(0xA640, 0xABFF), *range(0xFB00, 0xFFF0), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)]:
        c = chr(cp)
        tag, _, rest = unicodedata.decomposition(c).partition("> ")
        if c.isspace():
            out[cp] = " "
        elif unicodedata.category(c) == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp in (0x34F, 0x180E, 0x115F, 0x1160, 0x3164, 0xFFA0):
            out[cp] = ""
        elif rest and (tag in ("<wide", "<narrow", "<font", "<noBreak") or tag == "<compat" and 0xFB00 <= cp <= 0xFB06):
            out[cp] = "".join(chr(int(x, 16)) for x in rest.split())
    out |= {ord(k): v for k, v in LOOK_ALIKE.items()}
    out |= {c: " " for c in range(0x00, 0x20) if c != 0x0A} | {0x7F: "", 0xAD: "", 0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
    for _ in range(2):  # prototypes of prototypes
        out = {k: v.translate(out) for k, v in out.items()}
    return out


_MAP = _prototypes()
# characters that are their own prototype and have no decomposition
_ODD = re.compile("[^\n -~ऀ-नप-रलळव-ॗॠ-३४-ॿ»²½©—]|॥")
_SEQUENCES = (*DRAWN_ALIKE, "़्")
_DRAWN = re.compile("|".join(sorted(DRAWN_ALIKE, key=len, reverse=True)))
_SPACES = re.compile(" {2,}")
_EDGES = re.compile(" ?\n ?")
# a joiner after a virama changes the drawn form of the consonants around it
_JOINED = re.compile("(?<=\u094d)[\u200c\u200d](?=[\u0900-\u097f])")


def skeleton(s: str | None) -> str | None:
    """The form that is equal for all texts that look the same; null stays null.

    Decompose, replace every character by its prototype, decompose again, then
    make white space single blanks (line feeds stay). Case, digits of another
    script, superscripts, accents, vowel signs, nasal signs and nuktas remain.
    """
    if s is None:
        return None
    if _ODD.search(s) or any(x in s for x in _SEQUENCES):
        s = _JOINED.sub(lambda m: "\ue001" if m[0] == "\u200c" else "\ue002", s)
        s = unicodedata.normalize("NFD", s.replace("\r\n", "\n")).translate(_MAP)
        s = unicodedata.normalize("NFD", s)
        if any(x in s for x in DRAWN_ALIKE):
            s = _DRAWN.sub(lambda m: DRAWN_ALIKE[m[0]], s)
    if "  " in s:
        s = _SPACES.sub(" ", s)
    if " \n" in s or "\n " in s:
        s = _EDGES.sub("\n", s)
    return s.strip(" ")


U = np.uint64
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LANES = [U(int(x) | 1) for x in _RNG.integers(1, 2**63, 16, dtype=np.int64)]
_POW = np.ones(1, dtype=U)
_INV = np.ones(1, dtype=U)
BLOCK = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = np.asarray(x).astype(U, copy=True)
    with np.errstate(over="ignore"):
        x ^= U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def _powers(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, BLOCK + (1 << 18))
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.r_[U(1), np.full(n, _BASE)], dtype=U)
            _INV = np.cumprod(np.r_[U(1), np.full(n, _BASE_INV)], dtype=U)


def sort_within(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``np.lexsort((key, doc))`` for small numbers ``doc`` and unsigned 64-bit keys, by one sort of both in 64 bits; where the bits cut off the keys would change the order, by lexsort."""
    if not len(doc):
        return np.zeros(0, dtype=np.int64)
    bits = U(max(1, int(doc.max()).bit_length()))
    both = (doc.astype(U) << (U(64) - bits)) | (key >> bits)
    order = np.argsort(both, kind="stable")
    both, key_ = both[order], key[order]
    if ((both[1:] == both[:-1]) & (key_[1:] < key_[:-1])).any():
        return np.lexsort((key, doc))
    return order


class Words:
    """Word hashes of a block of texts: h, doc (index of the text), size in bytes with one separator."""

    def __init__(self, texts: list[str]):
        raw = [s.encode("utf-8", "surrogatepass") for s in texts]
        n = np.fromiter((len(b) + 1 for b in raw), dtype=np.int64, count=len(raw))
        buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        self.count = len(texts)
        starts_at = np.cumsum(n) - n
        word = (buf != 32) & (buf != 10)
        edge = np.diff(np.r_[False, word, False].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        _powers(len(buf) + 2)
        with np.errstate(over="ignore"):
            total = np.cumsum(np.r_[U(0), _BYTE[buf] * _POW[: len(buf)]], dtype=U)
            self.h = mix((total[end] - total[start]) * _INV[start])
        self.doc = np.searchsorted(starts_at, start, "right") - 1
        self.size = (end - start + 1).astype(np.int64)
        self.per_doc = np.bincount(self.doc, minlength=self.count)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, offsets): the sorted distinct k-word shingle hashes of every text; a shorter text is one shingle. ``first``: the word at which each of them starts for the first time, -1 for the shingle of a shorter text."""
        h, doc = self.h, self.doc
        with np.errstate(over="ignore"):
            if len(h) >= k:
                g = np.zeros(len(h) - k + 1, dtype=U)
                for i in range(k):
                    g += h[i : len(h) - k + 1 + i] * _LANES[i]
                ok = doc[: len(g)] == doc[k - 1 :]
                v, d, at = mix(g[ok]), doc[: len(g)][ok], np.flatnonzero(ok)
            else:
                v, d, at = np.zeros(0, dtype=U), np.zeros(0, dtype=doc.dtype), np.zeros(0, dtype=np.int64)
            short = np.flatnonzero((self.per_doc > 0) & (self.per_doc < k))
            if len(short):
                first = np.searchsorted(doc, short)
                whole = [int(mix(np.array([sum(int(h[f + i]) * int(_LANES[i]) for i in range(self.per_doc[s])) + int(self.per_doc[s]) & 0xFFFFFFFFFFFFFFFF], dtype=U))[0]) for s, f in zip(short, first)]
                v, d, at = np.r_[v, np.array(whole, dtype=U)], np.r_[d, short], np.r_[at, np.full(len(short), -1)]
        o = sort_within(d, v)
        v, d, at = v[o], d[o], at[o]
        if len(v):
            new = np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])]
            v, d, at = v[new], d[new], at[new]
        self.first = at
        return v, np.searchsorted(d, np.arange(self.count + 1))

    def chunks(self, radius: int = 2, ahead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, bytes, doc, start) of content-defined chunks.

        A chunk ends at a word where the rolling hash of the last two words is the
        smallest within ``radius`` words on both sides, or at the end of the text.
        Its hash is over its own words and the ``ahead`` words after it, if there
        are so many: equal chunks then have equal shingles of ``ahead`` + 1 words
        starting in them.
        """
        h, doc = self.h, self.doc
        if not len(h):
            return h, self.size, doc, np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            roll = mix(h * _LANES[0] + np.r_[U(0), np.where(doc[1:] == doc[:-1], h[:-1], U(0))] * _LANES[1], 5)
        cut = np.ones(len(h), dtype=bool)
        for r in range(1, radius + 1):
            same = doc[r:] == doc[:-r]
            cut[r:] &= ~same | (roll[r:] < roll[:-r])
            cut[:-r] &= ~same | (roll[:-r] <= roll[r:])
        cut |= np.r_[doc[1:] != doc[:-1], True]
        end = np.flatnonzero(cut) + 1
        start = np.r_[0, end[:-1]]
        stop = np.minimum(end + ahead, np.searchsorted(doc, doc[start], "right"))
        _powers(len(h) + 2)
        with np.errstate(over="ignore"):
            total = np.cumsum(np.r_[U(0), h * _POW[: len(h)]], dtype=U)
            value = mix((total[stop] - total[start]) * _INV[start] + (end - start).astype(U) * _LANES[2] + (stop - end).astype(U) * _LANES[3], 11)
        size = np.cumsum(np.r_[0, self.size])
        return value, size[end] - size[start], doc[start], start


def blocks(texts: list[str], limit: int = BLOCK):
    """(first index, texts) of runs of texts of about ``limit`` characters, so that arrays stay in cache; a longer text is its own run."""
    at, run, size = 0, [], 0
    for i, s in enumerate(texts):
        if run and size + len(s) * 2 > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(s)
        size += len(s) * 2
    if run:
        yield at, run


def set_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set of values."""
    with np.errstate(over="ignore"):
        total = np.cumsum(np.r_[U(0), mix(values, 3)], dtype=U)
        n = np.diff(offsets)
        return mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(U) * _LANES[15])
