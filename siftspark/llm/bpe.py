"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

The vocabulary is read from the tokenizers' folder (a parameter); nothing is
trained. A text is cut into units at white space; every distinct unit of a task
is encoded once. Encoding keeps a segment tree over byte positions whose nodes
hold the leftmost minimum pair rank; a merge makes logarithmic point updates at
its position and its live neighbours. Many units are encoded at a time, their
trees being the rows of one array.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pre-tokenizing pattern of the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the Unicode property White_Space.
SPACE = "\t\n\v\f\r \x85\xa0  -     　"
#: A unit never crosses a boundary of the pattern, so units can be encoded one by one.
_UNIT = regex.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PIECE = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"))
NONE = np.int64(1 << 62)
LONG = 256
#: Distinct units that a task keeps; beyond, it starts anew.
KEPT = 400_000


class Vocabulary:
    """Ranks of a byte-level BPE and the rank of every pair that can merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it can't merge; negative ids stand for no token."""
        key = (a << 20) | b
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where((a >= 0) & (b >= 0) & (self.keys[i] == key), self.merged[i], NONE)

    def encode_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most ``width`` bytes (a power of two), all trees in one array."""
        n = len(words)
        tok = np.full((n, width + 2), -1, dtype=np.int64)
        for i, w in enumerate(words):
            tok[i, : len(w)] = self.byte[np.frombuffer(w, dtype=np.uint8)]
        at = np.arange(width)
        nxt = np.tile(np.arange(1, width + 3), (n, 1))
        prv = np.tile(np.arange(-1, width + 1), (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        r = self.rank(tok[:, :width], tok[:, 1 : width + 1])
        tree[:, width:] = np.where(r < NONE, r * width + at, NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            rank, p = np.divmod(tree[live, 1], width)
            q = nxt[live, p]
            after = nxt[live, q]
            tok[live, p] = rank
            tok[live, q] = -1
            nxt[live, p] = after
            prv[live, np.minimum(after, width + 1)] = p
            before = prv[live, p]
            right = self.rank(rank, np.where(after <= width, tok[live, np.minimum(after, width + 1)], -1))
            left = self.rank(np.where(before >= 0, tok[live, np.maximum(before, 0)], -1), rank)
            has = before >= 0
            for rows, pos, value in ((live, q, None), (live, p, right), (live[has], before[has], left[has])):
                node = pos + width
                inside = node < 2 * width
                rows, node = rows[inside], node[inside]
                tree[rows, node] = NONE if value is None else np.where(value[inside] < NONE, value[inside] * width + pos[inside], NONE)
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        return [row[:k][row[:k] >= 0].astype(np.int32) for row, k in zip(tok, map(len, words))]

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same with one tree as a list, for a single long word."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        none, pairs = int(NONE), self.pairs
        tok = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(tok[i] << 20 | tok[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                best = tree[2 * i] if tree[2 * i] <= tree[2 * i + 1] else tree[2 * i + 1]
                if tree[i] == best:
                    break
                tree[i] = best
                i >>= 1

        while tree[1] < none:
            rank, p = divmod(tree[1], width)
            q = nxt[p]
            after = nxt[q]
            tok[p], tok[q] = rank, -1
            nxt[p] = after
            put(q, none)
            r = None
            if after < n:
                prv[after] = p
                r = pairs.get(rank << 20 | tok[after])
            put(p, none if r is None else r * width + p)
            before = prv[p]
            if before >= 0:
                r = pairs.get(tok[before] << 20 | rank)
                put(before, none if r is None else r * width + before)
        return np.array([x for x in tok if x >= 0], dtype=np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty word."""
        out: list = [None] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = self.byte[[w[0]]].astype(np.int32)
            elif len(w) > LONG:
                out[i] = self.encode_long(w)
            else:
                by.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, index in by.items():
            step = max(64, (1 << 18) // width)
            for k in range(0, len(index), step):
                part = index[k : k + step]
                for i, ids in zip(part, self.encode_rows([words[i] for i in part], width)):
                    out[i] = ids
        return out


class Encoder:
    """Encodes texts, keeping the ids of the units seen."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.pieces: dict[str, np.ndarray] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def learn(self, units: list[str]) -> None:
        """Encode new units; their ids are appended to one array."""
        cut = [_PIECE.findall(u) for u in units]
        new = list({p for u in cut for p in u if p not in self.pieces})
        self.pieces.update(zip(new, self.vocabulary.encode_words([p.encode("utf-8", "surrogatepass") for p in new])))
        parts = [np.concatenate([self.pieces[p] for p in u]) if len(u) > 1 else self.pieces[u[0]] for u in cut]
        first = len(self.index)
        self.index.update((u, first + i) for i, u in enumerate(units))
        self.ids = np.concatenate([self.ids, *parts])
        self.start = np.r_[self.start, self.start[-1] + np.cumsum([len(p) for p in parts])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; null and empty texts have none."""
        if len(self.index) > KEPT:
            self.reset()
        units = [_UNIT.findall(s) if s else [] for s in texts]
        new = list({u for x in units for u in x if u not in self.index})
        if new:
            self.learn(new)
        get = self.index.__getitem__
        flat = np.fromiter((get(u) for x in units for u in x), dtype=np.int64, count=sum(map(len, units)))
        size = (self.start[1:] - self.start[:-1])[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) - np.repeat(ends - size - self.start[flat], size)]
        per = np.cumsum([0, *map(len, units)])
        return ids, np.r_[0, ends][per]


_ENCODERS: dict[str, Encoder] = {}


def encoder(folder: str, name: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def runs(texts: list, limit: int = 1 << 19):
    """Slices of a list of texts of about ``limit`` characters each."""
    at = size = 0
    for i, s in enumerate(texts):
        n = len(s or "")
        if size + n > limit and i > at:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def encode_column(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): token ids of every row, without special tokens (their strings are ordinary text).

    Null and empty texts have an empty list; each row gives one row. No shuffle.
    """

    def run(batches):
        e = encoder(folder, name)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in runs(texts):
                values, offsets = e.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, tokens): number of tokens of every row; 0 for null and empty texts. Byte-level vocabularies by the encoder above, others by their library."""

    def run(batches):
        if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
            e = encoder(folder, name)
            count = lambda texts: np.diff(e.encode(texts)[1])
        elif os.path.exists(os.path.join(folder, f"{name}.model")):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
            count = lambda texts: np.array([len(x) for x in sp.encode([s or "" for s in texts], num_threads=1)])
        else:
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
            tk.encode_special_tokens = True
            count = lambda texts: np.array([len(x.ids) for x in tk.encode_batch([s or "" for s in texts], add_special_tokens=False)])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in runs(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(count(texts[a:b]).astype(np.int64))], [id_col, "tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, tokens long")

