"""Problem 8: the whole corpus in ids of a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; a word's bytes are then merged, always the pair of least rank and
of these the leftmost, until no pair is in the vocabulary. A segment tree over the byte positions holds
rank * size + position of the pair that starts at each live position and the minimum of every node below, so
its root is the leftmost minimum pair. A merge changes at most three leaves (the merged pair, its left neighbour, the
position that dies), each by an update of log n nodes.

Words of up to 256 bytes are merged together: one NumPy tree a word, all words of a size class one merge further
with each pass. Longer ones have a tree of their own. Distinct words are merged once and kept in a bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text into words: fixed value, part of its definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 60
TOGETHER = 256
CACHE = 200_000


class Vocabulary:
    """Ids of single bytes, and the ids of pairs that merge, as sorted arrays (about 5 MB for 50,000 tokens)."""

    def __init__(self, byte: np.ndarray, keys: np.ndarray, ranks: np.ndarray):
        self.byte, self.keys, self.ranks, self._dict = byte, keys, ranks, None

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.array(sorted(pairs), np.int64)
        return cls(byte, keys, np.array([pairs[k] for k in keys.tolist()], np.int64))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.of({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they do not merge."""
        k = (a << np.int64(32)) | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], NONE)

    @property
    def table(self) -> dict[int, int]:
        if self._dict is None:
            self._dict = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._dict


def merge_together(words: list[bytes], size: int, v: Vocabulary) -> list[list[int]]:
    """Ids of words of at most `size` bytes (a power of two), merged side by side."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    raw = np.zeros((n, size), np.uint8)
    raw[np.arange(size) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    tok = v.byte[raw]
    tok[np.arange(size) >= lengths[:, None]] = -1
    after = np.broadcast_to(np.arange(1, size + 1), (n, size)).copy()
    after[after >= lengths[:, None]] = size
    before = np.broadcast_to(np.arange(-1, size - 1), (n, size)).copy()
    tree = np.full((n, 2 * size), NONE, np.int64)
    r, c = np.nonzero(np.arange(1, size) < lengths[:, None])
    rank = v.pair(tok[r, c], tok[r, c + 1])
    tree[r, size + c] = np.where(rank < NONE, rank * size + c, NONE)
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    live = np.arange(n)

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
        node = leaf + size
        tree[rows, node] = value
        node = node >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def start(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        rank = v.pair(tok[rows, i], tok[rows, j])
        put(rows, i, np.where(rank < NONE, rank * size + i, NONE))

    while True:
        root = tree[live, 1]
        live, root = live[root < NONE], root[root < NONE]
        if not len(live):
            break
        i = root % size
        j = after[live, i]
        k = after[live, j]
        tok[live, i] = root // size
        tok[live, j] = -1
        after[live, i] = k
        put(live, j, NONE)
        more = k < size
        if more.any():
            before[live[more], k[more]] = i[more]
            start(live[more], i[more], k[more])
        if not more.all():
            put(live[~more], i[~more], NONE)
        p = before[live, i]
        left = p >= 0
        if left.any():
            start(live[left], p[left], i[left])
    at = tok >= 0
    flat, ends = tok[at].tolist(), np.cumsum(at.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def merge_long(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one word of any length by its own segment tree."""
    n = len(word)
    size = 1 << max(1, (n - 1).bit_length())
    tok = v.byte[np.frombuffer(word, np.uint8)]
    leaf = np.full(size, NONE, np.int64)
    rank = v.pair(tok[:-1], tok[1:])
    leaf[: n - 1] = np.where(rank < NONE, rank * size + np.arange(n - 1), NONE)
    levels = [leaf]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [0] + [x for level in reversed(levels) for x in level.tolist()]
    tok, after, before, table, none = tok.tolist(), [*range(1, n), size], [*range(-1, n - 1)], v.table, int(NONE)

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least

    while (root := tree[1]) < none:
        i = root % size
        j = after[i]
        k = after[j]
        tok[i], tok[j], after[i] = root // size, -1, k
        put(j, none)
        value = none
        if k < size:
            before[k] = i
            if (r := table.get((tok[i] << 32) | tok[k])) is not None:
                value = r * size + i
        put(i, value)
        if (p := before[i]) >= 0:
            r = table.get((tok[p] << 32) | tok[i])
            put(p, none if r is None else r * size + p)
    return [t for t in tok if t >= 0]


def merge_words(words: list[str], v: Vocabulary) -> list[list[int]]:
    """Ids of each word."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    out: list[list[int]] = [[]] * len(raw)
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(raw):
        if len(w) > TOGETHER:
            out[i] = merge_long(w, v)
        elif w:
            classes.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(i)
    for size, at in classes.items():
        step = max(1, (1 << 19) // size)
        for a in range(0, len(at), step):
            part = at[a : a + step]
            for i, ids in zip(part, merge_together([raw[i] for i in part], size, v)):
                out[i] = ids
    return out


class Encoder:
    def __init__(self, v: Vocabulary, pattern: str = PATTERN):
        import regex

        self.v, self.find, self.cache = v, regex.compile(pattern).findall, {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.find(t) if t else [] for t in texts]
        new = list({w for ws in words for w in ws if w not in self.cache})
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = list({w for ws in words for w in ws})
        self.cache.update(zip(new, merge_words(new, self.v)))
        get = self.cache.__getitem__
        return [[i for w in ws for i in get(w)] for ws in words]


def encoded(spark: SparkSession, text: Column, path: str = VOCABULARY, pattern: str = PATTERN, count_only: bool = False) -> Column:
    """The ids (array<int>) of a text column, or their number; null and empty texts give an empty list, or 0.

    Texts are taken as stored and whole; strings that look like special tokens are ordinary text. The vocabulary is read
    on the driver from `path` and broadcast: its size is that of the vocabulary file, whatever the corpus.
    """
    v = Vocabulary.read(path)
    arrays = spark.sparkContext.broadcast((v.byte, v.keys, v.ranks))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(Vocabulary(*arrays.value), pattern)
        for texts in batches:
            done: list[pa.Array] = []
            for a in range(0, len(texts), 256):
                ids = enc(texts.slice(a, 256).to_pylist())
                if count_only:
                    done.append(pa.array([len(x) for x in ids], pa.int32()))
                else:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    done.append(pa.ListArray.from_arrays(pa.array(ends), pa.array([i for x in ids for i in x], pa.int32())))
            yield pa.concat_arrays(done) if done else pa.array([], pa.int32() if count_only else pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "int" if count_only else "array<int>")(text)
