"""Byte-level BPE: encoding by segment trees of pair ranks, and decoding.

A text is split by a pattern, and each match is merged by itself, always the leftmost pair of the least rank. A segment
tree over the byte positions of a match holds in each node the least (rank, position) of the live pairs below it, so
its root is the next merge; a merge changes the pair before it, its own pair and the pair of the position that goes,
which are three point updates up the tree. Matches of one size class are merged side by side, a tree a row of one
matrix, so that a step of all of them is a few array operations a level; very long matches have a tree each.

What a worker has encoded it remembers, in bounded memory, as a text repeats its words.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import KnownIds, runs, worker_memory

#: Distinct matches whose ids a worker remembers, how many of the first it keeps when there are more, and their
#: characters at most.
CACHE, KEEP, CACHE_CHARS = 600_000, 300_000, 32 << 20
#: Matches looked up together, characters of text encoded together.
GO, GO_CHARS = 200_000, 1 << 20
#: Positions of one matrix of trees, and the size from which a match has a tree of its own.
POSITIONS, ALONE = 1 << 18, 1024
#: Stands for a symbol where a text is split.
PRIVATE = "\ue000"
#: In a tree: rank << SHIFT | position; larger than all of them.
SHIFT = 32
NONE = np.iinfo(np.int64).max


class Ranks:
    """Tokens by rank, and for each two tokens that make a third its rank, in an open hash table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        found = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = dict(zip((left << SHIFT | right).tolist(), rank.tolist()))
        self.mask = (1 << (4 * max(1, len(rank))).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int64)
        key, slot = left << SHIFT | right, self._slot(left << SHIFT | right)
        while len(key):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = key[first], rank[first]
            rest = self.keys[slot] != key
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & self.mask
        # tokens as bytes one after another, for decoding
        size = max(self.ranks.values()) + 1
        listed = [b""] * size
        for token, rank in self.ranks.items():
            listed[rank] = token
        self.lengths = np.array([len(t) for t in listed], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(listed), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where they make no token."""
        key = left << SHIFT | right
        slot = self._slot(key)
        out, at = np.full(len(key), NONE, np.int64), np.arange(len(key))
        while len(at):
            own = self.keys[slot]
            hit = own == key
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (own >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        return runs(self.flat, self.starts[ids], self.lengths[ids])


def merge_many(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one after another, and how many each has: a tree a row."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n, leaves = len(words), 1 << max(1, int(sizes.max() - 1).bit_length())
    ids = np.full((n, leaves), -1, np.int64)
    ids[np.arange(leaves)[None, :] < sizes[:, None]] = ranks.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after = np.broadcast_to(np.arange(1, leaves + 1), (n, leaves)).copy()  # the next live position; the word's size ends it
    before = np.broadcast_to(np.arange(-1, leaves - 1), (n, leaves)).copy()
    tree = np.full((n, 2 * leaves), NONE, np.int64)
    w, p = np.nonzero(ids[:, 1:] >= 0)
    tree[w, leaves + p] = _nodes(ranks.of(ids[w, p], ids[w, p + 1]), p)
    level = leaves
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        least = tree[live, 1]
        at, made = least & ((1 << SHIFT) - 1), least >> SHIFT
        gone = after[live, at]
        end = after[live, gone]
        ids[live, at], ids[live, gone], after[live, at] = made, -1, end
        on = end < sizes[live]
        before[live[on], end[on]] = at[on]
        own = np.full(len(live), NONE, np.int64)
        own[on] = _nodes(ranks.of(made[on], ids[live[on], end[on]]), at[on])
        prior = before[live, at]
        has = prior >= 0
        changed = np.full(len(live), NONE, np.int64)
        changed[has] = _nodes(ranks.of(ids[live[has], prior[has]], made[has]), prior[has])
        leaf_rows = np.concatenate([live, live, live[has]])
        leaf = leaves + np.concatenate([gone, at, prior[has]])
        tree[leaf_rows, leaf] = np.concatenate([np.full(len(live), NONE, np.int64), own, changed[has]])
        while leaf[0] > 1:  # all leaves are on one level
            leaf >>= 1
            tree[leaf_rows, leaf] = np.minimum(tree[leaf_rows, 2 * leaf], tree[leaf_rows, 2 * leaf + 1])
        live = live[tree[live, 1] != NONE]
    kept = ids >= 0
    return ids[kept].astype(np.uint32), kept.sum(1)


def _nodes(ranks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.where(ranks == NONE, NONE, (ranks << SHIFT) | positions)


def merge_one(word: bytes, ranks: Ranks) -> list[int]:
    """Ids of one long word, by one tree."""
    n, pairs = len(word), ranks.pairs
    leaves = 1 << max(1, (n - 1).bit_length())
    ids = ranks.byte_ids[np.frombuffer(word, np.uint8)]
    found = ranks.of(ids[:-1], ids[1:])
    tree = np.full(2 * leaves, NONE, np.int64)
    tree[leaves : leaves + n - 1] = _nodes(found, np.arange(n - 1))
    level = leaves
    while level > 1:
        level //= 2
        tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
    ids, tree, none, low = ids.tolist(), tree.tolist(), int(NONE), (1 << SHIFT) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(at: int, left: int, right: int) -> None:
        rank = pairs.get(left << SHIFT | right) if right >= 0 else None
        value, i = none if rank is None else rank << SHIFT | at, leaves + at
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            value = value if value < other else other
            i >>= 1
            if tree[i] == value:
                break
            tree[i] = value

    while (least := tree[1]) != none:
        at, made = least & low, least >> SHIFT
        gone = after[at]
        end = after[gone]
        ids[at], ids[gone], after[at] = made, -1, end
        update(gone, 0, -1)
        if end < n:
            before[end] = at
        update(at, made, ids[end] if end < n else -1)
        if before[at] >= 0:
            update(before[at], ids[before[at]], made)
    return [i for i in ids if i >= 0]


@cache
def newer_letters() -> str:
    """Letters and digits of the regex module that the tiktoken library, by an older Unicode, takes for symbols."""
    kinds = regex.compile(r"[\p{L}\p{N}]")
    unknown = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and kinds.match(c)]
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {("!" + c).encode(): 256 + i for i, c in enumerate(unknown)}  # one id where both are symbols
    judge = tiktoken.Encoding("symbols", pat_str=r"[^\s\p{L}\p{N}]+|.", mergeable_ranks=ranks, special_tokens={})
    return "".join(c for c in unknown if len(judge.encode_ordinary("!" + c)) == 1)


class Encoder:
    """Ids of texts, by a bounded memory of matches."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = Ranks(path), regex.compile(pattern)
        self.newer = dict.fromkeys(map(ord, newer_letters()), PRIVATE)
        self.is_newer = np.zeros(0x110000, bool)
        self.is_newer[list(self.newer)] = True
        self.known = KnownIds(CACHE, KEEP, CACHE_CHARS)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. A word that is a token is its id."""
        tokens = np.fromiter((self.ranks.ranks.get(w, -1) for w in words), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.flatnonzero(tokens >= 0)
        order, flat, counts = [whole], [tokens[whole].astype(np.uint32)], [np.ones(len(whole), np.int64)]
        for i in np.flatnonzero((tokens < 0) & (sizes >= ALONE)).tolist():
            ids = merge_one(words[i], self.ranks)
            order.append(np.array([i]))
            flat.append(np.array(ids, np.uint32))
            counts.append(np.array([len(ids)]))
        bits, rest = np.frexp(sizes - 1)[1], (tokens < 0) & (sizes < ALONE)
        for k in np.unique(bits[rest]).tolist():
            members = np.flatnonzero(rest & (bits == k))
            for own in np.split(members, range(POSITIONS >> k, len(members), POSITIONS >> k)):
                ids, n = merge_many([words[i] for i in own], self.ranks)
                order.append(own)
                flat.append(ids)
                counts.append(n)
        order, counts = np.concatenate(order), np.concatenate(counts)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return runs(np.concatenate(flat), (np.cumsum(counts) - counts)[place], counts[place]), counts[place]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches, one after another, and how many each has."""
        new = set(words).difference(self.known.places)
        if new:
            if self.known.full(new):
                self.known.forget()
                new = set(words).difference(self.known.places)
            new = list(new)
            self.known.add(new, *self.merged([w.encode() for w in new]))
        return self.known.join(words)

    def matches(self, text: str) -> Iterator[list[str]]:
        """A text's matches; those of a long text in several lists."""
        if not text.isascii() and self.is_newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            found = (text[m.start() : m.end()] for m in self.split.finditer(text.translate(self.newer)))
            while own := list(islice(found, GO)):
                yield own
        elif len(text) < GO:
            yield self.split.findall(text)
        else:
            found = (m.group() for m in self.split.finditer(text))
            while own := list(islice(found, GO)):
                yield own

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        words, n_words, ids, counts = [], [], [], [np.zeros(1, np.int64)]

        def look_up() -> None:
            found, sizes = self.ids(words)
            ids.append(found)
            counts.append(sizes)
            words.clear()

        for text in texts:
            n_words.append(0)
            for own in self.matches(text):
                words.extend(own)
                n_words[-1] += len(own)
                if len(words) >= GO:
                    look_up()
        if words:
            look_up()
        ends = np.cumsum(np.concatenate(counts))[np.cumsum(n_words)]
        return np.split(np.concatenate(ids) if ids else np.zeros(0, np.uint32), ends[:-1])


def encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker process."""
    return worker_memory(("byte bpe", path, pattern), lambda: Encoder(path, pattern))


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow batch, some at a time, with the place of the first; null is empty, and bytes that are no UTF-8
    are replacement characters."""
    at, held, own = 0, 0, []
    for i, x in enumerate(texts):
        own.append((x.as_py() or b"").decode("utf-8", "replace"))
        held += len(own[-1])
        if held >= GO_CHARS:
            yield at, own
            at, held, own = i + 1, 0, []
    if own:
        yield at, own


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row of ``docs(doc_id, text, ...)``: the text's byte-level BPE ids.

    ``ranks_path`` is a rank file (a base64 token and its rank a line) that holds all single bytes; ``pattern`` splits
    texts into the matches that are encoded each by itself; there are no special tokens. A null or empty text has no
    ids. Of equal ranks the leftmost pair is merged first. Texts are encoded whole: a match of many bytes takes n log n
    steps, and memory grows with the longest text. Repeated rows and null ids are rows like any other; other columns
    are not read, whatever their names; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for b in batches:
            for at, texts in pieces(b.column(1)):
                ids = own.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).view(np.int32)))
                yield pa.record_batch([b.column(0).slice(at, len(texts)), listed], names=["doc_id", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, bytes binary)`` for each row of ``encoded(doc_id, ids, ...)``: the bytes that ids stand for.
    Null ids are none; an id that the rank file lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern).ranks
        for b in batches:
            ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([own.decode(x).tobytes() for x in ids], pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>, bytes binary")
