"""Sequence packing by minimum bin slack over the lengths of whole documents.

Documents are tokenized where they are read. Each piece that fills a window by itself is cut off; what remains of each
document is packed whole. For each window the largest remaining length is set, and a subset-sum over a bitset of
reachable sums picks, from the counts of remaining lengths, the multiset that leaves the least slack; the counts are
recovered by going back through the bitsets. Lengths that fill no window wait for more documents; if too many wait,
and at a partition's end, they are laid one after another into full windows, with a cut at each window's end. Only the
last window of a partition is cut at powers of two, where no padding is due.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dnstide.llm.shared import KnownIds, worker_memory

#: Tokens that a task holds before it packs what it has; of those that fill no window it keeps at most a half.
BLOCK_TOKENS = 4_000_000
#: Distinct words whose ids a worker remembers, and how many of the first it keeps when there are more: frequent words
#: come early; bytes of words at most. New words that are encoded together; bytes of text encoded in one go.
CACHE_WORDS, KEEP_WORDS, CACHE_BYTES, GROUP, GO_BYTES = 400_000, 200_000, 64 << 20, 64, 1 << 20
#: Rows of a batch whose texts are copied at a time.
SLICE = 1000
#: Stands after each word of a group. It is no letter, digit, mark or blank, and nothing composes with it.
STOP = "\x01"


#: A mark right after an ASCII letter or digit; there a run of tokens ends, so a blank between them changes no id.
_MARK = re.compile(rb"[.,;:!?#$%&*|](?<=[a-z0-9].)")


def folded(text: bytes) -> bytes:
    """The text with A-Z lower-cased and marks parted from words, so that fewer words differ, where that leaves its ids
    as they are. It doesn't where special tokens are sought as written, nor before a mark of U+0300 to U+033F: h and
    U+0331 have a letter of their own, H and U+0331 have none."""
    return text if b"<|" in text or b"\xcc" in text else _MARK.sub(rb" \g<0>", text.lower())


class WordTokenizer:
    """Ids of a tokenizer that treats words between blanks apart and lower-cases them; by a bounded memory of words."""

    def __init__(self, path: str, words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stop = self._encode([STOP])[0]  # one id, else words are encoded one by one
        self.known = KnownIds(words, KEEP_WORDS, CACHE_BYTES)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters are encoded some at a time, each ending in an id of its own kind; others with a stop after
        each, and where that doesn't part them, one by one."""
        texts = [w.decode("utf-8", "replace") for w in words]
        whole, others = [], []
        for w in zip(words, texts):
            (whole if w[1].lower().isalpha() else others).append(w)
        others += self._learn_groups(whole, " ", lambda ids: self.last[ids], 0)
        others = self._learn_groups(others, f" {STOP} ", lambda ids: ids == self.stop, 1) if len(self.stop) == 1 else others
        found = self._encode([text for _, text in others])
        self.known.add([w for w, _ in others], np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found)))

    def _learn_groups(self, words: list[tuple[bytes, str]], between: str, ends: Callable, drop: int) -> list[tuple[bytes, str]]:
        """Encode words with ``between`` after each; ``ends`` flags the last id of each, ``drop`` of which aren't its
        own. Returns the words of groups that have another number of ends."""
        groups, left = [words[i : i + GROUP] for i in range(0, len(words), GROUP)], []
        for group, ids in zip(groups, self._encode(["".join([text + between for _, text in g]) for g in groups])):
            at = np.flatnonzero(ends(ids))
            if len(at) == len(group):
                self.known.add([w for w, _ in group], np.delete(ids, at) if drop else ids, np.diff(at, prepend=-1) - drop)
            else:
                left += group
        return left

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, some texts at a time."""
        at = 0
        while at < len(texts):
            parts, sizes, held = [], [], 0
            while at < len(texts) and held < GO_BYTES:
                own = folded(texts[at]).split()  # at [\x20\x09-\x0D], which no token spans
                parts += own
                sizes.append(len(own))
                held += len(texts[at])
                at += 1
            new = set(parts).difference(self.known.places)
            if new:
                if self.known.full(new):
                    self.known.forget()
                    new = set(parts).difference(self.known.places)
                self._learn(list(new))
            ids, counts = self.known.join(parts)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
            yield from np.split(ids, ends[:-1])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, ``SLICE`` at a time."""
    return (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core
    return worker_memory(("tokenizer", path), lambda: WordTokenizer(path))


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum is the largest up to ``room``, from ``lengths`` in order and their ``counts``.

    Bit s of a bitset says that a sum of s can be made. Counts are added in powers of two, so a length takes a step
    for each binary digit of its count; the search ends when ``room`` itself is reached.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & full
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            taken[length] = taken.get(length, 0) + times
    return taken


class Packer:
    """Packs documents given as ``(key, ids)`` into windows, block by block."""

    def __init__(self, window: int):
        self.window, self.by_length, self.held = window, defaultdict(deque), 0
        self.sequences = 0

    def _row(self, key, ids, total, start, stop, offset):
        part = ids[start - key[1] : stop - key[1]]
        return (key[0], start, stop - start, zlib.crc32(part.astype("<u4").tobytes()), total, self.sequences, offset)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        while total - start >= self.window:
            yield self._row((doc, 0), ids, total, start, start + self.window, 0)
            self.sequences += 1
            start += self.window
        if start < total:
            self.by_length[total - start].append((doc, start, total, ids[start:].copy()))
            self.held += total - start

    def _windows(self) -> Iterator[list[tuple]]:
        counts = {n: len(x) for n, x in self.by_length.items() if x}
        lengths = sorted(counts)

        def take(n: int, k: int) -> list[tuple]:
            counts[n] -= k
            if not counts[n]:
                del lengths[bisect_left(lengths, n)]
            return [self.by_length[n].popleft() for _ in range(k)]

        while lengths:
            docs = take(lengths[-1], 1)
            for n, k in fill(lengths, counts, self.window - len(docs[0][3])).items():
                docs += take(n, k)
            yield docs

    def pack(self, last: bool, most: int = 0) -> Iterator[tuple]:
        """Rows of the windows that the remaining lengths fill exactly. What fills none waits for the next call while
        it has no more than ``most`` tokens; beyond that, and with the ``last`` call, it goes into full windows one
        after another, the document at a window's end being cut there. The ``last`` window is cut at powers of two."""
        short = []
        for docs in self._windows():
            if sum(len(d[3]) for d in docs) < self.window:
                short += docs
            else:
                yield from self._emit(docs, [self.window])
        held = sum(len(d[3]) for d in short)
        if last or held > most:
            rest = held % self.window
            sizes = [self.window] * (held // self.window)
            if last:
                short = yield from self._emit(short, sizes + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1])
            else:
                short = yield from self._emit(short, sizes)
        for d in short:
            self.by_length[len(d[3])].append(d)
        self.held = sum(len(d[3]) for d in short)

    def _emit(self, docs: list[tuple], sizes: list[int]) -> Generator[tuple, None, list[tuple]]:
        """Rows of documents in sequences of the given sizes, one after another; returns what is left."""
        sizes, offset = deque(sizes), 0
        for n_done, (doc, start, total, ids) in enumerate(docs):
            at = start
            while at < total:
                if not sizes:
                    return [(doc, at, total, ids[at - start :].copy()), *docs[n_done + 1 :]]
                n = min(total - at, sizes[0] - offset)
                yield self._row((doc, start), ids, total, at, at + n, offset)
                at, offset = at + n, offset + n
                if offset == sizes[0]:
                    sizes.popleft()
                    self.sequences, offset = self.sequences + 1, 0
        return []


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per piece of each row of ``docs(doc_id, text, ...)``: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    A document is its ids and then ``end_id``, so a null or empty text is the one id; each id lies in one piece.
    ``start`` counts the document's ids before the piece. Sequences hold ``window`` ids; only the last window of each
    partition is cut at powers of two, at most one of each, so none needs padding. ``sequence_id`` is unique, its upper
    bits the partition's number. Repeated rows and null ids are packed like any other; of equal lengths the first come
    first; columns besides these two are not read, whatever their names; an empty table gives an empty one. Memory is
    bounded by ``block_tokens`` and the longest text, which is encoded and cut whole. ``tokenizer_path`` is a tokenizers
    file of a kind that drops blanks and joins nothing over them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = word_tokenizer(tokenizer_path), Packer(window)
        base = TaskContext.get().partitionId() << 40

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            columns[5] = [base + x for x in columns[5]]
            return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows, kind = [], None
        for b in batches:
            kind = b.schema.field(0).type
            for part in slices(b):
                texts = [x.as_py() or b"" for x in part.column(1)]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts)):
                    rows.extend(packer.add(doc, np.append(ids, np.uint32(end_id))))
                    if packer.held > block_tokens:
                        rows.extend(packer.pack(last=False, most=block_tokens // 2))
                    if len(rows) > 20_000:
                        yield batch(rows)
                        rows = []
        rows.extend(packer.pack(last=True))
        if rows:
            yield batch(rows)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
