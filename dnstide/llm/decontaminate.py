"""Benchmark decontamination: MinHash containment search, partitioned by item size, then exact shingle containment.

A test item is in a document if at least ``threshold`` of the item's distinct word shingles are. The sketch of an item
is its bottom-k MinHash: the k shingles of least hash. Items fall into size classes (powers of two), and k is one more
than the number of shingles that an item of the class's upper size may miss; so a document that holds an item holds at
least one shingle of its sketch, and no item is lost, however long the document. Each document's shingles are looked up
in the sketches; the few items met are verified on the shingles themselves.

An item shorter than a shingle is one shingle of all its words, its own sketch: a document that has these words in a row
holds it. Documents are shingled at such a length only where an item has it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dnstide.llm.shared import filter_texts

#: Letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"
#: UTF-8 bytes of item texts in a broadcast block; further items make further blocks.
BLOCK_BYTES = 16 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Hashes of word shingles: a bounded memory of word hashes, mixed over each run of words."""

    def __init__(self, memory: int = 500_000):
        self.memory, self.find = memory, regex.compile(WORD).findall
        self.known: dict[str, int] = {}

    def split(self, text: str | None) -> list[str]:
        return self.find((text or "").lower())

    def hashes(self, parts: list[str], words: int) -> np.ndarray:
        n = len(parts) - words + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.memory:
            self.known.clear()
        known = self.known
        for w in set(parts).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        one = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        out = np.zeros(n, np.uint64)
        for i in range(words):
            out = (out ^ one[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        return out


def _shingles(parts: list[str], words: int) -> set[tuple]:
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


class Sketches:
    """A block of test items: by length of shingles the sketch hashes in order, with the items behind each, and the
    items' shingles."""

    def __init__(self, items: list[tuple], words: int, threshold: float):
        self.shingler, self.items = Shingler(), []
        behind: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for key, text in items:
            parts = self.shingler.split(text)
            if not parts:
                continue
            size = min(words, len(parts))
            hashes = np.unique(self.shingler.hashes(parts, size))
            upper = 1 << (len(hashes) - 1).bit_length()  # the size class
            k = math.floor((1 - threshold) * upper + 1e-9) + 1
            for h in hashes[:k].tolist():
                behind[size][h].append(len(self.items))
            self.items.append((key, _shingles(parts, size)))
        self.sketches = [(size, np.array(sorted(of), np.uint64), [of[h] for h in sorted(of)]) for size, of in sorted(behind.items())]

    def search(self, text: str | None, threshold: float) -> Iterator[tuple]:
        """``(item, shingles of the item, shingles found)`` for each item in the text."""
        parts = self.shingler.split(text)
        for size, keys, behind in self.sketches:
            hashes = self.shingler.hashes(parts, size)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            met = {i for k in np.unique(at[keys[at] == hashes]).tolist() for i in behind[k]}
            if met:
                own = _shingles(parts, size)
                for i in sorted(met):
                    key, shingles = self.items[i]
                    found = len(shingles & own)
                    if found >= threshold * len(shingles) - 1e-9:
                        yield key, len(shingles), found


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` for each row of ``docs(doc_id, text, ...)`` and each
    row of ``benchmark(item_id, text, ...)`` that it holds: at least ``threshold`` of the item's distinct shingles of
    ``words`` words (runs of letters, digits and underscores, lower-cased).

    Null and empty texts hold nothing; an item of fewer than ``words`` words is one shingle of all of them, and one
    without words (null, empty) is never found. Extra columns, whatever their names, aren't read. Rows that repeat an id
    are each compared. Test items are broadcast in blocks of at most about ``block_bytes`` of text, one pass over the
    documents a block, so a large benchmark takes more passes and no more memory. The documents aren't shuffled.
    """
    names, item_type = ["doc_id", "item_id", "n_shingles", "n_found", "containment"], to_arrow_type(benchmark.schema["item_id"].dataType)
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, n_shingles bigint, n_found bigint, containment double"
    out = None
    for shared in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value, words, threshold)
            for b in batches:
                rows = [(d, *x, x[2] / x[1]) for d, text in zip(b.column(0).to_pylist(), b.column(1)) for x in sketches.search(text.as_py(), threshold)]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (b.schema.field(0).type, item_type, pa.int64(), pa.int64(), pa.float64()))], names=names)

        found = docs.select("doc_id", "text").mapInArrow(run, kinds)
        out = found if out is None else out.union(found)
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """The test items, broadcast in blocks of at most about ``block_bytes`` of text."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(1.5 * size / block_bytes))
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.select("item_id", "text").toLocalIterator()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs(text, ...)`` that hold no test item, columns as given, whatever their names. Each row is
    judged by its own whole text, whatever its doc_id; null and empty texts hold nothing and stay, as all do where the
    benchmark is empty; a short item takes all documents with its words in a row, so one of a common word takes many;
    repeated rows fare alike; a large benchmark takes a pass a block."""
    for shared in _blocks(benchmark, block_bytes):
        search = {}

        def keep(texts: pa.Array, shared=shared, search=search) -> list[bool]:
            if not search:
                search[0] = Sketches(shared.value, words, threshold)
            return [next(search[0].search(x.as_py(), threshold), None) is None for x in texts]

        docs = filter_texts(docs, keep)
    return docs
