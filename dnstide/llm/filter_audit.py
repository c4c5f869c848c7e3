"""Interaction of quality filters: for every order of them what each removes, by masks of the filters a text fails.

Four filters judge a text by itself. The fifth, copies, needs the whole table: texts are range-partitioned by prefixes
just long enough to tell sampled neighbours apart, and each range inserts its full texts into a compressed trie whose
terminals hold the smallest id; a walk over the trie gives each row its flag. Before the shuffle, tries over blocks of
a task's rows do the same, so that of a block's copies only the one of smallest id travels with its text, and a text
of a third of all rows comes to its range once a block. What leaves the ranges are rows of id, part and mask; counts
by part and mask, at most 32 a part, then give all orders.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import spread

FILTERS = "ABCDE"
FEW_WORDS, REPEATED, CAPITALS, SIGNS, COPY = (1 << i for i in range(5))
#: Bytes of text of a range, and of a block whose copies meet before the shuffle; rows of such a block.
RANGE_BYTES, BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 32 << 20, 200_000
#: Sampled texts a range, and bytes of splitters that tasks are sent at most: beyond that ranges grow.
SAMPLED, SPLITTER_BYTES = 8, 64 << 20
#: Bytes of a text that are split into words in one go.
GO_BYTES = 4 << 20
BLANKS = b"\t\n\x0b\x0c\r "
UPPER, CONTINUATION = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, of a long text some at a time."""
    at = 0
    while len(text) - at > GO_BYTES:
        end = at + GO_BYTES
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def own_mask(text: bytes) -> int:
    """The filters that a text fails by itself."""
    n_words, distinct = 0, set()
    for words in words_of(text):
        n_words += len(words)
        distinct.update(words)
    n_upper = len(text) - len(text.translate(None, UPPER))
    n_chars = len(text.translate(None, CONTINUATION))
    fails = (n_words < 50, 100 * len(distinct) < 65 * n_words, 100 * n_upper > 5 * n_chars, len(text.translate(None, b"#$%&*|")) < len(text))
    return sum(1 << i for i, x in enumerate(fails) if x)


def shared_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes ``a`` and ``b[at:]`` share."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Terminal:
    """What a trie holds of one text: the smallest id, the text's own mask, and rows by id and part."""

    __slots__ = ("least", "mask", "rows")

    def __init__(self, mask: int):
        self.least, self.mask, self.rows = None, mask, Counter()

    def add(self, doc_id, part: str, n: int) -> None:
        self.rows[doc_id, part] += n
        if self.least is None or doc_id < self.least:
            self.least = doc_id


class Trie:
    """Compressed trie over whole texts. A node is its label, its children by first byte and its terminal."""

    def __init__(self):
        self.root, self.n_bytes, self.n_rows = [b"", {}, None], 0, 0

    def find(self, text: bytes) -> list:
        """The node at which ``text`` ends, made if it isn't there."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                self.n_bytes += len(child[0])
                return child
            if not text.startswith(child[0], at):
                n = shared_prefix(child[0], text, at)
                middle = node[1][text[at]] = [child[0][:n], {child[0][n]: child}, None]
                child[0] = child[0][n:]
                child = middle
            node, at = child, at + len(child[0])
        return node

    def add(self, text: bytes, doc_id, part: str, mask: int | None = None, n: int = 1) -> None:
        """``mask`` is worked out where it isn't given and the text is new."""
        node = self.find(text)
        if node[2] is None:
            node[2] = Terminal(own_mask(text) if mask is None else mask)
        node[2].add(doc_id, part, n)
        self.n_rows += 1

    def terminals(self) -> Iterator[tuple[bytes, Terminal]]:
        """Texts and what is held of them."""
        stack = [(self.root, b"")]
        while stack:
            (label, children, terminal), before = stack.pop()
            text = before + label
            if terminal is not None:
                yield text, terminal
            stack.extend((child, text) for child in children.values())


def splitters(texts: DataFrame, n_ranges: int, fraction: float) -> list[bytes]:
    """At most ``n_ranges - 1`` prefixes that cut ``texts(text)`` into ranges of like size, in order: of every
    ``SAMPLED`` sampled texts one, cut to the bytes that tell it from the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, found, i = None, [], 0
        for b in batches:
            for x in b.column(0):
                text = x.as_py()
                i += 1
                if i % SAMPLED == 0 and before is not None and text != before:
                    found.append(text[: shared_prefix(before, text) + 1])
                before = text
        yield pa.record_batch([pa.array(found, pa.binary())], names=["text"])

    sample = texts.sample(fraction, seed=11).repartitionByRange(max(1, n_ranges // 64), "text").sortWithinPartitions("text")
    found = sample.mapInArrow(run, "text binary")
    n_bytes = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] if n_ranges > 10_000 else 0
    if n_bytes > SPLITTER_BYTES:
        found = found.sample(SPLITTER_BYTES / n_bytes, seed=11)
    return sorted({bytes(r.text) for r in found.toLocalIterator()})


def filter_masks(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(doc_id, part, mask, n)``: ``n`` rows of ``docs(doc_id, text, source, ...)`` with one doc_id, text and source
    fail the filters of ``mask``, bit i for the i-th of ``FILTERS``.

    A: fewer than 50 words (maximal runs of other than ASCII blanks). B: under 65 % of the words are different. C: over
    5 % of the code points are A to Z. D: there is one of ``#$%&*|``. E: a row of a smaller doc_id has the same text.
    Null texts are empty, null sources empty strings. Rows without doc_id are neither smaller nor larger than others:
    they never fail E and make no row fail it, and are counted together. Rows that repeat a doc_id and its text share
    their fate. Texts are compared whole; memory is bounded by ``range_bytes`` of text, a few times the longest text,
    and the texts that share a range by the sample's chance. Other columns are not read, whatever their names; an empty
    table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    total, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // range_bytes))
    cuts = splitters(rows.select("text"), n_ranges, min(1.0, SAMPLED * n_ranges / max(1, total)))
    sent, n_ranges = spark.sparkContext.broadcast(cuts), len(cuts) + 1
    names = ["range", "text", "doc_id", "part", "mask", "n"]

    def batch(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = (pa.int32(), pa.binary(), id_type, pa.string(), pa.int32(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose flag is settled have no text; they go to any range."""
        cuts, trie, without, id_type = sent.value, Trie(), Counter(), pa.int64()

        def settled(trie: Trie) -> Iterator[pa.RecordBatch]:
            found, held = [], 0
            for text, terminal in trie.terminals():
                for i, ((doc_id, part), n) in enumerate(terminal.rows.items()):
                    if doc_id == terminal.least:
                        found.append((bisect_right(cuts, text), text, doc_id, part, terminal.mask, n))
                        held += len(text)
                    else:
                        found.append(((len(found) + i) % n_ranges, None, doc_id, part, terminal.mask | COPY, n))
                    if held > 4 << 20 or len(found) > 10_000:
                        yield batch(found, id_type)
                        found, held = [], 0
            if found:
                yield batch(found, id_type)

        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if doc_id is None:
                    without[part, own_mask(text.as_py())] += 1
                    continue
                trie.add(text.as_py(), doc_id, part)
                if trie.n_bytes > BLOCK_BYTES or trie.n_rows > BLOCK_ROWS:
                    yield from settled(trie)
                    trie = Trie()
        yield from settled(trie)
        if without:
            yield batch([(0, None, None, part, mask, n) for (part, mask), n in without.items()], id_type)

    def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, id_type = Trie(), pa.int64()
        out = names[2:]
        for b in batches:
            id_type = b.schema.field(2).type
            yield b.filter(b.column(1).is_null()).select(out)
            for text, doc_id, part, mask, n in zip(b.column(1), *(b.column(c).to_pylist() for c in out)):
                if text.is_valid:
                    trie.add(text.as_py(), doc_id, part, mask, n)
        found = []
        for _, terminal in trie.terminals():
            for (doc_id, part), n in terminal.rows.items():
                found.append((None, None, doc_id, part, terminal.mask | (COPY if doc_id > terminal.least else 0), n))
            if len(found) > 10_000:
                yield batch(found, id_type).select(out)
                found = []
        if found:
            yield batch(found, id_type).select(out)

    schema = f"doc_id {kind}, part string, mask int, n bigint"
    local = rows.mapInArrow(in_blocks, f"range int, text binary, {schema}")
    return local.repartitionById(n_ranges, F.col("range")).mapInArrow(in_ranges, schema)


def interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: a row a
    part of ``masks``, order of the five filters and step.

    At a step its filter takes the rows that fail it and none before it. ``removed`` counts them, ``kept`` those left,
    ``redundant`` those that fail it and were gone, ``unique_fails`` those that fail no other; ``good_lost`` and
    ``toxic_lost`` are the removed ones whose doc_id has a row of quality 1, or toxic 1, in
    ``labels(doc_id, quality, toxic, ...)``, each once; ``shapley`` adds up what the filter removes over all orders.
    """
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.select(F.col("doc_id").alias("of"), "quality", "toxic").where("of is not null").groupBy("of").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")]
    counts = masks.join(spread(known), F.col("doc_id") == F.col("of"), "left").groupBy("part", "mask").agg(*sums)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    step = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", step)
    bit = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord("A")).cast("int")
    own = bit(F.substring("filter_order", F.col("step"), F.lit(1)))
    prior = F.aggregate(F.slice(F.split("filter_order", ""), 1, F.col("step") - 1), F.lit(0), lambda sum_, letter: sum_ + bit(letter))
    steps = steps.select("*", own.alias("own"), prior.alias("prior"))
    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("prior")) != 0
    removed = lambda c: fails(c) & ~gone(c)

    def total(which, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("bigint"), lambda sum_, c: sum_ + value(c))

    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("bigint")).alias("shapley"),
    )
