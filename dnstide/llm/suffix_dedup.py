"""Exact substring dedup: bytes under any string of ``length`` bytes that starts twice in the corpus.

A suffix array of every byte is too large to shuffle, so it is a sparse one. Each string of ``length`` bytes has an
anchor: the k-gram in it with the least hash, the leftmost of equals. Equal strings have equal anchors at equal places,
so only suffixes at anchors are filed, and only anchors that occur twice carry bytes: those of all strings that they
anchor. Sampled splitters range-partition them by their leading bytes, equal anchors together; each bucket sorts the
suffixes from the anchor on, and the prefixes back from it, by multikey sort, and what neighbours share tells which
strings are equal on both sides: byte by byte, without hashes. Anchors that very many documents share are dealt over
several buckets, and across these boundaries one string of each sort is compared by its 256-bit BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import settle, spread

#: Bytes of an anchor.
GRAM = 32
#: Leading bytes by which suffixes are range-partitioned, before their anchors.
LEAD = 4
#: Bytes that a task works on at once.
BLOCK = 1 << 20
#: Occurrences of an anchor in one bucket.
CAP = 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


class Rolling:
    """Hashes of all strings of one length in a buffer, by prefix sums modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        while len(self.up) < len(data) + 1:
            n = 2 * len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(int(self.base), n // 2, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(int(self.inverse), n // 2, 1 << 64))])
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
        if isinstance(starts, slice):
            h = (prefix[length:] - prefix[:-length]) * self.up[: len(prefix) - length]
        else:
            h = (prefix[starts + length] - prefix[starts]) * self.up[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    ahead = np.minimum.accumulate(padded.reshape(rows, width), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of texts, and for each the range of strings that it anchors."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.rolling = length, gram, Rolling(_BASE)

    def pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of (text number, start, bytes) of about a block each; longer texts are cut with an overlap that
        leaves each string in one piece."""
        out, held = [], 0
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - self.length + 1), BLOCK):
                part = text[at : at + BLOCK + self.length - 1]
                if len(part) >= self.length:
                    out.append((i, at, part))
                    held += len(part)
                    if held >= BLOCK:
                        yield out
                        out, held = [], 0
        if out:
            yield out

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text numbers, anchor hashes, anchor starts, first and last start of the strings)."""
        for group in self.pieces(texts):
            data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
            sizes = np.array([len(p[2]) for p in group])
            begins = np.cumsum(sizes) - sizes
            hashes = self.rolling.at(self.rolling.prefix(data), slice(None), self.gram)
            ranked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
            least = (_sliding_min(ranked, self.length - self.gram + 1) & _LOW).astype(np.int64)
            counts = sizes - self.length + 1
            before = np.cumsum(counts) - counts
            starts = np.repeat(begins - before, counts) + np.arange(counts.sum())
            piece = np.repeat(np.arange(len(group)), counts)
            anchor = least[starts]
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
            last = np.append(new[1:], len(anchor)) - 1
            own = piece[new]
            shift = np.array([p[1] for p in group])[own] - begins[own]
            yield np.array([p[0] for p in group])[own], hashes[anchor[new]], anchor[new] + shift, starts[new] + shift, starts[last] + shift


def _kind(docs: DataFrame) -> str:
    return dict(docs.dtypes)["doc_id"]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text binary): the hash tells rows of one doc_id apart, with all its 64 bits, as a table may
    have very many rows under one doc_id or under none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _squeezed(docs: DataFrame) -> DataFrame:
    """The same, with compressed texts, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6, write_content_size=True)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([squeeze.compress(x.as_buffer()) for x in b.column(2)], pa.binary())], names=["doc_id", "text_hash", "z"])

    return _rows(docs).mapInArrow(run, f"doc_id {_kind(docs)}, text_hash bigint, z binary")


def anchors(docs: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``(anchor, doc_id, text_hash, place)``; ``place`` packs the anchor's start and how far before it the first and
    the last of its strings start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        for b in batches:
            for text, hashes, at, first, last in find([x.as_py() for x in b.column(2)]):
                which = pa.array(text)
                place = (at << 32) | ((at - first) << 16) | (at - last)
                yield pa.record_batch([pa.array(hashes.view(np.int64)), b.column(0).take(which), b.column(1).take(which), pa.array(place)], names=["anchor", "doc_id", "text_hash", "place"])

    return _rows(docs).mapInArrow(run, f"anchor bigint, doc_id {_kind(docs)}, text_hash bigint, place bigint")


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, anchor, salt, salts, first, at, lead, bytes) of each place; ``at`` is the anchor's place in
    ``bytes``."""
    open_z = zstandard.ZstdDecompressor()
    for b in batches:
        for row in range(b.num_rows):
            text, places = open_z.decompress(b.column(2)[row].as_py()), b.column(3)[row].values
            place, anchor, salts = (places.field(i).to_numpy() for i in range(3))
            for at in range(0, len(place), 4000):
                p = place[at : at + 4000]
                start = p >> 32
                first, last = start - ((p >> 16) & 0xFFFF), start - (p & 0xFFFF)
                n, many = len(p), salts[at : at + 4000]
                # mixed, as the places of lines of one width would fall on few salts
                salt = ((b.column(4)[row].as_py() + start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                same = pa.array(np.full(n, row))
                yield pa.record_batch(
                    [b.column(0).take(same), b.column(1).take(same), pa.array(anchor[at : at + 4000]), pa.array(salt), pa.array(many), pa.array(first), pa.array(start - first), pa.array([text[s : s + LEAD] for s in start.tolist()], pa.binary()), pa.array([text[f : x + length] for f, x in zip(first.tolist(), last.tolist())], pa.binary())],
                    names=["doc_id", "text_hash", "anchor", "salt", "salts", "first", "at", "lead", "bytes"],
                )


def multikey_sort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of strings given as rows of ``words``, group by group: a word at a time, and only those that tie in
    all words before go on to the next."""
    order = np.argsort(group, kind="stable")
    run = group[order]
    for word in words.T:
        tied = np.flatnonzero(np.concatenate([[False], run[1:] == run[:-1]]) | np.concatenate([run[1:] == run[:-1], [False]]))
        if not len(tied):
            break
        key = word[order[tied]]
        by = np.lexsort((key, run[tied]))
        order[tied], key = order[tied[by]], key[by]
        own = run[tied]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        run[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1] + len(run)  # above all groups' numbers, in order
        run = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
    return order


class Sides:
    """The strings that begin at anchors, or run back from them, sorted within groups; for a length, those that agree
    so far have one class."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int, width: int, group: np.ndarray):
        n, places = len(starts), np.arange(-(-width // 8) * 8)
        index = starts[:, None] + step * places[None, :]
        inside = places[None, :] < np.minimum(sizes, width)[:, None]
        strings = np.where(inside, data[np.where(inside, index, 0)], 0).astype(np.uint8)
        self.order = multikey_sort(strings.view(">u8"), group)
        own = strings[self.order]
        differ = own[1:] != own[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), len(places))
        same = group[self.order][1:] == group[self.order][:-1]
        self.shared, self.places = np.concatenate([[-1], np.where(same, shared, -1)]), np.arange(n)

    def classes(self, length: int) -> np.ndarray:
        """By row: the first place in the order that agrees with it in so many bytes, and in the group."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.maximum.accumulate(np.where(self.shared < length, self.places, 0))
        return out


class Bucket:
    """Sorts the anchored suffixes of whole groups of equal anchors, and finds the strings that are equal on both sides
    of the anchor."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def __call__(self, table: pa.Table) -> pa.RecordBatch:
        length = self.length
        texts = table["bytes"].to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(x) for x in texts])
        begins, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        before = np.cumsum(counts) - counts  # places of a row's strings among all
        at, first = table["at"].to_numpy(), table["first"].to_numpy()
        key = np.stack([table["anchor"].to_numpy(), table["salt"].to_numpy()])
        leads = table["lead"].to_pylist()
        new = np.concatenate([[False], (key[:, 1:] != key[:, :-1]).any(0) | np.array([x != y for x, y in zip(leads, leads[1:])], bool)])
        group = np.cumsum(new)
        right = Sides(data, begins + at, sizes - at, 1, length, group)
        left = Sides(data, begins + at - 1, at, -1, length - self.gram, group)
        found = np.zeros(int(counts.sum()), bool)
        witness = []
        for lead in range(int(at.max()) + 1):  # bytes of a string before its anchor
            own = np.flatnonzero((at >= lead) & (at - lead < counts))
            if len(own) < 2:
                continue
            both = left.classes(lead)[own] * len(at) + right.classes(length - lead)[own]
            by = np.argsort(both, kind="stable")
            twin = both[by][1:] == both[by][:-1]
            again = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
            place = before[own[by]] + at[own[by]] - lead
            found[place[again]] = True
            witness.append(place[again & ~np.concatenate([[False], twin])])
        row = np.repeat(np.arange(len(texts)), counts)
        start = np.arange(len(row)) - before[row]
        place = first[row] + start
        edge = np.concatenate([[True], row[1:] != row[:-1]])
        opens = np.flatnonzero(found & (edge | ~np.concatenate([[False], found[:-1]])))
        closes = np.flatnonzero(found & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([found[1:], [False]])))
        parts = [(row[opens], place[opens], place[closes] + length, np.zeros(len(opens), np.int64))]
        digests = [None] * len(opens)
        dealt = (table["salts"].to_numpy() > 1)[row]
        if dealt.any():  # equal strings may be in another bucket: one of each sort, and those that met none, go on
            witness = np.concatenate(witness) if witness else np.zeros(0, np.int64)
            for some, n in ((np.flatnonzero(dealt & ~found), 1), (witness[dealt[witness]], 2)):
                parts.append((row[some], place[some], place[some] + length, np.full(len(some), n)))
                digests += [hashlib.blake2b(texts[r][s : s + length], digest_size=32).digest() for r, s in zip(row[some].tolist(), start[some].tolist())]
        columns = [np.concatenate(x) for x in zip(*parts)]
        own = table.select(["doc_id", "text_hash"]).combine_chunks().take(pa.array(columns[0]))
        return pa.record_batch([own["doc_id"].combine_chunks(), own["text_hash"].combine_chunks(), *(pa.array(c) for c in columns[1:]), pa.array(digests, pa.binary())], names=["doc_id", "text_hash", "start", "stop", "n", "digest"])


def _buckets(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole groups (anchor, salt) of the sorted rows."""
    bucket, held, size = Bucket(length, gram), [], 0
    for b in batches:
        key = np.stack([b.column(i).to_numpy() for i in (2, 3)])
        ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if held and b.num_rows:
            previous = held[-1]
            if (previous.column(2)[-1].as_py(), previous.column(3)[-1].as_py()) != (int(key[0, 0]), int(key[1, 0])):
                ends = np.concatenate([[0], ends])
        done, total = 0, np.concatenate([[0], np.cumsum(pc.binary_length(b.column(8)).to_numpy())])
        for end in ends.tolist():
            if size + total[end] - total[done] >= BLOCK:
                held.append(b.slice(done, end - done))
                yield bucket(pa.Table.from_batches([x for x in held if x.num_rows]))
                held, size, done = [], 0, end
        if done < b.num_rows:
            held.append(b.slice(done))
            size += int(total[-1] - total[done])
    if held:
        yield bucket(pa.Table.from_batches(held))


def repeated_rows(docs: DataFrame) -> DataFrame:
    """``(again_id, again_hash)`` of the rows that are there more than once."""
    counts = docs.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).count().where("count > 1")
    return counts.select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))


def once(docs: DataFrame, again: DataFrame) -> DataFrame:
    """``(doc_id, text)`` without the repetitions of the rows named."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("text_hash") == F.col("again_hash"))
    one = rows.join(again, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    return rows.join(again, same, "left_anti").select("doc_id", "text").union(one.select("doc_id", "text"))


def repeated_ranges(docs: DataFrame, length: int = 200, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """``(doc_id, text_hash, ranges array<struct<start, stop>>)`` for the rows with repeated strings: byte ranges,
    sorted, that may overlap. A row that is there more than once is searched once and is a range by itself."""
    docs = docs.select("doc_id", "text")
    again = settle(repeated_rows(docs))
    whole = None
    if not again.isEmpty():
        bytes_of = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
        same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("again_hash"))
        whole = docs.join(again, same).where(bytes_of >= length).select("doc_id", F.col("again_hash").alias("text_hash"), F.lit(0).cast("bigint").alias("start"), bytes_of.alias("stop")).distinct()
        docs = once(docs, again)
    spots = anchors(docs, length, gram)
    counts = spots.groupBy("anchor").count().where("count > 1").select("anchor", F.ceil(F.col("count") / cap).cast("bigint").alias("salts"))
    twice = spots.join(spread(counts), "anchor")
    lists = twice.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "anchor", "salts")).alias("places")).withColumnsRenamed({"doc_id": "list_id", "text_hash": "list_hash"})
    kind = _kind(docs)
    joined = _squeezed(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("list_id")) & (F.col("text_hash") == F.col("list_hash"))).select("doc_id", "text_hash", "z", "places", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 40)).alias("deal"))
    contexts = joined.mapInArrow(lambda it: _contexts(it, length), f"doc_id {kind}, text_hash bigint, anchor bigint, salt bigint, salts bigint, first bigint, at bigint, lead binary, bytes binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartitionByRange(parts, "lead", "anchor", "salt").sortWithinPartitions("lead", "anchor", "salt")
    found = settle(dealt.mapInArrow(lambda it: _buckets(it, length, gram), f"doc_id {kind}, text_hash bigint, start bigint, stop bigint, n bigint, digest binary"))
    apart = found.where("n > 0")
    equal = apart.groupBy("digest").agg(F.sum("n").alias("all")).where("all > 1").select("digest")
    more = apart.where("n = 1").join(spread(equal), "digest")
    ranges = found.where("n = 0").select("doc_id", "text_hash", "start", "stop").union(more.select("doc_id", "text_hash", "start", "stop"))
    ranges = ranges if whole is None else ranges.union(whole)
    return ranges.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def substring_dedup(docs: DataFrame, length: int = 200, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """``(doc_id, n_bytes, spans array<struct<start, stop>>, kept binary)`` for each row of ``docs(doc_id, text, ...)``.

    ``spans`` are the maximal runs of bytes covered by strings of ``length`` bytes that start anywhere else too, in
    the same text or another row's; ``kept`` is the rest of the UTF-8 text. Strings are judged on the input. A null
    text is empty; a row repeated is another text, so both lose all if they are long enough. Long texts are searched
    whole, in blocks with an overlap. Other columns are not read, whatever their names. An empty table gives an empty
    one.
    """
    ranges = repeated_ranges(docs, length, gram, cap).withColumnsRenamed({"doc_id": "range_id", "text_hash": "range_hash"})
    joined = _squeezed(docs).join(ranges, F.col("doc_id").eqNullSafe(F.col("range_id")) & (F.col("text_hash") == F.col("range_hash")), "left").select("doc_id", "z", "ranges")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_z = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [open_z.decompress(z.as_py()) for z in part.column(1)]
                merged = [_merge(r.values) for r in part.column(2)]
                kept = [_cut(t, s) for t, s in zip(texts, merged)]
                columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"start": x, "stop": y} for x, y in s] for s in merged], span), pa.array(kept, pa.binary())]
                yield pa.record_batch([part.column(0), *columns], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {_kind(docs)}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def _merge(ranges: pa.StructArray | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges; ranges that touch are one run."""
    if ranges is None or not len(ranges):
        return []
    start, stop = ranges.field(0).to_numpy(), np.maximum.accumulate(ranges.field(1).to_numpy())
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return list(zip(start[new].tolist(), stop[np.append(np.flatnonzero(new)[1:], len(stop)) - 1].tolist()))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(text[x:y] for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(text)]))
