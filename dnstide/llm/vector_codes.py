"""Vector code compression: product codes from integer k-means, with exact distances by limb-split matrix products.

Components become integers, and every later step is exact on them. The nearest entry of a codebook is the least
``|c|^2 - 2 x.c``: the integers are broken into limbs so short that a float64 product of two limb matrices stays below
2^53, where every sum is exact whatever its order; the limb products are put together in int64, and the first least
one is taken. Each round is one pass over the table: a task adds up the parts of each entry, and sums of entries are
all that is shuffled and all that comes to the driver. Integers too large for int64 take Python's, with the same
result.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import settle

#: Rows of a batch that are coded together, and their components at most.
ROWS, COMPONENTS = 4096, 1 << 20
#: Sums leave a task in limbs of 32 bits, the topmost signed.
LIMB = 32
#: Values below this take int64 sums.
SMALL = 1 << 30


def limbs(values: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """int64 ``values`` as ``n`` float64 arrays of ``bits`` bits each, least first; the last keeps the sign."""
    low = (1 << bits) - 1
    return [((values >> (bits * i)) & low if i < n - 1 else values >> (bits * i)).astype(np.float64) for i in range(n)]


def limb_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exact if the result fits in int64, by float64 products of limbs."""
    width = max(1, x.shape[1])
    bits = (53 - math.ceil(math.log2(width + 1))) // 2
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    n = max(1, -(-(most.bit_length() + 1) // bits))
    out = np.zeros((len(x), len(y)), np.int64)
    rights = limbs(y, bits, n)
    for i, left in enumerate(limbs(x, bits, n)):
        for j, right in enumerate(rights):
            if bits * (i + j) < 64:
                out += (left @ right.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """For each row of ``x``, whole numbers as float64, the first nearest of ``entries`` and its squared distance."""
    width = x.shape[1]
    most = max((abs(v) for e in entries for v in e), default=0)
    room = math.isqrt((1 << 62) // max(1, width)) - most  # for |x - c| to stay in int64 when squared and added
    small = np.abs(x).max(1, initial=0) < room
    if room > 0 and small.all():
        own, book = x.astype(np.int64), np.array(entries, np.int64).reshape(len(entries), width)
        scores = (book * book).sum(1)[None, :] - 2 * limb_dot(own, book)
        codes = scores.argmin(1)
        return codes, scores[np.arange(len(x)), codes] + (own * own).sum(1)
    if room > 0 and small.any():
        codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        for mask in (small, ~small):
            codes[mask], errors[mask] = nearest(x[mask], entries)
        return codes, errors
    rows = [[int(v) for v in r] for r in x]
    away = [[sum((v - c) ** 2 for v, c in zip(r, e)) for e in entries] for r in rows]
    codes = np.array([d.index(min(d)) for d in away], np.int64)
    return codes, np.array([min(d) for d in away], object)


class Sums:
    """Componentwise sums and counts by part and entry, exact."""

    def __init__(self, parts: int, entries: int, width: int):
        self.shape = (parts, entries, width)
        self.small, self.large = np.zeros(self.shape, np.int64), defaultdict(int)
        self.counts, self.held = np.zeros((parts, entries), np.int64), 0

    def add(self, part: int, x: np.ndarray, codes: np.ndarray) -> None:
        self.counts[part] += np.bincount(codes, minlength=self.shape[1])
        small = np.abs(x).max(1, initial=0) < SMALL
        order = np.flatnonzero(small)[np.argsort(codes[small], kind="stable")]
        if len(order):
            found, starts = np.unique(codes[order], return_index=True)
            self.small[part, found] += np.add.reduceat(x[order].astype(np.int64), starts, 0)
        for i in np.flatnonzero(~small).tolist():
            for position, v in enumerate(x[i].tolist()):
                self.large[part, int(codes[i]), position] += int(v)

    def rows(self) -> Iterator[tuple[int, int, int, int, int]]:
        """``(part, entry, position, limb, value)``; position -1 counts parts."""
        for part, entry in np.argwhere(self.counts).tolist():
            yield part, entry, -1, 0, int(self.counts[part, entry])
            for position in range(self.shape[2]):
                value, limb = int(self.small[part, entry, position]) + self.large.get((part, entry, position), 0), 0
                while not -(1 << LIMB) < value < 1 << LIMB:
                    yield part, entry, position, limb, value & ((1 << LIMB) - 1)
                    value, limb = value >> LIMB, limb + 1
                yield part, entry, position, limb, value


def kept_rows(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, embedding)`` of the rows that are coded: vectors without null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(F.coalesce(finite, F.lit(False)))


def whole(vectors: pa.Array, parts: int, width: int) -> np.ndarray:
    """``floor(4096 * x)`` as float64, by row, part and position; short vectors are filled up with zeros, and doubles
    beyond 1e300 count as that."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), parts * width))
    out[np.arange(parts * width)[None, :] < lengths[:, None]] = np.floor(np.minimum(np.maximum(values, -1e300), 1e300) * 4096)
    return out.reshape(len(vectors), parts, width)


def blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, min(ROWS, COMPONENTS // max(1, parts * width)))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, whole(part.column("embedding"), parts, width)


def refine(kept: DataFrame, books: list[list[list[int]]], width: int) -> list[list[list[int]]]:
    """The codebooks after one round: each entry the floor of the mean of the parts nearest to it."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        sums = Sums(len(books), max(map(len, books)), width)
        for _, x in blocks(batches, len(books), width):
            for part, entries in enumerate(books):
                own = np.ascontiguousarray(x[:, part])
                sums.add(part, own, nearest(own, entries)[0])
        rows = list(sums.rows())
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(),) * 4 + (pa.int64(),))], names=names)

    names = ["part", "entry", "position", "limb", "value"]
    found = kept.select("embedding").mapInArrow(add, "part int, entry int, position int, limb int, value bigint")
    total: dict = defaultdict(int)
    for r in found.groupBy(*names[:4]).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # parts x entries x width
        total[r.part, r.entry, r.position] += int(r.value) << (LIMB * r.limb)
    sent.destroy()
    return [
        [[total[p, e, i] // total[p, e, -1] for i in range(width)] if total[p, e, -1] else entry for e, entry in enumerate(book)]
        for p, book in enumerate(books)
    ]


def spelled_out(books: list[list[list[int]]]) -> str:
    return ",".join(str(v) for book in books for entry in book for v in entry)


def train_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[list[list[int]]], int]:
    """Codebooks by part, entry and position, and the width of a part.

    They start as the ``entries`` rows of the smallest vec_id (equal ones by their vectors, null ids last). Only those
    rows and the sums of entries come to the driver.
    """
    kept = kept_rows(vectors)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    start = whole(first["embedding"].combine_chunks(), parts, width)
    books = [[[int(v) for v in row[p]] for row in start] for p in range(parts)]
    for _ in range(rounds if len(start) else 0):
        books = refine(kept, books, width)
    return books, width


def encode(vectors: DataFrame, books: list[list[list[int]]], width: int) -> DataFrame:
    """``(vec_id, label, codes array<int>, error decimal)`` of each row that is coded."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for b, x in blocks(batches, len(books), width):
            found = [nearest(np.ascontiguousarray(x[:, p]), entries) for p, entries in enumerate(books)]
            codes = np.stack([c for c, _ in found], 1).astype(np.int32)
            errors = [e for _, e in found]
            if all(e.dtype == np.int64 and e.max(initial=0) < TOP // len(books) for e in errors):
                errors = pa.array(np.sum(errors, axis=0)).cast(pa.decimal128(38, 0))
            else:
                errors = pa.array([min(int(e), TOP) for e in np.sum([e.astype(object) for e in errors], axis=0)], pa.decimal128(38, 0))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, len(books), dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.record_batch([b.column("vec_id"), b.column("label"), listed, errors], names=["vec_id", "label", "codes", "error"])

    kept, kinds = kept_rows(vectors), dict(vectors.dtypes)
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error decimal(38,0)")


#: Errors beyond this are given as this.
TOP = (1 << 63) - 1


def to_long(c: Column) -> Column:
    return F.least(c, F.lit(TOP).cast("decimal(38,0)")).cast("bigint")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """``(vec_id, label, codes, error, label_error, codebooks_sha256)`` for each row of
    ``vectors(vec_id, label, embedding, ...)`` whose vector is not null and holds no null or non-finite component.

    Components x become ``floor(4096 * x)``; vectors are cut into ``parts`` equal parts, shorter ones than the longest
    filled up with zeros first, to a multiple of ``parts``. ``codes`` are the nearest entries of each part's codebook
    after ``rounds`` rounds, of equally near ones the first; ``error`` adds up their squared distances, ``label_error``
    the errors of all rows of the label (null is a label); both end at the largest long. With fewer rows than
    ``entries`` the codebooks are as short. Repeated rows count each; rows without vec_id are coded, and start a
    codebook last; empty vectors are zeros; other columns are not read, whatever their names; an empty table gives an
    empty one.
    """
    books, width = train_codebooks(vectors, parts, entries, rounds)
    if not books[0]:
        books = [[[0] * width] for _ in range(parts)]  # no row to code
    coded = settle(encode(vectors, books, width))
    totals = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    digest = hashlib.sha256(spelled_out(books).encode()).hexdigest()
    return joined.select("vec_id", "label", "codes", to_long(F.col("error")).alias("error"), to_long(F.col("label_error")).alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def hex_code(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
