"""Language identification by interpolated Kneser-Ney character models, one per language.

Spark counts the character n-grams of labelled documents; all counts become sorted hash arrays of discounted
probabilities and interpolation weights, with a column per language. The labelled rows are all there are up to a stated
number, and beyond it a sample by hash of that size, so that the model is bounded and nothing is cut from its counts. A
text goes to the language of least cross-entropy per character. It is rejected where even that is out of line with
what labelled texts of that language, kept apart from the counts, cost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import discard, filter_texts, settle, settled_path, worker_memory

#: Characters of the longest n-gram.
ORDER = 5
#: Labelled rows that the model is fitted on, over all languages, each language having an equal share; a language with
#: more rows is sampled by hash. Of them one in so many is kept apart for the rejection.
LABELLED_ROWS, APART = 40_000, 10
#: Rejection: nats a character above the mean of the texts kept apart, and standard errors beyond that.
SLACK, ERRORS = 0.75, 6.0
#: Distinct words whose costs a worker remembers, and words that are looked up in one go.
CACHE_WORDS, GO_WORDS = 300_000, 100_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none where there is no letter at all."""
    found = _WORDS(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Is crc32 of the id's text a multiple of ``folds``? False for a null id, which training leaves out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, n)`` over all rows of ``docs(text, lang)``: the n-grams that end in each letter of each word and
    in its end, blanks standing for what is outside the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        grams: Counter = Counter()

        def spill() -> pa.RecordBatch:
            rows = [(lang, g, n) for (lang, g), n in grams.items()]
            grams.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

        def count() -> None:
            for lang, own in words.items():
                for w, n in own.items():
                    padded = " " * (order - 1) + w + " "
                    for i in range(len(w) + 1):
                        grams[lang, padded[i : i + order]] += n
            words.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text.as_py()))
                if sum(map(len, words.values())) > 100_000:
                    count()
                    if len(grams) > 250_000:
                        yield spill()
        count()
        if grams:
            yield spill()

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, gram string, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of ``codes``."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for column in codes.T:
        out = (out ^ column.astype(np.uint64)) * _PRIME
        out ^= out >> np.uint64(31)
    return out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted ``keys``; ``len(keys)`` where one isn't there."""
    at = np.searchsorted(keys, wanted)
    at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == wanted[at < len(keys)], at[at < len(keys)], len(keys))
    return at


@dataclass
class Model:
    """For each order, sorted hashes of n-grams with discounted probabilities, and of contexts with the weight of the
    next lower order; a last row stands for what is not there. ``mean`` and ``deviation`` of a character's cost."""

    order: int
    languages: list[str]
    floor: float
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    deviation: np.ndarray

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """By row of ``codes``, whose last column is the letter and whose others are what precedes it, and language."""
        p = np.full((len(codes), len(self.languages)), self.floor)
        for k in range(1, self.order + 1):
            keys, alpha = self.grams[k - 1]
            own, gamma = self.contexts[k - 1]
            p = alpha[_lookup(keys, _hash(codes[:, self.order - k :]))] + gamma[_lookup(own, _hash(codes[:, self.order - k : self.order - 1]))] * p
        return np.log(p)


def _codes(grams: list[str], order: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, order)


def fit(counts: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER) -> Model:
    """The model of n-grams and their counts by language. A language's lower orders count the different letters before
    an n-gram; each order has the discount n1 / (n1 + 2 n2) of its counts."""
    languages = sorted(counts)
    alphas: list[list] = [[] for _ in range(order)]
    gammas: list[list] = [[] for _ in range(order)]
    tables = []
    for column, lang in enumerate(languages):
        codes, number = _codes(counts[lang][0], order), np.asarray(counts[lang][1], float)
        tables.append((codes, number))
        for k in range(order, 0, -1):
            keys = _hash(codes)
            own, where = np.unique(_hash(codes[:, :-1]), return_inverse=True)
            n1, n2 = (number == 1).sum(), (number == 2).sum()
            discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.75))
            total = np.bincount(where, number)
            alphas[k - 1].append((keys, np.maximum(number - discount, 0) / total[where], column))
            gammas[k - 1].append((own, np.minimum(1.0, np.bincount(where, np.minimum(number, discount)) / total), column))
            _, first, number = np.unique(_hash(codes[:, 1:]), return_index=True, return_counts=True) if k > 1 else (None, [], [])
            codes, number = codes[first, 1:] if k > 1 else codes, np.asarray(number, float)

    def merge(parts: list, default: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
        values = np.full((len(keys) + 1, len(languages)), default, np.float32)
        for own, v, column in parts:
            values[np.searchsorted(keys, own), column] = v
        return keys, values

    letters = len(np.unique(np.concatenate([c[:, -1] for c, _ in tables]))) if tables else 0
    model = Model(order, languages, 1 / (letters + 1), [merge(x, 0) for x in alphas], [merge(x, 1) for x in gammas], np.zeros(0), np.zeros(0))
    costs = [(-model.log_probability(c)[:, i], n) for i, (c, n) in enumerate(tables)]
    model.mean = np.array([np.average(x, weights=n) for x, n in costs])
    model.deviation = np.array([np.sqrt(np.average((x - m) ** 2, weights=n)) for (x, n), m in zip(costs, model.mean)])
    return model


def labelled_sample(docs: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``(lang, text, apart)`` of the rows of ``docs(doc_id, text, lang)`` with a language and a letter in the text: of
    each language about an equal share of ``rows``, chosen by a hash of id and text, or all if there are fewer. One in
    ``APART`` of a language with enough rows is marked as kept apart. The driver gets the number of rows by language."""
    h = F.xxhash64("doc_id", "text")
    some = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.pmod(h, F.lit(1 << 31)).alias("draw"), F.pmod(F.xxhash64(h), F.lit(APART)).alias("part"))
    sizes = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    if not sizes:
        return some.select("lang", "text", F.lit(False).alias("apart"))
    share = rows / len(sizes)
    below = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, share / n) * (1 << 31)))))
    many = F.col("lang").isin([lang for lang, n in sizes.items() if min(n, share) >= 5 * APART])
    return some.where(F.col("draw") < below[F.col("lang")]).select("lang", "text", (many & (F.col("part") == 0)).alias("apart"))


def train(docs: DataFrame, order: int = ORDER, rows: int = LABELLED_ROWS) -> Model:
    """Fit on about ``rows`` rows of ``docs(doc_id, text, lang)`` that have a language, all if there are no more. The
    driver gets the n-gram counts of these rows, and sums of costs by language of those kept apart."""
    sample = labelled_sample(docs.select("doc_id", "text", "lang"), rows)
    path = settled_path(docs.sparkSession)
    counts = settle(gram_counts(sample.where("not apart"), order), path).toArrow().sort_by("lang").combine_chunks()
    discard(docs.sparkSession, path)
    ends = pc.run_end_encode(counts["lang"].combine_chunks()).run_ends.to_pylist() if len(counts) else []
    parts = [counts.slice(start, end - start) for start, end in zip([0, *ends], ends)]
    model = fit({x["lang"][0].as_py(): (x["gram"].to_pylist(), x["n"].to_numpy()) for x in parts}, order)
    for lang, n, cost, letters, cost2, both, letters2 in costs_apart(sample.where("apart"), model).collect():
        i, mean = model.languages.index(lang), cost / letters
        model.mean[i] = mean
        model.deviation[i] = np.sqrt(max(0.0, cost2 - 2 * mean * both + mean * mean * letters2) / letters)
    return model


def costs_apart(docs: DataFrame, model: Model) -> DataFrame:
    """Of each language of ``docs(lang, text)``: the number of words, and sums of their costs under the language's own
    model, of their lengths, and of the squares and products of both."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang", "n", "cost", "letters", "cost2", "both", "letters2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer.of(shared.value)
        for b in batches:
            rows = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                costs, letters = score.word_costs(words_of(text.as_py()))
                own = costs[:, score.model.languages.index(lang)]
                rows.append((lang, len(own), own.sum(), letters.sum(), own @ own, own @ letters, letters @ letters))
            yield pa.record_batch([pa.array(c, pa.string() if i == 0 else pa.float64()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.string() if i == 0 else pa.float64()) for i in range(7)], names=names)

    sums = docs.select("lang", "text").mapInArrow(run, "lang string, " + ", ".join(f"{x} double" for x in names[1:]))
    return sums.groupBy("lang").agg(*(F.sum(x).alias(x) for x in names[1:])).where("letters > 0")


class Scorer:
    """Costs of texts under a model, by a bounded memory of word costs."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.costs = np.zeros((1024, len(model.languages)))

    @classmethod
    def of(cls, model: Model) -> Scorer:
        """One for all tasks that a worker process runs with the model."""
        return worker_memory(("scorer", id(model)), lambda: cls(model))

    def _learn(self, new: list[str]) -> None:
        o, base = self.model.order, len(self.known)
        while len(self.costs) < base + len(new):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            codes = np.frombuffer("".join(" " * (o - 1) + w + " " for w in some).encode("utf-32-le"), np.uint32)
            sizes = np.array([len(w) + 1 for w in some])
            starts = np.cumsum(sizes + o - 1) - (sizes + o - 1)
            before = np.cumsum(sizes) - sizes
            first = np.repeat(starts - before, sizes) + np.arange(sizes.sum())
            letters = np.lib.stride_tricks.sliding_window_view(codes, o)[first]
            self.costs[base + at : base + at + len(some)] = np.add.reduceat(-self.model.log_probability(letters), before)
        self.known.update(zip(new, range(base, base + len(new))))

    def _answer(self, total: np.ndarray, size: int) -> tuple[str, float, float, bool]:
        entropy = total / size
        best = int(entropy.argmin())
        score = 1 / np.exp(-10 * np.minimum(entropy - entropy[best], 50)).sum()
        limit = self.model.mean[best] + SLACK + ERRORS * self.model.deviation[best] / np.sqrt(size)
        return self.model.languages[best], float(score), float(entropy[best]), bool(entropy[best] > limit)

    def __call__(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy in nats a character, and rejected? of each text, some texts at a time."""
        words, counts = [], []
        for text in texts:
            own = words_of(text) if self.model.languages else []
            words += own
            counts.append(len(own))
            if len(words) > GO_WORDS:
                yield from self._answers(words, counts)
                words, counts = [], []
        yield from self._answers(words, counts)

    def word_costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Costs by word and language, and lengths with the end of the word."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))  # frequent words come early
            new = set(words).difference(self.known)
        if new:
            self._learn(list(new))
        costs = self.costs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
        return costs, np.fromiter(map(len, words), np.int64, len(words)) + 1

    def _answers(self, words: list[str], counts: list[int]) -> Iterator[tuple]:
        costs, letters = self.word_costs(words)
        at = 0
        for n in counts:
            own = slice(at, at + n)
            yield self._answer(costs[own].sum(0), int(letters[own].sum())) if n else ("und", 0.0, None, True)
            at += n


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, cross_entropy, rejected)`` for each row of ``docs(doc_id, text, ...)``.

    A text that is null or has no letter is ``und`` with score 0, no cross-entropy, and rejected; so is every text if
    nothing was learned. Only the text is looked at, all of it, however long. Of equally likely languages the first by
    name wins. Repeated rows get equal answers; other columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer.of(shared.value)
        for b in batches:
            found = list(zip(*score(x.as_py() for x in b.column(1)))) or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` that aren't rejected, columns as given, whatever their names. The
    model is learned from the rows with an id and a language that aren't held out; where those give no language, all
    rows stay. Null texts and those without a letter go; long ones are judged whole; repeated rows fare alike."""
    model = train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: [not x[3] for x in Scorer.of(shared.value)(x.as_py() for x in texts)])
