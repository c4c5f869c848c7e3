"""Filter audit, byte-level BPE and vector codes against plain versions and on odd rows."""

import base64
import hashlib
import random
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from dnstide.llm import filter_audit as audit
from dnstide.llm import vector_codes as codes
from dnstide.llm.byte_bpe import Encoder, Ranks, bpe_decode, bpe_encode, merge_many, merge_one
from dnstide.llm.queries import ORACLES, QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_vector_codes"])
def test_sql(same, name):
    same(QUERIES[name], ORACLES[name])


# --- filters


def plain_masks(rows):
    blanks = " \t\n\x0b\x0c\r"
    out = []
    for doc_id, text, source in rows:
        text, words, own = text or "", [], ""
        for ch in text:
            if ch not in blanks:
                own += ch
            elif own:
                words.append(own)
                own = ""
        words += [own] if own else []
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * sum("A" <= ch <= "Z" for ch in text) > 5 * len(text)) + "D" * any(ch in "#$%&*|" for ch in text)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        out.append((source or "", set(fails + "E" * copy), doc_id))
    return out


def plain_audit(rows, labels):
    masks, out = plain_masks(rows), {}
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    for part in {p for p, _, _ in masks}:
        own = [(fails, d) for p, fails, d in masks if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                removed = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(removed)
                redundant = sum(f in x[0] for x in own) - len(removed)
                out[part, "".join(order), i + 1] = [len(left), len(removed), redundant, sum(x[0] == {f} for x in own), sum(x[1] in good for x in removed), sum(x[1] in toxic for x in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    shared = "a header that many texts begin with " * 40
    some = ["", " \n\t", shared, shared + "x", shared + "y" * 3000, "ÄÖÜ A", "WORDS IN CAPITALS", "100 %", "  wide \x85 blanks", "a\x00b"]
    some += [" ".join(f"w{rng.randrange(200)}" for _ in range(rng.choice([10, 49, 50, 51, 400]))) for _ in range(40)]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *some]), rng.choice([None, "", "a", "b"])) for _ in range(250)]
    return rows + [(i, shared + "hot", "a") for i in range(100, 250)] + [(7, shared + "hot", "b")] * 40


@pytest.mark.parametrize("range_bytes", [200, 1 << 25])
def test_audit(spark, texts, monkeypatch, range_bytes):
    labels = [(i, i % 3, i % 2) for i in range(0, 200, 2)] + [(4, 1, None), (None, 1, 1), (6, None, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in texts], "doc_id long, text string, source string, mask int, range string, part string, `a.b` string").repartition(3)
    found = audit.interactions(audit.filter_masks(docs, range_bytes), spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string"))
    got = {tuple(r)[:3]: list(r)[3:] for r in found.collect()}
    assert got == plain_audit(texts, labels)


def test_audit_blocks(spark, texts, monkeypatch):
    """Blocks, long texts and the look-up of long words take other ways to the same masks."""
    monkeypatch.setattr(audit, "GO_BYTES", 50)
    assert [sum(1 << i for i, f in enumerate("ABCD") if f in fails) for _, fails, _ in plain_masks(texts)] == [audit.own_mask((t or "").encode()) for _, t, _ in texts]


def test_audit_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id int, text string, source string"), spark.createDataFrame([], "doc_id int, quality int, toxic int")
    assert audit.interactions(audit.filter_masks(docs), labels).collect() == []
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    rows = audit.interactions(audit.filter_masks(one), labels).collect()
    assert len(rows) == 600 and {(r.part, r.kept + r.removed) for r in rows if r.step == 1} == {("", 1)}


def test_trie():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(3000)]
    trie, least = audit.Trie(), {}
    for i, t in enumerate(texts):
        key = rng.randrange(10_000)
        trie.add(t, key, "p", 0)
        least[t] = min(key, least.get(t, key))
    assert {t: x.least for t, x in trie.terminals()} == least


# --- BPE


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(library):
    rng = random.Random(1)
    some = "abcdefghiİß éÅ中文字😀\n\t  12,.'sté́\x85\x1c "
    pool = [*range(1, 0xD800), *range(0x10000, 0x33500)] * 2 + [*range(0xE000, 0x110000)]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["".join(map(chr, rng.choices(pool, k=rng.randrange(40)))) for _ in range(10_000)]
    texts += ["a" * n for n in (1, 2, 3, 1023, 1024, 1025, 5000)] + ["ab" * 3000, " " * 2000, "=" * 1500, "".join(rng.choice("abcdef") for _ in range(30_000))]
    own = Encoder(RANKS, public_tokenizers.PATTERN)
    for ids, text in zip(own.encode(texts), texts, strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert own.ranks.decode(ids).tobytes() == text.encode()


def test_bpe_forgets(library):
    own = Encoder(RANKS, public_tokenizers.PATTERN)
    own.known.words, own.known.keep, own.known.chars = 50, 20, 400
    rng = random.Random(2)
    for _ in range(60):
        texts = [" ".join("".join(rng.choices("abcxyz", k=rng.randrange(1, 9))) for _ in range(10)) for _ in range(3)]
        assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_trees_agree():
    ranks, rng = Ranks(RANKS), random.Random(4)
    words = [bytes(rng.choice(b"aeinst\xc3\xa9 ") for _ in range(rng.randrange(2, 65))) for _ in range(2000)]
    ids, sizes = merge_many(words, ranks)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [merge_one(w, ranks) for w in words]


def test_bpe_rows(spark, library):
    long = "lorem ipsum dolor " * 30_000
    rows = [(1, "ein Text"), (None, None), (2, ""), (1, "ein Text"), (None, "x"), (3, long)]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, ids int, `a.b` string")
    got = sorted((r.doc_id or 0, r.ids, bytes(r.bytes)) for r in bpe_decode(bpe_encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect())
    assert got == sorted((d or 0, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert bpe_decode(bpe_encode(docs.where("false"), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_byte_bpe"](spark, sf_dir).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {d: (len(i := library.encode_ordinary(t)), sha(",".join(map(str, i)).encode()), sha(t.encode())) for d, t in docs.items()}


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(v, label, x) for v, label, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    longest = max((len(x) for *_, x in kept), default=0)
    width = -(-longest // parts)
    whole = [[int(np.floor(np.float64(c) * 4096)) for c in x] + [0] * (parts * width - len(x)) for *_, x in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
        return [[min((away(w[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for w in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in range(len(cut)) if found[i][p][1] == e]
                if own:
                    books[p][e] = [sum(x[j] for x in own) // len(own) for j in range(width)]
    found, top = assign(), (1 << 63) - 1
    errors = [min(sum(d for d, _ in f), top) for f in found]
    by_label = {}
    for (_, label, _), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(repr((k[0], k[1], [e for _, e in f], err, min(by_label[k[1]], top), digest)) for k, f, err in zip(kept, found, errors))


def coded(spark, rows):
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, error int, codes int").repartition(3)
    return sorted(repr((r.vec_id, r.label, r.codes, r.error, r.label_error, r.codebooks_sha256)) for r in codes.compress(vectors).collect())


def as_floats(x):
    return None if x is None else [None if c is None else float(np.float32(c)) for c in x]


@pytest.mark.parametrize("scale", [0.1, 1.0, 3e4, 1e7, 1e30])
def test_codes(spark, scale):
    """By scale: products in one limb, in several, and beyond int64."""
    rng = np.random.default_rng(int(np.log10(scale)) + 50)
    n = 120 if scale < 1e20 else 40
    rows = [(int(rng.integers(0, 100)) if i % 7 else None, int(rng.integers(0, 4)) if i % 5 else None, as_floats(rng.standard_normal(24) * scale)) for i in range(n)]
    rows += [(3, 1, None), (4, 1, as_floats([0.1] * 23 + [float("nan")])), (5, 1, as_floats([None] * 24)), (6, 1, as_floats([float("inf")] * 24)), (2, None, []), (1, 2, as_floats([0.5] * 10))]
    rows += rows[:5]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_outlier_and_ties(spark):
    """Huge vectors beside plain ones, and equal distances."""
    rows = [(i, 0, as_floats([i % 3] * 16)) for i in range(30)] + [(50, 0, as_floats([1e20] * 16)), (51, 1, as_floats([-1e20] * 16))]
    assert coded(spark, rows) == plain_codes(rows)
    rows = [(i, None, as_floats([0.25, -0.25] * 4)) for i in range(5)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, [(1, 1, None)]) == [] and coded(spark, [(1, 1, [])]) == plain_codes([(1, 1, [])])


def test_limb_products():
    rng = np.random.default_rng(1)
    for high in (1, 100, 1 << 20, 1 << 29):
        x, y = rng.integers(-high, high, (50, 9)), rng.integers(-high, high, (16, 9))
        assert (codes.limb_dot(x, y) == x @ y.T).all()
