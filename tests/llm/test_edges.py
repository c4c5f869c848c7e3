"""Each operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import duckdb
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from dnstide.llm.decontaminate import contamination, decontaminate
from dnstide.llm.embedding_dedup import embedding_dedup
from dnstide.llm.langid import identify, keep_known_languages, train
from dnstide.llm.line_dedup import line_dedup, line_dedup_texts
from dnstide.llm.near_dedup import near_dedup
from dnstide.llm.oracle import CONTAMINATION
from dnstide.llm.packing import pack
from dnstide.llm.pii import replace_pii
from dnstide.llm.secrets import scan
from dnstide.llm.simhash import simhash_components
from dnstide.llm.suffix_dedup import substring_dedup
from dnstide.llm.url_filter import url_filter

LONG = " ".join(f"word{i} token = {'ab' * 20} mail{i}@x.example.com" for i in range(3000)) + "\n" + "a line that is repeated often enough\n" * 500
#: Extra columns with names that operators use inside.
COLUMNS = "doc_id long, text string, lang string, h1 long, fp long, node string, key string, row string, found_id string, spans string"
ROWS = [(1, "some plain words of a text\nand one more line here", "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (4, LONG, "en"), (4, "another text under the same id", "de"), (None, "a text without an id\nand one more line here", None), (None, None, None), (5, " \n\t\n  ", "en"), (6, "1234 5678 !!", "fr"), (7, "some plain words of a text\nand one more line here", "en")]
TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "n", "k", "r", "d", "s") for r in ROWS], COLUMNS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "some plain words of a text", "x"), (2, None, "x"), (3, "too short", "x"), (1, "some plain words of a text", "x")], "item_id long, text string, doc_id string")


def operators(items):
    return {
        "contamination": (lambda d: contamination(d, items), None),
        "decontaminate": (lambda d: decontaminate(d, items), 9),
        "pack": (lambda d: pack(d, TOKENS), None),
        "substrings": (substring_dedup, 11),
        "pii": (lambda d: replace_pii(d, "k"), 11),
        "secrets": (scan, 11),
        "identify": (lambda d: identify(d, train(d)), 11),
        "languages": (keep_known_languages, None),
        "lines": (line_dedup, 11),
        "line_texts": (line_dedup_texts, 11),
        "simhash": (simhash_components, 11),
        "near_dedup": (near_dedup, None),
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_rows(docs, items, name):
    run, rows = operators(items)[name]
    got = run(docs).collect()
    assert rows is None or len(got) == rows


def test_values_of_odd_rows(docs):
    text = [r[1] or "" for r in ROWS]
    lengths = sorted((r.doc_id or 0, r.doc_tokens) for r in pack(docs, TOKENS).where("start = 0").collect())
    assert len(lengths) == 11 and lengths.count((0, 1)) == 1 and (2, 1) in lengths and (3, 1) in lengths and (5, 1) in lengths
    assert len({n for d, n in lengths if d == 4}) == 2
    gone = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in substring_dedup(docs).collect())
    n = len(LONG.encode())
    assert gone == sorted((r[0] or 0, len(t.encode()), 0 if t == LONG else len(t.encode())) for r, t in zip(ROWS, text)) and (4, n, 0) in gone
    new = {(r.row.doc_id, r.row.text): (r.text, r.entities.email) for r in replace_pii(docs, "k").collect()}
    assert new[2, None] == (None, 0) and new[3, ""] == ("", 0) and new[1, text[0]] == (text[0], 0)
    assert new[4, LONG][1] == 3000 and "@x.example.com" not in new[4, LONG][0]
    spans = sorted((r.doc_id or 0, len(r.spans)) for r in scan(docs).collect())
    assert spans.count((4, 6000)) == 2 and sum(k for _, k in spans) == 12000
    kept = sorted(r.doc_id for r in keep_known_languages(docs.where("doc_id in (1, 2, 3, 5, 6, 7)")).collect())
    assert not {2, 3, 5, 6} & set(kept)


def test_ties(spark):
    """Texts and vectors that are equally near to several; of equals the smallest id decides."""
    words = "a b c d e f g h i j"
    rows = [(9, words), (3, words), (5, words), (3, words), (8, "other words entirely here now"), (7, "other words entirely here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash_components(docs).collect()) == [(3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 3)]
    assert sorted(r.doc_id for r in near_dedup(docs).collect()) == [3, 7]
    both = spark.createDataFrame([(1, "abab abab", "x"), (2, "abab abab", "y")], "doc_id long, text string, lang string")
    got = identify(both, train(both)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("x", 0.5)] * 2


def test_pipeline_stages_on_odd_rows(spark, docs, items):
    """Each stage on the same odd rows: columns as given, nothing but what it is there to drop."""
    import corpus_pipeline

    texts = {r[1] for r in ROWS}
    for name, stage in corpus_pipeline.STAGES:
        if name == "decontaminate":
            got = decontaminate(docs, items)
        else:
            got = stage(spark, docs, None)
        rows = got.collect()
        if name != "packing":
            assert got.columns == docs.columns
        if name == "near_dedup":
            assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 4, 4, 6]
        if name == "line_dedup":
            assert len(rows) == 11
        if name == "packing":
            assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        if name == "decontaminate":
            assert {r.text for r in rows} == texts - {ROWS[0][1]}
        assert name == "packing" or stage(spark, docs.where("false"), None).collect() == [] if name != "decontaminate" else True


@pytest.mark.parametrize("name", list(operators(None)))
def test_empty(docs, items, name):
    assert operators(items)[name][0](docs.where("false")).collect() == []


@pytest.mark.parametrize("run", [line_dedup_texts, keep_known_languages])
def test_filters_keep_columns(docs, run):
    assert run(docs).columns == docs.columns


def test_decontaminate_takes_all_of_the_item(docs, items):
    got = contamination(docs, items)
    assert sorted((r.doc_id, r.item_id, r.containment) for r in got.collect()) == [(1, 1, 1.0)] * 2 + [(7, 1, 1.0)] * 2
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 7)").count() == 0


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_decontaminate_judges_each_row(spark, block_bytes):
    rows = [(None, "some plain words of a text"), (None, "a clean text without an id"), (3, "so some plain words of a text"), (3, "a clean text under the same id"), (None, None), (4, "other words of a second item")]
    items = spark.createDataFrame([(1, "some plain words of a text"), (2, "other words of a second item")], "item_id long, text string")
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "a clean text without an id"), (3, "a clean text under the same id")]


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_items_shorter_than_a_shingle(spark, tmp_path, block_bytes):
    items = [(1, "Paris"), (2, "the answer: B"), (3, "one two three four"), (4, "one two three four five six"), (5, ""), (6, None), (7, "..."), (8, "你好")]
    texts = ["I saw PARIS.", "parisian", "so the  answer\n(b) it is", "the answer is b", "zero one two three four five", "one two three four five six", "two three four", "他说：你好。", "", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    words = lambda t: regex.findall(r"[\p{L}\p{N}_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for d, text in rows:
        for key, item in items:
            own = words(item)
            need = grams(own, min(5, len(own))) if own else set()
            found = len(need & grams(words(text), min(5, len(own))))
            if need and found >= 0.8 * len(need):
                want.add((d, key, len(need), found))
    assert {(0, 1), (2, 2), (4, 3), (5, 3), (5, 4), (7, 8)} == {x[:2] for x in want}
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs, benchmark, block_bytes=block_bytes).collect()
    assert len(got) == len(want) and {tuple(r)[:4] for r in got} == want
    kept = decontaminate(docs, benchmark, block_bytes=block_bytes)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {x[0] for x in want}
    db = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        db.register(name, df.toPandas())
    assert {x[:4] for x in db.sql(CONTAMINATION).project("doc_id, item_id, n_shingles, n_found").fetchall()} == want


def test_near_dedup_keeps_one(docs):
    got = sorted(r.doc_id for r in near_dedup(docs).where("doc_id is not null").select("doc_id").collect())
    assert got == [1, 2, 4, 4, 6]


def test_lines(docs):
    got = {(r.row.doc_id, r.row.text): (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup(docs).collect()}
    assert got[7, ROWS[0][1]] == ("", 2, 2)
    assert got[1, ROWS[0][1]] == (ROWS[0][1], 2, 0)
    assert got[None, ROWS[6][1]] == ("a text without an id", 2, 1)
    assert got[4, LONG] == (LONG, 502, 0)
    assert got[2, None] == ("", 1, 0)
    assert got[5, ROWS[8][1]] == (ROWS[8][1], 3, 0)


def test_language_of_nothing_is_und(docs):
    got = identify(docs, train(docs.where("lang is not null")))
    assert {r.lang_pred for r in got.where("doc_id in (2, 3, 5, 6)").collect()} == {"und"}
    assert {r.lang_pred for r in identify(docs, train(docs.where("false"))).collect()} == {"und"}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://X.ORG"), (5, "http://a.org/x?y"), (6, "http://example.org/en/10"), (7, "ftp://b.com/de/#z"), (8, "http://cheap-pills.net/"), (9, "http://cheappills.net/free/loan"), (10, "http://freeloan.net/"), (11, "http://free.net/sextet"), (12, "http://u://v/x")]
    got = url_filter(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "allow", "allow", "allow", "allow", "block", "block", "block", "block", "allow", "allow", "allow"]
    assert [r.host for r in got] == ["", "", "", "x.org", "a.org", "example.org", "b.com", "cheap-pills.net", "cheappills.net", "freeloan.net", "free.net", "u:"]
    assert [r.rule for r in got][3:7] == [None, "org/", "example.org/en/1", "com/de/"]
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_vectors(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.01]), (3, 2, [1.0, 0.0]), (4, 1, None), (5, 1, [0.0, 0.0]), (6, 1, [1.0, None]), (7, 1, [float("nan"), 1.0]), (8, None, [1.0, 0.0]), (9, 1, [1.0, 0.0]), (9, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (10, 1, [1.0, 0.0, 0.0]), (11, 1, []), (12, 1, [float("inf"), 1.0])]
    got = {(r.vec_id, r.label): (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert got[1, 1] == (4, 1, True) and got[2, 1] == (4, 1, False) and got[9, 1] == (4, 1, False) and got[None, 1] == (4, 1, False)
    for key in ((3, 2), (4, 1), (5, 1), (6, 1), (7, 1), (8, None), (10, 1), (11, 1), (12, 1)):
        assert got[key] == (0, key[0], True)
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).collect() == []


#: Names that operators use inside, and names that need quoting.
INSIDE = ["stay_id", "stay_hash", "_text_hash", "text_hash", "own_id", "own_hash", "again", "again_id", "again_hash", "map_id", "map_hash", "row_id", "row_hash", "found_id", "found_hash", "range_id", "range_hash", "list_id", "list_hash", "words", "keep", "new", "counts", "set", "n", "component", "a.b", "c d", "e`f", "row", "terms"]


@pytest.mark.parametrize("name", list(operators(None)))
def test_clashing_names(spark, items, name):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    odd = plain.select("*", *(F.lit(i).alias(c) for i, c in enumerate(INSIDE)))
    run, rows = operators(items)[name]
    got = run(odd)
    n = got.count()
    assert n == run(plain).count() and (rows is None or n == rows)
    if set(odd.columns) <= set(got.columns):
        assert got.columns == odd.columns and {tuple(r)[3:] for r in got.collect()} == {tuple(range(len(INSIDE)))}


def test_clashing_names_of_other_tables(spark):
    odd = [F.lit(i).alias(c) for i, c in enumerate(INSIDE + ["node", "key", "low", "h1", "member"])]
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string").select("*", *odd)
    assert url_filter(pages).where("verdict = 'allow'").count() == 2
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.01])], "vec_id long, label int, embedding array<float>").select("*", *odd)
    assert [r.component_id for r in embedding_dedup(vectors).collect()] == [1, 1]


def test_many_lines(spark):
    """Two texts of a million equal lines: time in proportion to the lines."""
    text = "\n".join(f"line number {i}" for i in range(1_000_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nand one line more")], "doc_id long, text string")
    got = {r.row.doc_id: (r.kept_text, r.n_dropped) for r in line_dedup(docs).collect()}
    assert got[1] == (text, 0) and got[2] == ("and one line more", 1_000_000)


def test_long_alike_texts(spark):
    """A bucket of long texts goes through few chunks, whatever its shingles."""
    words = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(words[: 60_000 - 5 * i]) + f" end {i}" for i in range(40)] + [" ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(docs, hot=4).select("doc_id").collect()) == [0, 40]
