"""Line dedup over a whole corpus, in DataFrame functions alone.

The 128-bit hash of each line's key is range-partitioned and sorted by document and position, and the first
occurrences are streamed off each run of equal hashes. A line that a third of all documents hold would make one run,
so runs are first dealt over salts by document: a first round finds each (hash, salt) run's first document, and only
those few rows per hash meet in a second round. What comes back is not text but a keep bitmap per document, compressed:
words of 64 lines that all stay are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnstide.llm.shared import BLANKS, ascii_lower, settle, whole_row

#: Bits of a bitmap word.
WORD = 64


def line_keys(text: Column) -> Column:
    """Array of the lines' keys: the line without blanks at its ends, A-Z lower-cased."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS))))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, text_hash, keep, words)`` for the documents that lose lines: ``keep`` holds, by number, the words of 64
    line positions of which some are lost, with a 1 for each line that stays; words that aren't there are all ones, as
    are the bits of lines that aren't there. ``words`` is the same without gaps.

    A line is lost if its key has at least ``min_chars`` code points and a document with a smaller doc_id holds the
    key too. Rows of one doc_id are one document; null doc_ids are one document that comes last.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # hashed below the explode: above it each line would hash the whole text
    hashed = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), line_keys(F.col("text")).alias("keys"))
    lines = hashed.select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars)
    # settled, as sampling the splitters would split and hash all texts a second time
    lines = settle(lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "text_hash", "pos"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("pos")]

    def first(rows: DataFrame, *key: str) -> DataFrame:
        dealt = rows.repartitionByRange(salts, *key)
        return dealt.withColumn("is_first", F.col("doc_id").eqNullSafe(F.first("doc_id").over(Window.partitionBy(*key).orderBy(*order))))

    one = first(lines, "h1", "h2", "salt")
    two = first(one.where("is_first").drop("is_first"), "h1", "h2")
    lost = one.where("not is_first").select("doc_id", "text_hash", "pos").union(two.where("not is_first").select("doc_id", "text_hash", "pos"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % WORD))
    words = lost.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bitwise_not(bits).alias("bits"))
    packed = words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))
    last = lambda i: F.coalesce(F.get("keep", i - 1)["word"], F.lit(-1))
    ones = lambda n: F.array_repeat(F.lit(-1).cast("bigint"), n)
    dense = F.flatten(F.transform("keep", lambda x, i: F.concat(ones(x["word"] - last(i) - 1), F.array(x["bits"]))))
    return packed.select("doc_id", "text_hash", "keep", dense.alias("words"))


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` as ``(row struct, kept_text, n_lines, n_dropped, keep)``: each row whole, its lines that stay joined by
    newlines, and the compressed bitmap of them, empty where all stay.

    A null or empty text is one empty line and stays empty. Repeated rows lose the same lines; rows of one doc_id with
    different texts are one document, and of its equal lines all stay. Texts and lines may be of any length. Columns of
    any name come back in ``row``. An empty table gives an empty one.
    """
    maps = keep_bitmaps(docs, min_chars).withColumnsRenamed({"doc_id": "map_id", "text_hash": "map_hash"})
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("row_id"), text_hash(F.col("text")).alias("row_hash"))
    joined = rows.join(maps, F.col("row_id").eqNullSafe(F.col("map_id")) & (F.col("row_hash") == F.col("map_hash")), "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n")
    word = lambda i: F.coalesce(F.get("words", F.floor(i / WORD).cast("int")), F.lit(-1).cast("bigint"))
    kept = F.filter(lines, lambda _, i: F.call_function("shiftright", word(i), i % WORD).bitwiseAND(F.lit(1)) == 1)
    n_dropped = F.coalesce(F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(F.bitwise_not(w))), F.lit(0).cast("bigint"))
    none = F.array().cast("array<struct<word:int,bits:bigint>>")
    return joined.select(
        "row",
        F.when(F.col("words").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(lines).cast("bigint").alias("n_lines"),
        n_dropped.alias("n_dropped"),
        F.coalesce("keep", none).alias("keep"),
    )


def line_dedup_texts(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the lines that stay as ``text`` (and their length as ``n_chars``, where there is one)."""
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return line_dedup(docs, min_chars).select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
