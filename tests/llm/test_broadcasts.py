"""What joins send whole to the driver, where tables are exploded."""

import random

import pytest
from pyspark.sql import functions as F

from dnstide.llm.near_dedup import near_dedup
from dnstide.llm.shared import settle
from dnstide.llm.simhash import _midpoint_links, cover_masks, links

LIMIT = 32 << 10


@pytest.fixture
def most_rows(spark):
    """The most rows of a broadcast since the test began; tables beyond LIMIT aren't to be broadcast."""
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(LIMIT))

    def most() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = [0]
        for i in range(began, store.executionsCount()):
            run = store.executionsList().apply(i).executionId()
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in map(nodes.apply, range(nodes.size())):
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if node.name() == "BroadcastExchange" and m.name() == "number of output rows":
                        found.append(int(values.get(m.accumulatorId()).getOrElse(None).replace(",", "") if values.contains(m.accumulatorId()) else 0))
        return max(found)

    yield most
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def numbers(spark, values):
    return settle(spark.createDataFrame([(x,) for x in values], "fp bigint").coalesce(1))


def test_tables_of_fingerprints(spark, most_rows):
    """1000 fingerprints are 8 KB, but 31,000 rows in the covering tables."""
    draw = random.Random(1)
    far = [draw.getrandbits(63) for _ in range(1000)]
    found = links(numbers(spark, far + [far[0] ^ 3]), 4).collect()
    assert [{*r} for r in found] == [{far[0], far[0] ^ 3}]
    assert most_rows() <= LIMIT // 16  # a row has 16 bytes at least


def test_midpoints(spark, most_rows):
    draw = random.Random(2)
    base = draw.getrandbits(63)
    rows = numbers(spark, [base ^ (1 << i) for i in range(62)]).select(F.lit(0).alias("t"), "fp")
    assert _midpoint_links(rows, cover_masks(4), 2).count() > 30
    assert most_rows() <= LIMIT // 16


def test_bands_of_sets(spark, most_rows):
    """150 sets are 24 rows each in the bands' buckets."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    texts = [[word() for _ in range(60)] for _ in range(75)]
    docs = [(2 * i + j, " ".join([*words, *["end"] * j])) for i, words in enumerate(texts) for j in range(2)]
    docs = settle(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1))
    assert near_dedup(docs).count() == 75
    assert most_rows() <= LIMIT // 16
