"""Series and top lists of a running stream, kept in state: five-minute samples by event-time timers, half-hour means
as a second window over them, and ranked lists that are updated as counts grow.

Before the state each task adds up what it reads of a batch (a stream has no partial aggregates of its own), so a hot
key brings a row a task and view, not a row a query. The state store must be RocksDB's (``use_rocksdb``)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dnstide.functions.names import valid_key
from dnstide.functions.stamps import stamp
from dnstide.operators.counters import keys_of
from dnstide.operators.rates import HALF, HOUR, MARK, TICK, end_of
from dnstide.operators.topn import list_size
from dnstide.plans.rollup import named
from dnstide.streaming.jobs import LATE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, as processors with timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


#: Rows that a task gathers before it adds them up, and different groups from which on it hands on what it has.
GATHER, HELD = 1 << 16, 1 << 20


def added_up(rows: DataFrame, sums: dict[str, str], gather: int = GATHER, most: int = HELD) -> DataFrame:
    """``rows`` with the columns ``sums`` (name to type) added up over equal other columns, by each task for itself. A
    task holds about ``most`` groups: where it meets more, a group may come out several times, in parts."""
    by = [c for c in rows.columns if c not in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        groups = waiting = 0

        def together() -> pa.Table:
            return pa.concat_tables(held).group_by(by).aggregate([(c, "sum") for c in sums]).rename_columns([*by, *sums])

        for b in batches:
            held.append(pa.Table.from_arrays(b.columns, names=b.schema.names))  # a field's "not null" would differ from that of a sum
            waiting += b.num_rows
            if waiting >= max(gather, groups):  # as many new rows as groups, so that groups aren't added up over and over
                held, waiting = [together()], 0
                groups = held[0].num_rows
                if groups >= most:
                    yield from held.pop().to_batches()
                    groups = 0
        if held:
            yield from together().to_batches()

    kinds = dict(rows.dtypes) | sums
    return rows.select(*by, *(F.col(c).cast(t).alias(c) for c, t in sums.items())).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, *sums)))


def under_keys(rows: DataFrame) -> DataFrame:
    """Sums by view and zone, dealt to both keys."""
    rest = [c for c in rows.columns if c not in ("view", "zone")]
    return rows.select(F.explode(keys_of(F.col("view"), F.col("zone"))).alias("key"), *rest).where(valid_key(F.col("key")))


class Samples(StatefulProcessor):
    """Of each key the running hour's sums up to its next mark, and the sums of five minutes that are still open; a
    timer at the next mark, up to the hour's end, gives a row. Times are whole seconds. Open five minutes are as few as
    the watermark's delay has marks, but where a whole log is read at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next bigint, n bigint, failed bigint, marks array<bigint>, sums array<array<bigint>>")
        self.done: dict = {}

    def _held(self) -> tuple:
        at, n, failed, marks, sums = self.state.get() if self.state.exists() else (None, 0, 0, [], [])
        return at, n, failed, dict(zip(marks, map(tuple, sums)))

    def _hold(self, at, n: int, failed: int, sums: dict) -> None:
        due = at if at is not None else min(sums, default=None)
        if due is None:
            self.state.clear()
        else:
            self.state.update((at, n, failed, list(sums), [list(x) for x in sums.values()]))
            self.handle.registerTimer(due * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        at, n, failed, sums = self._held()
        for r in rows:
            if r.mark * 1000 > passed:  # else its rows are out: a late line
                own = sums.get(r.mark, (0, 0, 0))
                sums[r.mark] = (own[0] + r.n, own[1] + r.failed, own[2] + r.last)
        self._hold(at, n, failed, sums)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Every mark up to the watermark that is due; a second timer of the same batch finds nothing left."""
        passed = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key) == passed:
            return
        self.done[key] = passed
        at, n, failed, sums = self._held()
        waiting = iter(sorted(sums))
        while True:
            if at is None:  # the next mark with a query starts an hour
                at, n, failed = next((m for m in waiting if m in sums), None), 0, 0
                if at is not None and at * 1000 > passed:
                    at = None  # its hour may still get an earlier one
            if at is None or at * 1000 > passed:
                break
            own = sums.pop(at, (0, 0, 0))
            n, failed = n + own[0], failed + own[1]
            rate = (n - failed) / n
            e = datetime.fromtimestamp(at, UTC)
            yield Row(key=key[0], e=e, second=at, qps=own[2] / 10.0, success_rate=1.0 if rate < 0.1 else rate)
            if at % HALF == 0:  # just before the mark, so that it falls into the half hour that ends
                yield Row(key=key[0], e=e - timedelta(microseconds=1), second=None, qps=None, success_rate=None)
            at = at + MARK if at % HOUR else None
        self._hold(at, n, failed, sums)

    def close(self) -> None:
        pass


def _sampled(records: DataFrame, late: str) -> DataFrame:
    """``key, e, second, qps, success_rate`` with the event time ``e``: samples, and at half-hour marks of live keys a
    row without a second."""
    mark = F.unix_seconds(end_of(F.col("ts"), MARK))
    last = (F.unix_seconds("ts") >= mark - TICK).cast("bigint")
    told = records.withWatermark("ts", late).select("view", "zone", mark.alias("mark"), F.lit(1).alias("n"), (F.col("rcode") == "SERVFAIL").cast("bigint").alias("failed"), last.alias("last"))
    sums = under_keys(added_up(told, {"n": "bigint", "failed": "bigint", "last": "bigint"}))
    return sums.groupBy("key").transformWithState(Samples(), "key string, e timestamp, second bigint, qps double, success_rate double", "append", "EventTime", eventTimeColumnName="e")


def stream_samples(records: DataFrame, late: str = LATE) -> DataFrame:
    """What five_minute_samples gives, as a stream: ``key, stamp, qps, success_rate`` once the watermark passes a mark,
    for each live key, with or without a query in its five minutes. Lines later than the watermark don't count."""
    return _sampled(records, late).where("second is not null").select("key", stamp(F.timestamp_seconds("second")).alias("stamp"), "qps", "success_rate")


def stream_half_hours(records: DataFrame, late: str = LATE) -> DataFrame:
    """What half_hour_mean gives, as a second window over the samples of the same stream: ``key, stamp, qps,
    success_rate`` at each half-hour mark of keys that are live then."""
    means = _sampled(records, late).groupBy(F.window("e", "30 minutes").alias("w"), "key")
    rows = means.agg(F.avg("qps").alias("q"), F.avg("success_rate").alias("s"), F.count_if(F.col("second").isNull()).alias("live")).where("live > 0")
    return rows.select("key", stamp(F.col("w.end")).alias("stamp"), F.coalesce("q", F.lit(0.0)).alias("qps"), F.coalesce("s", F.lit(1.0)).alias("success_rate"))


class TopLists(StatefulProcessor):
    """Exact counts of a group's names, and its ``n`` largest beside them, in order. Counts only grow, so a name that
    was counted again is all that can move. A group is given up once the watermark passes its ``expires`` second."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "name string", "count bigint")
        self.top = handle.getValueState("top", "counts array<bigint>, names array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kind, hour, view = key
        if hour * 1000 <= timerValues.getCurrentWatermarkInMs():
            return
        new: dict[str, int] = {}
        for r in rows:
            new[r.name] = new.get(r.name, 0) + r.n
        known = self.top.exists()  # a new group has no counts to ask for
        held = sorted((-c, x) for c, x in zip(*self.top.get())) if known else []
        for name, n in new.items():
            before = self.counts.getValue((name,))[0] if known and self.counts.containsKey((name,)) else 0
            self.counts.updateValue((name,), (before + n,))
            i = bisect_left(held, (-before, name))
            if i < len(held) and held[i] == (-before, name):
                del held[i]
            elif len(held) == self.n and (-before - n, name) > held[-1]:
                continue
            insort(held, (-before - n, name))
            del held[self.n :]
        self.top.update(([-c for c, _ in held], [x for _, x in held]))
        self.handle.registerTimer(hour * 1000)
        for rank, (count, name) in enumerate(held, 1):
            yield Row(kind=kind, second=hour, key=view, name=name, count=-count, rank=rank)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.counts.clear()
        self.top.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_topn(records: DataFrame, n: int | None = None, late: str = LATE) -> DataFrame:
    """``kind, hour, key, name, count, rank``: with each batch the whole top lists that it changed, of domains and
    clients since the hour mark; a group's list is that of its latest batch. Read no earlier batch for it. Lines of an
    hour count until the watermark passes its end."""
    hour = F.unix_seconds(end_of(F.col("ts"), HOUR))
    names = named(*map(F.col, ("domain", "client_ip", "rcode", "rtype")))
    told = records.withWatermark("ts", late).select("view", "zone", hour.alias("second"), F.inline(F.slice(names, 1, 2)), F.lit(1).alias("n")).where("name is not null")
    sums = under_keys(added_up(told, {"n": "bigint"}))
    lists = sums.groupBy("kind", "second", "key").transformWithState(TopLists(list_size(n)), "kind string, second bigint, key string, name string, count bigint, rank int", "update", "EventTime")
    return lists.select("kind", hour_stamp(F.col("second")), "key", "name", "count", "rank")


def hour_stamp(second: Column) -> Column:
    return stamp(F.timestamp_seconds(second)).alias("hour")
