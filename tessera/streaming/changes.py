"""File change streams: what changed, debounced, by priority. Every step has a batch form that a table runs too."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.operators import sync
from tessera.operators.graph import saved
from tessera.sources.keyed import Keyed

OUT = "path string, ts timestamp, kind string, previous string, current string"


def classify(events: DataFrame) -> DataFrame:
    """(path, ts, kind, previous, current) of observations (path, ts, hash); a null hash says that the file is gone.

    Created, modified or deleted against the hash before; an observation that changes nothing is dropped.
    """
    before = F.lag("hash").over(W.partitionBy("path").orderBy("ts"))
    kind = F.when(F.col("previous").isNull() & F.col("hash").isNotNull(), "created").when(F.col("hash").isNull() & F.col("previous").isNotNull(), "deleted").when(F.col("hash") != F.col("previous"), "modified")
    return events.select("path", "ts", "hash", before.alias("previous")).withColumn("kind", kind).where("kind IS NOT NULL").select("path", "ts", "kind", "previous", F.col("hash").alias("current"))


#: What a state store must be for processors with timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class _InOrder(StatefulProcessor):
    """Rows of a key in order of their time, across micro-batches: they wait until the watermark has passed them, and a timer wakes the key. A key that has been silent for ``keep`` milliseconds is forgotten."""

    #: Columns of a waiting row, the time first, and of what is known of a key.
    ROW, KNOWN = "", ""

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.known = handle.getValueState("known", self.KNOWN)
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        arrived = [row for part in rows for row in self.arrive(part)]
        if arrived:
            self.waiting.appendList(arrived)
            self.handle.registerTimer(min(_millis(r[0]) for r in arrived))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: tuple(r)[: self.ORDERED])
        due, later = [r for r in rows if _millis(r[0]) <= now], [r for r in rows if _millis(r[0]) > now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(_millis(later[0][0]))
        else:
            self.waiting.clear()
        last = self.seen.get()[0] if self.seen.exists() else None
        for burst in self._bursts(due):
            if last is not None and self.keep is not None and _millis(burst[0][0]) - last > self.keep:
                self.known.clear()
            last = _millis(burst[-1][0])
            yield self.take(key, burst)
        if due:
            self.seen.update((last,))
            if self.keep is not None:
                self.handle.registerTimer(last + self.keep + 1)
        if self.keep is not None and not later and last is not None and now > last + self.keep:
            self.known.clear()
            self.seen.clear()

    def _bursts(self, rows: list) -> Iterator[list]:
        """Rows without a silence of more than ``keep`` between them: what a silence ends depends on times alone, not on when timers go off."""
        begin = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or self.keep is not None and _millis(rows[k][0]) - _millis(rows[k - 1][0]) > self.keep:
                yield rows[begin:k]
                begin = k

    def close(self) -> None:
        pass


class _Classifier(_InOrder):
    ROW, KNOWN, ORDERED = "ts timestamp, hash string", "hash string", 1

    def arrive(self, part: pd.DataFrame) -> list[tuple]:
        return [(ts.to_pydatetime(), None if pd.isna(h) else h) for ts, h in zip(part["ts"], part["hash"], strict=True)]

    def take(self, key, due: list) -> pd.DataFrame:
        last, out = self.known.get()[0] if self.known.exists() else None, []
        for ts, now in due:
            kind = None if now == last else "created" if last is None else "deleted" if now is None else "modified"
            if kind:
                out.append((key[0], pd.Timestamp(ts), kind, last, now))
            last = now
        if last is None:
            self.known.clear()
        else:
            self.known.update((last,))
        return pd.DataFrame(out, columns=["path", "ts", "kind", "previous", "current"])


def classify_stream(events: DataFrame, late: str | None = None, keep: str | None = None) -> DataFrame:
    """As ``classify`` on a stream: the last hash of each path is its state.

    With ``late``, rows up to that late are taken in order of their time whatever micro-batch brings them: a row waits
    until the watermark has passed it, so the result is that of the batch; rows later than that are dropped. A path
    that has been silent for ``keep`` (event time) is forgotten: its next hash is a creation. The state store must be
    STATE_STORE. Without ``late`` only the rows within a micro-batch are put in order, and nothing waits.
    """
    if late:
        keep = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
        marked = events.select("path", "ts", "hash").withWatermark("ts", late)
        return marked.groupBy("path").transformWithStateInPandas(_Classifier(keep), OUT, "append", "eventtime")

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, now in zip(rows["ts"], rows["hash"], strict=True):
            now = None if pd.isna(now) else now
            kind = None if now == last else "created" if last is None else "deleted" if now is None else "modified"
            if kind:
                out.append((key[0], ts, kind, last, now))
            last = now
        if last is None:
            state.remove()
        else:
            state.update((last,))
        yield pd.DataFrame(out, columns=["path", "ts", "kind", "previous", "current"])

    return events.groupBy("path").applyInPandasWithState(step, OUT, "hash string", "append", "NoTimeout")


def debounce(events: DataFrame, gap: str = "5 seconds", late: str | None = None) -> DataFrame:
    """The last event of each burst of a path: events less than ``gap`` apart are one burst. ``late`` is the watermark on a stream."""
    if late:
        events = events.withWatermark("ts", late)
    rest = [c for c in events.columns if c not in ("path", "ts")]
    got = events.groupBy("path", F.session_window("ts", gap).alias("burst")).agg(F.max(F.struct("ts", *rest)).alias("e"), F.count("*").alias("n_events"))
    return got.select("path", "e.*", "n_events")


#: Languages whose files go first.
CRITICAL = ("typescript", "javascript", "python", "java", "go")


def priority(kind: Column, size: Column, language: Column) -> Column:
    base = F.when(kind == "deleted", 4).when(kind == "modified", 2).when(kind == "created", 1).otherwise(0)
    step = F.when(size < 1024, 1).when(size > 1024 * 1024, -1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(4), base + step + F.when(language.isin(*CRITICAL), 1).otherwise(0)))


def batches(events: DataFrame, size: int = 50, by: str = "priority", order: str = "seq") -> DataFrame:
    """``events`` with the number of the batch in which they are taken: highest priority first, in order inside.

    Rows are dealt by ranges of (priority, order) and counted inside each range, so no task holds all rows of a
    priority: a place is the rows of the ranges before, plus those of the same range that come before. Rows without a
    priority come last.
    """
    place = [F.desc(by), F.asc(order)]
    ranged = saved(events.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_range": F.shiftright("_id", 33), "_r": F.col("_id").bitwiseAND((1 << 33) - 1)})  # the parts of such an id
    per = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    above = per.alias("a").join(per.alias("b"), F.col("b._range") < F.col("a._range"), "left").groupBy(F.col("a._range").alias("_range")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_above"))
    placed = ranged.join(F.broadcast(above), "_range")  # a row a range
    return placed.withColumn("batch", F.floor((F.col("_above") + F.col("_r")) / size)).drop("_r", "_above", "_id", "_range")


def history(events: DataFrame, n: int = 10) -> DataFrame:
    """The newest n events of each path."""
    return events.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("ts")))).where(F.col("_r") <= n).drop("_r")


def windowed(events: DataFrame, size: str = "5 seconds", slide: str | None = None, late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, keys, n, total) of tumbling or sliding windows of event time."""
    if late:
        events = events.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def index_batch(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], dead: Callable[[DataFrame], None] | None = None, key: str = "path", tries: int = 3, wait: float = 1.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a store that is read and written as a whole and knows no epochs (``index_epochs`` is for those that do): deletes first, then upserts; rows without a key go to the dead letters.

    A write that fails is tried again after ``wait`` seconds, then twice that, ``tries`` times in all; then the batch
    goes to the dead letters if there are any, and is an error if not. A batch that cannot be read is an error at once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        with _held(batch) as batch:
            good = batch.where(F.col(key).isNotNull())
            if dead is not None:
                dead(batch.where(F.col(key).isNull()))

            def once() -> None:
                left = sync.delete(read(), good.where("kind = 'deleted'"), key)
                write(sync.upsert(left, good.where("kind <> 'deleted'").select(*left.columns), key, "ts" if "ts" in left.columns else None))

            error = _tried(once, tries, wait)
            if error is not None:
                if dead is None:
                    raise error
                dead(good)

    return run


@contextmanager
def _held(batch: DataFrame) -> Iterator[DataFrame]:
    """The batch, read once: what cannot be read fails here, and not as if a store had."""
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        batch.count()
        yield batch
    finally:
        batch.unpersist()


def _tried(work: Callable[[], object], tries: int, wait: float) -> Exception | None:
    """The last error, if all tries fail."""
    for n in range(1, tries + 1):
        try:
            work()
            return None
        except Exception as e:  # whatever a store raises
            error = e
            if n < tries:
                time.sleep(n * wait)
    return error


@dataclass
class Store:
    """A keyed table that follows a stream: ``upserts`` and ``deletes`` make its rows, and its keys that go, of a batch of changes."""

    table: Keyed
    upserts: Callable[[DataFrame], DataFrame]
    deletes: Callable[[DataFrame], DataFrame] | None = None
    order: str | None = None


class DeadLetters:
    """Rows that a store did not take, as JSON, by stream and epoch; an epoch that comes again takes its own place."""

    def __init__(self, spark: SparkSession, database: str, name: str = "dead_letters"):
        self.spark, self.name = spark, f"`{database}`.`{name}`"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (store STRING, row STRING, stream STRING, epoch BIGINT) USING parquet PARTITIONED BY (stream, epoch)")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def put(self, rows: DataFrame, stream: str, epoch: int) -> None:
        """``rows``: (store, row)."""
        spark = rows.sparkSession
        old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.select("store", "row", F.lit(stream).alias("stream"), F.lit(epoch).cast("long").alias("epoch")).write.mode("overwrite").insertInto(self.name)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def index_epochs(stores: Sequence[Store], stream: str, dead: DeadLetters | None = None, key: str = "path", tries: int = 3, wait: float = 1.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that brings each batch of changes (key, kind, ...) into every store once.

    Each store remembers the last epoch of the stream it has taken, so a batch that comes again, after a failure
    between two stores too, changes only those that lack it. A batch is read once; in each store deletes come first,
    then upserts. A store that fails ``tries`` times (with waits of ``wait`` seconds, twice that, ...) leaves the batch
    to the dead letters; without these it is an error, and the next start takes the batch again. Rows without a key
    are dead letters of no store.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        with _held(batch) as batch:
            good = batch.where(F.col(key).isNotNull())
            left = [batch.where(F.col(key).isNull()).select(F.lit(None).cast("string").alias("store"), F.to_json(F.struct("*")).alias("row"))]
            for store in stores:
                table = store.table.using(batch.sparkSession)
                gone = None if store.deletes is None else store.deletes(good.where("kind = 'deleted'"))
                new = store.upserts(good.where("kind <> 'deleted'"))
                error = _tried(lambda table=table, new=new, gone=gone, store=store: table.apply(new, gone, store.order, stream, epoch), tries, wait)
                if error is not None:
                    if dead is None:
                        raise error
                    left.append(good.select(F.lit(f"{table.database}.{table.plain}").alias("store"), F.to_json(F.struct("*")).alias("row")))
            if dead is not None:
                dead.put(reduce(lambda a, b: a.union(b), left), stream, epoch)

    return run


def _adapted(state: tuple, values: list[float], size: int) -> tuple:
    """(weight, confidence, batches, rest) after more feedback."""
    weight, sure, n, rest = state
    rest = [*rest, *values]
    while len(rest) >= size:
        mean, rest, n = sum(rest[:size]) / size, rest[size:], n + 1
        rate = 0.05 if mean >= 0.7 else -0.1 if mean <= 0.3 else 0.0
        weight, sure = max(0.0, min(1.0, weight * (1 + rate))), min(1.0, sure + 0.1 * abs(rate))
    return weight, sure, n, rest


class _Adapter(_InOrder):
    ROW, KNOWN, ORDERED = "ts timestamp, seq long, relevance double", "weight double, confidence double, batches long, rest array<double>", 2

    def __init__(self, keep: int | None, start: float, size: int):
        super().__init__(keep)
        self.start, self.size = start, size

    def arrive(self, part: pd.DataFrame) -> list[tuple]:
        return [(ts.to_pydatetime(), int(n), float(x)) for ts, n, x in zip(part["ts"], part["seq"], part["relevance"], strict=True)]

    def take(self, key, due: list) -> pd.DataFrame:
        known = self.known.get() if self.known.exists() else (self.start, 0.5, 0, [])
        now = _adapted((*known[:3], list(known[3])), [r[2] for r in due], self.size)
        self.known.update(now)
        return pd.DataFrame([(key[0], *now[:3])], columns=["key", "weight", "confidence", "batches"])


def adapt_stream(feedback: DataFrame, start: float = 0.5, size: int = 10, late: str | None = None, keep: str | None = None) -> DataFrame:
    """(key, weight, confidence, batches) after each micro-batch, of feedback (key, seq, relevance) on a stream: as ``search.adapted_weights`` has it of the whole table.

    A key's state is its weight, its confidence, the number of batches, and the feedback that does not fill one yet.
    With ``late`` (feedback then has a time ``ts`` too) rows are taken in order of (ts, seq) across micro-batches, and
    a key that has been silent for ``keep`` is forgotten, as in ``classify_stream``.
    """
    out = f"key {feedback.schema['key'].dataType.simpleString()}, weight double, confidence double, batches long"
    if late:
        keep = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
        marked = feedback.select("key", "ts", "seq", "relevance").withWatermark("ts", late)
        return marked.groupBy("key").transformWithStateInPandas(_Adapter(keep, start, size), out, "update", "eventtime")

    def step(key, parts, state):
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        now = _adapted(state.get if state.exists else (start, 0.5, 0, []), rows["relevance"].tolist(), size)
        state.update(now)
        yield pd.DataFrame([(key[0], *now[:3])], columns=["key", "weight", "confidence", "batches"])

    return feedback.groupBy("key").applyInPandasWithState(step, out, "weight double, confidence double, batches long, rest array<double>", "update", "NoTimeout")


def expired(rows: DataFrame, as_of: Column, seconds: str = "ttl") -> DataFrame:
    """Cache rows (ts, ttl in seconds) that are past their time."""
    return rows.where(F.unix_micros(as_of) - F.unix_micros("ts") >= F.col(seconds) * 1_000_000)
