"""State of one's own over many batches and a restart, and outer joins of streams.

State is kept in RocksDB, so it may be larger than memory, and is told by the checkpoint in the shared folder: a stopped stream, or one whose executors were lost, goes on
from there. A key's state and its rows of one batch are in one task, which a batch's size (maxFilesPerTrigger) bounds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.shared import Scratch
from tessera.sources.tables import table
from tessera.streaming.events import run_once, source

#: Functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SESSION = "user_id long, start timestamp, n long, top string, total double, before long"


#: Users are dealt over so many keys of the state.
BUCKETS = 256
_USERS = "timer long, users array<struct<known:boolean,user:long,start:long,last:long,n:long,cents:long,kinds:map<string,long>,before:long>>"


class Sessions(StatefulProcessor):
    """Sessions of users' events, which end when none comes for gap milliseconds: one row each, with the kind seen most (ties by name), the sum of the values
    in cents, over 100, and how many sessions the user had before.

    A key of the state is a bucket of users: for each its open session (none where n is 0), with the counts of its kinds, and the number of sessions so far. The state is read once
    and written once a bucket and batch, as each call and each access is a message between processes, and calls do not grow with the users. A session is given out when
    an event after the gap comes, or by the bucket's timer, which is set to the first end of an open one, when the watermark passes its end.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("users", _USERS)

    def _held(self) -> tuple[int | None, dict]:
        timer, users = self.state.get() or (None, [])
        return timer, {(x[0], x[1]): [*x[2:6], dict(x[6]), x[7]] for x in users}

    def _keep(self, timer: int | None, users: dict) -> None:
        new = min((x[1] // 1000 + self.gap for x in users.values() if x[2]), default=None)
        if new != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if new is not None:
                self.handle.registerTimer(new)
        self.state.update((new, [(*who, *x) for who, x in users.items()]))

    @staticmethod
    def _close(who: tuple, x: list, ended: list) -> None:
        top = min((-many, kind) for kind, many in x[4].items())[1]
        ended.append((who[1] if who[0] else None, pd.Timestamp(x[0], unit="us"), x[2], top, x[3] / 100, x[5]))
        x[:] = [0, 0, 0, 0, {}, x[5] + 1]

    @staticmethod
    def _told(ended: list) -> Iterator[pd.DataFrame]:
        if ended:
            out = pd.DataFrame(ended, columns=["user_id", "start", "n", "top", "total", "before"])
            yield out.assign(user_id=pd.array([r[0] for r in ended], "Int64"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted(row for some in rows for row in zip(*(some[c].tolist() for c in ("at", "event_id", "known", "user", "event_type", "cents")), strict=True))
        (timer, users), ended, gap = self._held(), [], 1000 * self.gap
        for at, _, known, user, kind, cents in events:
            x = users.get((known, user))
            if x is None:
                x = users[known, user] = [0, 0, 0, 0, {}, 0]
            if x[2] and at - x[1] >= gap:
                self._close((known, user), x, ended)
            if not x[2]:
                x[0] = at
            x[1], x[2], x[3] = at, x[2] + 1, x[3] + cents
            x[4][kind] = x[4].get(kind, 0) + 1
        self._keep(timer, users)
        yield from self._told(ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (_, users), ended, now = self._held(), [], max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for who, x in users.items():
            if x[2] and x[1] // 1000 + self.gap <= now:
                self._close(who, x, ended)
        self._keep(None, users)
        yield from self._told(ended)

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """The first event of each kind of a user. A kind is forgotten, and is new again, ttl milliseconds after it was seen: the state store drops it by itself."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "event_id long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("event_id").drop_duplicates("event_type")
        for event_id, kind in zip(batch["event_id"].tolist(), batch["event_type"].tolist(), strict=True):
            if not self.seen.containsKey((kind,)):
                self.seen.updateValue((kind,), (event_id,))
                yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "event_id": [event_id]})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, ttl: int) -> DataFrame:
    """user_id, event_type, event_id: first events of a stream (event_id, user_id, event_type), new ones after ttl milliseconds of the clock."""
    return events.select("user_id", "event_id", "event_type").groupBy("user_id").transformWithStateInPandas(FirstSeen(ttl), "user_id long, event_type string, event_id long", "append", "processingTime")


def sessions(events: DataFrame, gap: int, delay: str) -> DataFrame:
    """SESSION rows of a stream of events (event_id, user_id, event_type, value, ts); rows later than delay behind the latest one may be left out."""
    known, user = F.col("user_id").isNotNull().alias("known"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user")
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket")
    rows = events.withWatermark("ts", delay).select(bucket, known, user, "event_id", "event_type", "ts", F.unix_micros("ts").alias("at"), F.round(100 * F.col("value")).cast("long").alias("cents"))
    return rows.groupBy("bucket").transformWithStateInPandas(Sessions(gap), SESSION, "append", "eventTime")


def run_on(df: DataFrame, where: str, clocked: bool = False) -> None:
    """Run a stream over what is there now, into where/out, going on from the state in where/state; state is kept in RocksDB. A stream that goes by the clock
    has always another batch to run, so it is given one batch."""
    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = df.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(**({"once": True} if clocked else {"availableNow": True})).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    q.awaitTermination()


def in_files(events: DataFrame, files: int, where: str) -> list[DataFrame]:
    """Events cut by time into files of about equal numbers, earlier ones first. Tasks read the events side by side, and one writes a file."""
    bounds = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [k / files for k in range(1, files)], 10_000)).first()[0] or []
    cut = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>"), lambda b: b <= F.unix_micros(F.col("ts").cast("timestamp"))))
    return [events.where(cut == k).repartition(1) for k in range(len(set(bounds)) + 1)]


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events, which come in six files, one a batch; after the third the stream is stopped, and goes on from its checkpoint."""
    scratch = Scratch(spark, "state")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    parts = in_files(e, 6, scratch.path)
    for some in (parts[:3], parts[3:]):
        for part in some:
            part.write.mode("append").parquet(f"{scratch.path}/in")
        given = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
        run_on(sessions(given, 1_800_000, "1 hour"), scratch.path)
    out = spark.read.schema(SESSION).parquet(f"{scratch.path}/out")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind of each user, whose state lives for a day."""
    scratch, firsts = Scratch(spark, "first"), first_seen(source(spark, sf_dir), 86_400_000)
    run_on(firsts, scratch.path, True)
    return spark.read.schema(firsts.schema).parquet(f"{scratch.path}/out")


def outer_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of the hour after them; those without any once the watermark says that none can come."""
    a = source(spark, sf_dir).where("event_type = 'click'").selectExpr("event_id AS click", "user_id AS u", "ts AS ta").withWatermark("ta", "1 hour")
    b = source(spark, sf_dir).where("event_type = 'purchase'").selectExpr("event_id AS purchase", "user_id AS v", "ts AS tb").withWatermark("tb", "1 hour")
    return run_once(a.join(b, F.expr("u = v AND tb BETWEEN ta AND ta + INTERVAL 1 HOUR"), "leftOuter").select("click", "purchase"))


QUERIES = {"stream_state": stream_state, "stream_first_seen": stream_first_seen, "stream_outer_join": outer_joined}
_WATERMARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
SQL = {
    "stream_first_seen": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "stream_state": f"""
WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
k AS (SELECT user_id, s, event_type, row_number() OVER (PARTITION BY user_id, s ORDER BY count(*) DESC, event_type) AS rn FROM s GROUP BY 1, 2, 3),
a AS (SELECT user_id, s, min(ts) AS start, max(ts) AS last, count(*) AS n, sum(round(100 * value)::BIGINT)::BIGINT / 100 AS total, max(s) OVER (PARTITION BY user_id) AS most FROM s GROUP BY 1, 2)
SELECT a.user_id, start, n, event_type AS top, total::DOUBLE AS total, (a.s - 1)::BIGINT AS before FROM a JOIN k ON a.user_id = k.user_id AND a.s = k.s AND rn = 1
WHERE a.s < most OR date_trunc('milliseconds', last) + INTERVAL 30 MINUTE <= {_WATERMARK}""",
    # the watermark is the earlier of the two streams' latest times less an hour; a click goes out alone when it is past the hour after it
    "stream_outer_join": """
WITH w AS (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 1 HOUR AS w FROM events)
SELECT c.event_id AS click, p.event_id AS purchase FROM events c LEFT JOIN events p ON c.user_id = p.user_id AND p.event_type = 'purchase' AND epoch_us(p.ts) - epoch_us(c.ts) BETWEEN 0 AND 3600000000
WHERE c.event_type = 'click' AND (p.event_id IS NOT NULL OR c.ts + INTERVAL 1 HOUR <= (SELECT w FROM w))""",
}
