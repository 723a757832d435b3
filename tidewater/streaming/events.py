"""The engine's operators on streams: bars, late data, keyed folds, order life, journal.

Batch and stream share their fold functions.  A micro-batch's rows reach a
stateful operator in no order, so each call sorts its own.  Windows drop what comes
behind the watermark; arrivals() tells these rows apart instead, so an account of
them can be kept beside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling_bars(events: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of span by symbol from (ts, symbol, event_id, value), emitted when the watermark passes them."""
    at = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", span), "symbol")
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select((F.unix_micros("window.end") * 1000).alias("ts_nanos"), "symbol", "open", "high", "low", "close", "volume")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a symbol's events with no gap longer than `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")


CHUNK = 10_000  # rows told at once


def keyed_fold(df: DataFrame, key: str, order: list[str], start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]], columns: list[str], output: str, state: str, idle_ms: int | None = None) -> DataFrame:
    """One output row an input row: step(state, row) -> (state, row out); the state is a tuple, kept by key.

    step sees the columns in the given order; rows of a micro-batch are sorted by
    `order`, as one array a column, and told CHUNK at a time.  With idle_ms, a key without rows for so long (of processing time) is
    forgotten and starts anew.
    """
    names, used = [c.split()[0] for c in output.split(", ")], list(dict.fromkeys([*order, *columns]))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        kept: dict[str, list[np.ndarray]] = {c: [] for c in used}
        for frame in frames:  # a batch's rows as arrays; their frames go
            for c in used:
                kept[c].append(frame[c].to_numpy(copy=True))
        arrays = {c: np.concatenate(kept.pop(c)) for c in used}
        if any(arrays[c].dtype == object for c in order):
            places = pd.DataFrame({c: arrays[c] for c in order}).sort_values(order, kind="stable").index.to_numpy()
        else:
            places = np.lexsort([arrays[c] for c in reversed(order)])
        now = held.get if held.exists else start
        for low in range(0, len(places), CHUNK):
            at, out = places[low : low + CHUNK], []
            for row in zip(*(pd.Series(arrays[c][at]).tolist() for c in columns), strict=True):
                now, made = step(tuple(now), row)
                out.append((k[0], *made))
            yield pd.DataFrame(out, columns=names)
        held.update(tuple(now))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)

    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", timeout)


def idle_alerts(df: DataFrame, key: str, limit_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, last_ms: keys whose last event is more than limit_ms of event time behind the watermark; a timer for each key.

    df: key, ts.  Each event sets its key's timer anew; an alert ends the key's state, and its next event begins one.
    """
    kind = f"{key} {df.schema[key].dataType.simpleString()}, last_ms LONG"

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = held.get[0]
            held.remove()
            yield pd.DataFrame([(k[0], last)], columns=[key, "last_ms"])
            return
        last = max([held.get[0]] if held.exists else [0])
        for frame in frames:
            last = max(last, int(frame["ms"].max()))
        held.update((last,))
        held.setTimeoutTimestamp(last + limit_ms)

    timed = df.withWatermark("ts", late).select(key, "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy(key).applyInPandasWithState(run, kind, "last_ms LONG", "append", GroupStateTimeout.EventTimeTimeout)


def ema_step(half_life: float) -> Callable[[tuple, tuple], tuple[tuple, tuple]]:
    a = 1 - 2 ** (-1 / half_life)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        seen, mean, var = state
        ts, x = row
        if not seen:
            mean, var = x, 0.0
        else:
            d = x - mean
            mean, var = mean + a * d, (1 - a) * (var + a * d * d)
        return (True, mean, var), (ts, x, mean, var)

    return step


def streaming_ema(df: DataFrame, half_life: float, key: str = "symbol") -> DataFrame:
    """ts_nanos, value -> running mean and variance by key."""
    return keyed_fold(df, key, ["ts_nanos"], (False, 0.0, 0.0), ema_step(half_life), ["ts_nanos", "value"], f"{key} STRING, ts_nanos LONG, value DOUBLE, mean DOUBLE, var DOUBLE", "seen BOOLEAN, mean DOUBLE, var DOUBLE")


LEVELS = ((7, 0.12), (6, 0.08), (5, 0.05), (4, 0.035), (3, 0.02), (2, 0.01))


def ladder_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """Loss level from the first value on; a session's open clears levels 2 to 4, level 7 stays."""
    first, level = state
    ts, nav, opens = row
    if math.isnan(first):
        first = nav
    loss = (first - nav) / first
    if level != 7:
        held = 0 if opens and 2 <= level <= 4 else level
        level = max([held, *(k for k, limit in LEVELS if loss >= limit)])
    return (first, level), (ts, nav, level)


def streaming_ladder(df: DataFrame, key: str = "run") -> DataFrame:
    return keyed_fold(df, key, ["ts_nanos"], (math.nan, 0), ladder_step, ["ts_nanos", "nav", "opens"], f"{key} STRING, ts_nanos LONG, nav DOUBLE, level INT", "first DOUBLE, level INT")


def arrivals(df: DataFrame, time: str, late: str = "10 minutes", shards: int = 64) -> DataFrame:
    """df with `watermark_ms` and `late`: whether a row came behind the watermark of the batches before its own.

    The watermark is the largest time so far less `late`.  Nothing is dropped: a
    stateful operator without a timeout sees every row.  Rows are dealt by the hash of
    their values, so a key that a third of them share is spread like any other.
    """
    names, kind = df.columns, df.schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind) + ", watermark_ms LONG, late BOOLEAN"

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        mark = held.getCurrentWatermarkMs()
        for frame in frames:
            rows = frame[names].copy()
            rows["watermark_ms"] = mark
            rows["late"] = (frame["__ms"] < mark).fillna(False).astype(bool)
            yield rows

    shard = F.pmod(F.hash(*names), F.lit(shards)).alias("__shard")
    timed = df.withWatermark(time, late).select("*", F.unix_millis(time).alias("__ms"), shard)
    return timed.groupBy("__shard").applyInPandasWithState(run, out, "seen LONG", "append", GroupStateTimeout.NoTimeout)


def late_account(told: DataFrame, time: str, span: str = "1 hour", *keys: str) -> DataFrame:
    """window, keys, on_time, late, worst_ms (how far the latest came behind the watermark): the rows of arrivals(), landed, by window."""
    behind = F.when(F.col("late"), F.col("watermark_ms") - F.unix_millis(time))
    return told.groupBy(F.window(time, span).alias("window"), *keys).agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if(F.col("late")).alias("late"), F.max(behind).alias("worst_ms"))


# What a message does to an order in a state; a move that isn't listed is illegal and changes nothing
MOVES = {
    ("New", "accept"): "Accepted",
    ("New", "reject"): "Rejected",
    ("New", "cancel"): "Cancelled",
    ("Accepted", "fill"): "PartiallyFilled",  # Filled where it is complete
    ("Accepted", "cancel"): "Cancelled",
    ("Accepted", "expire"): "Expired",
    ("New", "expire"): "Expired",
    ("PartiallyFilled", "fill"): "PartiallyFilled",
    ("PartiallyFilled", "cancel"): "Cancelled",
    ("PartiallyFilled", "expire"): "Expired",
}
DONE = ("Filled", "Rejected", "Cancelled", "Expired")
ORDER_ROW = "ts_ms LONG, seq LONG, kind STRING, status STRING, legal BOOLEAN, filled DOUBLE, vwap DOUBLE, over DOUBLE"
ORDER_STATE = "status STRING, asked DOUBLE, filled DOUBLE, paid DOUBLE, expires_ms LONG"


def order_step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
    """(state after, (status, legal, filled, vwap, over)) of one message (ts_ms, kind, qty, price, ttl_ms).

    submit opens an order of qty that expires ttl_ms later (never, without one); a
    fill beyond what is open fills the order, and `over` is the rest.  Messages to an
    order that isn't there or is done, and a second submit, are illegal.
    """
    ts, kind, qty, price, ttl = row
    if state is None:
        if kind != "submit" or not qty or qty <= 0:
            return None, (None, False, 0.0, 0.0, 0.0)
        return ("New", qty, 0.0, 0.0, ts + int(ttl) if ttl else None), ("New", True, 0.0, 0.0, 0.0)
    status, asked, filled, paid, expires = state
    after, over = MOVES.get((status, kind)), 0.0
    if kind == "fill" and (not qty or qty <= 0):
        after = None
    if after is None:
        return state, (status, False, filled, paid / filled if filled else 0.0, 0.0)
    if kind == "fill":
        taken = min(qty, asked - filled)
        over, filled, paid = qty - taken, filled + taken, paid + taken * price
        after = "Filled" if filled >= asked else after
    return (after, asked, filled, paid, expires), (after, True, filled, paid / filled if filled else 0.0, over)


def _listed(column: pd.Series) -> list:
    """A column's values, None for missing ones."""
    return column.astype(object).where(column.notna(), None).tolist()


class OrderMachine(StatefulProcessor):
    """Orders by shard: the states of a shard's orders in one value state, the earliest expiry as its event-time timer.

    Every call on the state is a round trip to the JVM, so a batch costs a few of them a
    shard, whatever the number of its orders.  Messages of a batch are taken in order of
    (time, seq).  An order whose expiry lies at or before a message's time expires before
    that message; one without further messages expires when the watermark reaches it, and
    tells a row of its own (seq null).
    """

    def __init__(self, key: str, kind: str):
        self.key, self.kind = key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [f"ids ARRAY<{self.kind}>", *(f"{name} ARRAY<{kind}>" for name, kind in (c.split() for c in ORDER_STATE.split(", "))), "timer_ms LONG"]
        self.shard = handle.getValueState("shard", ", ".join(fields))

    def _held(self) -> tuple[dict, int | None]:
        """The shard's orders by id, and its timer."""
        held = self.shard.get()
        if held is None:
            return {}, None
        ids, *parts, timer = held
        return dict(zip(ids, zip(*parts, strict=True), strict=True)), timer

    def _hold(self, orders: dict, timer: int | None, fired: int | None = None) -> None:
        """Keeps the orders; the timer is set to the earliest expiry of those that are open."""
        due = min((s[4] for s in orders.values() if s[4] is not None and s[0] not in DONE), default=None)
        # a timer runs when the watermark is beyond its time, and the one that ran is gone
        wanted = None if due is None else due - 1 if fired is None else max(due - 1, fired + 1)
        if wanted != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if orders:
            self.shard.update((list(orders), *(list(c) for c in zip(*orders.values(), strict=True)), wanted))

    def _due(self, state: tuple | None, now: int) -> bool:
        return state is not None and state[0] not in DONE and state[4] is not None and state[4] <= now

    def _expired(self, state: tuple) -> tuple[tuple, tuple]:
        after, (status, legal, filled, vwap, over) = order_step(state, (state[4], "expire", None, None, None))
        return after, (state[4], None, "expire", status, legal, filled, vwap, over)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[self.key, *(c.split()[0] for c in ORDER_ROW.split(", "))])
        return frame.astype({"seq": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        orders, timer = self._held()
        out = []
        for name, ts, seq, kind, qty, price, ttl in zip(*(_listed(frame[c]) for c in (self.key, "ts_ms", "seq", "kind", "qty", "price", "ttl_ms")), strict=True):
            ts, seq, state = int(ts), None if seq is None else int(seq), orders.get(name)
            if self._due(state, ts):
                state, told = self._expired(state)
                out.append((name, *told))
            state, made = order_step(state, (ts, kind, qty, price, ttl))
            out.append((name, ts, seq, kind, *made))
            if state is not None:
                orders[name] = state
        self._hold(orders, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        orders, timer = self._held()
        out = []
        for name, state in orders.items():
            if self._due(state, now):
                orders[name], told = self._expired(state)
                out.append((name, *told))
        self._hold(orders, timer, fired)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def order_life(df: DataFrame, key: str = "order_id", time: str = "ts", late: str = "10 minutes", shards: int = 256) -> DataFrame:
    """A row for each message and each expiry: key, ts_ms, seq, kind, status after it, legal, filled, vwap, over.

    df: key, time, seq (breaks ties of the time), kind (submit, accept, reject, fill,
    cancel), qty, price, ttl_ms.  State lives in the RocksDB store, which the query that
    runs this has to name (run_once does); messages behind the watermark are dropped by Spark.
    Orders are dealt by hash to `shards` keys of the state, a number that a checkpoint fixes.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.withWatermark(time, late).select(F.pmod(F.hash(key), F.lit(shards)).alias("__shard"), key, time, F.unix_millis(time).alias("ts_ms"), "seq", "kind", "qty", "price", "ttl_ms")
    return rows.groupBy("__shard").transformWithStateInPandas(OrderMachine(key, kind), f"{key} {kind}, {ORDER_ROW}", "Append", "EventTime")


def stale(df: DataFrame, limit: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """symbol, last event of symbols, for heartbeat checks against a clock column downstream."""
    return df.withWatermark("ts", late).groupBy(F.window("ts", limit), "symbol").agg(F.max("ts").alias("last"))


def journal(df: DataFrame, path: str, checkpoint: str):
    """Append a stream to a JSON-lines journal; the checkpoint makes each record appear once."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, to Parquet, exactly once over restarts; state in the RocksDB store."""
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)  # read when the query starts
    try:
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(name, before)
