"""Late rows and order life over several micro-batches against the same rules row by row."""

import datetime
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidewater.streaming import events as st

ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(minutes):
    return ZERO + datetime.timedelta(minutes=minutes)


def batches(spark, folder, schema, parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return st.read_events(spark, str(folder), schema)


def test_late_rows_are_told_and_none_is_lost(spark, tmp_path):
    schema = "id long, ts timestamp"
    parts = [[(1, at(0)), (2, at(60))], [(3, at(49)), (4, at(50)), (5, at(200)), (6, None)], [(7, at(189)), (8, at(190)), (9, at(10))]]
    s = st.arrivals(batches(spark, tmp_path / "in", schema, parts), "ts")
    for _ in range(2):  # a restart adds nothing
        st.run_once(s, str(tmp_path / "out"), str(tmp_path / "state"))
    told = spark.read.parquet(str(tmp_path / "out"))
    got = {r.id: r.late for r in told.collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False, 9: True}
    account = {r.window.start.hour: (r.on_time, r.late, r.worst_ms) for r in st.late_account(told, "ts", "1 hour").collect() if r.window}
    assert sum(a + b for a, b, _ in account.values()) == 8 and account[0] == (2, 2, 180 * 60_000)


ORDERS = "order_id string, ts timestamp, seq long, kind string, qty double, price double, ttl_ms long"


def test_order_life_over_batches(spark, tmp_path):
    hour = 3_600_000
    parts = [
        [("a", at(0), 1, "submit", 10.0, None, 2 * hour), ("b", at(1), 2, "submit", 5.0, None, None), ("c", at(2), 3, "accept", None, None, None), ("d", at(3), 4, "submit", 4.0, None, hour), ("e", at(3), 5, "submit", 0.0, None, None)],
        [("a", at(30), 6, "accept", None, None, None), ("b", at(31), 7, "reject", None, None, None), ("a", at(40), 8, "fill", 4.0, 2.0, None), ("b", at(41), 9, "fill", 1.0, 1.0, None), ("d", at(45), 10, "cancel", None, None, None)],
        [("a", at(130), 11, "fill", 9.0, 3.0, None), ("f", at(131), 12, "submit", 3.0, None, hour), ("f", at(132), 13, "accept", None, None, None), ("f", at(133), 14, "fill", 5.0, 7.0, None)],
        [("g", at(600), 15, "submit", 1.0, None, hour)],
        [("a", at(601), 16, "cancel", None, None, None)],
    ]
    s = st.order_life(batches(spark, tmp_path / "in", ORDERS, parts))
    st.run_once(s, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.order_id, r.ts_ms, r.seq is not None)):
        got.setdefault(r.order_id, []).append((r.kind, r.status, r.legal, r.filled, round(r.vwap, 6), r.over))
    assert got["a"] == [("submit", "New", True, 0, 0, 0), ("accept", "Accepted", True, 0, 0, 0), ("fill", "PartiallyFilled", True, 4, 2, 0), ("expire", "Expired", True, 4, 2, 0), ("fill", "Expired", False, 4, 2, 0), ("cancel", "Expired", False, 4, 2, 0)]
    assert got["b"] == [("submit", "New", True, 0, 0, 0), ("reject", "Rejected", True, 0, 0, 0), ("fill", "Rejected", False, 0, 0, 0)]
    assert [x[1:3] for x in got["c"]] == [(None, False)] and [x[1:3] for x in got["e"]] == [(None, False)]
    assert [x[0] for x in got["d"]] == ["submit", "cancel"]  # its timer went with it
    assert got["f"][-1] == ("fill", "Filled", True, 3, 7, 2)
    assert [x[0] for x in got["g"]] == ["submit"]


def test_keyed_fold_holds_arrays_and_tells_chunks():
    class Frame:
        groupBy = lambda self, key: self
        applyInPandasWithState = lambda self, run, *rest: run

    class Held:
        hasTimedOut, exists, kept = False, False, None

        def update(self, state):
            self.kept = state

    n = 100_000
    ts = np.random.default_rng(5).permutation(n)
    frames = (pd.DataFrame({"symbol": ["A"] * 10_000, "ts_nanos": ts[i : i + 10_000], "value": ts[i : i + 10_000] * 0.5}) for i in range(0, n, 10_000))
    held, at, state = Held(), 0, (False, 0.0, 0.0)
    run = st.streaming_ema(Frame(), 5)
    tracemalloc.start()
    for told in run(("A",), frames, held):
        assert len(told) <= st.CHUNK
        for row in told.itertuples(index=False, name=None):
            state, made = st.ema_step(5)(state, (at, at * 0.5))
            assert row == ("A", *made)
            at += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and held.kept == state
    assert peak < 100 * n  # bytes; a list of all rows takes several times that


def test_orders_share_a_bounded_number_of_states(spark, tmp_path):
    """Calls on the state are round trips, so they go by shard and not by order; expiries of one shard differ."""
    parts = [
        [(f"o{k}", at(0), k, "submit", 1.0, None, (10 + k % 30) * 60_000) for k in range(600)],
        [("z", at(30), 600, "submit", 1.0, None, None)],  # the watermark is 20 minutes after the start
    ]
    s = st.order_life(batches(spark, tmp_path / "in", ORDERS, parts))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, st.ROCKS)
    try:
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert max(p.stateOperators[0].numRowsUpdated for p in q.recentProgress) <= 256
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.order_id for r in rows if r.kind == "submit") == sorted([f"o{k}" for k in range(600)] + ["z"])
    gone = {r.order_id: r.ts_ms for r in rows if r.kind == "expire"}
    start = min(r.ts_ms for r in rows if r.kind == "submit")
    assert gone == {f"o{k}": start + (10 + k % 30) * 60_000 for k in range(600) if k % 30 <= 10} and len(rows) == 601 + len(gone)


@pytest.mark.parametrize("status", sorted({s for s, _ in st.MOVES}) + list(st.DONE))
def test_moves(status):
    state = (status, 4.0, 1.0, 2.0, None)
    for kind in ("submit", "accept", "reject", "fill", "cancel", "expire"):
        after, (told, legal, filled, _, over) = st.order_step(state, (5, kind, 5.0, 3.0, None))
        assert legal == ((status, kind) in st.MOVES)
        assert after == state if not legal else (after[0], told) == (told, after[0]) and told in ("Accepted", "Rejected", "Cancelled", "Expired", "Filled")
        assert (filled, over) == ((4.0, 2.0) if legal and kind == "fill" else (1.0, 0.0))
