"""Keyed state with timers: job lifecycles with stall alarms, and sightings that expire.

Events of a key are held until the watermark passes them and then folded in event-time order, so a stream that delivers
them late, in any order and in any batches gives what one pass over the ordered table gives. Timers at the earliest
event that waits and at each due time make alarms fall due by event time, also for keys that never speak again. State is kept by Spark's
state store (the RocksDB provider), as records of buckets of keys: a record for each key costs about a millisecond of a
task, whatever it holds. Events come to the state as records too, since each row handed to a processor costs tens of microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Statuses of a job, those that end it, and where each may lead.
STATUSES = ("pending", "crawling", "synthesising", "generating_overview", "completed", "failed", "no_documents", "robots_blocked", "access_denied", "no_policy_found", "site_unavailable", "analysis_failed", "thin_evidence", "interrupted")
ENDS = STATUSES[4:]
NEXT = {
    "pending": ("crawling", "synthesising", "failed", "interrupted"),
    "crawling": ("synthesising", "no_documents", "robots_blocked", "access_denied", "no_policy_found", "site_unavailable", "thin_evidence", "failed", "interrupted"),
    "synthesising": ("generating_overview", "analysis_failed", "thin_evidence", "failed", "interrupted"),
    "generating_overview": ("completed", "analysis_failed", "failed", "interrupted"),
}
STALL_SECONDS = 3600
#: Records of a fold's state; one should be a few MB at most.
BUCKETS = 1024
#: Events that are dealt to buckets together, a record for each bucket; about 10 MB of them.
PACKED = 1 << 18
#: Settings of a fold's state store: RocksDB, whose commits write what a batch changed and not snapshots of all files.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: What leaves the fold: kind is moved, illegal or stalled (lifecycle), or seen or expired (sightings).
OUT = "key long, kind string, was string, now string, at long"


class Fold:
    """Pure steps over a key's state (status, last sign of life, due time): what the processor and a batch replay share."""

    def step(self, state: tuple | None, at: int, value: str) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def many(self, events: pa.Table, known: pa.Table, until: int) -> tuple[pa.Table, pd.DataFrame]:
        """The states (KEPT) and output of many keys, from their events (WAITING), ordered by key and time, and states."""
        before = dict(zip(known["key"].to_pylist(), zip(*(known[c].to_pylist() for c in KEPT.names[1:]))))
        after: list[tuple] = []
        out: list[tuple] = []

        def fold(who: int, own: list[tuple[int, str]]) -> None:
            state, rows = replay(self, before.pop(who, None), own, until)
            out.extend((who, *row) for row in rows)
            if state is not None:
                after.append((who, *state))

        own: list[tuple[int, str]] = []
        last = None
        for who, at, value in zip(events["key"].to_pylist(), events["at"].to_pylist(), events["value"].to_pylist()):
            if own and who != last:
                fold(last, own)
                own = []
            last = who
            own.append((at, value))
        if own:
            fold(last, own)
        for who in list(before):
            fold(who, [])
        columns = list(zip(*after)) or [()] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, KEPT)], schema=KEPT), _frame(out)


class Lifecycle(Fold):
    """A job's status. A status that may not follow is reported and changes nothing; without a sign of life the job fails."""

    def __init__(self, seconds: int = STALL_SECONDS):
        self.micros = seconds * 1_000_000

    def step(self, state, at, value):
        was = state[0] if state else None
        if was in ENDS or value not in (STATUSES[:1] if was is None else (was, *NEXT[was])):
            return state, [("illegal", was, value, at)]
        out = [] if value == was else [("moved", was, value, at)]
        return (value, at, None if value in ENDS else at + self.micros), out

    def due(self, state):
        return ("failed", state[2], None), [("stalled", state[0], "failed", state[2])]


class Sightings(Fold):
    """The first sighting of a key counts; further ones do not, until it expires some time after it was counted."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def step(self, state, at, value):
        return (state, []) if state else (("seen", at, at + self.micros), [("seen", None, value, at)])

    def due(self, state):
        return None, [("expired", "seen", None, state[2])]

    def many(self, events, known, until):
        """The same by columns: from each event, its key's next one that counts is looked up, and all keys go on together."""
        n, key, at = events.num_rows, events["key"].to_numpy(), events["at"].to_numpy()
        keys, first = np.unique(key, return_index=True)
        ends, rank = np.append(first[1:], n), np.searchsorted(keys, key)
        low = int(at.min()) if n else 0
        span = (int(at.max()) - low if n else 0) + self.micros + 1
        if not n or len(keys) * span >= 1 << 62:
            return super().many(events, known, until)
        place = rank * span + (at - low)
        after = np.searchsorted(place, place + self.micros, side="right")
        had, due = known["key"].to_numpy(), known["due"].to_numpy()
        spot = np.minimum(np.searchsorted(keys, had), len(keys) - 1)
        speaks = keys[spot] == had
        now = first.copy()  # the next event of each key that counts, if it is before the key's end
        over = np.clip(due[speaks] - low, -1, span - 1)
        now[spot[speaks]] = np.searchsorted(place, spot[speaks] * span + over, side="right")
        back = now < ends
        gone = np.zeros(len(had), bool)  # states that an event follows
        gone[speaks] = back[spot[speaks]]
        seen, going = [], np.flatnonzero(back)
        while len(going):
            seen.append(now[going])
            now[going] = after[now[going]]
            going = going[now[going] < ends[going]]
        counted = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        whose, ended = key[counted], at[counted] + self.micros
        last = np.append(whose[1:] != whose[:-1], True)[: len(counted)]  # of its key
        left = ~gone & (due > until)
        stays = last & (ended > until)
        states = [pa.array(np.append(had[left], whose[stays])), pa.array(["seen"] * int(left.sum() + stays.sum()), pa.string()), pa.array(np.append(known["at"].to_numpy()[left], at[counted][stays])), pa.array(np.append(due[left], ended[stays]))]
        sighted = pd.DataFrame({"key": whose, "kind": "seen", "was": None, "now": events["value"].take(pa.array(counted)).to_pandas(), "at": at[counted]})
        expired = pd.DataFrame({"key": np.append(had[~left], whose[~stays]), "kind": "expired", "was": "seen", "now": None, "at": np.append(due[~left], ended[~stays])})
        return pa.table(states, schema=KEPT), pd.concat([sighted.astype(object), expired.astype(object)], ignore_index=True)


def replay(fold: Fold, state: tuple | None, events: list[tuple[int, str]], until: int) -> tuple[tuple | None, list[tuple]]:
    """Folds ordered events, and what falls due up to a time, in the order of time; an event at the due time comes first."""
    out: list[tuple] = []
    for at, value in events:
        while state and state[2] is not None and state[2] < at:
            state, rows = fold.due(state)
            out += rows
        state, rows = fold.step(state, at, value)
        out += rows
    while state and state[2] is not None and state[2] <= until:
        state, rows = fold.due(state)
        out += rows
    return state, out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "kind", "was", "now", "at"], dtype=object)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


WAITING = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("tie", pa.int64()), ("value", pa.string())])
KEPT = pa.schema([("key", pa.int64()), ("status", pa.string()), ("at", pa.int64()), ("due", pa.int64())])
RECORD = "bucket long, ts timestamp, data binary"


def dealt(batches: Iterator[pa.RecordBatch], rows: int = PACKED) -> Iterator[pa.RecordBatch]:
    """RECORD for events (bucket and WAITING): a record for each bucket among so many rows, at the time of its last event."""
    held: list[pa.RecordBatch] = []

    def records() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        own = table.select(WAITING.names).cast(WAITING).take(pa.array(order)).combine_chunks()
        parts = [own.slice(a, b - a) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)])]
        last = pa.array([pc.max(part["at"]).as_py() for part in parts], pa.int64()).cast(pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(names), last, pa.array(map(_packed, parts), pa.binary())], names=["bucket", "ts", "data"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield records()
            held = []
    if sum(b.num_rows for b in held):
        yield records()


class Processor(StatefulProcessor):
    """Holds the events (key, at, tie, value) of a bucket of keys until the watermark has passed them, then replays them.

    Events come as rows, or as records of them (data). Spark drops a record if its last event is late; events in others
    that are earlier than what the bucket has replayed are dropped here.

    A bucket's events and its keys' states are Arrow tables in one record each, so that the state store is asked a few
    times for each bucket and batch, however many keys there are; only keys with events or due times are replayed.
    """

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "data binary")
        self.states = handle.getValueState("states", "data binary")
        self.timer = handle.getValueState("timer", "ms long")
        self.upto = handle.getValueState("upto", "us long")

    def _wake(self, at: int | None) -> None:
        """One timer, at the earliest time that something may fall due."""
        was = self.timer.get()[0] if self.timer.exists() else None
        if at is None or was is not None and was <= at // 1000 + 1:
            return
        if was is not None:
            self.handle.deleteTimer(was)
        self.handle.registerTimer(at // 1000 + 1)
        self.timer.update((at // 1000 + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts: list[pa.Table] = []
        for part in rows:
            if "data" in part:
                parts += [pa.ipc.open_stream(bytes(data)).read_all() for data in part["data"]]
            else:
                parts.append(pa.Table.from_pandas(part[WAITING.names], schema=WAITING, preserve_index=False))
        table = pa.concat_tables(parts).combine_chunks()
        if self.upto.exists():
            table = table.filter(pc.greater_equal(table["at"], self.upto.get()[0]))
        self.waiting.appendList([(_packed(table),)])
        self._wake(pc.min(table["at"]).as_py())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = [pa.ipc.open_stream(bytes(e[0])).read_all() for e in self.waiting.get()] if self.waiting.exists() else []
        events = pa.concat_tables([*held, WAITING.empty_table()])
        known = pa.ipc.open_stream(bytes(self.states.get()[0])).read_all() if self.states.exists() else KEPT.empty_table()
        early = pc.less(events["at"], until)
        ready, rest = events.filter(early).sort_by([(c, "ascending") for c in WAITING.names]), events.filter(pc.invert(early))
        moves = pc.or_(pc.is_in(known["key"], ready["key"].combine_chunks()), pc.fill_null(pc.less(known["due"], until), False))
        now, still = known.filter(moves), known.filter(pc.invert(moves))
        after, out = self.fold.many(ready.combine_chunks(), now.combine_chunks(), until - 1)
        if key[0] < 0:
            out["key"] = None
        self.upto.update((until,))
        if ready.num_rows:
            self.waiting.clear()
            if rest.num_rows:
                self.waiting.put([(_packed(rest),)])
        states = pa.concat_tables([still, after])
        if states.num_rows:
            self.states.update((_packed(states),))
        else:
            self.states.clear()
        times = [pc.min(rest["at"]).as_py(), pc.min(states["due"]).as_py()]
        self._wake(min((t for t in times if t is not None), default=None))
        return iter([out] if len(out) else [])

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Fold, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """OUT for a stream of (key, ts, tie, value); events that are too late for the watermark are dropped.

    buckets: how many records the state has; it must stay as it was when a stream goes on.
    """
    key = F.col("key").cast("long")
    bucket = F.when(key.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))  # null is a key of its own
    keyed = events.select(bucket.cast("long").alias("bucket"), F.coalesce(key, F.lit(0)).alias("key"), F.unix_micros("ts").alias("at"), F.col("tie").cast("long").alias("tie"), "value")
    keyed = keyed.select("bucket", *WAITING.names).mapInArrow(dealt, RECORD).withWatermark("ts", late)
    return keyed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Processor(fold), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def batch_replay(events: DataFrame, fold: Fold, until: Column) -> DataFrame:
    """OUT of a finished table in one pass: each key's events in order, folded by the same steps."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["at", "tie", "value"])
        _, out = replay(fold, None, list(zip(ordered["at"].tolist(), ordered["value"].tolist())), int(rows["until"].iloc[0]))
        return _frame([(key[0], *row) for row in out])

    own = events.select(F.col("key").cast("long").alias("key"), F.unix_micros("ts").alias("at"), F.col("tie").cast("long").alias("tie"), "value", until.alias("until"))
    return own.groupBy("key").applyInPandas(run, OUT)
