"""Lifecycles and stores: streams against batches, restarts, crashes, and which files an update touches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vellum.sources.buckets import BucketTable, Conflict
from vellum.sources.sinks import workspace
from vellum.streaming import lifecycle as life
from vellum.streaming import store

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_every_status_has_a_place():
    assert len(life.STATUSES) == 14 and len(life.ENDS) == 10
    assert set(life.NEXT) == set(life.STATUSES) - set(life.ENDS)
    reached = {x for ends in life.NEXT.values() for x in ends}
    assert reached == set(life.STATUSES) - {"pending"}


def test_lifecycle_steps():
    fold, hour = life.Lifecycle(3600), 3_600_000_000
    events = [(0, "crawling"), (1, "pending"), (2, "pending"), (3, "crawling"), (3 + hour, "crawling"), (4 + 2 * hour, "synthesising"), (9, "completed")]
    state, out = life.replay(fold, None, events[:5], 0)
    assert out == [("illegal", None, "crawling", 0), ("moved", None, "pending", 1), ("moved", "pending", "crawling", 3)]  # a sign at the due time counts
    state, out = life.replay(fold, state, events[5:6], 0)
    assert out == [("stalled", "crawling", "failed", 3 + 2 * hour), ("illegal", "failed", "synthesising", 4 + 2 * hour)] and state == ("failed", 3 + 2 * hour, None)
    _, out = life.replay(life.Lifecycle(1), None, [(5, "pending")], 10**9)
    assert out == [("moved", None, "pending", 5), ("stalled", "pending", "failed", 5 + 10**6)]


def test_sightings_expire():
    _, out = life.replay(life.Sightings(1), None, [(0, "seen"), (10, "seen"), (10**6, "seen"), (10**6 + 1, "seen")], 10**6 + 1)
    assert [(k, at) for k, _, _, at in out] == [("seen", 0), ("expired", 10**6), ("seen", 10**6 + 1)]


def rows_of(n=400, keys=12):
    rng = random.Random(4)
    rows = [(rng.randrange(keys), DAY + timedelta(minutes=rng.randrange(3000)), i, rng.choice(life.STATUSES[:5])) for i in range(n)]
    return rows + rows[:20]  # repeated ones


SCHEMA = "key long, ts timestamp, tie long, value string"


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = rows_of()
    fold = life.Lifecycle(3600)
    for i in range(4):
        spark.createDataFrame(rows[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = store.FoldedEvents(spark, f"{tmp_path}/out", fold, "3 days")
    out.run(events)
    out.advance(datetime(2030, 1, 1))
    out.run(events)
    want = life.batch_replay(spark.createDataFrame(rows, SCHEMA), fold, F.lit(2 * 10**15))
    assert sorted(map(tuple, out.result().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert want.where("kind = 'stalled'").count() > 0 and want.where("kind = 'illegal'").count() > 0


def test_alarm_is_raised_while_others_go_on(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    spark.createDataFrame([(1, at(0), 1, "pending"), (2, at(0), 2, "pending")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    events = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    out = store.FoldedEvents(spark, f"{tmp_path}/out", life.Lifecycle(3600), "10 minutes")
    out.run(events)
    assert out.result().where("kind = 'stalled'").count() == 0
    spark.createDataFrame([(2, at(50), 3, "crawling"), (2, at(100), 4, "synthesising")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    out.run(events)  # the watermark is at minute 90: job 1 was silent since 0, job 2 was not
    alarms = [(r["key"], r["at"]) for r in out.result().where("kind = 'stalled'").collect()]
    assert alarms == [(1, int((at(60) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 10**6))]


def stored(table):
    return sorted(tuple(r) for r in table.read().collect())


KEYED = "id long, value string"


def bucket_table(spark, tmp_path, buckets=8):
    table = BucketTable(spark, f"{tmp_path}/table", "id", spark.createDataFrame([], KEYED).schema, buckets)
    table.merge(spark.createDataFrame([(i, f"v{i}") for i in range(100)], KEYED))
    return table


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = bucket_table(spark, tmp_path)
    before = table.manifest()["folders"]
    done = table.merge(spark.createDataFrame([(7, "new"), (1000, "more")], KEYED))
    after = table.manifest()["folders"]
    touched = {str(r[0]) for r in spark.createDataFrame([(7,), (1000,)], "id long").select(table.bucket()).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and done["rewritten"] == len(touched) < 8
    changed = [f for f in table.read().inputFiles() if "data/000000000002" in f]
    assert len(changed) == len(touched)
    assert stored(table) == sorted([(i, f"v{i}") for i in range(100) if i != 7] + [(7, "new"), (1000, "more")])
    assert sorted(map(tuple, table.read(1).collect())) == sorted((i, f"v{i}") for i in range(100))  # older readers
    looked = table.lookup(spark.createDataFrame([(7,)], "id long"))
    assert [tuple(r) for r in looked.collect()] == [(7, "new")] and len(looked.inputFiles()) == 1
    table.delete(spark.createDataFrame([(i,) for i in range(100)], "id long"))
    assert stored(table) == [(1000, "more")] and len(table.manifest()["folders"]) == 1
    assert table.vacuum() == 2 and stored(table) == [(1000, "more")] and table.versions() == [3]


def test_crash_before_the_swap_and_conflicts(spark, tmp_path, monkeypatch):
    table = bucket_table(spark, tmp_path)
    change, was = spark.createDataFrame([(1, "x")], KEYED), stored(table)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.merge(change)
    assert stored(table) == was and table.versions() == [1]
    table.merge(change, source="s", batch=4)
    assert table.merge(spark.createDataFrame([(1, "y")], KEYED), source="s", batch=4)["rewritten"] == 0
    assert dict(stored(table))[1] == "x"
    stale = table.manifest(1) | {"version": 2}
    with pytest.raises(Conflict):
        table._commit(stale)
    assert BucketTable(spark, f"{tmp_path}/none", "id", table.schema).read().count() == 0


def test_page_store_survives_restarts(spark, tmp_path, monkeypatch):
    body = "words of a page that is long enough to stay " * 10
    pages = [(i, f"{body} {i % 17}", ("a", "b", None)[i % 3]) for i in range(120)] + [(500, "short", "a"), (501, None, "b"), (None, f"{body} 1", "b")]
    kind = "doc_id long, text string, source string"
    for i in range(4):
        spark.createDataFrame(pages[i::4], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    want = store.admitted(spark.createDataFrame(pages, kind)).groupBy("key").agg(F.first("owner").alias("owner"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))
    rows, commits = store.table_stream(spark, str(tmp_path), "documents"), []
    real = BucketTable._commit

    def fails(self, manifest):
        commits.append(manifest["version"])
        if len(commits) == 2:
            raise OSError("lost before the swap")
        real(self, manifest)
        if len(commits) == 4:
            raise OSError("lost after the swap")

    monkeypatch.setattr(BucketTable, "_commit", fails)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            store.PageStore(spark, f"{tmp_path}/s", 4).run(rows)
    pages_store = store.PageStore(spark, f"{tmp_path}/s", 4)  # a new process finds the checkpoint
    pages_store.run(rows)
    assert stored(pages_store.table) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
    log = spark.read.parquet(f"{tmp_path}/s/log")
    assert log.count() == 121 and log.where("action = 'insert'").count() == want.count()


def test_workspace_is_under_the_shared_folder(spark):
    assert "vellum-x-" in workspace(spark, "x")


def test_a_batch_of_pages_is_judged_once(spark, tmp_path):
    body = "words of a page that is long enough to stay " * 10
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        asked.add(1)
        return text

    pages = spark.createDataFrame([(i, f"{body} {i % 5}", "a") for i in range(40)], "doc_id long, text string, source string")
    pages_store = store.PageStore(spark, f"{tmp_path}/s", 4)
    pages_store.write(pages.withColumn("text", counted.asNondeterministic()("text")), 0)
    assert sum(r[3] for r in stored(pages_store.table)) == 40 and asked.value == 40


class Held:
    """The state store of one bucket, which counts how often it is asked."""

    def __init__(self):
        self.asked, self.timers = 0, set()

    def state(self, *_):
        store, value = self, []

        class State:
            def exists(self):
                store.asked += 1
                return bool(value)

            def get(self):
                store.asked += 1
                return iter(list(value)) if self.listed else value[0]

            def put(self, rows):
                store.asked += 1
                value[:] = rows

            def appendList(self, rows):
                store.asked += 1
                value.extend(rows)

            def update(self, row):
                self.put([row])

            def clear(self):
                self.put([])

        return State()

    def getListState(self, *_):
        out = self.state()
        out.listed = True
        return out

    def getValueState(self, *_):
        out = self.state()
        out.listed = False
        return out

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_state_is_asked_for_buckets_not_for_keys(spark):
    import pandas as pd

    rng, keys = random.Random(7), 2000
    rows = [(rng.randrange(keys), rng.randrange(10**11), i, rng.choice(life.STATUSES[:5])) for i in range(4 * keys)]
    fold, store_, out = life.Lifecycle(3600), Held(), []
    processor = life.Processor(fold)
    processor.init(store_)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.ms})()
    for part in range(4):
        own = pd.DataFrame(rows[part::4], columns=["key", "at", "tie", "value"])
        list(processor.handleInputRows((3,), iter([own[:100], own[100:]]), clock))
    for clock.ms in (3 * 10**7, 7 * 10**7, 10**9):
        for ms in [t for t in store_.timers if t <= clock.ms]:
            store_.timers.remove(ms)
            out += [tuple(r) for part in processor.handleExpiredTimer((3,), clock, None) for r in part.itertuples(index=False)]
    want = []
    for key in range(keys):
        own = sorted((at, tie, value) for k, at, tie, value in rows if k == key)
        want += [(key, *r) for r in life.replay(fold, None, [(at, v) for at, _, v in own], 10**12)[1]]
    assert sorted(out, key=str) == sorted(want, key=str) and not store_.timers
    assert store_.asked < 100  # 7 calls, 2000 keys


def test_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    from vellum.plans import lifecycles

    kind = "event_id long, ts timestamp, user_id long, event_type string"
    rows = [(i, DAY + timedelta(minutes=7 * i), i % 5, ("view", "click", "signup", "purchase", "error")[i * i % 5]) for i in range(240)]
    for i in range(8):
        spark.createDataFrame(rows[i::8], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    name = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(lifecycles, "workspace", lambda *_: f"{tmp_path}/fold")
    fold = life.Lifecycle(3600)
    out = lifecycles.folded_events(spark, str(tmp_path), fold)
    want = life.batch_replay(lifecycles.job_events(spark.createDataFrame(rows, kind)), fold, F.lit(4102444800000000))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len(list((tmp_path / "fold" / "out").glob("batch=*"))) <= 4  # the files, the time after them, and what each makes due
    assert spark.conf.get(name, None) == before


def table(rows, schema):
    import pyarrow as pa

    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, schema)], schema=schema)


def test_sightings_of_many_keys_are_those_of_each():
    rng = random.Random(3)
    for _ in range(200):
        fold, keys = life.Sightings(1), rng.randrange(1, 6)
        fold.micros = rng.choice([1, 5, 20])
        events = table(sorted((3 * rng.randrange(keys), rng.randrange(60), i, rng.choice("ab")) for i in range(rng.randrange(30))), life.WAITING)
        begun = [(k, rng.randrange(-10, 40)) for k in range(0, 3 * keys + 3, 2) if rng.random() < 0.5]
        known, until = table([(k, "seen", at, at + fold.micros) for k, at in begun], life.KEPT), rng.choice([59, 60, 70, 90])
        (own, out), (states, want) = fold.many(events, known, until), life.Fold.many(fold, events, known, until)
        assert sorted(map(str, own.to_pylist())) == sorted(map(str, states.to_pylist()))
        assert sorted(map(str, out.values.tolist())) == sorted(map(str, want.values.tolist()))


def test_events_come_to_the_state_as_records():
    import pandas as pd
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(k % 7, k, rng.randrange(10**9), i, "seen") for i, k in enumerate(rng.randrange(90) for _ in range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", *life.WAITING.names])
    records = [r for b in life.dealt(iter(batch.slice(i, 500) for i in range(0, 3000, 500)), 1500) for r in b.to_pylist()]
    assert len(records) == 2 * 7
    own = [r["data"] for r in records if r["bucket"] == 3]
    fold, store_, out = life.Sightings(60), Held(), []
    processor = life.Processor(fold)
    processor.init(store_)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.ms})()
    list(processor.handleInputRows((3,), iter([pd.DataFrame({"data": own})]), clock))
    for clock.ms in (3 * 10**5, 10**6, 2 * 10**6):  # sightings last from one to the next
        for ms in [t for t in store_.timers if t <= clock.ms]:
            store_.timers.remove(ms)
            out += [tuple(r) for part in processor.handleExpiredTimer((3,), clock, None) for r in part.itertuples(index=False)]
        late = life._packed(table([(3, 5, 0, "seen")], life.WAITING))
        list(processor.handleInputRows((3,), iter([pd.DataFrame({"data": [late]})]), clock))  # earlier than what is replayed
    want = []
    for key in range(3, 90, 7):
        events = sorted((at, tie) for _, k, at, tie, _ in rows if k == key)
        want += [(key, *r) for r in life.replay(fold, None, [(at, "seen") for at, _ in events], 10**10)[1]]
    assert sorted(out, key=str) == sorted(want, key=str) and len({r[0] for r in out}) > 5


def test_partitions_of_a_state_follow_cores(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        spark.createDataFrame([(1, DAY, 1, "seen")], SCHEMA).write.parquet(f"{tmp_path}/in")
        out = store.FoldedEvents(spark, f"{tmp_path}/out", life.Sightings(60), "10 minutes")
        out.run(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
        assert len([p for p in (tmp_path / "out" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]) == store.ROUNDS * 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
