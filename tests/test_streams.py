"""Streams whose rows come late, twice, in several batches, or after a restart."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.sources.keyed import KeyedTable, committed
from swapledger.streaming import jobs as J
from swapledger.streaming import stateful as S

DAY = datetime(2024, 1, 1)


def deliver(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/a{number}")


def test_counter_goes_on_after_a_restart_and_forgets_idle_keys(spark, tmp_path):
    arrivals, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k int, id int, at timestamp"
    day = lambda d: DAY + timedelta(days=d)

    def drain():
        stream = J.file_stream(spark, f"{arrivals}/*", spark.read.parquet(f"{arrivals}/*").schema, files_per_batch=1)
        J.number_across_batches(stream, "k", ["id"], "at", target, "n", checkpoint, delay="1 day", idle="30 days")

    deliver(spark, arrivals, 0, [(1, 2, day(0)), (1, 1, day(0)), (2, 1, day(0))], schema)
    deliver(spark, arrivals, 1, [(1, 3, day(3))], schema)
    drain()
    deliver(spark, arrivals, 2, [(1, 5, day(10)), (1, 4, day(10)), (3, 1, day(10))], schema)
    drain()
    got = lambda: sorted((r.k, r.id, r.n) for r in spark.read.parquet(target).collect())
    assert got() == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4), (2, 1, 0), (3, 1, 0)]
    # Key 2 was last seen on day 0, so its counter is gone once the watermark passes day 30.
    deliver(spark, arrivals, 3, [(1, 6, day(35))], schema)
    drain()
    deliver(spark, arrivals, 4, [(2, 7, day(36)), (1, 7, day(36))], schema)
    drain()
    assert [x for x in got() if x[1] > 5] == [(1, 6, 5), (1, 7, 6), (2, 7, 0)]


def test_late_and_repeated_rows_rebuild_only_their_keys(spark, tmp_path):
    arrivals, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "k int, id int, v int, at timestamp"
    table = KeyedTable(spark, str(tmp_path / "out"), ["k"], buckets=8)
    built = []

    def build(rows):
        built.append(sorted((r.k, r["count"]) for r in rows.groupBy("k").count().collect()))
        return rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max_by("v", "at").alias("last"))

    def drain():
        stream = J.file_stream(spark, f"{arrivals}/*", spark.read.parquet(f"{arrivals}/*").schema, files_per_batch=1)
        J.rebuild_touched(stream, "k", ["k", "id"], "at", build, table, "s", delay="5 days", checkpoint=checkpoint)

    at = lambda h: DAY + timedelta(hours=h, microseconds=7)
    deliver(spark, arrivals, 0, [(1, 2, 20, at(2)), (2, 1, 5, at(0))], schema)
    deliver(spark, arrivals, 1, [(1, 1, 10, at(1)), (1, 2, 20, at(2))], schema)
    drain()
    deliver(spark, arrivals, 2, [(3, 1, 7, at(9)), (1, 3, 1, at(0))], schema)
    drain()
    assert sorted(map(tuple, table.read().collect())) == [(1, 3, 31, 20), (2, 1, 5, 5), (3, 1, 7, 7)]
    # A batch sees whole groups of its own keys and nothing of the others; empty closing batches see nothing.
    assert [b for b in built if b] == [[(1, 1), (2, 1)], [(1, 2)], [(1, 3), (3, 1)]]


def test_idle_groups_are_forgotten_and_a_missing_key_is_one_group(spark, tmp_path):
    arrivals, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "k int, id int, v int, at timestamp"
    table = KeyedTable(spark, str(tmp_path / "out"), ["k"], buckets=8)
    build = lambda rows: rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))

    def drain():
        stream = J.file_stream(spark, f"{arrivals}/*", spark.read.parquet(f"{arrivals}/*").schema, files_per_batch=1)
        J.rebuild_touched(stream, "k", ["id"], "at", build, table, "s", delay="5 days", idle="10 days", checkpoint=checkpoint)

    day = lambda d: DAY + timedelta(days=d)
    deliver(spark, arrivals, 0, [(1, 1, 1, day(0)), (None, 1, 1, day(0)), (None, 2, 2, day(0)), (2, 1, 1, day(0))], schema)
    deliver(spark, arrivals, 1, [(2, 2, 2, day(3)), (None, 3, 4, day(3)), (None, 1, 1, day(0))], schema)
    deliver(spark, arrivals, 2, [(3, 1, 1, day(30))], schema)
    drain()
    assert sorted(map(tuple, table.read().where("k is not null").collect())) == [(1, 1, 1), (2, 2, 3), (3, 1, 1)]
    assert [tuple(r) for r in table.read().where("k is null").collect()] == [(None, 3, 7)]
    # Key 1 was last seen on day 0 and the watermark is on day 25, so its group begins anew.
    deliver(spark, arrivals, 3, [(1, 9, 8, day(31)), (3, 2, 2, day(31))], schema)
    drain()
    assert sorted(map(tuple, table.read().where("k is not null").collect())) == [(1, 1, 8), (2, 2, 3), (3, 2, 3)]


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k int, v int")


def versions(spark, table, n):
    return {int(p.split("bucket=")[1]) for p in committed(spark, f"{table.root}/data/version={n}/bucket=*")}


def test_loads_write_touched_buckets_only(spark, table):
    table.insert(rows_of(spark, [(i, i) for i in range(200)]), ["v"])
    first = set(table.paths())
    assert len(first) == len(versions(spark, table, 1)) > 10
    table.insert(rows_of(spark, [(5, -1), (1000, 1), (1000, 2)]), ["v"])
    assert len(versions(spark, table, 2)) == 1 and first < set(table.paths())
    table.upsert(rows_of(spark, [(7, 70), (7, 71)]), ["v"])
    assert len(versions(spark, table, 3)) == 1 and len(first - set(table.paths())) == 1
    table.upsert(rows_of(spark, [(7, 60), (8, 80)]), ["v"], newest=True)
    got = dict(map(tuple, table.read().collect()))
    assert len(got) == 201 and got[5] == 5 and got[1000] == 1 and got[7] == 71 and got[8] == 80
    table.insert(rows_of(spark, []), ["v"])
    assert table.version() == 4


def test_replayed_batches_and_failed_loads_change_nothing(spark, table):
    table.insert(rows_of(spark, [(1, 1)]), ["v"], "a", 0)
    table.upsert(rows_of(spark, [(1, 2)]), ["v"], source="a", number=1)
    table.upsert(rows_of(spark, [(1, 9)]), ["v"], source="a", number=1)
    table.insert(rows_of(spark, [(2, 2)]), ["v"], "b", 0)
    # Rows of a load whose manifest was never written.
    rows_of(spark, [(3, 3)]).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{table.root}/data/version=4")
    assert sorted(map(tuple, table.read().collect())) == [(1, 2), (2, 2)]
    table.insert(rows_of(spark, [(4, 4)]), ["v"])
    assert sorted(map(tuple, table.read().collect())) == [(1, 2), (2, 2), (4, 4)]


def test_a_bucket_of_many_inserts_is_written_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("swapledger.sources.keyed.MOST", 3)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
    for i in range(5):
        table.insert(rows_of(spark, [(i, i)]), ["v"])
        assert len(table.paths()) <= 3
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 3, 4]


def test_groups_are_replaced(spark, table):
    table.replace_groups(rows_of(spark, [(1, 1), (1, 2), (2, 5)]))
    table.replace_groups(rows_of(spark, [(1, 3)]))
    assert sorted(map(tuple, table.read().collect())) == [(1, 3), (2, 5)]


class Kept:
    """A state value that lives in this process."""

    def __init__(self):
        self.held = None

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Slots(dict):
    """A map of state values, and the keys that were asked for."""

    asked = ()

    def getValue(self, key):
        self.asked = (*self.asked, *key)
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, name, key, value):
        return Slots()

    def getValueState(self, name, schema):
        return Kept()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_one_call_numbers_all_keys_of_a_bin():
    handle = Handle()
    counter = S.Counter(["k", "id", "_ms"], T.StructField("k", T.LongType()), ["id"], "_ms", "n", 100)
    counter.init(handle)

    def call(*rows):
        frame = next(counter.handleInputRows(None, iter([pd.DataFrame(rows, columns=["k", "id", "_ms"])]), None))
        return sorted(zip(frame["k"], frame["id"], frame["n"]))

    assert call((1, 2, 5), (2, 1, 9), (1, 1, 5)) == [(1, 1, 0), (1, 2, 1), (2, 1, 0)]
    assert call((2, 3, 50)) == [(2, 3, 1)]
    # Key 1 is idle from 105 on, key 2 from 150 on.
    assert handle.timers == {105}
    assert list(counter.handleExpiredTimer(None, Now(110), None)) == [] and 150 in handle.timers
    assert call((1, 4, 120), (2, 4, 120)) == [(1, 4, 0), (2, 4, 2)]


def test_one_call_keeps_all_keys_of_a_bin():
    handle, names = Handle(), ["k", "id", "s", "_ms", "_slot"]
    kinds = T.StructType([T.StructField(n, T.StringType() if n == "s" else T.LongType()) for n in names[:-1]])
    keeper = S.GroupKeeper(names, kinds, "k", ["id"], "_ms", "_slot", 100, slots=4)
    keeper.init(handle)

    def call(*rows):
        keeper.rows.asked = ()
        frames = list(keeper.handleInputRows(None, iter([pd.DataFrame(rows, columns=names)]), None))
        return sorted(tuple(r) for f in frames for r in f[["k", "id", "s"]].itertuples(index=False))

    # Keys 1 and 2 share a slot; ids count by key, and the first row of an id stays.
    assert call((1, 1, "a", 5, 0), (2, 1, "b", 9, 0), (3, 1, "", 7, 3), (1, 1, "x", 5, 0)) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "")]
    assert handle.timers == {105}
    assert call((1, 2, "c", 50, 0), (2, 1, "y", 60, 0)) == [(1, 1, "a"), (1, 2, "c")] and keeper.rows.asked == (0,)
    assert call((1, 2, "c", 50, 0)) == [] and handle.timers == {107}
    # A row without a time sets no timer.
    assert call((4, 1, "z", None, 1)) == [(4, 1, "z")] and handle.timers == {107}
    # Key 3 is idle from 107 on, key 2 from 109 on, key 1 from 150 on.
    assert list(keeper.handleExpiredTimer(None, Now(109), None)) == [] and set(keeper.rows) == {(0,), (1,)} and 109 in handle.timers
    assert list(keeper.handleExpiredTimer(None, Now(110), None)) == [] and 150 in handle.timers
    assert call((1, 3, "e", 120, 0), (2, 2, "d", 120, 0), (3, 1, "f", 120, 3)) == [(1, 1, "a"), (1, 2, "c"), (1, 3, "e"), (2, 2, "d"), (3, 1, "f")]
    assert 220 in handle.timers and 150 not in handle.timers
