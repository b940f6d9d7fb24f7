"""Write semantics."""

from swapledger.sources import writers as W


def test_insert_keeps_first(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    W.append_new(spark, path, a, ["k"], ["v"])
    W.append_new(spark, path, spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string"), ["k"], ["v"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "y")]


def test_upsert_snapshots(spark, tmp_path):
    root = str(tmp_path / "u")
    W.upsert_snapshot(spark, root, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"], ["v"])
    W.upsert_snapshot(spark, root, spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string"), ["k"], ["v"])
    df, version = W.current(spark, root)
    assert version == 2 and sorted((r.k, r.v) for r in df.collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_current_skips_unfinished_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert W.current(spark, root) == (None, 0)
    W.write_snapshot(df, root, 2)
    W.write_snapshot(spark.createDataFrame([(9, "z")], "k int, v string"), root, 10)
    (tmp_path / "s" / "snapshot=10" / "_SUCCESS").unlink()
    found, version = W.current(spark, root)
    assert version == 2 and found.collect() == df.collect()
