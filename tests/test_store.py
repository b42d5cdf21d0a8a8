"""The store: what a replace writes, what readers see, conflicts, broken commits and the ledger of landed files."""

import os

import pytest
from pyspark.sql import functions as F

from tracelake.plans import sinks as K
from tracelake.plans import store
from tracelake.schema import SIGNAL_SCHEMA


def signals(spark, recordings, rows=20, value=1.0):
    made = spark.range(rows).select(F.explode(F.array(*[F.lit(r) for r in recordings])).alias("recording_id"), F.col("id").alias("ord"))
    made = made.selectExpr(
        "recording_id", "'s' source_id", "cast(ord as double) time", "'/m/v' entity_path", "'scalar' semantic_type", "'v' key",
        "'double' value_type", f"cast(ord + {value} as double) value_num", "cast(null as string) value_str", "ord",
    )
    return made.select(*SIGNAL_SCHEMA.fieldNames())


def data_files(path):
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def totals(frame):
    return {r.recording_id: (r.n, r.s) for r in frame.groupBy("recording_id").agg(F.count("*").alias("n"), F.sum("value_num").alias("s")).collect()}


def test_replace_writes_only_its_recordings(spark, tmp_path):
    path = str(tmp_path / "store")
    everything = signals(spark, [f"r{i:03d}" for i in range(200)], 50).withColumn("value_str", F.sha2(F.concat("recording_id", F.col("ord").cast("string")), 256))
    assert K.write_signals(everything, path) == 1
    before = data_files(path)
    assert K.write_signals(signals(spark, ["r007"], 5, 100.0), path) == 2
    after = data_files(path)
    assert before.items() <= after.items()
    fresh = sum(after.values()) - sum(before.values())
    assert fresh < 0.2 * sum(before.values())
    got = totals(K.read_signals(spark, path))
    assert len(got) == 200 and got["r007"] == (5, 510.0) and got["r008"] == (50, 1275.0)
    # a reader of an earlier version still sees it
    assert totals(K.read_signals(spark, path, version=1))["r007"] == (50, 1275.0)


def test_files_are_chosen_by_the_log(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(4):
        K.write_signals(signals(spark, [f"r{i}"], 10).withColumn("time", F.col("time") + 100 * i), path)
    assert len(K.read_signals(spark, path).inputFiles()) == 4
    one = K.read_signals(spark, path, ["r2"])
    assert len(one.inputFiles()) == 1 and one.count() == 10
    timed = K.read_signals(spark, path, times=(95.0, 205.0))
    assert len(timed.inputFiles()) == 2 and totals(timed) == {"r1": (10, 55.0), "r2": (6, 21.0)}
    assert K.read_signals(spark, path, ["none"]).count() == 0
    assert K.read_signals(spark, str(tmp_path / "nothing")).count() == 0


def test_broken_commit_is_not_there(spark, tmp_path):
    path = str(tmp_path / "store")
    K.write_signals(signals(spark, ["a", "b"]), path)
    seen = store.snapshot(spark, path)
    # a writer that dies before its marker leaves files that no reader opens
    rows = signals(spark, ["a"], 3)
    rows.write.parquet(f"{path}/data/dead")
    assert totals(K.read_signals(spark, path)) == {"a": (20, 210.0), "b": (20, 210.0)}
    # two writers from one snapshot: the second changes nothing
    assert store.append(rows, seen, ["recording_id"], True) == 2
    with pytest.raises(store.Conflict):
        store.append(signals(spark, ["b"], 1), seen, ["recording_id"], True)
    assert totals(K.read_signals(spark, path)) == {"a": (3, 6.0), "b": (20, 210.0)}


def test_null_recordings(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = signals(spark, ["a"]).unionByName(signals(spark, ["x"], 4).withColumn("recording_id", F.lit(None).cast("string")))
    K.write_signals(rows, path)
    K.write_signals(signals(spark, ["x"], 2).withColumn("recording_id", F.lit(None).cast("string")), path)
    assert totals(K.read_signals(spark, path)) == {"a": (20, 210.0), None: (2, 3.0)}


def test_tidy_and_expire(spark, tmp_path):
    path = str(tmp_path / "store")
    K.write_signals(signals(spark, ["a", "b", "c"]), path)
    K.write_signals(signals(spark, ["b"], 7), path)
    want = totals(K.read_signals(spark, path))
    assert K.tidy_signals(spark, path) == 3 and totals(K.read_signals(spark, path)) == want
    assert K.tidy_signals(spark, path) is None
    assert store.expire(store.snapshot(spark, path)) > 0 and totals(K.read_signals(spark, path)) == want


def test_landed_files_are_taken_once(spark, tmp_path):
    landed, path = str(tmp_path / "landed"), str(tmp_path / "store")
    signals(spark, ["a", "b"], 10).write.parquet(landed)
    assert K.compact_signals(spark, landed, path) == 1
    assert K.compact_signals(spark, landed, path) is None
    # the second call opens no landed file: it does not see that they are no longer readable
    for d, _, names in os.walk(landed):
        for name in names:
            if name.endswith(".parquet"):
                size, times = os.path.getsize(f"{d}/{name}"), os.stat(f"{d}/{name}")
                with open(f"{d}/{name}", "r+b") as file:
                    file.write(b"\0" * size)
                os.utime(f"{d}/{name}", ns=(times.st_atime_ns, times.st_mtime_ns))
    assert K.compact_signals(spark, landed, path) is None
    other = str(tmp_path / "other")
    signals(spark, ["a"], 3, 50.0).write.parquet(other)
    signals(spark, ["c"], 3).write.mode("append").parquet(other)
    assert K.compact_signals(spark, other, path) == 2
    assert totals(K.read_signals(spark, path)) == {"a": (10, 55.0 + 3 * 49.0), "b": (10, 55.0), "c": (3, 6.0)}
    # before the correction: the ledger belongs to its version
    assert store.snapshot(spark, path, 1).taken().count() < store.snapshot(spark, path).taken().count()


def test_landed_rows_are_taken_in_parts(spark, tmp_path, monkeypatch):
    """Rows are shuffled in parts, each with all rows of its recordings; it is one commit."""
    monkeypatch.setattr(store, "PART_ROWS", 40)
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    landed, path, ids = str(tmp_path / "landed"), str(tmp_path / "store"), [None, *"abcdefg"]
    rows = spark.range(30).select(F.explode(F.array(*[F.lit(r).cast("string") for r in ids])).alias("recording_id"), F.col("id").alias("ord"))
    rows = rows.join(signals(spark, ["x"], 30).drop("recording_id"), "ord").select(*SIGNAL_SCHEMA.fieldNames())
    rows.write.parquet(landed)
    assert K.compact_signals(spark, landed, path) == 1
    assert totals(K.read_signals(spark, path)) == {r: (30, 465.0) for r in ids}
    fixed = rows.filter("recording_id in ('a', 'c') and ord < 3 or recording_id is null and ord = 0").withColumn("value_num", F.lit(100.0))
    fixed = fixed.withColumn("time", F.lit(7.0)).unionByName(signals(spark, ["g"], 2).withColumn("ord", F.col("ord") + 50)).unionByName(signals(spark, ["new"], 4))
    fixed.write.mode("append").parquet(landed)
    assert K.compact_signals(spark, landed, path) == 2
    assert K.compact_signals(spark, landed, path) is None
    want = {r: (30, 465.0) for r in ids} | {"a": (30, 759.0), "c": (30, 759.0), None: (30, 564.0), "g": (32, 468.0), "new": (4, 10.0)}
    assert totals(K.read_signals(spark, path)) == want
    assert totals(K.read_signals(spark, path, version=1)) == {r: (30, 465.0) for r in ids}
    assert totals(K.read_signals(spark, path, ["c", "g"])) == {r: want[r] for r in ("c", "g")}
    # several folders of data for each of two commits
    assert len({name.split("-")[0] for name in os.listdir(f"{path}/data")}) == 2 < len(os.listdir(f"{path}/data"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
