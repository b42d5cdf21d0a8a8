from pyspark.sql import functions as F

from tracelake.operators.query import custom_query, low_battery
from tracelake.streaming import ingest as T

MAPPING = {
    "primary_timeline": "t",
    "streams": [{"source_fields": ["battery"], "semantic_type": "scalar", "entity_path": "/metrics/battery"}],
}


def test_drop_folder_exactly_once_with_rejects(spark, tmp_path):
    drop, target, rejects = tmp_path / "drop", str(tmp_path / "signals"), str(tmp_path / "rejects")
    drop.mkdir()

    def run():
        T.ingest_folder(
            spark, str(drop), "json", "t double, battery double", MAPPING, "rec", "src", target, rejects=rejects
        )

    (drop / "one.json").write_text('{"t": 0, "battery": 0.5}\n{"t": 1, "battery": 0.1}\n{broken\n')
    run()
    run()
    assert spark.read.parquet(target).count() == 2
    (drop / "two.json").write_text('{"t": 2, "battery": 0.15}\n')
    run()
    signals = spark.read.parquet(target)
    assert sorted(r.time for r in signals.collect()) == [0.0, 1.0, 2.0]
    bad = spark.read.parquet(rejects).collect()
    assert len(bad) == 1 and bad[0].file.endswith("one.json") and "broken" in bad[0].text
    stream = T.read_signal_stream(spark, target)
    T.filter_stream(stream, lambda rows: low_battery(rows, 0.2), str(tmp_path / "low"))
    T.filter_stream(stream, lambda rows: custom_query(rows, operator="gte", value=0.5), str(tmp_path / "high"))
    assert spark.read.parquet(str(tmp_path / "low")).count() == 2
    assert spark.read.parquet(str(tmp_path / "high")).select(F.max("value_num")).first()[0] == 0.5
