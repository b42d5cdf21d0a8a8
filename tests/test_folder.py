"""Import of a folder of mixed files: a recording of every file, each by its own layout, as alone."""

import json

import pytest
from conftest import SENSOR_CSV, SENSOR_JSONL
from pyspark.sql import functions as F

from tracelake.plans.workflow import import_folder, import_source
from tracelake.sources import mixed


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("drop")
    (base / "deep").mkdir()
    (base / "a.csv").write_text(SENSOR_CSV)
    (base / "b.jsonl").write_text(SENSOR_JSONL)
    (base / "deep" / "c.tsv").write_text("t\tdepth\twet\tnote\n3\t1.50\tTRUE\tfirst\n1\t2.25\tfalse\t\n2\t\ttrue\tsecond\n")
    (base / "d.CSV").write_text("time;x\n1;2\n" + "")
    (base / "e.log").write_text("boot done\n\nERROR pump stuck\n")
    (base / "f.csv").write_text("time,v\n5,1\n6,2\n")
    (base / "g.csv").write_text("time,v\n5,1\n6,2\n")
    (base / "skipped.bin").write_bytes(b"\x00\x01")
    return base


@pytest.fixture(scope="module")
def done(spark, folder):
    return import_folder(spark, str(folder), "run")


def names(done):
    return {r.source_id.rsplit("/", 1)[1]: r.recording_id for r in done.recordings.collect()}


def test_every_file_is_a_recording(done):
    assert names(done) == {
        "a.csv": "run_001", "b.jsonl": "run_002", "d.CSV": "run_003", "c.tsv": "run_004", "e.log": "run_005", "f.csv": "run_006", "g.csv": "run_007"
    }
    rows = {r.source_id.rsplit("/", 1)[1]: r.rows for r in done.recordings.collect()}
    assert rows == {"a.csv": 5, "b.jsonl": 3, "d.CSV": 1, "c.tsv": 3, "e.log": 2, "f.csv": 2, "g.csv": 2}


@pytest.mark.parametrize("name", ["a.csv", "b.jsonl", "deep/c.tsv", "e.log", "f.csv"])
def test_as_if_imported_alone(spark, folder, done, name):
    """Fields, profiles, streams, validation and signals of a file are those of an import of that file alone."""
    alone = import_source(spark, str(folder / name), "r", "s")
    here = F.col("source_id").endswith("/" + name.rsplit("/", 1)[-1])

    def rows(frame, drop=("source_id", "recording_id", "position", "pos")):
        columns = sorted(c for c in frame.columns if c not in drop)
        return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in frame.select(*columns).collect())

    signals = rows(done.signals.filter(here))
    assert signals == rows(alone.signals) and signals
    assert rows(done.streams.filter(here)) == rows(alone.streams)
    assert rows(done.profiles.filter(here)) == rows(alone.profiles)
    assert rows(done.report.filter(here)) == rows(alone.report)
    assert rows(done.issues.filter(here)) == rows(alone.issues)


def test_places_do_not_meet(done):
    """Two files with equal rows: equal places in different recordings, never twice in one."""
    # a log's own field is called message like the joined one
    keys = done.signals.filter("recording_id != 'run_005'").groupBy("recording_id", "entity_path", "key", "ord").count()
    assert keys.filter("count > 1").count() == 0
    twins = done.signals.filter("recording_id in ('run_006', 'run_007')").groupBy("ord", "key", "value_num").count()
    assert {r["count"] for r in twins.collect()} == {2}
    profiles = done.profiles.filter("field = 'time' and source_id like '%/f.csv'").first()
    assert profiles.time_monotonic and profiles.row_count == 2


def test_rejects_are_told_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,v\n1,2\n2,3,4\n3,4\n")
    (tmp_path / "b.jsonl").write_text('{"t": 1, "v": 2}\n[1]\nnonsense\n{"t": 2, "w": {"x": {"y": 1}, "z": null}}\n')
    done = import_folder(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.jsonl")])
    bad = {(r.source_id.rsplit("/", 1)[1], r.ord, r.reason) for r in done.rejects.collect()}
    assert {(f, n) for f, n, _ in bad} == {("a.csv", 2), ("b.jsonl", 2), ("b.jsonl", 3)}
    cells = mixed.json_records(spark.createDataFrame([("f", 1, '{"w": {"x": {"y": 1}, "z": null}, "k": [1, "a"]}')], "file string, line_number long, text string"))
    assert {(c.field, c.text, c.kind) for c in cells.first().cells} == {("w.x", '{"y":1}', "string"), ("w.z", None, "string"), ("k", '[1,"a"]', "string")}


def test_given_streams(spark, folder):
    """Mapping rows of one's own instead of inferred ones."""
    plain = import_folder(spark, str(folder / "f.csv"))
    own = plain.streams.withColumn("entity_path", F.lit("/own/v"))
    done = import_folder(spark, str(folder / "f.csv"), streams=own)
    assert {r.entity_path for r in done.signals.collect()} == {"/own/v"}


def test_globs_cover_suffixes():
    glob = mixed.suffix_glob(("csv", "jsonl"))
    assert glob == "*.{[cC][sS][vV],[jJ][sS][oO][nN][lL],[nN][dD][jJ][sS][oO][nN]}"
